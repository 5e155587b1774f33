"""Tables of the graph and the seed of its vocabulary."""

from __future__ import annotations

NODES = "node_id string, node_type string, name string, summary string, properties map<string,string>, source_system string, external_id string, canonical_node_id string, confidence double, created_at timestamp"
EDGES = "source_id string, target_id string, relationship string, weight double, confidence double, evidence_document_id string, properties map<string,string>"
DOCUMENTS = "document_id string, source_system string, source_type string, external_id string, title string, url string, author string, content string, raw_payload string, source_created_at timestamp, source_updated_at timestamp, resource_key string, ingested_at timestamp, content_hash string, extracted_hash string"
RAW = "source_type string, external_id string, title string, url string, author string, content string, raw_payload string, source_created_at timestamp, source_updated_at timestamp, resource_key string"
MENTIONS = "node_id string, document_id string, context string"
PROPOSALS = "proposal_id string, kind string, payload map<string,string>, confidence double, agent string, evidence map<string,string>, dedup_key string, status string, created_at timestamp, decided_at timestamp, applied_at timestamp, reviewed_by string, error string"
GRANTS = "group_name string, source_system string, resource_key string"
AUDIT = "occurred_at timestamp, subject string, groups array<string>, tool string, params string, result_ids array<string>, result_count int"

# Names of the vocabulary that graphs are seeded with.
NODE_TYPES = ["user", "team", "repository", "pull_request", "issue", "commit", "file", "feature", "service", "deployment", "incident", "slack_channel", "slack_thread", "slack_message", "document", "meeting", "participant"]
# Relationship, allowed source types, allowed target types (None: any), symmetric.
RELATIONSHIP_TYPES = [
    ("AUTHORED", ["user"], ["pull_request", "issue", "commit", "slack_message", "document"], False),
    ("REVIEWED", ["user"], ["pull_request"], False),
    ("MEMBER_OF", ["user"], ["team"], False),
    ("OWNS", ["team"], ["repository", "service"], False),
    ("PART_OF", None, None, False),
    ("MODIFIES", ["pull_request", "commit"], ["file", "feature", "service"], False),
    ("IMPLEMENTS", ["pull_request", "commit"], ["feature"], False),
    ("DISCUSSES", ["slack_thread", "slack_message", "document", "meeting"], ["feature", "pull_request", "incident", "service", "repository"], False),
    ("PARTICIPATES_IN", ["participant", "user"], ["meeting"], False),
    ("REFERENCES", None, None, False),
    ("MENTIONS", None, None, False),
    ("CAUSED", ["pull_request", "commit", "feature", "deployment"], ["incident"], False),
    ("RESOLVES", ["pull_request", "commit"], ["incident", "issue"], False),
    ("TARGETS", ["deployment"], ["repository", "service"], False),
    ("TRIGGERED_BY", ["deployment"], ["pull_request", "commit"], False),
    ("AFFECTS", ["incident"], ["service", "repository", "feature"], False),
    ("POSTED_IN", ["slack_message", "slack_thread"], ["slack_channel", "slack_thread"], False),
    ("DEPENDS_ON", ["service", "feature"], ["service", "feature"], True),
    ("RELATES_TO", None, None, True),
]
