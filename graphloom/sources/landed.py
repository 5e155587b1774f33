"""Landed artifacts of work tools, as JSON or text in a column ``payload``, to one document schema.

Every function takes rows and gives source_type, external_id, title, url, author, content, raw_payload,
source_created_at, source_updated_at, resource_key. Comments and messages are joined as ordered transcripts.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text


def _doc(df: DataFrame, source_type: str | Column, external_id: Column, title: Column, content: Column, **more: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    pick = lambda k, t="string": more.get(k, F.lit(None).cast(t)).cast(t).alias(k)
    return df.select(
        (F.lit(source_type) if isinstance(source_type, str) else source_type).alias("source_type"), external_id.cast("string").alias("external_id"), title.cast("string").alias("title"), pick("url"), pick("author"), content.alias("content"),
        more.get("raw_payload", F.col("payload") if "payload" in df.columns else none).alias("raw_payload"), pick("source_created_at", "timestamp"), pick("source_updated_at", "timestamp"), pick("resource_key"),
    )


def transcript(lines: Column) -> Column:
    """``who: said`` lines of an ordered array of (who, said)."""
    return F.array_join(F.transform(lines, lambda c: F.concat(F.coalesce(c["who"], F.lit("unknown")), F.lit(": "), F.coalesce(c["said"], F.lit("")))), "\n")


def with_comments(body: Column, comments: Column) -> Column:
    """A body and, if there are any, its comments."""
    n = F.coalesce(F.size(comments), F.lit(0))
    return F.when(n > 0, F.concat(body, F.lit("\n\n--- Comments ("), n.cast("string"), F.lit(") ---\n"), transcript(comments))).otherwise(body)


def local_notes(spark: SparkSession, folder: str, resource_key: str, most: int | None = None) -> DataFrame:
    """Markdown and text files under a folder; the payload has their sorted distinct links."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt,markdown}").load(folder)
    root = folder.rstrip("/")
    name = F.regexp_replace("path", f"^.*{root.rsplit('/', 1)[-1]}/", "")
    rows = files.select(name.alias("name"), text.decoded(F.col("content")).alias("content"))
    rows = rows.withColumn("payload", F.to_json(F.struct(F.array_sort(text.wikilinks(F.col("content"))).alias("wikilinks"))))
    rows = rows if most is None else rows.orderBy("name").limit(most)
    stem = F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"\.[^.]*$", "")
    return _doc(rows, "note", F.col("name"), stem, F.col("content"), resource_key=F.lit(resource_key))


def github_pulls(df: DataFrame, repo: str) -> DataFrame:
    p = df.withColumn("p", F.from_json("payload", "number long, title string, state string, body string, merged_at string, html_url string, created_at string, updated_at string, user struct<login:string>"))
    state = F.when(F.col("p.merged_at").isNotNull(), "merged").otherwise(F.col("p.state"))
    content = F.concat(F.lit("PR #"), F.col("p.number").cast("string"), F.lit(": "), F.col("p.title"), F.lit("\nState: "), state, F.lit("\n\n"), F.coalesce("p.body", F.lit("")))
    return _doc(p, "pull_request", F.concat(F.lit(f"{repo}#"), F.col("p.number").cast("string")), F.col("p.title"), content, url=F.col("p.html_url"), author=F.col("p.user.login"), source_created_at=scores.iso_ts(F.col("p.created_at")), source_updated_at=scores.iso_ts(F.col("p.updated_at")), resource_key=F.lit(repo))


def github_issues(df: DataFrame, comments: DataFrame, repo: str) -> DataFrame:
    """Issues without those that are pull requests; ``comments`` (number, pos, who, said) in order."""
    p = df.withColumn("p", F.from_json("payload", "number long, title string, state string, body string, pull_request string, html_url string, created_at string, updated_at string, user struct<login:string>")).where("p.pull_request is null")
    said = comments.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("pos", "who", "said"))).alias("said"))
    p = p.withColumn("number", F.col("p.number")).join(said, "number", "left")
    body = F.concat(F.lit("Issue #"), F.col("number").cast("string"), F.lit(": "), F.col("p.title"), F.lit("\nState: "), F.col("p.state"), F.lit("\n\n"), F.coalesce("p.body", F.lit("")))
    return _doc(p, "issue", F.concat(F.lit(f"{repo}#"), F.col("number").cast("string")), F.col("p.title"), with_comments(body, F.col("said")), url=F.col("p.html_url"), author=F.col("p.user.login"), source_created_at=scores.iso_ts(F.col("p.created_at")), source_updated_at=scores.iso_ts(F.col("p.updated_at")), resource_key=F.lit(repo))


def slack_threads(df: DataFrame, users: DataFrame) -> DataFrame:
    """Messages (channel, payload) without subtypes, one document per thread; users (id, name) give names."""
    m = df.withColumn("m", F.from_json("payload", "ts string, thread_ts string, user string, text string, subtype string")).where("m.subtype is null")
    m = m.select("channel", F.coalesce("m.thread_ts", "m.ts").alias("root"), F.col("m.ts").alias("ts"), F.col("m.user").alias("id"), F.col("m.text").alias("said")).join(users, "id", "left")
    m = m.groupBy("channel", "root").agg(F.array_sort(F.collect_list(F.struct("ts", F.coalesce("name", "id").alias("who"), "said"))).alias("said"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    url = F.concat(F.lit("https://slack.com/archives/"), "channel", F.lit("/p"), F.replace("root", F.lit("."), F.lit("")))
    return _doc(m, "slack_thread", F.concat_ws(":", "channel", "root"), F.substring(F.col("said")[0]["said"], 1, 80), transcript(F.col("said")), url=url, author=F.col("said")[0]["who"], source_created_at=scores.epoch_ts(F.col("first")), source_updated_at=scores.epoch_ts(F.col("last")), resource_key=F.col("channel"))


def message_threads(df: DataFrame, source_type: str, resource_key: Column) -> DataFrame:
    """Messages (thread, pos, who, said, at) folded into one document per thread."""
    t = df.withColumn("_r", resource_key).groupBy("thread", "_r").agg(F.array_sort(F.collect_list(F.struct("pos", "who", "said"))).alias("said"), F.min("at").alias("first"), F.max("at").alias("last"))
    return _doc(t, source_type, F.col("thread"), F.substring(F.col("said")[0]["said"], 1, 80), transcript(F.col("said")), author=F.col("said")[0]["who"], source_created_at=F.col("first"), source_updated_at=F.col("last"), resource_key=F.col("_r"))


def teams_threads(df: DataFrame) -> DataFrame:
    """Root messages and replies of channels (team, channel, ...)."""
    return message_threads(df, "teams_thread", F.concat_ws("/", "team", "channel"))


_JIRA_TS = ("yyyy-MM-dd'T'HH:mm:ss.SSSZ", "yyyy-MM-dd'T'HH:mm:ssZ")


def two_formats(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in _JIRA_TS))


def jira_issues(df: DataFrame) -> DataFrame:
    p = df.withColumn("p", F.from_json("payload", "key string, fields struct<summary:string, status:struct<name:string>, description:string, created:string, updated:string, reporter:struct<displayName:string>, project:struct<key:string>, comment:struct<comments:array<struct<author:struct<displayName:string>, body:string>>>>"))
    f = lambda c: F.col(f"p.fields.{c}")
    said = F.transform(f("comment.comments"), lambda c: F.struct(c["author"]["displayName"].alias("who"), c["body"].alias("said")))
    body = F.concat(F.lit("Jira "), F.col("p.key"), F.lit(": "), f("summary"), F.lit("\nStatus: "), f("status.name"), F.lit("\n\n"), F.coalesce(f("description"), F.lit("")))
    project = F.coalesce(f("project.key"), F.split_part(F.col("p.key"), F.lit("-"), F.lit(1)))
    return _doc(p, "jira_issue", F.col("p.key"), f("summary"), with_comments(body, said), author=f("reporter.displayName"), source_created_at=two_formats(f("created")), source_updated_at=two_formats(f("updated")), resource_key=project)


def linear_issues(df: DataFrame) -> DataFrame:
    p = df.withColumn("p", F.from_json("payload", "identifier string, title string, description string, url string, createdAt string, updatedAt string, state struct<name:string>, creator struct<name:string>, team struct<key:string>, comments struct<nodes:array<struct<body:string, user:struct<name:string>>>>"))
    said = F.transform("p.comments.nodes", lambda c: F.struct(c["user"]["name"].alias("who"), c["body"].alias("said")))
    body = F.concat(F.lit("Linear "), F.col("p.identifier"), F.lit(": "), F.col("p.title"), F.lit("\nState: "), F.coalesce("p.state.name", F.lit("")), F.lit("\n\n"), F.coalesce("p.description", F.lit("")))
    return _doc(p, "linear_issue", F.col("p.identifier"), F.col("p.title"), with_comments(body, said), url=F.col("p.url"), author=F.col("p.creator.name"), source_created_at=scores.iso_ts(F.col("p.createdAt")), source_updated_at=scores.iso_ts(F.col("p.updatedAt")), resource_key=F.col("p.team.key"))


def confluence_pages(df: DataFrame, base: str, closed_only: bool = False) -> DataFrame:
    """Storage bodies as text, with comments; ``closed_only`` as in ``strip_html``."""
    p = df.withColumn("p", F.from_json("payload", "id string, title string, space string, body string, webui string, created string, updated string, comments array<struct<who:string, said:string>>"))
    stripped = text.strip_html_each(F.transform("p.comments", lambda c: c["said"]), closed_only)
    said = F.zip_with("p.comments", stripped, lambda c, s: F.struct(c["who"].alias("who"), s.alias("said")))
    return _doc(p, "confluence_page", F.col("p.id"), F.col("p.title"), with_comments(text.strip_html(F.col("p.body"), closed_only), said), url=F.concat(F.lit(base), "p.webui"), source_created_at=scores.iso_ts(F.col("p.created")), source_updated_at=scores.iso_ts(F.col("p.updated")), resource_key=F.col("p.space"))


def notion_pages(pages: DataFrame, blocks: DataFrame, depth: int = 4) -> DataFrame:
    """Pages (page_id, title, url) with their blocks (block_id, parent_id, page_id, pos, text) depth first."""
    level = blocks.where("parent_id is null").select("page_id", "block_id", F.array("pos").alias("path"), "text")
    every = level
    for _ in range(depth):
        below = blocks.select(F.col("parent_id").alias("_up"), F.col("block_id").alias("_id"), "pos", F.col("text").alias("_text"))
        level = level.join(below, level.block_id == below._up).select("page_id", F.col("_id").alias("block_id"), F.concat("path", F.array("pos")).alias("path"), F.col("_text").alias("text"))
        every = every.unionByName(level)
    body = every.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("lines"))
    p = pages.join(body, "page_id", "left")
    return _doc(p, "notion_page", F.col("page_id"), F.coalesce("title", F.lit("Untitled")), F.coalesce(F.array_join("lines.text", "\n"), F.lit("")), url=F.col("url"))


def drive_files(df: DataFrame, folder: str) -> DataFrame:
    """Files (id, name, mime, content, modified): text, CSV, JSON, XML and exported documents; other kinds are left out."""
    mime = F.col("mime")
    kept = mime.startswith("text/") | mime.isin("application/json", "application/xml", "text/csv") | mime.startswith("application/vnd.google-apps.")
    return _doc(df.where(kept), "drive_file", F.col("id"), F.col("name"), F.col("content"), source_updated_at=F.col("modified"), resource_key=F.lit(folder))


def mailbox(df: DataFrame) -> DataFrame:
    """Mails (folder, uid, content binary): first plain part that is no attachment, else the first HTML part stripped."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for folder, uid, raw in zip(pdf["folder"], pdf["uid"], pdf["content"]):
                mail = email.message_from_bytes(bytes(raw), policy=email.policy.default)
                parts = [p for p in mail.walk() if not p.is_multipart() and p.get_content_disposition() != "attachment"]
                plain = next((p.get_content() for p in parts if p.get_content_type() == "text/plain"), None)
                html = next((p.get_content() for p in parts if p.get_content_type() == "text/html"), None)
                sent = mail["date"].datetime.isoformat() if mail["date"] and mail["date"].datetime else None
                out.append((str(mail["message-id"] or f"{folder}:{uid}"), str(mail["subject"] or ""), str(mail["from"] or ""), plain, html, sent, folder))
            yield pd.DataFrame(out, columns=["id", "subject", "sender", "plain", "html", "sent", "folder"])

    m = df.select("folder", "uid", "content").mapInPandas(parsed, "id string, subject string, sender string, plain string, html string, sent string, folder string")
    return _doc(m, "email", F.col("id"), F.col("subject"), F.coalesce(F.trim("plain"), text.strip_html(F.col("html"))), author=F.col("sender"), source_created_at=scores.iso_ts(F.col("sent")), resource_key=F.col("folder"))


def vtt_turns(df: DataFrame) -> DataFrame:
    """(id, pos, who, said) of WebVTT texts (id, vtt); headers, cue numbers and times go, no name gives unknown."""
    block = df.select("id", F.posexplode(F.split("vtt", r"\n\s*\n")).alias("pos", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("-->") & (F.upper(x) != "WEBVTT") & ~x.rlike(r"^\d+$"))
    p = block.withColumn("p", F.array_join(lines, " ")).where("p <> ''").withColumn("at", F.locate(":", F.col("p")))
    said = F.trim(F.expr("substring(p, at + 1)"))
    named = (F.col("at") > 0) & (said != "")
    return p.select("id", "pos", F.when(named, F.trim(F.expr("substring(p, 1, at - 1)"))).otherwise("unknown").alias("who"), F.when(named, said).otherwise(F.col("p")).alias("said"))


def transcripts(df: DataFrame) -> DataFrame:
    """One document per WebVTT text."""
    t = vtt_turns(df).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "who", "said"))).alias("said"))
    return _doc(t, "meeting", F.col("id"), F.col("id"), transcript(F.col("said")))


def github_events(df: DataFrame) -> DataFrame:
    """Envelopes (event, payload) of pull requests, issues and comments; other events are left out."""
    p = df.where(F.col("event").isin("pull_request", "issues", "issue_comment")).withColumn("p", F.from_json("payload", "repository struct<full_name:string>, pull_request struct<number:long, title:string, body:string>, issue struct<number:long, title:string, body:string>, comment struct<body:string, user:struct<login:string>>"))
    p = p.withColumn("i", F.coalesce("p.pull_request", "p.issue")).where("i is not null")
    said = F.when(F.col("event") == "issue_comment", F.array(F.struct(F.col("p.comment.user.login").alias("who"), F.col("p.comment.body").alias("said"))))
    return _doc(p, F.when(F.col("event") == "pull_request", "pull_request").otherwise("issue"), F.concat_ws("#", "p.repository.full_name", F.col("i.number").cast("string")), F.col("i.title"), with_comments(F.concat_ws("\n\n", "i.title", "i.body"), said), resource_key=F.col("p.repository.full_name"))


def slack_events(df: DataFrame) -> DataFrame:
    """Message events without subtype."""
    p = df.withColumn("e", F.from_json("payload", "event struct<type:string, subtype:string, channel:string, ts:string, user:string, text:string>")["event"]).where("e.type = 'message' and e.subtype is null")
    return _doc(p, "slack_message", F.concat_ws(":", "e.channel", "e.ts"), F.substring("e.text", 1, 80), F.col("e.text"), author=F.col("e.user"), source_created_at=scores.epoch_ts(F.col("e.ts")), resource_key=F.col("e.channel"))


def jira_events(df: DataFrame) -> DataFrame:
    """Issue envelopes, with a comment if there is one."""
    inner = df.select(F.get_json_object("payload", "$.issue").alias("payload"), F.from_json(F.get_json_object("payload", "$.comment"), "author struct<displayName:string>, body string").alias("c"))
    docs = jira_issues(inner.where("payload is not null and c is null").drop("c"))
    more = inner.where("payload is not null and c is not null").withColumn("payload", F.concat(F.lit(""), "payload"))
    said = jira_issues(more.drop("c")).join(more.select("payload", F.array(F.struct(F.col("c.author.displayName").alias("who"), F.col("c.body").alias("said"))).alias("said")), F.col("raw_payload") == F.col("payload"))
    return docs.unionByName(said.withColumn("content", with_comments(F.col("content"), F.col("said"))).select(docs.columns))
