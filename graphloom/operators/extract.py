"""Extraction of entities and relationships, embeddings, and the vocabulary that checks them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scores, text

NODE = "struct<temp_id:string, node_type:string, name:string, summary:string, source_system:string, external_id:string, confidence:double>"
EDGE = "struct<source_temp:string, target_temp:string, relationship:string, confidence:double>"
RESULT = f"document_id string, nodes array<{NODE}>, edges array<{EDGE}>, unmapped array<struct<kind:string, name:string, example:string>>"


def extract_rules(docs: DataFrame, targets: Column | None = None) -> DataFrame:
    """One sourced document node per document; one derived node and a REFERENCES edge per distinct link in it.

    ``targets`` is an array of link targets; wikilinks of the content without it.
    """
    links = text.wikilinks(F.col("content")) if targets is None else targets
    none = F.lit(None).cast("string")
    own = F.struct(F.lit("doc").alias("temp_id"), F.lit("document").alias("node_type"), F.col("title").alias("name"), text.first_160(F.col("content"), F.col("title")).alias("summary"), F.col("source_system"), F.col("external_id"), F.lit(1.0).alias("confidence"))
    rows = docs.withColumn("_links", F.coalesce(links, F.array().cast("array<string>")))
    more = F.transform("_links", lambda x, i: F.struct(F.concat(F.lit("link"), i.cast("string")).alias("temp_id"), F.lit("document").alias("node_type"), x.alias("name"), none.alias("summary"), none.alias("source_system"), none.alias("external_id"), F.lit(0.8).alias("confidence")))
    edges = F.transform("_links", lambda x, i: F.struct(F.lit("doc").alias("source_temp"), F.concat(F.lit("link"), i.cast("string")).alias("target_temp"), F.lit("REFERENCES").alias("relationship"), F.lit(0.8).alias("confidence")))
    return rows.select("document_id", F.concat(F.array(own), more).alias("nodes"), edges.alias("edges"), F.array().cast("array<struct<kind:string, name:string, example:string>>").alias("unmapped"))


def extract_model(docs: DataFrame, extractor: Callable[[str, str], dict]) -> DataFrame:
    """The same shape from any ``extractor(document_id, rendered_text)``, called on the executors batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [{"nodes": [], "edges": [], "unmapped": []} | extractor(i, t) for i, t in zip(pdf["document_id"], pdf["rendered"])]
            yield pd.DataFrame({"document_id": pdf["document_id"], **{k: [x[k] for x in got] for k in ("nodes", "edges", "unmapped")}})

    return docs.select("document_id", "rendered").mapInPandas(run, RESULT)


def seed_node_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in schema.NODE_TYPES], "node_type string")


def seed_relationships(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schema.RELATIONSHIP_TYPES, "relationship string, allowed_source_types array<string>, allowed_target_types array<string>, is_symmetric boolean")


def live_registry(current: DataFrame, seed: DataFrame) -> DataFrame:
    """The current vocabulary, or the seed where it is empty."""
    return seed if current.isEmpty() else current


def seed_ontology(current: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Current terms with the seed's columns where it has them, and the seed's other terms."""
    return seed.unionByName(current.join(seed, key, "left_anti"), allowMissingColumns=True)


def validate_nodes(nodes: DataFrame, node_types: DataFrame) -> DataFrame:
    """Nodes with ``error``: unknown type, confidence outside 0 to 1, or only one of the two source fields."""
    known = node_types.select("node_type", F.lit(True).alias("_known"))
    half = F.col("source_system").isNull() != F.col("external_id").isNull()
    error = F.when(F.col("_known").isNull(), "unknown type").when(~F.col("confidence").between(0, 1) | F.col("confidence").isNull(), "confidence").when(half, "half sourced")
    return nodes.join(F.broadcast(known), "node_type", "left").withColumn("error", error).drop("_known")


def validate_endpoints(edges: DataFrame, nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Edges whose end types the vocabulary doesn't allow, with the types found."""
    kind = nodes.select("node_id", "node_type")
    rows = edges.join(kind.toDF("source_id", "source_type"), "source_id").join(kind.toDF("target_id", "target_type"), "target_id").join(registry, "relationship")
    ok = lambda allowed, t: F.col(allowed).isNull() | F.array_contains(allowed, F.col(t))
    return rows.where(~(ok("allowed_source_types", "source_type") & ok("allowed_target_types", "target_type"))).select("source_id", "target_id", "relationship", "source_type", "target_type")


def file_unmapped(unmapped: DataFrame) -> DataFrame:
    """One vocabulary proposal per kind and name, with the first example (smallest document)."""
    first = unmapped.groupBy("kind", "name").agg(F.min_by("example", "document_id").alias("example"))
    proposal = F.when(F.col("kind") == "relationship", "schema_relationship_type").otherwise("schema_node_type")
    ok = F.when(F.col("kind") == "relationship", text.valid_type_name(F.col("name"), True)).otherwise(text.valid_type_name(F.col("name")))
    return first.where(ok).select(proposal.alias("kind"), F.create_map(F.lit("name"), "name", F.lit("example"), "example").alias("payload"), F.lit(0.5).alias("confidence"), F.lit("drift").alias("agent"), F.col("name").alias("dedup_key"))


def deterministic_embedding(body: str, dim: int = 64) -> np.ndarray:
    """Unit vector drawn from a generator that the text's hash seeds."""
    seed = int.from_bytes(hashlib.sha256(body.encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).standard_normal(dim)
    return v / np.sqrt((v * v).sum())


def embed_batch(rows: DataFrame, body: str, embed: Callable[[list[str]], list[np.ndarray]] | None = None, size: int = 256) -> DataFrame:
    """Rows with an ``embedding``, ``size`` texts a call; deterministic vectors without a provider."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out: list[list[float]] = []
            texts = series.fillna("").tolist()
            for k in range(0, len(texts), size):
                part = texts[k : k + size]
                out += [np.asarray(v, np.float32).tolist() for v in (embed(part) if embed else map(deterministic_embedding, part))]
            yield pd.Series(out, dtype=object)

    return rows.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(body)))


def judge_pairs(pairs: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """dedup_key, verdict, judged from a judge over batches of pairs; an abstaining or failing judge gives ``unsure``."""
    kinds = "dedup_key string, verdict string, judged double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({"dedup_key": pdf["dedup_key"], "verdict": "unsure", "judged": 0.0})
            if judge is not None:
                try:
                    out = judge(pdf)[["dedup_key", "verdict", "judged"]]
                except ValueError:
                    pass
            yield out

    return pairs.mapInPandas(run, kinds)


def plan_backfill(nodes: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Nodes without the stamp of this model."""
    found = nodes.where(F.coalesce(F.try_element_at("properties", F.lit("embedding_model")), F.lit("")) != model)
    return found if limit is None else found.orderBy("node_id").limit(limit)


def run_backfill(nodes: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """The planned nodes with vectors and the model's stamp."""
    plan = plan_backfill(nodes, model, limit).withColumn("_body", text.node_text(F.col("name"), F.col("summary")))
    return embed_batch(plan, "_body").withColumn("properties", scores.stamp(F.col("properties"), "embedding_model", F.lit(model))).drop("_body")
