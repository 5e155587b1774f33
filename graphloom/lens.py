"""The driver's tables seen as a knowledge graph, in Spark and (for checks) in DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"


def _id(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _text(value: object = None) -> Column:
    return F.lit(value).cast("string")


class Lens:
    """Graph tables over ``sf_dir``; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})

    def _node(self, df: DataFrame, kind: str | Column, node_id: Column, name: Column, props: dict[str, Column], source: str | Column | None, key: Column | None, **more: Column) -> DataFrame:
        bag = F.create_map(*(x for k, v in props.items() for x in (F.lit(k), v.cast("string")))) if props else F.create_map().cast("map<string,string>")
        return df.select(
            node_id.alias("node_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("node_type"), name.alias("name"), more.get("summary", _text()).alias("summary"), bag.alias("properties"),
            (source if isinstance(source, Column) else _text(source)).alias("source_system"), (_text() if key is None else key.cast("string")).alias("external_id"), more.get("canonical", _text()).alias("canonical_node_id"),
            F.lit(1.0).alias("confidence"), more.get("created", F.lit(None)).cast("timestamp").alias("created_at"),
        )

    @cached_property
    def parts(self) -> DataFrame:
        """Parts; of one name all point at the smallest key."""
        p = self.table("part")
        first = p.groupBy("p_name").agg(F.min("p_partkey").alias("first"))
        p = p.join(first, "p_name")
        return self._node(p, "part", _id("part", "p_partkey"), F.col("p_name"), {"brand": F.col("p_brand"), "type": F.col("p_type")}, "catalog", F.col("p_partkey"), canonical=F.when(F.col("first") != F.col("p_partkey"), _id("part", "first")))

    def nodes(self, *kinds: str) -> DataFrame:
        """Nodes of some kinds (all without any)."""
        makers = {
            "region": lambda: self._node(self.table("region"), "region", _id("region", "r_regionkey"), F.col("r_name"), {}, None, None),
            "nation": lambda: self._node(self.table("nation"), "nation", _id("nation", "n_nationkey"), F.col("n_name"), {}, None, None),
            "customer": lambda: self._node(self.table("customer"), "customer", _id("customer", "c_custkey"), F.col("c_name"), {"segment": F.col("c_mktsegment"), "stale": F.when(F.col("c_acctbal") < 0, "true").otherwise("false"), "stale_since": F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd")}, "crm", F.col("c_custkey")),
            "supplier": lambda: self._node(self.table("supplier"), "supplier", _id("supplier", "s_suppkey"), F.col("s_name"), {"nation": F.col("s_nationkey")}, "erp", F.col("s_suppkey")),
            "part": lambda: self.parts,
            "order": lambda: self._node(self.table("orders"), "order", _id("order", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey")), {"priority": F.col("o_orderpriority")}, "shop", F.col("o_orderkey"), created=F.col("o_orderdate")),
            "document": lambda: self._node(self.table("documents"), "document", _id("document", "doc_id"), F.concat(F.lit("doc "), F.col("doc_id")), {"lang": F.col("lang")}, F.col("source"), F.col("doc_id"), summary=F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 160)),
            "page": lambda: self._node(self.table("pages"), "page", _id("page", "page_id"), F.col("url"), {}, "web", F.col("page_id")),
            "vec": lambda: self._node(self.table("embeddings"), F.concat(F.lit("vec_"), F.col("label")), _id("vec", "vec_id"), F.concat(F.lit("vec "), F.col("vec_id")), {}, "vectors", F.col("vec_id")),
        }
        out = [make() for kind, make in makers.items() if not kinds or kind in kinds]
        first = out[0]
        for df in out[1:]:
            first = first.unionByName(df)
        return first

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(_id("vec", "vec_id").alias("node_id"), F.concat(F.lit("vec_"), F.col("label")).alias("node_type"), F.concat(F.lit("vec "), F.col("vec_id")).alias("name"), "embedding")

    def edges(self, *kinds: str) -> DataFrame:
        """Edges of some relationships (all without any)."""

        def edge(df: DataFrame, a: Column, b: Column, rel: str, weight: Column, confidence: Column) -> DataFrame:
            return df.select(a.alias("source_id"), b.alias("target_id"), F.lit(rel).alias("relationship"), weight.cast("double").alias("weight"), confidence.cast("double").alias("confidence"), _text().alias("evidence_document_id"))

        one = F.lit(1.0)
        t = self.table

        def grouped(a: str, b: str, value: str) -> DataFrame:
            return t("lineitem").groupBy(a, b).agg(F.count(F.lit(1)).alias("w"), F.max(F.round(1 - F.col(value), 6)).alias("c"))

        makers = {
            "PART_OF": lambda: edge(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "PART_OF", one, one),
            "MEMBER_OF": lambda: edge(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "MEMBER_OF", one, one).unionByName(edge(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "MEMBER_OF", one, one)),
            "AUTHORED": lambda: edge(t("orders"), _id("customer", "o_custkey"), _id("order", "o_orderkey"), "AUTHORED", one, one),
            "REFERENCES": lambda: edge(grouped("l_orderkey", "l_partkey", "l_discount"), _id("order", "l_orderkey"), _id("part", "l_partkey"), "REFERENCES", F.col("w"), F.col("c")),
            "DEPENDS_ON": lambda: edge(grouped("l_partkey", "l_suppkey", "l_tax"), _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "DEPENDS_ON", F.col("w"), F.col("c")),
            "LINKS": lambda: edge(t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("w")), _id("page", "page_id"), _id("concept", "href"), "LINKS", F.col("w"), F.lit(0.8)),
        }
        out = [make() for kind, make in makers.items() if not kinds or kind in kinds]
        first = out[0]
        for df in out[1:]:
            first = first.unionByName(df)
        return first

    @cached_property
    def event_docs(self) -> DataFrame:
        """Events as raw documents."""
        e = self.table("events")
        return e.select(_id("event", "event_id").alias("document_id"), F.col("event_type").alias("source_system"), F.lit("event").alias("source_type"), F.col("event_id").cast("string").alias("external_id"), _text().alias("title"), _text().alias("url"), F.col("props").alias("content"), F.get_json_object("props", "$.k").alias("resource_key"), F.lit(None).cast("timestamp").alias("source_created_at"), F.col("ts").alias("source_updated_at"), F.col("ts").alias("ingested_at"), F.col("ts").alias("created_at"))

    @cached_property
    def text_docs(self) -> DataFrame:
        d = self.table("documents")
        return d.select(_id("document", "doc_id").alias("document_id"), F.col("source").alias("source_system"), F.lit("document").alias("source_type"), F.col("doc_id").cast("string").alias("external_id"), F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), _text().alias("url"), F.col("text").alias("content"), F.col("lang").alias("resource_key"))

    @cached_property
    def mentions(self) -> DataFrame:
        """Events mention customers."""
        e = self.table("events")
        return e.select(_id("customer", "user_id").alias("node_id"), _id("event", "event_id").alias("document_id"), F.substring("props", 1, 1000).alias("context"))

    @cached_property
    def runs(self) -> DataFrame:
        e = self.table("events")
        failed = (F.col("value") < 5) | ((F.col("event_type") == "error") & (F.col("value") < 40))
        return e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("source_system"), F.when(failed, "failed").otherwise("completed").alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"), F.get_json_object("props", "$.k").alias("resource_key"), F.col("event_id").cast("string").alias("cursor"))

    @cached_property
    def grants(self) -> DataFrame:
        """Engineers see clicks and views whole, sales the purchases of three resources, as far as there are any."""
        found = self.event_docs.select("source_system", "resource_key").distinct()
        eng = found.where("source_system in ('click', 'view')").select(F.lit("eng").alias("group_name"), "source_system", _text().alias("resource_key")).distinct()
        return eng.unionByName(found.where("source_system = 'purchase' and resource_key in ('1', '2', '3')").select(F.lit("sales").alias("group_name"), "source_system", "resource_key"))

    @property
    def now(self) -> Column:
        return F.lit(NOW).cast("timestamp")


#: The same tables for DuckDB; put in front of a query.
SQL = """
WITH parts AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_name) AS first_key FROM part),
n_region AS (SELECT 'region:' || r_regionkey AS node_id, 'region' AS node_type, r_name AS name, NULL::VARCHAR AS summary, NULL::VARCHAR AS source_system, NULL::VARCHAR AS external_id, NULL::VARCHAR AS canonical_node_id, NULL::TIMESTAMP AS created_at FROM region),
n_nation AS (SELECT 'nation:' || n_nationkey AS node_id, 'nation' AS node_type, n_name AS name, NULL::VARCHAR AS summary, NULL::VARCHAR AS source_system, NULL::VARCHAR AS external_id, NULL::VARCHAR AS canonical_node_id, NULL::TIMESTAMP AS created_at FROM nation),
n_customer AS (SELECT 'customer:' || c_custkey AS node_id, 'customer' AS node_type, c_name AS name, NULL::VARCHAR AS summary, 'crm' AS source_system, c_custkey::VARCHAR AS external_id, NULL::VARCHAR AS canonical_node_id, NULL::TIMESTAMP AS created_at FROM customer),
n_supplier AS (SELECT 'supplier:' || s_suppkey AS node_id, 'supplier' AS node_type, s_name AS name, NULL::VARCHAR AS summary, 'erp' AS source_system, s_suppkey::VARCHAR AS external_id, NULL::VARCHAR AS canonical_node_id, NULL::TIMESTAMP AS created_at FROM supplier),
n_part AS (SELECT 'part:' || p_partkey AS node_id, 'part' AS node_type, p_name AS name, NULL::VARCHAR AS summary, 'catalog' AS source_system, p_partkey::VARCHAR AS external_id, CASE WHEN first_key <> p_partkey THEN 'part:' || first_key END AS canonical_node_id, NULL::TIMESTAMP AS created_at FROM parts),
n_order AS (SELECT 'order:' || o_orderkey AS node_id, 'order' AS node_type, 'order ' || o_orderkey AS name, NULL::VARCHAR AS summary, 'shop' AS source_system, o_orderkey::VARCHAR AS external_id, NULL::VARCHAR AS canonical_node_id, o_orderdate AS created_at FROM orders),
n_document AS (SELECT 'document:' || doc_id AS node_id, 'document' AS node_type, 'doc ' || doc_id AS name, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160) AS summary, source AS source_system, doc_id::VARCHAR AS external_id, NULL::VARCHAR AS canonical_node_id, NULL::TIMESTAMP AS created_at FROM documents),
n_page AS (SELECT 'page:' || page_id AS node_id, 'page' AS node_type, url AS name, NULL::VARCHAR AS summary, 'web' AS source_system, page_id::VARCHAR AS external_id, NULL::VARCHAR AS canonical_node_id, NULL::TIMESTAMP AS created_at FROM pages),
n_vec AS (SELECT 'vec:' || vec_id AS node_id, 'vec_' || label AS node_type, 'vec ' || vec_id AS name, NULL::VARCHAR AS summary, 'vectors' AS source_system, vec_id::VARCHAR AS external_id, NULL::VARCHAR AS canonical_node_id, NULL::TIMESTAMP AS created_at FROM embeddings),
nodes AS (SELECT * FROM n_region UNION ALL SELECT * FROM n_nation UNION ALL SELECT * FROM n_customer UNION ALL SELECT * FROM n_supplier UNION ALL SELECT * FROM n_part UNION ALL SELECT * FROM n_order UNION ALL SELECT * FROM n_document UNION ALL SELECT * FROM n_page UNION ALL SELECT * FROM n_vec),
e_part_of AS (SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'PART_OF' AS relationship, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS confidence FROM nation),
e_member_of AS (SELECT 'customer:' || c_custkey AS source_id, 'nation:' || c_nationkey AS target_id, 'MEMBER_OF' AS relationship, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS confidence FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'MEMBER_OF', 1.0, 1.0 FROM supplier),
e_authored AS (SELECT 'customer:' || o_custkey AS source_id, 'order:' || o_orderkey AS target_id, 'AUTHORED' AS relationship, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS confidence FROM orders),
e_references AS (SELECT 'order:' || l_orderkey AS source_id, 'part:' || l_partkey AS target_id, 'REFERENCES' AS relationship, count(*)::DOUBLE AS weight, max(round(1 - l_discount, 6)) AS confidence FROM lineitem GROUP BY ALL),
e_depends_on AS (SELECT 'part:' || l_partkey AS source_id, 'supplier:' || l_suppkey AS target_id, 'DEPENDS_ON' AS relationship, count(*)::DOUBLE AS weight, max(round(1 - l_tax, 6)) AS confidence FROM lineitem GROUP BY ALL),
hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
e_links AS (SELECT 'page:' || page_id AS source_id, 'concept:' || href AS target_id, 'LINKS' AS relationship, count(*)::DOUBLE AS weight, 0.8::DOUBLE AS confidence FROM hrefs GROUP BY ALL),
edges AS (SELECT * FROM e_part_of UNION ALL SELECT * FROM e_member_of UNION ALL SELECT * FROM e_authored UNION ALL SELECT * FROM e_references UNION ALL SELECT * FROM e_depends_on UNION ALL SELECT * FROM e_links),
event_docs AS (SELECT 'event:' || event_id AS document_id, event_type AS source_system, event_id::VARCHAR AS external_id, props AS content, json_extract_string(props, '$.k') AS resource_key, ts AS source_updated_at, ts AS ingested_at, event_id FROM events),
mentions AS (SELECT 'customer:' || user_id AS node_id, 'event:' || event_id AS document_id, substr(props, 1, 1000) AS context FROM events),
runs AS (SELECT event_id AS run_id, event_type AS source_system, CASE WHEN value < 5 OR (event_type = 'error' AND value < 40) THEN 'failed' ELSE 'completed' END AS status, ts AS started_at, ts AS finished_at, json_extract_string(props, '$.k') AS resource_key, event_id::VARCHAR AS cursor FROM events),
grants AS (SELECT DISTINCT 'eng' AS group_name, source_system, NULL::VARCHAR AS resource_key FROM event_docs WHERE source_system IN ('click', 'view') UNION ALL SELECT DISTINCT 'sales', source_system, resource_key FROM event_docs WHERE source_system = 'purchase' AND resource_key IN ('1', '2', '3')),
visible_docs AS (SELECT * FROM event_docs WHERE source_system = 'purchase' AND resource_key IN ('1', '2', '3')),
visible AS (SELECT DISTINCT node_id FROM mentions SEMI JOIN visible_docs USING (document_id))
"""
