"""Vectors, scores, times and property bags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- vectors and scores


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def blend_confidence(name_similarity: Column, distance: Column) -> Column:
    near = F.greatest(F.lit(0.0), 1.0 - distance)
    both = 0.4 * name_similarity + 0.6 * near
    return F.round(F.coalesce(F.when(name_similarity.isNotNull() & distance.isNotNull(), both), near if distance is None else F.when(distance.isNotNull(), near), name_similarity, F.lit(0.0)), 3)


def judge_confidence(score: Column, verdict: Column, confidence: Column) -> Column:
    """A verdict ``same`` can only raise a score, ``different`` only lower it."""
    return F.when(verdict == "same", F.greatest(score, F.round(confidence, 3))).when(verdict == "different", F.least(score, F.round(1.0 - confidence, 3))).otherwise(score)


def stale_confidence(age_days: Column, after_days: int) -> Column:
    over = F.greatest(F.lit(0), age_days - after_days)
    return F.round(F.least(F.lit(0.9), 0.5 + 0.1 * (over / (after_days / 2))), 3)


def rrf(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)


def failure_rate(failed: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(100.0 * failed / total)


# --- times


def iso_ts(text: Column) -> Column:
    return F.try_to_timestamp(text)


def epoch_ts(text: Column) -> Column:
    """Seconds since 1970, as text, to a timestamp; null if it is no number."""
    return F.timestamp_micros(F.round(text.try_cast("double") * 1_000_000).cast("long"))


def freshness_ts(updated: Column, ingested: Column, created: Column) -> Column:
    return F.coalesce(updated, ingested, created)


def timeline_ts(updated: Column, source_created: Column, ingested: Column) -> Column:
    return F.coalesce(updated, source_created, ingested)


def story_ts(source_created: Column, ingested: Column, created: Column) -> Column:
    return F.coalesce(source_created, ingested, created)


def age_days(now: Column, ts: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000).cast("long")


def cursor_format(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- property bags: MAP<STRING, STRING>


def merge_new_wins(old: Column, new: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, o, n: F.coalesce(n, o))


def merge_old_wins(old: Column, new: Column) -> Column:
    return merge_new_wins(new, old)


def stamp(bag: Column, key: str, value: Column) -> Column:
    return merge_new_wins(bag, F.create_map(F.lit(key), value.cast("string")))


def json_canonical(bag: Column) -> Column:
    """Keys in order; an empty or missing bag is {}."""
    entries = F.array_sort(F.map_entries(bag))
    return F.coalesce(F.to_json(F.map_from_entries(entries)), F.lit("{}"))


def kv_to_map(pairs: Column) -> Column:
    """key/value structs to a bag; of equal keys the last wins."""
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def flagged(bag: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(bag, F.lit(key)), F.lit("false")) == "true"


def scalar_equal(a: Column, b: Column) -> Column:
    """VARIANT scalars compared by value: numbers and booleans as numbers, strings as strings; null if not scalar."""

    def kind(v: Column) -> Column:
        s = F.schema_of_variant(v)
        return F.when(s == "STRING", "s").when((s == "BOOLEAN") | (s == "BIGINT") | (s == "DOUBLE") | (s == "FLOAT") | s.startswith("DECIMAL"), "n")

    def number(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))

    same = F.when(kind(a) == "n", number(a) == number(b)).otherwise(F.try_variant_get(a, "$", "string") == F.try_variant_get(b, "$", "string"))
    return F.when(kind(a).isNull() | kind(b).isNull(), F.lit(None)).when(kind(a) != kind(b), F.lit(False)).otherwise(same)
