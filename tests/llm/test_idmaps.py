"""The map of ids keeps every row it must keep."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import idmaps


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_no_wanted_row_is_lost(spark, step):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("_b"))
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, 1)], "doc_id long, text string, _b int"))
    ids = docs.where(f"doc_id % {step} = 0").select("doc_id")
    got = idmaps.possible_rows(docs, ids)
    assert got.columns == docs.columns
    assert got.join(ids, "doc_id", "left_semi").count() == docs.join(ids, "doc_id", "left_semi").count()
    assert got.count() <= ids.count() + 60
    assert idmaps.possible_rows(docs, ids.limit(0)).count() == 0
