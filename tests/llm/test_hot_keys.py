"""A key that a third of the rows hold fills no task beyond twice its share, where tables are too large to broadcast."""

import pytest
from pyspark.sql import functions as F

from cohortlake.llm import components, exchange

PARTS = 4


@pytest.fixture
def spread_out(spark, monkeypatch):
    monkeypatch.setattr(components, "small", lambda df, row_bytes: df)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def largest(df):
    return max(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())


def test_null_ids_meet_their_rank_in_many_tasks(spark, spread_out):
    rows = [(None if i % 3 == 0 else f"id{i:05}", f"text {i}") for i in range(1200)]
    docs, at = exchange._numbered(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id")
    out = docs.select("doc_id", at.alias("at"))
    assert out.count() == 1200 and largest(out) <= 2 * 1200 / PARTS
    got = [r.doc_id for r in out.filter("at is not null").orderBy("at").collect()]
    assert got == sorted(got) and len(got) == 800


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, spread_out, how):
    rows = spark.range(1200).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 100).alias("k"), F.col("id").alias("row"))
    named = spark.createDataFrame([(7, "hot"), (101, "one")], "k bigint, v string")
    out = components.hot_join(rows, named, "k", "row", 16, how)
    got = {r.v: r["n"] for r in out.groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert got == ({"hot": 400, "one": 1} if how == "inner" else {"hot": 400, "one": 1, None: 799})
    assert largest(out) <= 2 * 1200 / PARTS


def test_components_of_a_hub(spark, spread_out):
    edges = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(500, 501), (None, 3), (9, 9)], "a bigint, b bigint")
    got = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(400)} | {500: 500, 501: 500}
