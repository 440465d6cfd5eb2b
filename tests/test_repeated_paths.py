"""Pages of which several have one address, against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import evidence as E
from cohortlake.plans import registry


@pytest.mark.parametrize("name", ["tree_digest", "verify_hashes"])
def test_repeated_urls(spark, tmp_path, name):
    rows = [(i, f"u{i % 40}", None if i % 9 == 4 else f"text {i % 13}") for i in range(150)] + [(5, "u5", "other"), (22, "u3", "x"), (3, "u3", "text 3")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.SQL[name])
    names, want = [c[0] for c in want.description], want.fetchall()
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_row_a_recorded_file(spark):
    want = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), (None, "4"), ("b", "5")], "path string, sha256 string")
    have = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), (None, "4")], "path string, sha256 string")
    assert sorted(map(tuple, E.verify_hashes(want, have).collect())) == [("a", "changed"), ("b", "missing")]
    assert E.content_hashes(have.withColumn("n", F.lit(1)), "path", "sha256", ["n"]).columns[0] == "n"
