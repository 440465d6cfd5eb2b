"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, small


def salted_join(rows: DataFrame, named: DataFrame, key: str, spread: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join, inner or left, of rows, of which very many may hold one key, with a table of one row a key.

    The rows are spread over ``salts`` tasks a key by their ``spread`` column, the
    table is repeated as often.
    """
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = named.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def hot_join(rows: DataFrame, named: DataFrame, key: str, spread: str, row_bytes: int, how: str = "inner") -> DataFrame:
    """``salted_join`` with a cut table, or a broadcast of it if its counted rows of ``row_bytes`` are few."""
    bounded = small(named, row_bytes)
    return salted_join(rows, named, key, spread, how=how) if bounded is named else rows.join(bounded, key, how)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge, label the least node reachable.

    Each round takes the least label among a node and its neighbours, then the
    label of the label, so paths halve; labels are aggregated before they move.
    Nulls and loops link nothing. No edges give an empty table.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    both = cut(e.union(e.select("y", "x")).distinct())
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("label"))
    while True:
        # a hub has very many edges
        near = hot_join(both.select("x", F.col("y").alias("node")), labels, "node", "x", 24).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("mid"))
        # a hub is the label of very many nodes
        up = lower.select("mid").distinct().join(lower.select(F.col("node").alias("mid"), F.col("mid").alias("top")), "mid")
        step = cut(salted_join(lower, up, "mid", "node").select("node", "old", F.least("mid", "top").alias("label")))
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels
