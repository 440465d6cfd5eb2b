"""Exact duplicates by progressive refinement, in DataFrame functions only.

Texts are grouped by length, then by a hash of their first characters, then by a
hash of the whole. Each step sees only rows whose group of the step before has
another row: lengths are counted over all texts, prefixes are hashed where a
length repeats, and whole texts are hashed where a prefix repeats. What moves
between machines is a length, a hash or an id, never a text, unless the repeated
prefixes are too many to broadcast; then texts of repeated lengths move once.

Defined results: a null text counts as empty. Of equal texts one row stays, that
of the largest id (nulls lowest), and of rows with that id any one, so every group
keeps exactly one row. A text of its own keeps itself. An empty table gives an
empty result; names of other columns play no part, for results are read only from
the columns given. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import hot_join
from .shared import cut

PREFIX = 256
LENGTHS = 1 << 20  # longer texts share classes of length, so the table of classes is bounded
Normalise = Callable[[Column], Column]


def unchanged(text: Column) -> Column:
    return text


def length_class(text: Column) -> Column:
    """The length in bytes up to ``LENGTHS``; longer texts fall into that many classes above."""
    n = F.octet_length(text).cast("bigint")
    return F.when(n < LENGTHS, n).otherwise(F.lit(LENGTHS) + F.pmod(n, F.lit(LENGTHS)))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Normalise = unchanged, digest: Callable[[Column], Column] | None = None, prefix: int = PREFIX) -> DataFrame:
    """A row each: id, keep_id, group_size, kept and, where asked for, ``digest`` of the normalised text.

    Texts are equal when they are after ``normalise``. ``keep_id`` is the id of the
    row of the same text that stays; ``group_size`` counts the rows of the text.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text"))
    by_length = texts.withColumn("length", length_class(F.col("text")))
    # at most twice LENGTHS rows of 16 bytes
    lengths = F.broadcast(cut(by_length.groupBy("length").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("length", F.lit(True).alias("shared"))))
    by_head = by_length.join(lengths, "length", "left").withColumn("head", F.when(F.col("shared"), F.xxhash64(F.substring("text", 1, prefix))))
    heads = by_head.filter("shared").groupBy("length", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("again", F.lit(True))

    # where the prefixes are too many for a broadcast, texts meet them by key, and hot keys are spread
    at = F.struct("length", "head").alias("at")
    marked = hot_join(by_head.select("id", "text", "length", at, F.monotonically_increasing_id().alias("row")), cut(heads.select(at, "again")), "at", "row", 96, how="left")
    whole = F.when(F.col("again"), F.concat(F.hex("length"), F.lit(":"), F.sha2("text", 256)))
    extra = [digest(F.col("text")).alias("digest")] if digest else []
    rows = cut(marked.select("id", whole.alias("whole"), *extra, "row"))

    alike = rows.filter("whole is not null")
    groups = cut(alike.groupBy("whole").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("stays")).filter("group_size > 1"))
    members = hot_join(alike, groups, "whole", "row", 256, how="left")
    one = F.col("group_size").isNull()
    found = members.select("id", F.when(one, F.col("id")).otherwise(F.col("stays.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), (one | (F.col("stays.row") == F.col("row"))).alias("kept"), *(["digest"] if digest else []))
    alone = rows.filter("whole is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), *(["digest"] if digest else []))
    return found.unionByName(alone)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of its text that stays, and the SHA-256 of the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = exact_duplicates(docs, digest=lambda text: F.sha2(text, 256))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
