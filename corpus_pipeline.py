"""A training corpus from raw documents: quality, toxicity, near copies, repeated passages, packing.

Each stage gets the documents that the stage before kept, as written and read
again, and all but the last return the columns of ``documents``. The toxicity
model is fitted on the documents of the stage's own input that ``labels`` covers.

Defined results: rows with equal ids are rows of their own; of each group of
near copies one row stays, that of the smallest (id, text), nulls last; an
empty table gives an empty result of every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.byte_dedup import repeated_bytes
from cohortlake.llm.near_copies import near_copies
from cohortlake.llm.packing import packed_digest
from cohortlake.llm.quality import apply_rules
from cohortlake.llm.shared import checkpoint_folder, cut, small
from cohortlake.llm.toxicity import fit_on_tables, score_toxicity

# none of the later stages can be expressed in SQL
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return apply_rules(docs, verdict_col="__rejected_by").filter("__rejected_by is null").select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    model = fit_on_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs, model, keep_columns=docs.columns)
    return out.filter("score < 0.5").select("extra.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest (id, text); ids need not be distinct.

    SimHash near-dedup at a similarity of 0.8 of five-word shingles.
    """
    keyed = cut(docs.withColumn("__key", F.monotonically_increasing_id()))
    groups = cut(near_copies(keyed, "__key").withColumnRenamed("key", "__key"))
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text").isNull().alias("c"), F.col("text").alias("d"), F.col("__key").alias("key"))
    first = keyed.join(small(groups, 16), "__key").groupBy("component").agg(F.min(place)["key"].alias("__key"))
    others = cut(groups.select("__key").join(first, "__key", "left_anti"))
    return keyed.join(small(others, 8), "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier; a character cut in two goes, a null text stays null."""
    others = [c for c in docs.columns if c != "text"]
    marked = docs.withColumn("__null", F.col("text").isNull())
    out = repeated_bytes(marked, keep_columns=[*others, "__null"])
    whole = F.col("kept").cast("string")
    text = F.when(F.col("n_removed") == 0, whole).otherwise(F.coalesce(F.try_validate_utf8(whole), F.make_valid_utf8(whole)))
    out = out.select("extra.*", F.when(~F.col("extra.__null"), text).alias("__text"))
    new = {"text": F.col("__text")} | ({"n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of 2048 ids."""
    return packed_digest(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", suffix_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written in the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
