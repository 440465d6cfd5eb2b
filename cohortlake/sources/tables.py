"""Reading of delimited, JSON and listing inputs, and atomic writes of tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = ("nan", "None", "<NA>")


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """All strings, trimmed, blank as null; the header is checked on the driver."""
    df = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    if lost := [c for c in columns if c not in [x.strip() for x in df.columns]]:
        raise ValueError(f"missing columns: {lost}")
    return df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in df.columns])


def coerce(df: DataFrame, integers: list[str], strings: list[str]) -> DataFrame:
    """Integers by try_cast, tokens for missing as null."""
    new = {c: F.expr(f"try_cast(`{c}` as int)") for c in integers if c in df.columns}
    new |= {c: F.when(~F.col(c).isin(*MISSING), F.col(c)) for c in strings if c in df.columns}
    return df.withColumns(new)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors both write: under spark.checkpoint.dir, a local one only in local sessions."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the folder of spark.checkpoint.dir, a temporary one only in local sessions."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length; the contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


def hash_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size_bytes, sha256."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def read_runs(spark: SparkSession, path: str, run: T.StructType) -> DataFrame:
    """Records of {"runs": [...]} with an explicit schema."""
    return spark.read.option("multiLine", True).schema(T.StructType([T.StructField("runs", T.ArrayType(run))])).json(path).select(F.inline("runs"))


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.partitionBy(column).mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Replaces the written (run_name, split) alone; readers never see half of one."""
    df.write.partitionBy("run_name", "split").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_package(df: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").parquet(path)
