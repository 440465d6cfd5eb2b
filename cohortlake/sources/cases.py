"""Delimited files of one kind whose headers are spelled in different ways."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The spellings of the release's case descriptions, and the column that some files lack.
SPELLINGS = {"breast_density": "birads_density", "breast density": "birads_density", "abnormality type": "lesion_type"}
OPTIONAL = ("subtlety",)


def file_headers(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """header, files: the first lines that occur, each with its files; lines are not parsed and only the first of a file is kept."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    first = lines.filter("start = 0").withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))


def read_variants(spark: SparkSession, path: str, columns: Sequence[str], spellings: Mapping[str, str] = SPELLINGS, optional: Sequence[str] = OPTIONAL, glob: str = "*.csv", sep: str = ",") -> DataFrame:
    """``columns`` as strings and file, of all files below ``path``; names are trimmed and mapped by ``spellings``.

    Files with one header are one scan, so there are as many scans as spellings,
    not as files. An optional column that a file lacks is null there; any other is
    an error that names the file. Blank fields are null.
    """
    parts = []
    for row in file_headers(spark, path, glob).collect():
        df = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(row["files"])
        names = {spellings.get(c.strip(), c.strip()): c for c in df.columns}
        if lost := [c for c in columns if c not in names and c not in optional]:
            raise ValueError(f"{row['files'][0]} is missing columns: {lost}")
        field = {c: F.nullif(F.trim(F.col(f"`{names[c]}`")), F.lit("")) if c in names else F.lit(None).cast("string") for c in columns}
        parts.append(df.select(*[v.alias(k) for k, v in field.items()], F.col("_metadata.file_path").alias("file")))
    if not parts:
        raise ValueError(f"no files below {path}")
    return reduce(DataFrame.unionByName, parts)
