"""Stores that are compared before they are written: a cache of derived rows, and a locked record."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest_version(spark: SparkSession, root: str) -> int:
    """The highest complete version below ``root``; 0 if there is none."""
    where, fs = _path(spark, root)
    if not fs.exists(where):
        return 0
    found = [s.getPath().getName() for s in fs.listStatus(where)]
    return max([0, *[int(n[2:]) for n in found if n.startswith("v-") and fs.exists(_path(spark, f"{root}/{n}/_SUCCESS")[0])]])


def refresh(root: str, wanted: DataFrame, key: str, stamps: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """The store after ``work`` on the rows of ``wanted`` that are new or whose ``stamps`` differ from the stored ones, and how many these were.

    ``work`` gets rows of ``wanted`` and returns key, stamps and what it makes of
    them. The store is replaced as a whole: a new version is written beside the
    old one and counts once it is complete, so readers never see half of one and a
    failed run changes nothing. Rows of keys no longer wanted stay.
    """
    spark = wanted.sparkSession
    version = latest_version(spark, root)
    if not version:
        made = work(wanted)
        made.write.mode("overwrite").parquet(f"{root}/v-1")
        store = spark.read.schema(made.schema).parquet(f"{root}/v-1")
        return store, store.count()
    store = spark.read.parquet(f"{root}/v-{version}")
    stored = store.select(F.col(key).alias("__key"), *[F.col(s).alias(f"__{s}") for s in stamps])
    same = F.lit(True)
    for s in stamps:
        same = same & F.col(s).eqNullSafe(F.col(f"__{s}"))
    # the stamps are compared with small rows, whatever the store holds beside them
    stale = wanted.join(stored, wanted[key] == stored["__key"], "left").filter(F.col("__key").isNull() | ~same).select(*wanted.columns)
    n = stale.count()
    if not n:
        return store, 0
    kept = store.join(stale.select(key), key, "left_anti")
    kept.unionByName(work(stale)).write.mode("overwrite").parquet(f"{root}/v-{version + 1}")
    return spark.read.schema(store.schema).parquet(f"{root}/v-{version + 1}"), n


STAMP = "generated_at_utc"


class LockChanged(ValueError):
    """A record differs from the locked one."""


def write_lock(path: str, record: DataFrame) -> DataFrame:
    """The locked record at ``path``: ``record``, one row, with the UTC time it was first written.

    A record equal to the one that is there leaves it as it is, with its stamp; any
    other is refused and leaves it too.
    """
    spark = record.sparkSession
    where, fs = _path(spark, path)
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in record.columns]), {"ignoreNullFields": "false"})
    if fs.exists(where):
        old = spark.read.json(path, schema=f"record string, {STAMP} string")
        if old.first()["record"] != record.select(body.alias("record")).first()["record"]:
            raise LockChanged(f"the record differs from the one locked at {path}")
    else:
        utc = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
        record.select(body.alias("record"), utc.alias(STAMP)).coalesce(1).write.json(path)
    found = spark.read.json(path, schema=f"record string, {STAMP} string")
    return found.select(F.from_json("record", record.schema).alias("r"), STAMP).select("r.*", STAMP)
