"""Reliable cuts of lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ddl(kind: T.DataType) -> str:
    """The type as DDL in which any name is quoted."""
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"`{f.name.replace('`', '``')}`: {ddl(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"array<{ddl(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{ddl(kind.keyType)}, {ddl(kind.valueType)}>"
    return kind.simpleString()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, as in tests, a local session gets a temporary folder; a
    cluster has none that all its machines see, which is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A cut frame, marked for broadcast if its counted rows of ``row_bytes`` fit into ``BROADCAST_BYTES``; else joins shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
