"""Running totals, ranks and next rows along an order, whatever the size of a key.

The rows are dealt into ranges of (keys, order), so a key of very many rows fills
several ranges. Totals are run within a range and the ranges before are added;
what crosses the edge of a range is one row a range, however large the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

PART = "__part"


def _within(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def along(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    xors: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    wholes: Mapping[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """The rows with running ``sums`` and ``xors`` up to and with the row, ``nexts``, the values of the row after it, and ``wholes``, sums over the key.

    ``order`` ascends, nulls first, within ``keys``; rows equal in it take an
    order of their own, so give one that tells rows apart. Null keys are keys. The
    rows are computed once and kept in the checkpoint folder; ``parts`` ranges, as
    many as shuffle partitions if not given, hold about as many rows each.
    """
    sums, xors, nexts, wholes = dict(sums or {}), dict(xors or {}), dict(nexts or {}), dict(wholes or {})
    run = {**{k: (F.sum, v) for k, v in sums.items()}, **{k: (F.bit_xor, v) for k, v in xors.items()}}
    places = [f"__order{i}" for i in range(len(order))]
    values = {f"__v_{k}": v for k, (_, v) in run.items()} | {f"__n_{k}": v for k, v in nexts.items()} | {f"__w_{k}": v for k, v in wholes.items()}
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.withColumns(dict(zip(places, order, strict=True)) | values)
    rows = cut(named.repartitionByRange(n, *_within(keys), *places).withColumn(PART, F.spark_partition_id()))
    group, key = Window.partitionBy(*_within(keys), PART), Window.partitionBy(*(_within(keys) or [F.lit(0)]))
    first = F.struct(*[F.col(f"__n_{k}").alias(k) for k in nexts]) if nexts else None

    # one row a range of a key; only keys that fill several ranges have anything to carry
    ends = rows.groupBy(*_within(keys), PART).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[f(f"__v_{k}").alias(f"__t_{k}") for k, (f, _) in run.items()],
        *[F.sum(f"__w_{k}").alias(f"__w_{k}") for k in wholes],
        *([F.min_by(first, F.struct(*places)).alias("__first")] if nexts else []),
    )
    before = key.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*_within(keys), PART, F.count(F.lit(1)).over(key).alias("__ranges"), *[f(f"__t_{k}").over(before).alias(f"__c_{k}") for k, (f, _) in run.items()], *[F.sum(f"__w_{k}").over(key).alias(f"__a_{k}") for k in wholes], *([F.lead("__first").over(key.orderBy(PART)).alias("__follow")] if nexts else []))
    carried = F.broadcast(carried.filter("__ranges > 1").select(F.col(PART).alias("__p"), *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], *[f"__c_{k}" for k in run], *[f"__a_{k}" for k in wholes], *(["__follow"] if nexts else [])))

    up = group.orderBy(*places)
    local = rows.withColumns({f"__l_{k}": f(f"__v_{k}").over(up.rowsBetween(Window.unboundedPreceding, 0)) for k, (f, _) in run.items()} | {f"__f_{k}": F.lead(F.struct(f"__n_{k}")).over(up) for k in nexts} | {f"__s_{k}": F.sum(f"__w_{k}").over(group) for k in wholes})
    same = F.col(PART) == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    out = local.join(carried, same, "left")
    whole = {k: F.coalesce(F.col(f"__l_{k}") + F.col(f"__c_{k}"), f"__l_{k}", f"__c_{k}") for k in sums}
    whole |= {k: F.coalesce(F.col(f"__l_{k}").bitwiseXOR(F.col(f"__c_{k}")), f"__l_{k}", f"__c_{k}") for k in xors}
    whole |= {k: F.coalesce(f"__a_{k}", f"__s_{k}") for k in wholes}
    follow = {k: F.when(F.col(f"__f_{k}").isNotNull(), F.col(f"__f_{k}.__n_{k}")).otherwise(F.col(f"__follow.{k}")) for k in nexts}
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in whole and c not in follow], *[v.alias(k) for k, v in (whole | follow).items()])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "at", parts: int | None = None) -> DataFrame:
    """The rows with their place from 1 within ``keys``."""
    return along(df, keys, order, sums={name: F.lit(1).cast("bigint")}, parts=parts)
