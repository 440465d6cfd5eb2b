"""Corpus-wide questions about fingerprints, asked in packed form.

Documents are dealt into groups by ranges of their id, so (group, place in the
group) orders all documents; rows that share an id are ordered by a hash of
their text. A task turns its group into arrays, removes what
repeats inside the group, and sends one packed row per (bucket, group), where
the bucket comes from the fingerprint. A bucket's task sees every group's
entries once, answers each, and the answers go back by group. A fingerprint
that a third of the corpus holds thus costs one entry per group, not one per
occurrence. Groups and buckets grow in bytes with the root of the corpus, so
their rows, groups times buckets, are in proportion to it up to 2 TB; beyond
that groups have 16 MB and buckets 256 MB, what a task of a large cluster can
hold, and rows only get shorter.

The text is shuffled once: each step groups the same exchange by ``g``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, NumericType

from .components import hot_join
from .packed import Group, forget_powers
from .shared import cut

GROUP, BUCKET, FROM = 2 << 20, 16 << 20, 32 << 30  # bytes of text, up to a corpus of FROM bytes
RANGES = 4096
SENT = "bucket int, g int, payload binary"
ANSWER = "g int, bucket int, payload binary"
_SENT = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("payload", pa.binary())])
_ANSWER = pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


@dataclass(frozen=True)
class Dealt:
    """Documents with their group, the number of buckets that suits their size, and their bytes."""

    docs: DataFrame  # g, doc_id, h, text and, if asked for, extra
    groups: int
    buckets: int
    size: int


def _fitting(size: int) -> tuple[int, int]:
    """Bytes of text of a group and of a bucket: both grow with the root of the corpus, so that packed rows,
    groups times buckets, grow with the corpus itself, up to what a task of a large cluster can hold."""
    grown = max(1.0, (size / FROM) ** 0.5)
    return int(GROUP * min(8.0, grown)), int(BUCKET * min(16.0, grown))


def _numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """The documents and a number that orders them as their ids do, null for null ids.

    Whole numbers under 2**53 and finite floats are their own; for all other ids
    the distinct ones are range partitioned, sorted and numbered by Spark.
    """
    kind = docs.schema[id_col].dataType
    if isinstance(kind, NumericType) and not isinstance(kind, DecimalType):
        at = F.col(f"`{id_col}`").cast("double")
        far = docs.agg(F.max(F.abs(at))).first()[0]
        if far is None or far < (1 << 53 if isinstance(kind, IntegralType) else float("inf")):
            return docs, at
    ids = docs.select(F.col(f"`{id_col}`").alias("__id")).filter("__id is not null").distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = cut(ids.repartitionByRange(parts, "__id").sortWithinPartitions("__id").withColumn("__rank", F.monotonically_increasing_id()))
    # null ids, and any id that very many rows hold, meet their rank in many tasks
    keyed = docs.withColumn("__id", F.col(f"`{id_col}`")).withColumn("__row", F.monotonically_increasing_id())
    return hot_join(keyed, ranks, "__id", "__row", 96, how="left"), F.col("__rank").cast("double")


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Iterable[str] = (), group_bytes: int | None = None, bucket_bytes: int | None = None) -> Dealt:
    """Deal documents into groups of about ``group_bytes`` by ranges of (id, hash of the text).

    At most ``RANGES`` bounds come from approximate quantiles of the id, rows
    weighted by their bytes, whatever the corpus; a range is cut in further
    groups evenly between its bounds. Null ids come first. An id that takes up
    ranges of its own, as null or any other may, is cut by the hash of its
    texts instead. Ids may be of any type that Spark can order.
    """
    from pyspark.ml.feature import Bucketizer  # here, so that workers, which import this module, do not hold pyspark.ml

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("bigint"))).first()[0] or 0
    fitting = _fitting(size)
    group_bytes, bucket_bytes = group_bytes or fitting[0], bucket_bytes or fitting[1]
    groups = max(1, parts if size > (parts << 16) else 1, -(-size // group_bytes))
    buckets = max(1, min(parts, groups), -(-size // bucket_bytes))
    numbered, at = (docs, F.lit(0.0)) if groups == 1 else _numbered(docs, id_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    chosen = numbered.select(at.alias("at"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"), *([F.struct(*[F.col(f"`{c}`").alias(c) for c in extra]).alias("extra")] if extra else []))
    named = ["doc_id", "h", "text", *(["extra"] if extra else [])]
    if groups == 1:
        return Dealt(chosen.select(F.lit(0).alias("g"), *named), 1, buckets, size)
    low, high = chosen.agg(F.min("at"), F.max("at")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    before = min(low - 1, float(np.nextafter(low, -np.inf)))  # of null ids
    ranges = min(groups, RANGES)
    each = -(-groups // ranges)
    units = F.least(F.octet_length("text") * 64 / group_bytes, F.lit(64)).cast("int") + 1
    weighted = chosen.select(F.coalesce("at", F.lit(before)).alias("at"), F.explode(F.array_repeat(F.lit(0), units)))
    cuts = sorted(weighted.approxQuantile("at", [i / ranges for i in range(1, ranges)], 0.1 / ranges))
    # the parts of the line: (start, end, first group, groups, cut by hash)
    line, first = [], 0
    bounds, many = np.unique(np.array(cuts), return_counts=True)
    starts = [before, *bounds.tolist(), high]
    for i, (a, z) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        hot = int(many[i - 1]) if i else 0
        if hot > 1:  # the id ``a`` alone
            line.append((a, a, first, hot * each, True))
            first += hot * each
            a = float(np.nextafter(a, np.inf))
        line.append((a, max(a, z), first, each, False))
        first += each
    begin = [float("-inf"), *[x[0] for x in line[1:]], float("inf")]
    keep = [0, *[i for i in range(1, len(line)) if begin[i] > begin[i - 1]]]
    line, begin = [line[i] for i in keep], [begin[i] for i in keep] + [float("inf")]
    placed = chosen.withColumn("at", F.coalesce("at", F.lit(before)))
    if len(line) == 1:
        placed = placed.withColumn("of", F.lit(0))
    else:
        placed = Bucketizer(splits=begin, inputCol="at", outputCol="of").transform(placed).withColumn("of", F.col("of").cast("int"))
    got = lambda k: F.element_at(F.lit([x[k] for x in line]), F.col("of") + 1)
    place = F.when(got(4), (F.col("h") / 2.0**64 + 0.5) * got(3)).otherwise(F.when(got(1) > got(0), (F.col("at") - got(0)) / (got(1) - got(0)) * got(3)).otherwise(0.0))
    g = got(2) + F.greatest(F.lit(0), F.least(got(3) - 1, F.floor(place).cast("int")))
    return Dealt(placed.select(g.cast("int").alias("g"), *named), first, buckets, size)


TABLES: list[Callable[[], None]] = []  # each forgets a table that a process keeps from task to task


def drop_tables() -> None:
    """Forgets what earlier tasks of other operators keep in this process; a worker serves one stage after another."""
    for forget in TABLES:
        forget()


def give_back() -> None:
    """Returns freed memory to the machine: a worker outlives its task, and the next stage may not need as much."""
    forget_powers()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sent(g: int, parts: Iterable[tuple[int, bytes]]) -> pa.Table:
    rows = list(parts)
    return pa.table([pa.array([b for b, _ in rows], pa.int32()), pa.array([g] * len(rows), pa.int32()), pa.array([p for _, p in rows], pa.binary())], schema=_SENT)


def split_by(key: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Indices of the entries of each bucket, in their order."""
    of = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return np.split(order, np.searchsorted(of[order], np.arange(1, buckets)))


def ask(dealt: Dealt, step: Callable[[int, Group], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """First step: every group sends (bucket, payload) rows."""

    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        out = sent(g, step(g, Group(table)))
        give_back()
        return out

    return dealt.docs.groupBy("g").applyInArrow(run, SENT)


def answer(asked: DataFrame, step: Callable[[np.ndarray, list[bytes]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """A bucket's task gets the groups, ascending, with their payloads, and gives back (group, payload)."""

    def run(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        gs = table.column("g").to_numpy()
        order = np.argsort(gs, kind="stable")
        payloads = table.column("payload").to_pylist()
        rows = list(step(gs[order], [payloads[i] for i in order]))
        out = pa.table([pa.array([g for g, _ in rows], pa.int32()), pa.array([b] * len(rows), pa.int32()), pa.array([p for _, p in rows], pa.binary())], schema=_ANSWER)
        del payloads, rows
        give_back()
        return out

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def told(dealt: Dealt, answers: DataFrame, step: Callable[[int, Group, dict[int, list[bytes]]], pa.Table], schema: str) -> DataFrame:
    """A further step: every group again, with the answers by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[int, list[bytes]] = {}
        for b, p in zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True):
            got.setdefault(b, []).append(p)
        g = left.column("g")[0].as_py()
        out = step(g, Group(left), got)
        give_back()
        return out

    return dealt.docs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, schema)


def pieces(batches: Iterable[pa.RecordBatch], text_col: str = "text", most: int = 1 << 20) -> Iterable[pa.Table]:
    """Arrow batches cut into tables of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            until = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right"))
            until = min(max(until, at + 1), batch.num_rows)
            yield pa.Table.from_batches([batch.slice(at, until - at)])
            at = until
    give_back()
