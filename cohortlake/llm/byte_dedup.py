"""Removal of byte windows that occur earlier in the corpus, by sparse prefix doubling.

Ranks of suffixes are found by doubling, over sampled positions only. A window
of ``window`` bytes samples the position of its least ``prefix``-byte
fingerprint (the leftmost of equals), so equal windows sample the same place
and every window has one. The rounds:

1. Round one ranks the sampled suffixes by their first ``prefix`` bytes. Spark
   brings equal ranks together; suffixes of a unique rank are done.
2. Round two extends both ways to all bytes of the windows that sampled the
   place, and reranks by the pair. Of suffixes that agree in the pair, which is
   past the threshold, all but the first are copies throughout and done too.
3. What is left shares its first rank but not the pair, at the edges of
   repeats. Its windows are compared in full at each offset.

Ranks are fingerprints: repeats need equality, not the lexicographic order.

Defined results: a null text is an empty one; texts shorter than a window lose
nothing; matches do not cross documents; rows that share an id are ordered by a
hash of their text, of identical rows one counts as first; null ids come first; other columns
are ignored, whatever their names, unless named in ``keep_columns``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, repeats
from .packed import U64, Group, covered, mix, pack, powers, runs, unpack
from .shared import ddl

WINDOW = 100
PREFIX = 32
_FAR = U64(0xFFFFFFFFFFFFFFFF)
_PLACE = U64(0xFFFFFFFF)  # the low half holds the place, so the choice hangs on the window's bytes alone


class Suffixes:
    """Sampled suffixes of a group: place, windows it owns [start, stop], rank, rank of the pair."""

    def __init__(self, group: Group, window: int, prefix: int):
        n = len(group.data)
        self.window, self.sums = window, group.sums()
        _, self.down = powers(n + 1)
        reach = window - prefix + 1
        empty = np.zeros(0, np.int64)
        self.at = self.start = self.stop = empty
        self.rank = self.pair = np.zeros(0, np.uint64)
        if n < window:
            return
        doc_end = np.repeat(group.starts[1:], np.diff(group.starts))
        place = np.arange(n, dtype=np.int64)
        grams = n - prefix + 1
        value = mix((self.sums[prefix:] - self.sums[:grams]) * self.down[:grams])
        value &= ~_PLACE
        value |= place[:grams].astype(np.uint64)
        value[doc_end[:grams] - place[:grams] < prefix] = _FAR
        least, step = value, 1
        while step * 2 <= reach:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < reach:
            least = np.minimum(least[: len(least) - (reach - step)], least[reach - step :])
        whole = np.flatnonzero(doc_end[: len(least)] - place[: len(least)] >= window)
        if not len(whole):
            return
        owner = (least[whole] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1] + 1))))
        self.at, self.start = owner[new], whole[new]
        self.stop = whole[np.append(new[1:], len(whole)) - 1]
        self.rank = self.hashes(self.at, prefix)
        left, wide = (self.at - self.start).astype(np.uint64), (self.stop - self.start).astype(np.uint64)
        self.pair = mix(self.hashes(self.start, window + (self.stop - self.start)) + left * U64(0x9E3779B97F4A7C15) + wide * U64(0xC2B2AE3D27D4EB4F))

    def hashes(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[at + width] - self.sums[at]) * self.down[at])

    def firsts(self) -> np.ndarray:
        """Of equal (rank, pair) in the group the first, in order of place."""
        order = np.lexsort((self.pair, self.rank))
        new = np.ones(len(order), bool)
        new[1:] = (self.rank[order[1:]] != self.rank[order[:-1]]) | (self.pair[order[1:]] != self.pair[order[:-1]])
        return np.sort(order[new])

    def windows(self, of: np.ndarray) -> np.ndarray:
        """Starts of all windows that the suffixes own."""
        size = self.stop[of] - self.start[of] + 1
        return np.repeat(self.start[of] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))


def _send_ranks(group: Group, window: int, prefix: int, buckets: int) -> Iterable[tuple[int, bytes]]:
    suffixes = Suffixes(group, window, prefix)
    first = suffixes.firsts()
    for b, idx in enumerate(exchange.split_by(suffixes.rank[first], buckets)):
        if len(idx):
            yield b, pack(suffixes.rank[first[idx]], suffixes.pair[first[idx]], first[idx].astype(np.uint32))


def _answer_ranks(groups: np.ndarray, payloads: list[bytes]) -> Iterable[tuple[int, bytes]]:
    """To each group: suffixes whose pair came earlier, and the firsts of pairs that share a rank."""
    parts = [unpack(p) for p in payloads]
    rank, pair, name = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((pair, rank))  # stable, and groups ascend: the first of equals is the earliest
    same_rank = np.concatenate(([False], rank[order[1:]] == rank[order[:-1]]))
    same_pair = np.concatenate(([False], same_rank[1:] & (pair[order[1:]] == pair[order[:-1]])))
    begin = np.flatnonzero(~same_rank)
    kinds = np.add.reduceat((~same_pair).astype(np.int64), begin)
    mixed = np.repeat(kinds > 1, np.diff(np.append(begin, len(order))))
    copy, edge = np.zeros(len(order), bool), np.zeros(len(order), bool)
    copy[order] = same_pair
    edge[order] = mixed & ~same_pair
    at = 0
    for g, p in zip(groups, parts, strict=True):
        c, e = copy[at : at + len(p[0])], edge[at : at + len(p[0])]
        if c.any() or e.any():
            yield int(g), pack(p[2][c], p[2][e])
        at += len(p[0])


def _windows_at_edges(suffixes: Suffixes, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = suffixes.windows(np.sort(edge.astype(np.int64)))
    return at, suffixes.hashes(at, suffixes.window)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int | None = None, keep_columns: Iterable[str] = (), group_bytes: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, removed (byte spans, end-exclusive), kept (binary)[, extra].

    A byte goes if a string of ``window`` bytes covers it that also starts
    earlier, in a smaller id or before it in the document; overlaps count, and
    strings are judged on the input. ``prefix`` (a third of the window unless
    given) is the length that the first round compares.
    """
    prefix = prefix or max(1, window * PREFIX // WINDOW)
    if not 0 < prefix <= window:
        raise ValueError("prefix must be within the window")
    keep_columns = list(keep_columns)
    dealt = exchange.deal(docs, id_col, text_col, keep_columns, group_bytes)
    n = dealt.buckets

    def again(g: int, group: Group, got: dict[int, list[bytes]]) -> pa.Table:
        at, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        edges = [unpack(p)[1] for payloads in got.values() for p in payloads]
        if sum(map(len, edges)):
            at, h = _windows_at_edges(Suffixes(group, window, prefix), np.concatenate(edges))
        return exchange.sent(g, repeats.send_windows(h, at, n, ((b, p) for b, payloads in got.items() for p in payloads)))

    def last(g: int, group: Group, got: dict[int, list[bytes]]) -> pa.Table:
        suffixes = Suffixes(group, window, prefix)
        copies, edges, lost = [], [], []
        for payloads in got.values():
            for raw in payloads:
                kind, body = unpack(raw)
                if kind[0] == repeats.FORWARD:
                    c, e = unpack(body.tobytes())
                    copies.append(c)
                    edges.append(e)
                else:
                    lost.append(body)
        own_copy = np.ones(len(suffixes.at), bool)
        own_copy[suffixes.firsts()] = False
        if copies:
            own_copy[np.concatenate(copies)] = True
        whole = np.flatnonzero(own_copy)
        edge = np.zeros(len(group.data) + 1, np.int32)
        np.add.at(edge, suffixes.start[whole], 1)
        np.add.at(edge, suffixes.stop[whole] + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        if sum(map(len, edges)):
            at, h = _windows_at_edges(suffixes, np.concatenate(edges))
            gone |= covered(len(group.data), repeats.later_windows(h, at, lost), window)
        return _results(group, gone, bool(keep_columns))

    fields = docs.select(*[F.col(f"`{c}`") for c in keep_columns]).schema if keep_columns else None
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, removed array<struct<start:int,stop:int>>, kept binary" + (f", extra {ddl(fields)}" if fields else "")
    asked = exchange.ask(dealt, lambda g, group: _send_ranks(group, window, prefix, n))
    windows = exchange.told(dealt, exchange.answer(asked, _answer_ranks), again, exchange.SENT)
    return exchange.told(dealt, exchange.answer(windows, repeats.answer_windows), last, schema)


def _results(group: Group, gone: np.ndarray, extra: bool) -> pa.Table:
    n_removed, removed, kept = [], [], []
    bounds, raw = group.starts.tolist(), group.data.tobytes()
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        own = gone[a:z]
        first, stop = runs(own) if own.any() else ((), ())
        n_removed.append(int(own.sum()))
        removed.append([{"start": int(s), "stop": int(e)} for s, e in zip(first, stop, strict=True)])
        at, parts = a, []
        for s, e in zip(first, stop, strict=True):
            parts.append(raw[at : a + s])
            at = a + e
        kept.append(b"".join([*parts, raw[at:z]]))
    spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
    cols = {"doc_id": group.ids, "n_bytes": pa.array(np.diff(group.starts)), "n_removed": pa.array(n_removed, pa.int64()), "removed": spans, "kept": pa.array(kept, pa.binary())}
    return pa.table(cols | ({"extra": group.extra()} if extra else {}))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """100-byte strings of ``documents`` that also start earlier, removed."""
    out = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
