"""Removal of word windows that occur earlier in the corpus, by fixed-block anchors.

A window of ``window`` words holds one aligned block of ``(window + 1) // 2``
words, or one shorter, of any document that also has the window. So the blocks
at multiples of that width are indexed, every rolling window of that width
probes them, and a hit is extended: all windows that contain a hit anchor are
compared over the corpus, and neighbouring equal windows merge to the maximal
exact repeat.

Defined results: a null text is an empty one, and empty texts or texts of fewer
words than a window lose nothing; rows that share an id are ordered by a hash
of their text, of identical rows one counts as first; null ids come first; other columns are
ignored, whatever their names, unless named in ``keep_columns``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, repeats
from .packed import Group, Words, covered, pack, runs, unpack
from .shared import ddl

WINDOW = 20


def _local_probes(words: Words, hashes: np.ndarray, block: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per bucket: distinct rolling fingerprints (ascending), whether each is an aligned block, occurs twice; and the windows' starts."""
    at, h = words.windows(hashes, block)
    of = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)  # short keys sort faster
    key = (h // np.uint64(buckets)).astype(np.uint32)
    aligned = (at - words.first[words.doc[at]]) % block == 0 if len(at) else np.zeros(0, bool)
    out = []
    order = np.argsort(of, kind="stable")
    for idx in np.split(order, np.searchsorted(of[order], np.arange(1, buckets))):
        distinct, inverse, count = np.unique(key[idx], return_inverse=True, return_counts=True)
        block_of = np.zeros(len(distinct), bool)
        block_of[inverse[aligned[idx]]] = True
        out.append((distinct, block_of, count > 1, (at[idx], inverse)))
    return out


def _send_probes(group: Group, block: int, buckets: int) -> Iterable[tuple[int, bytes]]:
    words = Words(group)
    for b, (distinct, is_block, twice, _) in enumerate(_local_probes(words, words.hashes(), block, buckets)):
        if len(distinct):
            yield b, pack(distinct, np.packbits(is_block), np.packbits(twice))


def _answer_probes(groups: np.ndarray, payloads: list[bytes]) -> Iterable[tuple[int, bytes]]:
    """A bit per probe sent: an indexed block has this fingerprint, and it occurs more than once."""
    parts = [unpack(p) for p in payloads]
    sizes = [len(p[0]) for p in parts]
    key = np.concatenate([p[0] for p in parts])
    block = np.concatenate([np.unpackbits(p[1])[:n] for p, n in zip(parts, sizes, strict=True)]).astype(bool)
    twice = np.concatenate([np.unpackbits(p[2])[:n] for p, n in zip(parts, sizes, strict=True)]).astype(bool)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    many = (np.diff(np.append(first, len(key))) > 1) | np.logical_or.reduceat(twice[order], first)
    hit = many & np.logical_or.reduceat(block[order], first)
    flags = np.empty(len(key), bool)
    flags[order] = np.repeat(hit, np.diff(np.append(first, len(key))))
    at = 0
    for g, n in zip(groups, sizes, strict=True):
        if flags[at : at + n].any():
            yield int(g), np.packbits(flags[at : at + n]).tobytes()
        at += n


def _candidates(words: Words, hashes: np.ndarray, window: int, block: int, buckets: int, bits: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows that contain a hit anchor: (starts, fingerprints)."""
    near = np.zeros(len(words) + 1, bool)
    if bits:
        for b, (distinct, _, _, (at, inverse)) in enumerate(_local_probes(words, hashes, block, buckets)):
            if b in bits:
                near[at[np.unpackbits(np.frombuffer(bits[b], np.uint8))[: len(distinct)].astype(bool)[inverse]]] = True
    if not near.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, h = words.windows(hashes, window)
    seen = np.concatenate(([0], np.cumsum(near)))
    hit = seen[at + window - block + 1] > seen[at]
    return at[hit], h[hit]


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_columns: Iterable[str] = (), group_bytes: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, removed (spans of words, end-exclusive), kept_text[, extra].

    A word goes if a window of ``window`` words of one document covers it and
    the same word sequence also starts earlier, in a smaller id or before it in
    the document. Windows are judged on the input. The words kept are joined by
    one space. ``group_bytes`` bounds what a task holds, but for a longer text;
    unless given it follows the corpus.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    block = window // 2
    keep_columns = list(keep_columns)
    dealt = exchange.deal(docs, id_col, text_col, keep_columns, group_bytes)
    n = dealt.buckets

    def again(g: int, group: Group, got: dict[int, list[bytes]]) -> pa.Table:
        at, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if got:
            words = Words(group)
            at, h = _candidates(words, words.hashes(), window, block, n, {b: p[0] for b, p in got.items()})
        return exchange.sent(g, repeats.send_windows(h, at, n, ((b, pack(np.array([b], np.int64), np.frombuffer(p[0], np.uint8))) for b, p in got.items())))

    fields = docs.select(*[F.col(f"`{c}`") for c in keep_columns]).schema if keep_columns else None
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, removed array<struct<start:int,stop:int>>, kept_text string" + (f", extra {ddl(fields)}" if fields else "")

    def last(g: int, group: Group, got: dict[int, list[bytes]]) -> pa.Table:
        words = Words(group)
        bits, lost = {}, []
        for payloads in got.values():
            for raw in payloads:
                kind, body = unpack(raw)
                if kind[0] == repeats.FORWARD:
                    b, p = unpack(body.tobytes())
                    bits[int(b[0])] = p.tobytes()
                else:
                    lost.append(body)
        gone = np.zeros(len(words), bool)
        if bits:
            at, h = _candidates(words, words.hashes(), window, block, n, bits)
            gone = covered(len(words), repeats.later_windows(h, at, lost), window)
        return _results(group, words, gone, bool(keep_columns))

    asked = exchange.ask(dealt, lambda g, group: _send_probes(group, block, n))
    windows = exchange.told(dealt, exchange.answer(asked, _answer_probes), again, exchange.SENT)
    return exchange.told(dealt, exchange.answer(windows, repeats.answer_windows), last, schema)


def _results(group: Group, words: Words, gone: np.ndarray, extra: bool) -> pa.Table:
    text, removed, n_words, n_removed = [], [], np.diff(words.first, append=len(words)), []
    raw, bounds = words.data.tobytes(), [*words.first.tolist(), len(words)]
    for d in range(group.n):
        a, z = bounds[d], bounds[d + 1]
        own = gone[a:z]
        n_removed.append(int(own.sum()))
        keep = np.flatnonzero(~own) + a
        text.append(b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.stop[keep].tolist(), strict=True)]))
        first, stop = runs(own) if n_removed[-1] else ((), ())
        removed.append([{"start": int(s), "stop": int(e)} for s, e in zip(first, stop, strict=True)])
    spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
    cols = {"doc_id": group.ids, "n_words": pa.array(n_words.astype(np.int64)), "n_removed": pa.array(n_removed, pa.int64()), "removed": spans, "kept_text": pa.array(text, pa.binary()).cast(pa.string())}
    return pa.table(cols | ({"extra": group.extra()} if extra else {}))


def op2_word_window_dedup(spark, sf_dir: str) -> DataFrame:
    """20-word windows of ``documents`` that also start earlier, removed."""
    out = repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.size("removed").alias("n_spans"))
