"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of n-grams over all training texts are quantised to powers of two, and
an n-gram of count c enters the filter once for each level 1 .. floor(log2 c)+1.
A lookup probes level after level until one is missing. The filter is cut into
segments by fingerprint, which are never broadcast: by the packed exchange every
group sends its distinct n-grams to their segment's task, which makes the
segment from all counts, at ``BITS`` bits an entry however many there are,
probes it for the same n-grams and sends the levels back. No count is left out,
and false positives have one rate at every size, (1 - exp(-3 / 16))**3 or about
0.5 percent. The number of segments follows from the size of the texts alone,
so scores do not hang on partitions. Unigram counts go the same way and stay
exact.

P(w | context), a text's start being a context like any other, is backoff_keep * count(context w) / count(context) where the
filter holds the n-gram, else (1 - backoff_keep) * P1(w), with
P1(w) = (c(w) + 1) / (N + V + 1): at most 1 in sum over w but for the filter's
false positives.

Defined results: a null text is an empty one, of one token, the end; a null
training flag counts as training; every row is scored, repeated ids or not.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange
from .packed import U64, Group, Words, mix, pack, unpack

END, START = U64(0x5BD1E995A3C59AC3), U64(0x1B873593CC9E2D51)
HASHES = 3
BITS = 16  # of the filter for an entry
KEY = 40  # bits that an n-gram is known by within its segment
SEGMENT = 4 << 20  # bytes of text a segment, 64 segments at least


def tokens(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words, lower-cased in A-Z, with one end a document; and each token's document."""
    words = Words(group, lower=True)
    place = np.arange(len(words)) + words.doc
    total = len(words) + group.n
    out = np.full(total, END, np.uint64)
    out[place] = words.hashes()
    doc = np.empty(total, np.int64)
    doc[place] = words.doc
    doc[words.first + np.diff(words.first, append=len(words)) + np.arange(group.n)] = np.arange(group.n)
    return out, doc


def contexts(token: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 2 .. order the fingerprint of each token's n - 1 predecessors; before a document stands its start."""
    out, last = [], np.zeros(len(token), np.uint64)
    for n in range(1, order):
        before = np.full(len(token), START, np.uint64)
        before[n:] = np.where(doc[n:] == doc[:-n], token[:-n], START)
        last = mix(last * U64(0x9FB21C651E98DF25) + before)
        out.append(last)
    return out


def _gram(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * U64(0xD6E8FEB86659FD93) + token)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def _bits(key: np.ndarray, level: int, size: int) -> Iterable[np.ndarray]:
    for i in range(HASHES):
        yield (mix(key + U64(level * 2654435761 + i * 40503 + 1)) % U64(size)).astype(np.int64)


def split_key(gram: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each n-gram and the ``KEY`` bits it is known by there; neither hangs on how tasks are dealt."""
    return (gram % U64(segments)).astype(np.int64), gram // U64(segments) & U64((1 << KEY) - 1)


@dataclass(frozen=True)
class Filter:
    """The filters of several segments end to end: segment i has ``size[i]`` bits from ``first[i]`` on."""

    flags: np.ndarray
    first: np.ndarray
    size: np.ndarray

    def at(self, segment: np.ndarray, key: np.ndarray, level: int) -> Iterable[np.ndarray]:
        for i in range(HASHES):
            yield self.first[segment] + (mix(key + U64(level * 2654435761 + i * 40503 + 1)) % self.size[segment].astype(U64)).astype(np.int64)

    @classmethod
    def of(cls, segment: np.ndarray, key: np.ndarray, counts: np.ndarray, segments: int, least: int = 64) -> Filter:
        """From all levels of distinct n-grams; a segment's size follows from its own entries."""
        level = _levels(counts)
        size = np.maximum(least, BITS * np.bincount(segment, weights=level, minlength=segments).astype(np.int64))
        out = cls(np.zeros(int(size.sum()), bool), np.cumsum(size) - size, size)
        for j in range(1, int(level.max(initial=0)) + 1):
            held = level >= j
            for at in out.at(segment[held], key[held], j):
                out.flags[at] = True
        return out

    def levels(self, segment: np.ndarray, key: np.ndarray) -> np.ndarray:
        """By repeated probes the last level of each n-gram without a miss before it; 0 for absent ones."""
        out = np.zeros(len(key), np.uint8)
        live, level = np.arange(len(key)), 1
        while len(live):
            ok = np.ones(len(live), bool)
            for at in self.at(segment[live], key[live], level):
                ok &= self.flags[at]
            live = live[ok]
            out[live] = level
            level += 1
        return out


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, backoff_keep: float = 0.4, group_bytes: int | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, n_ngrams (found in the filter), train_tokens, train_types, base_score, score."""
    if order < 2 or not 0 < backoff_keep < 1:
        raise ValueError("order must be 2 or more, backoff_keep between 0 and 1")
    flagged = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    dealt = exchange.deal(flagged, "doc_id", "text", ["train"], group_bytes)
    n = dealt.buckets
    segments = max(64, 1 << (dealt.size // SEGMENT).bit_length())

    def dealt_out(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        segment, low = split_key(gram, segments)
        return segment, low, exchange.split_by(segment.astype(U64), n)

    def distinct(group: Group):
        token, doc = tokens(group)
        trains = group.rows.column("extra").combine_chunks().field("train").to_numpy(zero_copy_only=False).astype(bool) if group.n else np.zeros(0, bool)
        grams = np.concatenate([_gram(c, token) for c in contexts(token, doc, order)])
        out = []
        for x, of in ((token, doc), (grams, np.tile(doc, order - 1))):
            key, inverse = np.unique(x, return_inverse=True)
            out += [key, inverse, np.bincount(inverse, weights=trains[of], minlength=len(key)).astype(np.int64)]
        return token, doc, *out

    def ask(g: int, group: Group):
        _, _, key, _, counts, gram, _, times = distinct(group)
        segment, low, parts = dealt_out(gram)
        for b, (idx, of) in enumerate(zip(exchange.split_by(key, n), parts, strict=True)):
            if len(idx) or len(of):
                of = of[np.argsort(segment[of], kind="stable")]
                number = np.bincount(segment[of] // n, minlength=-(-segments // n))  # of each segment of the bucket
                other = np.flatnonzero(times[of] != 1)
                yield b, pack(key[idx], counts[idx].astype(np.uint32), low[of].astype(np.uint32), (low[of] >> U64(32)).astype(np.uint8), number.astype(np.uint32), other.astype(np.uint32), times[of][other].astype(np.uint32))

    def total(table: pa.Table) -> pa.Table:
        gs, parts = table.column("g").to_numpy(), [unpack(p) for p in table.column("payload").to_pylist()]
        key = np.concatenate([p[0] for p in parts])
        _, inverse = np.unique(key, return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        own = -(-segments // n)  # segments of a bucket
        low = np.concatenate([p[2].astype(np.uint64) | p[3].astype(np.uint64) << U64(32) for p in parts])
        segment = np.concatenate([np.repeat(np.arange(own), p[4]) for p in parts])
        gram, place = np.unique(segment.astype(np.uint64) << U64(KEY) | low, return_inverse=True)
        each = np.ones(len(place), np.int64)
        each[np.concatenate([p[5].astype(np.int64) + first for p, first in zip(parts, np.cumsum([0] + [len(p[2]) for p in parts])[:-1], strict=True)])] = np.concatenate([p[6] for p in parts])
        times = np.bincount(place, weights=each, minlength=len(gram)).astype(np.int64)
        of, key = (gram >> U64(KEY)).astype(np.int64), gram & U64((1 << KEY) - 1)
        levels = Filter.of(of[times > 0], key[times > 0], times[times > 0], own).levels(of, key)
        counts = counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64)
        told, at, by = [], 0, 0
        for p in parts:
            told.append(pack(counts[inverse[at : at + len(p[0])]], levels[place[by : by + len(p[2])]]))
            at, by = at + len(p[0]), by + len(p[2])
        b = table.column("bucket")[0].as_py()
        rows = len(gs)
        row = {"g": pa.array([*gs.tolist(), -1], pa.int32()), "bucket": pa.array([b] * (rows + 1), pa.int32()), "payload": pa.array([*told, b""], pa.binary())}
        return pa.table(row | {"tokens": pa.array([0] * rows + [int(counts.sum(dtype=np.int64))], pa.int64()), "types": pa.array([0] * rows + [int((counts > 0).sum())], pa.int64())})

    def last(g: int, group: Group, got: dict[int, list[bytes]]) -> pa.Table:
        token, doc, key, inverse, _, gram, place, _ = distinct(group)
        counts, level = np.zeros(len(key), np.int64), np.zeros(len(gram), np.int64)
        segment, _, parts = dealt_out(gram)
        for b, (idx, of) in enumerate(zip(exchange.split_by(key, n), parts, strict=True)):
            if len(idx) or len(of):
                counts[idx], level[of[np.argsort(segment[of], kind="stable")]] = unpack(got[b][0])
        own = counts[inverse]
        begins = np.diff(doc, prepend=-1) > 0
        trained = own[token == END][0] if len(token) else 0  # texts, for each has one end: the count of their start as a context
        known = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)[place].reshape(order - 1, len(token))
        logs = np.log10(own + 1.0)
        # of the longest context that the filter knows with this token
        hit, value = np.zeros(len(token), bool), np.zeros(len(token))
        for c in range(order - 2, -1, -1):
            times = known[c]
            if c:
                before = np.roll(known[c - 1], 1)  # the context as an n-gram: its last token after its own context
            else:
                before = np.roll(own, 1)
            before[begins] = trained
            new = ~hit & (times > 0) & (before > 0)
            value[new] = np.log10(backoff_keep * np.minimum(1.0, times[new] / before[new]))
            hit |= new
        add = lambda x: np.bincount(doc, weights=x, minlength=group.n)
        return pa.table({
            "doc_id": group.ids,
            "n_tokens": pa.array(add(np.ones(len(doc))).astype(np.int64)), "n_known": pa.array(add(own > 0).astype(np.int64)),
            "n_ngrams": pa.array(add(hit).astype(np.int64)), "logs": pa.array(add(logs)), "missed": pa.array(add(np.where(hit, 0.0, logs))), "found": pa.array(add(value)),
        })

    answers = exchange.ask(dealt, ask).groupBy("bucket").applyInArrow(total, exchange.ANSWER + ", tokens bigint, types bigint")
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, n_known bigint, n_ngrams bigint, logs double, missed double, found double"
    parts = exchange.told(dealt, answers.filter("g >= 0").select("g", "bucket", "payload"), last, schema)
    totals = answers.filter("g = -1").agg(F.sum("tokens").alias("train_tokens"), F.sum("types").alias("train_types"))
    room = F.log10((F.col("train_tokens") + F.col("train_types") + 1).cast("double"))
    misses = F.col("n_tokens") - F.col("n_ngrams")
    return parts.join(F.broadcast(totals)).select(
        "doc_id", "n_tokens", "n_known", "n_ngrams", "train_tokens", "train_types", (F.col("logs") - F.col("n_tokens") * room).alias("base_score"),
        (F.col("missed") + F.col("found") + misses * (F.log10(F.lit(1 - backoff_keep)) - room)).alias("score"),
    )


def op10_ngram_lm(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, scored by counts from six sevenths of them."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_texts(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_ngrams")
