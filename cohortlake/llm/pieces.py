"""SentencePiece encoding and decoding in batches of equally long words.

Words advance together: all distinct new words of one length form a matrix,
substring fingerprints probe the sorted fingerprints of the pieces, and
vectorised maxima choose. Unigram models take the best segmentation by Viterbi
with stored backpointers. A model of type BPE is defined by merges, best score
first and leftmost of equals, which is not the best sum; for it the same probes
give the scores of neighbouring pairs, and each round merges the maximum of
every word; a word of over ``LONG`` characters keeps its pairs in a heap instead,
so its cost grows with n log n. piece_bpe_32k.model is such a model.

Words are what stands between the starts of white-space runs, so a piece that
had white space after another character would break them; the model is checked
for that. Newlines are split off too if no piece holds one. A model whose own
normalisation changes texts in another way, or puts no space before them, is
refused: the library encodes a few probes and the results are compared.

Defined results: a null text is an empty one and has no ids; characters without
a piece become bytes, or the unknown id if the model has no bytes; of equal
scores the leftmost pair, or the longest first piece, wins; repeated rows are
encoded each; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .packed import U64, mix, powers

SPACE = "▁"
_KEPT = 1 << 18
LONG = 512
_NONE = -np.inf


def _code_sums(points: np.ndarray) -> np.ndarray:
    """Prefix sums along rows of mixed code points times powers."""
    up, _ = powers(points.shape[1] + 1)
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + U64(0x51ED270B)) * up[:-1], axis=1, out=out[:, 1:])
    return out


class Vocabulary:
    """Pieces with scores; ``kind`` is "unigram" or "bpe"."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, byte_ids: list[int] | None, unknown: int = 0, special: Iterable[int] = ()):
        skip = {*special, *(byte_ids or ())}
        self.kind, self.byte_ids, self.unknown = kind, byte_ids, unknown
        named = [(p, i) for i, p in enumerate(pieces) if i not in skip and p]
        if any(SPACE in p.lstrip(SPACE) for p, _ in named):
            raise ValueError("a piece has white space after another character")
        self.lines = not any("\n" in p for p, _ in named)
        keys = np.concatenate([self._keys([p for p, _ in group]) for group in self._by_length(named)]) if named else np.zeros(0, np.uint64)
        ids = np.array([i for group in self._by_length(named) for _, i in group], np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.scores = np.array(scores, float)[self.ids]
        self.score_of = {p: float(scores[i]) for p, i in named}
        self.longest = max((len(p) for p, _ in named), default=1)
        self.floor = (self.scores.min() if len(self.scores) else 0.0) - 10.0  # of an unknown character in a unigram model
        self.bytes = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids or ()):
            self.bytes[i] = bytes([b])
        for i in special:
            self.bytes[i] = b"" if i != unknown else " ⁇ ".encode()
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _by_length(named):
        out: dict[int, list] = {}
        for p, i in named:
            out.setdefault(len(p), []).append((p, i))
        return out.values()

    @staticmethod
    def _keys(same: list[str]) -> np.ndarray:
        points = np.frombuffer("".join(same).encode("utf-32-le"), np.uint32).reshape(len(same), -1)
        return mix(_code_sums(points)[:, -1] + U64(points.shape[1]))

    def probe(self, key: np.ndarray) -> np.ndarray:
        """Index of each key among the sorted pieces, or -1."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, of in by.items():
            if n:
                for at in range(0, len(of), max(1, (1 << 20) // n)):
                    some = of[at : at + max(1, (1 << 20) // n)]
                    points = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(len(some), n)
                    if self.kind == "bpe":
                        nexts = self._merge(points) if n <= LONG else np.stack([self._merge_long(words[i]) for i in some])
                    else:
                        nexts = self._viterbi(points)
                    for i, ids in zip(some, self._named(points, nexts), strict=True):
                        out[i] = ids
        return out

    def _range_key(self, sums: np.ndarray, row: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        _, down = powers(sums.shape[1] + 1)
        return mix((sums[row, z] - sums[row, a]) * down[a] + (z - a).astype(np.uint64))

    def _merge(self, points: np.ndarray) -> np.ndarray:
        """next[w, i]: where the piece that starts at i ends, 0 if none starts there."""
        w, n = points.shape
        sums = _code_sums(points)
        nxt = np.tile(np.arange(1, n + 1), (w, 1))
        before = np.tile(np.arange(-1, n), (w, 1))
        pair = np.full((w, n), _NONE)

        def rate(row: np.ndarray, at: np.ndarray) -> None:
            mid = nxt[row, at]
            ok = mid < n
            row, at, mid = row[ok], at[ok], mid[ok]
            hit = self.probe(self._range_key(sums, row, at, nxt[row, mid]))
            pair[row, at] = np.where(hit >= 0, self.scores[hit], _NONE)

        for i in range(n - 1):
            rate(np.arange(w), np.full(w, i))
        rows = np.arange(w)
        while len(rows):
            at = pair[rows].argmax(axis=1)
            live = pair[rows, at] > _NONE
            rows, at = rows[live], at[live]
            mid = nxt[rows, at]
            end = nxt[rows, mid]
            nxt[rows, at], nxt[rows, mid] = end, 0
            before[rows, end] = at
            pair[rows, mid] = pair[rows, at] = _NONE
            rate(rows, at)
            left = before[rows, at]
            has = left >= 0
            pair[rows[has], left[has]] = _NONE
            rate(rows[has], left[has])
        return nxt

    def _merge_long(self, word: str) -> np.ndarray:
        """``_merge`` for one long word: the same merges in the same order, pairs in a heap."""
        n, score_of = len(word), self.score_of
        nxt, before, heap = list(range(1, n + 1)), list(range(-1, n)), []

        def rate(at: int) -> None:
            if at >= 0 and (mid := nxt[at]) < n and (score := score_of.get(word[at : nxt[mid]])) is not None:
                heap.append((-score, at, mid, nxt[mid])) if not begun else heapq.heappush(heap, (-score, at, mid, nxt[mid]))

        begun = False
        for i in range(n - 1):
            rate(i)
        heapq.heapify(heap)
        begun = True
        while heap:
            _, at, mid, end = heapq.heappop(heap)
            if nxt[at] != mid or nxt[mid] != end:
                continue
            nxt[at], nxt[mid], before[end] = end, 0, at
            rate(at)
            rate(before[at])
        return np.array(nxt)

    def _viterbi(self, points: np.ndarray) -> np.ndarray:
        w, n = points.shape
        sums, rows = _code_sums(points), np.arange(w)
        best = np.full((w, n + 1), _NONE)
        best[:, 0] = 0
        back = np.zeros((w, n + 1), np.int64)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                hit = self.probe(self._range_key(sums, rows, np.full(w, start), np.full(w, end)))
                score = np.where(hit >= 0, self.scores[hit], self.floor if end == start + 1 else _NONE) + best[:, start]
                better = score > best[:, end]
                best[better, end] = score[better]
                back[better, end] = start
        nxt, end = np.zeros((w, n), np.int64), np.full(w, n)
        while (end > 0).any():
            live = rows[end > 0]
            start = back[live, end[live]]
            nxt[live, start] = end[live]
            end[live] = start
        return nxt

    def _named(self, points: np.ndarray, nxt: np.ndarray) -> list[list[int]]:
        row, at = np.nonzero(nxt)
        end = nxt[row, at]
        hit = self.probe(self._range_key(_code_sums(points), row, at, end))
        ids = np.where(hit >= 0, self.ids[hit], -1)
        out: list[list[int]] = [[] for _ in range(len(points))]
        for r, i, a, z in zip(row.tolist(), ids.tolist(), at.tolist(), end.tolist(), strict=True):
            if i >= 0:
                out[r].append(i)
            elif self.byte_ids:
                for c in points[r, a:z].tolist():
                    out[r] += [self.byte_ids[b] for b in chr(c).encode()]
            else:
                out[r].append(self.unknown)
        return out

    def units(self, text: str) -> list[str]:
        """The words of a text, with the space that the library puts before it."""
        if not text:
            return []
        out: list[str] = []
        for k, line in enumerate(text.split("\n") if self.lines else [text]):
            if k:
                out.append("\n")
            body = (SPACE if not k else "") + line.replace(" ", SPACE)
            out += _UNIT(body)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.units(t) for t in texts]
        new = set().union(*split).difference(self.known) if split else set()
        if len(self.known) + len(new) > _KEPT:
            self.known = {}
            new = set().union(*split)
        if new:
            units = list(new)
            self.known.update(zip(units, (np.array(x, "<u4").tobytes() for x in self.encode_words(units)), strict=True))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, s)), "<u4") for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space put before it."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


@lru_cache(maxsize=2)
def load(model: bytes) -> Vocabulary:
    """The pieces of a serialised model; the library only reads the file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in range(n)) else None
    special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
    pieces = [sp.id_to_piece(i) for i in range(n)]
    normal = [sp.get_score(i) for i in range(n) if i not in special and not sp.is_byte(i)]
    kind = "bpe" if all(float(s).is_integer() for s in normal) else "unigram"  # BPE scores are negated ranks
    return Vocabulary(pieces, [sp.get_score(i) for i in range(n)], kind, byte_ids, sp.unk_id(), special)


PROBES = ("a b", " lead", "two  spaces", "trail ", "Line\nline", "\ttab", "\ufb01x\u00b2 \u2460", "e\u0301 \u00e9", "A" * 40)


def check_probes(model: bytes) -> None:
    """Refuses a model that the library encodes otherwise, by its own normaliser or settings."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for text, ids in zip(PROBES, load(model).encode(list(PROBES)), strict=True):
        if sp.encode(text) != ids.tolist():
            raise ValueError(f"the model normalises or splits texts in a way not supported, as in {text!r}")


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (little-endian unsigned 32-bit), n_ids, decoded (the text that the ids give back)."""
    with open(model_path, "rb") as file:
        raw = file.read()
    check_probes(raw)
    model = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        vocabulary = load(model.value)
        for table in exchange.pieces(batches):
            ids = vocabulary.encode([t or "" for t in table.column("text").to_pylist()])
            out = {"doc_id": table.column("doc_id"), "ids": pa.array([x.tobytes() for x in ids], pa.binary()), "n_ids": pa.array([len(x) for x in ids], pa.int64()), "decoded": pa.array([vocabulary.decode(x) for x in ids], pa.string())}
            yield pa.table(out | {"text": table.column("text")}).combine_chunks().to_batches()[0]

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary, n_ids bigint, decoded string, text string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` as piece ids, and whether the ids give the text back."""
    import public_tokenizers

    out = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), "n_ids", F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == text).alias("round_trip"))
