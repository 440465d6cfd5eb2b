"""Packing of token ids into sequences of one length: concatenate and cut.

The first pass encodes each text once, keeps its ids with the number of tokens
before it in its partition, and sums the tokens of each partition. Prefix sums
over the partitions, one number each, give every document its place in one long
concatenation. The second pass cuts that at multiples of the sequence length;
each record is the part of a document in one sequence. Only the last sequence
is not full.

Words repeat, so their ids are looked up. A text may be split at spaces and
newlines if the tokenizer drops white space and no rule of it crosses white
space, which holds for word_bpe_49k.json; the rest is left to the library.

Defined results: a null text is an empty one, the end id alone; ties in ids and
repeated rows are packed like all others; no rows give no sequences.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange
from .shared import cut
from .token_counts import load

LENGTH = 2048
_KEPT = 1 << 18
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_AT_ONCE = 512


class WordIds:
    """Ids of texts through a table of the units between spaces.

    A full table becomes the old one; a unit met again moves to the new one, so
    frequent units stay and rare ones go, in at most twice ``_KEPT`` and a batch.

    A full stop or other marks after letters are a word of their own by the
    splitter's rules, so only the letters and the marks are encoded. Units of
    letters alone are one word each, whose last id is that of a token with the
    end-of-word suffix; they are encoded many at once, joined by spaces, and
    told apart by these ids, if the model has that suffix and there are as many.

    Lower case is part of the model's rules for every character alone, as
    Python has it but for a final sigma; special strings are matched before it.
    """

    def __init__(self, tokenizer, code: str, lower: bool):
        self.tokenizer, self.code, self.lower, self.known, self.old = tokenizer, code, lower, {}, {}
        from tokenizers.pre_tokenizers import ByteLevel  # after load() has set its environment

        suffix, vocab = getattr(tokenizer.model, "end_of_word_suffix", None), tokenizer.get_vocab()
        # a word has such an id at all only if no last byte is without one
        self.last = None
        if suffix and all(c + suffix in vocab for c in ByteLevel.alphabet()):
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def encoded(self, units: list[str]) -> dict[str, bytes]:
        """The ids of each unit."""
        words = [u for u in units if u.isalpha()] if self.last is not None else []
        single, out = list(set(units).difference(words)), {}
        lots = [words[i : i + _AT_ONCE] for i in range(0, len(words), _AT_ONCE)]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([" ".join(lot) for lot in lots], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.code)
            stop = (ids.itemsize * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(stop) == len(lot):
                raw = ids.tobytes()
                out.update(zip(lot, [raw[a:z] for a, z in zip([0, *stop[:-1]], stop, strict=True)], strict=True))
            else:
                single += lot
        encoded = self.tokenizer.encode_batch_fast(single, add_special_tokens=False)
        out.update(zip(single, (array(self.code, e.ids).tobytes() for e in encoded), strict=True))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [(t.lower() if self.lower and "<" not in t and "Σ" not in t else t).replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > _KEPT:
            self.known, self.old = {}, self.known
        new = set().union(*split).difference(self.known)
        again = [u for u in new if u in self.old]  # an intersection with a table goes through all of it
        self.known.update([(u, self.old[u]) for u in again])
        new.difference_update(again)
        bases = {u: base for u in new if (base := u.rstrip(_MARKS)) != u and base.isalpha()}
        parts = new.difference(bases).union(bases.values(), {u[len(base) :] for u, base in bases.items()})
        units = parts.difference(self.known)
        again = [u for u in units if u in self.old]
        self.known.update([(u, self.old[u]) for u in again])
        units = list(units.difference(again))
        if units:
            self.known.update(self.encoded(units))
        self.known.update([(u, self.known[base] + self.known[u[len(base) :]]) for u, base in bases.items()])
        known = self.known.__getitem__
        return [b"".join(map(known, s)) for s in split]


@lru_cache(maxsize=1)
def _word_ids(model: bytes, code: str) -> WordIds:
    """One table a process, kept from task to task."""
    tokenizer = load(model)
    # its rules alone, not the whole model as Python objects
    rules = json.loads(tokenizer.normalizer.__getstate__()) if tokenizer.normalizer else {}
    out = WordIds(tokenizer, code, any(n.get("type") == "Lowercase" for n in rules.get("normalizers") or []))
    exchange.give_back()
    return out


exchange.TABLES.append(_word_ids.cache_clear)


def cut_at(batches: Iterable[pa.RecordBatch], length: int) -> Iterable[pa.RecordBatch]:
    """The parts of each document (doc_id, doc_tokens, ids, at) between multiples of ``length``, about a megabyte of ids at a time."""
    for table in exchange.pieces(batches, "ids"):
        batch = table.combine_chunks().to_batches()[0]
        n, at = batch.column("doc_tokens").to_numpy(), batch.column("at").to_numpy()
        raw = batch.column("ids").to_pylist()
        first, last = at // length, (at + n - 1) // length
        many = last - first + 1
        row = np.repeat(np.arange(len(n)), many)
        sequence = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        begin = np.maximum(sequence * length, at[row])
        size = np.minimum((sequence + 1) * length, (at + n)[row]) - begin
        start = begin - at[row]
        width = len(raw[0]) // int(n[0])
        wide = [np.frombuffer(raw[r], f"<u{width}")[s : s + k].astype("<u4").tobytes() for r, s, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
        yield pa.record_batch([batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(size), pa.array(wide, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack_sequences(docs: DataFrame, model_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        tokenizer = load(model.value)
        code = "H" if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "I"
        ids, end, width = _word_ids(model.value, code), array(code, [end_id]).tobytes(), array(code).itemsize
        for table in exchange.pieces(batches):
            rows = [x + end for x in ids([t or "" for t in table.column("text").to_pylist()])]
            n = np.array([len(x) // width for x in rows], np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.table({"part": pa.array(np.full(len(n), part, np.int32)), "before": at, "doc_id": table.column("doc_id"), "doc_tokens": n, "ids": pa.array(rows, pa.binary())}).combine_chunks().to_batches()[0]

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    encoded = cut(chosen.mapInArrow(encode, f"part int, before bigint, doc_id {id_type}, doc_tokens bigint, ids binary"))
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    placed = encoded.join(F.broadcast(bases), "part").select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("before")).alias("at"))
    return placed.mapInArrow(lambda batches: cut_at(batches, length), f"doc_id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 ids."""
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_digest(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    import public_tokenizers

    out = pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
