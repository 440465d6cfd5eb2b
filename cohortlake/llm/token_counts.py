"""Token counts of texts of any length by overlap resynchronisation.

A text of more than ``chunk`` characters is encoded in overlapping chunks with
offsets. Neighbouring chunks are spliced at a place in the overlap where both
start a token, a white-space character stands and no white space precedes it.
Such a place is stable: the splitter of byte-level BPE has no alternative that
matches white space after anything else, and none that looks behind, so it
always splits there, and what follows is encoded as if the text began there.
Where an overlap has no such place it is doubled, at last to the whole chunk,
and then the chunk grows.

Shorter texts are encoded whole, their units between single spaces or newlines
looked up once seen.

Defined results: a null text is an empty one and has no tokens; special strings
in a text count as the library's default has them; every row is counted.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange

CHUNK, OVERLAP = 1 << 16, 1 << 10


@lru_cache(maxsize=4)
def load(model: bytes):
    """A tokenizer of the tokenizers library from its JSON, without truncation or padding, once a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_buffer(model)
    out.no_truncation()
    out.no_padding()
    return out


class UnitCounts:
    """Token counts of texts through a table of the units between spaces and newlines.

    Such a split is stable by the same rule wherever white space is a single
    space or newline; other texts go to the library whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.known = tokenizer, {}
        self.newline = len(tokenizer.encode("\n", add_special_tokens=False))

    def __call__(self, texts: list[str]) -> list[int]:
        plain, split = [], []
        for i, text in enumerate(texts):
            text = "\n" + text
            if "\n\n" not in text and "  " not in text and "\n " not in text and " \n" not in text and not _ODD(text):
                plain.append(i)
                split.append(text.replace("\n", " \n").split(" ")[1:])
        new = set().union(*split).difference(self.known) if split else set()
        if len(self.known) + len(new) > _KEPT:
            self.known = {}
            new = set().union(*split)
        if new:
            units = list(new)
            encoded = self.tokenizer.encode_batch_fast([u if u[:1] == "\n" else " " + u for u in units], add_special_tokens=False)
            self.known.update(zip(units, map(len, encoded), strict=True))
        out = [0] * len(texts)
        known = self.known.__getitem__
        for i, units in zip(plain, split, strict=True):
            out[i] = sum(map(known, units)) - self.newline
        rest = sorted({*range(len(texts))}.difference(plain))
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = len(e)
        return out


@lru_cache(maxsize=1)
def _units(model: bytes) -> UnitCounts:
    """One table a process, kept from task to task."""
    return UnitCounts(load(model))


exchange.TABLES += [load.cache_clear, _units.cache_clear]


_ODD = re.compile(r"[^\S \n]").search
_KEPT = 1 << 19


def _starts(tokenizer, text: str, at: int, until: int) -> np.ndarray:
    encoded = tokenizer.encode(text[at:until], add_special_tokens=False)
    return np.array([a for a, _ in encoded.offsets], np.int64) + at


def _stable(text: str, at: np.ndarray) -> np.ndarray:
    return np.array([x for x in at.tolist() if x and text[x] in " \n\t\r" and not text[x - 1].isspace()], np.int64)


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, encoded a chunk at a time."""
    total, cut, stop = 0, 0, min(len(text), chunk)
    left = _starts(tokenizer, text, 0, stop)
    while stop < len(text):
        wide = overlap
        while True:
            begin = max(cut, stop - wide)
            end = min(len(text), begin + max(chunk, 2 * wide))
            right = _starts(tokenizer, text, begin, end)
            both = _stable(text, np.intersect1d(left[left > begin], right))
            if len(both):
                place = int(both[-1])
                total += int(((left >= cut) & (left < place)).sum())
                cut, stop, left = place, end, right
                break
            if begin == cut:  # nothing stable since the last splice: a longer chunk from there
                chunk *= 2
                stop = min(len(text), cut + chunk)
                left = _starts(tokenizer, text, cut, stop)
                break
            wide *= 2
    return total + int((left >= cut).sum())


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens. The model, a few MB whatever the corpus, goes with the tasks."""
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must be within the chunk")
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        tokenizer, units = load(model.value), _units(model.value)
        for table in exchange.pieces(batches):
            texts = [t or "" for t in table.column("text").to_pylist()]
            short = [t for t in texts if len(t) <= chunk]
            counts = iter(units(short))
            n = [next(counts) if len(t) <= chunk else count_long(tokenizer, t, chunk, overlap) for t in texts]
            size = pa.compute.fill_null(pa.compute.binary_length(table.column("text")), 0).cast(pa.int64())
            yield pa.table({"doc_id": table.column("doc_id"), "n_bytes": size, "n_tokens": pa.array(n, pa.int64())}).combine_chunks().to_batches()[0]

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of all ``documents``."""
    import public_tokenizers

    out = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
