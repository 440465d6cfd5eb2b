"""Numpy views of document groups: concatenated UTF-8 bytes, words, fingerprints.

A *group* is a few megabytes of documents that one task holds as one byte
array. Everything here is linear in that array. Fingerprints are polynomial
sums modulo 2**64 over a random table, finalised by a bit mixer; two distinct
sequences share one with a chance of about 2**-58.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE = (_BYTE << U64(1)) | U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept until ``forget_powers``."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[key] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def forget_powers() -> None:
    """Frees the powers, 16 bytes for each byte of the largest group so far; they are soon made again."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, in place where it can."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def loosened(kind: pa.DataType) -> pa.DataType:
    """The type with all its fields nullable, as schemas given by text have them."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, loosened(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(loosened(kind.value_type))
    return kind


class Group:
    """Documents of one group in order of (id, hash of the text where the table has one as ``h``, text), nulls first.

    ``data`` holds the texts' bytes end to end, ``starts[i]:starts[i+1]`` those
    of document ``i``. Null texts count as empty.
    """

    def __init__(self, table: pa.Table, id_col: str = "doc_id", text_col: str = "text"):
        table = table.combine_chunks()
        text = table.column(text_col).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        text = text.cast(pa.large_binary()).fill_null(b"")
        keys = {"i": table.column(id_col)} | ({"h": table.column("h")} if "h" in table.column_names else {}) | {"t": text}
        order = pa.compute.sort_indices(pa.table(keys), sort_keys=[(k, "ascending") for k in keys], null_placement="at_start")
        text = text.take(order)
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        self.rows = table.take(order)
        self.ids = self.rows.column(id_col)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.starts = (offsets - offsets[0]).astype(np.int64)
        self.n = len(text)

    def extra(self) -> pa.ChunkedArray:
        """The columns that ride along, one struct a row."""
        column = self.rows.column("extra")
        return column.cast(loosened(column.type))

    def sums(self) -> np.ndarray:
        """Prefix sums of byte values times powers: any substring's fingerprint in O(1)."""
        up, _ = powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=out[1:])
        return out


class Words:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D, per document."""

    def __init__(self, group: Group, lower: bool = False):
        data = _LOWER[group.data] if lower else group.data
        self.data = data
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~_SPACE[data]
        here, before = solid[1:], solid[:-1]
        cut = np.zeros(len(data) + 1, bool)  # a document's first byte starts a word of its own
        cut[group.starts] = True
        self.start = np.flatnonzero(here & (~before | cut))
        self.stop = np.flatnonzero(before & (~here | cut))
        self.doc = np.searchsorted(group.starts, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, group.starts[:-1])  # of each document

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A fingerprint of each word."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=sums[1:])
        return mix((sums[self.stop] - sums[self.start]) * down[self.start] + (self.stop - self.start).astype(np.uint64))

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, fingerprints) of the windows of ``width`` words inside one document."""
        n = len(hashes)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=sums[1:])
        return at, mix((sums[at + width] - sums[at]) * down[at])


def covered(n: int, starts: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` positions lie in [start, start + width) of some window."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + widths, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of True."""
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one binary; see :func:`unpack`."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.num, a.nbytes))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


_KINDS = {np.dtype(t).num: np.dtype(t) for t in ("u1", "u2", "u4", "u8", "i4", "i8", "f4", "f8")}


def unpack(raw: bytes) -> list[np.ndarray]:
    view = memoryview(raw)
    n = int(np.frombuffer(view[:8], np.int64)[0])
    head = np.frombuffer(view[8 : 8 + 16 * n], np.int64)
    out, at = [], 8 + 16 * n
    for kind, size in head.reshape(-1, 2):
        out.append(np.frombuffer(view[at : at + int(size)], _KINDS[int(kind)]))
        at += int(size)
    return out
