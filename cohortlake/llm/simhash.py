"""Near-duplicate groups by SimHash, linked through BK-trees.

Fingerprints are 64-bit SimHashes of word shingles. Equal fingerprints are one
node. Nodes within ``radius`` differing bits agree in ``blocks - radius`` of
``blocks`` bit blocks at least, so each combination of blocks deals all nodes
to shards by its bits, and no link is lost. A shard's nodes form a BK-tree:
children keyed by the Hamming distance to the parent, searched along the edges
within the radius. While a shard asks for one component, only a node that no
search has found yet is still to be found, so a shard of many near copies costs
about as much as it has nodes, and each node gives back one link. Trees are built where their shard is, not
broadcast, for the trees of all fingerprints grow with the corpus.

Defined results: a null or empty text has fingerprint zero, linked like any
other; fewer words than a shingle give one shingle of them all; rows that share
an id are rows of their own; null ids count last for the smallest id; other
columns are ignored, whatever their names; an empty table gives an empty result.

``near_copies`` is the same operator for a similarity of shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .bktree import Forest
from .components import connected_components, hot_join, salted_join
from .packed import Group, Words
from .shared import cut

SHINGLE, RADIUS, SEED = 4, 4, 42


def text_fingerprints(group: Group, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The SimHash of each document: a bit is set if it is in over half the XXH64 of its shingles."""
    words = Words(group, lower=True)
    out = np.zeros(group.n, np.uint64)
    if not len(words):
        return out
    data, keep = words.data.copy(), np.zeros(len(words.data) + 1, np.int64)
    np.add.at(keep, words.start, 1)
    np.add.at(keep, words.stop, -1)
    keep = np.cumsum(keep[:-1]) > 0
    joint = words.stop[:-1][words.doc[1:] == words.doc[:-1]]
    data[joint], keep[joint] = 0x20, True
    at = np.concatenate(([0], np.cumsum(keep)))
    raw, start, stop = data[keep].tobytes(), at[words.start], at[words.stop]
    count = np.diff(words.first, append=len(words))
    number = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    full = np.flatnonzero(number)
    first = np.concatenate(([0], np.cumsum(number[full])))
    begin = np.repeat(words.first[full] - first[:-1], number[full]) + np.arange(first[-1])
    end = begin + np.repeat(np.minimum(count[full], shingle), number[full]) - 1
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(raw[a:z], seed) for a, z in zip(start[begin].tolist(), stop[end].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(joined, np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, first[:-1], axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > number[full][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) per row, fp the SimHash as a signed 64-bit integer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for table in exchange.pieces(batches):
            group = Group(table)
            yield pa.record_batch([group.ids.combine_chunks() if isinstance(group.ids, pa.ChunkedArray) else group.ids, pa.array(text_fingerprints(group, shingle, seed).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def masks(nodes: int, radius: int) -> list[int]:
    """Masks of the block combinations, of as many blocks as keep a shard of random nodes small."""
    for blocks in range(radius + 1, 17):
        agree = blocks - radius
        bits = 64 * agree // blocks
        if nodes >> bits < 2048 or blocks == 16:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (z - a)) - 1) << a for a, z in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(block, agree)]


def shard_links(shard: np.ndarray, value: np.ndarray, radius: int, at_once: int = 128, few: int = 16) -> np.ndarray:
    """For each item the least index of its links' component within its shard.

    An item found by one component must stay to be found by the others: it
    leaves the live set unasked only while its shard asks for that component
    alone. New items are asked when none of these is left, and what they find
    stays live: a component of more than ``few`` such items gets its turn next,
    the items of lesser ones are asked as new.
    """
    forest, n = Forest(shard, value), len(value)
    label = np.arange(n)
    asked, known, met = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    busy = np.zeros(n, bool)  # by root: the shard has known items to ask
    waiting = np.arange(n)
    while len(waiting):
        busy[forest.root[waiting]] = False
        busy[forest.root[waiting[known[waiting]]]] = True
        open_ = waiting[met[waiting] & ~known[waiting]]
        open_ = open_[~busy[forest.root[open_]]]
        if len(open_):
            # the largest component among the found items of each shard without known ones
            _, of, size = np.unique(label[open_], return_inverse=True, return_counts=True)
            order = np.lexsort((label[open_], -size[of], forest.root[open_]))
            root = forest.root[open_][order]
            begin = np.concatenate(([True], root[1:] != root[:-1]))
            lead = label[open_][order][begin][np.cumsum(begin) - 1]
            chosen = open_[order][(label[open_][order] == lead) & (size[of][order] > few)]
            known[chosen] = True
            busy[forest.root[chosen]] = True
            forest.remove(chosen)
        # known items alone, or else new ones, those met before first; some of each shard at a time
        able = waiting[known[waiting] | ~busy[forest.root[waiting]]]
        order = able[np.lexsort((~met[able], forest.root[able]))]
        root = forest.root[order]
        begin = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        query = order[rank < at_once]
        asked[query] = True
        q, x = forest.search(query, radius)
        met[x] = True
        found = np.unique(x[known[q]])
        known[found] = True
        forest.remove(np.concatenate((found, query[forest.live[query]])))
        while len(q):
            low = np.minimum(label[q], label[x])
            np.minimum.at(label, label[q], low)
            np.minimum.at(label, label[x], low)
            while (label[label] != label).any():
                label = label[label]
            apart = label[q] != label[x]
            q, x = q[apart], x[apart]
        waiting = waiting[~asked[waiting]]
    return label


def link(nodes: DataFrame, radius: int = RADIUS, count: int | None = None) -> DataFrame:
    """(node, label) of the fingerprints that have links; nodes: distinct ``fp``."""
    count = nodes.count() if count is None else count
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chosen = masks(count, radius)
    buckets = max(parts, count * len(chosen) >> 18)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    shards = F.array(*[F.struct(F.lit(i).alias("of"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(chosen)])
    dealt = nodes.select("fp", F.explode(shards).alias("shard")).select("fp", F.xxhash64("shard.of", "shard.bits").alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        shard, value = table.column("shard").to_numpy(), table.column("fp").to_numpy()
        order = np.lexsort((value, shard))
        shard, value = shard[order], value[order]
        label = shard_links(shard, value.view(np.uint64), radius)
        tied = label != np.arange(len(label))
        return pa.table({"a": value[tied], "b": value[label[tied]]})

    edges = dealt.withColumn("bucket", F.pmod("shard", F.lit(buckets))).groupBy("bucket").applyInArrow(run, "a bigint, b bigint")
    return connected_components(edges)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, fp (signed SimHash), component_id (smallest id reachable by links of ``radius`` bits or less)."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle, seed).withColumn("row", F.monotonically_increasing_id()))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = link(nodes.select("fp"), radius)
    named = labels.withColumnRenamed("node", "fp").join(nodes, "fp")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    tied = salted_join(named.select("fp", "label"), least, "label", "fp").select("fp", "component_id")
    whole = cut(nodes.join(tied, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    # very many texts may have one fingerprint, as all empty ones do
    return hot_join(prints, whole, "fp", "row", 32).select("doc_id", "fp", "component_id")


def op4_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    out = near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
