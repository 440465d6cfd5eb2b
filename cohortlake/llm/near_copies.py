"""Near copies by SimHash and BK-trees at a similarity of shingle sets.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. Texts of equal sets are one node. A node has a SimHash
of ``WORDS`` 64-bit words; the first two are the fingerprint that BK-trees hold.
A bit of two sets of similarity s differs with a chance of arccos(2s / (1 + s)) / pi,
0.15 at 0.8, so such a pair differs in about 19 of 128 bits and hardly ever in over
``RADIUS``. Up to ``WHOLE`` nodes are one shard. More are dealt to shards by bits
of their SimHashes: each of some tables draws a few of the 512 bits, and nodes
that agree in all of them share a shard. With the count of nodes, bits grow so that
a shard keeps about ``SHARD`` of them, and tables so that a pair at 0.8 is expected
to share a shard with a chance of ``RECALL``. A shard's BK-tree is searched within
the radius where it is, as in op4, and what is found links candidate components.

A component's nodes form a BK-tree again, and what a search finds within the radius
is compared set by set before it is linked. A node that a component has found is not
searched for again, so a component of texts all near to each other costs about its
size; one of many texts alike but under the bound costs its pairs within the radius.
A component's sets lie in one task.

Defined results: fewer words than a shingle give one shingle of them all; null
texts and texts without words have the empty set and are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import acos, lgamma, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .bktree import Forest
from .components import connected_components, hot_join
from .packed import U64, Group, Words, mix
from .shared import cut, small
from .simhash import shard_links

SHINGLE, SIMILARITY = 5, 0.8
WORDS, FINGERPRINT, RADIUS = 8, 2, 38  # words of a SimHash, of them in BK-trees, and bits that differ there
WHOLE, SHARD, RECALL = 2048, 64, 0.999
_EACH = np.random.default_rng(20240301).integers(0, 1 << 63, WORDS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(group: Group, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, fingerprints): the distinct shingles of document i, ascending, at starts[i]:starts[i + 1]."""
    words = Words(group, lower=True)
    hashes = words.hashes()
    at, prints = words.windows(hashes, width)
    doc = words.doc[at]
    count = np.diff(words.first, append=len(words))
    for short in np.flatnonzero((count > 0) & (count < width)):
        first = words.first[short]
        prints = np.append(prints, mix(np.bitwise_xor.reduce(mix(hashes[first : first + count[short]] + np.arange(count[short]).astype(np.uint64))) + U64(count[short])))
        doc = np.append(doc, short)
    order = np.lexsort((prints, doc))
    prints, doc = prints[order], doc[order]
    new = np.ones(len(prints), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (doc[1:] != doc[:-1])
    prints, doc = prints[new], doc[new]
    return np.searchsorted(doc, np.arange(group.n + 1)), prints


def set_fingerprints(starts: np.ndarray, prints: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The SimHash of each set, a row of words: a bit is set if it is in over half the shingles' values; of a half, that of the least shingle's print decides."""
    size = np.diff(starts)
    full = np.flatnonzero(size)
    out = np.zeros((len(size), words), np.uint64)
    if not len(full):
        return out
    # bits are counted in bytes, eight to a word, so at most 255 shingles at once
    count = -(-size[full] // 255)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    part = np.repeat(starts[:-1][full], count) + 255 * (np.arange(int(count.sum())) - np.repeat(first, count))
    least, lanes = mix(prints[starts[:-1][full]]), U64(0x0101010101010101)
    for w in range(words):
        value, tie = mix(prints ^ _EACH[w]), mix(least ^ _EACH[w])
        for bit in range(8):
            ones = np.add.reduceat((value >> U64(bit)) & lanes, part).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
            half = ((tie >> U64(bit)) & lanes).view(np.uint8).reshape(-1, 8)
            over = 2 * ones + half > size[full][:, None]
            out[full, w] |= over.astype(np.uint8).view(np.uint64).ravel() << U64(bit)
    return out


def tables_for(count: int, similarity: float = SIMILARITY, recall: float = RECALL) -> np.ndarray:
    """Which bits of the SimHash each table draws, a row a table, for so many nodes."""
    bits = max(1, count // SHARD).bit_length() - 1 if count > WHOLE else 0
    if not bits:
        return np.zeros((1, 0), np.int64)
    n, chance = 64 * WORDS, acos(2 * similarity / (1 + similarity)) / pi
    ways = lambda a, k: lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1)
    far = np.arange(n - bits + 1)
    weight = np.exp([ways(n, d) for d in far] + far * np.log(chance) + (n - far) * np.log1p(-chance))
    agree = np.exp([ways(n - d, bits) - ways(n, bits) for d in far])
    tables = 1
    while 1 - (weight * (1 - agree) ** tables).sum() < recall:
        tables += 1
    rng = np.random.default_rng(20240302)
    return np.stack([rng.permutation(n)[:bits] for _ in range(tables)])


def shards(simhash: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The shard of each SimHash in each table, a row a SimHash."""
    drawn = np.zeros((64 * simhash.shape[1], len(tables)))
    for j, at in enumerate(tables.T):
        drawn[at, np.arange(len(tables))] = 1 << j
    bits = np.unpackbits(np.ascontiguousarray(simhash).view(np.uint8), axis=1)
    return (bits.astype(np.float64) @ drawn).astype(np.int64) + (np.arange(len(tables)) << tables.shape[1])


def _prints(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    exchange.drop_tables()
    for table in exchange.pieces(batches):
        group = Group(table, "key")
        starts, prints = shingle_sets(group)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(prints))))
        size = np.diff(starts)
        whole = mix(sums[starts[1:]] - sums[starts[:-1]] + size.astype(np.uint64))
        simhash = [row.tobytes() for row in set_fingerprints(starts, prints)]
        yield pa.record_batch([pa.array(group.ids.to_numpy()), pa.array(whole.view(np.int64)), pa.array(np.diff(group.starts)), pa.array(size), pa.array(simhash, pa.binary())], names=["key", "whole", "size", "shingles", "simhash"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    exchange.drop_tables()
    for table in exchange.pieces(batches):
        group = Group(table, "key")
        starts, prints = shingle_sets(group)
        rows = [prints[a:z].tobytes() for a, z in zip(starts[:-1], starts[1:], strict=True)]
        names = ["label", "node", "low", "high", "shingles"]
        low, high = set_fingerprints(starts, prints, FINGERPRINT).view(np.int64).T
        yield pa.record_batch([pa.array(group.rows.column("label").to_numpy()), pa.array(group.ids.to_numpy()), pa.array(low), pa.array(high), pa.array(rows, pa.binary())], names=names)


def first_of(shard: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
    """Whether each row, sorted by shard and fingerprint, is the first of its own."""
    other = (fingerprint[1:] != fingerprint[:-1]).reshape(max(0, len(shard) - 1), -1)
    return np.concatenate((np.ones(min(1, len(shard)), bool), (shard[1:] != shard[:-1]) | other.any(axis=1)))


def _candidates(table: pa.Table) -> pa.Table:
    """(a, b): nodes and the least of their candidate component in their shard."""
    shard, node = table.column("shard").to_numpy(), table.column("node").to_numpy()
    value = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("low", "high")], axis=1)
    order = np.lexsort((node, value[:, 1], value[:, 0], shard))
    shard, node, value = shard[order], node[order], value[order]
    # equal fingerprints of a shard are one item of its tree
    new = first_of(shard, value)
    label = shard_links(shard[new], value[new], RADIUS)[np.cumsum(new) - 1]
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    lead = least[label]
    exchange.give_back()
    return pa.table({"a": node[lead != node], "b": lead[lead != node]})


def confirmed(shard: np.ndarray, fingerprint: np.ndarray, sets: list[np.ndarray], least: float = SIMILARITY, radius: int = RADIUS, at_once: int = 128) -> np.ndarray:
    """For each set the least index of its component, sets of one shard linked by a similarity of ``least`` or more.

    Sorted by shard, then fingerprint. A shard grows one component at a time:
    while it has found sets to ask, only these are asked, then one new set.
    """
    n = len(sets)
    size, label = np.array([len(s) for s in sets]), np.arange(n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(size)))
    flags = np.zeros(int(code.max(initial=-1)) + 1, bool)
    # equal fingerprints of a shard are one item of its tree
    new = first_of(shard, fingerprint)
    begin = np.flatnonzero(new)
    item, members = np.cumsum(new) - 1, np.diff(np.append(begin, n))
    forest = Forest(shard[begin], fingerprint[begin])
    live, left, open_, asked = np.ones(n, bool), members.copy(), np.zeros(n, bool), np.zeros(n, bool)

    def take(of: np.ndarray) -> None:
        """These sets are found: no search gives them again."""
        live[of] = False
        np.subtract.at(left, item[of], 1)
        forest.remove(np.unique(item[of][left[item[of]] == 0]))

    waiting = np.arange(n)
    while len(waiting):
        root = forest.root[item[waiting]]
        busy = np.zeros(len(begin), bool)
        busy[root[open_[waiting]]] = True
        able = waiting[open_[waiting] | ~busy[root]]
        root = forest.root[item[able]]
        start = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
        place = np.arange(len(able)) - np.repeat(start, np.diff(np.append(start, len(able))))
        query = able[place < np.where(open_[able], at_once, 1)]
        asked[query] = True
        take(query[live[query]])
        tree_query, of_query = np.unique(item[query], return_inverse=True)
        q, x = forest.search(tree_query, radius, itself=True)
        # from items of the tree to sets
        order = np.argsort(q, kind="stable")
        q, x = q[order], x[order]
        lo, hi = np.searchsorted(q, tree_query), np.searchsorted(q, tree_query, side="right")
        for one, at in zip(query.tolist(), of_query.tolist(), strict=True):
            found = x[lo[at] : hi[at]]
            if not len(found):
                continue
            many = members[found]
            near = np.repeat(begin[found] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
            # as large as the similarity needs
            near = near[live[near] & (size[near] >= least * size[one] - 1e-9) & (size[one] >= least * size[near] - 1e-9)]
            for near in np.array_split(near, -(-len(near) // 4096)) if len(near) else ():
                flags[code[first[one] : first[one + 1]]] = True
                width = size[near]
                ends = np.cumsum(width)
                flat = code[np.repeat(first[near] - (ends - width), width) + np.arange(int(ends[-1]))]
                common = np.add.reduceat(flags[flat], ends - width, dtype=np.int64)
                flags[code[first[one] : first[one + 1]]] = False
                hit = near[common >= least * (size[one] + width - common) - 1e-9]
                label[hit] = label[one]
                open_[hit] = True
                if len(hit):
                    take(hit)
        waiting = waiting[~asked[waiting]]
    # of each component the least index
    _, of = np.unique(label, return_inverse=True)
    lowest = np.full(of.max(initial=-1) + 1, n)
    np.minimum.at(lowest, of, np.arange(n))
    return lowest[of]


def near_copies(docs: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """(key, component) of the rows that have near copies; component is the key of one of them. Keys: distinct bigints."""
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    prints = cut(texts.mapInArrow(_prints, "key bigint, whole bigint, size bigint, shingles bigint, simhash binary"))
    nodes = cut(prints.groupBy("whole").agg(F.min("key").alias("node"), F.count("*").alias("rows")))
    alone = prints.join(small(nodes.select(F.col("node").alias("key")), 8), "key").filter("shingles > 0").select("key", "simhash")
    count = nodes.count()
    tables = tables_for(count)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                simhash = np.frombuffer(b"".join(rows.column("simhash").to_pylist()), np.uint64).reshape(-1, WORDS)
                node, low, high = (np.repeat(x, len(tables)) for x in (rows.column("key").to_numpy(), *simhash.view(np.int64)[:, :FINGERPRINT].T))
                yield pa.record_batch([pa.array(shards(simhash, tables).ravel()), pa.array(low), pa.array(high), pa.array(node)], names=["shard", "low", "high", "node"])

    tasks = max(1, count * len(tables) >> 15)
    dealt = alone.mapInArrow(deal, "shard bigint, low bigint, high bigint, node bigint").withColumn("task", F.pmod(F.xxhash64("shard"), F.lit(tasks)))
    found = dealt.groupBy("task").applyInArrow(_candidates, "a bigint, b bigint")
    # a node meets one other in each table at most; these are linked to the least of them, not to the node, which leaves few edges
    met = found.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("others"))
    edges = cut(met.select("least", F.explode(F.array_append("others", F.col("a"))).alias("node")).filter("node <> least").distinct())
    maybe = small(connected_components(edges, "least", "node").select(F.col("node").alias("key"), "label"), 16)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = prints.select("key", "size").join(maybe, "key").agg(F.sum("size")).first()[0] or 0
    buckets = max(1, min(parts, -(-size // (1 << 16))), -(-size // (8 << 20)))

    def run(table: pa.Table) -> pa.Table:
        label, low, high, node = (table.column(c).to_numpy() for c in ("label", "low", "high", "node"))
        order = np.lexsort((node, high, low, label))
        raw, node = table.column("shingles"), node[order]
        sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in order]
        component = node[confirmed(label[order], np.stack((low[order], high[order]), axis=1).view(np.uint64), sets)]
        del sets, raw
        exchange.give_back()
        return pa.table({"node": node, "component": component})

    sets = texts.join(maybe, "key").select("key", "text", "label").mapInArrow(_sets, "label bigint, node bigint, low bigint, high bigint, shingles binary")
    linked = cut(sets.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, "node bigint, component bigint"))
    named = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    many = named.groupBy("component").agg(F.sum("rows").alias("n")).filter("n > 1").select("component")
    tied = cut(named.join(many, "component").select("whole", "component"))
    return hot_join(prints.select("key", "whole"), tied, "whole", "key", 24).select("key", "component")
