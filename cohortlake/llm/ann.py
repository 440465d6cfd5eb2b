"""Approximate nearest neighbours by inner product, in a forest of random-projection trees.

The trees are fitted on a bounded sample of ``sample`` vectors: at each node a
random direction, split at the sample's median. Every vector is indexed: it goes
to one leaf of each tree. A query walks all trees at once through one priority
queue, ordered by how far it lies beyond the splits on the way, and takes the
first ``probes`` leaves. Candidates of those leaves are reranked by exact inner
products in double precision.

How many leaves a recall takes depends on the data: vectors in clusters need a
handful, vectors without any structure, which no tree can part, about half of
one tree's. So ``probes`` is measured: ``trials`` of the queries are compared
with every vector, and the least number of leaves that would have found the
share ``recall`` of their true neighbours is taken. ``probes`` may be given.

Leaves are hashed into buckets, as many as keep a bucket's vectors to
``bucket_bytes``; a leaf of more than ``cell_rows`` vectors on average is cut in
cells by a hash of the vector, all of which its queries read. A query goes to a
bucket once, with the list of its cells there, and comes back with its best of
the whole bucket, so rows are queries times buckets times ``k`` at most.

Lengths may differ, so trees split the direction of a vector and its length,
the usual lift of inner products to angles, with the largest length of all.

Equal vectors are one candidate with the smallest ids that any result can hold,
and equal queries are asked once, so a vector that a third of the rows share
takes one place. The forest has at most trees * 2**depth nodes, with 2**depth at
most an eighth of the sample, whatever the data, and goes with the tasks.

Defined results: vectors that are null, zero, of another dimension than most
rows, or hold null or non-finite components take no part; null ids take no part;
of repeated rows with one id and one vector one is a candidate, an id with
several vectors counts by its nearest and is asked once for each, its best
places given; ties go to the smaller id; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import U64, mix
from .shared import cut


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: node i has children 2i+1 and 2i+2, leaves have no split."""

    directions: np.ndarray  # tree, node, dimension
    splits: np.ndarray  # tree, node
    longest: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors over the largest length, and what is missing to length 1."""
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    @property
    def inner(self) -> int:
        return self.splits.shape[1]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, from 0."""
        y, out = self.lift(x).astype(np.float32), np.zeros((len(x), len(self.splits)), np.int64)
        for t in range(len(self.splits)):
            node = np.zeros(len(x), np.int64)
            while self.inner and len(node) and node[0] < self.inner:
                side = np.einsum("ij,ij->i", y, self.directions[t][node]) > self.splits[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - self.inner
        return out

    def margins(self, q: np.ndarray) -> np.ndarray:
        """By tree and node, on which side of the split the query lies and how far."""
        y = np.append(q / np.linalg.norm(q), 0.0).astype(np.float32)
        return self.directions @ y - self.splits

    def probe(self, q: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves nearest to the query over all trees."""
        margin = self.margins(q).tolist()
        queue, out = [(0.0, t, 0) for t in range(len(self.splits))], []  # the sum of squares beyond splits
        while queue and len(out) < probes:
            far, t, node = heapq.heappop(queue)
            if node >= self.inner:
                out.append((t, node - self.inner))
                continue
            m = margin[t][node]
            heapq.heappush(queue, (far, t, 2 * node + 1 + (m > 0)))
            heapq.heappush(queue, (far + m * m, t, 2 * node + 1 + (m <= 0)))
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """By tree and leaf, what the priority queue orders leaves by."""
        square, out = self.margins(q), np.zeros((len(self.splits), 1))
        level = 1
        while level <= self.inner:
            m = square[:, level - 1 : 2 * level - 1]
            out = np.stack([out + np.where(m > 0, m * m, 0), out + np.where(m > 0, 0, m * m)], axis=2).reshape(len(out), -1)
            level *= 2
        return out


def fit_forest(sample: np.ndarray, longest: float, trees: int, depth: int, seed: int = 7) -> Forest:
    """Random directions with splits at the medians of the sample's vectors in the node."""
    rng, inner = np.random.default_rng(seed), (1 << depth) - 1
    dim = sample.shape[1] + 1
    forest = Forest(np.zeros((trees, inner, dim), np.float32), np.zeros((trees, inner), np.float32), longest)
    y = forest.lift(sample).astype(np.float32)
    for t in range(trees):
        members = {0: np.arange(len(y))}
        for node in range(inner):
            own = members.pop(node)
            direction = rng.standard_normal(dim)
            if len(own) > 1:  # the line between two random members, which follows the data
                a, b = rng.choice(own, 2, replace=False)
                if (y[a] != y[b]).any():
                    direction = y[a] - y[b]
            forest.directions[t, node] = direction / np.linalg.norm(direction)
            along = np.einsum("ij,j->i", y[own], forest.directions[t, node])
            forest.splits[t, node] = np.median(along) if len(own) else 0.0
            right = along > forest.splits[t, node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return forest


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _best(asker: np.ndarray, score: np.ndarray, name: np.ndarray, most: int) -> np.ndarray:
    """Of each asker the first ``most`` by score, ties to the smaller name."""
    order = np.lexsort((name, -score, asker))
    begin = np.flatnonzero(np.concatenate(([True], asker[order[1:]] != asker[order[:-1]]))) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[place < most]


def _at_least(score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` largest of each row, and of what ties with the last."""
    width = score.shape[1]
    if width <= most:
        return np.nonzero(np.ones_like(score, bool))
    least = np.partition(score, width - most, axis=1)[:, width - most]
    return np.nonzero(score >= (least - 1e-9 * np.abs(least))[:, None])


def _measured_probes(forest: Forest, distinct: DataFrame, asked: DataFrame, dim: int, k: int, recall: float, trials: int) -> int:
    """The leaves that find the share ``recall`` of the true neighbours of ``trials`` queries."""
    spark = distinct.sparkSession
    taken = asked.orderBy(F.xxhash64("v"), "key").limit(trials).select("v").toPandas()["v"]
    if not len(taken):
        return 0
    q = np.array(taken.tolist(), float)
    shared = spark.sparkContext.broadcast(q)

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = shared.value @ _matrix(batch.column("v"), dim).T
                trial, row = _at_least(score, k + 1)
                keep = _best(trial, score[trial, row], row, k + 1)
                trial, row = trial[keep], row[keep]
                yield pa.record_batch([pa.array(trial.astype(np.int32)), pa.array(score[trial, row]), batch.column("v").take(pa.array(row))], names=["trial", "score", "v"])

    found = distinct.select("v").mapInArrow(nearest, f"trial int, score double, v {distinct.schema['v'].dataType.simpleString()}")
    place = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "v"))
    rows = found.withColumn("nth", place).filter(F.col("nth") <= k + 1).select("trial", "v").toPandas()
    ranks = []
    for i, own in rows.groupby("trial")["v"]:
        x = np.array(own.tolist(), float)
        x = x[(x != q[i]).any(axis=1)]
        if len(x):
            far = forest.distances(q[i])
            least = np.stack([far[t, at] for t, at in enumerate(forest.leaves(x).T)]).min(axis=0)
            ranks += np.searchsorted(np.sort(far.ravel()), least, side="right").tolist()
    return int(np.quantile(ranks, recall, method="higher")) if ranks else 0


def nearest_neighbours(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, trees: int = 16, recall: float = 0.95, probes: int | None = None, leaf: int = 384, sample: int = 32768, trials: int = 128, cell_rows: int = 4096, bucket_bytes: int = 32 << 20, seed: int = 7) -> DataFrame:
    """Per query its ``k`` nearest other rows found: query_id, rank, vec_id, score.

    ``sample`` bounds what the forest is fitted on, ``trials`` the queries that
    ``probes`` is measured by, to the share ``recall``; ``leaf`` is the size of a
    leaf aimed at, as far as the sample allows. All rows are indexed.
    """
    if k < 1 or not 0 < recall <= 1:
        raise ValueError("k must be 1 or more, recall over 0 and at most 1")
    spark = rows.sparkSession
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    named = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = named.filter(sound).withColumn("norm", F.sqrt(length)).filter("norm > 0 and norm < double('infinity')")
    stats = named.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy(F.desc("n"), "dim").first()
    if stats is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n, longest = stats["dim"], stats["n"], stats["longest"]
    named = named.filter(F.size("v") == dim)
    # equal vectors together, with as many of their smallest ids as a result can hold besides the query's own
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = cut(named.select("v", "id").withColumn("nth", order).filter(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    asked = cut(named.filter("asks").groupBy("v").agg(F.min("id").alias("key")))
    taken = distinct.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(sample).select("v").toPandas()["v"]
    fitted = np.array(taken.tolist(), float)
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    depth = min(depth, max(0, int(np.log2(len(fitted) / 8)) if len(fitted) > 8 else 0))
    forest = fit_forest(fitted, longest, trees if depth else 1, depth, seed)
    if probes is None:
        probes = max(2 * trees, _measured_probes(forest, distinct, asked, dim, k, recall, trials))
    shared = spark.sparkContext.broadcast(forest)
    salts = max(1, -(-n // (cell_rows << depth)))
    buckets = max(64, -(-n * len(forest.splits) * dim * 8 // bucket_bytes))

    def cells(tree: np.ndarray, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (tree << depth | at) * salts + salt

    def bucket_of(cell: np.ndarray) -> np.ndarray:
        return (mix(cell.astype(np.uint64) + U64(seed)) % U64(buckets)).astype(np.int64)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = shared.value.leaves(_matrix(batch.column("v"), dim))
                row = np.repeat(np.arange(len(at)), at.shape[1])
                salt = batch.column("salt").to_numpy()[row]
                cell = cells(np.tile(np.arange(at.shape[1]), len(at)), at.ravel(), salt)
                yield pa.record_batch([pa.array(bucket_of(cell)), pa.array(cell), batch.column("v").take(pa.array(row)), batch.column("ids").take(pa.array(row))], names=["bucket", "cell", "v", "ids"])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            row, bucket, lists = [], [], []
            for i, q in enumerate(_matrix(batch.column("v"), dim)):
                tree, at = np.array(shared.value.probe(q, probes), np.int64).T
                cell = cells(np.repeat(tree, salts), np.repeat(at, salts), np.tile(np.arange(salts), len(at)))
                of = bucket_of(cell)
                order = np.argsort(of, kind="stable")
                begin = np.flatnonzero(np.concatenate(([True], of[order[1:]] != of[order[:-1]])))
                row += [i] * len(begin)
                bucket += of[order[begin]].tolist()
                lists += np.split(cell[order], begin[1:])
            if row:
                yield pa.record_batch([pa.array(bucket, pa.int64()), batch.column("key").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(lists, pa.list_(pa.int64()))], names=["bucket", "key", "v", "cells"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        askers, names, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            cell = left.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            left, cell = left.take(pa.array(order)), cell[order]
            x, ids = _matrix(left.column("v"), dim), left.column("ids").combine_chunks()
            q, lists = _matrix(right.column("v"), dim), right.column("cells").combine_chunks()
            size = lists.value_lengths().to_numpy()
            asker, wanted = np.repeat(np.arange(len(q)), size), lists.flatten().to_numpy()
            by = np.argsort(wanted, kind="stable")
            asker, wanted = asker[by], wanted[by]
            pairs = []
            for c in np.unique(wanted):
                a, z = np.searchsorted(cell, (c, c + 1))
                who = asker[slice(*np.searchsorted(wanted, (c, c + 1)))]
                for some in np.array_split(who, -(-len(who) * (z - a) // (1 << 21)) if z > a else 0) if z > a else ():
                    i, j = _at_least(q[some] @ x[a:z].T, k + 1)
                    pairs.append((some[i] << 32) | (j + a))
            if pairs:
                pair = np.concatenate(pairs)
                of, at = pair >> 32, pair & 0xFFFFFFFF
                score = np.einsum("ij,ij->i", q[of], x[at])
                first = ids.flatten().to_numpy()[(ids.offsets.to_numpy() - ids.offsets[0].as_py())[at]]
                keep = np.unique(np.stack([of, first]), axis=1, return_index=True)[1]  # a vector lies in a cell of each tree
                of, at, score = of[keep], at[keep], score[keep]
                many = ids.value_lengths().to_numpy()[at]
                askers, scores, names = np.repeat(of, many), np.repeat(score, many), ids.take(pa.array(at)).flatten().to_numpy()
                best = _best(askers, scores, names, k + 1)
                askers, scores, names = right.column("key").to_numpy()[askers[best]], scores[best], names[best]
        return pa.table({"key": pa.array(askers, pa.int64()), "vec_id": pa.array(names, pa.int64()), "score": pa.array(scores, pa.float64())})

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    indexed = distinct.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts))).repartition(parts).mapInArrow(index, f"bucket bigint, cell bigint, v {kind}, ids array<bigint>")
    queries = asked.repartition(parts).mapInArrow(ask, f"bucket bigint, key bigint, v {kind}, cells array<bigint>")
    pairs = indexed.groupBy("bucket").cogroup(queries.groupBy("bucket")).applyInArrow(rerank, "key bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    best = pairs.groupBy("key", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", place).filter(F.col("nth") <= k + 1)
    lists = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    named = named.filter("asks").select("v", F.col("id").alias("query_id")).distinct().join(asked, "v").join(lists, "key")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(own).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector of ``embeddings`` among all."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
