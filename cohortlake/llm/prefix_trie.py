"""Prefix trie of conversations, by ROLLUP over positional columns of turn ids.

A conversation is cut into blocks of ``BLOCK`` turns, one column a position. A
block is keyed by the node that its prior blocks end in, so one ROLLUP over
(key, positions) with grouping_id aggregates all prefixes of all blocks together,
however long a conversation is. A node's id is the exclusive or of fingerprints
of (position, turn) along its path, 128 bits, so the key of a block is a running
value over the blocks before it and no block waits for another.

A first ROLLUP gives each node its members and the smallest of them. A node
belongs to its smallest member, and the nodes of one conversation are the end of
its path; so each conversation has the depth where its own nodes begin, their
characters, and whether its end is a leaf. A second ROLLUP sums these over
members, which gives children, leaves and saved characters of whole subtrees
without walking the tree.

Defined results: rows without a conversation take no part; null role or text is
empty; turns with the same number follow in the order of the MD5 of role and
text. Conversations without turns end at the root. An empty table has no node,
not even a root. Other columns play no part. Turns of any length are
fingerprinted whole, and a conversation of very many turns fills many blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import along, numbered
from .components import hot_join
from .shared import cut

BLOCK = 8
PIECE = 256  # ids hashed together in a digest of many
KEY = ("depth", "i1", "i2")


def turn_id(role: Column, text: Column) -> Column:
    """The MD5 of role and text, then the characters of the text, as one string."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)), F.char_length(t).cast("string"))


def length_of(turn: Column) -> Column:
    return F.substring(turn, 33, 20).cast("bigint")


def _marks(at: Column, turn: Column) -> tuple[Column, Column]:
    """Two fingerprints of a turn at its place."""
    return F.xxhash64(at, turn), F.xxhash64(turn, at, F.lit(1))


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, at from 1, turn_id; the turns of a conversation of any size are numbered by ranges."""
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), turn_id(F.col(f"`{role_col}`"), F.col(f"`{text_col}`")).alias("turn_id")).filter("conv is not null")
    return numbered(rows, ["conv"], [F.col("turn"), F.col("turn_id")]).select("conv", "at", "turn_id")


@dataclass(frozen=True)
class Trie:
    """``nodes``: depth, i1, i2 (the node's id), conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. ``ends``: conv and the node (depth, i1, i2) that it ends in."""

    nodes: DataFrame
    ends: DataFrame


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, block, p1, p2, before, t0 .. t7, depth, total: a row a block, one without turns for conversations without."""
    placed = turns.withColumn("block", F.floor((F.col("at") - 1) / BLOCK).cast("bigint"))
    one, two = _marks(F.col("at"), F.col("turn_id"))
    rows = placed.groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "turn_id"))).alias("slots"),
        F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2"), F.sum(length_of(F.col("turn_id"))).alias("chars"),
        F.max("depth").alias("depth"), F.max("total").alias("total"),
    )
    rows = cut(rows)
    # only conversations of several blocks have anything before a block
    several = along(rows.filter(F.col("depth") > BLOCK), ["conv"], [F.col("block")], sums={"upto": F.col("chars")}, xors={"p1": F.col("x1"), "p2": F.col("x2")})
    several = several.withColumns({"p1": F.col("p1").bitwiseXOR(F.col("x1")), "p2": F.col("p2").bitwiseXOR(F.col("x2")), "before": F.col("upto") - F.col("chars")}).drop("upto")
    none = {"p1": F.lit(0).cast("bigint"), "p2": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint")}
    single = rows.filter(F.col("depth") <= BLOCK).withColumns(none)
    bare = convs.filter("depth = 0").select("conv", F.lit(0).cast("bigint").alias("block"), "depth", "total").withColumns(none)
    slot = [F.get("slots", F.lit(i))["turn_id"].alias(f"t{i}") for i in range(BLOCK)]
    named = ["conv", "block", "p1", "p2", "before", "depth", "total"]
    out = several.select(*named, *slot).unionByName(single.select(*named, *slot))
    return cut(out.unionByName(bare.select(*named, *[F.lit(None).cast("string").alias(f"t{i}") for i in range(BLOCK)])))


def _rollup(blocks: DataFrame, aggregates: str) -> DataFrame:
    """A row a node with its aggregates: block, level, depth, i1, i2 and q1, q2 of the parent, above (characters before its last turn), chars (of that)."""
    places = ", ".join(f"t{i}" for i in range(BLOCK))
    rows = blocks.sparkSession.sql(f"SELECT block, p1, p2, before, {places}, CAST({BLOCK} - bit_count(grouping_id()) AS INT) AS level, {aggregates} FROM {{blocks}} GROUP BY block, p1, p2, before, ROLLUP({places})", blocks=blocks)
    level = F.col("level")
    last = F.coalesce(*[F.when(level == i + 1, F.col(f"t{i}")) for i in range(BLOCK)])
    # rolled up, or past the end of the path; the node above a later block is the end of the block before
    rows = rows.withColumn("last", last).filter((F.col("last").isNotNull()) | ((level == 0) & (F.col("block") == 0)))
    marks = [_marks(F.col("block") * BLOCK + i + 1, F.col(f"t{i}")) for i in range(BLOCK)]
    none = F.lit(0).cast("bigint")
    ids = {}
    for n, (name, up) in enumerate((("i1", "q1"), ("i2", "q2"))):
        ids[name], ids[up] = F.col(f"p{n + 1}"), F.col(f"p{n + 1}")
        for i in range(BLOCK):
            ids[name] = ids[name].bitwiseXOR(F.when(level > i, marks[i][n]).otherwise(none))
            ids[up] = ids[up].bitwiseXOR(F.when(level > i + 1, marks[i][n]).otherwise(none))
    above = F.col("before")
    for i in range(BLOCK - 1):
        above = above + F.when(level > i + 1, length_of(F.col(f"t{i}"))).otherwise(none)
    names = [c for c in rows.columns if c not in {"p1", "p2", "before", "last", *[f"t{i}" for i in range(BLOCK)]}]
    return rows.select(*names, (F.col("block") * BLOCK + level).alias("depth"), *[v.alias(k) for k, v in ids.items()], above.alias("above"), F.coalesce(length_of(F.col("last")), none).alias("chars"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of conversations given by turns (conv, at from 1 without gaps, turn_id, depth, total) and convs (conv, depth, total).

    ``depth`` counts a conversation's turns, ``total`` their characters.
    ``saved_tokens`` sums, over a node's subtree, the characters of each node's
    last turn times its members but one.
    """
    blocks = _blocks(turns, convs)
    first = cut(_rollup(blocks, "count(*) AS n, min(conv) AS conv, max(depth) AS deepest"))

    # what belongs to a conversation: the nodes of which it is the smallest member
    own = first.groupBy("conv").agg(F.sum("chars").alias("chars"), F.min(F.struct("depth", "q1", "q2")).alias("top"), F.max((F.col("deepest") == F.col("depth")).cast("bigint")).alias("leaf"))
    above = F.when(F.col("top.depth") > 0, F.struct((F.col("top.depth") - 1).alias("depth"), F.col("top.q1").alias("i1"), F.col("top.q2").alias("i2"))).alias("at")
    parents = first.filter("n > 1").select(F.struct(*KEY).alias("at"), F.col("conv").alias("parent"))
    own = cut(hot_join(own.select("conv", "chars", F.col("top.depth").alias("top"), "leaf", above), parents, "at", "conv", 128, how="left").select("conv", "chars", "top", "leaf", "parent"))
    marked = hot_join(blocks, own, "conv", "block", 96, how="left").withColumn("rest", F.col("total") - F.coalesce("chars", F.lit(0)))

    born = ", ".join(f"count_if(top = block * {BLOCK} + {i + 1}) AS b{i}" for i in range(BLOCK + 1))
    low = ", ".join(f"min_by({c}, conv) AS low_{c}" for c in ("rest", "depth", "top", "parent"))
    second = _rollup(marked, f"count(*) AS n, min(conv) AS conv, sum(rest) AS rests, coalesce(sum(leaf), 0) AS leaves, {low}, {born}")
    children = F.coalesce(*[F.when(F.col("level") == i, F.col(f"b{i}")) for i in range(BLOCK + 1)]) + (F.col("low_depth") > F.col("depth")).cast("bigint")
    nodes = second.select(
        *KEY, F.col("conv").alias("conv_id"),
        F.when(F.col("depth") > F.col("low_top"), F.col("conv")).otherwise(F.col("low_parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), children.alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("rests") - F.col("low_rest") - (F.col("n") - 1) * F.col("above")).alias("saved_tokens"),
    )

    at_end = F.greatest(F.floor((F.col("depth") - 1) / BLOCK), F.lit(0)) == F.col("block")
    end = {}
    for n, name in enumerate(("i1", "i2")):
        end[name] = F.col(f"p{n + 1}")
        for i in range(BLOCK):
            mark = _marks(F.col("block") * BLOCK + i + 1, F.col(f"t{i}"))[n]
            end[name] = end[name].bitwiseXOR(F.when(F.col(f"t{i}").isNotNull(), mark).otherwise(F.lit(0).cast("bigint")))
    return Trie(nodes, blocks.filter(at_end).select("conv", F.col("depth").cast("bigint").alias("depth"), *[v.alias(k) for k, v in end.items()]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node from its pieces in order; holds a batch and a state."""
    node, state = None, None

    def out():
        return pa.RecordBatch.from_pylist([dict(zip(KEY, node, strict=True)) | {"ends_sha256": state.hexdigest()}], pa.schema([("depth", pa.int64()), ("i1", pa.int64()), ("i2", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
            if key != node:
                if node is not None:
                    yield out()
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if node is not None:
        yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, i1, i2, ends_sha256: of the ids that end in a node, ascending, joined by commas.

    Ids of a node are numbered by ranges and joined in pieces of ``PIECE``; a node
    of one piece is hashed where it is, the pieces of others are hashed in order.
    """
    pieces = numbered(ends, KEY, [F.col("conv")]).withColumn("piece", F.floor((F.col("at") - 1) / PIECE).cast("bigint"))
    pieces = cut(pieces.groupBy(*KEY, "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n")))
    alone = (F.col("piece") == 0) & (F.col("n") < PIECE)
    one = pieces.filter(alone).select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    many = pieces.filter(~alone).repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return one.unionByName(many.mapInArrow(_digests, "depth bigint, i1 bigint, i2 bigint, ends_sha256 string"))


SHARED = 6  # a rebuilt conversation begins with fewer turns than this of another


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and convs, as ``prefix_trie`` takes them, of conversations that begin with the first turns of their hundred's first.

    Conversation c takes the first h turns of c - c % 100, then its own after its first h; h is the CRC-32 of c in decimal, modulo ``SHARED``.
    """
    turns = ordered_turns(conversations)
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(SHARED))
    few = F.when(F.col("at") < SHARED, F.struct("at", "turn_id"))
    tail = F.when(F.col("at") > h, length_of(F.col("turn_id")))
    own = cut(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(few)).alias("first"), F.coalesce(F.sum(tail), F.lit(0)).alias("tail")).withColumn("h", h))
    heads = own.select(F.col("conv").alias("base"), F.col("first")["turn_id"].alias("head"))
    base = (F.col("conv") - F.col("conv") % 100).alias("base")
    # at most 199 conversations meet one base
    taken = own.select("conv", "n", "tail", "h", base).join(heads, "base", "left").withColumn("taken", F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h").cast("int")))
    chars = F.aggregate("taken", F.lit(0).cast("bigint"), lambda acc, t: acc + length_of(t))
    k = F.size("taken").cast("bigint")
    convs = cut(taken.select("conv", "h", "taken", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"), (F.col("tail") + chars).alias("total")))
    borrowed = convs.select("conv", F.posexplode("taken").alias("at", "turn_id"), "depth", "total").withColumn("at", F.col("at").cast("bigint") + 1)
    rest = hot_join(turns, convs.select("conv", "h", "k", "depth", "total"), "conv", "at", 96).filter("at > h").withColumn("at", F.col("at") - F.col("h") + F.col("k"))
    return borrowed.unionByName(rest.select("conv", "at", "turn_id", "depth", "total")), convs.select("conv", "depth", "total")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt ``conversations``."""
    trie = prefix_trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
    out = trie.nodes.join(end_digests(trie.ends), list(KEY), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


OP11_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS nth,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY nth) AS turns FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM o, crc),
p AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS path
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
n AS (
  SELECT d AS depth, path[1:d] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(len(path) = d) AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = d), '')) AS ends_sha256
  FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM p) GROUP BY ALL),
s AS (
  SELECT prefix[1:a] AS prefix, sum(leaf::INT) AS n_leaves, sum(v) AS saved_tokens, count(*) FILTER (depth = a + 1) AS n_children
  FROM (SELECT prefix, depth, leaf, (n_convs - 1) * coalesce(length(prefix[depth].t), 0) AS v, unnest(range(depth + 1)) AS a FROM n) GROUP BY ALL)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.prefix = n.prefix LEFT JOIN n u ON u.depth = n.depth - 1 AND u.prefix = n.prefix[1:n.depth - 1]
"""
