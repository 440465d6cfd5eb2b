"""Exact dedup, filter audit and prefix trie against brute force, and their edge cases."""

import hashlib
import os
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import components, exact_dedup, filter_audit, prefix_trie, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
DATA = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(monkeypatch):
    """Joins by key, as for tables that are too large to broadcast."""
    monkeypatch.setattr(components, "small", lambda df, row_bytes: df)
    monkeypatch.setattr(filter_audit, "BROADCAST_BYTES", -1)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_exact_dedup", "op13_filter_audit"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df, rel = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    assert got == sorted(repr([r[rel.columns.index(c)] for c in sorted(rel.columns)]) for r in rel.fetchall())


TEXTS = [(1, "a b"), (2, "a b"), (3, "a c"), (4, None), (5, ""), (6, ""), (7, "x" * 300), (8, "x" * 299 + "y"), (8, "x" * 300), (9, "é"), (9, "é"), (9, "é"), (None, "a b"), (None, "z"), (None, "z"), (10, "long " * 400000), (11, "long " * 400000), (12, "lang " * 400000)]
ODD = "doc_id bigint, text string, length int, `a.b` string, row string"


def odd(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], ODD).repartition(3)


def check_exact(got, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        same = [r for r in got if r.digest == hashlib.sha256(t.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert sorted(map(repr, (r.id for r in same))) == sorted(map(repr, ids))
        assert {r.keep_id for r in same} == {max(known) if known else None} and {r.group_size for r in same} == {len(ids)}
        assert [r.id for r in same if r.kept] == [max(known) if known else None]


def test_exact_duplicates(spark):
    check_exact(exact_dedup.exact_duplicates(odd(spark), digest=lambda t: F.sha2(t, 256)).collect(), TEXTS)


def test_exact_duplicates_without_broadcast(spark, no_broadcast):
    check_exact(exact_dedup.exact_duplicates(odd(spark), digest=lambda t: F.sha2(t, 256), prefix=4).collect(), TEXTS)


def test_exact_duplicates_refine(spark):
    """Only texts of a repeated length and prefix are hashed whole."""
    rows = spark.createDataFrame([(1, "abcd1"), (2, "abcd2"), (3, "efgh1"), (4, "long one"), (5, "abcd2")], "doc_id bigint, text string")
    out = {r.id: r.group_size for r in exact_dedup.exact_duplicates(rows, prefix=4).collect()}
    assert out == {1: 1, 2: 2, 3: 1, 4: 1, 5: 2}
    lower = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "Ab"), (2, "aB")], "doc_id bigint, text string"), normalise=F.lower)
    assert {(r.id, r.keep_id) for r in lower.collect()} == {(1, 2), (2, 2)}
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], ODD)).count() == 0


def test_length_classes_are_bounded(spark):
    out = spark.createDataFrame([("x" * 5,), ("y" * ((1 << 20) + 7),), ("y" * (1 << 20),)], "t string").select(exact_dedup.length_class(F.col("t")).alias("c")).collect()
    assert [r.c for r in out] == [5, (1 << 20) + 7, 1 << 20]


def brute_audit(docs, labels):
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = WORDS(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        own = [(q, x) for d, q, x in labels if d is not None and d == i]
        rows.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [r for r in mine if f in r[1] and not r[1] & before]
                total[f] += len(here)
                out[part, "".join(order), k + 1] = [sum(not r[1] & (before | {f}) for r in mine), len(here), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audit_rows():
    rng = np.random.default_rng(3)
    docs = []
    for i in range(80):
        n = int(rng.choice([30, 220]))
        text = " ".join(f"w{x}" for x in rng.integers(0, int(rng.choice([20, 1000])), n))
        text = text.upper() if rng.random() < 0.2 else text
        docs.append((i, text + " #" * int(rng.random() < 0.3), [None, "", "en", "de"][int(rng.integers(0, 4))]))
    docs += [(100 + i, docs[i][1], docs[i + 1][2]) for i in range(20)] + [(3, docs[5][1], "en"), (3, docs[5][1], "en"), (None, docs[6][1], "en"), (None, None, None), (200, None, "fr"), (201, "", "fr"), (202, "word " * 300000, "en")]
    labels = [(i, int(rng.random() < 0.6), int(rng.random() < 0.3)) for i in range(110)] + [(3, 1, 0), (3, None, 1), (None, 1, 1), (7, None, None)]
    return docs, labels


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, lang string, row int, `a.b` string").repartition(3)
    lab = spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    out = filter_audit.audit(d, lab, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in out}
    assert len(got) == len(out)
    return got


def test_filter_audit(spark):
    docs, labels = audit_rows()
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_filter_audit_without_broadcast(spark, no_broadcast):
    docs, labels = audit_rows()
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_filter_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    clean = " ".join(f"w{i}" for i in range(300))
    got = audited(spark, [(1, clean, "en")], [])
    assert len(got) == 600 and all(v == [1, 0, 0, 0, 0, 0, 0] for v in got.values())


def brute_trie(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = set()
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        child = lambda p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(prefix))))
        out.add((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), len(child(prefix)), sum(not child(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def brute_rebuild(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            turns.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest(), (r, t)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = tuple(own.get(base, [])[:h] + mine[h:])
    return out


def conversations():
    rng = np.random.default_rng(9)
    rows = []
    for c in [*range(0, 40), *range(200, 230), *range(330, 340), -5, -205]:
        rows += [(c, t if rng.random() < 0.9 else None, ["user", "assistant", None][int(rng.integers(0, 3))], ["a", "bé", None, "cc " * 9][int(rng.integers(0, 4))]) for t in range(int(rng.integers(1, 9)))]
    long = [("user" if t % 2 else "assistant", f"turn {t}") for t in range(60)]
    for c, n in ((500, 60), (501, 60), (502, 33), (503, 24), (504, 25), (505, 16), (600, 60)):
        rows += [(c, t, *long[t]) for t in range(n)] + ([(c, n, "user", "other")] if c == 504 else [])
    rows += [(700 + i, 0, "user", "hello") for i in range(90)] + [(None, 0, "user", "x"), (3, 1, "user", "again"), (3, 1, "user", "again"), (7, None, None, None)]
    return rows


def trie_rows(spark, rows, piece=256):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string").repartition(3)
    trie = prefix_trie.prefix_trie(*prefix_trie.rebuilt(df))
    out = trie.nodes.join(prefix_trie.end_digests(trie.ends), list(prefix_trie.KEY), "left").withColumn("e", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).collect()
    got = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.e) for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize("piece", [256, 4])
def test_prefix_trie(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = conversations()
    assert trie_rows(spark, rows) == brute_trie(brute_rebuild(rows))


def test_prefix_trie_without_broadcast(spark, no_broadcast):
    rows = conversations()
    assert trie_rows(spark, rows) == brute_trie(brute_rebuild(rows))


def test_prefix_trie_of_little(spark):
    assert trie_rows(spark, []) == set()
    assert trie_rows(spark, [(None, 1, "user", "x")]) == set()
    one = [(2, 0, "user", "hello")]  # its first turns come from conversation 0, which is not there
    assert trie_rows(spark, one) == brute_trie(brute_rebuild(one))


def test_turns_that_only_join_alike_differ(spark):
    rows = [(5, 0, "us", "er1"), (5, 1, "user", "1"), (5, 2, "user", "1")]
    assert trie_rows(spark, rows) == brute_trie(brute_rebuild(rows))
