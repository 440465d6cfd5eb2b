import os

import numpy as np
import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


SCHEMA = "doc_id bigint, text string, n_chars int"


def planted(rng, changed, words=454):
    """A text, and a copy with words changed so far apart that each takes five of the 450 shingles with it."""
    text = [f"w{x}" for x in rng.integers(0, 1 << 40, words)]
    copy = list(text)
    for i in range(changed):
        copy[10 + 7 * i] = f"x{i}"
    return " ".join(text), " ".join(copy)


@pytest.mark.parametrize(("changed", "similarity"), [(10, 0.8), (8, 0.837), (7, 0.856), (4, 0.915), (11, 0.782), (14, 0.731)])
def test_near_copies_by_similarity(spark, changed, similarity):
    rng = np.random.default_rng(changed)
    rows = []
    for i in range(100):
        rows += [(2 * i, (pair := planted(rng, changed))[0], 1), (2 * i + 1, pair[1], 1)]
    out = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), DATA).collect()}
    assert out >= {2 * i for i in range(100)}
    gone = 200 - len(out)
    assert gone >= 97 if similarity >= 0.8 else gone == 0


def test_rows_that_share_an_id_or_have_none(spark):
    rng = np.random.default_rng(1)
    text = lambda: planted(rng, 1)[0]
    x, x_copy = planted(rng, 4)
    y, others, hot = text(), [text() for _ in range(20)], [text() for _ in range(20)]
    rows = [(5, x, 1), (5, y, 2), (3, x_copy, 3), *[(None, t, 4) for t in others], *[(9, t, 5) for t in hot], (9, hot[0], 5), (None, others[0], 4), (None, None, 6), (8, "", 7), (7, None, 8)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), DATA)
    want = [(5, y, 2), (3, x_copy, 3), *[(None, t, 4) for t in others], *[(9, t, 5) for t in hot], (7, None, 8)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), DATA).count() == 0


def test_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base, sets, rows = [[f"b{k}-{i}" for i in range(60)] for k in range(4)], [], []
    for i in range(160):
        words = list(base[i % 4])
        for at in rng.integers(0, 60, int(rng.integers(0, 4))):
            words[at] = f"n{rng.integers(0, 6)}"
        words = words[: int(rng.integers(1, 8))] if i % 10 == 9 else words
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
        rows.append((i, " ".join(words), 0))
    label = list(range(160))
    while True:
        low = [min(label[j] for j in range(160) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in range(160)]
        if low == label:
            break
        label = low
    out = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), DATA).collect()}
    assert out == set(label)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, equal ids, repeated rows, empty and long texts, and names that stages use themselves."""
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(3, 9)))) for _ in range(n))
    shared = prose(60)
    texts = [prose(80) for _ in range(12)] + [prose(30) + " " + shared + " " + prose(30) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, prose(50)), (None, prose(50)), (None, None), (40, None), (41, ""), (42, prose(30_000)), (7, prose(40))]
    return spark.createDataFrame([(i, t, None if t is None else len(t), "a", i, 1, 2) for i, t in rows], "doc_id bigint, text string, n_chars int, extra string, g bigint, score int, __nth int").repartition(4)


def test_every_stage_on_odd_tables(spark, odd, tmp_path):
    spark.createDataFrame([(i, int(i < 3)) for i in range(12)] + [(None, 1), (5, None)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.filter("1 = 0")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.schema.names == docs.schema.names
            got = out.collect()
            assert (len(got) > 0) == (n > 0)
    rows = sorted(map(str, odd.collect()))
    assert sorted(map(str, corpus_pipeline.quality_rules(spark, odd, str(tmp_path)).collect())) == [r for r in rows if "text=None" not in r and "text=''" not in r]


def test_suffix_stage_changes_only_what_repeats(spark, odd):
    before = {(r.doc_id, r.text) for r in odd.collect()}
    out = corpus_pipeline.suffix_dedup(spark, odd, DATA).collect()
    assert len(out) == odd.count()
    changed = [r for r in out if (r.doc_id, r.text) not in before]
    assert {r.doc_id for r in changed} == {3, 13, 14, 15} and all(r.n_chars == len(r.text) for r in out if r.text is not None)
    assert sum(r.text is None for r in out) == 2


def test_run_gives_every_id_of_what_the_stages_kept(spark, odd, tmp_path):
    """The pieces of run() are those of packing what the stages kept one after the other."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 3)) for i in range(12)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in got) == sum(want) and {r.doc_tokens for r in got} == set(want)
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
