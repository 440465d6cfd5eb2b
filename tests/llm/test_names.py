"""Names with dots, offsets of texts that lower case lengthens, and tables that a process keeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlake.llm import byte_dedup, exchange, packing, token_counts, toxicity, word_dedup
from cohortlake.llm.shared import ddl

ROWS = [(1, "some text with words", 20, {"k.v": 1}), (2, None, 0, None), (3, "", 0, {})]
SCHEMA = "doc_id bigint, text string, n_chars int, `a.b` map<string,int>, `we``ird` string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, n, m, "x") for i, t, n, m in ROWS] + [(4 + i, long, len(long), None, None) for i in range(2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("dedup", [word_dedup.repeated_windows, byte_dedup.repeated_bytes])
def test_dedup_keeps_columns_of_any_name(odd, dedup):
    out = dedup(odd, keep_columns=["a.b", "n_chars"])
    assert out.select("extra.*").columns == ["a.b", "n_chars"]
    assert {r.doc_id: r.extra["a.b"] for r in out.collect()} == {1: {"k.v": 1}, 2: None, 3: {}, 4: None, 5: None}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_columns_of_any_name(spark, odd, tmp_path, name):
    spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plain = odd.withColumnRenamed("we`ird", "we ird")
    out = dict(corpus_pipeline.STAGES)[name](spark, plain, str(tmp_path))
    if name != "packing":
        assert out.columns == plain.columns
    assert out.count() >= 0


def test_ddl_quotes_names(odd):
    assert ddl(odd.select("doc_id", "`a.b`").schema) == "struct<`doc_id`: bigint, `a.b`: map<string, int>>"


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    clean, bad = [f"w{i}" for i in range(40)], ["vile", "disgusting", "awful"]
    texts, toxic = [], []
    for i in range(120):
        words = list(rng.choice(clean, 30))
        if i % 3 == 0:
            words[5:7] = list(rng.choice(bad, 2))
        texts.append(" ".join(words))
        toxic.append(i % 3 == 0)
    return toxicity.fit(texts, np.array(toxic))


@pytest.mark.parametrize("start", ["x", "İx", "İİİ ß x", "\U0001d400 x"])
def test_offsets_are_those_of_the_text(spark, model, start):
    text = f"{start} w1 w2 w3 DISGUSTING vile w4 w5"
    row = toxicity.score_toxicity(spark.createDataFrame([(1, text), (2, "w1 w2"), (3, text)], "doc_id bigint, text string"), model).filter("doc_id <> 2").collect()
    assert [[text[s.start : s.stop] for s in r.spans] for r in row] == [["DISGUSTING vile"]] * 2


def test_scores_equal_brute_force(spark, model):
    """Marginals from all labellings of short texts, their noisy-or, and its logistic."""
    texts = ["w1 vile w2", "w3 w4", "disgusting", "", None, "unknown words vile awful w1"]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    for i, t in enumerate(texts):
        word, doc, begins = toxicity._features([t or ""], model.vocabulary)
        emit = model.emissions(word, begins)
        n = len(word)
        weight = {}
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            weight[code] = np.exp(sum(emit[k, y[k]] for k in range(n)) + sum(model.move[y[k - 1], y[k]] for k in range(1, n)))
        total = sum(weight.values())
        p = np.array([sum(w for c, w in weight.items() if c >> k & 1) / total for k in range(n)])
        z = model.slope * min(sum(-np.log1p(-min(x, 1 - 1e-9)) for x in p if x > 0.05), 30.0) + model.bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_query_has_spans_and_held_out(spark):
    out = toxicity.op1_toxicity_crf(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "n_spans", "spans"]
    rows = out.collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_spans == len(r.spans) and r.predicted == int(r.score >= 0.5)
        assert all(0 <= s.start < s.stop <= len(texts[r.doc_id]) and s.probability >= 0.5 for s in r.spans)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_tables_are_dropped_between_operators():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        model = file.read()
    first = packing._word_ids(model, "H")
    assert packing._word_ids(model, "H") is first and token_counts.load.cache_info().currsize
    exchange.drop_tables()
    assert packing._word_ids.cache_info().currsize == token_counts.load.cache_info().currsize == 0
