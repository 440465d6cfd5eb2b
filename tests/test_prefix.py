"""Running totals over ranges, and all resamples by weight vectors, against plain windows and loops."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlake.operators import bootstrap as B
from cohortlake.operators import resample as R
from cohortlake.operators import scores as S
from cohortlake.operators.prefix import along, numbered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    keys = [None if k == 3 else int(k) for k in rng.choice([0, 1, 2, 3], 900, p=[0.6, 0.3, 0.05, 0.05])]
    data = [(k, int(v), i, int(w)) for i, (k, v, w) in enumerate(zip(keys, rng.integers(0, 40, 900), rng.integers(-5, 9, 900), strict=True))]
    return spark.createDataFrame(data, "k int, v int, id int, w bigint").repartition(5).cache()


@pytest.mark.parametrize("parts", [1, 4, 50, 200])
@pytest.mark.parametrize("keys", [["k"], []])
def test_equals_windows(rows, parts, keys):
    w = Window.partitionBy(*keys).orderBy("v", "id") if keys else Window.orderBy("v", "id")
    up, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = rows.select("id", F.sum("w").over(up).alias("s"), F.bit_xor("w").over(up).alias("x"), F.lead("w").over(w).alias("n"), F.sum("w").over(whole).alias("t"))
    got = along(rows, keys, [F.col("v"), F.col("id")], sums={"s": F.col("w")}, xors={"x": F.col("w")}, nexts={"n": F.col("w")}, wholes={"t": F.col("w")}, parts=parts)
    assert sorted(map(tuple, got.select("id", "s", "x", "n", "t").collect())) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


def test_numbered_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, v int")
    assert numbered(empty, ["k"], [F.col("v")]).count() == 0
    assert numbered(empty, [], [F.col("v")]).columns == ["k", "v", "at"]


def test_values_of_one_name_and_nulls_that_follow(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None)], "v int, w int")
    got = {r.v: (r.w, r.n) for r in along(df, [], [F.col("v")], sums={"w": F.col("w")}, nexts={"n": F.col("w")}, parts=3).collect()}
    assert got == {1: (None, 5), 2: (5, None), 3: (5, None)}


@pytest.fixture(scope="module")
def pred(spark):
    rng = np.random.default_rng(4)
    n = 400
    label = rng.integers(0, 2, n)
    data = [(["a", "b"][i % 2], f"p{i // 5}", int(label[i]), float(np.round(0.6 * rng.random() + 0.3 * label[i], 2)), int(rng.integers(1, 5)), ["mass", "Calcification "][int(rng.integers(0, 2))]) for i in range(n)]
    return spark.createDataFrame(data, "run string, patient_id string, label int, probability double, density int, lesion_type string").cache()


@pytest.mark.parametrize("parts", [4, 200])
def test_curves_do_not_depend_on_ranges(pred, parts):
    counts = S.score_counts(pred, ["run"])
    same = lambda f: sorted(map(repr, f(parts).collect())) == sorted(map(repr, f(1).collect()))
    assert same(lambda n: S.roc_points(counts, ["run"], parts=n))
    assert same(lambda n: S.pr_points(counts, ["run"], parts=n))
    assert same(lambda n: S.rank_metrics(counts, ["run"], parts=n).select("run", F.round("auc", 9), F.round("average_precision", 9)))
    assert same(lambda n: S.roc_points(S.score_counts(pred), parts=n))


def test_no_window_holds_a_whole_key(pred):
    plan = S.roc_points(S.score_counts(pred, ["run"]), ["run"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "__range" not in line and "__t_" not in line]
    assert windows and all("__part" in line.split("],")[1] for line in windows if "__v_" in line)


def test_vectors_equal_the_weights_of_rows(pred):
    vectors = {r.patient_id: np.frombuffer(r.w, "<u2") for r in R.weight_vectors(pred, 30, 7).collect()}
    want = {}
    for r in B.bootstrap_weights(pred, 30, 7).collect():
        want.setdefault(r.patient_id, np.zeros(30, int))[r.b] += r.weight
    assert vectors.keys() == want.keys() and all((vectors[k] == want[k]).all() for k in want)


@pytest.mark.parametrize(("parts", "slice_rows"), [(1, 512), (7, 3), (50, 512)])
def test_rank_sums_equal_weighted_curves(pred, monkeypatch, parts, slice_rows):
    monkeypatch.setattr(R, "SLICE", slice_rows)
    counts = pred.groupBy("run", "patient_id", F.col("probability").alias("threshold")).agg(F.sum("label").alias("tp"), F.sum(1 - F.col("label")).alias("fp"))
    got = {(r.run, r.b): (r.auc, r.average_precision) for r in R.rank_sums(counts, R.weight_vectors(pred, 20, 7), ["run"], 20, parts=parts).collect()}
    weighted = B.weighted_counts(pred, B.bootstrap_weights(pred, 20, 7), ["run"])
    want = {(r.run, r.b): (r.auc, r.average_precision) for r in S.rank_metrics(weighted, ["run", "b"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_rank_sums_without_keys(pred):
    counts = pred.groupBy("patient_id", F.col("probability").alias("threshold")).agg(F.sum("label").alias("tp"), F.sum(1 - F.col("label")).alias("fp"))
    got = {r.b: r.auc for r in R.rank_sums(counts, R.weight_vectors(pred, 5, 7), [], 5).collect()}
    want = {r.b: r.auc for r in S.rank_metrics(B.weighted_counts(pred, B.bootstrap_weights(pred, 5, 7)), ["b"]).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_specificity_takes_close_rates_as_equal(spark):
    roc = spark.createDataFrame([(0.9, 0.1, 0.5), (0.4, 0.1, 0.5 - 1e-7), (0.3, 0.1, 0.4), (0.2, 0.9, 1.0), (float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    assert S.threshold_at_specificity(roc, 0.8).first().threshold == 0.4
