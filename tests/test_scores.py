"""Hand-computed cases of the score audit."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import bootstrap as B
from cohortlake.operators import scores as S

ROWS = [("n1", 0, 0.1), ("n1", 0, 0.2), ("n2", 0, 0.4), ("n2", 0, 0.6), ("p1", 1, 0.3), ("p1", 1, 0.7), ("p2", 1, 0.8), ("p2", 1, 0.9)]


@pytest.fixture(scope="module")
def pred(spark):
    return spark.createDataFrame([("m", *r) for r in ROWS], "run string, patient_id string, label int, probability double").cache()


def scored(spark, labels, probs):
    return spark.createDataFrame(list(zip(labels, probs, strict=True)), "label int, probability double")


def test_rank_and_quality(pred):
    r = S.rank_metrics(S.score_counts(pred)).first()
    q = S.prob_quality(pred).first()
    assert r.auc == 0.875 and r.average_precision == pytest.approx(0.916667, abs=1e-6)
    assert q.brier == pytest.approx(0.15) and q.nll == pytest.approx(0.455597, abs=1e-6)


def test_panel(pred):
    p = S.panel(pred, F.lit(0.5)).first()
    assert (p.tn, p.fp, p.fn, p.tp) == (3, 1, 1, 3)


def test_roc_and_youden(pred):
    roc = S.roc_points(S.score_counts(pred))
    got = {r.threshold: (r.fpr, r.tpr) for r in roc.collect()}
    assert got == {math.inf: (0, 0), 0.9: (0, 0.25), 0.7: (0, 0.75), 0.4: (0.5, 0.75), 0.3: (0.5, 1), 0.1: (1, 1)}
    assert S.youden(roc).first().threshold == 0.7


def test_fixed_specificity_sees_kept_points_only(spark):
    roc = S.roc_points(S.score_counts(scored(spark, [1, 0, 0, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5])))
    assert S.threshold_at_specificity(roc, 0.5).first().threshold == 0.9
    roc = S.roc_points(S.score_counts(scored(spark, [0, 0, 0, 0, 1, 1, 1, 1], [0.1, 0.2, 0.4, 0.8, 0.3, 0.5, 0.7, 0.9])))
    assert S.threshold_at_specificity(roc, 0.75).first().threshold == 0.5


def test_one_class_has_no_auc(spark):
    assert S.rank_metrics(S.score_counts(scored(spark, [1, 1], [0.2, 0.3]))).first().auc is None


def test_bins(spark):
    got = {r.mean_p: r.bin for r in S.calibration_bins(scored(spark, [1, 1, 1, 1], [0.3, 0.6, 0.7, 1.0])).collect()}
    assert got == {0.3: 2, 0.6: 5, 0.7: 6, 1.0: 9}
    assert S.expected_calibration_error(S.calibration_bins(scored(spark, [0, 1], [0.5, 0.5]))).first().ece == 0


def test_strata_skip(spark):
    df = spark.createDataFrame([(1, i % 2, i / 10) for i in range(10)] + [(2, 0, 0.2), (2, 1, 0.8)], "density int, label int, probability double")
    got = {r.density: (r.n, r.reason) for r in S.strata(df, "density", [1, 2, 3, 4], F.lit(0.5), 5).collect()}
    assert got == {1: (10, None), 2: (2, "n<5"), 3: (0, "n<5"), 4: (0, "n<5")}


def test_bootstrap_invariants(pred):
    w = B.bootstrap_weights(pred, 40, 1).collect()
    by = {}
    for r in w:
        by.setdefault(r.b, {}).setdefault(r.patient_id[0], []).append(r.weight)
    assert all(sum(s["n"]) == 2 and sum(s["p"]) == 2 for s in by.values()) and len(by) == 40
    again = B.bootstrap_weights(pred.repartition(3), 40, 1).collect()
    assert sorted(map(tuple, w)) == sorted(map(tuple, again))
    auc = S.rank_metrics(B.weighted_counts(pred, B.bootstrap_weights(pred, 40, 1)), ["b"]).withColumnRenamed("auc", "value")
    i = B.intervals(auc).first()
    assert i.n_valid == 40 and i.lo <= 0.875 <= i.hi


def test_temperature_improves(spark):
    df = spark.createDataFrame([(float(z), int(y)) for z, y in [(4, 1), (5, 0), (-4, 0), (-5, 1), (3, 1), (-3, 0)]], "logit double, label int")
    fit = S.fit_temperature(df).first()
    start = df.agg(F.avg(F.log1p(F.exp(-F.col("logit") * (2 * F.col("label") - 1))))).first()[0]
    assert fit.temperature > 1 and fit.nll < start


def test_no_python_or_cartesian_in_plans(pred):
    plan = S.rank_metrics(S.score_counts(pred, ["run"]), ["run"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
