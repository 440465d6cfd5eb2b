"""Curves, operating points, panels and calibration of scored predictions.

Rows are collapsed to distinct scores first, so thresholds, curves and
resamples work on counts. Every function takes ``keys``: all runs, subsets or
strata go through one job. Running counts go over ranges of scores, so one run of
very many scores, with or without keys, fills many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bin_of
from ..sources.tables import cut
from .prefix import along

Keys = Sequence[str]
ONE = ("__one",)


def _keyed(df: DataFrame, keys: Keys) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("__one", F.lit(1)), list(ONE))


def score_counts(pred: DataFrame, keys: Keys = (), p: str = "probability", y: str = "label", weight: Column | None = None) -> DataFrame:
    """keys, threshold, tp, fp at each distinct score."""
    w = F.lit(1) if weight is None else weight
    return pred.groupBy(*keys, F.col(p).alias("threshold")).agg(F.sum(w * F.col(y)).alias("tp"), F.sum(w * (1 - F.col(y))).alias("fp"))


def running(counts: DataFrame, keys: Keys = (), parts: int | None = None) -> DataFrame:
    """Adds at (the place from the highest score), tps, fps (at the score or above), next_tp, next_fp (of the next lower score), pos, neg."""
    tp, fp = F.col("tp"), F.col("fp")
    return along(counts, keys, [-F.col("threshold")], sums={"at": F.lit(1).cast("bigint"), "tps": tp, "fps": fp}, nexts={"next_tp": tp, "next_fp": fp}, wholes={"pos": tp, "neg": fp}, parts=parts)


def rank_metrics(counts: DataFrame, keys: Keys = (), parts: int | None = None) -> DataFrame:
    """keys, pos, neg, auc (ties half; null with one class), average_precision."""
    run = running(counts, keys, parts)
    area = F.sum(F.col("fp") * (F.col("tps") - F.col("tp") / 2))
    ap = F.sum(F.try_divide(F.col("tp"), F.col("pos")) * F.try_divide(F.col("tps"), F.col("tps") + F.col("fps")))
    return run.groupBy(*keys).agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"), area.alias("area"), ap.alias("average_precision")).select(*keys, "pos", "neg", F.try_divide("area", F.col("pos") * F.col("neg")).alias("auc"), "average_precision")


def roc_points(counts: DataFrame, keys: Keys = (), drop_intermediate: bool = True, parts: int | None = None) -> DataFrame:
    """keys, threshold, fpr, tpr; straight runs keep their ends; (inf, 0, 0) first.

    A point lies on a straight run if the step to it equals the step from it,
    and steps are the counts at the scores.
    """
    run = running(counts, keys, parts)
    kept = run.filter("at = 1 or next_tp is null or next_tp <> tp or next_fp <> fp") if drop_intermediate else run
    points = kept.select(*keys, "threshold", F.try_divide("fps", "neg").alias("fpr"), F.try_divide("tps", "pos").alias("tpr"))
    return points.unionByName(run.filter("at = 1").select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def youden(roc: DataFrame, keys: Keys = ()) -> DataFrame:
    """keys, threshold of the largest tpr - fpr; the highest of equals, maybe inf."""
    return roc.groupBy(*keys).agg(F.max_by("threshold", F.struct(F.col("tpr") - F.col("fpr"), "threshold")).alias("threshold"))


def threshold_at_specificity(roc: DataFrame, target: float, keys: Keys = ()) -> DataFrame:
    """keys, threshold: best tpr with fpr <= 1 - target, then the lowest finite threshold.

    A tpr is the best if it is within 1e-8 and 1e-5 of its share of the largest.
    """
    ok = roc.filter((F.col("fpr") <= 1 - target + 1e-12) & (F.col("threshold") < float("inf")))
    df, k = _keyed(ok, keys)
    best = df.groupBy(*k).agg(F.max("tpr").alias("__best"))
    close = F.abs(F.col("tpr") - F.col("__best")) <= 1e-8 + 1e-5 * F.col("__best")
    return df.join(best, k).filter(close).groupBy(*k).agg(F.min("threshold").alias("threshold")).drop(*ONE)


def pr_points(counts: DataFrame, keys: Keys = (), parts: int | None = None) -> DataFrame:
    """keys, threshold, precision, recall; the end (null, 1, 0) has no threshold."""
    run = running(counts, keys, parts)
    points = run.select(*keys, "threshold", F.try_divide("tps", F.col("tps") + F.col("fps")).alias("precision"), F.try_divide("tps", "pos").alias("recall"))
    return points.unionByName(run.filter("at = 1").select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def panel(pred: DataFrame, threshold: Column, keys: Keys = (), p: str = "probability", y: str = "label") -> DataFrame:
    """keys, n, tn, fp, fn, tp and six rates, 0 on an empty denominator; p >= threshold is positive."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    c = pred.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return c.select("*", rate(tp + tn, F.col("n")).alias("accuracy"), rate(tp, tp + fn).alias("sensitivity"), rate(tn, tn + fp).alias("specificity"), rate(tp, tp + fp).alias("ppv"), rate(tn, tn + fn).alias("npv"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def prob_quality(pred: DataFrame, keys: Keys = (), p: str = "probability", y: str = "label") -> DataFrame:
    """keys, brier, nll (p clipped to 1e-7 from both ends)."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(p)))
    return pred.groupBy(*keys).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(-F.ln(F.when(F.col(y) == 1, q).otherwise(1 - q))).alias("nll"))


def calibration_bins(pred: DataFrame, keys: Keys = (), p: str = "probability", y: str = "label", bins: int = 10) -> DataFrame:
    """keys, bin, n, mean_p, mean_y of the bins that hold rows."""
    return pred.groupBy(*keys, bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def expected_calibration_error(binned: DataFrame, keys: Keys = ()) -> DataFrame:
    return binned.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def decision_curve(counts: DataFrame, keys: Keys = (), first: float = 0.05, step: float = 0.01, points: int = 46) -> DataFrame:
    """keys, t, net_benefit, treat_all, treat_none over a fixed grid, crossed with counts by score, not with rows."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(first) + i * F.lit(step)))
    hit = F.col("threshold") >= F.col("t")
    agg = counts.withColumn("t", grid).groupBy(*keys, "t").agg(F.sum(F.when(hit, F.col("tp")).otherwise(0)).alias("tps"), F.sum(F.when(hit, F.col("fp")).otherwise(0)).alias("fps"), F.sum("tp").alias("pos"), F.sum(F.col("tp") + F.col("fp")).alias("n"))
    odds = F.col("t") / (1 - F.col("t") + 1e-12)
    return agg.select(*keys, "t", (F.col("tps") / F.col("n") - F.col("fps") / F.col("n") * odds).alias("net_benefit"), (F.col("pos") / F.col("n") - (1 - F.col("pos") / F.col("n")) * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"))


def strata(pred: DataFrame, stratum: str, levels: Sequence, threshold: Column, min_n: int = 10, p: str = "probability", y: str = "label") -> DataFrame:
    """A row a level: n, panel and AUC, null with a reason under ``min_n`` rows."""
    own = panel(pred, threshold, [stratum], p, y).join(rank_metrics(score_counts(pred, [stratum], p, y), [stratum]).select(stratum, "auc"), stratum)
    kind = pred.schema[stratum].dataType
    dim = pred.sparkSession.createDataFrame([(x,) for x in levels], f"{stratum} {kind.simpleString()}")
    joined = F.broadcast(dim).join(own, stratum, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keep = F.col("n") >= min_n
    return joined.select(stratum, "n", *[F.when(keep, F.col(c)).alias(c) for c in ("sensitivity", "specificity", "auc")], F.when(~keep, F.lit(f"n<{min_n}")).alias("reason"))


def fit_temperature(pred: DataFrame, keys: Keys = (), logit: str = "logit", y: str = "label", rounds: int = 3) -> DataFrame:
    """keys, temperature, nll: least mean loss on a log grid of 41 points, refined ``rounds`` times.

    Rows are counted by score and label first, so the grid meets distinct scores
    and not rows. All runs and grid points of a round go through one aggregation;
    each round keeps the best point and shrinks the step twentyfold.
    """
    from math import log

    low, high = log(0.05), log(20.0)
    step = (high - low) / 40
    df, k = _keyed(pred, keys)
    df = cut(df.groupBy(*k, F.col(logit).alias("z"), F.col(y).alias("y")).agg(F.count("*").alias("n")))
    best = df.select(*k).distinct().withColumn("mid", F.lit((low + high) / 2))
    for _ in range(rounds + 1):
        t = F.exp(F.col("mid") + (F.col("i") - 20) * F.lit(step))
        grid = df.join(F.broadcast(best.select(*k, "mid")), k).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(40))))
        z = F.col("z") / t
        loss = F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z)))
        each = grid.groupBy(*k, "mid", "i").agg((F.sum(loss * F.col("n")) / F.sum("n")).alias("nll"))
        best = each.groupBy(*k).agg(F.min(F.struct("nll", "i", "mid")).alias("b")).select(*k, (F.col("b.mid") + (F.col("b.i") - 20) * F.lit(step)).alias("mid"), F.col("b.nll").alias("nll"))
        best = cut(best)
        step /= 20
    return best.select(*[c for c in k if c not in ONE], F.exp("mid").alias("temperature"), "nll")
