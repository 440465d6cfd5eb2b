"""The audit record of scored runs: what is fixed on validation rows, and what test rows show at it.

A record is long, (keys, item, value), so that runs, strata and bins of any
number are rows and not columns; items are dotted paths. Curves with a point a
score are tables of their own (``scores.roc_points``, ``scores.pr_points``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clipped_logit, clipped_sigmoid
from . import scores as S

RATES = ("accuracy", "sensitivity", "specificity", "ppv", "npv", "f1")
ROUNDS = 2  # of the temperature's grid; the last step is 0.04 percent


def locked_points(validation: DataFrame, keys: Sequence[str], target: float = 0.8, p: str = "probability", y: str = "label") -> DataFrame:
    """keys, threshold (Youden), fixed (at the target specificity), temperature, nll_before, nll_after: all fitted on these rows alone."""
    counts = S.score_counts(validation, keys, p, y)
    roc = S.roc_points(counts, keys)
    points = S.youden(roc, keys).join(S.threshold_at_specificity(roc, target, keys).withColumnRenamed("threshold", "fixed"), list(keys))
    scored = validation.withColumn("logit", clipped_logit(F.col(p)))
    fit = S.fit_temperature(scored, keys, "logit", y, ROUNDS).withColumnRenamed("nll", "nll_after")
    before = S.prob_quality(validation, keys, p, y).select(*keys, F.col("nll").alias("nll_before"))
    return points.join(fit, list(keys)).join(before, list(keys))


def strata_rows(rows: DataFrame, keys: Sequence[str], stratum: str, levels: Sequence, threshold: str, min_n: int = 10, p: str = "probability", y: str = "label") -> DataFrame:
    """keys, level, n, auc, accuracy, sensitivity, specificity, ppv of every level, null but for n under ``min_n`` rows.

    ``threshold`` names a column of the rows; all keys and levels go through one job.
    """
    level = F.col(stratum).cast("string").alias("level")
    named = rows.select(*keys, level, F.col(p).alias("p"), F.col(y).alias("y"), F.col(threshold).alias("cut"))
    by = [*keys, "level"]
    own = S.panel(named, F.col("cut"), by, "p", "y").join(S.rank_metrics(S.score_counts(named, by, "p", "y"), by).select(*by, "auc"), by)
    every = named.select(*keys).distinct().withColumn("level", F.explode(F.array(*[F.lit(str(x)) for x in levels])))
    out = every.join(own, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(*by, "n", *[F.when(F.col("n") >= min_n, F.col(c)).alias(c) for c in ("auc", "accuracy", "sensitivity", "specificity", "ppv")])


def _long(df: DataFrame, keys: Sequence[str], names: Mapping[str, str | Column], prefix: Column | str = "") -> DataFrame:
    """keys, item, value of some columns, each under its name after the prefix."""
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    pairs = [F.struct(F.concat(start, F.lit(k)).alias("item"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value")) for k, v in names.items()]
    return df.select(*keys, F.inline(F.array(*pairs))).filter("value is not null")


def audit_record(test: DataFrame, locked: DataFrame, keys: Sequence[str], strata: Mapping[str, Sequence], validation: DataFrame | None = None, bins: int = 10, p: str = "probability", y: str = "label", patient: str = "patient_id") -> DataFrame:
    """keys, item, value: the record of each run at its locked points.

    ``locked`` has keys, threshold, fixed and temperature. Nothing is fitted here, so
    the same record serves rows of other origin; with ``validation`` it also has the
    panel of those rows at the fixed threshold. ``strata`` names levels by column.
    """
    k = list(keys)
    points = F.broadcast(locked.select(*k, "threshold", "fixed", "temperature"))  # a row a run
    rows = test.join(points, k).withColumn("calibrated", clipped_sigmoid(clipped_logit(F.col(p)), F.col("temperature")))
    rates = {c: c for c in RATES}
    size = rows.groupBy(*k).agg(F.count("*").alias("n_cases"), F.count_distinct(patient).alias("n_patients"), F.count_if(F.col(y) == 1).alias("n_positive"), F.avg(y).alias("prevalence"))
    parts = [_long(size, k, {c: c for c in ("n_cases", "n_patients", "n_positive", "prevalence")})]
    fitted = [c for c in ("threshold", "fixed", "temperature", "nll_before", "nll_after") if c in locked.columns]
    parts.append(_long(locked, k, {c: c for c in fitted}, "locked."))
    for name, q in (("raw", p), ("calibrated", "calibrated")):
        parts.append(_long(S.rank_metrics(S.score_counts(rows, k, q, y), k), k, {"auc": "auc", "average_precision": "average_precision"}, f"{name}."))
        parts.append(_long(S.prob_quality(rows, k, q, y), k, {"brier": "brier", "nll": "nll"}, f"{name}."))
        binned = S.calibration_bins(rows, k, q, y, bins)
        parts.append(_long(S.expected_calibration_error(binned, k), k, {"ece": "ece"}, f"{name}."))
        if name == "calibrated":
            parts.append(_long(binned, k, {"n": "n", "pred": "mean_p", "obs": "mean_y"}, F.concat(F.lit("reliability."), "bin", F.lit("."))))
            curve = S.decision_curve(S.score_counts(rows, k, q, y), k)
            place = F.round((F.col("t") - 0.05) / 0.01).cast("int")
            parts.append(_long(curve, k, {"net_benefit": "net_benefit", "treat_all": "treat_all"}, F.concat(F.lit("decision."), place, F.lit("."))))
    for name, cut in (("test.", "threshold"), ("fixed.test.", "fixed")):
        parts.append(_long(S.panel(rows, F.col(cut), k, p, y), k, rates, name))
        for column, levels in strata.items():
            own = strata_rows(rows, k, column, levels, cut, p=p, y=y)
            start = F.concat(F.lit(f"{'fixed.' if cut == 'fixed' else ''}{column}."), "level", F.lit("."))
            parts.append(_long(own, k, {c: c for c in ("n", "auc", "accuracy", "sensitivity", "specificity", "ppv")}, start))
    if validation is not None:
        parts.append(_long(S.panel(validation.join(points, k), F.col("fixed"), k, p, y), k, rates, "fixed.validation."))
    return reduce(DataFrame.unionByName, parts)


def strata_table(rows: DataFrame, keys: Sequence[str], min_n: int = 10) -> DataFrame:
    """Strata rows for print: four places, and the reason of those without figures, a column only if some have none."""
    figures = [c for c in rows.columns if c not in (*keys, "level", "n")]
    out = rows.select(*keys, "level", "n", *[F.round(c, 4).alias(c) for c in figures], F.when(F.col("n") < min_n, F.lit(f"n<{min_n}")).alias("reason"))
    return out.drop("reason") if out.filter("reason is not null").isEmpty() else out
