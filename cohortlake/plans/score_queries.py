"""Score audit and uncertainty."""

from __future__ import annotations

from math import log

from pyspark.sql import functions as F

from ..functions import clipped_logit, clipped_sigmoid, keyed_uniform, r6
from ..operators import audits as A
from ..operators import bootstrap as B
from ..operators import contracts as K
from ..operators import scores as S
from ..operators.resample import packed_vectors, rank_sums
from ..sources.tables import cut
from .views import RUNS_SQL, SPLITS_SQL, pred_sql, predictions, runs, splits, table, u_sql

ALL: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        ALL[f.__name__.rstrip("_")] = (f, sql)
        return f

    return add


P = f"WITH pred AS ({pred_sql()}), runs AS ({RUNS_SQL}), "


def _curve(src: str = "pred", key: str = "run_name") -> str:
    return f"""cnt AS (SELECT {key} AS k, probability AS threshold, sum(label)::BIGINT AS tp, sum(1 - label)::BIGINT AS fp FROM {src} GROUP BY ALL),
run AS (SELECT *, sum(tp) OVER w AS tps, sum(fp) OVER w AS fps, sum(tp) OVER (PARTITION BY k) AS pos, sum(fp) OVER (PARTITION BY k) AS neg FROM cnt WINDOW w AS (PARTITION BY k ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
bend AS (SELECT *, lead(fps) OVER v - 2 * fps + lag(fps) OVER v AS bf, lead(tps) OVER v - 2 * tps + lag(tps) OVER v AS bt FROM run WINDOW v AS (PARTITION BY k ORDER BY threshold DESC)),
roc AS (SELECT k, threshold, fps / neg AS fpr, tps / pos AS tpr FROM bend WHERE bf IS NULL OR bt IS NULL OR bf <> 0 OR bt <> 0 UNION ALL SELECT DISTINCT k, 'inf'::DOUBLE, 0.0, 0.0 FROM cnt)"""


_AUC = "sum(fp * (tps - tp / 2.0)) / nullif(max(pos) * max(neg), 0)"
_AP = "sum(tp / pos * (tps / (tps + fps)))"


def _counts(spark, d, keys=("run_name",)):
    return S.score_counts(runs(spark, d), keys)


@query(f"SELECT count(*) AS n, count(*) FILTER (image_id IS NULL) AS null_ids, count(*) - count(DISTINCT image_id) AS repeated_ids, count(*) FILTER (label NOT IN (0, 1)) AS bad_labels, count(*) FILTER (probability NOT BETWEEN 0 AND 1) AS bad_scores FROM ({pred_sql()})")
def scan_predictions(spark, d):
    return predictions(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("image_id").isNull()).alias("null_ids"), (F.count("*") - F.count_distinct("image_id")).alias("repeated_ids"), F.count_if(~F.col("label").isin(0, 1)).alias("bad_labels"), F.count_if(~F.col("probability").between(0, 1)).alias("bad_scores"))


@query(P + _curve("pred", "lesion_type") + f" SELECT k AS lesion_type, round({_AUC}, 6) AS auc FROM run GROUP BY k")
def roc_auc(spark, d):
    return S.rank_metrics(S.score_counts(predictions(spark, d), ["lesion_type"]), ["lesion_type"]).select("lesion_type", r6(F.col("auc")).alias("auc"))


@query(P + _curve("runs") + f" SELECT k AS run_name, round({_AP}, 6) AS average_precision FROM run GROUP BY k")
def average_precision(spark, d):
    return S.rank_metrics(_counts(spark, d), ["run_name"]).select("run_name", r6(F.col("average_precision")).alias("average_precision"))


@query(P + _curve("runs") + " SELECT k AS run_name, CASE WHEN isinf(threshold) THEN -1 ELSE threshold END AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
def roc_curve(spark, d):
    t = F.when(F.col("threshold") == float("inf"), -1.0).otherwise(F.col("threshold"))
    return S.roc_points(_counts(spark, d), ["run_name"]).select("run_name", t.alias("threshold"), r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


@query(P + _curve("runs") + " SELECT k AS run_name, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc WHERE k <> 'model' AND NOT isinf(threshold)")
def roc_subset(spark, d):
    chosen = runs(spark, d).filter(F.col("run_name").isin("model_seed7", "model_seed2026"))
    return S.roc_points(S.score_counts(chosen, ["run_name"]), ["run_name"]).filter(F.col("threshold") < float("inf")).select("run_name", "threshold", r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


@query(P + _curve("runs") + " SELECT k AS run_name, arg_max(threshold, (tpr - fpr, threshold)) AS threshold FROM roc GROUP BY k")
def youden(spark, d):
    return S.youden(S.roc_points(_counts(spark, d), ["run_name"]), ["run_name"])


@query(P + _curve("runs") + " SELECT k AS run_name, arg_min(threshold, (-tpr, threshold)) AS threshold FROM roc WHERE fpr <= 0.2 + 1e-12 AND NOT isinf(threshold) GROUP BY k")
def fixed_spec_threshold(spark, d):
    return S.threshold_at_specificity(S.roc_points(_counts(spark, d), ["run_name"]), 0.8, ["run_name"])


@query(P + _curve("runs") + " SELECT k AS run_name, threshold, round(tps / (tps + fps), 6) AS precision, round(tps / pos, 6) AS recall FROM run UNION ALL SELECT DISTINCT k, NULL, 1.0, 0.0 FROM cnt")
def pr_curve(spark, d):
    return S.pr_points(_counts(spark, d), ["run_name"]).select("run_name", "threshold", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


_PANEL = """n, tn, fp, fn, tp, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS ppv, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS npv, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


def _cells(t: str) -> str:
    return f"count(*) AS n, count(*) FILTER (probability < {t} AND label = 0) AS tn, count(*) FILTER (probability >= {t} AND label = 0) AS fp, count(*) FILTER (probability < {t} AND label = 1) AS fn, count(*) FILTER (probability >= {t} AND label = 1) AS tp"


RATES = ("accuracy", "sensitivity", "specificity", "ppv", "npv", "f1")


@query(P + f"c AS (SELECT run_name, {_cells('0.5')} FROM runs GROUP BY 1) SELECT run_name, {_PANEL} FROM c")
def metric_panel(spark, d):
    out = S.panel(runs(spark, d), F.lit(0.5), ["run_name"])
    return out.withColumns({c: r6(F.col(c)) for c in RATES})


@query(P + "q AS (SELECT *, greatest(1e-7, least(1 - 1e-7, probability)) AS c FROM runs) SELECT run_name, round(avg((probability - label) ** 2), 6) AS brier, round(avg(-ln(CASE label WHEN 1 THEN c ELSE 1 - c END)), 6) AS nll FROM q GROUP BY 1")
def prob_quality(spark, d):
    return S.prob_quality(runs(spark, d), ["run_name"]).select("run_name", r6(F.col("brier")).alias("brier"), r6(F.col("nll")).alias("nll"))


_BIN = " + ".join(f"(probability >= {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10))
_BINNED = f"bins AS (SELECT run_name, {_BIN} AS bin, count(*) AS n, avg(probability) AS mean_p, avg(label) AS mean_y FROM runs GROUP BY 1, 2)"


@query(P + _BINNED + " SELECT run_name, round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece FROM bins GROUP BY 1")
def ece(spark, d):
    return S.expected_calibration_error(S.calibration_bins(runs(spark, d), ["run_name"]), ["run_name"]).select("run_name", r6(F.col("ece")).alias("ece"))


@query(P + _BINNED + " SELECT run_name, bin, n, round(bin * 0.1 + 0.05, 6) AS centre, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM bins")
def reliability(spark, d):
    return S.calibration_bins(runs(spark, d), ["run_name"]).select("run_name", "bin", "n", r6(F.col("bin") * 0.1 + 0.05).alias("centre"), r6(F.col("mean_p")).alias("mean_p"), r6(F.col("mean_y")).alias("mean_y"))


@query(P + _curve("runs") + """, grid AS (SELECT 0.05::DOUBLE + i * 0.01::DOUBLE AS t FROM range(46) r(i)),
a AS (SELECT k, t, sum(tp) FILTER (threshold >= t) AS tps, sum(fp) FILTER (threshold >= t) AS fps, sum(tp) AS pos, sum(tp + fp) AS n FROM cnt, grid GROUP BY 1, 2)
SELECT k AS run_name, round(t, 6) AS t, round(coalesce(tps, 0) / n - coalesce(fps, 0) / n * (t / (1 - t + 1e-12)), 6) + 0 AS net_benefit, round(pos / n - (1 - pos / n) * (t / (1 - t + 1e-12)), 6) AS treat_all, 0.0::DOUBLE AS treat_none FROM a""")
def decision_curve(spark, d):
    out = S.decision_curve(_counts(spark, d), ["run_name"])
    return out.select("run_name", r6(F.col("t")).alias("t"), (r6(F.col("net_benefit")) + 0).alias("net_benefit"), r6(F.col("treat_all")).alias("treat_all"), "treat_none")


def _strata(col: str, dim: str) -> str:
    return P + _curve("pred", col) + f""", a AS (SELECT k, round({_AUC}, 6) AS auc FROM run GROUP BY k), c AS (SELECT {col} AS k, {_cells('0.5')} FROM pred GROUP BY 1), dim AS (SELECT unnest({dim}) AS {col})
SELECT {col}, coalesce(n, 0) AS n, CASE WHEN n >= 10 THEN round(tp / (tp + fn), 6) END AS sensitivity, CASE WHEN n >= 10 THEN round(tn / (tn + fp), 6) END AS specificity, CASE WHEN n >= 10 THEN auc END AS auc,
 CASE WHEN coalesce(n, 0) < 10 THEN 'n<10' END AS reason FROM dim LEFT JOIN c ON dim.{col} = c.k LEFT JOIN a ON dim.{col} = a.k"""


def _rounded(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("sensitivity", "specificity", "auc")})


@query(_strata("density", "[1, 2, 3, 4, 5]"))
def density_strata(spark, d):
    return _rounded(S.strata(predictions(spark, d), "density", [1, 2, 3, 4, 5], F.lit(0.5)))


@query(_strata("lesion_type", "['mass', 'calcification']"))
def lesion_strata(spark, d):
    return _rounded(S.strata(predictions(spark, d), "lesion_type", ["mass", "calcification"], F.lit(0.5)))


@query(P + "x AS (SELECT 1) SELECT run_name, density, round(avg((probability >= 0.5)::INT) FILTER (label = 1), 6) AS sensitivity FROM runs GROUP BY 1, 2")
def subgroup_sens(spark, d):
    hit = F.when(F.col("label") == 1, (F.col("probability") >= 0.5).cast("double"))
    return runs(spark, d).groupBy("run_name", "density").agg(r6(F.avg(hit)).alias("sensitivity"))


_FAULTY = """z AS (SELECT run_name, CASE WHEN image_id % 101 = 3 THEN NULL WHEN image_id % 103 = 4 THEN -1 ELSE image_id END AS image_id, CASE WHEN image_id % 107 = 5 THEN NULL ELSE patient_id END AS patient_id,
  CASE image_id % 109 WHEN 6 THEN 2 WHEN 7 THEN NULL ELSE label END AS label, CASE image_id % 113 WHEN 8 THEN NULL WHEN 9 THEN 'nan'::DOUBLE WHEN 10 THEN 'inf'::DOUBLE WHEN 11 THEN 1.5 WHEN 12 THEN -0.1 ELSE probability END AS probability FROM runs),
n AS (SELECT run_name, image_id, count(*) AS copies FROM z WHERE image_id IS NOT NULL GROUP BY 1, 2)"""


def _faulty(spark, d):
    """The runs with a fault of each kind planted."""
    i = F.col("image_id")
    p = F.when(i % 113 == 8, None).when(i % 113 == 9, float("nan")).when(i % 113 == 10, float("inf")).when(i % 113 == 11, 1.5).when(i % 113 == 12, -0.1).otherwise(F.col("probability"))
    label = F.when(i % 109 == 6, 2).when(i % 109 == 7, None).otherwise(F.col("label"))
    return runs(spark, d).select("run_name", F.when(i % 101 == 3, None).when(i % 103 == 4, -1).otherwise(i).alias("image_id"), F.when(i % 107 == 5, None).otherwise(F.col("patient_id")).alias("patient_id"), label.alias("label"), p.alias("probability"))


@query(P + _FAULTY + """ SELECT run_name, image_id, faults FROM (SELECT z.run_name, z.image_id, concat_ws(',', CASE WHEN z.image_id IS NULL OR patient_id IS NULL THEN 'no_id' END, CASE WHEN copies > 1 THEN 'repeated_id' END, CASE WHEN label IS NULL OR label NOT IN (0, 1) THEN 'label' END,
  CASE WHEN probability IS NULL OR isnan(probability) OR isinf(probability) THEN 'not_finite' WHEN probability < 0 OR probability > 1 THEN 'range' END) AS faults FROM z LEFT JOIN n ON n.run_name = z.run_name AND n.image_id = z.image_id) WHERE faults <> ''""")
def validate_scores(spark, d):
    """Scored rows with a fault of each kind planted, and every reason of a row."""
    return K.score_faults(_faulty(spark, d)).select("run_name", "image_id", F.array_join("faults", ",").alias("faults"))


@query(P + "z AS (SELECT CASE WHEN run_name = 'model' THEN 'model' ELSE 'rest' END AS run_name, seed, CASE WHEN run_name = 'model' THEN 1 ELSE label END AS label FROM runs) SELECT run_name, concat_ws(',', CASE WHEN count(DISTINCT label) < 2 THEN 'one_label' END, CASE WHEN count(DISTINCT seed) > 1 THEN 'mixed_seed' END) AS faults FROM z GROUP BY 1 HAVING count(DISTINCT label) < 2 OR count(DISTINCT seed) > 1")
def run_contract(spark, d):
    """A run of one label and one that mixes two seeds."""
    one = F.col("run_name") == "model"
    mixed = runs(spark, d).withColumns({"label": F.when(one, 1).otherwise(F.col("label")), "run_name": F.when(one, "model").otherwise("rest")})
    return K.run_faults(mixed, constant=["seed"]).select("run_name", F.array_join("faults", ",").alias("faults"))


@query(P + "x AS (SELECT 1) SELECT run_name, image_id, (probability >= 0.5)::INT AS predicted_label FROM runs")
def predicted_label(spark, d):
    return runs(spark, d).select("run_name", "image_id", (F.col("probability") >= 0.5).cast("int").alias("predicted_label"))


@query(P + "q AS (SELECT image_id, greatest(1e-7, least(1 - 1e-7, probability)) AS c FROM pred), z AS (SELECT image_id, ln(c / (1 - c)) AS logit FROM q) SELECT image_id, round(logit, 6) AS logit, round(1 / (1 + exp(-greatest(-60, least(60, logit / 1.25)))), 6) AS calibrated FROM z")
def calibrated_prob(spark, d):
    z = clipped_logit(F.col("probability"))
    return predictions(spark, d).select("image_id", r6(z).alias("logit"), r6(clipped_sigmoid(z, 1.25)).alias("calibrated"))


@query(P + "x AS (SELECT 1) SELECT p.image_id, p.patient_id, o.o_orderstatus AS view, p.probability, (p.probability >= 0.5)::INT AS predicted_label, NULL::INT AS birads FROM pred p JOIN orders o ON p.image_id = o.o_orderkey")
def prediction_frame(spark, d):
    meta = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderstatus").alias("view"))
    return predictions(spark, d).join(meta, "image_id").select("image_id", "patient_id", "view", "probability", (F.col("probability") >= 0.5).cast("int").alias("predicted_label"), F.lit(None).cast("int").alias("birads"))


@query(P + "s AS (SELECT image_id FROM pred WHERE density = 2) SELECT s.image_id, p.probability FROM s LEFT JOIN pred p USING (image_id)")
def subset_align(spark, d):
    full = predictions(spark, d)
    return full.filter("density = 2").select("image_id").join(full.select("image_id", "probability"), "image_id", "left")


@query(P + "a AS (SELECT * FROM runs WHERE run_name = 'model'), b AS (SELECT * FROM runs WHERE run_name = 'model_seed7') SELECT count(*) AS n, count(*) FILTER (a.image_id IS NULL OR b.image_id IS NULL) AS unmatched, count(*) FILTER (a.patient_id IS DISTINCT FROM b.patient_id OR a.label IS DISTINCT FROM b.label) AS differing FROM a FULL JOIN b ON a.image_id = b.image_id")
def paired_align(spark, d):
    r = runs(spark, d)
    a, b = r.filter("run_name = 'model'").alias("a"), r.filter("run_name = 'model_seed7'").alias("b")
    both = a.join(b, F.col("a.image_id") == F.col("b.image_id"), "full_outer")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("a.image_id").isNull() | F.col("b.image_id").isNull()).alias("unmatched"), F.count_if(~F.col("a.patient_id").eqNullSafe(F.col("b.patient_id")) | ~F.col("a.label").eqNullSafe(F.col("b.label"))).alias("differing"))


@query(P + "x AS (SELECT 1) SELECT image_id, count(*) AS members, round(avg(probability), 6) AS probability FROM runs GROUP BY 1")
def ensemble(spark, d):
    return runs(spark, d).groupBy("image_id").agg(F.count("*").alias("members"), r6(F.avg("probability")).alias("probability"))


@query(f"SELECT o_orderkey AS image_id, {u_sql('7', 'o_orderkey')} AS u FROM orders")
def keyed_uniform_(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), keyed_uniform(7, F.col("o_orderkey")).alias("u"))


RESAMPLES = 2000
_BOOT = f"""out AS (SELECT patient_id, max(label) AS outcome FROM pred GROUP BY 1),
num AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY patient_id) - 1 AS nth, count(*) OVER (PARTITION BY outcome) AS n FROM out),
draw AS (SELECT b, outcome, floor({u_sql('42', 'b', 'outcome', 'nth')} * n)::INT AS nth FROM num, range({RESAMPLES}) r(b)),
wt AS (SELECT b, patient_id, count(*) AS weight FROM draw JOIN num USING (outcome, nth) GROUP BY ALL)"""


def _rate(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0), 0)::DOUBLE"


def _loss(q: str) -> str:
    return f"-ln(CASE WHEN label = 1 THEN greatest(1e-7, least(1 - 1e-7, {q})) ELSE 1 - greatest(1e-7, least(1 - 1e-7, {q})) END)"


_VALUES = {
    "accuracy": "((tp + tn) / n)::DOUBLE", "sensitivity": _rate("tp", "tp + fn"), "specificity": _rate("tn", "tn + fp"), "ppv": _rate("tp", "tp + fp"), "npv": _rate("tn", "tn + fn"), "f1": _rate("2 * tp", "2 * tp + fp + fn"),
    "brier_score": "sq / n", "negative_log_likelihood": "lg / n", "calibrated_brier_score": "csq / n", "calibrated_negative_log_likelihood": "clg / n",
    "sensitivity_at_fixed_specificity": _rate("ftp", "tp + fn"), "specificity_at_fixed_specificity": _rate("ftn", "tn + fp"),
    "calcification_sensitivity_at_fixed_specificity": "(chit / nullif(cpos, 0))::DOUBLE", "dense_breast_sensitivity_at_fixed_specificity": "(dhit / nullif(dpos, 0))::DOUBLE",
}


def _boot_sql(src: str) -> str:
    """wt and val (run_name, b, metric, value): each metric from the resampled rows."""
    pos, neg, hit, fix = "label = 1", "label = 0", "probability >= threshold", "probability >= fixed"
    cells = {"tp": f"{hit} AND {pos}", "fp": f"{hit} AND {neg}", "fn": f"NOT {hit} AND {pos}", "tn": f"NOT {hit} AND {neg}", "ftp": f"{fix} AND {pos}", "ftn": f"NOT {fix} AND {neg}"}
    cells |= {"cpos": f"lesion_type = 'calcification' AND {pos}", "chit": f"lesion_type = 'calcification' AND {pos} AND {fix}", "dpos": f"density = 4 AND {pos}", "dhit": f"density = 4 AND {pos} AND {fix}"}
    sums = ", ".join(f"sum(weight) FILTER ({c}) AS {k}" for k, c in cells.items())
    zero = ", ".join(f"coalesce({k}, 0) AS {k}" for k in cells)
    long = " UNION ALL ".join(f"SELECT run_name, b, '{k}' AS metric, {v} AS value FROM lin" for k, v in _VALUES.items())
    return f"""{_BOOT}, {_curve(src)},
cut AS (SELECT k AS run_name, arg_max(threshold, (tpr - fpr, threshold)) AS threshold, arg_min(threshold, (-tpr, threshold)) FILTER (fpr <= 0.2 + 1e-12 AND NOT isinf(threshold)) AS fixed FROM roc GROUP BY 1),
x AS (SELECT s.*, threshold, fixed, 1 / (1 + exp(-ln(greatest(1e-7, least(1 - 1e-7, probability)) / (1 - greatest(1e-7, least(1 - 1e-7, probability)))) / 1.5)) AS calibrated FROM {src} s JOIN cut USING (run_name)),
raw AS (SELECT run_name, b, sum(weight) AS n, {sums}, sum(weight * (probability - label) ** 2) AS sq, sum(weight * {_loss("probability")}) AS lg, sum(weight * (calibrated - label) ** 2) AS csq, sum(weight * {_loss("calibrated")}) AS clg FROM x JOIN wt USING (patient_id) GROUP BY 1, 2),
lin AS (SELECT run_name, b, n, {zero}, sq, lg, csq, clg FROM raw),
bcnt AS (SELECT run_name, b, probability AS threshold, sum(label * weight) AS tp, sum((1 - label) * weight) AS fp FROM {src} JOIN wt USING (patient_id) GROUP BY ALL),
brun AS (SELECT *, sum(tp) OVER w AS tps, sum(fp) OVER w AS fps, sum(tp) OVER (PARTITION BY run_name, b) AS pos, sum(fp) OVER (PARTITION BY run_name, b) AS neg FROM bcnt WINDOW w AS (PARTITION BY run_name, b ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
rk AS (SELECT run_name, b, ({_AUC})::DOUBLE AS auc, ({_AP.replace("(tps / (tps + fps))", "(tps / nullif(tps + fps, 0))")})::DOUBLE AS ap FROM brun GROUP BY 1, 2),
val AS ({long} UNION ALL SELECT run_name, b, 'auc', auc FROM rk UNION ALL SELECT run_name, b, 'average_precision', ap FROM rk)"""


def _boot_values(spark, d, pred=None):
    """All metrics of each run and resample, at the run's own thresholds of all rows."""
    base = predictions(spark, d)
    pred = base if pred is None else pred
    roc = S.roc_points(S.score_counts(pred, ["run_name"]), ["run_name"])
    cut = S.youden(roc, ["run_name"]).join(S.threshold_at_specificity(roc, 0.8, ["run_name"]).withColumnRenamed("threshold", "fixed"), "run_name")
    full = pred.join(cut, "run_name").withColumn("calibrated", clipped_sigmoid(clipped_logit(F.col("probability")), 1.5))
    return B.metric_values(full, packed_vectors(base, RESAMPLES, 42), RESAMPLES, ["run_name"])


_INTERVALS = " SELECT run_name, metric, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, count(value) AS n_valid FROM val GROUP BY 1, 2"


def _intervals(values):
    return B.intervals(values, ["run_name", "metric"]).select("run_name", "metric", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n_valid")


@query(P + _boot_sql("pred") + _INTERVALS)
def bootstrap_ci(spark, d):
    return _intervals(_boot_values(spark, d))


_DIFF = f"d AS (SELECT metric, a.value - c.value AS v FROM val a JOIN val c USING (b, metric) WHERE a.run_name = 'model' AND c.run_name = 'model_seed7' AND metric IN {B.PAIRED})"


@query(P + _boot_sql("runs") + f", {_DIFF} SELECT metric, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(v) AS n_valid, round(least(1, 2 * least((count(*) FILTER (v <= 0) + 1) / (count(v) + 1), (count(*) FILTER (v >= 0) + 1) / (count(v) + 1))), 6) AS p FROM d GROUP BY 1")
def paired_ci(spark, d):
    v = _boot_values(spark, d, runs(spark, d).filter("run_name <> 'model_seed2026'")).filter(F.col("metric").isin(*B.PAIRED))
    out = B.paired(v.filter("run_name = 'model'"), v.filter("run_name = 'model_seed7'"), ["metric"])
    return out.select("metric", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n_valid", r6(F.col("p")).alias("p"))


@query(P + _curve("runs") + f", a AS (SELECT k AS run_name, {_AUC} AS value FROM run GROUP BY k) SELECT regexp_replace(run_name, '_seed[0-9]+$', '') AS \"group\", count(*) AS n_seeds, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high FROM a GROUP BY 1 HAVING count(*) >= 3")
def seed_repeats(spark, d):
    auc = S.rank_metrics(S.score_counts(runs(spark, d), ["run_name", "seed"]), ["run_name", "seed"]).withColumnRenamed("auc", "value")
    return B.seed_repeats(auc).select("group", "n_seeds", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "low", "high")])


@query(f"WITH s AS ({SPLITS_SQL}), bad AS (SELECT patient_id FROM s GROUP BY 1 HAVING bool_or(split = 'test') AND bool_or(split <> 'test')), t AS (SELECT 'full' AS run_name, probability, label FROM s WHERE split = 'test' UNION ALL SELECT 'clean', probability, label FROM s WHERE split = 'test' AND patient_id NOT IN (SELECT patient_id FROM bad)), " + _curve("t") + f" SELECT k AS subset, round({_AUC}, 6) AS auc, max(pos + neg)::BIGINT AS n FROM run GROUP BY 1")
def leakage_shift(spark, d):
    from ..operators.cohort import overlap_ledger

    s = splits(spark, d)
    bad = overlap_ledger(s).select("patient_id", F.lit(True).alias("leaks")).distinct()
    test = s.filter("split = 'test'").join(bad, "patient_id", "left")
    tags = F.when(F.col("leaks"), F.array(F.lit("full"))).otherwise(F.array(F.lit("full"), F.lit("clean")))
    tagged = test.withColumn("subset", F.explode(tags))
    return S.rank_metrics(S.score_counts(tagged, ["subset"]), ["subset"]).select("subset", r6(F.col("auc")).alias("auc"), (F.col("pos") + F.col("neg")).alias("n"))


PAIRS = (("model", "model_seed7"), ("model_seed2026", "model"))


def _population_sql(sub: str, rows: str) -> str:
    """{sub}v (k, b, auc) and {sub}e (k, n_cases, n_patients, auc): the runs' rows of one population, with resamples of its own patients."""
    return f"""{sub}x AS (SELECT run_name AS k, patient_id, label, probability FROM {rows}),
{sub}o AS (SELECT patient_id, max(label) AS outcome FROM {sub}x WHERE k = 'model' GROUP BY 1),
{sub}n AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY patient_id) - 1 AS nth, count(*) OVER (PARTITION BY outcome) AS n FROM {sub}o),
{sub}d AS (SELECT b, outcome, floor({u_sql('42', 'b', 'outcome', 'nth')} * n)::INT AS nth FROM {sub}n, range({RESAMPLES}) r(b)),
{sub}w AS (SELECT b, patient_id, count(*) AS weight FROM {sub}d JOIN {sub}n USING (outcome, nth) GROUP BY ALL),
{sub}c AS (SELECT k, b, probability AS threshold, sum(label * weight) AS tp, sum((1 - label) * weight) AS fp FROM {sub}x JOIN {sub}w USING (patient_id) GROUP BY ALL),
{sub}r AS (SELECT *, sum(tp) OVER w AS tps, sum(tp) OVER (PARTITION BY k, b) AS pos, sum(fp) OVER (PARTITION BY k, b) AS neg FROM {sub}c WINDOW w AS (PARTITION BY k, b ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
{sub}v AS (SELECT k, b, ({_AUC})::DOUBLE AS auc FROM {sub}r GROUP BY 1, 2),
{sub}1 AS (SELECT k, probability AS threshold, sum(label)::BIGINT AS tp, sum(1 - label)::BIGINT AS fp FROM {sub}x GROUP BY ALL),
{sub}2 AS (SELECT *, sum(tp) OVER w AS tps, sum(tp) OVER (PARTITION BY k) AS pos, sum(fp) OVER (PARTITION BY k) AS neg FROM {sub}1 WINDOW w AS (PARTITION BY k ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
{sub}e AS (SELECT k, n_cases, n_patients, auc FROM (SELECT k, ({_AUC})::DOUBLE AS auc FROM {sub}2 GROUP BY 1) JOIN (SELECT k, count(*) AS n_cases, count(DISTINCT patient_id) AS n_patients FROM {sub}x GROUP BY 1) USING (k))"""


_POPULATIONS = f"""WITH runs AS ({RUNS_SQL}), s AS ({SPLITS_SQL}), bad AS (SELECT patient_id FROM s GROUP BY 1 HAVING bool_or(split = 'test') AND bool_or(split <> 'test')),
alltest AS (SELECT r.* FROM runs r JOIN s USING (image_id) WHERE s.split = 'test'), cleantest AS (SELECT * FROM alltest WHERE patient_id NOT IN (SELECT patient_id FROM bad)),
{_population_sql("f", "alltest")}, {_population_sql("c", "cleantest")}"""


def _populations(spark, d):
    """(name, rows, AUC of each resample) of all test rows and of those without patients of development splits."""
    from ..operators.cohort import clean, overlap_ledger

    rows = _split_runs(spark, d, "test")
    for name, own in (("full", rows), ("clean", clean(rows, overlap_ledger(splits(spark, d))))):
        own = cut(own)
        counts = own.groupBy("run_name", "patient_id", F.col("probability").alias("threshold")).agg(F.sum("label").alias("tp"), F.sum(1 - F.col("label")).alias("fp"))
        yield name, own, cut(rank_sums(counts, packed_vectors(own.filter("run_name = 'model'"), RESAMPLES, 42), ["run_name"], RESAMPLES).select("run_name", "b", F.col("auc").alias("value")))


@query(_POPULATIONS + ", " + ", ".join(f"{x}i AS (SELECT k, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi FROM {x}v GROUP BY 1)" for x in "fc") + " " + " UNION ALL ".join(f"SELECT '{name}' AS subset, k AS run_name, n_cases, n_patients, round(auc, 6) AS auc, round(lo, 6) AS lo, round(hi, 6) AS hi FROM {x}e JOIN {x}i USING (k)" for x, name in (("f", "full"), ("c", "clean"))))
def leakage_intervals(spark, d):
    """AUC with its interval of every run, on all test rows and without the patients that leak."""
    out = []
    for name, rows, values in _populations(spark, d):
        size = rows.groupBy("run_name").agg(F.count("*").alias("n_cases"), F.count_distinct("patient_id").alias("n_patients"))
        auc = S.rank_metrics(S.score_counts(rows, ["run_name"]), ["run_name"]).select("run_name", r6(F.col("auc")).alias("auc"))
        span = B.intervals(values, ["run_name"]).select("run_name", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))
        out.append(size.join(auc, "run_name").join(span, "run_name").select(F.lit(name).alias("subset"), "run_name", "n_cases", "n_patients", "auc", "lo", "hi"))
    return out[0].unionByName(out[1])


@query(_POPULATIONS + ", " + ", ".join(f"{x}p AS (SELECT p.first || '__minus__' || p.second AS pair, a.auc - z.auc AS v FROM {x}v a JOIN {x}v z USING (b) JOIN (SELECT unnest([{', '.join(repr(p[0]) for p in PAIRS)}]) AS first, unnest([{', '.join(repr(p[1]) for p in PAIRS)}]) AS second) p ON p.first = a.k AND p.second = z.k)" for x in "fc") + " " + " UNION ALL ".join(f"SELECT '{name}' AS subset, pair, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(v) AS n_valid, round(least(1, 2 * least((count(*) FILTER (v <= 0) + 1) / (count(v) + 1), (count(*) FILTER (v >= 0) + 1) / (count(v) + 1))), 6) AS p FROM {x}p GROUP BY pair" for x, name in (("f", "full"), ("c", "clean"))))
def leakage_pairs(spark, d):
    """The differences of two central pairs of runs, on both populations."""
    out = []
    for name, _, values in _populations(spark, d):
        for first, second in PAIRS:
            got = B.paired(values.filter(F.col("run_name") == first), values.filter(F.col("run_name") == second))
            out.append(got.select(F.lit(name).alias("subset"), F.lit(f"{first}__minus__{second}").alias("pair"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n_valid", r6(F.col("p")).alias("p")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _temperature_sql(src: str, rounds: int) -> str:
    """tmp (k, t, nll) of src (k, probability, label): the same grid, round by round."""
    step, mid = (log(20.0) - log(0.05)) / 40, (log(0.05) + log(20.0)) / 2
    safe = "greatest(1e-7, least(1 - 1e-7, probability))"
    out = f"zz AS (SELECT k, ln({safe} / (1 - {safe})) AS z, label AS y, count(*) AS n FROM {src} GROUP BY ALL), m0 AS (SELECT DISTINCT k, {mid!r}::DOUBLE AS mid, 0::DOUBLE AS nll FROM zz)"
    for r in range(rounds + 1):
        loss = "greatest(z / t, 0) - z / t * y + ln(1 + exp(-abs(z / t)))"
        out += f""", g{r} AS (SELECT k, mid, i, exp(mid + (i - 20) * {step!r}::DOUBLE) AS t FROM m{r}, range(41) r(i)),
e{r} AS (SELECT k, mid, i, sum(n * ({loss})) / sum(n) AS nll FROM zz JOIN g{r} USING (k) GROUP BY ALL),
m{r + 1} AS (SELECT k, arg_min(mid + (i - 20) * {step!r}::DOUBLE, (nll, i)) AS mid, min(nll) AS nll FROM e{r} GROUP BY 1)"""
        step /= 20
    return out + f", tmp AS (SELECT k, exp(mid) AS t, nll FROM m{rounds + 1})"


@query(P + "src AS (SELECT run_name AS k, probability, label FROM runs), " + _temperature_sql("src", A.ROUNDS) + " SELECT k AS run_name, round(t, 4) AS temperature, round(nll, 6) AS nll FROM tmp")
def temperature(spark, d):
    scored = runs(spark, d).withColumn("logit", clipped_logit(F.col("probability")))
    return S.fit_temperature(scored, ["run_name"], rounds=A.ROUNDS).select("run_name", F.round("temperature", 4).alias("temperature"), r6(F.col("nll")).alias("nll"))


STRATA = {"density": (1, 2, 3, 4, 9), "lesion_type": ("mass", "calcification", "mixed")}


def _split_runs(spark, d, split: str):
    """The runs' rows of one split of the base cohort."""
    return runs(spark, d).join(splits(spark, d).filter(F.col("split") == split).select("image_id"), "image_id")


def _points_sql(cells: str, item: str, src: str, threshold: str) -> str:
    rates = {"accuracy": "(tp + tn) / n", "sensitivity": "coalesce(tp / nullif(tp + fn, 0), 0)", "specificity": "coalesce(tn / nullif(tn + fp, 0), 0)", "ppv": "coalesce(tp / nullif(tp + fp, 0), 0)", "npv": "coalesce(tn / nullif(tn + fn, 0), 0)", "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"}
    each = ", ".join(f"{{'i': '{k}', 'v': ({v})::DOUBLE}}" for k, v in rates.items())
    return f"SELECT k, '{item}.' || u.i AS item, u.v AS value FROM (SELECT k, unnest([{each}]) AS u FROM (SELECT k, {_cells(threshold)} FROM {src} GROUP BY 1))"


def _audit_sql(test: str, validation: str | None, locked: str) -> str:
    """rec (k, item, value) of test rows x (k, patient_id, density, lesion_type, label, probability) at lck (k, threshold, fixed, t, nll_before, nll_after)."""
    q = "greatest(1e-7, least(1 - 1e-7, {0}))"
    logit = f"ln({q.format('probability')} / (1 - {q.format('probability')}))"
    sql = f"""x AS (SELECT s.*, threshold, fixed, t, 1 / (1 + exp(-{logit} / t)) AS calibrated FROM {test} s JOIN {locked} USING (k))"""
    out = ["SELECT k, u.i AS item, u.v AS value FROM (SELECT k, unnest([{'i': 'n_cases', 'v': count(*)::DOUBLE}, {'i': 'n_patients', 'v': count(DISTINCT patient_id)::DOUBLE}, {'i': 'n_positive', 'v': sum(label)::DOUBLE}, {'i': 'prevalence', 'v': avg(label)::DOUBLE}]) AS u FROM x GROUP BY 1)"]
    names = {"threshold": "threshold", "fixed": "fixed", "temperature": "t"} | ({"nll_before": "nll_before", "nll_after": "nll_after"} if validation else {})
    out += [f"SELECT k, 'locked.{n}', {c} FROM {locked}" for n, c in names.items()]
    for i, (name, p) in enumerate((("raw", "probability"), ("calibrated", "calibrated"))):
        sql += f""", c{i} AS (SELECT k, {p} AS threshold, sum(label)::BIGINT AS tp, sum(1 - label)::BIGINT AS fp FROM x GROUP BY ALL),
r{i} AS (SELECT *, sum(tp) OVER w AS tps, sum(fp) OVER w AS fps, sum(tp) OVER (PARTITION BY k) AS pos, sum(fp) OVER (PARTITION BY k) AS neg FROM c{i} WINDOW w AS (PARTITION BY k ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
b{i} AS (SELECT k, {_BIN.replace("probability", p)} AS bin, count(*) AS n, avg({p}) AS mean_p, avg(label) AS mean_y FROM x GROUP BY 1, 2)"""
        out += [f"SELECT k, '{name}.auc', {_AUC} FROM r{i} GROUP BY 1", f"SELECT k, '{name}.average_precision', {_AP} FROM r{i} GROUP BY 1"]
        out += [f"SELECT k, '{name}.brier', avg(({p} - label) ** 2) FROM x GROUP BY 1", f"SELECT k, '{name}.nll', avg(-ln(CASE label WHEN 1 THEN {q.format(p)} ELSE 1 - {q.format(p)} END)) FROM x GROUP BY 1"]
        out += [f"SELECT k, '{name}.ece', sum(n * abs(mean_p - mean_y)) / sum(n) FROM b{i} GROUP BY 1"]
    out += [f"SELECT k, 'reliability.' || bin || '.{n}', {c}::DOUBLE FROM b1" for n, c in (("n", "n"), ("pred", "mean_p"), ("obs", "mean_y"))]
    sql += """, d AS (SELECT k, i, 0.05::DOUBLE + i * 0.01::DOUBLE AS o, sum(tp) FILTER (threshold >= 0.05::DOUBLE + i * 0.01::DOUBLE) AS tps, sum(fp) FILTER (threshold >= 0.05::DOUBLE + i * 0.01::DOUBLE) AS fps, sum(tp) AS pos, sum(tp + fp) AS n FROM c1, range(46) g(i) GROUP BY 1, 2)"""
    odds = "o / (1 - o + 1e-12)"
    out += [f"SELECT k, 'decision.' || i || '.net_benefit', coalesce(tps, 0) / n - coalesce(fps, 0) / n * {odds} FROM d", f"SELECT k, 'decision.' || i || '.treat_all', pos / n - (1 - pos / n) * {odds} FROM d"]
    for start, cut in (("", "threshold"), ("fixed.", "fixed")):
        out.append(_points_sql("", f"{start}test", "x", cut))
        for column, levels in STRATA.items():
            tag = f"{column[0]}{cut[0]}"
            sql += f""", {tag} AS (SELECT k, {column}::VARCHAR AS level, {_cells(cut)} FROM x GROUP BY 1, 2),
{tag}c AS (SELECT k, {column}::VARCHAR AS level, probability AS threshold, sum(label)::BIGINT AS tp, sum(1 - label)::BIGINT AS fp FROM x GROUP BY ALL),
{tag}r AS (SELECT *, sum(tp) OVER w AS tps, sum(tp) OVER (PARTITION BY k, level) AS pos, sum(fp) OVER (PARTITION BY k, level) AS neg FROM {tag}c WINDOW w AS (PARTITION BY k, level ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
{tag}a AS (SELECT k, level, {_AUC} AS auc FROM {tag}r GROUP BY 1, 2),
{tag}l AS (SELECT DISTINCT k, unnest([{", ".join(f"'{v}'" for v in levels)}]) AS level FROM x),
{tag}v AS (SELECT l.k, l.level, coalesce(n, 0) AS n, auc, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(tp / nullif(tp + fp, 0), 0) AS ppv FROM {tag}l l LEFT JOIN {tag} s ON s.k = l.k AND s.level = l.level LEFT JOIN {tag}a a ON a.k = l.k AND a.level = l.level)"""
            out.append(f"SELECT k, '{start}{column}.' || level || '.n', n::DOUBLE FROM {tag}v")
            out += [f"SELECT k, '{start}{column}.' || level || '.{c}', {c}::DOUBLE FROM {tag}v WHERE n >= 10" for c in ("auc", "accuracy", "sensitivity", "specificity", "ppv")]
    if validation:
        sql += f", vx AS (SELECT s.*, fixed FROM {validation} s JOIN {locked} USING (k))"
        out.append(_points_sql("", "fixed.validation", "vx", "fixed"))
    return sql + ", rec AS (" + " UNION ALL ".join(out) + ")"


_LOCKED = f"""{_curve("val", "k")}, {_temperature_sql("val", A.ROUNDS)},
qv AS (SELECT k, avg(-ln(CASE label WHEN 1 THEN greatest(1e-7, least(1 - 1e-7, probability)) ELSE 1 - greatest(1e-7, least(1 - 1e-7, probability)) END)) AS nll_before FROM val GROUP BY 1),
best AS (SELECT k, max(tpr) AS top FROM roc WHERE fpr <= 0.2 + 1e-12 AND NOT isinf(threshold) GROUP BY 1),
lck AS (SELECT r.k, arg_max(threshold, (tpr - fpr, threshold)) AS threshold, min(threshold) FILTER (fpr <= 0.2 + 1e-12 AND NOT isinf(threshold) AND abs(tpr - top) <= 1e-8 + 1e-5 * top) AS fixed, any_value(tmp.t) AS t, any_value(nll_before) AS nll_before, any_value(tmp.nll) AS nll_after FROM roc r JOIN best ON best.k = r.k JOIN tmp ON tmp.k = r.k JOIN qv ON qv.k = r.k GROUP BY 1)"""
_BY_SPLIT = f"WITH runs AS ({RUNS_SQL}), s AS ({SPLITS_SQL}), both_ AS (SELECT r.run_name AS k, r.patient_id, r.density, r.lesion_type, r.label, r.probability, s.split FROM runs r JOIN s USING (image_id)), val AS (SELECT * FROM both_ WHERE split = 'val'), tst AS (SELECT * FROM both_ WHERE split = 'test'), "


@query(_BY_SPLIT + _LOCKED + ", " + _audit_sql("tst", "val", "lck") + " SELECT k AS run_name, item, round(value, 5) AS value FROM rec WHERE value IS NOT NULL")
def run_audit(spark, d):
    """The whole record of each run: points and temperature from validation rows, all else from test rows."""
    val = _split_runs(spark, d, "val")
    locked = cut(A.locked_points(val, ["run_name"]))
    out = A.audit_record(_split_runs(spark, d, "test"), locked, ["run_name"], STRATA, val)
    return out.select("run_name", "item", F.round("value", 5).alias("value"))


@query(P + _curve("runs", "run_name || '|' || density") + f""", c AS (SELECT run_name, density::VARCHAR AS level, {_cells("0.5")} FROM runs GROUP BY 1, 2), a AS (SELECT k, {_AUC} AS auc FROM run GROUP BY k),
l AS (SELECT DISTINCT run_name, unnest(['1', '2', '3', '4', '9']) AS level FROM runs)
SELECT l.run_name, l.level, coalesce(n, 0) AS n, round(auc, 4) AS auc, round((tp + tn) / n, 4) AS accuracy, round(tp / (tp + fn), 4) AS sensitivity, round(tn / (tn + fp), 4) AS specificity, round(tp / (tp + fp), 4) AS ppv, CASE WHEN n IS NULL THEN 'n<10' END AS reason
FROM l LEFT JOIN c USING (run_name, level) LEFT JOIN a ON a.k = l.run_name || '|' || l.level""")
def strata_table(spark, d):
    """Strata of each run for print, one of which has no rows."""
    rows = runs(spark, d).withColumn("cut", F.lit(0.5))
    return A.strata_table(A.strata_rows(rows, ["run_name"], "density", STRATA["density"], "cut"), ["run_name"])


_OUTSIDE = "tst AS (SELECT 'outside' AS k, o_custkey AS patient_id, (o_orderkey % 4 + 1)::INT AS density, CASE o_orderstatus WHEN 'F' THEN 'mass' WHEN 'O' THEN 'calcification' ELSE 'mixed' END AS lesion_type, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS label, round(0.8 * " + u_sql("99", "o_orderkey") + " + 0.15 * (o_orderpriority = '1-URGENT')::INT, 3) AS probability FROM orders WHERE o_orderkey % 5 = 0)"
_INSIDE = f"WITH s AS ({SPLITS_SQL}), val AS (SELECT 'outside' AS k, patient_id, density, lesion_type, label, probability FROM s WHERE split = 'val'), "


@query(_INSIDE + _LOCKED + f", {_OUTSIDE}, " + _audit_sql("tst", None, "lck") + " SELECT k AS cohort, item, round(value, 5) AS value FROM rec WHERE value IS NOT NULL")
def external_record(spark, d):
    """The record of a cohort with other labels and scores, at points and a temperature from within; nothing is fitted on it."""
    cohort, val = _outside(spark, d)
    locked = cut(A.locked_points(val, ["cohort"]).drop("nll_before", "nll_after"))
    return A.audit_record(cohort, locked, ["cohort"], STRATA).select("cohort", "item", F.round("value", 5).alias("value"))


def _outside(spark, d):
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    p = F.round(0.8 * keyed_uniform(99, F.col("o_orderkey")) + 0.15 * (F.col("o_orderpriority") == "1-URGENT").cast("int"), 3)
    kind = F.when(F.col("o_orderstatus") == "F", "mass").when(F.col("o_orderstatus") == "O", "calcification").otherwise("mixed")
    cohort = table(spark, d, "orders").filter("o_orderkey % 5 = 0").select(F.lit("outside").alias("cohort"), F.col("o_custkey").alias("patient_id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("density"), kind.alias("lesion_type"), high.alias("label"), p.alias("probability"))
    return cohort, splits(spark, d).filter("split = 'val'").withColumn("cohort", F.lit("outside"))


@query(f"WITH s AS ({SPLITS_SQL}), v AS (SELECT * FROM s WHERE split = 'val'), " + _curve("v") + f", lock AS (SELECT arg_min(threshold, (-tpr, threshold)) AS t FROM roc WHERE fpr <= 0.2 + 1e-12 AND NOT isinf(threshold)), c AS (SELECT {_cells('t')} FROM s, lock WHERE split = 'test') SELECT {_PANEL} FROM c")
def external_audit(spark, d):
    """The threshold is fixed on validation rows and transferred, nothing is fitted on test rows."""
    s = splits(spark, d)
    val = s.filter("split = 'val'")
    locked = S.threshold_at_specificity(S.roc_points(S.score_counts(val, ["run_name"]), ["run_name"]), 0.8, ["run_name"]).select(F.col("threshold").alias("t"))
    out = S.panel(s.filter("split = 'test'").join(F.broadcast(locked)), F.col("t"))
    return out.withColumns({c: r6(F.col(c)) for c in RATES})


@query(P + _boot_sql("runs") + _INTERVALS)
def statistics(spark, d):
    """Intervals of all metrics and runs over shared resamples."""
    return _intervals(_boot_values(spark, d, runs(spark, d)))


_CELLS = """e AS (SELECT vec_id AS case_id, unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings), c AS (SELECT case_id, pos, least(1, greatest(4 * v::DOUBLE, 0)) AS v, pos // 8 AS y, pos % 8 AS x, (pos // 8 BETWEEN 2 AND 5 AND pos % 8 BETWEEN 2 AND 5) AS inside FROM e),
s AS (SELECT case_id, arg_max(inside, (v, -pos)) AS hit, sum(v) FILTER (inside) / sum(v) AS energy, max(v) AS top FROM c GROUP BY 1),
i AS (SELECT case_id, coalesce(count(*) FILTER (v >= 0.5 AND inside) / nullif(count(*) FILTER (v >= 0.5 OR inside), 0), 0) AS iou FROM c GROUP BY 1)"""


def _heat(spark, d):
    from ..operators.regions import heatmap_stats

    cells = table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), F.posexplode("embedding").alias("pos", "e")).select("case_id", "pos", F.floor(F.col("pos") / 8).alias("y"), (F.col("pos") % 8).alias("x"), F.least(F.lit(1.0), F.greatest(4 * F.col("e").cast("double"), F.lit(0.0))).alias("v"), F.lit(8.0).alias("side"))
    return heatmap_stats(cells.withColumn("inside", F.col("y").between(2, 5) & F.col("x").between(2, 5)))


@query(f"WITH {_CELLS} SELECT case_id, hit, round(energy, 6) AS energy, round(iou, 6) AS iou FROM s JOIN i USING (case_id)")
def heatmap_roi(spark, d):
    return _heat(spark, d).select("case_id", "hit", r6(F.col("energy")).alias("energy"), r6(F.col("iou")).alias("iou"))


@query(f"WITH {_CELLS} SELECT count(*) AS n, round(avg(hit::INT), 6) AS hit_rate, round(avg(energy), 6) AS mean_energy, round(stddev_pop(iou), 6) AS sd_iou FROM s JOIN i USING (case_id) WHERE top > 0")
def heatmap_panel(spark, d):
    return _heat(spark, d).filter("not degenerate").agg(F.count("*").alias("n"), r6(F.avg(F.col("hit").cast("int"))).alias("hit_rate"), r6(F.avg("energy")).alias("mean_energy"), r6(F.stddev_pop("iou")).alias("sd_iou"))

