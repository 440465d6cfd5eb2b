"""Evidence checks and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import r6
from ..operators import contracts as K
from ..operators import evidence as E
from ..operators import scores as S
from ..sources.tables import read_runs, scratch
from . import score_queries as Q
from .views import RUNS_SQL, SPLITS_SQL, runs, splits, table

ALL: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        ALL[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT url AS path, html IS NOT NULL AS exists, octet_length(encode(coalesce(html, ''))) AS size_bytes, sha256(coalesce(html, '')) AS sha256 FROM pages")
def content_hash(spark, d):
    return E.content_hashes(table(spark, d, "pages"), "url", "html")


_FILES = "f AS (SELECT url AS path, sha256(coalesce(html, '')) AS h, page_id % 5 AS folder FROM pages)"


@query(f"WITH {_FILES}, l AS (SELECT folder, path || chr(31) || h || chr(10) AS line, path, h FROM f) SELECT folder, count(*) AS n, sha256(string_agg(line, '' ORDER BY path, h)) AS digest FROM l GROUP BY 1")
def tree_digest(spark, d):
    files = E.content_hashes(table(spark, d, "pages").withColumn("folder", F.col("page_id") % 5), "url", "html", ["folder"])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: F.concat(f["path"], F.lit("\x1f"), f["sha256"], F.lit("\n")))
    return files.groupBy("folder").agg(F.count("*").alias("n"), F.sha2(F.array_join(lines, ""), 256).alias("digest"))


@query("SELECT url AS path, CASE WHEN page_id % 11 = 0 THEN 'missing' ELSE 'changed' END AS reason FROM pages WHERE page_id % 11 = 0 OR page_id % 7 = 0")
def verify_hashes(spark, d):
    pages = table(spark, d, "pages")
    recorded = pages.select("page_id", F.col("url").alias("path"), F.when(F.col("page_id") % 7 == 0, "0").otherwise(F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)).alias("sha256"))
    there = pages.filter(F.coalesce(F.col("page_id") % 11 != 0, F.lit(True)))
    return E.verify_hashes(recorded, E.content_hashes(there, "url", "html", ["page_id"]), ["page_id", "path"]).select("path", "reason")


@query("""WITH r AS (SELECT CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE 'abc' END AS commit_id, CASE WHEN c_custkey % 60 = 9 THEN 'sync' ELSE 'git' END AS source, 'v3' AS preprocessing, c_nationkey::VARCHAR AS evaluation FROM customer),
c AS (SELECT 'commit_id' AS check, count(DISTINCT commit_id) AS n_values, count(*) FILTER (commit_id IS NULL) AS n_null FROM r UNION ALL SELECT 'source', count(DISTINCT source), count(*) FILTER (source IS NULL) FROM r
UNION ALL SELECT 'preprocessing', count(DISTINCT preprocessing), count(*) FILTER (preprocessing IS NULL) FROM r UNION ALL SELECT 'evaluation', count(DISTINCT evaluation), count(*) FILTER (evaluation IS NULL) FROM r)
SELECT * FROM c WHERE n_values <> 1 OR n_null > 0""")
def freeze_checks(spark, d):
    """Run records of which some lack a commit, some have another source, and all the same code but for one part."""
    k = F.col("c_custkey")
    records = table(spark, d, "customer").select(F.when(k % 50 != 7, "abc").alias("commit_id"), F.when(k % 60 == 9, "sync").otherwise("git").alias("source"), F.lit("v3").alias("preprocessing"), F.col("c_nationkey").cast("string").alias("evaluation"))
    return E.homogeneous(records, ["commit_id", "source", "preprocessing", "evaluation"])


@query("WITH s AS (SELECT DISTINCT o_custkey AS model FROM orders WHERE o_orderkey % 3 > 0 UNION SELECT -s_suppkey FROM supplier WHERE s_suppkey % 7 = 0) SELECT coalesce(c_custkey, model) AS model, CASE WHEN model IS NULL THEN 'left' ELSE 'right' END AS side FROM customer FULL JOIN s ON c_custkey = model WHERE c_custkey IS NULL OR model IS NULL")
def freeze_models(spark, d):
    """Models that only the metrics (left) or only the statistics (right) hold."""
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("model"))
    right = table(spark, d, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("model"))
    more = table(spark, d, "supplier").filter("s_suppkey % 7 = 0").select((-F.col("s_suppkey")).alias("model"))
    return E.set_differences(left, right.unionByName(more), "model")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN c_nationkey < 5 THEN 'commit,source' ELSE 'commit' END ELSE 'source' END AS missing FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey < 5")
def freeze_complete(spark, d):
    """Run records without a commit or a source."""
    commit = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    source = F.when(F.col("c_nationkey") < 5, " ").otherwise(F.col("c_nationkey").cast("string"))
    return E.incomplete(table(spark, d, "customer").select("c_custkey", commit.alias("commit"), source.alias("source")), "c_custkey", ["commit", "source"])


@query("""WITH r AS (SELECT c_custkey AS model, c_custkey % 20 AS g, c_acctbal AS t FROM customer)
SELECT model, CASE g WHEN 1 THEN 'no_record' WHEN 2 THEN 'no_sidecar' WHEN 3 THEN 'threshold_drift' WHEN 4 THEN 'no_threshold' WHEN 5 THEN 'no_fixed_specificity' WHEN 6 THEN 'no_temperature' WHEN 7 THEN 'temperature_not_positive' WHEN 8 THEN 'no_fixed_specificity,no_temperature' END AS faults FROM r WHERE g BETWEEN 1 AND 8""")
def locked_point(spark, d):
    """Records and sidecars of runs with a fault of each kind planted, and some that differ by less than counts."""
    runs_ = table(spark, d, "customer").select(F.col("c_custkey").alias("model"), (F.col("c_custkey") % 20).alias("g"), F.col("c_acctbal").cast("double").alias("t"))
    g = F.col("g")
    fixed = F.struct(F.when(~g.isin(5, 8), 0.8).alias("target"), F.lit(0.6).alias("threshold"))
    temperature = F.struct(F.when(g == 7, -1.0).when(~g.isin(6, 8), 1.25).alias("temperature"))
    records = runs_.filter(g != 1).select("model", F.when(g != 4, F.col("t")).alias("val_threshold"), fixed.alias("fixed_specificity"), temperature.alias("calibration"))
    sidecars = runs_.filter(g != 2).select("model", F.when(g == 3, F.col("t") + 1e-6).when(g == 9, F.col("t") + 1e-10).otherwise(F.col("t")).alias("youden_j"))
    return K.locked_point_faults(runs_, records, sidecars).select("model", F.array_join("faults", ",").alias("faults"))


@query("""WITH r AS (SELECT c_custkey AS model, c_custkey % 30 AS g FROM customer)
SELECT model, CASE g WHEN 1 THEN 'calibration' WHEN 2 THEN 'fixed_specificity.density_strata' WHEN 3 THEN 'fixed_specificity,fixed_specificity.density_strata' WHEN 4 THEN 'provenance.version<3' WHEN 5 THEN 'provenance.git.dirty' WHEN 6 THEN 'calibration,provenance.git.dirty' END AS missing FROM r WHERE g BETWEEN 1 AND 6""")
def audit_complete(spark, d):
    """Nested run records that lack a block, or part of one, or are old or of a dirty tree."""
    g = F.col("c_custkey") % 30
    fixed = F.when(g != 3, F.struct(F.lit(0.8).alias("target"), F.when(g != 2, F.array(F.lit(1))).alias("density_strata")))
    provenance = F.struct(F.when(g == 4, 2).otherwise(3).alias("version"), F.struct(g.isin(5, 6).alias("dirty")).alias("git"))
    records = table(spark, d, "customer").select(F.col("c_custkey").alias("model"), F.when(~g.isin(1, 6), F.struct(F.lit(1.2).alias("temperature"))).alias("calibration"), fixed.alias("fixed_specificity"), provenance.alias("provenance"))
    return K.incomplete_records(records, "model", ["calibration", "fixed_specificity", "fixed_specificity.density_strata"], 3).select("model", F.array_join("missing", ",").alias("missing"))


@query("SELECT c_custkey AS model, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS auc FROM customer")
def upsert_runs(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("model"), F.col("c_acctbal").alias("auc"))
    return E.upsert(old, old.filter("model % 10 = 0").withColumn("auc", F.lit(0.0)))


@query(f"WITH r AS ({RUNS_SQL}), q AS (SELECT run_name, round(avg((probability - label) ** 2), 6) AS brier, count(*) AS n FROM r GROUP BY 1) SELECT run_name, CASE WHEN run_name <> 'model' THEN brier END AS brier, n, CASE WHEN run_name = 'model_seed7' THEN 0.8 END AS target FROM q")
def scan_runs(spark, d):
    """Nested records written as JSON files and read by their schema: one lacks its test block, two a block that the schema has."""
    folder = f"{scratch(spark, 'runs')}/store"
    each = S.prob_quality(runs(spark, d), ["run_name"]).join(runs(spark, d).groupBy("run_name").agg(F.count("*").alias("n")), "run_name")
    test = F.when(F.col("run_name") != "model", F.struct(r6(F.col("brier")).alias("brier"), F.lit("x").alias("not_in_schema")))
    fixed = F.when(F.col("run_name") == "model_seed7", F.struct(F.lit(0.8).alias("target")))
    each.select("run_name", test.alias("test"), "n", fixed.alias("fixed")).groupBy().agg(F.collect_list(F.struct("run_name", "test", "n", "fixed")).alias("runs")).write.json(folder)
    schema = T.StructType.fromDDL("run_name string, test struct<brier:double>, n bigint, fixed struct<target:double>")
    return read_runs(spark, folder, schema).select("run_name", F.col("test.brier").alias("brier"), "n", F.col("fixed.target").alias("target"))


_HIST = "h AS (SELECT user_id % 20 AS run, (epoch_us(ts) // 3600000000) AS epoch, round(avg(value), 6) AS val_auc FROM events GROUP BY 1, 2)"


def _history(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("run"), F.floor(F.unix_timestamp("ts") / 3600).alias("epoch")).agg(r6(F.avg("value")).alias("val_auc"))


@query(f"WITH {_HIST} SELECT * FROM h")
def scan_history(spark, d):
    return _history(spark, d)


@query(f"WITH {_HIST} SELECT run, arg_max(epoch, (val_auc, -epoch)) AS epoch FROM h GROUP BY 1")
def best_epoch(spark, d):
    return _history(spark, d).groupBy("run").agg(F.max_by("epoch", F.struct("val_auc", -F.col("epoch"))).alias("epoch"))


@query(f"WITH {_HIST}, o AS (SELECT *, row_number() OVER w AS nth, max(val_auc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)), g AS (SELECT *, nth - max(CASE WHEN before IS NULL OR val_auc > before THEN nth END) OVER (PARTITION BY run ORDER BY epoch) AS gap FROM o) SELECT run, min(epoch) FILTER (gap >= 3) AS stop_epoch FROM g GROUP BY 1")
def early_stop(spark, d):
    w = Window.partitionBy("run").orderBy("epoch")
    o = _history(spark, d).withColumn("at", F.row_number().over(w)).withColumn("before", F.max("val_auc").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    better = F.when(F.col("before").isNull() | (F.col("val_auc") > F.col("before")), F.col("at"))
    g = o.withColumn("gap", F.col("at") - F.last(better, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("run").agg(F.min(F.when(F.col("gap") >= 3, F.col("epoch"))).alias("stop_epoch"))


@query(Q.P + f"c AS (SELECT run_name, {Q._cells('0.5')} FROM runs GROUP BY 1), p AS (SELECT run_name, {Q._PANEL} FROM c) UNPIVOT (SELECT run_name, sensitivity, specificity, ppv FROM p) ON sensitivity, specificity, ppv INTO NAME metric VALUE estimate")
def headline(spark, d):
    p = S.panel(runs(spark, d), F.lit(0.5), ["run_name"]).withColumns({c: r6(F.col(c)) for c in Q.RATES})
    return p.unpivot(["run_name"], ["sensitivity", "specificity", "ppv"], "metric", "estimate")


@query(Q.P + Q._curve("runs") + " SELECT k AS run_name, count(*) AS points, round(sum(fpr), 4) AS total_fpr FROM roc GROUP BY 1")
def roc_points(spark, d):
    """Arrays of a record back to rows."""
    roc = S.roc_points(S.score_counts(runs(spark, d), ["run_name"]), ["run_name"])
    nested = roc.groupBy("run_name").agg(F.array_sort(F.collect_list(F.struct("threshold", "fpr", "tpr"))).alias("points"))
    return nested.select("run_name", F.inline("points")).groupBy("run_name").agg(F.count("*").alias("points"), F.round(F.sum("fpr"), 4).alias("total_fpr"))


@query(Q.P + Q._curve("runs") + f", a AS (SELECT k AS run_name, round({Q._AUC}, 6) AS auc FROM run GROUP BY k) SELECT run_name, auc, row_number() OVER (ORDER BY auc, run_name) AS place FROM a")
def auc_table(spark, d):
    a = S.rank_metrics(S.score_counts(runs(spark, d), ["run_name"]), ["run_name"]).select("run_name", r6(F.col("auc")).alias("auc"))
    return a.withColumn("place", F.row_number().over(Window.orderBy("auc", "run_name")))


@query(Q.P + Q._curve("runs") + f", t AS (SELECT k AS run_name, arg_min(threshold, (-tpr, threshold)) AS t FROM roc WHERE fpr <= 0.2 + 1e-12 AND NOT isinf(threshold) GROUP BY k), c AS (SELECT run_name, {Q._cells('t')} FROM runs JOIN t USING (run_name) GROUP BY 1) SELECT run_name, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, 0.8::DOUBLE AS target FROM c")
def fixed_spec_table(spark, d):
    r = runs(spark, d)
    t = S.threshold_at_specificity(S.roc_points(S.score_counts(r, ["run_name"]), ["run_name"]), 0.8, ["run_name"]).withColumnRenamed("threshold", "t")
    return S.panel(r.join(F.broadcast(t), "run_name"), F.col("t"), ["run_name"]).select("run_name", r6(F.col("sensitivity")).alias("sensitivity"), r6(F.col("specificity")).alias("specificity"), F.lit(0.8).alias("target"))


@query(Q.P + "x AS (SELECT 1) SELECT run_name, round(avg((probability >= 0.5)::INT) FILTER (label = 1 AND lesion_type = 'mass'), 6) AS mass, round(avg((probability >= 0.5)::INT) FILTER (label = 1 AND lesion_type = 'calcification'), 6) AS calcification FROM runs GROUP BY 1")
def strata_pivot(spark, d):
    hit = F.when(F.col("label") == 1, (F.col("probability") >= 0.5).cast("int"))
    return runs(spark, d).groupBy("run_name").pivot("lesion_type", ["mass", "calcification"]).agg(r6(F.avg(hit)))


@query(f"WITH s AS ({SPLITS_SQL}), c AS (SELECT split, count(*) AS images, count(DISTINCT patient_id) AS patients FROM s GROUP BY 1) SELECT sum(images)::BIGINT AS images, max(patients) AS most_patients, 3 AS splits FROM c")
def cohort_lock(spark, d):
    c = splits(spark, d).groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("patient_id").alias("patients"))
    lock = c.agg(F.map_from_entries(F.collect_list(F.struct("split", F.struct("images", "patients")))).alias("by_split"))
    each = F.map_values("by_split")
    return lock.select(F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x["images"]).alias("images"), F.array_max(F.transform(each, lambda x: x["patients"])).alias("most_patients"), F.size("by_split").alias("splits"))
