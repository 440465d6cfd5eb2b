"""Contracts, audits and manifests on small cases with known faults."""

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import audits as A
from cohortlake.operators import cohort as C
from cohortlake.operators import contracts as K
from cohortlake.operators import regions as R

NAN, INF = float("nan"), float("inf")


def faults(df, key):
    return {r[key]: r["faults"] for r in df.collect()}


def test_score_faults(spark):
    rows = [("a", 1, "p", 0, 0.5), ("a", 2, "p", 1, NAN), ("a", 3, "p", 1, 1.01), ("a", 4, "p", 2, -0.1), ("a", 5, None, None, None), ("a", 6, "p", 1, 0.1), ("a", 6, "p", 1, 0.1), ("b", 6, "p", 1, INF)]
    df = spark.createDataFrame(rows, "run_name string, image_id int, patient_id string, label int, probability double").withColumn("c", F.lit(2.0))
    got = sorted((r.run_name, r.image_id, r.faults) for r in K.score_faults(df).collect())
    assert got == [("a", 2, ["not_finite"]), ("a", 3, ["range"]), ("a", 4, ["label", "range"]), ("a", 5, ["no_id", "label", "not_finite"]), ("a", 6, ["repeated_id"]), ("a", 6, ["repeated_id"]), ("b", 6, ["not_finite"])]
    assert K.score_faults(df.filter("image_id = 1"), others=["c"]).first().faults == ["c_range"]
    assert faults(K.run_faults(df.withColumn("t", F.col("image_id")), constant=["t"]), "run_name") == {"a": ["mixed_t"], "b": ["one_label"]}


def test_locked_points(spark):
    schema = "model string, val_threshold double, fixed_specificity struct<target:double,threshold:double>, calibration struct<temperature:double>"
    good = (0.4846, (0.8, 0.6005), (1.25,))
    records = [("good", *good), ("near", *good), ("drift", *good), ("lost", *good), ("cold", 0.4846, (0.8, 0.6), (0.0,)), ("nan", 0.4846, (0.8, 0.6), (NAN,)), ("bare", None, (None, 0.6), None), ("none", 0.4846, None, (1.0,))]
    sidecars = [(m, 0.4846 + {"near": 1e-10, "drift": 1e-8}.get(m, 0)) for m, *_ in records if m != "lost"]
    wanted = spark.createDataFrame([(m,) for m, *_ in records] + [("absent",)], "model string")
    got = faults(K.locked_point_faults(wanted, spark.createDataFrame(records, schema), spark.createDataFrame(sidecars, "model string, youden_j double")), "model")
    assert got == {"drift": ["threshold_drift"], "lost": ["no_sidecar"], "cold": ["temperature_not_positive"], "nan": ["temperature_not_positive"], "bare": ["no_threshold", "no_fixed_specificity", "no_temperature"], "none": ["no_fixed_specificity"], "absent": ["no_record", "no_sidecar"]}


def test_array_faults(spark):
    stored = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, None]), (3, [1.0]), (4, [5.0]), (5, [])], "k int, a array<double>")
    rebuilt = spark.createDataFrame([(1, [1.0, 3.0]), (2, [1.0, None]), (3, [1.0, 1.0]), (5, [])], "k int, a array<double>")
    assert sorted((r.k, r.fault, r.place) for r in K.array_faults(stored, rebuilt, "k").collect()) == [(1, "values", 2), (3, "shape", None), (4, "missing", None)]


def test_kept_fields(spark):
    row = spark.sql("select map('PatientID', '1', 'modality', 'MG', 'x', null) as m, map() as e").select(K.kept_fields(F.col("m"), ["patientid"]).alias("m"), K.kept_fields(F.col("m"), []).alias("all")).first()
    assert row.m == {"modality": "MG", "x": None} and len(row.all) == 3


def test_membership(spark):
    rows = spark.createDataFrame([(1, "train"), (2, "train"), (3, "val"), (None, "val")], "image_id int, split string")
    members = spark.createDataFrame([(1, "train"), (2, "val")], "image_id int, split string")
    assert {r.image_id: r.fault for r in C.membership_faults(rows, members, "image_id", "split").collect()} == {2: "other_split", 3: "no_split", None: "no_split"}


CLASSES = ("background", "mass")


def manifest(spark, **change):
    """Two sound rows, of which the second is changed."""
    good = {"patch_id": "a", "patient_id": "p1", "split": "train", "patch_class": "mass", "class_id": 1, "patch_kind": "lesion", "y0": 0, "x0": 0, "y1": 8, "x1": 8, "source_height": 32, "source_width": 32, "roi_overlap_px": 4}
    other = good | {"patch_id": "b", "patient_id": "p2", "split": "val", "patch_class": "background", "class_id": 0, "patch_kind": "background", "roi_overlap_px": 0} | change
    schema = "patch_id string, patient_id string, split string, patch_class string, class_id int, patch_kind string, y0 int, x0 int, y1 int, x1 int, source_height int, source_width int, roi_overlap_px int"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in (good, other)], schema)


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, {}),
        ({"split": "test"}, {"known_split"}),
        ({"split": "train"}, {"locked_train"}),
        ({"patient_id": "p1"}, {"locked_val", "patient_in_one_split"}),
        ({"patch_class": "x"}, {"known_class", "class_id"}),
        ({"class_id": 1}, {"class_id"}),
        ({"y1": 33}, {"inside_source"}),
        ({"x0": -1}, {"inside_source"}),
        ({"y1": 0}, {"inside_source"}),
        ({"roi_overlap_px": 1}, {"background_off_regions"}),
        ({"patch_id": "a"}, {"unique_id"}),
    ],
)
def test_each_rule_of_the_manifest(spark, change, broken):
    locked = spark.createDataFrame([("p1", "train"), ("p2", "val")], "patient_id string, split string")
    got = {r.rule: r.n for r in R.manifest_violations(manifest(spark, **change), locked, CLASSES).collect()}
    assert got == dict.fromkeys(broken, 1)


def test_empty_manifest_and_coverage(spark):
    locked = spark.createDataFrame([("p1", "train")], "patient_id string, split string")
    none = manifest(spark).limit(0)
    assert [r.rule for r in R.manifest_violations(none, locked, CLASSES).collect()] == ["not_empty"]
    got = {(r.split, r.patch_class, r.n, r.problem) for r in R.class_coverage(manifest(spark), CLASSES, 2).collect()}
    assert got == {("train", "background", 0, "missing"), ("val", "mass", 0, "missing"), (None, "background", 1, "few"), (None, "mass", 1, "few")}


def test_whole_manifest_is_sound(spark):
    regions = [(f"i{i}:{k}", f"i{i}", f"p{i}", "train" if i % 2 else "val", "mass", 40 * k, 40 * k, 40 * k + 32, 40 * k + 32) for i in range(6) for k in range(2)]
    df = spark.createDataFrame(regions, "region_id string, image_id string, patient_id string, split string, patch_class string, y0 int, x0 int, y1 int, x1 int")
    runs = df.select("region_id", F.explode(F.sequence(F.col("y0") + 10, F.col("y0") + 20)).alias("y"), (F.col("x0") + 10).alias("xs"), (F.col("x0") + 22).alias("xe"))
    tissue = df.select("image_id").distinct().select("image_id", F.lit(0).alias("y0"), F.lit(200).alias("y1"), F.lit(0).alias("x0"), F.lit(200).alias("x1"))
    out = R.patch_manifest(df, runs, tissue, CLASSES, lesion=2, background=3, candidates=9, attempts=60, size=32, seed=1, cutoff=0.9, height=200, width=200).cache()
    assert R.manifest_violations(out, df.select("patient_id", "split"), CLASSES).count() == 0
    assert R.class_coverage(out, CLASSES, 5).count() == 0
    by = {(r.patch_kind): r["n"] for r in out.groupBy("patch_kind").agg(F.count("*").alias("n")).collect()}
    assert by == {"lesion": 24, "background": 18}


def test_audit_fits_on_validation_alone(spark):
    val = spark.createDataFrame([("r", f"v{i}", i % 2, 0.3 + 0.4 * (i % 2) + 0.01 * (i % 5), 1) for i in range(40)], "run string, patient_id string, label int, probability double, density int")
    test = spark.createDataFrame([("r", f"t{i // 2}", int(i % 3 == 0), 0.05 * (i % 20), i % 2 + 1) for i in range(60)], val.schema)
    locked = A.locked_points(val, ["run"]).cache()
    other = A.locked_points(val, ["run"]).first()
    point = locked.first()
    assert point == other and 0.3 <= point.fixed <= point.threshold <= 0.75 and point.nll_after <= point.nll_before and point.temperature < 1
    got = {r["item"]: r["value"] for r in A.audit_record(test, locked, ["run"], {"density": (1, 2, 3)}, val).collect()}
    assert got["n_cases"] == 60 and got["n_patients"] == 30 and got["prevalence"] == pytest.approx(1 / 3)
    hits = [(r.label, r.probability >= point.threshold) for r in test.collect()]
    assert got["test.sensitivity"] == pytest.approx(sum(h for y, h in hits if y) / 20)
    assert got["fixed.validation.specificity"] >= 0.8
    assert got["raw.auc"] == pytest.approx(got["calibrated.auc"])
    assert got["density.3.n"] == 0 and "density.3.auc" not in got and got["density.1.n"] == got["fixed.density.2.n"] == 30
    assert sum(v for k, v in got.items() if k.startswith("reliability.") and k.endswith(".n")) == 60
    assert sum(k.startswith("decision.") for k in got) == 92
