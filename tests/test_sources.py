"""Header spellings, path conventions, caches, locks, freezes and region candidates on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import evidence as E
from cohortlake.operators import paths as P
from cohortlake.operators import regions as R
from cohortlake.sources import cases, stores


def write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text)


def test_header_variants(spark, tmp_path):
    write(tmp_path / "x", "mass.csv", "patient_id,breast_density, abnormality type ,subtlety\nP1,2,mass,4\nP2, ,mass,\n")
    write(tmp_path / "x", "mass2.csv", "patient_id,breast_density, abnormality type ,subtlety\nP3,1,mass,5\n")
    write(tmp_path / "x", "calc.csv", "breast density,patient_id,abnormality type\n3,P4,calcification\n")
    got = cases.read_variants(spark, str(tmp_path / "x"), ["patient_id", "birads_density", "lesion_type", "subtlety"]).withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1))
    assert sorted(map(tuple, got.collect())) == [("P1", "2", "mass", "4", "mass.csv"), ("P2", None, "mass", None, "mass.csv"), ("P3", "1", "mass", "5", "mass2.csv"), ("P4", "3", "calcification", None, "calc.csv")]
    assert cases.file_headers(spark, str(tmp_path / "x")).count() == 2
    with pytest.raises(ValueError, match="calc.csv.*subtlety"):
        cases.read_variants(spark, str(tmp_path / "x"), ["subtlety"], optional=())


LISTING = ["Mass-Training_P_1_LEFT_CC_1", "Calc-Test_P_2_LEFT_CC_10", "Calc-Test_P_2_LEFT_CC_9", "P_3_LEFT_CC_2.dcm", "P_3_LEFT_CC.dcm", "P_4_LEFT_CC_7.dcm", "P_4_LEFT_CC_3.dcm", "readme"]


@pytest.mark.parametrize(
    ("path", "folder", "rung"),
    [
        ("Mass-Training_P_1_LEFT_CC_1/u/1.dcm", "Mass-Training_P_1_LEFT_CC_1", 1),
        ("Calc-Test_P_2_LEFT_CC_1/u/1.dcm", "Calc-Test_P_2_LEFT_CC_9", 2),
        ("Calc-Test_P_2_LEFT_CC/u/1.dcm", "Calc-Test_P_2_LEFT_CC_9", 2),
        ("Calc-Test_P_3_LEFT_CC_2/u/1.dcm", "P_3_LEFT_CC_2.dcm", 3),
        ("Calc-Test_P_3_LEFT_CC/u/1.dcm", "P_3_LEFT_CC.dcm", 3),
        ("Calc-Test_P_4_LEFT_CC_1/u/1.dcm", "P_4_LEFT_CC_3.dcm", 3),
        ("Calc-Test_P_5_LEFT_CC_1/u/1.dcm", None, None),
        (None, None, None),
    ],
)
def test_each_rung(spark, path, folder, rung):
    folders = spark.createDataFrame([(x,) for x in LISTING], "name string")
    row = P.resolve_folders(spark.createDataFrame([(1, path, "x")], "k int, csv string, `a.b` string"), folders, "csv").first()
    assert (row.folder, row.rung, row["a.b"]) == (folder, rung, "x")


def test_best_image(spark):
    folders = spark.createDataFrame([(x,) for x in LISTING], "name string")
    rows = spark.createDataFrame([(1, "Mass-Training_P_1_LEFT_CC_1/u"), (3, "Calc-Test_P_3_LEFT_CC_2/u"), (4, "Calc-Test_P_4_LEFT_CC_7/u"), (5, "none/u")], "k int, csv string")
    files = [("Mass-Training_P_1_LEFT_CC_1", "only", 5, 2), ("P_3_LEFT_CC_2.dcm", "small", 5, 9), ("P_3_LEFT_CC_2.dcm", "mask", 90, 2), ("P_3_LEFT_CC.dcm", "b", 50, 9), ("P_3_LEFT_CC.dcm", "a", 50, 9), ("P_4_LEFT_CC_7.dcm", "m2", 7, 2), ("P_4_LEFT_CC_7.dcm", "m1", 7, 1)]
    out = P.best_images(P.resolve_folders(rows, folders, "csv"), folders, spark.createDataFrame(files, "folder string, path string, area int, n_values int"), "k", "csv")
    assert {r.k: r.image for r in out.collect()} == {1: "only", 3: "a", 4: "m1", 5: None}


def test_find_files(spark):
    files = spark.createDataFrame([("a/1.dcm",), ("z/2.dcm",), ("b/2.dcm",), ("b/1.dcm",)], "path string")
    out = P.find_files(spark.createDataFrame([("a/1",), ("a/2",), ("a/3",), (None,)], "id string"), files, "id")
    assert {r.id: (r.file, r.found_by) for r in out.collect()} == {"a/1": ("a/1.dcm", "direct"), "a/2": ("b/2.dcm", "stem"), "a/3": (None, None), None: (None, None)}


def test_refresh_works_on_what_changed(spark, tmp_path):
    seen = []

    def work(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", "size", F.upper("text").alias("made"))

    def run(rows):
        store, n = stores.refresh(str(tmp_path / "s"), spark.createDataFrame(rows, "id int, size int, text string"), "id", ["size"], work)
        return {r.id: r.made for r in store.collect()}, n

    assert run([(1, 1, "a"), (2, 1, "b")]) == ({1: "A", 2: "B"}, 2)
    assert run([(1, 1, "a"), (2, 1, "b")]) == ({1: "A", 2: "B"}, 0)
    assert run([(1, 2, "aa"), (2, 1, "not looked at"), (3, None, "c")]) == ({1: "AA", 2: "B", 3: "C"}, 2)
    assert run([(3, None, "c")]) == ({1: "AA", 2: "B", 3: "C"}, 0)
    assert seen == [[1, 2], [1, 3]]
    (tmp_path / "s" / "v-9").mkdir()  # a version that was never completed
    assert stores.latest_version(spark, str(tmp_path / "s")) == 2


def test_lock(spark, tmp_path):
    path = str(tmp_path / "lock")
    record = spark.createDataFrame([(3, None, [1, 2])], "n int, note string, ids array<int>")
    first = stores.write_lock(path, record).first()
    assert first.n == 3 and first.note is None and first.ids == [1, 2] and first.generated_at_utc.endswith("+00:00")
    assert stores.write_lock(path, record).first() == first
    with pytest.raises(stores.LockChanged):
        stores.write_lock(path, record.withColumn("n", F.lit(4)))
    assert stores.write_lock(path, record).first() == first


def test_freeze_names_each_difference(spark):
    files = [(r, p, f"f{p}", 1, f"h{p}") for r in range(6) for p in range(4)]
    schema = "run int, place int, path string, size_bytes int, sha256 string"
    frozen = E.freeze_record(spark.createDataFrame(files, schema), ["run"])
    later = [x for x in files if x[:2] != (1, 2) and x[0] != 5]
    later = [(r, p, f, s, "new" if (r, p) == (2, 0) else h) for r, p, f, s, h in later]
    later = [(r, {1: 2, 2: 1}.get(p, p) if r == 3 else p, f, s, h) for r, p, f, s, h in later] + [(4, 9, "more", 1, "h"), (7, 0, "run", 1, "h")]
    got = sorted(map(tuple, E.freeze_differences(frozen, spark.createDataFrame(later, schema), ["run"]).collect()))
    assert got == [(1, "f2", "removed"), (2, "f0", "changed"), (3, "f1", "moved"), (3, "f2", "moved"), (4, "more", "added"), *[(5, f"f{i}", "removed") for i in range(4)], (7, "run", "added")]
    assert E.freeze_differences(frozen, spark.createDataFrame(files, schema), ["run"]).count() == 0


def test_lesion_candidates_come_from_the_region(spark):
    runs = [("r", 10, 5, 9), ("r", 11, 5, 5), ("r", 40, 100, 400), ("s", 0, 0, 1)]
    df = spark.createDataFrame(runs, "region_id string, y int, xs int, xe int")
    pixels = {k: [(y, x) for r, y, a, b in runs if r == k for x in range(a, b)] for k in ("r", "s")}
    box = lambda y, x: (min(max(y - 16, 0), 468), min(max(x - 16, 0), 468))
    got = {}
    for r in R.lesion_candidates(df, 40, 32, 1, 500, 500).collect():
        got.setdefault(r.region_id, set()).add((r.y0, r.x0))
    for k, p in pixels.items():
        centroid = tuple(int(np.rint(np.mean([q[i] for q in p]))) for i in (0, 1))
        assert box(*centroid) in got[k] and got[k] <= {box(*q) for q in p} | {box(*centroid)}
    assert len(got["r"]) > 20 and got["s"] == {(0, 0)}
    one = R.lesion_candidates(df, 1, 32, 1, 500, 500)
    assert one.count() == 2 and R.lesion_candidates(df, 5, 501, 1, 500, 500).count() == 0


def test_draws_are_even_over_pixels(spark, monkeypatch):
    monkeypatch.setattr(R, "PIXELS", 7)
    df = spark.createDataFrame([("r", 0, 0, 90), ("r", 300, 0, 10)], "region_id string, y int, xs int, xe int")
    out = R.lesion_candidates(df, 3000, 1, 3, 500, 500).collect()
    assert len(out) == 101  # every pixel, and the centroid between the runs


def test_overlap_across_bands(spark):
    boxes = spark.createDataFrame([("i", "a", 60, 0, 130, 10), ("i", "b", 0, 0, 5, 5), ("j", "a", 0, 0, 5, 5)], "image_id string, box_id string, y0 int, x0 int, y1 int, x1 int")
    runs = spark.createDataFrame([("i", 63, 0, 4), ("i", 64, 2, 20), ("i", 129, 9, 12), ("i", 130, 0, 9)], "image_id string, y int, xs int, xe int")
    got = {(r.image_id, r.box_id): (r.px, r.coverage) for r in R.roi_overlap(boxes, runs).collect()}
    assert got == {("i", "a"): (13, 13 / 34), ("i", "b"): (0, 0), ("j", "a"): (0, 0)}


@pytest.mark.parametrize(("dark", "held", "found"), [("left", 1, True), ("right", 1, True), ("top", 1, True), ("bottom", 1, True), ("middle", 1, False), ("left", 0, False)])
def test_black_stripe(spark, dark, held, found):
    clean, mask = np.full((12, 12), 0.5), np.ones((12, 12), int)
    at = {"left": np.s_[:, :3], "right": np.s_[:, -3:], "top": np.s_[:3], "bottom": np.s_[-3:], "middle": np.s_[4:7]}[dark]
    clean[at], mask[at] = 0.01, held
    df = spark.createDataFrame([(clean.tolist(), mask.tolist()), (None, None), ([], [])], "c array<array<double>>, m array<array<int>>")
    assert [r.s for r in df.select(R.black_stripe(F.col("c"), F.col("m"), 3).alias("s")).collect()] == [found, None, False]


def test_best_images_resolves_once(spark):
    rows = spark.createDataFrame([("a", "Calc-Test_P_1_L_CC_1/u/1.dcm"), ("a", "P_1_L_CC.dcm/u/1.dcm"), ("b", "gone/1.dcm"), (None, "P_1_L_CC.dcm/u/1.dcm")], "id string, csv string")
    folders = spark.createDataFrame([("Calc-Test_P_1_L_CC_1",), ("P_1_L_CC.dcm",), ("P_1_L_CC_2.dcm",)], "name string")
    files = spark.createDataFrame([("Calc-Test_P_1_L_CC_1", "x/1.dcm", 9, 200), ("P_1_L_CC.dcm", "y/1.dcm", 20, 2), ("P_1_L_CC_2.dcm", "z/1.dcm", 12, 200)], "folder string, path string, area int, n_values int")
    got = P.best_images(P.resolve_folders(rows, folders, "csv"), folders, files, "id", "csv")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "z/1.dcm"), ("a", "z/1.dcm"), ("b", None), (None, None)]
    # each use of the resolved rows would resolve them again
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 6
