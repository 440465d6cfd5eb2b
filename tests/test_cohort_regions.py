import pytest
from pyspark.sql import functions as F

from cohortlake.functions import box_from_center
from cohortlake.operators import cohort as C
from cohortlake.operators import evidence as E
from cohortlake.operators import regions as R
from cohortlake.sources import tables as T

ABN = "image_id string, label int, lesion_type string, roi_mask_id string, ord int"


@pytest.mark.parametrize(("rows", "want"), [
    ([("i", 0, "mass", "roi_1", 1), ("i", 1, "calc", "roi_2", 2)], (1, "roi_2", "mixed")),
    ([("i", 1, "mass", "roi_1", 1), ("i", 1, "calc", "roi_2", 2)], (1, "roi_1", "mixed")),
    ([("i", 1, "mass", "roi_1", 1), ("i", 0, "mass", "roi_2", 2)], (1, "roi_1", "mass")),
])
def test_collapse(spark, rows, want):
    got = C.collapse_images(spark.createDataFrame(rows, ABN), F.col("ord")).collect()
    assert [(r.label, r.roi_mask_id, r.lesion_type) for r in got] == [want]


def test_collapse_empty(spark):
    assert C.collapse_images(spark.createDataFrame([], ABN), F.col("ord")).count() == 0


def test_ledger_and_clean(spark):
    s = spark.createDataFrame([("a", "1", "train"), ("a", "2", "test"), ("b", "3", "train"), ("c", "4", "test")], "patient_id string, image_id string, split string")
    led = C.overlap_ledger(s)
    assert [(r.patient_id, r.development_split, r.n_train_images, r.n_val_images, r.n_test_images) for r in led.collect()] == [("a", "train", 1, 0, 1)]
    assert sorted(r.image_id for r in C.clean(s, led).collect()) == ["3", "4"]


def test_carve_is_disjoint(spark):
    df = spark.createDataFrame([(f"p{i % 30}", f"i{i}", int(i % 30 < 10)) for i in range(90)], "patient_id string, image_id string, label int")
    parts = C.carve(df, 0.1, 3).groupBy("patient_id").agg(F.count_distinct("part").alias("n"), F.max("part").alias("p"), F.max("label").alias("y")).collect()
    assert all(r.n == 1 for r in parts) and sum(r.p == "val" for r in parts if r.y == 1) == 1 and sum(r.p == "val" for r in parts if r.y == 0) == 2


def test_overlap_values(spark):
    runs = spark.createDataFrame([("i", y, 14, 18) for y in range(14, 18)], "image_id string, y int, xs int, xe int")
    boxes = spark.createDataFrame([("i", "b", 10, 10, 22, 22), ("j", "c", 0, 0, 4, 4)], "image_id string, box_id string, y0 int, x0 int, y1 int, x1 int")
    got = {r.box_id: (r.px, r.coverage, r.fraction, r.score) for r in R.roi_overlap(boxes, runs).collect()}
    assert got["b"] == (16, 1.0, 16 / 144, 1.0) and got["c"] == (0, 0.0, 0.0, 0.0)


def test_box_is_moved_inside(spark):
    b = spark.range(1).select(box_from_center(F.lit(1), F.lit(99), 10, F.lit(50), F.lit(100)).alias("b"), box_from_center(F.lit(1), F.lit(1), 60, F.lit(50), F.lit(100)).alias("n")).first()
    assert tuple(b.b) == (0, 90, 10, 100) and b.n is None


def test_heatmap(spark):
    cells = [("hit", p, p // 8, p % 8, 1.0 if p == 10 else 0.0, p == 10, 8.0) for p in range(64)] + [("zero", p, p // 8, p % 8, 0.0, p == 10, 8.0) for p in range(64)]
    got = {r.case_id: r for r in R.heatmap_stats(spark.createDataFrame(cells, "case_id string, pos int, y int, x int, v double, inside boolean, side double")).collect()}
    assert got["hit"].hit and got["hit"].energy == 1 and got["hit"].distance == 0 and got["zero"].degenerate and got["zero"].energy == 0


def test_evidence(spark):
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    have = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, sha256 string")
    assert sorted((r.path, r.reason) for r in E.verify_hashes(want, have).collect()) == [("b", "changed"), ("c", "missing")]
    old = spark.createDataFrame([("baseline", 0.6), ("x", 0.5)], "model string, auc double")
    assert sorted(map(tuple, E.upsert(old, spark.createDataFrame([("baseline", 0.7)], "model string, auc double")).collect())) == [("baseline", 0.7), ("x", 0.5)]


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("File Name; ACR\n100 ; 2\n101;  \n")
    df = T.read_delimited(spark, str(tmp_path / "m.csv"), ["File Name", "ACR"], ";")
    assert [tuple(r) for r in T.coerce(df, ["ACR"], ["File Name"]).collect()] == [("100", 2), ("101", None)]
    with pytest.raises(ValueError):
        T.read_delimited(spark, str(tmp_path / "m.csv"), ["Patient"], ";")
    T.write_package(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        T.write_package(df, str(tmp_path / "out"))
    assert T.list_files(spark, str(tmp_path), "*.csv").count() == 1


def review_rows(n=40):
    return [(f"i{k % 30}", k, "train" if k % 4 else "val", (k * 37 % 101) / 101, (k * 53 % 97) / 97) for k in range(n)]


REVIEW = "image_id string, box_id int, split string, metric double, rank double"


@pytest.mark.parametrize(("count", "n"), [(7, 1), (8, 1), (1, 1), (9, 4), (5, 5)])
def test_spread_places(spark, count, n):
    df = spark.createDataFrame([("g", i, i / 10) for i in range(count)], "g string, box_id int, metric double")
    want = [count // 2] if n == 1 else [int(i * (count - 1) / (n - 1)) for i in range(n)]
    assert sorted(r.box_id for r in R.spread(df, ["g"], n, "metric", "box_id").collect()) == want
    with pytest.raises(Exception, match="rows are wanted"):
        R.spread(df, ["g"], count + 1, "metric", "box_id").collect()


@pytest.mark.parametrize("strategy", ["spread", "lowest", "ranked"])
def test_review_by_quotas(spark, strategy):
    rows = review_rows()
    df = spark.createDataFrame(rows, REVIEW)
    best = {}
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        best.setdefault(r[0], r)
    one = R.one_per_unit(df, "image_id", F.col("rank"), "metric")
    assert sorted(map(tuple, one.collect())) == sorted(best.values())
    units = {f"i{k}" for k in range(5)}
    left = [r for r in best.values() if r[0] not in units]
    train = [r for r in left if r[2] == "train"]
    quota = min(max(1, round(6 * len(train) / len(left))), len(train), 5)
    want = []
    for name, k in (("train", quota), ("val", 6 - quota)):
        own = sorted((r for r in left if r[2] == name), key=lambda r: (r[4], r[1]) if strategy == "ranked" else (r[3], r[1]))
        places = range(k) if strategy != "spread" else [len(own) // 2] if k == 1 else [int(i * (len(own) - 1) / (k - 1)) for i in range(k)]
        want += [own[i] for i in places]
    taken = spark.createDataFrame([(u,) for u in units], "image_id string")
    got = R.take_partitioned(one, 6, strategy, F.col("rank"), "metric", "box_id", taken)
    assert sorted(map(tuple, got.select(*df.columns).collect())) == sorted(want)
    with pytest.raises(ValueError, match="are wanted"):
        R.take_partitioned(one, 99, strategy, F.col("rank"), "metric", "box_id")


def test_heatmap_overlap_is_absolute(spark):
    cell = lambda k, pos, v, inside: (k, pos, pos // 2, pos % 2, v, inside, 2.0)
    rows = [cell("faint", p, v, p < 2) for p, v in enumerate((0.4, 0.3, 0.1, 0.0))] + [cell("strong", p, v, p < 2) for p, v in enumerate((0.9, 0.5, 0.6, 0.1))] + [cell("none", p, 0.0, False) for p in range(4)]
    df = spark.createDataFrame(rows, "case_id string, pos int, y int, x int, v double, inside boolean, side double")
    got = {r.case_id: (r.iou, r.degenerate) for r in R.heatmap_stats(df).collect()}
    assert got == {"faint": (0.0, False), "strong": (2 / 3, False), "none": (0.0, True)}


def test_context_is_cut_at_the_frame(spark):
    df = spark.createDataFrame([(0, 0, 10, 4), (50, 80, 60, 99)], "y0 int, x0 int, y1 int, x1 int")
    got = [(r.cy0, r.cy1, r.cx0, r.cx1) for r in R.context_window(df, 0.5, F.lit(100), F.lit(100)).collect()]
    assert got == [(0, 15, 0, 9), (40, 70, 70, 100)]
