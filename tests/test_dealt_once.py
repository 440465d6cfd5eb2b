"""Boxes and runs that are dealt by image stay where they are, and give what brute force gives."""

import random

import pytest

from cohortlake.operators import regions as R
from cohortlake.plans import registry

DATA = "/root/testdata/sf0.001"
SHUFFLES = {"roi_union": 1, "roi_overlap": 2, "roi_coverage": 2, "lesion_boxes": 2, "normalised_manifest": 2, "lesion_candidates": 3, "drawn_lesion_boxes": 4, "whole_manifest": 18}


@pytest.mark.parametrize("name", SHUFFLES)
def test_rows_move_by_image_alone(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= SHUFFLES[name] and "ExistingRDD" not in plan
    moved = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all(x.startswith(("image_id", "split", "patch_class")) for x in moved) and "region_id" not in " ".join(x.split("]")[0] for x in moved)


def test_union_of_runs(spark):
    draw = random.Random(4)
    runs = [(f"i{draw.randrange(3)}", draw.randrange(4), a, a + draw.randrange(9)) for a in (draw.randrange(40) for _ in range(200))]
    want = {}
    for image, y, a, b in runs:
        want.setdefault(image, set()).update((y, x) for x in range(a, b))
    got = {r.image_id: r.px for r in R.union_pixels(spark.createDataFrame(runs, "image_id string, y int, xs int, xe int")).collect()}
    assert got == {k: len(v) for k, v in want.items() if v}


def test_overlap_keeps_boxes_of_unknown_place(spark):
    boxes = spark.createDataFrame([("i", "a", None, 0, None, 10), ("i", "b", 5, 20, 6, 30), (None, "c", 0, 0, 9, 9), ("i", "d", 0, 0, 9, 9)], "image_id string, box_id string, y0 int, x0 int, y1 int, x1 int")
    runs = spark.createDataFrame([("i", 5, 0, 4), (None, 5, 0, 4)], "image_id string, y int, xs int, xe int")
    got = {r.box_id: (r.px, r.coverage) for r in R.roi_overlap(boxes, runs).collect()}
    assert got == {"a": (0, 0), "b": (0, 0), "c": (0, 0), "d": (4, 1)}


def test_review_keeps_ids_alone(spark, monkeypatch):
    from cohortlake.plans import region_queries as Q

    kept = []
    monkeypatch.setattr(Q, "cut", lambda df: kept.append(df.columns) or df)
    registry.QUERIES["review_strategies"](spark, DATA)
    assert ["split", "image_id", "box_id"] in kept
