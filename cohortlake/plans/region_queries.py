"""Boxes, patches and review selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import box_from_center, keyed_uniform, r6, stable_rank
from ..functions import stable_id as make_id
from ..operators import cohort as C
from ..operators import contracts as K
from ..operators import regions as R
from ..sources.tables import cut
from .views import ABN_SQL, BOXES_SQL, abnormalities, boxes, splits, table, u_sql
from .views import SPLITS_SQL as SP

ALL: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        ALL[f.__name__.rstrip("_")] = (f, sql)
        return f

    return add


X = f"WITH b AS ({BOXES_SQL}), "
_RUNS = "r AS (SELECT image_id, y0 + dy AS y, x0 AS xs, x0 + 20 AS xe FROM b, (SELECT unnest([0, 10, 20, 30, 40]) AS dy) WHERE pathology = 'MALIGNANT' GROUP BY ALL)"


def mask_runs(b):
    """Five pixel runs of 20 for each malignant box."""
    return b.filter("pathology = 'MALIGNANT'").select("image_id", F.explode(F.array(*[F.col("y0") + dy for dy in (0, 10, 20, 30, 40)])).alias("y"), F.col("x0").alias("xs"), (F.col("x0") + 20).alias("xe")).distinct()


_HIT = """h AS (SELECT b.image_id, b.box_id, sum(least(r.xe, b.x1) - greatest(r.xs, b.x0)) AS px FROM b JOIN r ON b.image_id = r.image_id AND r.y >= b.y0 AND r.y < b.y1 AND r.xs < b.x1 AND r.xe > b.x0 GROUP BY 1, 2),
a AS (SELECT image_id, sum(xe - xs) AS area FROM r GROUP BY 1),
o AS (SELECT b.*, coalesce(px, 0)::BIGINT AS px, coalesce(px / area, 0) AS coverage, coalesce(px, 0) / 9216 AS fraction, greatest(coalesce(px / area, 0), coalesce(px, 0) / 9216) AS score FROM b LEFT JOIN h USING (image_id, box_id) LEFT JOIN a USING (image_id))"""


def _scored(spark, d):
    b = boxes(spark, d)
    return R.roi_overlap(b, mask_runs(b))


@query("SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_partkey % 600 - 48, 0), 512)::INT AS y0, least(greatest(l_suppkey % 600 - 48, 0), 512)::INT AS x0 FROM lineitem")
def box_geometry(spark, d):
    box = box_from_center((F.col("l_partkey") % 600).cast("int"), (F.col("l_suppkey") % 600).cast("int"), 96, F.lit(608), F.lit(608))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box["y0"].alias("y0"), box["x0"].alias("x0"))


@query(X + _RUNS + ", p AS (SELECT DISTINCT image_id, y, unnest(range(xs, xe)) AS x FROM r) SELECT image_id, count(*) AS px FROM p GROUP BY 1")
def roi_union(spark, d):
    return R.union_pixels(mask_runs(boxes(spark, d)))


@query(X + f"{_RUNS}, {_HIT} SELECT image_id, box_id, px, round(coverage, 6) AS coverage, round(fraction, 6) AS fraction, round(score, 6) AS score FROM o")
def roi_overlap(spark, d):
    return _scored(spark, d).select("image_id", "box_id", "px", *[r6(F.col(c)).alias(c) for c in ("coverage", "fraction", "score")])


@query(X + f"{_RUNS}, {_HIT} SELECT image_id, round(min(coverage), 6) AS worst, arg_min(box_id, (coverage, box_id)) AS worst_box FROM o WHERE px > 0 GROUP BY 1")
def roi_coverage(spark, d):
    hit = _scored(spark, d).filter("px > 0")
    return hit.groupBy("image_id").agg(r6(F.min("coverage")).alias("worst"), F.min_by("box_id", F.struct("coverage", "box_id")).alias("worst_box"))


@query(X + "m AS (SELECT * FROM b WHERE pathology = 'MALIGNANT') SELECT image_id, box_id FROM b WHERE pathology <> 'MALIGNANT' AND NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = b.image_id AND b.y0 < m.y1 AND b.y1 > m.y0 AND b.x0 < m.x1 AND b.x1 > m.x0)")
def bg_boxes(spark, d):
    b = boxes(spark, d)
    return R.free_boxes(b.filter("pathology <> 'MALIGNANT'"), b.filter("pathology = 'MALIGNANT'")).select("image_id", "box_id")


def _draw_sql(axis: str) -> str:
    return f"floor({u_sql(chr(39) + '42' + chr(39), 'image_id', 'attempt', chr(39) + axis + chr(39))} * 513)::INT"


_BACKGROUND = f"""i AS (SELECT DISTINCT image_id FROM b),
a AS (SELECT image_id, unnest(range(30)) AS attempt FROM i),
d AS (SELECT image_id, {_draw_sql("y")} AS y0, {_draw_sql("x")} AS x0, min(attempt) AS attempt FROM a GROUP BY ALL),
f AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.image_id = d.image_id AND d.y0 < b.y1 AND d.y0 + 96 > b.y0 AND d.x0 < b.x1 AND d.x0 + 96 > b.x0)),
t AS (SELECT *, greatest(0, least(x0 + 96, 150 + image_id % 300) - x0) * 96 / 9216 AS share FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY attempt) AS place FROM t WHERE share >= 0.5),
g AS (SELECT image_id, list(box_id ORDER BY box_id) AS ids FROM b GROUP BY 1)
SELECT image_id, place, y0, x0, round(share, 6) AS tissue_fraction, ids[((place - 1) % len(ids) + 1)::INT] AS anchor FROM p JOIN g USING (image_id) WHERE place <= 3"""


@query(X + _BACKGROUND)
def background_boxes(spark, d):
    """Three boxes an image off all regions, half on tissue, which lies left of a column of the image."""
    b = boxes(spark, d)
    tissue = b.select("image_id").distinct().select("image_id", F.lit(0).alias("y0"), F.lit(608).alias("y1"), F.lit(0).alias("x0"), (150 + F.col("image_id") % 300).alias("x1"))
    out = R.background_boxes(b, b, tissue, n=3, size=96, attempts=30, seed=42, height=608, width=608)
    return out.select("image_id", "place", "y0", "x0", r6(F.col("tissue_fraction")).alias("tissue_fraction"), "anchor")


@query(X + f"{_RUNS}, {_HIT}, w AS (SELECT *, count(*) FILTER (score >= 0.1) OVER (PARTITION BY image_id) AS took, row_number() OVER (PARTITION BY image_id ORDER BY (score >= 0.1) DESC, score DESC, y0, x0, box_id) AS place FROM o) SELECT image_id, box_id, place, CASE WHEN score < 0.1 THEN 'insufficient_overlap_0.1:' || least(took, 2) || '/2' END AS fallback_reason FROM w WHERE place <= 2")
def lesion_boxes(spark, d):
    return R.best_boxes(_scored(spark, d), ["image_id"], 2, 0.1).select("image_id", "box_id", "place", "fallback_reason")


_LESION = "q AS (SELECT box_id AS region_id, y0 + dy AS y, x0 + dy AS xs, x0 + 20 + 2 * dy AS xe FROM b, (SELECT unnest([0, 10, 20, 30, 40]) AS dy) WHERE pathology = 'MALIGNANT')"


_REGION = ("image_id", "region_id")  # a region has one image, by which its runs are dealt


def lesion_runs(b):
    """Five runs for each malignant box, which grow to the right."""
    rows = b.filter("pathology = 'MALIGNANT'").select("image_id", F.col("box_id").alias("region_id"), "y0", "x0", F.explode(F.array(*[F.lit(x) for x in (0, 10, 20, 30, 40)])).alias("dy"))
    return rows.select("image_id", "region_id", (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dy")).alias("xs"), (F.col("x0") + 20 + 2 * F.col("dy")).alias("xe"))


_CENTRES = f"""w AS (SELECT *, xe - xs AS len, sum(xe - xs) OVER (PARTITION BY region_id ORDER BY y, xs ROWS UNBOUNDED PRECEDING) AS upto FROM q),
a AS (SELECT region_id, sum(len) AS area, round_even(sum(y * len) / sum(len), 0)::INT AS cy, round_even(sum((xs + xe - 1) / 2 * len) / sum(len), 0)::INT AS cx FROM w GROUP BY 1),
k AS (SELECT DISTINCT region_id, floor({u_sql("42", "region_id", "i")} * area)::BIGINT AS nth FROM a, range(1, 12) t(i)),
cc AS (SELECT region_id, cy, cx FROM a UNION ALL SELECT k.region_id, w.y, w.xs + k.nth - (w.upto - w.len) FROM k JOIN w ON w.region_id = k.region_id AND k.nth >= w.upto - w.len AND k.nth < w.upto),
bx AS (SELECT DISTINCT region_id, least(greatest(cy - 48, 0), 512)::INT AS y0, least(greatest(cx - 48, 0), 512)::INT AS x0 FROM cc)"""


@query(X + f"{_LESION}, {_CENTRES} SELECT region_id, y0, x0 FROM bx")
def lesion_candidates(spark, d):
    """Boxes around the centroid and eleven drawn pixels of each region; no pixel table is made."""
    return R.lesion_candidates(lesion_runs(boxes(spark, d)), 12, 96, 42, 608, 608, _REGION).select("region_id", "y0", "x0")


@query(X + f"""{_LESION}, {_CENTRES}, h AS (SELECT bx.*, sum(greatest(0, least(w.xe, x0 + 96) - greatest(w.xs, x0))) FILTER (w.y >= y0 AND w.y < y0 + 96) AS px, max(area) AS area FROM bx JOIN w ON w.region_id = bx.region_id JOIN a ON a.region_id = bx.region_id GROUP BY bx.region_id, y0, x0),
s AS (SELECT *, greatest(coalesce(px, 0) / area, coalesce(px, 0) / 9216) AS score FROM h),
p AS (SELECT *, count(*) FILTER (score >= 0.97) OVER (PARTITION BY region_id) AS took, row_number() OVER (PARTITION BY region_id ORDER BY score >= 0.97 DESC, score DESC, y0, x0) AS place FROM s)
SELECT region_id, place, y0, x0, round(score, 6) AS score, CASE WHEN score < 0.97 THEN 'insufficient_overlap_0.97:' || least(took, 3) || '/3' END AS fallback_reason FROM p WHERE place <= 3""")
def drawn_lesion_boxes(spark, d):
    """The three best candidates of each region, those under the cutoff with a reason."""
    out = R.lesion_boxes(lesion_runs(boxes(spark, d)), 12, 3, 96, 42, 0.97, 608, 608, _REGION)
    return out.select("region_id", "place", "y0", "x0", r6(F.col("score")).alias("score"), "fallback_reason")


_CLASS = "CASE WHEN pathology = 'MALIGNANT' THEN 'malignant' ELSE 'benign' END || '_' || CASE lesion_type WHEN 'Mass' THEN 'mass' ELSE 'calcification' END"
CLASSES = ("background", "benign_calcification", "benign_mass", "malignant_calcification", "malignant_mass")


def _classed(spark, d):
    name = F.concat_ws("_", F.when(F.col("pathology") == "MALIGNANT", "malignant").otherwise("benign"), F.when(F.col("lesion_type") == "Mass", "mass").otherwise("calcification"))
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(CLASSES) for x in (c, i)])
    return boxes(spark, d).withColumn("patch_class", name).withColumn("class_id", ids[F.col("patch_class")])


_IDS = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES))
_PC = f"c AS (SELECT *, {_CLASS} AS patch_class FROM b)"


@query(X + f"""{_PC}, r AS (SELECT CASE WHEN y0 % 50 = 0 THEN 'unknown' ELSE patch_class END AS patch_class, CASE patch_class {_IDS} END + (x0 % 40 = 1)::INT AS class_id, CASE WHEN x0 % 30 = 2 THEN NULL ELSE box_id END AS box_id FROM c)
SELECT 'known_class' AS rule, count(*) AS n FROM r WHERE patch_class = 'unknown' HAVING count(*) > 0
UNION ALL SELECT 'id_of_class', count(*) FROM r WHERE patch_class = 'unknown' OR class_id <> CASE patch_class {_IDS} END HAVING count(*) > 0
UNION ALL SELECT 'path', count(*) FROM r WHERE box_id IS NULL HAVING count(*) > 0""")
def reader_rules(spark, d):
    """Rules of the patch reader on a manifest with padded names, unknown classes, wrong ids and lost paths."""
    c = _classed(spark, d)
    raw = c.select(F.concat(F.lit(" "), F.when(F.col("y0") % 50 == 0, "unknown").otherwise(F.col("patch_class"))).alias("patch_class"), (F.col("class_id") + (F.col("x0") % 40 == 1).cast("int")).alias("class_id"), F.when(F.col("x0") % 30 == 2, " ").otherwise(F.col("box_id")).alias("patch_path"))
    clean = raw.withColumns({x: F.nullif(F.trim(x), F.lit("")) for x in ("patch_class", "patch_path")})
    ids = F.create_map(*[F.lit(x) for i, name in enumerate(CLASSES) for x in (name, i)])
    rules = {"known_class": F.col("patch_class").isin(*CLASSES), "id_of_class": ids[F.col("patch_class")] == F.col("class_id"), "path": F.col("patch_path").isNotNull()}
    return C.violations(clean, rules)


@query(X + f"{_PC} SELECT box_id, image_id, patch_class, CASE patch_class {_IDS} END AS class_id FROM c")
def patch_class(spark, d):
    return _classed(spark, d).select("box_id", "image_id", "patch_class", "class_id")


@query(X + "x AS (SELECT 1) SELECT image_id, box_id, substr(sha256(concat_ws('|', '42', 'train', image_id, box_id, 'lesion', '0')), 1, 24) AS patch_id FROM b")
def patch_id(spark, d):
    return boxes(spark, d).select("image_id", "box_id", make_id(42, "train", F.col("image_id"), F.col("box_id"), "lesion", 0).alias("patch_id"))


@query(X + "x AS (SELECT 1) SELECT image_id, box_id, sha256('42' || chr(31) || image_id || chr(31) || box_id) AS rank FROM b")
def stable_rank_(spark, d):
    return boxes(spark, d).select("image_id", "box_id", stable_rank(42, F.col("image_id"), F.col("box_id")).alias("rank"))


_PATCH = X + f"{_PC}, s AS ({SP}), m AS (SELECT c.*, s.patient_id, s.split FROM c JOIN s USING (image_id) WHERE s.split <> 'test')"


def _patches(spark, d):
    s = splits(spark, d).filter("split <> 'test'").select("image_id", "patient_id", "split")
    return _classed(spark, d).join(s, "image_id")


@query(_PATCH + f" SELECT substr(sha256(concat_ws('|', '42', split, image_id, box_id, 'lesion', '0')), 1, 24) AS patch_id, image_id, patient_id, split, patch_class, CASE patch_class {_IDS} END AS class_id, y0, x0, y1, x1 FROM m")
def patch_manifest(spark, d):
    return _patches(spark, d).select(make_id(42, F.col("split"), F.col("image_id"), F.col("box_id"), "lesion", 0).alias("patch_id"), "image_id", "patient_id", "split", "patch_class", "class_id", "y0", "x0", "y1", "x1")


_PLANTED = _PATCH + f""", z AS (SELECT CASE WHEN y0 % 59 = 19 THEN 'same' ELSE box_id END AS patch_id, patient_id,
  CASE WHEN y0 % 97 = 3 THEN 'test' WHEN x0 % 89 = 5 THEN CASE split WHEN 'train' THEN 'val' ELSE 'train' END ELSE split END AS split,
  CASE WHEN y0 % 71 = 13 THEN 'unknown' ELSE patch_class END AS patch_class, CASE patch_class {_IDS} END + (x0 % 67 = 15)::INT AS class_id,
  CASE WHEN (x0 + y0) % 2 = 0 THEN 'background' ELSE 'lesion' END AS patch_kind, CASE WHEN (x0 + y0) % 2 = 1 THEN 100 WHEN y0 % 61 = 17 THEN 5 ELSE 0 END AS px,
  CASE WHEN x0 % 83 = 7 THEN -1 ELSE y0 END AS y0, x0, CASE WHEN y0 % 79 = 11 THEN 700 ELSE y1 END AS y1, CASE WHEN x0 % 73 = 9 THEN x0 ELSE x1 END AS x1 FROM m),
lk AS (SELECT DISTINCT patient_id, split FROM s)"""


@query(_PLANTED + f""" SELECT 'known_split' AS rule, count(*) AS n FROM z WHERE split NOT IN ('train', 'val') HAVING count(*) > 0
UNION ALL SELECT 'known_class', count(*) FROM z WHERE patch_class = 'unknown' HAVING count(*) > 0
UNION ALL SELECT 'class_id', count(*) FROM z WHERE patch_class = 'unknown' OR class_id <> CASE patch_class {_IDS} END HAVING count(*) > 0
UNION ALL SELECT 'inside_source', count(*) FROM z WHERE y0 < 0 OR x0 < 0 OR y1 > 608 OR x1 > 608 OR y1 <= y0 OR x1 <= x0 HAVING count(*) > 0
UNION ALL SELECT 'background_off_regions', count(*) FROM z WHERE patch_kind = 'background' AND px <> 0 HAVING count(*) > 0
UNION ALL SELECT 'locked_' || split, count(*) FROM z WHERE split IN ('train', 'val') AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.patient_id = z.patient_id AND lk.split = z.split) GROUP BY split
UNION ALL SELECT 'patient_in_one_split', count(*) FROM (SELECT patient_id FROM z GROUP BY 1 HAVING count(DISTINCT split) > 1) HAVING count(*) > 0
UNION ALL SELECT 'unique_id', count(*) - count(DISTINCT patch_id) FROM z HAVING count(*) > count(DISTINCT patch_id)""")
def patch_rules(spark, d):
    """Every rule of a patch manifest, on one with a fault of each kind planted."""
    y0, x0 = F.col("y0"), F.col("x0")
    other = F.when(F.col("split") == "train", "val").otherwise("train")
    background = (x0 + y0) % 2 == 0
    planted = _patches(spark, d).select(
        F.when(y0 % 59 == 19, "same").otherwise(F.col("box_id")).alias("patch_id"), "patient_id", F.when(y0 % 97 == 3, "test").when(x0 % 89 == 5, other).otherwise(F.col("split")).alias("split"),
        F.when(y0 % 71 == 13, "unknown").otherwise(F.col("patch_class")).alias("patch_class"), (F.col("class_id") + (x0 % 67 == 15).cast("int")).alias("class_id"),
        F.when(background, "background").otherwise("lesion").alias("patch_kind"), F.when(~background, 100).when(y0 % 61 == 17, 5).otherwise(0).alias("roi_overlap_px"),
        F.when(x0 % 83 == 7, -1).otherwise(y0).alias("y0"), "x0", F.when(y0 % 79 == 11, 700).otherwise(F.col("y1")).alias("y1"), F.when(x0 % 73 == 9, x0).otherwise(F.col("x1")).alias("x1"), F.lit(608).alias("source_height"), F.lit(608).alias("source_width"),
    )
    return R.manifest_violations(planted, splits(spark, d), CLASSES)


def _whole_manifest(spark, d):
    """Lesion and background patches of the images of train and val."""
    regions = _patches(spark, d).withColumnRenamed("box_id", "region_id")
    named = ("image_id", "patient_id", "split", "patch_class", "region_id")
    rows = regions.select(*named, "y0", "x0", F.explode(F.array(*[F.lit(x) for x in (0, 10, 20, 30, 40)])).alias("dy"))
    runs = rows.select(*named, (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dy")).alias("xs"), (F.col("x0") + 20 + 2 * F.col("dy")).alias("xe"))
    tissue = regions.select("image_id").distinct().select("image_id", F.lit(0).alias("y0"), F.lit(608).alias("y1"), F.lit(0).alias("x0"), (150 + F.col("image_id") % 300).alias("x1"))
    return R.patch_manifest(regions, runs, tissue, CLASSES, lesion=2, background=3, candidates=6, attempts=30, size=96, seed=42, cutoff=0.97, height=608, width=608)


_WHOLE = _PATCH + f""", q AS (SELECT box_id AS region_id, y0 + dy AS y, x0 + dy AS xs, x0 + 20 + 2 * dy AS xe FROM m, (SELECT unnest([0, 10, 20, 30, 40]) AS dy)), {_CENTRES.replace("range(1, 12)", "range(1, 6)")},
h AS (SELECT bx.*, sum(greatest(0, least(w.xe, x0 + 96) - greatest(w.xs, x0))) FILTER (w.y >= y0 AND w.y < y0 + 96) AS px, max(area) AS area FROM bx JOIN w ON w.region_id = bx.region_id JOIN a ON a.region_id = bx.region_id GROUP BY bx.region_id, y0, x0),
sc AS (SELECT *, greatest(coalesce(px, 0) / area, coalesce(px, 0) / 9216) AS score FROM h),
pl AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY score >= 0.97 DESC, score DESC, y0, x0) AS place FROM sc),
bo AS (SELECT * FROM b), bg AS (WITH b AS (SELECT * FROM m), {_BACKGROUND}),
man AS (SELECT m.image_id, m.box_id AS region_id, m.patient_id, m.split, m.patch_class, 'lesion' AS patch_kind, pl.place, pl.y0, pl.x0, round(pl.score, 6) AS roi_overlap, NULL::DOUBLE AS tissue_fraction FROM pl JOIN m ON m.box_id = pl.region_id WHERE pl.place <= 2
UNION ALL SELECT bg.image_id, bg.anchor, o.patient_id, o.split, 'background', 'background', bg.place, bg.y0, bg.x0, 0.0, bg.tissue_fraction FROM bg JOIN (SELECT DISTINCT image_id, patient_id, split FROM m) o ON o.image_id = bg.image_id)"""


@query(_WHOLE + f" SELECT substr(sha256(concat_ws('|', '42', split, image_id, region_id, patch_kind, place - 1)), 1, 24) AS patch_id, image_id, region_id, patient_id, split, patch_class, CASE patch_class {_IDS} END AS class_id, patch_kind, place, y0, x0, roi_overlap, tissue_fraction FROM man")
def whole_manifest(spark, d):
    """The patch manifest with drawn lesion boxes and background boxes."""
    return _whole_manifest(spark, d).select("patch_id", "image_id", "region_id", "patient_id", "split", "patch_class", "class_id", "patch_kind", "place", "y0", "x0", r6(F.col("roi_overlap")).alias("roi_overlap"), r6(F.col("tissue_fraction")).alias("tissue_fraction"))


@query(_PATCH + " SELECT split, patch_class, count(*) AS n, count(DISTINCT patient_id) AS patients FROM m GROUP BY GROUPING SETS ((split, patch_class), (split), ())")
def patch_counts(spark, d):
    p = _patches(spark, d)
    return p.groupingSets([["split", "patch_class"], ["split"], []], "split", "patch_class").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"))


@query(_WHOLE + f""", ct AS (SELECT sp.v AS split, pc.v AS patch_class, (SELECT count(*) FROM man WHERE man.split = sp.v AND man.patch_class = pc.v) AS n FROM (SELECT unnest(['train', 'val']) AS v) sp, (SELECT unnest({list(CLASSES)}) AS v) pc)
SELECT split, patch_class, n, 'missing' AS problem FROM ct WHERE n = 0 UNION ALL SELECT NULL, patch_class, sum(n)::BIGINT, 'few' FROM ct GROUP BY 2 HAVING sum(n) < 30000""")
def class_coverage(spark, d):
    """Classes that a split of the whole manifest lacks, and classes of under 30,000 patches."""
    return R.class_coverage(_whole_manifest(spark, d), CLASSES, 30000)


_METRIC = u_sql("9", "image_id", "box_id")
_ONE = f", q AS (SELECT *, {_METRIC} AS metric FROM m), u AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY metric, box_id) AS k FROM q), v AS (SELECT *, row_number() OVER (PARTITION BY split, patch_class ORDER BY metric, box_id) - 1 AS nth, count(*) OVER (PARTITION BY split, patch_class) AS cnt FROM u WHERE k = 1), sel AS (SELECT * FROM v WHERE list_contains(list_transform(range(4), lambda i: (i * (cnt - 1)) // 3), nth))"


def _review(spark, d):
    p = _patches(spark, d).withColumn("metric", keyed_uniform(9, F.col("image_id"), F.col("box_id")))
    one = p.withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy("metric", "box_id"))).filter("k = 1")
    return R.spread(one, ["split", "patch_class"], 4, "metric", "box_id", strict=False)


@query(f"{X} m AS (SELECT *, round_even(greatest(y1 - y0, x1 - x0) * 0.75, 0)::INT AS margin FROM b) SELECT image_id, box_id, greatest(0, y0 - margin)::INT AS cy0, least(600, y1 + margin)::INT AS cy1, greatest(0, x0 - margin)::INT AS cx0, least(600, x1 + margin)::INT AS cx1 FROM m")
def context_window(spark, d):
    """The surroundings of each box in a frame of 600 by 600."""
    out = R.context_window(boxes(spark, d), 0.75, F.lit(600), F.lit(600))
    return out.select("image_id", "box_id", *[F.col(c).cast("int").alias(c) for c in ("cy0", "cy1", "cx0", "cx1")])


@query()
def review_strategies(spark, d):
    """Six patches by each strategy, one an image, no image twice."""
    metric = {"metric": keyed_uniform(9, F.col("image_id"), F.col("box_id")), "rank": keyed_uniform(10, F.col("image_id"), F.col("box_id"))}
    one = R.one_per_unit(_patches(spark, d).select("split", "image_id", "box_id").withColumns(metric), "image_id", F.col("rank"), "metric")
    # kept as ids alone, for each strategy passes over the rows several times
    one, taken = cut(one.select("split", "image_id", "box_id")).withColumns(metric), None
    for strategy in ("spread", "lowest", "ranked"):
        chosen = R.take_partitioned(one, 6, strategy, F.col("rank"), "metric", "box_id", taken).withColumn("strategy", F.lit(strategy))
        chosen = cut(chosen.select("strategy", "split", "image_id", "box_id"))
        taken = chosen if taken is None else taken.unionByName(chosen)
    return taken.select("strategy", "split", "image_id", "box_id")


@query(_PATCH + _ONE + " SELECT split, patch_class, image_id, box_id FROM sel")
def review_select(spark, d):
    return _review(spark, d).select("split", "patch_class", "image_id", "box_id")


@query(_PATCH + _ONE + " SELECT split, patch_class, count(*) AS n FROM sel GROUP BY 1, 2")
def review_counts(spark, d):
    return _review(spark, d).groupBy("split", "patch_class").agg(F.count("*").alias("n"))


@query(_PATCH + _ONE + """, f AS (SELECT m.*, (x0 + y0) % 2 = 0 AS bg, y0 % 5 = 1 AS fallback FROM m), ch AS (SELECT sel.*, x0 % 7 <> 0 AS exact, CASE WHEN y0 % 9 = 0 THEN 3 ELSE 0 END AS px, (x0 + y0) % 2 = 0 AS bg FROM sel)
SELECT 'n_patches' AS item, count(*) AS n FROM f UNION ALL SELECT 'n_patients', count(DISTINCT patient_id) FROM f UNION ALL SELECT 'n_fallback_patches', count(*) FROM f WHERE fallback UNION ALL SELECT 'n_background_patches', count(*) FROM f WHERE bg
UNION ALL SELECT 'n_checked', count(*) FROM ch UNION ALL SELECT 'n_exact_matches', count(*) FROM ch WHERE exact UNION ALL SELECT 'n_background_overlaps', count(*) FROM ch WHERE bg AND px > 0
UNION ALL SELECT 'selected/' || patch_class, count(*) FROM sel GROUP BY patch_class UNION ALL SELECT 'selected/' || patch_class || '/' || split, count(*) FROM sel GROUP BY patch_class, split""")
def review_summary(spark, d):
    """Counts of a manifest, of the rows chosen for review and of their checks."""
    kind = F.when((F.col("x0") + F.col("y0")) % 2 == 0, "background").otherwise("lesion")
    manifest = _patches(spark, d).withColumns({"patch_kind": kind, "fallback_reason": F.when(F.col("y0") % 5 == 1, "few")})
    chosen = _review(spark, d).withColumn("audit_group", F.col("patch_class"))
    checks = chosen.select((F.col("x0") % 7 != 0).alias("exact"), kind.alias("patch_kind"), F.when(F.col("y0") % 9 == 0, 3).otherwise(0).alias("roi_overlap_px"))
    return R.review_summary(manifest, chosen, checks)


@query(X + f"{_RUNS}, {_HIT}, w AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (score >= 0.1) DESC, score DESC, y0, x0, box_id) AS place FROM o) SELECT image_id::VARCHAR AS image_id, box_id AS patch_id, score < 0.1 AS has_reason, 0::BIGINT AS null_reasons FROM w WHERE place <= 2")
def normalised_manifest(spark, d):
    """Ids as text, and an empty reason where there is none."""
    out = R.normalised_names(R.best_boxes(_scored(spark, d), ["image_id"], 2, 0.1).withColumnRenamed("box_id", "patch_id"))
    return out.select("image_id", "patch_id", (F.col("fallback_reason") != "").alias("has_reason"), F.col("fallback_reason").isNull().cast("bigint").alias("null_reasons"))


@query(_PATCH + f", q AS (SELECT *, row_number() OVER (PARTITION BY patch_class ORDER BY {_METRIC}, box_id) AS k FROM m) SELECT patch_class, image_id, box_id, k FROM q WHERE k <= 25")
def hardest(spark, d):
    p = _patches(spark, d).withColumn("metric", keyed_uniform(9, F.col("image_id"), F.col("box_id")))
    k = F.row_number().over(Window.partitionBy("patch_class").orderBy("metric", "box_id"))
    return p.withColumn("k", k).filter("k <= 25").select("patch_class", "image_id", "box_id", "k")


_PX = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS pos FROM embeddings), q AS (SELECT vec_id, round(avg((v > 0)::INT), 6) AS mask_fraction, min(pos // 8) FILTER (v > 0) AS y0, max(pos // 8) FILTER (v > 0) + 1 AS y1, count(*) FILTER (v > 0.1 AND pos % 8 = 0) AS edge_saturated FROM e GROUP BY 1)"


def _image_qa(spark, d):
    c = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    on, y = F.col("v") > 0, F.floor(F.col("pos") / 8)
    return c.groupBy("vec_id").agg(r6(F.avg(on.cast("int"))).alias("mask_fraction"), F.min(F.when(on, y)).alias("y0"), (F.max(F.when(on, y)) + 1).alias("y1"), F.count_if((F.col("v").cast("double") > 0.1) & (F.col("pos") % 8 == 0)).alias("edge_saturated"))


@query(f"WITH {_PX} SELECT * FROM q")
def image_qa(spark, d):
    return _image_qa(spark, d)


@query(f"WITH {_PX} SELECT vec_id, concat_ws('; ', CASE WHEN mask_fraction < 0.45 THEN 'small_mask' END, CASE WHEN mask_fraction > 0.6 THEN 'full_frame' END, CASE WHEN edge_saturated >= 4 THEN 'saturated_edge' END) AS flags FROM q WHERE mask_fraction < 0.45 OR mask_fraction > 0.6 OR edge_saturated >= 4")
def qa_flags(spark, d):
    m = F.col("mask_fraction")
    flags = F.concat_ws("; ", F.when(m < 0.45, "small_mask"), F.when(m > 0.6, "full_frame"), F.when(F.col("edge_saturated") >= 4, "saturated_edge"))
    return _image_qa(spark, d).select("vec_id", flags.alias("flags")).filter(F.length("flags") > 0)


_GRID = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS pos FROM embeddings),
c AS (SELECT vec_id, pos // 8 AS y, pos % 8 AS x, greatest(0, v) AS v, (v > 0 OR (vec_id % 3 = 0 AND pos % 8 < 2)) AS m, CASE WHEN vec_id % 3 = 0 AND pos % 8 < 2 THEN 0.01 ELSE greatest(0, v) END AS p FROM e)"""


@query(_GRID + """, s AS (SELECT vec_id, band, count(*) AS n, count(*) FILTER (m) AS held, avg(p) FILTER (m) AS mean FROM c, (SELECT unnest(['top', 'bottom', 'left', 'right']) AS band)
  WHERE CASE band WHEN 'top' THEN y < 2 WHEN 'bottom' THEN y >= 6 WHEN 'left' THEN x < 2 ELSE x >= 6 END GROUP BY 1, 2)
SELECT vec_id, bool_or(held > 0.2 * n AND coalesce(mean < 0.02, false)) AS black_stripe FROM s GROUP BY 1""")
def black_stripe(spark, d):
    """Grids of 8 x 8, a third of them with a dark band of two columns that the mask holds."""
    dark = (F.col("vec_id") % 3 == 0) & (F.col("x") < 2)
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", (F.col("pos") % 8).alias("x"), F.col("v").cast("double").alias("v"))
    flat = cells.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(dark, 0.01).otherwise(F.greatest(F.lit(0.0), F.col("v"))).alias("p"), ((F.col("v") > 0) | dark).cast("int").alias("m")))).alias("c"))
    grid = lambda field: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.slice("c", y * 8 + 1, 8), lambda e: e[field]))
    return flat.select("vec_id", R.black_stripe(grid("p"), grid("m"), 2).alias("black_stripe"))


@query(f"WITH b AS ({ABN_SQL}), z AS (SELECT lesion_type, sqrt((part % 97 + 1) ** 2 + (supp % 89 + 1) ** 2) AS diagonal FROM b) SELECT lesion_type, count(*) AS n, round(avg(diagonal), 6) AS mean, round(quantile_cont(diagonal, 0.5), 6) AS median, round(avg((diagonal <= 64)::INT), 6) AS fits FROM z GROUP BY 1")
def size_profile(spark, d):
    diag = F.hypot((F.col("part") % 97 + 1).cast("double"), (F.col("supp") % 89 + 1).cast("double"))
    z = abnormalities(spark, d).select("lesion_type", diag.alias("diagonal"))
    return z.groupBy("lesion_type").agg(F.count("*").alias("n"), r6(F.avg("diagonal")).alias("mean"), r6(F.percentile("diagonal", 0.5)).alias("median"), r6(F.avg((F.col("diagonal") <= 64).cast("int"))).alias("fits"))


@query("WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings) SELECT vec_id, round(list_sum(list_transform(a, lambda x: (x - list_min(a)) / (list_max(a) - list_min(a) + 1e-8))), 4) AS scaled_sum, round((a[1] - 0.485) / 0.229, 6) AS first FROM m")
def array_scale(spark, d):
    a = F.col("a")
    m = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a")).withColumn("lo", F.array_min("a")).withColumn("hi", F.array_max("a"))
    scaled = F.transform(a, lambda x: (x - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8))
    return m.select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x), 4).alias("scaled_sum"), r6((a[0] - 0.485) / 0.229).alias("first"))


@query("SELECT vec_id, array_to_string(list_transform(embedding[19:21] || embedding[27:29] || embedding[35:37], lambda x: round(x::DOUBLE, 5)), ',') = '' AS empty, len(embedding[19:21] || embedding[27:29] || embedding[35:37]) AS n, round(list_sum(list_transform(embedding[19:21] || embedding[27:29] || embedding[35:37], lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def patch_crop(spark, d):
    """Rows 2 to 4 and columns 2 to 4 of an 8 x 8 array in row order."""
    crop = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda y: F.slice("embedding", y * 8 + 3, 3)))
    t = table(spark, d, "embeddings").select("vec_id", crop.alias("c"))
    return t.select("vec_id", (F.size("c") == 0).alias("empty"), F.size("c").cast("bigint").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 11 = 0 THEN 'shape' ELSE 'values' END AS fault, CASE WHEN vec_id % 7 <> 0 AND vec_id % 11 <> 0 THEN 20 END::BIGINT AS place FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0")
def patch_verify(spark, d):
    """Arrays cut into rows and put together again, of which some are gone, some are short and some have a changed value."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    again = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("a", y * 8 + 1, 8)))
    changed = F.transform(again, lambda x, i: F.when((i == 19) & (F.col("vec_id") % 13 == 0), x + 1).otherwise(x).cast("float"))
    rebuilt = v.filter("vec_id % 7 <> 0").select("vec_id", F.when(F.col("vec_id") % 11 == 0, F.slice(again, 1, 56)).otherwise(changed).alias("a"))
    return K.array_faults(v, rebuilt, "vec_id")
