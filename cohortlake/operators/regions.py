"""Boxes, regions and their overlaps; boxes are end-exclusive."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import box_from_center, keyed_uniform, stable_id
from .cohort import violations
from .prefix import along


BAND = 64  # rows of an image that meet in one lookup


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def roi_overlap(boxes: DataFrame, runs: DataFrame, image: str | Sequence[str] = "image_id") -> DataFrame:
    """The boxes with px, coverage, fraction, score against mask runs (y, xs, xe); no pixels give 0.

    A box meets the runs of the bands of rows that it covers: boxes and runs are one
    table, in which the runs of a band are a list, at most the runs that fit into
    the band. No join deals them again, so what is dealt by image, or by a part of
    a key of several columns, stays where it is. Boxes and runs are the distinct
    ones of their image.
    """
    keys, own = _names(image), boxes.columns
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    run = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("y", "xs", "xe")])
    banded = boxes.withColumns({"__band": F.explode_outer(F.sequence(F.floor(F.col("y0") / BAND), F.floor((F.greatest("y1", F.col("y0") + 1) - 1) / BAND))), "__box": F.lit(True)})
    rows = banded.unionByName(runs.select(*keys, F.floor(F.col("y") / BAND).alias("__band"), run.alias("__run")), allowMissingColumns=True)
    band, whole = Window.partitionBy(*keys, "__band"), Window.partitionBy(*keys)
    rows = rows.withColumn("__runs", F.collect_list("__run").over(band)).withColumn("__area", F.sum(F.col("__run.xe") - F.col("__run.xs")).over(whole))
    inside = lambda r: (r["y"] >= F.col("y0")) & (r["y"] < F.col("y1")) & (r["xs"] < F.col("x1")) & (r["xe"] > F.col("x0"))
    px = F.aggregate("__runs", F.lit(0).cast("bigint"), lambda n, r: n + F.when(inside(r), F.least(r["xe"], F.col("x1")) - F.greatest(r["xs"], F.col("x0"))).otherwise(0))
    out = rows.filter("__box").select(*own, F.when(known, F.col("__area")).alias("__area"), F.when(known, px).otherwise(0).alias("px")).groupBy(*own, "__area").agg(F.sum("px").alias("px"))
    size = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    out = out.withColumn("coverage", F.coalesce(F.try_divide("px", "__area"), F.lit(0.0))).withColumn("fraction", F.col("px") / size)
    return out.withColumn("score", F.greatest("coverage", "fraction")).withColumnRenamed("__area", "area")


def union_pixels(runs: DataFrame, image: str = "image_id") -> DataFrame:
    """image, px: how many pixels the runs (y, xs, xe) of an image cover together; no pixel is a row.

    Along a row of the image a run adds what lies right of all runs before it.
    """
    before = F.max("xe").over(Window.partitionBy(image, "y").orderBy("xs", "xe").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("xe") - F.greatest(F.col("xs"), before), F.lit(0))
    return runs.filter("xe > xs").select(image, new.cast("bigint").alias("new")).groupBy(image).agg(F.sum("new").alias("px"))


PIXELS = 4096  # places of a region that meet in one lookup


def lesion_candidates(runs: DataFrame, n: int, size: int, seed: int, height: int, width: int, unit: str | Sequence[str] = "region_id") -> DataFrame:
    """unit, box_id, y0, x0, y1, x1: the distinct boxes around n centres of each region, given by its mask runs (y, xs, xe).

    The first centre is the centroid, rounded to even; the others are drawn pixels
    of the region. A drawn number is a place in the region's order of rows and
    columns, and the run that holds it is the last that starts before it, so no
    pixel is ever a row. Boxes are moved inside the frame; a frame under ``size``
    and a region without pixels give no rows. Runs of a region do not overlap. The
    last name of ``unit`` is the region's, which the draws depend on; others before
    it, such as the image, only say where the runs lie: dealt by any of them they
    stay there. The runs of one region, at most a mask's, are numbered in one task.
    """
    keys = _names(unit)
    length = (F.col("xe") - F.col("xs")).cast("bigint")
    held = runs.select(*keys, "y", "xs", "xe").filter(length > 0)
    middle = (F.col("xs") + F.col("xe") - 1) / 2
    regions = held.groupBy(*keys).agg(F.sum(length).alias("area"), F.sum(F.col("y") * length).alias("sy"), F.sum(middle * length).alias("sx"))
    centres = regions.select(*keys, F.bround(F.col("sy") / F.col("area")).cast("int").alias("cy"), F.bround(F.col("sx") / F.col("area")).cast("int").alias("cx"))
    if n > 1:
        own = Window.partitionBy(*keys).orderBy("y", "xs").rowsBetween(Window.unboundedPreceding, 0)
        placed = held.withColumn("upto", F.sum(length).over(own)).withColumn("at", F.col("upto") - length)
        placed = placed.select(*keys, F.explode(F.sequence(F.floor(F.col("at") / PIXELS), F.floor((F.col("upto") - 1) / PIXELS))).alias("bin"), "at", F.struct("y", "xs", "at").alias("run"))
        draws = regions.select(*keys, "area", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("draw"))
        drawn = draws.select(*keys, F.floor(keyed_uniform(seed, F.col(keys[-1]), F.col("draw")) * F.col("area")).alias("at")).distinct().withColumn("bin", F.floor(F.col("at") / PIXELS))
        both = placed.unionByName(drawn, allowMissingColumns=True)
        upto = Window.partitionBy(*keys, "bin").orderBy("at", F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("in", F.last("run", ignorenulls=True).over(upto)).filter("run is null")
        centres = centres.unionByName(found.select(*keys, F.col("in.y").cast("int").alias("cy"), (F.col("in.xs") + F.col("at") - F.col("in.at")).cast("int").alias("cx")))
    box = centres.select(*keys, box_from_center(F.col("cy"), F.col("cx"), size, F.lit(height), F.lit(width)).alias("box")).filter("box is not null")
    return box.select(*keys, "box.*").distinct().withColumn("box_id", F.concat_ws(":", "y0", "x0"))


def lesion_boxes(runs: DataFrame, n: int, k: int, size: int, seed: int, cutoff: float, height: int, width: int, unit: str | Sequence[str] = "region_id") -> DataFrame:
    """The k best of n candidates a region with px, coverage, fraction, score, place and fallback_reason."""
    return best_boxes(roi_overlap(lesion_candidates(runs, n, size, seed, height, width, unit), runs, unit), _names(unit), k, cutoff)


def patch_manifest(regions: DataFrame, runs: DataFrame, tissue: DataFrame, classes: Sequence[str], *, lesion: int, background: int, candidates: int, attempts: int, size: int, seed: int, cutoff: float, height: int, width: int) -> DataFrame:
    """One row a patch: the best ``lesion`` drawn boxes of each region and ``background`` boxes of each image, with ids, classes and overlaps.

    ``regions`` has region_id, image_id, patient_id, split, patch_class and the
    region's box y0, x0, y1, x1; ``runs`` the mask runs by region_id, which move less
    if they have the names of their region too; ``tissue`` disjoint rectangles by image_id. Background boxes touch no region's box, are
    anchored to the image's regions in turn and have the first of ``classes``.
    """
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    named = ["image_id", "patient_id", "split", "patch_class", "region_id"]
    if set(named) <= set(runs.columns):
        lesions = lesion_boxes(runs, candidates, lesion, size, seed, cutoff, height, width, named)
    else:
        lesions = lesion_boxes(runs, candidates, lesion, size, seed, cutoff, height, width).join(regions.select(*named), "region_id")
    lesions = lesions.select("image_id", "region_id", "patient_id", "split", "patch_class", F.lit("lesion").alias("patch_kind"), "place", "y0", "x0", "y1", "x1", F.col("score").alias("roi_overlap"), F.col("coverage").alias("roi_coverage"), F.col("fraction").alias("patch_lesion_fraction"), F.col("px").cast("bigint").alias("roi_overlap_px"), F.lit(None).cast("double").alias("tissue_fraction"), "fallback_reason")
    boxes = regions.select("image_id", F.col("region_id").alias("box_id"), "y0", "x0", "y1", "x1")
    free = background_boxes(boxes, boxes, tissue, background, size, attempts, seed, height, width).join(regions.select("image_id", "patient_id", "split").distinct(), "image_id")
    zero = F.lit(0.0)
    free = free.select("image_id", F.col("anchor").alias("region_id"), "patient_id", "split", F.lit(classes[0]).alias("patch_class"), F.lit("background").alias("patch_kind"), "place", "y0", "x0", "y1", "x1", zero.alias("roi_overlap"), zero.alias("roi_coverage"), zero.alias("patch_lesion_fraction"), F.lit(0).cast("bigint").alias("roi_overlap_px"), "tissue_fraction", F.lit(None).cast("string").alias("fallback_reason"))
    out = lesions.unionByName(free)
    ident = stable_id(seed, F.col("split"), F.col("image_id"), F.col("region_id"), F.col("patch_kind"), F.col("place") - 1)
    return out.select(ident.alias("patch_id"), "*", ids[F.col("patch_class")].alias("class_id"), F.lit(height).alias("source_height"), F.lit(width).alias("source_width"))


def manifest_violations(manifest: DataFrame, locked: DataFrame, classes: Sequence[str]) -> DataFrame:
    """rule, n of every rule that the manifest breaks; no rows: it is sound.

    Rules of a row count rows: known split, known class, class of the id, box with
    area inside its source, background off all regions, patient in the locked
    split (``locked``: patient_id, split). Patients in several splits count
    patients, repeated ids the rows after the first, an empty manifest one.
    """
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    inside = (F.col("y0") >= 0) & (F.col("x0") >= 0) & (F.col("y1") <= F.col("source_height")) & (F.col("x1") <= F.col("source_width")) & (F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0"))
    rows = {
        "known_split": F.col("split").isin("train", "val"),
        "known_class": F.col("patch_class").isin(*classes),
        "class_id": ids[F.col("patch_class")] == F.col("class_id"),
        "inside_source": inside,
        "background_off_regions": (F.col("patch_kind") != "background") | (F.col("roi_overlap_px") == 0),
    }
    developed = manifest.filter(F.col("split").isin("train", "val"))
    outside = developed.join(locked.select("patient_id", "split").distinct(), ["patient_id", "split"], "left_anti")
    outside = outside.groupBy(F.concat(F.lit("locked_"), "split").alias("rule")).agg(F.count("*").alias("n"))
    several = manifest.groupBy("patient_id").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("patient_in_one_split").alias("rule"), "n")
    again = manifest.groupBy("patch_id").agg((F.count("*") - 1).alias("k")).agg(F.sum("k").alias("n")).select(F.lit("unique_id").alias("rule"), F.coalesce("n", F.lit(0)).alias("n"))
    empty = manifest.agg((F.count("*") == 0).cast("bigint").alias("n")).select(F.lit("not_empty").alias("rule"), "n")
    return violations(manifest, rows).unionByName(outside).unionByName(several).unionByName(again).unionByName(empty).filter("n > 0")


def class_coverage(manifest: DataFrame, classes: Sequence[str], least: int, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """split, patch_class, n, problem: classes that a split lacks (missing), and classes of under ``least`` patches over both (few, split null)."""
    spark = manifest.sparkSession
    want = F.broadcast(spark.createDataFrame([(s, c) for s in splits for c in classes], "split string, patch_class string"))
    each = manifest.groupBy("split", "patch_class").agg(F.count("*").alias("n"))
    both = want.join(each, ["split", "patch_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = both.groupBy("patch_class").agg(F.sum("n").alias("n")).filter(F.col("n") < least).select(F.lit(None).cast("string").alias("split"), "patch_class", "n", F.lit("few").alias("problem"))
    return both.filter("n = 0").select("split", "patch_class", "n", F.lit("missing").alias("problem")).unionByName(few)


def black_stripe(clean: Column, mask: Column, band: int) -> Column:
    """Whether one of the four edge bands of a grid is over a fifth in the mask and there under 0.02 in the mean.

    ``clean`` and ``mask`` are arrays of rows. A null grid gives null, an empty one false.
    """

    def side(c: Column) -> list[Column]:
        rows = [F.slice(c, 1, band), F.slice(c, F.greatest(F.size(c) - band + 1, F.lit(1)), F.lit(band))]
        left = F.transform(c, lambda r: F.slice(r, 1, band))
        right = F.transform(c, lambda r: F.slice(r, F.greatest(F.size(r) - band + 1, F.lit(1)), F.lit(band)))
        return [F.flatten(x) for x in (*rows, left, right)]

    found = F.lit(False)
    for values, inside in zip(side(clean), side(mask), strict=True):
        held = F.filter(F.zip_with(values, inside, lambda v, m: F.when(m > 0, v.cast("double"))), lambda v: v.isNotNull())
        mean = F.try_divide(F.aggregate(held, F.lit(0.0), lambda acc, v: acc + v), F.size(held))
        found = found | F.coalesce((F.size(held) > 0.2 * F.size(inside)) & (mean < 0.02), F.lit(False))
    return F.when(clean.isNotNull() & mask.isNotNull(), found)


def free_boxes(boxes: DataFrame, rois: DataFrame, image: str = "image_id") -> DataFrame:
    """Boxes that touch no region box of their image."""
    b, r = boxes.alias("b"), rois.alias("r")
    touch = (F.col(f"b.{image}") == F.col(f"r.{image}")) & (F.col("b.y0") < F.col("r.y1")) & (F.col("b.y1") > F.col("r.y0")) & (F.col("b.x0") < F.col("r.x1")) & (F.col("b.x1") > F.col("r.x0"))
    return b.join(r, touch, "left_anti")


def background_boxes(images: DataFrame, rois: DataFrame, tissue: DataFrame, n: int, size: int, attempts: int, seed: int, height: int, width: int, least: float = 0.5, image: str = "image_id") -> DataFrame:
    """image, place, y0, x0, y1, x1, tissue_fraction, anchor: the first n of ``attempts`` drawn boxes an image.

    A box counts once, touches none of ``rois`` and has ``least`` of its area
    in ``tissue`` (disjoint rectangles). Boxes are anchored to the image's
    regions (box_id) in turn; an image without regions has no anchor. A frame
    under ``size`` gives no rows.
    """

    def draw(axis: str, room: int) -> Column:
        return F.floor(keyed_uniform(seed, F.col(image), F.col("attempt"), axis) * (room - size + 1)).cast("int")

    tries = images.select(image).distinct().withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    if min(height, width) < size:
        tries = tries.limit(0)
    drawn = tries.withColumns({"y0": draw("y", height), "x0": draw("x", width)}).groupBy(image, "y0", "x0").agg(F.min("attempt").alias("attempt"))
    free = free_boxes(drawn.withColumns({"y1": F.col("y0") + size, "x1": F.col("x0") + size}), rois, image)
    b, t = free.alias("b"), tissue.alias("t")
    meet = (F.col(f"b.{image}") == F.col(f"t.{image}")) & (F.col("b.y0") < F.col("t.y1")) & (F.col("b.y1") > F.col("t.y0")) & (F.col("b.x0") < F.col("t.x1")) & (F.col("b.x1") > F.col("t.x0"))
    area = (F.least("b.y1", "t.y1") - F.greatest("b.y0", "t.y0")) * (F.least("b.x1", "t.x1") - F.greatest("b.x0", "t.x0"))
    share = b.join(t, meet).groupBy("b." + image, "b.y0", "b.x0", "b.y1", "b.x1", "b.attempt").agg((F.sum(area) / size**2).alias("tissue_fraction"))
    place = F.row_number().over(Window.partitionBy(image).orderBy("attempt"))
    chosen = share.filter(F.col("tissue_fraction") >= least).withColumn("place", place).filter(F.col("place") <= n).drop("attempt")
    own = rois.withColumns({"turn": F.row_number().over(Window.partitionBy(image).orderBy("box_id")) - 1}).filter(F.col("turn") < n)
    own = own.groupBy(image).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "box_id"))), lambda r: r["box_id"]).alias("ids"))
    return chosen.join(own, image, "left").withColumn("anchor", F.get("ids", (F.col("place") - 1) % F.size("ids"))).drop("ids")


def best_boxes(scored: DataFrame, unit: Sequence[str], k: int, cutoff: float) -> DataFrame:
    """The k best boxes a unit, those over the cutoff first; the rest carry a reason."""
    w = Window.partitionBy(*unit)
    took = F.count_if(F.col("score") >= cutoff).over(w)
    place = F.row_number().over(w.orderBy(F.desc(F.col("score") >= cutoff), F.desc("score"), "y0", "x0", "box_id"))
    reason = F.when(F.col("score") < cutoff, F.format_string("insufficient_overlap_%s:%d/%d", F.lit(str(cutoff)), F.least("took", F.lit(k)), F.lit(k)))
    return scored.withColumn("took", took).withColumn("place", place).filter(F.col("place") <= k).withColumn("fallback_reason", reason).drop("took")


def spread(df: DataFrame, group: Sequence[str], n: int, metric: str, ident: str, strict: bool = True) -> DataFrame:
    """n rows a group at even places of the metric's order; one row is that at half the group's size.

    A group of fewer than n rows is an error, or without ``strict`` is kept whole.
    """
    one = F.lit(1).cast("bigint")
    ranked = along(df, group, [F.col(metric), F.col(ident)], sums={"at": one}, wholes={"cnt": one}).withColumn("at", F.col("at") - 1)
    if strict:
        short = F.concat(F.lit(f"{n} rows are wanted of a group that has "), F.col("cnt").cast("string"))
        ranked = ranked.withColumn("at", F.when(F.col("cnt") < n, F.raise_error(short).cast("bigint")).otherwise(F.col("at")))
    if n == 1:
        return ranked.filter(F.col("at") == F.floor(F.col("cnt") / 2)).drop("at", "cnt")
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("cnt") - 1) / (n - 1)))
    return ranked.filter(F.array_contains(places, F.col("at").cast("bigint"))).drop("at", "cnt")


def one_per_unit(df: DataFrame, unit: str, rank: Column, low: str | None = None) -> DataFrame:
    """One row a unit: that of the lowest ``low``, if given, then of the least rank."""
    order = ([F.col(low)] if low else []) + [rank]
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(unit).orderBy(*order))).filter("__nth = 1").drop("__nth")


def split_quotas(df: DataFrame, n: int, splits: Sequence[str] = ("train", "val"), split: str = "split") -> dict[str, int]:
    """How many of n rows each split gives, near its share, at least one where n allows, the last the rest."""
    counts = {r[split]: r["n"] for r in df.groupBy(split).agg(F.count("*").alias("n")).filter(F.col(split).isin(*splits)).collect()}
    total, there, out = df.count(), [s for s in splits if s in counts], {}
    if total < n:
        raise ValueError(f"{n} rows are wanted of {total}")
    for i, s in enumerate(there):
        left, after = n - sum(out.values()), len(there) - i - 1
        share = max(1 if n >= len(there) else 0, round(n * counts[s] / total))
        out[s] = min(share, counts[s], left - after) if after else left
    return out


def take_partitioned(df: DataFrame, n: int, strategy: str, rank: Column, metric: str, ident: str, taken: DataFrame | None = None, unit: str = "image_id", split: str = "split") -> DataFrame:
    """n rows over the splits by their quotas: ``spread`` over the metric, ``lowest`` of it, or ``ranked`` by a stable rank.

    Units of ``taken`` are left out.
    """
    if strategy not in ("spread", "lowest", "ranked"):
        raise ValueError(f"no such strategy: {strategy}")
    if taken is not None:
        df = df.join(taken.select(unit).distinct(), unit, "left_anti")
    parts = []
    for name, quota in split_quotas(df, n, split=split).items():
        own = df.filter(F.col(split) == name)
        if quota and strategy == "spread":
            parts.append(spread(own, [split], quota, metric, ident))
        elif quota:
            order = [F.col(metric), F.col(ident)] if strategy == "lowest" else [rank, F.col(ident)]
            parts.append(own.orderBy(*order).limit(quota))
    out = parts[0] if parts else df.limit(0)
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


NAMES = ("patch_id", "patch_path", "patient_id", "image_id", "roi_mask_id", "split", "patch_class", "patch_kind", "fallback_reason")


def normalised_names(manifest: DataFrame) -> DataFrame:
    """The manifest with ids and names as text and no reason as an empty one; columns that it lacks stay away."""
    out = manifest.withColumn("fallback_reason", F.coalesce("fallback_reason", F.lit("")))
    return out.withColumns({c: F.col(c).cast("string") for c in NAMES if c in out.columns})


def review_summary(manifest: DataFrame, selection: DataFrame, checks: DataFrame) -> DataFrame:
    """item, n: the size of the manifest, what was chosen by group and by group and split, and what the checks of the chosen found.

    ``selection`` has audit_group and split, ``checks`` exact, patch_kind and roi_overlap_px.
    """
    size = manifest.agg(F.count("*").alias("n_patches"), F.count_distinct("patient_id").alias("n_patients"), F.count_if(F.coalesce("fallback_reason", F.lit("")) != "").alias("n_fallback_patches"), F.count_if(F.col("patch_kind") == "background").alias("n_background_patches"))
    found = checks.agg(F.count("*").alias("n_checked"), F.count_if("exact").alias("n_exact_matches"), F.count_if((F.col("patch_kind") == "background") & (F.col("roi_overlap_px") > 0)).alias("n_background_overlaps"))
    chosen = selection.groupingSets([["audit_group"], ["audit_group", "split"]], "audit_group", "split").agg(F.count("*").alias("n"))
    chosen = chosen.select(F.concat_ws("/", F.lit("selected"), "audit_group", "split").alias("item"), "n")
    return size.unpivot([], size.columns, "item", "n").unionByName(found.unpivot([], found.columns, "item", "n")).unionByName(chosen)


def context_window(boxes: DataFrame, margin_patches: float, height: Column, width: Column) -> DataFrame:
    """Adds cy0, cy1, cx0, cx1: the box with a margin of so many patch sizes, cut at the frame."""
    margin = F.bround(F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) * margin_patches).cast("int")
    zero = F.lit(0)
    return boxes.withColumns({"cy0": F.greatest(zero, F.col("y0") - margin), "cy1": F.least(height, F.col("y1") + margin), "cx0": F.greatest(zero, F.col("x0") - margin), "cx1": F.least(width, F.col("x1") + margin)})


def heatmap_stats(cells: DataFrame, key: str = "case_id", threshold: float = 0.5) -> DataFrame:
    """From cells (key, pos, y, x, v, inside, side): hit, energy, iou, distance, degenerate, roi_share of each heatmap.

    The overlap is of cells at or over ``threshold``, 0 if there is nothing to
    overlap; the distance is of cells at or over half the peak.
    """
    peak = cells.withColumn("top", F.max("v").over(Window.partitionBy(key)))
    over, hot, roi = F.col("v") >= threshold, F.col("v") >= 0.5 * F.col("top"), F.col("inside")
    mean = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    out = peak.groupBy(key).agg(
        F.max_by(F.col("inside"), F.struct("v", -F.col("pos"))).alias("hit"), F.try_divide(F.sum(F.when(roi, F.col("v")).otherwise(0.0)), F.sum("v")).alias("energy"),
        F.coalesce(F.try_divide(F.count_if(over & roi), F.count_if(over | roi)), F.lit(0.0)).alias("iou"), (F.sum("v") <= 0).alias("degenerate"), (F.count_if(roi) / F.count("*")).alias("roi_share"),
        (F.hypot(mean("y", hot) - mean("y", roi), mean("x", hot) - mean("x", roi)) / (F.max("side") * F.sqrt(F.lit(2.0)))).alias("distance"),
    )
    return out.withColumn("energy", F.coalesce("energy", F.lit(0.0)))
