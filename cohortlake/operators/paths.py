"""Resolution of recorded paths against what lies on disk, as equi joins on derived keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The naming conventions of the release.
SERIES = r"^(.+)_(\d+)$"
BARE = r"^(P_\d+_.+?)(?:_(\d+))?\.dcm$"
PREFIX = r"^[A-Za-z]+-(?:Test|Training)_"
SUFFIX = r"_\d+$"


def first_component(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def stem(path: Column) -> Column:
    """The last component without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def folder_series(folders: DataFrame) -> DataFrame:
    """core, bare, lowest (name), series (suffix -> name), one row a core, from distinct folder names.

    ``bare`` cores are those of folders named after patient and view alone, whose
    suffix may be missing and is then 0; other cores come from names that end in a
    number. A name of neither kind has no row. A core has as many entries as a
    patient has views or crops, so a row stays small.
    """
    rows = series_names(folders)
    return rows.groupBy("core", "bare").agg(F.min_by("name", "suffix").alias("lowest"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "name")))).alias("series"))


def series_names(folders: DataFrame) -> DataFrame:
    """core, bare, suffix, name, one row a number of a core: the entries of ``folder_series``."""
    name = F.col("name")
    plain, bare = F.rlike(name, F.lit(SERIES)), F.rlike(name, F.lit(BARE))
    suffix = F.regexp_extract(name, SERIES, 2)
    bare_suffix = F.regexp_extract(name, BARE, 2)
    rows = folders.select("name").filter(plain | bare).select(
        "name", (~plain).alias("bare"), F.when(plain, F.regexp_extract(name, SERIES, 1)).otherwise(F.regexp_extract(name, BARE, 1)).alias("core"),
        F.when(plain, suffix).otherwise(F.when(bare_suffix == "", "0").otherwise(bare_suffix)).cast("bigint").alias("suffix"),
    )
    # of names with one suffix, such as 1 and 01, the last stays
    return rows.groupBy("core", "bare", "suffix").agg(F.max("name").alias("name"))


def bare_core(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(first_component(path), PREFIX, ""), SUFFIX, "")


def resolve_folders(rows: DataFrame, folders: DataFrame, path: str) -> DataFrame:
    """The rows with folder and rung: 1 the very name, 2 the lowest number of its series, 3 the bare folder of its number or the lowest.

    Each rung is an equi join with a table of one row a key; the lowest rung that
    has a folder counts. Rows that no rung resolves have null folder and rung.
    """
    base = first_component(F.col(f"`{path}`"))
    hint = F.regexp_extract(F.regexp_replace(base, PREFIX, ""), r"_(\d+)$", 1)
    keyed = rows.withColumns({"__name": base, "__core": F.regexp_replace(base, SUFFIX, ""), "__bare": bare_core(F.col(f"`{path}`")), "__hint": F.when(hint == "", "0").otherwise(hint).cast("bigint")})
    series = folder_series(folders)
    exact = folders.select(F.col("name").alias("__name"), F.col("name").alias("__exact")).distinct()
    plain = series.filter("not bare").select(F.col("core").alias("__core"), F.col("lowest").alias("__lowest"))
    bare = series.filter("bare").select(F.col("core").alias("__bare"), F.col("lowest").alias("__low"), F.col("series").alias("__series"))
    out = keyed.join(exact, "__name", "left").join(plain, "__core", "left").join(bare, "__bare", "left")
    third = F.coalesce(F.try_element_at("__series", F.col("__hint")), F.col("__low"))
    rung = F.when(F.col("__exact").isNotNull(), 1).when(F.col("__lowest").isNotNull(), 2).when(third.isNotNull(), 3)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("__exact", "__lowest", third).alias("folder"), rung.alias("rung"))


def best_images(resolved: DataFrame, folders: DataFrame, files: DataFrame, ident: str, path: str) -> DataFrame:
    """ident, image: the only file of the resolved folder, else the best of its files and those of all bare folders of the same patient and view.

    ``files`` has folder, path, area and n_values; a file of at most two values is a
    mask. The best is the first that is no mask by falling area, then path; of
    masks alone the first.
    """
    place = F.struct((F.col("n_values") <= 2).alias("mask"), (-F.col("area")).alias("area"), F.col("path").alias("file"))
    held = files.groupBy("folder").agg(F.count(F.lit(1)).alias("__n"), F.min("path").alias("__only"), F.min(place).alias("__best"))
    names = series_names(folders).filter("bare").select(F.col("core").alias("__bare"), F.col("name").alias("folder"))
    bare = names.join(held.select("folder", "__best"), "folder").groupBy("__bare").agg(F.min("__best").alias("__more"))
    # a folder and a view have one row each, so a row meets one row of each and is made once
    rows = resolved.select(ident, "folder", bare_core(F.col(f"`{path}`")).alias("__bare")).join(held, "folder", "left").join(bare, "__bare", "left")
    own = Window.partitionBy(ident)
    best = F.min(F.least("__best", "__more")).over(own)["file"]
    image = F.when(F.sum("__n").over(own) == 1, F.min("__only").over(own)).otherwise(best)
    return rows.select(ident, F.when(F.col(ident).isNotNull(), image).alias("image"))


def find_files(wanted: DataFrame, files: DataFrame, ident: str) -> DataFrame:
    """The rows with file: the path of the id itself, else the first path whose stem is the id's last component."""
    direct = files.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("__id"), F.col("path").alias("__direct")).groupBy("__id").agg(F.min("__direct").alias("__direct"))
    by_stem = files.select(stem(F.col("path")).alias("__stem"), "path").groupBy("__stem").agg(F.min("path").alias("__other"))
    keyed = wanted.withColumns({"__id": F.col(f"`{ident}`"), "__stem": F.element_at(F.split(F.col(f"`{ident}`"), "/"), -1)})
    out = keyed.join(direct, "__id", "left").join(by_stem, "__stem", "left")
    return out.select(*[F.col(f"`{c}`") for c in wanted.columns], F.coalesce("__direct", "__other").alias("file"), F.when(F.col("__direct").isNotNull(), "direct").when(F.col("__other").isNotNull(), "stem").alias("found_by"))
