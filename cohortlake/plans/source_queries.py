"""Sources as they lie on disk: header spellings, path conventions, caches, locks and frozen inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import paths as R
from ..sources import cases, stores, tables
from .views import SPLITS_SQL, splits, table

ALL: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        ALL[f.__name__] = (f, sql)
        return f

    return add


@query("""SELECT o_orderkey::VARCHAR AS image_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 4 + 1)::VARCHAR END AS birads_density,
  CASE o_orderkey % 3 WHEN 0 THEN 'mass' ELSE 'calcification' END AS lesion_type, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE (o_orderkey % 5 + 1)::VARCHAR END AS subtlety,
  ['mass', 'calc', 'bare'][o_orderkey % 3 + 1] AS kind FROM orders""")
def scan_case_files(spark, d):
    """Three kinds of files, each with its own spelling of the header and one without the optional column."""
    root = tables.scratch(spark, "cases")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("image_id"), F.when(F.col("o_orderkey") % 13 == 0, " ").otherwise((F.col("o_orderkey") % 4 + 1).cast("string")).alias("density"), F.when(F.col("o_orderkey") % 3 == 0, "mass").otherwise("calcification").alias("type"), (F.col("o_orderkey") % 5 + 1).cast("string").alias("subtlety"), (F.col("o_orderkey") % 3).alias("part"))
    for part, kind, density, kind_of, more in ((0, "mass", "breast_density", "abnormality type", ["subtlety"]), (1, "calc", "breast density", "lesion_type", ["subtlety"]), (2, "bare", "birads_density", " abnormality type ", [])):
        named = rows.filter(F.col("part") == part).select("image_id", F.col("density").alias(density), F.col("type").alias(kind_of), *more)
        named.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/{kind}")
    out = cases.read_variants(spark, root, ["image_id", "birads_density", "lesion_type", "subtlety"])
    return out.select("image_id", "birads_density", "lesion_type", "subtlety", F.regexp_extract("file", "([a-z]+)/[^/]*$", 1).alias("kind"))


_CASES = """c AS (SELECT o_orderkey AS k, o_orderkey % 6 AS r, 'Mass-Training_P_' || o_orderkey || '_LEFT_CC' AS p, 'P_' || o_orderkey || '_LEFT_CC' AS b FROM orders),
f AS (SELECT k, unnest(CASE r WHEN 0 THEN [p || '_1', p || '_0'] WHEN 1 THEN [p || '_3', p || '_2', b || '_1.dcm'] WHEN 2 THEN [b || '.dcm', b || '_1.dcm'] WHEN 3 THEN [b || '_5.dcm', b || '_4.dcm'] WHEN 4 THEN ['other_' || p, b || '_x'] ELSE [p || '_1', b || '_1.dcm', b || '_2.dcm'] END) AS name FROM c)"""
_FOUND = """g AS (SELECT k, r, CASE r WHEN 0 THEN p || '_1' WHEN 1 THEN p || '_2' WHEN 2 THEN b || '_1.dcm' WHEN 3 THEN b || '_4.dcm' WHEN 5 THEN p || '_1' END AS folder,
  CASE r WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 5 THEN 1 END AS rung FROM c)"""


def _case_paths(spark, d):
    """A path for each order, and the folders on disk, made so that each convention alone finds some."""
    k = F.col("o_orderkey")
    p, b = F.concat(F.lit("Mass-Training_P_"), k, F.lit("_LEFT_CC")), F.concat(F.lit("P_"), k, F.lit("_LEFT_CC"))

    def name(stem, end):
        return F.concat(stem, F.lit(end))

    made = {0: [name(p, "_1"), name(p, "_0")], 1: [name(p, "_3"), name(p, "_2"), name(b, "_1.dcm")], 2: [name(b, ".dcm"), name(b, "_1.dcm")], 3: [name(b, "_5.dcm"), name(b, "_4.dcm")], 4: [F.concat(F.lit("other_"), p), name(b, "_x")], 5: [name(p, "_1"), name(b, "_1.dcm"), name(b, "_2.dcm")]}
    names = F
    for r, each in made.items():
        names = names.when(k % 6 == r, F.array(*each))
    orders = table(spark, d, "orders")
    return orders.select(k.alias("k"), name(p, "_1/uid/000001.dcm").alias("csv_path")), orders.select(F.explode(names).alias("name"))


@query(f"WITH {_CASES}, {_FOUND} SELECT k, folder, rung FROM g")
def path_ladder(spark, d):
    rows, folders = _case_paths(spark, d)
    return R.resolve_folders(rows, folders, "csv_path").select("k", "folder", "rung")


_DISK = """x AS (SELECT name AS folder, k, unnest(range(1 + (k + length(name)) % 3)) AS j FROM f),
z AS (SELECT folder, k, folder || '/uid' || j || '/1.dcm' AS path, 1000 + 10 * ((k + 3 * j) % 4) AS area, CASE WHEN (k + j) % 3 = 0 THEN 2 ELSE 200 END AS n_values FROM x)"""


@query(f"""WITH {_CASES}, {_FOUND}, {_DISK},
own AS (SELECT g.k, z.path, z.area, z.n_values FROM g JOIN z ON z.folder = g.folder),
more AS (SELECT g.k, z.path, z.area, z.n_values FROM g JOIN z ON z.k = g.k AND regexp_matches(z.folder, '^P_[0-9]+_.+[.]dcm$')),
n AS (SELECT k, count(*) AS n, min(path) AS only FROM own GROUP BY 1),
best AS (SELECT k, arg_min(path, (n_values <= 2, -area, path)) AS best FROM (SELECT * FROM own UNION SELECT * FROM more) GROUP BY 1)
SELECT g.k, CASE WHEN n.n = 1 THEN n.only ELSE best.best END AS image FROM g LEFT JOIN n ON n.k = g.k LEFT JOIN best ON best.k = g.k""")
def best_image(spark, d):
    """The full image of each case: one file, or the largest that is no mask, with the bare folders of the view."""
    rows, folders = _case_paths(spark, d)
    k = F.regexp_extract("name", r"P_(\d+)_", 1).cast("bigint")
    files = folders.select(F.col("name").alias("folder"), k.alias("k"), F.explode(F.sequence(F.lit(0), ((k + F.length("name")) % 3).cast("int"))).alias("j"))
    files = files.select("folder", F.concat("folder", F.lit("/uid"), "j", F.lit("/1.dcm")).alias("path"), (1000 + 10 * ((F.col("k") + 3 * F.col("j")) % 4)).alias("area"), F.when((F.col("k") + F.col("j")) % 3 == 0, 2).otherwise(200).alias("n_values"))
    return R.best_images(R.resolve_folders(rows, folders, "csv_path"), folders, files, "k", "csv_path")


@query(f"""WITH {_CASES}, m AS (SELECT name, CASE WHEN regexp_matches(name, '^.+_[0-9]+$') THEN 'series' WHEN regexp_matches(name, '^P_[0-9]+_.+[.]dcm$') THEN 'bare' END AS kind FROM f),
s AS (SELECT name, kind = 'bare' AS bare, CASE kind WHEN 'series' THEN regexp_replace(name, '_[0-9]+$', '') ELSE regexp_replace(regexp_replace(name, '[.]dcm$', ''), '_[0-9]+$', '') END AS core,
  coalesce(nullif(regexp_extract(regexp_replace(name, '[.]dcm$', ''), '_([0-9]+)$', 1), ''), '0')::BIGINT AS suffix FROM m WHERE kind IS NOT NULL)
SELECT core, bare, string_agg(suffix || '=' || name, ',' ORDER BY suffix) AS series FROM s GROUP BY 1, 2""")
def folder_series(spark, d):
    """A listing as a lookup: each core with its numbers in order."""
    entry = F.transform(F.map_entries("series"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return R.folder_series(_case_paths(spark, d)[1]).select("core", "bare", F.array_join(entry, ",").alias("series"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 'a/moved/' ELSE 'a/' END || CASE WHEN p_partkey % 4 < 3 THEN p_partkey || '.dcm' END AS file, CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 'stem' ELSE 'direct' END AS found_by FROM part")
def find_files(spark, d):
    """Ids of which a quarter has moved to other folders, twice, and a quarter is gone."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    path = F.when(k % 4 == 2, F.array(F.concat(F.lit("a/moved/"), k, F.lit(".dcm")), F.concat(F.lit("b/"), k, F.lit(".dcm")))).when(k % 4 < 2, F.array(F.concat(F.lit("a/"), k, F.lit(".dcm"))))
    return R.find_files(part.select("p_partkey", F.concat(F.lit("a/"), k).alias("image_id")), part.select(F.explode(path).alias("path")), "image_id").select("p_partkey", "file", "found_by")


_WORKED = "SELECT count(*) AS total, count(*) FILTER (page_id % 97 = 5) AS changed, sum(length(coalesce(html, ''))) AS chars FROM pages"


@query(f"""WITH t AS ({_WORKED}) SELECT 1 AS run, total AS worked, total, chars::BIGINT AS chars FROM t UNION ALL SELECT 2, 0, total, chars::BIGINT FROM t
UNION ALL SELECT 3, changed, total, (chars + changed)::BIGINT FROM t UNION ALL SELECT 4, 0, total, (chars + changed)::BIGINT FROM t""")
def cache_refresh(spark, d):
    """A cache of pages: built, then unchanged, then after a change to a few, then unchanged again."""
    root = tables.scratch(spark, "cache")

    def source(changed: bool):
        html = F.coalesce("html", F.lit(""))
        html = F.when((F.col("page_id") % 97 == 5) & F.lit(changed), F.concat(html, F.lit("!"))).otherwise(html)
        body = table(spark, d, "pages").select("page_id", html.alias("html"))
        return body.select("page_id", "html", F.octet_length("html").alias("size_bytes"), F.sha2("html", 256).alias("sha256"))

    def work(rows):
        return rows.select("page_id", "size_bytes", "sha256", F.length("html").alias("chars"))

    out = []
    for run, changed in enumerate((False, False, True, True), 1):
        store, worked = stores.refresh(root, source(changed), "page_id", ["size_bytes", "sha256"], work)
        out.append(store.agg(F.count("*").alias("total"), F.sum("chars").alias("chars")).select(F.lit(run).alias("run"), F.lit(worked).cast("bigint").alias("worked"), "total", "chars"))
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(f"WITH s AS ({SPLITS_SQL}), n AS (SELECT count(*) AS images, count(DISTINCT patient_id) AS patients FROM s WHERE split = 'test') SELECT unnest([1, 2, 3]) AS attempt, unnest(['written', 'kept', 'refused']) AS outcome, images, patients, true AS utc, true AS first_stamp FROM n")
def lock_record(spark, d):
    """A cohort's record locked, then written again as it is, then refused with another count."""
    path = tables.scratch(spark, "lock")
    record = splits(spark, d).filter("split = 'test'").agg(F.count("*").alias("images"), F.count_distinct("patient_id").alias("patients"))
    stamps, out = [], []
    for attempt, change in enumerate((0, 0, 1), 1):
        try:
            stores.write_lock(path, record.withColumn("images", F.col("images") + change))
            outcome = "kept" if stamps else "written"
        except stores.LockChanged:
            outcome = "refused"
        kept = stores.write_lock(path, record)
        stamps.append(kept.first()[stores.STAMP])
        utc = F.rlike(stores.STAMP, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$"))
        out.append(kept.select(F.lit(attempt).alias("attempt"), F.lit(outcome).alias("outcome"), "images", "patients", utc.alias("utc"), (F.col(stores.STAMP) == stamps[0]).alias("first_stamp")))
    return out[0].union(out[1]).union(out[2])


def _inputs(spark, d):
    """Described files of five runs, in a place of their own."""
    pages = table(spark, d, "pages")
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select((F.col("page_id") % 5).alias("run"), F.col("page_id").alias("place"), F.concat(F.lit("in/"), F.col("page_id").cast("string")).alias("path"), F.octet_length(html).cast("bigint").alias("size_bytes"), F.sha2(html, 256).alias("sha256"))


@query("""WITH f AS (SELECT page_id % 5 AS run, page_id AS place, 'in/' || page_id AS path, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS h FROM pages)
SELECT run, count(*) AS n_files, sum(size)::BIGINT AS size_bytes, sha256(string_agg(h, '' ORDER BY place)) AS ordered_digest, sha256(string_agg(path || h, '' ORDER BY path)) AS fingerprint FROM f GROUP BY 1""")
def freeze_record(spark, d):
    return E.freeze_record(_inputs(spark, d), ["run"]).drop("files")


@query("""SELECT page_id % 5 AS run, 'in/' || page_id AS path, CASE page_id % 5 WHEN 1 THEN 'changed' WHEN 2 THEN 'removed' WHEN 3 THEN 'moved' END AS difference FROM pages WHERE page_id IN (6, 7) OR page_id IN (3, 8)
UNION ALL SELECT 4, 'in/new', 'added'""")
def freeze_compare(spark, d):
    """One change planted in each of four runs: a content, a file gone, two places exchanged, a file more; the fifth stays."""
    now = _inputs(spark, d)
    page = F.col("place")
    changed = now.filter(page != 7).withColumns({"sha256": F.when(page == 6, F.lit("0")).otherwise(F.col("sha256")), "place": F.when(page == 3, 8).when(page == 8, 3).otherwise(page).cast("bigint")})
    more = now.filter(page == 4).withColumns({"path": F.lit("in/new"), "place": F.lit(1 << 40)})
    return E.freeze_differences(E.freeze_record(now, ["run"]), changed.unionByName(more), ["run"])
