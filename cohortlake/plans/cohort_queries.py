"""Cohort building, validation and leakage control."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import missing, r6
from ..operators import cohort as C
from ..operators import contracts as K
from ..operators.prefix import numbered
from ..sources import tables
from .views import ABN_SQL, SPLITS_SQL, abnormalities, pred_sql, predictions, splits, table, u_sql

ALL: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        ALL[f.__name__] = (f, sql)
        return f

    return add


A, S, P = f"WITH abn AS ({ABN_SQL}) ", f"WITH s AS ({SPLITS_SQL}) ", f"WITH pred AS ({pred_sql()}) "
_LABEL = "CASE pathology WHEN 'MALIGNANT' THEN 1 WHEN 'BENIGN' THEN 0 WHEN 'BENIGN_WITHOUT_CALLBACK' THEN 0 END"


def labelled(df):
    """BENIGN and BENIGN_WITHOUT_CALLBACK are 0, MALIGNANT is 1, other rows go."""
    label = F.when(F.col("pathology") == "MALIGNANT", 1).when(F.col("pathology").isin("BENIGN", "BENIGN_WITHOUT_CALLBACK"), 0)
    return df.withColumn("label", label).filter("label is not null")


@query("SELECT c_custkey AS patient_id, c_mktsegment AS pathology, (c_nationkey % 4 + 1)::INT AS birads_density, NULL::INT AS subtlety, 'cases' AS dataset FROM customer")
def scan_cases(spark, d):
    raw = table(spark, d, "customer").withColumnsRenamed({"c_custkey": "patient_id", "c_mktsegment": "pathology"})
    return raw.select("patient_id", "pathology", (F.col("c_nationkey") % 4 + 1).cast("int").alias("birads_density"), F.lit(None).cast("int").alias("subtlety"), F.lit("cases").alias("dataset"))


@query(A + f"SELECT image_id, roi_mask_id, {_LABEL} AS label FROM abn WHERE pathology <> 'UNPROVEN'")
def label_map(spark, d):
    return labelled(abnormalities(spark, d)).select("image_id", "roi_mask_id", "label")


@query(A + f""", l AS (SELECT *, {_LABEL} AS label FROM abn WHERE pathology <> 'UNPROVEN'),
k AS (SELECT image_id, list(DISTINCT lower(lesion_type)) AS kinds FROM l GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label DESC, l_linenumber, roi_mask_id) AS n FROM l)
SELECT image_id, label, roi_mask_id, CASE WHEN len(kinds) = 1 THEN kinds[1] ELSE 'mixed' END AS lesion_type FROM r JOIN k USING (image_id) WHERE n = 1""")
def collapse_images(spark, d):
    rows = labelled(abnormalities(spark, d))
    return C.collapse_images(rows, F.struct("l_linenumber", "roi_mask_id")).select("image_id", "label", "roi_mask_id", "lesion_type")


@query(S + "SELECT split, count(*) AS images, count(DISTINCT patient_id) AS patients, sum(label)::BIGINT AS positives, round(avg(label), 6) AS prevalence, count(*) FILTER (lesion_type = 'mixed') AS mixed FROM s GROUP BY 1")
def cohort_counts(spark, d):
    return splits(spark, d).groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("patient_id").alias("patients"), F.sum("label").alias("positives"), r6(F.avg("label")).alias("prevalence"), F.count_if(F.col("lesion_type") == "mixed").alias("mixed"))


@query("SELECT coalesce(nullif(lang, 'en'), 'unannotated') AS value, count(*) AS n FROM documents GROUP BY 1")
def cohort_tally(spark, d):
    return C.tally(table(spark, d, "documents").select(F.nullif("lang", F.lit("en")).alias("lang")), "lang")


@query(S + "SELECT round(count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0), 6) AS pos_weight FROM s WHERE split = 'train'")
def pos_weight(spark, d):
    return splits(spark, d).filter("split = 'train'").agg(r6(F.try_divide(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1))).alias("pos_weight"))


@query(P + "SELECT patient_id, max(label) AS outcome FROM pred GROUP BY 1")
def patient_outcome(spark, d):
    from ..operators.bootstrap import patient_outcome as outcome

    return outcome(predictions(spark, d))


@query(A + "SELECT image_id, array_to_string(list_sort(list(DISTINCT roi_mask_id)), ',') AS rois FROM abn GROUP BY 1")
def image_rois(spark, d):
    return abnormalities(spark, d).filter(~missing(F.col("roi_mask_id"))).groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("roi_mask_id")), ",").alias("rois"))


@query("SELECT 'missing_column' AS fault, 'roi_mask_id' AS value, NULL::BIGINT AS n UNION ALL SELECT 'label', (doc_id % 37)::VARCHAR, count(*) FROM labels WHERE doc_id % 37 IN (2, 3) GROUP BY 2")
def validate_manifest(spark, d):
    """A manifest without one column, with null labels, which pass, and labels of other values, which do not."""
    i = F.col("doc_id") % 37
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("image_id"), F.col("doc_id").alias("patient_id"), F.when(i.isin(2, 3), i).when(i != 5, F.col("quality")).alias("label"))
    return K.schema_faults(rows, ["image_id", "patient_id", "label", "roi_mask_id"])


@query("SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS INT) AS brand, try_cast(p_type AS INT) AS type_no, nullif(p_name, 'nan') AS name FROM part")
def coerce_manifest(spark, d):
    from ..sources.tables import coerce

    raw = table(spark, d, "part").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand"), F.col("p_type").alias("type_no"), F.col("p_name").alias("name"))
    return coerce(raw, ["brand", "type_no"], ["name"])


@query("SELECT p_partkey, CASE WHEN p_size % 7 IN (4, 5, 6) THEN 1 WHEN p_size % 7 IN (1, 2, 3) THEN 0 END AS label, CASE WHEN p_size % 6 BETWEEN 1 AND 4 THEN p_size % 6 END AS density FROM part")
def assessment_label(spark, d):
    raw = F.concat((F.col("p_size") % 7).cast("string"), F.when(F.col("p_size") % 7 == 4, " A").otherwise(""))
    digit = F.nullif(F.regexp_extract(F.lower(F.trim(raw)), r"^(\d)", 1), F.lit("")).cast("int")
    acr = F.trim((F.col("p_size") % 6).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.when(digit.isin(4, 5, 6), 1).when(digit.isin(1, 2, 3), 0).alias("label"), F.when(acr.isin("1", "2", "3", "4"), acr.cast("int")).alias("density"))


@query(A + "SELECT image_id, CASE WHEN bool_or(lesion_type = 'Mass') AND bool_or(lesion_type = 'Calcification') THEN 'mixed' WHEN bool_or(lesion_type = 'Mass') THEN 'mass' ELSE 'calcification' END AS lesion_type, count(*) AS n_rois FROM abn GROUP BY 1")
def lesion_family(spark, d):
    kind = F.lower(F.trim("lesion_type"))
    mass, calc = F.bool_or(kind == "mass"), F.bool_or(kind.startswith("calc") | (kind == "cluster"))
    return abnormalities(spark, d).groupBy("image_id").agg(F.when(mass & calc, "mixed").when(mass, "mass").when(calc, "calcification").otherwise("other").alias("lesion_type"), F.count("*").alias("n_rois"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type <> 'ECONOMY'")
def lesion_present(spark, d):
    return table(spark, d, "part").filter(F.trim("p_type") != "ECONOMY").select("p_partkey", "p_type")


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS side, split_part(p_name, ' ', 2) AS view, split_part(p_brand, '#', 2)::INT AS family FROM part")
def case_key(spark, d):
    key = F.concat_ws("_", "p_name", "p_brand")
    part = lambda i: F.nullif(F.regexp_extract(key, r"^(\w+) (\w+)_Brand#(\d+)$", i), F.lit(""))
    return table(spark, d, "part").select("p_partkey", part(1).alias("side"), part(2).alias("view"), part(3).cast("int").alias("family"))


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS only_documents, count(*) FILTER (d.doc_id IS NULL) AS only_labels, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def key_reconcile(spark, d):
    a, b = table(spark, d, "documents").select(F.col("doc_id").alias("a")), table(spark, d, "labels").select(F.col("doc_id").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").agg(F.count_if(F.col("b").isNull()).alias("only_documents"), F.count_if(F.col("a").isNull()).alias("only_labels"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


@query("WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey AS image_id, c_name AS patient, coalesce(n, 0) AS n_annotated_rois, CASE WHEN n > 0 THEN o_orderkey || '_roi' END AS roi_mask_id FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN n ON o_orderkey = l_orderkey")
def external_manifest(spark, d):
    n = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    out = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, "o_orderkey", "left")
    return out.select(F.col("o_orderkey").alias("image_id"), F.col("c_name").alias("patient"), F.coalesce("n", F.lit(0)).alias("n_annotated_rois"), F.when(F.col("n") > 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("_roi"))).alias("roi_mask_id"))


@query("WITH k AS (SELECT o_custkey, o_orderstatus, count(DISTINCT o_orderkey) AS n, min(o_orderkey) AS image_id FROM orders GROUP BY 1, 2) SELECT c_custkey, s.st AS view, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN image_id END AS image_id FROM customer, (SELECT unnest(['F', 'O', 'P']) AS st) s LEFT JOIN k ON k.o_custkey = c_custkey AND k.o_orderstatus = s.st")
def reconcile_images(spark, d):
    """A key must match one locked image; zero or many stay without an id."""
    key = table(spark, d, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, "FOP"))).alias("view"))
    locked = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("view")).agg(F.count_distinct("o_orderkey").alias("n"), F.min("o_orderkey").alias("image_id"))
    return key.join(locked, ["c_custkey", "view"], "left").select("c_custkey", "view", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("image_id")).alias("image_id"))


@query(S + f", a AS (SELECT DISTINCT image_id, roi_mask_id FROM ({ABN_SQL})) SELECT a.image_id, a.roi_mask_id, s.patient_id, s.split, row_number() OVER (PARTITION BY s.split ORDER BY s.patient_id, a.image_id, a.roi_mask_id) AS place FROM a JOIN s USING (image_id) WHERE s.split IN ('train', 'val')")
def lesion_sources(spark, d):
    """Regions of train and val images with their place in the canonical order of their split."""
    s = splits(spark, d).filter(F.col("split").isin("train", "val")).select("image_id", "patient_id", "split")
    rows = abnormalities(spark, d).select("image_id", "roi_mask_id").distinct().join(s, "image_id").select("image_id", "roi_mask_id", "patient_id", "split")
    return numbered(rows, ["split"], [F.col("patient_id"), F.col("image_id"), F.col("roi_mask_id")], "place")


@query(S + f", a AS (SELECT image_id, min(l_linenumber) AS line, count(*) AS n FROM ({ABN_SQL}) GROUP BY 1) SELECT a.image_id, CASE WHEN a.image_id % 17 = 0 THEN 'no_split' ELSE 'other_split' END AS fault, s.split FROM a JOIN s USING (image_id) WHERE a.image_id % 17 = 0 OR (a.image_id % 19 = 0 AND s.split <> 'train')")
def source_membership(spark, d):
    """Images of regions that no split holds, or another than was claimed; the failures are rows, not an error."""
    held = splits(spark, d).select("image_id", "split")
    claimed = abnormalities(spark, d).select("image_id").distinct().join(held.withColumnRenamed("split", "real"), "image_id")
    claimed = claimed.withColumn("claim", F.when(F.col("image_id") % 19 == 0, "train").otherwise(F.col("real")))
    out = C.membership_faults(claimed.select("image_id", F.col("claim").alias("split"), "real"), held.filter("image_id % 17 <> 0"), "image_id", "split")
    return out.select("image_id", "fault", F.col("real").alias("split"))


@query("WITH h AS (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), f AS (SELECT host, min(page_id) AS low FROM h GROUP BY 1) SELECT h.page_id, coalesce(f.low, h.page_id) AS resolved FROM h LEFT JOIN f USING (host)")
def resolve_paths(spark, d):
    """Exact key, else the lowest of the folder: equi joins and coalesce in order of preference."""
    h = table(spark, d, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    low = h.groupBy("host").agg(F.min_by("page_id", "page_id").alias("low"))
    return h.join(low, "host", "left").select("page_id", F.coalesce("low", "page_id").alias("resolved"))


@query("SELECT l_orderkey, arg_min(l_partkey, (l_quantity, l_partkey)) AS crop, arg_max(l_partkey, (l_quantity, l_partkey)) AS mask, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def crop_mask(spark, d):
    area = F.struct("l_quantity", "l_partkey")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", area).alias("crop"), F.max_by("l_partkey", area).alias("mask"), F.count("*").alias("n")).filter("n >= 2")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness(spark, d):
    return C.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(A + "SELECT pathology, lesion_type, count(*) AS n, count(*) FILTER (roi_mask_id IS NULL) AS no_roi FROM abn GROUP BY 1, 2")
def eda_counts(spark, d):
    return abnormalities(spark, d).groupBy("pathology", "lesion_type").agg(F.count("*").alias("n"), F.count_if(F.col("roi_mask_id").isNull()).alias("no_roi"))


@query(S + "SELECT image_id, split FROM s WHERE split = 'train' UNION ALL SELECT image_id, split FROM s WHERE split = 'val'")
def union_splits(spark, d):
    s = splits(spark, d).select("image_id", "split")
    return s.filter("split = 'train'").unionByName(s.filter("split = 'val'"))


@query(S + "SELECT split, count(*) AS images FROM s GROUP BY 1")
def scan_splits(spark, d):
    return splits(spark, d).groupBy("split").agg(F.count("*").alias("images"))


@query("SELECT DISTINCT l_orderkey AS image_id FROM lineitem")
def distinct_images(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id")).distinct()


@query("SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)$', 1) AS number, regexp_replace(c_name, '#[0-9]+$', '') AS prefix, lower(trim(c_mktsegment)) AS segment FROM customer")
def regex_fields(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "#0*([0-9]+)$", 1).alias("number"), F.regexp_replace("c_name", "#[0-9]+$", "").alias("prefix"), F.lower(F.trim("c_mktsegment")).alias("segment"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '\.[^./]+$', '') AS id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS root FROM pages")
def path_id(spark, d):
    rel = F.regexp_replace("url", "^https?://", "")
    return table(spark, d, "pages").select("page_id", F.regexp_replace(rel, r"\.[^./]+$", "").alias("id"), F.split_part(rel, F.lit("/"), F.lit(1)).alias("root"))


@query("""SELECT event_id, concat_ws(';', 'Modality=MG', CASE WHEN event_id % 3 = 0 THEN 'Rows=' || event_id % 7 END, 'k=' || (props->>'k')) AS kept, (1 + (event_id % 2 = 0)::INT + (event_id % 5 = 0)::INT)::INT AS n_removed FROM events""")
def deidentify(spark, d):
    """Identifying fields leave the header map, in any case of letters; some rows lack some, and other fields stay."""
    i = F.col("event_id")
    pair = lambda k, v, there=F.lit(True): F.when(there, F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")))
    own = [pair("PatientName", F.col("user_id")), pair("patientid", F.col("user_id"), i % 2 == 0), pair("PATIENTBIRTHDATE", F.col("ts"), i % 5 == 0), pair("Modality", F.lit("MG")), pair("Rows", i % 7, i % 3 == 0)]
    tags = F.map_concat(F.map_from_entries(F.array_compact(F.array(*own))), F.from_json("props", "map<string,string>"))
    rows = table(spark, d, "events").select("event_id", tags.alias("tags")).withColumn("left", K.kept_fields(F.col("tags"), ["PatientName", "PatientID", "PatientBirthDate", "PatientAddress"]))
    text = F.transform(F.array_sort(F.map_entries("left")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("event_id", F.array_join(text, ";").alias("kept"), (F.size("tags") - F.size("left")).alias("n_removed"))


@query("SELECT DISTINCT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def cache_worklist(spark, d):
    return table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT 'labelled' AS check, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) = count(*) AS ok FROM documents UNION ALL SELECT 'scored', count(*) > 0 FROM orders")
def presence(spark, d):
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    lacking = docs.join(lab, "doc_id", "left_anti").agg((F.count("*") == 0).alias("ok")).select(F.lit("labelled").alias("check"), "ok")
    return lacking.unionByName(table(spark, d, "orders").agg((F.count("*") > 0).alias("ok")).select(F.lit("scored").alias("check"), "ok"))


_LEDGER = "led AS (SELECT patient_id, count(*) FILTER (split = 'train') AS n_train_images, count(*) FILTER (split = 'val') AS n_val_images, count(*) FILTER (split = 'test') AS n_test_images FROM s GROUP BY 1 HAVING count(*) FILTER (split = 'test') > 0 AND count(*) FILTER (split <> 'test') > 0)"


@query(S + f", {_LEDGER} SELECT *, 'train' AS development_split FROM led WHERE n_train_images > 0 UNION ALL SELECT *, 'val' FROM led WHERE n_val_images > 0")
def overlap_ledger(spark, d):
    return C.overlap_ledger(splits(spark, d)).drop("reason")


@query(S + f", {_LEDGER} SELECT DISTINCT patient_id::VARCHAR AS patient_id FROM led")
def scan_ledger(spark, d):
    return C.overlap_ledger(splits(spark, d)).select(F.col("patient_id").cast("string")).distinct()


@query(S + "SELECT patient_id, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def patient_leak(spark, d):
    return splits(spark, d).groupBy("patient_id").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


@query(S + f", {_LEDGER} SELECT image_id, split FROM s WHERE patient_id NOT IN (SELECT patient_id FROM led)")
def leakage_clean(spark, d):
    s = splits(spark, d)
    return C.clean(s, C.overlap_ledger(s)).select("image_id", "split")


@query(P + f", o AS (SELECT patient_id, max(label) AS outcome FROM pred GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY {u_sql('11', 'patient_id')}, patient_id) AS nth, count(*) OVER (PARTITION BY outcome) AS n FROM o) SELECT p.image_id, CASE WHEN nth <= ceil(0.1::DOUBLE * n) THEN 'val' ELSE 'train' END AS part FROM pred p JOIN r USING (patient_id)")
def carve_val(spark, d):
    return C.carve(predictions(spark, d), 0.1, 11).select("image_id", "part")


@query(S + "SELECT patient_id FROM s WHERE split = 'train' INTERSECT SELECT patient_id FROM s WHERE split = 'test'")
def split_intersect(spark, d):
    s = splits(spark, d)
    return s.filter("split = 'train'").select("patient_id").intersect(s.filter("split = 'test'").select("patient_id"))


@query(S + "SELECT patient_id FROM s WHERE split = 'train' EXCEPT SELECT patient_id FROM s WHERE split = 'test'")
def split_except(spark, d):
    s = splits(spark, d)
    return s.filter("split = 'train'").select("patient_id").subtract(s.filter("split = 'test'").select("patient_id"))


_SAMPLE = f", r AS (SELECT image_id, label, {u_sql('5', 'image_id')} AS u FROM pred), q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, image_id) AS nth FROM r)"


@query(P + _SAMPLE + " SELECT image_id, label FROM q WHERE nth <= 50")
def stratified_sample(spark, d):
    return C.stratified_sample(predictions(spark, d), 100, 5).select("image_id", "label")


@query(P + _SAMPLE + ", t AS (SELECT * FROM q WHERE nth <= 50) SELECT 'train_' || lpad((row_number() OVER (ORDER BY u, image_id) - 1)::VARCHAR, 4, '0') AS flat_id, image_id AS source_image_id, label FROM t")
def fixture_manifest(spark, d):
    s = C.stratified_sample(predictions(spark, d), 100, 5)
    return s.select(F.format_string("train_%04d", F.row_number().over(Window.orderBy("u", "image_id")) - 1).alias("flat_id"), F.col("image_id").alias("source_image_id"), "label")


@query(P + "SELECT image_id, round(1.0 / count(*) OVER (PARTITION BY label), 9) AS weight FROM pred")
def balanced_weights(spark, d):
    """Counts by label are two rows; they go to the images, not the images to them."""
    pred = predictions(spark, d)
    n = pred.groupBy("label").agg(F.count("*").alias("n"))
    return pred.join(F.broadcast(n), "label").select("image_id", F.round(1.0 / F.col("n"), 9).alias("weight"))


@query(f"WITH s AS ({SPLITS_SQL}) SELECT split, count(*) AS rows, max(image_id) AS last FROM s GROUP BY 1")
def sink_splits(spark, d):
    """Image counts by split, of the tables as written and read again."""
    path = tables.scratch(spark, "splits")
    tables.write_splits(splits(spark, d), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("rows"), F.max("image_id").alias("last"))


@query(f"WITH s AS ({SPLITS_SQL}) SELECT run_name, split, count(*) AS n, sum(label)::BIGINT AS positives FROM s WHERE split <> 'test' OR label = 1 GROUP BY ALL")
def sink_predictions(spark, d):
    """All predictions written, those of the test split then replaced alone."""
    path, s = tables.scratch(spark, "predictions"), splits(spark, d)
    tables.write_predictions(s, path)
    tables.write_predictions(s.filter("split = 'test' and label = 1"), path)
    return spark.read.parquet(path).groupBy("run_name", "split").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"))


@query(f"WITH s AS ({SPLITS_SQL}) SELECT split, count(*) AS n, TRUE AS first_written, FALSE AS second_written FROM s GROUP BY 1")
def qa_package(spark, d):
    """A package is written once; the second one, of other rows, is refused and changes nothing."""
    path, s = tables.scratch(spark, "package"), splits(spark, d)
    written = []
    for rows in (s, s.filter("label = 1")):
        try:
            tables.write_package(rows, path)
            written.append(True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            written.append(False)
    counts = spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))
    return counts.select("*", F.lit(written[0]).alias("first_written"), F.lit(written[1]).alias("second_written"))


@query()
def scan_files(spark, d):
    """The files of the tables' folder, with their sizes, contents unread."""
    return tables.list_files(spark, d, "*.parquet").select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("name"), "length")


@query("SELECT p_partkey::VARCHAR AS image_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS density, nullif(p_name, 'red ring') AS name FROM part")
def scan_manifest(spark, d):
    """Text columns as a CSV has them, typed with nulls for what is not a number or stands for missing."""
    from ..sources.tables import coerce

    name = F.when(F.col("p_name") == "red ring", "nan").otherwise(F.col("p_name"))
    raw = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("image_id"), F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("density"), name.alias("name"))
    return coerce(raw, ["density"], ["image_id", "name"])


@query("SELECT c_custkey::VARCHAR AS file_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 11 = 0 THEN 'a;b' ELSE c_mktsegment END AS segment FROM customer")
def scan_delimited(spark, d):
    """A semicolon file with padded fields, blank ones and a quoted separator, written and read."""
    path = f"{tables.scratch(spark, 'metadata')}/csv"
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.concat(F.lit(" "), k.cast("string"), F.lit("  ")).alias("File Name"), F.when(k % 7 == 0, "   ").otherwise(F.concat(F.lit(" "), "c_name")).alias("Name"), F.when(k % 11 == 0, "a;b").otherwise(F.col("c_mktsegment")).alias("Segment"))
    rows.write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_delimited(spark, path, ["File Name", "Name"], ";").select(F.col("File Name").alias("file_name"), F.col("Name").alias("name"), F.col("Segment").alias("segment"))


@query("SELECT vec_id, i AS roi, round(embedding[2 * i + 1]::DOUBLE, 5) AS x, round(embedding[2 * i + 2]::DOUBLE, 5) AS y FROM embeddings, range(4) r(i)")
def scan_rois(spark, d):
    """Points written as text in a nested table, back to numbers; regions without points would go."""
    pair = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("roi"), F.array(F.concat(F.lit("("), F.get("embedding", 2 * i).cast("double").cast("string"), F.lit(", "), F.get("embedding", 2 * i + 1).cast("double").cast("string"), F.lit(")"))).alias("points")))
    rois = table(spark, d, "embeddings").select("vec_id", F.inline(pair))
    part = lambda i: F.round(F.regexp_extract(F.col("points")[0], r"\(([^,]+), ([^)]+)\)", i).cast("double"), 5)
    return rois.filter(F.size("points") > 0).select("vec_id", F.col("roi").cast("bigint").alias("roi"), part(1).alias("x"), part(2).alias("y"))
