"""Roles that the star-schema tables play, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed_uniform


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def u_sql(*parts: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


def predictions(spark: SparkSession, d: str, seed: int = 42, run: str = "base") -> DataFrame:
    """Scored images: orders as images, customers as patients."""
    label = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    kind = F.when(F.col("o_orderstatus") == "F", "mass").when(F.col("o_orderstatus") == "O", "calcification").otherwise("mixed")
    p = F.round(0.7 * keyed_uniform(seed, F.col("o_orderkey")) + 0.3 * label, 3)
    return table(spark, d, "orders").select(F.lit(run).alias("run_name"), F.lit(seed).alias("seed"), F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("patient_id"), label.alias("label"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("density"), kind.alias("lesion_type"), p.alias("probability"))


def pred_sql(seed: int = 42, run: str = "base") -> str:
    return f"""SELECT '{run}' AS run_name, {seed} AS seed, o_orderkey AS image_id, o_custkey AS patient_id, (o_orderpriority = '1-URGENT')::INT AS label,
    (o_orderkey % 4 + 1)::INT AS density, CASE o_orderstatus WHEN 'F' THEN 'mass' WHEN 'O' THEN 'calcification' ELSE 'mixed' END AS lesion_type,
    round(0.7 * {u_sql(str(seed), 'o_orderkey')} + 0.3 * (o_orderpriority = '1-URGENT')::INT, 3) AS probability FROM orders"""


RUNS = (("model", 42), ("model_seed7", 7), ("model_seed2026", 2026))


def runs(spark: SparkSession, d: str) -> DataFrame:
    out = [predictions(spark, d, s, r) for r, s in RUNS]
    return out[0].unionByName(out[1]).unionByName(out[2])


RUNS_SQL = " UNION ALL ".join(pred_sql(s, r) for r, s in RUNS)


def abnormalities(spark: SparkSession, d: str) -> DataFrame:
    """Rows an image may have several of, with a place that orders them."""
    t = table(spark, d, "lineitem")
    roi = F.substring(F.sha2(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag", "l_linestatus"), 256), 1, 16)
    return t.select(F.col("l_orderkey").alias("image_id"), F.when(F.col("l_returnflag") == "R", "MALIGNANT").when(F.col("l_returnflag") == "A", "BENIGN_WITHOUT_CALLBACK").when(F.col("l_linestatus") == "O", "BENIGN").otherwise("UNPROVEN").alias("pathology"), F.when(F.col("l_linestatus") == "F", "Mass").otherwise("Calcification").alias("lesion_type"), roi.alias("roi_mask_id"), "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))


ABN_SQL = """SELECT l_orderkey AS image_id, CASE WHEN l_returnflag = 'R' THEN 'MALIGNANT' WHEN l_returnflag = 'A' THEN 'BENIGN_WITHOUT_CALLBACK' WHEN l_linestatus = 'O' THEN 'BENIGN' ELSE 'UNPROVEN' END AS pathology,
    CASE l_linestatus WHEN 'F' THEN 'Mass' ELSE 'Calcification' END AS lesion_type, substr(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)), 1, 16) AS roi_mask_id, l_linenumber, l_partkey AS part, l_suppkey AS supp FROM lineitem"""


def splits(spark: SparkSession, d: str) -> DataFrame:
    """Images with splits by patient, and a slice moved to test, so some patients leak."""
    by, moved = keyed_uniform("split", F.col("patient_id")), keyed_uniform("move", F.col("image_id"))
    return predictions(spark, d).withColumn("split", F.when(moved < 0.03, "test").when(by < 0.7, "train").when(by < 0.8, "val").otherwise("test"))


SPLITS_SQL = f"SELECT *, CASE WHEN {u_sql(chr(39) + 'move' + chr(39), 'image_id')} < 0.03 THEN 'test' WHEN {u_sql(chr(39) + 'split' + chr(39), 'patient_id')} < 0.7 THEN 'train' WHEN {u_sql(chr(39) + 'split' + chr(39), 'patient_id')} < 0.8 THEN 'val' ELSE 'test' END AS split FROM ({pred_sql()})"


def boxes(spark: SparkSession, d: str, size: int = 96) -> DataFrame:
    """Boxes in a frame of 608 x 608, dealt by image once, so what is joined or ranked by image moves no more.

    What tells boxes apart is dealt as narrow rows; ids and names are made after.
    """
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    kind = F.when(flag == "R", 0).when(flag == "A", 1).when(status == "O", 2).otherwise(3)
    raw = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.concat_ws("|", flag, status).alias("codes"), kind.alias("kind"), F.coalesce(status == "F", F.lit(False)).alias("mass"))
    own = raw.repartition("image_id").dropDuplicates()
    line = F.col("l_linenumber").cast("string")
    roi = F.substring(F.sha2(F.concat_ws("|", F.col("image_id").cast("string"), line, F.col("part").cast("string"), F.col("supp").cast("string"), F.when(F.col("codes") != "", F.col("codes"))), 256), 1, 16)
    y, x = (F.col("part") % 512).cast("int"), (F.col("supp") * 37 % 512).cast("int")
    pathology = F.when(F.col("kind") == 0, "MALIGNANT").when(F.col("kind") == 1, "BENIGN_WITHOUT_CALLBACK").when(F.col("kind") == 2, "BENIGN").otherwise("UNPROVEN")
    return own.select("image_id", F.concat_ws(":", roi, line).alias("box_id"), y.alias("y0"), x.alias("x0"), (y + size).alias("y1"), (x + size).alias("x1"), F.when(F.col("mass"), "Mass").otherwise("Calcification").alias("lesion_type"), pathology.alias("pathology"))


BOXES_SQL = f"SELECT DISTINCT image_id, roi_mask_id || ':' || l_linenumber AS box_id, (part % 512)::INT AS y0, (supp * 37 % 512)::INT AS x0, (part % 512)::INT + 96 AS y1, (supp * 37 % 512)::INT + 96 AS x1, lesion_type, pathology FROM ({ABN_SQL})"
