"""Contracts of scored rows, run records and arrays; what breaks them comes back as rows, with every reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(conditions: Mapping[str, Column]) -> Column:
    """The names of the conditions that hold, in order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items()]))


def score_faults(pred: DataFrame, run: str = "run_name", ident: str = "image_id", patient: str = "patient_id", p: str = "probability", y: str = "label", others: Sequence[str] = ()) -> DataFrame:
    """run, ident, faults of each scored row that breaks the contract of predictions.

    Ids are there and distinct within a run, labels are 0 or 1, probabilities (and
    ``others``, where not null) are finite and within 0 and 1. Repeated ids all count.
    """
    copies = pred.filter(F.col(ident).isNotNull()).groupBy(run, ident).agg(F.count("*").alias("__n")).filter("__n > 1").withColumn("__again", F.lit(True)).drop("__n")
    rows = pred.join(copies, [run, ident], "left")

    def outside(c: str) -> Column:
        return ~F.col(c).between(0, 1) & ~_infinite(c)

    found = {"no_id": F.col(ident).isNull() | F.col(patient).isNull(), "repeated_id": F.col("__again"), "label": F.col(y).isNull() | ~F.col(y).isin(0, 1), "not_finite": F.col(p).isNull() | _infinite(p), "range": outside(p)}
    found |= {f"{c}_not_finite": _infinite(c) for c in others} | {f"{c}_range": outside(c) for c in others}
    return rows.select(run, ident, reasons(found).alias("faults")).filter(F.size("faults") > 0)


def _infinite(c: str) -> Column:
    return F.isnan(c) | (F.abs(F.col(c)) == float("inf"))


def run_faults(pred: DataFrame, run: str = "run_name", y: str = "label", constant: Sequence[str] = ()) -> DataFrame:
    """run, faults of each run without both labels, or that mixes values of a ``constant`` column."""
    mixed = {c: F.count_distinct(c) for c in constant}
    each = pred.groupBy(run).agg(F.count_if(F.col(y) == 1).alias("__pos"), F.count_if(F.col(y) == 0).alias("__neg"), *[v.alias(f"__{c}") for c, v in mixed.items()])
    found = {"one_label": (F.col("__pos") == 0) | (F.col("__neg") == 0)} | {f"mixed_{c}": F.col(f"__{c}") > 1 for c in constant}
    return each.select(run, reasons(found).alias("faults")).filter(F.size("faults") > 0)


def locked_point_faults(wanted: DataFrame, records: DataFrame, sidecars: DataFrame, key: str = "model", within: float = 1e-9) -> DataFrame:
    """key, faults of each wanted run whose locked point can't be transferred.

    ``records`` has val_threshold, fixed_specificity (target, threshold) and
    calibration (temperature), ``sidecars`` youden_j. The threshold stands in both
    and differs by ``within`` at most; target, fixed threshold and a positive
    temperature are there.
    """
    both = wanted.select(key).join(records.withColumn("__record", F.lit(True)), key, "left").join(sidecars.select(key, "youden_j").withColumn("__sidecar", F.lit(True)), key, "left")
    there, temperature = F.col("__record").isNotNull(), F.col("calibration.temperature")
    found = {
        "no_record": ~there,
        "no_sidecar": F.col("__sidecar").isNull(),
        "threshold_drift": F.abs(F.col("val_threshold") - F.col("youden_j")) > within,
        "no_threshold": there & F.col("val_threshold").isNull(),
        "no_fixed_specificity": there & (F.col("fixed_specificity.target").isNull() | F.col("fixed_specificity.threshold").isNull()),
        "no_temperature": there & temperature.isNull(),
        "temperature_not_positive": ~(temperature > 0) | F.isnan(temperature),
    }
    return both.select(key, reasons(found).alias("faults")).filter(F.size("faults") > 0)


def incomplete_records(records: DataFrame, key: str, blocks: Sequence[str], least_version: int, version: str = "provenance.version", dirty: str = "provenance.git.dirty") -> DataFrame:
    """key, missing of each run record that lacks one of ``blocks`` (dotted paths into it), is of an old version or from a dirty tree."""
    found = {b: F.col(b).isNull() for b in blocks} | {f"{version}<{least_version}": F.col(version) < least_version, dirty: F.col(dirty)}
    return records.select(key, reasons(found).alias("missing")).filter(F.size("missing") > 0)


def array_faults(stored: DataFrame, rebuilt: DataFrame, key: str, array: str = "a") -> DataFrame:
    """key, fault of each stored array that its rebuilt one does not equal: missing, shape, or values with the first place that differs."""
    both = stored.select(key, F.col(array).alias("__s")).join(rebuilt.select(key, F.col(array).alias("__r")), key, "left")
    first = F.array_position(F.zip_with("__s", "__r", lambda s, r: ~s.eqNullSafe(r)), F.lit(True))
    fault = F.when(F.col("__r").isNull(), "missing").when(F.size("__s") != F.size("__r"), "shape").when(first > 0, "values")
    return both.select(key, fault.alias("fault"), F.when(fault == "values", first).alias("place")).filter("fault is not null")


def kept_fields(tags: Column, identifying: Sequence[str]) -> Column:
    """The map without the identifying keys, whatever their case; absent ones do not matter."""
    names = [x.lower() for x in identifying]
    return F.map_filter(tags, lambda k, v: ~F.lower(k).isin(*names))


def canonical_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows in global order of the columns; for the sink alone, for it range-partitions the rows."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def schema_faults(df: DataFrame, required: Sequence[str], label: str = "label", allowed: Sequence = (0, 1)) -> DataFrame:
    """fault, value, n: required columns that are missing, and label values that are not allowed, null aside, with their rows."""
    gone = df.sparkSession.createDataFrame([("missing_column", c, None) for c in required if c not in df.columns], "fault string, value string, n bigint")
    if label not in df.columns:
        return gone
    bad = df.filter(~F.col(label).isin(*allowed)).groupBy(F.col(label).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return gone.unionByName(bad.select(F.lit("label").alias("fault"), "value", "n"))
