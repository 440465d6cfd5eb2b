"""Cohort building and leakage control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed_uniform
from .prefix import along, numbered


def collapse_images(rows: DataFrame, order: Column, image: str = "image_id", label: str = "label", kind: str = "lesion_type") -> DataFrame:
    """One row an image: the first in ``order`` among those of the largest label; its type, or mixed."""
    out = rows.withColumn("__o", order).groupBy(image).agg(F.min_by(F.struct(*rows.columns), F.struct(-F.col(label), F.col("__o"))).alias("r"), F.collect_set(F.lower(kind)).alias("kinds"))
    return out.select(*[F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("mixed").alias(kind) if c == kind else F.col(f"r.{c}").alias(c) for c in rows.columns])


def tally(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unannotated")).alias("value")).agg(F.count("*").alias("n"))


def overlap_ledger(splits: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Patients of test that are also in train or val, with images a split; one shuffle, no self-join."""
    n = lambda s: F.count_if(F.col("split") == s).alias(f"n_{s}_images")
    agg = splits.groupBy(patient).agg(n("train"), n("val"), n("test")).filter("n_test_images > 0 and n_train_images + n_val_images > 0")
    dev = F.filter(F.array(F.when(F.col("n_train_images") > 0, "train"), F.when(F.col("n_val_images") > 0, "val")), lambda x: x.isNotNull())
    return agg.withColumn("development_split", F.explode(dev)).withColumn("reason", F.lit("patient_id_also_present_in_locked_test"))


def clean(df: DataFrame, ledger: DataFrame, patient: str = "patient_id") -> DataFrame:
    """The rows of patients that the ledger doesn't name."""
    return df.join(ledger.select(patient).distinct(), patient, "left_anti")


def carve(train: DataFrame, fraction: float, seed: int, patient: str = "patient_id", label: str = "label") -> DataFrame:
    """The rows with ``part``: by outcome, the first ceil(fraction * n) patients of a keyed order go to val."""
    outcome = train.groupBy(patient).agg(F.max(label).alias("outcome"))
    one = F.lit(1).cast("bigint")
    ranked = along(outcome, ["outcome"], [keyed_uniform(seed, F.col(patient)), F.col(patient)], sums={"at": one}, wholes={"n": one})
    side = ranked.select(patient, F.when(F.col("at") <= F.ceil(fraction * F.col("n")), "val").otherwise("train").alias("part"))
    return train.join(side, patient)


def stratified_sample(df: DataFrame, n: int, seed: int, ident: str = "image_id", label: str = "label") -> DataFrame:
    """About n rows with both labels, as many of each as there are and half of n allows; in keyed order."""
    u = keyed_uniform(seed, F.col(ident))
    counts = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    want_pos = F.least(F.col("pos"), F.greatest(F.lit(1), F.lit(n // 2)))
    quota = counts.select(want_pos.alias("q1"), F.least(F.col("neg"), F.greatest(F.lit(1), F.lit(n) - want_pos)).alias("q0"))
    ranked = numbered(df.withColumn("u", u), [label], [F.col("u"), F.col(ident)])
    return ranked.filter(F.col("at") <= n).join(F.broadcast(quota)).filter(F.col("at") <= F.when(F.col(label) == 1, F.col("q1")).otherwise(F.col("q0"))).drop("at", "q0", "q1")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n for each rule that some row breaks; a null condition counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def membership_faults(rows: DataFrame, members: DataFrame, key: str, group: str) -> DataFrame:
    """The rows with fault: no_split, whose key no group holds, or other_split, whose group does not hold it."""
    known = members.select(key).distinct().withColumn("__known", F.lit(True))
    pairs = members.select(key, group).distinct().withColumn("__held", F.lit(True))
    out = rows.join(known, key, "left").join(pairs, [key, group], "left").filter("__held is null")
    return out.withColumn("fault", F.when(F.col("__known").isNull(), "no_split").otherwise("other_split")).drop("__known", "__held")
