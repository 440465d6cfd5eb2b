"""Content hashes, run records and checks that end in rows, never in a failing task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hashes(df: DataFrame, path: str, content: str, keep: Sequence[str] = ()) -> DataFrame:
    """path, exists, size_bytes, sha256 of each row, with the columns to ``keep``, since paths may repeat."""
    body = F.encode(F.coalesce(F.col(content), F.lit("")), "UTF-8")
    return df.select(*keep, F.col(path).alias("path"), F.col(content).isNotNull().alias("exists"), F.octet_length(body).cast("bigint").alias("size_bytes"), F.sha2(body, 256).alias("sha256"))


def tree_digest(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, digest: SHA-256 over path, NUL, hash, LF of the files in order of path."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: F.concat(f["path"], F.lit("\x00"), f["sha256"], F.lit("\n")))
    return files.groupBy(*keys).agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"), F.count("*").alias("n"))


def verify_hashes(recorded: DataFrame, actual: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """keys, reason of each recorded file that is gone or differs, one row a recorded one.

    Where paths repeat, ``keys`` name what tells files apart besides; null keys
    are keys. Of several actual files of the same keys one has to agree.
    """
    want, have = recorded.select(*keys, "sha256"), actual.select(*keys, "sha256").distinct()

    def met(rows: DataFrame, there: DataFrame, on: Sequence[str], mark: str) -> DataFrame:
        there = there.select(*[F.col(c).alias(f"__{c}") for c in on], F.lit(True).alias(mark))
        return rows.join(there, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]), "left").drop(*[f"__{c}" for c in on])

    both = met(met(want, have, [*keys, "sha256"], "__same"), have.select(*keys).distinct(), keys, "__there")
    return both.filter("__same is null").select(*keys, F.when(F.col("__there").isNull(), "missing").otherwise("changed").alias("reason"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """The old records but for those replaced, and the new ones; write to a new version."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def homogeneous(runs: DataFrame, columns: list[str]) -> DataFrame:
    """check, n_values, n_null of each column that isn't the same, and present, in all runs."""
    agg = runs.agg(*[F.struct(F.count_distinct(c).alias("n_values"), F.count_if(F.col(c).isNull()).alias("n_null")).alias(c) for c in columns])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"{c}.n_values").alias("n_values"), F.col(f"{c}.n_null").alias("n_null")) for c in columns]))
    return agg.select(rows).filter("n_values <> 1 or n_null > 0")


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side of each value that only one side has; no rows if the sets are equal."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    side = F.when(F.max("l") > F.max("r"), "left").when(F.max("l") < F.max("r"), "right")
    return both.groupBy(key).agg(side.alias("side")).filter("side is not null")


def incomplete(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, missing: the names of the columns that a record has null or blank, in the order given."""
    names = F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in columns])
    return records.select(key, F.array_join(names, ",").alias("missing")).filter("missing <> ''")


def freeze_record(files: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """keys, n_files, size_bytes, ordered_digest, fingerprint, files: a record of described files (place, path, size_bytes, sha256).

    ``ordered_digest`` is the SHA-256 over the files' hashes in order of place,
    ``fingerprint`` that over path and hash of each in order of path. A record lists
    its inputs, so it has as many entries as a run has files.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(place, "path", "sha256"))), lambda f: f["sha256"])
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: F.concat(f["path"], f["sha256"]))
    listed = F.array_sort(F.collect_list(F.struct(place, "path", "size_bytes", "sha256")))
    return files.groupBy(*keys).agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"), F.sha2(F.array_join(ordered, ""), 256).alias("ordered_digest"), F.sha2(F.array_join(sorted_, ""), 256).alias("fingerprint"), listed.alias("files"))


def freeze_differences(frozen: DataFrame, now: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """keys, path, difference of a frozen record and the files as they are: added, removed, changed or moved (another place, same content).

    Runs whose two digests both agree are passed over; of the others each file is
    compared once. No rows: nothing differs.
    """
    later = freeze_record(now, keys, place).select(*keys, F.col("ordered_digest").alias("__o"), F.col("fingerprint").alias("__f"), F.col("files").alias("__files"))
    both = frozen.join(later, keys, "full").filter(~(F.col("ordered_digest").eqNullSafe(F.col("__o")) & F.col("fingerprint").eqNullSafe(F.col("__f"))))
    old = both.select(*keys, F.inline("files")).select(*keys, "path", F.struct(place, "sha256").alias("old"))
    new = both.select(*keys, F.inline("__files")).select(*keys, "path", F.struct(place, "sha256").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old.sha256") != F.col("new.sha256"), "changed").when(F.col(f"old.{place}") != F.col(f"new.{place}"), "moved")
    return old.join(new, [*keys, "path"], "full").select(*keys, "path", kind.alias("difference")).filter("difference is not null")
