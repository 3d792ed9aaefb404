"""Tables keyed by columns: latest row, upsert, change feeds, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` of each key: one aggregation, partly done before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(previous: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch, and earlier rows whose key it lacks. Keys of the batch must be unique."""
    return previous.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch)


def apply_changes(previous: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: Column) -> DataFrame:
    """The state after a change feed: the last change of each key counts, and a delete removes the key."""
    last = latest_per_key(changes.withColumn("_gone", F.coalesce(deleted, F.lit(False))), keys, order)
    kept = previous.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.filter(~F.col("_gone")).select(*previous.columns))


def diff_tables(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, change (added, removed, changed) and both rows as structs; equal rows are left out."""
    rest = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.struct(*rest).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, list(keys), "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change", "before", "after")


def array_changes(before: Column, after: Column) -> tuple[Column, Column]:
    """(removed, added) elements of two arrays, as sets."""
    return F.array_sort(F.array_except(before, after)), F.array_sort(F.array_except(after, before))


def set_conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with several values, as (keys, values): what a rule that may have one value only rejects."""
    found = df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return found.filter(F.size("values") > 1)
