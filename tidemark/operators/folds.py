"""Ordered folds and lookups that don't need a key's rows, or those without a key, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(rows: DataFrame, order: str, n: int | None = None, like: DataFrame | None = None) -> Column:
    """A number for the range of ``order`` that a row is in; about as many rows in each of ``n`` ranges.

    The bounds are constants of the plan, so every reading of it deals the rows alike. They are those of ``like``, if it has rows.
    """
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = lambda held: held.agg(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], 10_000).alias("b")).first()["b"]
    bounds = (None if like is None else found(like)) or found(rows) or []
    return F.size(F.filter(F.array(*(F.lit(b) for b in sorted(set(bounds)))), lambda b: b < F.col(order))) if bounds else F.lit(0)


def running_max(rows: DataFrame, key: Sequence[str], order: str, value: str, out: str, n: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """rows with the greatest ``value`` before each row of its key, null for the first.

    A key's rows are dealt by ranges of the order: each range is gone through by itself, and then only the ranges' maxima.
    Where the ranges lie changes no result; ``like`` are rows whose order is about that of ``rows`` and cheaper to make.
    """
    dealt = rows.withColumn("_range", ranges(rows, order, n, like))
    inside = F.max(value).over(Window.partitionBy(*key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    tops = dealt.groupBy(*key, "_range").agg(F.max(value).alias("_top"))
    before = F.max("_top").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    held = tops.select(*key, "_range", before.alias("_before"))
    return dealt.withColumn("_inside", inside).join(held, [*key, "_range"]).withColumn(out, F.greatest("_inside", "_before")).drop("_range", "_inside", "_before")


def matched(rows: DataFrame, found: DataFrame, key: str, found_key: str | None = None) -> DataFrame:
    """rows with what ``found`` has under their ``key``, as a left join does; rows whose key is null, which match nothing,
    are dealt by their other columns, where a join would send them all to one task."""
    # fields of a struct are equal if both are null, and found has no null key
    theirs = F.struct(F.col(found_key or key).alias("key"), F.lit(None).cast("long").alias("row"))
    mine = F.struct(F.col(key).alias("key"), F.when(F.col(key).isNull(), F.xxhash64(*rows.columns)).alias("row"))
    kept = [c for c in found.columns if c != key]
    there = found.where(F.col(found_key or key).isNotNull()).select(theirs.alias("_key"), *kept)
    return rows.withColumn("_key", mine).join(there, "_key", "left").drop("_key")
