"""Changes of sources over time: versions from hashes, first discovery, run health, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(log: DataFrame, source: str, hash_: str, *order: str) -> DataFrame:
    """log with ``change`` (first, changed, unchanged), ``sequence`` (from 1, one more for each change) and
    ``reverted``: whether the hash of a change has been seen before."""
    w = Window.partitionBy(source).orderBy(*order)
    before = F.lag(hash_).over(w)
    change = F.when(before.isNull(), "first").when(before != F.col(hash_), "changed").otherwise("unchanged")
    marked = log.withColumn("change", change)
    marked = marked.withColumn("sequence", F.sum((F.col("change") != "unchanged").cast("long")).over(w))
    again = F.row_number().over(Window.partitionBy(source, hash_).orderBy(*order)) > 1
    return marked.withColumn("reverted", (F.col("change") == "changed") & again)


def latest_transition(log: DataFrame, source: str, count: str, order: str, *columns: str) -> DataFrame:
    """The row of the greatest count of each source, the first of equal ones."""
    return log.groupBy(source).agg(F.max_by(F.struct(count, *columns), F.struct(F.col(count), -F.col(order))).alias("latest")).select(source, "latest.*")


def first_discovery(rows: DataFrame, key: Sequence[str], found: str) -> DataFrame:
    """rows with the earliest time at which the same key was found."""
    return rows.withColumn(found, F.min(found).over(Window.partitionBy(*key)))


def due(schedule: Column, last_checked: Column, now: Column, days: int = 6) -> Column:
    """Daily sources always; weekly ones if never checked or ``days`` ago or more."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_checked.cast("timestamp"))
    return (schedule == "daily") | last_checked.isNull() | (age >= days * 86_400 * 1_000_000)


def run_health(results: DataFrame, least: float = 0.8, group: Sequence[str] = ()) -> DataFrame:
    """Health of a run from its results (status, eligible, critical).

    The rate is 1 where no source was due. Failed: a critical source erred or the rate is under ``least``;
    degraded: any error.
    """
    ok, bad = F.col("eligible") & (F.col("status") == "success"), F.col("eligible") & (F.col("status") == "error")
    counted = results.groupBy(*group).agg(
        F.count_if(ok).alias("successful"),
        F.count_if(bad).alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.bool_or(bad & F.col("critical")), F.lit(False)).alias("critical_failure"),
        F.coalesce(F.bool_or(~F.col("eligible") & (F.col("status") == "error")), F.lit(False)).alias("retry_failure"),
    )
    total = F.col("successful") + F.col("failed")
    rated = counted.withColumn("due", total).withColumn("rate", F.when(total == 0, F.lit(1.0)).otherwise(F.col("successful") / total))
    health = F.when(F.col("critical_failure") | (F.col("rate") < least), "failed").when((F.col("failed") > 0) | F.col("retry_failure"), "degraded").otherwise("healthy")
    return rated.withColumn("health", health).drop("critical_failure", "retry_failure")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up, 100 of nothing."""
    return F.when(whole == 0, F.lit(100)).otherwise(F.floor(F.lit(100.0) * part / whole + 0.5)).cast("long")


def manual_coverage(sources: DataFrame, reviews: DataFrame, now: Column, days: Column) -> DataFrame:
    """One row: manual sources that are current, unavailable, overdue, never reviewed. reviews: source_id, reviewed_at, outcome."""
    held = sources.join(reviews, "source_id", "left")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("reviewed_at").cast("timestamp"))
    fresh = age <= days.cast("long") * 86_400 * 1_000_000
    state = F.when(F.col("reviewed_at").isNull(), "never").when(~fresh, "overdue").when(F.col("outcome") == "unavailable", "unavailable").otherwise("current")
    return held.withColumn("state", state).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("current", "unavailable", "overdue", "never")))


def fixed_windows(calls: DataFrame, key: str, time: str, order: str, limit: int, seconds: float) -> DataFrame:
    """Each call with ``allowed``: a window opens at a key's first call and again at the first one after it ended.

    Where a window opens depends on the one before, so calls are folded in order, key by key, as Arrow
    batches; a key's calls are sorted by Spark and its state is three numbers.
    """
    schema = calls.select(key, order).schema

    def fold(frames):
        import pandas as pd

        last, until, n = None, 0.0, 0
        for frame in frames:
            out = []
            for k, o, t in zip(frame[key], frame[order], frame["_seconds"]):
                if k != last or t > until:
                    last, until, n = k, t + seconds, 1
                else:
                    n += 1
                out.append((k, o, n <= limit))
            yield pd.DataFrame(out, columns=[key, order, "allowed"])

    timed = calls.select(key, order, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("_seconds"))
    from pyspark.sql import types as T

    return timed.repartition(key).sortWithinPartitions(key, "_seconds", order).mapInPandas(fold, T.StructType([*schema.fields, T.StructField("allowed", T.BooleanType())]))
