"""First and last wins, retry queues, bounded selection, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; ``order`` should be total."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_value_by(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of the last row of each key, by partial aggregation."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def repeats(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Rows after the first of their key, with ``holder``, the first one's order value."""
    first = order[0]
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("holder", F.first(first).over(w)).withColumn("_rank", F.row_number().over(w)).where("_rank > 1").drop("_rank")


def retry_queue(state: DataFrame, source: str = "source_id") -> DataFrame:
    """Pending candidates with their place in the source's queue: fewest attempts, then longest waiting."""
    waiting = F.coalesce("last_attempt", "first_seen")
    w = Window.partitionBy(source).orderBy(F.coalesce("attempts", F.lit(0)), waiting, "key")
    return state.where("status = 'pending'").withColumn("place", F.row_number().over(w))


def select_for_run(pending: DataFrame, fresh: DataFrame, most: int, source: str = "source_id") -> DataFrame:
    """At most ``most`` candidates of each source, one slot of them for retries where any wait.

    pending and fresh: source, key, place (from 1). The result has ``origin`` and ``slot``, the order in the run.
    """
    both = pending.select(source, "key", "place", F.lit("pending").alias("origin")).unionByName(fresh.select(source, "key", "place", F.lit("fresh").alias("origin")))
    w = Window.partitionBy(source)
    n_pending = F.count_if(F.col("origin") == "pending").over(w)
    n_fresh = F.count_if(F.col("origin") == "fresh").over(w)
    counted = both.withColumn("p", n_pending).withColumn("f", n_fresh)
    first = F.when(F.col("p") == 0, F.lit(most)).otherwise(F.least(F.col("f"), F.lit(most - 1)))
    retries = F.least(F.col("p"), F.lit(most) - F.when(F.col("f") == 0, 0).otherwise(F.least(F.col("f"), F.lit(most - 1))))
    counted = counted.withColumn("first", first).withColumn("retries", F.when(F.col("p") == 0, 0).otherwise(retries))
    slot = F.when(F.col("origin") == "pending", F.when(F.col("place") <= F.col("retries"), F.least("first", "f") + F.col("place"))).when(F.col("place") <= F.col("first"), F.col("place")).otherwise(F.col("place") + F.col("retries"))
    return counted.withColumn("slot", slot).where((F.col("slot") <= most) & (F.lit(most) > 0)).drop("p", "f", "first", "retries", "place")


def supersede_older(candidates: DataFrame, source: str = "source_id", version: str = "version", open_states=("pending", "awaiting_review", "approved", "failed")) -> DataFrame:
    """Unresolved candidates under the source's newest version are dismissed."""
    newest = F.max(version).over(Window.partitionBy(source))
    older = (F.col(version) < newest) & F.col("status").isin(*open_states)
    return candidates.withColumn("status", F.when(older, "dismissed").otherwise(F.col("status")))


def upsert(current: DataFrame, updates: DataFrame, key: str, order: str = "_ord") -> DataFrame:
    """Rows by key: an update replaces its row and keeps its place, the last update wins, new keys follow."""
    place = current.select(key, F.col(order).alias("_place"))
    last = first_by(updates, key, F.col(order).desc())
    firsts = updates.groupBy(key).agg(F.min(order).alias("_new"))
    base = current.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("_base"))
    put = last.join(place, key, "left").join(firsts, key).crossJoin(F.broadcast(base))  # one row
    put = put.withColumn(order, F.coalesce("_place", F.col("_base") + F.col("_new"))).select(current.columns)
    return current.join(updates.select(key).distinct(), key, "left_anti").select(current.columns).unionByName(put)


def keep_newest(log: DataFrame, most: int, *order: Column) -> DataFrame:
    """The newest rows of a log; a top-k, not a sort of it all."""
    return log.orderBy(*order).limit(most)
