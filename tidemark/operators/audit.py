"""Comparison of stored source evidence with what a source shows now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import host, identity

# Answers that say a source is gone.
GONE = (404, 410)
# End of fixed values.


def linked_documents(before: DataFrame, now: DataFrame, owner: str = "id") -> DataFrame:
    """(owner, same_set, same_content) over linked documents (owner, identity, hash, ord); of equal identities the last counts."""
    last = lambda rows, name: rows.groupBy(owner, "identity").agg(F.max_by("hash", "ord").alias(name))
    both = last(before, "old").join(last(now, "new"), [owner, "identity"], "full_outer")
    missing = F.col("old").isNull() | F.col("new").isNull()
    return both.groupBy(owner).agg((~F.bool_or(missing)).alias("same_set"), (~F.bool_or(missing | (F.col("old") != F.col("new")))).alias("same_content"))


def compared(old_method: Column, new_method: Column, old_hash: Column, new_hash: Column) -> Column:
    """unchanged, changed, or incomparable where a hash is missing or the source was read in another way."""
    return F.when(~old_method.eqNullSafe(new_method) | old_hash.isNull() | new_hash.isNull(), "incomparable").when(old_hash == new_hash, "unchanged").otherwise("changed")


def audited(records: DataFrame, retrieved: DataFrame, only: Column | None = None) -> DataFrame:
    """(id, outcome, http_status, checked_at, error): what an audit of records' sources finds.

    records: id, status, url, hash, method; retrieved: url, ok, http_status, final_url, hash, method, at, error, an answer for
    each address that was asked, met by the source's identity; of several the latest counts. Outcomes: baseline_missing,
    unchanged, changed, incomparable (read in another way than the record's evidence), source_missing (gone, or led to
    another host) and retrieval_failed. Trashed records, and those that ``only`` leaves out, aren't audited.
    """
    told, latest = F.struct("ok", "http_status", "final_url", F.col("hash").alias("new_hash"), F.col("method").alias("new_method"), "at", "error"), F.struct("at", F.coalesce("final_url", F.lit("")))
    # an address is asked again and again, so that its identity is made once for its latest answer
    asked = retrieved.groupBy("url").agg(F.max_by(told, latest).alias("a"), F.max(latest).alias("_latest"))
    answers = asked.groupBy(identity(F.col("url")).alias("_identity")).agg(F.max_by("a", "_latest").alias("a"))
    due = records.where(F.col("status") != "trashed")
    due = (due.where(only) if only is not None else due).withColumn("_identity", identity(F.col("url")))
    held = due.join(answers, "_identity", "left").select("id", "hash", "method", "a.*", F.coalesce(host(F.col("a.final_url")) != host(F.col("url")), F.lit(False)).alias("_moved"))
    moved = F.col("_moved")
    gone = F.coalesce(F.col("http_status").isin(*GONE), F.lit(False)) | moved
    outcome = (
        F.when(gone, "source_missing")
        .when(~F.coalesce("ok", F.lit(False)), "retrieval_failed")
        .when(F.col("hash").isNull(), "baseline_missing")
        .otherwise(compared(F.col("method"), F.col("new_method"), F.col("hash"), F.col("new_hash")))
    )
    said = F.when(F.col("at").isNull(), "not retrieved").when(moved, "led to another host").otherwise(F.col("error"))
    return held.select("id", outcome.alias("outcome"), "http_status", F.col("at").alias("checked_at"), said.alias("error"))


def applied(records: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Records with the verification that an audit leaves: id, status, last_audit; results: id, outcome."""
    held = records.join(results, "id", "left")
    status = (
        F.when(F.col("outcome") == "changed", "stale")
        .when(F.col("outcome") == "unavailable", "unreachable")
        .when((F.col("outcome") == "unchanged") & (F.col("status") == "unreachable"), "needs_review")
        .otherwise(F.col("status"))
    )
    return held.withColumn("status", status).withColumn("last_audit", F.when(F.col("outcome").isNotNull(), at).otherwise(F.col("last_audit"))).drop("outcome")


def aliases_meet(left: Column, right: Column) -> Column:
    return F.arrays_overlap(left, right)


def collisions(records: DataFrame, key: str = "id", aliases: str = "aliases") -> DataFrame:
    """(key, alias): records that share an alias with another one. Aliases of one record only are aggregated away before the join."""
    each = records.select(key, F.explode(F.array_distinct(aliases)).alias("alias"))
    shared = each.groupBy("alias").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("alias")
    return each.join(shared, "alias").select(key, "alias")
