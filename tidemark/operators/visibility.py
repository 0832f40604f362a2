"""What the public sees of a relation: a function of the tables and a given time, never of the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import stripped
from tidemark.functions.urls import identity
from tidemark.operators.folds import matched

# The editorial rules.
REVIEW_DAYS, SKEW_MINUTES = 90, 5
REASONS = {
    "method": "No manual editorial verification is recorded; human re-verification is required.",
    "reviewer": "No attributable editorial reviewer is recorded; human re-verification is required.",
    "expired": "Editorial review interval of 90 days expired; re-verification is required.",
    "hash": "No reproducible source fingerprint is stored; fingerprinted re-verification is required.",
}
ACTIVE_REVIEWS = ("pending_review", "approved")
# End of fixed values.

SHA256 = "(?i)^[a-f0-9]{64}$"


def has_hash(content_hash: Column) -> Column:
    return F.coalesce(F.rlike(content_hash, F.lit(SHA256)), F.lit(False))


def is_current(status: Column, method: Column, checked_by: Column, checked_at: Column, content_hash: Column, now: Column) -> Column:
    """Verified by a named person with a fingerprint, not more than 90 days ago nor five minutes ahead."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(checked_at.cast("timestamp"))
    fresh = (age >= -SKEW_MINUTES * 60 * 1_000_000) & (F.greatest(age, F.lit(0)) <= REVIEW_DAYS * 86_400 * 1_000_000)
    return F.coalesce((status == "verified") & (method == "manual") & (stripped(checked_by) != "") & has_hash(content_hash) & fresh, F.lit(False))


def stale_projection(status: Column, method: Column, checked_by: Column, content_hash: Column, notes: Column, current: Column) -> Column:
    """(status, notes) as shown: verified but no longer current becomes stale, with the reason once."""
    reason = (
        F.when(F.coalesce(method, F.lit("")) != "manual", REASONS["method"])
        .when(F.coalesce(stripped(checked_by), F.lit("")) == "", REASONS["reviewer"])
        .when(has_hash(content_hash), REASONS["expired"])
        .otherwise(REASONS["hash"])
    )
    added = F.when(F.contains(notes, reason), notes).when(F.coalesce(notes, F.lit("")) != "", F.concat(notes, F.lit(" "), reason)).otherwise(reason)
    stale = (status == "verified") & ~current
    return F.struct(F.when(stale, F.lit("stale")).otherwise(status).alias("status"), F.when(stale, added).otherwise(notes).alias("notes"))


def withheld_ids(reviews: DataFrame, records: DataFrame) -> DataFrame:
    """Ids of records that an active review holds back.

    reviews: target_id, url, status, draft_id, draft_revision; records: id, url, revision.
    """
    status, target = F.col("status"), F.col("target_id")
    drafted = target.isNull() & (status == "approved")
    active = reviews.where(status.isin(*ACTIVE_REVIEWS)).select(F.coalesce(target, F.when(drafted, F.col("draft_id"))).alias("id"), F.col("url").alias("_url"), F.when(drafted, F.col("draft_revision")).alias("_draft"), drafted.alias("_drafted"))
    # joined on the id first, so that identities are worked out for rows that meet only
    met = active.join(records.select("id", "url", "revision"), "id").where(~F.col("_drafted") | (F.col("_draft") == F.col("revision")))
    return met.where((F.col("_url") == F.col("url")) | (identity(F.col("_url")) == identity(F.col("url")))).select("id").distinct()


def mask_reference(rows: DataFrame, column: str, visible: DataFrame, key: str = "id") -> DataFrame:
    """References to rows that aren't visible become null."""
    seen = visible.select(F.col(key).alias("_id"), F.col(key).alias("_seen")).distinct()
    return matched(rows, seen, column, "_id").withColumn(column, F.col("_seen")).drop("_seen", "_id")


def public_records(records: DataFrame, withheld: DataFrame, current: Column, reference: str | None = "superseded_by") -> DataFrame:
    """Current records that aren't trashed or withheld, with dangling references nulled."""
    kept = records.where((F.col("status") != "trashed") & current).join(withheld.select("id"), "id", "left_anti")
    return mask_reference(kept, reference, kept) if reference else kept


def redacted(rows: DataFrame, verified: Column, columns: Sequence[str]) -> DataFrame:
    """Claims become null unless verified."""
    return rows.withColumns({c: F.when(verified, F.col(c)) for c in columns})


def keep_public_members(rows: DataFrame, key: str, members: str, public: DataFrame, public_key: str = "id") -> DataFrame:
    """An array of ids cut to the public ones, in order; null where none is left."""
    each = rows.select(key, F.posexplode(members).alias("_at", "_id")).join(public.select(F.col(public_key).alias("_id")).distinct(), "_id", "left_semi")
    left = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda s: s["_id"]).alias("_kept"))
    return rows.join(left, key, "left").withColumn(members, F.col("_kept")).drop("_kept")


def later_than(sequence: str, discovered: str, key: str) -> list[Column]:
    """The order of a record's versions: sequence, time of discovery, id."""
    return [F.col(sequence).asc_nulls_first(), F.col(discovered), F.col(key)]


def has_newer_version(reviews: DataFrame, target: str, sequence: str, discovered: str, key: str) -> DataFrame:
    """reviews with ``superseded``: whether a later version of the same target is there."""
    newest = reviews.groupBy(target).agg(F.max(F.struct(sequence, discovered, key)).alias("_newest"))
    return reviews.join(newest, target).withColumn("superseded", F.struct(sequence, discovered, key) < F.col("_newest")).drop("_newest")


def gated(artifacts: DataFrame, records: DataFrame, current: Column) -> DataFrame:
    """Artifacts that the public sees: their record is public, they are ``current`` themselves, were checked no earlier than
    their record, and stand on the same content where both have a hash.

    artifacts: related, checked_at, hash and what ``current`` reads; records: id, checked_at, hash of the public ones.
    """
    held = records.select(F.col("id").alias("_id"), F.col("checked_at").alias("_checked"), F.col("hash").alias("_hash"))
    met = artifacts.where(current).join(held, F.col("related") == F.col("_id"))
    same = F.col("hash").isNull() | F.col("_hash").isNull() | (F.col("hash") == F.col("_hash"))
    return met.where((F.col("checked_at") >= F.col("_checked")) & same).select(artifacts.columns)
