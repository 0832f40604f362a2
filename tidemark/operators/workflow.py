"""Guarded changes to record sets: each takes the current rows and gives the new ones, or raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import identity


class Conflict(ValueError):
    """A guard of a change doesn't hold."""


def guard(found: DataFrame, message: str) -> None:
    """Raise if there is any such row; Spark stops at the first."""
    if not found.isEmpty():
        raise Conflict(message)


def created(current: DataFrame, record: DataFrame, key: str = "id", url: str = "url", order: str = "_ord") -> DataFrame:
    """Insert in front, unless the key or the url's identity is there."""
    guard(current.join(record.select(key), key, "left_semi"), "the key is taken")
    mine = record.select(identity(F.col(url)).alias("_identity"))
    guard(current.withColumn("_identity", identity(F.col(url))).join(mine, "_identity", "left_semi"), "the source is already recorded")
    front = current.agg(F.coalesce(F.min(order), F.lit(0)).alias("_front"))
    put = record.crossJoin(front).withColumn(order, F.col("_front") - 1).select(current.columns)  # one row
    return put.unionByName(current)


def updated(current: DataFrame, key: str, value, patch: dict[str, Column], now: Column, expected: Column | None = None, revision: str | None = None) -> DataFrame:
    """Replace fields of one record; with ``expected``, only if its revision is still that.

    Moving to trashed sets trashed_at, leaving it clears that; updated_at is now unless given.
    """
    mine = F.col(key) == F.lit(value)
    if current.where(mine).isEmpty():
        raise Conflict("no such record")
    if expected is not None:
        guard(current.where(mine & ~F.col(revision).eqNullSafe(expected)), "the record has changed since")
    fields = dict(patch)
    if "status" in fields and "trashed_at" in current.columns:
        going = (fields["status"] == "trashed") & (F.col("status") != "trashed")
        fields["trashed_at"] = F.when(going, now).when(fields["status"] != "trashed", F.lit(None)).otherwise(F.col("trashed_at"))
    if "updated_at" in current.columns:
        fields.setdefault("updated_at", now)
    return current.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in fields.items()})


def deleted(current: DataFrame, key: str, value) -> tuple[DataFrame, bool]:
    mine = F.col(key) == F.lit(value)
    return current.where(~mine | F.col(key).isNull()), not current.where(mine).isEmpty()


def reconciled(developments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Developments after their reviews: the last review of each decides.

    developments: id, status; reviews: development_id, status, ord. Rejected dismisses, published promotes a
    detected one, an active review brings back a missing one as detected.
    """
    last = reviews.groupBy(F.col("development_id").alias("id")).agg(F.max_by("status", "ord").alias("review"))
    both = developments.join(last, "id", "full_outer")
    status = (
        F.when((F.col("review") == "rejected") & F.col("status").isNotNull(), "dismissed")
        .when((F.col("review") == "published") & (F.col("status") == "detected"), "promoted")
        .when(F.col("status").isNull() & F.col("review").isin("pending_review", "approved"), "detected")
        .otherwise(F.col("status"))
    )
    return both.withColumn("status", status).where("status IS NOT NULL").drop("review")


def merged_reviews(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert by id; an update with the same sequence and hash keeps its first discovery. Updates come first in ``_ord``."""
    old, new = existing.alias("old"), updates.alias("new")
    both = old.join(new, F.col("old.id") == F.col("new.id"), "full_outer")
    same = F.col("old.sequence").eqNullSafe(F.col("new.sequence")) & F.col("old.hash").eqNullSafe(F.col("new.hash")) & F.col("old.id").isNotNull()
    pick = lambda c: F.when(F.col("new.id").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    found = F.when(F.col("new.id").isNotNull() & ~same, F.col("new.discovered")).otherwise(F.coalesce("old.discovered", "new.discovered"))
    rest = [c for c in existing.columns if c not in ("discovered", "_ord")]
    order = F.struct(F.when(F.col("new.id").isNotNull(), 0).otherwise(1).alias("side"), F.coalesce("new._ord", "old._ord").alias("at"))
    return both.select(*(pick(c).alias(c) for c in rest), found.alias("discovered"), order.alias("_ord"))


def monotone(current: Column, given: Column) -> Column:
    """The later of two times; null never wins."""
    return F.greatest(current, given)


def publishable(review: DataFrame, now: Column, live_hash: str, approved_hash: str, checked: str, hours: int = 24) -> DataFrame:
    """Reviews whose live hash is the approved one, checked within ``hours``, and with no newer version."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(checked).cast("timestamp"))
    fresh = age.between(0, hours * 3600 * 1_000_000)
    return review.where((F.col(live_hash) == F.col(approved_hash)) & fresh & ~F.col("superseded"))
