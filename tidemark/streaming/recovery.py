"""Collector state rebuilt from the reviews that were written: what a run has lost comes back, and nothing goes back.

Reviews are folded in their order. The fold of a candidate's status depends on its last decision and on whether a pending
review came after it; a snapshot takes a version that is greater than all before it, or that version again with the same
content. So the fold is sums and running maxima, and no source's reviews are gathered.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import state_key
from tidemark.functions.urls import identity
from tidemark.operators import folds


class State(NamedTuple):
    #: key, source_id, status, first_seen, processed_at, error
    seen: DataFrame
    #: source_id, hash, sequence, first_checked, last_checked, last_changed
    snapshots: DataFrame
    #: source_id, checked
    checks: DataFrame


def versions(reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """Reviews of a version of a source: with a sequence from 1 on and a hash, and a source by its development or its address.

    Of sources with one address the last counts.
    """
    named = sources.groupBy(identity(F.col("url")).alias("_identity")).agg(F.max_by("source_id", "ord").alias("_by_url"))
    numbered = reviews.where((F.col("sequence") >= 1) & F.rlike("hash", F.lit("^[a-f0-9]{64}$"))).withColumn("_identity", identity(F.col("url")))
    held = numbered.join(named, "_identity", "left").withColumn("source_id", F.coalesce("linked_source", "_by_url")).where("source_id IS NOT NULL")
    processed = F.coalesce("published", "reviewed", "updated")
    return held.select(
        "source_id", "ord", "status", "hash", "sequence", "discovered", "reviewed", processed.alias("processed"), F.coalesce("retrieved", processed).alias("checked"),
        state_key(F.col("_identity"), F.concat_ws(":", "hash", "sequence")).alias("key"),
    )


def seen(held: DataFrame, state: DataFrame) -> DataFrame:
    pending = F.col("status") == "pending_review"
    folded = held.groupBy("key").agg(
        F.max_by(F.when(~pending, F.struct("status", "processed", "source_id", "ord")), F.when(~pending, F.col("ord"))).alias("last"),
        F.max(F.when(pending, F.col("ord"))).alias("asked"),
        F.min_by(F.struct("source_id", "discovered"), "ord").alias("first"),
    )
    both = state.alias("s").join(folded, "key", "full_outer")
    decided = F.col("last").isNotNull()
    told = F.when(F.col("last.status").isin("approved"), "approved").when(F.col("last.status") == "rejected", "dismissed").otherwise("processed")
    base = F.when(decided, told).otherwise(F.col("s.status"))
    again = F.col("asked").isNotNull() & (~decided | (F.col("asked") > F.col("last.ord")))
    new = F.col("s.key").isNull() & ~decided
    back = again & (base == "processed")
    done = F.when(decided, F.when(told != "approved", F.col("last.processed"))).otherwise(F.col("s.processed_at"))
    return both.select(
        "key",
        F.coalesce("last.source_id", "s.source_id", "first.source_id").alias("source_id"),
        F.when(new, "pending").when(back, "awaiting_review").otherwise(base).alias("status"),
        F.coalesce("s.first_seen", "first.discovered").alias("first_seen"),
        F.when(~F.coalesce(back, F.lit(False)) & ~new, done).alias("processed_at"),
        F.when(~decided, F.col("s.error")).alias("error"),
    )


def accepted(held: DataFrame, snapshots: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """The approved and published versions that move their source's snapshot; ``reviews`` are what ``held`` comes from."""
    start = snapshots.select("source_id", "hash", "sequence", F.lit(-1).cast("long").alias("ord"))
    told = held.where(F.col("status").isin("approved", "published"))
    rows = told.unionByName(start, allowMissingColumns=True)
    holder = rows.groupBy("source_id", "sequence").agg(F.min_by("hash", "ord").alias("_holder"))
    placed = folds.running_max(rows, ["source_id"], "ord", "sequence", "_sofar", like=reviews).where("ord >= 0").join(holder, ["source_id", "sequence"])
    newer = F.col("_sofar").isNull() | (F.col("sequence") > F.col("_sofar"))
    return placed.where(newer | ((F.col("sequence") == F.col("_sofar")) & (F.col("hash") == F.col("_holder"))))


def recovered(state: State, reviews: DataFrame, sources: DataFrame) -> State:
    """The state after all reviews in the order of ``ord``, which starts from 0 and is unique.

    reviews: ord, status, url, hash, sequence, linked_source, discovered, retrieved, reviewed, published, updated; sources:
    source_id, url, ord. Reviews that repeat change nothing the second time.
    """
    held = versions(reviews, sources)
    moves = accepted(held, state.snapshots, reviews).groupBy("source_id").agg(
        F.max_by(F.struct("hash", "sequence", F.col("checked").alias("last_checked"), F.coalesce("reviewed", "processed").alias("last_changed")), "ord").alias("last"),
        F.min_by("checked", "ord").alias("first_checked"),
        F.max("checked").alias("checked"),
    )
    both = state.snapshots.alias("s").join(moves.alias("m"), "source_id", "full_outer")
    pick = lambda c: F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    snapshots = both.select("source_id", pick("hash"), pick("sequence"), F.coalesce("s.first_checked", "m.first_checked").alias("first_checked"), pick("last_checked"), pick("last_changed"))
    checks = state.checks.unionByName(moves.select("source_id", "checked")).groupBy("source_id").agg(F.max("checked").alias("checked"))
    return State(seen(held, state.seen), snapshots, checks)
