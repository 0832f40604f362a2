"""Filtered, merged and ordered views of the relations, as functions of the tables and a given time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import folded
from tidemark.functions.urls import identity
from tidemark.operators.visibility import mask_reference


def matches(needle: str, *fields: Column, lists: Sequence[Column] = ()) -> Column:
    """Whether a search text is in any of the fields, or in an item of the lists, whatever the case; empty finds all."""
    asked = needle.strip().lower()
    if not asked:
        return F.lit(True)
    found = F.lit(False)
    for x in fields:
        found = found | F.coalesce(F.contains(F.lower(x), F.lit(asked)), F.lit(False))
    for x in lists:
        found = found | F.coalesce(F.exists(x, lambda item: F.contains(F.lower(item), F.lit(asked))), F.lit(False))
    return found


def chosen(column: str, values: Sequence[str]) -> Column:
    """Membership in a list of choices; none chosen lets all pass."""
    return F.col(column).isin(*values) if values else F.lit(True)


def has_theme(tags: Column, key: str | None) -> Column:
    """Whether a folded tag is the theme's key; no theme lets all pass."""
    return F.lit(True) if key is None else F.coalesce(F.exists(tags, lambda t: folded(t) == key), F.lit(False))


def withheld_events(reviews: DataFrame, events: DataFrame, open_states=("pending_review", "approved")) -> DataFrame:
    """Ids of timeline events that an active review holds back.

    reviews: event_id, url, status, draft_id, draft_hash, event_hash; events: id, url, revision. The target is the named
    event, else the draft's where a revision is stored; approved drafts and stored revisions must still be the event's.
    """
    target = F.coalesce("event_id", F.when((F.col("event_hash").isNotNull()) | (F.col("status") == "approved"), F.col("draft_id")))
    named = F.col("event_id").isNotNull()
    hashes = F.when(~named, F.array_compact(F.array("event_hash", F.when(F.col("status") == "approved", F.col("draft_hash")))))
    active = reviews.where(F.col("status").isin(*open_states)).select(target.alias("id"), F.col("url").alias("_url"), hashes.alias("_hashes")).where("id IS NOT NULL AND (_hashes IS NULL OR size(_hashes) > 0)")
    met = active.join(events.select("id", "url", "revision"), "id")
    # identities are made last, of rows that hold else, and only where the texts differ
    held = F.col("_hashes").isNull() | F.coalesce(F.array_contains("_hashes", F.col("revision")), F.lit(False))
    source = F.when(F.col("_url") == F.col("url"), True).otherwise(identity(F.col("_url")) == identity(F.col("url")))
    return met.where(F.when(held, source).otherwise(False)).select("id").distinct()


def event_as_development(events: DataFrame) -> DataFrame:
    """(id, event_id, title, url, jurisdiction, detected, status): a manual event in the shape of a development."""
    return events.select(F.concat(F.lit("timeline-"), "id").alias("id"), F.col("id").cast("string").alias("event_id"), "title", "url", "jurisdiction", F.col("date").alias("detected"), F.lit("promoted").alias("status"))


def with_legacy(developments: DataFrame, legacy: DataFrame, order: str = "_ord") -> DataFrame:
    """Developments, and those of the legacy ones that none of them has by event or by source; of two legacy ones with a
    common event or source the first stays. Two anti-joins on keys, not one with OR. legacy has ``order`` beside the columns."""
    live = developments.where("status <> 'dismissed'")
    rest = legacy.join(live.where("event_id IS NOT NULL").select("event_id").distinct(), "event_id", "left_anti").withColumn("_source", identity(F.col("url")))
    rest = rest.join(live.select(identity(F.col("url")).alias("_source")).distinct(), "_source", "left_anti")
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    kept = rest.withColumn("_a", first("event_id")).where("_a").withColumn("_b", first("_source")).where("_b")
    return developments.unionByName(kept.select(developments.columns))


def masked_developments(developments: DataFrame, policies: DataFrame, events: DataFrame, reason: str) -> DataFrame:
    """Public developments: not dismissed, references to what isn't public nulled, and verified ones that lost one stale, with the reason."""
    live = developments.where("status <> 'dismissed'").withColumns({"_p": F.col("policy_id"), "_e": F.col("event_id")})
    held = mask_reference(mask_reference(live, "policy_id", policies), "event_id", events)
    lost = (F.col("_p").isNotNull() & F.col("policy_id").isNull()) | (F.col("_e").isNotNull() & F.col("event_id").isNull())
    stale = lost & (F.col("v_status") == "verified")
    return held.withColumns({"v_status": F.when(stale, "stale").otherwise(F.col("v_status")), "notes": F.when(stale, reason).otherwise(F.col("notes"))}).drop("_p", "_e")


def newest(rows: DataFrame, key: str, limit: int = 0) -> DataFrame:
    """By publication, else detection, newest first; a limit of 0 is none, and applies last."""
    ordered = rows.orderBy(F.coalesce("published", "detected").desc_nulls_last(), key)
    return ordered.limit(limit) if limit else ordered


def by_strength(connections: DataFrame) -> DataFrame:
    """Formal neighbours first, then the heavier, then by title."""
    return connections.orderBy(F.col("formal").desc(), F.col("weight").desc(), "title")


def with_verdicts(candidates: DataFrame, verdicts: DataFrame, fallback: Column, cap: float = 0.65) -> DataFrame:
    """Candidates with the scorer's verdict, else the heuristic's: method, raw score, and the stored score, which a heuristic can't bring above ``cap``."""
    held = candidates.join(verdicts.select("id", F.col("score").alias("_score")), "id", "left")
    method = F.when(F.col("_score").isNotNull(), "ai").otherwise("heuristic")
    raw = F.coalesce("_score", fallback)
    return held.withColumns({"method": method, "raw": raw, "score": F.when(F.col("_score").isNull(), F.least(fallback, F.lit(cap))).otherwise(F.col("_score"))}).drop("_score")


def grouped_notes(notes: DataFrame, places: DataFrame) -> DataFrame:
    """(jurisdiction, n, ids newest first) of every place, those without notes included."""
    newest_first = F.transform(F.sort_array(F.collect_list(F.struct("date", "id")), False), lambda s: s["id"])
    held = notes.groupBy("jurisdiction").agg(F.count("*").alias("n"), newest_first.alias("ids"))
    return places.select("jurisdiction").join(held, "jurisdiction", "left").na.fill(0, ["n"])


def greatest_count(snapshots: DataFrame, fingerprints: DataFrame, source: str = "source") -> DataFrame:
    """(source, count): the newest version that a snapshot or a fingerprint of ``hash:count`` tells, 0 where neither does."""
    told = F.regexp_extract("fingerprint", "^[a-f0-9]{64}:([0-9]+)$", 1)
    seen = fingerprints.where(told != "").select(source, told.cast("long").alias("count"))
    both = snapshots.select(source, F.coalesce("count", F.lit(0)).cast("long").alias("count")).unionByName(seen)
    return both.groupBy(source).agg(F.max("count").alias("count"))


def unresolved(candidates: DataFrame, source: str = "source", open_states=("pending", "awaiting_review", "approved")) -> DataFrame:
    """(source, unresolved): whether a change of the source still waits."""
    return candidates.groupBy(source).agg(F.coalesce(F.bool_or(F.col("status").isin(*open_states)), F.lit(False)).alias("unresolved"))


def audit_summary(results: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: reached, unreached, rate, unreached critical sources in order, and whether the audit failed."""
    ok = F.col("reached")
    counted = results.agg(F.count_if(ok).alias("reached"), F.count_if(~ok).alias("unreached"), F.array_sort(F.collect_list(F.when(~ok & F.col("critical"), F.col("source")))).alias("critical"))
    rated = counted.withColumn("rate", F.when(F.col("reached") + F.col("unreached") == 0, 1.0).otherwise(F.col("reached") / (F.col("reached") + F.col("unreached"))))
    return rated.withColumn("failed", (F.col("rate") < least) | (F.size("critical") > 0))


def focus(nodes: DataFrame, wanted) -> DataFrame:
    """The wanted node where it is visible, else the one of most edges, of equal ones the first by title."""
    mine = (F.col("id") == F.lit(wanted)).cast("int")
    return nodes.orderBy(mine.desc(), F.col("degree").desc(), "title", "id").limit(1)


def attached_within(documents: DataFrame, page: str, budget: int) -> DataFrame:
    """Documents of each page, in the order of their urls, with ``kept``: whether all up to it fit the page's budget of bytes."""
    total = F.sum("bytes").over(Window.partitionBy(page).orderBy("url").rowsBetween(Window.unboundedPreceding, 0))
    return documents.withColumn("kept", total <= budget)


def headline_claims(rows: DataFrame, key: str, order: Sequence[str], accepted: str = "accepted") -> DataFrame:
    """Each candidate with ``claimed``: it is the first accepted one of its headline and month. Ones before that don't claim."""
    w = Window.partitionBy(key, accepted).orderBy(*order)
    return rows.withColumn("claimed", F.col(key).isNull() & F.col(accepted) | F.col(key).isNotNull() & F.col(accepted) & (F.row_number().over(w) == 1))
