"""Validators of the relations: rule tables over flat records, each giving (relation, key, rule, severity) rows.

A rule is a condition for breaking it. Rules of one record are tried in one pass; repeats and references
are windows and anti-joins. Columns of a record's verification have the prefix ``v_``: status, url, final_url,
hash, retrieved, checked_at, checked_by, method, audit, published, precision.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, urls
from tidemark.functions.text import stripped
from tidemark.operators import quality
from tidemark.operators.visibility import SKEW_MINUTES

# What the relations' fields may hold.
VERIFICATION = ("unverified", "verified", "stale", "unreachable")
PRECISIONS = ("day", "month", "year")
DEVELOPMENT = ("detected", "promoted", "dismissed")
CLASSIFIED = ("ai", "heuristic", "curated")
ASSESSED = ("ai", "heuristic", "editorial")
REVIEW = ("pending_review", "approved", "rejected", "published")
ENTRY = ("policy", "timeline_event")
CANDIDATE = ("pending", "awaiting_review", "approved", "processed", "dismissed", "failed")
UNRESOLVED = ("pending", "awaiting_review", "approved")
KINDS, SCHEDULES, AUTOMATION = ("html-index", "rss", "document"), ("daily", "weekly"), ("automatic", "manual")
REQUIREMENTS = ("mandatory", "recommended", "consideration")
NOTES_LENGTH = 20
# End of fixed values.


@dataclass(frozen=True)
class Scope:
    """What depends on the register: official hosts, jurisdictions, event types, and the time of validation."""

    suffixes: Sequence[str]
    jurisdictions: Sequence[str]
    now: Column
    events: Sequence[str] = ()
    hosts: Sequence[str] = field(default_factory=tuple)

    def official(self, url: Column) -> Column:
        return urls.is_allowed(url, self.suffixes, self.hosts)

    def ahead(self, time: Column) -> Column:
        return time.cast("timestamp") > self.now.cast("timestamp") + F.expr(f"INTERVAL {SKEW_MINUTES} MINUTES")


def blank(text: Column) -> Column:
    return F.coalesce(stripped(text) == "", F.lit(True))


def given(text: Column) -> Column:
    return F.coalesce(text.cast("string") != "", F.lit(False))


def outside(value: Column, allowed: Sequence[str]) -> Column:
    return ~F.coalesce(value.isin(*allowed), F.lit(False))


def digest(text: Column) -> Column:
    """A SHA-256 in lower-case hex."""
    return F.coalesce(F.rlike(text, F.lit("^[a-f0-9]{64}$")), F.lit(False))


def spelled(url: Column) -> Column:
    """Given, but not written as its canonical form."""
    return given(url) & ~F.coalesce(url == urls.canonical(url), F.lit(False))


def time(text: Column) -> Column:
    return F.when(dates.is_timestamp(text), F.try_to_timestamp(text))


def read(rows: DataFrame, url: Column, scope: Scope) -> DataFrame:
    """rows with what several rules of the verification ask, made once a row: the ``url`` that it should be of, canonical forms,
    whether hosts are official, and times, null where they are none."""
    asked = {"url": F.col("_url"), "v_url": F.col("v_url"), "v_final": F.col("v_final_url")}
    return rows.withColumn("_url", url).withColumns(
        {f"_canonical_{x}": urls.canonical(c) for x, c in asked.items()}
        | {f"_official_{x}": scope.official(c) for x, c in asked.items()}
        | {f"_time_{x}": time(F.col(f"v_{x}")) for x in ("retrieved", "checked_at", "audit")}
    )


def verification_rules(scope: Scope) -> dict[str, Column]:
    """Rules over rows that were ``read``."""
    c = {x: F.col(f"v_{x}") for x in "status url final_url hash retrieved checked_at checked_by method audit published precision".split()}
    there, verified = c["status"].isNotNull() | c["url"].isNotNull(), F.coalesce(c["status"] == "verified", F.lit(False))
    canonical, official, at = ({x: F.col(f"_{kind}_{x}") for x in of} for kind, of in (("canonical", ("url", "v_url", "v_final")), ("official", ("v_url", "v_final")), ("time", ("retrieved", "checked_at", "audit"))))
    misspelled = lambda url, x: given(url) & ~F.coalesce(url == canonical[x], F.lit(False))
    differs = F.coalesce(canonical["v_url"], F.trim(c["url"])) != F.coalesce(canonical["url"], F.trim("_url"))
    late = at["retrieved"] > at["checked_at"] + F.expr(f"INTERVAL {SKEW_MINUTES} MINUTES")
    rules = {
        "verification status": outside(c["status"], VERIFICATION),
        "verification source": blank(c["url"]),
        "verification source form": ~blank(c["url"]) & misspelled(c["url"], "v_url"),
        "verification source differs": ~blank(c["url"]) & differs,
        "verification source host": ~blank(c["url"]) & ~official["v_url"],
        "verification final host": given(c["final_url"]) & ~official["v_final"],
        "verification final form": given(c["final_url"]) & official["v_final"] & misspelled(c["final_url"], "v_final"),
        "verification hash": given(c["hash"]) & ~digest(c["hash"]),
        **{f"verification {x}": given(c[x]) & at[x].isNull() for x in at},
        "verification published": given(c["published"]) & ~dates.is_date(c["published"]),
        "verification precision": given(c["precision"]) & outside(c["precision"], PRECISIONS),
        "verification precision alone": given(c["precision"]) & ~given(c["published"]),
        "verified without hash": verified & ~digest(c["hash"]),
        "verified without time": verified & at["checked_at"].isNull(),
        "verified without person": verified & blank(c["checked_by"]),
        "verified not by hand": verified & ~F.coalesce(c["method"] == "manual", F.lit(False)),
        "verified ahead": verified & scope.ahead(at["checked_at"]),
        "retrieved after check": verified & late & ~F.coalesce(at["audit"] >= at["retrieved"], F.lit(False)),
    }
    return {"verification missing": ~there, **{name: there & bad for name, bad in rules.items()}}


def identified(rows: DataFrame, relation: str, order: str) -> DataFrame:
    """Missing ids, and each record after the first with the same id."""
    none = quality.broken(rows, relation, "id", {"no id": blank(F.col("id").cast("string"))})
    return none.unionByName(quality.duplicates(rows, relation, "id", F.when(~blank(F.col("id").cast("string")), F.col("id").cast("string")), order, "id repeats"))


def waiting(rows: DataFrame, relation: str) -> DataFrame:
    """One warning with the number of records that aren't verified, none where there are none."""
    n = rows.agg(F.count_if(~F.coalesce(F.col("v_status") == "verified", F.lit(False))).alias("n")).where("n > 0")
    return n.select(F.lit(relation).alias("relation"), F.col("n").cast("string").alias("key"), F.lit("await review").alias("rule"), F.lit("warning").alias("severity"))


def agencies(rows: DataFrame, scope: Scope, order: str = "_ord") -> DataFrame:
    """rows: id, name, jurisdiction, level, published (has a statement), website, statement_url, and the verification."""
    rules = {
        "name": blank(F.col("name")),
        "jurisdiction": outside(F.col("jurisdiction"), scope.jurisdictions),
        "level": outside(F.col("level"), ("federal", "state")),
        "published flag": F.col("published").isNull(),
        "website host": ~scope.official(F.col("website")),
        **verification_rules(scope),
    }
    told = read(rows, F.when(given(F.col("statement_url")), F.col("statement_url")).otherwise(F.col("website")), scope)
    return quality.merged(identified(rows, "agencies", order), quality.broken(told, "agencies", "id", rules), waiting(rows, "agencies"))


def policies(rows: DataFrame, scope: Scope, types: Sequence[str], statuses: Sequence[str], date_types: Sequence[str], order: str = "_ord") -> DataFrame:
    """rows: id, title, description, jurisdiction, type, status, effective, tags, agencies, content, summary, created, updated,
    last_review, url, superseded_by, the verification, and dates: type, date, precision, primary, s_url, s_published,
    s_precision, r_date, r_precision (evidence of a date: its source, what that says, and what a person read there)."""
    verified, day = F.coalesce(F.col("v_status") == "verified", F.lit(False)), F.lit("day")
    told = read(rows, F.coalesce("url", F.lit("")), scope).withColumn("_primary", F.filter("dates", lambda d: F.coalesce(d["primary"], F.lit(False))))
    told = told.withColumn("_first", F.get("_primary", 0)).withColumns({"_dated": dates.is_date(F.col("_first.date")), "_effective": dates.is_date(F.col("effective")), "_created": time(F.col("created")), "_updated": time(F.col("updated"))})
    first = F.col("_first")
    hollow = lambda c: F.exists(c, blank)
    backed = lambda d: F.coalesce((d["s_published"] == d["date"]) & (F.coalesce(d["s_precision"], day) == d["precision"]), F.lit(False)) | F.coalesce((d["r_date"] == d["date"]) & (F.coalesce(d["r_precision"], day) == d["precision"]), F.lit(False))
    rules = {
        **{c: blank(F.col(c)) for c in ("title", "description", "content", "summary")},
        "jurisdiction": outside(F.col("jurisdiction"), scope.jurisdictions),
        "type": outside(F.col("type"), types),
        "status": outside(F.col("status"), statuses),
        "effective": ~F.col("_effective"),
        "no dates": F.coalesce(F.size("dates") <= 0, F.lit(True)),
        "not one primary date": (F.size("dates") > 0) & (F.size("_primary") != 1),
        "effective isn't the primary date": F.col("_dated") & F.col("_effective") & (first["date"] != F.col("effective")),
        "primary date not backed": verified & F.col("_dated") & ~outside(first["precision"], PRECISIONS) & ~backed(first),
        "no tags": F.col("tags").isNull(),
        "empty tag": hollow("tags"),
        "no agencies": F.col("agencies").isNull(),
        "empty agency": hollow("agencies"),
        "created": F.col("_created").isNull(),
        "updated": F.col("_updated").isNull(),
        "last review": given(F.col("last_review")) & ~dates.is_timestamp(F.col("last_review")) & ~dates.is_date(F.col("last_review")),
        "created after update": F.col("_created") > F.col("_updated"),
        "no source": blank(F.col("url")),
        "source host": ~blank(F.col("url")) & ~F.col("_official_url"),
        "source form": ~blank(F.col("url")) & (F.col("url") != F.coalesce("_canonical_url", F.lit(""))),
        "superseded by no id": F.col("superseded_by").isNotNull() & blank(F.col("superseded_by").cast("string")),
        **verification_rules(scope),
    }
    each = rows.select("id", "dates", F.posexplode("dates").alias("_at", "d"))
    each = each.select(F.concat_ws("/", F.coalesce("id", F.lit("")), F.col("_at").cast("string")).alias("key"), "d", F.exists(F.slice("dates", F.lit(1), F.col("_at")), lambda e: F.coalesce(e["type"] == F.col("d.type"), F.lit(False))).alias("_again"))
    each = each.withColumns({"_valid": dates.is_date(F.col("d.date")), "_official": ~blank(F.col("d.s_url")) & scope.official(F.col("d.s_url"))})
    date, precision, valid, official = F.col("d.date"), F.col("d.precision"), F.col("_valid"), F.col("_official")
    sourced = F.col("d.s_url").isNotNull() | F.col("d.r_date").isNotNull()
    date_rules = {
        "date type": outside(F.col("d.type"), date_types),
        "date type repeats": ~outside(F.col("d.type"), date_types) & F.col("_again"),
        "date": ~valid,
        "date precision": outside(precision, PRECISIONS),
        "date year not on its first day": (precision == "year") & valid & ~date.endswith("-01-01"),
        "date month not on its first day": (precision == "month") & valid & ~date.endswith("-01"),
        "date source host": sourced & ~official,
        "reviewed date": sourced & official & given(F.col("d.r_date")) & (~dates.is_date(F.col("d.r_date")) | outside(F.col("d.r_precision"), PRECISIONS)),
        "reviewed date differs": sourced & official & given(F.col("d.r_date")) & valid & ~(F.col("d.r_date").eqNullSafe(date) & F.col("d.r_precision").eqNullSafe(precision)),
    }
    again = quality.duplicates(rows, "policies", "id", F.when(~blank(F.col("url")), urls.identity(F.col("url"))), order, "source repeats")
    lost = quality.dangling(rows, "policies", "id", "superseded_by", rows, "id", "superseded by none", "warning")
    return quality.merged(identified(rows, "policies", order), quality.broken(told, "policies", "id", rules), quality.broken(each, "policies", "key", date_rules), again, lost, waiting(rows, "policies"))


def timeline(rows: DataFrame, policies: DataFrame, scope: Scope, order: str = "_ord") -> DataFrame:
    """rows: id, title, description, date, precision, type, jurisdiction, related, url, and the verification; policies: id."""
    told = read(rows, F.coalesce("url", F.lit("")), scope).withColumn("_valid", dates.is_date(F.col("date")))
    date, precision, verified = F.col("date"), F.col("precision"), F.coalesce(F.col("v_status") == "verified", F.lit(False))
    valid = F.col("_valid")
    backed = F.coalesce((F.col("v_published") == date) & (F.coalesce(F.col("v_precision"), F.lit("day")) == precision), F.lit(False))
    rules = {
        "title": blank(F.col("title")),
        "description": blank(F.col("description")),
        "date": ~valid,
        "verified without precision": verified & ~given(precision),
        "precision": given(precision) & outside(precision, PRECISIONS),
        "year not on its first day": (precision == "year") & valid & ~date.endswith("-01-01"),
        "month not on its first day": (precision == "month") & valid & ~date.endswith("-01"),
        "date not backed": verified & valid & given(precision) & ~outside(precision, PRECISIONS) & ~backed,
        "type": outside(F.col("type"), scope.events),
        "jurisdiction": outside(F.col("jurisdiction"), scope.jurisdictions),
        "no source": blank(F.col("url")),
        "source host": ~blank(F.col("url")) & ~F.col("_official_url"),
        "source form": ~blank(F.col("url")) & F.col("_official_url") & (F.col("url") != F.coalesce("_canonical_url", F.lit(""))),
        **verification_rules(scope),
    }
    none = quality.dangling(rows, "timeline", "id", "related", policies, "id", "related to none")
    return quality.merged(identified(rows, "timeline", order), quality.broken(told, "timeline", "id", rules), none, waiting(rows, "timeline"))


def developments(rows: DataFrame, policies: DataFrame, events: DataFrame, scope: Scope, order: str = "_ord") -> DataFrame:
    """rows: id, title, url, source_id, source_name, jurisdiction, status, reason, policy, event, classification, score,
    detected, published, precision, a_method, a_time, a_prompt, and the verification. References are tested where targets exist."""
    told = read(rows, F.coalesce("url", F.lit("")), scope)
    kind, method, assessed = F.col("classification"), F.col("a_method"), F.col("a_method").isNotNull() | F.col("a_time").isNotNull()
    rules = {
        **{x: blank(F.col(x)) for x in ("title", "url", "source_id", "source_name")},
        "url host": ~blank(F.col("url")) & ~F.col("_official_url"),
        "url form": ~blank(F.col("url")) & F.col("_official_url") & (F.col("url") != F.coalesce("_canonical_url", F.lit(""))),
        "jurisdiction": outside(F.col("jurisdiction"), scope.jurisdictions),
        "status": outside(F.col("status"), DEVELOPMENT),
        "dismissed without reason": (F.col("status") == "dismissed") & blank(F.col("reason")),
        "classification": outside(kind, CLASSIFIED),
        "score": ~F.coalesce(F.col("score").between(0, 1), F.lit(False)),
        "detected": ~dates.is_timestamp(F.col("detected")),
        "published": given(F.col("published")) & ~dates.is_date(F.col("published")),
        "precision": given(F.col("precision")) & outside(F.col("precision"), PRECISIONS),
        "precision alone": given(F.col("precision")) & ~given(F.col("published")),
        "no assessment": ~assessed,
        "assessment method": assessed & outside(method, ASSESSED),
        "assessment time": assessed & ~dates.is_timestamp(F.col("a_time")),
        "assessment prompt": assessed & blank(F.col("a_prompt")),
        "assessed otherwise": assessed & ~kind.eqNullSafe("curated") & ~method.eqNullSafe(kind),
        "curated, not editorial": assessed & kind.eqNullSafe("curated") & ~method.eqNullSafe("editorial"),
        **verification_rules(scope),
    }
    some = lambda targets: targets.limit(1).agg((F.count("*") > 0).alias("_some"))
    to = lambda name, targets: quality.dangling(rows, "developments", "id", name, targets, "id", f"{name} is none").crossJoin(F.broadcast(some(targets))).where("_some").drop("_some")  # noqa: E731  one row
    return quality.merged(identified(rows, "developments", order), quality.broken(told, "developments", "id", rules), to("policy", policies), to("event", events))


def source_reviews(rows: DataFrame, policies: DataFrame, events: DataFrame, scope: Scope, order: str = "_ord") -> DataFrame:
    """rows: id, url, status, kind, policy, event (targets), previous_url, base_hash, policy_hash, event_hash, draft_id,
    draft_url, draft_created, sequence, discovered, updated, reviewed, reviewer, e_url, e_retrieved, e_published, e_precision;
    policies and events: id, url."""
    kept, final = F.col("status").isin("approved", "published"), F.coalesce(F.col("status").isin("approved", "published"), F.lit(False))
    official, web = scope.official(F.col("url")), F.coalesce(F.lower(F.left("url", F.lit(8))) == "https://", F.lit(False))
    to_policy, to_event = given(F.col("policy")), given(F.col("event"))
    precedes = lambda a, b: F.coalesce(time(F.col(a)) > time(F.col(b)), F.lit(False))
    rules = {
        "url": ~web,
        "final without official source": web & ~official & final,
        "url form": web & spelled(F.col("url")),
        "kind": outside(F.col("kind"), ENTRY),
        "policy target of another kind": to_policy & ~F.col("kind").eqNullSafe("policy"),
        "draft isn't the policy target": to_policy & ~F.col("draft_id").eqNullSafe(F.col("policy")),
        "no base revision": to_policy & ~digest(F.col("base_hash")),
        "final without revision": to_policy & kept & ~digest(F.col("policy_hash")),
        "previous source without target": ~to_policy & given(F.col("previous_url")),
        "base revision without target": ~to_policy & given(F.col("base_hash")),
        "revision without target": ~to_policy & given(F.col("policy_hash")),
        "sequence": F.col("sequence") < 1,
        "sequence without target": F.col("sequence").isNotNull() & ~to_policy & ~to_event,
        "base revision": given(F.col("base_hash")) & ~digest(F.col("base_hash")),
        "revision": given(F.col("policy_hash")) & ~digest(F.col("policy_hash")),
        "event revision of another kind": given(F.col("event_hash")) & ~F.col("kind").eqNullSafe("timeline_event"),
        "event revision": given(F.col("event_hash")) & ~digest(F.col("event_hash")),
        "event revision without target": given(F.col("event_hash")) & ~to_event,
        "event target of another kind": to_event & ~F.col("kind").eqNullSafe("timeline_event"),
        "draft isn't the event target": to_event & ~F.col("draft_id").eqNullSafe(F.col("event")),
        "event target without revision": to_event & ~given(F.col("event_hash")),
        "status": outside(F.col("status"), REVIEW),
        "discovered": ~dates.is_timestamp(F.col("discovered")),
        "updated": ~dates.is_timestamp(F.col("updated")),
        "no evidence": blank(F.col("e_url")),
        "evidence differs": ~blank(F.col("e_url")) & ~same(F.col("e_url"), F.coalesce("url", F.lit(""))),
        "evidence form": ~blank(F.col("e_url")) & spelled(F.col("e_url")),
        "evidence retrieved": given(F.col("e_retrieved")) & ~dates.is_timestamp(F.col("e_retrieved")),
        "evidence published": given(F.col("e_published")) & ~dates.is_date(F.col("e_published")),
        "evidence precision": given(F.col("e_precision")) & outside(F.col("e_precision"), PRECISIONS),
        "final without time": final & ~dates.is_timestamp(F.col("reviewed")),
        "final without person": final & blank(F.col("reviewer")),
        "reviewed before discovery": final & precedes("discovered", "reviewed"),
        "reviewed before retrieval": final & precedes("e_retrieved", "reviewed"),
        "reviewed before creation": final & F.col("kind").eqNullSafe("policy") & precedes("draft_created", "reviewed"),
        "final draft differs": final & given(F.col("draft_url")) & ~same(F.col("draft_url"), F.coalesce("url", F.lit(""))),
    }
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit("error").alias("severity"))) for name, bad in rules.items()]
    found.append(F.when(F.coalesce(web & ~official & ~final, F.lit(False)), F.struct(F.lit("source isn't official").alias("rule"), F.lit("warning").alias("severity"))))
    each = rows.select(F.lit("reviews").alias("relation"), F.col("id").cast("string").alias("key"), F.explode(F.array_compact(F.array(*found))).alias("f")).select("relation", "key", "f.rule", "f.severity")
    # only reviews that name a target meet the targets, and with what is compared alone
    named = lambda targets, url: targets.groupBy(F.col("id").alias(f"{url}_of")).agg(F.min("url").alias(url), F.lit(True).alias(f"{url}_there"))
    met = rows.where(to_policy).select("id", "policy", "url", "status", "previous_url", "draft_url").join(named(policies, "_policy"), F.col("policy") == F.col("_policy_of"), "left")
    # of a policy's reviews, published ones that replaced its source: what another review published before is then right too
    later = rows.where((F.col("status") == "published") & given(F.col("previous_url"))).groupBy(F.col("policy").alias("_by"), urls.identity(F.col("previous_url")).alias("_old"), urls.identity(F.col("url")).alias("_new"))
    later = later.agg(F.min("id").alias("_one"), F.max("id").alias("_two"))
    met = met.withColumn("_was", urls.identity(F.col("url"))).withColumn("_is", urls.identity(F.col("_policy")))
    met = met.join(later, (F.col("policy") == F.col("_by")) & (F.col("_was") == F.col("_old")) & (F.col("_is") == F.col("_new")), "left")
    followed = F.coalesce((F.col("_one") != F.col("id")) | (F.col("_two") != F.col("id")), F.lit(False)) & F.coalesce(F.col("status") == "published", F.lit(False)) & ~given(F.col("previous_url"))
    moved = F.when(given(F.col("previous_url")), _no_replacement()).otherwise(~same(F.col("url"), F.col("_policy")))
    of_policies = quality.broken(met, "reviews", "id", {
        "policy target is none": F.col("_policy_there").isNull(),
        "source isn't the policy target's": F.col("_policy_there").isNotNull() & F.coalesce(moved, F.lit(False)) & ~followed,
    })
    told = rows.where(to_event).select("id", "event", "url").join(named(events, "_event"), F.col("event") == F.col("_event_of"), "left")
    of_events = quality.broken(told, "reviews", "id", {
        "event target is none": F.col("_event_there").isNull(),
        "source isn't the event target's": F.col("_event_there").isNotNull() & ~same(F.col("url"), F.col("_event")),
    })
    open_ = rows.where(web & ~F.col("status").eqNullSafe("rejected") & ~to_policy & ~to_event & ~given(F.col("event_hash")))
    again = quality.duplicates(open_, "reviews", "id", urls.identity(F.col("url")), order, "source repeats")
    return quality.merged(identified(rows, "reviews", order), each, of_policies, of_events, again)


def same(a: Column, b: Column) -> Column:
    """Whether two addresses are one source; identities are made only where the texts differ."""
    return F.when(a == b, True).otherwise(urls.identity(a) == urls.identity(b))


def _no_replacement() -> Column:
    """Whether a review that names its previous source doesn't replace it: its target still has the previous one, or, once the
    review is final, the new one."""
    url, old, held = F.col("url"), F.col("previous_url"), F.col("_policy")
    drafted = F.coalesce(same(F.col("draft_url"), url), F.lit(False))
    before, done = same(held, old) & ~same(held, url), F.col("status").isin("approved", "published") & same(held, url) & ~same(held, old)
    return ~drafted | ~(before | done)


def watch_state(seen: DataFrame, checked: DataFrame, snapshots: DataFrame, scope: Scope) -> DataFrame:
    """seen: key, first_seen, status, candidate_url, fingerprint, attempts, error; checked: source, at;
    snapshots: source, hash, first, last, count."""
    status, url = F.col("status"), F.col("candidate_url")
    key = F.concat(urls.canonical(url), F.coalesce(F.concat(F.lit("#change="), F.col("fingerprint")), F.lit("")))
    rules = {
        "host": ~scope.official(F.col("key")),
        "first seen": ~dates.is_timestamp(F.col("first_seen")),
        "status": given(status) & outside(status, CANDIDATE),
        "unresolved without candidate": F.coalesce(status.isin(*UNRESOLVED), F.lit(False)) & url.isNull(),
        "failed without error": F.coalesce(status == "failed", F.lit(False)) & blank(F.col("error")),
        "attempts": F.col("attempts") < 0,
        "candidate form": url.isNotNull() & spelled(url),
        "key isn't the candidate's": url.isNotNull() & ~key.eqNullSafe(F.col("key")),
    }
    of_checks = {"last check": blank(F.col("source")) | ~dates.is_timestamp(F.col("at"))}
    of_snapshots = {"snapshot hash": ~digest(F.col("hash")), "snapshot first": ~dates.is_timestamp(F.col("first")), "snapshot last": ~dates.is_timestamp(F.col("last")), "snapshot count": F.col("count") < 0}
    return quality.merged(quality.broken(seen, "state", "key", rules), quality.broken(checked, "checks", "source", of_checks), quality.broken(snapshots, "snapshots", "source", of_snapshots))


def watch_sources(rows: DataFrame, scope: Scope, order: str = "_ord") -> DataFrame:
    """rows: id, url, kind, schedule, automation, least (items)."""
    official = scope.official(F.col("url"))
    rules = {
        "url host": ~official,
        "url form": official & spelled(F.col("url")),
        "kind": outside(F.col("kind"), KINDS),
        "schedule": outside(F.col("schedule"), SCHEDULES),
        "automation": outside(F.col("automation"), AUTOMATION),
        "least items": F.col("least") < 0,
        "least items of a document": F.col("least").isNotNull() & (F.col("kind") == "document"),
    }
    again = quality.duplicates(rows.where(official), "sources", "id", urls.identity(F.col("url")), order, "url repeats")
    return quality.merged(identified(rows, "sources", order), quality.broken(rows, "sources", "id", rules), again)


def monitoring(rows: DataFrame, sources: DataFrame, statuses: Sequence[str], scope: Scope, order: str = "_ord") -> DataFrame:
    """rows: source, status, reviewed, reviewer, notes, url, final_url, retrieved, hash, published, precision, title;
    sources: id, url, automation, enabled. Only the first review of a source is judged further."""
    from tidemark.operators.ranking import first_by

    again = quality.duplicates(rows, "monitoring", "source", F.col("source").cast("string"), order, "review repeats")
    held = first_by(rows, "source", order).join(sources.select(F.col("id").alias("source"), F.col("url").alias("_url"), F.col("automation").alias("_by")), "source", "left")
    known = F.col("_by").isNotNull()
    rules = {
        "unknown source": ~known,
        "not by hand": known & (F.col("_by") != "manual"),
        "status": outside(F.col("status"), statuses),
        "reviewed": ~dates.is_timestamp(F.col("reviewed")),
        "reviewed ahead": scope.ahead(time(F.col("reviewed"))),
        "reviewer": blank(F.col("reviewer")),
        "notes": F.coalesce(F.char_length(stripped(F.col("notes"))) < NOTES_LENGTH, F.lit(True)),
        "no evidence": blank(F.col("url")),
        "evidence differs": given(F.col("url")) & known & (urls.identity(F.col("url")) != urls.identity(F.col("_url"))),
        "evidence form": spelled(F.col("url")),
        "final host": given(F.col("final_url")) & ~scope.official(F.col("final_url")),
        "final form": given(F.col("final_url")) & scope.official(F.col("final_url")) & spelled(F.col("final_url")),
        "retrieved": given(F.col("retrieved")) & ~dates.is_timestamp(F.col("retrieved")),
        "hash": given(F.col("hash")) & ~digest(F.col("hash")),
        "published": given(F.col("published")) & ~dates.is_date(F.col("published")),
        "precision": given(F.col("precision")) & outside(F.col("precision"), PRECISIONS),
        "precision alone": given(F.col("precision")) & ~given(F.col("published")),
        "title": F.col("title").isNotNull() & blank(F.col("title")),
    }
    never = sources.where("enabled AND automation = 'manual'").join(rows.select(F.col("source").alias("id")), "id", "left_anti")
    warned = never.select(F.lit("monitoring").alias("relation"), F.col("id").cast("string").alias("key"), F.lit("never reviewed").alias("rule"), F.lit("warning").alias("severity"))
    return quality.merged(again, quality.broken(held, "monitoring", "source", rules), warned)


def framework(artifacts: DataFrame, policies: DataFrame) -> DataFrame:
    """artifacts: id, title, version, authority, url, effective, updated, related, hash, risks array<string>, and pillars
    array<struct<id, title, principles array<string>, requirements array<struct<id, title, type, deadline, details array<string>>>>>;
    policies: id, title, url, effective, hash."""
    empty = lambda values: F.coalesce(F.size(values) == 0, F.lit(True)) | F.exists(values, blank)
    rules = {
        **{x: blank(F.col(x)) for x in ("title", "version", "authority", "url")},
        "effective": ~dates.is_date(F.col("effective")),
        "updated": ~dates.is_date(F.col("updated")),
        "no pillars": F.coalesce(F.size("pillars") == 0, F.lit(True)),
        "risks": empty(F.col("risks")),
        "related to none": F.col("related").isNull(),
    }
    pillars = artifacts.select(F.col("id").alias("_of"), F.posexplode("pillars").alias("_at", "p")).select("_of", "_at", "p.*", F.concat_ws("/", "_of", "_at").alias("_key"))
    needs = pillars.select("_of", "_at", F.posexplode("requirements").alias("_n", "r")).select("_of", "_at", "_n", "r.*", F.concat_ws("/", "_of", "_at", "_n").alias("_key"))
    of_pillars = {"pillar id": blank(F.col("id")), "pillar title": blank(F.col("title")), "pillar principles": empty(F.col("principles")), "pillar without requirements": F.coalesce(F.size("requirements") == 0, F.lit(True))}
    of_needs = {
        "requirement id": blank(F.col("id")),
        "requirement title": blank(F.col("title")),
        "requirement type": outside(F.col("type"), REQUIREMENTS),
        "requirement deadline": F.col("deadline").isNotNull() & blank(F.col("deadline")),
        "requirement details": empty(F.col("details")),
    }
    repeats = lambda rows, rule, *within: quality.duplicates(rows, "framework", "_key", F.when(~blank(F.col("id")), F.concat_ws("|", *within, "id")), "_key", rule)
    met = artifacts.join(policies.select(F.col("id").alias("related"), *(F.col(x).alias(f"_{x}") for x in ("title", "url", "effective", "hash"))), "related")
    differs = {x: ~F.col(x).eqNullSafe(F.col(f"_{x}")) for x in ("title", "url", "effective")} | {"hash": given(F.col("hash")) & given(F.col("_hash")) & (F.col("hash") != F.col("_hash"))}
    return quality.merged(
        quality.broken(artifacts, "framework", "id", rules), quality.broken(pillars, "framework", "_key", of_pillars), quality.broken(needs, "framework", "_key", of_needs),
        repeats(pillars, "pillar repeats", "_of"), repeats(needs, "requirement repeats", "_of", "_at"),
        quality.dangling(artifacts, "framework", "id", "related", policies, "id", "related to none"),
        quality.broken(met, "framework", "id", {f"{x} isn't the policy's": bad for x, bad in differs.items()}),
    )
