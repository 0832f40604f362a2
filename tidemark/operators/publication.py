"""Approval, publication and rejection of staged sources, for many requests in one keyed pass.

A request is decided by the first guard that it doesn't pass, in the order in which the guards stand; of several that pass for one
review, the earliest counts. What it changes depends on revisions: a record is replaced only if it still is what the
approval saw, and a record that already is what a review would write is taken as its own half-written
change, which the request completes. So a pass that ran halfway, or a request that comes twice, ends in the same rows.

records: id, url, content (JSON). reviews: id, status, url, hash, sequence, discovered, target_id, previous_url, target_revision,
proposed_id, proposed (JSON), reviewed, published, reason. requests: request_id, review_id, live_hash, at, by, and for
an approval expected, the revision of the review that was looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.json_text import revision
from tidemark.functions.urls import identity
from tidemark.tables import cut, drop

ACTIVE = ("pending_review", "approved")
APPLIED = "applied"


def review_revision(prefix: str = "") -> Column:
    """What a person who approves has looked at."""
    c = lambda name: F.col(f"{prefix}{name}")
    return F.sha2(F.to_json(F.struct(c("status").alias("status"), c("hash").alias("hash"), c("proposed").alias("proposed"), c("target_id").alias("target_id"))), 256)


def _reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*(F.when(F.coalesce(found, F.lit(False)), F.lit(name)) for name, found in rules), F.lit(APPLIED))


def _packed(digest: Column) -> Column:
    """A SHA-256 made here, in half of the bytes of its text."""
    return F.unhex(digest)


def _text(packed: Column) -> Column:
    return F.lower(F.hex(packed))


def _short(text: Column) -> Column:
    """A text to be compared, in half of its bytes where it is a SHA-256; equal for equal texts only."""
    digest = F.rlike(text, F.lit(r"\A[0-9a-f]{64}\z"))
    return F.when(digest, F.concat(F.lit(b"\0"), F.unhex(text))).otherwise(F.concat(F.lit(b"\1"), F.encode(text, "utf-8")))


def _records(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").alias("t_id"), identity(F.col("url")).alias("t_identity"), _packed(revision(F.col("content"))).alias("_revision"))


def _owners(records: DataFrame) -> DataFrame:
    """Who has an address: the first record's id and revision."""
    return _records(records).groupBy(F.col("t_identity").alias("_identity")).agg(F.min("t_id").alias("_owner"), F.min_by("_revision", "t_id").alias("_owner_revision"))


def _only(reviews: DataFrame, wanted: Column, *columns: str) -> DataFrame:
    """reviews as v_*, whose ``columns`` are null for others than the ``wanted``: rows are moved by their record and then by
    their own id, and texts and digests that nothing asks for are what takes the room."""
    held = reviews.withColumn("_wanted", wanted).withColumn("hash", _short(F.col("hash")))
    return held.select("_wanted", *((F.when(F.col("_wanted"), F.col(x)) if x in columns else F.col(x)).alias(f"v_{x}") for x in reviews.columns))


def _held(reviews: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Reviews as v_* with the record that has their ``key`` as its id.

    _identity, _was: the review's address and the one before. _there: the record exists. _at_home: it is at the
    review's address. _moved: it is at neither of the two.
    """
    v = reviews.withColumns({"_identity": identity(F.col("v_url")), "_was": identity(F.col("v_previous_url")), "_record": F.col(key)}).drop("v_url", "v_previous_url")
    held = v.join(_records(records), F.col("_record") == F.col("t_id"), "left")
    there, at_home = F.col("t_id").isNotNull(), F.col("t_identity") == F.col("_identity")
    return held.withColumns({"_there": there, "_at_home": at_home, "_moved": there & ~(at_home | F.coalesce(F.col("t_identity") == F.col("_was"), F.lit(False)))})


def _made() -> Column:
    return _packed(revision(F.col("v_proposed")))


def _asked(requests: DataFrame, facts: DataFrame, *columns: str, how: str = "left") -> DataFrame:
    """Requests as q_*, with the facts of their reviews."""
    short = lambda c: _short(F.col(c)) if c == "live_hash" else F.col(c)
    q = requests.select(*(short(c).alias(f"q_{c}") for c in ("review_id", "request_id", "at", *columns)))
    return q.join(facts, F.col("q_review_id") == F.col("v_id"), how)


def _earliest(judged: DataFrame, key: str, late: str) -> DataFrame:
    """Of the requests that pass and share ``key``, the earliest stays; the others get the reason ``late``. Others stand alone."""
    asked = (F.col("outcome") == APPLIED) & F.col(key).isNotNull()
    by = Window.partitionBy(key, "_asked").orderBy("q_at", "q_request_id")
    ranked = judged.withColumn("_asked", asked).withColumn("_n", F.rank().over(by))
    return ranked.withColumn("outcome", F.when(asked & (F.col("_n") > 1), late).otherwise(F.col("outcome"))).drop("_asked", "_n")


def _told(judged: DataFrame, revision: Column, own: Column) -> DataFrame:
    return judged.select(F.col("q_request_id").alias("request_id"), F.col("q_review_id").alias("review_id"), "outcome", F.col("q_at").alias("at"), revision.alias("target_revision"), own.alias("own"))


def approvals(requests: DataFrame, reviews: DataFrame, records: DataFrame) -> DataFrame:
    """(request_id, review_id, outcome, at, target_revision, own): what each request to approve comes to."""
    c = F.col
    wanted = ~F.coalesce(c("status").isin("published", "rejected"), F.lit(False))
    own = ("v_id", "v_status", "v_hash", "v_discovered", "v_looked")
    v = _only(reviews.withColumn("looked", _packed(review_revision())), wanted, "looked", "hash", "url", "previous_url", "proposed")
    owners = _owners(records)
    # a new source: is its id or its address taken, or staged by another review
    others = reviews.where(c("status").isin(*ACTIVE)).groupBy(identity(c("url")).alias("_identity")).agg(F.min("id").alias("_first"), F.max("id").alias("_last"))
    new = _held(v.where("v_target_id IS NULL"), records, "v_proposed_id").withColumns({"_id_taken": c("_there") & ~c("_at_home"), "_made": _made()})
    new = new.select(*own, "_identity", "_id_taken", "_made").join(owners, "_identity", "left").join(others, "_identity", "left")
    of_new = _reason(
        ("id_taken", c("_id_taken")),
        ("source_taken", c("_owner").isNotNull() & ~c("_owner_revision").eqNullSafe(c("_made"))),
        ("source_staged", (c("_first") != c("v_id")) | (c("_last") != c("v_id"))),
    )
    # an update: has its target moved, or is the review's address another record's; where the target is at that
    # address, its first owner is found among the records
    first = _records(records).select(c("t_id").alias("_record"), F.min("t_id").over(Window.partitionBy("t_identity")).alias("_owner")).where(c("_owner") != c("_record"))
    tracked = _held(v.where("v_target_id IS NOT NULL"), records, "v_target_id").join(first, "_record", "left").withColumn("_owner", F.when(c("_at_home"), c("_owner")))
    away = F.coalesce(c("_there") & c("_wanted") & ~F.coalesce(c("_moved") | c("_at_home"), F.lit(False)), F.lit(False))
    tracked = cut(tracked.select(*own, "_there", "_moved", "_record", "_identity", "_revision", "_owner", away.alias("_away")))
    gone = tracked.where("_away").drop("_owner").join(owners.select("_identity", "_owner"), "_identity", "left")
    of_tracked = _reason(("target_missing", ~c("_there")), ("target_moved", c("_moved")), ("source_taken", c("_owner") != c("_record")))
    shown = [x.select(*own, of_tracked.alias("_barred"), "_revision") for x in (tracked.where("NOT _away"), gone)]
    facts = cut(shown[0].unionByName(shown[1]).unionByName(new.select(*own, of_new.alias("_barred"), F.lit(None).cast("binary").alias("_revision"))))
    drop(tracked)
    reason = _reason(
        ("missing", c("v_id").isNull()),
        ("published", c("v_status") == "published"),
        ("rejected", c("v_status") == "rejected"),
        ("changed", ~c("q_expected").eqNullSafe(_text(c("v_looked")))),
        ("source_changed", ~c("q_live_hash").eqNullSafe(c("v_hash"))),
        ("no_reviewer", F.coalesce(F.trim("q_by"), F.lit("")) == ""),
        ("before_discovery", c("q_at") < c("v_discovered")),
    )
    reason = F.when(reason == APPLIED, c("_barred")).otherwise(reason)
    judged = _earliest(_asked(requests, facts, "expected", "live_hash", "by").withColumn("outcome", reason), "q_review_id", "late")
    return _told(judged, _text(c("_revision")), F.lit(False))


def publications(requests: DataFrame, reviews: DataFrame, records: DataFrame, days: int = 90, passing: bool = False) -> DataFrame:
    """(request_id, review_id, outcome, at, target_revision, own): what each request to publish comes to; ``own`` where the
    record is already what the review would write. With ``passing`` only requests that pass, which fewer reviews decide."""
    c = F.col
    wanted = F.coalesce(c("status") == "approved", F.lit(True))
    own = ("v_id", "v_status", "v_hash", "v_reviewed")
    seldom = ("hash", "reviewed", "previous_url", "target_revision") + (("proposed",) if passing else ())
    # a new source: whose id or address it is, and whether that record is what it would write
    fresh = _only(reviews.where("target_id IS NULL"), wanted, *seldom)
    new = _held(fresh.where("_wanted") if passing else fresh, records, "v_proposed_id")
    new = new.withColumn("_made", _made()).select(*own, "_identity", "_there", "_revision", "_made").join(_owners(records), "_identity", "left")
    by_owner = c("_owner_revision").eqNullSafe(c("_made")) & c("_owner_revision").isNotNull()
    new = new.withColumn("own", F.coalesce(F.when(c("_revision").isNull(), by_owner).otherwise(c("_revision") == c("_made")), F.lit(False)))
    of_new = _reason(("source_taken", ~c("own") & (c("_there") | c("_owner").isNotNull())))
    # an update: its target, and whether another review of it is newer
    tracked = _held(_only(reviews.where("target_id IS NOT NULL"), wanted, "url", *seldom), records, "v_target_id")
    version = F.struct(F.coalesce("v_sequence", F.lit(-1)).alias("sequence"), c("v_discovered").alias("discovered"), c("v_id").alias("id"))
    tracked = tracked.withColumn("_newest", F.max(F.when(c("v_status") != "rejected", version)).over(Window.partitionBy("_record")))
    tracked = (tracked.where("_wanted") if passing else tracked).withColumns({"own": F.coalesce(c("_revision") == _made(), F.lit(False)), "_older": version < c("_newest")})
    of_tracked = _reason(
        ("target_missing", ~c("_there")),
        ("target_moved", c("_moved")),
        ("target_changed", ~c("own") & ~_text(c("_revision")).eqNullSafe(c("v_target_revision"))),
    )
    none = lambda kind: F.lit(None).cast(kind)
    facts = tracked.select(*own, "_older", of_tracked.alias("_barred"), "own", none("string").alias("_new_identity"), "_revision")
    facts = facts.unionByName(new.select(*own, none("boolean").alias("_older"), of_new.alias("_barred"), "own", c("_identity").alias("_new_identity"), none("binary").alias("_revision")))
    age = F.unix_micros(c("q_at").cast("timestamp")) - F.unix_micros(c("v_reviewed").cast("timestamp"))
    reason = _reason(
        ("missing", c("v_id").isNull()),
        ("published", c("v_status") == "published"),
        ("rejected", c("v_status") == "rejected"),
        ("not_approved", c("v_status") != "approved"),
        ("before_approval", c("v_reviewed").isNull() | (age < 0)),
        ("expired", age > days * 86_400_000_000),
        ("newer_version", c("_older")),
        ("source_changed", ~c("q_live_hash").eqNullSafe(c("v_hash"))),
    )
    reason = F.when(reason == APPLIED, c("_barred")).otherwise(reason)
    judged = _asked(requests, cut(facts), "live_hash", how="inner" if passing else "left").withColumn("outcome", reason)
    judged = _earliest(judged.where(c("outcome") == APPLIED) if passing else judged, "q_review_id", "late")
    # only those that ask for a new source's identity meet by it; the others stay where they are
    asking = (c("outcome") == APPLIED) & c("_new_identity").isNotNull()
    judged = judged.where(~asking).unionByName(_earliest(judged.where(asking), "_new_identity", "source_taken"))
    told = _told(judged, _text(c("_revision")), F.coalesce("own", F.lit(False)))
    return told.where(c("outcome") == APPLIED) if passing else told


def rejections(requests: DataFrame, reviews: DataFrame, records: DataFrame) -> DataFrame:
    """(request_id, review_id, outcome, at, target_revision, own): what each request to reject comes to, which no record decides."""
    c = F.col
    facts = reviews.select(c("id").alias("v_id"), c("status").alias("v_status"), c("discovered").alias("v_discovered"), c("target_id").isNotNull().alias("_tracked"))
    reason = _reason(
        ("missing", c("v_id").isNull()), ("published", c("v_status") == "published"), ("rejected", c("v_status") == "rejected"),
        ("tracked", c("_tracked")), ("before_discovery", c("q_at") < c("v_discovered")),
    )
    judged = _earliest(_asked(requests, facts).withColumn("outcome", reason), "q_review_id", "late")
    return _told(judged, F.lit(None).cast("string"), F.lit(False))


def _won(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == APPLIED).select(F.col("review_id").alias("id"), F.col("at").alias("_at"), F.col("target_revision").alias("_revision"))


def approved(outcomes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews after the approvals: each keeps the revision of the record that it was approved against."""
    held = reviews.join(_won(outcomes), "id", "left")
    yes = F.col("_at").isNotNull()
    change = {"status": F.lit("approved"), "reviewed": F.col("_at"), "target_revision": F.col("_revision")}
    return held.select(*(F.when(yes, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in reviews.columns))


def rejected(outcomes: DataFrame, reviews: DataFrame, reason: str = "rejected by a reviewer") -> DataFrame:
    held = reviews.join(_won(outcomes), "id", "left")
    yes = F.col("_at").isNotNull()
    change = {"status": F.lit("rejected"), "reviewed": F.col("_at"), "reason": F.lit(reason)}
    return held.select(*(F.when(yes, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in reviews.columns))


def published(outcomes: DataFrame, reviews: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, records) after the publications.

    A target takes the proposed content and the review's address, a new source becomes a record; other open reviews of the
    target with an older version are rejected.
    """
    won = _won(outcomes)
    full = won.join(reviews, "id").select("id", "_at", F.coalesce("target_id", "proposed_id").alias("_record"), "target_id", "url", "proposed", "sequence", "discovered")
    version = lambda: F.struct(F.coalesce("sequence", F.lit(-1)).alias("sequence"), "discovered", "id")
    latest = full.where("target_id IS NOT NULL").groupBy("target_id").agg(F.max(version()).alias("_newest"))
    held = reviews.join(won.select("id", "_at"), "id", "left")
    # what was decided before, or has no target, has nothing to do with the target's other reviews
    open_ = F.coalesce(F.col("status").isin(*ACTIVE) & F.col("target_id").isNotNull(), F.lit(False))
    rest = held.where(~open_).withColumn("_newest", F.lit(None).cast(latest.schema["_newest"].dataType))
    held = held.where(open_).join(latest, "target_id", "left").unionByName(rest)
    yes = F.col("_at").isNotNull()
    older = ~yes & F.col("status").isin(*ACTIVE) & F.coalesce(version() < F.col("_newest"), F.lit(False))
    status = F.when(yes, "published").when(older, "rejected").otherwise(F.col("status"))
    reason = F.when(older, F.concat(F.lit("Superseded by newer source update "), F.col("_newest.id"))).otherwise(F.col("reason"))
    change = {"status": status, "published": F.when(yes, F.col("_at")).otherwise(F.col("published")), "reason": reason}
    after = held.select(*(change[c].alias(c) if c in change else F.col(c) for c in reviews.columns))
    made = full.select(F.col("_record").alias("id"), F.col("url").alias("_url"), F.col("proposed").alias("_content"))
    both = records.join(made, "id", "full_outer")
    return after, both.select("id", F.coalesce("_url", "url").alias("url"), F.coalesce("_content", "content").alias("content"))
