"""Small rules of collecting and publishing, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import part

# The candidate machine's limits, and codes after which a request is tried again.
ATTEMPTS, LEAST_SCORE, REVIEW_SCORE = 5, 0.5, 0.7
NEW_DAYS, NOTES_LENGTH = 30, 20
TITLE_KINDS = (("consult", "Consultation"), ("release", "New"), ("publish", "New"), ("update", "Update"), ("amend", "Update"))
RETRY_CODES, SERVER_ERRORS = (408, 429), 500
EXTENSIONS = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword", "rtf": "application/rtf"}
# End of fixed values.


def run_failed(health: Column, errors: Column, targeted: Column) -> Column:
    return (health == "failed") | (targeted & (errors > 0))


def is_retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRY_CODES) | (code >= SERVER_ERRORS), F.lit(False))


def linked_development(explicit: Column, review: Column) -> Column:
    """The development of a review: the named one, else the review's id without its prefix, if that is a development's."""
    bare = F.regexp_replace(review, "^source-review-", "")
    return F.when(explicit.startswith("dev-"), explicit).when(bare.startswith("dev-"), bare)


def event_target(event: Column, draft: Column, revision: Column) -> Column:
    return F.coalesce(event, F.when(revision.isNotNull(), draft))


def next_state(status: Column, outcome: Column, attempts: Column, score: Column) -> Column:
    """A candidate's status after an outcome: selected, duplicate, error, fatal, scored, superseded, or the name of a review's status."""
    open_ = status.isin("pending", "awaiting_review", "approved", "failed")
    reviewed = F.when(outcome == "pending_review", "pending").when(outcome == "approved", "approved").when(outcome == "rejected", "dismissed").when(outcome == "published", "processed")
    pending = (
        F.when(outcome == "selected", "pending")
        .when(outcome == "duplicate", "dismissed")
        .when(outcome == "fatal", "failed")
        .when(outcome == "error", F.when(attempts >= ATTEMPTS, "failed").otherwise("pending"))
        .when(outcome == "scored", F.when(F.coalesce(score, F.lit(0.0)) < LEAST_SCORE, "dismissed").otherwise("processed"))
    )
    return F.coalesce(reviewed, F.when((outcome == "superseded") & open_, "dismissed"), F.when(status == "pending", pending), status)


def attempts_after(outcome: Column, attempts: Column) -> Column:
    return F.coalesce(attempts, F.lit(0)) + (outcome == "selected").cast("int")


def wants_review(method: Column, raw: Column) -> Column:
    return (method == "heuristic") | (raw >= REVIEW_SCORE)


def change_summary(title: Column, first: Column, reverted: Column) -> Column:
    """What the review of a changed document says."""
    return F.when(first, F.concat(F.lit("A baseline of "), title, F.lit(" was missing; the current text was recorded."))).when(
        reverted, F.concat(title, F.lit(" went back to an earlier text."))
    ).otherwise(F.concat(title, F.lit(" changed at its source.")))


def node_text(formal: Column, thematic: Column) -> Column:
    """A node's links in words."""
    many = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word} link"), F.when(n == 1, "").otherwise("s"))
    return F.when((formal == 0) & (thematic == 0), "No links").when(formal == 0, many(thematic, "thematic")).when(thematic == 0, many(formal, "formal")).otherwise(
        F.concat(many(formal, "formal"), F.lit(" and "), many(thematic, "thematic"))
    )


def document_kind(url: Column, mime: Column) -> Column:
    """pdf, docx, doc or rtf by the path's extension, else by the type; null where they disagree or tell nothing."""
    extension = F.lower(F.regexp_extract(part(url, 3), r"\.([A-Za-z]+)$", 1))
    by_name, by_type = F.lit(None).cast("string"), F.lit(None).cast("string")
    bare = F.trim(F.lower(F.substring_index(mime, ";", 1)))
    for kind, name in EXTENSIONS.items():
        by_name, by_type = F.when(extension == kind, kind).otherwise(by_name), F.when(bare == name, kind).otherwise(by_type)
    return F.when(by_name.isNotNull() & by_type.isNotNull() & (by_name != by_type), F.lit(None)).otherwise(F.coalesce(by_name, by_type))


def is_html(mime: Column, body: Column) -> Column:
    told = F.coalesce(F.contains(F.lower(mime), F.lit("html")), F.lit(False))
    return told | F.coalesce(F.rlike(body, F.lit(r"(?i)^\s*(<!doctype html|<html)")), F.lit(False))


def backs_date(date: Column, precision: Column, published: Column, published_precision: Column, reviewed: Column, reviewed_precision: Column) -> Column:
    """Whether a record's date is the source's publication date, or one that a reviewer read there, at the same precision."""
    by_source = (published == date) & (F.coalesce(published_precision, F.lit("day")) == precision)
    by_hand = (reviewed == date) & (F.coalesce(reviewed_precision, F.lit("day")) == precision)
    return F.coalesce(by_source, F.lit(False)) | F.coalesce(by_hand, F.lit(False))


def published_from(review: DataFrame, records: DataFrame) -> DataFrame:
    """Ids of reviews whose revision a record of the same kind and id has. review: id, kind, draft_id, revision; records: kind, id, revision."""
    held = records.select("kind", F.col("id").alias("draft_id"), "revision")
    return review.join(held, ["kind", "draft_id", "revision"], "left_semi").select("id")


def manual_review_accepted(automation: Column, notes: Column, reviewed: Column, now: Column, least: int = 20) -> Column:
    """Whether an inspection by hand may be recorded: of a manual source, with notes, and not from the future."""
    return F.coalesce((automation == "manual") & (F.char_length(F.trim(notes)) >= least) & (reviewed.cast("timestamp") <= now.cast("timestamp")), F.lit(False))


def title_kind(title: Column, classification: Column) -> Column:
    """What a development is by its title, the first that fits; else a sighting of the radar, or a development."""
    low = F.lower(title)
    return F.coalesce(*(F.when(F.contains(low, F.lit(word)), F.lit(kind)) for word, kind in TITLE_KINDS), F.when(classification == "heuristic", "Radar").otherwise("Development"))


def point_class(status: Column, date: Column, kind: Column, now: Column) -> Column:
    """How a date of a record is drawn: new for thirty days, then by the record's state, an amendment before an active one."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(date.cast("timestamp"))
    return F.when(age.between(0, NEW_DAYS * 86_400_000_000), "new").when(status == "proposed", "proposed").when(kind == "amended", "amended").when(status == "active", "active").otherwise("other")


def bound_date(date: Column, precision: Column, metadata: Column, told: Column, kept: Column, by_metadata: Column) -> Column:
    """(by, date, precision, notes, error): what backs a record's date. The source's metadata where they may, else what a
    reviewer has told, else what an earlier review has kept; each must have the date and the precision.

    metadata and kept: date, precision; told: date, precision, notes. A reviewer's that differs, or without notes of
    ``NOTES_LENGTH``, is an error even where an earlier one would do.
    """
    fits = lambda e: F.coalesce((e["date"] == date) & (e["precision"] == precision), F.lit(False))
    notes = F.regexp_replace(told["notes"], r"^\s+|\s+$", "")
    short = F.coalesce(F.char_length(notes), F.lit(0)) < NOTES_LENGTH
    by = F.when(by_metadata & fits(metadata), "metadata").when(told.isNotNull(), F.when(fits(told) & ~short, "reviewer")).when(fits(kept), "earlier review")
    error = F.when(by.isNull(), F.when(told.isNull(), "no evidence").when(~fits(told), "reviewed date differs").otherwise("no notes"))
    there = by.isNotNull()
    return F.struct(by.alias("by"), F.when(there, date).alias("date"), F.when(there, precision).alias("precision"), F.when(by == "reviewer", notes).alias("notes"), error.alias("error"))
