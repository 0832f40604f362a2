"""What the editorial workflow writes to disk on its way, and that its short ways decide as the long ones do."""

from datetime import datetime

import pytest

from tests.conftest import DATA
from tests.test_store import RECORD, REQUEST, REVIEW
from tidemark import catalog
from tidemark.operators import publication
from tidemark.tables import cut, drop


@pytest.fixture
def shuffled(spark, monkeypatch):
    """Bytes that a query writes to shuffles where no table is small enough to be sent to all tasks."""
    store = spark._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def stages():
        found = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    def run(name):
        before = stages()
        catalog.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()
        return sum(n for stage, n in stages().items() if stage not in before)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield run
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


NAMES = ["workflow_reviews_published", "workflow_publications", "workflow_approvals", "workflow_records_published"]


@pytest.mark.parametrize("name", NAMES)
def test_shuffles_stay_small(spark, shuffled, name):
    """Bytes for each lineitem; 471 to 628 where every part of a query joined its lines anew."""
    assert shuffled(name) < 300 * spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def day(n):
    return datetime(2024, 1, n)


def told(made):
    return {r["request_id"]: (r["outcome"], r["own"]) for r in made.collect()}


def test_passing_requests_are_those_of_all(spark):
    records = spark.createDataFrame([(1, "https://a.example.com/x", '{"n":1}'), (2, "https://a.example.com/y", '{"n":2}')], RECORD)
    review = lambda i, status, url, target, made, seq=1: (i, status, url, "h", seq, day(1), target, None, None, 10, made, day(2), None, None)
    reviews = spark.createDataFrame(
        [review("older", "approved", "https://a.example.com/x", 1, '{"n":1}'), review("newest", "approved", "https://a.example.com/x", 1, '{"n":1}', 3), review("gone", "rejected", "https://a.example.com/x", 1, '{"n":1}', 9),
         review("unseen", "approved", "https://a.example.com/y", 2, '{"n":5}'), review("new", "approved", "https://b.example.com/", None, '{"n":7}'), review("again", "approved", "https://b.example.com/#x", None, '{"n":8}'),
         review("half", "approved", "https://a.example.com/y/", None, '{"n":2}'), review("none", None, "https://c.example.com/", None, '{"n":8}'), review("open", "pending_review", "https://d.example.com/", None, '{"n":8}')],
        REVIEW,
    )
    asked = [("p1", "older", 3), ("p2", "newest", 4), ("p3", "newest", 3), ("p4", "gone", 3), ("p5", "unseen", 3), ("p6", "new", 4), ("p7", "again", 3), ("p8", "half", 3), ("p9", "none", 3), ("p10", "open", 3), ("p11", "no", 3)]
    requests = spark.createDataFrame([(q, v, "h", day(n), "Ann", None) for q, v, n in asked], REQUEST)
    every = told(publication.publications(requests, reviews, records))
    assert every == {
        "p1": ("newer_version", True), "p2": ("late", True), "p3": ("applied", True), "p4": ("rejected", True), "p5": ("target_changed", False), "p6": ("source_taken", False),
        "p7": ("applied", False), "p8": ("applied", True), "p9": ("applied", False), "p10": ("not_approved", False), "p11": ("missing", False),
    }
    assert told(publication.publications(requests, reviews, records, passing=True)) == {q: made for q, made in every.items() if made[0] == "applied"}


def test_owners_of_an_update_s_address(spark):
    """At the target's own address, at one that it leaves for another record's or for a free one, and where it has none."""
    records = spark.createDataFrame([(1, "https://a.example.com/x", "{}"), (2, "https://a.example.com/y", "{}"), (3, "https://a.example.com/y/", "{}"), (4, None, "{}")], RECORD)
    cases = {
        "home": (1, "https://a.example.com/x#p", None, "applied"), "shared": (3, "https://a.example.com/y", None, "source_taken"), "first": (2, "https://a.example.com/y", None, "applied"),
        "taken": (1, "https://a.example.com/y", "https://a.example.com/x/", "source_taken"), "free": (1, "https://b.example.com/", "https://a.example.com/x", "applied"),
        "moved": (1, "https://b.example.com/", "https://c.example.com/", "target_moved"), "missing": (9, "https://a.example.com/x", None, "target_missing"), "blank": (4, "https://a.example.com/x", None, "source_taken"),
    }
    reviews = spark.createDataFrame([(i, "pending_review", url, "h", 1, day(1), target, was, None, None, "{}", None, None, None) for i, (target, url, was, _) in cases.items()], REVIEW)
    looked = {r["id"]: r["r"] for r in reviews.select("id", publication.review_revision().alias("r")).collect()}
    requests = spark.createDataFrame([(i, i, "h", day(2), "Ann", looked[i]) for i in cases], REQUEST)
    assert {i: made[0] for i, made in told(publication.approvals(requests, reviews, records)).items()} == {i: c[3] for i, c in cases.items()}


def test_dropped_table_is_gone(spark):
    import os

    held = cut(spark.range(3))
    assert held.count() == 3
    drop(held)
    assert not os.path.exists(held._written)
