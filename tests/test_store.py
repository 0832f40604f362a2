"""Tables that change together: pinned reads, two writers, writers that die, exports."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.json_text import revision
from tidemark.operators import publication
from tidemark.sources.store import Stale, Store, export, stored


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def broken(spark):
    return numbers(spark, 1).select(F.raise_error(F.lit("the writer dies")).cast("long").alias("x"))


def test_pinned_tables_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.version() == 0 and store.pin().tables == {}
    assert store.commit(0, {"a": numbers(spark, 1), "b": numbers(spark, 2)}) == 1
    held = store.pin()
    assert store.commit(1, {"a": numbers(spark, 3)}) == 2
    assert rows(held.read("a")) == [(1,)] and rows(store.pin().read("a")) == [(3,)] and rows(store.pin().read("b")) == [(2,)]
    assert rows(store.pin(1).read("a")) == [(1,)]
    with pytest.raises(Stale):
        store.commit(1, {"a": numbers(spark, 9)})


def test_second_of_two_writers_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit(0, {"a": numbers(spark, 1)})
    rival = Store(spark, str(tmp_path))
    seen = store.version()
    first = store._put

    def put(version, manifest):  # the rival ends between the check and the rename
        rival.commit(seen, {"a": numbers(spark, 2)})
        return first(version, manifest)

    store._put = put
    with pytest.raises(Stale):
        store.commit(seen, {"a": numbers(spark, 3)})
    assert rows(Store(spark, str(tmp_path)).pin().read("a")) == [(2,)]


@pytest.mark.parametrize("at", [0, 1])
def test_writer_that_dies_changes_nothing(spark, tmp_path, at):
    store = Store(spark, str(tmp_path))
    store.commit(0, {"a": numbers(spark, 1), "b": numbers(spark, 1)})
    tables = {"a": numbers(spark, 2), "b": numbers(spark, 2)}
    with pytest.raises(Exception, match="dies"):
        store.commit(1, {**tables, "ab"[at]: broken(spark)})
    assert store.version() == 1 and rows(store.pin().read("a")) == rows(store.pin().read("b")) == [(1,)]
    assert store.commit(1, tables) == 2 and rows(store.pin().read("b")) == [(2,)]


def test_export_is_whole_or_old(spark, tmp_path):
    store, public = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "p"), "json")
    store.commit(0, {"a": numbers(spark, 1, 2)})
    views = {"all": lambda s: s.read("a"), "few": lambda s: s.read("a").where("x > 1")}
    assert export(store.pin(), views, public) == 1 and export(store.pin(), views, public) == 1
    assert rows(public.pin().read("all")) == [(1,), (2,)] and rows(public.pin().read("few")) == [(2,)]
    store.commit(1, {"a": numbers(spark, 5)})
    with pytest.raises(Exception, match="dies"):
        export(store.pin(), {"all": views["all"], "few": lambda s: broken(spark)}, public)
    assert rows(public.pin().read("all")) == [(1,), (2,)]
    assert export(store.pin(), views, public) == 2 and rows(public.pin().read("few")) == [(5,)]


def test_batches_are_stored_exactly_once(spark, tmp_path):
    store, dies = Store(spark, str(tmp_path)), [True]

    def step(held, batch):
        rows = held.read("sums").unionByName(batch) if held.tables else batch
        total = rows.agg(F.sum("x").cast("long").alias("x"))
        return {"sums": total, "last": broken(spark) if dies and batch.first()["x"] == 20 else batch}

    write = stored(store, step)
    write(numbers(spark, 10), 0)
    with pytest.raises(Exception, match="dies"):
        write(numbers(spark, 20), 1)  # sums is written, last isn't
    assert rows(store.pin().read("sums")) == [(10,)]
    dies.clear()
    for batch_id, x in ((1, 20), (1, 20), (0, 10), (2, 30)):
        write(numbers(spark, x), batch_id)
    assert rows(store.pin().read("sums")) == [(60,)] and rows(store.pin().read("last")) == [(30,)]


RECORD = "id long, url string, content string"
REVIEW = "id string, status string, url string, hash string, sequence int, discovered timestamp_ntz, target_id long, previous_url string, target_revision string, proposed_id long, proposed string, reviewed timestamp_ntz, published timestamp_ntz, reason string"
REQUEST = "request_id string, review_id string, live_hash string, at timestamp_ntz, by string, expected string"


@pytest.fixture
def desk(spark, tmp_path):
    """One record with an update under review, and a new source."""
    from datetime import datetime

    day = lambda n: datetime(2024, 1, n)
    store = Store(spark, str(tmp_path))
    records = spark.createDataFrame([(1, "https://a.example.com/x", '{"n":1}')], RECORD)
    reviews = [
        ("u1", "pending_review", "https://a.example.com/x/", "h1", 1, day(1), 1, None, None, None, '{"n":2}', None, None, None),
        ("u2", "pending_review", "https://a.example.com/x", "h2", 2, day(2), 1, None, None, None, '{"n":3}', None, None, None),
        ("n1", "pending_review", "https://b.example.com/", "h3", None, day(2), None, None, None, 7, '{"n":9}', None, None, None),
    ]
    store.commit(0, {"records": records, "reviews": spark.createDataFrame(reviews, REVIEW)})
    return store, day


def ask(spark, store, *wanted):
    """Requests that name the revision they have seen."""
    seen = {r["id"]: r["r"] for r in store.pin().read("reviews").select("id", publication.review_revision().alias("r")).collect()}
    return spark.createDataFrame([(q, v, h, at, "Ann", seen.get(v)) for q, v, h, at in wanted], REQUEST)


def approve(store, requests):
    now = store.pin()
    made = publication.approvals(requests, now.read("reviews"), now.read("records"))
    store.commit(now.version, {"reviews": publication.approved(made, now.read("reviews"))})
    return {r["request_id"]: r["outcome"] for r in made.collect()}


def publish(store, requests, tables=("reviews", "records")):
    now = store.pin()
    made = publication.publications(requests, now.read("reviews"), now.read("records"))
    both = dict(zip(("reviews", "records"), publication.published(made, now.read("reviews"), now.read("records"))))
    store.commit(now.version, {name: both[name] for name in tables})
    return {r["request_id"]: r["outcome"] for r in made.collect()}


def test_two_approvals_have_one_end(spark, desk):
    store, day = desk
    both = ask(spark, store, ("q2", "u2", "h2", day(5)), ("q1", "u2", "h2", day(4)), ("q3", "n1", "h3", day(4)), ("q4", "u1", "other", day(4)), ("q5", "no", "h", day(4)))
    assert approve(store, both) == {"q1": "applied", "q2": "late", "q3": "applied", "q4": "source_changed", "q5": "missing"}
    # the same requests again have seen another revision
    assert approve(store, both) == {"q1": "changed", "q2": "changed", "q3": "changed", "q4": "source_changed", "q5": "missing"}
    assert rows(store.pin().read("reviews").where("status = 'approved'").select("id", "reviewed")) == [("n1", day(4)), ("u2", day(4))]


@pytest.mark.parametrize("written", [(), ("records",), ("reviews",), ("records", "reviews")])
def test_publication_that_dies_ends_alike(spark, desk, written):
    """A writer without a manifest of its own that has written some of its tables, and then begins again."""
    store, day = desk
    approve(store, ask(spark, store, ("q1", "u2", "h2", day(4)), ("q2", "n1", "h3", day(4)), ("q3", "u1", "h1", day(4))))
    again = ask(spark, store, ("p1", "u2", "h2", day(6)), ("p2", "n1", "h3", day(6)), ("p3", "u1", "h1", day(6)))
    if written:
        publish(store, again, written)
    told = publish(store, again)
    assert set(told.values()) <= {"applied", "published", "newer_version", "rejected"}
    now = store.pin()
    if written != ("reviews",):  # reviews first is the order that loses the records: the store's one manifest is there to prevent it
        assert rows(now.read("records")) == [(1, "https://a.example.com/x", '{"n":3}'), (7, "https://b.example.com/", '{"n":9}')]
    assert rows(now.read("reviews").select("id", "status")) == [("n1", "published"), ("u1", "rejected"), ("u2", "published")]


def test_changed_target_is_not_overwritten(spark, desk):
    store, day = desk
    approve(store, ask(spark, store, ("q1", "u2", "h2", day(4))))
    now = store.pin()
    store.commit(now.version, {"records": now.read("records").withColumn("content", F.lit('{"n":77}'))})
    assert publish(store, ask(spark, store, ("p1", "u2", "h2", day(6)))) == {"p1": "target_changed"}
    assert publish(store, ask(spark, store, ("p1", "u2", "h2", day(3)))) == {"p1": "before_approval"}
    assert store.pin().read("records").select(revision(F.col("content"))).first()[0] == spark.sql("SELECT sha2('{\"n\":77}', 256)").first()[0]
