"""JSON of any shape, patches and recovered state, against brute force."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import json_text
from tidemark.operators import folds, patches
from tidemark.streaming import recovery


def one(spark, text, function):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t"))).first()[0]


def closed(text):
    """The first balanced value, character by character."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    stack, quoted, skip = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if stack.pop() != c:
                return None
            if not stack:
                return text[start : i + 1]
    return None


def test_balanced_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice('{}[]"\\ab,\n') for _ in range(rng.randrange(14))) for _ in range(3000)] + ['x \\"[1, "\\\\"] }', "", '{"a": "' + "\\n" * 20000 + '"} ]']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", json_text.balanced(F.col("t")).alias("v")).collect()
    assert {r["i"]: r["v"] for r in got} == {i: closed(t) for i, t in enumerate(texts)}


def test_reply(spark):
    assert one(spark, ' {"a": 1} ', json_text.reply) == '{"a": 1}' and one(spark, "```JSON\n[1]\n```", json_text.reply) == "[1]"
    assert one(spark, 'So: {"a": [1, "}"]} and {', json_text.reply) == '{"a": [1, "}"]}' and one(spark, "nothing {", json_text.reply) is None


def test_stable_under_any_order(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        return [None, True, rng.randrange(99), f"é\"{rng.randrange(9)}"][kind] if kind < 4 else [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 4 else {k: value(depth - 1) for k in rng.sample("abcdXY", rng.randrange(5))}

    def mixed(v):
        if isinstance(v, dict):
            keys = list(v)
            rng.shuffle(keys)
            return {k: mixed(v[k]) for k in keys}
        return [mixed(x) for x in v] if isinstance(v, list) else v

    made = [{"r": value(4)} for _ in range(60)]
    rows = [(json.dumps(v), json.dumps(mixed(v), indent=1), json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)) for v in made]
    for r in spark.createDataFrame(rows, "a string, b string, s string").select(json_text.stable(F.col("a")).alias("a"), json_text.stable(F.col("b")).alias("b"), "s").collect():
        assert r["a"] == r["b"] == r["s"]
    assert one(spark, "{", json_text.stable) is None


def test_rewritten_keeps_every_other_byte(spark):
    text = '{"url":"https://A.example.org/x/?utm_a=1#t", "x" : [ {"website" :\n"http://b.example.org:80"}, "url", {"url": ["http://c/#d"]}], "surl":"http://d/#e", "n":1.0e5,"t":", \\"url\\":\\"http://f/#g\\"", "finalUrl":"http:\\/\\/h.example.org\\/i\\/"}'
    want = text.replace("https://A.example.org/x/?utm_a=1#t", "https://a.example.org/x").replace("http://b.example.org:80", "http://b.example.org/").replace("http:\\/\\/h.example.org\\/i\\/", "http://h.example.org/i")
    assert one(spark, text, json_text.rewritten) == want and json.loads(want)
    for same in ("[]", '{"url":"https://a.example.org/x"}', '{"url":null}', "no json", ""):
        assert one(spark, same, json_text.rewritten) == same


def test_colliding_keys_are_refused(spark):
    rows = spark.createDataFrame([("https://a.example.org/x/", 1), ("https://a.example.org/x", 2), ("b", 3)], "key string, n int")
    from tidemark.functions.urls import canonical

    got = {(r["key"], r["n"], r["collides"]) for r in json_text.rekeyed(rows, "key", canonical(F.col("key"))).collect()}
    assert got == {("https://a.example.org/x", 1, True), ("https://a.example.org/x", 2, True), ("b", 3, False)}


@pytest.mark.parametrize("seed", range(2))
def test_running_max(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab") if rng.random() < 0.2 else "hot", i, rng.randrange(50)) for i in rng.sample(range(10**6), 300)]
    got = {r["o"]: r["m"] for r in folds.running_max(spark.createDataFrame(rows, "k string, o long, v int"), ["k"], "o", "v", "m", 7).collect()}
    assert got == {o: max((w for j, p, w in rows if j == k and p < o), default=None) for k, o, _ in rows}


def test_patches_against_one_after_the_other(spark):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    fields = ("status", "title")
    records = [{"id": i, "status": rng.choice(["active", "trashed"]), "title": "t", "kept": i, "updated_at": start, "trashed_at": None} for i in range(20)]
    for r in records:
        r["trashed_at"] = start if r["status"] == "trashed" else None
    given = []
    for o in range(150):
        at = start + timedelta(days=o)
        given.append((rng.randrange(22), o, at, rng.choice(["active", "trashed", "trashed"]), rng.choice(["x", None]), rng.randrange(4)))
    after = {r["id"]: dict(r) for r in records}
    for i, _, at, status, title, present in given:
        if i not in after:
            continue
        r = after[i]
        if present & 1:
            if status == "trashed" and r["status"] != "trashed":
                r["trashed_at"] = at
            if status != "trashed":
                r["trashed_at"] = None
            r["status"] = status
        if present & 2:
            r["title"] = title
        r["updated_at"] = at
    df = spark.createDataFrame([tuple(r.values()) for r in records], "id int, status string, title string, kept int, updated_at timestamp_ntz, trashed_at timestamp_ntz")
    asked = spark.createDataFrame(given, "id int, ord int, at timestamp_ntz, status string, title string, present long")
    got, lost = patches.applied(df, asked, fields)
    assert {r["id"]: r.asDict() for r in got.collect()} == after
    assert {r["id"] for r in lost.collect()} <= {20, 21} and lost.count() == sum(g[0] > 19 for g in given)


def test_recovery_twice_is_recovery_once(spark):
    day = lambda n: datetime(2024, 1, n)
    h = {c: c * 64 for c in "abc"}
    review = "ord long, status string, url string, hash string, sequence int, linked_source string, discovered timestamp_ntz, retrieved timestamp_ntz, reviewed timestamp_ntz, published timestamp_ntz, updated timestamp_ntz"
    sources = spark.createDataFrame([("s", "https://a.example.org/x/", 1)], "source_id string, url string, ord int")
    url = "https://a.example.org/x"
    rows = [
        (0, "approved", url, h["b"], 2, None, day(1), day(2), day(3), None, day(4)),
        (1, "published", url, h["a"], 1, "s", day(1), day(9), day(3), day(5), day(4)),  # older: the snapshot stays
        (2, "approved", url, h["c"], 2, "s", day(1), day(8), day(3), None, day(4)),  # the same number with other content
        (3, "pending_review", url, h["a"], 1, "s", day(6), None, None, None, day(6)),  # a processed version is asked about again
        (4, "rejected", "https://unknown.example.org/", h["a"], 1, None, day(6), None, None, None, day(6)),
        (5, "published", url, "no hash", 9, "s", day(6), None, None, None, day(6)),
    ]
    none = recovery.State(
        spark.createDataFrame([], "key string, source_id string, status string, first_seen timestamp_ntz, processed_at timestamp_ntz, error string"),
        spark.createDataFrame([], "source_id string, hash string, sequence int, first_checked timestamp_ntz, last_checked timestamp_ntz, last_changed timestamp_ntz"),
        spark.createDataFrame([], "source_id string, checked timestamp_ntz"),
    )
    held = spark.createDataFrame(rows, review)
    once = recovery.recovered(none, held, sources)
    twice = recovery.recovered(once, held, sources)
    want = {f"{url}#change={h['b']}:2": "approved", f"{url}#change={h['a']}:1": "awaiting_review", f"{url}#change={h['c']}:2": "approved"}
    for state in (once, twice):
        assert {r["key"]: r["status"] for r in state.seen.collect()} == want
        assert [tuple(r) for r in state.snapshots.collect()] == [("s", h["b"], 2, day(2), day(2), day(3))]
        assert [tuple(r) for r in state.checks.collect()] == [("s", day(2))]


def test_rejections_need_no_records(spark):
    from tidemark.operators import publication

    reviews = spark.createDataFrame([("a", "pending_review", None, 1), ("b", "pending_review", 7, 1), ("c", "rejected", None, 1)], "id string, status string, target_id long, discovered long")
    asked = [("1", "a", 3), ("2", "a", 2), ("3", "b", 2), ("4", "c", 2), ("5", "d", 2), ("6", "a", 0)]
    requests = spark.createDataFrame(asked, "request_id string, review_id string, at long")
    made = publication.rejections(requests, reviews, None)
    assert {r.request_id: r.outcome for r in made.collect()} == {"1": "late", "2": "applied", "3": "tracked", "4": "rejected", "5": "missing", "6": "before_discovery"}


def test_withheld_events_by_name_and_by_revision(spark):
    from tidemark.operators import views

    events = spark.createDataFrame([(i, f"https://www.example.org/e/{i}", f"h{i}") for i in range(8)], "id long, url string, revision string")
    u = "https://www.example.org/e/"
    rows = [(0, u + "0/?utm_source=x", "pending_review", None, None, None), (1, u + "x", "approved", None, None, None), (None, u + "2", "approved", 2, "h2", None), (None, u + "3", "pending_review", 3, "h3", None),
            (None, u + "4", "pending_review", 4, None, "h4"), (None, u + "5", "approved", 5, "old", "old"), (6, u + "6", "rejected", None, None, None), (None, u + "7", "approved", None, "h7", "h7")]
    reviews = spark.createDataFrame(rows, "event_id long, url string, status string, draft_id long, draft_hash string, event_hash string")
    assert {r.id for r in views.withheld_events(reviews, events).collect()} == {0, 2, 4}
