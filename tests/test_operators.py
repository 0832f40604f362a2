import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import changes, graph, quality, ranking, relevance, visibility, workflow
from tidemark.sources import html, records
from tidemark.streaming import state


def test_currency_bounds(spark):
    now = datetime(2026, 7, 16, 12)
    cases = [("2026-04-17 12:00:00", True), ("2026-04-17 11:59:59", False), ("2026-07-16 12:05:00", True), ("2026-07-16 12:05:01", False)]
    rows = spark.createDataFrame([("verified", "manual", "A", datetime.fromisoformat(at), "A" * 64, want) for at, want in cases], "s string, m string, b string, at timestamp_ntz, h string, want boolean")
    made = rows.withColumn("got", visibility.is_current(*(F.col(c) for c in ("s", "m", "b", "at", "h")), F.lit(now).cast("timestamp_ntz")))
    assert made.where("got <> want").count() == 0


def test_stale_reason_is_added_once(spark):
    rows = spark.createDataFrame([("verified", "manual", "A", "a" * 64, "x")], "s string, m string, b string, h string, n string")
    shown = visibility.stale_projection(F.col("s"), F.col("m"), F.col("b"), F.col("h"), F.col("n"), F.lit(False))
    again = rows.withColumn("n", shown["notes"])
    first = again.first().n
    assert first == "x " + visibility.REASONS["expired"]
    assert again.select(visibility.stale_projection(F.col("s"), F.col("m"), F.col("b"), F.col("h"), F.col("n"), F.lit(False))["notes"]).first()[0] == first


def test_thematic_edges_with_repeated_tags(spark):
    nodes = spark.createDataFrame([(1, 1, "a", ["X", "x", "y"]), (2, 2, "a", ["x"]), (3, 3, "b", ["X ", "Y", "z"]), (4, 4, "b", ["y", "x", "Z"])], "id long, ord long, jurisdiction string, tags array<string>")
    got = {tuple(r) for r in graph.thematic_edges(nodes).collect()}
    want = set()
    rows = [r.asDict() for r in nodes.collect()]
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            fold = {t.strip().lower() for t in b["tags"]}
            w = sum(t.strip().lower() in fold for t in a["tags"])
            cross = a["jurisdiction"] != b["jurisdiction"]
            if w >= (3 if cross else 2):
                want.add((a["id"], b["id"], w, cross))
    assert got == want and want


def test_edges_by_classes_equal_brute_force(spark):
    import random

    r = random.Random(7)
    rows = [(i, (i * 37) % 101, r.choice(["a", "b", None]), [r.choice(["X", "x ", "y", "z", "Z", "w", None]) for _ in range(r.randint(1, 4))]) for i in range(100)]
    rows += [(200 + i, 200 + i, "a", ["x", "y"]) for i in range(20)]
    nodes = spark.createDataFrame(rows, "id long, ord long, jurisdiction string, tags array<string>").withColumn("superseded_by", F.when(F.col("id") == 5, 6))
    want, fold = set(), lambda tags: [t.strip().lower() for t in tags if t is not None]
    for a in rows:
        for b in rows:
            w = sum(t in fold(b[3]) for t in fold(a[3]))
            cross = None if a[2] is None or b[2] is None else a[2] != b[2]
            if a[1] < b[1] and w >= (3 if cross else 2):
                want.add((a[0], b[0], w, cross))
    for most in (3, 1000):
        got = [tuple(x) for x in graph.thematic_edges(nodes, most=most).collect()]
        assert set(got) == want and len(got) == len(want)
    for node in (0, 7, 205, 999):
        assert {tuple(x) for x in graph.thematic_edges_at(nodes, F.lit(node)).collect()} == {e for e in want if node in e[:2]}
    for x in graph.degrees(nodes).collect():
        at = [e for e in want if x.id in e[:2]]
        assert (x.thematic, x.crossing, x.formal, x.replaced) == (len(at), sum(e[3] is True for e in at), int(x.id in (5, 6)), int(x.id == 5))
    shown = graph.summary(nodes).first()
    assert (shown.records, shown.cross_links, shown.formal_links) == (len(rows), sum(e[3] is True for e in want), 1)


def test_degrees_of_many_alike_nodes(spark):
    nodes = spark.range(40_000).select("id", F.col("id").alias("ord"), F.lit("a").alias("jurisdiction"), F.array(F.lit("x"), F.lit("y")).alias("tags"), F.lit(None).cast("long").alias("superseded_by"))
    held = graph.degrees(nodes).agg(F.min("thematic").alias("least"), F.sum("thematic").alias("all")).first()  # 800 million edges
    assert (held.least, held["all"]) == (39_999, 40_000 * 39_999)


def test_rows_without_a_key_are_dealt_over_tasks(spark):
    from tidemark.operators import folds

    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    found = spark.range(0, 4000, 20).select(F.col("id").alias("k"), F.lit("yes").alias("there")).unionByName(spark.createDataFrame([(None, "never")], "k long, there string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = folds.matched(rows, found, "k")
        assert {(r.id, r.k, r.there) for r in made.collect()} == {(i, i if i % 10 == 0 else None, "yes" if i % 20 == 0 else None) for i in range(4000)}
        assert made.where("k IS NULL").select(F.spark_partition_id()).distinct().count() == 4
        masked = visibility.mask_reference(rows, "k", found, "k")
        assert masked.count() == 4000 and masked.where("k IS NOT NULL").count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_unique_themes(spark):
    row = spark.createDataFrame([(["A", " a", "b", "B"],)], "t array<string>")
    assert row.select(graph.unique_themes(F.col("t"))).first()[0] == ["A", "b"]


def test_select_for_run(spark):
    def run(p, f, most):
        pending = spark.createDataFrame([("s", f"p{i}", i + 1) for i in range(p)], "source_id string, key string, place int")
        fresh = spark.createDataFrame([("s", f"f{i}", i + 1) for i in range(f)], "source_id string, key string, place int")
        return [r.key for r in ranking.select_for_run(pending, fresh, most).orderBy("slot").collect()]

    assert run(3, 9, 5) == ["f0", "f1", "f2", "f3", "p0"]
    assert run(3, 1, 5) == ["f0", "p0", "p1", "p2"]
    assert run(0, 9, 5) == ["f0", "f1", "f2", "f3", "f4"]
    assert run(9, 0, 5) == ["p0", "p1", "p2", "p3", "p4"]
    assert run(1, 1, 0) == []


def test_upsert_keeps_place_and_last_wins(spark):
    current = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "id string, v int, _ord int")
    updates = spark.createDataFrame([("b", 5, 0), ("c", 6, 1), ("b", 7, 2)], "id string, v int, _ord int")
    got = [(r.id, r.v) for r in ranking.upsert(current, updates, "id").orderBy("_ord").collect()]
    assert got == [("a", 1), ("b", 7), ("c", 6)]


def test_run_health(spark):
    schema = "status string, eligible boolean, critical boolean"
    health = lambda rows: changes.run_health(spark.createDataFrame(rows, schema)).first()
    assert health([("skipped", True, False)]).rate == 1.0
    assert health([("success", True, False)] * 9 + [("error", True, False)]).health == "degraded"
    assert health([("success", True, False)] * 9 + [("error", True, True)]).health == "failed"
    assert health([("success", True, False), ("error", False, False)]).health == "degraded"


def test_fixed_windows_open_at_the_first_call(spark):
    calls = spark.createDataFrame([("k", i, datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate((0, 1, 2, 10, 11, 12))], "k string, i long, t timestamp_ntz")
    got = [r.allowed for r in changes.fixed_windows(calls, "k", "t", "i", 2, 10.0).orderBy("i").collect()]
    assert got == [True, True, False, False, True, True]


def test_quality_report(spark):
    rows = spark.createDataFrame([(1, "x", 2), (2, "x", 9), (3, None, None)], "id long, u string, r long")
    report = quality.merged(
        quality.broken(rows, "t", "id", {"no url": F.col("u").isNull()}),
        quality.duplicates(rows, "t", "id", F.col("u"), "id", "repeats"),
        quality.dangling(rows, "t", "id", "r", rows, "id", "no target", "warning"),
    )
    assert {(r.key, r.rule, r.severity) for r in report.collect()} == {("3", "no url", "error"), ("2", "repeats", "error"), ("2", "no target", "warning")}


def test_relevance(spark):
    rows = spark.createDataFrame([("AI policy", "https://e.au/x", ""), ("Privacy policy", "https://e.au/privacy", ""), ("Aim high", "https://e.au/policy", ""), ("AI", "https://e.au/a.pdf", "")], "t string, u string, x string")
    got = [tuple(r) for r in rows.select(*relevance.scored(F.col("t"), F.col("u"), F.col("x"))).collect()]
    assert got == [(True, 0.65), (False, 0.0), (False, 0.0), (True, 0.55)]


def test_workflow_guards(spark):
    current = spark.createDataFrame([("a", "https://e.com/a", "active", None, "r1", 0)], "id string, url string, status string, trashed_at string, revision string, _ord int")
    new = spark.createDataFrame([("b", "https://e.com/b", "active", None, "r1", 0)], current.schema)
    assert [r.id for r in workflow.created(current, new).orderBy("_ord").collect()] == ["b", "a"]
    clash = spark.createDataFrame([("c", "https://e.com/a/?utm_a=1#x", "active", None, "r1", 0)], current.schema)
    with pytest.raises(workflow.Conflict):
        workflow.created(current, clash)
    with pytest.raises(workflow.Conflict):
        workflow.updated(current, "id", "a", {"status": F.lit("x")}, F.lit("now"), F.lit("r2"), "revision")
    gone = workflow.updated(current, "id", "a", {"status": F.lit("trashed")}, F.lit("now"), F.lit("r1"), "revision")
    assert gone.first().trashed_at == "now"
    left, was = workflow.deleted(current, "id", "a")
    assert was and left.count() == 0


def test_merged_reviews_keep_first_discovery(spark):
    schema = "id string, sequence int, hash string, discovered string, _ord int"
    old = spark.createDataFrame([("a", 1, "h", "2020", 0), ("b", 1, "h", "2020", 1)], schema)
    new = spark.createDataFrame([("b", 1, "h", "2021", 0), ("c", 1, "h", "2021", 1)], schema)
    got = {r.id: r.discovered for r in workflow.merged_reviews(old, new).collect()}
    assert got == {"a": "2020", "b": "2020", "c": "2021"}


def test_json_arrays(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    path = str(tmp_path / "rows.json")
    assert records.read_array(spark, path, schema).count() == 0
    (tmp_path / "rows.json").write_text(json.dumps([{"id": "b", "n": 1}, {"id": "a", "n": 2}]))
    rows = records.read_array(spark, path, schema)
    assert [(r.id, r._ord) for r in rows.orderBy("_ord").collect()] == [("b", 0), ("a", 1)]
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        records.read_array(spark, str(tmp_path / "bad.json"), schema).collect()
    out = str(tmp_path / "out")
    records.write_array(rows, out)
    records.write_array(rows.where("n = 1"), out)
    assert spark.read.json(out).count() == 1


def test_posts(spark, tmp_path):
    (tmp_path / "one.mdx").write_text("---\ntitle: One\ndate: 2024-01-02\n---\nBody")
    (tmp_path / "two.mdx").write_text("---\ntitle: Two\ndate: never\n---\nBody")
    got = records.read_posts(spark, str(tmp_path)).collect()
    assert [(r.slug, r.title, r.body) for r in got] == [("one", "One", "Body")]


def test_order_over_partitions(spark):
    rows = records.with_order(spark.range(100).repartition(7), F.col("id").desc())
    assert [r.id for r in rows.orderBy("_ord").collect()] == list(range(99, -1, -1))
    assert rows.agg(F.max("_ord")).first()[0] == 99


def test_docx_and_fetch(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>A &amp; B</w:t></w:p><w:p><w:t>C</w:t></w:p>")
    rows = spark.createDataFrame([(bytearray(held.getvalue()),), (bytearray(b"no"),), (None,)], "c binary")
    assert [tuple(r[0]) for r in rows.select(html.docx_text(F.col("c"))).collect()] == [("A & B\nC", None), (None, "not a Word file"), (None, "not a Word file")]

    def fetch(url):
        if "bad" in url:
            raise OSError("down")
        return {"status": 404 if "none" in url else 200, "body": "x"}

    got = html.retrieve(spark.createDataFrame([("https://a",), ("https://bad",), ("https://none",)], "url string"), fetch)
    assert {r.url: (r.ok, r.status) for r in got.collect()} == {"https://a": (True, 200), "https://bad": (False, None), "https://none": (False, 404)}


def test_stream_equals_batch_and_once(spark, tmp_path):
    from tests.conftest import DATA
    from tidemark.plans.base import Tables
    from tidemark.plans.feeds import log

    events = log(Tables(spark, DATA)).select("source", "ts", "event_id", "hash").withColumn("source", F.col("source").cast("string")).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    events.where("event_id < 500").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        q = state.seen_versions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    events.where("event_id >= 500").coalesce(1).write.mode("append").parquet(folder)
    run()
    run()  # nothing new
    got = {r.event_id: (r.change, r.sequence) for r in spark.read.parquet(out).collect()}
    batch = {r.event_id: (r.change, r.sequence) for r in changes.versions(events, "source", "hash", "ts", "event_id").collect()}
    assert got == batch
    wrote = []
    sink = state.once(lambda b: wrote.append(b.count()), lambda i: i == 1)
    sink(events, 0)
    sink(events, 1)
    assert len(wrote) == 1


def test_collection_run(spark):
    from tidemark.streaming import collector

    at = datetime(2024, 5, 1)
    found = spark.createDataFrame(
        [("s", "https://a.example.org/1/", "A notice about the rules", None, at), ("s", "https://a.example.org/1#x", "A notice again", None, datetime(2024, 5, 2)), ("s", "https://a.example.org/2", "Tracked already", None, at),
         ("s", "https://a.example.org/2", "Tracked, but changed", "h2", at), ("t", "https://b.example.org/9", "A notice about the rules", None, at), ("t", "https://b.example.org/8", "Weak words only here", None, at)],
        "source_id string, url string, title string, hash string, found timestamp_ntz",
    )
    old = spark.createDataFrame([("https://b.example.org/7", "t", "https://b.example.org/7", "Failing for the last time", None, "pending", 4, at, at, "timeout"), ("https://b.example.org/6", "t", "https://b.example.org/6", "Done", None, "processed", 1, at, at, None)], collector.STATE)
    tracked = spark.createDataFrame([("https://a.example.org/2?utm_source=x",)], "url string")
    told = spark.createDataFrame(
        [("https://a.example.org/1", None, 0.9, None, None), ("https://a.example.org/2#change=h2", "h1", 0.9, None, None), ("https://b.example.org/9", None, 0.8, None, None), ("https://b.example.org/8", None, 0.2, None, None), ("https://b.example.org/7", None, None, "timeout", None)],
        "key string, hash string, score double, error string, fatal boolean",
    )
    run = collector.collect(found, old, tracked, told, F.lit("2024-05-03 00:00:00").cast("timestamp_ntz"), cut=lambda rows: rows.cache())
    states = {r.key: (r.status, r.attempts) for r in run.state.collect()}
    assert states == {
        "https://a.example.org/1": ("processed", 1),
        "https://a.example.org/2#change=h2": ("pending", 1),  # the verdict is on another version
        "https://b.example.org/9": ("dismissed", 1),  # the headline is taken in this month
        "https://b.example.org/8": ("dismissed", 1),
        "https://b.example.org/7": ("failed", 5),
        "https://b.example.org/6": ("processed", 1),
    }
    assert [(r.source_id, r.score) for r in run.developments.collect()] == [("s", 0.9)] and run.developments.first().id.startswith("dev-a-notice-about-the-rules-")
    assert [r.development_id for r in run.reviews.collect()] == [run.developments.first().id]
    assert {r.source_id: (r.selected, r.errors, r.accepted) for r in run.health.collect()} == {"s": (2, 0, 1), "t": (3, 1, 0)}


def test_collector_batches_are_written_once(spark, tmp_path):
    from tidemark.streaming import collector

    tracked, told = spark.createDataFrame([], "url string"), spark.createDataFrame([("https://a.example.org/1", None, 0.9, None, None)], "key string, hash string, score double, error string, fatal boolean")
    batch = spark.createDataFrame([("s", "https://a.example.org/1", "A notice about the rules", None, datetime(2024, 5, 1))], "source_id string, url string, title string, hash string, found timestamp_ntz")
    write = collector.sink(collector.state_before(spark, str(tmp_path)), lambda rows, state, cut: collector.collect(rows, state, tracked, told, F.lit("2024-05-03 00:00:00").cast("timestamp_ntz"), cut=cut), str(tmp_path))
    for _ in range(2):
        write(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/developments").count() == 1 and spark.read.parquet(f"{tmp_path}/state").count() == 1
    for _ in range(2):  # the next one finds the state of the first, and a second try of it doesn't find its own
        write(batch.unionByName(batch.withColumns({"url": F.lit("https://a.example.org/2"), "title": F.lit("Another notice about it")})), 1)
    assert spark.read.parquet(f"{tmp_path}/developments").count() == 1
    assert {r.key: r.attempts for r in spark.read.parquet(f"{tmp_path}/state/batch=1").collect()} == {"https://a.example.org/1": 1, "https://a.example.org/2": 1}


def test_changed_review(spark):
    from tidemark.streaming import collector

    versions = spark.createDataFrame([("s", "https://a.example.org/1/", "h2", "changed", 2, False, 5), ("s", "https://a.example.org/1", "h1", "changed", 3, True, 6), ("s", "https://a.example.org/1", "h1", "unchanged", 3, False, 7)], "source_id string, url string, hash string, change string, sequence long, reverted boolean, at long")
    targets = spark.createDataFrame([("p1", "https://a.example.org/1", "The rules")], "id string, url string, title string")
    got = {r.id: r.summary for r in collector.changed_review(versions, targets).collect()}
    assert got == {"source-review-p1-2": "The rules changed at its source.", "source-review-p1-3": "The rules went back to an earlier text."}


def test_helpers(spark, tmp_path):
    from pyspark.sql import types as T

    from tidemark.functions import dates, hashing, text, urls
    from tidemark.operators import ranking, relevance, workflow
    from tidemark.sources import html, records

    one = lambda *columns: tuple(spark.range(1).select(*columns).first())
    lit = F.lit
    assert one(urls.landed_on_home(lit("https://a.org/x"), lit("https://a.org/")), urls.landed_on_home(lit("https://a.org/"), lit("https://a.org/"))) == (True, False)
    assert one(hashing.state_key(lit("u"), lit("h:2")), hashing.state_key(lit("u"), lit(None).cast("string"))) == ("u#change=h:2", "u")
    linked = F.array(F.struct(lit("b").alias("url"), lit("2").alias("hash")), F.struct(lit("a").alias("url"), lit("1").alias("hash")))
    assert one(hashing.composite(lit("p"), linked)) == one(F.sha2(lit("p|a=1|b=2"), 256))
    assert one(text.balanced_excerpt(F.array(lit("x" * 30), lit("yy")), 20)) == ("x" * 10 + "\n\nyy",)
    assert one(text.requirements(lit("- " + "Agencies must publish a statement about it.\n\nshort")))[0] == ["Agencies must publish a statement about it."]
    assert one(text.xml_plain(lit("a &lt;b&gt; &amp;amp; c"))) == ("a <b> &amp; c",)
    assert one(dates.is_timestamp(lit("2024-05-01T00:00:00Z")), dates.is_timestamp(lit("2024-02-30T00:00:00Z"))) == (True, False)
    assert one(workflow.monotone(lit(3), lit(None)), workflow.monotone(lit(3), lit(2))) == (3, 3)
    assert one(html.json_array(lit('Sure: [{"id": 1}] done'), "id int")) == ([(1,)],) and one(html.json_array(lit("none"), "id int")) == (None,)
    assert one(relevance.is_strong(lit("Policy on artificial intelligence"), lit("https://a.org/p")), relevance.wanted(lit(0.4), lit(True), lit("AI policy"), lit("https://a.org/p"), lit(""), False))[1] is False
    log = spark.createDataFrame([(i,) for i in range(9)], "n int")
    assert [r.n for r in ranking.keep_newest(log, 3, F.col("n").desc()).collect()] == [8, 7, 6]
    assert records.read_or_legacy(log.where("n > 99"), log).count() == 9 and records.read_or_legacy(log.where("n > 5"), log).count() == 3
    (tmp_path / "doc.json").write_text('{"a": 1}')
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert tuple(records.read_document(spark, str(tmp_path / "doc.json"), schema, {"b": F.lit("x")}).first()) == (1, "x")
    (tmp_path / "f").mkdir()
    for name, data in (("a.pdf", b"%PDF-1.7"), ("c.pdf", b"%PDF" + b"x" * 99)):
        (tmp_path / "f" / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.error) for r in records.read_captured(spark, str(tmp_path / "f"), most=50).collect()}
    assert got == {"a.pdf": ("pdf", None), "c.pdf": (None, "too large")}
    reviews = spark.createDataFrame([(1, "h", "h", datetime(2024, 5, 1), False), (2, "h", "g", datetime(2024, 5, 1), False), (3, "h", "h", datetime(2024, 4, 1), False), (4, "h", "h", datetime(2024, 5, 1), True)], "id int, live string, approved string, checked timestamp_ntz, superseded boolean")
    assert [r.id for r in workflow.publishable(reviews, F.lit("2024-05-01 12:00:00").cast("timestamp_ntz"), "live", "approved", "checked").collect()] == [1]
    title = spark.createDataFrame([("Guide SOUTHWEST",), ("Guide_east",), ("North",), ("Plan (Opens in new tab) DOCX 12 KB",), ("Northern rules",)], "t string").select(text.link_title(F.col("t")).alias("t"))
    assert [r.t for r in title.collect()] == ["Guide", "Guide", "", "Plan", "Northern rules"]


def test_rules_are_tried_once(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "b"), (3, None)], "id long, t string")
    made = quality.broken(rows, "t", "id", {"has a": F.rlike("t", F.lit("once|a")), "none": F.col("t").isNull(), "never": F.lit(False)})
    assert sorted(tuple(r) for r in made.collect()) == [("t", "1", "has a", "error"), ("t", "3", "none", "error")]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("once|a") == 1


def test_short_ways_of_urls_give_what_the_long_ones_do(spark, monkeypatch):
    from tidemark.functions import urls

    ends = ["", "/", "//", "?", "?utm_source=x", "?&UTM_a&gclid=1=2&", "?utm_x&b=1", "?gclidx=1", "?utm_a=1&&fbclid#x", "#x", "/?utm_source=x#", "?utm_a b", "\n", " ", "# ", "?=utm_a", ":443", "?utm_"]
    heads = ["https://a.example.org", "https://a.example.org/b", "http://a.example.org/b//c", "https://A.example.org/b", "https://u@a.example.org/b", "https://localhost/b", "https://a.example.org:8443/b", "https://example.org.evil/b", "x"]
    rows = spark.createDataFrame([(h + e,) for h in heads for e in ends] + [(None,)], "u string")
    made = lambda: [tuple(r) for r in rows.select("u", urls.canonical(F.col("u")), urls.is_allowed(F.col("u"), [".example.org"], ["example.org"])).collect()]
    short = made()
    for name in ("LOADED", "SIMPLE"):
        monkeypatch.setattr(urls, name, "^(none)$")
    assert short == made()
    assert dict((u, c) for u, c, _ in short)["http://a.example.org/b//c/?utm_source=x#"] == "http://a.example.org/b//c"


def test_common_urls_are_read_as_all_others(spark, monkeypatch):
    from tidemark.functions import urls

    ends = ["", "/", "//", "//b", "/b", "/b/", "/b//c//", "/b?", "/b?utm_source=x", "/b/?&utm_a&&utm_b=1&", "/b?utm_x&b=1", "/b?UTM_a=1", "/b#x?y", "/?utm_source=x#", "/b?utm_a b", "/b\n", "/b c", "/b?=utm_a", ":443/b", "/b?utm_é"]
    heads = ["https://a.example.org", "http://a..b", "https://A.example.org", "https://u@a.example.org", "ftp://a.example.org", "https://", " https://a.example.org"]
    rows = spark.createDataFrame([(h + e,) for h in heads for e in ends] + [(None,), ("",)], "u string")
    made = lambda: [tuple(r) for r in rows.select("u", urls.canonical(F.col("u")), urls.host(F.col("u"))).collect()]
    short = made()
    for name in ("COMMON", "COMMON_HOST"):
        monkeypatch.setattr(urls, name, "^(none)$")
    assert short == made()
    assert dict((u, (c, h)) for u, c, h in short)["https://a.example.org/b/?&utm_a&&utm_b=1&"] == ("https://a.example.org/b", "a.example.org")


def test_an_audit_takes_the_latest_answer_of_all_spellings(spark):
    from tidemark.operators import audit

    records = spark.createDataFrame([(1, "active", "https://a.org/b", "h", "http"), (2, "active", "https://a.org/c", "h", "http")], "id int, status string, url string, hash string, method string")
    fields = "url string, ok boolean, http_status int, final_url string, hash string, method string, at int, error string"
    asked = [("https://a.org/b/", 3, "h"), ("https://a.org/b?utm_x=1", 5, "g"), ("https://a.org/b", 4, "h"), ("https://a.org/b?utm_x=1", 1, "h")]
    answers = spark.createDataFrame([(u, True, 200, u, h, "http", at, None) for u, at, h in asked], fields)
    made = audit.audited(records, answers)
    assert sorted((r.id, r.outcome, r.checked_at) for r in made.collect()) == [(1, "changed", 5), (2, "retrieval_failed", None)]
    # answers meet by their address as it is first, so that its identity isn't made for each of them
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [url") == 1


def test_reviews_that_come_twice_are_read_once(spark):
    from tests.conftest import DATA
    from tidemark.plans import base, records

    made = records.version_reviews(base.Tables(spark, DATA))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 1
    again = made.where(F.col("ord") >= 1 << 61)
    assert again.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_quantity > 30").count() > 0


def test_ranges_like_other_rows_change_no_running_maximum(spark):
    from tidemark.operators import folds

    rows = spark.createDataFrame([(i % 3, i, i * 7 % 50) for i in range(200)], "k int, o long, v int")
    made = lambda **more: sorted(tuple(r) for r in folds.running_max(rows, ["k"], "o", "v", "m", 5, **more).collect())
    assert made() == made(like=rows.where("o < 20")) == made(like=rows.where("o < 0"))
