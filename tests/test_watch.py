"""Watched sources as keyed state: a stream in any order of batches, with a restart, gives what the table gives."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.streaming import watch

START = datetime(2024, 1, 1)


def events(seed, sources=3, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source, at = f"s{rng.randrange(sources)}", START + timedelta(minutes=rng.randrange(n))
        if rng.random() < 0.4:
            rows.append((source, at, i, "decision", None, None, None, rng.randrange(1, 8), rng.choice(["approved", "processed", "dismissed", "failed", "awaiting_review"])))
        else:
            rows.append((source, at, i, "seen", rng.choice("abc"), source == "s0", rng.choice(["a", "a", "b", None]), None, None))
    return rows


def plain(rows):
    return sorted((r["source"], r["event_id"], r["change"], r["sequence"], tuple(r["superseded"] or ()), r["snapshot"]) for r in rows)


def by_hand(rows):
    """One event after the other, each source's whole history at hand."""
    out = []
    for source in {r[0] for r in rows}:
        content, given, history = None, 0, {}
        for _, at, event_id, kind, hash_, tracked, baseline, number, status in sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], r[2])):
            gone = ()
            if kind == "decision":
                change = "decided" if number in history else "unknown"
                if number in history:
                    history[number][1] = status
            else:
                waiting = [n for n, (_, s) in history.items() if s in watch.OPEN]
                if tracked:
                    change = "baseline_missing" if baseline is None else "changed" if baseline != hash_ else "baseline_reversion" if waiting else "unchanged"
                else:
                    change = "first" if content is None else "unchanged" if content == hash_ else "changed"
                top = max(history, default=None)
                if change in ("first", "unchanged"):
                    content, number = hash_, given
                elif top and history[top][0] == hash_ and (content == hash_ or history[top][1] in watch.OPEN):
                    change, number = "same_version", top
                else:
                    gone = tuple(sorted(waiting))
                    for n in waiting:
                        history[n][1] = "dismissed"
                    given += 1
                    number = given
                    history[number] = [hash_, "pending"]
                    if not tracked:
                        content = hash_
            out.append((source, event_id, change, number, gone, content))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_table_is_folded_in_order(spark, seed):
    rows = events(seed, n=60)
    random.Random(seed).shuffle(rows)
    assert plain(watch.folded(spark.createDataFrame(rows, watch.EVENT).repartition(5)).collect()) == by_hand(rows)


def test_stream_in_any_order_and_restarted(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = events(7)
        mixed = sorted(rows, key=lambda r: r[1] + timedelta(minutes=random.Random(r[2]).randrange(50)))  # up to 50 minutes late
        given, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

        def run():
            stream = spark.readStream.schema(watch.EVENT).option("maxFilesPerTrigger", 1).parquet(given)
            query = watch.watched(stream, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()

        thirds = [mixed[:30], mixed[30:60], mixed[60:]]
        for i, part in enumerate(thirds):  # a new query on the same checkpoint each time
            spark.createDataFrame(part, watch.EVENT).coalesce(1).write.mode("append").parquet(given)
            run()
        last = [("end", START + timedelta(days=2), 1000, "seen", "z", False, None, None, None)]
        for part in (last, [("end", START + timedelta(days=4), 1001, "seen", "z", False, None, None, None)]):
            spark.createDataFrame(part, watch.EVENT).coalesce(1).write.mode("append").parquet(given)
            run()
        got = [r for r in spark.read.parquet(out).collect() if r["source"] != "end"]
        assert plain(got) == by_hand(rows)
        steps = spark.createDataFrame(got, watch.STEP)
        held = {r["source"]: (r["snapshot"], r["open"]) for r in watch.current(steps).collect()}
        assert set(held) == {"s0", "s1", "s2"} and all(n >= 0 for _, n in held.values())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
