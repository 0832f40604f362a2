"""State of watched sources: the last content of each, its versions and what has become of them, kept by key.

An observation says what a source held at a time, and what the record that tracks it holds; a decision says what became of a
version. Both are folded in the order of their time and id, whatever the order in which they come: a stream holds them
back in its state until the watermark has passed them. ``fold`` is one step, and the same for a stream and for a table.

State of a source: a value with its snapshot, a map from a version's sequence to (hash, status), and a map of what waits.
A version that was decided is forgotten ``KEPT`` versions later; the newest number is never given twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN = ("pending", "awaiting_review", "approved", "failed")
EVENT = "source string, at timestamp, event_id long, kind string, hash string, tracked boolean, baseline string, sequence long, status string"
STEP = "source string, event_id long, at timestamp, change string, sequence long, superseded array<long>, snapshot string"
SNAPSHOT = "hash string, sequence long, newest long, first_checked timestamp, last_checked timestamp, last_changed timestamp"
KEPT = 16


class Held(NamedTuple):
    """hash: content at the last check; sequence: its version; newest: the greatest number given."""

    hash: str | None
    sequence: int
    newest: int
    first_checked: Any
    last_checked: Any
    last_changed: Any


def fold(event: Any, held: Held | None, versions: dict[int, tuple[str, str]]) -> tuple[Held | None, str, int | None, list[int]]:
    """(state, change, sequence, superseded) after one event; ``versions`` is changed in place."""
    if event.kind == "decision":
        number = None if event.sequence is None or pd.isna(event.sequence) else int(event.sequence)
        if number not in versions:
            return held, "unknown", number, []
        versions[number] = (versions[number][0], event.status)
        return held, "decided", number, []
    snapshot, newest = (held.hash, held.newest) if held else (None, 0)
    last = max(versions, default=None)
    if event.tracked:
        waits = any(status in OPEN for _, status in versions.values())
        change = "baseline_missing" if event.baseline is None else "changed" if event.baseline != event.hash else "baseline_reversion" if waits else "unchanged"
    else:
        change = "first" if snapshot is None else "unchanged" if snapshot == event.hash else "changed"
    if change in ("first", "unchanged"):
        moved = held is not None and snapshot is not None and snapshot != event.hash
        after = Held(event.hash, newest, newest, held.first_checked if held and held.first_checked is not None else event.at, event.at, event.at if moved else held.last_changed if held else None)
        return after, change, newest, []
    if last is not None and versions[last][0] == event.hash and (snapshot == event.hash or versions[last][1] in OPEN):
        return held, "same_version", last, []
    superseded = sorted(n for n, (_, status) in versions.items() if status in OPEN)
    for n in superseded:
        versions[n] = (versions[n][0], "dismissed")
    number = newest + 1
    versions[number] = (event.hash, "pending")
    for n in [n for n, (_, status) in versions.items() if n <= number - KEPT and status not in OPEN]:
        del versions[n]
    if event.tracked:  # a tracked record's snapshot moves when its review is published
        after = Held(snapshot, held.sequence if held else 0, number, *(held[3:] if held else (None, None, None)))
    else:
        after = Held(event.hash, number, number, held.first_checked, event.at, event.at)
    return after, change, number, superseded


class _Watch(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.snapshot = handle.getValueState("snapshot", SNAPSHOT)
        self.versions = handle.getMapState("versions", "sequence long", "hash string, status string")
        self.waiting = handle.getMapState("waiting", "at timestamp, event_id long", EVENT.removeprefix("source string, ").replace("at timestamp, event_id long, ", ""))

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        from pyspark.sql import Row

        mark = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            due = int(row.at.timestamp() * 1000) + 1
            if due <= mark:  # later than the delay: it can't be put in order any more
                yield Row(source=key[0], event_id=row.event_id, at=row.at, change="late", sequence=None, superseded=[], snapshot=None)
                continue
            self.waiting.updateValue((row.at, row.event_id), (row.kind, row.hash, row.tracked, row.baseline, row.sequence, row.status))
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Any]:
        from pyspark.sql import Row

        until = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((k for k in self.waiting.keys() if int(k[0].timestamp() * 1000) + 1 <= until), key=lambda k: (k[0], k[1]))
        if not ready:
            return
        held = Held(*self.snapshot.get()) if self.snapshot.exists() else None
        versions = {int(k[0]): (v[0], v[1]) for k, v in self.versions.iterator()}
        known = dict(versions)
        for at, event_id in ready:
            kind, hash_, tracked, baseline, sequence, status = self.waiting.getValue((at, event_id))
            self.waiting.removeKey((at, event_id))
            event = Row(at=at, event_id=event_id, kind=kind, hash=hash_, tracked=tracked, baseline=baseline, sequence=sequence, status=status)
            held, change, number, superseded = fold(event, held, versions)
            yield Row(source=key[0], event_id=event_id, at=at, change=change, sequence=number, superseded=superseded, snapshot=held.hash if held else None)
        if held is not None:
            self.snapshot.update(tuple(held))
        for n in known.keys() - versions.keys():
            self.versions.removeKey((n,))
        for n, version in versions.items():
            if known.get(n) != version:
                self.versions.updateValue((n,), version)

    def close(self) -> None:
        pass


def watched(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of steps for a stream of events (``EVENT``); needs the RocksDB state store."""
    timed = events.withWatermark("at", delay)
    return timed.groupBy("source").transformWithState(_Watch(), STEP, "append", "EventTime")


def folded(events: DataFrame) -> DataFrame:
    """The same steps for a table: Spark sorts each source's events, and a task goes through them one after another, with the
    state of one source at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, held, versions = None, None, {}
        for frame in frames:
            out = []
            for event in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                if event.source != source:
                    source, held, versions = event.source, None, {}
                held, change, number, superseded = fold(event, held, versions)
                out.append((source, event.event_id, event.at, change, number, superseded, held.hash if held else None))
            yield pd.DataFrame(out, columns=["source", "event_id", "at", "change", "sequence", "superseded", "snapshot"]).astype({"sequence": "Int64"})

    names = [part.split()[0] for part in EVENT.split(", ")]
    return events.select(names).repartition("source").sortWithinPartitions("source", "at", "event_id").mapInPandas(run, STEP)


def current(steps: DataFrame) -> DataFrame:
    """(source, snapshot, sequence, open): each source's state, from its steps; open: versions that wait for a decision.

    A step that gives a number opens a version; a later one that names it as superseded, or decides it, closes it.
    """
    order = F.struct("at", "event_id")
    real = steps.where("change <> 'late'")
    last = real.groupBy("source").agg(F.max_by("snapshot", order).alias("snapshot"), F.max("sequence").alias("sequence"))
    opened = real.where(F.col("change").isin("changed", "baseline_missing", "baseline_reversion")).select("source", "sequence")
    closed = real.select("source", F.explode("superseded").alias("sequence")).unionByName(real.where("change = 'decided'").select("source", "sequence")).distinct()
    waits = opened.join(closed, ["source", "sequence"], "left_anti").groupBy("source").agg(F.count("*").alias("open"))
    return last.join(waits, "source", "left").withColumn("open", F.coalesce("open", F.lit(0)))
