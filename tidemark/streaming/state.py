"""Structured Streaming over feeds of candidates: first discovery, versions, and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "source string, event_id long, hash string, change string, sequence long"


def discoveries(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark; state older than ``delay`` goes."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def seen_versions(events: DataFrame) -> DataFrame:
    """Each event of a source (source, ts, event_id, hash) with its change and sequence.

    State of a source: the last hash and the sequence. Events of a micro-batch are taken in the order
    of time and id; an event that is older than the state's newest never moves it back.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, sequence, newest = state.get if state.exists else (None, 0, -1)
        # a key's events of one micro-batch, which the source's limit on a batch bounds, are put in order first
        for frame in [pd.concat(list(frames))]:
            out = []
            for ts, event, value in frame.sort_values(["ts", "event_id"])[["ts", "event_id", "hash"]].itertuples(index=False):
                at = pd.Timestamp(ts).value // 1000
                if at < newest:
                    out.append((key[0], event, value, "late", sequence))
                    continue
                change = "first" if last is None else "unchanged" if value == last else "changed"
                sequence += change != "unchanged"
                last, newest = value, at
                out.append((key[0], event, value, change, sequence))
            state.update((last, sequence, newest))
            yield pd.DataFrame(out, columns=["source", "event_id", "hash", "change", "sequence"])

    return events.groupBy("source").applyInPandasWithState(step, VERSION, "last string, sequence long, newest long", "append", "NoTimeout")


def once(write: Callable[[DataFrame], None], done: Callable[[int], bool]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that leaves out batches already written."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        if not done(batch_id):
            write(batch.withColumn("batch_id", F.lit(batch_id)))

    return sink
