"""Rows in batches of an exact size for a scorer from outside, and batches that fail tried again in parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import folds


def numbered(rows: DataFrame, order: str, size: int = 20, n: int | None = None) -> DataFrame:
    """rows with ``batch`` and ``place`` (from 0) in the order of a unique number: every batch but the last has ``size`` rows.

    Rows are dealt by ranges of the order; the ranges' sizes give where each begins, so that no task sorts all rows.
    """
    dealt = rows.withColumn("_range", folds.ranges(rows, order, n))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = sizes.select("_range", before.alias("_before"))
    at = F.col("_before") + F.col("_in")
    held = dealt.withColumn("_in", inside).join(F.broadcast(starts), "_range")
    return held.withColumn("batch", F.floor(at / size).cast("long")).withColumn("place", F.pmod(at, F.lit(size)).cast("int")).drop("_range", "_before", "_in")


def scored(rows: DataFrame, key: str, text: str, score: Callable[[list[str]], Sequence[float]], most: int = 600) -> DataFrame:
    """(key, score, error, calls) for rows in batches: ``score`` gets the first ``most`` characters of a batch's texts, in their
    places. A batch that fails, or gives another number of scores, is halved until a single row fails by itself;
    ``calls`` is how many calls a row was in. Batches are whole in one task, which goes through them one by one."""

    def tried(keys: list, texts: list[str], calls: int = 1) -> Iterator[tuple]:
        try:
            given = list(score(texts))
            if len(given) != len(texts):
                raise ValueError(f"{len(given)} scores for {len(texts)} texts")
        except Exception as error:  # noqa: BLE001  what a scorer raises is a result
            if len(keys) == 1:
                yield keys[0], None, f"{type(error).__name__}: {error}", calls
                return
            half = len(keys) // 2
            yield from tried(keys[:half], texts[:half], calls + 1)
            yield from tried(keys[half:], texts[half:], calls + 1)
            return
        for k, s in zip(keys, given):
            yield k, None if s is None else float(s), None, calls

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, keys, texts = None, [], []
        names = [key, "score", "error", "calls"]
        for frame in frames:
            out: list[tuple] = []
            for batch, k, x in zip(frame["batch"], frame[key], frame["_text"]):
                if keys and batch != last:
                    out += tried(keys, texts)
                    keys, texts = [], []
                last = batch
                keys.append(k)
                texts.append(x)
            yield pd.DataFrame(out, columns=names)
        if keys:
            yield pd.DataFrame(list(tried(keys, texts)), columns=names)

    schema = T.StructType([rows.schema[key], T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType()), T.StructField("calls", T.IntegerType())])
    held = rows.select("batch", "place", key, F.left(F.coalesce(text, F.lit("")), F.lit(most)).alias("_text"))
    return held.repartition("batch").sortWithinPartitions("batch", "place").mapInPandas(run, schema)
