"""Data quality as rows: (relation, key, rule, severity) for each rule that a record breaks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broken(rows: DataFrame, relation: str, key: str, rules: Mapping[str, Column], severity: str = "error") -> DataFrame:
    """A row for each record and rule whose condition for breaking it holds; one pass over the records.

    Names of rules are distinct. An explode that isn't outer has its array made again, to leave out records that break none,
    and a function of a lambda has it made without compiled code; so neither is used here.
    """
    found = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()))
    held = rows.select(F.col(key).cast("string").alias("key"), F.array_except(found, F.array(F.lit(None).cast("string"))).alias("_found"))
    told = held.select(F.lit(relation).alias("relation"), "key", F.explode_outer("_found").alias("rule"), F.lit(severity).alias("severity"))
    return told.where("rule IS NOT NULL")


def duplicates(rows: DataFrame, relation: str, key: str, by: Column, order: str, rule: str, severity: str = "error") -> DataFrame:
    """Every record after the first with the same value."""
    w = Window.partitionBy("_by").orderBy(order)
    ranked = rows.withColumn("_by", by).where(F.col("_by").isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n > 1")
    return ranked.select(F.lit(relation).alias("relation"), F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def dangling(rows: DataFrame, relation: str, key: str, reference: str, targets: DataFrame, target_key: str, rule: str, severity: str = "error") -> DataFrame:
    """Records whose reference names no target."""
    ids = targets.select(F.col(target_key).alias("_target"))
    held = rows.where(F.col(reference).isNotNull()).join(ids, F.col(reference) == F.col("_target"), "left_anti")
    return held.select(F.lit(relation).alias("relation"), F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def recomputed(stored: DataFrame, computed: DataFrame, relation: str, fields: list[str]) -> DataFrame:
    """Stored totals, one row, that differ from those computed anew, one row."""
    both = stored.select(F.struct(*fields).alias("s")).crossJoin(computed.select(F.struct(*fields).alias("c")))
    off = F.array(*(F.when(~F.col(f"s.{f}").eqNullSafe(F.col(f"c.{f}")), F.lit(f"{f} differs")) for f in fields))
    return both.select(F.lit(relation).alias("relation"), F.lit("totals").alias("key"), F.explode(F.array_compact(off)).alias("rule"), F.lit("error").alias("severity"))


def merged(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
