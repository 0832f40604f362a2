"""Changes to many records in one keyed pass, where a field that a patch holds as null isn't one that it leaves out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def patch(values: dict[str, Column], given: dict[str, Column] | None = None) -> list[Column]:
    """The columns of a patch row: the values, and ``present``, a bit for each field in its order; ``given`` says whether a
    patch has the field, for fields it doesn't name it has it always."""
    bits = [F.when(F.coalesce((given or {}).get(c, F.lit(True)), F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(values)]
    present = bits[0]
    for bit in bits[1:]:
        present = present.bitwiseOR(bit)
    return [*(v.alias(c) for c, v in values.items()), present.alias("present")]


def _has(fields: Sequence[str], field: str) -> Column:
    return F.col("present").bitwiseAND(F.lit(1 << list(fields).index(field))) != 0


def applied(records: DataFrame, patches: DataFrame, fields: Sequence[str], key: str = "id", order: str = "ord", time: str = "at") -> tuple[DataFrame, DataFrame]:
    """(records after their patches, patches without a record).

    patches: key, ``order`` (unique for a key), ``time``, ``fields``, present. The last patch that has a field decides it, an
    explicit null too. ``updated_at``, where records have it, is the last patch's time unless that patch gives one;
    ``trashed_at`` is when the record last went from another status to trashed, and null once it has left that.
    """
    status = _has(fields, "status") if "status" in fields else F.lit(False)
    going = F.coalesce(F.col("status") == "trashed", F.lit(False)) if "status" in fields else F.lit(False)
    last = patches.groupBy(key).agg(
        F.max(order).alias("_last"),
        F.max_by(F.when(_has(fields, "updated_at"), F.col("updated_at")).otherwise(F.col(time)) if "updated_at" in fields else F.col(time), order).alias("_time"),
        F.max(F.when(status & ~going, F.col(order))).alias("_left"),
        *(F.max_by(F.when(_has(fields, c), F.struct(F.col(c).alias("v"))), F.when(_has(fields, c), F.col(order))).alias(f"_{c}") for c in fields),
    )
    tracks = "status" in fields and "trashed_at" in records.columns
    if tracks:
        went = patches.where(status & going).join(last.select(key, "_left"), key).where(F.col("_left").isNull() | (F.col(order) > F.col("_left")))
        last = last.join(went.groupBy(key).agg(F.min_by(time, order).alias("_went")), key, "left")
    both = records.join(last, key, "left")
    changes = {c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)) for c in fields if c != "updated_at"}
    if "updated_at" in records.columns:
        changes["updated_at"] = F.when(F.col("_last").isNotNull(), F.col("_time")).otherwise(F.col("updated_at"))
    if tracks:
        stays = F.col("_left").isNull() & (F.col("status") == "trashed")
        changes["trashed_at"] = F.when(stays, F.col("trashed_at")).when(F.col("_went").isNotNull(), F.col("_went")).when(F.col("_left").isNull(), F.col("trashed_at"))
    after = both.select(*(changes[c].alias(c) if c in changes else F.col(c) for c in records.columns))
    return after, patches.join(records.select(key), key, "left_anti")
