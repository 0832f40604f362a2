"""Small pieces that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of one byte a character take the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of the separator class; null has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), f"{separators}+")
    return F.filter(pieces, lambda w: w != "")


ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 2 << 20


def small_batches(spark) -> None:
    """Bound what a Python worker holds of the texts at a time, for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def tidy(task: Callable) -> Callable:
    """A task over an iterator of batches that gives its freed memory back to the system when it ends.

    Python workers are used again by later tasks, and would keep what large arrays once took.
    """

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library: nothing to give back
                pass

    return run


def documents(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine, as in tests, one under the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return str(named).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, lean: bool = False) -> DataFrame:
    """Cut the lineage: the rows written to the shared folder as a table, and read from there.

    ``drop`` deletes the table; what a result still needs goes when the driver's JVM ends. With ``lean`` the shuffles that
    led to the table are deleted as soon as it is written, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    if lean:
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if lean:
            spark.conf.set(SHUFFLES_GO, before)
    place, files = _files(spark, path)
    files.deleteOnExit(place)
    held = spark.read.schema(df.schema).parquet(path)
    held._written = path
    return held


def _files(spark, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark, path: str) -> bool:
    place, files = _files(spark, path)
    return files.exists(place)


def drop(*cuts: DataFrame) -> None:
    """Delete what ``cut`` wrote, where nothing is to be computed from it any more."""
    for held in cuts:
        path, files = _files(held.sparkSession, held._written)
        files.delete(path, True)


HOT_KEYS, HOT_ROWS, WAYS = 4096, 1000, 64


def salted(rows: DataFrame, keyed: DataFrame, on: str, weight: str, by: Column) -> DataFrame:
    """rows joined with ``keyed``, which has each key once and its ``weight``, about how many rows share it.

    Rows of the heaviest keys, at most ``HOT_KEYS``, are dealt over ``WAYS`` tasks by ``by``, and those keys repeated for each, so
    that no task gets all rows of a key that very many share.
    """
    top = cut(keyed.where(F.col(weight) > HOT_ROWS).orderBy(F.desc(weight), on).limit(HOT_KEYS).select(on, F.lit(True).alias("_hot")))
    left = rows.join(F.broadcast(top), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(WAYS)).cast("int")).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    right = keyed.join(F.broadcast(top), on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [on, "_salt"]).drop("_salt")
