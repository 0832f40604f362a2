"""Tables in the shared folder, by which a query's lineage is cut; the training-data operators have their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine, as in tests, one under the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return str(named).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(rows: DataFrame) -> DataFrame:
    """The rows written once and read from there, and the shuffles that led to them deleted as soon as that is done.

    The table goes when the driver's JVM ends, as a result may be read from it, or is deleted by ``drop``.
    """
    spark = rows.sparkSession
    path, before = f"{_folder(spark)}/cut-{uuid.uuid4().hex}", spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    place, files = _files(spark, path)
    files.deleteOnExit(place)
    held = spark.read.schema(rows.schema).parquet(path)
    held._written = path
    return held


def drop(held: DataFrame) -> None:
    """Delete what ``cut`` wrote, where nothing is to be computed from it any more."""
    place, files = _files(held.sparkSession, held._written)
    files.delete(place, True)


def _files(spark, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())
