"""Reading and writing record sets: JSON arrays with a schema, single documents, posts, captured files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that Spark uses for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of a JSON array with ``_ord``, their place; no rows if the file is missing, an error if it is malformed."""
    full = T.StructType([*schema.fields, T.StructField("_ord", T.LongType())])
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(schema), {"mode": "FAILFAST"}).alias("rows"))
    return whole.select(F.posexplode("rows").alias("_ord", "row")).select("row.*", F.col("_ord").cast("long").alias("_ord"))


def read_or_legacy(primary: DataFrame, legacy: DataFrame) -> DataFrame:
    """The primary relation, or the legacy one if that has no rows."""
    return legacy.select(primary.columns) if primary.isEmpty() else primary


def read_document(spark: SparkSession, path: str, schema: T.StructType, defaults: dict[str, Column]) -> DataFrame:
    """One row: a JSON document with a default for each missing field."""
    if exists(spark, path):
        row = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    else:
        row = spark.createDataFrame([[None] * len(schema)], schema)
    return row.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})


def write_array(rows: DataFrame, path: str, order: str = "_ord") -> None:
    """Write a record set next to its place and move it there when it is whole; a failed write changes nothing."""
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    staged, target = fs_path(f"{path}.{uuid.uuid4().hex}"), fs_path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows.repartitionByRange(order).sortWithinPartitions(order).drop(order).write.json(staged.toString())
        if fs.exists(target):
            fs.delete(target, True)
        fs.rename(staged, target)
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)


def read_posts(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, title, date, summary, body) of texts with front matter; without title or date they are skipped. Newest first."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    head, body = r"(?s)^---\r?\n(.*?)\r?\n---", r"(?s)^---\r?\n.*?\r?\n---\r?\n?(.*)$"
    field = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(F.regexp_extract("value", head, 1), rf"(?m)^{name}:[ \t]*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    rows = files.select(F.regexp_replace("file", r"\.[^.]+$", "").alias("slug"), field("title").alias("title"), field("date").alias("date"), field("description").alias("summary"), F.regexp_extract("value", body, 1).alias("body"))
    return rows.where(F.col("title").isNotNull() & F.try_to_date(F.left("date", F.lit(10)), "yyyy-MM-dd").isNotNull()).orderBy(F.col("date").desc(), "slug")


def read_captured(spark: SparkSession, path: str, most: int = 32 << 20) -> DataFrame:
    """(path, content, kind, error) of files, by their first bytes; those over ``most`` bytes come without content and with an error. Spark lists no empty files."""
    from tidemark.functions.hashing import kind_of

    files = spark.read.format("binaryFile").load(path).withColumn("error", F.when(F.col("length") > most, "too large"))
    content = F.when(F.col("error").isNull(), F.col("content"))
    return files.select("path", content.alias("content"), kind_of(content).alias("kind"), "error")


def with_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with ``_ord`` by a total order, within partitions of the first column's ranges and then over them.

    Row numbers over a whole table need one pass for the sizes of the ranges; no task sorts it all.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    before = inside.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.drop("count")), "_range").withColumn("_ord", F.col("_in") + F.col("_before") - 1).drop("_range", "_in", "_before")
