"""Registry of queries with their SQL, and the roles that the tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2001-03-01 00:00:00"


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register a function of the tables as a query under its name."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def register(t: Tables) -> DataFrame:
    """Orders as register rows: a jurisdiction by region, an agency by customer, a verification by label."""
    o, c, n, r = t.orders, t.customer, t.nation, t.region
    q = t.labels.select(F.col("doc_id").alias("_label"), "quality")
    held = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    held = held.join(q, F.col("o_orderkey") % 1000 == F.col("_label"), "left")
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    return held.select(
        key.alias("id"),
        F.concat(F.lit("Order "), key, F.lit(" for "), "c_name").alias("title"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_orderstatus").alias("status"),
        F.col("r_name").alias("jurisdiction"),
        F.col("c_name").alias("agency"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective"),
        F.array("c_mktsegment", "n_name").alias("tags"),
        F.concat(F.lit("https://www.example.com/orders/"), key, F.lit("/?utm_source=feed&b=2&a="), owner, F.lit("#top")).alias("url"),
        F.when(F.col("o_orderstatus") == "F", owner).alias("superseded_by"),
        F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "stale").otherwise("needs_review").alias("v_status"),
        F.when(owner % 5 == 0, "automatic").otherwise("manual").alias("method"),
        F.when(owner % 7 == 0, "  ").otherwise("Reviewer").alias("checked_by"),
        F.when(key % 11 != 0, F.sha2(key.cast("string"), 256)).alias("hash"),
        F.col("o_orderdate").alias("checked_at"),
        F.when(key % 3 == 0, "Seen before.").alias("notes"),
    )


REGISTER_SQL = """reg AS (
  SELECT o_orderkey AS id, 'Order ' || o_orderkey || ' for ' || c_name AS title, o_orderpriority AS type, o_orderstatus AS status, r_name AS jurisdiction,
    c_name AS agency, strftime(o_orderdate, '%Y-%m-%d') AS effective, [c_mktsegment, n_name] AS tags,
    'https://www.example.com/orders/' || o_orderkey || '/?utm_source=feed&b=2&a=' || o_custkey || '#top' AS url,
    CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS superseded_by,
    CASE WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'stale' ELSE 'needs_review' END AS v_status,
    CASE WHEN o_custkey % 5 = 0 THEN 'automatic' ELSE 'manual' END AS method, CASE WHEN o_custkey % 7 = 0 THEN '  ' ELSE 'Reviewer' END AS checked_by,
    CASE WHEN o_orderkey % 11 <> 0 THEN sha256(o_orderkey::VARCHAR) END AS hash, o_orderdate AS checked_at, CASE WHEN o_orderkey % 3 = 0 THEN 'Seen before.' END AS notes
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN labels ON o_orderkey % 1000 = doc_id),
cur AS (SELECT *, coalesce(v_status = 'verified' AND method = 'manual' AND trim(checked_by) <> '' AND hash IS NOT NULL
    AND checked_at <= TIMESTAMP '2001-03-01' + INTERVAL 5 MINUTE AND checked_at >= TIMESTAMP '2001-03-01' - INTERVAL 90 DAY, FALSE) AS is_current FROM reg)"""


def reviews(t: Tables) -> DataFrame:
    """Lineitems as source reviews of the orders; some carry another url than their order."""
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("l_orderkey")
    moved = F.when(F.col("l_linenumber") == 4, "/moved").otherwise("")
    return rows.select(
        F.concat_ws("-", key, "l_linenumber", "l_partkey", "l_suppkey").alias("review_id"),
        F.when(F.col("l_linenumber") < 5, key).alias("target_id"),
        F.concat(F.lit("https://www.example.com/orders/"), key, moved, F.lit("?a="), "o_custkey", F.lit("&b=2")).alias("url"),
        F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_linestatus") == "O", "pending_review").otherwise("published").alias("status"),
        key.alias("draft_id"),
        F.sha2(F.when(F.col("l_linenumber") == 5, key).otherwise(F.lit(-1)).cast("string"), 256).alias("draft_revision"),
        F.col("l_linenumber").alias("sequence"),
        F.col("l_shipdate").alias("discovered"),
    )


REVIEWS_SQL = """rev AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id, CASE WHEN l_linenumber < 5 THEN l_orderkey END AS target_id,
    'https://www.example.com/orders/' || l_orderkey || CASE WHEN l_linenumber = 4 THEN '/moved' ELSE '' END || '?a=' || o_custkey || '&b=2' AS url,
    CASE WHEN l_returnflag = 'A' THEN 'approved' WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_linestatus = 'O' THEN 'pending_review' ELSE 'published' END AS status,
    l_orderkey AS draft_id, sha256((CASE WHEN l_linenumber = 5 THEN l_orderkey ELSE -1 END)::VARCHAR) AS draft_revision, l_linenumber AS sequence, l_shipdate AS discovered
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
uid AS (SELECT id, 'https://www.example.com/orders/' || id || '?a=' || regexp_extract(url, 'a=(\\d+)', 1) || '&b=2' AS identity, hash AS revision FROM reg),
held AS (SELECT DISTINCT id FROM (
  SELECT uid.id FROM rev JOIN uid ON rev.target_id = uid.id AND rev.url = uid.identity WHERE status IN ('pending_review', 'approved')
  UNION ALL SELECT uid.id FROM rev JOIN uid ON rev.draft_id = uid.id AND rev.url = uid.identity AND rev.draft_revision = uid.revision WHERE status = 'approved' AND target_id IS NULL))"""
