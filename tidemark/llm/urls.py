"""URL rules by a sort-merge range join, with built-in functions only.

A host is keyed by its labels in reverse, each with a dot behind it, so that a host and all its
subdomains are the keys that begin with the host's own: an interval. The rules of one host are nested
in the same way by their paths. Both are swept alike: keys and interval ends are dealt to ranges, sorted
there, and one window over the sorted rows keeps the stack of open intervals, a column for each level.
A slash, which no host has, parts host key and path, so that only rules of one host nest there.
An interval that reaches over several ranges is opened in each. The first sweep gives each host the
stack of its ancestors that have rules, the second the innermost path of each. The longest rule wins.

Only distinct keys are swept, so that no frequent host or address fills a range. Range bounds are
taken from the keys with the smallest hashes; they shape the work, not the result.

Defined results: a null address, or one without ``://``, has an empty host and path, which no rule fits;
repeated pages are judged alike; of rules with equal host and path the greatest action holds; a rule
with a null host or path, or with one of ``/?#`` in its host, is ignored; other columns are kept aside and come back unless an output has
their name; empty tables give every address the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, partitions

#: Sorts behind every continuation of a prefix.
BEYOND = "\U0010ffff"
BOUNDS = 4096  # keys that the range bounds are chosen from at most


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(name: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def sweep(keys: DataFrame, prefixes: DataFrame, depth: int) -> DataFrame:
    """(key, stack): for each of the distinct ``key``s the payloads of the prefixes that it begins with,
    outermost first. ``prefixes``: distinct ``key``, ``payload``; no more than ``depth`` are nested."""
    some = sorted(r[0] for r in keys.orderBy(F.xxhash64("key"), "key").select("key").limit(BOUNDS).collect())
    n = min(len(some), 2 * partitions(keys.sparkSession))
    bounds = F.array(*(F.lit(some[i * len(some) // n]) for i in range(1, n))).cast("array<string>")
    range_of = lambda key: F.size(F.filter(bounds, lambda b: b <= key))
    kind = prefixes.schema["payload"].dataType
    points = keys.select(range_of(F.col("key")).alias("range"), "key", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("payload"))
    open_in = F.explode(F.sequence(range_of(F.col("key")), range_of(F.concat("key", F.lit(BEYOND)))))
    reach = prefixes.select(open_in.alias("range"), "key", "payload")
    starts = reach.select("range", "key", F.lit(0).alias("kind"), "payload")
    ends = reach.select("range", F.concat("key", F.lit(BEYOND)).alias("key"), F.lit(2).alias("kind"), "payload")
    order = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    swept = points.unionByName(starts).unionByName(ends).withColumn("depth", F.sum(step).over(order))
    levels = [F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.col("payload")), ignorenulls=True).over(order) for d in range(1, depth + 1)]
    swept = swept.withColumn("levels", F.array(*levels))
    return swept.where("kind = 1").select("key", F.expr("slice(levels, 1, depth)").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the longest that fits, else null) and verdict."""
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & ~F.col("host").rlike("[/?#]")).groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.max("action").alias("action"))
    rules = rules.withColumn("hkey", host_key(F.col("host")))
    depths = rules.agg(F.count_distinct(F.size(F.split("hkey", r"\.")))).first()[0]
    lengths = rules.groupBy("hkey").agg(F.count_distinct(F.char_length("path")).alias("n")).agg(F.max("n")).first()[0] or 0
    addressed = pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    if not depths:
        return addressed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    addresses = addressed.select("host", "path").where("host <> ''").distinct().withColumn("hkey", host_key(F.col("host")))
    hosts = sweep(addresses.select(F.col("hkey").alias("key")).distinct(), rules.select(F.col("hkey").alias("key"), F.col("hkey").alias("payload")).distinct(), depths)
    under = addresses.join(hosts.where(F.size("stack") > 0).withColumnRenamed("key", "hkey"), "hkey").select("host", "path", F.explode("stack").alias("hkey"))
    under = under.withColumn("key", F.concat("hkey", F.lit("/"), "path"))
    ways = rules.select(F.concat("hkey", F.lit("/"), "path").alias("key"), F.struct(F.concat("host", "path").alias("rule"), F.col("action").alias("action")).alias("payload"))
    innermost = sweep(under.select("key").distinct(), ways, lengths).where(F.size("stack") > 0).select("key", F.element_at("stack", -1).alias("found"))
    best = under.join(innermost, "key").groupBy("host", "path").agg(F.max_by("found", F.struct(F.char_length("found.rule"), F.char_length("hkey"))).alias("_found"))
    judged = addressed.join(best, ["host", "path"], "left").withColumn("rule", F.col("_found.rule"))
    return judged.withColumn("verdict", F.coalesce("_found.action", F.lit(default))).drop("_found")
