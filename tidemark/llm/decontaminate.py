"""Benchmark decontamination by a prefix-filtered set join, with built-in functions only.

An item's windows are runs of ``size`` consecutive words (an item of fewer words is one window). A
window is a set of shingles of up to ``shingle`` words with their places. A text that holds a window
holds all its shingles, so the prefix that must be shared is one shingle: the rarest, by counts over all
texts. A window with a shingle that no text has is dropped. The texts' shingles are joined with these
prefixes alone; a match fixes where the window would start, which must leave room for its length, and
the words there are compared one by one.

The window table is broadcast while its measured size is under ``BROADCAST_BYTES``; beyond it, shingles
and windows are joined by shuffle, and words are fetched for the candidates only.

Defined results: null texts and texts without words have no words and no hits; items without words are
ignored; repeated items count by distinct id; repeated documents are judged alike, and each keeps its row;
a null id is an id; other columns of ``docs`` are kept unless an output has their name; empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, words_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return words_of(lower_ascii(text), SEPARATORS)


def shingles(hashes: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words, by the words' hashes."""
    places = F.sequence(F.lit(0), F.size(hashes) - width)
    run = lambda i: F.xxhash64(F.lit(width), *(F.get(hashes, i + k) for k in range(width)))
    return F.when(F.size(hashes) >= width, F.transform(places, run)).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, size: int, shingle: int, item: str, text: str) -> DataFrame:
    """Distinct windows: words, length, the items that hold them, width and hashes of their shingles."""
    cut = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("all")).where("size(all) > 0")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - size + 1)), lambda i: F.slice("all", i, size))
    out = cut.select("item", F.explode(runs).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))
    out = out.withColumn("length", F.size("window")).withColumn("width", F.least(F.lit(shingle), F.col("length")))
    hashes = F.transform("window", lambda w: F.xxhash64(w))
    by_width = F.coalesce(*(F.when(F.col("width") == k, shingles(hashes, k)) for k in range(1, shingle + 1)))
    return out.withColumn("shingles", by_width)


def flag(docs: DataFrame, benchmark: DataFrame, size: int = 13, shingle: int = 3, percent: int = 5, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurring window), items (ids of the items with one,
    as sorted strings) and contaminated: whether hits are at least ``percent`` of a hundred words."""
    found = occurrences(docs, item_windows(benchmark, size, shingle, item, item_text), shingle, doc, text)
    span = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    hits = found.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("items"))
    hits = hits.select(
        F.col("id").alias("_hit_id"),
        F.col("hash").alias("_hit_hash"),
        F.size(F.array_distinct(F.flatten(span))).cast("long").alias("_hit_n"),
        F.array_sort(F.array_distinct(F.flatten("items")).cast("array<string>")).alias("_hit_items"),
    )
    rows = docs.withColumn("n_words", F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long"))
    joined = rows.join(hits, F.col(doc).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(text) == F.col("_hit_hash")), "left")
    out = joined.withColumn("n_hit", F.coalesce("_hit_n", F.lit(0).cast("long"))).withColumn("items", F.coalesce("_hit_items", F.array().cast("array<string>")))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    return out.drop("_hit_id", "_hit_hash", "_hit_n", "_hit_items")


def occurrences(docs: DataFrame, windows: DataFrame, shingle: int, doc: str, text: str) -> DataFrame:
    """(id, hash of the text, start, length, items): where windows stand in texts."""
    made = windows.select("window", "items", "length", "width", "shingles")
    sizes = made.agg(F.sum(F.size("shingles") * 8 + F.octet_length(F.to_json("window")) + 16 * F.size("items")).alias("bytes"), F.collect_set("width").alias("widths")).first()
    small = (sizes["bytes"] or 0) <= BROADCAST_BYTES
    near = F.broadcast if small else lambda df: df
    texts = docs.select(F.col(doc).alias("id"), F.xxhash64(text).alias("hash"), words(F.col(text)).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    places = None
    for width in sorted(sizes["widths"] or [1]):
        one = texts.select("id", "hash", "words", F.posexplode(shingles(F.col("hashes"), width)).alias("at", "shingle"))
        places = one if places is None else places.unionByName(one)
    wanted = made.select(F.explode("shingles").alias("shingle")).distinct()
    seen = places.select("shingle").join(near(wanted), "shingle").groupBy("shingle").agg(F.count("*").alias("seen"))
    each = made.select("window", "items", "length", F.posexplode("shingles").alias("offset", "shingle")).join(near(seen), "shingle", "left")
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("shingle"), F.col("offset"))).alias("prefix")
    prefix = each.groupBy("window").agg(rarest, F.first("items").alias("items"), F.first("length").alias("length")).where("prefix.seen > 0")
    prefix = prefix.select("window", "items", "length", "prefix.shingle", "prefix.offset")
    room = "at >= offset AND at - offset + length <= n"
    same = F.slice("words", F.col("start") + 1, F.col("length")) == F.col("window")
    if small:
        met = places.join(near(prefix), "shingle").withColumn("n", F.size("words")).where(room).withColumn("start", F.col("at") - F.col("offset"))
        return met.where(same).select("id", "hash", "start", "length", "items")
    met = places.select("id", "hash", "at", "shingle").join(prefix, "shingle").where("at >= offset").select("id", "hash", (F.col("at") - F.col("offset")).alias("start"), "length", "items", "window")
    back = texts.select(F.col("id").alias("id2"), F.col("hash").alias("hash2"), "words").dropDuplicates(["id2", "hash2"])
    met = met.join(back, F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2"))).where(F.col("start") + F.col("length") <= F.size("words"))
    return met.where(same).select("id", "hash", "start", "length", "items")
