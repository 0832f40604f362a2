"""Spelling variants: words one edit apart, by merging the light subtrees of their trie.

Occurrences are counted for each text, then summed by Spark; words that are long and frequent enough form a trie. A
node's heavy child is the one with most words below it. All words below its other, light, children (and one that
ends at the node) are merged, the smaller side, with one character changed:

- *replaced* by the heavy child's: the word must end in the heavy subtree;
- *skipped*: it must end below the node itself;
- the heavy child's *skipped on the other side*, so put in before the light character: again in the heavy subtree;
- *left out of sight*: light words that agree in all but this character meet one another.

Terminals that coincide are words one edit apart. A character is skipped only where the next one differs, so
each pair is met once. A word is below a light child at most as often as its number of halvings,
log2 of the words. No tree is built in one place: a node is the hash of its prefix, its children's sizes are
sums, and coinciding terminals are joins. Which child counts as heavy decides the work, not the result, so a hash that
two prefixes share does no harm.

The largest ``LARGEST`` nodes, which many words pass, are broadcast; the rest is joined. Pairs within one merged
group, at most one word for each character of the alphabet, are counted without being written out.

Defined results: a null text has no words, a null id is an empty one in the hash; rows that repeat an id or a text
count each by itself; words of equal count are taken in code-point order; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, cut, drop, tidy

LEAST_LENGTH, LEAST_COUNT, NOISE, FACTOR = 5, 3, 97, 2
LARGEST, HELD, PART = 4096, 1 << 17, 1 << 20
_RUN = re.compile("[A-Za-zÀ-ÿ]+").findall
_GAP = re.compile("[^A-Za-zÀ-ÿ]").search
_LOWER = str.maketrans(UPPER, UPPER.lower())
#: Stands for a character that is out of sight; no word holds it.
BLANK = "_"


def runs(text: str) -> Iterator[str]:
    """Maximal runs of letters, with a bounded part of the text cut up at a time."""
    at = 0
    while at < len(text):
        gap = _GAP(text, at + PART)
        end = gap.start() if gap else len(text)
        yield from _RUN(text, at, end)
        at = end


def spellings(doc_id: int | None, text: str, least: int = LEAST_LENGTH, noise: int = NOISE) -> Iterator[tuple[str, int]]:
    """The text's words with their counts; of one in ``noise`` a character is lost."""
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs(text)).items():
        size = len(run)
        if size < least:
            continue
        word = run.lower() if run.isascii() else run.translate(_LOWER)
        hashed = crc32(word.encode(), seed)
        if hashed % noise == 0:
            if size == least:
                continue
            lost = hashed % size
            word = word[:lost] + word[lost + 1 :]
        yield word, n


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return made

        for batch in batches:
            for key, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in spellings(key, one.as_py()):
                    found[word] = found.get(word, 0) + n
                if len(found) >= HELD:
                    yield out()
        if found:
            yield out()

    parts = docs.select(F.col(doc_id), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def steps(words: DataFrame) -> DataFrame:
    """(node, at, char) with the columns of ``words``: a row for each node on a word's path and the child it goes to; char
    is empty where the word ends."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 100):
                yield path(batch.slice(row, 100))

    def path(batch: pa.RecordBatch) -> pa.RecordBatch:
        back, nodes, places, chars = [], [], [], []
        for row, word in enumerate(batch.column(batch.schema.get_field_index("word")).to_pylist()):
            prefix = xxhash.xxh64()
            for at, char in enumerate([*word, ""]):
                back.append(row)
                nodes.append(prefix.intdigest() - (1 << 63))
                places.append(at)
                chars.append(char)
                prefix.update(char.encode())
        at = pa.array(back, pa.int64())
        # only the row's number is repeated here: a long word isn't copied for each of its characters
        keys = batch.column(batch.schema.get_field_index("key")).take(at)
        return pa.RecordBatch.from_arrays([keys, pa.array(nodes, pa.int64()), pa.array(places, pa.int32()), pa.array(chars, pa.string())], ["key", "node", "at", "char"])

    return words.select("word", "key").mapInArrow(run, "key long, node long, at int, char string")


def branches(paths: DataFrame) -> DataFrame:
    """(node, heavy, size, lights): nodes of two children or more, the end of a word counting as one."""
    sizes = paths.groupBy("node", "char").agg(F.count("*").alias("size"))
    real = F.col("char") != ""
    held = sizes.groupBy("node").agg(
        F.max(F.when(real, F.struct("size", "char"))).getField("char").alias("heavy"), F.sum("size").alias("size"), F.count("*").alias("kids"), F.count_if(real).alias("lights")
    )
    return held.where("kids > 1").select("node", "heavy", "size", (F.col("lights") - 1).alias("lights"))


def light(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, at, char, heavy, lights): the places where a word leaves the heavy path."""
    top = nodes.orderBy(F.desc("size"), "node").limit(LARGEST)
    top = cut(top.select("node", "heavy", "lights", F.lit(True).alias("_top")))
    met = paths.join(F.broadcast(top), "node", "left")
    rest = met.where("_top IS NULL").select("key", "node", "at", "char").join(nodes.join(F.broadcast(top.select("node")), "node", "left_anti"), "node")
    columns = ["key", "at", "char", "heavy", "lights"]
    return met.where("_top").select(columns).unionByName(rest.select(columns)).where("char <> heavy")


def _without(word: Column, at: Column, by: Column) -> Column:
    """The word with the character at ``at`` (from 0) replaced."""
    return F.concat(F.left(word, at), by, F.substr(word, at + 2))


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and of these (-n, word) the most frequent, ties in order.

    ``words`` is (key, word, n), read several times; the result is a written table.
    """
    paths = cut(steps(words))
    nodes = cut(branches(paths))
    places = cut(light(paths, nodes).join(words, "key").select("word", "n", "at", "char", "heavy", "lights"))
    drop(paths, nodes)
    word, at, char, heavy = (F.col(c) for c in ("word", "at", "char", "heavy"))
    ends = char == ""
    replaced = F.when(~ends, _without(word, at, heavy))
    skipped = F.when(~ends & (F.substr(word, at + 2, F.lit(1)) != char), _without(word, at, F.lit("")))
    put_in = F.concat(F.left(word, at), heavy, F.substr(word, at + 1))
    tried = places.select("word", "n", F.explode(F.array(replaced, skipped, put_in)).alias("other")).where("other IS NOT NULL")
    met = tried.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    both = met.select(F.explode(F.array(F.struct("word", F.struct((-F.col("m")).alias("n"), F.col("other").alias("word")).alias("by")), F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word")).alias("by")))).alias("p"))
    pairs = both.select("p.word", F.lit(1).cast("long").alias("k"), "p.by")

    masked = places.where((F.col("lights") > 1) & ~ends).select(_without(word, at, F.lit(BLANK)).alias("seen"), F.struct((-F.col("n")).alias("n"), "word").alias("by"))
    groups = masked.groupBy("seen").agg(F.array_sort(F.collect_list("by")).alias("g")).where(F.size("g") > 1)  # at most the alphabet
    each = groups.select("g", F.posexplode("g").alias("i", "me"))
    merged = each.select(F.col("me.word").alias("word"), (F.size("g") - 1).cast("long").alias("k"), F.when(F.col("i") == 0, F.col("g")[1]).otherwise(F.col("g")[0]).alias("by"))
    found = cut(pairs.unionByName(merged).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("by").alias("best")))
    drop(places)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that the forms lead to. Ways are doubled each round; as the counts at
    least double with each form, a few rounds do."""
    held = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = cut(held.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        drop(held)
        held = after.select("word", "root")
        held._written = after._written
        if after.where("moved").limit(1).count() == 0:
            return held


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs``."""
    words = cut(counted(docs, doc_id, text).withColumn("key", F.monotonically_increasing_id()))
    found = near(words)
    most = -F.col("best.n")
    formed = most >= FACTOR * F.col("n")
    held = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, most).alias("form_n"))
    held = cut(held)
    drop(words, found)
    ends = roots(held.where("form IS NOT NULL").select("word", "form"))
    return held.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
