"""Substring dedup by sliding sentence spans.

A text is cut into sentences: at full stops, exclamation and question marks before white space, and at line
ends. In a stretch of more than ``LONG`` words without such an end, further cuts follow words that
their own hash picks, at least ``EDGE`` words from its ends, so that copies of a passage are cut alike
wherever they stand. From every sentence starts one run: the shortest of at least two sentences (or one
of more than ``LONG`` words) with ``least`` words in all. At every sentence ends one more: the shortest of at
least two sentences with ``least`` words. Of a longer repeated passage each sentence is in one of these that the
passage holds whole: in the run from it, or, where that goes on beyond the passage, in the one that ends
with the passage. All runs are hashed and joined over the whole corpus; of equal runs the first (by
document id, then place) stays, and each sentence that another one covers is removed.

Runs are hashed from their words in lower case, so that white space doesn't tell copies apart. Equal
runs are met by grouping with partial sums and a join on the hash, never gathered.

Defined results: null and empty texts have no sentences and come back empty; a null id sorts first; rows with
equal id and text count as one document and are cut alike; rows with an equal id and different texts are
documents of their own, in the order of their texts' hashes; texts of fewer words than a run have none and stay;
other columns are kept unless an output has their name; an empty table stays empty.
"""

from __future__ import annotations

import re
from itertools import accumulate
from zlib import crc32

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, salted

LONG, EDGE, PICK, LEAST = 24, 12, 8, 16
RUNS = "array<struct<hash:binary,at:int,n:int>>"
CUT = "text string, n_sentences long, n_removed long"
_END = re.compile(r"[.!?]+[\"')\]]*\s+|\n\s*").finditer
_WORD = re.compile(r"\S+").finditer


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words in lower case); together they cover the text."""
    out: list[tuple[int, int, list[str]]] = []
    ends = [m.end() for m in _END(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    start = 0
    for end in ends:
        words = text[start:end].lower().split()
        if not words:
            if out:  # white space goes with the sentence before it
                out[-1] = (out[-1][0], end, out[-1][2])
                start = end
            continue
        if len(words) > LONG:
            cuts = [i + 1 for i in range(EDGE, len(words) - EDGE) if crc32(words[i].encode()) % PICK == 0]
            if cuts:
                places = [m.start() for m in _WORD(text[start:end])]
                for a, b in zip([0, *cuts], cuts):
                    out.append((start + (places[a] if a else 0), start + places[b], words[a:b]))
                out.append((start + places[cuts[-1]], end, words[cuts[-1] :]))
                start = end
                continue
        out.append((start, end, words))
        start = end
    return out


def runs(text: str | None, least: int = LEAST) -> list[dict]:
    """The runs that start and end at each sentence: hash, index of the first sentence, number of sentences."""
    units = sentences(text or "")
    held = [w for _, _, words in units for w in words]
    ends = [0, *accumulate(len(words) for _, _, words in units)]
    found: dict[tuple[int, int], None] = {}
    j = 0
    for i, (_, _, words) in enumerate(units):
        if len(words) > LONG:
            found[i, i + 1] = None
            continue
        j = max(j, i + 2)
        while j < len(ends) and ends[j] - ends[i] < least:
            j += 1
        if j < len(ends):
            found[i, j] = None
    i = 0
    for j in range(2, len(ends)):
        while i + 3 <= j and ends[j] - ends[i + 1] >= least:
            i += 1
        if ends[j] - ends[i] >= least:
            found[i, j] = None
    return [{"hash": xxhash.xxh3_128_digest(" ".join(held[ends[i] : ends[j]])), "at": i, "n": j - i} for i, j in found]


def without(text: str | None, spans) -> tuple[str, int, int]:
    """The text without the sentences that spans (at, n) cover, how many there were, and how many went."""
    units = sentences(text or "")
    gone = {k for s in (spans if spans is not None else ()) for k in range(s["at"], s["at"] + s["n"])}
    if not gone:
        return text or "", len(units), 0
    return "".join(text[a:b] for k, (a, b, _) in enumerate(units) if k not in gone), len(units), len(gone)


def _runs_of(texts: pd.Series) -> pd.Series:
    return pd.Series([runs(x) for x in texts], dtype=object)


def _without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([without(x, s) for x, s in zip(texts, spans)], columns=["text", "n_sentences", "n_removed"])


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its text cut, n_sentences and n_removed."""
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    found = docs.select(F.col(doc).alias("id"), key.alias("k"), F.inline(F.pandas_udf(_runs_of, RUNS)(F.col(text))))
    place = F.struct(F.col("id").isNotNull().alias("given"), "id", "k", "at")
    # a run that only identical rows hold has a count above one too, but no later place
    # cut, so that the join is broadcast while it is small, and else a run that very many share is dealt over many tasks
    firsts = cut(found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1"))
    later = salted(found, firsts, "hash", "rows", F.struct("id", "k", "at")).where(place > F.col("first"))
    gone = later.groupBy(F.col("id").alias("_gone_id"), F.col("k").alias("_gone_k")).agg(F.collect_set(F.struct("at", "n")).alias("_gone"))
    held = docs.join(gone, F.col(doc).eqNullSafe(F.col("_gone_id")) & (key == F.col("_gone_k")), "left")
    made = held.withColumn("_cut", F.pandas_udf(_without, CUT)(F.col(text), F.col("_gone")))
    return made.withColumns({text: F.col("_cut.text"), "n_sentences": F.col("_cut.n_sentences"), "n_removed": F.col("_cut.n_removed")}).drop("_gone_id", "_gone_k", "_gone", "_cut")
