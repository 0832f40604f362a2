"""Language-model scoring by a hashed maximum-entropy model.

A text's tokens are its words in lower case and one end. The softmax is factored by class: the end and
the commonest words are classes of their own, all other words fall into classes by their first bytes. A word
within its class is reached by a second softmax, over ``SLOTS`` parts of the class; both follow from hashed
features of what stands before it (the last word, the one before that with a skip, and classes), the second
with the class in each feature. Within its part, of about a two hundred and fiftieth of the words, a word has the
probability that the corpus counts give.

Training: word counts over all training documents are summed by Spark and stay distributed. The weights
are fitted in rounds, each over another slice of the training documents; tasks add up the observed and
expected counts of their documents, Spark sums these by block, and the driver moves the weights of
fixed size (``TEMPLATES * BUCKETS * (CLASSES + SLOTS)`` numbers). A task's sums have that size too, 5 MB before
compression, for each part of the table that it reads, 128 MB by default; what is shuffled is thus a small share
of the input.

Scoring: numpy over batches with sparse features. The ``FREQUENT`` commonest words, proven to be no more by a
histogram, are sent to all tasks; the counts of all other words are joined by shuffle, so every score uses
exact counts.

Defined results: null and empty texts are one end token; null ids are never held out; repeated rows are
scored one by one; an empty table gives no rows; a training set without documents leaves all counts at 0.
Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, tidy

END = b""
OWN, LETTER_CLASSES, SLOTS = 16, 16, 16
CLASSES = OWN + LETTER_CLASSES
BUCKETS, TEMPLATES, BLOCK = 4096, 3, 1 << 14
FREQUENT, WORD_BYTES = 1 << 17, 64
ROUNDS, SMOOTH, RATE, GROUP, CHUNK = 3, 4.0, 0.5, 600_000, 2048


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def slice_of(doc: Column, rounds: int) -> Column:
    return F.coalesce(F.floor(F.crc32(doc.cast("string").cast("binary")) / 10) % rounds, F.lit(0))


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter = Counter()
    for frame in frames:
        for text in frame["text"]:
            held.update(tokens(text))
            if len(held) > 300_000:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
    yield pd.DataFrame({"word": list(held), "n": list(held.values())})


def count(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts."""
    return docs.select("text").mapInPandas(tidy(_counts), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lookup(dict):
    """Index of a frequent word, else -1."""

    def __missing__(self, word):
        return -1


class Vocabulary:
    """What every task holds of the counts: the frequent words, the totals of the classes' parts, the size of the whole."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, parts: dict[tuple[int, int], tuple[int, int]]):
        order = sorted(range(len(words)), key=lambda i: (words[i] != END, -counts[i], words[i]))
        self.words, n = [words[i] for i in order], np.array([counts[i] for i in order], np.float64)
        self.total, self.distinct = total, distinct
        self.hashes = np.array([crc32(w) for w in self.words], np.uint32)
        own = np.arange(len(self.words)) < OWN
        by_letters = np.array([letter_class(w) for w in self.words], np.int64)
        self.classes = np.where(own, np.arange(len(self.words)), by_letters) if len(self.words) else by_letters
        self.logs = np.log10(n + 0.1)
        sums, kinds = np.zeros((CLASSES, SLOTS)), np.zeros((CLASSES, SLOTS))
        for at, (total_of, n_of) in parts.items():
            sums[at], kinds[at] = total_of, n_of
        first = (by_letters[:OWN], slots(self.hashes[:OWN]))
        np.subtract.at(sums, first, n[:OWN])
        np.subtract.at(kinds, first, 1)
        #: A word's log10 probability within its part is log10(c + 0.1) less this; 0 in all for own classes.
        self.within = np.log10(sums + 0.1 * (kinds + 1))
        self.within[: min(OWN, len(self.words))] = self.logs[:OWN, None]
        prior = sums.sum(1)
        prior[: min(OWN, len(self.words))] = n[:OWN]
        self.bias = np.log((prior + 0.5) / (prior + 0.5).sum()).astype(np.float32)
        self.bias_within = np.log((sums + 0.5) / (sums + 0.5).sum(1, keepdims=True)).astype(np.float32)

    def lookup(self) -> Lookup:
        return Lookup(zip(self.words, range(len(self.words))))


def letter_class(word: bytes) -> int:
    return OWN + crc32(word[:2]) % LETTER_CLASSES


def slots(hashes):
    """The part of its class that a word is in, from its hash."""
    return (hashes >> 12) & (SLOTS - 1)


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    level = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    room, least = frequent, None
    for at, n in steps:
        if (room := room - n) < 0:
            break
        least = at
    chosen = counts.where(((level >= least) if least is not None else F.lit(False)) & (F.octet_length("word") <= WORD_BYTES) | (F.col("word") == END))
    table = chosen.toPandas()
    rest = (F.crc32(F.substring("word", 1, 2)) % LETTER_CLASSES + OWN).cast("int")
    slot = F.shiftright(F.crc32("word"), 12).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    parts = {(r["k"], r["p"]): (r["s"], r["v"]) for r in counts.groupBy(rest.alias("k"), slot.alias("p")).agg(F.sum("n").alias("s"), F.count("*").alias("v")).collect()}  # LETTER_CLASSES * SLOTS rows at most
    return Vocabulary([bytes(w) for w in table["word"]], table["n"].tolist(), sum(s for s, _ in parts.values()), sum(v for _, v in parts.values()), parts)


class Coded:
    """A group of texts as numbers: for each token its class, log count and features."""

    def __init__(self, texts: list[list[bytes]], known: Vocabulary, lookup: Lookup):
        flat = [w for words in texts for w in words]
        self.sizes = np.array([len(words) for words in texts])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        index = np.fromiter(map(lookup.__getitem__, flat), np.int32, len(flat))
        self.rare = np.flatnonzero(index < 0)
        self.rare_words = [flat[i] for i in self.rare]
        if len(known.words):
            hashes, self.classes, self.logs = known.hashes[index], known.classes[index], known.logs[index]
        else:
            hashes, self.classes, self.logs = np.zeros(len(flat), np.uint32), np.zeros(len(flat), np.int64), np.zeros(len(flat))
        hashes[self.rare] = [crc32(w) for w in self.rare_words]
        self.classes[self.rare] = [letter_class(w) for w in self.rare_words]
        self.logs[self.rare] = 0
        place = np.arange(len(flat)) - np.repeat(self.starts, self.sizes)

        def back(values, k):
            out = np.roll(values, k)
            out[place < k] = 0  # the end's class and hash, as what stands before a text
            return out

        h1, h2 = back(hashes, 1), back(hashes, 2)
        mix = lambda h, by: ((h * np.uint32(by)) >> np.uint32(20)).astype(np.int64)
        before = back(self.classes, 1)
        self.features = np.stack([mix(h1, 2654435761), mix(h2, 2246822519), before * CLASSES + back(self.classes, 2)])
        #: Tokens whose class has more than one word, their part of it, and the features of that.
        self.inner = np.flatnonzero(self.classes >= OWN)
        own = self.classes[self.inner]
        self.slots = slots(hashes[self.inner]).astype(np.int64)
        by = own.astype(np.uint32) * np.uint32(0x9E3779B1)
        self.inner_features = np.stack([mix(h1[self.inner] ^ by, 2654435761), mix(h2[self.inner] ^ by, 2246822519), before[self.inner] * CLASSES + own])


def grouped(texts: list[str | None], most: int = GROUP) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first index, tokens of each text) for groups of about ``most`` characters; a longer text is a group by itself."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "") + 1
        if held and held + size > most:
            yield first, [tokens(x) for x in texts[first:i]]
            first, held = i, 0
        held += size
    if held:
        yield first, [tokens(x) for x in texts[first:]]


def log_weights(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Unnormalised log weights of each outcome for a chunk of tokens, the largest of a token at 0."""
    s = weights[0][features[0]]
    for t in range(1, TEMPLATES):
        s += weights[t][features[t]]
    s += bias
    s -= s.max(1, keepdims=True)
    return s


SIZES = (TEMPLATES * BUCKETS * CLASSES, TEMPLATES * BUCKETS * SLOTS)


def weights_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the classes and of the parts, from one array of numbers."""
    return flat[: SIZES[0]].reshape(TEMPLATES, BUCKETS, CLASSES), flat[SIZES[0] :].reshape(TEMPLATES, BUCKETS, SLOTS)


def _expect(meant: np.ndarray, features: np.ndarray, p: np.ndarray) -> None:
    """Add each token's probabilities to the rows of its features."""
    for t in range(TEMPLATES):
        order = np.argsort(features[t].astype(np.uint16), kind="stable")
        held = features[t][order]
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        meant[t, held[first]] += np.add.reduceat(p[order], first)


def gradients(known, weights):
    """A task's observed and expected counts, by block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, w = known.value, weights.value
        lookup, learned = vocabulary.lookup(), weights_of(w)
        seen, meant = np.zeros(sum(SIZES)), np.zeros(sum(SIZES), np.float32)
        seen_of, meant_of, even = weights_of(seen), weights_of(meant), not w.any()
        for frame in frames:
            for _, group in grouped(frame["text"].tolist()):
                coded = Coded(group, vocabulary, lookup)
                held = ((coded.features, coded.classes, vocabulary.bias[None]), (coded.inner_features, coded.slots, vocabulary.bias_within[coded.classes[coded.inner]]))
                for k, (features, outcome, bias) in enumerate(held):
                    width = seen_of[k].shape[2]
                    for t in range(TEMPLATES):
                        seen_of[k][t] += np.bincount(features[t] * width + outcome, minlength=BUCKETS * width).reshape(BUCKETS, width)
                    if even and k == 0:  # without weights every token has the same probabilities
                        p = np.exp(bias[0]) / np.exp(bias[0]).sum()
                        for t in range(TEMPLATES):
                            meant_of[0][t] += np.bincount(features[t], minlength=BUCKETS)[:, None] * p
                        continue
                    for a in range(0, len(outcome), CHUNK):
                        f, b = features[:, a : a + CHUNK], bias if len(bias) == 1 else bias[a : a + CHUNK]
                        p = log_weights(learned[k], b, f)
                        np.exp(p, out=p)
                        p /= p.sum(1, keepdims=True)
                        _expect(meant_of[k], f, p)
        a, b = (x.astype(np.float32).reshape(-1, BLOCK) for x in (seen, meant))
        yield pd.DataFrame({"block": range(len(a)), "seen": [x.tobytes() for x in a], "meant": [x.tobytes() for x in b]})

    return run


def _sum_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of each block, for rows in any order; a task holds its blocks' sums only."""
    sums: dict[int, list[np.ndarray]] = {}
    for frame in frames:
        for block, *parts in frame[["block", "seen", "meant"]].itertuples(index=False):
            held = sums.setdefault(block, [np.zeros(BLOCK), np.zeros(BLOCK)])
            for x, part in zip(held, parts):
                x += np.frombuffer(part, np.float32)
    yield pd.DataFrame({"block": list(sums), "seen": [x.astype(np.float32).tobytes() for x, _ in sums.values()], "meant": [y.astype(np.float32).tobytes() for _, y in sums.values()]})


def fit(docs: DataFrame, known, doc: str, rounds: int = ROUNDS) -> np.ndarray:
    """The weights after one round over each slice of the training documents."""
    context = docs.sparkSession.sparkContext
    weights = np.zeros(sum(SIZES), np.float32)
    schema = "block int, seen binary, meant binary"
    for k in range(rounds):
        sent = context.broadcast(weights)
        part = docs.where(slice_of(F.col(doc), rounds) == k).select("text")
        blocks = part.mapInPandas(tidy(gradients(known, sent)), schema).repartition("block").mapInPandas(_sum_blocks, schema).collect()
        seen, meant = np.zeros_like(weights).reshape(-1, BLOCK), np.zeros_like(weights).reshape(-1, BLOCK)
        for r in blocks:
            seen[r["block"]], meant[r["block"]] = np.frombuffer(r["seen"], np.float32), np.frombuffer(r["meant"], np.float32)
        weights = weights + ((seen - meant) / (np.maximum(seen, meant) + SMOOTH) * RATE).ravel()
    return weights


SCORED = "row long, id {id}, n_tokens long, known long, logs double, classed double, words array<binary>, times array<int>"


def scores(known, weights):
    """Each text's sums over its tokens, and its words that aren't frequent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, learned = known.value, weights_of(weights.value)
        lookup = vocabulary.lookup()
        for frame in frames:
            for first, group in grouped(frame["text"].tolist()):
                coded = Coded(group, vocabulary, lookup)
                part = np.zeros(len(coded.classes), np.int64)
                part[coded.inner] = coded.slots
                classed = -vocabulary.within[coded.classes, part]
                every = np.arange(len(part))
                held = ((coded.features, coded.classes, vocabulary.bias[None], every), (coded.inner_features, coded.slots, vocabulary.bias_within[coded.classes[coded.inner]], coded.inner))
                for k, (features, outcome, bias, at) in enumerate(held):
                    for a in range(0, len(outcome), CHUNK):
                        c = outcome[a : a + CHUNK]
                        sums = log_weights(learned[k], bias if len(bias) == 1 else bias[a : a + CHUNK], features[:, a : a + CHUNK])
                        own = sums[np.arange(len(c)), c]
                        classed[at[a : a + CHUNK]] += (own - np.log(np.exp(sums, out=sums).sum(1))) / np.log(10)
                out = frame.iloc[first : first + len(group)][["row", "id"]].copy()
                out["n_tokens"] = coded.sizes
                flags = np.ones(len(coded.classes), np.int64)
                flags[coded.rare] = 0
                out["known"] = np.add.reduceat(flags, coded.starts)
                out["logs"] = np.add.reduceat(coded.logs, coded.starts)
                out["classed"] = np.add.reduceat(classed, coded.starts)
                ends = np.searchsorted(coded.rare, coded.starts + coded.sizes)
                rare = [Counter(coded.rare_words[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
                out["words"], out["times"] = [list(x) for x in rare], [list(x.values()) for x in rare]
                yield out

    return run


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """One row for each of ``docs``: the id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"))
    training = rows.where(~held_out(F.col("id")))
    counts = cut(count(training))
    size = vocabulary(counts, frequent)
    known = context.broadcast(size)
    weights = context.broadcast(fit(training, known, "id", rounds))
    kind = rows.schema["id"].dataType.simpleString()
    # The row numbers hold from here on, since the scored rows are kept.
    scored = cut(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text").mapInPandas(tidy(scores(known, weights)), SCORED.format(id=kind)))
    rare = scored.select("row", F.inline(F.arrays_zip("words", "times")).alias("word", "times"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) + 1)).alias("above"))
    missed = F.col("known") - F.col("n_tokens")  # each unknown word has log10(0.1) = -1
    logs = F.col("logs") + missed + F.coalesce("above", F.lit(0.0))
    out = scored.join(found, "row", "left")
    return out.select(
        F.col("id").alias(doc),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(size.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(size.total + 0.1 * (size.distinct + 1))))).alias("base_score"),
        (logs + F.col("classed")).alias("score"),
    )
