"""N-gram Jaccard join with count vectors.

A document's set holds the 64-bit hashes of its distinct runs of ``WORDS`` words. Documents with equal sets
are one node from the start, named by their smallest id. A node's tokens are hashed into groups, and the
counts of the groups are its point; the sum of the smaller coordinates of two points bounds the overlap of
their sets, so that most pairs fall without their sets being read. Points are made in the first pass.

Which points can meet at all: sorted by one order over all tokens (the corpus' heavy ones last), two
linked sets share one of their first n - ceil(0.8 n) + 1 tokens. Each such token is a cell, a part of the
index that one task can hold. Only nodes are posted to cells, once. Cells with the same members are one. In a
cell every member is first tried with one pivot, which connects groups of near copies without writing out
their pairs. Cells that still hold several components then get an R-tree over their points, with the largest
corner of each leaf: leaf pairs whose corners can't reach the overlap that their sizes need are passed over,
the others give the pairs of different components that the bound leaves, first over few groups, then over
all. What is left is bounded once more over ``SPREAD`` groups for each token, kept as gaps between filled
groups, and then verified on whole sets; components follow by alternating stars.

Skew: the tokens' counts are known before they are posted, so the cell of a token that more than 2 ** ``HOT``
places hold is dealt to several tasks from the start and put together from their counts. A cell with more
than ``BLOCK`` members is dealt to trees as pairs of blocks; no task holds more than two blocks, and no pair is
left out. Pairs are verified in a stream: one text of a pair is sent with each pair, the other once for
``DEAL`` pairs. Ids of nodes and copies are broadcast up to ``BROADCAST_ROWS``, else joined.

Sets are hashes: two runs of words with one 64-bit hash count as equal. Among 10 ** 4 tokens of a pair that is
one chance in 10 ** 11; it is the only way in which a result could differ from that on the words themselves.
Cells hold 48 bits of a hash; a clash there only costs a try.

Defined results: a null or empty text has no shingles and stays alone; fewer words than a run are one shingle;
a null id has a null component and links with nothing; rows with equal ids are one document, which links by each of
its texts and has the number of shingles of the one with the greatest hash; very long texts are read whole; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, tidy

WORDS, SHARE = 5, 80
SLOTS = 1 << 20
BLOCK, LEAF, BROADCAST_ROWS = 2048, 32, 500_000
HOT, SPREAD, DEAL = 17, 16, 256
FINE, FOLDS = 2, 4  # tokens in a group of a point, and how many of these groups are one in the tree's boxes
GROUP_BYTES, CHUNK, FRAME = 1 << 18, 1 << 18, 50_000
FACTOR = 0x9E3779B97F4A7C15
_MIX = ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53))


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in _MIX:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of many texts at once: word hashes from running sums over the bytes, shingles from word hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.up = words, np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, GROUP_BYTES * 2)
            up, down = np.full(n, FACTOR, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The sorted distinct hashes of each text."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            data = (text or "").encode().lower()
            if group and size + len(data) > GROUP_BYTES:
                yield from self._sets(group)
                group, size = [], 0
            group.append(data)
            size += len(data) + 1
        if group:
            yield from self._sets(group)

    def _sets(self, group: list[bytes]) -> Iterator[np.ndarray]:
        raw = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        ends = ends[: len(starts)]
        self.powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        lengths = np.array([len(d) + 1 for d in group])
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        k, n = self.words, len(hashes)
        runs = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k):
            runs = runs * np.uint64(FACTOR) + hashes[i : n - k + 1 + i] if n >= k else runs
        runs = mixed(runs)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=k)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def groups_for(n: int) -> int:
    """Number of token groups for a set: about ``FINE`` tokens in one, a power of two."""
    return 1 << max(3, min(14, (max(n, 1) // FINE).bit_length()))


def point(tokens: np.ndarray) -> np.ndarray:
    g = groups_for(len(tokens))
    return np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (g - 1), minlength=g)


def packed(p: np.ndarray) -> bytes:
    """A point in half bytes, bytes or words: the smallest that hold its counts."""
    if p.max() < 16:
        q = p.astype(np.uint8)
        return (q[0::2] | (q[1::2] << 4)).tobytes()
    return p.astype(np.uint8 if p.max() < 256 else np.uint32).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    g = groups_for(n)
    if 2 * len(data) == g:
        raw, out = np.frombuffer(data, np.uint8), np.empty(g, np.int32)
        out[0::2], out[1::2] = raw & 15, raw >> 4
        return out
    return np.frombuffer(data, np.uint8 if len(data) == g else np.uint32).astype(np.int32)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point over fewer groups."""
    return p.reshape(-1, groups).sum(0)


def coarser(held: np.ndarray, groups: int) -> np.ndarray:
    """Points in rows over fewer groups."""
    return held.reshape(len(held), -1, groups).sum(1, dtype=np.int32)


def needed(a, b, share: int = SHARE):
    """Smallest overlap of linked sets with these sizes."""
    return -((-share * (a + b)) // (100 + share))


def may_link(p: np.ndarray, q: np.ndarray, a: int, b: int) -> bool:
    if 100 * min(a, b) < SHARE * max(a, b):
        return False
    g = min(len(p), len(q))
    return int(np.minimum(folded(p, g), folded(q, g)).sum()) >= needed(a, b)


def prefix(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    n = len(tokens)
    most = n + (-SHARE * n) // 100 + 1
    order = np.argsort(levels[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")
    return tokens[order[:most]]


def sketch(tokens: np.ndarray) -> bytes:
    """A point over about ``SPREAD`` groups for each of the sorted tokens: gaps between the filled groups, a byte for each token."""
    gaps = np.diff(tokens >> np.uint64(64 - _depth(len(tokens))), prepend=np.uint64(0))
    wide = gaps >= 255
    return np.minimum(gaps, 255).astype(np.uint8).tobytes() + gaps[wide].astype(np.uint32).tobytes()


def _depth(n: int) -> int:
    return max(8, min(31, (max(n, 1) * SPREAD).bit_length()))


def filled(data: bytes, n: int) -> np.ndarray:
    """The group of each token, in order, from a sketch of n tokens."""
    gaps = np.frombuffer(data, np.uint8, n).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, np.uint32, -1, n)
    return np.cumsum(gaps)


def meeting(x: np.ndarray, y: np.ndarray) -> int:
    """The sum of the smaller counts over all groups, from the tokens' groups in order."""

    def apart(v):  # the k-th token of a group gets a place of its own
        at = np.arange(len(v))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], v[1:] != v[:-1]]), at, 0))
        return (v << 32) + at - first

    both = np.sort(np.concatenate([apart(x), apart(y)]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def close(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> bool:
    """Whether sketches (size, groups) leave an overlap that is large enough."""
    (n, u), (m, v) = x, y
    shift = _depth(n) - _depth(m)
    return meeting(u >> max(0, shift), v >> max(0, -shift)) >= needed(n, m)


FACTS = "id long, k long, n long, digest binary, point binary, slot int, seen long"
CELLS = "key long, id long"


def _facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text, and at the end one for each slot that is heavy in this task."""
    shingler, seen, total = Shingler(), np.zeros(SLOTS, np.int64), 0
    held: list[np.ndarray] = []
    waiting = 0

    def count() -> None:
        if held:
            np.add(seen, np.bincount((np.concatenate(held) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS), out=seen)
            held.clear()

    for frame in frames:
        rows = []
        for tokens in shingler.sets(frame["text"].tolist()):
            held.append(tokens)
            total, waiting = total + len(tokens), waiting + len(tokens)
            if waiting > SLOTS:
                count()
                waiting = 0
            rows.append((len(tokens), xxhash.xxh3_128_digest(tokens.tobytes()), packed(point(tokens))))
        out = pd.DataFrame(rows, columns=["n", "digest", "point"])
        out.insert(0, "id", frame["id"].to_numpy())
        out.insert(1, "k", frame["k"].to_numpy())
        yield out.assign(slot=pd.array([None] * len(out), dtype="Int32"), seen=pd.array([None] * len(out), dtype="Int64"))
    count()
    heavy = np.flatnonzero(seen > 2 * total / SLOTS + 8)
    none = [None] * len(heavy)
    yield pd.DataFrame({"id": pd.array(none, dtype="Int64"), "k": pd.array(none, dtype="Int64"), "n": pd.array(none, dtype="Int64"), "digest": none, "point": none, "slot": pd.array(heavy, dtype="Int32"), "seen": pd.array(seen[heavy], dtype="Int64")})


def _cells(levels, hot: int):
    """(key, id): the first tokens of each set as cells, 48 bits, and 16 that deal a hot token's cell (0: not dealt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held = Shingler(), np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            made = [prefix(x, held) if len(x) else x for x in shingler.sets(batch.column(1).to_pylist())]
            ids = np.repeat(batch.column(0).to_numpy(), [len(m) for m in made])
            tokens = np.concatenate(made) if made else np.zeros(0, np.uint64)
            over = np.maximum(held[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.int64) - hot, 0)
            deal = mixed(ids.view(np.uint64)) & ((np.uint64(1) << np.minimum(over, 15).astype(np.uint64)) - np.uint64(1))
            keys = (tokens >> np.uint64(16) << np.uint64(16)) | np.where(over > 0, deal + np.uint64(1), np.uint64(0))
            for a in range(0, len(ids), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 20)].view(np.int64)), pa.array(ids[a : a + (1 << 20)])], ["key", "id"])

    return run


def _sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for frame in frames:
        rows = [(len(x), sketch(x)) for x in shingler.sets(frame["text"].tolist())]
        out = pd.DataFrame(rows, columns=["n", "value"])
        out.insert(0, "id", frame["id"].to_numpy())
        yield out


def linked(x: np.ndarray, y: np.ndarray, share: int = SHARE) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= share * (len(x) + len(y) - both)


def _streamed(read, test):
    """Pairs that pass a test, from rows in the order (a, deal, b): each part has a's own row first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for frame in frames:
            left, right, keep = frame["a"].tolist(), frame["b"].tolist(), []
            for i, value in enumerate(read(frame)):
                if right[i] is None or right[i] != right[i]:  # null sorts first
                    own = value
                elif test(own, value):
                    keep.append((left[i], int(right[i])))
            yield pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    return run


def _texts(frame: pd.DataFrame) -> Iterator[np.ndarray]:
    return Shingler().sets(frame["value"].tolist())


def _filled(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for data, n in zip(frame["value"], frame["n"].tolist()):
        yield n, filled(data, n)


def _near(p: pd.Series, q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([may_link(unpacked(x, n), unpacked(y, m), n, m) for x, y, n, m in zip(p, q, a, b)], dtype=bool)


class Tree:
    """An R-tree of points, packed in the order of their set sizes: leaves of ``LEAF``, and a parent for each ``LEAF`` leaves."""

    def __init__(self, sizes: np.ndarray, points: list[np.ndarray]):
        self.leaves, self.parents = [], []
        for a in range(0, len(points), LEAF):
            g = min(len(p) for p in points[a : a + LEAF])
            whole = np.stack([p if len(p) == g else folded(p, g) for p in points[a : a + LEAF]])
            held = coarser(whole, max(8, g // FOLDS))
            whole = whole.astype(np.uint16 if whole.max() < 1 << 16 else np.uint32)
            self.leaves.append((held.max(0), int(sizes[a]), int(sizes[a : a + LEAF][-1]), held, a, whole))
        for a in range(0, len(self.leaves), LEAF):
            under = self.leaves[a : a + LEAF]
            g = min(len(x[0]) for x in under)
            self.parents.append((np.stack([folded(x[0], g) for x in under]).max(0), under[0][1], under[-1][2], under))

    @staticmethod
    def reach(x, y) -> bool:
        """Whether two boxes, by largest corner and range of sizes, can hold a linked pair."""
        if 100 * x[2] < SHARE * y[1] or 100 * y[2] < SHARE * x[1]:
            return False
        g = min(len(x[0]), len(y[0]))
        return int(np.minimum(folded(x[0], g), folded(y[0], g)).sum()) >= needed(x[1], y[1])

    def leaf_pairs(self, other: Tree) -> Iterator[tuple]:
        for x in self.parents:
            for y in other.parents:
                if self.reach(x, y):
                    for p in x[3]:
                        for q in y[3]:
                            if (self is not other or q[4] >= p[4]) and self.reach(p, q):
                                yield p, q


def pairs_of(left, right=None) -> Iterator[np.ndarray]:
    """Pairs (smaller, larger id) of different components that the bound leaves, a few rows at a time; right None: within left.

    Sides have columns n, id, label, point.
    """
    made = []
    for side in (left, right) if right is not None else (left,):
        n, ids, labels, data = (np.asarray(side[c]) for c in ("n", "id", "label", "point"))
        order = np.lexsort((ids, n))
        n = n[order]
        made.append((n, ids[order], labels[order], Tree(n, [unpacked(x, k) for x, k in zip(data[order], n.tolist())])))
    (n, ids, labels, tree), (m, others, marks, second) = made[0], made[-1]
    for p, q in tree.leaf_pairs(second):
        g = min(p[3].shape[1], q[3].shape[1])
        a, b = coarser(p[3], g), coarser(q[3], g)
        i, j = np.arange(p[4], p[4] + len(a)), np.arange(q[4], q[4] + len(b))
        bound = np.minimum(a[:, None], b[None]).sum(2)
        fits = (bound >= needed(n[i][:, None], m[j][None])) & (labels[i][:, None] != marks[j][None])
        fits &= 100 * np.minimum(n[i][:, None], m[j][None]) >= SHARE * np.maximum(n[i][:, None], m[j][None])
        if right is None:
            fits &= i[:, None] < j[None]
        us, vs = np.nonzero(fits)
        if not len(us):
            continue
        g = min(p[5].shape[1], q[5].shape[1])
        a, b = coarser(p[5], g), coarser(q[5], g)
        some = max(1, CHUNK // g)  # pairs whose whole points are held against each other at a time
        bound = np.concatenate([np.minimum(a[us[k : k + some]], b[vs[k : k + some]]).sum(1) for k in range(0, len(us), some)])
        near = bound >= needed(n[i][us], m[j][vs])
        if near.any():
            yield np.sort(np.stack([ids[i[us[near]]], others[j[vs[near]]]], 1), 1)


CELL = ("cell", "one", "two")
SIDE = ("n", "id", "label", "side", "point")


def _residual(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs to verify, from rows in the order of their cells; a cell's rows may come in several frames."""
    held: list[dict] = []
    last = None

    def close() -> Iterator[pd.DataFrame]:
        """A cell's pairs, in frames of bounded size; Spark drops those that other cells give too."""
        whole = {c: np.concatenate([h[c] for h in held]) if len(held) > 1 else held[0][c] for c in SIDE}
        if last[1] == last[2]:
            found = pairs_of(whole)
        else:
            one, two = (whole["side"] == k for k in last[1:])
            found = pairs_of({c: v[one] for c, v in whole.items()}, {c: v[two] for c, v in whole.items()}) if one.any() and two.any() else ()
        for pairs in found:
            waiting.append(pairs)
            if sum(map(len, waiting)) > FRAME:
                yield flushed()

    def flushed() -> pd.DataFrame:
        pairs = np.unique(np.concatenate(waiting), axis=0) if waiting else np.zeros((0, 2), np.int64)
        waiting.clear()
        return pd.DataFrame(pairs, columns=["a", "b"])

    waiting: list[np.ndarray] = []
    for frame in frames:
        columns = {c: frame[c].to_numpy() for c in SIDE}
        keys = np.stack([frame[c].to_numpy(np.int64) for c in CELL], 1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else keys[:0, 0]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            key = tuple(keys[a].tolist())
            if key != last and held:
                yield from close()
                held = []
            last = key
            held.append({c: v[a:b] for c, v in columns.items()})
    if held:
        yield from close()
    yield flushed()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), by alternating large and small stars."""
    held = cut(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct())
    state = None
    while True:
        both = held.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(held.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        last, held = held, cut(small)
        drop(last)
        now = held.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            found = held.withColumnsRenamed({"a": "node", "b": "component"})
            found._written = held._written
            return found
        state = now


def posted(nodes: DataFrame, sent, hot: int = HOT, repeated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members (cell, id) of the cells with several nodes, of cells with equal members one, and those cells (cell, members, pivot).

    The postings are shuffled once and never written: a window counts each key's, and what stands alone goes there.
    """
    rows = nodes.mapInArrow(tidy(_cells(sent, hot)), CELLS).repartition("key")
    rows = rows.distinct() if repeated else rows
    key = Window.partitionBy("key")
    counted = {"members": F.count("*"), "pivot": F.min("id"), "x": F.bit_xor(F.xxhash64("id")), "y": F.bit_xor(F.xxhash64("id", F.lit(1)))}
    dealt = F.col("key").bitwiseAND(F.lit(0xFFFF)) != 0
    kept = cut(rows.withColumns({name: value.over(key) for name, value in counted.items()}).where(dealt | (F.col("members") > 1)))
    parts = kept.drop("id").distinct().withColumn("cell", F.shiftleft(F.shiftright("key", 16), 16))
    whole = parts.where(dealt).groupBy("cell").agg(F.sum("members").alias("members"), F.min("pivot").alias("pivot"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    cells = parts.where(~dealt).select(*whole.columns).unionByName(whole.where("members > 1"))
    cells = cut(cells.groupBy("members", "x", "y").agg(F.min("cell").alias("cell"), F.min("pivot").alias("pivot")).drop("x", "y"))
    keys = parts.select("key", "cell").join(cells.select("cell"), "cell", "left_semi")
    members = cut(kept.select("key", "id").join(keys, "key").select("cell", "id"))
    drop(kept)
    return members, cells


def join(docs: DataFrame, doc: str = "doc_id", text: str = "text", hot: int = HOT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of ``docs``.

    Of an id with different texts, all but one get a number of their own beyond all ids; what their texts link is then
    put together with what the id's other text links.
    """
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k"), F.col(text).alias("text"))
    keys = rows.where("id IS NOT NULL").groupBy("id").agg(F.max("k").alias("top"), F.min("k").alias("low"))
    several = cut(keys.where("low <> top").select("id", "top"))
    if several.isEmpty():
        drop(several)
        return _joined(docs, doc, text, hot, broadcast_rows)
    base = keys.agg(F.max("id")).first()[0] + 1
    spare = rows.join(several, "id").where("k <> top").dropDuplicates(["id", "k"])
    spare = cut(spare.select((F.monotonically_increasing_id() + base).alias("own"), "id", "text"))
    main = rows.join(several, "id", "left").where("top IS NULL OR k = top").select("id", "text")
    found = cut(_joined(main.unionByName(spare.select(F.col("own").alias("id"), "text")), "id", "text", hot, broadcast_rows))
    each = found.where("id IS NOT NULL").select("id", "n_shingles", "component_id").dropDuplicates(["id"])
    by = lambda key, name: each.select(F.col("id").alias(key), F.col("component_id").alias(name))
    labels = components(spare.join(by("own", "a"), "own").join(by("id", "b"), "id").select("a", "b"))
    whole = each.join(labels.withColumnRenamed("node", "component_id"), "component_id", "left")
    whole = cut(whole.select("id", "n_shingles", F.coalesce("component", "component_id").alias("component_id")))
    lone = found.where("id IS NULL")
    out = rows.select("id").where("id IS NOT NULL").join(whole, "id").unionByName(lone)
    drop(several, spare, labels)
    return out.select(F.col("id").alias(doc), "n_shingles", "component_id")


def _joined(docs: DataFrame, doc: str, text: str, hot: int, broadcast_rows: int) -> DataFrame:
    """As ``join``, where of an id's texts the one with the greatest hash counts."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k"), F.col(text).alias("text"))
    given = rows.where("id IS NOT NULL")
    table = cut(rows.mapInPandas(tidy(_facts), FACTS))
    levels = np.zeros(SLOTS, np.uint8)
    for r in table.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("seen").alias("seen")).collect():  # SLOTS rows at most
        levels[r["slot"]] = int(r["seen"]).bit_length()
    sent = context.broadcast(levels.tobytes())
    texts = table.where("slot IS NULL")
    facts = texts.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("k", "n", "digest", "point")).alias("f"), F.count("*").alias("copies")).select("id", "copies", "f.*")
    each = cut(facts)
    # cut as well, so that the join on a digest that very many share is broadcast while it is small, and else split
    reps = cut(each.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("alike")).where("alike > 1").drop("alike"))
    facts = cut(each.join(reps, "digest", "left").select("id", "k", "n", "copies", "point", F.coalesce("rep", "id").alias("rep")))
    drop(each, reps)
    is_node = (F.col("id") == F.col("rep")) & (F.col("n") > 0)
    nodes, points = facts.where(is_node).select("id", "k", "copies"), facts.where(is_node).select("id", "n", "point")
    others = facts.where(~is_node).select("id")
    fetch = _Fetch(given, nodes, broadcast_rows)

    few = others.count() <= broadcast_rows
    first = given.join(F.broadcast(others) if few else others, "id", "left_anti").select("id", "text")
    repeated = (facts.agg(F.max("copies")).first()[0] or 0) > 1
    members, cells = posted(first, sent, hot, repeated)
    tried = members.join(cells.select("cell", F.col("pivot").alias("a")), "cell").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    tried = cut(tried)
    edges = fetch.verified(bounded(tried, points))
    labels = components(edges)
    held = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    mixed_cells = held.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cell")
    held = held.join(cells.join(mixed_cells, "cell", "left_semi").select("cell", "members"), "cell").join(points, "id")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    held = held.withColumn("side", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    held = held.select("cell", "id", "label", "n", "point", "side", F.least("side", "with").alias("one"), F.greatest("side", "with").alias("two"))
    more = held.repartition("cell", "one", "two").sortWithinPartitions("cell", "one", "two").mapInPandas(tidy(_residual), "a long, b long")
    more = cut(more.distinct().join(tried, ["a", "b"], "left_anti"))
    drop(members, cells, tried, labels)
    both = cut(edges.unionByName(fetch.verified(fetch.nearer(more))))
    drop(edges, more)
    labels = components(both)
    drop(both)
    found = facts.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    found = cut(found)
    lone = cut(texts.where("id IS NULL").select("id", "n", F.lit(None).cast("long").alias("component")))
    drop(facts, labels, table)
    out = rows.select("id").where("id IS NOT NULL").join(found, "id").unionByName(lone)
    return out.select(F.col("id").alias(doc), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs whose sizes and fine points leave an overlap that is large enough."""
    side = lambda name, n, p: points.select(F.col("id").alias(name), F.col("n").alias(n), F.col("point").alias(p))
    sizes = lambda name, n: points.select(F.col("id").alias(name), F.col("n").alias(n))
    sized = pairs.join(sizes("a", "n"), "a").join(sizes("b", "m"), "b").where(f"100 * least(n, m) >= {SHARE} * greatest(n, m)").select("a", "b")
    both = sized.join(side("a", "n", "p"), "a").join(side("b", "m", "q"), "b")
    return both.where(F.pandas_udf(_near, "boolean")("p", "q", "n", "m")).select("a", "b")


class _Fetch:
    """Pairs of nodes held against each other on what is read from their texts."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, broadcast_rows: int):
        self.texts, self.nodes, self.broadcast_rows = texts, nodes, broadcast_rows

    def of(self, pairs: DataFrame) -> DataFrame:
        """(id, text) of the pairs' nodes, a row for each: one scan of the texts, and one more for ids with several rows."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = cut(ids.join(self.nodes, "id").select("id", "k", "copies"))
        size, most = wanted.agg(F.count("*"), F.max("copies")).first()
        found = self.texts.join(F.broadcast(wanted) if size <= self.broadcast_rows else wanted, ["id", "k"])
        if size and most > 1:
            found = found.where("copies = 1").unionByName(found.where("copies > 1").dropDuplicates(["id"]))
        found = found.select("id", "text")
        found._wanted = wanted
        return found

    def held(self, pairs: DataFrame, values: DataFrame, read, test) -> DataFrame:
        """The pairs that pass the test on their values: b's is sent with each pair, a's once for ``DEAL`` pairs."""
        degrees = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("deals"))
        dealt = pairs.join(degrees, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("deal"))
        own = degrees.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("a", F.lit(None).cast("long").alias("b"), "deal")
        rows = own.join(values.withColumnRenamed("id", "a"), "a").unionByName(dealt.join(values.withColumnRenamed("id", "b"), "b"))
        return rows.repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("b").asc_nulls_first()).mapInPandas(tidy(_streamed(read, test)), "a long, b long")

    def nearer(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches leave an overlap that is large enough."""
        texts = self.of(pairs)
        values = cut(texts.mapInPandas(tidy(_sketches), "id long, n long, value binary"))
        out = cut(self.held(pairs, values, _filled, close))
        drop(values, texts._wanted)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked, by their whole sets."""
        pairs = cut(pairs)
        texts = self.of(pairs)
        values = cut(texts.withColumnRenamed("text", "value"))
        out = cut(self.held(pairs, values, _texts, linked))
        drop(values, pairs, texts._wanted)
        return out
