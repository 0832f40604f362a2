"""Suffix-array dedup of byte strings over a whole corpus.

Every byte that a string of ``LENGTH`` bytes covers goes, if that string also starts anywhere else. Two
equal strings hold the same bytes, so they choose the same anchor: the ``GRAM`` bytes with the smallest
hash inside them. An anchor thus owns the starts that choose it, a stretch of at most LENGTH - GRAM + 1.
Only anchors whose bytes are met again can own a repeated string, and all equal strings meet in one cell,
that of their anchor's hash. Texts are joined once with their repeated anchors, and the owned stretches
are dealt by cell.

In a cell the distinct stretches are put into one text, and its suffixes sorted in two stages: directly
only those that are smaller than their successors; all others by scanning the buckets in order, which
puts each before the suffix it was found from. Then the common prefixes of neighbours say which starts repeat.

A cell of more than ``LARGE`` distinct stretches is split by its next bytes first: a string's distance from its anchor
is in one half of the range or the other, and all strings of a half hold the same bytes around the anchor if they
are equal, which name the new cell. A passage that stands in many surroundings is thus one stretch where the half
lies inside it, and goes on being split where it reaches over its ends, until a cell has few distinct stretches,
at the last one; each is sorted by the same method. Cells of more than ``MOST`` occurrences are split by Spark, equal
stretches being met once with their number, smaller ones inside the task that holds them.

Identical rows are one text with a multiplicity: it is read, dealt and cut once, each of its strings repeats, and
its result is given as often as it has rows.

Defined results: null and empty texts have no bytes; matches never reach over a text's end; repeated rows are
copies like any others, so strings in them repeat; long texts are read in pieces that overlap; other columns
aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, salted, tidy

LENGTH, GRAM, LARGE, MOST = 400, 100, 500, 10_000
PIECE, CHUNK = 1 << 19, 1 << 18
FACTOR = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, FACTOR, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(text: np.ndarray, gram: int, powers) -> np.ndarray:
    """A mixed hash of the ``gram`` bytes from each place on."""
    n = len(text)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[0][:n], out=sums[1:])
    h = (sums[gram:] - sums[: n + 1 - gram]) * powers[1][: n + 1 - gram]
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    return h ^ (h >> np.uint64(32))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, from prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, at, first, last): anchors in order, with the first and last start that choose each."""
    hashes, ats, firsts, lasts = [], [], [], []
    low = np.uint64((1 << 20) - 1)
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        text = np.frombuffer(data, np.uint8)[at : at + PIECE + length - 1]
        if len(text) < length:
            break
        h = gram_hashes(text, gram, powers)
        ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
        chosen = (least(ranked, length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        hashes.append(h[chosen[first]].view(np.int64))
        ats.append(chosen[first] + at)
        firsts.append(first + at)
        lasts.append(np.concatenate([first[1:], [len(chosen)]]) - 1 + at)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (hashes, ats, firsts, lasts))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` symbols. 0 ends a part; the text ends with 0."""
    n, raw = len(text), text.tobytes()
    change = np.where(text[:-1] != text[1:], np.arange(n - 1), n)
    change = np.minimum.accumulate(change[::-1])[::-1]  # where the run of equal symbols from here ends
    smaller = np.zeros(n, bool)
    run = change < n
    smaller[:-1][run] = text[change[run] + 1] > text[change[run]]
    smaller &= text > 0
    direct = np.array(sorted(np.flatnonzero(smaller).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    edges = np.searchsorted(text[direct], np.arange(257))
    found: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(items: np.ndarray, own: int) -> np.ndarray:
        """Deal the larger predecessors of a sorted stretch to the ends of their buckets; gives the bucket's own."""
        before = items[items > 0] - 1
        before = before[(text[before] > 0) & ~smaller[before]]
        symbols = text[before]
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        mine = before[:0]
        for part in np.split(before, cuts) if len(before) else ():
            if text[part[0]] == own:
                mine = part
            else:
                found[text[part[0]]].append(part)
        return mine

    for c in range(256):
        wave = np.flatnonzero(text == 0) if c == 0 else np.concatenate(found[c]) if found[c] else direct[:0]
        while len(wave):
            if c:
                out.append(wave)
            wave = induce(wave, c)
        part = direct[edges[c] : edges[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    return np.concatenate(out) if out else direct


def repeated_starts(parts: list[bytes], times: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each distinct part, which of its starts of ``length`` bytes are met again, in it or in another."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)  # 255 is in no UTF-8 text; it becomes the end, 0
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = np.repeat(begin + sizes, sizes + 1)
    again = np.zeros(len(text), bool)
    order = suffix_array(text, length)
    order = order[ends[order] - order >= length]
    if len(order) > 1:
        views = np.lib.stride_tricks.sliding_window_view(text, length)
        for a in range(0, len(order) - 1, 4096):
            left, right = order[a : a + 4096][: len(order) - 1 - a], order[a + 1 : a + 4097]
            near = (views[left, :8] == views[right, :8]).all(1)
            left, right = left[near], right[near]
            differ = views[left] != views[right]
            common = np.where(differ.any(1), differ.argmax(1), length)  # neighbours' common prefix, as far as it counts
            same = common >= length
            again[left[same]] = True
            again[right[same]] = True
    out = []
    for b, size, n in zip(begin.tolist(), sizes.tolist(), times):
        starts = again[b : b + size - length + 1]
        out.append(np.ones(len(starts), bool) if n > 1 else starts)
    return out


def halves(at: int, stretch: bytes, lo: int, hi: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(near, far, first, shared bytes, part) of a stretch's two parts by the distance of their strings from the anchor."""
    middle = (lo + hi) // 2
    for near, far in ((lo, middle), (middle + 1, hi)):
        first, last = max(0, at - far), min(len(stretch) - LENGTH, at - near)
        if near <= far and first <= last:
            yield near, far, first, stretch[at - near : at - far + LENGTH], stretch[first : last + LENGTH]


Leaf = tuple[bytes, int, list[tuple[int, int]]]


def small_cells(parts: list[tuple[bytes, int, int]], large: int, lo: int = 0, hi: int = LENGTH - GRAM) -> Iterator[list[Leaf]]:
    """The cells of at most ``large`` distinct stretches into which one cell of (stretch, place of the anchor, times) is split;
    each of its stretches with the times and the (number, first start) of those that hold it."""
    cells: dict[tuple[int, int, bytes], dict[bytes, list]] = {}
    for i, (part, at, times) in enumerate(parts):
        for near, far, first, shared, held in halves(at, part, lo, hi):
            cells.setdefault((near, far, shared), {}).setdefault(held, [at - first, 0, []])
            found = cells[near, far, shared][held]
            found[1] += times
            found[2].append((i, first))
    for (near, far, _), held in cells.items():
        if len(held) <= large or near == far:  # of one distance, equal bytes around the anchor are all there is
            yield [(part, times, of) for part, (_, times, of) in held.items()]
            continue
        above = [of for _, _, of in held.values()]
        for cell in small_cells([(part, at, times) for part, (at, times, _) in held.items()], large, near, far):
            yield [(part, times, [(i, first + more) for j, more in of for i, first in above[j]]) for part, times, of in cell]


def cell_starts(parts: list[bytes], ats: list[int], times: list[int], large: int) -> list[np.ndarray]:
    """As ``repeated_starts``, for the distinct stretches of one cell of any size, whose anchors stand at ``ats``."""
    out = [np.zeros(len(p) - LENGTH + 1, bool) for p in parts]
    waiting: list[Leaf] = []

    def mark(leaf: Leaf, starts: np.ndarray) -> None:
        for i, first in leaf[2]:
            out[i][first : first + len(starts)] |= starts

    def flush() -> None:  # strings of different cells can't be equal, so that many cells are sorted as one text
        if waiting:
            for leaf, starts in zip(waiting, repeated_starts([p for p, _, _ in waiting], [n for _, n, _ in waiting])):
                mark(leaf, starts)
            waiting.clear()

    size = 0
    for cell in small_cells(list(zip(parts, ats, times)), large):
        if len(cell) == 1:  # the only one of its cell
            mark(cell[0], np.full(len(cell[0][0]) - LENGTH + 1, cell[0][1] > 1))
            continue
        waiting += cell
        size += sum(len(p) for p, _, _ in cell)
        if size >= CHUNK:
            flush()
            size = 0
    flush()
    return out


def covered(starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Byte ranges (start, end, start, end ...) under runs of starts."""
    edge = np.diff(np.concatenate([[0], starts.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + length], 1).ravel()


# -- tasks ---------------------------------------------------------------------------------------------------

ANCHORS = "k1 long, k2 long, times long, hash long, at int, first int, last int"
STRETCHES = "k1 long, k2 long, times long, hash long, at int, first int, stretch binary"
RANGES = "k1 long, k2 long, ranges array<int>"
ROOTED = STRETCHES + ", lo int, hi int, r1 long, r2 long"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _powers(PIECE + LENGTH)
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("k1", "k2", "times")]
        made = [anchors((x or "").encode(), powers) for x in batch.column("text").to_pylist()]
        n = [len(m[0]) for m in made]
        columns = [np.repeat(k, n) for k in keys] + [np.concatenate([m[i] for m in made]) if made else np.zeros(0, np.int64) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["k1", "k2", "times", "hash", "at", "first", "last"])


def _stretches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for a in range(0, len(frame), 500):
            rows = []
            for k1, k2, times, text, owned in frame[["k1", "k2", "times", "text", "owned"]].iloc[a : a + 500].itertuples(index=False):
                data = text.encode()
                rows += [(k1, k2, times, o["hash"], o["at"] - o["first"], o["first"], data[o["first"] : o["last"] + LENGTH]) for o in owned]
            yield pd.DataFrame(rows, columns=["k1", "k2", "times", "hash", "at", "first", "stretch"])


def _rooted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with the name of what they hold: equal for equal stretches of a cell with the anchor at the same place."""
    for frame in frames:
        names = [xxhash.xxh3_128_digest(b"%d %d " % (cell, at) + stretch) for cell, at, stretch in zip(frame["hash"], frame["at"], frame["stretch"])]
        both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        yield frame.assign(r1=both[:, 0], r2=both[:, 1])


def _halves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each stretch's halves, in cells that the bytes around the anchor name."""
    for frame in frames:
        rows = []
        for k1, k2, times, cell, at, stretch, lo, hi in frame[["k1", "k2", "times", "hash", "at", "stretch", "lo", "hi"]].itertuples(index=False):
            for near, far, first, shared, held in halves(at, stretch, lo, hi):
                name = xxhash.xxh3_64_intdigest(b"%d %d %d " % (cell, near, far) + shared) - (1 << 63)
                rows.append((k1, k2, times, name, at - first, first, held, near, far))
        yield pd.DataFrame(rows, columns=["k1", "k2", "times", "hash", "at", "first", "stretch", "lo", "hi"])


def _sorted_cells(large: int):
    """A task that gives the ranges to remove, for rows in the order of their cells."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: list[dict[bytes, list]] = []
        last, size = None, 0

        def flush() -> pd.DataFrame:
            often = lambda rows: sum(r[3] for r in rows)
            sure = [(p, rows) for c in cells if len(c) == 1 for p, rows in c.items()]
            open_ = [(p, rows) for c in cells if 1 < len(c) <= large for p, rows in c.items()]
            # a stretch that is the only one of its cell is met again if it occurs again, and nothing is to be sorted
            flags = [np.full(len(p) - LENGTH + 1, often(rows) > 1) for p, rows in sure]
            if open_:
                flags += repeated_starts([p for p, _ in open_], [often(rows) for _, rows in open_])
            for c in cells:
                if len(c) > large:
                    open_ += c.items()
                    flags += cell_starts(list(c), [rows[0][4] for rows in c.values()], [often(rows) for rows in c.values()], large)
            out = []
            for (_, rows), starts in zip(sure + open_, flags):
                ranges = covered(starts)
                if len(ranges):
                    out += [(k1, k2, (ranges + first).astype(np.int32)) for k1, k2, first, _, _ in rows]
            return pd.DataFrame(out, columns=["k1", "k2", "ranges"])

        for frame in frames:
            for k1, k2, times, cell, at, first, stretch in frame[["k1", "k2", "times", "hash", "at", "first", "stretch"]].itertuples(index=False):
                if cell != last:
                    if size >= CHUNK:
                        yield flush()
                        cells, size = [], 0
                    cells.append({})
                    last = cell
                rows = cells[-1].setdefault(stretch, [])
                if not rows:
                    size += len(stretch)
                rows.append((k1, k2, first, times, at))
        if cells:
            yield flush()

    return task


CUT = "kept binary, n_bytes long, n_removed long, n_spans long"


def without(data: bytes, ranges) -> tuple[bytes, int, int, int]:
    """The bytes outside the ranges, how many there were, how many went, and in how many runs."""
    pairs = sorted(zip(ranges[::2], ranges[1::2]))
    merged: list[list[int]] = []
    for a, b in pairs:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    parts, done = [], 0
    for a, b in merged:
        parts.append(data[done:a])
        done = b
    parts.append(data[done:])
    return b"".join(parts), len(data), sum(b - a for a, b in merged), len(merged)


def _without(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    rows = [without((x or "").encode(), () if r is None else [int(v) for part in r for v in part]) for x, r in zip(texts, ranges)]
    return pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])


def in_small_cells(cells: DataFrame) -> DataFrame:
    """(k1, k2, ranges) of stretches whose cells are small enough for a task."""
    return cells.repartition("hash").sortWithinPartitions("hash").mapInPandas(tidy(_sorted_cells(LARGE)), RANGES)


def in_large_cells(rows: DataFrame) -> DataFrame:
    """(k1, k2, ranges) of stretches (``ROOTED``, a table) of cells of any size; the distances lo to hi are halved as often as it
    takes, nine times at most."""
    some = {c: F.first(c).alias(c) for c in ("hash", "at", "stretch", "lo", "hi")}
    roots = cut(rows.groupBy("r1", "r2").agg(F.sum("times").alias("times"), *some.values()).select(F.col("r1").alias("k1"), F.col("r2").alias("k2"), "times", "hash", "at", F.lit(0).alias("first"), "stretch", "lo", "hi"))
    large = cut(roots.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > LARGE))
    found = in_small_cells(roots.join(large, "hash", "left_anti"))
    if not large.isEmpty():
        halves = salted(roots, large, "hash", "n", F.col("k1")).mapInPandas(tidy(_halves), STRETCHES + ", lo int, hi int")
        found = found.unionByName(in_large_cells(cut(halves.mapInPandas(tidy(_rooted), ROOTED))))
    met = found.groupBy(F.col("k1").alias("r1"), F.col("k2").alias("r2")).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))  # of one stretch
    many = rows.groupBy("r1", "r2").agg(F.count("*").alias("n"))
    named = met.join(many, ["r1", "r2"]).withColumn("r", F.struct("r1", "r2")).select("r", "ranges", "n")
    back = salted(rows.select("k1", "k2", "first", F.struct("r1", "r2").alias("r")), cut(named), "r", "n", F.col("k1"))
    return back.select("k1", "k2", F.transform("ranges", lambda x: x + F.col("first")).alias("ranges"))


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kept bytes, n_bytes, n_removed, n_spans), a row for each document."""
    value = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(doc).alias("id"), value.alias("text"), F.xxhash64(doc, value, F.lit(1)).alias("k1"), F.xxhash64(value, doc, F.lit(2)).alias("k2"))
    texts = rows.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("times"))
    # wherever the texts are read, all of their columns go along in the same order: so one shuffle of them serves all uses in a query
    found = texts.mapInArrow(tidy(_anchors), ANCHORS)
    # counted over all rows, so that this pass needs no shuffle of texts; cut, so that the join on a hash that very
    # many share is broadcast while it is small, and else dealt over many tasks
    every = rows.withColumn("times", F.lit(1).cast("long")).mapInArrow(tidy(_anchors), ANCHORS)
    again = cut(every.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), lean=True)
    owned = salted(found, again, "hash", "n", F.col("k1"))
    lists = owned.groupBy("k1", "k2").agg(F.collect_list(F.struct("hash", "at", "first", "last", "n")).alias("owned"))
    cells = texts.join(lists, ["k1", "k2"]).select(*texts.columns, "owned")

    def of(kept):
        return cells.withColumn("owned", F.filter("owned", kept)).where(F.size("owned") > 0).mapInPandas(tidy(_stretches), STRETCHES)

    some = not again.where(F.col("n") > MOST).isEmpty()
    met = in_small_cells(of(lambda o: o["n"] <= MOST))
    if some:  # one pass over the texts gives the ranges of the small cells and, without ranges, the stretches of the large ones
        large = of(lambda o: o["n"] > MOST).withColumns({"lo": F.lit(0), "hi": F.lit(LENGTH - GRAM)}).mapInPandas(tidy(_rooted), ROOTED)
        met = met.unionByName(large, allowMissingColumns=True)
    met = cut(met, lean=True)  # with or without large cells: the texts are shuffled for the pass, and again for the result
    ranges = met.where(F.col("ranges").isNotNull()).select("k1", "k2", "ranges")
    if some:
        ranges = ranges.unionByName(in_large_cells(met.where(F.col("ranges").isNull()).drop("ranges")))
    gone = ranges.groupBy("k1", "k2").agg(F.collect_list("ranges").alias("ranges"))
    held = texts.join(gone, ["k1", "k2"], "left").withColumn("cut", F.pandas_udf(_without, CUT)(F.col("text"), F.col("ranges")))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return held.select(F.col("id").alias(doc), "cut.*", each.alias("_copy")).drop("_copy")
