"""Best-fit packing of documents into sequences.

Texts become token ids with an end id last; only those longer than a sequence are cut, and only their first piece may
be shorter than one. What decides a packing is how many pieces there are of each length, at most ``capacity`` numbers.
``plan`` packs these counts, never single pieces: lengths above a third of the capacity, of which at most two fit
together, are matched greedily, the longest with the longest that still fits; shorter ones go, longest first, where
they leave least room. A step of the plan says which ranks of a length go to which sequences and where. Each
piece finds its step by its rank among those of its length, which sums over the written parts of the table
give, so that no piece meets another and ids are never shuffled to be placed.

Tokens come from the ``tiktoken`` form of the vocabulary, which cuts every code point as the ``tokenizers`` file
does and is seven times faster; a text whose white space is too long for it takes the ``tokenizers`` file.

Defined results: a null text is empty; an empty text is one piece, the end id; rows that repeat an id are pieces of
their own; equal lengths are ranked as the table is written; a special token's string in a text is that token, as in the
library; other columns named in ``keep`` stay, unless an output has their name; an empty table gives no pieces and no sequences.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, tidy

CAPACITY, END = 2048, 0
MADE = ("piece", "start", "length", "ids", "sequence_id", "offset", "_part", "_rank", "_at", "_before")
BITS = 44  # of a rank, beside a length in one number
#: length; first rank and rank after the last; first sequence; pieces in each sequence; offset of the first of them.
STEP = ("length", "rank", "until", "sequence", "each", "offset")


@cache
def coder(json: str, ranks: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Text to ids, by the vocabulary's two files."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json)
    special = {x.content: i for i, x in exact.get_added_tokens_decoder().items() if x.special}
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special=set(special), disallowed_special=())
        except ValueError:  # its pattern gives up on very long white space
            return np.array(exact.encode(text, add_special_tokens=False).ids, "u4")

    return ids


def pieces(docs: DataFrame, files: Sequence[str], capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit numbers.

    ``files``: the vocabulary as ``tokenizers`` and ``tiktoken`` file, and its pattern.
    """
    rest = [c for c in keep if c not in (doc_id, "doc_id", "_text", *MADE)]
    held = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *rest)
    kinds = [held.schema[c].dataType.simpleString() for c in ("doc_id", *rest)]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(*files)
        for batch in batches:
            back, numbers, starts, lengths, parts = [], [], [], [], []
            for row, one in enumerate(batch.column(1)):
                ids = np.append(encode(one.as_py()), end).astype("<u4")
                n = len(ids)
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for number, (a, b) in enumerate(zip(edges, edges[1:])):
                    back.append(row)
                    numbers.append(number)
                    starts.append(a)
                    lengths.append(b - a)
                    parts.append(ids[a:b].tobytes())
            at = pa.array(back, pa.int64())
            others = [batch.column(i).take(at) for i in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())],
                ["doc_id", *rest, "piece", "start", "length", "ids"],
            )

    schema = ", ".join(f"`{c}` {k}" for c, k in zip(("doc_id", *rest), kinds))
    return held.mapInArrow(run, f"{schema}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Steps for so many pieces of each length; sequences are numbered from 0 without gaps."""
    steps: list[tuple[int, ...]] = []
    left, used = dict(counts), {length: 0 for length in counts}
    bins = 0
    free: dict[int, list[tuple[int, int]]] = {}  # room: ranges of sequences
    rooms: list[int] = []  # in order

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        steps.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    others = sorted(large)
    for length in large:
        while left[length]:
            at = bisect_left(others, capacity - length + 1) - 1  # the longest that fits beside it
            while at >= 0 and (not left[others[at]] or (others[at] == length and left[length] < 2)):
                at -= 1
            if at < 0:
                n = left[length]
                place(length, n, bins, 1, 0)
                give(capacity - length, bins, n)
            elif (beside := others[at]) == length:
                n = left[length] // 2
                place(length, 2 * n, bins, 2, 0)
                give(capacity - 2 * length, bins, n)
            else:
                n = min(left[length], left[beside])
                place(length, n, bins, 1, 0)
                place(beside, n, bins, 1, length)
                give(capacity - length - beside, bins, n)
            bins += n
        others = others[: bisect_left(others, length)]
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                each = capacity // length
                room, first, n = capacity, bins, -(-left[length] // each)
                bins += n
            each = room // length
            full = min(n, left[length] // each)
            if full:
                place(length, full * each, first, each, capacity - room)
                give(room - each * length, first, full)
            if full < n:
                rest = left[length]
                if rest:
                    place(length, rest, first + full, rest, capacity - room)
                    give(room - rest * length, first + full, 1)
                give(room, first + full + bool(rest), n - full - bool(rest))
    return steps


def place(held: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``held`` with sequence_id and offset; ``held`` has a length of at most ``capacity`` in each row.

    The rows are written once, each with its part of the table and its rank among the part's rows of its length.
    """

    @tidy
    def ranked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, "i8")
        part = TaskContext.get().partitionId()
        for batch in frames:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = pd.Series(lengths).groupby(lengths).cumcount().to_numpy() + seen[lengths]
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part), pa.int64()), pa.array(rank, pa.int64())], [*batch.schema.names, "_part", "_rank"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    rows = cut(held.mapInArrow(ranked, f"{fields}, _part long, _rank long"))
    sizes = rows.groupBy("_part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    based = cut(sizes.select("_part", "length", "n", F.coalesce(before, F.lit(0)).alias("_before")))
    counts = {r["length"]: r["n"] for r in based.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    steps = np.array(sorted(plan(counts, capacity)), "i8").reshape(-1, len(STEP))

    @tidy
    def placed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, sequence, each, offset = steps.T
        keys = length << BITS | rank
        for batch in frames:
            names = batch.schema.names
            mine, at = (batch.column(names.index(c)).to_numpy() for c in ("length", "_at"))
            step = np.searchsorted(keys, mine << BITS | at, side="right") - 1
            number = at - rank[step]
            rest = [c for c in names if c != "_at"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in rest), pa.array(sequence[step] + number // each[step]), pa.array(offset[step] + number % each[step] * mine)], [*rest, "sequence_id", "offset"]
            )

    found = rows.join(based.drop("n"), ["_part", "length"]).select(*held.columns, (F.col("_before") + F.col("_rank")).alias("_at"))
    return found.mapInArrow(placed, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, files: Sequence[str], capacity: int = CAPACITY, **more) -> DataFrame:
    """All pieces with their ids, sequence and offset."""
    return place(pieces(docs, files, capacity, **more), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of each sequence one after another; a sequence is bounded by its capacity."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), inside.alias("inside"))
    return whole.select("sequence_id", "n_tokens", F.aggregate("inside", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
