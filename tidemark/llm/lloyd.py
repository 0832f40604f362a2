"""Centroid clustering: Lloyd's rounds over two trees.

The vectors are dealt, as they lie, into blocks of at most ``BLOCK`` rows. Each block holds a cover tree over its
vectors: a node is one of the vectors, its children are nodes of at most 1 / ``BASE`` of its radius, farther apart than
that, and the node itself is the first of them. The blocks are written once. Each round builds such a tree over the
centroids too, and descends both together, a level of pairs at a time: a pair goes if no vector below it can be as near
to a centroid below it as to some centroid below another pair. A node with one centroid left is taken whole; of a leaf,
what is left is compared exactly.

A task gives sums for each centroid and component, which Spark adds; the driver sees ``k`` centroids
and nothing else. Bounds are floating point with a margin, distances and sums are integers, so the result is
exact, ties included.

Defined results: vectors with another number of components, or with a null or non-finite one, are left out; rows with
an equal id, or an equal vector, count each by itself; a null id comes last where centroids are chosen, and rows
with one id are ordered by their vectors; with fewer rows than centroids, each row starts one; an empty table gives an
empty result; other columns aren't read. A squared distance that no long holds is an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, tidy

BLOCK, LEAF, BASE = 2048, 16, 1.3
MARGIN = 1e-9
BLOCKS = "ids binary, known binary, points binary, wide boolean, nodes binary"
ROWS = "vec_id long, cluster int, distance long"
_NODE = [("center", "i4"), ("start", "i4"), ("end", "i4"), ("first", "i4"), ("last", "i4"), ("radius", "f8")]


def integers(vector: Column, components: int = 64, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for a vector that is left out."""
    plain = F.transform(vector, lambda x: x.cast("double"))
    whole = (F.size(vector) == components) & F.forall(plain, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.when(whole, F.transform(plain, lambda x: F.floor(x * scale).cast("long")))


def narrow(components: int) -> int:
    """The largest component with which the squares of a block's differences, summed, are sure to fit 64 bits."""
    return math.isqrt((1 << 61) // (BLOCK * components)) // 2


def squares(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``points`` to ``center``, as floats."""
    gap = (points - center).astype("f8")
    return np.einsum("ij,ij->i", gap, gap)


def tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and nodes over ranges of it; a node's children stand together, after it."""
    order = np.arange(len(points))
    nodes = [[0, 0, len(points), 0, 0, 0.0]]
    at = 0
    while at < len(nodes):
        center, start, end, *_ = nodes[at]
        held = order[start:end]
        near = squares(points[held], points[center])
        radius = float(np.sqrt(near.max())) if len(held) else 0.0
        nodes[at][5] = radius
        at += 1
        if end - start <= leaf or radius == 0:
            continue
        centers, owner = [center], np.zeros(len(held), "i4")
        reach = (radius / BASE) ** 2
        while near.max() > reach:  # the farthest row that no child covers is the next child
            far = int(near.argmax())
            gap = squares(points[held], points[held[far]])
            closer = gap < near
            owner[closer] = len(centers)
            near = np.where(closer, gap, near)
            centers.append(int(held[far]))
        by = np.argsort(owner, kind="stable")
        order[start:end] = held[by]
        edges = start + np.searchsorted(owner[by], np.arange(len(centers) + 1))
        nodes[at - 1][3:5] = [len(nodes), len(nodes) + len(centers)]
        nodes += [[c, int(a), int(b), 0, 0, 0.0] for c, a, b in zip(centers, edges[:-1], edges[1:])]
    return order, np.array([tuple(x) for x in nodes], dtype=_NODE)


def _spread(nodes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes ``of``, and the place in ``of`` that each comes from."""
    n = nodes["last"][of] - nodes["first"][of]
    back = np.repeat(np.arange(len(of)), n)
    return nodes["first"][of][back] + np.arange(len(back)) - (np.cumsum(n) - n)[back], back


def nearest(points: np.ndarray, nodes: np.ndarray, centroids: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """(whole, rows, clusters): nodes taken whole as (node, cluster), and single rows with their cluster.

    ``points`` are in the order of the tree over them.
    """
    order, tops = tree(centroids, 1)
    number = np.array([order[x["start"] : x["end"]].min() for x in tops])  # of equal centroids the smallest
    inner = tops["last"] > tops["first"]
    place = points[nodes["center"]]
    v, c = np.zeros(1, "i8"), np.zeros(1, "i8")
    whole: list[tuple[np.ndarray, np.ndarray]] = []
    rows, clusters = [], []
    while len(v):
        gap = (place[v] - centroids[tops["center"][c]]).astype("f8")
        far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        slack = nodes["radius"][v] + tops["radius"][c]
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        sizes = np.diff(np.r_[starts, len(v)])
        best = np.repeat(np.minimum.reduceat(far + slack, starts), sizes)
        keep = far - slack <= best * (1 + MARGIN) + MARGIN
        v, c = v[keep], c[keep]
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        sizes = np.diff(np.r_[starts, len(v)])
        alone = np.repeat(sizes == 1, sizes) & ~inner[c]
        if alone.any():
            whole.append((v[alone], number[c[alone]]))
            v, c = v[~alone], c[~alone]
        ready = ~np.isin(v, v[inner[c]])  # all centroids left are single
        leaf = nodes["last"][v] == nodes["first"][v]
        exact = ready & leaf
        if exact.any():
            for node in np.unique(v[exact]):
                a, b = nodes["start"][node], nodes["end"][node]
                left = np.sort(number[c[slice(*np.searchsorted(v, [node, node + 1]))]])
                gaps = points[a:b, None, :] - centroids[left][None]
                rows.append(np.arange(a, b))
                clusters.append(left[(gaps * gaps).sum(axis=2).argmin(axis=1)])
            v, c, ready, leaf = v[~exact], c[~exact], ready[~exact], leaf[~exact]
        # the side whose radius is larger is opened; a node of the vectors with all its pairs at once
        opens = inner[c] & (leaf | (tops["radius"][c] >= nodes["radius"][v]))
        down = ~leaf & ~np.isin(v, v[opens])
        kids, back = _spread(tops, c[opens])
        over, from_ = _spread(nodes, v[down])
        stay = ~opens & ~down
        v, c = np.r_[v[opens][back], over, v[stay]], np.r_[kids, c[down][from_], c[stay]]
        by = np.lexsort((c, v))
        v, c = v[by], c[by]
    pick = np.concatenate(rows) if rows else np.zeros(0, "i8")
    return whole, pick, np.concatenate(clusters) if clusters else np.zeros(0, "i8")


def _block(ids: list, points: np.ndarray) -> dict:
    wide = max(int(points.max()), -int(points.min())) > narrow(points.shape[1])
    order, nodes = tree(points.astype(object) if wide else points)
    back = np.empty(len(order), "i4")
    back[order] = np.arange(len(order))
    nodes["center"] = back[nodes["center"]]
    held = [ids[i] for i in order]
    return {
        "ids": np.array([0 if i is None else i for i in held], "i8").tobytes(),
        "known": np.array([i is not None for i in held], "?").tobytes(),
        "points": points[order].astype("i8" if wide else "i4").tobytes(),
        "wide": wide,
        "nodes": nodes.tobytes(),
    }


def blocks(vectors: DataFrame, components: int) -> DataFrame:
    """Rows (vec_id, v) as blocks with a tree each."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            row = _block(ids, np.concatenate(parts))
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            at, values = 0, batch.column(1).flatten().to_numpy().reshape(-1, components)
            keys = batch.column(0).to_pylist()
            while at < len(keys):
                take = min(BLOCK - len(ids), len(keys) - at)
                ids += keys[at : at + take]
                parts.append(values[at : at + take])
                at += take
                if len(ids) == BLOCK:
                    yield made()
                    ids, parts = [], []
        if ids:
            yield made()

    return vectors.mapInArrow(run, BLOCKS)


_SCHEMA = pa.schema([("ids", pa.binary()), ("known", pa.binary()), ("points", pa.binary()), ("wide", pa.bool_()), ("nodes", pa.binary())])


def _read(batch: pa.RecordBatch, row: int, components: int) -> tuple[np.ndarray, np.ndarray, bool]:
    wide = batch.column(3)[row].as_py()
    points = np.frombuffer(batch.column(2)[row].as_buffer(), "i8" if wide else "i4").reshape(-1, components)
    nodes = np.frombuffer(batch.column(4)[row].as_buffer(), np.dtype(_NODE))
    return points.astype("i8"), nodes, wide


def _assigned(points: np.ndarray, nodes: np.ndarray, wide: bool, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, centers, cluster of each row), in integers of any size where 64 bits may not do."""
    if wide or max(abs(x) for c in centroids for x in c) > narrow(points.shape[1]):
        points = points.astype(object)
        centers = np.array(centroids, dtype=object)
    else:
        centers = np.array(centroids, dtype="i8")
    out = np.empty(len(points), "i4")
    whole, rows, clusters = nearest(points, nodes, centers)
    for taken, cluster in whole:
        for node, number in zip(taken, cluster):
            out[nodes["start"][node] : nodes["end"][node]] = number
    out[rows] = clusters
    return points, centers, out


def _totals(held: DataFrame, centroids: list[list[int]], components: int) -> dict[int, tuple[int, list[int], int]]:
    """For each cluster: rows, sums of the components, sum of all squares."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (components + 2) for _ in centroids]
        for batch in batches:
            for row in range(batch.num_rows):
                points, _, cluster = _assigned(*_read(batch, row, components), centroids)
                for k in np.unique(cluster):
                    mine = points[cluster == k]
                    found = [len(mine), int((mine * mine).sum()), *(int(x) for x in mine.sum(axis=0))]
                    sums[k] = [a + b for a, b in zip(sums[k], found)]
        rows = [(k, i, str(x)) for k, of in enumerate(sums) if of[0] for i, x in enumerate(of)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["cluster", "part", "total"])

    parts = held.mapInArrow(run, "cluster int, part int, total string")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # k * (components + 2) rows
        found.setdefault(r["cluster"], {})[r["part"]] = int(r["total"])
    return {k: (of[0], [of[i + 2] for i in range(components)], of[1]) for k, of in found.items()}


def first(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors whose seeded ids hash smallest."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [list(r["v"]) for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, components: int = 64, seed: str = "3", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): each vector's cluster after ``rounds`` rounds.

    The blocks stay in the shared folder until the session ends, as the result is computed from them.
    """
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), integers(F.col(vector), components).alias("v")).where("v IS NOT NULL")
    centroids = first(kept, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not centroids:
        return rows.sparkSession.createDataFrame([], out)
    held = cut(blocks(kept, components))
    for _ in range(rounds):
        for j, (n, sums, _) in _totals(held, centroids, components).items():
            centroids[j] = [x // n for x in sums]
    ends = _totals(held, centroids, components)
    # of a cluster: sum |x|^2 - 2 c sum x + n |c|^2
    spent = [0] * len(centroids)
    for j, (n, sums, squared) in ends.items():
        spent[j] = squared - 2 * sum(a * b for a, b in zip(centroids[j], sums)) + n * sum(a * a for a in centroids[j])
    total = sum(spent)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                points, centers, mine = _assigned(*_read(batch, row, components), centroids)
                gap = points - centers[mine]
                known = np.frombuffer(batch.column(1)[row].as_buffer(), "?")
                ids = np.frombuffer(batch.column(0)[row].as_buffer(), "i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=~known), pa.array(mine, pa.int32()), pa.array((gap * gap).sum(axis=1).tolist(), pa.int64())], ["vec_id", "cluster", "distance"]
                )

    table = rows.sparkSession.createDataFrame([(j, spent[j], total, centroids[j]) for j in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return held.mapInArrow(run, ROWS).join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
