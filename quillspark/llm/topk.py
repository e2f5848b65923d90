"""Exact k best inner products by dual cover trees.

Vectors become integers, floor(SCALE * x). Both sides are indexed in cover trees: a node of level s covers its points within
2**s of its centre; its children have level s - 1, their centres are further apart than 2**(s - 1) and each point is with
its nearest centre. A node that can't be split at a level keeps it at the next; nodes of at most LEAF points are leaves. The
search goes down both trees: a query node hands the reference nodes that it could not leave out to its children, and a
pair of nodes is left out when no pair of their members can reach the worst kth score of the query node's group:
q.r <= q0.r0 + |q0| R + |r0| Q + Q R, with the centres q0, r0 and the radii Q, R. A leaf of queries meets leaves in the order
of that bound until it falls below the worst kth score.

Rows lie in the order of their nearest pivot (REGIONS at most, spread over a sample of rows), in ranges of like size, so that
a region of any size spreads over tasks; a block is up to BLOCK neighbours in that order. First each query meets the block
that it lies in, directly, which gives it a kth score to begin with. Then queries go, in groups of QUERIES, to all tasks, and a task
carries their best from block to block; it returns k rows a query at most. A block that no query's bound reaches gets no tree.

What pruning can save depends on the data: next to all of it among points of few dimensions or in clusters, nothing among
directions drawn at random in many dimensions, where any ball that holds two points may hold a better one (README gives
figures). The result is exact all the same.

Defined cases. Vectors that are null, empty, or hold a null or a component that is not finite take no part, nor do rows
without an id. Repeated rows are rows of their own: a query leaves out only itself. Vectors of other lengths are filled
with zeros. Ties go to the smaller id. Fewer than k candidates give fewer rows, an empty table none. Scores are exact as
long as they fit 62 bits. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, mark, single_threaded, stored

SCALE = 256
BLOCK, QUERIES, LEAF, REGIONS = 4096, 16384, 16, 1024
TREE = 2048  # queries of a tree
POINTS = 1024  # that a leaf of queries meets at a time
LOW = -(1 << 62)


@dataclass
class Tree:
    """Nodes in breadth-first order, each one's children beside one another. order: points, each node's own from low to high."""

    order: np.ndarray
    center: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    level: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _gaps(x: np.ndarray, norms: np.ndarray, at: np.ndarray, center: int) -> np.ndarray:
    return np.sqrt(np.maximum(norms[at] - 2 * (x[at] @ x[center]) + norms[center], 0))


def cover_tree(x: np.ndarray) -> Tree:
    """The tree over rows of x (one at least)."""
    norms = np.einsum("ij,ij->i", x, x)
    order = np.arange(len(x))
    nodes = [(0, len(x))]
    found: list[tuple[int, float, int, int, int]] = []  # centre, radius, level, first child, children
    at = 0
    while at < len(nodes):
        low, high = nodes[at]
        at += 1
        own = order[low:high]
        center = own[0]
        near = _gaps(x, norms, own, center)
        radius = float(near.max())
        level = math.ceil(math.log2(radius)) if radius > 1e-3 else -10
        if high - low <= LEAF or radius <= 1e-3:
            found.append((center, radius, level, 0, 0))
            continue
        while near.max() <= 2.0 ** (level - 1):
            level -= 1
        owner, k = np.zeros(len(own), np.int64), 1
        while near.max() > 2.0 ** (level - 1):  # the point furthest from all centres is the next one
            gap = _gaps(x, norms, own, own[int(near.argmax())])
            nearer = gap < near
            owner[nearer], near[nearer] = k, gap[nearer]
            k += 1
        ranked = np.lexsort((near, owner))  # a centre comes first among its points
        order[low:high] = own[ranked]
        cuts = low + np.searchsorted(owner[ranked], np.arange(k + 1))
        found.append((center, radius, level, len(nodes), k))
        nodes += zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
    centers = np.array([f[0] for f in found])
    span = np.array(nodes)
    return Tree(order, x[centers], np.sqrt(norms[centers]), np.array([f[1] for f in found]) * (1 + 1e-9) + 1e-6, np.array([f[2] for f in found]), span[:, 0], span[:, 1], np.array([f[3] for f in found]), np.array([f[4] for f in found]))


def _ranges(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... for sizes[0] numbers, then the same for the next."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - sizes), sizes)


class Search:
    """The k best of queries over the blocks that it is shown. floor: scores below which a query needs none."""

    def __init__(self, q: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray | None = None):
        single_threaded()
        self.q, self.rows, self.k = q, rows, k
        self.forest = [(at, cover_tree(q[at : at + TREE])) for at in range(0, len(q), TREE)]
        self.most = float(np.abs(q).max(initial=0)) * max(1, q.shape[1])
        self.norms = np.sqrt(np.einsum("ij,ij->i", q, q))
        self.score = np.full((len(q), k), LOW, np.int64)
        self.other, self.ids = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -1, np.int64)
        self.need = np.full(len(q), LOW, np.int64) if floor is None else floor.copy()
        self.formed = self.bounded = 0  # products of vectors with vectors, of centres with centres

    def show(self, r: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """A block's vectors, rows and ids."""
        if not len(r) or not len(self.q):
            return
        middle = r[0]
        radius = math.sqrt(float(((r - middle) ** 2).sum(axis=1).max()))
        reach = self.q @ middle + self.norms * radius
        if not (reach + 1e-6 * np.abs(reach) + 1 >= self.need).any():
            return
        exact = self.most * float(np.abs(r).max()) < 2**53
        block = (r if exact else r.astype(np.int64), rows, ids)
        tree = cover_tree(r)
        for first, asking in self.forest:
            self._descend(first, asking, tree, block)

    def _descend(self, first: int, a: Tree, b: Tree, block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        waiting = [(0, np.zeros(1, np.int64))]
        while waiting:
            node, of = waiting.pop()
            own = first + a.order[a.low[node] : a.high[node]]
            worst = self.need[own].min()
            ends, tops = [], []
            while len(of):
                self.bounded += len(of)
                most = b.center[of] @ a.center[node] + a.norm[node] * b.radius[of] + b.norm[of] * a.radius[node] + a.radius[node] * b.radius[of]
                most = most + 1e-6 * np.abs(most) + 1
                of, most = of[most >= worst], most[most >= worst]
                # a query node goes down after the reference nodes that are larger than itself
                stays = b.children[of] == 0 if not a.children[node] else (b.children[of] == 0) | (b.radius[of] < a.radius[node])
                ends.append(of[stays])
                tops.append(most[stays])
                of = _ranges(b.child[of[~stays]], b.children[of[~stays]])
            of, most = np.concatenate(ends), np.concatenate(tops)
            if a.children[node]:
                if len(of):
                    waiting += [(c, of) for c in range(a.child[node], a.child[node] + a.children[node])]
                continue
            ranked = np.argsort(-most, kind="stable")
            of, most = of[ranked], most[ranked]
            sums = np.cumsum(b.high[of] - b.low[of])
            at = 0
            while at < len(of) and most[at] >= (worst := float(self.need[own].min())):
                to = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + POINTS, side="right"))
                to = max(at + 1, min(to, int(np.searchsorted(-most, -worst, side="right"))))
                self._meet(own, b.order[_ranges(b.low[of[at:to]], (b.high - b.low)[of[at:to]])], *block)
                at = to

    def _meet(self, own: np.ndarray, points: np.ndarray, r: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        score = (self.q[own].astype(r.dtype) @ r[points].T).astype(np.int64)
        self.formed += score.size
        score[self.rows[own][:, None] == rows[points][None, :]] = LOW
        i, j = np.nonzero((score >= self.need[own][:, None]) & (score > LOW))
        if not len(i):
            return
        row = np.concatenate([i, np.repeat(np.arange(len(own)), self.k)])
        value, other, name = (np.concatenate([new, held[own].ravel()]) for new, held in ((score[i, j], self.score), (rows[points[j]], self.other), (ids[points[j]], self.ids)))
        ranked = np.lexsort((other, name, -value, row))
        row, value, other, name = row[ranked], value[ranked], other[ranked], name[ranked]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.k
        for held, new in ((self.score, value), (self.other, other), (self.ids, name)):
            held[own[row[top]], rank[top]] = new[top]
        self.need[own] = np.maximum(self.need[own], self.score[own, self.k - 1])


def _integers(column: pa.Array) -> list[bytes | None]:
    """Each vector's integers, in 2, 4 or 8 bytes each behind a byte that says so."""
    out = []
    for v in column.to_pylist():
        if not v or any(x is None for x in v):
            out.append(None)
            continue
        x = np.array(v, dtype=np.float64)
        if not np.isfinite(x).all():
            out.append(None)
            continue
        x = np.floor(SCALE * x)
        most = np.abs(x).max()
        size, kind = (2, np.int16) if most < 2**15 else (4, np.int32) if most < 2**31 else (8, np.float64)
        out.append(bytes([size]) + x.astype(kind).tobytes())
    return out


_SIZED = {2: np.int16, 4: np.int32, 8: np.float64}


def _stack(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, b in enumerate(rows):
        v = np.frombuffer(b, _SIZED[b[0]], offset=1)
        out[i, : len(v)] = v
    return out


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of a sample, each the furthest from those before it."""
    norms = np.einsum("ij,ij->i", sample, sample)
    every = np.arange(len(sample))
    chosen, near = [0], _gaps(sample, norms, every, 0)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _gaps(sample, norms, every, chosen[-1]))
    return sample[chosen]


def best_products(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query row's k best other rows. queries: a condition on vec_id."""
    since = mark()
    spark = vectors.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_integers(batch.column(1)), pa.binary())], ["vec_id", "v"])

    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    rows = own.mapInArrow(encode, "vec_id long, v binary").where("v is not null").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "vectors").withColumn("asks", F.coalesce(queries, F.lit(False)))
    places = F.floor((F.length("v") - 1) / F.conv(F.hex(F.substring("v", 1, 1)), 16, 10).cast("int"))
    n, asked, width = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(places), F.lit(0))).first()
    parts = min(REGIONS, max(1, -(-n // BLOCK)))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(4 * parts).select("v").collect()
    pivots = _pivots(_stack([bytes(r["v"]) for r in sample], width), parts) if sample else np.zeros((1, max(1, width)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        norms = np.einsum("ij,ij->i", pivots, pivots)
        for batch in batches:
            x = _stack(batch.column(1).to_pylist(), width)
            region = (norms - 2 * x @ pivots.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region.astype(np.int32))], [*batch.schema.names, "region"])

    rows = rows.mapInArrow(dealt, "vec_id long, v binary, row long, asks boolean, region int")
    rows = stored(rows.repartitionByRange("region", "row").sortWithinPartitions("region", "row") if parts > 1 else rows, "dealt")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        """Up to BLOCK neighbours of one region each."""
        held: list[pa.RecordBatch] = []

        def block() -> dict[str, np.ndarray]:
            whole = pa.Table.from_batches(held)
            held.clear()
            return {"x": _stack(whole.column("v").to_pylist(), width), **{c: whole.column(c).to_numpy() for c in ("row", "vec_id", "asks")}}

        for batch in batches:
            region = batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(region)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and (held[0].column(4)[0].as_py() != region[a] or sum(h.num_rows for h in held) >= BLOCK):
                        yield block()
                    take = min(b - a, BLOCK - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield block()

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        for block in blocks(batches):
            x, at = block["x"], np.flatnonzero(block["asks"])
            floor = np.full(len(at), LOW, np.int64)
            if len(x) > k and len(at):
                score = x[at] @ x.T
                score[np.arange(len(at)), at] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k]
                floor = np.floor(least - np.abs(least) * 1e-9).clip(LOW, -LOW).astype(np.int64)  # no higher than the exact score
            yield pa.RecordBatch.from_arrays([pa.array(block["row"][at]), pa.array(floor)], ["row", "floor"])

    floors = rows.mapInArrow(home, "row long, floor long")
    groups = max(1, -(-asked // QUERIES))
    asking = rows.where("asks").join(floors, "row").select("row", "vec_id", "v", "region", "floor", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g"))
    asking = stored(asking, "asking") if groups > 1 else asking
    met: DataFrame | None = None
    for g in range(groups):
        got = asking.where(F.col("g") == g).orderBy("region", "row").drop("region", "g").toArrow()  # QUERIES rows or so
        asks = [got.column(c).to_numpy() for c in ("row", "vec_id", "floor")]
        shared = spark.sparkContext.broadcast((_stack(got.column("v").to_pylist(), width), *asks))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, row, vec_id, floor = shared.value
            search = Search(q, row, k, floor)
            for block in blocks(batches):
                search.show(block["x"], block["row"], block["vec_id"])
            i, j = np.nonzero(search.other >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row[i], vec_id[i], search.other[i, j], search.ids[i, j], search.score[i, j])], ["row", "query_id", "other", "vec_id", "score"])

        part = rows.mapInArrow(run, "row long, query_id long, other long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other"))
        part = stored(part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
        met = part if met is None else met.unionByName(part)
        shared.unpersist()
    dropped(spark, since, keep=groups)
    return met


def oracle_sql(queries: str, k: int, table: str = "embeddings") -> str:
    """best_products() in DuckDB's SQL: every query's product with every row."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM {table} WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e)::BIGINT AS score FROM (SELECT * FROM v WHERE {queries}) q JOIN v r ON q.vec_id <> r.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
