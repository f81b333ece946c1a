"""Exact top-k by inner product with M-trees.

Vectors are rows of a metric space after one more component, which makes all norms equal: then the
nearest vector is the one with the largest inner product. Rows are dealt to the nearest of a bounded number of pivots, and
what a pivot has into blocks of bounded size; each block becomes an M-tree of paged nodes, whose entries hold a routing vector,
a covering radius and the distance to the parent. A query first searches one tree of its own pivot. The k-th score that it finds there
bounds how far away better ones can be, so it then meets only trees whose pivot, less the covering radius around it, is within that
bound; a tree is loaded once for a block of its queries. A search takes nodes by their
lower bound, best first, and by the triangle inequality passes over entries whose stored distance to
the parent already shows that they are too far, before any distance to them is computed.

Scores are inner products of integers and exact; bounds are floating point with a margin, so
rounding never loses a row. Vectors that are null, or hold null or a non-finite component, and rows
without an id take no part; shorter vectors count as padded with zeros. Rows with equal ids are separate
candidates, and none of them is a candidate of a query with that id. Query rows with equal ids are one query; if their
vectors differ, with the least of them by components. Ties go to the smaller id. Components and scores beyond a 64-bit number are taken as the
nearest one. An empty table, or one without queries, gives an empty result. Only the id and the vector are read.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import materialise

BLOCK = 4096
QUERY_BLOCK = 4096
PAGE = 64
#: Pivots are sent to every task: some thousand numbers each at most.
PIVOTS = 8192


class Tree:
    """Nodes are pages: entries' rows, radii, distances to the parent, children (-1: a vector)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, seed: int = 1, top: float | None = None):
        """top: the largest squared norm of all trees that are searched together."""
        self.ids, self.vectors = ids, vectors
        self.top = float((vectors.astype(float) ** 2).sum(axis=1).max(initial=0.0)) if top is None else top
        self.points = _lifted(vectors, self.top)
        self.page, self.random = page, np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.computed = 0
        self.root = self._build(np.arange(len(ids)), None) if len(ids) else -1

    def _distances(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        to_parent = lambda at: np.zeros(len(at)) if parent is None else self._distances(at, parent)
        if len(rows) <= self.page:
            self.nodes.append((rows, np.zeros(len(rows)), to_parent(rows), np.full(len(rows), -1)))
            return len(self.nodes) - 1
        pivots = self.random.choice(rows, min(self.page, -(-len(rows) // self.page) + 1), replace=False)
        nearest = np.argmin(np.stack([self._distances(rows, self.points[p]) for p in pivots]), axis=0)
        groups = [(p, rows[nearest == i]) for i, p in enumerate(pivots)]
        if max(len(g) for _, g in groups) == len(rows):  # equal points: any halves do
            half = len(rows) // 2
            groups = [(rows[0], rows[:half]), (rows[half], rows[half:])]
        groups = [(p, g) for p, g in groups if len(g)]
        at = np.array([p for p, _ in groups])
        radii = np.array([self._distances(g, self.points[p]).max() for p, g in groups])
        children = np.array([self._build(g, self.points[p]) for p, g in groups])
        self.nodes.append((at, radii, to_parent(at), children))
        return len(self.nodes) - 1

    def search(self, own: int, query: np.ndarray, k: int, least: float = -math.inf) -> list[tuple[int, int]]:
        """(score, id) of the k best, best first; `own` is the query's id. Scores below `least` needn't be found."""
        if self.root < 0:
            return []
        # components beyond the block's width meet zeros only
        q = np.zeros(self.vectors.shape[1], dtype=np.int64)
        q[: min(len(q), len(query))] = query[: len(q)]
        point = np.append(q.astype(float), 0.0)
        square = float((point**2).sum())
        margin = 1e-9 * (1 + math.sqrt(square) + math.sqrt(self.top))
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(1, len(q)) < 2**52
        found: list[tuple[int, int]] = []  # a heap: the worst of the best, (score, -id), first
        # the distance of the worst of the best
        reach = bound_to = math.sqrt(max(0.0, square + self.top - 2.0 * least)) if least > -math.inf else math.inf
        queue = [(0.0, self.root, -1.0)]
        while queue:
            bound, node, above = heapq.heappop(queue)
            if bound > reach + margin:
                break
            rows, radii, to_parent, children = self.nodes[node]
            if above >= 0 and reach < math.inf:
                near = np.abs(above - to_parent) - radii <= reach + margin
                rows, radii, children = rows[near], radii[near], children[near]
            if not len(rows):
                continue
            self.computed += len(rows)
            if children[0] < 0:
                scores = (self.points[rows, :-1] @ q.astype(float)).astype(np.int64) if exact else _products(self.vectors[rows], q)
                ids = self.ids[rows]
                if len(found) == k:
                    hopeful = scores >= found[0][0]
                    scores, ids = scores[hopeful], ids[hopeful]
                for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                    if i == own:
                        continue
                    if len(found) < k:
                        heapq.heappush(found, (s, -i))
                    elif (s, -i) > found[0]:
                        heapq.heapreplace(found, (s, -i))
                if len(found) == k:
                    reach = min(bound_to, math.sqrt(max(0.0, square + self.top - 2.0 * found[0][0])))
            else:
                distances = self._distances(rows, point)
                for d, r, c in zip(distances.tolist(), radii.tolist(), children.tolist(), strict=True):
                    if d - r <= reach + margin:
                        heapq.heappush(queue, (max(0.0, d - r), c, d))
        return [(s, -i) for s, i in sorted(found, reverse=True)]

    def dump(self) -> bytes:
        out = io.BytesIO()
        parts = [np.concatenate(c) if c else np.zeros(0) for c in zip(*self.nodes, strict=True)]
        np.savez(out, ids=self.ids, vectors=self.vectors, points=self.points, top=self.top, root=self.root, sizes=[len(n[0]) for n in self.nodes], **{f"part{i}": p for i, p in enumerate(parts)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        z = np.load(io.BytesIO(data))
        tree = cls.__new__(cls)
        tree.ids, tree.vectors, tree.points, tree.top, tree.root, tree.computed = z["ids"], z["vectors"], z["points"], float(z["top"]), int(z["root"]), 0
        cuts = np.cumsum(z["sizes"])[:-1]
        tree.nodes = list(zip(*[np.split(z[f"part{i}"], cuts) for i in range(4)], strict=True))
        return tree


def _lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component, which makes all squared norms the largest."""
    real = vectors.astype(float)
    return np.hstack([real, np.sqrt(np.maximum(top - (real**2).sum(axis=1), 0))[:, None]])


def _matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(width, max(map(len, rows), default=0))), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products, as far as 64 bits go."""
    products = vectors.astype(object) @ q.astype(object)
    return np.clip(products, -(2**63), 2**63 - 1).astype(np.int64)


def _apart(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points to pivots; some pivots at a time."""
    return np.concatenate([np.sqrt(((points[:, None, :] - pivots[None, a : a + 64]) ** 2).sum(axis=2)) for a in range(0, len(pivots), 64)], axis=1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest inner products of floor(scale * x) for each query.

    vectors: vec_id and embedding. is_query: which rows are queries; all rows but the query's own are candidates.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound).select(F.col("vec_id").cast("long").alias("id"), whole.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, asking, width, top = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max(F.size("vector")), F.max(norm)).first()
    if not asking:
        return rows.filter("false").select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    chosen = rows.select("vector").orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(min(PIVOTS, -(-n // block))).collect()
    pivots = _lifted(_matrix(pa.array([r["vector"] for r in chosen], pa.list_(pa.int64())), width), top)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                apart = _apart(_lifted(_matrix(some.column(1), width), top), pivots)
                nearest = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(nearest, pa.int32()), pa.array(apart.min(axis=1))], names=["id", "vector", "asks", "pivot", "apart"])

    placed = materialise(rows.mapInArrow(place, "id long, vector array<long>, asks boolean, pivot int, apart double"), "placed")
    # a pivot's trees: as many as its rows need, so that one with a third of all rows has many
    cells = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).orderBy("pivot").collect()  # a row for each pivot
    own, first = {}, 0
    for r in cells:
        own[r["pivot"]] = (first, max(1, -(-r["n"] // block)))
        first += own[r["pivot"]][1]
    starts = F.broadcast(spark.createDataFrame([(p, a, m) for p, (a, m) in own.items()], "pivot int, first int, trees int"))
    tree = (F.col("first") + F.pmod(F.xxhash64(F.lit("tree"), "id"), F.col("trees"))).cast("int")

    def grow(rows: pa.Table) -> pa.Table:
        grown = Tree(rows.column("id").to_numpy(), _matrix(rows.column("vector"), width), top=top)
        return pa.table({"tree": rows.column("tree").slice(0, 1), "pivot": rows.column("pivot").slice(0, 1), "radius": pa.array([max(rows.column("apart").to_pylist())]), "payload": pa.array([grown.dump()], pa.binary())})

    grown = materialise(placed.join(starts, "pivot").select(tree.alias("tree"), "id", "vector", "pivot", "apart").groupBy("tree").applyInArrow(grow, "tree int, pivot int, radius double, payload binary"), "trees")
    asked = placed.filter("asks").groupBy("id").agg(F.min(F.struct("vector", "pivot")).alias("q")).select("id", "q.vector", "q.pivot").join(starts, "pivot")
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.lit("query"), "id"), F.lit(-(-asking // query_block))).cast("int"))

    def searched(queries: DataFrame) -> DataFrame:
        """query_id, vec_id and score: the best that each query (tree, part, id, vector, least) finds in its tree."""
        keys = queries.select(F.col("tree").alias("of"), F.col("part").alias("block")).distinct()
        loads = grown.select("tree", "payload").join(keys, F.col("tree") == F.col("of")).select("of", "block", "payload")

        def search(load: pa.Table, asking: pa.Table) -> pa.Table:
            found = []
            if len(load) and len(asking):
                tree = Tree.load(load.column("payload")[0].as_py())
                for q, v, least in zip(asking.column("id").to_pylist(), _matrix(asking.column("vector"), width), asking.column("least").to_pylist(), strict=True):
                    found += [(q, i, s) for s, i in tree.search(q, v, k, -math.inf if least is None else least)]
            return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], names=["query_id", "vec_id", "score"])

        return loads.groupBy("of", "block").cogroup(queries.select("tree", "part", "id", "vector", "least").groupBy("tree", "part")).applyInArrow(search, "query_id long, vec_id long, score long")

    # one tree of its own pivot gives each query a score that the k-th best can't be below
    none = F.lit(None).cast("long").alias("least")
    home = searched(asked.select(F.col("first").alias("tree"), "part", "id", "vector", none))
    bound = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    asked = materialise(asked.select("id", "vector", "part").join(bound, asked["id"] == bound["query_id"], "left").select("id", "vector", "part", "least"), "bounds")
    spheres = grown.select("tree", "pivot", "radius").collect()  # a row for each tree
    numbers, centers, radii = (np.array([r[c] for r in spheres]) for c in ("tree", "pivot", "radius"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                points = np.hstack([_matrix(some.column(1), width).astype(float), np.zeros((len(some), 1))])
                square = (points**2).sum(axis=1)
                least = np.array([-math.inf if s is None else s for s in some.column(3).to_pylist()])
                with np.errstate(over="ignore"):
                    reach = np.sqrt(np.maximum(0, square + top - 2 * least))
                margin = 1e-9 * (1 + np.sqrt(square) + math.sqrt(top))
                near = _apart(points, pivots)[:, centers] - radii <= (reach + margin)[:, None]
                which, at_tree = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[at_tree], pa.int32()), *(some.column(i).take(pa.array(which)) for i in (2, 0, 1, 3))], names=["tree", "part", "id", "vector", "least"])

    met = materialise(asked.mapInArrow(meet, "tree int, part int, id long, vector array<long>, least long"), "met")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return searched(met).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
