"""The Gaussian inversion in tiles: no task holds a whole matrix of unknowns by unknowns, and none holds the prior covariance.

With few observations and many unknowns all is solved in the observations' space. A is the matrix, C the prior covariance, N the noise:

1. gain: B = A C by columns of blocks; a task makes C tile by tile from coordinates as the blocks of A pass by.
2. system: S = B A' + N by rows of tiles, as the columns of B pass by.
3. factor: S = L L' by block elimination, a round for each row of tiles; a square on the diagonal is kept as its factor's inverse.
4. solution: V = L^-1 B by columns, as the tiles of L pass by; then the change is V' (L^-1 r) and the variance C_ii less V's squares.

What passes by is sorted, so a task holds the one column (or row) it works on, at most HELD bytes, and a tile or two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.intervals import bounded
from tessella.operators.windows import dense_numbers, stored

#: Rows in a tile, and the most columns.
TILE, WIDEST = 512, 1024
#: Bytes of the column of blocks that a task holds; with very many observations blocks are narrower.
HELD = 128 << 20


def tile(kernel: Callable, one: np.ndarray, other: np.ndarray, same: bool) -> np.ndarray:
    """Covariance of places (n, 3) with others; same: whether they are the same places in the same order."""
    if hasattr(kernel, "tile"):
        return kernel.tile(one, other, same)
    return kernel(*(one[:, None, i] - other[None, :, i] for i in range(3)))


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, dtype=np.float64).tobytes()


def _array(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(rows, -1)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from batch.itertuples(index=False)


def _places(x) -> np.ndarray:
    return np.array([x["x"], x["y"], x["z"]], dtype=float).T if isinstance(x, dict) else np.array([(p["x"], p["y"], p["z"]) for p in x], dtype=float).reshape(-1, 3)


def _in_tasks(rows: DataFrame, run: str, block: Column, parts: int, order: list[str]) -> DataFrame:
    """Each (run, block) whole in one of so many tasks, in order. The number is given, as the rows' bytes say little about the work."""
    deal = F.pmod(block.cast("long") + F.abs(F.xxhash64(F.col(run)) % 1_000_003), F.lit(parts)).cast("int")
    return rows.repartitionById(parts, deal).sortWithinPartitions(run, *order)


def _scattered(ri, ci, value, most: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows a block of the matrix has, and these rows as a dense array."""
    rows, at = np.unique(np.asarray(ri, dtype=np.int64), return_inverse=True)
    out = np.zeros((len(rows), width))
    np.add.at(out, (at, np.asarray(ci, dtype=np.int64)), np.asarray(value, dtype=float))
    return rows, out


def _gain(kernel: Callable, run: str) -> Callable:
    def tiles(key: tuple, b: np.ndarray) -> pd.DataFrame:
        cuts = range(0, len(b), TILE)
        return pd.DataFrame({run: key[0], "p": [k // TILE for k in cuts], "j": key[1], "data": [_bytes(b[k : k + TILE]) for k in cuts]})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, b = None, None
        for r in _rows(batches):
            if (r.run, r.j) != key:
                if key:
                    yield tiles(key, b)
                key, own = (r.run, r.j), np.stack([r.x1, r.y1, r.z1], axis=1)
                b = np.zeros((r.m, len(own)))
            rows, a = _scattered(r.ri, r.ci, r.value, r.m, len(r.x0))
            b[rows] += a @ tile(kernel, np.stack([r.x0, r.y0, r.z0], axis=1), own, r.i == r.j)
        if key:
            yield tiles(key, b)

    return of


def _system(run: str) -> Callable:
    def tiles(key: tuple, s: np.ndarray, variance: np.ndarray) -> pd.DataFrame:
        place = key[1] * TILE + np.arange(len(s))
        s[np.arange(len(s)), place] += variance
        cuts = range(0, (key[1] + 1) * TILE, TILE)
        return pd.DataFrame({run: key[0], "p": key[1], "q": [k // TILE for k in cuts], "n": len(s), "data": [_bytes(s[:, k : k + TILE]) for k in cuts]})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s, variance = None, None, None
        for r in _rows(batches):
            if (r.run, r.p) != key:
                if key:
                    yield tiles(key, s, variance)
                key, variance = (r.run, r.p), np.asarray(r.variance, dtype=float)
                s = np.zeros((len(variance), r.m))
            rows, a = _scattered(r.ri, r.ci, r.value, r.m, r.width)
            s[:, rows] += _array(r.data, len(variance)) @ a.T
        if key:
            yield tiles(key, s, variance)

    return of


def _factored(tiles: DataFrame, run: str, rounds: int, schema: str) -> DataFrame:
    """Tiles of L (run, p, q, n, data) of a symmetric system's lower tiles; a square on the diagonal is the inverse of its factor."""

    def pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["data"] = [_bytes(np.linalg.inv(np.linalg.cholesky(_array(d, n)))) for d, n in zip(b["data"], b["n"], strict=True)]
            yield b

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["data"] = [_bytes(_array(d, n) @ _array(inverse, k).T) for d, n, inverse, k in zip(b["data"], b["n"], b.pop("inverse"), b.pop("k"), strict=True)]
            yield b

    def less(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["data"] = [_bytes(_array(d, n) - _array(one, n) @ _array(other, k).T) for d, n, one, other, k in zip(b["data"], b["n"], b.pop("one"), b.pop("other"), b.pop("k"), strict=True)]
            yield b

    done = []
    for k in range(rounds):
        inverse = stored(tiles.filter((F.col("p") == k) & (F.col("q") == k)).mapInPandas(pivot, schema), "pivot")
        done.append(inverse)
        if k + 1 == rounds:
            break
        met = tiles.filter((F.col("p") > k) & (F.col("q") == k)).join(inverse.select(run, F.col("data").alias("inverse"), F.col("n").alias("k")), run)
        column = stored(met.mapInPandas(below, schema), "column")
        done.append(column)
        one, other = column.select(run, "p", F.col("data").alias("one")), column.select(run, F.col("p").alias("q"), F.col("data").alias("other"), F.col("n").alias("k"))
        rest = tiles.filter((F.col("p") > k) & (F.col("q") > k)).join(one, [run, "p"]).join(other, [run, "q"])
        tiles = stored(rest.select(run, "p", "q", "n", "data", "one", "other", "k").mapInPandas(less, schema), "rest")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _solution(run: str) -> Callable:
    def told(key: tuple, x: list[np.ndarray], y: list[np.ndarray], width: int) -> pd.DataFrame:
        v, r = np.concatenate(x), np.concatenate(y)
        return pd.DataFrame({run: key[0], "j": key[1], "place": np.arange(width), "change": v.T @ r, "less": np.einsum("ij,ij->j", v, v)})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x, y, width = None, [], [], 0
        b = r = None
        for row in _rows(batches):
            if (row.run, row.j) != key:
                if key:
                    yield told(key, x, y, width)
                key, x, y = (row.run, row.j), [], []
            if row.kind == 0:  # a tile of B, then those of L in its row, the diagonal last
                b, r = _array(row.data, row.n).copy(), np.asarray(row.residual, dtype=float).copy()
                width = b.shape[1]
            elif row.q < row.p:
                left = _array(row.data, row.n)
                b -= left @ x[row.q]
                r -= left @ y[row.q]
            else:
                inverse = _array(row.data, row.n)
                x.append(inverse @ b)
                y.append(inverse @ r)
        if key:
            yield told(key, x, y, width)

    return of


def solved(matrix: DataFrame, observed: DataFrame, unknowns: DataFrame, kernel: Callable, by: str = "run") -> DataFrame:
    """by, col, density and error of each run, as invert.solved gives them, for any number of unknowns.

    matrix: by, row, col, value. observed: by, row, residual, variance (positive). unknowns: col, x, y, z, prior; the same for all runs.
    kernel: (dx, dy, dz) arrays -> covariance, or what invert.prior_covariance gives; it depends on distances alone. Work grows with the square of the unknowns
    and with observations by unknowns; the observations' own system has a round of tasks for each TILE of a run's rows.
    """
    kind = matrix.schema[by].dataType.simpleString()
    known = stored(dense_numbers(unknowns.select("col", "x", "y", "z", "prior"), ["col"], "ci"), "unknowns")
    w = Window.partitionBy(by).orderBy("row")
    rows = observed.select(F.col(by).alias("run"), "row", F.col("residual").cast("double"), F.col("variance").cast("double"), (F.row_number().over(w) - 1).cast("long").alias("ri"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("m"))
    rows = stored(rows, "observations")
    size = rows.agg(F.max("m").alias("m"), F.countDistinct("run").alias("runs")).first()
    n, most = known.count(), size["m"] or 0
    if not n or not most:
        return known.select(F.lit(None).cast(kind).alias(by), "col", F.col("prior").alias("density"), F.lit(0.0).alias("error")).limit(0)
    width = max(16, min(WIDEST, HELD // (8 * most)))
    blocks, rounds = -(-n // width), -(-most // TILE)
    parts = min(100_000, max(1, blocks * size["runs"]))
    cells = matrix.select(F.col(by).alias("run"), "row", "col", F.col("value").cast("double")).join(rows.select("run", "row", "ri", "m"), ["run", "row"]).join(bounded(known.select("col", "ci")), "col")
    block = F.floor(F.col("ci") / width).cast("int")
    entries = F.collect_list(F.struct("ri", (F.col("ci") % width).cast("int").alias("ci"), "value"))
    # so that a run without any entries has its prior for a solution
    none = rows.filter("ri = 0").select("run", "m", "ri", F.lit(0).cast("long").alias("ci"), F.lit(0.0).alias("value"))
    listed = cells.select(*none.columns).unionByName(none).groupBy("run", "m", block.alias("i")).agg(entries.alias("e")).select("run", "m", "i", F.col("e.ri").alias("ri"), F.col("e.ci").alias("ci"), F.col("e.value").alias("value"))
    listed = stored(listed, "matrix-blocks")
    # a block of places has `width` of them
    place = known.groupBy(block.alias("i")).agg(F.array_sort(F.collect_list(F.struct("ci", "x", "y", "z"))).alias("p"))
    places = stored(place.select("i", *[F.col(f"p.{c}").cast("array<double>").alias(c) for c in "xyz"]), "places")
    at = [places.select(F.col("i").alias(k), *[F.col(c).alias(f"{c}{e}") for c in "xyz"]) for e, k in ((0, "i"), (1, "j"))]

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j")
    passing = listed.join(at[0], "i").select("*", every).join(bounded(at[1]), "j")
    gain = _in_tasks(passing, "run", F.col("j"), parts, ["j", "i"]).mapInPandas(_gain(kernel, "run"), f"run {kind}, p int, j int, data binary")
    gain = stored(gain, "gain")

    panels = rows.withColumn("p", F.floor(F.col("ri") / TILE).cast("int")).groupBy("run", "p").agg(F.array_sort(F.collect_list(F.struct("ri", "residual", "variance"))).alias("o"))
    panels = stored(panels.select("run", "p", F.col("o.residual").alias("residual"), F.col("o.variance").alias("variance")), "panels")
    widths = F.least(F.lit(width), F.lit(n) - F.col("j") * width).cast("int").alias("width")
    passing = gain.join(listed.withColumnRenamed("i", "j"), ["run", "j"]).join(bounded(panels.select("run", "p", "variance")), ["run", "p"]).select("*", widths)
    schema = f"run {kind}, p int, q int, n int, data binary"
    lower = _in_tasks(passing, "run", F.col("p"), max(1, min(100_000, rounds * size["runs"])), ["p", "j"]).mapInPandas(_system("run"), schema)
    left = stored(_factored(stored(lower, "system"), "run", rounds, schema), "factor")

    nothing = F.lit(None).cast("array<double>").alias("residual")
    tiles = gain.join(bounded(panels.select("run", "p", "residual")), ["run", "p"]).select("run", "j", "p", F.lit(-1).alias("q"), F.lit(0).alias("kind"), F.size("residual").alias("n"), "data", "residual")
    passing = tiles.unionByName(left.select("run", every, "p", "q", F.lit(1).alias("kind"), "n", "data", nothing))
    found = _in_tasks(passing, "run", F.col("j"), parts, ["j", "p", "kind", "q"]).mapInPandas(_solution("run"), f"run {kind}, j int, place long, change double, less double")
    own = float(tile(kernel, np.zeros((1, 3)), np.zeros((1, 3)), True)[0, 0])
    out = found.select(F.col("run").alias(by), (F.col("j").cast("long") * width + F.col("place")).alias("ci"), "change", "less").join(known.select("ci", "col", "prior"), "ci")
    return out.select(by, F.col("col").cast("long"), (F.col("prior") + F.col("change")).alias("density"), F.sqrt(F.greatest(F.lit(0.0), F.lit(own) - F.col("less"))).alias("error"))
