"""Regularised Gaussian inversion, leave-one-out errors and their mixture."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.physics import covariance
from tessella.operators import tiled
from tessella.operators.windows import dense_numbers, stored

#: A dense solve takes place in one worker; with more unknowns `solved` works in tiles, and `solved_nonnegative` is an error.
MOST_UNKNOWNS = 20_000
#: Unknowns beyond which `solved` works in tiles.
TILED = 4_000
#: Rows of a covariance that are made at a time.
ROWS = 512


def posterior(a: np.ndarray, residual: np.ndarray, noise: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Change of the unknowns and their covariance; noise is a diagonal. Solved in the space with fewer dimensions."""
    if len(a) < a.shape[1]:
        gain = np.linalg.solve(a @ prior @ a.T + np.diag(noise), a @ prior).T
        return gain @ residual, prior - gain @ a @ prior
    weighted = a.T / noise
    covariance = np.linalg.inv(weighted @ a + np.linalg.inv(prior))
    return covariance @ (weighted @ residual), covariance


def prior_covariance(sigma: float, lengths: tuple[float, ...], kind: str = "iso", diagonal: float = 0.0):
    """A function of coordinates (n, 3) that gives the covariance of the places: as functions.physics.covariance says it.

    Its `tile` is that of places with others, which may be the same ones.
    """

    def tile(one: np.ndarray, other: np.ndarray, same: bool) -> np.ndarray:
        apart = lambda axes: np.sqrt(sum((one[:, None, i] - other[None, :, i]) ** 2 for i in axes))
        if kind == "iso":
            reach = apart((0, 1, 2)) / lengths[0]
        else:
            flat, deep = apart((0, 1)) / lengths[0], apart((2,)) / lengths[1]
            reach = {"separable": lambda: flat + deep, "ellipsoidal": lambda: np.sqrt(flat**2 + deep**2)}[kind]()
        out = sigma**2 * np.exp(-reach)
        if same:
            np.fill_diagonal(out, (diagonal if diagonal > 0 else sigma) ** 2)
        return out

    def of(xyz: np.ndarray) -> np.ndarray:
        out = np.empty((len(xyz), len(xyz)))
        for k in range(0, len(xyz), ROWS):
            out[k : k + ROWS] = tile(xyz[k : k + ROWS], xyz, False)
        np.fill_diagonal(out, (diagonal if diagonal > 0 else sigma) ** 2)
        return out

    of.of_places, of.tile = True, tile
    return of


def solved(matrix: DataFrame, observed: DataFrame, unknowns: DataFrame, kernel, by: str = "run") -> DataFrame:
    """by, col, density and error of each run.

    matrix: by, row, col, value. observed: by, row, residual, variance. unknowns: col, x, y, z, prior; the same for all runs.
    kernel: (dx, dy, dz) arrays -> covariance, or what prior_covariance gives. The covariance is made where it is used, once for all runs of a task. More than
    TILED unknowns are solved in tiles.
    """
    if unknowns.count() > TILED:
        return tiled.solved(matrix, observed, unknowns, kernel, by)
    place = unknowns.orderBy("col").toPandas()  # bounded by the check above
    xyz, cols, start = place[["x", "y", "z"]].to_numpy(float), place["col"].to_numpy(), place["prior"].to_numpy(float)
    kind, made = matrix.schema[by].dataType.simpleString(), {}

    def prior() -> np.ndarray:
        if not made:
            made[0] = kernel(xyz) if getattr(kernel, "of_places", False) else kernel(*(xyz[:, None, i] - xyz[None, :, i] for i in range(3)))
        return made[0]

    def run(key: tuple, cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        order = {r: i for i, r in enumerate(rows["row"])}
        a = np.zeros((len(rows), len(cols)))
        kept = cells[cells["row"].isin(order) & cells["col"].isin(cols)]
        np.add.at(a, (kept["row"].map(order).to_numpy(int), np.searchsorted(cols, kept["col"])), kept["value"].to_numpy(float))
        change, covariance = posterior(a, rows["residual"].to_numpy(float), rows["variance"].to_numpy(float), prior())
        return pd.DataFrame({by: key[0], "col": cols, "density": start + change, "error": np.sqrt(np.maximum(0, np.diag(covariance)))})

    return matrix.groupBy(by).cogroup(observed.groupBy(by)).applyInPandas(run, f"{by} {kind}, col long, density double, error double")


def nonnegative(a: np.ndarray, b: np.ndarray, start: np.ndarray, weight: float, most: int = 10_000, near: float = 1e-12) -> np.ndarray:
    """The x >= 0 with the least |a x - b|^2 + weight |x - start|^2, by accelerated projected gradients."""
    step = 1 / (np.linalg.norm(a, 2) ** 2 + weight)
    x = y = np.maximum(start, 0.0)
    t = 1.0
    for _ in range(most):
        new = np.maximum(0.0, y - step * (a.T @ (a @ y - b) + weight * (y - start)))
        ahead = (1 + math.sqrt(1 + 4 * t * t)) / 2
        back = (y - new) @ (new - x) > 0  # the momentum leads up again
        y = new if back else new + (t - 1) / ahead * (new - x)
        t = 1.0 if back else ahead
        if np.abs(new - x).max(initial=0) <= near * (1 + np.abs(new).max(initial=0)) and not back:
            return new
        x = new
    return x


def solved_nonnegative(matrix: DataFrame, observed: DataFrame, unknowns: DataFrame, weight: float, by: str = "run") -> DataFrame:
    """by, col and density of each run: least squares of the observations with densities that aren't negative, held to the prior by weight.

    matrix: by, row, col, value. observed: by, row, value. unknowns: col, prior.
    """
    n = unknowns.count()
    if n > MOST_UNKNOWNS:
        raise ValueError(f"{n} unknowns; a dense solve takes {MOST_UNKNOWNS} at most")
    place = unknowns.orderBy("col").toPandas()  # bounded by the check above
    cols, start = place["col"].to_numpy(), place["prior"].to_numpy(float)
    kind = matrix.schema[by].dataType.simpleString()

    def run(key: tuple, cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        order = {r: i for i, r in enumerate(rows["row"])}
        a = np.zeros((len(rows), len(cols)))
        cells = cells[cells["row"].isin(order) & cells["col"].isin(cols)]
        np.add.at(a, (cells["row"].map(order).to_numpy(int), np.searchsorted(cols, cells["col"])), cells["value"].to_numpy(float))
        return pd.DataFrame({by: key[0], "col": cols, "density": nonnegative(a, rows["value"].to_numpy(float), start, weight)})

    return matrix.groupBy(by).cogroup(observed.groupBy(by)).applyInPandas(run, f"{by} {kind}, col long, density double")


def pairs(places: DataFrame, sigma: float, lengths: tuple[float, ...], kind: str = "iso", diagonal: float = 0.0) -> DataFrame:
    """one, other and the covariance of all pairs of places (col, x, y, z): the covariance matrix as a table, joined block by block."""
    known = stored(dense_numbers(places.select("col", "x", "y", "z"), ["col"], "__n").withColumn("__block", F.floor(F.col("__n") / ROWS)), "places")
    last = (known.agg(F.max("__block")).first()[0] or 0) + 1
    one, other = (known.select("__block", *[F.col(c).alias(f"{c}{i}") for c in ("col", "x", "y", "z")]) for i in (1, 2))
    one = one.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last - 1).cast("long"))))
    d = [F.col(f"{c}1") - F.col(f"{c}2") for c in "xyz"]
    value = covariance(kind, F.col("col1") == F.col("col2"), *d, sigma, lengths, diagonal)
    return one.join(other, "__block").select(F.col("col1").alias("one"), F.col("col2").alias("other"), value.alias("value"))


def largest_change(runs: DataFrame, whole: DataFrame, least: float = 1e-6) -> DataFrame:
    """col and the largest change against the whole, over runs that changed anything at all."""
    moved = runs.join(whole.select("col", F.col("density").alias("__whole")), "col").withColumn("change", F.abs(F.col("density") - F.col("__whole")))
    alive = runs.groupBy("run").agg(F.max(F.abs(F.col("density") - F.col("prior"))).alias("m")).filter(F.col("m") > least).select("run")
    return moved.join(alive, "run", "left_semi").groupBy("col").agg(F.max("change").alias("loo"))


def mixed(errors: DataFrame) -> DataFrame:
    """errors (prior_low, prior_high, stat, loo) with prior and mixed."""
    prior = F.abs(F.col("prior_high") - F.col("prior_low")) / 2
    return errors.withColumn("prior", prior).withColumn("mixed", F.sqrt(F.col("prior") * F.col("prior") + F.col("stat") * F.col("stat") + F.col("loo") * F.col("loo")))


def chi_square(observed: DataFrame, by: list[str]) -> DataFrame:
    out = observed.groupBy(*by).agg(F.sum(F.col("residual") * F.col("residual") / F.col("variance")).alias("chi2"), F.count(F.lit(1)).alias("ndf"))
    return out.withColumn("chi2_per_ndf", F.col("chi2") / F.col("ndf"))
