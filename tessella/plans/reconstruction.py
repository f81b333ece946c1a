"""The reconstruction as a plan of stages: terrain, paths, counts, matrix, solution, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.angles import effective_area, from_tangents, rotation, solid_angle, turned
from tessella.operators import invert, matrix
from tessella.operators.trace import path_sums

SECONDS = 86400.0


def elements(panels: DataFrame) -> DataFrame:
    """Angular bins of each panel, with direction, solid angle and exposure.

    panels: detid, nbinx, txmin, txmax, nbiny, tymin, tymax, yaw, roll, pitch (radians), px, py, pz, hori, vert, dept, n_unit, days.
    """
    out = panels.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nbinx") - 1))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("nbiny") - 1)))
    wx, wy = ((F.col(f"t{k}max") - F.col(f"t{k}min")) / F.col(f"nbin{k}") for k in "xy")
    out = out.withColumns({"tx0": F.col("txmin") + F.col("ix") * wx, "tx1": F.col("txmin") + (F.col("ix") + 1) * wx, "ty0": F.col("tymin") + F.col("iy") * wy, "ty1": F.col("tymin") + (F.col("iy") + 1) * wy})
    tx, ty = (F.col("tx0") + F.col("tx1")) / 2, (F.col("ty0") + F.col("ty1")) / 2
    local = from_tangents(tx, ty)
    v = turned(rotation(-F.col("yaw"), F.col("roll"), F.col("pitch")), local)
    area = effective_area(F.abs(local[1]), tx, ty, F.col("hori"), F.col("vert"), F.col("dept"), F.col("n_unit"))
    sot = area * solid_angle(F.col("tx0"), F.col("tx1"), F.col("ty0"), F.col("ty1")) * F.col("days") * SECONDS
    inthis = F.col("ix") + F.col("iy") * F.col("nbinx")
    ray = (F.col("detid").cast("long") * (1 << 32) + inthis).alias("ray_id")
    return out.select("detid", inthis.alias("inthis"), "ix", "iy", ray, "px", "py", "pz", v[0].alias("vx"), v[1].alias("vy"), v[2].alias("vz"), sot.alias("sot"))


def counts(rays: DataFrame, cells: DataFrame, densities: DataFrame, flux: Column) -> DataFrame:
    """rays with pl, dl and n, the expected count. cells: ray_id, ix, iy, iz, length. flux: of `vz` and `dl`."""
    paths = path_sums(cells, densities, ["ix", "iy", "iz"])
    out = rays.join(paths, "ray_id", "left").withColumns({"pl": F.coalesce("pl", F.lit(0.0)), "dl": F.coalesce("dl", F.lit(0.0))})
    return out.withColumn("n", flux * F.col("sot"))


def observation(cells: DataFrame, numbers: DataFrame, slopes: DataFrame, groups: DataFrame) -> DataFrame:
    """The matrix of groups by cells: path lengths times the count's slope, rows summed before anything is made dense.

    numbers: ix, iy, iz, col. slopes: row (ray), factor. groups: row (ray), grp.
    """
    lengths = cells.join(numbers, ["ix", "iy", "iz"]).select(F.col("ray_id").alias("row"), "col", F.col("length").alias("value"))
    return matrix.grouped_rows(matrix.scaled_rows(lengths, slopes), groups).withColumnRenamed("grp", "row")


def with_leave_one_out(observations: DataFrame, observed: DataFrame, unknowns: DataFrame, kernel, owners: list[int]) -> tuple[DataFrame, DataFrame]:
    """The whole solution (run -1), and the largest change of each unknown when one owner's rows are left out.

    observations: owner, row, col, value; observed: owner, row, residual, variance. All runs are solved side by side.
    """
    runs = F.explode(F.array(*[F.lit(o) for o in [-1, *owners]])).alias("run")
    cut = lambda df: df.select("*", runs).filter(F.col("owner") != F.col("run")).drop("owner")
    out = invert.solved(cut(observations), cut(observed), unknowns, kernel).join(unknowns.select("col", "prior"), "col")
    whole = out.filter("run = -1")
    return whole, invert.largest_change(out.filter("run <> -1"), whole)


def rebuilt_prior(shells: DataFrame, cells: DataFrame, left_out: DataFrame, densities: tuple[float, float, float, float]) -> DataFrame:
    """ray_id, pl and dl under other densities (cells, upper, lower and lateral shell), from path lengths that were traced once.

    shells: ray_id, kind (upper, lower, lateral), pl. cells and left_out: ray_id, pl in cells that are solved for, and in those too few panels see.
    """
    by_kind = dict(zip(("upper", "lower", "lateral"), densities[1:], strict=True))
    rho = F.lit(None).cast("double")
    for kind, d in by_kind.items():
        rho = F.when(F.col("kind") == kind, d).otherwise(rho)
    parts = shells.select("ray_id", "pl", (F.col("pl") * rho).alias("dl"))
    for more in (cells, left_out):
        parts = parts.unionByName(more.select("ray_id", "pl", (F.col("pl") * densities[0]).alias("dl")))
    return parts.groupBy("ray_id").agg(F.sum("pl").alias("pl"), F.sum("dl").alias("dl"))


def relinearised(lengths: DataFrame, densities: DataFrame, slope: Column, sot: DataFrame) -> DataFrame:
    """The matrix of rays by cells around other densities: lengths times the slope at the density length that these give.

    lengths: row (ray), col, value. densities: col, x. sot: row, sot. slope: of `dl`.
    """
    paths = matrix.times_vector(lengths, densities).withColumnRenamed("value", "dl").join(sot, "row")
    return matrix.scaled_rows(lengths, paths.select("row", (slope * F.col("sot")).alias("factor")))


def heights(places: DataFrame, z: Column, floor: float) -> DataFrame:
    """places, or an error if one lies below the grid's floor."""
    return places.withColumn("pz", F.when(z >= floor, z).otherwise(F.raise_error(F.lit("a panel below the grid")).cast("double")))
