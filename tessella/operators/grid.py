"""Grids as tables of cells: binning, merging, splitting, structures and shells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import geometry
from tessella.functions.axis import EPSILON, Axis


def binned(points: DataFrame, x: Axis, y: Axis, xs: Column, ys: Column) -> DataFrame:
    """points with ix and iy; those outside are dropped."""
    return points.withColumns({"ix": x.index(xs), "iy": y.index(ys)}).filter("ix IS NOT NULL AND iy IS NOT NULL")


def histogram(points: DataFrame, x: Axis, y: Axis, xs: Column, ys: Column, weight: Column) -> DataFrame:
    return binned(points, x, y, xs, ys).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("z"))


def cell_means(points: DataFrame, x: Axis, y: Axis, xs: Column, ys: Column, value: Column) -> DataFrame:
    return binned(points, x, y, xs, ys).groupBy("ix", "iy").agg(F.avg(value).alias("z"))


def last_in_cell(points: DataFrame, x: Axis, y: Axis, xs: Column, ys: Column, z: Column, order: Column, base: float, density: float) -> DataFrame:
    """Pillars from scattered points: of several in a cell the last by `order` counts; at or below the base nothing stands."""
    cells = binned(points, x, y, xs, ys).groupBy("ix", "iy").agg(F.max_by(z, order).alias("zmax"))
    return cells.select("ix", "iy", F.lit(base).alias("zmin"), "zmax", F.when(F.col("zmax") > base, density).otherwise(0.0).alias("density"))


def infer_axis(values: DataFrame, column: str, tolerance: float = 1e-4, shifted: bool = True, strict: bool = False) -> DataFrame:
    """min, max, interval, nbin and uniform of the axis that the distinct values stand on; edges half a step out if shifted.

    The interval is the first step; the axis is uniform if no step departs from it by more than `tolerance` of that step. strict: else
    it is an error. Only the distinct values are ordered, which are as many as the axis has bins.
    """
    distinct = values.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").distinct()
    w = Window.orderBy("v")
    steps = distinct.withColumn("step", F.col("v") - F.lag("v").over(w))
    steps = steps.withColumn("first", F.first("step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = steps.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.first("first").alias("interval"), F.max(F.abs(F.col("step") - F.col("first")) - F.col("step") * tolerance).alias("off"))
    half = F.col("interval") / 2 if shifted else F.lit(0.0)
    end = F.col("interval") / 2 if shifted else F.col("interval")
    nbin = (F.floor((F.col("high") - F.col("low")) / F.col("interval") + 0.5) + 1).cast("int")
    even = F.col("off") <= 0
    even = F.when(even, True).otherwise(F.raise_error(F.lit(f"{column} has uneven steps")).cast("boolean")) if strict else even
    return out.select((F.col("low") - half).alias("min"), (F.col("high") + end).alias("max"), "interval", nbin.alias("nbin"), even.alias("uniform"))


def merged(cells: DataFrame, keys: list[str], factor: int, value: str, firsts: list[int] | None = None, bins: list[int] | None = None) -> DataFrame:
    """Blocks of factor cells a side that are complete, with their mean; others are dropped. firsts: where blocks begin.

    bins: the numbers of bins of the axes. With them, only blocks that begin before the last possible beginning are
    made, so a block that ends with the axis is left out; an axis shorter than a block has one.
    """
    starts = firsts or [0] * len(keys)
    block = [F.floor((F.col(k) - s) / factor).cast("int").alias(k) for k, s in zip(keys, starts, strict=True)]
    out = cells.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(value)).filter(F.col("n") == factor ** len(keys)).drop("n")
    for k, s, n in zip(keys, starts, bins or [], strict=False):
        out = out.filter((F.col(k) * factor + s < n - factor) | F.lit(n < factor))
    return out


def merged_away(cells: DataFrame, blocks: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """cells, of which those that went into a block no longer exist (tf_exist)."""
    gone = blocks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias("__gone"))
    on = [F.floor(cells[k] / factor).cast("int") == gone[f"__{k}"] for k in keys]
    return cells.join(gone, on, "left").withColumn("tf_exist", F.col("tf_exist") & F.col("__gone").isNull()).select(*cells.columns)


def split(cells: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Every cell as factor cells a side, with its other columns."""
    for k in keys:
        cells = cells.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(k, (F.col(k) * factor + F.col("__s")).cast("int")).drop("__s")
    return cells


def overlaid(fine: DataFrame, coarse: DataFrame, keys: list[str], factor: int, value: str) -> DataFrame:
    """fine with the value of its merged cell, where there is one."""
    other = coarse.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("__value"))
    on = [F.floor(fine[k] / factor).cast("int") == other[f"__{k}"] for k in keys]
    return fine.join(other, on, "left").withColumn(value, F.coalesce("__value", value)).select(*fine.columns)


def structure(cells: DataFrame, inside: Column, delta: float, exists: Column | None = None) -> DataFrame:
    """density raised by delta where inside, and where a cell exists."""
    return cells.withColumn("density", F.col("density") + F.when(inside & (F.lit(True) if exists is None else exists), delta).otherwise(0.0))


def extents(cells: DataFrame, keys: list[str], z: str) -> DataFrame:
    """Lowest and highest level of each column, and their number."""
    return cells.groupBy(*keys).agg(F.min(z).alias("low"), F.max(z).alias("high"), F.count(F.lit(1)).alias("n"))


def shells(pillars: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Terrain split by the reconstructed column (z_low to z_high): upper and lower shell there, lateral shell elsewhere."""
    out = pillars.join(columns.select(*keys, "z_low", "z_high"), keys, "left")
    has = F.col("z_low").isNotNull()
    return out.select(*keys, F.when(has, F.greatest(F.lit(0.0), F.col("zmax") - F.col("z_high"))).otherwise(0.0).alias("upper"), F.when(has, F.greatest(F.lit(0.0), F.col("z_low") - F.col("zmin"))).otherwise(0.0).alias("lower"), F.when(has, 0.0).otherwise(F.col("zmax") - F.col("zmin")).alias("lateral"))


def voxels(pillars: DataFrame, z: Axis) -> DataFrame:
    """Cells of pillars: from the bin of their base up to below that of their top they exist; the one with the top doesn't, and has a
    density by its fill; all others are empty. A pillar that rises above the axis is an error."""
    iz = F.explode(F.sequence(F.lit(0), F.lit(z.nbin - 1))).alias("iz")
    bin_of = lambda v: F.floor((F.col(v) - z.min + EPSILON * z.interval) / z.interval)
    out = pillars.select("ix", "iy", "zmax", "density", F.greatest(F.lit(0), bin_of("zmin")).alias("__from"), F.least(F.lit(z.nbin - 1), bin_of("zmax")).alias("__to"), iz)
    fill = (F.col("zmax") - z.lower(F.col("iz"))) / z.interval
    full, top = (F.col("__from") <= F.col("iz")) & (F.col("iz") < F.col("__to")), F.col("iz") == F.col("__to")
    part = F.when(fill <= 1, F.col("density") * F.greatest(F.lit(0.0), fill)).otherwise(F.raise_error(F.lit("a pillar above the grid")).cast("double"))
    return out.select("ix", "iy", "iz", full.alias("tf_exist"), F.when(full, F.col("density")).when(top, part).otherwise(0.0).alias("density"))


def slices(pillars: DataFrame, levels: list[float]) -> DataFrame:
    """The terrain's horizontal sections."""
    out = pillars.withColumn("z", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    inside = (F.col("zmin") <= F.col("z")) & (F.col("z") < F.col("zmax"))
    return out.select("ix", "iy", "z", F.when(inside, F.col("density")).otherwise(0.0).alias("density"))


def raised(pillars: DataFrame, columns: DataFrame) -> DataFrame:
    """The base of pillars lifted to the top of the cells in their column; a top above the terrain is an error."""
    out = pillars.join(columns.select("ix", "iy", "z_high"), ["ix", "iy"], "left")
    top = F.when(F.col("z_high") > F.col("zmax"), F.raise_error(F.lit("cells above the terrain")).cast("double")).otherwise(F.coalesce("z_high", "zmin"))
    return out.withColumn("zmin", top).drop("z_high")


def above_terrain(points: DataFrame, pillars: DataFrame, x: Axis, y: Axis) -> DataFrame:
    """points (x, y, z) with dz, their height above the terrain; those outside are dropped."""
    out = binned(points, x, y, F.col("x"), F.col("y")).join(pillars.select("ix", "iy", "zmax"), ["ix", "iy"])
    return out.withColumn("dz", F.col("z") - F.col("zmax"))


def difference(one: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """one minus other, cell by cell; a cell that only one has is an error."""
    out = one.select(*keys, F.col(value).alias("__a")).join(other.select(*keys, F.col(value).alias("__b")), keys, "full")
    checked = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("grids of different shape")).cast("double")).otherwise(F.col("__a") - F.col("__b"))
    return out.select(*keys, checked.alias(value))


def checked_inside(points: DataFrame, x: Axis, y: Axis, what: str = "a point outside the grid") -> DataFrame:
    """points, or an error if one of them (x, y) is outside."""
    inside = x.index(F.col("x")).isNotNull() & y.index(F.col("y")).isNotNull()
    return points.withColumn("x", F.when(inside, F.col("x")).otherwise(F.raise_error(F.lit(what)).cast("double")))


def profile_along(cells: DataFrame, pillars: DataFrame, x: Axis, y: Axis, rays: DataFrame, most: float) -> DataFrame:
    """ray_id, distance of each crossed cell's centre and height of the terrain there over the ray's start, up to a distance.

    cells: ray_id, ix, iy. rays: ray_id, px, py, pz.
    """
    out = cells.join(pillars.select("ix", "iy", "zmax"), ["ix", "iy"]).join(rays.select("ray_id", "px", "py", "pz"), "ray_id")
    dx, dy = x.center(F.col("ix")) - F.col("px"), y.center(F.col("iy")) - F.col("py")
    return out.select("ray_id", F.sqrt(dx * dx + dy * dy).alias("distance"), (F.col("zmax") - F.col("pz")).alias("height")).filter(F.col("distance") <= most)


def in_circle(cells: DataFrame, x: Axis, y: Axis, center: tuple[float, float], radius: float) -> DataFrame:
    """The cells whose centre is within a circle."""
    dx, dy = x.center(F.col("ix")) - center[0], y.center(F.col("iy")) - center[1]
    return cells.filter(dx * dx + dy * dy <= radius * radius)


def in_rectangle(cells: DataFrame, x: Axis, y: Axis, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """The cells whose centre is within a half-open rectangle."""
    return cells.filter(geometry.in_box([x.center(F.col("ix")), y.center(F.col("iy"))], list(low), list(high)))


def lowest_top(pillars: DataFrame, x: Axis, y: Axis, circles: DataFrame) -> DataFrame:
    """circles (cx, cy, radius) with zmax, the least top of the pillars whose centre is within; of the pillar below the middle, if there is none.

    A middle outside the grid is an error.
    """
    dx, dy = x.center(F.col("ix")) - F.col("cx"), y.center(F.col("iy")) - F.col("cy")
    at = (F.col("ix") == x.index(F.col("cx"))) & (F.col("iy") == y.index(F.col("cy")))
    within = dx * dx + dy * dy <= F.col("radius") * F.col("radius")
    covered = circles
    for a, name, middle in ((x, "ix", "cx"), (y, "iy", "cy")):  # the cells around each circle, a row each
        first, last = (F.floor((F.col(middle) + s * F.col("radius") - a.min) / a.interval) for s in (-1, 1))
        span = F.transform(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.lit(a.nbin - 1))), lambda i: i.cast("int"))
        covered = covered.withColumn(name, F.explode(F.when((last >= -1) & (first <= a.nbin), span)))
    met = covered.filter(within | at).join(pillars.select("ix", "iy", F.col("zmax").alias("__z")), ["ix", "iy"])
    out = met.groupBy(*circles.columns).agg(F.coalesce(F.min(F.when(within, F.col("__z"))), F.min(F.when(at, F.col("__z")))).alias("zmax"))
    inside = x.index(F.col("cx")).isNotNull() & y.index(F.col("cy")).isNotNull()
    every = circles.withColumn("cx", F.when(inside, F.col("cx")).otherwise(F.raise_error(F.lit("a circle outside the grid")).cast("double")))
    return every.join(out, circles.columns)


def average_density(shell: DataFrame, cells: DataFrame, area: float, volume: float) -> DataFrame:
    """One row: mass and volume of pillars (of an area) and of cells that exist (of a volume), together and their ratio."""
    height = F.col("zmax") - F.col("zmin")
    one = shell.select((height * area).alias("volume"), (height * area * F.col("density")).alias("mass"))
    other = cells.filter("tf_exist").select(F.lit(volume).alias("volume"), (F.col("density") * volume).alias("mass"))
    out = one.unionByName(other).agg(F.sum("volume").alias("volume"), F.sum("mass").alias("mass"))
    return out.withColumn("density", F.try_divide("mass", "volume"))


def reconstructed(cells: DataFrame, axes: list[Axis], center: tuple[float, float, float], widths: tuple[float, float, float], radii: tuple[float, float] | None = None, angle: float = 0.0) -> DataFrame:
    """The cells whose centre is within a box of full widths around a place, and within an upright elliptic cylinder there, if radii are given."""
    at = [a.center(F.col(f"i{n}")) for a, n in zip(axes, "xyz", strict=True)]
    inside = geometry.in_box(at, [c - w / 2 for c, w in zip(center, widths, strict=True)], [c + w / 2 for c, w in zip(center, widths, strict=True)])
    return cells.filter(inside & geometry.in_ellipse(at[0], at[1], center[:2], radii, angle) if radii else inside)


def single_shell(pillars: DataFrame, columns: DataFrame, x: Axis, y: Axis, other_x: Axis, other_y: Axis) -> DataFrame:
    """pillars raised to the highest cell (z_high) of the coarser column that holds their centre; others stay."""
    placed = pillars.withColumns({"__x": other_x.index(x.center(F.col("ix"))), "__y": other_y.index(y.center(F.col("iy")))})
    top = columns.select(F.col("ix").alias("__x"), F.col("iy").alias("__y"), "z_high")
    return placed.join(top, ["__x", "__y"], "left").withColumn("zmin", F.coalesce("z_high", "zmin")).select(*pillars.columns)


def nearest_slice(nodes: DataFrame, x: Axis, at: float) -> DataFrame:
    """iy and z of the column whose lower edge is nearest to a place."""
    i = min(x.nbin - 1, max(0, math.floor((at - x.min) / x.interval + 0.5)))
    return nodes.filter(F.col("ix") == i).select("iy", "z")


def interpolated_slice(nodes: DataFrame, x: Axis, at: float) -> DataFrame:
    """iy and z at a place between two columns; the last column stands for what is beyond it."""
    if not x.min <= at < x.max:
        raise ValueError("a place outside the axis")
    i = min(x.nbin - 1, math.floor((at - x.min) / x.interval + EPSILON))
    f = (at - x.min) / x.interval - i
    both = nodes.filter(F.col("ix").isin(i, i + 1)).groupBy("iy").agg(F.max(F.when(F.col("ix") == i, F.col("z"))).alias("a"), F.max(F.when(F.col("ix") == i + 1, F.col("z"))).alias("b"))
    return both.select("iy", (F.col("a") * (1 - f) + F.coalesce("b", "a") * f).alias("z"))
