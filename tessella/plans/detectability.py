"""Which anomalies a panel would detect: windows over an angular grid, base against changed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import p_one_sided, p_two_sided, z_value
from tessella.functions.angles import convert
from tessella.functions.axis import Axis
from tessella.functions.geometry import candidate_angles, cylinder_radius, highest_allowed
from tessella.operators.grid import binned
from tessella.operators.windows import prefix_sums, rectangle_sums


def windows(panels: DataFrame, sizes: list[int], step: int) -> DataFrame:
    """rect_id and bounds of square windows that slide down each panel's middle. panels: det, nx, ny.

    As many as whole steps fit into what a window can move, one at least; so the lowest place is left out where steps fit evenly.
    """
    out = panels.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).filter("size <= nx AND size <= ny")
    steps = F.greatest(F.lit(1), F.floor((F.col("ny") - F.col("size")) / step).cast("int"))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0), steps - 1)))
    y1 = F.col("ny") - F.col("i") * step
    x0 = F.floor((F.col("nx") - F.col("size")) / 2).cast("int")
    return out.select("det", "size", "i", x0.alias("x0"), (x0 + F.col("size")).alias("x1"), (y1 - F.col("size")).cast("int").alias("y0"), y1.cast("int").alias("y1"))


def depth_windows(tries: DataFrame, step: float, unit: str = "tangent") -> DataFrame:
    """tries with i, ty0, ty1 and the depths (top, bottom) below the surface between which a window sees, from the highest window down.

    tries: half (of a window, across and up), ty_min, ty_max, height (of the object's top above the panel), distance (horizontal), rise
    (of the surface above the object's top). Windows that look over the object's top are left out.
    """
    length = (F.col("ty_max") - F.col("half")) - (F.col("ty_min") + F.col("half"))
    out = tries.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(length / step).cast("int")) - 1)))
    middle = F.col("ty_max") - F.col("half") - F.col("i") * step
    out = out.withColumns({"ty0": middle - F.col("half"), "ty1": middle + F.col("half")})
    below = lambda ty: F.col("height") - convert(F.col(ty), unit, "tangent") * F.col("distance")
    out = out.withColumns({"__top": below("ty1"), "__bottom": below("ty0")}).filter("__top >= 0")
    return out.withColumns({"depth_top": F.col("__top") + F.col("rise"), "depth_bottom": F.col("__bottom") + F.col("rise")}).drop("__top", "__bottom")


def cylinder_tries(panels: DataFrame, unit: str, least_size: float, most_size: float, factor: float = 1.0) -> DataFrame:
    """A row for each panel and each size of an upright cylinder at the object that it might see: what `depth_windows` takes, and size.

    panels: det, distance, interval and nbin of the angles across, ty_min, ty_max, elev_det, elev_object (the lowest surface over the object), elev_surface.
    A size is left out if it is below the least, larger than the surface is high above the panel, or reaches out of the top at every angle.
    """
    tries = panels.withColumn("angle", F.explode(candidate_angles(F.col("distance"), most_size, F.col("interval"), F.col("nbin"), unit)))
    out = tries.withColumns({"size": 2 * cylinder_radius(F.col("distance"), F.col("angle")), "height": F.col("elev_object") - F.col("elev_det"), "rise": F.col("elev_surface") - F.col("elev_object")})
    out = out.filter((F.col("size") >= least_size) & (F.col("size") <= F.col("elev_surface") - F.col("elev_det")))
    out = out.withColumns({"half": convert(F.col("angle"), "radian", unit) * factor, "ty_max": F.least("ty_max", highest_allowed(F.col("height"), F.col("size"), unit))})
    return out.filter("ty_max > ty_min")


def tested(bins: DataFrame, rectangles: DataFrame, deltas: list[float], amplifiers: list[float], alphas: list[float], changed, both_sides: bool = False) -> DataFrame:
    """A row for each window, change, amplifier and level.

    bins: ix, iy, signal (and what `changed` needs); of one panel. changed: delta column -> changed signal column.
    """
    base = rectangle_sums(prefix_sums(bins, "signal"), rectangles).withColumnRenamed("total", "signal_base")
    modified = bins.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    modified = modified.withColumn("changed", changed(F.col("delta")))
    sums = prefix_sums(modified.select("delta", "ix", "iy", "changed"), "changed", ["delta"])
    per = rectangles.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    for i, (a, b) in enumerate((("x1", "y1"), ("x0", "y1"), ("x1", "y0"), ("x0", "y0"))):
        at = sums.select(F.col("delta").alias(f"__d{i}"), (F.col("ix") + 1).alias(f"__x{i}"), (F.col("iy") + 1).alias(f"__y{i}"), F.col("s").alias(f"__s{i}"))
        per = per.join(at, (per["delta"] == at[f"__d{i}"]) & (per[a] == at[f"__x{i}"]) & (per[b] == at[f"__y{i}"]), "left").drop(f"__d{i}", f"__x{i}", f"__y{i}")
    s = [F.coalesce(F.col(f"__s{i}"), F.lit(0.0)) for i in range(4)]
    per = per.withColumn("signal_modi", s[0] - s[1] - s[2] + s[3]).drop(*[f"__s{i}" for i in range(4)])
    keys = [c for c in rectangles.columns]
    out = per.join(base.select(*keys, "signal_base"), keys)
    out = out.withColumn("signal_amp", F.explode(F.array(*[F.lit(float(a)) for a in amplifiers]))).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    z = z_value(F.col("signal_base") * F.col("signal_amp"), F.col("signal_modi") * F.col("signal_amp"))
    p = p_two_sided(F.col("z_val")) if both_sides else p_one_sided(F.col("z_val"))
    return out.withColumn("z_val", z).withColumn("p_val", p).withColumn("is_signi", (F.col("p_val") < F.col("alpha")).cast("int"))


#: Order of a significance list.
ORDER = (("alpha", False), ("signal_amp", True), ("delta", False), ("size", True), ("i", True))


def in_order(rows: DataFrame, keys: tuple[tuple[str, bool], ...] = ORDER) -> DataFrame:
    return rows.orderBy(*[F.asc(k) if up else F.desc(k) for k, up in keys])


def heat_map(rows: DataFrame, x: Axis, y: Axis, xs: Column, ys: Column, amplifier: float, delta: float) -> DataFrame:
    """ix, iy, and the mean and least log10 of p (cut off at 1e-10) of the tests with an amplifier and a change."""
    chosen = rows.filter((F.col("signal_amp") == amplifier) & (F.col("delta") == delta)).withColumn("__log", F.log10(F.greatest(F.lit(1e-10), F.least(F.lit(1.0), F.col("p_val")))))
    return binned(chosen, x, y, xs, ys).groupBy("ix", "iy").agg(F.avg("__log").alias("mean"), F.min("__log").alias("least"))
