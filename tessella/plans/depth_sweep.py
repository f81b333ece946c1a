"""The depth sweep: which anomalies each panel would see below a mountain, from panels and pillars to a significance list.

An upright cylinder stands at the object, as high as the lowest surface over it. For every panel, turned to the object, and every size that is a multiple of its bins,
a window as wide as the object slides down; counts in it with and without a change of density are compared. All panels, sizes and changes
are priced in one plan: a window's columns of bins depend on the size alone, so counts are summed to a line of rows for each (panel, size, change), and
running sums of these lines answer every window by two look-ups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.angles import aimed, convert, rotation, turned
from tessella.functions.axis import EPSILON, Axis
from tessella.functions.geometry import candidate_angles, cylinder_chord, cylinder_radius, highest_allowed
from tessella.functions.stats import p_one_sided, p_two_sided, z_value
from tessella.operators import grid
from tessella.operators.intervals import bounded
from tessella.operators.trace import pillar_stretches
from tessella.operators.windows import stored
from tessella.plans.detectability import depth_windows
from tessella.plans.reconstruction import elements
from tessella.sources.sinks import SIGNIFICANCE

#: Of a bin, by which a window is narrowed before its bins are looked up.
HAIR = 1e-6


@dataclass
class Sweep:
    """center: of the object. mode: `cylinder` (the exact chord of each ray) or `ddl` (the diameter for every ray, and no window where a ray would leave
    through the top). least and most: sizes in metres. step: of the windows. reach: half a window by the angle of the object."""

    center: tuple[float, float]
    base_density: float
    deltas: list[float]
    amplifiers: list[float]
    alphas: list[float]
    least: float = 0.0
    most: float = 100.0
    step: float = 0.01
    reach: float = 1.0
    both_sides: bool = False
    mode: str = "ddl"
    unit: str = field(default="tangent")


def turned_to(panels: DataFrame, center: tuple[float, float]) -> DataFrame:
    """Elements of panels (as reconstruction.elements wants them) that look at the object, with their place and bins' ends."""
    out = elements(panels)
    own = panels.select("detid", "nbinx", "txmin", "txmax", "nbiny", "tymin", "tymax", "yaw", "roll", "pitch")
    out = out.join(own, "detid")
    dx, dy = F.lit(center[0]) - F.col("px"), F.lit(center[1]) - F.col("py")
    far = F.sqrt(dx * dx + dy * dy)
    ahead = turned(rotation(-F.col("yaw"), F.col("roll"), F.col("pitch")), [F.lit(0.0), F.lit(1.0), F.lit(0.0)])
    out = out.withColumns({**{f"__s{i}": a for i, a in enumerate(ahead)}, "__t0": dx / far, "__t1": dy / far})
    v = aimed([F.col(c) for c in ("vx", "vy", "vz")], [F.col(f"__s{i}") for i in range(3)], [F.col("__t0"), F.col("__t1"), F.lit(0.0)])
    return out.withColumns({c: x for c, x in zip(("vx", "vy", "vz"), v, strict=True)}).drop("__s0", "__s1", "__s2", "__t0", "__t1", "yaw", "roll", "pitch")


def through(rays: DataFrame, x: Axis, y: Axis, pillars: DataFrame) -> DataFrame:
    """rays with pl, their path within the pillars."""
    paths = pillar_stretches(rays, x, y, pillars).groupBy("ray_id").agg(F.sum(F.col("t1") - F.col("t0")).alias("pl"))
    return rays.join(paths, "ray_id", "left").withColumn("pl", F.coalesce("pl", F.lit(0.0)))


def tries(panels: DataFrame, tops: Callable[[DataFrame], DataFrame], sweep: Sweep) -> DataFrame:
    """A row for each panel and size: detid, size, radius, half, height, distance, rise, ty_min, ty_max and the bins x0 to x1 (exclusive) of its windows.

    tops: adds elev_object, the lowest surface over the object's radius, and elev_surface, that in its middle.
    """
    dx, dy = F.col("px") - sweep.center[0], F.col("py") - sweep.center[1]
    wide = (F.col("txmax") - F.col("txmin")) / F.col("nbinx")
    out = panels.select("detid", "pz", F.sqrt(dx * dx + dy * dy).alias("distance"), wide.alias("wide"), ((F.col("tymax") - F.col("tymin")) / F.col("nbiny")).alias("high"), "nbinx", "nbiny", "txmin", F.col("tymin").alias("ty_min"), F.col("tymax").alias("ty_max"))
    out = out.withColumn("angle", F.explode(candidate_angles(F.col("distance"), sweep.most, F.col("wide"), F.col("nbinx"), sweep.unit)))
    out = out.withColumn("radius", cylinder_radius(F.col("distance"), F.col("angle"))).withColumn("size", 2 * F.col("radius"))
    out = tops(out.filter(F.col("size") >= sweep.least))
    out = out.withColumns({"height": F.col("elev_object") - F.col("pz"), "rise": F.col("elev_surface") - F.col("elev_object"), "half": convert(F.col("angle"), "radian", sweep.unit) * sweep.reach})
    out = out.filter(F.col("size") <= F.col("elev_surface") - F.col("pz"))
    if sweep.mode == "ddl":
        out = out.withColumn("ty_max", F.least("ty_max", highest_allowed(F.col("height"), F.col("size"), sweep.unit)))
    first, last = (bin_of(s * F.col("half") - s * HAIR * F.col("wide"), F.col("txmin"), F.col("wide"), F.col("nbinx")) for s in (-1, 1))
    return out.filter("ty_max > ty_min").withColumns({"x0": first, "x1": last + 1}).drop("angle", "pz")


def bin_of(at: Column, low: Column, step: Column, n: Column) -> Column:
    """The bin that holds a place; the nearest one for a place outside."""
    return F.least(n - 1, F.greatest(F.lit(0), F.floor((at - low + EPSILON * step) / step))).cast("int")


def lines(bins: DataFrame, sizes: DataFrame, sweep: Sweep, flux: Callable[[Column, Column], Column]) -> DataFrame:
    """detid, size, delta, iy, s: running sums up the rows of bins of counts in the windows' columns, with a change of density and without (delta null).

    bins: detid, ix, iy, px, py, pz, vx, vy, vz, pl, sot.
    """
    met = bins.join(bounded(sizes.select("detid", "size", "radius", "height", "x0", "x1")), "detid").filter("ix >= x0 AND ix < x1")
    if sweep.mode == "cylinder":
        # in the object's own frame, from the panel's height up
        ray = [F.col("px") - sweep.center[0], F.col("py") - sweep.center[1], F.lit(0.0)]
        chord = cylinder_chord(ray, [F.col("vx"), F.col("vy"), F.col("vz")], (0.0, 0.0), (F.col("radius"), F.col("radius")), 0.0, F.col("height"))
    else:
        chord = F.col("size")
    met = met.withColumn("chord", chord).withColumn("delta", F.explode(F.array(F.lit(None).cast("double"), *[F.lit(float(d)) for d in sweep.deltas])))
    dl = F.greatest(F.lit(0.0), F.col("pl") * sweep.base_density + F.coalesce(F.col("delta") * F.col("chord"), F.lit(0.0)))
    rows = met.withColumn("dl", dl).groupBy("detid", "size", "delta", "iy").agg(F.sum(flux(F.col("vz"), F.col("dl")) * F.col("sot")).alias("n"))
    up = Window.partitionBy("detid", "size", "delta").orderBy("iy").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("s", F.sum("n").over(up)).drop("n")


def windows(sizes: DataFrame, sweep: Sweep) -> DataFrame:
    """sizes with every window: i, ty0, ty1, the depths between which it sees, and its rows of bins y0 to y1 (exclusive)."""
    out = depth_windows(sizes, sweep.step, sweep.unit)
    first, last = (bin_of(F.col(c) + s * HAIR * F.col("high"), F.col("ty_min"), F.col("high"), F.col("nbiny")) for c, s in (("ty0", 1), ("ty1", -1)))
    return out.withColumns({"y0": first, "y1": last + 1})


def significance(bins: DataFrame, sizes: DataFrame, sweep: Sweep, flux: Callable[[Column, Column], Column]) -> DataFrame:
    """The significance list: a row for each window, change, amplifier and level, with the columns that sinks.write_significance takes."""
    sums = stored(lines(bins, sizes, sweep, flux), "lines")
    slid = stored(windows(sizes, sweep), "windows")
    key = ["detid", "size", "iy"]
    # a window's rows are a difference of two running sums; without and with a change they stand in one row
    by_change = sums.groupBy(*key).agg(F.max(F.when(F.col("delta").isNull(), F.col("s"))).alias("base"), F.map_from_entries(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("delta", "s")))).alias("changed"))
    at = lambda end, row: by_change.select("detid", "size", (F.col("iy") + 1).alias(row), F.col("base").alias(f"base_{end}"), F.col("changed").alias(f"changed_{end}"))
    out = slid.join(at("up", "y1"), ["detid", "size", "y1"]).join(at("down", "y0"), ["detid", "size", "y0"], "left")
    zero = F.lit(0.0)
    out = out.withColumn("ddens", F.explode(F.array(*[F.lit(float(d)) for d in sweep.deltas])))
    out = out.withColumns({"__base": F.col("base_up") - F.coalesce("base_down", zero), "__modi": F.col("changed_up")[F.col("ddens")] - F.coalesce(F.col("changed_down")[F.col("ddens")], zero)})
    out = out.withColumn("signal_amp", F.explode(F.array(*[F.lit(float(a)) for a in sweep.amplifiers]))).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in sweep.alphas])))
    out = out.withColumns({"signal_base": F.col("__base") * F.col("signal_amp"), "signal_modi": F.col("__modi") * F.col("signal_amp")})
    out = out.withColumns({"delta_signal": F.col("signal_modi") - F.col("signal_base"), "z_val": z_value(F.col("signal_base"), F.col("signal_modi"))})
    out = out.withColumn("p_val", (p_two_sided if sweep.both_sides else p_one_sided)(F.col("z_val")))
    out = out.withColumns({"is_signi": (F.col("p_val") < F.col("alpha")).cast("int"), "det": F.col("detid"), "obsize": F.col("size"), "depth_anom_top": F.col("depth_top"), "depth_anom_btm": F.col("depth_bottom")})
    hair = {"txL": -F.col("half") + HAIR * F.col("wide"), "txU": F.col("half") - HAIR * F.col("wide"), "tyL": F.col("ty0") + HAIR * F.col("high"), "tyU": F.col("ty1") - HAIR * F.col("high")}
    return out.withColumns(hair).select(*SIGNIFICANCE)


def in_order(rows: DataFrame) -> DataFrame:
    """A significance list in its order: level and change from the largest, amplifier, size and depth from the smallest."""
    return rows.orderBy("det", F.desc("alpha"), "signal_amp", F.desc("ddens"), "obsize", "depth_anom_top")


def swept(panels: DataFrame, pillars: DataFrame, x: Axis, y: Axis, sweep: Sweep, flux: Callable[[Column, Column], Column]) -> DataFrame:
    """The significance list of panels (as reconstruction.elements wants them) and pillars (ix, iy, zmin, zmax); flux: of `vz` and `dl`."""
    rays = stored(turned_to(panels, sweep.center), "elements")
    bins = stored(through(rays, x, y, pillars), "paths")

    def tops(tried: DataFrame) -> DataFrame:
        circles = tried.select(F.lit(float(sweep.center[0])).alias("cx"), F.lit(float(sweep.center[1])).alias("cy"), "radius").distinct()
        tops_ = pillars.select("ix", "iy", "zmax")
        lowest = stored(grid.lowest_top(tops_, x, y, stored(circles, "circles")).select("radius", F.col("zmax").alias("elev_object")), "tops")
        middle = tops_.filter((F.col("ix") == x.index(F.lit(float(sweep.center[0])))) & (F.col("iy") == y.index(F.lit(float(sweep.center[1])))))
        return tried.join(bounded(lowest), "radius").withColumn("elev_surface", middle.select("zmax").scalar())

    return significance(bins, stored(tries(panels, tops, sweep), "tries"), sweep, flux)
