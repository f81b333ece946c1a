"""Groups of angular bins: making, dividing, summing and pricing them."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.stats import poisson
from tessella.operators.intervals import bounded
from tessella.operators.windows import dense_numbers, prefix_sums, stored


def initial(bins: DataFrame, nx: int, ny: int, x_parts: int, y_parts: int) -> DataFrame:
    """bins with igroup: about equal rectangles."""
    wx, wy = -(-nx // x_parts), -(-ny // y_parts)
    return bins.withColumn("igroup", (F.floor(F.col("ix") / wx) + F.floor(F.col("iy") / wy) * -(-nx // wx)).cast("int"))


def available(bins: DataFrame, least_pl: float, least_dl: float, signal: float, noise: float) -> DataFrame:
    """Bins with too short a path are off; where a replacement is not negative it takes the place of their signal and noise."""
    short = (F.col("pl") < least_pl) | (F.col("dl") < least_dl)
    return bins.withColumns(
        {
            "is_avail": ~short,
            "signal": F.when(short & F.lit(signal >= 0), signal).otherwise(F.col("signal")),
            "noise_poi": F.when(short & F.lit(noise >= 0), noise).otherwise(F.col("noise_poi")),
            "noise_det": F.when(short & F.lit(noise >= 0), 0.0).otherwise(F.col("noise_det")),
        }
    )


def sums(bins: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return bins.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])


def efficiency_variance(bins: DataFrame, by: list[str], count: Column, low: Column, high: Column) -> DataFrame:
    """Variance of a group's count by its bins' efficiencies, correlated and independent."""
    part = (high - low) / 2 * count
    return bins.groupBy(*by).agg(F.pow(F.sum(part), F.lit(2)).alias("correlated"), F.sum(part * part).alias("independent"))


def weighted_mean(bins: DataFrame, by: list[str], value: Column, weight: Column, otherwise: float) -> DataFrame:
    """Mean by weight; a group without weight has the given value."""
    return bins.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(otherwise)).alias("mean"))


def noise_split(bins: DataFrame, by: list[str], total: float, share: float) -> DataFrame:
    """A group's noise dealt to its bins in proportion to their signal, as a floor and a Poisson part."""
    whole = bins.groupBy(*by).agg(F.sum("signal").alias("__whole"))
    noise = F.coalesce(F.try_divide(F.col("signal") * total, F.col("__whole")), F.lit(0.0))
    return bins.join(whole, by).withColumns({"noise_det": noise * (1 - share), "noise_poi": noise * share}).drop("__whole")


def observed_counts(rows: DataFrame, key: list[str], draw_signal: bool, seed: int = 42) -> DataFrame:
    """rows with observed: signal (drawn or not), the noise floor, and the Poisson part of the noise, which is always drawn."""
    ids = [F.col(k) for k in key]
    signal = poisson(F.col("signal"), F.lit("signal"), *ids, seed=seed).cast("double") if draw_signal else F.col("signal")
    return rows.withColumn("observed", signal + F.col("noise_det") + poisson(F.col("noise_poi"), F.lit("noise"), *ids, seed=seed))


def expected_counts(rows: DataFrame) -> DataFrame:
    """rows with expected: signal and the Poisson part of the noise, without the floor."""
    return rows.withColumn("expected", F.col("signal") + F.col("noise_poi"))


def log_counts(rows: DataFrame, total: Column, least: float, fill: float) -> DataFrame:
    """rows with log_count, which is the fill where the total is below the least."""
    return rows.withColumn("log_count", F.when(total < least, fill).otherwise(F.log10(total)))


def cone_volume(transitions: Column, solid: Column) -> Column:
    """Volume that an angular bin cuts from a body: cones at the distances where its ray leaves less those where it enters.

    transitions: an array of structs tf_in (whether it enters there) and dist.
    """
    cubes = F.aggregate(transitions, F.lit(0.0), lambda s, x: s + F.when(x["tf_in"], -1.0).otherwise(1.0) * x["dist"] * x["dist"] * x["dist"])
    return cubes * solid / 3


def combined_paths(one: DataFrame, other: DataFrame, key: list[str], sign: float) -> DataFrame:
    """one with pl and dl plus sign times the other's."""
    added = other.select(*key, F.col("pl").alias("__pl"), F.col("dl").alias("__dl"))
    return one.join(added, key).withColumns({"pl": F.col("pl") + sign * F.col("__pl"), "dl": F.col("dl") + sign * F.col("__dl")}).drop("__pl", "__dl")


def left_out_paths(cells: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """ray_id and the path length in cells that aren't kept: all less the kept."""
    known = bounded(stored(kept.select(*keys).distinct(), "kept"))  # a few cells that many rays cross must not gather all of them
    marked = cells.join(known.withColumn("__kept", F.lit(True)), keys, "left")
    return marked.groupBy("ray_id").agg((F.sum("length") - F.coalesce(F.sum(F.when(F.col("__kept"), F.col("length"))), F.lit(0.0))).alias("pl"))


def bounding_boxes(bins: DataFrame, by: list[str]) -> DataFrame:
    out = bins.groupBy(*by).agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("is_rect", F.col("n") == (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))


def best_density(bins: DataFrame, by: list[str], densities: list[float], expected: Column, target: DataFrame) -> DataFrame:
    """The density of a grid whose expected count is nearest to the target; of equals the lowest. expected may use `rho`."""
    tried = bins.withColumn("rho", F.explode(F.array(*[F.lit(float(d)) for d in densities]))).groupBy(*by, "rho").agg(F.sum(expected).alias("n"))
    off = F.abs(F.col("n") - F.col("target"))
    return tried.join(target, by).groupBy(*by).agg(F.min(F.struct(off.alias("off"), F.col("rho").alias("rho"))).alias("b")).select(*by, F.col("b.rho").alias("rho"), F.col("b.off").alias("off"))


def zoomed_density(bins: DataFrame, by: list[str], low: float, high: float, steps: list[float], expected: Column, target: DataFrame, factor: float = 2.0) -> DataFrame:
    """best_density by ever finer steps, each within factor steps of the last. One pass a step; grids travel with their groups."""
    span = target.withColumns({"__low": F.lit(low), "__high": F.lit(high)})
    out = None
    for step in sorted(steps, reverse=True):
        grid = F.explode(F.sequence(F.lit(0), F.floor((F.col("__high") - F.col("__low")) / step + 1e-9).cast("int"))).alias("__i")
        tries = span.select("*", grid).withColumn("rho", F.col("__low") + F.col("__i") * step)
        counted = bins.join(tries, by).groupBy(*by, "rho", "target").agg(F.sum(expected).alias("n"))
        best = F.min(F.struct(F.abs(F.col("n") - F.col("target")).alias("off"), "rho"))
        out = counted.groupBy(*by, "target").agg(best.alias("b")).select(*by, "target", "b.rho", "b.off")
        span = out.withColumns({"__low": F.greatest(F.lit(low), F.col("rho") - factor * step), "__high": F.least(F.lit(high), F.col("rho") + factor * step)}).drop("rho", "off")
    return out.drop("target")


def divide(cells: np.ndarray, boxes: list[tuple[int, int, int, int]], trigger: float, least_x: int, least_y: int, prefer_x: bool, most_loops: int = 100_000) -> list[tuple[int, int, int, int]]:
    """Rectangles (x0, x1, y0, y1, inclusive) halved along their longer side while they hold the trigger.

    The odd line goes to the half with more; equal halves give it to the first. A rectangle whose side of
    choice can't be halved stays. First in, first out.
    """
    s = np.zeros((cells.shape[0] + 1, cells.shape[1] + 1))
    s[1:, 1:] = cells.cumsum(0).cumsum(1)
    total = lambda x0, x1, y0, y1: s[x1 + 1, y1 + 1] - s[x0, y1 + 1] - s[x1 + 1, y0] + s[x0, y0]
    out, queue = [], deque(boxes)
    while queue:
        box = queue.popleft()
        x0, x1, y0, y1 = box
        nx, ny = x1 - x0 + 1, y1 - y0 + 1
        by_x = (nx > ny or nx == ny and prefer_x) and nx > least_x
        by_y = (nx < ny or nx == ny and not prefer_x) and ny > least_y
        if total(*box) < trigger or most_loops <= 0 or not (by_x or by_y):
            out.append(box)
            continue
        most_loops -= 1
        n = nx if by_x else ny
        part = (lambda a, b: (x0 + a, x0 + b, y0, y1)) if by_x else (lambda a, b: (x0, x1, y0 + a, y0 + b))
        half = n // 2
        if n % 2:
            # the trial leaves the middle line out
            half += total(*part(0, half - 1)) >= total(*part(half + 1, n - 1)) if half else 1
        queue += [part(0, half - 1), part(half, n - 1)]
    return out


def auto_divided(bins: DataFrame, panel: str, trigger: float, least_x: int = 1, least_y: int = 1, prefer_x: bool = True) -> DataFrame:
    """panel, ix, iy and igroup: each panel's whole grid divided. A panel's bins are bounded by its grid and go to one task."""
    kind = bins.schema[panel].dataType.simpleString()

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, y = block["ix"].to_numpy(), block["iy"].to_numpy()
        cells = np.zeros((x.max() + 1, y.max() + 1))
        np.add.at(cells, (x, y), block["weight"].to_numpy(float))
        groups = np.full(cells.shape, -1)
        for g, (a, b, c, d) in enumerate(divide(cells, [(0, cells.shape[0] - 1, 0, cells.shape[1] - 1)], trigger, least_x, least_y, prefer_x)):
            groups[a : b + 1, c : d + 1] = g
        return pd.DataFrame({panel: block[panel], "ix": x, "iy": y, "igroup": groups[x, y]})

    return bins.select(panel, "ix", "iy", "weight").groupBy(panel).applyInPandas(run, f"{panel} {kind}, ix int, iy int, igroup int")


def divided_by_rounds(bins: DataFrame, panel: str, trigger: float, least_x: int = 1, least_y: int = 1, prefer_x: bool = True, most_loops: int = 100_000) -> DataFrame:
    """panel, ix, iy and igroup: what `auto_divided` gives, worked out on all panels' rectangles at once.

    A round looks up the sums of all rectangles that may be halved in a table of prefix sums, by one join of their corners; there are as
    many rounds as halvings of the deepest rectangle. Groups are numbered by round, then from left to right.
    """
    weights = bins.groupBy(panel, "ix", "iy").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    sums = stored(prefix_sums(weights, "weight", [panel]).select(panel, F.col("ix").alias("__x"), F.col("iy").alias("__y"), F.col("s").alias("__s")), "sums")
    n = lambda v: F.lit(v).cast("long")
    boxes = sums.groupBy(panel).agg(F.max("__x").cast("long").alias("x1"), F.max("__y").cast("long").alias("y1"))
    boxes = boxes.select(panel, n(0).alias("x0"), "x1", n(0).alias("y0"), "y1", n(0).alias("path"), n(0).alias("done"))
    ready, level = None, 0
    wide, high = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    while True:
        longer = (wide > high) | ((wide == high) & F.lit(prefer_x))
        open_ = boxes.withColumns({"by_x": longer & (wide > least_x), "by_y": ~longer & (high > least_y)})
        open_ = open_.withColumn("half", F.floor(F.when(F.col("by_x"), wide).otherwise(high) / 2))
        box = {"": [F.col(c) for c in ("x0", "x1", "y0", "y1")]}
        for name, first, last in (("a", n(0), F.col("half") - 1), ("b", F.col("half") + 1, F.when(F.col("by_x"), wide).otherwise(high) - 1)):
            along = {k: (F.when(F.col(f"by_{k}"), F.col(f"{k}0") + first).otherwise(F.col(f"{k}0")), F.when(F.col(f"by_{k}"), F.col(f"{k}0") + last).otherwise(F.col(f"{k}1"))) for k in "xy"}
            box[name] = [*along["x"], *along["y"]]
        corners = [F.struct(F.lit(f"{k}{i}").alias("__k"), x.alias("__x"), y.alias("__y")) for k, (x0, x1, y0, y1) in box.items() for i, (x, y) in enumerate(((x1, y1), (x0 - 1, y1), (x1, y0 - 1), (x0 - 1, y0 - 1)))]
        asked = open_.select(panel, "path", F.explode(F.array(*corners)).alias("__c")).select(panel, "path", "__c.*")
        met = asked.join(sums, [panel, "__x", "__y"]).groupBy(panel, "path").agg(*[F.max(F.when(F.col("__k") == f"{k}{i}", F.col("__s"))).alias(f"__{k}{i}") for k in box for i in range(4)])
        total = lambda k: F.coalesce(f"__{k}0", F.lit(0.0)) - F.coalesce(f"__{k}1", F.lit(0.0)) - F.coalesce(f"__{k}2", F.lit(0.0)) + F.coalesce(f"__{k}3", F.lit(0.0))
        known = open_.join(met, [panel, "path"])
        wants = (total("") >= trigger) & (F.col("by_x") | F.col("by_y"))
        odd = F.when(F.col("by_x"), wide).otherwise(high) % 2 == 1
        # the trial leaves the middle line out; the odd line goes to the half with more
        cut = F.col("half") + F.when(odd, (total("a") >= total("b")).cast("long")).otherwise(n(0))
        turn = Window.partitionBy(panel).orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
        known = known.select(*boxes.columns, "by_x", wants.alias("__wants"), cut.alias("__cut")).withColumn("__turn", F.sum(F.col("__wants").cast("long")).over(turn))
        known = known.withColumn("__splits", F.col("__wants") & (F.col("done") + F.col("__turn") <= most_loops)).withColumn("__all", F.sum(F.col("__wants").cast("long")).over(Window.partitionBy(panel)))
        known = stored(known, "rectangles")
        last = known.filter("NOT __splits").select(panel, "x0", "x1", "y0", "y1", n(level).alias("level"), "path")
        ready = last if ready is None else ready.unionByName(last)
        halves = known.filter("__splits").withColumn("__side", F.explode(F.array(n(0), n(1))))
        if halves.isEmpty():
            break
        second, by_x = F.col("__side") == 1, F.col("by_x")
        edge = lambda k, on: (F.when(on & second, F.col(f"{k}0") + F.col("__cut")).otherwise(F.col(f"{k}0")).alias(f"{k}0"), F.when(on & ~second, F.col(f"{k}0") + F.col("__cut") - 1).otherwise(F.col(f"{k}1")).alias(f"{k}1"))
        boxes = halves.select(panel, *edge("x", by_x), *edge("y", ~by_x), (F.col("path") * 2 + F.col("__side")).alias("path"), (F.col("done") + F.col("__all")).alias("done"))
        level += 1
    numbered = ready.withColumn("igroup", (F.row_number().over(Window.partitionBy(panel).orderBy("level", "path")) - 1).cast("int"))
    cells = numbered.select(panel, "igroup", "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("ix")).select(panel, "igroup", "ix", F.explode(F.sequence("y0", "y1")).alias("iy"))
    return bins.select(panel, "ix", "iy").join(cells.withColumns({c: F.col(c).cast("int") for c in ("ix", "iy")}), [panel, "ix", "iy"]).select(panel, "ix", "iy", "igroup")


def mean_efficiency(bins: DataFrame, by: list[str]) -> DataFrame:
    """A group's efficiencies: plain means of its bins'."""
    return bins.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("eff_low", "eff_cnt", "eff_upp")])


def volumes(bins: DataFrame, by: list[str], transitions: Column, solid: Column) -> DataFrame:
    """Volume of each group: its bins' cones. A negative one, or a ray that doesn't come out, is an error."""
    ends = F.coalesce(F.get(transitions, F.size(transitions) - 1)["tf_in"], F.lit(False))
    volume = cone_volume(transitions, solid)
    sound = F.when(~ends & (volume >= 0), volume).otherwise(F.raise_error(F.lit("a ray that stays inside, or a negative volume")).cast("double"))
    return bins.groupBy(*by).agg(F.sum(sound).alias("volume"))


def totals(bins: DataFrame, by: list[str], values: list[str], least_dl: float) -> DataFrame:
    """Sums over bins whose density length isn't below the least."""
    return bins.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("dl") >= least_dl, F.col(v))), F.lit(0.0)).alias(v) for v in values])


def with_noise(bins: DataFrame, by: list[str], flux_floor: float, flux_poisson: float, sot_floor: float, sot_poisson: float, least_dl: float) -> DataFrame:
    """bins with noise_det and noise_poi: parts of their signal, and parts of the panel's signal dealt by exposure (sot).

    Bins with a density length below the least keep what they have; so do all, if no ratio is positive.
    """
    ratios = [max(0.0, r) for r in (flux_floor, flux_poisson, sot_floor, sot_poisson)]
    if not any(ratios):
        return bins
    whole = totals(bins, by, ["signal", "sot"], least_dl).select(*by, F.col("signal").alias("__signal"), F.col("sot").alias("__sot"))
    dealt = F.try_divide(F.col("sot"), F.col("__sot")) * F.col("__signal")
    on = F.col("dl") >= least_dl
    value = lambda own, share, old: F.when(on, F.col("signal") * own + (dealt * share if share else 0.0)).otherwise(F.col(old))
    out = bins.join(whole, by)
    return out.withColumns({"noise_det": value(ratios[0], ratios[2], "noise_det"), "noise_poi": value(ratios[1], ratios[3], "noise_poi")}).drop("__signal", "__sot")


def all_grouped(bins: DataFrame, grouped: DataFrame, key: list[str]) -> DataFrame:
    """grouped (key, rect_id) of bins that lie in a rectangle that isn't excluded; a bin that no rectangle holds is an error.

    grouped: key, rect_id, excluded of each bin's first rectangle.
    """
    out = bins.select(*key).join(grouped, key, "left")
    # the error is in the condition, as columns that a filter drops aren't worked out
    return out.filter(F.when(F.col("excluded").isNull(), F.raise_error(F.lit("a bin in no rectangle")).cast("boolean")).otherwise(~F.col("excluded"))).select(*key, "rect_id")


def checked_sizes(bins: DataFrame, by: list[str], least_x: int, least_y: int) -> DataFrame:
    """bounding_boxes of the groups; one with a shorter side is an error."""
    out = bounding_boxes(bins, by)
    small = (F.col("x1") - F.col("x0") + 1 < least_x) | (F.col("y1") - F.col("y0") + 1 < least_y)
    return out.withColumn("n", F.when(small, F.raise_error(F.lit("a group smaller than allowed")).cast("long")).otherwise(F.col("n")))


def merge_from(groups: np.ndarray, weight: np.ndarray, seed: int, least: float, most_loops: int) -> bool:
    """Grows a group (an array of group numbers by ix, iy; changed in place) until it holds the least weight: right, up, down and left in
    turn, each of its bins takes the whole group of its neighbour. False if it never does."""
    total = lambda: float(weight[groups == seed].sum())
    for loop in range(1, most_loops + 2):
        if total() >= least:
            return True
        dx, dy = {1: (1, 0), 2: (0, 1), 3: (0, -1), 0: (-1, 0)}[loop % 4]
        for x, y in zip(*np.nonzero(groups == seed), strict=True):
            u, v = x + dx, y + dy
            if 0 <= u < groups.shape[0] and 0 <= v < groups.shape[1] and groups[u, v] != seed:
                groups[groups == groups[u, v]] = seed
                if total() >= least:
                    break
    return total() >= least


def merged_small(bins: DataFrame, panel: str, least: float, most_loops: int = 1000) -> DataFrame:
    """panel, ix, iy and igroup: groups with too little weight grow, the least number first, until all hold the least or nothing is left to take.

    bins: panel, ix, iy, igroup, weight. A panel's bins are bounded by its grid and go to one task.
    """
    kind = bins.schema[panel].dataType.simpleString()

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, y = block["ix"].to_numpy(), block["iy"].to_numpy()
        groups, weight = np.full((x.max() + 1, y.max() + 1), -1), np.zeros((x.max() + 1, y.max() + 1))
        groups[x, y], weight[x, y] = block["igroup"], block["weight"]
        for seed in np.unique(block["igroup"]):
            if (groups == seed).any() and weight[groups == seed].sum() < least:
                merge_from(groups, weight, seed, least, most_loops)
        return pd.DataFrame({panel: block[panel], "ix": x, "iy": y, "igroup": groups[x, y]})

    return bins.select(panel, "ix", "iy", "igroup", "weight").groupBy(panel).applyInPandas(run, f"{panel} {kind}, ix int, iy int, igroup int")


def density_targets(counts: DataFrame, sigma: float, variance: Column | None = None) -> DataFrame:
    """counts (a group's keys and n) once for each band: center, and the counts that lie sigma deviations off, fewer of which mean the upper density.

    A group without counts has none. variance: of the efficiency, which adds to that of the count.
    """
    deviation = sigma * F.sqrt(F.col("n") + (F.lit(0.0) if variance is None else variance))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), t.alias("target")) for b, t in (("lower", F.col("n") + deviation), ("center", F.col("n")), ("upper", F.greatest(F.lit(0.0), F.col("n") - deviation)))])
    return counts.filter("n > 0").withColumn("__b", F.explode(bands)).select(*[c for c in counts.columns if c != "n"], "__b.band", "__b.target")


def adaptive_density(bins: DataFrame, by: list[str], low: float, high: float, first_step: float, least_step: float, factor: float, most: int, expected: Column, target: DataFrame) -> DataFrame:
    """by, rho and off: the density whose expected count is nearest to the target, by steps that shrink by a factor around the best so far.

    Where a step would be below the least, the last range is scanned with the least step, and that ends the search. expected may use `rho`; target: by, target.
    """
    span = target.withColumns({"__low": F.lit(low), "__high": F.lit(high), "__rho": F.lit(low), "__off": F.lit(float("inf"))})
    step, last = first_step, False
    for _ in range(most + 1):
        grid = F.explode(F.sequence(F.lit(0), F.floor((F.col("__high") - F.col("__low")) / step).cast("int"))).alias("__i")
        tries = span.select("*", grid).withColumn("rho", F.col("__low") + F.col("__i") * step)
        counted = bins.join(tries, by).groupBy(*by, "target", "__low", "__high", "__rho", "__off", "rho").agg(F.sum(expected).alias("n"))
        # of equals the first that was tried wins
        best = F.min(F.struct(F.abs(F.col("n") - F.col("target")).alias("off"), "rho"))
        span = counted.groupBy(*by, "target", "__low", "__high", "__rho", "__off").agg(best.alias("b"))
        better = F.col("b.off") < F.col("__off")
        span = span.withColumns({"__rho": F.when(better, F.col("b.rho")).otherwise(F.col("__rho")), "__off": F.least("__off", "b.off")}).drop("b")
        if last or (most := most - 1) < 0:
            break
        last = step / factor < least_step
        step = least_step if last else step / factor
        if not last:
            if not most:
                break
            span = span.withColumns({"__low": F.greatest(F.lit(low), F.col("__rho") - step), "__high": F.least(F.lit(high), F.col("__rho") + step)})
    return span.select(*by, F.col("__rho").alias("rho"), F.col("__off").alias("off"))


def extremes(bins: DataFrame, panel: str) -> DataFrame:
    """Of each panel, the groups with the least and the most signal and noise; of equals the smallest number."""
    held = bins.groupBy(panel, "igroup").agg(F.sum(F.col("signal") + F.col("noise_poi")).alias("n"))
    return held.groupBy(panel).agg(F.min(F.struct("n", "igroup"))["igroup"].alias("least"), F.min(F.struct((-F.col("n")).alias("n"), "igroup"))["igroup"].alias("most"))


def exposed(elements: DataFrame, days: Column, new_days: Column) -> DataFrame:
    """elements whose exposure (sot) and what is in proportion to it are those of other days."""
    scale = new_days / days
    return elements.withColumns({c: F.col(c) * scale for c in ("sot", "signal") if c in elements.columns})


def rebinned(panels: DataFrame, x: tuple[int, float, float], y: tuple[int, float, float]) -> DataFrame:
    """panels with the same angular bins for all, from which elements are made anew."""
    return panels.withColumns({f"{k}{n}": F.lit(v) for n, axis in (("x", x), ("y", y)) for k, v in (("nbin", axis[0]),)} | {f"t{n}{k}": F.lit(float(v)) for n, axis in (("x", x), ("y", y)) for k, v in zip(("min", "max"), axis[1:], strict=True)})


def regrouped(elements: DataFrame, other: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """elements with the grouping, or the transitions, of another array; an element that it doesn't have is an error."""
    out = elements.drop(*columns).join(other.select(*key, *columns, F.lit(True).alias("__has")), key, "left")
    return out.withColumn(columns[0], F.when(F.col("__has"), F.col(columns[0])).otherwise(F.raise_error(F.lit("an element that the other array doesn't have")).cast(other.schema[columns[0]].dataType))).drop("__has")


def vector(rows: DataFrame, key: list[str], value: Column, name: str = "value") -> DataFrame:
    """key, place (from 0, in the order of the key) and a value: what stands at each place of a vector."""
    return dense_numbers(rows.select(*key, value.alias(name)), key, "place")
