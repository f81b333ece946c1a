"""Queries of the depth sweep (panels are nations, what their bins see through comes from the raster) and of division by rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.angles import from_tangents
from tessella.operators import grid, groups
from tessella.plans import depth_sweep
from tessella.plans.queries import RASTER, X, Y, bin_sql, query, raster

SWEEP = depth_sweep.Sweep((0.0, 0.0), 2000.0, [-500.0, 400.0], [0.5, 2.0], [0.3, 0.1], least=6.0, most=40.0, step=0.04)
CARD = {"nbinx": X.nbin, "txmin": -0.25, "txmax": 0.25, "nbiny": Y.nbin, "tymin": 0.0, "tymax": 0.66}


def panels(t) -> DataFrame:
    n = F.col("n_nationkey")
    return t("nation").select(n.alias("detid"), (80 + n * 5.0).alias("px"), F.lit(0.0).alias("py"), (n * 1.0).alias("pz"), *[F.lit(v).alias(k) for k, v in CARD.items()])


def bins(t) -> DataFrame:
    """Every panel sees the raster's cells as its bins."""
    cells = panels(t).join(F.broadcast(raster(t).select("ix", "iy", "n", F.lit(X.nbin).alias("nbinx"))), "nbinx")  # 110 cells
    v = from_tangents(-0.25 + (F.col("ix") + 0.5) * 0.05, (F.col("iy") + 0.5) * 0.06)
    return cells.select("detid", "ix", "iy", "px", "py", "pz", *[a.alias(f"v{k}") for k, a in zip("xyz", v, strict=True)], (30.0 + F.col("n") % 60 + F.col("detid")).alias("pl"), (1e4 * (1 + F.col("ix"))).alias("sot"))


@query(f"""WITH {RASTER},
    b AS (SELECT n_nationkey AS det, ix, iy, 30.0 + n % 60 + n_nationkey AS pl, 1e4 * (1 + ix) AS sot, -0.25 + (ix + 0.5) * 0.05 AS tx, (iy + 0.5) * 0.06 AS ty FROM raster, nation),
    p AS (SELECT n_nationkey AS det, 80 + n_nationkey * 5.0 AS d, n_nationkey * 1.0 AS pz, 60.0 - n_nationkey % 3 - n_nationkey * 1.0 AS height, 6.0 + n_nationkey % 3 AS rise FROM nation),
    tried AS (SELECT *, 2 * d * sin(atan(k * 0.05)) AS size, tan(atan(k * 0.05)) AS half FROM p, generate_series(1, 4) AS g(k) WHERE atan((k - 1) * 0.05) < asin(20.0 / d)),
    limited AS (SELECT *, least(0.66, CASE WHEN height <= 0 THEN 0 WHEN size <= height THEN 99 ELSE tan(asin(height / size)) END) AS top FROM tried WHERE size >= 6 AND size <= 66.0 - pz),
    slid AS (SELECT *, top - half - i * 0.04 AS mid FROM (SELECT *, unnest(range(0, greatest(1, CAST(floor(((top - half) - half) / 0.04) AS BIGINT)))) AS i FROM limited WHERE top > 0)),
    seen AS (SELECT *, greatest(0, floor((mid - half + 6e-8) / 0.06)) AS y0, least(10, floor((mid + half - 6e-8) / 0.06)) AS y1, 5 - k AS x0, 4 + k AS x1 FROM slid WHERE height - (mid + half) * d >= 0),
    sums AS (SELECT s.det, size, half, mid, d, height, rise, delta, sum(0.01 * (0.2 + ty / sqrt(tx * tx + ty * ty + 1)) * pow(1 + pl * 2000 / 1e5, -2) * sot) AS base,
            sum(0.01 * (0.2 + ty / sqrt(tx * tx + ty * ty + 1)) * pow(1 + greatest(0, pl * 2000 + delta * size) / 1e5, -2) * sot) AS modi
        FROM seen s JOIN b ON b.det = s.det AND ix BETWEEN x0 AND x1 AND iy BETWEEN y0 AND y1, (VALUES (-500.0::DOUBLE), (400.0::DOUBLE)) AS c(delta) GROUP BY ALL)
    SELECT det, round(mid - half, 6) AS tyL, round(height - (mid + half) * d + rise, 5) AS depth_anom_top, round(height - (mid - half) * d + rise, 5) AS depth_anom_btm, round(size, 6) AS obsize, delta AS ddens, signal_amp, alpha,
        round(base * signal_amp, 5) AS signal_base, round((modi - base) * signal_amp, 5) AS delta_signal, round((modi - base) * signal_amp / sqrt((base + modi) * signal_amp), 6) AS z_val
    FROM sums, (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) AS m(signal_amp), (VALUES (0.3::DOUBLE), (0.1::DOUBLE)) AS l(alpha)""")
def depth_significance(t):
    n = F.col("detid")
    tops = lambda tried: tried.withColumns({"elev_object": 60.0 - n % 3, "elev_surface": F.lit(66.0)})
    flux = lambda vz, dl: F.lit(1e-2) * (F.lit(0.2) + vz) * F.pow(1 + dl / 1e5, F.lit(-2.0))
    out = depth_sweep.significance(bins(t), depth_sweep.tries(panels(t), tops, SWEEP), SWEEP, flux)
    digits = {"tyL": 6, "depth_anom_top": 5, "depth_anom_btm": 5, "obsize": 6, "signal_base": 5, "delta_signal": 5, "z_val": 6}
    out = out.withColumn("tyL", F.col("tyL") - depth_sweep.HAIR * 0.06)
    return out.select("det", "ddens", "signal_amp", "alpha", *[F.round(c, d).alias(c) for c, d in digits.items()])


def _judged(boxes: str) -> str:
    """Rectangles with their weight, that of both halves without the odd line, and where they are cut (null: not)."""
    inner = f"""SELECT b.panel, x0, x1, y0, y1, level, path, x1 - x0 + 1 AS nx, y1 - y0 + 1 AS ny, x1 - x0 >= y1 - y0 AS across, (CASE WHEN x1 - x0 >= y1 - y0 THEN x1 - x0 + 1 ELSE y1 - y0 + 1 END) // 2 AS half,
        coalesce(sum(n), 0) AS total, coalesce(sum(n) FILTER (WHERE CASE WHEN x1 - x0 >= y1 - y0 THEN ix - x0 < (x1 - x0 + 1) // 2 ELSE iy - y0 < (y1 - y0 + 1) // 2 END), 0) AS one,
        coalesce(sum(n) FILTER (WHERE CASE WHEN x1 - x0 >= y1 - y0 THEN ix - x0 > (x1 - x0 + 1) // 2 ELSE iy - y0 > (y1 - y0 + 1) // 2 END), 0) AS other
        FROM {boxes} b LEFT JOIN w ON w.panel = b.panel AND ix BETWEEN x0 AND x1 AND iy BETWEEN y0 AND y1 GROUP BY ALL"""
    return f"SELECT *, CASE WHEN total >= 500 AND greatest(nx, ny) > 1 THEN half + CASE WHEN greatest(nx, ny) % 2 = 1 AND one >= other THEN 1 ELSE 0 END END AS cut FROM ({inner})"


@query(f"""WITH RECURSIVE w AS (SELECT panel, ix, iy, count(*) AS n FROM (SELECT CAST(l_suppkey % 10 AS INTEGER) AS panel, {bin_sql("l_quantity", X)} AS ix, {bin_sql("l_discount", Y)} AS iy FROM lineitem) WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY panel, ix, iy),
    boxes AS (SELECT panel, 0 AS x0, max(ix) AS x1, 0 AS y0, max(iy) AS y1, 0 AS level, CAST(0 AS BIGINT) AS path FROM w GROUP BY panel
        UNION ALL SELECT panel, CAST(CASE WHEN across AND side = 1 THEN x0 + cut ELSE x0 END AS INTEGER), CAST(CASE WHEN across AND side = 0 THEN x0 + cut - 1 ELSE x1 END AS INTEGER),
            CAST(CASE WHEN NOT across AND side = 1 THEN y0 + cut ELSE y0 END AS INTEGER), CAST(CASE WHEN NOT across AND side = 0 THEN y0 + cut - 1 ELSE y1 END AS INTEGER), level + 1, path * 2 + side
        FROM ({_judged("boxes")}) j, (VALUES (0), (1)) AS s(side) WHERE cut IS NOT NULL),
    ready AS (SELECT *, CAST(row_number() OVER (PARTITION BY panel ORDER BY level, path) - 1 AS INTEGER) AS igroup FROM ({_judged("boxes")}) WHERE cut IS NULL)
    SELECT w.panel, ix, iy, igroup FROM w JOIN ready ON ready.panel = w.panel AND ix BETWEEN x0 AND x1 AND iy BETWEEN y0 AND y1""")
def auto_divide_rounds(t):
    """Ten panels at once."""
    lines = t("lineitem").withColumn("panel", (F.col("l_suppkey") % 10).cast("int"))
    cells = grid.binned(lines, X, Y, F.col("l_quantity"), F.col("l_discount")).groupBy("panel", "ix", "iy").agg(F.count(F.lit(1)).alias("weight"))
    return groups.divided_by_rounds(cells, "panel", 500)
