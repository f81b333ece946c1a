"""Queries of the inversion in tiles, over suppliers as unknowns with a full prior covariance, and of whole runs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from tessella.functions import physics, projection
from tessella.functions.axis import Axis
from tessella.operators import invert, tiled, windows
from tessella.plans.queries import query, raster
from tessella.plans.run import Run, Settings, Sweep

SIGMA, LENGTH, OWN = 2.0, 4.0, 2.5

SYSTEM = f"""
    places AS (SELECT s_suppkey AS col, s_suppkey % 10 * 1.0 AS x, floor(s_suppkey / 10.0) % 10 AS y, s_suppkey % 3 * 1.0 AS z, 1.0 + s_nationkey % 5 AS prior FROM supplier),
    a AS (SELECT l_returnflag AS run, l_linenumber % 2 AS p, l_suppkey AS col, sum(l_quantity) / 1000 AS value FROM lineitem GROUP BY ALL),
    seen AS (SELECT l_returnflag AS run, l_linenumber % 2 AS p, avg(l_extendedprice) / 1000 - 40 AS residual, count(*) / 100.0 AS variance FROM lineitem GROUP BY ALL),
    c AS (SELECT i.col AS i, j.col AS j, CASE WHEN i.col = j.col THEN {OWN**2} ELSE {SIGMA**2} * exp(-sqrt(pow(i.x - j.x, 2) + pow(i.y - j.y, 2) + pow(i.z - j.z, 2)) / {LENGTH}) END AS value FROM places i, places j)"""


def system(t):
    lines = t("lineitem").withColumns({"run": F.col("l_returnflag"), "row": F.col("l_linenumber") % 2})
    cells = lines.groupBy("run", "row", F.col("l_suppkey").alias("col")).agg((F.sum("l_quantity") / 1000).alias("value"))
    seen = lines.groupBy("run", "row").agg((F.avg("l_extendedprice") / 1000 - 40).alias("residual"), (F.count(F.lit(1)) / 100).alias("variance"))
    k = F.col("s_suppkey")
    places = t("supplier").select(k.alias("col"), (k % 10 * 1.0).alias("x"), (F.floor(k / 10) % 10).cast("double").alias("y"), (k % 3 * 1.0).alias("z"), (1.0 + F.col("s_nationkey") % 5).alias("prior"))
    return cells, seen, places


@query(f"""WITH {SYSTEM},
    b AS (SELECT run, p, j, sum(a.value * c.value) AS value FROM a JOIN c ON c.i = a.col GROUP BY ALL),
    s AS (SELECT b.run, b.p, a.p AS q, sum(b.value * a.value) + CASE WHEN b.p = a.p THEN any_value(variance) ELSE 0 END AS value FROM b JOIN a ON a.run = b.run AND a.col = b.j JOIN seen ON seen.run = b.run AND seen.p = b.p GROUP BY b.run, b.p, a.p),
    s2 AS (SELECT run, max(value) FILTER (WHERE p = 0 AND q = 0) AS s00, max(value) FILTER (WHERE p = 0 AND q = 1) AS s01, max(value) FILTER (WHERE p = 1 AND q = 1) AS s11 FROM s GROUP BY run),
    r2 AS (SELECT run, max(residual) FILTER (WHERE p = 0) AS r0, max(residual) FILTER (WHERE p = 1) AS r1 FROM seen GROUP BY run),
    b2 AS (SELECT run, j, max(value) FILTER (WHERE p = 0) AS b0, max(value) FILTER (WHERE p = 1) AS b1 FROM b GROUP BY run, j)
    SELECT run, col, round(prior + (b0 * (s11 * r0 - s01 * r1) + b1 * (s00 * r1 - s01 * r0)) / (s00 * s11 - s01 * s01), 6) AS density,
        round(sqrt({OWN**2} - (b0 * b0 * s11 - 2 * b0 * b1 * s01 + b1 * b1 * s00) / (s00 * s11 - s01 * s01)), 6) AS error
    FROM b2 JOIN s2 USING (run) JOIN r2 USING (run) JOIN places ON col = j""")
def tiled_solution(t):
    out = tiled.solved(*system(t), invert.prior_covariance(SIGMA, (LENGTH,), "iso", OWN))
    return out.select("run", "col", F.round("density", 6).alias("density"), F.round("error", 6).alias("error"))


def mountain(t):
    """Pillars on the raster's cells, and a panel for each nation around them."""
    cells = raster(t)
    pillars = cells.select("ix", "iy", F.lit(0.0).alias("zmin"), (F.col("z") / cells.agg(F.max("z")).scalar() * 90).alias("zmax"), F.lit(2000.0).alias("density"))
    azimuth = F.col("n_nationkey") * (2 * math.pi / 25)
    place = {"px": 100 - 95 * F.sin(azimuth), "py": 110 - 105 * F.cos(azimuth), "pz": F.lit(1.0), "yaw": azimuth, "roll": F.lit(0.0), "pitch": F.lit(0.0)}
    card = {"nbinx": 8, "txmin": -0.8, "txmax": 0.8, "nbiny": 6, "tymin": 0.0, "tymax": 0.6, "hori": 0.5, "vert": 0.5, "dept": 0.03, "n_unit": 2, "days": 60.0}
    return pillars, t("nation").select(F.col("n_nationkey").alias("detid"), *[v.alias(n) for n, v in place.items()], *[F.lit(v).alias(n) for n, v in card.items()])


@query(None)
def sweep_of_runs(t):
    """Four points of two densities and two lengths, which share one geometry and one tracing."""
    pillars, panels = mountain(t)
    spark = pillars.sparkSession
    settings = Settings([Axis("x", 10, 0.0, 200.0), Axis("y", 11, 0.0, 220.0), Axis("z", 5, 0.0, 100.0)], (100.0, 110.0, 40.0), (120.0, 120.0, 60.0), parts=(4, 3))
    flux = lambda vz, dl: F.lit(1e2) * (F.lit(0.2) + vz) * F.pow(1 + dl / 1e5, F.lit(-2.0))
    slope = lambda vz, dl: F.lit(-2e-3) * (F.lit(0.2) + vz) * F.pow(1 + dl / 1e5, F.lit(-3.0))
    run = Run(spark, f"{windows.shared_folder(spark)}/sweep-{uuid.uuid4().hex}", pillars, panels, settings, flux, slope)
    sweep = Sweep(run, [300.0], [60.0, 120.0], [1900.0, [2100.0, 2000.0, 2000.0, 2000.0]], at_once=2)
    sweep.go("invert_density")
    out = sweep.densities_of_all()
    return out.withColumns({"density": F.round("density", 3), "error": F.round("error", 3)})


def _mercator_sql(lon: str, lat: str, mercator: projection.TransverseMercator) -> str:
    """x and y by the same series, one step after the other."""
    e = math.sqrt(mercator.ellipsoid[1] * (2 - mercator.ellipsoid[1]))
    forward = projection._series(mercator._n)[0]
    up = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(forward, 1))
    across = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(forward, 1))
    return f"""SELECT *, {mercator.east!r} + {mercator._radius!r} * (eta + {across}) AS x, {mercator.north!r} + {mercator._radius!r} * (xi + {up}) AS y FROM (
        SELECT *, atan2(t, cos(away)) AS xi, asinh(sin(away) / sqrt(t * t + cos(away) * cos(away))) AS eta FROM (
        SELECT *, radians({lon} - {mercator.lon0!r}) AS away, sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat})))) AS t FROM homes))"""


ZONE = projection.of_code(32654)


@query(f"""WITH homes AS (SELECT c_custkey, 138 + c_custkey % 600 * 0.01 AS lon, 30 + c_nationkey * 0.4 + c_custkey % 7 * 0.05 AS lat FROM customer)
    SELECT c_custkey, round(x, 4) AS x, round(y, 4) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM ({_mercator_sql("lon", "lat", ZONE)})""")
def projected_places(t):
    """Customers on a map, and back from it."""
    k = F.col("c_custkey")
    homes = t("customer").select(k, (138 + k % 600 * 0.01).alias("lon"), (30 + F.col("c_nationkey") * 0.4 + k % 7 * 0.05).alias("lat"))
    x, y = ZONE.forward(F.col("lon"), F.col("lat"))
    out = homes.select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = ZONE.inverse(F.col("x"), F.col("y"))
    return out.select("c_custkey", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("""WITH p AS (SELECT p_partkey, greatest(0, least(1, 1 - 0.01 * (p_size / 10.0) * (p_size / 10.0))) AS p FROM part)
    SELECT p_partkey, round(list_sum(list_transform([0, 1, 2], lambda j: [45, 10, 1][j + 1] * pow(greatest(0, p - 0.02), 8 + j) * pow(1 - greatest(0, p - 0.02), 2 - j))), 9) AS low,
        round(list_sum(list_transform([0, 1, 2], lambda j: [45, 10, 1][j + 1] * pow(p, 8 + j) * pow(1 - p, 2 - j))), 9) AS central,
        round(list_sum(list_transform([0, 1, 2], lambda j: [45, 10, 1][j + 1] * pow(least(1, p + 0.02), 8 + j) * pow(1 - least(1, p + 0.02), 2 - j))), 9) AS high FROM p""")
def layered_efficiency(t):
    """Tracks through eight of ten layers at least."""
    layers = {"n": 10, "k": 8, "per_layer_sigma": 0.02, "per_layer": {"fn": "poly", "params": {"coef": [1.0, 0.0, -0.01]}}}
    band = physics.layered(layers, F.col("p_size") / 10)
    return t("part").select("p_partkey", *[F.round(e, 9).alias(n) for e, n in zip(band, ("low", "central", "high"), strict=True)])
