"""A generated case of the tutorial's size, from terrain to densities: 11 panels of 320 x 160 bins around a cone of 10 m cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.axis import Axis
from tessella.plans.run import Run, Settings
from tessella.sources.raster import synthetic_terrain


def scene(spark: SparkSession) -> tuple[DataFrame, DataFrame, list[Axis]]:
    """Pillars, panels and axes."""
    x, y, z = Axis("x", 41, -205.0, 205.0), Axis("y", 41, -205.0, 205.0), Axis("z", 13, 0.0, 130.0)
    terrain = synthetic_terrain(spark, "cone", 41, 120.0, 200.0, 10.0).filter("z > 0")
    pillars = terrain.select("ix", "iy", F.lit(0.0).alias("zmin"), F.col("z").alias("zmax"), F.lit(2000.0).alias("density"))
    k = F.col("id")
    azimuth = k * (2 * math.pi / 11)
    place = {"px": -200 * F.sin(azimuth), "py": -200 * F.cos(azimuth), "pz": F.lit(1.0), "yaw": azimuth, "roll": F.lit(0.0), "pitch": F.lit(0.0)}
    card = {"nbinx": 320, "txmin": -1.6, "txmax": 1.6, "nbiny": 160, "tymin": 0.0, "tymax": 1.6, "hori": 0.333, "vert": 0.333, "dept": 0.03, "n_unit": 2, "days": 120.0}
    panels = spark.range(11).select(k.cast("int").alias("detid"), *[v.alias(n) for n, v in place.items()], *[F.lit(v).alias(n) for n, v in card.items()])
    return pillars, panels, [x, y, z]


def reconstruct(spark: SparkSession, folder: str, until: str = "invert_density") -> Run:
    """The run by stages below a folder, through the inversion: groups of 20 x 20 bins, 2,370 unknowns."""
    pillars, panels, axes = scene(spark)
    flux = lambda vz, dl: F.lit(1e-2) * (F.lit(0.2) + vz) * F.pow(1 + dl / 1e5, F.lit(-2.0))
    slope = lambda vz, dl: F.lit(-2e-7) * (F.lit(0.2) + vz) * F.pow(1 + dl / 1e5, F.lit(-3.0))
    run = Run(spark, folder, pillars, panels, Settings(axes, (0.0, 0.0, 60.0), (200.0, 200.0, 100.0), parts=(16, 8)), flux, slope)
    run.go(until)
    return run
