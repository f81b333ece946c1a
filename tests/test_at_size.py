"""What a step must not do as tables grow: plans and small cases of the operators that queries over large tables share."""

import itertools

from pyspark.sql import functions as F

from tessella.functions import geometry
from tessella.functions.axis import Axis
from tessella.operators import groups, lookup, trace, windows

RECT = "rect_id long, excluded boolean, xlow double, xup double, ylow double, yup double"
AXES = [Axis("x", 10, 0.0, 10.0), Axis("y", 12, 0.0, 12.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_rays(spark, n=40):
    return spark.range(n).select(F.col("id").alias("ray_id"), F.lit(-1.0).alias("px"), (F.col("id") % 10 + 0.35).alias("py"), F.lit(1.0).alias("vx"), ((F.col("id") % 7 - 3) * 0.11).alias("vy"))


def test_overlaps_of_equal_rectangles_without_a_broadcast(spark):
    shapes = [(0.0, 2.0, 0.0, 2.0), (1.0, 3.0, 1.0, 4.0), (3.0, 4.0, 0.0, 9.0), (7.0, 7.0, 1.0, 1.0)]
    rows = [(i, False, *shapes[i % 4]) for i in range(12)] + [(None, False, *shapes[0])]
    out = lookup.overlaps(spark.createDataFrame(rows, RECT))
    assert "Broadcast" not in plan(out)
    wanted = []
    for a, b in itertools.combinations(rows[:12], 2):
        dx, dy = min(a[3], b[3]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[4], b[4])
        if dx >= 0 and dy >= 0 and (dx > 0 or dy > 0):
            wanted.append((a[0], b[0], dx * dy))
    assert sorted(map(tuple, out.collect())) == sorted(wanted)


def test_first_of_equal_rectangles_without_a_sort_of_hits(spark):
    rows = [(i, i % 7 == 3, 0.0, 2.0, 0.0, 2.0) for i in range(3, 60)] + [(2, None, 5.0, 6.0, 5.0, 6.0), (1, True, 8.0, 9.0, 8.0, 9.0), (1, False, 8.0, 9.5, 8.0, 9.0), (None, False, 0.0, 9.0, 0.0, 9.0)]
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.5, 5.5), (3, 8.5, 8.5), (4, 3.0, 3.0)], "k long, x double, y double")
    out = lookup.first_rectangle_of_all(points, spark.createDataFrame(rows, RECT), F.col("x"), F.col("y"), ["k"])
    assert "SortAggregate" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 3, True), (2, 2, None), (3, 1, False)]


def test_rays_are_traced_in_their_rows(spark):
    rays = some_rays(spark)
    for out in (trace.crossings(rays, AXES), trace.stretches(rays, AXES)):
        assert "Exchange" not in plan(out) and "Window" not in plan(out)
    summed = trace.stretches(rays, AXES).groupBy("ray_id", "ix", "iy").agg(F.sum(F.col("t1") - F.col("t0")).alias("length"))
    got = {tuple(r)[:3]: r.length for r in trace.crossings(rays, AXES).collect()}
    wanted = {tuple(r)[:3]: r.length for r in summed.collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)
    assert len(got) == trace.crossings(rays, AXES).count()


def test_cells_that_many_rays_cross_are_looked_up_without_a_shuffle(spark):
    cells = trace.crossings(some_rays(spark), AXES)
    densities = cells.select("ix", "iy").distinct().withColumn("density", F.lit(2.0))
    for out in (trace.path_sums(cells, densities, ["ix", "iy"]), groups.left_out_paths(cells, cells.filter("ix % 2 = 0"), ["ix", "iy"])):
        assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    assert all(abs(r.dl - 2 * r.pl) < 1e-9 for r in trace.path_sums(cells, densities, ["ix", "iy"]).collect())


def test_slab_names_every_axis_a_few_times(spark):
    p, v, a, b = ([F.col(f"{k}{i}") for i in range(3)] for k in "pvab")
    assert str(geometry.slab_length(p, v, a, b)).count("try_divide") <= 24


def test_tables_are_dealt_by_their_rows(spark):
    rows = spark.range(1000).withColumn("col", F.col("id") % 50)
    assert windows.dealt(rows, ["id", "col"], 100).rdd.getNumPartitions() == 10
    one = windows.dealt(rows, ["id", "col"], 100).groupBy("id", "col").agg(F.count(F.lit(1)).alias("n"))
    other = windows.dealt(rows, ["id", "col"], 100).groupBy("id", "col").agg(F.max("col").alias("m"))
    assert plan(one.join(other.hint("merge"), ["id", "col"])).count("Exchange") <= 2
    assert plan(windows.dealt(rows, ["id", "col"], 1000)).count("Exchange") == 0
