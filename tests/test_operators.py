"""Closed forms and brute force for the operators; the queries against their SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import angles, geometry, physics, stats
from tessella.functions.axis import Axis
from tessella.operators import grid, groups, invert, lookup, matrix, trace, windows
from tessella.plans import detectability, flux_tables, reconstruction
from tessella.sources import config, raster


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_axis_bins_are_half_open(spark):
    a = Axis("x", 4, 0.0, 1.0)
    values = [0.0, 0.25, 0.5 - 1e-12, math.nextafter(1.0, 0), 1.0, -1e-9, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", a.index(F.col("v")).alias("i"))
    assert [r.i for r in df.collect()] == [0, 1, 1, 3, None, None, None]
    assert a.cut(0.25, 0.8).nbin == 2 and a.split(3).nbin == 12
    assert a.merged(0.6, 2) == Axis("x", 1, 0.0, 0.5)
    with pytest.raises(ValueError):
        Axis("x", 0, 0.0, 1.0)


def test_raster_round_trip(spark, tmp_path):
    x, y = Axis("x", 5, 0.0, 5.0), Axis("y", 3, -1.0, 2.0)
    z = np.arange(15, dtype=float).reshape(3, 5)
    z[1, 2] = np.nan
    for precision in (4, 8):
        (tmp_path / f"a{precision}.g2zbin").write_bytes(raster.dumps("h", x, y, z, precision))
        name, x2, y2, z2 = raster.loads((tmp_path / f"a{precision}.g2zbin").read_bytes())
        assert (name, x2, y2) == ("h", x, y) and np.array_equal(z, z2, equal_nan=True)
    spark.dataSource.register(raster.RasterSource)
    df = spark.read.format("g2zbin").option("cells", 5).load(str(tmp_path / "a8.g2zbin"))
    assert df.count() == 15 and df.filter("isnan(z)").select("ix", "iy").first() == (2, 1)
    out = str(tmp_path / "b.g2zbin")
    df.coalesce(1).write.format("g2zbin").options(nx=5, xmin=0, xmax=5, ny=3, ymin=-1, ymax=2).mode("append").save(out)
    assert np.array_equal(raster.loads(open(out, "rb").read())[3], z, equal_nan=True)
    assert raster.read_files(spark, str(tmp_path / "a4.g2zbin")).count() == 15
    with pytest.raises(ValueError):
        raster.loads(b"x" * 40)


def test_text_sources(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# comment\n0 1 0 1\nexclude 1 2 0 1\n\n")
    assert [tuple(r)[1:] for r in raster.read_rectangles(spark, str(tmp_path / "r.txt")).collect()] == [(False, 0.0, 1.0, 0.0, 1.0), (True, 1.0, 2.0, 0.0, 1.0)]
    (tmp_path / "xyz.txt").write_text("1 2 3\n4 5 6 # last\n")
    assert rows(raster.read_columns(spark, str(tmp_path / "xyz.txt"), ["x", "y", "z"])) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    assert config.loads('{"a": "//no", /* c */ "b": [1, 2] // d\n}') == {"a": "//no", "b": [1, 2]}
    assert config.flat({"a": {"b": [5]}}) == {"a.b.0": 5} and config.end_stage("analyze_errors") == 8 and config.end_stage("4") == 4
    with pytest.raises(ValueError):
        config.end_stage("errors")


def test_prefix_sums_against_brute_force(spark):
    cells = [(i, j, 1 + i + 10 * j) for i in range(9) for j in range(7)]
    sums = windows.prefix_sums(spark.createDataFrame(cells, "ix int, iy int, z long"), "z")
    rects = [(k, a, a + 3, b, b + 2) for k, (a, b) in enumerate([(0, 0), (2, 3), (6, 5)])]
    got = dict(windows.rectangle_sums(sums, spark.createDataFrame(rects, "rect_id int, x0 int, x1 int, y0 int, y1 int")).select("rect_id", "total").collect())
    assert got == {k: sum(z for i, j, z in cells if a <= i < b and c <= j < d) for k, a, b, c, d in rects}


@pytest.mark.parametrize("kind", ["prism", "slanted"])
def test_rays_conserve_length(spark, kind):
    axes = [Axis(n, 8, 0.0, 8.0) for n in "xyz"]
    v = (1.0, 0.0, 0.0) if kind == "prism" else tuple((np.array([1.0, 0.5, 0.25]) / np.linalg.norm([1.0, 0.5, 0.25])).tolist())
    rays = spark.createDataFrame([(k, -1.0, 0.5 + k, 0.3, *v) for k in range(4)], "ray_id long, px double, py double, pz double, vx double, vy double, vz double")
    one = {r[:4]: r[4] for r in map(tuple, trace.crossings(rays, axes).collect())}
    other = {}
    for r in trace.traced(rays, axes).collect():
        other[tuple(r)[:4]] = other.get(tuple(r)[:4], 0) + r[4]
    assert {k for k, x in one.items() if x > 1e-9} == {k for k, x in other.items() if x > 1e-9}
    assert all(abs(one[k] - other[k]) < 1e-9 for k in one if one[k] > 1e-9)
    for k in range(4):
        t0, t1 = trace.traverse(np.array([-1.0, 0.5 + k, 0.3]), np.array(v), np.zeros(3), np.ones(3), np.full(3, 8))[1].sum(), sum(x for key, x in one.items() if key[0] == k)
        assert abs(t0 - t1) < 1e-9
    if kind == "prism":
        assert all(abs(x - 1) < 1e-12 for x in one.values()) and len(one) == 32


def test_marching_agrees_with_exact_paths(spark):
    axes = [Axis(n, 4, 0.0, 4.0) for n in "xy"]
    rays = spark.createDataFrame([(1, -1.0, 1.3, 0.9, 0.2)], "ray_id long, px double, py double, vx double, vy double")
    cells = spark.createDataFrame([(i, j, 1.0 + i) for i in range(4) for j in range(4)], "ix int, iy int, density double")
    exact = trace.path_sums(trace.crossings(rays, axes), cells, ["ix", "iy"]).first()
    rough = trace.marched(rays, axes, cells, 0.001, 8.0).first()
    assert abs(exact.pl - rough.pl) < 0.01 and abs(exact.dl - rough.dl) < 0.05


def test_solid_angles_add_up(spark):
    whole, cells = [(-0.4, 0.4, -0.3, 0.3)], [(-0.4 + 0.2 * i, -0.2 + 0.2 * i, -0.3 + 0.1 * j, -0.2 + 0.1 * j) for i in range(4) for j in range(6)]
    total = lambda r: spark.createDataFrame(r, "a double, b double, c double, d double").agg(F.sum(angles.solid_angle(F.col("a"), F.col("b"), F.col("c"), F.col("d")))).first()[0]
    assert abs(total(whole) - total(cells)) < 1e-12


def test_statistics(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(40)], "x double").select("x", stats.erfc(F.col("x")).alias("a"), stats.erfc_exact(F.col("x")).alias("b"))
    assert all(abs(r.a - math.erfc(r.x)) < 2e-7 and abs(r.b - math.erfc(r.x)) < 1e-15 for r in df.collect())
    draws = spark.range(2000).select("id", stats.poisson(F.lit(5.0), F.col("id")).alias("n"))
    assert rows(draws) == rows(draws.repartition(7)) and abs(draws.agg(F.avg("n")).first()[0] - 5) < 0.25
    got = spark.range(1).select(physics.k_of_n(F.lit(0.9), 2, 3), stats.p_two_sided(F.lit(1.96))).first()
    assert abs(got[0] - 0.972) < 1e-12 and abs(got[1] - 0.05) < 1e-3


def test_division_is_a_partition():
    rng = np.random.default_rng(0)
    for _ in range(30):
        cells = rng.random((rng.integers(1, 12), rng.integers(1, 12)))
        boxes = groups.divide(cells, [(0, cells.shape[0] - 1, 0, cells.shape[1] - 1)], 1.5, 1, 1, True)
        seen = np.zeros(cells.shape, int)
        for a, b, c, d in boxes:
            seen[a : b + 1, c : d + 1] += 1
        assert (seen == 1).all()
    # the odd line goes to the half with more
    assert groups.divide(np.array([[1.0], [9.0], [5.0]]), [(0, 2, 0, 0)], 15, 1, 1, True) == [(0, 0, 0, 0), (1, 2, 0, 0)]


def test_merging_needs_complete_blocks(spark):
    cells = spark.createDataFrame([(i, j, float(i)) for i in range(4) for j in range(4) if (i, j) != (3, 3)], "ix int, iy int, z double")
    assert rows(grid.merged(cells, ["ix", "iy"], 2, "z")) == [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 2.5)]
    assert grid.split(cells, ["ix", "iy"], 2).count() == 60


def test_terrain_and_voxels(spark):
    for kind in ("cylinder", "square_prism", "cone", "square_pyramid", "gaussian"):
        assert raster.synthetic_terrain(spark, kind, 11).agg(F.max("z")).first()[0] == 100.0
    pillars = spark.createDataFrame([(0, 0, 0.0, 25.0, 2.0)], "ix int, iy int, zmin double, zmax double, density double")
    got = [(r.iz, r.tf_exist, r.density) for r in grid.voxels(pillars, Axis("z", 4, 0.0, 40.0)).orderBy("iz").collect()]
    assert got == [(0, True, 2.0), (1, True, 2.0), (2, False, 1.0), (3, False, 0.0)]


def test_rectangles(spark):
    assert lookup.subtract((0, 4, 0, 4), (1, 2, 1, 2)) == [(0, 1, 0, 4), (2, 4, 0, 4), (1, 2, 0, 1), (1, 2, 2, 4)]
    assert lookup.subtract((0, 1, 0, 1), (2, 3, 2, 3)) == [(0, 1, 0, 1)]


def test_zoomed_density_finds_the_target(spark):
    bins = spark.createDataFrame([(g, float(x)) for g in (1, 2) for x in range(1, 6)], "g int, pl double")
    count = 1000 * F.exp(-F.col("pl") * F.col("rho") / 5)
    target = bins.groupBy("g").agg(F.sum(1000 * F.exp(-F.col("pl") * (F.lit(1.0) + F.col("g") * 0.23) / 5)).alias("target"))
    got = dict(groups.zoomed_density(bins, ["g"], 0.5, 3.0, [0.5, 0.1, 0.01], count, target).select("g", "rho").collect())
    assert abs(got[1] - 1.23) < 0.006 and abs(got[2] - 1.46) < 0.006


def test_inversion_both_ways():
    rng = np.random.default_rng(1)
    a, prior, noise = rng.random((3, 5)), np.diag(rng.random(5) + 0.5), rng.random(3) + 0.1
    change, cov = invert.posterior(a, np.ones(3), noise, prior)
    exact = np.linalg.inv(a.T @ np.diag(1 / noise) @ a + np.linalg.inv(prior))
    assert np.allclose(cov, exact) and np.allclose(change, exact @ a.T @ (np.ones(3) / noise))


def test_leave_one_out(spark):
    cells = spark.createDataFrame([(o, 10 * o + k, c, 1.0 + o * k + c) for o in (0, 1, 2) for k in (0, 1) for c in (0, 1)], "owner int, row long, col long, value double")
    seen = spark.createDataFrame([(o, 10 * o + k, 1.0 + k, 0.5) for o in (0, 1, 2) for k in (0, 1)], "owner int, row long, residual double, variance double")
    unknowns = spark.createDataFrame([(c, float(c), 0.0, 0.0, 2.0) for c in (0, 1)], "col long, x double, y double, z double, prior double")
    whole, loo = reconstruction.with_leave_one_out(cells, seen, unknowns, lambda x, y, z: np.exp(-np.abs(x)), [0, 1, 2])
    assert whole.count() == 2 and all(r.loo > 0 for r in loo.collect())


def test_flux_tables(spark):
    flux = spark.createDataFrame([(0, k / 100, -2.0 * k / 100) for k in range(0, 301)], "ic int, log_e double, value double")
    profile = spark.createDataFrame([(k / 10, 1.0 + k / 10) for k in range(0, 31)], "x double, y double")
    ranges = spark.createDataFrame([(i, 10.0 ** (1.5 + 0.5 * i)) for i in range(3)], "ir int, r double")
    cut = flux_tables.thresholds(ranges, profile)
    assert [round(r.log_e, 9) for r in cut.orderBy("ir").collect()] == [0.5, 1.0, 1.5]
    table = flux_tables.integrals(flux, cut.withColumn("log_e", F.round("log_e", 9)))
    for r in table.collect():  # the integral of E^-2 from E0 to 1000
        e0 = 10 ** (0.5 + 0.5 * r.ir)
        assert abs(10**r.log_f / (1 / e0 - 1e-3) - 1) < 1e-3
    assert not flux_tables.guard(flux_tables.derivatives(table, 1.0)).first().divergent


def test_efficiency_and_geometry(spark):
    one = spark.range(1)
    band = physics.efficiency_band(0.975, F.lit(1.0), F.lit(1.0), 0.05, F.lit(1.0), F.lit(1.0))
    assert [round(x, 9) for x in one.select(*band).first()] == [0.95, 0.975, 1.0]
    chord = geometry.cylinder_chord([F.lit(-5.0), F.lit(0.0), F.lit(1.0)], [F.lit(1.0), F.lit(0.0), F.lit(0.0)], (0.0, 0.0), (2.0, 2.0), 0.0, 3.0)
    assert abs(one.select(chord).first()[0] - 4.0) < 1e-12
    for kind, p in (("flat", {}), ("cos_power", {"power": 2}), ("sigmoid", {"center": 1.0, "width": 0.1}), ("step", {"edge": 1.0})):
        assert 0 <= one.select(physics.efficiency(kind, F.lit(0.5), p).cast("double")).first()[0] <= 1


def test_significance_order(spark):
    bins = spark.createDataFrame([(i, j, 100.0) for i in range(6) for j in range(6)], "ix int, iy int, signal double")
    rects = detectability.windows(spark.createDataFrame([(0, 6, 6)], "det int, nx int, ny int"), [2, 4], 2)
    out = detectability.tested(bins, rects, [-500.0], [1.0], [0.3, 0.1], lambda d: F.col("signal") * (1 - d / 1000))
    got = detectability.in_order(out).collect()
    assert got[0].alpha == 0.3 and got[0]["size"] == 2 and all(r.is_signi for r in got) and {r.signal_modi / r.signal_base for r in got} == {1.5}


def test_counts_volumes_and_profiles(spark):
    df = spark.createDataFrame([(g, 100.0, 7.0, 3.0) for g in range(500)], "g int, signal double, noise_poi double, noise_det double")
    seen = groups.observed_counts(df, ["g"], False)
    assert rows(seen) == rows(groups.observed_counts(df.repartition(5), ["g"], False)) and abs(seen.agg(F.avg("observed")).first()[0] - 110) < 1
    shell = F.array(F.struct(F.lit(True).alias("tf_in"), F.lit(1.0).alias("dist")), F.struct(F.lit(False).alias("tf_in"), F.lit(2.0).alias("dist")))
    assert abs(spark.range(1).select(groups.cone_volume(shell, F.lit(4 * math.pi))).first()[0] - 4 / 3 * math.pi * 7) < 1e-12
    x = Axis("x", 4, 0.0, 4.0)
    pillars = spark.createDataFrame([(i, 0, 10.0 * i) for i in range(4)], "ix int, iy int, zmax double")
    rays = spark.createDataFrame([(1, 0.5, 0.5, 5.0)], "ray_id long, px double, py double, pz double")
    cells = spark.createDataFrame([(1, i, 0) for i in range(4)], "ray_id long, ix int, iy int")
    assert rows(grid.profile_along(cells, pillars, x, x, rays, 2.0)) == [(1, 0.0, -5.0), (1, 1.0, 5.0), (1, 2.0, 15.0)]
    with pytest.raises(Exception, match="outside"):
        grid.checked_inside(spark.createDataFrame([(9.0, 0.0)], "x double, y double"), x, x).collect()


def test_matrices(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 5, 2.0), (1, 5, 3.0)], "row long, col long, value double")
    assert rows(matrix.renumbered(m, m.filter("col = 5").select("col"))) == [(0, 0, 2.0), (1, 0, 3.0)]
    assert rows(matrix.row_sums(m)) == [(0, 3.0), (1, 3.0)]
    assert matrix.differs(m, m, 1e-9).count() == 0 and matrix.stacked(m, m).count() == 6


def test_queries_match_their_sql(spark):
    import duckdb

    from tessella.plans.queries import QUERIES, SQL

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")

    def plain(values, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        cell = lambda x: x if x is None or isinstance(x, (bool, str)) else round(float(x), 5) + 0.0
        return sorted(([cell(r[i]) for i in order] for r in values), key=str)

    for name in sorted(set(SQL) & {"grid_index", "hist2d_weighted", "ray_cells_window", "prefix_rect_query", "rect_locate", "column_renumber", "map_solve_small", "ztest_significance", "dense_ids", "islands_in_out"}):
        df, r = QUERIES[name](spark, sf), c.execute(SQL[name])
        columns = [d[0] for d in r.description]
        assert plain(df.collect(), df.columns) == plain(r.fetchall(), columns), name
    for name in ("auto_divide", "poisson_draws"):
        assert QUERIES[name](spark, sf).count() > 0


def against_sql(spark, names):
    """The rows of each query, which are those of its SQL."""
    import duckdb

    from tessella.plans.queries import QUERIES, SQL

    sf, c, out = "/root/testdata/sf0.001", duckdb.connect(), {}
    for name in ("nation", "supplier", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in names:
        df, r = QUERIES[name](spark, sf), c.execute(SQL[name])
        columns = [d[0] for d in r.description]
        got, said = (sorted(tuple(float(x) for x in row) for row in values) for values in (df.select(*columns).collect(), r.fetchall()))
        assert len(got) == len(said) and np.allclose(got, said, atol=2e-3 if name.startswith("bilinear") else 2e-5), name
        out[name] = df
    return out


def test_ray_queries_take_every_order(spark):
    names = ["slab_intersect", "ray_cells_window", "ray_cells_batched", "path_density_sum", "left_out_paths"]
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    for name, df in against_sql(spark, names).items():
        rays = df.select("ray_id").distinct().count()  # some miss all boxes, none misses the grid
        assert rays > orders / 2 if name == "slab_intersect" else rays == orders, name


def test_queries_take_every_line_and_nation(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got = against_sql(spark, ["bilinear_lookup", "proj_density_scan", "leave_one_out_rows"])
    assert got["bilinear_lookup"].count() == lines.count()
    assert got["proj_density_scan"].count() == lines.select("l_suppkey").distinct().count()
    assert got["leave_one_out_rows"].count() == spark.read.parquet("/root/testdata/sf0.001/nation.parquet").count()


def test_methods_of_the_depth_sweep(spark):
    one = lambda *columns: spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    n = lambda *values: [F.lit(float(v)) for v in values]
    assert np.allclose(one(*angles.radial_lateral(n(3, 4), n(1, 2)), *angles.radial_lateral(n(0, 0), n(1, 2))), [11 / 5, -2 / 5, 0, 0])
    assert np.isclose(one(angles.between_near(n(2, 0, 0), n(2, 1, 0), 1.5))[0], math.atan(0.5)) and one(angles.between_near(n(2, 0, 0), n(2, 1, 0), 0.5))[0] is None
    assert np.isclose(one(geometry.cylinder_diameter(*n(10, 0.1, 3)))[0], 30 * math.tan(0.1)) and one(geometry.cylinder_diameter(*n(-1, 0.1, 3)))[0] is None
    assert np.allclose(one(*geometry.cylinder_range(n(0, 0), n(1, 0), n(10, 0), F.lit(2.0))), [-math.asin(0.1), math.asin(0.1)])
    back = one(*geometry.cylinder_range(n(0, 0), n(-1, 0), n(10, 0), F.lit(2.0)))
    assert np.allclose(back, [math.asin(0.1) - math.pi, math.pi - math.asin(0.1)])
    assert tuple(one(*geometry.cylinder_range(n(0, 0), n(1, 0), n(0.5, 0), F.lit(2.0)))) == (None, None)
    limits = one(*[geometry.highest_allowed(*n(h, d), u) for h, d, u in ((1, 2, "degree"), (1, 2, "tangent"), (2, 1, "degree"), (0, 1, "degree"), (1, 0, "degree"))])
    assert np.allclose(limits[:2], [30, math.tan(math.pi / 6)]) and limits[2] > 1e300 and tuple(limits[3:]) == (0, 0)
    tries = one(*[geometry.candidate_angles(F.lit(10.0), 2.0, F.lit(0.03), F.lit(b), "radian") for b in (40, 6, 2)], geometry.candidate_angles(F.lit(0.5), 2.0, F.lit(0.03), F.lit(40), "radian"))
    assert np.allclose(tries[0], [0.03, 0.06, 0.09, 0.12]) and np.allclose(tries[1], [0.03, 0.06]) and tries[2] == [] and tries[3] is None
    # differences of 20 at 100: z of 1.35, 1.35 and 1.41
    p = [math.erfc(z / math.sqrt(2)) for z in (20 / math.sqrt(220), 20 / math.sqrt(220), 20 / math.sqrt(200))]
    for kind, value in zip(("gaussian", "poisson", "chi_square"), p, strict=True):
        assert list(one(*[stats.is_significant(*n(100, 120), kind, a) for a in (value + 1e-5, value - 1e-5)])) == [True, False]


def test_rotations_turn_about_the_named_axes(spark):
    one = lambda *columns: np.array(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first(), float)
    n = lambda *values: [F.lit(float(v)) for v in values]
    quarter, none = F.lit(math.pi / 2), F.lit(0.0)
    assert np.allclose(one(*angles.turned(angles.rotation(none, quarter, none), n(0, 1, 0))), [0, 0, 1])  # roll about x
    assert np.allclose(one(*angles.turned(angles.rotation(none, none, quarter), n(0, 0, 1))), [1, 0, 0])  # pitch about y
    assert np.allclose(one(*angles.turned(angles.rotation(quarter, quarter, none), n(0, 1, 0))), [0, 0, 1])  # local: x first
    assert np.allclose(one(*angles.turned(angles.rotation(quarter, quarter, none, "global"), n(0, 1, 0))), [-1, 0, 0])
    rng = np.random.default_rng(2)
    for _ in range(5):
        a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 3)))
        assert np.allclose(one(*angles.aimed(n(*a), n(*a), n(*b))), b)
        u, w = rng.normal(size=(2, 3))
        assert np.isclose(one(*angles.aimed(n(*u), n(*a), n(*b))) @ one(*angles.aimed(n(*w), n(*a), n(*b))), u @ w)  # a rotation
    assert np.allclose(one(*angles.aimed(n(0, 0, 1), n(0, 0, 1), n(0, 0, -1))), [0, 0, -1])


def test_efficiency_models_by_their_files(spark):
    model = config.loads('{"base_eff": 0.9, "tx": {"fn": "step", "params": {"x0": 1.0, "w": 0.2, "inner": 1.0, "outer": 0.5}}, "ty": {"fn": "cos_power", "params": {"n": 2, "cutoff_deg": 45}}, "sigma": {"base": 0.1, "tx": {"fn": "sigmoid"}}}')
    for tx, ty in ((0.3, 0.2), (-1.4, 0.9), (0.0, 1.2)):
        e = 0.9 * (0.5 + 0.5 / (1 + math.exp((abs(tx) - 1) / 0.2))) * (0 if math.atan(ty) > math.radians(45) else math.cos(math.atan(ty)) ** 2)
        half = min(0.05 * (1 / (1 + math.exp((abs(tx) - 1) / 0.1)) + 1), e, 1 - e)
        assert np.allclose(spark.range(1).select(*physics.efficiency_model(model, F.lit(tx), F.lit(ty))).first(), [e - half, e, e + half])
    for bad in ({"tx": {"fn": "gauss", "params": {"sigma": 0}}}, {"layers": 3}, {"tx": {"fn": "other"}}):
        with pytest.raises(ValueError):
            physics.efficiency_model(bad, F.lit(0.0), F.lit(0.0))


def test_tails_and_guards(spark):
    for x in (0.5, 3.0, 6.0, 20.0):
        assert abs(spark.range(1).select(stats.erfc(F.lit(x))).first()[0] / math.erfc(x) - 1) < 2e-7
    line = [-1.0, -2.0, 0.0, 3.0, -1.0, None, -2.0]
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(line)], "ic int, ir int, z double")
    assert windows.sign_flips(df, F.col("z"), ["ic"], ["ir"]).first()[1:] == (7, 1, 1 / 7, 2 / 6)
    with pytest.raises(Exception, match="finite"):
        flux_tables.guard(df).collect()


def test_integrals_begin_at_the_threshold(spark):
    value = lambda e: -1.0 - 1.7 * e + 0.1 * e * e
    nodes = [k / 10 for k in range(31)]
    flux = spark.createDataFrame([(0, e, value(e)) for e in nodes], "ic int, log_e double, value double")
    cuts = [0.537, -1.0, 2.9999]
    got = {r.ir: r.log_f for r in flux_tables.integrals(flux, spark.createDataFrame(list(enumerate(cuts)), "ir int, log_e double"), 0.01).collect()}
    for ir, c in enumerate(cuts):
        low = max(c, 0.0)
        n = math.floor((3.0 - 1e-12 - low) / 0.01)
        f = [10 ** np.interp(low + k * 0.01, nodes, [value(e) for e in nodes]) for k in range(n + 1)]
        total = sum((f[k] + f[k - 1]) / 2 * (10 ** (low + k * 0.01) - 10 ** (low + (k - 1) * 0.01)) for k in range(1, n + 1))
        assert got[ir] == (pytest.approx(math.log10(total), abs=1e-9) if n else -math.inf)


def test_windows_of_the_depth_sweep(spark):
    panels = spark.createDataFrame([(0, 11, 11)], "det int, nx int, ny int")
    assert [r.i for r in detectability.windows(panels, [3], 2).collect()] == [0, 1, 2, 3] and detectability.windows(panels, [11], 2).count() == 1
    tries = spark.createDataFrame([(0.1, 0.0, 1.0, 53.0, 100.0, 7.0)], "half double, ty_min double, ty_max double, height double, distance double, rise double")
    got = detectability.depth_windows(tries, 0.1).orderBy("i").collect()
    want = [(i, 0.8 - i * 0.1, 1.0 - i * 0.1) for i in range(8)]
    want = [(i, a, b, 60 - 100 * b, 60 - 100 * a) for i, a, b in want if 53 - 100 * b >= 0]
    assert np.allclose([(r.i, r.ty0, r.ty1, r.depth_top, r.depth_bottom) for r in got], want)
    panel = spark.createDataFrame([(0, 100.0, 0.02, 40, 0.0, 1.0, 0.0, 60.0, 65.0)], "det int, distance double, interval double, nbin int, ty_min double, ty_max double, elev_det double, elev_object double, elev_surface double")
    sizes = [r["size"] for r in detectability.cylinder_tries(panel, "radian", 5.0, 30.0).orderBy("size").collect()]
    want = [200 * math.sin(0.02 * k) for k in range(1, 20) if 0.02 * (k - 1) < math.asin(0.15)]
    assert np.allclose(sizes, [s for s in want if 5 <= s <= 65])


def test_axes_keep_their_interval_and_reject_uneven_steps(spark):
    x = Axis("x", 3, 0.1, 0.4, 0.1)
    data = raster.dumps("h", x, Axis("y", 1, 0.0, 1.0), np.zeros((1, 3)))
    assert raster.loads(data)[1].interval == 0.1 != (0.4 - 0.1) / 3 and raster.dumps("h", *raster.loads(data)[1:]) == data
    df = spark.createDataFrame([(v,) for v in (0.0, 0.01, 0.020000001, 0.03)], "v double")
    assert grid.infer_axis(df, "v", strict=True).first().nbin == 4
    with pytest.raises(Exception, match="uneven"):
        grid.infer_axis(spark.createDataFrame([(v,) for v in (0.0, 1.0, 3.0)], "v double"), "v", strict=True).collect()


def test_rays_of_a_batch_at_once():
    rng = np.random.default_rng(4)
    low, step, n = np.zeros(3), np.array([1.0, 0.5, 2.0]), np.array([5, 8, 3])
    p, v = rng.uniform(-3, 8, (300, 3)), rng.normal(size=(300, 3))
    v[::7, 1], v[::11, 2] = 0, 0
    ray, cells, length = trace.traverse_all(p, v, low, step, n)
    for k in range(300):
        c, x = trace.traverse(p[k], v[k], low, step, n)
        total = {}
        for cell, a in zip(map(tuple, c), x, strict=True):
            total[cell] = total.get(cell, 0) + a
        own = {}
        for cell, a in zip(map(tuple, cells[ray == k]), length[ray == k], strict=True):
            own[cell] = own.get(cell, 0) + a
        assert {c for c, a in own.items() if a > 1e-9} == {c for c, a in total.items() if a > 1e-9} and all(abs(own.get(c, 0) - a) < 1e-9 for c, a in total.items())


def test_nonnegative_least_squares_against_all_supports():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(10):
        a, b, start = rng.normal(size=(6, 4)), rng.normal(size=6), rng.uniform(-1, 1, 4)
        cost = lambda x: np.sum((a @ x - b) ** 2) + 0.3 * np.sum((x - start) ** 2)  # noqa: E731, B023
        best = math.inf
        for kept in itertools.product((0, 1), repeat=4):
            at = np.flatnonzero(kept)
            x = np.zeros(4)
            if len(at):
                m = a[:, at]
                x[at] = np.linalg.solve(m.T @ m + 0.3 * np.eye(len(at)), m.T @ b + 0.3 * start[at])
            if (x >= 0).all():
                best = min(best, cost(x))
        assert invert.nonnegative(a, b, start, 0.3).min() >= 0 and cost(invert.nonnegative(a, b, start, 0.3)) == pytest.approx(best, rel=1e-6)


def test_asymmetric_draws(spark):
    draws = spark.range(20_000).select("id", stats.asymmetric_draw(F.lit(1.0), F.lit(0.5), F.lit(2.0), F.col("id")).alias("x"))
    x = np.array([r.x for r in draws.collect()])
    assert abs((x < 1).mean() - 0.2) < 0.01 and abs(np.sqrt(np.mean((x[x < 1] - 1) ** 2)) - 0.5) < 0.02 and abs(np.sqrt(np.mean((x[x > 1] - 1) ** 2)) - 2) < 0.05
    assert rows(draws.limit(50)) == rows(draws.repartition(5).filter("id < 50"))


def test_pillars_cut_rays(spark):
    x = Axis("x", 4, 0.0, 4.0)
    pillars = spark.createDataFrame([(i, j, 1.0, 3.0) for i in range(4) for j in range(4)], "ix int, iy int, zmin double, zmax double")
    r = spark.createDataFrame([(1, -1.0, 0.5, 0.0, 1.0, 0.0, 0.5), (2, -1.0, 0.5, 2.0, 1.0, 0.0, 0.0), (3, -1.0, 0.5, 5.0, 1.0, 0.0, 0.0), (4, -1.0, 0.5, 3.5, 1.0, 0.0, -0.25)], "ray_id long, px double, py double, pz double, vx double, vy double, vz double")
    got = dict(trace.pillar_stretches(r, x, x, pillars).groupBy("ray_id").agg(F.sum(F.col("t1") - F.col("t0"))).collect())
    assert got == pytest.approx({1: 3.0, 2: 4.0, 4: 3.0})
