"""Readers, exports and the reconstruction by stages on small generated fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.axis import Axis
from tessella.operators import groups, invert, lookup, matrix
from tessella.plans import reconstruction
from tessella.plans.run import VERSION, Run, Settings, Sweep
from tessella.sources import config, raster, sinks, tables

CARD = """{ "DETECTOR_PARAMETERS": { "name": "det_%02d" // a panel
  , "angle_unit": "tangent", "nbinx": 16, "txmin": -0.8, "txmax": 0.8, "nbiny": 8, "tymin": 0.0, "tymax": 0.8
  , "length_hori": 0.333, "length_vert": 0.333, "length_dept": 0.03, "n_unit": 2, "rotation_type": "LOCAL"
  , "yaw_deg": %f, "roll_deg": 0.0, "pitch_deg": 0.0, "x": %f, "y": %f, "z": 2.0, "days": 120.0 } }"""


def test_readers_of_text(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert [tuple(r) for r in tables.read_profile(spark, write("p", "2 20\n1 10\n")).collect()] == [(1.0, 10.0), (2.0, 20.0)]
    x, y, g = tables.read_groups(spark, write("g", "4 0 4 1\n2 0 2 1\n0 2 0 1 5.5\n2 4 0 2 7\n"))
    assert (x, y) == (Axis("x", 4, 0.0, 4.0), Axis("y", 2, 0.0, 2.0)) and [tuple(r) for r in g.orderBy("igroup").collect()] == [(0, 0.0, 2.0, 0.0, 1.0, 5.5), (1, 2.0, 4.0, 0.0, 2.0, 7.0)]
    eff = tables.read_efficiencies(spark, write("e", "0 1 0 1 0.8 0.9 1.0\n3 4 1 2 0.5 0.6 0.7\n9 10 0 1 0 0 0\n"))
    got = tables.with_efficiencies(spark.createDataFrame([(0, 0), (3, 1), (1, 1)], "ix int, iy int"), eff, x, y).orderBy("ix").collect()
    assert [tuple(r)[2:] for r in got] == [(0.8, 0.9, 1.0), (None, None, None), (0.5, 0.6, 0.7)]
    with pytest.raises(Exception, match="wrong number"):
        tables.read_efficiencies(spark, write("bad", "1 2 3\n")).collect()
    source = tables.read_range_source(spark, write("r", "T a b c d e f g CSDA\n1.0 0 0 0 0 0 0 0 5.0\n1.0 0 0 0 0 0 0 0 9.0\nMinimum\n2.0 0 0 0 0 0 0 0 7.0 x\n"))
    assert sorted(map(tuple, source.collect())) == [(1.0, 5.0), (2.0, 7.0)]
    kml = '<kml xmlns="k"><Placemark><name><![CDATA[ref A]]></name><Point><coordinates>1.5,2.5,30</coordinates></Point></Placemark><Placemark><name>line</name><LineString/></Placemark><Placemark><name>b</name><Point><coordinates>3,4</coordinates></Point></Placemark></kml>'
    assert [tuple(r) for r in tables.read_kml(spark, write("k.kml", kml)).collect()] == [("ref A", 1.5, 2.5, 30.0), ("b", 3.0, 4.0, None)]
    feature = lambda name, kind, c: {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": name}
    geo = {"type": "FeatureCollection", "features": [feature({"name": " a "}, "Point", [1, 2, 3]), feature({"title": "t"}, "Point", [4, 5]), feature({}, "LineString", [[0, 0], [1, 1]])]}
    assert [tuple(r) for r in tables.read_geojson(spark, write("g.json", json.dumps(geo))).collect()] == [("a", 1.0, 2.0, 3.0), ("t", 4.0, 5.0, None)]
    assert tables.read_geojson(spark, write("f.json", json.dumps(geo["features"][0]))).count() == 1


def test_terrain_files_of_either_kind(spark, tmp_path):
    x, y = Axis("x", 3, 0.0, 30.0), Axis("y", 2, 0.0, 20.0)
    z = np.array([[5.0, 1.0, 2.0], [3.0, 4.0, 0.0]])
    (tmp_path / "t.g2zbin").write_bytes(raster.dumps("t", x, y, z))
    (tmp_path / "t.xyz").write_text("".join(f"{5 + 10 * i} {5 + 10 * j} {z[j, i]}\n" for j in range(2) for i in range(3)))
    found = [tables.read_pillars(spark, str(tmp_path / f"t.{kind}"), 0.0, 2.0) for kind in ("g2zbin", "xyz")]
    for pillars, px, py in found:
        assert (px, py) == (x, y) and {(r.ix, r.iy): (r.zmax, r.density) for r in pillars.collect()} == {(i, j): (z[j, i], 2.0 if z[j, i] > 0 else 0.0) for i in range(3) for j in range(2)}
    cells, gx, gy = tables.gridded(tables.read_terrain(spark, str(tmp_path / "t.xyz")), shifted=False)
    assert gx == Axis("x", 3, 5.0, 35.0) and cells.filter("ix IS NULL").count() == 0
    (tmp_path / "other").write_bytes(b"\x00\x01\x02")
    with pytest.raises(ValueError):
        tables.read_terrain(spark, str(tmp_path / "other"))


def test_flux_tables_and_models(spark, tmp_path):
    x, y = Axis("cos", 4, 0.0, 1.0), Axis("r", 5, 1.0, 6.0)
    (tmp_path / "f").write_bytes(raster.dumps("f", x, y, np.zeros((5, 4))))
    (tmp_path / "s").write_bytes(raster.dumps("s", x, y, -np.ones((5, 4))))
    (tmp_path / "bad").write_bytes(raster.dumps("s", x, y, np.ones((5, 4))))
    t = tables.load_flux_tables(spark, str(tmp_path / "f"), str(tmp_path / "s"), high=5.0)
    assert (t.low, t.high, t.x, t.flux.count(), t.slope.count()) == (1.0, 5.0, x, 20, 20)
    assert tables.load_flux_tables(spark, "none", str(tmp_path / "s")).flux is None
    with pytest.raises(Exception, match="diverges"):
        tables.load_flux_tables(spark, str(tmp_path / "f"), str(tmp_path / "bad"))
    (tmp_path / "m").write_text('{"base_eff": 0.9 /* all */}')
    assert tables.read_model(spark, str(tmp_path / "m")) == {"base_eff": 0.9}


def test_splines_and_regridding(spark):
    at = np.linspace(0, 3, 31)
    cubic = lambda v: 1 + 2 * v - v**2 + 0.3 * v**3
    nodes = np.array([0.0, 0.4, 1.0, 1.7, 2.2, 3.0])
    assert np.allclose(tables.spline(nodes, cubic(nodes), at), cubic(at))
    source = spark.createDataFrame([(float(10**k * 1000), float(10 ** (0.5 + 0.9 * k))) for k in np.linspace(-2, 3, 12)], "t_mev double, range double")
    got = tables.range_table(source, -1.0, 2.0, 0.5).orderBy("x").collect()
    assert np.allclose([(r.x, r.y) for r in got], [(v, 1.5 + 0.9 * v) for v in np.arange(-1, 2.1, 0.5)])
    flux = spark.createDataFrame([(float(c), float(e), float(10 ** (cubic(c) + e))) for c in nodes for e in (0.0, 1.0, 2.0)], "cos double, log10ke double, dfde double")
    out = tables.regridded_flux(flux, np.array([0.5, 2.9]), np.array([0.25, 1.5])).collect()
    assert all(abs(r.log10_dfde - cubic(r.cos) - r.log10ke) < 1e-9 for r in out) and len(out) == 4


def test_matrix_files_and_exports(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "m.bin").write_bytes(tables.matrix_bytes(m))
    got = {(r.row, r.col): r.value for r in tables.read_matrix(spark, str(tmp_path / "m.bin")).collect()}
    assert got == {(i, j): float(m[i, j]) for i in range(3) for j in range(4) if m[i, j]}
    coo = spark.createDataFrame([(1, 2, 0.5)], "row long, col long, value double")
    sinks.write_coordinates(coo, str(tmp_path / "coo"))
    assert spark.read.parquet(str(tmp_path / "coo")).dtypes == [("row", "float"), ("col", "float"), ("value", "float")]
    with pytest.raises(Exception, match="32-bit"):
        sinks.write_coordinates(coo.withColumn("row", F.lit(1 << 24)), str(tmp_path / "coo2"))
    cells = spark.createDataFrame([(0, 0, z, z < 2, z) for z in range(4)], "ix int, iy int, iz int, tf_exist boolean, n_hit int")
    sinks.write_cells(cells, str(tmp_path / "cells"), least_hits=1)
    sinks.write_column_ends(cells, str(tmp_path / "ends"))
    assert spark.read.parquet(str(tmp_path / "cells")).count() == 1 and spark.read.csv(str(tmp_path / "ends"), header=True).first()[2:] == ("0", "1")
    points = config.sweep_points([100.0], [50.0], [[2000, 1900, 1800, 1700]], [10.0, 20.0])
    sinks.write_sweep(spark, points, [False, True], str(tmp_path / "sweep"))
    back = spark.read.csv(str(tmp_path / "sweep"), header=True).orderBy("index").collect()
    assert back[1].label == "sr100_cl50_srd20_p2000_u1900_l1800_lat1700" and back[1].module8_executed == "true"
    assert sinks.chi_square_list(spark.createDataFrame([("center", 8.0, 4), ("lower", 1.0, 0)], "model string, chi2 double, ndf int")).collect()[1].chi2_per_ndf == 0
    assert len(sinks.element_table(spark.createDataFrame([(0, 1, 2.0)], "detid int, inthis int, signal double")).columns) == 29
    assert [config.errors_wanted(m, 1, 2, [1]) for m in ("none", "all", "last", "selected", "else")] == [False, True, True, True, False]


def test_groups_grow_and_rectangles_come_apart(spark):
    cells, weight = np.arange(9).reshape(3, 3), np.ones((3, 3))
    assert groups.merge_from(cells, weight, 0, 3, 20) and (cells == 0).sum() >= 3
    assert not groups.merge_from(np.zeros((2, 2), int), np.ones((2, 2)), 0, 9, 10)
    pieces = lookup.disjoint([(0, 2, 0, 2), (1, 3, 1, 3), (0, 3, 0, 3)])
    assert math.isclose(sum((b - a) * (d - c) for a, b, c, d in pieces), 9)
    with pytest.raises(Exception, match="no rectangle"):
        groups.all_grouped(spark.range(1), spark.createDataFrame([], "id long, rect_id int, excluded boolean"), ["id"]).collect()
    with pytest.raises(Exception, match="smaller"):
        groups.checked_sizes(spark.createDataFrame([(0, 0, 0)], "g int, ix int, iy int"), ["g"], 2, 1).collect()
    with pytest.raises(Exception, match="stays inside"):
        inside = F.array(F.struct(F.lit(True).alias("tf_in"), F.lit(1.0).alias("dist")))
        groups.volumes(spark.range(1), ["id"], inside, F.lit(1.0)).collect()
    assert not matrix.same(spark.range(3), spark.range(4)).first()[0]


def test_covariance_is_that_of_pairs(spark):
    rng = np.random.default_rng(1)
    xyz = rng.random((6, 3)) * 10
    places = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "col long, x double, y double, z double")
    for kind, lengths, diagonal in (("iso", (3.0,), 0.0), ("separable", (3.0, 2.0), 5.0), ("ellipsoidal", (3.0, 2.0), 0.0)):
        dense = invert.prior_covariance(2.0, lengths, kind, diagonal)(xyz)
        assert all(abs(dense[r.one, r.other] - r.value) < 1e-12 for r in invert.pairs(places, 2.0, lengths, kind, diagonal).collect())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    panels = tables.panels(spark, [CARD % (0, 0.0, 0.0, -190.0), CARD % (1, 270.0, 190.0, 0.0), CARD % (2, 180.0, 5.0, 190.0)])
    x = y = Axis("x", 20, -200.0, 200.0)
    terrain = raster.synthetic_terrain(spark, "cone", 20, 100.0, 150.0, 20.0)
    pillars = terrain.select("ix", "iy", F.lit(0.0).alias("zmin"), F.col("z").alias("zmax"), F.when(F.col("z") > 0, 2000.0).otherwise(0.0).alias("density"))
    settings = Settings([x, y, Axis("z", 6, 0.0, 120.0)], (0.0, 0.0, 30.0), (160.0, 160.0, 40.0), densities=(1800.0, 2000.0, 2000.0, 2000.0), truth=2000.0, parts=(8, 4), sigma_rho=300.0, corr_length=60.0)
    flux = lambda vz, dl: F.lit(1e2) * (F.lit(0.2) + vz) * F.pow(1 + dl / 1e5, F.lit(-2.0))
    slope = lambda vz, dl: F.lit(-2e-3) * (F.lit(0.2) + vz) * F.pow(1 + dl / 1e5, F.lit(-3.0))
    run = Run(spark, folder, pillars, panels, settings, flux, slope)
    run.go("compute_prior")
    return run


def test_a_run_goes_on_where_it_stopped(spark, made):
    assert made.whole("compute_prior") and not made.whole("build_observation_matrix")
    before = made.load("trace_path_lengths", "lengths").inputFiles()
    made.go()
    assert made.whole("analyze_errors") and made.load("trace_path_lengths", "lengths").inputFiles() == before
    errors = made.load("analyze_errors", "errors").collect()
    assert len(errors) > 50 and all(r.mixed >= r.stat > 0 and r.loo >= 0 and r.prior == 0 for r in errors)
    # the prior is 200 too light: the solution moves most cells the right way
    assert np.mean([r.density for r in errors]) > 1830 and made.load("invert_density", "chi_square").first().chi2_per_ndf < 3
    mark = json.loads(spark.read.text(f"{made.folder}/build_geometry/whole").head()["value"])
    assert mark["version"] == VERSION and mark["settings"]["corr_length"] == 60.0


def test_the_run_against_a_plain_one(spark, made):
    """Paths, counts, matrix and solution again, with arrays."""
    made.go()
    cells = {(r.ix, r.iy, r.iz): (r.kind, r.fill) for r in made.load("build_geometry", "cells").collect()}
    numbers = {(r.ix, r.iy, r.iz): r.col for r in made.load("trace_path_lengths", "numbers").collect()}
    from tessella.operators.trace import traverse

    axes = made.settings.axes
    low, step, n = (np.array([getattr(a, k) for a in axes]) for k in ("min", "interval", "nbin"))
    elements = made.load("trace_path_lengths", "elements").collect()
    counts = made.load("build_observation_matrix", "counts").orderBy("grp").collect()
    group = {r.ray_id: r.igroup for r in made.load("compute_prior", "elements").collect()}
    place = {(r.detid, r.igroup): r.grp for r in counts}
    a, expected = np.zeros((len(counts), len(numbers))), np.zeros(len(counts))
    for e in elements:
        found, length = traverse(np.array([e.px, e.py, e.pz]), np.array([e.vx, e.vy, e.vz]), low, step, n)
        own = [(tuple(c), x * cells[tuple(c)][1]) for c, x in zip(found.tolist(), length.tolist(), strict=True) if tuple(c) in cells]
        pl = sum(x for _, x in own)
        if pl < made.settings.least_path:
            continue
        dl = sum(x * (1800 if cells[c][0] == "cell" else 2000) for c, x in own)
        g = place[e.detid, group[e.ray_id]]
        expected[g] += 1e2 * (0.2 + e.vz) * (1 + dl / 1e5) ** -2 * e.sot
        for c, x in own:
            if c in numbers:
                a[g, numbers[c]] += x * -2e-3 * (0.2 + e.vz) * (1 + dl / 1e5) ** -3 * e.sot
    assert np.allclose([r.expected for r in counts], expected, rtol=1e-9)
    kept = [r for r in counts if r.observed > 0]
    at = np.array([[a_.min + (i + 0.5) * a_.interval for a_, i in zip(axes, c, strict=True)] for c, _ in sorted(numbers.items(), key=lambda x: x[1])])
    prior = invert.prior_covariance(300.0, (60.0,))(at)
    m = a[[r.grp for r in kept]]
    change, covariance = invert.posterior(m, np.array([r.observed - r.expected for r in kept]), np.array([r.observed for r in kept]), prior)
    got = made.load("invert_density", "densities").orderBy("col").collect()
    assert np.allclose([r.density for r in got], 1800 + change, rtol=1e-6) and np.allclose([r.error for r in got], np.sqrt(np.diag(covariance)), rtol=1e-5)


def test_priors_and_places(spark):
    shells = spark.createDataFrame([(1, "upper", 2.0), (1, "lateral", 1.0)], "ray_id int, kind string, pl double")
    cells = spark.createDataFrame([(1, 4.0), (2, 5.0)], "ray_id int, pl double")
    out = reconstruction.rebuilt_prior(shells, cells, cells.limit(0), (10.0, 1.0, 2.0, 3.0)).orderBy("ray_id").collect()
    assert [tuple(r) for r in out] == [(1, 7.0, 45.0), (2, 5.0, 50.0)]
    with pytest.raises(Exception, match="below the grid"):
        reconstruction.heights(spark.createDataFrame([(-1.0,)], "pz double"), F.col("pz"), 0.0).collect()


def test_changed_settings_and_inputs_are_never_answered_from_old_tables(spark, made):
    made.go()
    made.done.clear()
    other = made.with_settings(sigma_rho=100.0)
    assert other.whole("build_observation_matrix") and not other.whole("invert_density")
    other.go("invert_density")
    assert [s for s, _ in other.done] == ["invert_density"]
    mean = lambda r: r.load("invert_density", "densities").agg(F.avg("density")).first()[0]
    assert mean(other) != mean(made)
    assert not made.with_settings(center=(0.0, 0.0, 31.0)).whole("build_geometry")
    for part, value in (("pillars", made.pillars.withColumn("zmax", F.col("zmax") + 1)), ("panels", made.panels.filter("detid > 0"))):
        changed = Run(spark, made.folder, made.pillars, made.panels, made.settings, made.flux, made.slope)
        setattr(changed, part, value)
        assert not changed.whole("build_geometry")
    changed = Run(spark, made.folder, made.pillars, made.panels, made.settings, lambda vz, dl: F.lit(1.0), made.slope)
    assert changed.whole("trace_path_lengths") and not changed.whole("compute_prior")
    # rows in another order are the same input
    again = Run(spark, made.folder, made.pillars.repartition(3), made.panels, made.settings, made.flux, made.slope)
    assert again.whole("analyze_errors")


def test_a_sweep_shares_stages(spark, made):
    made.go()
    made.done.clear()
    sweep = Sweep(made, [300.0, 200.0], [60.0, 90.0], [1800.0, [1900.0, 2000.0, 2000.0, 2000.0]], errors="last", at_once=3)
    summary = sweep.go()
    done = [s for s, _ in made.done]
    # nothing is traced again; each density is priced once, each point solved once
    assert {s: done.count(s) for s in done} == {"compute_prior": 2, "build_observation_matrix": 2, "invert_density": 8, "analyze_errors": 1}
    rows = summary.orderBy("index").collect()
    assert [r.label for r in rows][:3] == ["sr300_cl60_srd300_p1800_u1800_l1800_lat1800", "sr300_cl90_srd300_p1800_u1800_l1800_lat1800", "sr200_cl60_srd200_p1800_u1800_l1800_lat1800"]
    assert [r.module8_executed for r in rows] == [False] * 7 + [True]
    assert spark.read.option("header", True).csv(f"{made.folder}/sweep_summary.csv").count() == 8
    got = sweep.densities_of_all().groupBy("index").agg(F.countDistinct("col").alias("n"), F.avg("density").alias("d")).orderBy("index").collect()
    assert len({r.n for r in got}) == 1 and len({round(r.d, 6) for r in got}) == 8
    # a point alone gives the same
    alone = made.with_settings(densities=(1900.0, 2000.0, 2000.0, 2000.0), sigma_rho=200.0, corr_length=90.0, sigma_rho_diag=200.0)
    made.done.clear()
    alone.go()
    assert not made.done and made.load("invert_density", "densities").count() == got[0].n
    with pytest.raises(ValueError, match="at least"):
        sweep.go("compute_prior")


def test_a_run_with_noise_efficiencies_and_divided_groups(spark, made):
    # the efficiency is one half for odd columns of bins
    bins = made.load("trace_path_lengths", "elements").select("detid", "ix", "iy", F.when(F.col("ix") % 2 == 1, 0.5).otherwise(1.0).alias("eff_cnt"))
    run = Run(spark, made.folder, made.pillars, made.panels, made.settings, made.flux, made.slope, bins)
    run = run.with_settings(noise=(0.1, 0.2, 0.0, 0.0), draw_signal=False, grouping="auto", trigger=2e5, prior_range=(1700.0, 1900.0))
    run.go()
    assert "trace_path_lengths" not in [s for s, _ in run.done]
    plain = {(r.detid, r.ix, r.iy): r.n for r in made.load("compute_prior", "prior").collect()}
    for r in run.load("compute_prior", "prior").collect():
        assert r.n == pytest.approx(plain[r.detid, r.ix, r.iy] * (0.5 if r.ix % 2 else 1.0))
    elements = run.load("compute_prior", "elements")
    assert elements.filter("abs(noise_det - 0.1 * signal) > 1e-9 * signal OR abs(noise_poi - 0.2 * signal) > 1e-9 * signal").count() == 0
    # a group that holds the trigger can't be halved any more
    held = elements.groupBy("detid", "igroup").agg(F.sum(F.col("signal") + F.col("noise_poi")).alias("w"), F.count(F.lit(1)).alias("n"))
    assert held.filter("w >= 2e5 AND n > 1").count() == 0 and held.count() > 20
    counts = run.load("build_observation_matrix", "counts").collect()
    assert all(r.variance >= r.observed for r in counts)
    errors = run.load("analyze_errors", "errors").collect()
    assert errors and all(r.prior == pytest.approx(abs(r.prior_high - r.prior_low) / 2) and r.mixed >= r.prior for r in errors) and any(r.prior > 1 for r in errors)
