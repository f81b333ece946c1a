"""Map projection, shared draws, layers, and the order of lines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import physics, projection, stats
from tessella.functions.axis import Axis
from tessella.sources import tables


def meridian(lat, ellipsoid=projection.WGS84):
    """Length of the meridian from the equator, by numbers."""
    a, f = ellipsoid
    e2, n = f * (2 - f), 200_000
    phi = (np.arange(n) + 0.5) * math.radians(lat) / n
    return float(np.sum(a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5) * math.radians(lat) / n)


def at(spark, projection_, places):
    df = spark.createDataFrame(places, "lon double, lat double")
    x, y = projection_.forward(F.col("lon"), F.col("lat"))
    out = df.withColumns({"x": x, "y": y})
    lon, lat = projection_.inverse(F.col("x"), F.col("y"))
    return out.withColumns({"lon2": lon, "lat2": lat}).collect()


def test_transverse_mercator(spark):
    zone = projection.utm(54)
    rows = at(spark, zone, [(141.0, lat) for lat in (-80.0, -33.3, 0.0, 35.0, 84.0)])
    # on its meridian it is the meridian's length, by the scale: what defines it there
    for r in rows:
        assert r.x == pytest.approx(500_000, abs=1e-6) and r.y == pytest.approx(0.9996 * meridian(r.lat), abs=1e-5)
    # elsewhere it is the one map that keeps angles: a step to the north and one to the east are alike and at right angles
    h = 1e-5
    a, f = projection.WGS84
    e2 = f * (2 - f)
    for lon, lat in ((138.0, 35.3), (144.5, -60.0), (141.3, 10.0)):
        p = at(spark, zone, [(lon + h, lat), (lon - h, lat), (lon, lat + h), (lon, lat - h)])
        w = 1 - e2 * math.sin(math.radians(lat)) ** 2
        east = np.array([p[0].x - p[1].x, p[0].y - p[1].y]) / (2 * math.radians(h) * a * math.cos(math.radians(lat)) / math.sqrt(w))
        north = np.array([p[2].x - p[3].x, p[2].y - p[3].y]) / (2 * math.radians(h) * a * (1 - e2) / w**1.5)
        assert np.allclose(east, [north[1], -north[0]], atol=1e-7) and np.linalg.norm(east) > 0.9996 - 1e-9
    places = [(138 + k * 0.37, -79 + k * 9.5) for k in range(17)]
    assert all(r.lon2 == pytest.approx(r.lon, abs=1e-10) and r.lat2 == pytest.approx(r.lat, abs=1e-10) for r in at(spark, zone, places))
    # a published point: 33.3 N, 44.4 E in zone 38
    r = at(spark, projection.of_code(32638), [(44.4, 33.3)])[0]
    assert (r.x, r.y) == (pytest.approx(444140.54, abs=0.01), pytest.approx(3684706.36, abs=0.01))
    assert projection.of_code(32738).north == 10_000_000 and projection.TransverseMercator(135.0, 36.0, 0.9999, 0.0, 0.0, projection.GRS80)._origin > 0
    for wrong in (4326, 32600, 32761):
        with pytest.raises(ValueError, match="UTM"):
            projection.of_code(wrong)
    zones = spark.createDataFrame([(v,) for v in (-180.0, -0.1, 0.0, 179.9, 180.0)], "lon double").select(projection.utm_zone(F.col("lon"))).collect()
    assert [r[0] for r in zones] == [1, 30, 31, 60, 1]


def test_places_seen_from_the_reference(spark, tmp_path):
    mark = "<Placemark><name>%s</name><Point><coordinates>%s</coordinates></Point></Placemark>"
    (tmp_path / "p.kml").write_text("<kml>" + mark % ("north of it", "141.0,35.1,100") + mark % ("main vent", "141.0,35.0,600") + mark % ("east", "141.1,35.0,0") + "</kml>")
    places = tables.read_kml(spark, str(tmp_path / "p.kml"))
    got = {r.name: r for r in tables.seen_from(places, projection.utm(54)).collect()}
    r = got["north of it"]
    assert r.azimuth == pytest.approx(180) or r.azimuth == pytest.approx(-180)
    assert r.distance == pytest.approx(0.9996 * (meridian(35.1) - meridian(35.0)), abs=1e-4) and r.tangent == pytest.approx(500 / r.distance)
    assert got["east"].azimuth == pytest.approx(-90, abs=0.1) and got["main vent"].distance == 0
    with pytest.raises(ValueError, match="no place is named"):
        tables.seen_from(places, projection.utm(54), ("crater",))


def test_shared_factors(spark):
    bins = spark.range(120).select((F.col("id") % 40).alias("ix"), F.floor(F.col("id") / 40).alias("iy")).crossJoin(spark.range(200).withColumnRenamed("id", "panel"))
    parts = [("tx", 0.1, [F.col("panel"), F.col("ix")]), ("ty", 0.0, [F.col("iy")]), ("amp", 0.05, [F.col("panel"), F.col("ix"), F.col("iy")])]
    f = stats.shared_factor(parts, 7)
    one, other = ({(r.panel, r.ix, r.iy): r.f for r in b.withColumn("f", f).collect()} for b in (bins, bins.repartition(7)))
    assert one == other
    shared = bins.select("panel", "ix", "iy", stats.shared_factor(parts[:1], 7).alias("f")).toPandas()
    # one draw for a column of bins; another for other columns, panels and seeds
    assert shared.groupby(["panel", "ix"]).f.nunique().max() == 1 and shared.f.nunique() == 8000
    draws = shared.drop_duplicates(["panel", "ix"]).f.to_numpy()
    assert draws.mean() == pytest.approx(1, abs=0.005) and draws.std() == pytest.approx(0.1, rel=0.04)
    z = (draws - 1) / 0.1
    assert np.mean(z**4) == pytest.approx(3, abs=0.3) and abs(np.mean(z**3)) < 0.12
    assert bins.limit(3).select(stats.shared_factor(parts[1:2]).alias("f")).distinct().collect()[0].f == 1.0
    whole = np.array(list(one.values()))
    assert whole.std() == pytest.approx(math.hypot(0.1, 0.05), rel=0.05)


def test_layers(spark):
    layers = {"n": 4, "k": 3, "per_layer_sigma": 0.1, "per_layer": {"fn": "flat"}}
    low, central, high = physics.layered(layers | {"per_layer": {"fn": "poly", "params": {"coef": [0.8]}}}, F.lit(0.0), F.lit(1.3))
    r = spark.range(1).select(low.alias("l"), central.alias("c"), high.alias("h")).first()
    tail = lambda p: 4 * p**3 * (1 - p) + p**4
    assert r.l == pytest.approx(1.3 * tail(0.7)) and r.c == 1.0 and r.h == 1.0
    assert spark.range(1).select(*physics.layered(layers, F.lit(0.0))).first()[1] == 1.0


def test_the_last_line_wins(spark, tmp_path):
    lines = ["# a comment", "0 1 0 1 0.9 0.95 1.0", "0 1 0 1 0.1 0.2 0.3", "", "1 2 0 1 0.5 0.5 0.5", "0 1 0 1 0.4 0.5 0.6"]
    (tmp_path / "e").write_text("\n".join(lines))
    got = tables.with_efficiencies(spark.createDataFrame([(0, 0), (1, 0)], "ix int, iy int"), tables.read_efficiencies(spark, str(tmp_path / "e")).repartition(5), Axis("x", 2, 0.0, 2.0), Axis("y", 1, 0.0, 1.0))
    assert {(r.ix, r.eff_low, r.eff_cnt, r.eff_upp) for r in got.collect()} == {(0, 0.4, 0.5, 0.6), (1, 0.5, 0.5, 0.5)}
    cloud = [(x + 0.5, y + 0.5, 10.0 * x + y) for x in range(3) for y in range(3)]
    (tmp_path / "t").write_text("\n".join(f"{x} {y} {z} 1 2 3" for x, y, z in [(0.5, 0.5, 99.0), *cloud]))
    pillars, x, y = tables.read_pillars(spark, str(tmp_path / "t"), -1.0, 2.0)
    assert (x.nbin, y.nbin) == (3, 3) and {(r.ix, r.iy): r.zmax for r in pillars.collect()}[0, 0] == 0.0
    assert tables.read_coloured(spark, str(tmp_path / "t")).select("r", "g", "b").distinct().collect() == [(1, 2, 3)]
