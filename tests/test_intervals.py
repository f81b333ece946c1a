"""Joins by intervals against plain loops, and their plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import intervals, lookup

INF = float("inf")


def spread(rng):
    """Numbers of very different sizes, many of them equal."""
    return rng.choice([0.0, -0.0, 1.0, 0.5, rng.uniform(-3, 3), rng.uniform(-3, 3) * 10 ** rng.randint(-12, 12), float(round(rng.uniform(0, 9)))])


def plan(df):
    return df._jdf.queryExecution().toString()


def no_loops(df):
    said = plan(df)
    assert "NestedLoop" not in said and "CartesianProduct" not in said
    return df


@pytest.mark.parametrize("widths", [32, 2])
def test_points_in_pieces(spark, monkeypatch, widths):
    monkeypatch.setattr(intervals, "MOST_WIDTHS", widths)
    rng = random.Random(widths)
    pieces = [(k, rng.randint(0, 2), a, a + rng.choice([0.0, 1e-9, 0.3, 2.0, 1e6])) for k in range(80) for a in [spread(rng)]] + [(90, 0, -INF, INF), (91, 1, -INF, 0.0), (92, 1, 2.0, INF), (93, 0, None, 1.0), (94, 0, 1.0, None)]
    points = [(k, rng.randint(0, 2), spread(rng)) for k in range(200)] + [(300, 0, None), (301, 1, float("nan")), (302, 0, 1e300), (303, 0, -1e300)]
    df, ps = spark.createDataFrame(points, "point int, g int, x double"), spark.createDataFrame(pieces, "piece int, g int, low double, high double")
    got = sorted((r.point, r.piece) for r in no_loops(intervals.held(df, ps, [(F.col("x"), "low", "high")], ["g"])).collect())
    assert got == sorted((p, k) for p, g, x in points for k, h, a, b in pieces if g == h and None not in (x, a, b) and a <= x < b)
    assert intervals.held(df, ps.limit(0), [(F.col("x"), "low", "high")], ["g"]).count() == 0


def rectangles(rng, n):
    out = []
    for k in range(n):
        x, y, w, h = spread(rng), spread(rng), rng.choice([0.0, 0.5, 1.0, 4.0, 1e4]), rng.choice([1e-6, 0.5, 1.0, 40.0])
        out.append((k, k % 5 == 0, x, x + w, y, y + h))
    return out


RECTANGLES = "rect_id int, excluded boolean, xlow double, xup double, ylow double, yup double"


def test_first_rectangle(spark):
    rng = random.Random(5)
    rects, points = rectangles(rng, 150), [(k, spread(rng), spread(rng)) for k in range(300)]
    df, rs = spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(rects, RECTANGLES)
    got = {r.p: r.rect_id for r in no_loops(lookup.first_rectangle(df, rs, F.col("x"), F.col("y"), ["p"])).collect()}
    want = {}
    for p, x, y in points:
        first = next((r for r in rects if r[2] <= x < r[3] and r[4] <= y < r[5]), None)
        if first and not first[1]:
            want[p] = first[0]
    assert got == want and got


@pytest.mark.parametrize("seed", range(3))
def test_meeting_rectangles(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(intervals, "MOST_WIDTHS", 3)
    rects = rectangles(random.Random(seed), 120)
    got = [(r.one, r.other) for r in no_loops(lookup.overlaps(spark.createDataFrame(rects, RECTANGLES))).collect()]
    want = []
    for a in rects:
        for b in rects:
            dx, dy = min(a[3], b[3]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[4], b[4])
            if a[0] < b[0] and dx >= 0 and dy >= 0 and (dx > 0 or dy > 0):
                want.append((a[0], b[0]))
    assert sorted(got) == sorted(want) and len(set(got)) == len(got)
    assert lookup.overlaps(spark.createDataFrame([], RECTANGLES)).count() == 0


@pytest.mark.parametrize("keyed", [False, True])
def test_as_of(spark, keyed):
    rng = random.Random(9)
    events = [(rng.choice([1, 2, None]), rng.choice([None, float(rng.randint(0, 40))]), k) for k in range(60)]
    rows = [(k, rng.choice([1, 2, 3, None]), rng.choice([None, 7.0, 7.0, rng.uniform(-5, 60)])) for k in range(400)]
    by = ["g"] if keyed else []
    df, es = spark.createDataFrame(rows, "id int, g int, t double").repartition(3), spark.createDataFrame(events, "g int, at double, e int")
    es = es if keyed else es.drop("g")
    for most in (None, 3.0):
        got = {r.id: (r["at"], r.e) for r in no_loops(intervals.as_of(df, es, F.col("t"), "at", by, most)).collect()}
        want = {}
        for i, g, t in rows:
            before = [(at, e) for h, at, e in events if at is not None and t is not None and at <= t and (not keyed or (g == h and g is not None))]
            best = max(before, default=(None, None))
            want[i] = best if best[0] is None or most is None or t - best[0] <= most else (None, None)
        assert got == want
    assert intervals.as_of(df, es.limit(0), F.col("t"), "at", by).filter("e IS NOT NULL").count() == 0
    assert intervals.as_of(df.limit(0), es, F.col("t"), "at", by).count() == 0


def test_profiles(spark):
    profile = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (4.0, 0.0), (4.5, 2.0)], "x double, y double")
    points = spark.createDataFrame([(k, x) for k, x in enumerate([-0.1, 0.0, 0.25, 1.0, 2.5, 4.4999, 4.5, 9.0, None])], "k int, p double")
    want = {1: 1.0, 2: 1.5, 3: 3.0, 4: 1.5, 5: 1.9996}
    assert {r.k: r.y for r in lookup.forward(points, lookup.segments(profile), F.col("p")).collect()} == pytest.approx(want)
    along = {r.k: r.y for r in lookup.along(points, profile, F.col("p")).collect()}
    assert len(along) == 9 and {k: y for k, y in along.items() if y is not None} == pytest.approx(want)
    with pytest.raises(Exception, match="outside the profile"):
        lookup.forward(points, lookup.segments(profile), F.col("p"), strict=True).collect()
    assert lookup.forward(points.filter("k BETWEEN 1 AND 5"), lookup.segments(profile), F.col("p"), strict=True).count() == 5
    roots = lookup.inverse(spark.createDataFrame([(1.5,), (5.0,)], "level double"), lookup.segments(profile), F.col("level"))
    assert sorted(r.x for r in roots.collect()) == pytest.approx([0.25, 2.5, 4.375])


def test_queries_of_intervals_have_no_nested_loops(spark):
    from tessella.plans import queries

    for name in ("interp_forward", "interp_inverse", "interp_along", "interp_forward_orders", "interp_inverse_parts", "rect_locate", "rect_locate_lines", "manual_groups", "rect_overlap", "rect_overlap_parts", "lowest_top_in_circle", "last_click"):
        no_loops(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_exponents_fit(spark):
    lengths = [1e-300, 3e-7, 0.5, 1.0, 1.5, 1e300]
    out = spark.createDataFrame([(v,) for v in lengths], "v double").select(intervals._exponent(F.lit(0.0), F.col("v")).alias("k"), "v").collect()
    for r in out:
        assert r.v <= 2.0**r.k * (1 + 1e-9) and (2.0 ** (r.k - 1) < r.v * (1 + 1e-9) or r.k == -999 or math.isclose(2.0**r.k, r.v * 2))
