"""Covers of rectangles against a grid of all their edges."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import cover, lookup

RECTANGLES = "rect_id int, xlow double, xup double, ylow double, yup double"


def plain(rects):
    """(x, y) cell of all edges -> area, count and smallest id."""
    xs, ys = (sorted({r[k] for r in rects} | {r[k + 1] for r in rects}) for k in (1, 3))
    out = {}
    for a, b in zip(xs, xs[1:]):
        for c, d in zip(ys, ys[1:]):
            on = [r[0] for r in rects if r[1] <= a and b <= r[2] and r[3] <= c and d <= r[4]]
            out[a, b, c, d] = (len(on), min(on, default=None))
    return out


def matched(got, rects):
    """Pieces are apart, fill the box and say what holds in each cell that they touch."""
    cells = plain(rects)
    area = lambda a, b, c, d: (b - a) * (d - c)
    covered = {k: 0.0 for k in cells}
    for g in got:
        for k, v in cells.items():
            w, h = min(g.xup, k[1]) - max(g.xlow, k[0]), min(g.yup, k[3]) - max(g.ylow, k[2])
            if w > 1e-12 and h > 1e-12:
                assert (g.n, g.first) == v
                covered[k] += w * h
    assert all(covered[k] == pytest.approx(area(*k), rel=1e-9) for k in cells)


@pytest.mark.parametrize("edges, n", [(1, 12), (4, 40)])
def test_cover_against_plain(spark, edges, n):
    rng = random.Random(edges)
    rects = []
    for k in range(n):
        x, y = rng.choice([0.0, 1.0, rng.uniform(0, 8)]), rng.choice([0.0, 2.5, rng.uniform(0, 8)])
        rects.append((k, x, x + rng.choice([1.0, 3.0, 9.0]), y, y + rng.choice([0.5, 2.0, 9.0])))
    rects += [(n + k, 0.0, 20.0, 0.0, 20.0) for k in range(2)] + [(n + 5 + k, 3.0, 4.0, 3.0, 4.0) for k in range(50)]
    odd = [(900, 1.0, 1.0, 0.0, 5.0), (901, None, 2.0, 0.0, 1.0), (902, 5.0, 4.0, 0.0, 1.0)]
    got = cover.cover(spark.createDataFrame(rects + odd, RECTANGLES), edges).collect()
    matched(got, rects)


def test_disjoint_is_the_list_by_turns(spark):
    rng = random.Random(8)
    rects = [(k, x, x + 3, y, y + 2) for k in range(30) for x, y in [(float(rng.randint(0, 9)), float(rng.randint(0, 9)))]]
    got = cover.disjoint(spark.createDataFrame(rects, RECTANGLES)).collect()
    want = lookup.disjoint([r[1:] for r in rects])
    size = lambda rs: sum((b - a) * (d - c) for a, b, c, d in rs)
    assert size([(r.xlow, r.xup, r.ylow, r.yup) for r in got]) == pytest.approx(size(want))
    assert cover.cover(spark.createDataFrame([tuple(r) for r in got], "rect_id int, xlow double, xup double, ylow double, yup double")).filter("n > 1").count() == 0


def grid(n, m, step=0.1):
    return [(i * m + j, i * step, (i + 1) * step, j * step, (j + 1) * step) for i in range(n) for j in range(m)]


def test_tilings(spark):
    told = lambda rects: cover.tiling(spark.createDataFrame(rects, RECTANGLES)).first()
    # sides that are no multiples of 0.1 as doubles meet all the same
    assert told(grid(16, 8)).tiled and told([(0, 0.0, 2.0, 0.0, 1.0), (1, 0.0, 1.0, 1.0, 2.0), (2, 1.0, 2.0, 1.0, 2.0)]).tiled
    gap, twice = grid(16, 8)[:-30] + grid(16, 8)[-29:], [*grid(16, 8), (999, 0.2, 0.3, 0.2, 0.3)]
    # a gap and an overlap of one size: the area alone would not tell
    both = [*gap, (999, 0.2, 0.3, 0.2, 0.3)]
    for rects in (gap, twice, both):
        r = told(rects)
        assert not r.tiled and r.n == len(rects) and r.box == pytest.approx(1.6 * 0.8)
        with pytest.raises(Exception, match="don't tile"):
            cover.checked_tiling(spark.createDataFrame(rects, RECTANGLES)).collect()
    assert told(both).area == pytest.approx(told(both).box)
    assert not told([(1, None, 1.0, 0.0, 1.0)]).tiled
    pieces = cover.cover(spark.createDataFrame(both, RECTANGLES))
    assert pieces.filter("n = 0").agg(F.sum((F.col("xup") - F.col("xlow")) * (F.col("yup") - F.col("ylow")))).first()[0] == pytest.approx(0.01)
    assert pieces.filter("n = 2").agg(F.sum((F.col("xup") - F.col("xlow")) * (F.col("yup") - F.col("ylow")))).first()[0] == pytest.approx(0.01)
