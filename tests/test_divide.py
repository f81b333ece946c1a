"""Division by rounds of rectangles against the queue of one panel."""

import numpy as np
import pytest

from tessella.operators import groups


@pytest.mark.parametrize("prefer_x, least, loops", [(True, (1, 1), 100_000), (False, (2, 3), 7)])
def test_rounds_are_the_queue(spark, prefer_x, least, loops):
    """Ten panels of other shapes, with ties, empty stretches and one cell that holds nearly all."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for panel in range(10):
        shape = (rng.integers(1, 24), rng.integers(1, 24)) if panel else (1, 1)
        cells = rng.integers(0, 5, shape).astype(float) if panel % 3 else np.exp(rng.normal(0, 2, shape))
        cells[rng.random(shape) < 0.2] = 0
        if panel == 4:
            cells[shape[0] // 2, shape[1] // 2] = 1e4
        trigger = 12.0
        for g, (a, b, c, d) in enumerate(groups.divide(cells, [(0, shape[0] - 1, 0, shape[1] - 1)], trigger, *least, prefer_x, loops)):
            want.update({(panel, i, j): g for i in range(a, b + 1) for j in range(c, d + 1)})
        rows += [(panel, int(i), int(j), float(cells[i, j])) for i in range(shape[0]) for j in range(shape[1])]
    bins = spark.createDataFrame(rows, "panel int, ix int, iy int, weight double").repartition(4)
    got = {(r.panel, r.ix, r.iy): r.igroup for r in groups.divided_by_rounds(bins, "panel", trigger, *least, prefer_x, loops).collect()}
    assert got == want


def test_missing_bins_and_empty_tables(spark):
    bins = spark.createDataFrame([(1, 0, 0, 5.0), (1, 3, 2, 9.0), (1, 3, 2, 1.0)], "panel int, ix int, iy int, weight double")
    one, other = (sorted(tuple(r) for r in f(bins, "panel", 8.0).collect()) for f in (groups.divided_by_rounds, groups.auto_divided))
    assert one == other and len(one) == 3
    assert groups.divided_by_rounds(bins.limit(0), "panel", 8.0).count() == 0
