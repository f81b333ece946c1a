"""Sections of cells, and counts by efficiencies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import physics
from tessella.functions.axis import Axis
from tessella.sources import sinks

AXES = Axis("x", 4, 0.0, 8.0), Axis("y", 3, 0.0, 3.0), Axis("z", 5, 10.0, 20.0)


def test_sections(spark, tmp_path):
    cells = spark.createDataFrame([(i, j, k, (i + j + k) % 3 > 0, 100.0 * k + 10 * j + i, i) for i in range(4) for j in range(3) for k in range(5)], "ix int, iy int, iz int, tf_exist boolean, density double, n_hit int")
    levels = [9.0, 12.0, 13.9, 19.5, 20.0]
    told = lambda **o: {(r.iz, r.level, r.x, r.y): r.value for r in sinks.sections(cells, *AXES, levels, **o).collect()}
    every = {(k, level, 2 * i + 1.0, j + 0.5): (i, j, k) for k, level in ((1, 12.0), (4, 19.5)) for i in range(4) for j in range(3)}
    on = lambda c: sum(c) % 3 > 0
    value = lambda c: 100.0 * c[2] + 10 * c[1] + c[0]
    assert told() == {k: value(c) for k, c in every.items() if on(c)}
    assert told(only_existing=False, filler=-1.0) == {k: value(c) if on(c) else -1.0 for k, c in every.items()}
    assert told(least_hits=2) == {k: value(c) for k, c in every.items() if on(c) and c[0] >= 2}
    assert told(mask=True) == {k: float(on(c)) for k, c in every.items()}
    assert sinks.sections(cells, *AXES, [1.0]).count() == 0
    sinks.write_section_list(sinks.sections(cells, *AXES, levels, mask=True), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 24 and sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["iz=1", "iz=4"]


def test_counts_by_efficiency(spark):
    bins = spark.range(4000).select("id", F.lit(200.0).alias("n"), F.lit(0.8).alias("lo"), F.lit(0.9).alias("mid"), F.lit(0.95).alias("hi"))
    args = [F.col(c) for c in ("n", "lo", "mid", "hi")]
    one = lambda *a, **k: [r[0] for r in bins.select(physics.seen(*a, **k)).collect()]
    assert set(one(*args)) == {200.0} and one(*args, by_central=True, by_draw=True) == [pytest.approx(180.0)] * 4000
    drawn = np.array(one(*args, by_draw=True, key=(F.col("id"),))) / 200
    # a third of the draws lie above the middle, as wide as its side
    assert np.mean(drawn > 0.9) == pytest.approx(1 / 3, abs=0.03)
    assert np.sqrt(np.mean((drawn[drawn < 0.9] - 0.9) ** 2)) == pytest.approx(0.1, rel=0.05) and np.sqrt(np.mean((drawn[drawn > 0.9] - 0.9) ** 2)) == pytest.approx(0.05, rel=0.07)
    assert set(one(F.lit(10.0), F.lit(0.5), F.lit(0.5), F.lit(0.5), by_draw=True, key=(F.col("id"),))) == {5.0}
