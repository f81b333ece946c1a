"""The generated case of the tutorial's size, as far as paths."""

from pyspark.sql import functions as F

from tessella.plans import tutorial
from tessella.plans.reconstruction import elements


def test_scene(spark):
    pillars, panels, axes = tutorial.scene(spark)
    assert elements(panels).count() == 11 * 320 * 160 and [a.nbin for a in axes] == [41, 41, 13]
    top = pillars.agg(F.max("zmax"), F.count(F.lit(1))).first()
    assert 110 < top[0] <= 120 and top[1] > 1000
