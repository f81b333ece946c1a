"""Look-ups in tables of nodes, and rectangles that hold points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.axis import Axis
from tessella.functions.physics import bilinear
from tessella.operators.intervals import as_of, bounded, held, meeting
from tessella.operators.windows import stored

def widened(nodes: DataFrame, value: str = "z") -> DataFrame:
    """Each node with its three neighbours up: one join then serves an interpolation."""
    row = Window.partitionBy("iy").orderBy("ix").rangeBetween(1, 1)
    right = nodes.withColumn("z10", F.first(value).over(row))
    column = Window.partitionBy("ix").orderBy("iy").rangeBetween(1, 1)
    return right.withColumn("z01", F.first(value).over(column)).withColumn("z11", F.first("z10").over(column)).withColumnRenamed(value, "z00")


def interpolated(points: DataFrame, wide: DataFrame, x: Axis, y: Axis, xs: Column, ys: Column) -> DataFrame:
    """points with z by bilinear interpolation; outside, or in an empty cell, it is null."""
    placed = points.withColumns({"ix": x.index(xs), "iy": y.index(ys)})
    fx = (xs - x.lower(F.col("ix"))) / x.interval
    fy = (ys - y.lower(F.col("iy"))) / y.interval
    out = placed.join(bounded(wide.select("ix", "iy", "z00", "z10", "z01", "z11")), ["ix", "iy"], "left")
    return out.withColumn("z", bilinear(fx, fy, F.col("z00"), F.col("z10"), F.col("z01"), F.col("z11"))).drop("z00", "z10", "z01", "z11")


def segments(profile: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A profile's (x, y) pieces between neighbours."""
    w = Window.partitionBy(*(by or [])).orderBy("x")
    return profile.select(*(by or []), F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), F.col("y").alias("y0"), F.lead("y").over(w).alias("y1")).filter("x1 IS NOT NULL")


def forward(points: DataFrame, pieces: DataFrame, at: Column, strict: bool = False) -> DataFrame:
    """points with y on the piece that holds x; a point outside is dropped, or an error if strict."""
    placed = points.withColumn("__x", at)
    if strict:
        span = pieces.agg(F.min("x0").alias("__low"), F.max("x1").alias("__high"))
        inside = (F.col("__x") >= span.select("__low").scalar()) & (F.col("__x") < span.select("__high").scalar())
        placed = placed.withColumn("__x", F.when(F.coalesce(inside, F.lit(False)), F.col("__x")).otherwise(F.raise_error(F.lit("a place outside the profile")).cast("double")))
    out = held(placed, pieces, [(F.col("__x"), "x0", "x1")])
    return out.withColumn("y", F.col("y0") + (F.col("__x") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).drop("__x", "x0", "x1", "y0", "y1")


def along(points: DataFrame, profile: DataFrame, at: Column, by: list[str] | None = None) -> DataFrame:
    """points with y by linear interpolation in the profile (by, x, y); null outside. Both are sorted together, as for very long profiles."""
    pieces = segments(profile, by).withColumnRenamed("x0", "__x0")
    out = as_of(points.withColumn("__x", at), pieces, F.col("__x"), "__x0", by)
    y = F.col("y0") + (F.col("__x") - F.col("__x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("__x0"))
    return out.withColumn("y", F.when(F.col("__x") < F.col("x1"), y)).drop("__x", "__x0", "x1", "y0", "y1")


def inverse(points: DataFrame, pieces: DataFrame, level: Column) -> DataFrame:
    """points with every x at which the profile has the level: one row for each."""
    sides = pieces.withColumns({"__low": F.least("y0", "y1").cast("double"), "__high": F.greatest("y0", "y1").cast("double")})
    out = held(points.withColumn("__y", level), sides, [(F.col("__y"), "__low", "__high")])
    return out.withColumn("x", F.col("x0") + (F.col("__y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).drop("__y", "__low", "__high", "x0", "x1", "y0", "y1")


def first_rectangle_of_all(points: DataFrame, rectangles: DataFrame, x: Column, y: Column, key: list[str]) -> DataFrame:
    """key, rect_id and excluded of the first rectangle that holds each point, excluded ones too.

    rectangles: rect_id, excluded, xlow, xup, ylow, yup, half-open.
    """
    # of rectangles that are equal, only the first can be a point's first
    ends = ["xlow", "xup", "ylow", "yup"]
    firsts = rectangles.filter("rect_id IS NOT NULL").groupBy(*ends).agg(F.min(F.struct("rect_id", "excluded")).alias("__r")).select(*ends, "__r.*")
    hit = held(points, firsts, [(x, "xlow", "xup"), (y, "ylow", "yup")])
    # minima of numbers are kept in a hash table, those of structs would be sorted first
    first = lambda when: F.min(F.when(when, F.col("rect_id")))
    found = hit.groupBy(*key).agg(F.min("rect_id").alias("rect_id"), first(F.col("excluded").isNull()).alias("__null"), first(~F.col("excluded")).alias("__free"))
    excluded = F.when(F.col("__null") == F.col("rect_id"), F.lit(None).cast("boolean")).otherwise(~F.coalesce(F.col("__free") == F.col("rect_id"), F.lit(False)))
    return found.select(*key, "rect_id", excluded.alias("excluded"))


def first_rectangle(points: DataFrame, rectangles: DataFrame, x: Column, y: Column, key: list[str]) -> DataFrame:
    """key and the smallest rect_id that holds the point; if that one is excluded the point is dropped."""
    return first_rectangle_of_all(points, rectangles, x, y, key).filter("NOT excluded").drop("excluded")


def overlaps(rectangles: DataFrame) -> DataFrame:
    """Pairs of rectangles that share some area, with its size, or an edge (area 0).

    Equal rectangles are compared once; the pairs of those that meet are then spelt out, as rows of two joins, in no group or task whole.
    """
    ends = ["xlow", "xup", "ylow", "yup"]
    known = rectangles.filter("rect_id IS NOT NULL").select("rect_id", *ends)
    shapes = stored(known.groupBy(*ends).agg(F.min("rect_id").alias("rect_id")), "shapes")
    members = stored(known.join(shapes.select(*[F.col(c).alias(f"__{c}") for c in ends], F.col("rect_id").alias("__of")), [F.col(c) == F.col(f"__{c}") for c in ends]).select("__of", "rect_id"), "members")
    dx = F.least("one.xup", "other.xup") - F.greatest("one.xlow", "other.xlow")
    dy = F.least("one.yup", "other.yup") - F.greatest("one.ylow", "other.ylow")
    met = meeting(shapes, "rect_id").filter((dx > 0) | (dy > 0)).select(F.col("one.rect_id").alias("__a"), F.col("other.rect_id").alias("__b"), (dx * dy).alias("area"))
    width, height = F.col("xup") - F.col("xlow"), F.col("yup") - F.col("ylow")
    own = shapes.filter((width >= 0) & (height >= 0) & ((width > 0) | (height > 0))).select(F.col("rect_id").alias("__a"), F.col("rect_id").alias("__b"), (width * height).alias("area"))
    side = lambda of, name: members.select(F.col("__of").alias(of), F.col("rect_id").alias(name)).hint("merge")
    pairs = met.unionByName(own).join(side("__a", "__one"), "__a").join(side("__b", "__other"), "__b")
    pairs = pairs.filter((F.col("__one") < F.col("__other")) | ((F.col("__one") > F.col("__other")) & (F.col("__a") != F.col("__b"))))
    return pairs.select(F.least("__one", "__other").alias("one"), F.greatest("__one", "__other").alias("other"), "area")


def subtract(one: tuple[float, float, float, float], other: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
    """one (xlow, xup, ylow, yup) less other, as up to four rectangles."""
    x0, x1, y0, y1 = one
    a0, a1, b0, b1 = max(x0, other[0]), min(x1, other[1]), max(y0, other[2]), min(y1, other[3])
    if a0 >= a1 or b0 >= b1:
        return [one]
    return [r for r in ((x0, a0, y0, y1), (a1, x1, y0, y1), (a0, a1, y0, b0), (a0, a1, b1, y1)) if r[0] < r[1] and r[2] < r[3]]


def disjoint(rectangles: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """The same area without overlaps: of every rectangle, what those before it leave. A run has some hundred at most."""
    out: list[tuple[float, float, float, float]] = []
    for rectangle in rectangles:
        left = [rectangle]
        for other in out:
            left = [piece for r in left for piece in subtract(r, other)]
        out += left
    return out
