"""What rectangles cover together: whether they tile their box, where they leave gaps or overlap, and the same area without overlaps.

No two rectangles are compared. Whether they tile is seen from their corners: with a sign for each corner, all cancel out but the four of the box. Where
they don't, the plane is cut into tiles until each has few edges: a rectangle that fills a tile is only counted there, and rectangles that look alike in a tile are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.windows import stored

#: Different edges inside a tile, on each axis, beyond which it is cut.
EDGES = 12
#: Parts of the box's sides that corners are rounded to.
FINE = 1e9


def _sound(rectangles: DataFrame) -> DataFrame:
    """Rectangles as doubles; without sides, or with an end missing, they cover nothing."""
    return rectangles.select("rect_id", *[F.col(c).cast("double") for c in ("xlow", "xup", "ylow", "yup")]).filter("xlow < xup AND ylow < yup")


def tiling(rectangles: DataFrame) -> DataFrame:
    """One row: n, xmin, xmax, ymin, ymax of the box, area (of the rectangles, one by one), box (its area) and tiled, whether each place in it is covered once.

    rectangles: rect_id, xlow, xup, ylow, yup. Ends that differ by less than FINE-ths of the box are the same. Exclusions count as rectangles.
    """
    r = stored(_sound(rectangles), "rectangles")
    box = r.agg(F.count(F.lit(1)).alias("n"), F.min("xlow").alias("xmin"), F.max("xup").alias("xmax"), F.min("ylow").alias("ymin"), F.max("yup").alias("ymax"), F.sum((F.col("xup") - F.col("xlow")) * (F.col("yup") - F.col("ylow"))).alias("area"))
    box = stored(box.withColumn("box", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))), "box")
    edge = lambda c, k: F.round((F.col(c) - box.select(f"{k}min").scalar()) / (box.select(f"{k}max").scalar() - box.select(f"{k}min").scalar()) * FINE).cast("long")
    sides = r.select(*[edge(f"{k}{e}", k).alias(f"{k}{e}") for k in "xy" for e in ("low", "up")])
    corners = [F.struct(F.col(f"x{a}").alias("x"), F.col(f"y{b}").alias("y"), F.lit(1 if a == b else -1).alias("sign")) for a in ("low", "up") for b in ("low", "up")]
    left = sides.select(F.explode(F.array(*corners)).alias("c")).groupBy("c.x", "c.y").agg(F.sum("c.sign").alias("s")).filter("s <> 0")
    whole = F.col("x").isin(0, int(FINE)) & F.col("y").isin(0, int(FINE)) & (F.col("s") == F.when(F.col("x") == F.col("y"), 1).otherwise(-1))
    found = left.agg(F.count(F.lit(1)).alias("m"), F.count(F.when(~whole, 1)).alias("wrong"))
    return box.withColumn("tiled", F.coalesce((found.select("m").scalar() == 4) & (found.select("wrong").scalar() == 0), F.lit(False)))


def cover(rectangles: DataFrame, edges: int = EDGES) -> DataFrame:
    """xlow, xup, ylow, yup, n and first: pieces that fill the rectangles' box, each with how many rectangles cover it and the smallest rect_id of these (null without any).

    rectangles: rect_id, xlow, xup, ylow, yup. There are as many rounds as a tile is cut, in the middle of its edges, which grows with the logarithm of the rectangles.
    """
    r = _sound(rectangles)
    x, y = ("x0", "x1"), ("y0", "y1")
    pieces = stored(r.select(F.lit("").alias("tile"), F.col("xlow").alias("x0"), F.col("xup").alias("x1"), F.col("ylow").alias("y0"), F.col("yup").alias("y1"), F.lit(1).cast("long").alias("n"), F.col("rect_id").alias("first")), "pieces")
    kind = pieces.schema["first"].dataType
    tiles = pieces.groupBy("tile").agg(F.min("x0").alias("tx0"), F.max("x1").alias("tx1"), F.min("y0").alias("ty0"), F.max("y1").alias("ty1"))
    tiles = tiles.withColumns({"base": F.lit(0).cast("long"), "lowest": F.lit(None).cast(kind)})
    done = []
    while True:
        # pieces that are alike in a tile are one, and those that fill it are only counted
        alike = pieces.groupBy("tile", *x, *y).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        placed = alike.join(tiles, "tile").withColumn("__fills", (F.col("x0") == F.col("tx0")) & (F.col("x1") == F.col("tx1")) & (F.col("y0") == F.col("ty0")) & (F.col("y1") == F.col("ty1")))
        placed = stored(placed, "placed")
        ends = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(f"{k}{i}").alias("e"), F.col(f"t{k}0").alias("a"), F.col(f"t{k}1").alias("b")) for k in "xy" for i in (0, 1)])).alias("__e")
        edges_ = placed.filter("NOT __fills").select("tile", ends).select("tile", "__e.*").filter("e > a AND e < b")
        on = lambda k: F.when(F.col("axis") == k, F.col("e"))
        busy = edges_.groupBy("tile").agg(*[f for k in "xy" for f in (F.countDistinct(on(k)).alias(f"n{k}"), F.percentile_approx(on(k), 0.5, 1000).alias(f"m{k}"))])
        filled = placed.filter("__fills").groupBy("tile").agg(F.sum("n").alias("__n"), F.min("first").alias("__first"))
        known = tiles.join(filled, "tile", "left").join(busy, "tile", "left")
        known = known.withColumns({"base": F.col("base") + F.coalesce("__n", F.lit(0)), "lowest": F.least("lowest", "__first"), "nx": F.coalesce("nx", F.lit(0)), "ny": F.coalesce("ny", F.lit(0))})
        known = stored(known.drop("__n", "__first"), "tiles")
        rest = placed.filter("NOT __fills").select("tile", *x, *y, "n", "first")
        done.append((known.filter(f"nx <= {edges} AND ny <= {edges}"), rest))
        open_ = known.filter(f"nx > {edges} OR ny > {edges}")
        if open_.isEmpty():
            break
        # cut in the middle of the edges, on each axis that has any
        spans = [F.when(F.col(f"n{k}") > 0, F.array(F.struct(F.lit("0").alias("q"), F.col(f"t{k}0").alias("a"), F.col(f"m{k}").alias("b")), F.struct(F.lit("1").alias("q"), F.col(f"m{k}").alias("a"), F.col(f"t{k}1").alias("b")))).otherwise(F.array(F.struct(F.lit("0").alias("q"), F.col(f"t{k}0").alias("a"), F.col(f"t{k}1").alias("b")))) for k in "xy"]
        cut = open_.withColumn("__x", F.explode(spans[0])).withColumn("__y", F.explode(spans[1]))
        cut = cut.select("tile", F.concat("tile", "__x.q", "__y.q").alias("part"), F.col("__x.a").alias("tx0"), F.col("__x.b").alias("tx1"), F.col("__y.a").alias("ty0"), F.col("__y.b").alias("ty1"), "base", "lowest")
        cut = stored(cut, "cut")
        met = rest.join(cut.drop("base", "lowest"), "tile").filter("x0 < tx1 AND x1 > tx0 AND y0 < ty1 AND y1 > ty0")
        ends = {f"{k}{i}": f(f"{k}{i}", f"t{k}{i}") for k in "xy" for i, f in ((0, F.greatest), (1, F.least))}
        pieces = stored(met.select(F.col("part").alias("tile"), *[e.alias(n) for n, e in ends.items()], "n", "first"), "pieces")
        tiles = cut.drop("tile").withColumnRenamed("part", "tile")
    out = None
    for known, rest in done:
        one = _cells(known, rest)
        out = one if out is None else out.unionByName(one)
    return out


def _cells(tiles: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pieces of tiles with few edges, by these edges; what is alike along y is one."""
    own = pieces.join(tiles.select("tile"), "tile", "left_semi")
    lines = own.groupBy("tile").agg(*[F.array_union(F.collect_set(f"{k}0"), F.collect_set(f"{k}1")).alias(f"__{k}") for k in "xy"])
    at = tiles.join(lines, "tile", "left")
    at = at.select("tile", "base", "lowest", *[F.array_sort(F.array_distinct(F.concat(F.array(f"t{k}0", f"t{k}1"), F.coalesce(F.col(f"__{k}"), F.array().cast("array<double>"))))).alias(k) for k in "xy"])
    at = stored(at, "edges")
    place = lambda k, e: F.array_position(F.col(k), F.col(f"{k}{e}")).cast("int")
    met = own.join(at.select("tile", "x", "y"), "tile")
    met = met.select("tile", "n", "first", F.explode(F.sequence(place("x", 0), place("x", 1) - 1)).alias("i"), place("y", 0).alias("__a"), place("y", 1).alias("__b"))
    met = met.select("tile", "n", "first", "i", F.explode(F.sequence(F.col("__a"), F.col("__b") - 1)).alias("j"))
    held = met.groupBy("tile", "i", "j").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    every = at.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("x") - 1))).withColumn("j", F.explode(F.sequence(F.lit(1), F.size("y") - 1)))
    cells = every.join(held, ["tile", "i", "j"], "left")
    end = lambda k, c, more: F.element_at(k, F.col(c) + more)
    cells = cells.select("tile", "i", "j", end("x", "i", 0).alias("xlow"), end("x", "i", 1).alias("xup"), end("y", "j", 0).alias("ylow"), end("y", "j", 1).alias("yup"), (F.col("base") + F.coalesce("n", F.lit(0))).alias("n"), F.least("lowest", "first").alias("first"))
    up = Window.partitionBy("tile", "i").orderBy("j")
    starts = F.coalesce((F.lag("n").over(up) == F.col("n")) & F.lag("first").over(up).eqNullSafe(F.col("first")), F.lit(False))
    runs = cells.withColumn("__new", (~starts).cast("int")).withColumn("__run", F.sum("__new").over(up))
    return runs.groupBy("tile", "i", "__run").agg(F.first("xlow").alias("xlow"), F.first("xup").alias("xup"), F.min("ylow").alias("ylow"), F.max("yup").alias("yup"), F.first("n").alias("n"), F.first("first").alias("first")).drop("tile", "i", "__run")


def disjoint(rectangles: DataFrame) -> DataFrame:
    """rect_id, xlow, xup, ylow, yup: of every rectangle what those with smaller ids leave, in pieces without overlaps."""
    return cover(rectangles).filter("n > 0").select(F.col("first").alias("rect_id"), "xlow", "xup", "ylow", "yup")


def checked_tiling(rectangles: DataFrame) -> DataFrame:
    """tiling, or an error if there is a gap or an overlap."""
    out = tiling(rectangles)
    return out.withColumn("tiled", F.when(F.col("tiled"), True).otherwise(F.raise_error(F.concat(F.lit("rectangles that don't tile their box: area "), F.col("area").cast("string"), F.lit(" of "), F.col("box").cast("string"))).cast("boolean")))
