"""Running sums, differences, islands and dense numbers over ordered cells."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filled(cells: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, ix, iy and value of every cell from 0 to the largest indices; the value is 0 where there was none."""
    bounds = cells.groupBy(*by).agg(F.max("ix").alias("__x"), F.max("iy").alias("__y")).filter("__x IS NOT NULL")
    every = bounds.select(*by, F.explode(F.sequence(F.lit(0), F.col("__x").cast("int"))).alias("ix"), "__y").select(*by, "ix", F.explode(F.sequence(F.lit(0), F.col("__y").cast("int"))).alias("iy"))
    kinds = {c: cells.schema[c].dataType for c in ("ix", "iy", value)}
    every = every.withColumns({c: F.col(c).cast(kinds[c]) for c in ("ix", "iy")})
    return every.join(cells.select(*by, "ix", "iy", value), [*by, "ix", "iy"], "left").withColumn(value, F.coalesce(value, F.lit(0).cast(kinds[value])))


def prefix_sums(cells: DataFrame, value: str, by: list[str] | None = None, full: bool = False) -> DataFrame:
    """s, the sum over all cells of both indices up to a cell's: two stacked running sums over a full grid.

    full: whether all cells are there; their other columns then stay. If not, missing ones count as 0 and are added.
    """
    by = by or []
    cells = cells if full else filled(cells, value, by)
    along = F.sum(value).over(Window.partitionBy(*by, "iy").orderBy("ix"))
    up = F.sum("__row").over(Window.partitionBy(*by, "ix").orderBy("iy"))
    return cells.withColumn("__row", along).withColumn("s", up).drop("__row")


def rectangle_sums(sums: DataFrame, rectangles: DataFrame) -> DataFrame:
    """rectangles (rect_id, x0, x1, y0, y1, half-open) with total: four look-ups of a full grid of prefix sums."""
    out = rectangles
    for i, (a, b) in enumerate((("x1", "y1"), ("x0", "y1"), ("x1", "y0"), ("x0", "y0"))):
        at = sums.select((F.col("ix") + 1).alias(f"__x{i}"), (F.col("iy") + 1).alias(f"__y{i}"), F.col("s").alias(f"__s{i}"))
        out = out.join(at, (out[a] == at[f"__x{i}"]) & (out[b] == at[f"__y{i}"]), "left").drop(f"__x{i}", f"__y{i}")
    s = [F.coalesce(F.col(f"__s{i}"), F.lit(0)) for i in range(4)]
    return out.withColumn("total", s[0] - s[1] - s[2] + s[3]).drop(*[f"__s{i}" for i in range(4)])


def finite_difference(cells: DataFrame, value: str, along: str, by: list[str], step: Column | float = 1.0) -> DataFrame:
    """Forward differences; the last row of a line has that of the one before."""
    w = Window.partitionBy(*by).orderBy(along)
    ahead = F.lead(value).over(w) - F.col(value)
    back = F.col(value) - F.lag(value).over(w)
    return cells.withColumn("derivative", F.coalesce(ahead, back) / step)


def islands(rows: DataFrame, inside: Column, by: list[str], order: list[str]) -> DataFrame:
    """Runs of consecutive rows that are inside: by, island, n and the first and last order key."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("__in", inside).withColumn("__starts", (F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False))).cast("int"))
    numbered = marked.withColumn("island", F.sum("__starts").over(w)).filter("__in")
    return numbered.groupBy(*by, "island").agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def transitions(cells: DataFrame, inside: Column, near: float = 1e-9) -> DataFrame:
    """ray_id and changes: distances at which a ray enters (tf_in) and leaves what is inside, in order and in turn.

    cells: ray_id and the stretch (t0, t1) of every cell that a ray crosses. A ray leaves where the next cell isn't inside, doesn't follow
    on, or is missing.
    """
    w = Window.partitionBy("ray_id").orderBy("t0")
    marked = cells.withColumn("__in", inside).withColumns({"__on": F.coalesce(F.lag("__in").over(w) & (F.abs(F.lag("t1").over(w) - F.col("t0")) <= near), F.lit(False)), "__goes": F.coalesce(F.lead("__in").over(w) & (F.abs(F.lead("t0").over(w) - F.col("t1")) <= near), F.lit(False))}).filter("__in")
    change = lambda tf, t: F.struct(F.col(t).alias("dist"), F.lit(tf).alias("tf_in"))
    both = F.concat(F.when(~F.col("__on"), F.array(change(True, "t0"))).otherwise(F.array()), F.when(~F.col("__goes"), F.array(change(False, "t1"))).otherwise(F.array()))
    found = marked.select("ray_id", F.explode(both).alias("c"))
    # a ray that leaves and enters at one distance leaves first
    return found.groupBy("ray_id").agg(F.array_sort(F.collect_list("c")).alias("changes"))


def trapezoid(rows: DataFrame, x: Column, y: Column, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    piece = (x - F.lag(x).over(w)) * (y + F.lag(y).over(w)) / 2
    return rows.withColumn("__piece", piece).groupBy(*by).agg(F.coalesce(F.sum("__piece"), F.lit(0.0)).alias("integral"))


def sign_flips(rows: DataFrame, value: Column, by: list[str], order: list[str]) -> DataFrame:
    """Of each line: points, those that aren't finite, the share of positive ones, and sign changes by points less one.

    A change is between a value and the last one before it that is neither 0 nor infinite nor missing.
    """
    sound = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    signed = rows.withColumn("__s", F.when(sound & (value != 0), F.signum(value)))
    before = F.last("__s", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    flips = signed.withColumn("__f", F.when(before != F.col("__s"), 1).otherwise(0)).withColumn("__ok", sound)
    out = flips.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("__ok"), 1)).alias("broken"), F.count(F.when(F.col("__s") > 0, 1)).alias("__p"), F.sum("__f").alias("__f"))
    return out.select(*by, "n", "broken", (F.col("__p") / F.col("n")).alias("positive"), F.coalesce(F.try_divide(F.col("__f"), F.col("n") - 1), F.lit(0.0)).alias("flips"))


def uniform(rows: DataFrame, value: str, by: list[str], tolerance: float) -> DataFrame:
    """Whether each line's sorted values ascend strictly and by even steps."""
    steps = rows.withColumn("__d", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(value)))
    return steps.groupBy(*by).agg((F.min("__d") > 0).alias("ascends"), (F.max("__d") - F.min("__d") <= tolerance).alias("uniform"))


def contiguous(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.max(value) - F.min(value) + 1 == F.countDistinct(value)).alias("contiguous"))


def shared_folder(spark) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and one machine does everything."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (where or "file:///tmp/checkpoints/tessella").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that are grouped or joined in one task.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, keys: list[str], most: int = TASK_ROWS) -> DataFrame:
    """rows by hashes of the keys in as many partitions as leave each about `most`; as they are where spark.sql.shuffle.partitions do.

    For tables that are grouped and then joined by the same keys: a task's memory doesn't grow with the table. rows are counted, which files answer cheaply.
    """
    n = -(-rows.count() // most)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) else rows


def dense_numbers(rows: DataFrame, keys: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """rows with a number from 0 without gaps, in the order of the keys (which identify rows).

    Rows are sorted by range and numbered within it; only the ranges' sizes are added up in one place.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = stored(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "numbers")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    out = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")  # as many rows as partitions
    return out.withColumn(name, (F.col("__start") + place).cast("long")).drop("__part", "__start", "__at")
