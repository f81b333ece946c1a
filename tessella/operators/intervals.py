"""Joins by intervals: points in pieces and rectangles, rectangles that meet, and the last event before a row. None is a join by a condition alone.

An interval is filed under the power of two that is next above its length, in one or two buckets of that width; a point looks in
one bucket of each width that occurs. So buckets fit short and long intervals alike, and what an equality on the bucket lets through is checked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.windows import stored

#: A table is broadcast only if Spark's own estimate, which is from above, has at most so many bytes; else Spark decides as it runs.
BROADCAST_BYTES = 64 << 20
#: Widths (in two dimensions pairs of widths) of buckets at most; where more occur, neighbours share one.
MOST_WIDTHS = 32
#: Stands for the width of what has no end.
ENDLESS = 2000


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most else df


def _exponent(low: Column, high: Column) -> Column:
    """Of the power of two above the length, though not below the precision of the ends."""
    length = F.greatest(high - low, F.abs(low) * 2.0**-50, F.abs(high) * 2.0**-50, F.lit(2.0**-1000))
    return F.when(length < float("inf"), F.ceil(F.log2(length)).cast("int")).otherwise(ENDLESS)


def _bucket(at: Column, exponent: Column) -> Column:
    return F.when(exponent >= 1000, F.lit(0).cast("long")).otherwise(F.floor(at / F.pow(F.lit(2.0), exponent)))


def _at_width(at: Column, exponent: int) -> Column:
    return F.lit(0).cast("long") if exponent >= 1000 else F.floor(at / F.lit(2.0**exponent))


def _filed(pieces: DataFrame, axes: list[tuple[str, str]]) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """pieces with an exponent `__k{i}` for each axis, and all that occur. Written, as it is read twice."""
    sound = pieces.filter(" AND ".join(f"{c} IS NOT NULL" for axis in axes for c in axis))
    low_high = [(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in axes]
    filed = stored(sound.withColumns({f"__k{i}": _exponent(a, b) for i, (a, b) in enumerate(low_high)}), "intervals")
    names = [f"__k{i}" for i in range(len(axes))]
    found = [tuple(r) for r in filed.select(*names).distinct().collect()]  # at most as many as there are exponents
    step, shared = 1, set(found)
    while len(shared) > MOST_WIDTHS and step < ENDLESS:
        step *= 2
        shared = {tuple(k if k >= 1000 else math.ceil(k / step) * step for k in ks) for ks in found}
    if step > 1:
        filed = filed.withColumns({n: F.when(F.col(n) >= 1000, F.col(n)).otherwise((F.ceil(F.col(n) / step) * step).cast("int")) for n in names})
    return filed, sorted(shared)


def _in_buckets(filed: DataFrame, axes: list[tuple[str, str]]) -> DataFrame:
    """A row for every bucket that an interval reaches: two at most on each axis."""
    for i, (low, high) in enumerate(axes):
        k = F.col(f"__k{i}")
        filed = filed.withColumn(f"__b{i}", F.explode(F.sequence(_bucket(F.col(low).cast("double"), k), _bucket(F.col(high).cast("double"), k))))
    return filed


def held(points: DataFrame, pieces: DataFrame, axes: list[tuple[Column, str, str]], by: list[str] | None = None) -> DataFrame:
    """points with every piece that holds them: on each axis (a point's place, names of a piece's ends) low <= place < high.

    by: columns of both sides that must be equal. A point in no piece, or without a place, is dropped; so are pieces without an end.
    """
    by, ends = by or [], [(low, high) for _, low, high in axes]
    filed, widths = _filed(pieces, ends)
    keys = [f"__{c}{i}" for i in range(len(axes)) for c in "kb"]
    looks = [F.struct(*[c for i, k in enumerate(ks) for c in (F.lit(k).alias(f"__k{i}"), _at_width(axes[i][0].cast("double"), k).alias(f"__b{i}"))]) for ks in widths]
    placed = points.withColumns({f"__p{i}": at for i, (at, *_) in enumerate(axes)})
    look = F.explode(F.array(*looks)) if looks else F.explode(F.array().cast(f"array<struct<{', '.join(f'__k{i}: int, __b{i}: bigint' for i in range(len(axes)))}>>"))
    asked = placed.withColumn("__look", look).select("*", *[F.col(f"__look.{k}") for k in keys]).drop("__look")
    met = asked.join(bounded(_in_buckets(filed, ends)), [*by, *keys])
    for i, (low, high) in enumerate(ends):
        met = met.filter((F.col(f"__p{i}") >= F.col(low)) & (F.col(f"__p{i}") < F.col(high)))
    return met.drop(*keys, *[f"__p{i}" for i in range(len(axes))])


def meeting(rectangles: DataFrame, key: str) -> DataFrame:
    """Pairs of rectangles (key, xlow, xup, ylow, yup) of which the closed ones have a point in common, as structs one and other; one has the smaller key.

    Two rectangles are compared in buckets as wide as the wider of them on each axis, so each also looks up wider ones than itself. A pair
    comes from the one bucket that holds the lower corner of what they share. Of two that are both smaller than a bucket none is compared there.
    """
    axes = [("xlow", "xup"), ("ylow", "yup")]
    filed, widths = _filed(rectangles.select(key, *[c for axis in axes for c in axis]), axes)
    wide = [sorted({ks[i] for ks in widths}) for i in range(2)]
    grown = filed
    for i, (low, high) in enumerate(axes):
        # at its own width and at all above
        steps = [F.when(F.lit(k) >= F.col(f"__k{i}"), F.struct(F.lit(k).alias("k"), (F.lit(k) == F.col(f"__k{i}")).alias("own"), _at_width(F.col(low).cast("double"), k).alias("a"), _at_width(F.col(high).cast("double"), k).alias("b"))) for k in wide[i]]
        if not steps:
            continue
        grown = grown.withColumn("__s", F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())))
        grown = grown.withColumns({f"__w{i}": F.col("__s.k"), f"__own{i}": F.col("__s.own"), f"__b{i}": F.explode(F.sequence(F.col("__s.a"), F.col("__s.b")))}).drop("__s")
    if not wide[0]:
        kind = f"struct<{key}: {rectangles.schema[key].dataType.simpleString()}, xlow: double, xup: double, ylow: double, yup: double>"
        return rectangles.limit(0).select(F.lit(None).cast(kind).alias("one"), F.lit(None).cast(kind).alias("other"))
    tag = F.col("__own0").cast("int") * 2 + F.col("__own1").cast("int")
    # of a pair one has the bucket's width on each axis: 3 goes with all, 2 with 1 and 3, 1 with 2 and 3, 0 with 3
    partners = F.when(tag == 3, F.array(*map(F.lit, (0, 1, 2, 3)))).when(tag == 2, F.array(F.lit(1), F.lit(3))).when(tag == 1, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(3)))
    bucket = ["__w0", "__b0", "__w1", "__b1"]
    whole = F.struct(key, *[c for axis in axes for c in axis])
    left = grown.select(*bucket, F.explode(partners).alias("__tag"), whole.alias("one"))
    right = grown.select(*bucket, tag.alias("__tag"), whole.alias("other"))
    # a compressed table looks small, and its rows are many times as many here: it is never broadcast
    met = left.join(right.hint("merge"), [*bucket, "__tag"]).filter(F.col(f"one.{key}") < F.col(f"other.{key}"))
    for i, (low, high) in enumerate(axes):
        start = F.greatest(f"one.{low}", f"other.{low}")
        met = met.filter((start <= F.least(f"one.{high}", f"other.{high}")) & (_bucket(start.cast("double"), F.col(f"__w{i}")) == F.col(f"__b{i}")))
    return met.select("one", "other")


def as_of(rows: DataFrame, events: DataFrame, at: Column, time: str, by: list[str] | None = None, most: float | None = None) -> DataFrame:
    """rows with the columns of the last event at or before `at` (null if there is none, or none within `most` before).

    by: columns of both that must be equal. events: by, time and others; of events at one time, that with the largest others is taken.
    Both sides are sorted as one by range and the last event is carried along; from range to range by a table of one row for each by and
    range. So neither many rows of one key nor a long gap makes work for one task.
    """
    by = by or []
    others = [c for c in events.columns if c not in by and c != time]
    last = events.filter(F.col(time).isNotNull()).groupBy(*by, F.col(time).alias("__t")).agg(F.max(F.struct(*others) if others else F.struct(F.lit(0).alias("__none"))).alias("__o"))
    told = last.select(*by, "__t", F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__deal"), F.struct(F.col("__t"), F.col("__o")).alias("__e"), F.lit(None).cast(rows.schema).alias("__r"))
    kind = told.schema["__e"].dataType
    asked = rows.select(*by, at.cast(last.schema["__t"].dataType).alias("__t"), F.lit(1).alias("__kind"), F.xxhash64(*rows.columns).alias("__deal"), F.lit(None).cast(kind).alias("__e"), F.struct(*rows.columns).alias("__r"))
    order = [*by, "__t", "__kind", "__deal"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    line = told.unionByName(asked).repartitionByRange(n, *order).sortWithinPartitions(*order).select(*by, "__t", "__e", "__r", F.monotonically_increasing_id().alias("__at"))
    line = stored(line, "as-of").withColumn("__part", F.shiftright("__at", 33))
    own = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    parts = line.groupBy(*by, "__part").agg(F.max_by("__e", F.when(F.col("__e").isNotNull(), F.col("__at"))).alias("__e"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__p"), F.last("__e", ignorenulls=True).over(before).alias("__c"))
    found = line.withColumn("__last", F.last("__e", ignorenulls=True).over(own)).filter("__r IS NOT NULL")
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    found = found.join(bounded(carried), same).withColumn("__last", F.coalesce("__last", "__c"))
    if most is not None:
        found = found.withColumn("__last", F.when(F.col("__t") - F.col("__last.__t") <= most, F.col("__last")))
    known = F.col("__t").isNotNull()
    for c in by:  # a null is equal to nothing
        known = known & F.col(c).isNotNull()
    return found.select("__r.*", F.when(known, F.col("__last.__t")).alias(time), *[F.when(known, F.col(f"__last.__o.{c}")).alias(c) for c in others])
