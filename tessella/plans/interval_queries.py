"""Queries of joins by intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import cover, intervals, lookup
from tessella.plans.queries import MONTHS, months, query

AREA = "sum((xup - xlow) * (yup - ylow))"

PLACED = "placed AS (SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) + (day(o_orderdate) - 1) / 31.0 AS p FROM orders)"


def placed(t) -> DataFrame:
    date = F.col("o_orderdate")
    return t("orders").select("o_orderkey", (F.year(date) * 12 + F.month(date) + (F.dayofmonth(date) - 1) / 31.0).alias("p"))


@query(f"WITH {MONTHS}, {PLACED} SELECT o_orderkey, round(y0 + (p - x0) * (y1 - y0) / (x1 - x0), 3) AS y FROM placed LEFT JOIN (SELECT * FROM seg WHERE x1 IS NOT NULL) s ON p >= x0 AND p < x1")
def interp_along(t):
    return lookup.along(placed(t), months(t), F.col("p")).select("o_orderkey", F.round("y", 3).alias("y"))


@query(f"WITH {MONTHS}, {PLACED} SELECT o_orderkey, round(y0 + (p - x0) * (y1 - y0) / (x1 - x0), 3) AS y FROM placed JOIN seg ON p >= x0 AND p < x1")
def interp_forward_orders(t):
    return lookup.forward(placed(t), lookup.segments(months(t)), F.col("p")).select("o_orderkey", F.round("y", 3).alias("y"))


@query(f"""WITH {MONTHS}, levels AS (SELECT p_partkey, (SELECT min(y) FROM months) + (p_retailprice - 900) / 100.0 * (SELECT max(y) - min(y) FROM months) AS level FROM part)
    SELECT p_partkey, x0 AS month, round(x0 + (level - y0) * (x1 - x0) / (y1 - y0), 5) AS x FROM levels JOIN seg ON level >= least(y0, y1) AND level < greatest(y0, y1) WHERE x1 IS NOT NULL""")
def interp_inverse_parts(t):
    low, high = (months(t).agg(f("y")) for f in (F.min, F.max))
    points = t("part").select("p_partkey", (low.scalar() + (F.col("p_retailprice") - 900) / 100.0 * (high.scalar() - low.scalar())).alias("level"))
    pieces = lookup.segments(months(t)).withColumn("month", F.col("x0"))
    return lookup.inverse(points, pieces, F.col("level")).select("p_partkey", "month", F.round("x", 5).alias("x"))


@query("""WITH clicks AS (SELECT user_id, ts AS clicked, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT event_id, click, clicked FROM events ASOF LEFT JOIN clicks ON events.user_id = clicks.user_id AND events.ts >= clicks.clicked""")
def last_click(t):
    clicks = t("events").filter("event_type = 'click'").select("user_id", F.col("ts").alias("clicked"), F.col("event_id").alias("click"))
    return intervals.as_of(t("events").select("event_id", "user_id", "ts"), clicks, F.col("ts"), "clicked", ["user_id"]).select("event_id", "click", "clicked")


SHEETS = "sheets AS (SELECT p_partkey AS rect_id, p_partkey % 7 = 3 AS excluded, CAST(p_size AS DOUBLE) AS xlow, CAST(p_size + 1 + p_partkey % 2 AS DOUBLE) AS xup, (p_retailprice - 900) * 1050.0 AS ylow, (p_retailprice - 900) * 1050.0 + 100 + p_partkey % 5 * 100 AS yup FROM part)"


def sheets(t) -> DataFrame:
    k, size, y = F.col("p_partkey"), F.col("p_size"), (F.col("p_retailprice") - 900) * 1050.0
    return t("part").select(k.alias("rect_id"), (k % 7 == 3).alias("excluded"), size.cast("double").alias("xlow"), (size + 1 + k % 2).cast("double").alias("xup"), y.alias("ylow"), (y + 100 + k % 5 * 100).alias("yup"))


@query(f"""WITH {SHEETS}, hit AS (SELECT l_orderkey, l_linenumber, l_extendedprice, min(rect_id) AS rect_id FROM lineitem JOIN sheets ON l_quantity >= xlow AND l_quantity < xup AND l_extendedprice >= ylow AND l_extendedprice < yup GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_extendedprice, rect_id FROM hit JOIN sheets USING (rect_id) WHERE NOT excluded""")
def rect_locate_lines(t):
    points = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return lookup.first_rectangle(points, sheets(t), F.col("l_quantity"), F.col("l_extendedprice"), ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query(f"""WITH {SHEETS}, d AS (SELECT a.rect_id AS one, b.rect_id AS other, least(a.xup, b.xup) - greatest(a.xlow, b.xlow) AS dx, least(a.yup, b.yup) - greatest(a.ylow, b.ylow) AS dy FROM sheets a JOIN sheets b ON a.rect_id < b.rect_id AND a.ylow <= b.yup AND b.ylow <= a.yup)
    SELECT one, other, round(dx * dy, 3) AS area FROM d WHERE dx >= 0 AND dy >= 0 AND (dx > 0 OR dy > 0)""")
def rect_overlap_parts(t):
    return lookup.overlaps(sheets(t)).withColumn("area", F.round("area", 3))


CUT = f"""{SHEETS}, xs AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM (SELECT xlow AS a FROM sheets UNION SELECT xup FROM sheets)),
    ys AS (SELECT c, lead(c) OVER (ORDER BY c) AS d FROM (SELECT ylow AS c FROM sheets UNION SELECT yup FROM sheets)),
    cells AS (SELECT a, c, (b - a) * (d - c) AS area, count(rect_id) AS n, min(rect_id) AS first FROM xs CROSS JOIN ys LEFT JOIN sheets ON xlow <= a AND b <= xup AND ylow <= c AND d <= yup WHERE b IS NOT NULL AND d IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {CUT} SELECT n, round(sum(area), 3) AS area FROM cells GROUP BY n")
def rect_cover_depths(t):
    """How much of the box is covered by no rectangle, by one, by two and so on."""
    return cover.cover(sheets(t)).groupBy("n").agg(F.round(F.expr(AREA), 3).alias("area"))


@query(f"WITH {CUT} SELECT first AS rect_id, round(sum(area), 3) AS area FROM cells WHERE n > 0 GROUP BY first")
def rect_disjoint_areas(t):
    """What each rectangle has left of its area by those before it."""
    return cover.disjoint(sheets(t)).groupBy("rect_id").agg(F.round(F.expr(AREA), 3).alias("area"))


@query("""SELECT count(*) AS n, round(sum(0.02), 6) AS area, round((max(p_partkey // 50) + 1) * 50 * 0.02, 6) AS box, count(*) = (max(p_partkey // 50) + 1) * 50 AS tiled FROM part""")
def rect_tiling(t):
    """Parts as plates in lines of fifty: whether they tile their box."""
    k = F.col("p_partkey")
    plates = t("part").select(k.alias("rect_id"), (F.floor(k / 50) * 0.1).alias("xlow"), ((F.floor(k / 50) + 1) * 0.1).alias("xup"), (k % 50 * 0.2).alias("ylow"), ((k % 50 + 1) * 0.2).alias("yup"))
    return cover.tiling(plates).select("n", F.round("area", 6).alias("area"), F.round("box", 6).alias("box"), "tiled")
