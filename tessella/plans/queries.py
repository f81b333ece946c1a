"""Every operator as a query over the stand-in tables, each with the SQL that says the same.

Stand-ins: a raster is lineitem binned by quantity and discount; points are events and parts; a sparse matrix
is (supplier, part, quantity) of lineitem; groups are nations and regions; vectors are embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import angles, geometry, physics, stats
from tessella.functions.axis import EPSILON, Axis
from tessella.operators import grid, groups, invert, lookup, matrix, trace, windows
from tessella.plans import detectability
from tessella.sources import config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

X, Y = Axis("quantity", 10, 1.0, 51.0), Axis("discount", 11, -0.005, 0.105)
SIZE, PRICE = Axis("size", 10, 1.0, 51.0), Axis("price", 20, 900.0, 1000.0)


def query(sql: str | None) -> Callable:
    """Registers a function of a reader of tables; its name is the query's."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def bin_sql(column: str, a: Axis) -> str:
    at = f"floor(({column} - ({a.min!r}) + {EPSILON * a.interval!r}) / {a.interval!r})"
    return f"CASE WHEN {column} >= {a.min!r} AND {column} < {a.max!r} THEN CAST(least({at}, {a.nbin - 1}) AS INTEGER) END"


RASTER = f"""raster AS (SELECT ix, iy, count(*) AS n, round(sum(p), 2) AS z FROM
    (SELECT {bin_sql("l_quantity", X)} AS ix, {bin_sql("l_discount", Y)} AS iy, l_extendedprice AS p FROM lineitem)
    WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY ix, iy)"""
PART = f"part_cells AS (SELECT p_partkey, p_size, p_retailprice, {bin_sql('p_size', SIZE)} AS ix, {bin_sql('p_retailprice', PRICE)} AS iy FROM part)"
COO = "coo AS (SELECT l_suppkey AS \"row\", l_partkey AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def raster(t) -> DataFrame:
    out = grid.histogram(t("lineitem"), X, Y, F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice"))
    return out.withColumn("z", F.round("z", 2))


def coo(t) -> DataFrame:
    entries = t("lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))
    return windows.dealt(entries, ["row", "col"]).groupBy("row", "col").agg(F.sum("value").alias("value"))


def parts(t) -> DataFrame:
    return t("part").withColumns({"ix": SIZE.index(F.col("p_size")), "iy": PRICE.index(F.col("p_retailprice"))})


# ---- axes, cells and structures


@query(f"SELECT l_orderkey, l_linenumber, ix, iy, round(1.0 + (ix + 0.5) * 5.0, 6) AS xc, round(-0.005 + iy * {Y.interval!r}, 6) AS ylow FROM (SELECT l_orderkey, l_linenumber, {bin_sql('l_quantity', X)} AS ix, {bin_sql('l_discount', Y)} AS iy FROM lineitem)")
def grid_index(t):
    out = t("lineitem").select("l_orderkey", "l_linenumber", X.index(F.col("l_quantity")).alias("ix"), Y.index(F.col("l_discount")).alias("iy"))
    return out.withColumns({"xc": F.round(X.center(F.col("ix")), 6), "ylow": F.round(Y.lower(F.col("iy")), 6)})


@query(f"WITH {RASTER} SELECT * FROM raster")
def hist2d_weighted(t):
    return raster(t)


@query(f"SELECT {bin_sql('l_quantity', X)} AS ix, {bin_sql('l_discount', Y)} AS iy, round(avg(l_tax), 6) AS z FROM lineitem GROUP BY 1, 2")
def grid_mean_pivot(t):
    return grid.cell_means(t("lineitem"), X, Y, F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).withColumn("z", F.round("z", 6))


@query(f"""WITH b AS (SELECT *, {bin_sql('l_quantity', X)} AS ix, {bin_sql('l_discount', Y)} AS iy FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS k FROM b)
    SELECT ix, iy, 2000.0 AS zmin, l_extendedprice AS zmax, CASE WHEN l_extendedprice > 2000 THEN 2.5 ELSE 0.0 END AS density FROM r WHERE k = 1""")
def pillars_last_wins(t):
    return grid.last_in_cell(t("lineitem"), X, Y, F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice"), 2000.0, 2.5)


@query("""WITH d AS (SELECT DISTINCT l_quantity AS v FROM lineitem), s AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS step FROM d), f AS (SELECT step AS first FROM s WHERE step IS NOT NULL ORDER BY v LIMIT 1)
    SELECT min(v) - first / 2 AS min, max(v) + first / 2 AS max, first AS interval, CAST(floor((max(v) - min(v)) / first + 0.5) + 1 AS INTEGER) AS nbin, max(abs(step - first) - step * 1e-4) <= 0 AS uniform FROM s, f GROUP BY first""")
def axis_infer(t):
    return grid.infer_axis(t("lineitem"), "l_quantity")


#: A block that ends with the axis isn't made.
MERGED = f"{RASTER}, merged AS (SELECT CAST(floor(ix / 2.0) AS INTEGER) AS ix, CAST(floor(iy / 2.0) AS INTEGER) AS iy, round(avg(z), 4) AS z FROM raster WHERE floor(ix / 2.0) * 2 < 10 - 2 AND floor(iy / 2.0) * 2 < 11 - 2 GROUP BY 1, 2 HAVING count(*) = 4)"


@query(f"WITH {MERGED} SELECT * FROM merged")
def grid_merge_complete(t):
    return grid.merged(raster(t), ["ix", "iy"], 2, "z", bins=[X.nbin, Y.nbin]).withColumn("z", F.round("z", 4))


@query(f"WITH {MERGED} SELECT r.ix, r.iy, m.ix IS NULL AS tf_exist FROM raster r LEFT JOIN merged m ON m.ix = floor(r.ix / 2.0) AND m.iy = floor(r.iy / 2.0)")
def grid_merge_consumes(t):
    return grid.merged_away(raster(t).select("ix", "iy", F.lit(True).alias("tf_exist")), grid_merge_complete(t), ["ix", "iy"], 2)


@query(f"WITH {RASTER} SELECT ix * 2 + a AS ix, iy * 2 + b AS iy, n, z FROM raster, (VALUES (0), (1)) AS p(a), (VALUES (0), (1)) AS q(b)")
def grid_split(t):
    return grid.split(raster(t), ["ix", "iy"], 2)


@query(f"WITH {MERGED} SELECT r.ix, r.iy, n, coalesce(m.z, r.z) AS z FROM raster r LEFT JOIN merged m ON m.ix = floor(r.ix / 2.0) AND m.iy = floor(r.iy / 2.0)")
def grid_overlay(t):
    r = raster(t)
    return grid.overlaid(r, grid_merge_complete(t), ["ix", "iy"], 2, "z")


@query(f"WITH {RASTER} SELECT ix - 2 AS ix, iy, n, z FROM raster WHERE ix BETWEEN 2 AND 6")
def grid_cut(t):
    cut = X.cut(11.0, 36.0)
    first = round((cut.min - X.min) / X.interval)
    return raster(t).filter(F.col("ix").between(first, first + cut.nbin - 1)).withColumn("ix", (F.col("ix") - first).cast("int"))


@query("SELECT p_partkey FROM part WHERE pow((p_size - 25.5) / 12.0, 2) + pow((p_retailprice - 950.0) / 20.0, 2) <= 1")
def mask_ellipse(t):
    return t("part").filter(geometry.in_ellipse(F.col("p_size"), F.col("p_retailprice"), (25.5, 950.0), (12.0, 20.0))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 30 AND p_retailprice >= 920 AND p_retailprice < 970")
def mask_aabb(t):
    return t("part").filter(geometry.in_box([F.col("p_size"), F.col("p_retailprice")], [10, 920], [30, 970])).select("p_partkey")


@query(f"WITH {PART} SELECT p_partkey, CASE WHEN (floor((ix - 5) / 2.0) + floor((iy - 10) / 2.0)) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM part_cells WHERE ix IS NOT NULL AND iy IS NOT NULL")
def checkerboard(t):
    p = parts(t).filter("ix IS NOT NULL AND iy IS NOT NULL")
    return p.select("p_partkey", geometry.checker_sign([F.col("ix"), F.col("iy")], [5, 10], 2).alias("sign"))


@query(f"WITH {RASTER} SELECT ix, iy, 2.0 + CASE WHEN pow((ix - 4.5) / 3.0, 2) + pow((iy - 5.0) / 4.0, 2) <= 1 AND n > 0 THEN 0.5 ELSE 0 END AS density FROM raster")
def structure_add(t):
    cells = raster(t).withColumn("density", F.lit(2.0))
    return grid.structure(cells, geometry.in_ellipse(F.col("ix"), F.col("iy"), (4.5, 5.0), (3.0, 4.0)), 0.5, F.col("n") > 0).select("ix", "iy", "density")


EXTENTS = "extents AS (SELECT l_suppkey, l_partkey % 7 AS k, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {EXTENTS} SELECT * FROM extents")
def column_extent(t):
    return grid.extents(t("lineitem").withColumn("k", F.col("l_partkey") % 7), ["l_suppkey", "k"], "l_quantity")


@query(f"""WITH {RASTER}, c AS (SELECT ix, iy, 10000.0 AS z_low, z / 2 AS z_high FROM raster WHERE ix < 6)
    SELECT ix, iy, round(CASE WHEN c.z_low IS NOT NULL THEN greatest(0, z - z_high) ELSE 0 END, 3) AS upper, round(CASE WHEN c.z_low IS NOT NULL THEN greatest(0, z_low - 0.0) ELSE 0 END, 3) AS lower, round(CASE WHEN c.z_low IS NULL THEN z ELSE 0 END, 3) AS lateral FROM raster LEFT JOIN c USING (ix, iy)""")
def shell_split(t):
    r = raster(t)
    pillars = r.select("ix", "iy", F.lit(0.0).alias("zmin"), F.col("z").alias("zmax"))
    columns = r.filter("ix < 6").select("ix", "iy", F.lit(10000.0).alias("z_low"), (F.col("z") / 2).alias("z_high"))
    return grid.shells(pillars, columns, ["ix", "iy"]).select("ix", "iy", *[F.round(c, 3).alias(c) for c in ("upper", "lower", "lateral")])


@query(f"""WITH {RASTER}, v AS (SELECT ix, iy, CAST(iz AS INTEGER) AS iz, z / n AS top, ix * 1500.0 AS base, iz * 10000.0 AS low FROM raster, generate_series(0, 11) AS g(iz))
    SELECT ix, iy, iz, iz >= floor(base / 10000) AND iz < floor(top / 10000) AS tf_exist, round(CASE WHEN iz >= floor(base / 10000) AND iz < floor(top / 10000) THEN 2.0 WHEN iz = floor(top / 10000) THEN 2.0 * (top - low) / 10000 ELSE 0 END, 6) AS density FROM v""")
def voxelise(t):
    pillars = raster(t).select("ix", "iy", (F.col("ix") * 1500.0).alias("zmin"), (F.col("z") / F.col("n")).alias("zmax"), F.lit(2.0).alias("density"))
    return grid.voxels(pillars, Axis("z", 12, 0.0, 120000.0)).withColumn("density", F.round("density", 6))


@query(f"WITH {RASTER} SELECT ix, iy, CAST(h AS DOUBLE) AS z, CASE WHEN 0 <= h AND h < z / n THEN 2.0 ELSE 0.0 END AS density FROM raster, (VALUES (20000), (40000)) AS s(h)")
def horizontal_slices(t):
    pillars = raster(t).select("ix", "iy", F.lit(0.0).alias("zmin"), (F.col("z") / F.col("n")).alias("zmax"), F.lit(2.0).alias("density"))
    return grid.slices(pillars, [20000, 40000])


@query(f"WITH {RASTER} SELECT ix, iy, greatest(0.0, CASE WHEN ix < 6 THEN z / 2 ELSE 0.0 END) AS zmin, z AS zmax FROM raster")
def raise_base(t):
    r = raster(t)
    pillars = r.select("ix", "iy", F.lit(0.0).alias("zmin"), F.col("z").alias("zmax"))
    return grid.raised(pillars, r.filter("ix < 6").select("ix", "iy", (F.col("z") / 2).alias("z_high"))).select("ix", "iy", "zmin", "zmax")


@query(f"WITH {RASTER} SELECT l_orderkey, l_linenumber, round(l_extendedprice - z / n, 4) AS dz FROM (SELECT *, {bin_sql('l_quantity', X)} AS ix, {bin_sql('l_discount', Y)} AS iy FROM lineitem) JOIN raster USING (ix, iy)")
def above_terrain(t):
    pillars = raster(t).select("ix", "iy", (F.col("z") / F.col("n")).alias("zmax"))
    points = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("z"))
    return grid.above_terrain(points, pillars, X, Y).select("l_orderkey", "l_linenumber", F.round("dz", 4).alias("dz"))


@query(f"WITH {RASTER} SELECT ix, iy, round(z - n * 1000.0, 2) AS z FROM raster")
def grid_difference(t):
    r = raster(t)
    return grid.difference(r.select("ix", "iy", "z"), r.select("ix", "iy", (F.col("n") * 1000.0).alias("z")), ["ix", "iy"], "z").withColumn("z", F.round("z", 2))


# ---- rays


RAYS = "rays AS (SELECT o_orderkey AS ray_id, -1.0 AS px, CAST(o_custkey % 10 AS DOUBLE) + 0.35 AS py, 1.0 AS vx, (o_orderkey % 7 - 3) * 0.11 AS vy FROM orders)"


def rays(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("ray_id"), F.lit(-1.0).alias("px"), ((F.col("o_custkey") % 10).cast("double") + 0.35).alias("py"), F.lit(1.0).alias("vx"), ((F.col("o_orderkey") % 7 - 3) * 0.11).alias("vy"))


@query(f"""WITH {RAYS}, boxes AS (SELECT n_nationkey, n_nationkey * 1.0 AS x0, n_nationkey * 1.0 + 2 AS x1, (n_nationkey % 6) * 1.0 AS y0, (n_nationkey % 6) * 1.0 + 3 AS y1 FROM nation),
    s AS (SELECT ray_id, n_nationkey, (x0 - px) / vx AS a0, (x1 - px) / vx AS a1, vy, py, y0, y1, (y0 - py) / nullif(vy, 0) AS b0, (y1 - py) / nullif(vy, 0) AS b1 FROM rays, boxes),
    w AS (SELECT ray_id, n_nationkey, greatest(0, a0, CASE WHEN vy <> 0 THEN least(b0, b1) ELSE 0 END) AS t0, least(a1, CASE WHEN vy <> 0 THEN greatest(b0, b1) ELSE a1 END) AS t1 FROM s WHERE vy <> 0 OR (py >= y0 AND py <= y1))
    SELECT ray_id, n_nationkey, round(t1 - t0, 6) AS length FROM w WHERE t1 > t0""")
def slab_intersect(t):
    n = F.col("n_nationkey")
    boxes = t("nation").select(n, (n * 1.0).alias("x0"), (n * 1.0 + 2).alias("x1"), (n % 6 * 1.0).alias("y0"), (n % 6 * 1.0 + 3).alias("y1"))
    length = geometry.slab_length([F.col("px"), F.col("py")], [F.col("vx"), F.col("vy")], [F.col("x0"), F.col("y0")], [F.col("x1"), F.col("y1")])
    return rays(t).crossJoin(F.broadcast(boxes)).withColumn("length", F.round(length, 6)).filter("length IS NOT NULL").select("ray_id", "n_nationkey", "length")


CELLS = f"""{RAYS}, bound AS (SELECT *, greatest(1.0, CASE WHEN vy <> 0 THEN least((0 - py) / vy, (12 - py) / vy) ELSE 1.0 END) AS t0, least(11.0, CASE WHEN vy <> 0 THEN greatest((0 - py) / vy, (12 - py) / vy) ELSE 11.0 END) AS t1
        FROM (SELECT ray_id, px, py, vx, nullif(vy, 0) AS w, vy FROM rays) WHERE vy <> 0 OR (py >= 0 AND py <= 12)),
    cuts AS (SELECT ray_id, t0 AS t FROM bound WHERE t1 > t0 UNION SELECT ray_id, t1 FROM bound WHERE t1 > t0
        UNION SELECT ray_id, (0.0 + i * 1.0 - px) / vx FROM bound, generate_series(0, 10) AS g(i) WHERE t1 > t0 AND (i - px) / vx > t0 AND (i - px) / vx < t1
        UNION SELECT ray_id, (0.0 + i * 1.0 - py) / vy FROM bound, generate_series(0, 12) AS g(i) WHERE vy <> 0 AND t1 > t0 AND (i - py) / vy > t0 AND (i - py) / vy < t1),
    steps AS (SELECT ray_id, t, lead(t) OVER (PARTITION BY ray_id ORDER BY t) AS u FROM cuts),
    cells AS (SELECT ray_id, CAST(floor(px + (t + u) / 2 * vx) AS INTEGER) AS ix, CAST(floor(py + (t + u) / 2 * vy) AS INTEGER) AS iy, sum(u - t) AS length FROM steps JOIN bound USING (ray_id) WHERE u > t
        GROUP BY 1, 2, 3 HAVING ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 11)"""
GRID = [Axis("x", 10, 0.0, 10.0), Axis("y", 12, 0.0, 12.0)]


@query(f"WITH {CELLS} SELECT ray_id, ix, iy, round(length, 6) AS length FROM cells WHERE length > 1e-9")
def ray_cells_window(t):
    return trace.crossings(rays(t), GRID).filter("length > 1e-9").withColumn("length", F.round("length", 6))


@query(f"WITH {CELLS} SELECT ray_id, ix, iy, round(length, 6) AS length FROM cells WHERE length > 1e-9")
def ray_cells_batched(t):
    return trace.traced(rays(t), GRID).filter("length > 1e-9").withColumn("length", F.round("length", 6))


@query(f"WITH {CELLS} SELECT ray_id, round(sum(length), 5) AS pl, round(sum(length * (1 + (ix + iy) % 3)), 5) AS dl FROM cells GROUP BY 1")
def path_density_sum(t):
    every = trace.crossings(rays(t), GRID)
    densities = every.select("ix", "iy").distinct().withColumn("density", 1.0 + (F.col("ix") + F.col("iy")) % 3)
    out = trace.path_sums(every, densities, ["ix", "iy"])
    return out.select("ray_id", F.round("pl", 5).alias("pl"), F.round("dl", 5).alias("dl"))


# ---- look-ups


@query(f"""WITH {RASTER}, w AS (SELECT a.ix, a.iy, a.z AS z00, coalesce(b.z, a.z) AS z10, coalesce(c.z, a.z) AS z01, d.z AS d11 FROM raster a LEFT JOIN raster b ON b.ix = a.ix + 1 AND b.iy = a.iy LEFT JOIN raster c ON c.ix = a.ix AND c.iy = a.iy + 1 LEFT JOIN raster d ON d.ix = a.ix + 1 AND d.iy = a.iy + 1),
    p AS (SELECT l_orderkey, l_linenumber, {bin_sql('l_quantity', X)} AS ix, {bin_sql('l_discount', Y)} AS iy, l_quantity AS x, l_discount AS y, l_linenumber FROM lineitem),
    f AS (SELECT l_orderkey, l_linenumber, (x - (1.0 + ix * 5.0)) / 5.0 AS fx, (y - (-0.005 + iy * {Y.interval!r})) / {Y.interval!r} AS fy, z00, z10, z01, coalesce(d11, z10 + z01 - z00) AS z11 FROM p JOIN w USING (ix, iy))
    SELECT l_orderkey, l_linenumber, round(z00 * (1 - fx) * (1 - fy) + z10 * fx * (1 - fy) + z01 * (1 - fx) * fy + z11 * fx * fy, 3) AS z FROM f""")
def bilinear_lookup(t):
    points = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = lookup.interpolated(points, lookup.widened(raster(t).select("ix", "iy", "z")), X, Y, F.col("l_quantity"), F.col("l_discount"))
    return out.select("l_orderkey", "l_linenumber", F.round("z", 3).alias("z"))


MONTHS = "months AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1), seg AS (SELECT x AS x0, lead(x) OVER (ORDER BY x) AS x1, y AS y0, lead(y) OVER (ORDER BY x) AS y1 FROM months)"


def months(t) -> DataFrame:
    return t("orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("x")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


@query(f"WITH {MONTHS} SELECT n_nationkey, round(y0 + (p - x0) * (y1 - y0) / (x1 - x0), 3) AS y FROM (SELECT n_nationkey, (SELECT min(x) FROM months) + n_nationkey * 0.7 AS p FROM nation) JOIN seg ON p >= x0 AND p < x1")
def interp_forward(t):
    points = t("nation").select("n_nationkey").withColumn("p", months(t).agg(F.min("x")).scalar() + F.col("n_nationkey") * 0.7)
    return lookup.forward(points, lookup.segments(months(t)), F.col("p")).select("n_nationkey", F.round("y", 3).alias("y"))


@query(f"WITH {MONTHS}, m AS (SELECT avg(y) AS level FROM months) SELECT x0, round(x0 + (level - y0) * (x1 - x0) / (y1 - y0), 5) AS x FROM seg, m WHERE x1 IS NOT NULL AND level >= least(y0, y1) AND level < greatest(y0, y1)")
def interp_inverse(t):
    level = months(t).agg(F.avg("y").alias("level"))
    return lookup.inverse(level, lookup.segments(months(t)), F.col("level")).select(F.floor("x").cast("int").alias("x0"), F.round("x", 5).alias("x"))


def rectangles(t) -> DataFrame:
    n = F.col("n_nationkey")
    return t("nation").select(n.alias("rect_id"), (n % 7 == 3).alias("excluded"), (n % 5 * 10.0).alias("xlow"), (n % 5 * 10.0 + 15).alias("xup"), (F.floor(n / 5) * 20.0 + 900).alias("ylow"), (F.floor(n / 5) * 20.0 + 925).alias("yup"))


RECTANGLES = "rects AS (SELECT n_nationkey AS rect_id, n_nationkey % 7 = 3 AS excluded, n_nationkey % 5 * 10.0 AS xlow, n_nationkey % 5 * 10.0 + 15 AS xup, floor(n_nationkey / 5.0) * 20.0 + 900 AS ylow, floor(n_nationkey / 5.0) * 20.0 + 925 AS yup FROM nation)"


@query(f"""WITH {RECTANGLES}, hit AS (SELECT p_partkey, min(rect_id) AS rect_id FROM part JOIN rects ON p_size >= xlow AND p_size < xup AND p_retailprice >= ylow AND p_retailprice < yup GROUP BY 1)
    SELECT p_partkey, rect_id FROM hit JOIN rects USING (rect_id) WHERE NOT excluded""")
def rect_locate(t):
    return lookup.first_rectangle(t("part"), rectangles(t), F.col("p_size"), F.col("p_retailprice"), ["p_partkey"])


@query(f"""WITH {RECTANGLES}, d AS (SELECT a.rect_id AS one, b.rect_id AS other, least(a.xup, b.xup) - greatest(a.xlow, b.xlow) AS dx, least(a.yup, b.yup) - greatest(a.ylow, b.ylow) AS dy FROM rects a JOIN rects b ON a.rect_id < b.rect_id)
    SELECT one, other, dx * dy AS area FROM d WHERE dx >= 0 AND dy >= 0 AND (dx > 0 OR dy > 0)""")
def rect_overlap(t):
    return lookup.overlaps(rectangles(t))


# ---- windows


@query(f"WITH {RASTER} SELECT ix, iy, round(coalesce(lead(z) OVER w - z, z - lag(z) OVER w) / 5.0, 3) AS derivative FROM raster WINDOW w AS (PARTITION BY iy ORDER BY ix)")
def finite_difference(t):
    return windows.finite_difference(raster(t), "z", "ix", ["iy"], X.interval).select("ix", "iy", F.round("derivative", 3).alias("derivative"))


@query("""WITH v AS (SELECT user_id, event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0 ELSE value - 50 END AS z FROM events),
    s AS (SELECT user_id, event_id, sign(z) AS s, last_value(nullif(sign(z), 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)
    SELECT user_id, count(*) AS n, count(*) - count(s) AS broken, round(count(*) FILTER (WHERE s > 0) / CAST(count(*) AS DOUBLE), 6) AS positive, round(coalesce(count(*) FILTER (WHERE s <> 0 AND before <> s) / nullif(count(*) - 1.0, 0), 0), 6) AS flips FROM s GROUP BY 1""")
def divergence_guard(t):
    z = F.when(F.col("event_id") % 13 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value") - 50)
    out = windows.sign_flips(t("events"), z, ["user_id"], ["event_id"])
    return out.select("user_id", "n", "broken", F.round("positive", 6).alias("positive"), F.round("flips", 6).alias("flips"))


@query("""WITH s AS (SELECT user_id, epoch(ts) AS x, value AS y, lag(epoch(ts)) OVER w AS x0, lag(value) OVER w AS y0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, round(coalesce(sum((x - x0) * (y + y0) / 2), 0), 1) AS integral FROM s GROUP BY 1""")
def trapezoid_integral(t):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return windows.trapezoid(t("events").withColumn("x", seconds), F.col("x"), F.col("value"), ["user_id"], ["ts", "event_id"]).select("user_id", F.round("integral", 1).alias("integral"))


SPARSE = f"{RASTER}, sparse AS (SELECT ix, iy, n FROM raster WHERE (ix + 2 * iy) % 3 = 0)"


@query(f"""WITH {SPARSE}, g AS (SELECT CAST(x AS INTEGER) AS ix, CAST(y AS INTEGER) AS iy FROM generate_series(0, 9) AS a(x), generate_series(0, 10) AS b(y) WHERE x <= (SELECT max(ix) FROM sparse) AND y <= (SELECT max(iy) FROM sparse))
    SELECT g.ix, g.iy, CAST(coalesce(sum(n), 0) AS BIGINT) AS s FROM g LEFT JOIN sparse b ON b.ix <= g.ix AND b.iy <= g.iy GROUP BY 1, 2""")
def prefix_sum_2d(t):
    return windows.prefix_sums(raster(t).filter("(ix + 2 * iy) % 3 = 0"), "n").select("ix", "iy", "s")


def _rectangles(t) -> DataFrame:
    n = F.col("n_nationkey")
    return t("nation").select(n.alias("rect_id"), (n % 5).alias("x0"), (n % 5 + 3).alias("x1"), F.floor(n / 5).cast("int").alias("y0"), (F.floor(n / 5) + 4).cast("int").alias("y1"))


@query(f"WITH {RASTER} SELECT n_nationkey AS rect_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM nation LEFT JOIN raster ON ix >= n_nationkey % 5 AND ix < n_nationkey % 5 + 3 AND iy >= floor(n_nationkey / 5.0) AND iy < floor(n_nationkey / 5.0) + 4 GROUP BY 1")
def prefix_rect_query(t):
    return windows.rectangle_sums(windows.prefix_sums(raster(t), "n"), _rectangles(t)).select("rect_id", "total")


@query(f"""WITH {RASTER}, w AS (SELECT size, i, CAST(floor((10 - size) / 2.0) AS INTEGER) AS x0, CAST(11 - i * 2 AS INTEGER) AS y1 FROM (VALUES (3), (5)) AS s(size), generate_series(0, 4) AS g(i) WHERE i < greatest(1, floor((11 - size) / 2.0)))
    SELECT size, CAST(i AS INTEGER) AS i, CAST(sum(n) AS BIGINT) AS total FROM w JOIN raster ON ix >= x0 AND ix < x0 + size AND iy >= y1 - size AND iy < y1 GROUP BY 1, 2""")
def sliding_sweep(t):
    panel = t("region").filter("r_regionkey = 0").select(F.lit(0).alias("det"), F.lit(X.nbin).alias("nx"), F.lit(Y.nbin).alias("ny"))
    return windows.rectangle_sums(windows.prefix_sums(raster(t), "n"), detectability.windows(panel, [3, 5], 2)).select("size", F.col("i").cast("int").alias("i"), "total")


@query("""WITH m AS (SELECT user_id, event_id, value > 30 AS inside, lag(value > 30) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    k AS (SELECT *, sum(CASE WHEN inside AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m)
    SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM k WHERE inside GROUP BY 1, 2""")
def islands_in_out(t):
    return windows.islands(t("events"), F.col("value") > 30, ["user_id"], ["event_id"])


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS number FROM customer")
def dense_ids(t):
    return windows.dense_numbers(t("customer").select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], "number").select("c_custkey", "number")


@query("""WITH d AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)
    SELECT user_id, min(d) > 0 AS ascends, max(d) - min(d) <= 100 AS uniform FROM d GROUP BY 1""")
def uniform_check(t):
    return windows.uniform(t("events"), "event_id", ["user_id"], 100)


@query("SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY 1")
def contiguous_check(t):
    return windows.contiguous(t("lineitem"), "l_linenumber", ["l_orderkey"])


# ---- groups


@query(f"WITH {RASTER} SELECT ix, iy, CAST(floor(ix / 4.0) + floor(iy / 4.0) * 3 AS INTEGER) AS igroup FROM raster")
def initial_grouping(t):
    return groups.initial(raster(t), 10, 11, 3, 3).select("ix", "iy", "igroup")


@query(None)
def auto_divide(t):
    bins = grid.binned(t("lineitem"), X, Y, F.col("l_quantity"), F.col("l_discount")).groupBy("l_returnflag", "ix", "iy").agg(F.count(F.lit(1)).alias("weight"))
    return groups.auto_divided(bins, "l_returnflag", 500)


BINS = "bins AS (SELECT l_suppkey, l_partkey, l_linenumber, l_orderkey, l_quantity AS pl, l_extendedprice / 1000 AS dl, l_extendedprice AS signal, l_tax * 100 AS noise_poi, l_discount * 100 AS noise_det FROM lineitem)"


def bins(t) -> DataFrame:
    return t("lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey", F.col("l_quantity").alias("pl"), (F.col("l_extendedprice") / 1000).alias("dl"), F.col("l_extendedprice").alias("signal"), (F.col("l_tax") * 100).alias("noise_poi"), (F.col("l_discount") * 100).alias("noise_det"))


@query(f"""WITH {BINS} SELECT l_orderkey, l_linenumber, NOT (pl < 10 OR dl < 20) AS is_avail, signal, round(CASE WHEN pl < 10 OR dl < 20 THEN 7.5 ELSE noise_poi END, 6) AS noise_poi, round(CASE WHEN pl < 10 OR dl < 20 THEN 0 ELSE noise_det END, 6) AS noise_det FROM bins""")
def availability(t):
    out = groups.available(bins(t), 10, 20, -1, 7.5)
    return out.select("l_orderkey", "l_linenumber", "is_avail", "signal", F.round("noise_poi", 6).alias("noise_poi"), F.round("noise_det", 6).alias("noise_det"))


@query(f"WITH {BINS} SELECT l_suppkey, round(sum(signal), 2) AS signal, round(sum(noise_poi), 4) AS noise_poi, round(sum(noise_det), 4) AS noise_det FROM bins GROUP BY 1")
def group_sums(t):
    out = groups.sums(bins(t), ["l_suppkey"], ["signal", "noise_poi", "noise_det"])
    return out.select("l_suppkey", F.round("signal", 2).alias("signal"), F.round("noise_poi", 4).alias("noise_poi"), F.round("noise_det", 4).alias("noise_det"))


@query(f"WITH {BINS} SELECT l_suppkey, round(pow(sum((noise_poi + 2 - noise_poi) / 2 * pl), 2), 2) AS correlated, round(sum(pow((noise_poi + 2 - noise_poi) / 2 * pl, 2)), 2) AS independent FROM bins GROUP BY 1")
def group_eff_variance(t):
    out = groups.efficiency_variance(bins(t), ["l_suppkey"], F.col("pl"), F.col("noise_poi"), F.col("noise_poi") + 2)
    return out.select("l_suppkey", F.round("correlated", 2).alias("correlated"), F.round("independent", 2).alias("independent"))


@query(f"WITH {BINS} SELECT l_suppkey, round(avg(noise_poi), 6) AS eff_low, round(avg(noise_det), 6) AS eff_cnt FROM bins GROUP BY 1")
def group_eff_mean(t):
    return bins(t).groupBy("l_suppkey").agg(F.round(F.avg("noise_poi"), 6).alias("eff_low"), F.round(F.avg("noise_det"), 6).alias("eff_cnt"))


@query(f"WITH {BINS} SELECT l_suppkey, round(coalesce(sum(dl * pl) / nullif(sum(pl), 0), 2.0), 5) AS mean FROM bins GROUP BY 1")
def weighted_mean_density(t):
    return groups.weighted_mean(bins(t), ["l_suppkey"], F.col("dl"), F.col("pl"), 2.0).withColumn("mean", F.round("mean", 5))


@query(f"WITH {BINS}, w AS (SELECT *, 1000 * signal / sum(signal) OVER (PARTITION BY l_suppkey) AS noise FROM bins) SELECT l_orderkey, l_linenumber, round(noise * 0.75, 6) AS noise_det, round(noise * 0.25, 6) AS noise_poi FROM w")
def noise_split(t):
    out = groups.noise_split(bins(t), ["l_suppkey"], 1000.0, 0.25)
    return out.select("l_orderkey", "l_linenumber", F.round("noise_det", 6).alias("noise_det"), F.round("noise_poi", 6).alias("noise_poi"))


@query(f"WITH {PART} SELECT p_brand, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1, count(*) AS n, count(*) = (max(ix) - min(ix) + 1) * (max(iy) - min(iy) + 1) AS is_rect FROM part_cells JOIN part USING (p_partkey) GROUP BY 1")
def group_bounding_box(t):
    return groups.bounding_boxes(parts(t), ["p_brand"])


@query("""WITH b AS (SELECT l_suppkey AS g, l_quantity AS pl FROM lineitem), d AS (SELECT 0.5 + i * 0.25 AS rho FROM generate_series(0, 10) AS s(i)),
    n AS (SELECT g, rho, sum(1000 * exp(-pl * rho / 20)) AS n FROM b, d GROUP BY 1, 2), c AS (SELECT g, sum(1000 * exp(-pl * 1.3 / 20)) AS target FROM b GROUP BY 1),
    r AS (SELECT g, rho, abs(n - target) AS off, row_number() OVER (PARTITION BY g ORDER BY abs(n - target), rho) AS k FROM n JOIN c USING (g))
    SELECT g, CAST(rho AS DOUBLE) AS rho, round(off, 3) AS off FROM r WHERE k = 1""")
def proj_density_scan(t):
    b = t("lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("pl"))
    target = b.groupBy("g").agg(F.sum(1000 * F.exp(-F.col("pl") * 1.3 / 20)).alias("target"))
    return groups.best_density(b, ["g"], [0.5 + i * 0.25 for i in range(11)], 1000 * F.exp(-F.col("pl") * F.col("rho") / 20), target).withColumn("off", F.round("off", 3))


# ---- matrices


@query(f"WITH {COO} SELECT \"row\", round(sum(value * (col % 5 + 1)), 3) AS value FROM coo GROUP BY 1")
def matrix_vector(t):
    vector = t("part").select(F.col("p_partkey").alias("col"), (F.col("p_partkey") % 5 + 1).cast("double").alias("x"))
    return matrix.times_vector(coo(t), vector).withColumn("value", F.round("value", 3))


@query(f"WITH {COO} SELECT \"row\", col, round(value * s_acctbal, 3) AS value FROM coo JOIN supplier ON s_suppkey = \"row\"")
def obs_matrix_scale(t):
    factors = t("supplier").select(F.col("s_suppkey").alias("row"), F.col("s_acctbal").alias("factor"))
    return matrix.scaled_rows(coo(t), factors).withColumn("value", F.round("value", 3))


@query(f"WITH {COO} SELECT s_nationkey AS grp, col, sum(value) AS value FROM coo JOIN supplier ON s_suppkey = \"row\" GROUP BY 1, 2")
def obs_matrix_group(t):
    return matrix.grouped_rows(coo(t), t("supplier").select(F.col("s_suppkey").alias("row"), F.col("s_nationkey").alias("grp")))


@query(f"WITH {COO} SELECT n_nationkey AS left_out, count(*) AS n, sum(value) AS value FROM coo JOIN supplier ON s_suppkey = \"row\" JOIN nation ON s_nationkey <> n_nationkey GROUP BY 1")
def leave_one_out_rows(t):
    owners = [r[0] for r in t("nation").select("n_nationkey").distinct().collect()]  # panels, which are few
    owned = coo(t).join(t("supplier").select(F.col("s_suppkey").alias("row"), "s_nationkey"), "row")
    return matrix.leave_one_out(owned, F.col("s_nationkey"), owners).groupBy("left_out").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


HITS = "hits AS (SELECT col, count(DISTINCT s_nationkey) AS owners, count(*) AS \"rows\" FROM coo JOIN supplier ON s_suppkey = \"row\" GROUP BY 1)"


def hits(t) -> DataFrame:
    owned = coo(t).join(t("supplier").select(F.col("s_suppkey").alias("row"), "s_nationkey"), "row")
    return matrix.hits(owned, F.col("s_nationkey"))


@query(f"WITH {COO}, {HITS} SELECT * FROM hits")
def hit_counts(t):
    return hits(t)


@query(f"WITH {COO}, {HITS}, k AS (SELECT col, row_number() OVER (ORDER BY col) - 1 AS new FROM hits WHERE owners >= 3) SELECT \"row\", new AS col, value FROM coo JOIN k USING (col)")
def column_renumber(t):
    return matrix.renumbered(coo(t), hits(t).filter("owners >= 3"))


@query(f"WITH {COO} SELECT * FROM coo WHERE \"row\" NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def matrix_without_rows(t):
    return matrix.without_rows(coo(t), t("supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("row")))


@query(f"WITH {COO} SELECT * FROM coo WHERE abs(value) >= 50 * 0.5")
def matrix_threshold(t):
    return matrix.above(coo(t), 50, 0.5)


# ---- inversion and statistics


PLACES = "places AS (SELECT n_nationkey AS col, n_nationkey * 1.0 AS x, n_regionkey * 1.0 AS y, n_nationkey % 4 * 2.0 AS z FROM nation)"


def places(t) -> DataFrame:
    n = F.col("n_nationkey")
    return t("nation").select(n.alias("col"), (n * 1.0).alias("x"), (F.col("n_regionkey") * 1.0).alias("y"), (n % 4 * 2.0).alias("z"))


@query(f"""WITH {PLACES}, p AS (SELECT a.col AS one, b.col AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS flat, abs(a.z - b.z) AS deep FROM places a, places b)
    SELECT one, other, round(CASE WHEN one = other THEN 2.25 ELSE 4 * exp(-sqrt(flat * flat + deep * deep) / 3) END, 9) AS iso, round(CASE WHEN one = other THEN 4 ELSE 4 * exp(-flat / 3 - deep / 2) END, 9) AS separable, round(CASE WHEN one = other THEN 2.25 ELSE 4 * exp(-sqrt(pow(flat / 3, 2) + pow(deep / 2, 2))) END, 9) AS ellipsoidal FROM p""")
def cov_kernel(t):
    kinds = {"iso": ((3.0,), 1.5), "separable": ((3.0, 2.0), 0.0), "ellipsoidal": ((3.0, 2.0), 1.5)}
    out = None
    for kind, (lengths, diagonal) in kinds.items():
        found = invert.pairs(places(t), 2.0, lengths, kind, diagonal).select("one", "other", F.round("value", 9).alias(kind))
        out = found if out is None else out.join(found, ["one", "other"])
    return out


NORMAL = "eq AS (SELECT s_nationkey AS run, s_suppkey AS \"row\", s_suppkey % 4 + 1.0 AS a0, s_suppkey % 3 + 0.5 AS a1, s_acctbal / 1000 AS r, 1.0 + s_suppkey % 2 AS v FROM supplier)"


@query(f"""WITH {NORMAL}, m AS (SELECT run, sum(a0 * a0 / v) + 0.25 AS p, sum(a0 * a1 / v) AS q, sum(a1 * a1 / v) + 0.25 AS s, sum(a0 * r / v) AS b0, sum(a1 * r / v) AS b1 FROM eq GROUP BY 1)
    SELECT run, CAST(0 AS BIGINT) AS col, round((s * b0 - q * b1) / (p * s - q * q), 6) AS density, round(sqrt(s / (p * s - q * q)), 6) AS error FROM m
    UNION ALL SELECT run, CAST(1 AS BIGINT), round((p * b1 - q * b0) / (p * s - q * q), 6), round(sqrt(p / (p * s - q * q)), 6) FROM m""")
def map_solve_small(t):
    s = t("supplier")
    k = F.col("s_suppkey")
    cells = s.select(F.col("s_nationkey").alias("run"), k.alias("row"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("col"), (k % 4 + 1.0).alias("value")), F.struct(F.lit(1).cast("long").alias("col"), (k % 3 + 0.5).alias("value")))).alias("c")).select("run", "row", "c.*")
    observed = s.select(F.col("s_nationkey").alias("run"), k.alias("row"), (F.col("s_acctbal") / 1000).alias("residual"), (1.0 + k % 2).alias("variance"))
    unknowns = t("nation").filter("n_nationkey < 2").select(F.col("n_nationkey").cast("long").alias("col"), F.col("n_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("prior"))
    out = invert.solved(cells, observed, unknowns, lambda dx, dy, dz: 4.0 * (dx == 0))
    return out.select("run", "col", F.round("density", 6).alias("density"), F.round("error", 6).alias("error"))


ERRORS = "errors AS (SELECT s_suppkey, s_acctbal / 100 AS prior_low, s_acctbal / 50 AS prior_high, s_suppkey % 5 + 0.5 AS stat, s_nationkey * 0.1 AS loo FROM supplier)"


@query(f"WITH {ERRORS} SELECT s_suppkey, round(sqrt(pow(abs(prior_high - prior_low) / 2, 2) + stat * stat + loo * loo), 6) AS mixed FROM errors")
def mixed_error(t):
    e = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("prior_low"), (F.col("s_acctbal") / 50).alias("prior_high"), (F.col("s_suppkey") % 5 + 0.5).alias("stat"), (F.col("s_nationkey") * 0.1).alias("loo"))
    return invert.mixed(e).select("s_suppkey", F.round("mixed", 6).alias("mixed"))


@query("SELECT c_nationkey AS col, round(max(abs(c_acctbal - 100)), 6) AS loo FROM customer GROUP BY 1")
def loo_error_max(t):
    runs = t("customer").select(F.col("c_custkey").alias("run"), F.col("c_nationkey").cast("long").alias("col"), F.col("c_acctbal").alias("density"), F.lit(-1e9).alias("prior"))
    whole = t("nation").select(F.col("n_nationkey").cast("long").alias("col"), F.lit(100.0).alias("density"))
    return invert.largest_change(runs, whole).select(F.col("col").cast("int").alias("col"), F.round("loo", 6).alias("loo"))


@query("SELECT s_nationkey, round(sum(pow(s_acctbal / 1000, 2) / (1.0 + s_suppkey % 2)), 5) AS chi2, count(*) AS ndf, round(sum(pow(s_acctbal / 1000, 2) / (1.0 + s_suppkey % 2)) / count(*), 5) AS chi2_per_ndf FROM supplier GROUP BY 1")
def chi2(t):
    o = t("supplier").select("s_nationkey", (F.col("s_acctbal") / 1000).alias("residual"), (1.0 + F.col("s_suppkey") % 2).alias("variance"))
    return invert.chi_square(o, ["s_nationkey"]).select("s_nationkey", F.round("chi2", 5).alias("chi2"), "ndf", F.round("chi2_per_ndf", 5).alias("chi2_per_ndf"))


ERFC_SQL = "(u * exp(-x * x - 1.26551223 + u * (1.00002368 + u * (0.37409196 + u * (0.09678418 + u * (-0.18628806 + u * (0.27886807 + u * (-1.13520398 + u * (1.48851587 + u * (-0.82215223 + u * 0.17087277))))))))))"
TESTS = f"""pairs AS (SELECT event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS base, count(*) FILTER (WHERE event_id % 2 = 1 AND value > 5) AS modi FROM events GROUP BY 1),
    z AS (SELECT *, (modi - base) / sqrt(greatest(1e-12, base + modi)) AS z_val FROM pairs), q AS (SELECT *, abs(z_val) / sqrt(2) AS x, 1 / (1 + abs(z_val) / sqrt(2) / 2) AS u FROM z),
    tests AS (SELECT event_type, base, modi, round(z_val, 6) AS z_val, round({ERFC_SQL} / 2, 6) AS p_val FROM q)"""


def tests(t) -> DataFrame:
    e = t("events")
    out = e.groupBy("event_type").agg(F.count(F.when(F.col("event_id") % 2 == 0, 1)).alias("base"), F.count(F.when((F.col("event_id") % 2 == 1) & (F.col("value") > 5), 1)).alias("modi"))
    z = stats.z_value(F.col("base"), F.col("modi"))
    return out.withColumns({"z_val": F.round(z, 6), "p_val": F.round(stats.p_one_sided(z), 6)})


@query(f"WITH {TESTS} SELECT *, CASE WHEN p_val < 0.1 THEN 1 ELSE 0 END AS is_signi FROM tests")
def ztest_significance(t):
    return tests(t).withColumn("is_signi", F.when(F.col("p_val") < 0.1, 1).otherwise(0))


@query(f"WITH {TESTS} SELECT event_type, row_number() OVER (ORDER BY p_val, event_type DESC) AS place FROM tests")
def significance_sort(t):
    return _ranked(tests(t))


def _ranked(rows: DataFrame) -> DataFrame:
    """One row for each kind of event: few enough to be numbered in one place."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.orderBy("p_val", F.desc("event_type")))
    return rows.select("event_type", place.cast("long").alias("place"))


@query(f"""WITH {RASTER}, r AS (SELECT *, n * 1.0 AS signal FROM raster), w AS (SELECT size, i, CAST(floor((10 - size) / 2.0) AS INTEGER) AS x0, 11 - i * 2 AS y1 FROM (VALUES (3), (5)) AS s(size), generate_series(0, 4) AS g(i) WHERE i < greatest(1, floor((11 - size) / 2.0))),
    s AS (SELECT size, i, CAST(d AS DOUBLE) AS delta, sum(signal) AS b, sum(signal * (1 - d / 1000.0)) AS m FROM w JOIN r ON ix >= x0 AND ix < x0 + size AND iy >= y1 - size AND iy < y1, (VALUES (-300), (30)) AS k(d) GROUP BY 1, 2, 3)
    SELECT size, CAST(i AS INTEGER) AS i, delta, CAST(amp AS DOUBLE) AS signal_amp, round(b, 4) AS signal_base, round(m, 4) AS signal_modi, round((m - b) * amp / sqrt((m + b) * amp), 6) AS z_val FROM s, (VALUES (0.01), (1.0)) AS a(amp)""")
def detectability_sweep(t):
    panel = t("region").filter("r_regionkey = 0").select(F.lit(0).alias("det"), F.lit(X.nbin).alias("nx"), F.lit(Y.nbin).alias("ny"))
    bins_ = raster(t).withColumn("signal", F.col("n").cast("double"))
    out = detectability.tested(bins_, detectability.windows(panel, [3, 5], 2), [-300, 30], [0.01, 1.0], [0.3], lambda d: F.col("signal") * (1 - d / 1000))
    return out.select("size", F.col("i").cast("int").alias("i"), "delta", "signal_amp", F.round("signal_base", 4).alias("signal_base"), F.round("signal_modi", 4).alias("signal_modi"), F.round("z_val", 6).alias("z_val"))


# ---- sweeps, angles and models


@query("""WITH p AS (SELECT * FROM (VALUES (0, 2000.0), (1, 2500.0)) AS d(di, rho), (VALUES (0, 100.0), (1, 300.0)) AS s(si, sigma), (VALUES (0, 50.0), (1, 80.0)) AS l(li, length))
    SELECT CAST(di * 4 + si * 2 + li AS BIGINT) AS index, rho, sigma, length, format('sr{}_cl{}_srd{}_p{}_u{}_l{}_lat{}', CAST(sigma AS INTEGER), CAST(length AS INTEGER), CAST(sigma AS INTEGER), CAST(rho AS INTEGER), CAST(rho AS INTEGER), CAST(rho AS INTEGER), CAST(rho AS INTEGER)) AS label FROM p""")
def sweep_points(t):
    points = config.sweep_points([100.0, 300.0], [50.0, 80.0], [2000.0, 2500.0])
    rows = [(p["index"], p["density"][0], p["sigma_rho"], p["corr_length"], p["label"]) for p in points]
    return t("region").sparkSession.createDataFrame(rows, "index long, rho double, sigma double, length double, label string")


ANGLES = "ang AS (SELECT s_suppkey, (s_suppkey % 21 - 10) * 0.1 AS tx, (s_suppkey % 17 - 8) * 0.1 AS ty, s_nationkey * 0.2 AS yaw, s_suppkey % 5 * 0.1 AS roll, s_suppkey % 3 * 0.15 AS pitch FROM supplier)"


def suppliers(t) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select(k, ((k % 21 - 10) * 0.1).alias("tx"), ((k % 17 - 8) * 0.1).alias("ty"), (F.col("s_nationkey") * 0.2).alias("yaw"), (k % 5 * 0.1).alias("roll"), (k % 3 * 0.15).alias("pitch"))


def _corner_sql(a: str, b: str) -> str:
    return f"asin(({a}) * ({b}) / (sqrt(1 + ({a}) * ({a})) * sqrt(1 + ({b}) * ({b}))))"


@query(f"WITH {ANGLES} SELECT s_suppkey, round({_corner_sql('tx + 0.1', 'ty + 0.1')} - {_corner_sql('tx', 'ty + 0.1')} - {_corner_sql('tx + 0.1', 'ty')} + {_corner_sql('tx', 'ty')}, 9) AS omega FROM ang")
def solid_angle(t):
    tx, ty = F.col("tx"), F.col("ty")
    return suppliers(t).select("s_suppkey", F.round(angles.solid_angle(tx, tx + 0.1, ty, ty + 0.1), 9).alias("omega"))


@query(f"WITH {ANGLES} SELECT s_suppkey, round(1 / sqrt(1 + tx * tx + ty * ty) * (0.5 - 0.03 * abs(tx)) * (0.4 - 0.03 * abs(ty)) * 2, 9) AS area FROM ang")
def effective_area(t):
    tx, ty = F.col("tx"), F.col("ty")
    return suppliers(t).select("s_suppkey", F.round(angles.effective_area(1 / F.sqrt(1 + tx * tx + ty * ty), tx, ty, 0.5, 0.4, 0.03, 2), 9).alias("area"))


@query(f"WITH {ANGLES}, n AS (SELECT *, sqrt(tx * tx + ty * ty + 1) * CASE WHEN ty < 0 THEN -1 ELSE 1 END AS n FROM ang) SELECT s_suppkey, round(tx / n, 9) AS vx, round(1 / n, 9) AS vy, round(ty / n, 9) AS vz FROM n")
def direction_vector(t):
    v = angles.from_tangents(F.col("tx"), F.col("ty"))
    return suppliers(t).select("s_suppkey", *[F.round(c, 9).alias(n) for n, c in zip(("vx", "vy", "vz"), v, strict=True)])


@query(f"""WITH {ANGLES}, x AS (SELECT *, cos(roll) AS y1, sin(roll) AS z1 FROM ang), r AS (SELECT *, sin(pitch) * z1 AS x2, cos(pitch) * z1 AS z2 FROM x)
    SELECT s_suppkey, round(cos(yaw) * x2 - sin(yaw) * y1, 9) AS vx, round(sin(yaw) * x2 + cos(yaw) * y1, 9) AS vy, round(z2, 9) AS vz FROM r""")
def rotate_ypr(t):
    v = angles.turned(angles.rotation(F.col("yaw"), F.col("roll"), F.col("pitch")), [F.lit(0.0), F.lit(1.0), F.lit(0.0)])
    return suppliers(t).select("s_suppkey", *[F.round(c, 9).alias(n) for n, c in zip(("vx", "vy", "vz"), v, strict=True)])


@query(f"WITH {ANGLES} SELECT s_suppkey, round(degrees(atan(tx)), 9) AS deg, round(atan(tx), 9) AS rad, round(tan(radians(ty * 40)), 9) AS tangent FROM ang")
def angle_convert(t):
    tx, ty = F.col("tx"), F.col("ty")
    return suppliers(t).select("s_suppkey", F.round(angles.convert(tx, "tangent", "degree"), 9).alias("deg"), F.round(angles.convert(tx, "tangent", "radian"), 9).alias("rad"), F.round(angles.convert(ty * 40, "degree", "tangent"), 9).alias("tangent"))


@query(f"""WITH {ANGLES}, e AS (SELECT s_suppkey, greatest(0, least(1, 0.975 * (1 - 0.0195 * tx * tx) * exp(-ty * ty / 2))) AS e FROM ang), h AS (SELECT *, least(0.025, e, 1 - e) AS half FROM e)
    SELECT s_suppkey, round(e - half, 9) AS eff_low, round(e, 9) AS eff_cnt, round(e + half, 9) AS eff_upp FROM h""")
def eff_model_band(t):
    one = F.lit(1.0)
    ex = physics.efficiency("poly", F.col("tx"), {"coef": [1.0, 0.0, -0.0195]})
    ey = physics.efficiency("gauss", F.col("ty"), {"sigma": 1.0})
    band = physics.efficiency_band(0.975, ex, ey, 0.025, one, one)
    return suppliers(t).select("s_suppkey", *[F.round(c, 9).alias(n) for n, c in zip(("eff_low", "eff_cnt", "eff_upp"), band, strict=True)])


@query("SELECT s_suppkey, round(3 * pow(p, 2) * (1 - p) + pow(p, 3), 9) AS p2of3 FROM (SELECT s_suppkey, s_suppkey % 100 / 100.0 AS p FROM supplier)")
def k_of_n(t):
    return t("supplier").select("s_suppkey", F.round(physics.k_of_n(F.col("s_suppkey") % 100 / 100.0, 2, 3), 9).alias("p2of3"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice - 20000 <= 0 OR l_extendedprice - 20000 < 5000 THEN 5000.0 WHEN l_extendedprice - 20000 > 30000 THEN 30000.0 ELSE round(l_extendedprice - 20000, 2) END AS dl FROM lineitem")
def path_clamp(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", physics.clamp_path(F.round(F.col("l_extendedprice") - 20000, 2), 5000.0, 30000.0).alias("dl"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS place FROM orders")
def multi_key_sort_rank(t):
    from pyspark.sql.window import Window

    return t("orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderpriority"), "o_totalprice", "o_orderkey")).cast("long").alias("place"))


@query(None)
def poisson_draws(t):
    return t("supplier").select("s_suppkey", stats.poisson(F.abs("s_acctbal") / 100, F.col("s_suppkey")).alias("n"))


@query(f"WITH {BINS} SELECT l_orderkey, l_linenumber, round(signal + noise_poi, 4) AS expected, round(CASE WHEN signal + noise_poi < 5000 THEN -1.0 ELSE log10(signal + noise_poi) END, 6) AS log_count FROM bins")
def counts_and_logs(t):
    out = groups.expected_counts(bins(t))
    return groups.log_counts(out, F.col("expected"), 5000, -1.0).select("l_orderkey", "l_linenumber", F.round("expected", 4).alias("expected"), F.round("log_count", 6).alias("log_count"))


@query("SELECT l_orderkey, round(sum((CASE WHEN l_linenumber % 2 = 1 THEN -1 ELSE 1 END) * pow(l_quantity, 3)) * 0.01 / 3, 3) AS volume FROM lineitem GROUP BY 1")
def cone_volumes(t):
    steps = F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") % 2 == 1).alias("tf_in"), F.col("l_quantity").alias("dist"))))
    return t("lineitem").groupBy("l_orderkey").agg(steps.alias("s")).select("l_orderkey", F.round(groups.cone_volume(F.col("s"), F.lit(0.01)), 3).alias("volume"))


@query(f"WITH {CELLS} SELECT ray_id, round(sum(CASE WHEN ix % 2 = 0 THEN 0 ELSE length END), 5) AS pl FROM cells GROUP BY 1")
def left_out_paths(t):
    every = trace.crossings(rays(t), GRID)
    return groups.left_out_paths(every, every.filter("ix % 2 = 0"), ["ix", "iy"]).withColumn("pl", F.round("pl", 5))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster, interpolation at every line, and sums by group."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    points = t("lineitem").select("l_suppkey", "l_quantity", "l_discount")
    priced = lookup.interpolated(points, lookup.widened(raster(t).select("ix", "iy", "z")), X, Y, F.col("l_quantity"), F.col("l_discount"))
    return groups.sums(priced.withColumnRenamed("z", "signal"), ["l_suppkey"], ["signal"])


from tessella.plans import depth_queries, interval_queries, inversion_queries, more_queries  # noqa: E402, F401 (they register their queries)
