"""More operators as queries over the stand-in tables: panels' groups, priors, depth sweeps, keys and texts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import angles, geometry, physics, stats, text
from tessella.functions.axis import Axis
from tessella.operators import grid, groups, invert, lookup, matrix, trace, windows
from tessella.plans import detectability, flux_tables, reconstruction
from tessella.plans.queries import ANGLES, BINS, CELLS, COO, GRID, PART, PRICE, RASTER, RECTANGLES, SIZE, TESTS, X, Y, bins, coo, parts, query, raster, rays, rectangles, suppliers, tests
from tessella.sources import raster as raster_source
from tessella.sources import sinks, tables


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- predicates and projections


@query(f"WITH {PART} SELECT p_partkey FROM part_cells WHERE pow(1.0 + (ix + 0.5) * 5.0 - 25.0, 2) + pow(900.0 + (iy + 0.5) * 5.0 - 950.0, 2) <= 400")
def cells_in_circle(t):
    return grid.in_circle(parts(t), SIZE, PRICE, (25.0, 950.0), 20.0).select("p_partkey")


@query(f"WITH {PART} SELECT p_partkey FROM part_cells WHERE 1.0 + (ix + 0.5) * 5.0 >= 8.5 AND 1.0 + (ix + 0.5) * 5.0 < 28.5 AND 900.0 + (iy + 0.5) * 5.0 >= 920 AND 900.0 + (iy + 0.5) * 5.0 < 962.5")
def cells_in_rectangle(t):
    return grid.in_rectangle(parts(t), SIZE, PRICE, (8.5, 920.0), (28.5, 962.5)).select("p_partkey")


SOLID = f"{RASTER}, solid AS (SELECT ix, iy, CAST(iz AS INTEGER) AS iz FROM raster, generate_series(0, 7) AS g(iz))"


def solid(t) -> DataFrame:
    return raster(t).select("ix", "iy", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("iz"))


@query(f"""WITH {SOLID}, c AS (SELECT *, ix + 0.5 AS x, iy + 0.5 AS y, iz + 0.5 AS z FROM solid)
    SELECT ix, iy, iz FROM c WHERE x >= 1 AND x < 9 AND y >= 2 AND y < 9 AND z >= 2 AND z < 6 AND pow((x - 5.0) / 3.5, 2) + pow((y - 5.5) / 2.5, 2) <= 1""")
def reconstruction_mask(t):
    axes = [Axis("x", 10, 0.0, 10.0), Axis("y", 11, 0.0, 11.0), Axis("z", 8, 0.0, 8.0)]
    return grid.reconstructed(solid(t), axes, (5.0, 5.5, 4.0), (8.0, 7.0, 4.0), (3.5, 2.5))


@query(f"WITH {SOLID} SELECT ix, iy, iz FROM solid WHERE pow((ix - 4.5) / 3.0, 2) + pow((iy - 5.0) / 4.0, 2) + pow((iz - 3.5) / 3.0, 2) <= 1")
def mask_ellipsoid(t):
    return solid(t).filter(geometry.in_ellipsoid([F.col("ix"), F.col("iy"), F.col("iz")], [4.5, 5.0, 3.5], [3.0, 4.0, 3.0]))


@query(f"WITH {SOLID}, r AS (SELECT *, (ix - 4.5) * cos(0.5) + (iy - 5.0) * sin(0.5) AS u, (iy - 5.0) * cos(0.5) - (ix - 4.5) * sin(0.5) AS v FROM solid) SELECT ix, iy, iz, abs(u) <= 3 AND abs(v) <= 2 AND abs(iz - 3.5) <= 2 AS in_cuboid, pow(u / 3.0, 2) + pow(v / 4.0, 2) <= 1 AND abs(iz - 3.5) <= 2 AS in_cylinder FROM r")
def mask_cuboid_cylinder(t):
    p = [F.col("ix"), F.col("iy"), F.col("iz")]
    return solid(t).select("ix", "iy", "iz", geometry.in_cuboid(p, [4.5, 5.0, 3.5], [6.0, 4.0, 4.0], 0.5).alias("in_cuboid"), geometry.in_cylinder(p, [4.5, 5.0, 3.5], (3.0, 4.0), 4.0, 0.5).alias("in_cylinder"))


@query(f"WITH {COO}, h AS (SELECT col, count(DISTINCT s_nationkey) AS owners, count(*) AS n FROM coo JOIN supplier ON s_suppkey = \"row\" GROUP BY 1) SELECT col FROM h WHERE owners BETWEEN 2 AND 20 AND n BETWEEN 3 AND 25")
def hit_filter(t):
    owned = coo(t).join(t("supplier").select(F.col("s_suppkey").alias("row"), "s_nationkey"), "row")
    return matrix.hit_between(owned, F.col("s_nationkey"), (2, 20), (3, 25))


@query(f"WITH {BINS} SELECT l_orderkey, l_linenumber, CASE WHEN pl < 10 OR dl < 20 THEN -1.0 ELSE dl / pl END AS density, greatest(CAST(0 AS DOUBLE), dl - 30) AS changed FROM bins")
def projected_density(t):
    b = bins(t)
    return b.select("l_orderkey", "l_linenumber", physics.projected_density(F.col("pl"), F.col("dl"), 10, 20).alias("density"), physics.changed_path(F.col("dl"), F.lit(-30)).alias("changed"))


@query(f"WITH {BINS} SELECT l_orderkey, l_linenumber, round(greatest(5 * (1 + 1e-8), least(60 * (1 - 1e-8), dl)), 9) AS dl FROM bins")
def table_clamp(t):
    return bins(t).select("l_orderkey", "l_linenumber", F.round(physics.clamp_to_table(F.col("dl"), 5.0, 60.0), 9).alias("dl"))


# ---- groups


@query(f"WITH {BINS} SELECT l_suppkey, round(avg(noise_poi), 6) AS eff_low, round(avg(noise_det), 6) AS eff_cnt, round(avg(pl), 6) AS eff_upp FROM bins GROUP BY 1")
def group_mean_efficiency(t):
    out = groups.mean_efficiency(bins(t).withColumnsRenamed({"noise_poi": "eff_low", "noise_det": "eff_cnt", "pl": "eff_upp"}), ["l_suppkey"])
    return rounded(out, 6, "eff_low", "eff_cnt", "eff_upp")


@query("SELECT o_custkey, round(sum((pow(o_totalprice / 1000 + 5, 3) - pow(o_totalprice / 1000, 3)) * 0.001 / 3), 3) AS volume FROM orders GROUP BY 1")
def group_volumes(t):
    d = F.col("o_totalprice") / 1000
    through = F.array(F.struct(F.lit(True).alias("tf_in"), d.alias("dist")), F.struct(F.lit(False).alias("tf_in"), (d + 5).alias("dist")))
    return rounded(groups.volumes(t("orders"), ["o_custkey"], through, F.lit(0.001)), 3, "volume")


@query(f"WITH {BINS} SELECT l_suppkey, round(coalesce(sum(signal) FILTER (WHERE dl >= 30), 0), 2) AS signal, round(coalesce(sum(noise_poi) FILTER (WHERE dl >= 30), 0), 4) AS noise_poi FROM bins GROUP BY 1")
def totals_above(t):
    out = groups.totals(bins(t), ["l_suppkey"], ["signal", "noise_poi"], 30)
    return rounded(rounded(out, 2, "signal"), 4, "noise_poi")


@query(f"""WITH {BINS}, w AS (SELECT *, sum(signal) FILTER (WHERE dl >= 30) OVER (PARTITION BY l_suppkey) AS s, sum(pl) FILTER (WHERE dl >= 30) OVER (PARTITION BY l_suppkey) AS p FROM bins)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN dl >= 30 THEN signal * 0.1 + pl / p * s * 0.02 ELSE noise_det END, 5) AS noise_det, round(CASE WHEN dl >= 30 THEN signal * 0.05 + pl / p * s * 0.03 ELSE noise_poi END, 5) AS noise_poi FROM w""")
def noise_by_flux_and_exposure(t):
    out = groups.with_noise(bins(t).withColumn("sot", F.col("pl")), ["l_suppkey"], 0.1, 0.05, 0.02, 0.03, 30)
    return rounded(out.select("l_orderkey", "l_linenumber", "noise_det", "noise_poi"), 5, "noise_det", "noise_poi")


@query(f"""WITH {PART}, r AS (SELECT n_nationkey AS rect_id, n_nationkey % 7 = 3 AS excluded, n_nationkey % 5 * 10.0 AS xlow, n_nationkey % 5 * 10.0 + 12 AS xup, floor(n_nationkey / 5.0) * 400.0 AS ylow, floor(n_nationkey / 5.0) * 400.0 + 400 AS yup FROM nation),
    h AS (SELECT p_partkey, min(rect_id) AS rect_id FROM part JOIN r ON p_size >= xlow AND p_size < xup AND p_retailprice >= ylow AND p_retailprice < yup GROUP BY 1)
    SELECT p_partkey, rect_id FROM h JOIN r USING (rect_id) WHERE NOT excluded""")
def manual_groups(t):
    n = F.col("n_nationkey")
    r = t("nation").select(n.alias("rect_id"), (n % 7 == 3).alias("excluded"), (n % 5 * 10.0).alias("xlow"), (n % 5 * 10.0 + 12).alias("xup"), (F.floor(n / 5) * 400.0).alias("ylow"), (F.floor(n / 5) * 400.0 + 400).alias("yup"))
    first = lookup.first_rectangle_of_all(t("part"), r, F.col("p_size"), F.col("p_retailprice"), ["p_partkey"])
    return groups.all_grouped(t("part"), first, ["p_partkey"])


@query(f"WITH {RASTER} SELECT CAST(floor(ix / 4.0) + floor(iy / 4.0) * 3 AS INTEGER) AS igroup, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1, count(*) AS n, true AS is_rect FROM raster GROUP BY 1")
def group_sizes_checked(t):
    return groups.checked_sizes(groups.initial(raster(t), 10, 11, 3, 3), ["igroup"], 2, 3)


@query(None)
def groups_merged_from_seeds(t):
    b = groups.initial(raster(t), 10, 11, 5, 6).select(F.lit(0).alias("panel"), "ix", "iy", "igroup", F.col("n").alias("weight"))
    return groups.merged_small(b, "panel", 2000)


@query("""WITH c AS (SELECT l_suppkey AS g, sum(1000 * exp(-l_quantity * 1.3 / 20)) AS n FROM lineitem GROUP BY 1)
    SELECT g, 'center' AS band, round(n, 3) AS target FROM c UNION ALL SELECT g, 'lower', round(n + 2 * sqrt(n + 4), 3) FROM c UNION ALL SELECT g, 'upper', round(greatest(0, n - 2 * sqrt(n + 4)), 3) FROM c""")
def density_bands(t):
    counts = t("lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.sum(1000 * F.exp(-F.col("l_quantity") * 1.3 / 20)).alias("n"))
    return rounded(groups.density_targets(counts, 2.0, F.lit(4.0)), 3, "target")


@query("""WITH b AS (SELECT l_suppkey AS g, l_quantity AS pl FROM lineitem), c AS (SELECT g, sum(1000 * exp(-pl * 1.3 / 20)) AS target FROM b GROUP BY 1),
    n1 AS (SELECT g, rho, sum(1000 * exp(-pl * rho / 20)) AS n FROM b, (SELECT 0.5 + i * 0.5 AS rho FROM generate_series(0, 5) AS s(i)) GROUP BY 1, 2),
    r1 AS (SELECT g, CAST(arg_min(rho, (abs(n - target), rho)) AS DOUBLE) AS rho, min(abs(n - target)) AS off FROM n1 JOIN c USING (g) GROUP BY 1),
    g2 AS (SELECT g, r1.off, r1.rho AS r, greatest(0.5, r1.rho - 0.125) + i * 0.125 AS rho, least(3.0, r1.rho + 0.125) AS high FROM r1, generate_series(0, 2) AS s(i)),
    n2 AS (SELECT g2.g, g2.off, r, g2.rho, sum(1000 * exp(-pl * g2.rho / 20)) AS n FROM g2 JOIN b USING (g) WHERE g2.rho <= high GROUP BY 1, 2, 3, 4),
    r2 AS (SELECT g, any_value(r) AS r, any_value(off) AS off, CAST(arg_min(rho, (abs(n - target), rho)) AS DOUBLE) AS rho, min(abs(n - target)) AS best FROM n2 JOIN c USING (g) GROUP BY 1)
    SELECT g, round(CASE WHEN best < off THEN rho ELSE r END, 6) AS rho, round(least(off, best), 3) AS off FROM r2""")
def adaptive_density(t):
    b = t("lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("pl"))
    target = b.groupBy("g").agg(F.sum(1000 * F.exp(-F.col("pl") * 1.3 / 20)).alias("target"))
    out = groups.adaptive_density(b, ["g"], 0.5, 3.0, 0.5, 0.01, 4.0, 2, 1000 * F.exp(-F.col("pl") * F.col("rho") / 20), target)
    return rounded(rounded(out, 6, "rho"), 3, "off")


@query("""WITH b AS (SELECT l_returnflag, l_suppkey AS igroup, sum(l_extendedprice + l_tax * 100) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, arg_min(igroup, (n, igroup)) AS least, arg_min(igroup, (-n, igroup)) AS most FROM b GROUP BY 1""")
def group_extremes(t):
    b = t("lineitem").select("l_returnflag", F.col("l_suppkey").alias("igroup"), F.col("l_extendedprice").alias("signal"), (F.col("l_tax") * 100).alias("noise_poi"))
    return groups.extremes(b, "l_returnflag")


@query(f"WITH {BINS} SELECT l_orderkey, l_linenumber, round(signal * 0.75, 4) AS signal, round(pl * 0.75, 6) AS sot FROM bins")
def exposure_override(t):
    out = groups.exposed(bins(t).withColumn("sot", F.col("pl")), F.lit(120.0), F.lit(90.0))
    return rounded(rounded(out.select("l_orderkey", "l_linenumber", "signal", "sot"), 4, "signal"), 6, "sot")


@query("SELECT n_nationkey, 64 AS nbinx, -0.8 AS txmin, 0.8 AS txmax, 32 AS nbiny, 0.0 AS tymin, 0.8 AS tymax FROM nation")
def binning_override(t):
    p = t("nation").select("n_nationkey", F.lit(320).alias("nbinx"), F.lit(-1.6).alias("txmin"), F.lit(1.6).alias("txmax"), F.lit(160).alias("nbiny"), F.lit(0.0).alias("tymin"), F.lit(1.6).alias("tymax"))
    return groups.rebinned(p, (64, -0.8, 0.8), (32, 0.0, 0.8))


@query("SELECT p_partkey, p_brand, p_size % 5 AS igroup FROM part")
def copied_grouping(t):
    other = t("part").select("p_partkey", (F.col("p_size") % 5).alias("igroup"))
    return groups.regrouped(t("part").select("p_partkey", "p_brand", F.lit(-1).alias("igroup")), other, ["p_partkey"], ["igroup"])


@query("SELECT o_custkey, o_orderkey, o_totalprice AS value, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place FROM orders")
def signal_vector(t):
    return groups.vector(t("orders"), ["o_custkey", "o_orderkey"], F.col("o_totalprice"))


@query("SELECT o_orderkey, round(o_totalprice - o_custkey, 4) AS pl, round(o_totalprice * 2 - o_custkey * 3, 4) AS dl FROM orders")
def combined_paths(t):
    one = t("orders").select("o_orderkey", F.col("o_totalprice").alias("pl"), (F.col("o_totalprice") * 2).alias("dl"))
    other = t("orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("pl"), (F.col("o_custkey") * 3.0).alias("dl"))
    return rounded(groups.combined_paths(one, other, ["o_orderkey"], -1.0), 4, "pl", "dl")


@query(f"""WITH {PART}, ids AS (SELECT p_partkey, ix, iy, CAST(floor(ix / 4.0) AS INTEGER) AS igroup FROM part_cells WHERE ix IS NOT NULL AND iy IS NOT NULL), g AS (SELECT DISTINCT igroup FROM ids), on_ AS (SELECT igroup, row_number() OVER (ORDER BY igroup) - 1 AS a FROM g WHERE igroup % 2 = 0), every AS (SELECT igroup, row_number() OVER (ORDER BY igroup) - 1 AS u FROM g),
    cells AS (SELECT DISTINCT ix, iy, igroup FROM ids)
    SELECT CAST(0 AS INTEGER) AS detid, igroup, ix, iy, CAST(7 + ix + iy * 10 AS BIGINT) AS uqid, u AS uqig, a AS uqig_avail FROM cells JOIN every USING (igroup) LEFT JOIN on_ USING (igroup)""")
def index_numbers(t):
    cells = parts(t).filter("ix IS NOT NULL AND iy IS NOT NULL").select(F.lit(0).alias("detid"), "ix", "iy").distinct()
    elements = cells.withColumns({"inthis": F.col("ix") + F.col("iy") * 10, "first_uqid": F.lit(7)})
    igroup = F.floor(F.col("ix") / 4).cast("int")
    return sinks.index_table(elements, cells.withColumns({"igroup": igroup, "is_avail": igroup % 2 == 0}))


# ---- terrain


@query(f"""WITH {RASTER}, c AS (SELECT n_nationkey % 5 * 8.0 + 5 AS cx, floor(n_nationkey / 5.0) * 0.02 + 0.01 AS cy, n_nationkey % 3 * 4.0 AS radius FROM nation),
    m AS (SELECT cx, cy, radius, z, pow(1.0 + (ix + 0.5) * 5.0 - cx, 2) + pow(-0.005 + (iy + 0.5) * {Y.interval!r} - cy, 2) <= radius * radius AS inside, ix = floor((cx - 1.0) / 5.0) AND iy = floor((cy + 0.005) / {Y.interval!r} + 1e-9) AS here FROM raster, c)
    SELECT cx, cy, radius, coalesce(min(z) FILTER (WHERE inside), min(z) FILTER (WHERE here)) AS zmax FROM m GROUP BY 1, 2, 3""")
def lowest_top_in_circle(t):
    n = F.col("n_nationkey")
    circles = t("nation").select((n % 5 * 8.0 + 5).alias("cx"), (F.floor(n / 5) * 0.02 + 0.01).alias("cy"), (n % 3 * 4.0).alias("radius")).distinct()
    return grid.lowest_top(raster(t).select("ix", "iy", F.col("z").alias("zmax")), X, Y, circles)


@query(f"""WITH {RASTER}, m AS (SELECT z / 1e8 * 25 AS volume, z / 1e8 * 25 * 2.0 AS mass FROM raster UNION ALL SELECT 125, 125 * (1 + ix * 0.1) FROM raster WHERE iy % 2 = 0)
    SELECT round(sum(volume), 3) AS volume, round(sum(mass), 3) AS mass, round(sum(mass) / sum(volume), 9) AS density FROM m""")
def average_density(t):
    shell = raster(t).select(F.lit(0.0).alias("zmin"), (F.col("z") / 1e8).alias("zmax"), F.lit(2.0).alias("density"))
    cells = raster(t).select((F.col("iy") % 2 == 0).alias("tf_exist"), (1 + F.col("ix") * 0.1).alias("density"))
    return rounded(rounded(grid.average_density(shell, cells, 25.0, 125.0), 3, "volume", "mass"), 9, "density")


@query(f"WITH {RASTER} SELECT ix, iy, CASE WHEN floor(ix / 2.0) < 3 THEN floor(ix / 2.0) * 100.0 + 5 ELSE 0.0 END AS zmin, z AS zmax FROM raster")
def single_shell(t):
    pillars = raster(t).select("ix", "iy", F.lit(0.0).alias("zmin"), F.col("z").alias("zmax"))
    wide = Axis("x", 5, X.min, X.max)
    columns = pillars.select(F.floor(F.col("ix") / 2).cast("int").alias("ix"), "iy").distinct().filter("ix < 3").withColumn("z_high", F.col("ix") * 100.0 + 5)
    return grid.single_shell(pillars, columns, X, Y, wide, Y)


@query(f"WITH {RASTER} SELECT iy, z FROM raster WHERE ix = 4")
def column_slice(t):
    return grid.nearest_slice(raster(t), X, 22.0)


@query(f"WITH {RASTER} SELECT a.iy, round(a.z * 0.4 + b.z * 0.6, 3) AS z FROM raster a JOIN raster b ON a.iy = b.iy AND b.ix = a.ix + 1 WHERE a.ix = 4")
def interpolated_slice(t):
    return rounded(grid.interpolated_slice(raster(t), X, 24.0), 3, "z")


@query(f"WITH {RASTER} SELECT ix, iy, n FROM raster WHERE ix = 3")
def grid_slice(t):
    return raster(t).filter("ix = 3").select("ix", "iy", "n")


@query("SELECT s_suppkey, round(800 - (s_suppkey + 100 * tan((s_suppkey % 17 - 8) * 0.1)), 6) AS depth FROM supplier")
def depth_below_surface(t):
    return suppliers(t).select("s_suppkey", F.round(physics.depth_below(F.lit(800.0), F.col("s_suppkey"), F.lit(100.0), F.col("ty")), 6).alias("depth"))


# ---- rays


STRETCHES = f"""{CELLS}, st AS (SELECT ray_id, t AS t0, u AS t1, floor(px + (t + u) / 2 * vx) AS ix, floor(py + (t + u) / 2 * vy) AS iy FROM steps JOIN bound USING (ray_id) WHERE u > t + 1e-9),
    m AS (SELECT *, CAST(ix + iy AS INTEGER) % 3 <> 0 AS inside FROM st), k AS (SELECT *, lag(inside) OVER (PARTITION BY ray_id ORDER BY t0) AS before, lead(inside) OVER (PARTITION BY ray_id ORDER BY t0) AS after FROM m WHERE true)"""


@query(f"""WITH {STRETCHES} SELECT ray_id, count(*) AS n, round(min(d), 6) AS first, round(sum(CASE WHEN tf_in THEN -d ELSE d END), 5) AS length FROM
    (SELECT ray_id, true AS tf_in, t0 AS d FROM k WHERE inside AND NOT coalesce(before, false) UNION ALL SELECT ray_id, false, t1 FROM k WHERE inside AND NOT coalesce(after, false)) GROUP BY 1""")
def ray_transitions(t):
    found = trace.stretches(rays(t), GRID).filter("t1 > t0 + 1e-9")
    out = windows.transitions(found, (F.col("ix") + F.col("iy")) % 3 != 0)
    length = F.aggregate("changes", F.lit(0.0), lambda s, x: s + F.when(x["tf_in"], -1.0).otherwise(1.0) * x["dist"])
    return out.select("ray_id", F.size("changes").cast("long").alias("n"), F.round(F.col("changes")[0]["dist"], 6).alias("first"), F.round(length, 5).alias("length"))


@query(f"""WITH {STRETCHES}, s AS (SELECT ray_id, t0, t1, (2.0 + CAST(ix + iy AS INTEGER) % 3 - 1.5) / 0.25 AS top FROM st) SELECT ray_id, round(sum(least(t1, top) - t0), 5) AS pl FROM s WHERE least(t1, top) > t0 GROUP BY 1""")
def pillar_paths(t):
    """Rays that rise from 1.5 through pillars of 2, 3 and 4."""
    pillars = t("region").limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("ix")).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(11))))
    pillars = pillars.select("ix", "iy", F.lit(0.0).alias("zmin"), (2.0 + (F.col("ix") + F.col("iy")) % 3).alias("zmax"))
    found = trace.pillar_stretches(rays(t).withColumns({"pz": F.lit(1.5), "vz": F.lit(0.25)}), *GRID, pillars)
    return rounded(found.groupBy("ray_id").agg(F.sum(F.col("t1") - F.col("t0")).alias("pl")), 5, "pl")


@query(None)
def asymmetric_draws(t):
    return t("supplier").select("s_suppkey", stats.asymmetric_draw(F.lit(1.0), F.lit(0.5), F.lit(2.0), F.col("s_suppkey")).alias("x"))


@query("""WITH r AS (SELECT o_orderkey, (o_custkey % 10 + 0.5 - 5) / 2.5 AS p, (o_orderkey % 7 - 3) * 0.11 / 2.5 AS w, 1 / 3.0 AS v, -6 / 3.0 AS q FROM orders),
    k AS (SELECT o_orderkey, v * v + w * w AS a, q * v + p * w AS b, q * q + p * p - 1 AS c FROM r)
    SELECT o_orderkey, round(CASE WHEN b * b - a * c > 0 THEN greatest(0, (-b + sqrt(b * b - a * c)) / a - greatest((-b - sqrt(b * b - a * c)) / a, 0)) ELSE 0 END, 6) AS length FROM (SELECT *, 1 FROM k) WHERE true""")
def cylinder_chords(t):
    p = t("orders").select("o_orderkey", (F.col("o_custkey") % 10 + 0.5).alias("y"), ((F.col("o_orderkey") % 7 - 3) * 0.11).alias("vy"))
    chord = geometry.cylinder_chord([F.lit(-6.0), F.col("y"), F.lit(1.0)], [F.lit(1.0), F.col("vy"), F.lit(0.0)], (0.0, 5.0), (3.0, 2.5), 0.0, 3.0)
    return p.select("o_orderkey", F.round(chord, 6).alias("length"))


# ---- priors and matrices


@query("""WITH p AS (SELECT l_orderkey AS ray_id, l_quantity AS pl, CASE l_linenumber % 5 WHEN 0 THEN 2000 WHEN 1 THEN 1800 WHEN 2 THEN 1900 WHEN 3 THEN 2100 ELSE 2000 END AS rho FROM lineitem)
    SELECT ray_id, round(sum(pl), 4) AS pl, round(sum(pl * rho), 3) AS dl FROM p GROUP BY 1""")
def rebuilt_prior(t):
    p = t("lineitem").select(F.col("l_orderkey").alias("ray_id"), F.col("l_quantity").alias("pl"), (F.col("l_linenumber") % 5).alias("k"))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in ((1, "upper"), (2, "lower"), (3, "lateral")) for x in pair]), F.col("k"))
    out = reconstruction.rebuilt_prior(p.filter("k IN (1, 2, 3)").withColumn("kind", kind), p.filter("k = 0"), p.filter("k = 4"), (2000.0, 1800.0, 1900.0, 2100.0))
    return rounded(rounded(out, 4, "pl"), 3, "dl")


@query(f"""WITH {COO}, d AS (SELECT "row", sum(value * (1 + col % 3)) AS dl FROM coo GROUP BY 1)
    SELECT "row", col, round(value * -exp(-dl / 100000) * s_acctbal, 6) AS value FROM coo JOIN d USING ("row") JOIN supplier ON s_suppkey = "row" """)
def relinearised_matrix(t):
    densities = t("part").select(F.col("p_partkey").alias("col"), (1.0 + F.col("p_partkey") % 3).alias("x"))
    sot = t("supplier").select(F.col("s_suppkey").alias("row"), F.col("s_acctbal").alias("sot"))
    return rounded(reconstruction.relinearised(coo(t), densities, -F.exp(-F.col("dl") / 100000), sot), 6, "value")


@query(f"WITH {COO} SELECT \"row\", round(sum(value), 3) AS value FROM coo GROUP BY 1")
def matrix_row_sums(t):
    return rounded(matrix.row_sums(coo(t)), 3, "value")


@query(f"WITH {COO} SELECT \"row\", col, round(ln(value), 9) AS value FROM coo")
def matrix_logarithms(t):
    return rounded(matrix.logarithms(coo(t)), 9, "value")


@query(f"WITH {COO} SELECT \"row\", col, round(value / nullif(CAST(col % 4 AS DOUBLE), 0), 9) AS value FROM coo")
def safe_quotients(t):
    other = coo(t).withColumn("value", (F.col("col") % 4).cast("double"))
    return rounded(matrix.quotients(coo(t), other, ["row", "col"]), 9, "value")


@query(f"WITH {COO} SELECT * FROM coo WHERE \"row\" % 2 = 0 UNION ALL SELECT \"row\", col, value FROM coo WHERE \"row\" % 2 = 1")
def matrix_append(t):
    return matrix.stacked(coo(t).filter("row % 2 = 0"), coo(t).filter("row % 2 = 1"))


@query(f"WITH {COO} SELECT \"row\", col, value AS a, value + CASE WHEN col % 9 = 0 THEN 1 ELSE 0 END AS b FROM coo WHERE col % 9 = 0")
def matrix_differences(t):
    return matrix.differs(coo(t), coo(t).withColumn("value", F.col("value") + F.when(F.col("col") % 9 == 0, 1).otherwise(0)), 1e-6)


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def ids_of_a_panel(t):
    return t("lineitem").filter("l_returnflag = 'R'").select("l_suppkey").distinct()


@query("SELECT count(*) = count(DISTINCT o_orderkey) AS consistent FROM orders")
def bimap_consistent(t):
    return matrix.consistent(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT true AS same")
def tables_equal(t):
    return matrix.same(t("part"), t("part").repartition(3))


@query("SELECT l_orderkey, l_linenumber, l_orderkey || '_' || l_linenumber || '_' || l_suppkey AS key, l_suppkey AS third FROM lineitem")
def tuple_keys(t):
    out = t("lineitem").select("l_orderkey", "l_linenumber", matrix.tuple_text(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")).alias("key"))
    return out.withColumn("third", matrix.tuple_parts(F.col("key"), 3)[2])


# ---- fluxes, angles and statistics


@query("SELECT s_suppkey, round(sqrt(p * p + 0.105658 * 0.105658) - 0.105658, 9) AS ke, round(3 * 10000 * sqrt(p * p + 0.105658 * 0.105658) / p, 6) AS dfde FROM (SELECT s_suppkey, (s_suppkey + 1) * 0.1 AS p FROM supplier)")
def kinetic_energy(t):
    p = (F.col("s_suppkey") + 1) * 0.1
    return t("supplier").select("s_suppkey", F.round(physics.kinetic(p), 9).alias("ke"), F.round(physics.per_energy(F.lit(3.0), p), 6).alias("dfde"))


FLUX = "nodes AS (SELECT CAST(c AS INTEGER) AS ic, e * 0.1 AS log_e, -1.0 - c * 0.05 - 1.7 * e * 0.1 + 0.1 * e * 0.1 * e * 0.1 AS value FROM generate_series(0, 9) AS a(c), generate_series(0, 30) AS b(e)), cut AS (SELECT n_nationkey AS ir, n_nationkey * 0.113 AS log_e FROM nation)"


def flux(t) -> tuple[DataFrame, DataFrame]:
    spark = t("nation").sparkSession
    e = F.col("e") * 0.1
    nodes = spark.range(10).select(F.col("id").cast("int").alias("ic"), F.explode(F.sequence(F.lit(0), F.lit(30))).alias("e"))
    return nodes.select("ic", e.alias("log_e"), (-1.0 - F.col("ic") * 0.05 - 1.7 * e + 0.1 * F.col("e") * 0.1 * F.col("e") * 0.1).alias("value")), t("nation").select(F.col("n_nationkey").alias("ir"), (F.col("n_nationkey") * 0.113).alias("log_e"))


@query(f"""WITH {FLUX}, s AS (SELECT ic, ir, CAST(k AS INTEGER) AS k, greatest(cut.log_e, 0) + k * 0.02 AS x FROM (SELECT DISTINCT ic FROM nodes), cut, generate_series(0, 150) AS g(k) WHERE k <= floor((3.0 - 1e-12 - greatest(cut.log_e, 0)) / 0.02)),
    v AS (SELECT s.ic, ir, k, pow(10, x) AS e, pow(10, a.value + (x * 10 - least(29, floor(x * 10))) * (b.value - a.value)) AS f FROM s JOIN nodes a ON a.ic = s.ic AND round(a.log_e * 10) = least(29, floor(x * 10)) JOIN nodes b ON b.ic = s.ic AND round(b.log_e * 10) = least(29, floor(x * 10)) + 1),
    p AS (SELECT ic, ir, (e - lag(e) OVER w) * (f + lag(f) OVER w) / 2 AS piece FROM v WINDOW w AS (PARTITION BY ic, ir ORDER BY k))
    SELECT ic, ir, round(log10(sum(piece)), 6) AS log_f FROM p GROUP BY 1, 2""")
def flux_integrals(t):
    return rounded(flux_tables.integrals(*flux(t), 0.02), 6, "log_f")


@query("SELECT CAST(0 AS BIGINT) AS broken, CAST(0.0 AS DOUBLE) AS positive, CAST(0.0 AS DOUBLE) AS flips, false AS divergent")
def flux_guard(t):
    return flux_tables.guard(flux_tables.derivatives(flux_tables.integrals(*flux(t), 0.02), 1.0))


@query(f"""WITH {ANGLES} SELECT s_suppkey, round(exp(-pow(tx - 0.1, 2) / 0.5), 9) AS gauss, round(CASE WHEN atan(abs(tx)) > radians(35) THEN 0 ELSE pow(cos(atan(abs(tx))), 2) END, 9) AS cos_power, round(1 / (1 + exp((abs(tx) - 0.5) / 0.1)), 9) AS sigmoid, round(0.2 + 0.7 / (1 + exp((abs(tx) - 0.6) / 0.05)), 9) AS step FROM ang""")
def efficiency_functions(t):
    given = {"gauss": {"mu": 0.1, "sigma": 0.5}, "cos_power": {"n": 2.0, "cutoff_deg": 35.0}, "sigmoid": {"x0": 0.5, "w": 0.1}, "step": {"x0": 0.6, "w": 0.05, "inner": 0.9, "outer": 0.2}}
    return suppliers(t).select("s_suppkey", *[F.round(physics.efficiency(k, F.col("tx"), p), 9).alias(k) for k, p in given.items()])


@query(f"WITH {ANGLES}, e AS (SELECT *, abs(ty) AS el, CASE WHEN sin(ty) < 0 THEN -1 ELSE 1 END AS s FROM ang) SELECT s_suppkey, round(s * cos(ty) * sin(tx), 9) AS vx, round(s * cos(ty) * cos(tx), 9) AS vy, round(s * sin(ty), 9) AS vz FROM e")
def direction_from_azimuth(t):
    v = angles.from_azimuth(F.col("tx"), F.col("ty"))
    return suppliers(t).select("s_suppkey", *[F.round(c, 9).alias(n) for n, c in zip(("vx", "vy", "vz"), v, strict=True)])


@query(f"""WITH {ANGLES}, n AS (SELECT *, sqrt(tx * tx + 1) AS n FROM ang) SELECT s_suppkey, round((3 * tx + 4) / n, 9) AS radial, round((3 * 1 - 4 * tx) / n, 9) AS lateral, round(atan2(tx, 1), 9) AS azimuth, round(acos(greatest(-1, least(1, (tx * 0.6 + 0.8) / n))), 7) AS angle FROM n""")
def radial_lateral(t):
    tx, one, zero = F.col("tx"), F.lit(1.0), F.lit(0.0)
    along, across = angles.radial_lateral([tx, one], [F.lit(3.0), F.lit(4.0)])
    norm = F.sqrt(tx * tx + 1)
    between = angles.between([tx / norm, one / norm, zero], [F.lit(0.6), F.lit(0.8), zero])
    return suppliers(t).select("s_suppkey", F.round(along, 9).alias("radial"), F.round(across, 9).alias("lateral"), F.round(angles.azimuth([tx, one, zero]), 9).alias("azimuth"), F.round(between, 7).alias("angle"))


@query(f"""WITH {ANGLES}, b AS (SELECT *, sqrt(1 + tx * tx) AS n FROM ang) SELECT s_suppkey, round(tx / n * 0.5 + 0.5 / n, 9) AS vx, round(0.5 / n - tx / n * 0.5, 9) AS vy, round(0.25, 9) AS vz FROM b""")
def aimed_panel(t):
    """All directions of a panel turned about the vertical, from north to (1, tx)."""
    tx = F.col("tx")
    n = F.sqrt(1 + tx * tx)
    v = angles.aimed([F.lit(0.5), F.lit(0.5), F.lit(0.25)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)], [tx / n, 1 / n, F.lit(0.0)])
    return suppliers(t).select("s_suppkey", *[F.round(c, 9).alias(k) for k, c in zip(("vx", "vy", "vz"), v, strict=True)])


@query("""WITH s AS (SELECT s_suppkey, 100 + s_suppkey * 3.0 AS height, s_suppkey % 20 * 40.0 AS size FROM supplier)
    SELECT s_suppkey, round(CASE WHEN size <= 0 THEN 0 WHEN size <= height THEN 99 ELSE tan(asin(height / size)) END, 9) AS ty_max, round(size * sin(0.1), 9) AS radius, round(size * tan(0.02) * 3, 9) AS diameter FROM s""")
def cylinder_angles(t):
    s = t("supplier").select("s_suppkey", (100 + F.col("s_suppkey") * 3.0).alias("height"), (F.col("s_suppkey") % 20 * 40.0).alias("size"))
    diameter = F.coalesce(geometry.cylinder_diameter(F.col("size"), F.lit(0.02), F.lit(3)), F.lit(0.0))
    return s.select("s_suppkey", F.round(F.least(F.lit(99.0), geometry.highest_allowed(F.col("height"), F.col("size"), "tangent")), 9).alias("ty_max"), F.round(geometry.cylinder_radius(F.col("size"), F.lit(0.1)), 9).alias("radius"), F.round(diameter, 9).alias("diameter"))


@query("""WITH s AS (SELECT s_suppkey, 50 + s_suppkey % 37 * 10.0 AS length FROM supplier), k AS (SELECT s_suppkey, length, CAST(n AS INTEGER) AS n FROM s, generate_series(1, 19) AS g(n) WHERE length > 30 AND atan((n - 1) * 0.02) < asin(30 / length))
    SELECT s_suppkey, n, round(atan(n * 0.02), 9) AS angle FROM k""")
def candidate_sizes(t):
    s = t("supplier").select("s_suppkey", (50 + F.col("s_suppkey") % 37 * 10.0).alias("length"))
    out = s.select("s_suppkey", F.posexplode(geometry.candidate_angles(F.col("length"), 60.0, F.lit(0.02), F.lit(40), "tangent")).alias("n", "angle"))
    return out.select("s_suppkey", (F.col("n") + 1).alias("n"), F.round("angle", 9).alias("angle"))


@query("""WITH p AS (SELECT s_suppkey AS det, 0.05e0 + s_suppkey % 3 * 0.05e0 AS half, 0.803e0 + s_suppkey % 4 * 0.13e0 AS ty_max, 40.3e0 + s_suppkey % 11 * 10 AS height, 1e2 AS distance, 7e0 AS rise FROM supplier),
    w AS (SELECT *, CAST(i AS INTEGER) AS k, ty_max - half - i * 0.1e0 AS middle FROM p, generate_series(0, 15) AS g(i) WHERE i < greatest(1, floor((ty_max - half - (0e0 + half)) / 0.1e0)))
    SELECT det, k AS i, round(middle - half, 9) AS ty0, round(middle + half, 9) AS ty1, round(height - (middle + half) * distance + rise, 6) AS depth_top, round(height - (middle - half) * distance + rise, 6) AS depth_bottom FROM w WHERE height - (middle + half) * distance >= 0""")
def depth_windows(t):
    k = F.col("s_suppkey")
    p = t("supplier").select(k.alias("det"), (0.05 + k % 3 * 0.05).alias("half"), F.lit(0.0).alias("ty_min"), (0.803 + k % 4 * 0.13).alias("ty_max"), (40.3 + k % 11 * 10).alias("height"), F.lit(100.0).alias("distance"), F.lit(7.0).alias("rise"))
    out = detectability.depth_windows(p, 0.1).select("det", "i", "ty0", "ty1", "depth_top", "depth_bottom")
    return rounded(rounded(out, 9, "ty0", "ty1"), 6, "depth_top", "depth_bottom")


@query("""WITH p AS (SELECT n_nationkey AS det, 80 + n_nationkey * 5.0 AS distance, n_nationkey * 2.0 AS elev_det FROM nation),
    a AS (SELECT *, atan(n * 0.02) AS angle, 2 * distance * sin(atan(n * 0.02)) AS size, 60 - elev_det AS height FROM p, generate_series(1, 19) AS g(n) WHERE atan((n - 1) * 0.02) < asin(15 / distance)),
    f AS (SELECT *, CASE WHEN height <= 0 THEN 0 WHEN size <= height THEN 99 ELSE tan(asin(height / size)) END AS allowed FROM a WHERE size >= 5 AND size <= 66 - elev_det)
    SELECT det, round(size, 6) AS size, round(tan(angle) * 0.5, 9) AS half, round(least(1.0, allowed), 6) AS ty_max FROM f WHERE least(1.0, allowed) > 0""")
def cylinder_tries(t):
    n = F.col("n_nationkey")
    p = t("nation").select(n.alias("det"), (80 + n * 5.0).alias("distance"), F.lit(0.02).alias("interval"), F.lit(40).alias("nbin"), F.lit(0.0).alias("ty_min"), F.lit(1.0).alias("ty_max"), (n * 2.0).alias("elev_det"), F.lit(60.0).alias("elev_object"), F.lit(66.0).alias("elev_surface"))
    out = detectability.cylinder_tries(p, "tangent", 5.0, 30.0, 0.5).select("det", "size", "half", "ty_max")
    return rounded(rounded(out, 6, "size", "ty_max"), 9, "half")


@query(f"""WITH {TESTS}, h AS (SELECT CAST(length(event_type) % 3 AS INTEGER) AS ix, CAST(base % 2 AS INTEGER) AS iy, log10(greatest(1e-10, least(1.0, p_val))) AS l FROM tests) SELECT ix, iy, round(avg(l), 6) AS mean, round(min(l), 6) AS least FROM h GROUP BY 1, 2""")
def detection_heat_map(t):
    r = tests(t).withColumns({"signal_amp": F.lit(1.0), "delta": F.lit(-300.0)})
    x, y = Axis("x", 3, 0.0, 3.0), Axis("y", 2, 0.0, 2.0)
    out = detectability.heat_map(r, x, y, (F.length("event_type") % 3).cast("double"), (F.col("base") % 2).cast("double"), 1.0, -300.0)
    return rounded(out, 6, "mean", "least")


@query("""WITH c AS (SELECT s_suppkey, s_suppkey % 50 + 100.0 AS a, s_suppkey % 31 + 110.0 AS b FROM supplier), z AS (SELECT *, abs(a - b) / sqrt(a + b) AS g, abs(a - b) / sqrt(2 * a) AS c FROM c)
    SELECT s_suppkey, g > 1.2815515655446004 AS gaussian, g > 1.2815515655446004 AS poisson, c > 1.2815515655446004 AS chi_square FROM z""")
def significance_kinds(t):
    s = t("supplier").select("s_suppkey", (F.col("s_suppkey") % 50 + 100.0).alias("a"), (F.col("s_suppkey") % 31 + 110.0).alias("b"))
    return s.select("s_suppkey", *[stats.is_significant(F.col("a"), F.col("b"), k, 0.2).alias(k) for k in ("gaussian", "poisson", "chi_square")])


@query("SELECT s_suppkey, round(sqrt(2 / pi()) / 0.5 * exp(-pow(x - 0.1, 2) / (2 * pow(CASE WHEN x < 0.1 THEN 0.2 ELSE 0.3 END, 2))), 9) AS pdf FROM (SELECT s_suppkey, (s_suppkey % 21 - 10) * 0.1 AS x FROM supplier)")
def asymmetric_gauss(t):
    return suppliers(t).select("s_suppkey", F.round(stats.asymmetric_gauss(F.col("tx"), 0.1, 0.2, 0.3), 9).alias("pdf"))


@query("SELECT s_suppkey, round(degrees(atan2(100 - s_suppkey, 50 + s_nationkey)), 6) AS azimuth, round(sqrt(pow(100 - s_suppkey, 2) + pow(50 + s_nationkey, 2)), 6) AS distance, round(300.0 - s_nationkey, 6) AS rise, round((300 - s_nationkey) / sqrt(pow(100 - s_suppkey, 2) + pow(50 + s_nationkey, 2)), 9) AS tangent FROM supplier")
def relative_places(t):
    out = tables.relative_to(t("supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey"), -F.col("s_nationkey"), F.col("s_nationkey"), (100.0, 50.0, 300.0))
    return out.select("s_suppkey", F.round("azimuth", 6).alias("azimuth"), F.round("distance", 6).alias("distance"), F.round("rise", 6).alias("rise"), F.round("tangent", 9).alias("tangent"))


# ---- order and text


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_size, p_partkey) - 1 AS place FROM part")
def sorted_points(t):
    """Points by y, then x, then z."""
    return windows.dense_numbers(t("part").select("p_retailprice", "p_size", "p_partkey"), ["p_retailprice", "p_size", "p_partkey"], "place").select("p_partkey", "place")


@query("SELECT s_suppkey, length(split_part(CAST(s_acctbal AS VARCHAR), '.', 2)) AS decimals, round(floor(abs(s_acctbal) * 10 + 0.5) / 10 * sign(s_acctbal), 6) AS rounded, printf('%09.2f', s_acctbal) AS written, trim(split_part(s_name || ' // ' || s_suppkey, '//', 1)) AS cut FROM supplier")
def text_of_numbers(t):
    s = t("supplier")
    line = F.concat("s_name", F.lit(" // "), F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", text.decimals(F.col("s_acctbal")).cast("long").alias("decimals"), F.round(text.rounded(F.col("s_acctbal"), 1), 6).alias("rounded"), text.written(F.col("s_acctbal"), 2, 9).alias("written"), text.without_comment(line, "//").alias("cut"))


@query(f"WITH {RECTANGLES} SELECT count(*) AS n, round(sum((xup - xlow) * (yup - ylow)), 3) AS area FROM rects")
def rectangles_measured(t):
    return rectangles(t).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum((F.col("xup") - F.col("xlow")) * (F.col("yup") - F.col("ylow"))), 3).alias("area"))


@query(f"WITH {RASTER} SELECT ix, iy, round(log10(z), 9) AS log, round(pow(10, z / 1e7), 9) AS power FROM raster")
def raster_logarithms(t):
    return raster(t).select("ix", "iy", F.round(F.log10("z"), 9).alias("log"), F.round(F.pow(F.lit(10.0), F.col("z") / 1e7), 9).alias("power"))


@query(None)
def nonnegative_solution(t):
    s, k = t("supplier"), F.col("s_suppkey")
    cells = s.select(F.col("s_nationkey").alias("run"), k.alias("row"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("col"), (k % 4 + 1.0).alias("value")), F.struct(F.lit(1).cast("long").alias("col"), (k % 3 + 0.5).alias("value")))).alias("c")).select("run", "row", "c.*")
    seen = s.select(F.col("s_nationkey").alias("run"), k.alias("row"), (F.col("s_acctbal") / 1000).alias("value"))
    unknowns = t("nation").filter("n_nationkey < 2").select(F.col("n_nationkey").cast("long").alias("col"), F.lit(1.0).alias("prior"))
    return invert.solved_nonnegative(cells, seen, unknowns, 0.5).withColumn("density", F.round("density", 5))



@query(None)
def tutorial_paths(t):
    """Paths, density lengths and expected counts of 11 panels of 320 x 160 bins through a cone of 10 m cells, summed by panel and group of 4 x 4 bins."""
    spark = t("region").sparkSession
    x = y = Axis("x", 41, -205.0, 205.0)
    pillars = raster_source.synthetic_terrain(spark, "cone", 41, 120.0, 200.0, 10.0).filter("z > 0")
    pillars = pillars.select("ix", "iy", F.lit(0.0).alias("zmin"), F.col("z").alias("zmax"), F.lit(2000.0).alias("density"))
    z = Axis("z", 13, 0.0, 130.0)
    cells = grid.voxels(pillars, z).filter("density > 0")
    k = F.col("id")
    azimuth = k * (2 * math.pi / 11)
    place = {"px": -200 * F.sin(azimuth), "py": -200 * F.cos(azimuth), "pz": F.lit(1.0), "yaw": azimuth, "roll": F.lit(0.0), "pitch": F.lit(0.0)}
    card = {"nbinx": 320, "txmin": -1.6, "txmax": 1.6, "nbiny": 160, "tymin": 0.0, "tymax": 1.6, "hori": 0.333, "vert": 0.333, "dept": 0.03, "n_unit": 2, "days": 120.0}
    panels = spark.range(11).select(k.cast("int").alias("detid"), *[v.alias(n) for n, v in place.items()], *[F.lit(v).alias(n) for n, v in card.items()])
    # a panel's directions by ten lines of bins a task
    rays_ = reconstruction.elements(panels).repartition(176, "detid", F.floor(F.col("iy") / 10))
    flux_ = F.lit(1e-2) * (0.2 + F.col("vz")) * F.pow(1 + F.col("dl") / 1e5, F.lit(-2.0))
    counted = reconstruction.counts(rays_, trace.traced(rays_, [x, y, z]), cells, flux_).filter("pl > 0")
    group = groups.initial(counted, 320, 160, 80, 40)
    out = group.groupBy("detid", "igroup").agg(F.count(F.lit(1)).alias("bins"), F.sum("pl").alias("pl"), F.sum("dl").alias("dl"), F.sum("n").alias("n"))
    return rounded(rounded(out, 3, "pl", "dl"), 6, "n")
