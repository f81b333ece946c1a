"""Readers of the small files around a run: profiles, efficiencies, groups, panels, flux sources, places and dense matrices.

All go through Spark's readers, so a path may lie in any store. What is collected on the driver are headers, axes and
run cards, of which there are few.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import physics
from tessella.functions.axis import Axis
from tessella.functions.projection import TransverseMercator
from tessella.operators import grid
from tessella.plans.flux_tables import guard
from tessella.sources import config, raster

#: Characters below a blank that stand in texts.
TEXT_CONTROLS = b"\t\n\r"


def is_binary(head: bytes) -> bool:
    """Whether the first bytes of a file hold control characters that texts don't have."""
    return any(b < 32 and b not in TEXT_CONTROLS for b in head[:512])


def head(spark: SparkSession, path: str, n: int = 512) -> bytes:
    """The first bytes of the first file."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, n).alias("head")).orderBy("path").head()
    if files is None:
        raise FileNotFoundError(path)
    return bytes(files["head"])


def axis_of(points: DataFrame, column: str, tolerance: float = 1e-4, shifted: bool = True) -> Axis:
    """The axis on which a column's values stand; uneven ones are an error."""
    r = grid.infer_axis(points, column, tolerance, shifted, strict=True).first()
    return Axis(column, r["nbin"], r["min"], r["max"], r["interval"])


def gridded(points: DataFrame, tolerance: float = 1e-4, shifted: bool = True) -> tuple[DataFrame, Axis, Axis]:
    """ix, iy and z of points (x, y, z) on an even grid, and its axes. Shifted: points are centres, else lower edges."""
    x, y = axis_of(points, "x", tolerance, shifted), axis_of(points, "y", tolerance, shifted)
    half = 0.0 if shifted else 0.5
    return points.select(x.index(F.col("x") + half * x.interval).alias("ix"), y.index(F.col("y") + half * y.interval).alias("iy"), "z"), x, y


def read_terrain(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of a raster file or of a text of three columns, told apart by the first bytes."""
    if head(spark, path, 8) == raster.MAGIC:
        return raster.read_files(spark, path).select("x", "y", "z")
    if is_binary(head(spark, path)):
        raise ValueError(f"{path} is neither a raster nor a text")
    return read_xyz(spark, path)


#: Columns of coloured points.
COLOURED = ["x", "y", "z", "r", "g", "b"]


def read_xyz(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """x, y and z of a text of three columns, or of six with colours; the first line that isn't a comment tells which."""
    first = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v")).filter("v <> ''").head()
    names = COLOURED if first and len(first["v"].split()) == len(COLOURED) else COLOURED[:3]
    return raster.read_columns(spark, path, names, placed).select("x", "y", "z", *(["line"] if placed else []))


def read_coloured(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z and the colours r, g and b as whole numbers."""
    return raster.read_columns(spark, path, COLOURED).select("x", "y", "z", *[F.col(c).cast("int").alias(c) for c in "rgb"])


def read_pillars(spark: SparkSession, path: str, base: float, density: float, tolerance: float = 1e-4) -> tuple[DataFrame, Axis, Axis]:
    """Pillars of a terrain file, and their axes. Of several points in a cell that of the last line counts."""
    text = head(spark, path, 8) != raster.MAGIC
    points = read_xyz(spark, path, placed=True) if text and not is_binary(head(spark, path)) else read_terrain(spark, path)
    x, y = axis_of(points, "x", tolerance), axis_of(points, "y", tolerance)
    order = F.col("line") if "line" in points.columns else F.struct("x", "y", "z")
    return grid.last_in_cell(points, x, y, F.col("x"), F.col("y"), F.col("z"), order, base, density), x, y


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """x and y of a table of two columns, sorted by x."""
    return raster.read_columns(spark, path, ["x", "y"]).orderBy("x")


EFFICIENCY = ["tx_min", "tx_max", "ty_min", "ty_max", "eff_low", "eff_cnt", "eff_upp"]


def read_efficiencies(spark: SparkSession, path: str) -> DataFrame:
    """A table of seven columns and the line; a line of other arity is an error."""
    return raster.read_columns(spark, path, EFFICIENCY, placed=True)


def with_efficiencies(elements: DataFrame, table: DataFrame, x: Axis, y: Axis) -> DataFrame:
    """elements (ix, iy) with the efficiencies of the row whose centre lies in their bin; rows outside the panel are left out.

    Of several rows of a bin that of the last line counts; of a table without `line` the largest.
    """
    placed = table.withColumns({"ix": x.index((F.col("tx_min") + F.col("tx_max")) / 2), "iy": y.index((F.col("ty_min") + F.col("ty_max")) / 2)})
    values = F.struct(*EFFICIENCY[4:])
    last = F.max_by(values, "line") if "line" in table.columns else F.max(values)
    placed = placed.filter("ix IS NOT NULL AND iy IS NOT NULL").groupBy("ix", "iy").agg(last.alias("e")).select("ix", "iy", "e.*")
    return elements.join(placed, ["ix", "iy"], "left")


def read_groups(spark: SparkSession, path: str) -> tuple[Axis, Axis, DataFrame]:
    """The axes of the first two lines (bins, least, largest, interval) and the rectangles with their counts below: igroup, xmin, xmax, ymin, ymax, signal."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "v")).withColumn("v", F.trim("v")).filter("v <> ''")
    parts = lines.withColumn("c", F.split("v", r"[\s,]+"))
    axes = []
    for name, r in zip("xy", parts.orderBy("line").limit(2).collect(), strict=True):
        if len(r["c"]) != 4:
            raise ValueError(f"an axis needs four numbers: {r['v']}")
        axes.append(Axis(name, int(r["c"][0]), float(r["c"][1]), float(r["c"][2]), float(r["c"][3])))
    names = ("xmin", "xmax", "ymin", "ymax", "signal")
    wrong = F.when(F.size("c") == 5, F.col("line") - 2).otherwise(F.raise_error(F.concat(F.lit("a group needs five numbers: "), "v")).cast("int"))
    return axes[0], axes[1], parts.filter("line >= 2").select(wrong.alias("igroup"), *[F.col("c")[i].cast("double").alias(n) for i, n in enumerate(names)])


#: What run cards of panels hold, by the names that elements() takes them under.
CARD = {"nbinx": "nbinx", "txmin": "txmin", "txmax": "txmax", "nbiny": "nbiny", "tymin": "tymin", "tymax": "tymax", "length_hori": "hori", "length_vert": "vert", "length_dept": "dept", "n_unit": "n_unit", "x": "px", "y": "py", "z": "pz", "days": "days"}
ANGLES = {"yaw_deg": "yaw", "roll_deg": "roll", "pitch_deg": "pitch"}


def panels(spark: SparkSession, cards: list[str]) -> DataFrame:
    """A row for each run card (its text), with detid in order, the angles in radians, and first_uqid, from which its elements are numbered."""
    rows, first = [], 0
    for detid, text in enumerate(cards):
        card = config.loads(text)["DETECTOR_PARAMETERS"]
        row = {"detid": detid, "name": card["name"], "angle_unit": card.get("angle_unit", "tangent").lower(), "rotation": card.get("rotation_type", "LOCAL").lower(), "first_uqid": first}
        row |= {to: int(card[k]) if k.startswith("n") else float(card[k]) for k, to in CARD.items()} | {to: float(np.radians(card.get(k, 0.0))) for k, to in ANGLES.items()}
        rows.append(row | {"path_eff_table": card.get("path_eff_table"), "path_eff_model": card.get("path_eff_model")})
        first += row["nbinx"] * row["nbiny"]
    whole, text = {"detid", "first_uqid", "nbinx", "nbiny", "n_unit"}, {"name", "angle_unit", "rotation", "path_eff_table", "path_eff_model"}
    schema = ", ".join(f"{k} {'int' if k in whole else 'string' if k in text else 'double'}" for k in (rows[0] if rows else {"detid": 0}))
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def read_panels(spark: SparkSession, path: str) -> DataFrame:
    """`panels` of all files of a path, in the order of their names."""
    return panels(spark, [r["value"] for r in spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p")).orderBy("p").collect()])


def read_model(spark: SparkSession, path: str) -> dict:
    """An efficiency model, as functions.physics.efficiency_model takes it."""
    return config.loads(spark.read.text(path, wholetext=True).head()["value"])


@dataclass
class FluxTables:
    """Tables by cosine (ix) and density length (iy): log10 of the flux, and its slope; and the bounds that density lengths are held to."""

    flux: DataFrame | None
    slope: DataFrame | None
    x: Axis | None
    y: Axis | None
    low: float
    high: float


def _raster(spark: SparkSession, path: str) -> tuple[DataFrame | None, Axis | None, Axis | None]:
    if path == "none":
        return None, None, None
    content = spark.read.format("binaryFile").load(path).select("content").head()["content"]
    _, x, y, z = raster.loads(bytes(content))  # a table of cosines and ranges, which the driver holds
    j, i = np.divmod(np.arange(z.size), x.nbin)
    return spark.createDataFrame(pd.DataFrame({"ix": i.astype("int32"), "iy": j.astype("int32"), "z": z.ravel()})), x, y


def load_flux_tables(spark: SparkSession, flux: str, slope: str, low: float | None = None, high: float | None = None, fatal: bool = True, most_flips: float = 0.05) -> FluxTables:
    """Both tables, either of which may be `none`. Bounds that aren't given are the table's; the slope goes through the guard."""
    f, fx, fy = _raster(spark, flux)
    s, sx, sy = _raster(spark, slope)
    if s is not None:
        guard(s.select(F.col("ix").alias("ic"), F.col("iy").alias("ir"), "z"), most_flips=most_flips, fatal=fatal).collect()
    x, y = fx or sx, fy or sy
    bound = lambda given, own: own if given is None else given
    return FluxTables(f, s, x, y, bound(low, y.min if y else 0.0), bound(high, y.max if y else float("inf")))


def read_flux_source(spark: SparkSession, path: str) -> DataFrame:
    """log10p, cos, log10ke and dfde of a source table of log10 of momentum, cosine and flux for each momentum and square centimetre."""
    rows = raster.read_columns(spark, path, ["log10p", "cos", "dfdp"])
    p = F.pow(F.lit(10.0), F.col("log10p"))
    return rows.select("log10p", "cos", F.log10(F.greatest(F.lit(1e-10), physics.kinetic(p))).alias("log10ke"), physics.per_energy(F.col("dfdp"), p).alias("dfde"))


def read_range_source(spark: SparkSession, path: str) -> DataFrame:
    """t_mev and range (g/cm2) of a printed table: lines of nine and more numbers, the first and the ninth; the first of equal energies."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "v"))
    c = F.split(F.trim("v"), r"\s+")
    found = lines.filter(F.size(c) >= 9).select("line", c[0].try_cast("double").alias("t_mev"), c[8].try_cast("double").alias("range")).filter("t_mev IS NOT NULL AND range IS NOT NULL")
    return found.withColumn("k", F.row_number().over(Window.partitionBy("t_mev").orderBy("line"))).filter("k = 1").select("t_mev", "range")


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through nodes whose third derivative doesn't jump at the second and the last but one; y may have more columns."""
    n, h = len(x), np.diff(x)
    if n < 4:
        raise ValueError("a spline needs four nodes")
    d = np.diff(y, axis=0) / h.reshape(-1, *[1] * (y.ndim - 1))
    a, b = np.zeros((n, n)), np.zeros((n, *y.shape[1:]))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (d[i] - d[i - 1])
    a[0, :3], a[-1, -3:] = (h[1], -h[0] - h[1], h[0]), (h[-1], -h[-2] - h[-1], h[-2])
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    wide = lambda v: v.reshape(-1, *[1] * (y.ndim - 1))
    p, q, w = wide(x[i + 1] - at), wide(at - x[i]), wide(h[i])
    return (m[i] * p**3 + m[i + 1] * q**3) / (6 * w) + (y[i] / w - m[i] * w / 6) * p + (y[i + 1] / w - m[i + 1] * w / 6) * q


def range_table(source: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """x (log10 of GeV) and y (log10 of kg/m2) on an even axis, by a spline through the source, which must reach over the axis."""
    rows = source.orderBy("t_mev").toPandas()  # a printed table
    x = np.log10(rows["t_mev"].to_numpy() / 1000)
    if x[0] > low or x[-1] < high:
        raise ValueError("the source doesn't reach over the axis")
    at = low + step * np.arange(round((high - low) / step) + 1)
    return source.sparkSession.createDataFrame(pd.DataFrame({"x": at, "y": spline(x, np.log10(rows["range"].to_numpy()), at) + 1.0}))


def regridded_flux(source: DataFrame, cosines: np.ndarray, energies: np.ndarray) -> DataFrame:
    """cos, log10ke and log10 of dfde on other axes: cubic along the cosine, linear along the energy, through every node (no smoothing)."""
    rows = source.orderBy("cos", "log10ke").toPandas()  # a source table
    c, e = np.unique(rows["cos"]), np.unique(rows["log10ke"])
    if len(c) * len(e) != len(rows):
        raise ValueError("the source isn't an even grid")
    z = spline(c, np.log10(np.maximum(1e-30, rows["dfde"].to_numpy().reshape(len(c), len(e)))), cosines)
    i = np.clip(np.searchsorted(e, energies, "right") - 1, 0, len(e) - 2)
    f = (energies - e[i]) / (e[i + 1] - e[i])
    out = z[:, i] * (1 - f) + z[:, i + 1] * f
    return source.sparkSession.createDataFrame(pd.DataFrame({"cos": np.repeat(cosines, len(energies)), "log10ke": np.tile(energies, len(cosines)), "log10_dfde": out.ravel()}))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """name, lon, lat and elev of the places with a point."""
    marks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<Placemark\b.*?</Placemark>"), F.lit(0))).alias("m"))
    name = F.trim(F.regexp_replace(F.regexp_extract("m", r"(?s)<name>(.*?)</name>", 1), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))
    c = F.split(F.trim(F.regexp_extract("m", r"(?s)<Point\b.*?<coordinates>(.*?)</coordinates>", 1)), r"\s*,\s*")
    return marks.select(name.alias("name"), *[F.get(c, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("lon", "lat", "elev"))]).filter("lon IS NOT NULL AND lat IS NOT NULL")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """name, lon, lat and elev of the point features of a collection, or of a single feature."""
    feature = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:struct<name:string,title:string>>"
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"struct<type:string,features:array<{feature}>>")
    single = F.from_json("value", feature)
    listed = text.select(F.explode(F.when(whole["type"] == "Feature", F.array(single)).otherwise(whole["features"])).alias("f")).filter("f.geometry.type = 'Point'")
    c = F.from_json("f.geometry.coordinates", "array<double>")
    name = F.trim(F.coalesce(F.nullif("f.properties.name", F.lit("")), "f.properties.title", F.lit("")))
    return listed.select(name.alias("name"), *[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(("lon", "lat", "elev"))]).filter("lon IS NOT NULL AND lat IS NOT NULL")


def relative_to(places: DataFrame, x: Column, y: Column, z: Column, to: tuple[float, float, float]) -> DataFrame:
    """places with azimuth (degrees from +y, clockwise), distance, rise, elevation (degrees) and tangent of a reference as seen from them.

    x and y are in metres: coordinates are projected before, as seen_from does.
    """
    dx, dy, rise = to[0] - x, to[1] - y, to[2] - z
    distance = F.hypot(dx, dy)
    tangent = F.try_divide(rise, distance)
    return places.withColumns({"azimuth": F.degrees(F.atan2(dx, dy)), "distance": distance, "rise": rise, "elevation": F.degrees(F.atan(tangent)), "tangent": tangent})


#: What a name may hold by which the reference among places is known.
REFERENCE = ("vent", "crater", "summit", "center", "main", "reference", "target")


def seen_from(places: DataFrame, projection: TransverseMercator, keywords: tuple[str, ...] = REFERENCE) -> DataFrame:
    """places (name, lon, lat, elev; of read_kml or read_geojson) with x and y in metres and what relative_to adds, towards the reference.

    The reference is the first place, by name, whose name holds one of the keywords; without any it is an error, as every row depends on it.
    """
    east, north = projection.forward(F.col("lon"), F.col("lat"))
    known = places.withColumns({"x": east, "y": north})
    named = F.lit(False)
    for k in keywords:
        named = named | F.col("name").contains(k)
    target = known.filter(named).orderBy("name", "lon", "lat").head()  # one row
    if target is None:
        raise ValueError(f"no place is named after one of {', '.join(keywords)}")
    return relative_to(known, F.col("x"), F.col("y"), F.col("elev"), (target["x"], target["y"], float("nan") if target["elev"] is None else target["elev"]))


def matrix_bytes(values: np.ndarray) -> bytes:
    """A dense matrix as a file has it: rows and columns as 64-bit numbers, then 32-bit floats column by column."""
    return struct.pack("<QQ", *values.shape) + np.asfortranarray(values, "<f4").tobytes(order="F")


def read_matrix(spark: SparkSession, path: str, epsilon: float = 0.0) -> DataFrame:
    """row, col, value of dense matrix files, without what isn't larger than epsilon; a file is read as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, cols = struct.unpack_from("<QQ", content)
                if len(content) != 16 + 4 * rows * cols:
                    raise ValueError("a matrix file that is cut off or too long")
                for a in range(0, cols, max(1, 1_000_000 // max(1, rows))):
                    b = min(cols, a + max(1, 1_000_000 // max(1, rows)))
                    part = np.frombuffer(content, "<f4", rows * (b - a), 16 + 4 * rows * a).reshape(b - a, rows)
                    c, r = np.nonzero(np.abs(part) > epsilon)
                    yield pd.DataFrame({"row": r, "col": c + a, "value": part[c, r].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, col long, value double")
