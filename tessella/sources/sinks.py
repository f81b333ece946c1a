"""Exports: sections, element tables, matrices and significance lists."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.axis import Axis
from tessella.operators.windows import dense_numbers

#: Columns of a significance list, in order.
SIGNIFICANCE = ("det", "txL", "txU", "tyL", "tyU", "depth_anom_top", "depth_anom_btm", "obsize", "ddens", "signal_base", "signal_modi", "delta_signal", "z_val", "p_val", "alpha", "signal_amp", "is_signi")


def write_sections(cells: DataFrame, path: str) -> None:
    """One folder for each level."""
    cells.write.mode("overwrite").partitionBy("iz").parquet(path)


def sections(cells: DataFrame, x: Axis, y: Axis, z: Axis, levels: list[float], only_existing: bool = True, filler: float = 0.0, least_hits: int = 0, mask: bool = False) -> DataFrame:
    """level, iz, x, y and value of the cells that levels cut: densities, or with mask 1 where a cell exists and 0 elsewhere.

    Levels outside the grid are left out, and of those in one layer the first counts. Of densities, cells that don't exist are left out or have the filler, and so are those that fewer panels
    see than least_hits. cells: ix, iy, iz, tf_exist, density, and n_hit if there is a least.
    """
    first: dict[int, float] = {}
    for level in levels:
        if z.min <= level < z.max:
            first.setdefault(min(z.nbin - 1, math.floor((level - z.min) / z.interval)), float(level))
    at = F.create_map(*[F.lit(v) for pair in first.items() for v in pair]) if first else F.lit(None).cast("map<int,double>")
    cut = cells.filter(F.col("iz").isin(list(first)))
    if not mask:
        cut = cut.filter("tf_exist") if only_existing else cut
        cut = cut.filter(F.col("n_hit") >= least_hits) if least_hits else cut
    value = F.col("tf_exist").cast("double") if mask else F.when(F.col("tf_exist"), F.col("density")).otherwise(filler)
    return cut.select(at[F.col("iz")].alias("level"), "iz", x.center(F.col("ix")).alias("x"), y.center(F.col("iy")).alias("y"), value.alias("value"))


def write_section_list(cut: DataFrame, path: str) -> None:
    """What `sections` gives as CSV, a folder for each layer, line by line of the grid."""
    cut.repartitionByRange("iz", "y", "x").sortWithinPartitions("iz", "y", "x").write.mode("overwrite").partitionBy("iz").option("header", True).csv(path)


def write_significance(rows: DataFrame, path: str) -> None:
    """As CSV; rows whose object reaches above the surface are left out."""
    rows.filter("depth_anom_top >= 0").select(*SIGNIFICANCE).write.mode("overwrite").option("header", True).csv(path)


def write_matrix(matrix: DataFrame, path: str, epsilon: float = 0.0) -> None:
    matrix.filter(F.abs("value") > epsilon).write.mode("overwrite").parquet(path)


def write_manifest(rows: DataFrame, columns: DataFrame, path: str) -> None:
    """What rows and columns of an exported matrix are: tables beside it, and their schemas."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    columns.write.mode("overwrite").parquet(f"{path}/columns")
    schema = json.dumps({"rows": rows.schema.jsonValue(), "columns": columns.schema.jsonValue()})
    rows.sparkSession.createDataFrame([(schema,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


#: Whole numbers that a 32-bit float holds exactly.
EXACT = 1 << 24
#: Columns of an element table, in order; of a sweep's summary; of a chi-square list.
ELEMENT = ("tan_x_center", "tan_y_center", "tan_x_min", "tan_x_max", "tan_y_min", "tan_y_max", "path_length_m", "density_length_kg_m2", "penetrating_muon_flux", "signal", "noise_det", "noise_poi", "effective_area_m2", "solid_angle_sr", "exposure_time_sec", "eff_low", "eff_cnt", "eff_upp", "proj_density_kg_m3", "proj_density_lower_kg_m3", "proj_density_upper_kg_m3", "dir_vx", "dir_vy", "dir_vz", "pos_x_m", "pos_y_m", "pos_z_m")
SWEEP = ("index", "sigma_rho", "corr_length", "sigma_rho_diag", "prior_density", "shell_density_upper", "shell_density_lower", "shell_density_lateral", "label", "module8_executed")
CHI2 = ("model", "chi2_muon", "ndf_muon", "chi2_per_ndf")


def _csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_cells(cells: DataFrame, path: str, order: str = "zxy", least_hits: int = 0) -> None:
    """Cells that exist, sorted by range in an order of axes; with n_hit, only those that so many panels see."""
    kept = cells.filter("tf_exist")
    kept = kept.filter(F.col("n_hit") >= least_hits) if least_hits else kept
    kept.orderBy(*[f"i{a}" for a in order]).write.mode("overwrite").parquet(path)


def write_column_ends(cells: DataFrame, path: str) -> None:
    """Lowest and highest cell that exists of every column."""
    _csv(cells.filter("tf_exist").groupBy("ix", "iy").agg(F.min("iz").alias("iz_low"), F.max("iz").alias("iz_high")), path)


def write_coordinates(matrix: DataFrame, path: str) -> None:
    """row, col, value as 32-bit floats; an index that these don't hold exactly is an error."""
    exact = lambda c: F.when(F.col(c) < EXACT, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is beyond what a 32-bit float holds exactly")).cast("long")).cast("float").alias(c)
    matrix.select(exact("row"), exact("col"), F.col("value").cast("float").alias("value")).write.mode("overwrite").parquet(path)


def element_table(elements: DataFrame) -> DataFrame:
    """detid, inthis and the columns of an element table as 32-bit floats; those that elements doesn't have are null."""
    have = set(elements.columns)
    return elements.select("detid", "inthis", *[(F.col(c) if c in have else F.lit(None)).cast("float").alias(c) for c in ELEMENT])


def write_elements(elements: DataFrame, path: str) -> None:
    """A folder for each panel."""
    element_table(elements).write.mode("overwrite").partitionBy("detid").parquet(path)


def write_reconstruction(results: DataFrame, path: str) -> None:
    """Densities and errors of every unknown, by model."""
    results.write.mode("overwrite").partitionBy("model").parquet(path)


def chi_square_list(results: DataFrame) -> DataFrame:
    """results: model, chi2, ndf. The ratio is 0 without observations."""
    return results.select("model", F.col("chi2").alias(CHI2[1]), F.col("ndf").alias(CHI2[2]), F.coalesce(F.try_divide("chi2", "ndf"), F.lit(0.0)).alias(CHI2[3]))


def write_chi_square(results: DataFrame, path: str) -> None:
    _csv(chi_square_list(results), path)


def sweep_summary(spark: SparkSession, points: list[dict], errors: list[bool]) -> DataFrame:
    """Points of a sweep, and whether their errors were analysed."""
    rows = [(p["index"], float(p["sigma_rho"]), float(p["corr_length"]), float(p["sigma_rho_diag"]), *p["density"], p["label"], done) for p, done in zip(points, errors, strict=True)]
    kinds = ["long"] + ["double"] * 7 + ["string", "boolean"]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(SWEEP, kinds, strict=True)))


def write_sweep(spark: SparkSession, points: list[dict], errors: list[bool], path: str) -> None:
    _csv(sweep_summary(spark, points, errors), path)


def write_by_angle(elements: DataFrame, value: str, path: str) -> None:
    """tan_x_center, tan_y_center and a value (path, density length, density, signal) of every element, a folder for each panel."""
    elements.select("detid", "tan_x_center", "tan_y_center", value).write.mode("overwrite").partitionBy("detid").option("header", True).csv(path)


def write_groups(groups: DataFrame, path: str, vector: DataFrame | None = None) -> None:
    """Groups of bins, a folder for each panel; vector: detid, igroup and one more column."""
    (groups if vector is None else groups.join(vector, ["detid", "igroup"], "left")).write.mode("overwrite").partitionBy("detid").option("header", True).csv(path)


def index_table(elements: DataFrame, groups: DataFrame) -> DataFrame:
    """Every element's number over all panels (uqid), and its group's: over all groups (uqig) and over the available ones (uqig_avail, else null).

    elements: detid, ix, iy, inthis, first_uqid. groups: detid, ix, iy, igroup, is_avail.
    """
    ids = groups.groupBy("detid", "igroup").agg(F.bool_and("is_avail").alias("__on"))
    every = dense_numbers(ids, ["detid", "igroup"], "uqig").select("detid", "igroup", "uqig")
    on = dense_numbers(ids.filter("__on"), ["detid", "igroup"], "uqig_avail").select("detid", "igroup", "uqig_avail")
    placed = elements.select("detid", "ix", "iy", (F.col("first_uqid") + F.col("inthis")).cast("long").alias("uqid")).join(groups.select("detid", "ix", "iy", "igroup"), ["detid", "ix", "iy"], "left")
    return placed.join(every, ["detid", "igroup"], "left").join(on, ["detid", "igroup"], "left")


def write_index(elements: DataFrame, groups: DataFrame, path: str) -> None:
    index_table(elements, groups).write.mode("overwrite").partitionBy("detid").option("header", True).csv(path)
