"""Penetrating-flux tables: threshold energies, integrals above them, derivatives and their guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.lookup import inverse, segments
from tessella.operators.windows import finite_difference, sign_flips

#: Below the highest energy, so that no look-up reaches it.
HAIR = 1e-12


def thresholds(ranges: DataFrame, log_range: DataFrame) -> DataFrame:
    """log10 of the energy with each range: the first root of the profile. ranges: ir, r; log_range: x (energy), y (range)."""
    roots = inverse(ranges.withColumn("level", F.log10("r")), segments(log_range), F.col("level"))
    return roots.groupBy("ir", "r").agg(F.min("x").alias("log_e"))


def integrals(flux: DataFrame, cut: DataFrame, step: float = 0.005) -> DataFrame:
    """ic, ir, log_f: the integral of 10^value over energies from the threshold up, by trapezoids.

    flux: ic, log_e, value: a profile on even energies for each ic. cut: ir, log_e: the thresholds. From a threshold (the lowest energy at least)
    the integrand is taken at every `step` by linear interpolation of its logarithm, as far as whole steps go below the highest energy;
    without a whole step it is minus infinity. A profile travels as one array, as long as its axis, so nothing is joined by ranges.
    """
    profile = F.array_sort(F.collect_list(F.struct("log_e", "value")))
    lines = flux.groupBy("ic").agg(profile.alias("p")).select("ic", F.col("p.log_e").alias("__e"), F.col("p.value").alias("__v")).filter(F.size("__e") > 1)
    low, high = F.col("__e")[0], F.element_at("__e", -1)
    lines = lines.withColumns({"__low": low, "__high": high, "__d": (high - low) / (F.size("__e") - 1)})
    met = lines.crossJoin(F.broadcast(cut.select("ir", "log_e")) if cut.count() <= 100_000 else cut.select("ir", "log_e"))
    met = met.withColumn("__from", F.greatest("log_e", "__low")).withColumn("__n", F.floor((F.col("__high") - HAIR - F.col("__from")) / step).cast("int"))

    def at(k: Column) -> Column:
        place = (F.col("__from") + k * step - F.col("__low")) / F.col("__d")
        i = F.least(F.size("__v") - 2, F.floor(place).cast("int"))
        return F.pow(F.lit(10.0), F.get("__v", i) + (place - i) * (F.get("__v", i + 1) - F.get("__v", i)))

    energy = lambda k: F.pow(F.lit(10.0), F.col("__from") + k * step)
    first = F.struct(at(F.lit(0)).alias("f"), energy(F.lit(0)).alias("e"), F.lit(0.0).alias("sum"))

    def add(a: Column, k: Column) -> Column:
        f, e = at(k), energy(k)
        return F.struct(f.alias("f"), e.alias("e"), (a["sum"] + (a["f"] + f) * (e - a["e"]) / 2).alias("sum"))

    whole = F.when(F.col("__n") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("__n"))), first, add, lambda a: a["sum"])).otherwise(0.0)
    return met.withColumn("__sum", whole).select("ic", "ir", F.when(F.col("__sum") > 0, F.log10("__sum")).otherwise(float("-inf")).alias("log_f"))


def derivatives(table: DataFrame, step: float) -> DataFrame:
    """ic, ir, z: forward differences of 10^log_f along the range."""
    return finite_difference(table.withColumn("f", F.pow(F.lit(10.0), F.col("log_f"))), "f", "ir", ["ic"], step).select("ic", "ir", F.col("derivative").alias("z"))


def guard(table: DataFrame, most_positive: float = 0.01, most_flips: float = 0.05, fatal: bool = True) -> DataFrame:
    """One row: broken, positive, flips, divergent. Values that aren't finite always raise an error; divergence if fatal."""
    lines = sign_flips(table, F.col("z"), ["ic"], ["ir"])
    out = lines.agg(F.sum("broken").alias("broken"), F.try_divide(F.sum(F.col("positive") * F.col("n")), F.sum("n")).alias("positive"), F.max("flips").alias("flips"))
    out = out.withColumn("divergent", (F.col("positive") > most_positive) | (F.col("flips") > most_flips))
    bad = (F.col("broken") > 0) | (F.col("divergent") & F.lit(fatal))
    return out.withColumn("divergent", F.when(bad, F.raise_error(F.lit("a derivative table that isn't finite or diverges")).cast("boolean")).otherwise(F.col("divergent")))
