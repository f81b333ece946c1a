"""Sparse matrices as tables (row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.windows import dense_numbers


def times_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """row and value of the product; vector: col, x."""
    return matrix.join(vector, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def scaled_rows(matrix: DataFrame, factors: DataFrame) -> DataFrame:
    """Rows times their factor; factors: row, factor."""
    return matrix.join(factors, "row").select("row", "col", (F.col("value") * F.col("factor")).alias("value"))


def grouped_rows(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums of rows by group; groups: row, grp."""
    return matrix.join(groups, "row").groupBy("grp", "col").agg(F.sum("value").alias("value"))


def row_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("row").agg(F.sum("value").alias("value"))


def above(matrix: DataFrame, reference: float, epsilon: float) -> DataFrame:
    return matrix.filter(F.abs("value") >= reference * epsilon)


def without_rows(matrix: DataFrame, rows: DataFrame) -> DataFrame:
    return matrix.join(rows.select("row"), "row", "left_anti")


def only_rows(matrix: DataFrame, rows: DataFrame) -> DataFrame:
    return matrix.join(rows.select("row"), "row", "left_semi")


def leave_one_out(matrix: DataFrame, owner: Column, owners: list) -> DataFrame:
    """The matrix once for each owner, without that one's rows; owners is a short list, as each is a copy."""
    return matrix.withColumn("left_out", F.explode(F.array(*[F.lit(o) for o in owners]))).filter(owner != F.col("left_out"))


def hits(matrix: DataFrame, owner: Column) -> DataFrame:
    """How many owners and rows meet each column."""
    return matrix.groupBy("col").agg(F.countDistinct(owner).alias("owners"), F.count(F.lit(1)).alias("rows"))


def renumbered(matrix: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept columns alone, with dense new numbers in the order of the old; kept: col."""
    numbers = dense_numbers(kept.select("col").distinct(), ["col"], "new")
    return matrix.join(numbers, "col").select("row", F.col("new").alias("col"), "value")


def stacked(*matrices: DataFrame) -> DataFrame:
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out


def differs(one: DataFrame, other: DataFrame, tolerance: float) -> DataFrame:
    """Cells whose values are further apart; a missing one is 0."""
    both = one.select("row", "col", F.col("value").alias("a")).join(other.select("row", "col", F.col("value").alias("b")), ["row", "col"], "full")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.select("row", "col", a.alias("a"), b.alias("b")).filter(F.abs(F.col("a") - F.col("b")) > tolerance)


def hit_between(matrix: DataFrame, owner: Column, owners: tuple[int, int], rows: tuple[int, int]) -> DataFrame:
    """col of the columns that so many owners and so many rows meet, bounds included."""
    return hits(matrix, owner).filter(F.col("owners").between(*owners) & F.col("rows").between(*rows)).select("col")


def logarithms(matrix: DataFrame) -> DataFrame:
    """Natural logarithms; a value that isn't positive is an error."""
    return matrix.withColumn("value", F.when(F.col("value") > 0, F.ln("value")).otherwise(F.raise_error(F.lit("a logarithm of what isn't positive")).cast("double")))


def quotients(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """one by other, cell by cell; null where the other is 0."""
    return one.join(other.withColumnRenamed("value", "__by"), keys).withColumn("value", F.try_divide("value", "__by")).drop("__by")


def consistent(pairs: DataFrame, one: str, many: str) -> DataFrame:
    """One row: whether each of many belongs to a single one, and no pair stands twice."""
    return pairs.agg((F.count(F.lit(1)) == F.countDistinct(many)).alias("consistent"))


def same(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows, each as often."""
    return one.exceptAll(other).unionByName(other.exceptAll(one)).agg((F.count(F.lit(1)) == 0).alias("same"))


def tuple_text(*parts: Column) -> Column:
    """A key of whole numbers as text."""
    return F.concat_ws("_", *[p.cast("long").cast("string") for p in parts])


def tuple_parts(text: Column, n: int) -> list[Column]:
    """The numbers of such a text; null if there are not as many."""
    cells = F.split(text, "_")
    return [F.when(F.size(cells) == n, F.get(cells, F.lit(i)).try_cast("long")) for i in range(n)]
