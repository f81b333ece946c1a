"""Text of numbers and lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_comment(line: Column, mark: str = "#") -> Column:
    """A line up to the mark of a comment, without blanks around."""
    return F.trim(F.substring_index(line, mark, 1))


def fields(line: Column) -> Column:
    """The parts of a line between blanks, tabs and commas; none of an empty line."""
    return F.filter(F.split(line, r"[\s,]+"), lambda x: x != "")


def decimals(number: Column) -> Column:
    """How many decimals a number is written with."""
    return F.length(F.regexp_extract(number.cast("string"), r"\.(\d+)$", 1))


def rounded(value: Column, digits: int) -> Column:
    """To a number of decimals, halves away from 0."""
    scale = 10.0**digits
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def written(value: Column, digits: int, width: int = 0) -> Column:
    """A number with fixed decimals, filled with zeros to a width."""
    return F.format_string(f"%{f'0{width}' if width else ''}.{digits}f", value.cast("double"))
