"""Uniform axes: bins as column expressions. Bins are half-open, [min, max); outside is null."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Axis:
    name: str
    nbin: int
    min: float
    max: float
    #: The interval as it was given or read; without it, by the bounds.
    given: float | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.nbin < 1 or not self.max > self.min or not math.isfinite(self.max - self.min):
            raise ValueError(f"not an axis: {self}")

    @property
    def interval(self) -> float:
        return (self.max - self.min) / self.nbin if self.given is None else self.given

    def index(self, value: Column) -> Column:
        at = F.floor((value - F.lit(self.min) + F.lit(EPSILON * self.interval)) / F.lit(self.interval))
        return F.when((value >= self.min) & (value < self.max), F.least(at, F.lit(self.nbin - 1)).cast("int"))

    def lower(self, i: Column) -> Column:
        return F.lit(self.min) + i * F.lit(self.interval)

    def upper(self, i: Column) -> Column:
        return F.lit(self.min) + (i + 1) * F.lit(self.interval)

    def center(self, i: Column) -> Column:
        return F.lit(self.min) + (i + 0.5) * F.lit(self.interval)

    def nearest_edge(self, value: Column) -> Column:
        return F.lit(self.min) + F.floor((value - self.min) / self.interval + 0.5) * F.lit(self.interval)

    def split(self, factor: int) -> Axis:
        return Axis(self.name, self.nbin * factor, self.min, self.max)

    def cut(self, lower: float, upper: float, tolerance: float = 1e-9) -> Axis:
        """The bins that lie within the bounds."""
        first = max(0, math.ceil((lower - self.min) / self.interval - tolerance))
        last = min(self.nbin, math.floor((upper - self.min) / self.interval + tolerance))
        if last <= first:
            raise ValueError("no bin within the bounds")
        return Axis(self.name, last - first, self.min + first * self.interval, self.min + last * self.interval)

    def merged(self, center: float, factor: int) -> Axis:
        """Bins joined by factor, counted outwards from the one with the centre; bins left over at the ends are lost."""
        at = math.floor((center - self.min) / self.interval)
        if not 0 <= at < self.nbin:
            raise ValueError("the centre lies outside")
        below, above = at // factor, (self.nbin - 1 - at) // factor
        n = below + above
        if n < 1:
            raise ValueError("no merged bin fits")
        low = self.min + (at - below * factor) * self.interval
        return Axis(self.name, n, low, low + n * factor * self.interval)

    def same(self, other: Axis, tolerance: float = 1e-4) -> bool:
        return self.nbin == other.nbin and all(abs(a - b) <= tolerance * self.interval for a, b in ((self.min, other.min), (self.max, other.max)))
