"""Statistics as column expressions, and draws that don't depend on partitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of a Chebyshev fit to log(erfc(x) / t) + x^2 in t = 1 / (1 + x / 2), from the constant up;
#: the relative error is below 1.2e-7 however far in the tail.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
LEAST_VARIANCE = 1e-12


def erfc(x: Column) -> Column:
    """erfc for x >= 0, to seven digits of its value."""
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(poly - x * x)


def erfc_exact(x: Column) -> Column:
    """erfc in full precision, by Arrow batches."""

    @F.pandas_udf("double")
    def exact(x: pd.Series) -> pd.Series:
        return x.map(math.erfc, na_action="ignore")

    return exact(x)


def z_value(base: Column, modified: Column) -> Column:
    return (modified - base) / F.sqrt(F.greatest(F.lit(LEAST_VARIANCE), base + modified))


def p_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def p_one_sided(z: Column) -> Column:
    """Half the two-sided one, whatever the sign: so a deviation in either direction can be significant."""
    return p_two_sided(z) / 2


def is_significant(one: Column, other: Column, distribution: str, alpha: float) -> Column:
    """Whether counts differ, two-sided, by the variance that a distribution gives their difference. Negative counts: null."""
    at_least = lambda x: F.greatest(F.lit(LEAST_VARIANCE), x)
    variance = {"gaussian": at_least(one) + at_least(other), "poisson": at_least(one + other), "chi_square": 2 * at_least(one)}[distribution]
    return F.when((one >= 0) & (other >= 0), p_two_sided((one - other) / F.sqrt(variance)) < alpha)


def asymmetric_gauss(x: Column, mean: float, below: float, above: float) -> Column:
    sigma = F.when(x < mean, below).otherwise(above)
    return math.sqrt(2 / math.pi) / (below + above) * F.exp(-(x - mean) * (x - mean) / (2 * sigma * sigma))


def uniform(*key: Column) -> Column:
    """A number above 0 and up to 1 that depends on the key alone."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + 1) / float(1 << 53)


def normal(*key: Column, seed: int = 42) -> Column:
    """A draw from the normal distribution that depends on the seed and the key alone."""
    one, two = (uniform(F.lit(seed), F.lit(s), *key) for s in ("one", "two"))
    return F.sqrt(-2 * F.ln(one)) * F.cos(2 * math.pi * two)


def shared_factor(parts: list[tuple[str, float, list[Column]]], seed: int = 42) -> Column:
    """A product of factors 1 + sigma times a normal draw, one for each part (a name, sigma, and the key that those who share the draw have in common).

    A part whose sigma isn't positive is 1. The draws of different parts are independent; nothing depends on partitions or order.
    """
    out = F.lit(1.0)
    for name, sigma, key in parts:
        if sigma > 0:
            out = out * (1 + sigma * normal(F.lit(name), *key, seed=seed))
    return out


def asymmetric_draw(mean: Column, below: Column, above: Column, *key: Column, seed: int = 42) -> Column:
    """A draw from asymmetric_gauss for each row that depends on the seed and the key alone: the side by its share, then half a normal one."""
    one, two, side = (uniform(F.lit(seed), F.lit(s), *key) for s in ("one", "two", "side"))
    size = F.abs(F.sqrt(-2 * F.ln(one)) * F.cos(2 * math.pi * two))
    return F.when(side <= below / (below + above), mean - below * size).otherwise(mean + above * size)


def poisson(mean: Column, *key: Column, seed: int = 42) -> Column:
    """A Poisson draw for each row that depends on the seed and the key alone."""

    @F.pandas_udf("long")
    def draw(mean: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if m is None or np.isnan(m) else int(np.random.Generator(np.random.Philox(k % 2**64)).poisson(max(0.0, m))) for m, k in zip(mean, key, strict=True)], dtype="Int64")

    return draw(mean.cast("double"), F.xxhash64(F.lit(seed), *key))
