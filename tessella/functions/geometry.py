"""Boxes, ellipses, cylinders and rays as column expressions."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.angles import convert

INFINITY = float("inf")


def within(value: Column, low: float | Column, high: float | Column) -> Column:
    return (value >= low) & (value < high)


def in_box(point: list[Column], low: list, high: list) -> Column:
    out = F.lit(True)
    for p, a, b in zip(point, low, high, strict=True):
        out = out & within(p, a, b)
    return out


def rotated(x: Column, y: Column, angle: float) -> tuple[Column, Column]:
    """The point in axes turned by the angle."""
    c, s = math.cos(angle), math.sin(angle)
    return x * c + y * s, y * c - x * s


def in_ellipse(x: Column, y: Column, center: tuple[float, float], radii: tuple[float, float], angle: float = 0.0) -> Column:
    u, v = rotated(x - center[0], y - center[1], angle)
    return (u / radii[0]) * (u / radii[0]) + (v / radii[1]) * (v / radii[1]) <= 1


def in_ellipsoid(point: list[Column], center: list[float], radii: list[float], angle: float = 0.0) -> Column:
    u, v = rotated(point[0] - center[0], point[1] - center[1], angle)
    w = point[2] - center[2]
    return (u / radii[0]) * (u / radii[0]) + (v / radii[1]) * (v / radii[1]) + (w / radii[2]) * (w / radii[2]) <= 1


def in_cylinder(point: list[Column], center: list[float], radii: tuple[float, float], height: float, angle: float = 0.0) -> Column:
    return in_ellipse(point[0], point[1], (center[0], center[1]), radii, angle) & (F.abs(point[2] - center[2]) <= height / 2)


def in_cuboid(point: list[Column], center: list[float], sides: list[float], angle: float = 0.0) -> Column:
    u, v = rotated(point[0] - center[0], point[1] - center[1], angle)
    return (F.abs(u) <= sides[0] / 2) & (F.abs(v) <= sides[1] / 2) & (F.abs(point[2] - center[2]) <= sides[2] / 2)


def checker_sign(indices: list[Column], centers: list[int], size: int) -> Column:
    """1 and -1 by the parity of the blocks, whose sides are `size` cells."""
    blocks = sum((F.floor((i - c) / size) for i, c in zip(indices, centers, strict=True)), F.lit(0))
    return F.when(F.pmod(blocks, F.lit(2)) == 0, 1).otherwise(-1)


def _slab(point: list[Column], direction: list[Column], low: list[Column], high: list[Column]) -> tuple[Column, Column, Column]:
    """Where a ray enters and leaves a box, and whether it meets it. Every axis stands once in each, which keeps the code small enough to be compiled well."""
    inside = F.lit(True)
    enters, leaves = [F.lit(0.0)], [F.lit(INFINITY)]
    for p, v, a, b in zip(point, direction, low, high, strict=True):
        t0, t1 = F.try_divide(a - p, v), F.try_divide(b - p, v)
        moving = v != 0
        enters.append(F.when(moving, F.least(t0, t1)))  # greatest and least pass nulls over
        leaves.append(F.when(moving, F.greatest(t0, t1)))
        inside = inside & (moving | ((p >= a) & (p <= b)))
    enter, leave = F.greatest(*enters), F.least(*leaves)
    return enter, leave, inside & (leave > enter)


def slab(point: list[Column], direction: list[Column], low: list[Column], high: list[Column]) -> tuple[Column, Column]:
    """The stretch of a ray (from its point onwards) within a box, as (enter, leave); null if it misses."""
    enter, leave, hit = _slab(point, direction, low, high)
    return F.when(hit, enter), F.when(hit, leave)


def slab_length(point: list[Column], direction: list[Column], low: list[Column], high: list[Column]) -> Column:
    """The length, in the direction's units, of a ray's stretch within a box; null if it misses."""
    enter, leave, hit = _slab(point, direction, low, high)
    return F.when(hit, leave - enter)


def cylinder_chord(point: list[Column], direction: list[Column], center: tuple[float, float], radii: tuple[float, float], low: float, high: float) -> Column:
    """Length of a ray within an upright elliptic cylinder; 0 if it misses. The direction is a unit vector."""
    px, py = (point[0] - center[0]) / radii[0], (point[1] - center[1]) / radii[1]
    vx, vy = direction[0] / radii[0], direction[1] / radii[1]
    a, b, c = vx * vx + vy * vy, px * vx + py * vy, px * px + py * py - 1
    root = F.sqrt(F.greatest(b * b - a * c, F.lit(0.0)))
    meets = F.when(a > 0, b * b - a * c > 0).otherwise(c <= 0)
    s0 = F.when(a > 0, F.try_divide(-b - root, a)).otherwise(-INFINITY)
    s1 = F.when(a > 0, F.try_divide(-b + root, a)).otherwise(INFINITY)
    z0, z1 = F.try_divide(low - point[2], direction[2]), F.try_divide(high - point[2], direction[2])
    level = (point[2] >= low) & (point[2] <= high)
    c0 = F.when(direction[2] != 0, F.least(z0, z1)).otherwise(F.when(level, -INFINITY).otherwise(INFINITY))
    c1 = F.when(direction[2] != 0, F.greatest(z0, z1)).otherwise(F.when(level, INFINITY).otherwise(-INFINITY))
    return F.when(meets, F.greatest(F.lit(0.0), F.least(s1, c1) - F.greatest(s0, c0, F.lit(0.0)))).otherwise(0.0)


def cylinder_radius(length: Column, angle: Column) -> Column:
    return length * F.sin(angle)


def cylinder_angle(length: Column, radius: Column) -> Column:
    return F.asin(radius / length)


def cylinder_diameter(length: Column, step: Column, n: Column) -> Column:
    """Of a cylinder that n bins of step (radians) cover at a distance; null unless all are positive."""
    return F.when((length > 0) & (step > 0) & (n > 0), length * F.tan(step) * n)


def cylinder_range(point: list[Column], direction: list[Column], center: list[Column], diameter: Column) -> tuple[Column, Column]:
    """Lower and upper horizontal angle of a cylinder from the direction; null from within it or without a diameter."""
    dx, dy, r = center[0] - point[0], center[1] - point[1], diameter / 2
    outside = (diameter > 0) & (dx * dx + dy * dy > r * r)
    half = F.atan2(r, F.sqrt(F.greatest(F.lit(0.0), dx * dx + dy * dy - r * r)))
    middle = F.atan2(dy, dx) - F.atan2(direction[1], direction[0])
    turn = lambda a: a - 2 * math.pi * F.ceil(a / (2 * math.pi) - 0.5)  # into (-pi, pi]
    ends = turn(middle - half), turn(middle + half)
    return F.when(outside, F.least(*ends)), F.when(outside, F.greatest(*ends))


def highest_allowed(height: Column, size: Column, unit: str) -> Column:
    """The elevation above which a ray's path in an upright cylinder is shorter than its diameter (size); 0: none is allowed."""
    top = convert(F.asin(F.least(F.lit(1.0), F.try_divide(height, size))), "radian", unit)
    return F.when((size <= 0) | (height <= 0), 0.0).when(size <= height, sys.float_info.max).otherwise(top)


def candidate_angles(length: Column, limit: float, interval: Column, nbin: Column, unit: str) -> Column:
    """Multiples of a bin, in radians, as sizes to try: fewer than half the bins, up to the first that reaches the angle of
    a cylinder of diameter limit. Null from within that cylinder."""
    widest = F.when(length > limit / 2, cylinder_angle(length, F.lit(limit / 2)))
    half = F.floor(nbin / 2).cast("int")
    numbers = F.when(half > 1, F.sequence(F.lit(1), F.greatest(F.lit(1), half - 1))).otherwise(F.array().cast("array<int>"))
    tried = F.filter(numbers, lambda n: convert((n - 1) * interval, unit, "radian") < widest)
    return F.when(widest.isNotNull(), F.transform(tried, lambda n: convert(n * interval, unit, "radian")))
