"""Angles, directions and solid angles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("tangent", "degree", "radian")


def convert(value: Column, unit: str, to: str) -> Column:
    radian = {"tangent": F.atan, "degree": F.radians, "radian": lambda x: x}[unit](value)
    return value if unit == to else {"tangent": F.tan, "degree": F.degrees, "radian": lambda x: x}[to](radian)


def from_tangents(tx: Column, ty: Column) -> list[Column]:
    """The unit vector along (tx, 1, ty), turned round where ty is negative."""
    n = F.sqrt(tx * tx + ty * ty + 1) * F.when(ty < 0, -1.0).otherwise(1.0)
    return [tx / n, F.lit(1.0) / n, ty / n]


def from_azimuth(azimuth: Column, elevation: Column) -> list[Column]:
    """The unit vector of an azimuth (0: +y, clockwise) and an elevation, turned round where it points down.

    An elevation beyond a right angle is an error.
    """
    elevation = F.when(F.abs(elevation) <= math.pi / 2, elevation).otherwise(F.raise_error(F.lit("elevation beyond a right angle")).cast("double"))
    s = F.when(F.sin(elevation) < 0, -1.0).otherwise(1.0)
    return [s * F.cos(elevation) * F.sin(azimuth), s * F.cos(elevation) * F.cos(azimuth), s * F.sin(elevation)]


def rotation(yaw: Column, roll: Column, pitch: Column, order: str = "local") -> list[list[Column]]:
    """Rz Ry Rx (local) or Rx Ry Rz (global); roll turns about x, pitch about y, yaw about z. Radians."""
    one, zero = F.lit(1.0), F.lit(0.0)
    c, s = F.cos, F.sin
    x = [[one, zero, zero], [zero, c(roll), -s(roll)], [zero, s(roll), c(roll)]]
    y = [[c(pitch), zero, s(pitch)], [zero, one, zero], [-s(pitch), zero, c(pitch)]]
    z = [[c(yaw), -s(yaw), zero], [s(yaw), c(yaw), zero], [zero, zero, one]]
    product = lambda a, b: [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]
    return product(product(z, y), x) if order == "local" else product(product(x, y), z)


def turned(matrix: list[list[Column]], vector: list[Column]) -> list[Column]:
    return [row[0] * vector[0] + row[1] * vector[1] + row[2] * vector[2] for row in matrix]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _vector(row: Column, name: str) -> list[Column]:
    return [row[f"{name}{i}"] for i in range(3)]


def _row(single: dict[str, Column], **vectors: list[Column]) -> Column:
    return F.struct(*[x.alias(k) for k, x in single.items()], *[x.alias(f"{k}{i}") for k, v in vectors.items() for i, x in enumerate(v)])


def aimed(v: list[Column], source: list[Column], target: list[Column]) -> list[Column]:
    """v turned as source must be to point like target: about z first, then by the shortest way. source and target are unit
    vectors; where they are opposite after the first turn, the second goes by way of the axis that source has least of.

    The steps pass rows on, so that each computes its numbers once: as one expression they are beyond what Spark compiles.
    """

    def about_z(r: Column) -> Column:
        s, t = _vector(r, "s"), _vector(r, "t")
        flat = (F.hypot(s[0], s[1]) > 1e-15) & (F.hypot(t[0], t[1]) > 1e-15)
        psi = F.when(flat, F.atan2(t[1], t[0]) - F.atan2(s[1], s[0])).otherwise(0.0)
        return _row({"cos": F.cos(psi), "sin": F.sin(psi)}, v=_vector(r, "v"), s=s, t=t)

    def flat_turn(r: Column) -> Column:
        turn = lambda u: [r["cos"] * u[0] - r["sin"] * u[1], r["sin"] * u[0] + r["cos"] * u[1], u[2]]
        return _row({}, w=turn(_vector(r, "v")), a=turn(_vector(r, "s")), t=_vector(r, "t"))

    def axes(r: Column) -> Column:
        a, t = _vector(r, "a"), _vector(r, "t")
        size = [F.abs(x) for x in a]
        first, second = (size[0] < size[1]) & (size[0] < size[2]), size[1] < size[2]
        other = [F.when(first, 1.0).otherwise(0.0), F.when(~first & second, 1.0).otherwise(0.0), F.when(~first & ~second, 1.0).otherwise(0.0)]
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, t)))
        return _row({"cosine": cosine}, w=_vector(r, "w"), axis=_cross(a, t), side=_cross(a, other))

    def unit(r: Column) -> Column:
        axis, side = _vector(r, "axis"), _vector(r, "side")
        sine = F.sqrt(_dot(axis, axis))
        k = [F.when(sine < 1e-15, F.try_divide(s, F.sqrt(_dot(side, side)))).otherwise(F.try_divide(x, sine)) for x, s in zip(axis, side, strict=True)]
        return _row({"cosine": r["cosine"], "sine": sine}, w=_vector(r, "w"), k=k)

    def second_turn(r: Column) -> Column:
        w, k, cosine = _vector(r, "w"), _vector(r, "k"), r["cosine"]
        across, along = _cross(k, w), _dot(k, w)
        turned_ = [w[i] * cosine + across[i] * r["sine"] + k[i] * along * (1 - cosine) for i in range(3)]
        return _row({}, v=[F.when(cosine >= 1 - 1e-12, w[i]).otherwise(turned_[i]) for i in range(3)])

    rows = F.array(_row({}, v=v, s=source, t=target))
    for step in (about_z, flat_turn, axes, unit, second_turn):
        rows = F.transform(rows, step)
    return _vector(rows[0], "v")


def azimuth(v: list[Column]) -> Column:
    return F.atan2(v[0], v[1])


def elevation(v: list[Column]) -> Column:
    return F.atan2(v[2], F.sqrt(v[0] * v[0] + v[1] * v[1]))


def between(a: list[Column], b: list[Column]) -> Column:
    """The angle between two unit vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a[0] * b[0] + a[1] * b[1] + a[2] * b[2])))


def between_near(a: list[Column], b: list[Column], cut: float) -> Column:
    """The angle between vectors of any length; null where a component differs by more than cut, or a length is 0."""
    near = (F.abs(a[0] - b[0]) <= cut) & (F.abs(a[1] - b[1]) <= cut) & (F.abs(a[2] - b[2]) <= cut)
    norm = lambda v: F.nullif(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), F.lit(0.0))
    return F.when(near & norm(a).isNotNull() & norm(b).isNotNull(), between([x / norm(a) for x in a], [x / norm(b) for x in b]))


def radial_lateral(base: list[Column], delta: list[Column]) -> tuple[Column, Column]:
    """The parts of delta along base and across it, to the right; 0 where base is 0. Both in the plane."""
    norm = F.sqrt(base[0] * base[0] + base[1] * base[1])
    along, across = delta[0] * base[0] + delta[1] * base[1], delta[0] * base[1] - delta[1] * base[0]
    return tuple(F.when(norm == 0, 0.0).otherwise(F.try_divide(x, norm)) for x in (along, across))


def _corner(a: Column, b: Column) -> Column:
    return F.asin(a * b / (F.sqrt(1 + a * a) * F.sqrt(1 + b * b)))


def solid_angle(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Of a rectangle of tangents, by its four corners. One that isn't positive is an error."""
    omega = _corner(x1, y1) - _corner(x0, y1) - _corner(x1, y0) + _corner(x0, y0)
    return F.when(omega > 0, omega).otherwise(F.raise_error(F.lit("a solid angle that isn't positive")).cast("double"))


def effective_area(dot: Column, tx: Column, ty: Column, hori: float | Column, vert: float | Column, dept: float | Column, units: int | Column) -> Column:
    """Of panels of a depth, seen under an angle. May be negative, as it isn't clamped."""
    return dot * (hori - dept * F.abs(tx)) * (vert - dept * F.abs(ty)) * units
