"""Transverse Mercator and its UTM zones as column expressions, both ways, by series in the third flattening.

The series go to its fourth power; what they leave out is below a micrometre within a few thousand kilometres of the central meridian.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half axis (m) and flattening of GRS 80 and WGS 84.
GRS80, WGS84 = (6378137.0, 1 / 298.257222101), (6378137.0, 1 / 298.257223563)


def _series(n: float) -> tuple[list[float], list[float], list[float]]:
    """Coefficients of the published series, forward, inverse, and from conformal to geographic latitude."""
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return forward, inverse, latitude


@dataclass(frozen=True)
class TransverseMercator:
    """lon0 and lat0: degrees of the origin; scale on its meridian; false easting and northing; half axis and flattening."""

    lon0: float
    lat0: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    ellipsoid: tuple[float, float] = WGS84

    @property
    def _n(self) -> float:
        f = self.ellipsoid[1]
        return f / (2 - f)

    @property
    def _radius(self) -> float:
        n = self._n
        return self.scale * self.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def _origin(self) -> float:
        """Of the meridian at lat0, in units of the radius."""
        e, phi = math.sqrt(self.ellipsoid[1] * (2 - self.ellipsoid[1])), math.radians(self.lat0)
        t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
        xi = math.atan(t)
        return xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(_series(self._n)[0], 1))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing in metres of degrees."""
        e, phi = math.sqrt(self.ellipsoid[1] * (2 - self.ellipsoid[1])), F.radians(lat)
        away = F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(t * t + F.cos(away) * F.cos(away)))
        up = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_series(self._n)[0], 1))
        across = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_series(self._n)[0], 1))
        return self.east + self._radius * across, self.north + self._radius * (up - self._origin)

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees of metres."""
        xi, eta = (north - self.north) / self._radius + self._origin, (east - self.east) / self._radius
        _, back, latitude = _series(self._n)
        up = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(back, 1))
        across = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(back, 1))
        conformal = F.asin(F.sin(up) / F.cosh(across))
        phi = conformal + sum(d * F.sin(2 * j * conformal) for j, d in enumerate(latitude, 1))
        return self.lon0 + F.degrees(F.atan2(F.sinh(across), F.cos(up))), F.degrees(phi)


def utm_zone(lon: Column) -> Column:
    """From 1 to 60, each six degrees wide; 180 degrees east is 180 west."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def utm(zone: int, south: bool = False) -> TransverseMercator:
    if not 1 <= zone <= 60:
        raise ValueError(f"no such zone: {zone}")
    return TransverseMercator(6.0 * zone - 183, north=10_000_000.0 if south else 0.0)


def of_code(epsg: int) -> TransverseMercator:
    """The projection of a code: UTM zones of WGS 84, 32601 to 32660 in the north and 32701 to 32760 in the south."""
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return utm(epsg % 100, epsg > 32700)
    raise ValueError(f"not a UTM zone of WGS 84: {epsg}")
