"""Map projection, distances on it and fixed places. All closed-form expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80/WGS84 ellipsoid, UTM scale and false easting.
_A, _F = 6_378_137.0, 1 / 298.257223563
_K0, _E0 = 0.9996, 500_000.0
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
# Metres of a degree of latitude in bounding boxes, and the airport's centre.
METRES_PER_DEGREE = 111_195.0
AIRPORT_DMS = ("52°27'36.77\"N", "9°41'00.68\"E")
# Receivers of zone 32N, in metres.
RECEIVERS = (
    ("M01", 551663.90, 5811763.862),
    ("M02", 550989.13, 5813116.422),
    ("M03", 553686.61, 5813237.888),
    ("M04", 555267.09, 5811988.499),
    ("M05", 556553.09, 5813424.585),
    ("M06", 542489.95, 5811706.809),
    ("M07", 539538.85, 5812485.541),
    ("M08", 537135.69, 5813301.049),
    ("M09", 542060.92, 5813309.888),
)


def _column(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def utm(lat: Column | str, lon: Column | str, zone: int = 32) -> tuple[Column, Column]:
    """(x, y) metres of a northern UTM zone, by Krueger's series to the fourth order."""
    phi, lam = F.radians(_column(lat)), F.radians(_column(lon) - (6 * zone - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _RECT * x, _K0 * _RECT * y


def lat_lon(x: Column | str, y: Column | str, zone: int = 32) -> tuple[Column, Column]:
    """(lat, lon) degrees of northern UTM metres."""
    xi, eta = _column(y) / (_K0 * _RECT), (_column(x) - _E0) / (_K0 * _RECT)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), (6 * zone - 183) + F.degrees(F.atan2(F.sinh(v), F.cos(u)))


def dms(c: Column) -> Column:
    """52°27'13"N as degrees; the closing quote may be missing. Null where it is none."""
    pattern = "^\\s*(\\d+(?:\\.\\d+)?)°\\s*(\\d+(?:\\.\\d+)?)['′]\\s*(\\d+(?:\\.\\d+)?)[\"″]?\\s*([NSEWO])\\s*$"
    part = lambda k: F.regexp_extract(c, pattern, k).try_cast("double")
    sign = F.when(F.regexp_extract(c, pattern, 4).isin("S", "W"), -1.0).otherwise(1.0)
    return sign * (part(1) + part(2) / 60 + part(3) / 3600)


def airport_distance(x: Column | str, y: Column | str) -> Column:
    """Planar metres to the airport's centre."""
    ax, ay = utm(dms(F.lit(AIRPORT_DMS[0])), dms(F.lit(AIRPORT_DMS[1])))
    return F.hypot(_column(x) - ax, _column(y) - ay)


def box(lat: Column, lon: Column, lat0: Column, metres: Column, lon0: Column, buffer: float = 0.0) -> Column:
    """Whether (lat, lon) is within ``metres`` (1 + buffer) of (lat0, lon0) in both directions, edges included."""
    d_lat = metres * (1 + buffer) / METRES_PER_DEGREE
    return (F.abs(lat - lat0) <= d_lat) & (F.abs(lon - lon0) <= d_lat / F.cos(F.radians(lat0)))


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, scaled: bool = True) -> Column:
    """Metres from degrees: with the cosine of the mean latitude, or as if all degrees were alike."""
    east = (lon2 - lon1) * (F.cos(F.radians((lat1 + lat2) / 2)) if scaled else F.lit(1.0))
    return METRES_PER_DEGREE * F.hypot(lat2 - lat1, east)


def nearest_receiver(x: Column | str, y: Column | str, within: float = 5.0, receivers=RECEIVERS) -> Column:
    """Name of the nearest receiver, the first of equals, or UNKNOWN if none is as near as ``within`` metres."""
    each = F.array(*[F.struct(F.hypot(_column(x) - a, _column(y) - b).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, a, b) in enumerate(receivers)])
    best = F.array_min(each)
    return F.when(best["d"] <= within, best["name"]).otherwise("UNKNOWN")
