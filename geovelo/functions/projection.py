"""Map projections as native columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 and the NZTM2000 projection.
A, FLAT = 6378137.0, 1 / 298.257222101
LON0, K0, FE, FN = 173.0, 0.9996, 1_600_000.0, 10_000_000.0
_N = FLAT / (2 - FLAT)
RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
E1 = 2 * math.sqrt(_N) / (1 + _N)

# The New Zealand Map Grid on the International ellipsoid, and the shift from its datum.
NZMG_A, NZMG_FLAT, NZMG_E, NZMG_N, NZMG_LAT = 6378388.0, 1 / 297, 2_510_000.0, 6_023_150.0, -41.0
NZMG_C = (complex(1.3231270439, 0), complex(-0.577245789, -0.007809598), complex(0.508307513, -0.112208952), complex(-0.15094762, 0.18200602), complex(1.01418179, 1.64497696), complex(1.9660549, 2.5127645))
NZMG_B = (complex(0.7557853228, 0), complex(0.249204646, 0.003371507), complex(-0.001541739, 0.041058560), complex(-0.10162907, 0.01727609), complex(-0.26623489, -0.36249218), complex(-0.6870983, -1.1651967))
NZMG_D = (1.5627014243, 0.5185406398, -0.03333098, -0.1052906, -0.0368594, 0.007317, 0.01220, 0.00394, -0.0013)
SHIFT = (59.47, -5.04, 187.44, 0.47, -0.1, 1.024, -4.5993)


def nztm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) on NZTM2000 by the Krueger series to third order; good to well below a millimetre over New Zealand."""
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - E1 * F.atanh(E1 * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FE + K0 * RADIUS * east, FN + K0 * RADIUS * north


class _Complex:
    """A complex number as two columns."""

    def __init__(self, re: Column, im: Column):
        self.re, self.im = re, im

    def __add__(self, other):
        other = other if isinstance(other, _Complex) else _Complex(F.lit(other.real), F.lit(other.imag))
        return _Complex(self.re + other.re, self.im + other.im)

    def __mul__(self, other):
        other = other if isinstance(other, _Complex) else _Complex(F.lit(other.real), F.lit(other.imag))
        return _Complex(self.re * other.re - self.im * other.im, self.re * other.im + self.im * other.re)


def _polynomial(z: _Complex, terms: tuple[complex, ...]) -> _Complex:
    """sum of terms[k] * z^(k+1), by Horner's rule."""
    out = z * terms[-1]
    for c in reversed(terms[:-1]):
        out = (out + c) * z
    return out


def nzmg_columns(easting: Column, northing: Column) -> dict[str, Column]:
    """First guess of the inverse map grid, to be refined by refine_nzmg: columns _zr, _zi (the plane) and _tr, _ti (the guess)."""
    z = _Complex((northing - NZMG_N) / NZMG_A, (easting - NZMG_E) / NZMG_A)
    t = _polynomial(z, NZMG_C)
    return {"_zr": z.re, "_zi": z.im, "_tr": t.re, "_ti": t.im}


def refine_nzmg() -> dict[str, Column]:
    """One Newton step of the guess: t = (z + sum (k-1) B_k t^k) / (sum k B_k t^(k-1))."""
    z, t = _Complex(F.col("_zr"), F.col("_zi")), _Complex(F.col("_tr"), F.col("_ti"))
    top = _polynomial(t, tuple(k * b for k, b in enumerate(NZMG_B))) + z
    low = _polynomial(t, tuple((k + 2) * b for k, b in enumerate(NZMG_B[1:]))) + NZMG_B[0]
    size = low.re * low.re + low.im * low.im
    return {"_tr": (top.re * low.re + top.im * low.im) / size, "_ti": (top.im * low.re - top.re * low.im) / size}


def nzmg_geodetic() -> tuple[Column, Column]:
    """(lon, lat) degrees on the grid's own datum, from the refined guess."""
    psi = F.col("_tr")
    phi, power = F.lit(0.0), psi
    for d in NZMG_D:
        phi, power = phi + d * power, power * psi
    return LON0 + F.degrees(F.col("_ti")), NZMG_LAT + phi * 1e5 / 3600


def shifted(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(lon, lat) moved from the map grid's datum to WGS84 by the seven-parameter transformation, at height 0."""
    e2 = NZMG_FLAT * (2 - NZMG_FLAT)
    phi, lam = F.radians(lat), F.radians(lon)
    v = NZMG_A / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    x, y, z = v * F.cos(phi) * F.cos(lam), v * F.cos(phi) * F.sin(lam), v * (1 - e2) * F.sin(phi)
    dx, dy, dz = SHIFT[:3]
    rx, ry, rz = (math.radians(r / 3600) for r in SHIFT[3:6])
    m = 1 + SHIFT[6] * 1e-6
    x, y, z = dx + m * (x - rz * y + ry * z), dy + m * (rz * x + y - rx * z), dz + m * (-ry * x + rx * y + z)
    g2 = FLAT * (2 - FLAT)
    p = F.sqrt(x * x + y * y)
    b = A * (1 - FLAT)
    u = F.atan2(z * A, p * b)
    sin3, cos3 = F.pow(F.sin(u), F.lit(3.0)), F.pow(F.cos(u), F.lit(3.0))
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z + g2 / (1 - g2) * b * sin3, p - g2 * A * cos3))
