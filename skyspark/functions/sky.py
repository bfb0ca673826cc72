"""Columns of spherical astrometry: projections, their derivatives, epochs and propagation.

Angles are degrees, offsets milliarcseconds (mas), image positions pixels. All expressions are
built-in functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAS_PER_DEG = 3_600_000.0
RAD2MAS = 180.0 / math.pi * MAS_PER_DEG
MJD_J2000, DAYS_PER_YEAR = 51544.5, 365.25


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def mjd_to_year(mjd: Column) -> Column:
    return F.lit(2000.0) + (mjd - MJD_J2000) / DAYS_PER_YEAR


def year_to_mjd(year: Column) -> Column:
    return F.lit(MJD_J2000) + (year - 2000.0) * DAYS_PER_YEAR


def mjd_to_timestamp(mjd: Column) -> Column:
    return F.timestamp_seconds((mjd - 40587.0) * 86400.0)


class Tangent:
    """The tangent plane at (ra0, dec0) seen from (ra, dec), scale in mas per pixel; x points along -RA."""

    def __init__(self, ra, dec, ra0, dec0, scale):
        self.a, self.d, self.d0 = F.radians(lit(ra)) - F.radians(lit(ra0)), F.radians(lit(dec)), F.radians(lit(dec0))
        self.c = F.lit(RAD2MAS) / lit(scale)
        sa, ca, sd, cd, s0, c0 = F.sin(self.a), F.cos(self.a), F.sin(self.d), F.cos(self.d), F.sin(self.d0), F.cos(self.d0)
        self.trig = sa, ca, sd, cd, s0, c0
        self.den, self.nx, self.ny = s0 * sd + c0 * cd * ca, -(cd * sa), c0 * sd - s0 * cd * ca

    def x(self) -> Column:
        return self.c * self.nx / self.den

    def y(self) -> Column:
        return self.c * self.ny / self.den

    def _quotient(self, n: Column, dn: Column, dden: Column) -> Column:
        return self.c * (dn * self.den - n * dden) / (self.den * self.den)

    def jacobian(self) -> tuple[Column, Column, Column, Column]:
        """dx/da*, dx/dd, dy/da*, dy/dd in pixels per mas, where a* is RA times the cosine of Dec."""
        sa, ca, sd, cd, s0, c0 = self.trig
        den_a, den_d = -(c0 * cd * sa), s0 * cd - c0 * sd * ca
        x_a, x_d = self._quotient(self.nx, -(cd * ca), den_a), self._quotient(self.nx, sd * sa, den_d)
        y_a, y_d = self._quotient(self.ny, s0 * cd * sa, den_a), self._quotient(self.ny, c0 * cd + s0 * sd * ca, den_d)
        return x_a / (cd * RAD2MAS), x_d / RAD2MAS, y_a / (cd * RAD2MAS), y_d / RAD2MAS

    def tangent_derivatives(self) -> tuple[Column, Column, Column, Column]:
        """dx/dra0, dx/ddec0, dy/dra0, dy/ddec0 in pixels per mas that the tangent point moves."""
        sa, ca, sd, cd, s0, c0 = self.trig
        den_a, den_d = c0 * cd * sa, c0 * sd - s0 * cd * ca
        x_a, x_d = self._quotient(self.nx, cd * ca, den_a), self._quotient(self.nx, F.lit(0.0), den_d)
        y_a, y_d = self._quotient(self.ny, -(s0 * cd * sa), den_a), self._quotient(self.ny, -(s0 * sd + c0 * cd * ca), den_d)
        return x_a / RAD2MAS, x_d / RAD2MAS, y_a / RAD2MAS, y_d / RAD2MAS


def unproject(x, y, ra0, dec0, scale) -> tuple[Column, Column]:
    """(ra, dec) of a tangent-plane position; the tangent point itself where the distance vanishes."""
    xi, eta, d0 = -lit(x) * lit(scale) / RAD2MAS, lit(y) * lit(scale) / RAD2MAS, F.radians(lit(dec0))
    rho = F.sqrt(xi * xi + eta * eta)
    c = F.atan(rho)
    ra = lit(ra0) + F.degrees(F.atan2(xi * F.sin(c), rho * F.cos(d0) * F.cos(c) - eta * F.sin(d0) * F.sin(c)))
    dec = F.degrees(F.asin(F.cos(c) * F.sin(d0) + eta * F.sin(c) * F.cos(d0) / rho))
    here = rho < 1e-15
    return F.when(here, lit(ra0)).otherwise(ra), F.when(here, lit(dec0)).otherwise(dec)


def wcs_sky(x, y, crpix: tuple, crval: tuple, cd: tuple) -> tuple[Column, Column]:
    """(ra, dec) of a pixel, counted from 0, under a tangential WCS: crpix counted from 1, crval in degrees, cd = (11, 12, 21, 22) in degrees per pixel."""
    dx, dy = lit(x) + 1.0 - lit(crpix[0]), lit(y) + 1.0 - lit(crpix[1])
    xi, eta = lit(cd[0]) * dx + lit(cd[1]) * dy, lit(cd[2]) * dx + lit(cd[3]) * dy
    return unproject(-xi, eta, crval[0], crval[1], MAS_PER_DEG)


def wcs_jacobian(x, y, crpix: tuple, crval: tuple, cd: tuple, step: float = 0.1) -> tuple[Column, Column, Column, Column]:
    """dra/dx, dra/dy, ddec/dx, ddec/dy in degrees per pixel, by central differences."""
    at = lambda i, j: wcs_sky(lit(x) + i * step, lit(y) + j * step, crpix, crval, cd)
    (a, b, c, d) = at(1, 0), at(-1, 0), at(0, 1), at(0, -1)
    return tuple((p[k] - q[k]) / (2 * step) for k in (0, 1) for p, q in ((a, b), (c, d)))


def standard_coordinates(ra, dec, ra0, dec0) -> tuple[Column, Column]:
    """(xi, eta) in degrees; 90 for both behind the plane."""
    t = Tangent(ra, dec, ra0, dec0, 1.0)
    behind = t.den <= 0
    return F.when(behind, 90.0).otherwise(F.degrees(-t.nx / t.den)), F.when(behind, 90.0).otherwise(F.degrees(t.ny / t.den))


def flat_offset(ra, dec, ra0, dec0) -> tuple[Column, Column]:
    """Offsets in mas on a flat plane at (ra0, dec0)."""
    return (lit(ra) - lit(ra0)) * F.cos(F.radians(lit(dec0))) * MAS_PER_DEG, (lit(dec) - lit(dec0)) * MAS_PER_DEG


def flat_position(x, y, ra0, dec0) -> tuple[Column, Column]:
    return lit(ra0) + lit(x) / (F.cos(F.radians(lit(dec0))) * MAS_PER_DEG), lit(dec0) + lit(y) / MAS_PER_DEG


def earth_position(mjd: Column) -> tuple[Column, Column, Column]:
    """Earth's barycentric equatorial position in au, by the low-precision solar series of the Astronomical Almanac (about 0.01 degrees), without the Sun's own 0.01 au."""
    n = mjd - MJD_J2000
    g, q = F.radians(F.lit(357.528) + n * 0.9856003), F.lit(280.460) + n * 0.9856474
    lam, eps = F.radians(q + F.sin(g) * 1.915 + F.sin(g * 2) * 0.020), F.radians(F.lit(23.439) - n * 0.0000004)
    r = F.lit(1.00014) - F.cos(g) * 0.01671 - F.cos(g * 2) * 0.00014
    return -(r * F.cos(lam)), -(r * F.cos(eps) * F.sin(lam)), -(r * F.sin(eps) * F.sin(lam))


def parallax_factors(ra, dec, x, y, z, sign: float = 1.0) -> tuple[Column, Column]:
    """Displacement (a*, d) per mas of parallax, for an observer at (x, y, z) au. sign -1 gives the negated convention that the joint solver uses."""
    a, d = F.radians(lit(ra)), F.radians(lit(dec))
    fa = lit(x) * F.sin(a) - lit(y) * F.cos(a)
    fd = lit(x) * F.cos(a) * F.sin(d) + lit(y) * F.sin(a) * F.sin(d) - lit(z) * F.cos(d)
    return fa * sign, fd * sign


def propagate(ra, dec, pmra, pmdec, parallax, dt, fa, fd) -> tuple[Column, Column]:
    """(ra, dec) after dt years; a missing motion or parallax counts as none."""
    none = lambda c: F.coalesce(lit(c), F.lit(0.0))
    off_a, off_d = none(pmra) * dt + none(parallax) * fa, none(pmdec) * dt + none(parallax) * fd
    return lit(ra) + off_a / MAS_PER_DEG / F.cos(F.radians(lit(dec))), lit(dec) + off_d / MAS_PER_DEG


#: Rows of the rotation from ICRS to galactic coordinates (fixed values).
GALACTIC = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)


def galactic_unit(ra, dec) -> tuple[Column, Column, Column]:
    """Galactic Cartesian unit vector: cos b cos l, cos b sin l, sin b."""
    a, d = F.radians(lit(ra)), F.radians(lit(dec))
    v = F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)
    return tuple(v[0] * r[0] + v[1] * r[1] + v[2] * r[2] for r in GALACTIC)


def parallax_prior_width(ra, dec, g) -> Column:
    """Prior width of a parallax in mas by magnitude and direction (Michalik et al. 2015, equations 15 to 18, times 10)."""
    m = F.least(F.greatest(lit(g), F.lit(6.0)), F.lit(20.0))
    x, _, z = galactic_unit(ra, dec)
    s0 = F.lit(2.187) - m * 0.2547 + m * m * 0.006382
    s1 = F.lit(0.114) - m * 0.0579 + m * m * 0.01369 - m * m * m * 0.000506
    s2 = F.lit(0.031) - m * 0.0062
    return F.pow(F.lit(10.0), s0 + s1 * F.abs(z) + s2 * x) * 10.0


def monomials(x, y, order: int, scale: float = 2048.0) -> list[Column]:
    """Terms x^(k-j) y^j / scale^(k-1) of the degrees 2 to order."""
    return [F.pow(lit(x), F.lit(float(k - j))) * F.pow(lit(y), F.lit(float(j))) / scale ** (k - 1) for k in range(2, order + 1) for j in range(k + 1)]


def parameter_count(order: int) -> int:
    """Parameters of an image transformation: linear part and tangent point 8, each degree k above 1 2(k+1) more."""
    return 2 + (order + 1) * (order + 2)


def infer_order(count: int) -> int:
    return next(p for p in range(1, 6) if parameter_count(p) == count)


def design(x, y, tangent: Tangent, order: int = 1) -> tuple[list[Column], list[Column]]:
    """Rows of x and y equation over (a, b, c, d, w, z, dra0, ddec0, higher terms)."""
    zero, one = F.lit(0.0), F.lit(1.0)
    xa, xd, ya, yd = tangent.tangent_derivatives()
    rx, ry = [lit(x), lit(y), zero, zero, one, zero, xa, xd], [zero, zero, lit(x), lit(y), zero, one, ya, yd]
    terms, at = monomials(x, y, order), 0
    for k in range(2, order + 1):
        own = terms[at : at + k + 1]
        at += k + 1
        rx += own + [zero] * (k + 1)
        ry += [zero] * (k + 1) + own
    return rx, ry
