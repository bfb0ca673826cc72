"""Columns of instruments: pixel scales, noise by header, calibrated magnitudes, and conventions of image transformations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyspark.functions.covariance import finite
from skyspark.functions.sky import MAS_PER_DEG, lit, parallax_prior_width

#: Pixel scales in arcsec by instrument, or instrument and detector, and by channel of detectors that aren't listed (fixed values).
PIXEL_SCALE = {
    "NIRCAM_NRCA1": 0.031227, "NIRCAM_NRCA2": 0.030778, "NIRCAM_NRCA3": 0.03134, "NIRCAM_NRCA4": 0.0309, "NIRCAM_NRCALONG": 0.062906,
    "NIRCAM_NRCB1": 0.030746, "NIRCAM_NRCB2": 0.031194, "NIRCAM_NRCB3": 0.030872, "NIRCAM_NRCB4": 0.031326, "NIRCAM_NRCBLONG": 0.063001,
    "NIRISS": 0.065567, "MIRI": 0.110913,
}
SHORT_CHANNEL, LONG_CHANNEL = 0.031, 0.063
#: Units of images that are counted in electrons already (fixed values).
ELECTRONS = ("ELECTRONS", "ELECTRONS/S", "ELECTRON", "E-", "E")
#: Widths of the diffuse prior: positions in mas, motions in mas/yr.
DIFFUSE_POSITION, DIFFUSE_MOTION = 1e6, 100.0
PIVOT = 2048.0


def cd_scale(cd11: Column, cd12: Column, cd21: Column, cd22: Column) -> Column:
    """Pixel scale in mas from the CD matrix: the root of its determinant."""
    return F.sqrt(F.abs(cd11 * cd22 - cd12 * cd21)) * MAS_PER_DEG


def header_scale(cd: tuple, pc: tuple, cdelt: tuple) -> Column:
    """Pixel scale in mas from CD (11, 12, 21, 22), or from PC and CDELT where CD1_1 or CD2_2 is missing; off-diagonal terms that are missing are 0, PC's diagonal and CDELT 1."""
    none = lambda c, v: F.coalesce(c, F.lit(v))
    whole = cd_scale(cd[0], none(cd[1], 0.0), none(cd[2], 0.0), cd[3])
    d1, d2 = none(cdelt[0], 1.0), none(cdelt[1], 1.0)
    parts = cd_scale(none(pc[0], 1.0) * d1, none(pc[1], 0.0) * d1, none(pc[2], 0.0) * d2, none(pc[3], 1.0) * d2)
    return F.when(cd[0].isNull() | cd[3].isNull(), parts).otherwise(whole)


def nominal_scale(instrument: Column, detector: Column) -> Column:
    """Pixel scale in arcsec by instrument and detector; null for instruments without one."""
    table = F.create_map(*[F.lit(x) for pair in PIXEL_SCALE.items() for x in pair])
    camera = F.coalesce(F.try_element_at(table, F.concat_ws("_", instrument, detector)), F.when(detector.contains("LONG") | detector.contains("AL"), LONG_CHANNEL).otherwise(SHORT_CHANNEL))
    return F.when(instrument == "NIRCAM", camera).otherwise(F.try_element_at(table, instrument))


def pointing_offset(ra, dec, ra_ref, dec_ref, dec_centre, scale) -> Column:
    """Distance in pixels between two images' pointings, to first order; scale in arcsec."""
    dx = -(lit(ra) - lit(ra_ref)) * 3600.0 * F.cos(F.radians(lit(dec_centre))) / lit(scale)
    return F.hypot(dx, (lit(dec) - lit(dec_ref)) * 3600.0 / lit(scale))


def gain_and_noise(instrument: Column, unit: Column, h: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(hardware gain, gain of the noise model, read noise in electrons) from header values; h: ATODGNA ATODGNB CCDGAIN GAIN READNSEA READNSEB RDNOISE READNOISE, null where missing."""
    two = F.upper(F.trim(instrument)).isin("ACS", "WFC3")

    def mean(first, second, otherwise):
        a = F.coalesce(first, otherwise)
        return (a + F.coalesce(second, a)) / 2

    gain = F.when(two, mean(h["ATODGNA"], h["ATODGNB"], F.coalesce(h["CCDGAIN"], F.lit(2.0)))).otherwise(F.coalesce(h["CCDGAIN"], h["GAIN"], F.lit(1.0)))
    noise = F.when(two, mean(h["READNSEA"], h["READNSEB"], F.lit(5.0))).otherwise(F.coalesce(h["RDNOISE"], h["READNOISE"], F.lit(5.0)))
    counted = F.upper(F.trim(F.coalesce(unit, F.lit("")))).isin(*ELECTRONS)
    return gain, F.when(counted, 1.0).otherwise(gain), noise


def calibrated(flux: Column, zero_point: Column, correction: Column | None = None) -> Column:
    """Magnitude of a flux under a zero point, with the pixel-area correction if given; null without positive flux or finite zero point."""
    m = F.when((flux > 0) & finite(zero_point), F.log10(flux) * -2.5 + zero_point)
    return m if correction is None else m + F.coalesce(correction, F.lit(0.0))


def estimated_g(by_filter: dict[str, Column], offsets: dict[str, float] | None = None, faint: float = 20.0) -> Column:
    """G from the first filter (in the given order) with a finite magnitude: with the filter's offset if it has one, else the magnitude, ``faint`` at most; ``faint`` without any."""
    offsets = offsets or {}
    out = F.lit(faint)
    for name, m in reversed(by_filter.items()):
        out = F.when(finite(m), m + offsets[name] if name in offsets else F.least(m, F.lit(faint))).otherwise(out)
    return out


def plausible(sigma_pm: Column, n: Column, pm: Column, parallax: Column, most_sigma: float = 5.0, least: int = 2, most_pm: float = 30.0, most_parallax: float = 5.0) -> Column:
    """The cut on sources without catalogue star: a well measured motion from enough detections, and neither motion nor parallax implausibly large; missing sizes count as 0."""
    size = lambda c: F.coalesce(F.abs(c), F.lit(0.0))
    return F.coalesce((sigma_pm < most_sigma) & (n >= least) & (size(pm) <= most_pm) & (size(parallax) <= most_parallax), F.lit(False))


def linear_terms(rotation, ratio, on_skew, off_skew) -> tuple[Column, Column, Column, Column]:
    """(a, b, c, d) of a rotation in degrees, a ratio of scales and two skews."""
    co, si = F.cos(F.radians(lit(rotation))) * lit(ratio), F.sin(F.radians(lit(rotation))) * lit(ratio)
    return co + lit(on_skew), si + lit(off_skew), lit(off_skew) - si, co - lit(on_skew)


def shape_of(a, b, c, d) -> tuple[Column, Column, Column, Column]:
    """(ratio, rotation in degrees, on-axis skew, off-axis skew) of linear terms."""
    a, b, c, d = map(lit, (a, b, c, d))
    return F.sqrt(a * d - b * c), F.degrees(F.atan2(b - c, a + d)), (a - d) / 2, (b + c) / 2


def solver_terms(a, b, c, d, xs, ys, xt, yt, x_centre, y_centre, rotation) -> tuple[Column, ...]:
    """(a, b, c, d, w, z) of the joint solver from a matcher's affine transformation: turned by ``rotation`` degrees and carried to the pivot."""
    m = [lit(v) for v in (a, b, c, d)]
    co, si = F.cos(F.radians(lit(rotation))), F.sin(F.radians(lit(rotation)))
    turn = lambda x, y: (co * x + si * y, co * y - si * x)
    px, py = lit(PIVOT) - lit(xs), lit(PIVOT) - lit(ys)
    (oa, oc), (ob, od) = turn(m[0], m[2]), turn(m[1], m[3])
    w, z = turn(m[0] * px + m[1] * py + lit(xt) - lit(x_centre), m[2] * px + m[3] * py + lit(yt) - lit(y_centre))
    return oa, ob, oc, od, w, z


def transformation_jacobian(r: list[Column], x: Column, y: Column, order: int, scale: float = PIVOT) -> tuple[Column, Column, Column, Column]:
    """(dx/dX, dx/dY, dy/dX, dy/dY) of an image's transformation r (linear part, shift, tangent point, then each degree's terms of x and of y) at a position about the pivot."""
    x, y = lit(x), lit(y)
    power = lambda c, k: F.lit(1.0) if k == 0 else F.pow(c, F.lit(float(k)))
    out, at = list(r[:4]), 8
    for degree in range(2, order + 1):
        norm = scale ** (degree - 1)
        for row in (0, 2):
            for j in range(degree + 1):
                k, term = degree - j, r[at]
                at += 1
                if k:
                    out[row] = out[row] + term * power(x, k - 1) * power(y, j) * (k / norm)
                if j:
                    out[row + 1] = out[row + 1] + term * power(x, k) * power(y, j - 1) * (j / norm)
    return tuple(out)


def sky_of_offsets(x, y, ra0, dec0) -> tuple[Column, Column]:
    """(ra, dec) of standard coordinates in degrees about (ra0, dec0)."""
    xi, eta, d0 = F.radians(lit(x)), F.radians(lit(y)), F.radians(lit(dec0))
    along = F.cos(d0) - eta * F.sin(d0)
    turn = F.atan2(xi, along)
    return lit(ra0) + F.degrees(turn), F.degrees(F.atan2(F.cos(turn) * (F.sin(d0) + eta * F.cos(d0)), along))


def diffuse_precision(ra, dec, g) -> tuple[Column, Column, Column, Column, Column]:
    """Diagonal of the prior precision of a source without astrometric solution, by axis (a*, d, two motions, parallax)."""
    p, m = F.lit(DIFFUSE_POSITION**-2), F.lit(DIFFUSE_MOTION**-2)
    return p, p, m, m, F.pow(parallax_prior_width(ra, dec, g), F.lit(-2.0))
