"""Made fields: true stars drawn about a catalogue, what images would measure of them, and the linear transformation that they follow.

All of it is built-in functions. A random number is a digest of the seed, its use and the row's id, so it depends on no order and no partitioning, and a rerun agrees.

Defined results: a missing error counts as ``covariance.MISSING_ERROR``, a missing correlation as none; a covariance that isn't positive definite gives null offsets
from its first bad axis on; rows that repeat an id get the same draw; a missing motion or parallax of the truth counts as none in ``observed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyspark.functions import covariance as K
from skyspark.functions import sky as S

OFFSETS = tuple(f"v_{a}" for a in K.AXES)
#: Widths from which motions (mas/yr) and parallaxes (mas) of stars without measured ones are drawn.
MOTION_WIDTH, PARALLAX_WIDTH = 10.0, 1.0


def normals(seed: int, use: str, ids: list[Column | str], n: int) -> list[Column]:
    """n independent standard normal numbers a row, by Box and Muller's rule; a digest gives four."""
    out = []
    for k in range((n + 3) // 4):
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(use), F.lit(str(k)), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]).cast("binary"))
        u = [(F.conv(F.substring(digest, 8 * q + 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0 for q in range(4)]
        for a, b in ((u[0], u[1]), (u[2], u[3])):
            far, turn = F.sqrt(F.log(a) * -2.0), b * (2 * math.pi)
            out += [far * F.cos(turn), far * F.sin(turn)]
    return out[:n]


def with_cholesky(df: DataFrame, c: dict[tuple[int, int], Column], n: int, name: str = "l") -> DataFrame:
    """df with {name}{i}{j}, i >= j: the lower triangular factor of the symmetric n x n matrix c. A column of the factor is a projection of its own, so expressions stay short."""
    at = lambda i, j: F.col(f"{name}{i}{j}")
    out = df.withColumns({f"{name}{j}{i}": v for (i, j), v in c.items()})
    for j in range(n):
        left = out[f"{name}{j}{j}"]
        for k in range(j):
            left = left - at(j, k) * at(j, k)
        out = out.withColumn(f"{name}{j}{j}", F.when(left > 0, F.sqrt(left)))
        if j + 1 < n:
            rest = {}
            for i in range(j + 1, n):
                v = at(i, j)
                for k in range(j):
                    v = v - at(i, k) * at(j, k)
                rest[f"{name}{i}{j}"] = v / at(j, j)
            out = out.withColumns(rest)
    return out


def truth(stars: DataFrame, seed: int, key: str = "source_id", draw: bool = True, measured_only: bool = False, no_parallax: bool = False) -> DataFrame:
    """stars (ra, dec in degrees, pmra, pmdec, parallax and their errors and correlations) with true_ra, true_dec, true_pmra, true_pmdec, true_parallax, and v_ra to v_parallax: truth less catalogue.

    A star with a motion takes an offset from its whole covariance; one without takes its position from the 2 x 2 block, its motion and parallax from wide priors about 0. draw=False: truth is the catalogue."""
    c, has = F.col, F.col("pmra").isNotNull()
    d = stars.where(has) if measured_only else stars
    names = d.columns
    z, one = [c(f"__z{i}") for i in range(5)], F.lit(1.0 if draw else 0.0)
    f = with_cholesky(d.withColumns({f"__z{i}": v for i, v in enumerate(normals(seed, "truth", [key], 5))}), K.gaia_covariance(d.columns), 5, "__l")
    row = lambda i: sum((c(f"__l{i}{j}") * z[j] for j in range(1, i + 1)), c(f"__l{i}0") * z[0])
    wide = {2: z[2] * MOTION_WIDTH, 3: z[3] * MOTION_WIDTH, 4: z[4] * PARALLAX_WIDTH}
    off = {OFFSETS[i]: (row(i) if i < 2 else F.when(has, row(i)).otherwise(wide[i])) * one for i in range(5)}
    f = f.withColumns(off).select(*names, *OFFSETS)
    none = lambda k: F.coalesce(c(k), F.lit(0.0))
    a, b = c("ra") + c("v_ra") / F.cos(F.radians("dec")) / S.MAS_PER_DEG, c("dec") + c("v_dec") / S.MAS_PER_DEG
    f = f.withColumns({"true_ra": a, "true_dec": b} | {f"true_{k}": none(k) + c(f"v_{k}") for k in K.AXES[2:]})
    if no_parallax:
        f = f.withColumns({"true_parallax": F.lit(0.0), "v_parallax": F.lit(0.0)})
    return f


def to_pixels(ra, dec, ra0, dec0, x0, y0, scale, turn, linear: tuple, source: tuple, target: tuple) -> tuple[Column, Column]:
    """Pixel of a sky position: tangent plane at (ra0, dec0) of ``scale`` mas a pixel about (x0, y0), turned back by ``turn`` degrees, and through the inverse of the linear part (a, b, c, d) from ``target`` to ``source``."""
    t = S.Tangent(ra, dec, ra0, dec0, scale)
    gx, gy, angle = t.x(), t.y(), F.radians(S.lit(turn))
    rx, ry = F.cos(angle) * gx + F.sin(angle) * gy + S.lit(x0), F.cos(angle) * gy - F.sin(angle) * gx + S.lit(y0)
    a, b, c, d = (S.lit(v) for v in linear)
    dx, dy, det = rx - S.lit(target[0]), ry - S.lit(target[1]), a * d - b * c
    return S.lit(source[0]) + (d * dx - b * dy) / det, S.lit(source[1]) + (a * dy - c * dx) / det


def observed(detections: DataFrame, stars: DataFrame, images: DataFrame, seed: int, star: str = "source_id", image: str = "image_id") -> DataFrame:
    """(image, star, x_true, y_true, x, y, plane_x, plane_y): made measurements, with noise from each detection's covariance, and the true star's place in the tangent plane in pixels.

    detections: image, star, cov_xx, cov_xy, cov_yy; stars: truth()'s; images: image, epoch_mjd, ra0, dec0, x0, y0, scale, turn, a, b, c, d, xs, ys, xt, yt (names of to_pixels' arguments)."""
    c = F.col
    d = detections.select(image, star, "cov_xx", "cov_xy", "cov_yy").join(stars.select(star, *[f"true_{k}" for k in K.AXES]), star)
    d = d.join(images.select(image, "epoch_mjd", "ra0", "dec0", "x0", "y0", "scale", "turn", "a", "b", "c", "d", "xs", "ys", "xt", "yt"), image)
    fa, fd = S.parallax_factors(c("true_ra"), c("true_dec"), *S.earth_position(c("epoch_mjd")), -1.0)
    ra, dec = S.propagate(c("true_ra"), c("true_dec"), c("true_pmra"), c("true_pmdec"), c("true_parallax"), S.mjd_to_year(c("epoch_mjd")) - 2016.0, fa, fd)
    d = d.withColumns({"__ra": ra, "__dec": dec})
    x, y = to_pixels(c("__ra"), c("__dec"), c("ra0"), c("dec0"), c("x0"), c("y0"), c("scale"), c("turn"), tuple(c(k) for k in "abcd"), (c("xs"), c("ys")), (c("xt"), c("yt")))
    t = S.Tangent(c("__ra"), c("__dec"), c("ra0"), c("dec0"), c("scale"))
    # Variances have a floor, and a matrix with a negative eigenvalue is lifted.
    xx, yy, xy = F.greatest(c("cov_xx"), F.lit(1e-8)), F.greatest(c("cov_yy"), F.lit(1e-8)), c("cov_xy")
    low = (xx + yy) / 2 - F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    lift = F.when(low < 0, 1e-10 - low).otherwise(0.0)
    d = d.withColumns({"x_true": x, "y_true": y, "plane_x": t.x(), "plane_y": t.y(), "__xx": xx + lift, "__yy": yy + lift})
    z, l0 = normals(seed, "pixel", [image, star], 2), F.sqrt("__xx")
    l1 = c("cov_xy") / l0
    l2 = F.sqrt(F.greatest(c("__yy") - l1 * l1, F.lit(0.0)))
    return d.select(image, star, "x_true", "y_true", (c("x_true") + l0 * z[0]).alias("x"), (c("y_true") + l1 * z[0] + l2 * z[1]).alias("y"), "plane_x", "plane_y")


def linear_truth(rows: DataFrame, image: str, x: str, y: str, to_x: str, to_y: str, pivot: float = 2048.0) -> DataFrame:
    """(image, n, true_a, true_b, true_w, true_c, true_d, true_z): least squares of to = linear (x, y) about the pivot, by centred sums. Null for fewer than three places that aren't in a line."""
    cov = F.covar_pop
    s = rows.groupBy(image).agg(F.count("*").alias("n"), F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.avg(to_x).alias("__mu"), F.avg(to_y).alias("__mv"), F.var_pop(x).alias("__xx"), F.var_pop(y).alias("__yy"), cov(x, y).alias("__xy"), cov(x, to_x).alias("__xu"), cov(y, to_x).alias("__yu"), cov(x, to_y).alias("__xv"), cov(y, to_y).alias("__yv"))
    c = F.col
    det = c("__xx") * c("__yy") - c("__xy") * c("__xy")
    det = F.when(det > c("__xx") * c("__yy") * 1e-12, det)
    s = s.withColumns({f"true_{p}": (c(f"__x{u}") * c("__yy") - c(f"__y{u}") * c("__xy")) / det for p, u in (("a", "u"), ("c", "v"))} | {f"true_{q}": (c(f"__y{u}") * c("__xx") - c(f"__x{u}") * c("__xy")) / det for q, u in (("b", "u"), ("d", "v"))})
    shift = lambda p, q, m: c(m) - c(f"true_{p}") * (c("__mx") - pivot) - c(f"true_{q}") * (c("__my") - pivot)
    return s.select(image, "n", "true_a", "true_b", shift("a", "b", "__mu").alias("true_w"), "true_c", "true_d", shift("c", "d", "__mv").alias("true_z"))
