"""Columns of small symmetric matrices. A 2x2 matrix is (xx, xy, yy); a 5x5 one is a dict by (i, j), i <= j,

with axes 0 to 4: a*, d, pm a*, pm d, parallax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyspark.functions.sky import lit

#: Inflation of covariances by kind of solution, and systematic floors in mas/yr and mas (fixed values).
INFLATION = {"6p": 1.22, "5p": 1.05, "2p": 1.00}
PM_FLOOR, PARALLAX_FLOOR = 0.026, 0.011
AXES = ("ra", "dec", "pmra", "pmdec", "parallax")
#: Stand-ins for missing errors: positions, motions, parallax.
MISSING_ERROR = (1e6, 1e6, 1e3, 1e3, 1e3)
CORRELATIONS = {
    (0, 1): "ra_dec_corr", (0, 2): "ra_pmra_corr", (0, 3): "ra_pmdec_corr", (0, 4): "ra_parallax_corr", (1, 2): "dec_pmra_corr",
    (1, 3): "dec_pmdec_corr", (1, 4): "dec_parallax_corr", (2, 3): "pmra_pmdec_corr", (2, 4): "parallax_pmra_corr", (3, 4): "parallax_pmdec_corr",
}

Sym2 = tuple[Column, Column, Column]


def finite(c: Column) -> Column:
    """True where a double is present and neither NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def solution_type(pseudocolour: Column, pmra: Column) -> Column:
    return F.when(finite(pseudocolour), "6p").when(finite(pmra), "5p").otherwise("2p")


def gaia_covariance(have: list[str], power: int = 1) -> dict[tuple[int, int], Column]:
    """Inflated covariance from errors and correlations; columns missing from ``have`` count as absent. power 2 inflates twice, as the image matcher does."""
    col = lambda name: F.col(name) if name in have else F.lit(None).cast("double")
    kind = solution_type(col("pseudocolour"), col("pmra"))
    f = F.when(kind == "6p", INFLATION["6p"] ** power).when(kind == "5p", INFLATION["5p"] ** power).otherwise(INFLATION["2p"])
    err = [F.coalesce(col(f"{a}_error"), F.lit(m)) for a, m in zip(AXES, MISSING_ERROR, strict=True)]
    floor = (0.0, 0.0, PM_FLOOR**2, PM_FLOOR**2, PARALLAX_FLOOR**2)
    out = {(i, i): err[i] * err[i] * f + floor[i] for i in range(5)}
    return out | {(i, j): err[i] * F.coalesce(col(name), F.lit(0.0)) * err[j] * f for (i, j), name in CORRELATIONS.items()}


def sandwich(rows: list[list[Column | float]], c: dict[tuple[int, int], Column]) -> Sym2:
    """J C J^T of a 2xn J and a symmetric nxn C; zero entries of J cost nothing."""
    n = len(rows[0])

    def dot(a, b):
        terms = [(a[i], b[j], c[min(i, j), max(i, j)]) for i in range(n) for j in range(n) if not (isinstance(a[i], float) and a[i] == 0) and not (isinstance(b[j], float) and b[j] == 0)]
        total = None
        for x, y, z in terms:
            t = lit(x) * lit(y) * z
            total = t if total is None else total + t
        return total

    return dot(rows[0], rows[0]), dot(rows[0], rows[1]), dot(rows[1], rows[1])


def propagated(c: dict[tuple[int, int], Column], dt: Column, fa: Column, fd: Column) -> Sym2:
    """Covariance of the position dt years on."""
    return sandwich([[1.0, 0.0, dt, 0.0, fa], [0.0, 1.0, 0.0, dt, fd]], c)


def transformed(jacobian, c: Sym2) -> Sym2:
    """J C J^T of 2x2 matrices; jacobian: (xx, xy, yx, yy)."""
    a, b, d, e = jacobian
    return sandwich([[a, b], [d, e]], {(0, 0): c[0], (0, 1): c[1], (1, 1): c[2]})


def determinant(c: Sym2) -> Column:
    return c[0] * c[2] - c[1] * c[1]


def inverse(c: Sym2) -> Sym2:
    det = F.nullif(determinant(c), F.lit(0.0))
    return c[2] / det, -c[1] / det, c[0] / det


def geometric_sigma(c: Sym2) -> Column:
    """Fourth root of the determinant; null where it isn't positive."""
    det = determinant(c)
    return F.when(det > 0, F.pow(det, F.lit(0.25)))


def squared_distance(dx: Column, dy: Column, c: Sym2) -> Column:
    xx, xy, yy = inverse(c)
    return xx * dx * dx + yy * dy * dy + 2 * xy * dx * dy


def mahalanobis(dx: Column, dy: Column, c: Sym2) -> Column:
    return F.sqrt(squared_distance(dx, dy, c))


def log_cost(dx: Column, dy: Column, c: Sym2) -> Column:
    return F.ln(determinant(c)) + squared_distance(dx, dy, c)


def measured(sx: Column, sy: Column, rho: Column, floor: float = 0.001) -> Sym2:
    """Measurement covariance of pixel errors with a floor, correlation clipped short of one."""
    r = F.least(F.greatest(rho, F.lit(-0.9999)), F.lit(0.9999))
    return sx * sx + floor**2, r * sx * sy, sy * sy + floor**2


def added(a: Sym2, b: Sym2) -> Sym2:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]
