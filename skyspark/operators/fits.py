"""Least-squares fits: closed forms from sums, and batched small solves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspark.functions import covariance as V

SMALL = 1e-6


def proper_motion(df: DataFrame, keys: list[str], t: str, x: str, sx: str, y: str, sy: str) -> DataFrame:
    """Position and motion of each group by weighted least squares on both axes, from sums alone.

    Times are taken from the group's mean epoch. Groups of one detection, or of one epoch, have no motion."""
    mean = df.groupBy(*keys).agg(F.avg(t).alias("epoch"), F.count("*").alias("n"), F.count_distinct(t).alias("epochs"))
    rows = df.join(mean, keys).withColumn("dt", F.col(t) - F.col("epoch"))
    sums = []
    for v, s in ((x, sx), (y, sy)):
        e = F.greatest(F.col(s), F.lit(SMALL))
        w = 1 / (e * e)
        sums += [F.sum(w).alias(f"w_{v}"), F.sum(w * F.col("dt")).alias(f"wt_{v}"), F.sum(w * F.col("dt") * F.col("dt")).alias(f"wtt_{v}"), F.sum(w * F.col(v)).alias(f"wv_{v}"), F.sum(w * F.col("dt") * F.col(v)).alias(f"wtv_{v}"), F.sum(w * F.col(v) * F.col(v)).alias(f"wvv_{v}")]
    g = rows.groupBy(*keys).agg(F.first("epoch").alias("epoch"), F.first("n").alias("n"), F.first("epochs").alias("epochs"), *sums)
    out = [*keys, "epoch", "n"]
    for v in (x, y):
        w, wt, wtt, wv, wtv, wvv = (F.col(f"{k}_{v}") for k in ("w", "wt", "wtt", "wv", "wtv", "wvv"))
        det, moves = w * wtt - wt * wt, F.col("epochs") > 1
        p0, p1 = F.when(moves, (wtt * wv - wt * wtv) / det).otherwise(wv / w), F.when(moves, (w * wtv - wt * wv) / det).otherwise(0.0)
        chi2 = (wvv - 2 * (p0 * wv + p1 * wtv) + p0 * p0 * w + 2 * p0 * p1 * wt + p1 * p1 * wtt) / F.greatest(F.col("n") - 2, F.lit(1))
        out += [p0.alias(f"{v}0"), p1.alias(f"pm_{v}"), F.when(moves, F.sqrt(w / det)).alias(f"sigma_pm_{v}"), F.when(moves, F.sqrt(wtt / det)).otherwise(F.sqrt(1 / w)).alias(f"sigma_{v}0"), F.when(F.col("n") > 1, chi2).alias(f"chi2_{v}")]
    return g.select(*out)


MOMENTS = [f"g{a}{b}{w}" for w in ("xx", "xy", "yy") for a in range(3) for b in range(a, 3)]


def affine_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the weighted sums of an affine fit's deviation from the identity (small numbers, so that chi2 keeps its digits). df: keys, xs, ys, xt, yt and the covariance cxx, cxy, cyy of a pair."""
    c = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"{v}_o") for v in ("xs", "ys", "xt", "yt")])
    wxx, wxy, wyy = V.inverse((F.col("cxx"), F.col("cxy"), F.col("cyy")))
    d = df.join(c, keys)
    g = (F.col("xs") - F.col("xs_o"), F.col("ys") - F.col("ys_o"), F.lit(1.0))
    u, v, weights = F.col("xt") - F.col("xt_o") - g[0], F.col("yt") - F.col("yt_o") - g[1], {"xx": wxx, "xy": wxy, "yy": wyy}
    sums = [F.sum(g[a] * g[b] * w).alias(f"g{a}{b}{k}") for k, w in weights.items() for a in range(3) for b in range(a, 3)]
    sums += [F.sum(g[a] * (wxx * u + wxy * v)).alias(f"rx{a}") for a in range(3)] + [F.sum(g[a] * (wxy * u + wyy * v)).alias(f"ry{a}") for a in range(3)]
    sums.append(F.sum(wxx * u * u + 2 * wxy * u * v + wyy * v * v).alias("uu"))
    return d.groupBy(*keys).agg(F.first("n").alias("n"), *[F.first(f"{k}_o").alias(f"{k}_o") for k in ("xs", "ys", "xt", "yt")], *sums)


def _blocks(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = len(p)
    sym = {k: np.empty((n, 3, 3)) for k in ("xx", "xy", "yy")}
    for k, m in sym.items():
        for a in range(3):
            for b in range(a, 3):
                m[:, a, b] = m[:, b, a] = p[f"g{a}{b}{k}"]
    lhs = np.block([[sym["xx"], sym["xy"]], [sym["xy"], sym["yy"]]])
    rhs = p[[f"r{k}{a}" for k in "xy" for a in range(3)]].to_numpy(float)
    return lhs, rhs


AFFINE_SCHEMA = "n long, a double, b double, c double, d double, xs_o double, ys_o double, xt_o double, yt_o double, chi2 double"


def _solved(p: pd.DataFrame, names: list[str], least: int, basis: np.ndarray, prior: np.ndarray, target: np.ndarray) -> pd.DataFrame:
    """Solves for the parameters q of p = basis q, deviations from the identity; chi2 is that of the data without the prior."""
    lhs, rhs = _blocks(p)
    few = (p["n"] < least).to_numpy()
    small = np.einsum("ki,nkl,lj->nij", basis, lhs, basis) + prior
    small[few] = np.eye(basis.shape[1])
    q = np.linalg.solve(small, (rhs @ basis + target)[..., None])[..., 0]
    full = q @ basis.T
    chi2 = p["uu"].to_numpy() - 2 * (full * rhs).sum(1) + np.einsum("ni,nij,nj->n", full, lhs, full)
    full[few], chi2[few] = 0, 1e10
    full[:, [0, 4]] += 1
    out = p[names].copy()
    out["n"] = p["n"]
    for k, v in (("a", full[:, 0]), ("b", full[:, 1]), ("c", full[:, 3]), ("d", full[:, 4])):
        out[k] = v
    zero = lambda c: np.where(few, 0.0, c)
    out["xs_o"], out["ys_o"] = zero(p["xs_o"]), zero(p["ys_o"])
    out["xt_o"], out["yt_o"] = zero(p["xt_o"] + full[:, 2]), zero(p["yt_o"] + full[:, 5])
    out["chi2"] = chi2
    return out


def affine(df: DataFrame, keys: list[str], skew: float = 1e-4) -> DataFrame:
    """Six-parameter fit of each group; skew is the expected size of a - d and b + c. Fewer than 3 pairs: identity and chi2 1e10.

    The sums are native; only one row per group is solved in Python, many at a time."""
    types = {k: t for k, t in df.dtypes}
    prior = np.zeros((6, 6))
    if skew:
        for i, j, s in ((0, 4, -1), (1, 3, 1)):
            prior[[i, j], [i, j]] += skew**-2
            prior[i, j] += s * skew**-2
            prior[j, i] += s * skew**-2

    def run(batches):
        for p in batches:
            yield _solved(p, keys, 3, np.eye(6), prior, np.zeros(6))

    return affine_moments(df, keys).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + AFFINE_SCHEMA)


def similarity(df: DataFrame, keys: list[str], scale: float | None = None, scale_sigma: float = 0.02, turn_sigma: float = 0.0035) -> DataFrame:
    """Four-parameter fit (scale, rotation, shift) of each group with optional priors. Fewer than 2 pairs: identity and chi2 1e10."""
    types = {k: t for k, t in df.dtypes}
    basis = np.zeros((6, 4))
    basis[0, 0] = basis[4, 0] = basis[3, 1] = basis[2, 2] = basis[5, 3] = 1
    basis[1, 1] = -1
    prior, target = np.zeros((4, 4)), np.zeros(4)
    if scale is not None:
        prior[0, 0], prior[1, 1], target[0] = scale_sigma**-2, turn_sigma**-2, (scale - 1) * scale_sigma**-2

    def run(batches):
        for p in batches:
            yield _solved(p, keys, 2, basis, prior, target)

    return affine_moments(df, keys).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + AFFINE_SCHEMA)
