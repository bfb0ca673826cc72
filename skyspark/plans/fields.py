"""Queries over made fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspark.operators import synthetic
from skyspark.plans.adapters import registry
from skyspark.plans.tables import rounded

QUERIES, ORACLE, query = registry()

SEED = 42


def normal(use: str, k: int, ids: str, q: int, wave: str) -> str:
    """DuckDB's text of one of synthetic.normals' numbers: pair q (0 or 1) of digest k."""
    u = lambda i: f"((('0x' || substr(md5('{SEED}:{use}:{k}:' || {ids}), {8 * i + 1}, 8))::BIGINT + 0.5e0)/4294967296.0e0)"
    return f"sqrt(-2*ln({u(2 * q)}))*{wave}(2*pi()*{u(2 * q + 1)})"


def five(use: str, ids: str) -> str:
    return ", ".join(f"{normal(use, i // 4, ids, i % 4 // 2, ('cos', 'sin')[i % 2])} AS z{i}" for i in range(5))


TRUTH = f"""z AS (SELECT *, {five("truth", "source_id::VARCHAR")}, CASE WHEN pseudocolour IS NOT NULL THEN 1.22e0 WHEN pmra IS NOT NULL THEN 1.05e0 ELSE 1.0e0 END AS f FROM stars),
c AS (SELECT *, ra_error*ra_error*f AS c00, dec_error*dec_error*f AS c11, pmra_error*pmra_error*f + 0.000676e0 AS c22, pmdec_error*pmdec_error*f + 0.000676e0 AS c33, parallax_error*parallax_error*f + 0.000121e0 AS c44,
 ra_error*ra_dec_corr*dec_error*f AS c01, pmra_error*pmra_pmdec_corr*pmdec_error*f AS c23, ra_error*ra_parallax_corr*parallax_error*f AS c04, dec_error*dec_parallax_corr*parallax_error*f AS c14 FROM z),
l AS (SELECT *, sqrt(c00) AS l00, c01/sqrt(c00) AS l10, sqrt(c11 - c01*c01/c00) AS l11, sqrt(c22) AS l22, c23/sqrt(c22) AS l32, sqrt(c33 - c23*c23/c22) AS l33, c04/sqrt(c00) AS l40, (c14 - c04*c01/c00)/sqrt(c11 - c01*c01/c00) AS l41 FROM c),
v AS (SELECT *, l00*z0 AS v_ra, l10*z0 + l11*z1 AS v_dec, CASE WHEN pmra IS NULL THEN 10*z2 ELSE l22*z2 END AS v_pmra, CASE WHEN pmra IS NULL THEN 10*z3 ELSE l32*z2 + l33*z3 END AS v_pmdec,
 CASE WHEN pmra IS NULL THEN z4 ELSE l40*z0 + l41*z1 + sqrt(c44 - l40*l40 - l41*l41)*z4 END AS v_parallax FROM l)"""


@query("stars", sql=f"""WITH {TRUTH} SELECT source_id, round(v_ra, 6) AS v_ra, round(v_dec, 6) AS v_dec, round(v_pmra, 6) AS v_pmra, round(v_pmdec, 6) AS v_pmdec, round(v_parallax, 6) AS v_parallax,
 round(coalesce(pmra, 0) + v_pmra, 6) AS true_pmra, round(coalesce(pmdec, 0) + v_pmdec, 6) AS true_pmdec, round(coalesce(parallax, 0) + v_parallax, 6) AS true_parallax FROM v""")
def synthetic_truth(stars):
    """True motions, parallaxes and offsets of all stars, drawn about the catalogue."""
    return rounded(synthetic.truth(stars, SEED).select("source_id", *synthetic.OFFSETS, "true_pmra", "true_pmdec", "true_parallax"))


def transformed(images):
    """Images with planted transformations."""
    c = F.col
    n = c("image_id")
    turn, grow = F.radians((n % 7 - 3) * 0.02), n % 5 * 2e-4 + 1.0
    a, b = F.cos(turn) * grow, F.sin(turn) * grow
    at = {"x0": F.lit(2048.0), "y0": F.lit(2048.0), "scale": c("pixel_scale_mas"), "turn": n * 3.7 - 170.0, "a": a, "b": b, "c": -b, "d": a, "xs": F.lit(2048.0), "ys": F.lit(2048.0), "xt": F.lit(2050.0) + n % 11, "yt": F.lit(2045.0) - n % 9}
    return images.select("image_id", "epoch_mjd", "ra0", "dec0", *[v.alias(k) for k, v in at.items()])


@query("matched", "stars", "images", sql="""SELECT image_id, count(*) AS n, round(sqrt(1 + (image_id % 5)*4e-4::DOUBLE + (image_id % 5)*(image_id % 5)*4e-8::DOUBLE), 6) AS ratio, true AS noise_fits, true AS exact
FROM matched JOIN stars USING (source_id) JOIN images USING (image_id) GROUP BY 1 HAVING count(*) >= 10""")
def synthetic_field(matched, stars, images):
    """What every image would measure of the drawn stars: the scale of the linear truth found in it is the planted one, no residual is left of it without noise, and the noise has the detections' size."""
    c = F.col
    seen = synthetic.observed(matched, synthetic.truth(stars, SEED), transformed(images), SEED)
    fit = synthetic.linear_truth(seen, "image_id", "x_true", "y_true", "plane_x", "plane_y")
    d = seen.join(fit, "image_id").join(matched.select("image_id", "source_id", "cov_xx", "cov_yy"), ["image_id", "source_id"])
    dx, dy = c("x_true") - 2048, c("y_true") - 2048
    left = F.abs(c("plane_x") - c("true_a") * dx - c("true_b") * dy - c("true_w")) + F.abs(c("plane_y") - c("true_c") * dx - c("true_d") * dy - c("true_z"))
    noise = (c("x") - c("x_true")) * (c("x") - c("x_true")) / c("cov_xx") + (c("y") - c("y_true")) * (c("y") - c("y_true")) / c("cov_yy")
    g = d.groupBy("image_id").agg(F.count("*").alias("n"), F.max(left).alias("left"), F.avg(noise).alias("noise"), F.first(F.sqrt(c("true_a") * c("true_a") + c("true_b") * c("true_b"))).alias("ratio"))
    ok = F.abs(c("noise") - 2) < F.lit(12.0) / F.sqrt("n")
    return g.where("n >= 10").select("image_id", "n", F.round("ratio", 6).alias("ratio"), ok.alias("noise_fits"), (c("left") < 1e-6).alias("exact"))
