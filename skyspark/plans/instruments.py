"""Queries over instruments' headers, conventions of transformations, and priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspark.functions import covariance as V
from skyspark.functions import instrument as I
from skyspark.functions import sky as S
from skyspark.functions import text as T
from skyspark.plans.adapters import registry
from skyspark.plans.scalar import r

QUERIES, ORACLE, query = registry()


def every(n: int, c, k: int = 0):
    """c, null on every n-th image."""
    return F.when(F.col("image_id") % n != k, c)


@query("images", sql="""WITH h AS (SELECT image_name, CASE WHEN image_id % 4 <> 0 THEN -1.39e-5 - image_id*1e-9 END AS a, CASE WHEN image_id % 3 <> 0 THEN 2e-7 END AS b, CASE WHEN image_id % 5 <> 0 THEN -3e-7 END AS c, 1.39e-5::DOUBLE AS d,
 CASE WHEN image_id % 6 <> 0 THEN 0.998e0 END AS p, CASE WHEN image_id % 7 <> 0 THEN 0.01e0 END AS q, CASE image_id % 4 WHEN 0 THEN 'NIRCAM' WHEN 1 THEN 'NIRISS' WHEN 2 THEN 'ACS' ELSE 'NIRCAM' END AS i, CASE WHEN image_id % 3 = 0 THEN 'NRCA1' WHEN image_id % 3 = 1 THEN 'NRCBLONG' WHEN image_id % 8 = 3 THEN 'XLONG' ELSE 'WFC' END AS t FROM images)
SELECT image_name, round(CASE WHEN a IS NULL THEN sqrt(abs(coalesce(p, 1)*-1.4e-5*(coalesce(p, 1)*1.4e-5) - coalesce(q, 0)*-1.4e-5*0)) ELSE sqrt(abs(a*d - coalesce(b, 0)*coalesce(c, 0))) END*3600000, 6) AS scale,
 CASE i WHEN 'NIRISS' THEN 0.065567e0 WHEN 'NIRCAM' THEN CASE t WHEN 'NRCA1' THEN 0.031227e0 WHEN 'NRCBLONG' THEN 0.063001e0 WHEN 'XLONG' THEN 0.063e0 ELSE 0.031e0 END END AS nominal FROM h""")
def pixel_scales(images):
    n = F.col("image_id")
    scale = I.header_scale((every(4, F.lit(-1.39e-5) - n * 1e-9), every(3, F.lit(2e-7)), every(5, F.lit(-3e-7)), F.lit(1.39e-5)), (every(6, F.lit(0.998)), every(7, F.lit(0.01)), F.lit(None).cast("double"), every(6, F.lit(0.998))), (F.lit(-1.4e-5), F.lit(1.4e-5)))
    instrument = F.when(n % 4 == 1, "NIRISS").when(n % 4 == 2, "ACS").otherwise("NIRCAM")
    detector = F.when(n % 3 == 0, "NRCA1").when(n % 3 == 1, "NRCBLONG").when(n % 8 == 3, "XLONG").otherwise("WFC")
    return images.select("image_name", r(scale).alias("scale"), I.nominal_scale(instrument, detector).alias("nominal"))


@query("images", sql="SELECT image_name, round(sqrt(pow((image_id*1e-4::DOUBLE)*3600*cos(radians(2.09e0))/0.05e0, 2) + pow(image_id*2e-5::DOUBLE*3600/0.05e0, 2)), 5) AS offset_px FROM images")
def pointing_offsets(images):
    n = F.col("image_id")
    return images.select("image_name", r(I.pointing_offset(n * 1e-4 + 150.1, F.lit(2.09) - n * 2e-5, 150.1, 2.09, 2.09, 0.05), 5).alias("offset_px"))


@query("images", sql="""WITH h AS (SELECT image_name, CASE image_id % 3 WHEN 0 THEN ' acs' WHEN 1 THEN 'WFC3' ELSE 'WFPC2' END AS i, CASE image_id % 4 WHEN 0 THEN 'ELECTRONS ' WHEN 1 THEN 'COUNTS' ELSE NULL END AS u, CASE WHEN image_id % 2 <> 0 THEN 1.5e0 + image_id*0.001e0 END AS ga, CASE WHEN image_id % 5 <> 0 THEN 1.7e0 END AS gb, CASE WHEN image_id % 7 <> 0 THEN 2.5e0 END AS g, 3.5e0 AS g2, CASE WHEN image_id % 3 <> 0 THEN 4.1e0 END AS na, CASE WHEN image_id % 4 <> 0 THEN 4.3e0 END AS nb, CASE WHEN image_id % 6 <> 0 THEN 5.5e0 END AS n1 FROM images),
g AS (SELECT *, CASE WHEN i IN (' acs', 'WFC3') THEN (coalesce(ga, g, 2) + coalesce(gb, ga, g, 2))/2 ELSE coalesce(g, g2, 1) END AS gain, CASE WHEN i IN (' acs', 'WFC3') THEN (coalesce(na, 5) + coalesce(nb, na, 5))/2 ELSE coalesce(n1, 5) END AS noise FROM h)
SELECT image_name, round(gain, 6) AS gain, round(CASE WHEN u = 'ELECTRONS ' THEN 1.0e0 ELSE gain END, 6) AS model_gain, round(noise, 6) AS read_noise FROM g""")
def gain_and_noise(images):
    n, none = F.col("image_id"), F.lit(None).cast("double")
    h = {"ATODGNA": every(2, n * 0.001 + 1.5), "ATODGNB": every(5, F.lit(1.7)), "CCDGAIN": every(7, F.lit(2.5)), "GAIN": F.lit(3.5), "READNSEA": every(3, F.lit(4.1)), "READNSEB": every(4, F.lit(4.3)), "RDNOISE": every(6, F.lit(5.5)), "READNOISE": none}
    gain, used, noise = I.gain_and_noise(F.when(n % 3 == 0, " acs").when(n % 3 == 1, "WFC3").otherwise("WFPC2"), F.when(n % 4 == 0, "ELECTRONS ").when(n % 4 == 1, "COUNTS"), h)
    return images.select("image_name", r(gain).alias("gain"), r(used).alias("model_gain"), r(noise).alias("read_noise"))


@query("detections", sql="SELECT image_id, catalog_index, round(CASE WHEN image_id % 5 <> 0 THEN -2.5e0*log10(flux) + 26.5e0 END, 6) AS mag_st, round(CASE WHEN image_id % 5 <> 0 THEN -2.5e0*log10(flux) + 26.5e0 + coalesce(CASE WHEN catalog_index % 3 <> 0 THEN 0.01e0*x/4096 END, 0) END, 6) AS mag_st_gdc, round(-2.5e0*log10(flux) + 25.9e0, 6) AS mag_ab FROM detections")
def calibrated_systems(det):
    st = every(5, F.lit(26.5))
    return det.select("image_id", "catalog_index", r(I.calibrated(F.col("flux"), st)).alias("mag_st"), r(I.calibrated(F.col("flux"), st, F.when(F.col("catalog_index") % 3 != 0, F.col("x") * 0.01 / 4096))).alias("mag_st_gdc"), r(I.calibrated(F.col("flux"), F.lit(25.9))).alias("mag_ab"))


@query("matched", "images", sql="""WITH w AS (SELECT source_id, avg(mag) FILTER (filter = 'F606W' AND source_id % 3 = 0) AS a, avg(mag) FILTER (filter = 'F475W' AND source_id % 2 = 0) AS b, avg(mag) FILTER (filter = 'F814W' AND source_id % 5 = 0) AS c FROM matched JOIN images USING (image_id) GROUP BY 1)
SELECT source_id, round(CASE WHEN a IS NOT NULL THEN a + 0.15e0 WHEN b IS NOT NULL THEN least(b, 20) WHEN c IS NOT NULL THEN c - 0.4e0 ELSE 20 END, 6) AS g FROM w""")
def estimated_g(matched, images):
    m = lambda name, n: F.avg(F.when((F.col("filter") == name) & (F.col("source_id") % n == 0), F.col("mag"))).alias(name)
    w = matched.join(images.select("image_id", "filter"), "image_id").groupBy("source_id").agg(m("F606W", 3), m("F475W", 2), m("F814W", 5))
    return w.select("source_id", r(I.estimated_g({k: F.col(k) for k in ("F606W", "F475W", "F814W")}, {"F606W": 0.15, "F814W": -0.4})).alias("g"))


@query("stars", sql="SELECT source_id FROM stars WHERE pmra_error*20 < 5 AND source_id % 7 >= 2 AND coalesce(sqrt(pmra*pmra + pmdec*pmdec)*12, 0) <= 30 AND coalesce(abs(parallax)*4, 0) <= 5")
def plausible_sources(stars):
    c = F.col
    return stars.where(I.plausible(c("pmra_error") * 20, c("source_id") % 7, F.sqrt(c("pmra") * c("pmra") + c("pmdec") * c("pmdec")) * 12, c("parallax") * 4)).select("source_id")


TURN = "WITH h AS (SELECT image_name, radians(image_id*3.7e0 - 170) AS t, 1 + image_id*1e-4::DOUBLE AS s, image_id*1e-5::DOUBLE AS e, image_id*-2e-5::DOUBLE AS f FROM images)"


@query("images", sql=f"{TURN} SELECT image_name, round(s*cos(t) + e, 9) AS a, round(s*sin(t) + f, 9) AS b, round(f - s*sin(t), 9) AS c, round(s*cos(t) - e, 9) AS d, round(sqrt(s*s - e*e - f*f), 9) AS ratio, round(degrees(atan2(sin(t), cos(t))), 6) AS rotation FROM h")
def linear_conventions(images):
    n = F.col("image_id")
    a, b, c, d = I.linear_terms(n * 3.7 - 170.0, n * 1e-4 + 1.0, n * 1e-5, n * -2e-5)
    rows = images.select("image_name", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    ratio, rotation, _, _ = I.shape_of(*[F.col(k) for k in "abcd"])
    return rows.select("image_name", *[r(F.col(k), 9).alias(k) for k in "abcd"], r(ratio, 9).alias("ratio"), r(rotation).alias("rotation"))


@query("images", sql="""WITH h AS (SELECT image_name, 1.001e0 AS a, 0.002e0 AS b, -0.0015e0 AS c, 0.9995e0 AS d, 2000.0e0 + image_id AS xs, 2100.0e0 AS ys, 2050.0e0 AS xt, 1990.0e0 - image_id AS yt, cos(radians(image_id*2.9e0)) AS co, sin(radians(image_id*2.9e0)) AS si FROM images),
m AS (SELECT *, a*(2048 - xs) + b*(2048 - ys) + xt - 2040 AS u, c*(2048 - xs) + d*(2048 - ys) + yt - 2060 AS v FROM h)
SELECT image_name, round(co*a + si*c, 9) AS a, round(co*b + si*d, 9) AS b, round(co*c - si*a, 9) AS c, round(co*d - si*b, 9) AS d, round(co*u + si*v, 6) AS w, round(co*v - si*u, 6) AS z FROM m""")
def solver_conventions(images):
    n = F.col("image_id")
    out = I.solver_terms(1.001, 0.002, -0.0015, 0.9995, n + 2000.0, 2100.0, 2050.0, F.lit(1990.0) - n, 2040.0, 2060.0, n * 2.9)
    return images.select("image_name", *[r(c, 9 if k in "abcd" else 6).alias(k) for k, c in zip("abcdwz", out, strict=True)])


@query("detections", sql="""WITH p AS (SELECT image_id, catalog_index, x - 2048 AS u, y - 2048 AS v FROM detections)
SELECT image_id, catalog_index, round(1.001e0 + (0.3e0*2*u + -0.2e0*v)/2048 + (0.04e0*3*u*u + 0.05e0*2*u*v - 0.06e0*v*v)/2048/2048, 6) AS xx, round(0.002e0 + (-0.2e0*u + 0.1e0*2*v)/2048 + (0.05e0*u*u - 0.06e0*2*u*v + 0.07e0*3*v*v)/2048/2048, 6) AS xy,
 round(-0.002e0 + (0.15e0*2*u + 0.25e0*v)/2048 + (0.01e0*3*u*u - 0.02e0*2*u*v + 0.03e0*v*v)/2048/2048, 6) AS yx, round(0.999e0 + (0.25e0*u - 0.35e0*2*v)/2048 + (-0.02e0*u*u + 0.03e0*2*u*v - 0.08e0*3*v*v)/2048/2048, 6) AS yy FROM p""")
def transformation_jacobian(det):
    terms = [1.001, 0.002, -0.002, 0.999, 0.0, 0.0, 0.0, 0.0, 0.3, -0.2, 0.1, 0.15, 0.25, -0.35, 0.04, 0.05, -0.06, 0.07, 0.01, -0.02, 0.03, -0.08]
    out = I.transformation_jacobian([F.lit(t) for t in terms], F.col("x") - 2048.0, F.col("y") - 2048.0, 3)
    return det.select("image_id", "catalog_index", *[r(c, 6).alias(k) for c, k in zip(out, ("xx", "xy", "yx", "yy"), strict=True)])


@query("stars", sql="""WITH o AS (SELECT source_id, radians((ra - 150)*1.1e0) AS x, radians((dec - 2)*0.9e0) AS y, radians(2.09e0) AS d0 FROM stars), t AS (SELECT *, atan2(x, cos(d0) - y*sin(d0)) AS t FROM o)
SELECT source_id, round(150.1e0 + degrees(t), 9) AS ra, round(degrees(atan2(cos(t)*(sin(d0) + y*cos(d0)), cos(d0) - y*sin(d0))), 9) AS dec FROM t""")
def offsets_to_sky(stars):
    ra, dec = I.sky_of_offsets((F.col("ra") - 150) * 1.1, (F.col("dec") - 2) * 0.9, 150.1, 2.09)
    return stars.select("source_id", r(ra, 9).alias("ra"), r(dec, 9).alias("dec"))


@query("stars", sql="SELECT source_id, round(150.1e0 + (ra - 150)*1e6/(cos(radians(2.09e0))*3600000), 9) AS ra, round(2.09e0 + (dec - 2)*1e6/3600000, 9) AS dec FROM stars")
def tangent_plane_inverse(stars):
    ra, dec = S.flat_position((F.col("ra") - 150) * 1e6, (F.col("dec") - 2) * 1e6, 150.1, 2.09)
    return stars.select("source_id", r(ra, 9).alias("ra"), r(dec, 9).alias("dec"))


@query("stars", sql="""WITH v AS (SELECT source_id, least(greatest(gmag, 6), 20) AS m, cos(radians(dec))*cos(radians(ra)) AS vx, cos(radians(dec))*sin(radians(ra)) AS vy, sin(radians(dec)) AS vz FROM stars),
w AS (SELECT *, -0.0548755604162154e0*vx - 0.8734370902348850e0*vy - 0.4838350155487132e0*vz AS gx, -0.8676661490190047e0*vx - 0.1980763734312015e0*vy + 0.4559837761750669e0*vz AS gz FROM v),
s AS (SELECT source_id, 10*pow(10, 2.187e0 - 0.2547e0*m + 0.006382e0*m*m + (0.114e0 - 0.0579e0*m + 0.01369e0*m*m - 0.000506e0*m*m*m)*abs(gz) + (0.031e0 - 0.0062e0*m)*gx) AS w FROM w)
SELECT source_id, round(1e-12*1e12, 6) AS position, round(1e-4::DOUBLE*1e6, 6) AS motion, round(1/(w*w), 6) AS parallax FROM s""")
def diffuse_prior(stars):
    p = I.diffuse_precision(F.col("ra"), F.col("dec"), F.col("gmag"))
    return stars.select("source_id", r(p[1] * 1e12).alias("position"), r(p[3] * 1e6).alias("motion"), r(p[4]).alias("parallax"))


@query("detections", sql="SELECT image_id, catalog_index, round(cov_xx + 1e-6, 9) AS cxx, round(least(greatest(cov_xy*40/sqrt(cov_xx*cov_yy), -0.9999e0), 0.9999e0)*sqrt(cov_xx)*sqrt(cov_yy), 9) AS cxy, round(cov_yy + 1e-6, 9) AS cyy FROM detections")
def measured_covariance(det):
    c = V.measured(F.sqrt("cov_xx"), F.sqrt("cov_yy"), F.col("cov_xy") * 40 / F.sqrt(F.col("cov_xx") * F.col("cov_yy")))
    return det.select("image_id", "catalog_index", *[r(x, 9).alias(k) for x, k in zip(c, ("cxx", "cxy", "cyy"), strict=True)])


@query("images", sql="""SELECT image_name, image_name || printf('_ra%.4f_dec%+.4f_w%.4f_h%.4f_G%.1f', 150.1e0 + image_id*0.01e0, 2.09e0 - image_id*0.1e0, 0.25e0, 0.5e0, 5.0e0) || CASE WHEN image_id % 2 = 0 THEN printf('_%.1f', 21.0e0) ELSE '' END || '_gaia' AS stem,
 CASE WHEN image_id % 4 = 0 THEN 'F850LP' ELSE filter END AS archive, 'CLEAR1L; CLEAR2L' AS all_clear, 'img1|img2|img3' AS names FROM images""")
def names_and_stems(images):
    n = F.col("image_id")
    stem = T.cache_name(F.col("image_name"), n * 0.01 + 150.1, F.lit(2.09) - n * 0.1, F.lit(0.25), F.lit(0.5), F.lit(5.0), F.when(n % 2 == 0, F.lit(21.0)))
    return images.select("image_name", stem.alias("stem"), T.archive_filter(F.when(n % 4 == 0, "F850L").otherwise(F.col("filter"))).alias("archive"), T.clean_filter(F.lit(" CLEAR1L; CLEAR2L ")).alias("all_clear"), F.array_join(T.names(F.lit("img1; img2,img1,,img3;")), "|").alias("names"))


@query("detections", sql="""WITH p AS (SELECT image_id, catalog_index, x + 1 - 2048 AS dx, y + 1 - 1024 AS dy FROM detections), o AS (SELECT *, radians(-1.39e-5*dx + 2e-7*dy) AS xi, radians(1e-7*dx + 1.4e-5*dy) AS eta, radians(2.09e0) AS d0 FROM p),
t AS (SELECT *, atan2(xi, cos(d0) - eta*sin(d0)) AS t FROM o) SELECT image_id, catalog_index, round(150.1e0 + degrees(t), 9) AS ra, round(degrees(atan2(cos(t)*(sin(d0) + eta*cos(d0)), cos(d0) - eta*sin(d0))), 9) AS dec FROM t""")
def wcs_positions(det):
    ra, dec = S.wcs_sky(F.col("x"), F.col("y"), (2048.0, 1024.0), (150.1, 2.09), (-1.39e-5, 2e-7, 1e-7, 1.4e-5))
    return det.select("image_id", "catalog_index", r(ra, 9).alias("ra"), r(dec, 9).alias("dec"))


@query("detections", sql="""WITH s(i, j) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), p AS (SELECT image_id, catalog_index, i, j, x + i*0.1e0 + 1 - 2048 AS dx, y + j*0.1e0 + 1 - 1024 AS dy FROM detections, s), o AS (SELECT *, radians(-1.39e-5*dx + 2e-7*dy) AS xi, radians(1e-7*dx + 1.4e-5*dy) AS eta, radians(0.01e0) AS d0 FROM p),
t AS (SELECT *, atan2(xi, cos(d0) - eta*sin(d0)) AS t FROM o), q AS (SELECT image_id, catalog_index, i, j, degrees(t) AS ra, degrees(atan2(cos(t)*(sin(d0) + eta*cos(d0)), cos(d0) - eta*sin(d0))) AS dec FROM t)
SELECT image_id, catalog_index, round((sum(ra) FILTER (i = 1) - sum(ra) FILTER (i = -1))/0.2e0*3.6e6, 4) AS ra_x, round((sum(ra) FILTER (j = 1) - sum(ra) FILTER (j = -1))/0.2e0*3.6e6, 4) AS ra_y, round((sum(dec) FILTER (i = 1) - sum(dec) FILTER (i = -1))/0.2e0*3.6e6, 4) AS dec_x, round((sum(dec) FILTER (j = 1) - sum(dec) FILTER (j = -1))/0.2e0*3.6e6, 4) AS dec_y FROM q GROUP BY 1, 2""")
def wcs_jacobian(det):
    out = S.wcs_jacobian(F.col("x"), F.col("y"), (2048.0, 1024.0), (0.0, 0.01), (-1.39e-5, 2e-7, 1e-7, 1.4e-5))
    return det.select("image_id", "catalog_index", *[r(c * 3.6e6, 4).alias(k) for c, k in zip(out, ("ra_x", "ra_y", "dec_x", "dec_y"), strict=True)])
