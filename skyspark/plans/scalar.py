"""Queries over scalar operators: projections, covariances, calibration, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspark.functions import covariance as V
from skyspark.functions import photometry as P
from skyspark.functions import sky as S
from skyspark.functions import text as T
from skyspark.plans.adapters import oracle, view

QUERIES, ORACLE = {}, {}


def query(*views: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(*[view(spark, d, v) for v in views])
        if sql:
            ORACLE[f.__name__] = oracle(sql, *views)
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


CFE = """phot_bp_rp_excess_factor - CASE WHEN bp_rp IS NULL THEN 0.0e0 WHEN bp_rp < 0.5 THEN 1.154360e0 + 0.033772e0*bp_rp + 0.032277e0*bp_rp*bp_rp
 WHEN bp_rp < 4.0 THEN 1.162004e0 + 0.011464e0*bp_rp + 0.049255e0*bp_rp*bp_rp - 0.005879e0*bp_rp*bp_rp*bp_rp
 WHEN bp_rp > 4.0 THEN 1.057572e0 + 0.140537e0*bp_rp ELSE 0.0e0 END"""


@query("stars", sql=f"SELECT source_id, round({CFE}, 6) AS corrected FROM stars")
def flux_excess_correction(stars):
    return stars.select("source_id", r(P.flux_excess(F.col("bp_rp"), F.col("phot_bp_rp_excess_factor"))).alias("corrected"))


@query("stars", sql=f"""SELECT source_id, astro_ok, astro_5p_ok, photo_ok, astro_ok AND photo_ok AS clean_label FROM (
 SELECT source_id, ruwe <= 1.4e0 AND ipd_gof_harmonic_amplitude <= 0.2e0 AND visibility_periods_used >= 9 AND astrometric_excess_noise_sig <= 2 AS astro_ok,
 ruwe <= 1.4e0 AND ipd_gof_harmonic_amplitude <= 0.2e0 AND visibility_periods_used >= 9 AND astrometric_excess_noise_sig <= 2 AND astrometric_params_solved = 31 AS astro_5p_ok,
 abs({CFE}) < 3 * (0.0059898e0 + 8.817481e-12 * pow(gmag, 7.618399e0)) AS photo_ok FROM stars)""")
def quality_flags(stars):
    c = F.col
    astro = [c("ruwe"), c("ipd_gof_harmonic_amplitude"), c("visibility_periods_used"), c("astrometric_excess_noise_sig")]
    out = stars.select("source_id", P.clean_astrometry(*astro).alias("astro_ok"), P.clean_astrometry(*astro, c("astrometric_params_solved")).alias("astro_5p_ok"), P.clean_photometry(c("gmag"), P.flux_excess(c("bp_rp"), c("phot_bp_rp_excess_factor"))).alias("photo_ok"))
    return out.withColumn("clean_label", c("astro_ok") & c("photo_ok"))


KIND = "CASE WHEN pseudocolour IS NOT NULL THEN '6p' WHEN pmra IS NOT NULL THEN '5p' ELSE '2p' END"


@query("stars", sql=f"SELECT {KIND} AS kind, count(*) AS n FROM stars GROUP BY 1")
def solution_type_counts(stars):
    return stars.groupBy(V.solution_type(F.col("pseudocolour"), F.col("pmra")).alias("kind")).agg(F.count("*").alias("n"))


INFL = "CASE WHEN pseudocolour IS NOT NULL THEN 1.22e0 WHEN pmra IS NOT NULL THEN 1.05e0 ELSE 1.0e0 END"
COV = f"""cov AS (SELECT source_id, ra, dec, pmra, pmdec, parallax, gmag, {INFL} AS f, ra_error*ra_error*{INFL} AS c00, ra_error*ra_dec_corr*dec_error*{INFL} AS c01, dec_error*dec_error*{INFL} AS c11,
 pmra_error*pmra_error*{INFL} + pow(0.026e0, 2) AS c22, pmra_error*pmra_pmdec_corr*pmdec_error*{INFL} AS c23, pmdec_error*pmdec_error*{INFL} + pow(0.026e0, 2) AS c33,
 parallax_error*parallax_error*{INFL} + pow(0.011e0, 2) AS c44, ra_error*ra_parallax_corr*parallax_error*{INFL} AS c04, dec_error*dec_parallax_corr*parallax_error*{INFL} AS c14 FROM stars)"""


@query("stars", sql=f"WITH {COV} SELECT source_id, round(c00,8) AS c00, round(c01,8) AS c01, round(c11,8) AS c11, round(c22,8) AS c22, round(c23,8) AS c23, round(c33,8) AS c33, round(c44,8) AS c44, round(c04,8) AS c04, round(c14,8) AS c14, 0.0e0 AS c02 FROM cov")
def cov5_inflated(stars):
    c = V.gaia_covariance(stars.columns)
    return stars.select("source_id", *[r(c[i, j], 8).alias(f"c{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3), (4, 4), (0, 4), (1, 4), (0, 2))])


@query("stars", sql=f"WITH {COV} SELECT source_id, round(pow(c00*c11-c01*c01, 0.25), 6) AS pos_sigma, round(pow(c22*c33-c23*c23, 0.25), 6) AS pm_sigma FROM cov")
def geometric_sigma(stars):
    c = V.gaia_covariance(stars.columns)
    return stars.select("source_id", r(V.geometric_sigma((c[0, 0], c[0, 1], c[1, 1]))).alias("pos_sigma"), r(V.geometric_sigma((c[2, 2], c[2, 3], c[3, 3]))).alias("pm_sigma"))


EARTH = """e0 AS (SELECT image_id, image_name, epoch_mjd, 2000.0e0 + (epoch_mjd - 51544.5e0)/365.25e0 - 2016.0e0 AS dt, epoch_mjd - 51544.5e0 AS n FROM images),
e1 AS (SELECT *, radians(357.528e0 + n*0.9856003e0) AS g, 280.460e0 + n*0.9856474e0 AS q, radians(23.439e0 - n*0.0000004e0) AS eps FROM e0),
e2 AS (SELECT *, radians(q + 1.915e0*sin(g) + 0.020e0*sin(2*g)) AS lam, 1.00014e0 - 0.01671e0*cos(g) - 0.00014e0*cos(2*g) AS rr FROM e1),
earth AS (SELECT image_id, image_name, dt, -rr*cos(lam) AS ex, -rr*cos(eps)*sin(lam) AS ey, -rr*sin(eps)*sin(lam) AS ez FROM e2)"""
FACT = """ex*sin(radians(ra)) - ey*cos(radians(ra)) AS fa, ex*cos(radians(ra))*sin(radians(dec)) + ey*sin(radians(ra))*sin(radians(dec)) - ez*cos(radians(dec)) AS fd"""


def observers(images):
    x, y, z = S.earth_position(F.col("epoch_mjd"))
    return images.select("image_id", "image_name", (S.mjd_to_year(F.col("epoch_mjd")) - 2016.0).alias("dt"), x.alias("ex"), y.alias("ey"), z.alias("ez"))


@query("images", sql=f"WITH {EARTH} SELECT image_name, round(dt, 8) AS dt, round(ex, 7) AS ex, round(ey, 7) AS ey, round(ez, 7) AS ez FROM earth")
def observer_positions(images):
    return observers(images).select("image_name", r(F.col("dt"), 8).alias("dt"), *[r(F.col(c), 7).alias(c) for c in ("ex", "ey", "ez")])


def seen(matched, stars, images):
    """Each matched detection with its star and its image's observer."""
    return matched.select("image_id", "source_id").join(stars, "source_id").join(observers(images), "image_id")


@query("matched", "stars", "images", sql=f"""WITH {EARTH}, p AS (SELECT m.image_id, m.source_id, ra, dec, coalesce(pmra,0) AS pa, coalesce(pmdec,0) AS pd, coalesce(parallax,0) AS plx, dt, {FACT} FROM matched m JOIN stars USING (source_id) JOIN earth USING (image_id))
SELECT image_id, source_id, round(ra + (pa*dt + plx*fa)/3600000.0e0/cos(radians(dec)), 9) AS ra_prop, round(dec + (pd*dt + plx*fd)/3600000.0e0, 9) AS dec_prop FROM p""")
def epoch_propagation(matched, stars, images):
    d = seen(matched, stars, images)
    fa, fd = S.parallax_factors(F.col("ra"), F.col("dec"), F.col("ex"), F.col("ey"), F.col("ez"))
    ra, dec = S.propagate(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), F.col("parallax"), F.col("dt"), fa, fd)
    return d.select("image_id", "source_id", r(ra, 9).alias("ra_prop"), r(dec, 9).alias("dec_prop"))


@query("matched", "stars", "images", sql=f"""WITH {EARTH}, {COV}, p AS (SELECT m.image_id, m.source_id, cov.*, dt, {FACT} FROM matched m JOIN cov USING (source_id) JOIN earth USING (image_id))
SELECT image_id, source_id, round(c00 + dt*dt*c22 + fa*fa*c44 + 2*fa*c04, 6) AS cxx, round(c01 + dt*dt*c23 + fa*fd*c44 + fd*c04 + fa*c14, 6) AS cxy, round(c11 + dt*dt*c33 + fd*fd*c44 + 2*fd*c14, 6) AS cyy FROM p""")
def epoch_propagation_cov(matched, stars, images):
    d = seen(matched, stars, images)
    fa, fd = S.parallax_factors(F.col("ra"), F.col("dec"), F.col("ex"), F.col("ey"), F.col("ez"))
    xx, xy, yy = V.propagated(V.gaia_covariance(stars.columns), F.col("dt"), fa, fd)
    return d.select("image_id", "source_id", r(xx).alias("cxx"), r(xy).alias("cxy"), r(yy).alias("cyy"))


TAN = """t AS (SELECT *, radians(ra) - radians(150.1e0) AS da, radians(dec) AS d, radians(2.09e0) AS d0 FROM stars),
u AS (SELECT *, sin(d0)*sin(d) + cos(d0)*cos(d)*cos(da) AS den, -cos(d)*sin(da) AS nx, cos(d0)*sin(d) - sin(d0)*cos(d)*cos(da) AS ny, 180.0e0/pi()*3600000.0e0/50.0e0 AS c, 180.0e0/pi()*3600000.0e0 AS k FROM t)"""


def plane(ra="ra", dec="dec"):
    return S.Tangent(F.col(ra), F.col(dec), 150.1, 2.09, 50.0)


@query("stars", sql=f"WITH {TAN} SELECT source_id, round(c*nx/den, 6) AS x, round(c*ny/den, 6) AS y FROM u")
def gnomonic_project(stars):
    t = plane()
    return stars.select("source_id", r(t.x()).alias("x"), r(t.y()).alias("y"))


@query("stars", sql="SELECT source_id, round(ra, 8) AS ra, round(dec, 8) AS dec FROM stars")
def gnomonic_roundtrip(stars):
    t = plane()
    d = stars.select("source_id", t.x().alias("x"), t.y().alias("y"))
    ra, dec = S.unproject(F.col("x"), F.col("y"), 150.1, 2.09, 50.0)
    return d.select("source_id", r(ra, 8).alias("ra"), r(dec, 8).alias("dec"))


@query("stars", sql=f"""WITH {TAN} SELECT source_id, round(c*(-cos(d)*cos(da)*den + nx*cos(d0)*cos(d)*sin(da))/(den*den)/(cos(d)*k), 8) AS xa, round(c*(sin(d)*sin(da)*den - nx*(sin(d0)*cos(d)-cos(d0)*sin(d)*cos(da)))/(den*den)/k, 8) AS xd,
 round(c*(sin(d0)*cos(d)*sin(da)*den + ny*cos(d0)*cos(d)*sin(da))/(den*den)/(cos(d)*k), 8) AS ya, round(c*((cos(d0)*cos(d)+sin(d0)*sin(d)*cos(da))*den - ny*(sin(d0)*cos(d)-cos(d0)*sin(d)*cos(da)))/(den*den)/k, 8) AS yd FROM u""")
def projection_jacobian(stars):
    return stars.select("source_id", *[r(c, 8).alias(n) for c, n in zip(plane().jacobian(), ("xa", "xd", "ya", "yd"), strict=True)])


@query("stars", sql=f"""WITH {TAN} SELECT source_id, round(c*(cos(d)*cos(da)*den - nx*cos(d0)*cos(d)*sin(da))/(den*den)/k, 8) AS xa0, round(c*(-nx*(cos(d0)*sin(d)-sin(d0)*cos(d)*cos(da)))/(den*den)/k, 8) AS xd0,
 round(c*(-sin(d0)*cos(d)*sin(da)*den - ny*cos(d0)*cos(d)*sin(da))/(den*den)/k, 8) AS ya0, round(c*(-(sin(d0)*sin(d)+cos(d0)*cos(d)*cos(da))*den - ny*(cos(d0)*sin(d)-sin(d0)*cos(d)*cos(da)))/(den*den)/k, 8) AS yd0 FROM u""")
def tangent_point_derivatives(stars):
    return stars.select("source_id", *[(r(c, 8) + 0.0).alias(n) for c, n in zip(plane().tangent_derivatives(), ("xa0", "xd0", "ya0", "yd0"), strict=True)])


@query("stars", sql="SELECT source_id, round((ra-150.1e0)*cos(radians(2.09e0))*3600000.0e0, 4) AS x_mas, round((dec-2.09e0)*3600000.0e0, 4) AS y_mas FROM stars")
def tangent_plane_offset(stars):
    x, y = S.flat_offset(F.col("ra"), F.col("dec"), 150.1, 2.09)
    return stars.select("source_id", r(x, 4).alias("x_mas"), r(y, 4).alias("y_mas"))


@query("stars", sql=f"WITH {TAN} SELECT source_id, round(CASE WHEN den <= 0 THEN 90.0e0 ELSE degrees(-nx/den) END, 8) AS xi, round(CASE WHEN den <= 0 THEN 90.0e0 ELSE degrees(ny/den) END, 8) AS eta FROM u")
def standard_coordinates(stars):
    xi, eta = S.standard_coordinates(F.col("ra"), F.col("dec"), 150.1, 2.09)
    return stars.select("source_id", r(xi, 8).alias("xi"), r(eta, 8).alias("eta"))


@query("stars", sql="""WITH v AS (SELECT source_id, least(greatest(gmag, 6), 20) AS m, cos(radians(dec))*cos(radians(ra)) AS vx, cos(radians(dec))*sin(radians(ra)) AS vy, sin(radians(dec)) AS vz FROM stars),
w AS (SELECT *, -0.0548755604162154e0*vx - 0.8734370902348850e0*vy - 0.4838350155487132e0*vz AS gx, -0.8676661490190047e0*vx - 0.1980763734312015e0*vy + 0.4559837761750669e0*vz AS gz FROM v)
SELECT source_id, round(10*pow(10, 2.187e0 - 0.2547e0*m + 0.006382e0*m*m + (0.114e0 - 0.0579e0*m + 0.01369e0*m*m - 0.000506e0*m*m*m)*abs(gz) + (0.031e0 - 0.0062e0*m)*gx), 6) AS width FROM w""")
def parallax_prior(stars):
    return stars.select("source_id", r(S.parallax_prior_width(F.col("ra"), F.col("dec"), F.col("gmag"))).alias("width"))


@query("detections", sql="SELECT image_id, catalog_index, round(sqrt((cov_yy*dx*dx + cov_xx*dy*dy - 2*cov_xy*dx*dy)/det), 6) AS distance, round(ln(det) + (cov_yy*dx*dx + cov_xx*dy*dy - 2*cov_xy*dx*dy)/det, 6) AS cost FROM (SELECT *, x - floor(x) AS dx, y - floor(y) AS dy, cov_xx*cov_yy - cov_xy*cov_xy AS det FROM detections)")
def mahalanobis_cost(det):
    dx, dy, c = F.col("x") - F.floor("x"), F.col("y") - F.floor("y"), (F.col("cov_xx"), F.col("cov_xy"), F.col("cov_yy"))
    return det.select("image_id", "catalog_index", r(V.mahalanobis(dx, dy, c)).alias("distance"), r(V.log_cost(dx, dy, c)).alias("cost"))


@query("detections", sql="SELECT image_id, catalog_index, round(0.99e0*0.99e0*cov_xx + 2*0.99e0*0.02e0*cov_xy + 0.02e0*0.02e0*cov_yy, 10) AS cxx, round(-0.02e0*0.99e0*cov_xx + (0.99e0*0.99e0 - 0.02e0*0.02e0)*cov_xy + 0.02e0*0.99e0*cov_yy, 10) AS cxy, round(0.02e0*0.02e0*cov_xx - 2*0.02e0*0.99e0*cov_xy + 0.99e0*0.99e0*cov_yy, 10) AS cyy FROM detections")
def covariance_transform(det):
    out = V.transformed((0.99, 0.02, -0.02, 0.99), (F.col("cov_xx"), F.col("cov_xy"), F.col("cov_yy")))
    return det.select("image_id", "catalog_index", *[r(c, 10).alias(n) for c, n in zip(out, ("cxx", "cxy", "cyy"), strict=True)])


@query("detections", sql="SELECT image_id, catalog_index, round(-2.5e0*log10(flux) + 25, 6) AS mag, round(1.0857362047581296e0*sqrt(flux)/flux, 6) AS mag_err, round(greatest(pow(10, (25 - mag)/2.5e0), 50), 6) AS threshold, round(sqrt(0.01e0*0.01e0 + pow(1e-5*pow(10, 0.2e0*mag), 2) + pow(1e-9*pow(10, 0.4e0*mag), 2)), 6) AS noise FROM detections")
def calibrated_magnitude(det):
    m, f = F.col("mag"), F.col("flux")
    return det.select("image_id", "catalog_index", r(P.magnitude(f, 25)).alias("mag"), r(P.magnitude_error(f, F.sqrt(f))).alias("mag_err"), r(P.flux_threshold(25, m, 50)).alias("threshold"), r(P.noise_model(m, 0.01, 1e-5, 1e-9)).alias("noise"))


@query("detections", sql="SELECT image_id, catalog_index, round(2048 + 1.001e0*(x-2048) + 0.002e0*(y-2048), 6) AS u, round(2048 - 0.002e0*(x-2048) + 0.999e0*(y-2048), 6) AS v FROM detections")
def affine_apply(det):
    from skyspark.functions.affine import apply

    u, v = apply(F.col("x"), F.col("y"), 1.001, 0.002, -0.002, 0.999, 2048.0, 2048.0, 2048.0, 2048.0)
    return det.select("image_id", "catalog_index", r(u).alias("u"), r(v).alias("v"))


@query("images", sql="SELECT image_name, filter AS first, filter AS last, filter AS header FROM images")
def filter_name_clean(images):
    c = F.concat(F.lit("CLEAR1L;"), F.col("filter"), F.lit("; CLEAR2S"))
    return images.select("image_name", T.clean_filter(c).alias("first"), T.clean_filter(c, True).alias("last"), T.header_filter(F.lit(None).cast("string"), F.lit("CLEAR1L"), F.col("filter")).alias("header"))


@query("images", sql="SELECT image_name, round(150.1e0 - image_id*0.001e0, 6) AS ra_min, round(150.1e0 + image_id*0.001e0, 6) AS ra_max, round(2.0e0, 6) AS dec_min, round(2.1e0, 6) AS dec_max FROM images")
def polygon_bbox(images):
    w = F.col("image_id") * 0.001
    s = F.format_string("POLYGON ICRS %.6f %.6f %.6f %.6f %.6f %.6f", F.lit(150.1) - w, F.lit(2.0), F.lit(150.1) + w, F.lit(2.05), F.lit(150.1), F.lit(2.1))
    return images.select("image_name", T.bounding_box(T.polygon(s)).alias("b")).select("image_name", "b.*")


@query("matched", sql="SELECT source_id, 'img' || image_id AS sub_name, catalog_index FROM matched")
def parse_detection_list(matched):
    item = F.concat(F.lit("img"), F.col("image_id"), F.lit(":"), F.col("catalog_index"))
    lists = matched.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("hst_indices"))
    return lists.select("source_id", F.explode(T.detections(F.col("hst_indices"))).alias("d")).select("source_id", "d.sub_name", "d.catalog_index")


@query("matched", sql="SELECT source_id, count(*) AS n, round(sum(chi2), 6) AS total FROM matched GROUP BY 1")
def det_chi2_map(matched):
    item = F.concat(F.lit("img"), F.col("image_id"), F.lit(":"), F.col("chi2"))
    lists = matched.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("det_chi2"))
    m = T.chi2_map(F.col("det_chi2"))
    return lists.select("source_id", F.size(m).cast("long").alias("n"), r(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("images", sql="SELECT image_name, round(2000.0e0 + (epoch_mjd - 51544.5e0)/365.25e0, 8) AS year, strftime(make_timestamp(CAST((epoch_mjd - 40587)*86400*1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS iso, image_name AS base, replace(camera, '/', '_') AS safe FROM images")
def epochs_and_names(images):
    m = F.col("epoch_mjd")
    return images.select("image_name", r(S.mjd_to_year(m), 8).alias("year"), F.date_format(S.mjd_to_timestamp(m), "yyyy-MM-dd HH:mm:ss").alias("iso"), T.base_image(F.concat("image_name", F.lit("_hi"))).alias("base"), T.safe_name(F.col("camera")).alias("safe"))


@query("detections", sql="SELECT image_id, catalog_index, round(least(1, (5 + 2)/(5 + chi2)), 6) AS z, qfit < 2 AND chi2 < 5 AND is_star AND flux > 0 AS subtractable FROM detections")
def soft_weight(det):
    return det.select("image_id", "catalog_index", r(P.student_weight(F.col("chi2"), 5)).alias("z"), P.subtractable(F.col("qfit"), F.col("chi2"), F.col("is_star"), F.col("flux")).alias("subtractable"))


@query("detections", sql="SELECT image_id, catalog_index, round((x-2048)*(x-2048)/2047.3e0, 6) AS xx, round((x-2048)*(y-2048)/2047.3e0, 6) AS xy, round(pow(y-2048, 3)/2047.3e0/2047.3e0, 6) AS yyy, 22 AS n_r FROM detections")
def polynomial_terms(det):
    m = S.monomials(F.col("x") - 2048.0, F.col("y") - 2048.0, 3, 2047.3)
    return det.select("image_id", "catalog_index", r(m[0]).alias("xx"), r(m[1]).alias("xy"), r(m[6]).alias("yyy"), F.lit(S.parameter_count(3)).alias("n_r"))
