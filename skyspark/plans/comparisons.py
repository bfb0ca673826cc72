"""Queries over comparisons, joins of products, consistency and quality tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspark.operators import compare, relational, robust
from skyspark.operators.rounds import Rounds
from skyspark.plans.adapters import registry
from skyspark.plans.scalar import r
from skyspark.plans.tables import STATS, rounded

QUERIES, ORACLE, query = registry()


@query("detections", "images", sql="""WITH m AS (SELECT image_id, count(*) AS n_exp, round(max(mag), 6) AS depth FROM detections WHERE image_id % 6 <> 0 GROUP BY 1)
SELECT image_name, n_exp, depth, CASE WHEN image_id % 4 <> 0 THEN 'field' || (image_id % 3) END AS field, CASE WHEN image_id % 5 <> 0 THEN camera END AS instrument FROM images LEFT JOIN m USING (image_id)""")
def products_joined(det, images):
    """Products with their observation's metadata, field and instrument, by keys of different names."""
    metadata = det.where("image_id % 6 <> 0").groupBy(F.col("image_id").alias("obsid")).agg(F.count("*").alias("n_exp"), r(F.max("mag")).alias("depth"))
    fields = images.where("image_id % 4 <> 0").select(F.col("image_id").alias("obs"), F.concat(F.lit("field"), F.col("image_id") % 3).alias("field"))
    cameras = images.where("image_id % 5 <> 0").select(F.col("image_name").alias("product"), F.col("camera").alias("instrument"))
    d = images.select("image_name", F.col("image_id").alias("parent_obsid"))
    d = compare.attach(d, metadata, "parent_obsid", "obsid", ["n_exp", "depth"])
    d = compare.attach(d, fields, "parent_obsid", "obs", ["field"])
    return compare.attach(d, cameras, "image_name", "product", ["instrument"]).drop("parent_obsid")


@query("stars", sql="SELECT source_id AS gaia_id, round(coalesce(pmra, 0) + 0.01e0, 6) AS pmra_fit, round(CASE WHEN source_id % 9 <> 0 THEN pmra END, 6) AS pmra, round(CASE WHEN source_id % 9 <> 0 THEN pmra_error END, 6) AS pmra_error FROM stars WHERE source_id % 2 = 0")
def pm_comparison(stars):
    """Fitted motions beside the catalogue's, left join with the key renamed."""
    fitted = stars.where("source_id % 2 = 0").select(F.col("source_id").alias("gaia_id"), r(F.coalesce("pmra", F.lit(0.0)) + 0.01).alias("pmra_fit"))
    return compare.attach(fitted, rounded(stars.where("source_id % 9 <> 0").select("source_id", "pmra", "pmra_error")), "gaia_id", "source_id", ["pmra", "pmra_error"])


def compared(stars):
    c = F.col
    results = stars.where("source_id % 3 <> 0").select("source_id", "pmra", "parallax", "pmra_error", "parallax_error", (F.coalesce("pmra", F.lit(0.0)) + (c("source_id") % 13 - 6) * 0.01).alias("pmra_fit"), (F.coalesce("parallax", F.lit(0.0)) + (c("source_id") % 7 - 3) * 0.02).alias("parallax_fit"))
    truth = stars.where("source_id % 5 <> 0").select("source_id", ((c("source_id") % 11 - 5) * 0.008).alias("true_pmra"), ((c("source_id") % 5 - 2) * 0.015).alias("true_parallax"))
    none = lambda k: F.coalesce(c(k), F.lit(0.0))
    sigma = F.when(c("source_id") % 17 == 0, 0.0).otherwise(c("pmra_error"))
    return compare.against_truth(results, truth, "source_id", {"pmra": (c("pmra_fit") - none("pmra"), c("true_pmra"), sigma), "parallax": (c("parallax_fit") - none("parallax"), c("true_parallax"), c("parallax_error"))})


TRUTH = """t AS (SELECT source_id, (source_id % 13 - 6)*0.01e0 - (source_id % 11 - 5)*0.008e0 AS a, (source_id % 7 - 3)*0.02e0 - (source_id % 5 - 2)*0.015e0 AS b, CASE WHEN source_id % 17 <> 0 THEN pmra_error END AS sa, parallax_error AS sb FROM stars WHERE source_id % 3 <> 0 AND source_id % 5 <> 0)"""


@query("stars", sql=f"WITH {TRUTH} SELECT source_id, round(a, 6) AS resid_pmra, round(a/sa, 6) AS pull_pmra, round(b, 6) AS resid_parallax, round(b/sb, 6) AS pull_parallax FROM t")
def truth_comparison(stars):
    """Fitted values less the catalogue's against true offsets."""
    return compared(stars).select("source_id", *[(r(F.col(f"{k}_{m}")) + 0.0).alias(f"{k}_{m}") for m in ("pmra", "parallax") for k in ("resid", "pull")])


@query("stars", sql=f"""WITH {TRUTH}, l AS (SELECT 'pmra' AS measure, a AS resid, a/sa AS pull FROM t UNION ALL SELECT 'parallax', b, b/sb FROM t)
SELECT measure, count(resid) AS n, round(avg(resid), 6) AS bias, round(stddev_samp(resid), 6) AS rms, round(avg(pull), 6) AS pull_mean, round(stddev_samp(pull), 6) AS pull_std FROM l GROUP BY 1""")
def truth_summary(stars):
    return rounded(compare.truth_summary(compared(stars), ["pmra", "parallax"]))


@query("images", sql="""SELECT image_name || s AS image_name, round(0.001e0*image_id - 0.0009e0*image_id + k*1e-4::DOUBLE, 9) AS resid_a, round(0.5e0*k - 0.25e0, 9) AS resid_w FROM images, (VALUES ('_lo', 0), ('_hi', 1)) v(s, k) WHERE image_id % 7 <> 0""")
def image_truth(images):
    """Terms of both halves of a chip against their image's true ones."""
    n = F.col("image_id")
    halves = images.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.concat("image_name", F.when(F.col("k") == 0, "_lo").otherwise("_hi")).alias("image_name"), (n * 0.001 + F.col("k") * 1e-4).alias("a"), (F.col("k") * 0.5).alias("w"))
    truth = images.where("image_id % 7 <> 0").select("image_name", (n * 0.0009).alias("true_a"), F.lit(0.25).alias("true_w"))
    return compare.images_against_truth(halves, truth, "image_name", ["a", "w"]).select("image_name", r(F.col("resid_a"), 9).alias("resid_a"), r(F.col("resid_w"), 9).alias("resid_w"))


@query("matched", sql="""WITH s AS (SELECT source_id, sum(mag/(mag_err*mag_err))/sum(1/(mag_err*mag_err)) AS m FROM matched GROUP BY 1), d AS (SELECT image_id, count(*) AS n, median(mag - m) AS o FROM matched JOIN s USING (source_id) GROUP BY 1)
SELECT image_id, n, round(o, 6) AS "offset", CASE WHEN abs(o) > 0.08 THEN 'error' WHEN abs(o) > 0.04 THEN 'warning' ELSE 'ok' END AS verdict FROM d WHERE n >= 5""")
def zp_consistency(matched):
    return rounded(compare.zero_point_consistency(matched, "source_id", "image_id", "mag", "mag_err", 5, 0.04, 0.08))


@query("matched", sql=f"""WITH {STATS}, i AS (SELECT image_id, count(*) >= 400 AS offset_mag_ok FROM matched GROUP BY 1)
SELECT image_id, source_id, n_same_filter, round(mag - mean, 6) AS mag_residual_from_wmean, n_same_filter = 1 OR NOT list_contains(outs, image_id) AS is_mag_consistent, (n_same_filter = 1 OR NOT list_contains(outs, image_id)) AND offset_mag_ok AS is_trustworthy FROM matched JOIN q USING (source_id) JOIN i USING (image_id)""")
def source_quality(matched):
    matched = Rounds(matched.sparkSession).keep(matched.select("image_id", "source_id", "mag", "mag_err"), "matched")  # read four times, made once
    stats = robust.source_magnitudes(matched, "source_id", "image_id", "mag", "mag_err", 1.0)
    images = matched.groupBy("image_id").agg((F.count("*") >= 400).alias("offset_mag_ok"))
    d = compare.source_quality(matched.select("image_id", "source_id", "mag"), stats, images, "source_id", "image_id", "mag")
    return d.select("image_id", "source_id", "n_same_filter", r(F.col("mag_residual_from_wmean")).alias("mag_residual_from_wmean"), "is_mag_consistent", "is_trustworthy")


@query("matched", "images", sql="""WITH d AS (SELECT image_name, source_id, CASE WHEN image_id % 3 <> 0 THEN mag END AS m FROM matched JOIN images USING (image_id)), n AS (SELECT image_name, count(m) AS k, count(*) AS n FROM d GROUP BY 1)
SELECT image_name, source_id, round(m, 6) AS mag_norm_median, 1 AS n_same_filter, n AS n_shared_with_ref, image_name AS ref_image, true AS is_trustworthy FROM d JOIN n USING (image_name) WHERE k > 0""")
def solo_quality(matched, images):
    d = matched.join(images.select("image_id", "image_name"), "image_id").select("image_name", "source_id", F.when(F.col("image_id") % 3 != 0, F.col("mag")).alias("m"))
    return compare.solo_quality(d, "image_name", "m").select("image_name", "source_id", r(F.col("mag_norm_median")).alias("mag_norm_median"), "n_same_filter", "n_shared_with_ref", "ref_image", "is_trustworthy")


@query("stars", "matched", "images", sql="""WITH f AS (SELECT source_id, count(*) AS n FROM matched GROUP BY 1)
SELECT (SELECT count(*) FROM stars) AS n_stars, (SELECT round(min(gmag), 6) FROM stars) AS g_min, (SELECT round(max(gmag), 6) FROM stars) AS g_max, count(*) AS n_fitted, round(median(n), 6) AS n_detections_median, round((median(pmra_error) + median(pmdec_error))/2, 6) AS sigma_pm_median, (SELECT count(*) FROM images) AS n_images FROM f JOIN stars USING (source_id)""")
def field_summary(stars, matched, images):
    fitted = matched.groupBy("source_id").agg(F.count("*").alias("n_hst_used")).join(stars.select("source_id", F.col("pmra_error").alias("sigma_pmra"), F.col("pmdec_error").alias("sigma_pmdec")), "source_id")
    return rounded(compare.field_summary(stars, fitted, images))


@query("detections", "matched", sql="SELECT d.image_id, d.catalog_index, m.source_id AS gaia_id, m.source_id IS NOT NULL AS has_gaia_match FROM detections d LEFT JOIN (SELECT * FROM matched WHERE source_id % 2 = 0) m ON d.image_id = m.image_id AND d.catalog_index = m.catalog_index")
def match_lookup(det, matched):
    """The star of each detection, if it has one, by image and row number."""
    known = matched.where("source_id % 2 = 0").select("image_id", "catalog_index", F.col("source_id").alias("gaia_id"))
    return det.select("image_id", "catalog_index").join(known, ["image_id", "catalog_index"], "left").withColumn("has_gaia_match", F.col("gaia_id").isNotNull())


@query("stars", sql="""WITH c AS (SELECT source_id, ra_error*ra_error AS a, dec_error*dec_error AS b, ra_dec_corr*ra_error*dec_error AS ab, pmra_error*pmra_error AS c, pmdec_error*pmdec_error AS d, pmra_pmdec_corr*pmra_error*pmdec_error AS cd, parallax_error*parallax_error AS e,
 (source_id % 7 - 3)*0.03e0 AS v0, (source_id % 5 - 2)*0.04e0 AS v1, pmra*0.02e0 AS v2, pmdec*0.02e0 AS v3, 0.05e0 AS v4 FROM stars)
SELECT source_id, round((b*v0*v0 + a*v1*v1 - 2*ab*v0*v1)/(a*b - ab*ab) + (d*v2*v2 + c*v3*v3 - 2*cd*v2*v3)/(c*d - cd*cd) + v4*v4/e, 6) AS chi2 FROM c""")
def truth_chi2(stars):
    """Five residuals under their full covariance; null without motions."""
    c = F.col
    e = [c(f"{k}_error") for k in ("ra", "dec", "pmra", "pmdec", "parallax")]
    corr = {(0, 1): c("ra_dec_corr"), (2, 3): c("pmra_pmdec_corr")}
    cov = F.array(*[e[i] * e[j] * (F.lit(1.0) if i == j else corr.get((min(i, j), max(i, j)), F.lit(0.0))) for i in range(5) for j in range(5)])
    n = c("source_id")
    d = stars.select("source_id", ((n % 7 - 3) * 0.03).alias("v0"), ((n % 5 - 2) * 0.04).alias("v1"), (c("pmra") * 0.02).alias("v2"), (c("pmdec") * 0.02).alias("v3"), F.lit(0.05).alias("v4"), cov.alias("cov"))
    return compare.vector_chi2(d, [f"v{i}" for i in range(5)], "cov").select("source_id", r(c("chi2")).alias("chi2"))


@query("matched", sql="""WITH n AS (SELECT image_id, count(*) AS n FROM matched GROUP BY 1), ref AS (SELECT image_id FROM n ORDER BY n DESC, image_id LIMIT 1), f AS (SELECT source_id, mag AS fm FROM matched WHERE image_id = (SELECT image_id FROM ref))
SELECT image_id, count(*) AS n_shared, round(median(fm - mag), 6) AS residual FROM matched JOIN f USING (source_id) GROUP BY 1""")
def image_vs_best_reference(matched):
    """Every image against the one with the most stars."""
    best = matched.groupBy("image_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "image_id").limit(1).select(F.col("image_id").alias("ref"))
    ref = matched.join(F.broadcast(best), F.col("image_id") == F.col("ref")).select("source_id", F.col("mag").alias("fm"))  # one row is broadcast
    return rounded(matched.join(ref, "source_id").groupBy("image_id").agg(F.count("*").alias("n_shared"), F.median(F.col("fm") - F.col("mag")).alias("residual")))


@query("matched", "images", sql="""WITH s AS (SELECT source_id % 500 AS src, min(source_id) FILTER (source_id % 3 = 0) AS star, min(mag_err) AS sigma, count(*) AS n FROM matched GROUP BY 1), d AS (SELECT DISTINCT m.source_id % 500 AS src, image_name AS sub_name, catalog_index // 2 AS c FROM matched m JOIN images USING (image_id)),
a AS (SELECT d.*, CASE WHEN src % 4 = 0 THEN star END AS g, sigma, n FROM d JOIN s USING (src)), k AS (SELECT sub_name, src, row_number() OVER (PARTITION BY sub_name ORDER BY sigma, src) AS r FROM (SELECT DISTINCT sub_name, src, sigma FROM a WHERE g IS NULL)),
f AS (SELECT a.* FROM a JOIN k USING (sub_name, src) WHERE g IS NULL AND r <= 60), f2 AS (SELECT * FROM f WHERE src IN (SELECT src FROM f GROUP BY 1 HAVING count(*) >= 2)), c AS (SELECT * FROM a WHERE g IS NOT NULL UNION ALL SELECT * FROM f2),
o AS (SELECT *, row_number() OVER (PARTITION BY sub_name, c ORDER BY CASE WHEN g IS NULL THEN 1 ELSE 0 END, n DESC, sigma, src) AS r FROM c), w AS (SELECT * FROM o WHERE r = 1), i AS (SELECT src, -row_number() OVER (ORDER BY n DESC, sigma, src) AS h FROM (SELECT DISTINCT src, n, sigma FROM f2))
SELECT coalesce(g, h) AS gaia_id, src, sub_name, c AS catalog_index FROM w LEFT JOIN i USING (src) WHERE g IS NOT NULL OR src IN (SELECT src FROM w WHERE g IS NULL GROUP BY 1 HAVING count(*) >= 2)""")
def master_sources(matched, images):
    """Sources of a master list and the detections they own after caps and claims."""
    d = matched.join(images.select("image_id", "image_name"), "image_id").withColumn("src", F.col("source_id") % 500)
    star = F.min(F.when(F.col("source_id") % 3 == 0, F.col("source_id")))
    s = d.groupBy("src").agg(star.alias("star"), F.min("mag_err").alias("sigma"), F.count("*").alias("n_detect"))
    items = d.select("src", F.col("image_name").alias("sub_name"), F.expr("catalog_index div 2").alias("catalog_index")).distinct()
    rows = items.join(s, "src").select("src", F.when(F.col("src") % 4 == 0, F.col("star")).alias("gaia_id"), "sigma", "n_detect", "sub_name", "catalog_index")
    return relational.master_claims(rows, 60, 2)
