"""Queries over statistics, joins, neighbours, graphs and fits."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyspark.operators import fits, graph, matching, relational, robust, spatial
from skyspark.operators.rounds import Rounds
from skyspark.plans.adapters import oracle, view
from skyspark.plans.scalar import r

QUERIES, ORACLE = {}, {}


def query(*views: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(*[view(spark, d, v) for v in views])
        if sql:
            ORACLE[f.__name__] = oracle(sql, *views)
        return f

    return add


def rounded(df, digits: int = 6):
    return df.select(*[r(F.col(c), digits).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("matched", sql="""WITH m AS (SELECT image_id, count(mag) AS n, median(mag) AS med FROM matched GROUP BY 1)
SELECT image_id, any_value(n) AS n, round(any_value(med), 6) AS median, round(median(abs(mag - med))*1.4826e0, 6) AS mad FROM matched JOIN m USING (image_id) GROUP BY 1""")
def mad_by_group(matched):
    return rounded(robust.mad(matched, ["image_id"], "mag", robust.SCALE))


@query("matched", sql="SELECT source_id, round(sum(mag/mag_err/mag_err)/sum(1/mag_err/mag_err), 6) AS mean, round(1/sqrt(sum(1/mag_err/mag_err)), 6) AS err FROM matched GROUP BY 1")
def weighted_mean_by_group(matched):
    mean, err = robust.weighted_mean(F.col("mag"), F.col("mag_err"))
    return matched.groupBy("source_id").agg(r(mean).alias("mean"), r(err).alias("err"))


@query("matched", sql="SELECT image_id, round((quantile_cont(mag, 0.84) - quantile_cont(mag, 0.16))/2, 6) AS half_width FROM matched GROUP BY 1")
def p16_p84_scatter(matched):
    return matched.groupBy("image_id").agg(r(robust.half_width(F.col("mag"))).alias("half_width"))


@query("matched", sql="SELECT image_id, round(CASE WHEN count(chi2) < 10 THEN 9.0e0 ELSE greatest(quantile_cont(chi2, 0.5) + 5*greatest(quantile_cont(chi2, 0.5) - quantile_cont(chi2, 0.16), 1e-6), 3.0e0) END, 6) AS threshold FROM matched GROUP BY 1")
def adaptive_threshold(matched):
    return matched.groupBy("image_id").agg(r(robust.adaptive_threshold(F.col("chi2"), 5.0, 3.0, 9.0)).alias("threshold"))


@query("matched", sql="""WITH m AS (SELECT image_id, median(mag) AS med FROM matched GROUP BY 1), d AS (SELECT image_id, any_value(med) AS med, median(abs(mag-med))*1.4826e0 AS s FROM matched JOIN m USING (image_id) GROUP BY 1)
SELECT image_id, round(CASE WHEN count(mag) FILTER (abs(mag-med) <= 1.5*s) >= 3 THEN median(mag) FILTER (abs(mag-med) <= 1.5*s) ELSE any_value(med) END, 6) AS median, count(mag) FILTER (abs(mag-med) <= 1.5*s) AS kept FROM matched JOIN d USING (image_id) GROUP BY 1""")
def sigma_clipped_median(matched):
    return rounded(robust.clipped_median(matched, ["image_id"], "mag", 1.5))


STATS = """m AS (SELECT source_id, image_id, mag AS m, greatest(mag_err, 1e-4) + 0.01e0 AS e FROM matched),
s AS (SELECT source_id, count(*) AS n_same_filter, median(m) AS med, sum(m/(e*e))/sum(1/(e*e)) AS mean, 1/sqrt(sum(1/(e*e))) AS err FROM m GROUP BY 1),
q AS (SELECT source_id, n_same_filter, med, mean, err, median(abs(m-med)) AS mad, count(*) FILTER (abs((m-mean)/e) <= 1) AS n_consistent, list_sort(coalesce(list(image_id) FILTER (abs((m-mean)/e) > 1), [])) AS outs FROM m JOIN s USING (source_id) GROUP BY ALL)"""


@query("matched", sql=f"WITH {STATS} SELECT source_id, n_same_filter, round(med, 6) AS mag_norm_median, round(mean, 6) AS mag_norm_wmean, round(err, 6) AS mag_norm_werr, round(mad, 6) AS mag_norm_mad, n_consistent, array_to_string(outs, ',') AS outlier_images FROM q")
def per_source_mag_stats(matched):
    return rounded(robust.source_magnitudes(matched, "source_id", "image_id", "mag", "mag_err", 1.0)).withColumn("outlier_images", F.array_join("outlier_images", ","))


@query("matched", "images", "stars", sql="""WITH d AS (SELECT image_id, filter, gmag - mag AS d FROM matched JOIN stars USING (source_id) JOIN images USING (image_id)),
o AS (SELECT image_id, filter, count(d) AS n, median(d) AS own FROM d GROUP BY 1, 2), f AS (SELECT filter, median(own) AS of FROM o WHERE n >= 500 GROUP BY 1), a AS (SELECT median(own) AS oa FROM o WHERE n >= 500)
SELECT image_id, filter, n, round(coalesce(CASE WHEN n >= 500 THEN own END, of, oa), 6) AS zp FROM o LEFT JOIN f USING (filter) CROSS JOIN a""")
def gaia_zp_fallback(matched, images, stars):
    d = matched.join(stars.select("source_id", "gmag"), "source_id").join(images.select("image_id", "filter"), "image_id").withColumn("d", F.col("gmag") - F.col("mag"))
    return rounded(robust.zero_points(d, "image_id", "filter", "d", 500))


@query("matched", "stars", sql="""WITH d AS (SELECT image_id, gmag - mag + 2 AS d FROM matched JOIN stars USING (source_id)), b AS (SELECT image_id, floor(d/0.05e0)::BIGINT AS b, count(*) AS n FROM d WHERE abs(d) < 1 GROUP BY 1, 2),
s AS (SELECT image_id, b + k AS b, sum(n*w) AS w FROM b, (VALUES (-1, 0.25e0), (0, 0.5e0), (1, 0.25e0)) v(k, w) GROUP BY 1, 2), p AS (SELECT image_id, (arg_max(b, w*1000000 - b) + 0.5e0)*0.05e0 AS peak FROM s GROUP BY 1)
SELECT image_id, round(any_value(peak), 6) AS peak, count(*) AS n, round(median(d), 6) AS zp FROM d JOIN p USING (image_id) WHERE abs(d - peak) < 0.15e0 GROUP BY 1""")
def mode_zp_histogram(matched, stars):
    d = matched.join(stars.select("source_id", "gmag"), "source_id").withColumn("d", F.col("gmag") - F.col("mag") + 2.0)
    return rounded(robust.mode_zero_point(d, "image_id", "d"))


@query("matched", sql="""WITH m AS (SELECT source_id, count(*) AS n, median(mag) AS med, sum(mag/(mag_err*mag_err))/sum(1/(mag_err*mag_err)) AS fm FROM matched GROUP BY 1),
d AS (SELECT source_id, n, med, fm, median(abs(mag-med))*1.4826e0 AS s FROM matched JOIN m USING (source_id) GROUP BY ALL),
k AS (SELECT source_id, mag, mag_err, n < 3 OR abs(mag-fm) <= greatest(s, 0.05e0) AS ok FROM matched JOIN d USING (source_id))
SELECT source_id, count(*) AS n, CASE WHEN count(*) FILTER (ok) >= 2 THEN count(*) FILTER (ok) ELSE count(*) END AS n_used,
 round(CASE WHEN count(*) FILTER (ok) >= 2 THEN sum(mag/(mag_err*mag_err)) FILTER (ok)/sum(1/(mag_err*mag_err)) FILTER (ok) ELSE sum(mag/(mag_err*mag_err))/sum(1/(mag_err*mag_err)) END, 6) AS mag FROM k GROUP BY 1""")
def mag_outlier_reject(matched):
    return rounded(robust.reject_outliers(matched, "source_id", "mag", "mag_err", 1.0, 0.05))


@query("stars", sql="""WITH m AS (SELECT median(pmra) AS mx, median(pmdec) AS my FROM stars), s AS (SELECT any_value(mx) AS mx, any_value(my) AS my, greatest(median(abs(pmra-mx))*1.4826e0, median(abs(pmdec-my))*1.4826e0, 0.1e0)*4 AS h FROM stars, m)
SELECT round(mx-h, 6) AS x_low, round(mx+h, 6) AS x_high, round(my-h, 6) AS y_low, round(my+h, 6) AS y_high FROM s""")
def vpd_limits(stars):
    return rounded(robust.limits(stars, "pmra", "pmdec"))


@query("stars", sql="SELECT round(max(ra) + (max(ra)-min(ra))*0.05e0, 6) AS ra_left, round(min(ra) - (max(ra)-min(ra))*0.05e0, 6) AS ra_right, round(min(dec) - (max(dec)-min(dec))*0.05e0, 6) AS dec_low, round(max(dec) + (max(dec)-min(dec))*0.05e0, 6) AS dec_high FROM stars")
def sky_extent(stars):
    return rounded(robust.extent(stars, "ra", "dec"))


@query("matched", "images", sql="SELECT filter, count(*) AS n, round(avg((mag-20)/mag_err), 6) AS mean, round(stddev_samp((mag-20)/mag_err), 6) AS std FROM matched JOIN images USING (image_id) GROUP BY 1")
def pull_summary(matched, images):
    return rounded(robust.pulls(matched.join(images.select("image_id", "filter"), "image_id"), ["filter"], F.col("mag") - 20, F.col("mag_err")))


@query("matched", sql="SELECT image_id, source_id, round(cume_dist() OVER (PARTITION BY image_id ORDER BY chi2), 6) AS ecdf FROM matched")
def ecdf(matched):
    return rounded(robust.ecdf(matched, ["image_id"], "chi2").select("image_id", "source_id", "ecdf"))


@query("matched", sql="""WITH b AS (SELECT floor(mag/0.5e0)::BIGINT AS bin, count(chi2) AS n, median(mag_err) AS med, (quantile_cont(mag_err, 0.84) - quantile_cont(mag_err, 0.16))/2 AS h FROM matched GROUP BY 1)
SELECT bin, round((bin+0.5e0)*0.5e0, 6) AS centre, n, round(med, 6) AS median, round(h, 6) AS half_width, round((2*med + coalesce(lag(med) OVER (ORDER BY bin), med) + coalesce(lead(med) OVER (ORDER BY bin), med))/4, 6) AS smooth FROM b""")
def running_medians(matched):
    return rounded(robust.running_medians(matched, "mag_err", "mag", 0.5))


@query("detections", sql="SELECT image_id, count(*) AS n, count(*) FILTER (is_star) AS n_star, round(median(qfit), 6) AS qfit_median, round(quantile_cont(chi2, 0.9), 6) AS chi2_p90, round(min(mag), 6) AS mag_min, round(max(mag), 6) AS mag_max, count(DISTINCT source_id) AS n_sources, bit_or(dq) AS dq FROM detections GROUP BY 1")
def catalogue_summary(det):
    return rounded(det.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if("is_star").alias("n_star"), F.median("qfit").alias("qfit_median"), F.percentile("chi2", 0.9).alias("chi2_p90"), F.min("mag").alias("mag_min"), F.max("mag").alias("mag_max"), F.count_distinct("source_id").alias("n_sources"), F.bit_or("dq").alias("dq")))


PAIRS = """m AS (SELECT image_id AS i, source_id AS s, mag FROM matched),
h AS (SELECT a.i AS a, b.i AS b, median(a.mag - b.mag) AS zp, count(*) AS n FROM m a JOIN m b ON a.s = b.s AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 3), e AS (SELECT a, b, zp, n FROM h UNION ALL SELECT b, a, -zp, n FROM h)"""


def overlaps(matched):
    return relational.image_pairs(matched, "image_id", "source_id", "mag")


@query("matched", sql=f"WITH {PAIRS} SELECT a, b, round(zp, 6) AS zp, n FROM e")
def pairwise_zp(matched):
    return rounded(overlaps(matched))


@query("matched", sql=f"WITH RECURSIVE {PAIRS}, reach(node, nd) AS (SELECT DISTINCT a, a FROM e UNION SELECT node, b FROM reach JOIN e ON nd = a) SELECT node, min(nd) AS component FROM reach GROUP BY 1")
def image_overlap_components(matched):
    edges = Rounds(matched.sparkSession).keep(overlaps(matched).select("a", "b"), "edges")  # every round reads them
    return graph.components(edges.select(F.col("a").alias("node")).distinct(), edges)


def _zp(matched):
    edges = Rounds(matched.sparkSession).keep(overlaps(matched), "edges")  # every round and level reads them
    labels = graph.components(edges.select(F.col("a").alias("node")).distinct(), edges)
    sizes = matched.groupBy(F.col("image_id").alias("node")).agg(F.count("*").alias("n"))
    return graph.propagate_zero_points(labels, graph.references(sizes, labels), edges)


@query("matched", sql=f"""WITH RECURSIVE {PAIRS}, reach(node, nd) AS (SELECT DISTINCT a, a FROM e UNION SELECT node, b FROM reach JOIN e ON nd = a), comp AS (SELECT node, min(nd) AS component FROM reach GROUP BY 1),
sz AS (SELECT image_id AS node, count(*) AS n FROM matched GROUP BY 1), ref AS (SELECT component, arg_min(node, -n*1000000 + node) AS reference FROM comp JOIN sz USING (node) GROUP BY 1),
far(node, depth) AS (SELECT reference, 0 FROM ref UNION SELECT b, depth + 1 FROM far JOIN e ON node = a WHERE depth < 6), d AS (SELECT node, min(depth) AS depth FROM far GROUP BY 1),
par AS (SELECT c.node, min(p.node) AS parent FROM d c JOIN e ON e.b = c.node JOIN d p ON p.node = e.a AND p.depth = c.depth - 1 GROUP BY 1),
z(node, zp, depth) AS (SELECT reference, 0.0::DOUBLE, 0 FROM ref UNION ALL SELECT par.node, z.zp + e.zp, z.depth + 1 FROM z JOIN par ON par.parent = z.node JOIN e ON e.a = z.node AND e.b = par.node)
SELECT node, round(zp, 6) AS zp, depth FROM z""")
def zp_bfs(matched):
    return rounded(_zp(matched))


@query("matched", sql="SELECT a.image_id AS a, b.image_id AS b, count(*) AS n FROM matched a JOIN matched b ON a.source_id = b.source_id AND a.image_id < b.image_id GROUP BY 1, 2")
def image_pair_shared_counts(matched):
    a, b = matched.select("source_id", F.col("image_id").alias("a")), matched.select("source_id", F.col("image_id").alias("b"))
    return a.join(b, "source_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("images", sql="SELECT image_name, filter, camera, round(epoch_mjd, 6) AS epoch_mjd, round(true_zp, 6) AS zp FROM images")
def eav_pivot(images):
    long = relational.unpivot_columns(images.select("image_name", "filter", "camera", F.col("epoch_mjd").cast("string").alias("epoch_mjd"), F.col("true_zp").cast("string").alias("zp")), ["image_name"], ["filter", "camera", "epoch_mjd", "zp"], "parameter")
    wide = relational.pivot_parameters(long, "image_name", ["filter", "camera", "epoch_mjd", "zp"])
    return wide.select("image_name", "filter", "camera", r(F.col("epoch_mjd").cast("double")).alias("epoch_mjd"), r(F.col("zp").cast("double")).alias("zp"))


@query("matched", "images", sql="SELECT source_id, round(avg(mag) FILTER (filter='F475W'), 6) AS mag_F475W, round(avg(mag) FILTER (filter='F606W'), 6) AS mag_F606W, round(avg(mag) FILTER (filter='F814W'), 6) AS mag_F814W, count(DISTINCT filter) AS n_filters, string_agg(DISTINCT filter, ',' ORDER BY filter) AS filter_list FROM matched JOIN images USING (image_id) GROUP BY 1")
def per_filter_pivot(matched, images):
    d = matched.join(images.select("image_id", "filter"), "image_id")
    by = [F.avg(F.when(F.col("filter") == f, F.col("mag"))) for f in ("F475W", "F606W", "F814W")]
    return d.groupBy("source_id").agg(*[r(c).alias(f"mag_{f}") for c, f in zip(by, ("F475W", "F606W", "F814W"), strict=True)], F.count_distinct("filter").alias("n_filters"), F.array_join(F.array_sort(F.collect_set("filter")), ",").alias("filter_list"))


@query("matched", "images", "stars", sql="""WITH w AS (SELECT m.source_id, avg(mag) FILTER (filter='F475W') AS a, avg(mag) FILTER (filter='F606W') AS b, avg(mag) FILTER (filter='F814W') AS c FROM matched m JOIN images USING (image_id) GROUP BY 1),
l AS (SELECT source_id, unnest(['F475W','F606W','F814W']) AS filter, unnest([a,b,c]) AS mag FROM w) SELECT filter, count(*) AS n, round(median(mag - gmag), 6) AS colour FROM l JOIN stars USING (source_id) WHERE mag IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""")
def colour_offset_unpivot(matched, images, stars):
    wide = per_filter_means(matched, images)
    long = relational.unpivot_columns(wide, ["source_id"], ["F475W", "F606W", "F814W"], "filter", "mag").where("mag IS NOT NULL")
    return rounded(long.join(stars.select("source_id", "gmag"), "source_id").groupBy("filter").agg(F.count("*").alias("n"), F.median(F.col("mag") - F.col("gmag")).alias("colour")).where("n >= 5"))


def per_filter_means(matched, images):
    d = matched.join(images.select("image_id", "filter"), "image_id")
    return d.groupBy("source_id").agg(*[F.avg(F.when(F.col("filter") == f, F.col("mag"))).alias(f) for f in ("F475W", "F606W", "F814W")])


ROLL = """d AS (SELECT m.*, i.image_name, i.filter || '_' || i.camera AS fc, gmag FROM matched m JOIN images i USING (image_id) JOIN stars USING (source_id)),
c AS (SELECT source_id, fc, count(*) AS n_images, list(image_name ORDER BY image_name) AS images, list(catalog_index ORDER BY image_name) AS indices, median(mag_err) AS mag_norm_mad, count(*) FILTER (qfit < 0.9) AS n_trustworthy, bool_and(qfit < 0.9) AS all_trustworthy, bool_or(qfit < 0.9) AS any_trustworthy,
 min_by(gmag, image_name) AS gaia_gmag, median(chi2) AS median_residual_sigma, bool_and(is_star) AS is_star_all_images, bool_or(is_star) AS is_star_any_image, list_sort(coalesce(list(image_name) FILTER (NOT is_star), [])) AS non_star_images FROM d GROUP BY 1, 2)"""


def rolled(matched, images, stars):
    d = matched.join(images.select("image_id", "image_name", F.concat_ws("_", "filter", "camera").alias("filter_camera")), "image_id").join(stars.select("source_id", "gmag"), "source_id")
    d = d.select("source_id", "filter_camera", "image_name", "catalog_index", F.col("mag_err").alias("mag_mad"), (F.col("qfit") < 0.9).alias("trusted"), "is_star", F.col("chi2").alias("sigma"), "gmag")
    return relational.catalogue_rollup(d, ["source_id", "filter_camera"])


@query("matched", "images", "stars", sql=f"WITH {ROLL} SELECT source_id, fc AS filter_camera, n_images, array_to_string(images, ',') AS images, array_to_string(indices, ',') AS indices, round(mag_norm_mad, 6) AS mag_norm_mad, n_trustworthy, all_trustworthy, any_trustworthy, round(gaia_gmag, 6) AS gaia_gmag, round(median_residual_sigma, 6) AS median_residual_sigma, is_star_all_images, is_star_any_image, array_to_string(non_star_images, ',') AS non_star_images FROM c")
def cross_match_rollup(matched, images, stars):
    c = rounded(rolled(matched, images, stars))
    return c.withColumns({k: F.array_join(k, ",") for k in ("images", "indices", "non_star_images")})


@query("matched", "images", "stars", sql=f"""WITH {ROLL}, x AS (SELECT source_id, unnest(images) AS image_name, n_trustworthy = 0 OR NOT is_star_any_image OR list_contains(non_star_images[1:1], unnest(images)) AS bad FROM c), b AS (SELECT source_id, image_name, bool_or(bad) AS bad FROM x GROUP BY 1, 2)
SELECT image_name, d.source_id, coalesce(NOT bad, true) AS use_for_fit FROM d LEFT JOIN b USING (source_id, image_name)""")
def trust_explode_join(matched, images, stars):
    cat = rolled(matched, images, stars).withColumn("outlier_images", F.slice("non_star_images", 1, 1))
    d = matched.join(images.select("image_id", "image_name"), "image_id").select("image_name", "source_id")
    return relational.trusted_detections(d, cat, "source_id", "image_name")


@query("detections", sql="""WITH n AS (SELECT image_id, count(*) FILTER (y <= 300) AS lo, count(*) FILTER (y > 300) AS hi FROM detections GROUP BY 1), s AS (SELECT CAST(image_id AS VARCHAR) || CASE WHEN lo >= 44 AND hi >= 44 THEN CASE WHEN y <= 300 THEN '_lo' ELSE '_hi' END ELSE '' END AS sub_name FROM detections JOIN n USING (image_id))
SELECT sub_name, count(*) AS n FROM s GROUP BY 1""")
def chip_split(det):
    return relational.split_chips(det, "image_id", "y", 300.0, 44).groupBy("sub_name").agg(F.count("*").alias("n"))


@query("detections", sql="SELECT CAST(image_id AS VARCHAR) || '_' || CASE WHEN x <= 2048 THEN 'l' ELSE 'r' END || CASE WHEN y <= 2048 THEN 'lo' ELSE 'hi' END AS sub_name, count(*) AS n FROM detections GROUP BY 1")
def amp_split(det):
    return relational.split_amplifiers(det, "image_id", "x", "y").groupBy("sub_name").agg(F.count("*").alias("n"))


@query("detections", "images", sql="SELECT image_name, filter, n AS n_exp FROM images JOIN (SELECT image_id, count(*) AS n FROM detections WHERE qfit < 0.5 GROUP BY 1) USING (image_id) WHERE filter IN ('F606W','F814W') AND n >= 100")
def exposure_count_join(det, images):
    n = det.where("qfit < 0.5").groupBy("image_id").agg(F.count("*").alias("n_exp")).where("n_exp >= 100")
    return relational.restrict(images, filters=["F606W", "F814W"]).join(n, "image_id").select("image_name", "filter", "n_exp")


@query("stars", "detections", sql="SELECT source_id, round(gmag, 6) AS gmag FROM stars WHERE source_id IN (SELECT source_id FROM detections WHERE qfit > 0.96)")
def semi_join_observed(stars, det):
    return rounded(stars.join(det.where("qfit > 0.96"), "source_id", "left_semi").select("source_id", "gmag"))


@query("stars", "detections", sql="SELECT source_id, round(gmag, 6) AS gmag FROM stars WHERE source_id NOT IN (SELECT source_id FROM detections WHERE qfit > 0.96)")
def anti_join_unanchored(stars, det):
    return rounded(stars.join(det.where("qfit > 0.96"), "source_id", "left_anti").select("source_id", "gmag"))


@query("stars", "detections", sql="SELECT source_id, gmag, origin FROM (SELECT source_id, round(gmag, 6) AS gmag, 'gaia' AS origin FROM stars UNION ALL SELECT DISTINCT source_id + 1000000, NULL, 'hst' FROM detections WHERE qfit < 0.04)")
def union_catalogues(stars, det):
    a = stars.select("source_id", r(F.col("gmag")).alias("gmag"), F.lit("gaia").alias("origin"))
    return a.unionByName(det.where("qfit < 0.04").select((F.col("source_id") + 1000000).alias("source_id"), F.lit("hst").alias("origin")).distinct(), allowMissingColumns=True)


@query("matched", "images", sql="""WITH f AS (SELECT source_id, filter FROM matched JOIN images USING (image_id) WHERE qfit > 0.9)
SELECT source_id FROM (SELECT source_id FROM f WHERE filter = 'F606W' INTERSECT SELECT source_id FROM f WHERE filter = 'F814W' EXCEPT SELECT source_id FROM f WHERE filter = 'F475W')""")
def set_operations(matched, images):
    """Stars that two filters have well, and a third one hasn't."""
    f = matched.where("qfit > 0.9").join(images.select("image_id", "filter"), "image_id")
    one = lambda name: f.where(F.col("filter") == name).select("source_id")
    return one("F606W").intersect(one("F814W")).subtract(one("F475W"))


@query("stars", sql="SELECT source_id, -row_number() OVER (ORDER BY pmra_error, source_id) AS hst_id FROM stars")
def negative_ids(stars):
    return relational.negative_ids(stars.select("source_id", "pmra_error"), [F.col("pmra_error"), F.col("source_id")]).select("source_id", "hst_id")


@query("matched", sql="SELECT image_id, source_id, k AS rank FROM (SELECT image_id, source_id, row_number() OVER (PARTITION BY image_id ORDER BY mag, source_id)::INT AS k FROM matched) WHERE k <= 10")
def top_n_per_image(matched):
    return relational.top_per_group(matched, ["image_id"], [F.col("mag"), F.col("source_id")], 10).select("image_id", "source_id", "rank")


def _sides(det):
    """Two lists of positions per image: rows with small and with large qfit."""
    a = det.where("qfit <= 0.5").select("image_id", F.col("catalog_index").alias("a"), "x", "y")
    b = det.where("qfit > 0.5").select("image_id", F.col("catalog_index").alias("b"), "x", "y")
    return a, b


SIDES = """a AS (SELECT image_id, catalog_index AS a, x AS ax, y AS ay FROM detections WHERE qfit <= 0.5), b AS (SELECT image_id, catalog_index AS b, x AS bx, y AS by_ FROM detections WHERE qfit > 0.5),
p AS (SELECT image_id, a, b, sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay)) AS d FROM a JOIN b USING (image_id) WHERE (bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) <= 40000.0)"""


@query("detections", sql=f"WITH {SIDES} SELECT image_id, a, b, k AS rank, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY image_id, a ORDER BY d, b)::INT AS k FROM p) WHERE k <= 5")
def knn5_within_radius(det):
    a, b = _sides(det)
    return rounded(spatial.nearest(a, b, 200.0, 5, ["a"], "b", ("image_id",)).select("image_id", "a", "b", "rank", "distance"))


@query("detections", sql=f"WITH {SIDES} SELECT image_id, a, b, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY image_id, a ORDER BY d, b) AS k FROM p WHERE d <= 50) WHERE k = 1")
def nearest_within_radius(det):
    a, b = _sides(det)
    return rounded(spatial.nearest(a, b, 50.0, 1, ["a"], "b", ("image_id",)).select("image_id", "a", "b", "distance"))


@query("detections", sql=f"WITH {SIDES}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, a ORDER BY d, b) AS k FROM p) WHERE k = 1) SELECT image_id, a, b, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY image_id, b ORDER BY d, a) AS k2 FROM f) WHERE k2 = 1")
def two_step_dedup(det):
    a, b = _sides(det)
    p = spatial.pairs_within(a, b, 200.0, ("image_id",))
    out = matching.first_per(matching.first_per(p, ["image_id", "a"], ["distance", "b"]), ["image_id", "b"], ["distance", "a"])
    return rounded(out.select("image_id", "a", "b", "distance"))


@query("detections", sql=f"""WITH RECURSIVE {SIDES}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d, a, b) AS k FROM p),
g(image_id, k, a, b, d, won, ta, tb) AS (SELECT image_id, k, a, b, d, true, [a], [b] FROM o WHERE k = 1 UNION ALL SELECT image_id, k, a, b, d, free, CASE WHEN free THEN list_append(ta, a) ELSE ta END, CASE WHEN free THEN list_append(tb, b) ELSE tb END
 FROM (SELECT o.*, g.ta, g.tb, NOT list_contains(g.ta, o.a) AND NOT list_contains(g.tb, o.b) AS free FROM g JOIN o ON o.image_id = g.image_id AND o.k = g.k + 1)) SELECT image_id, a, b, round(d, 6) AS distance FROM g WHERE won""")
def greedy_match(det):
    """One-to-one pairs, nearest first; the SQL takes an image's pairs one after the other."""
    a, b = _sides(det)
    p = spatial.pairs_within(a, b, 200.0, ("image_id",)).select("image_id", "a", "b", "distance")
    return rounded(matching.greedy(p, "a", "b", "distance", ("image_id",)))


@query("detections", sql="""WITH g AS MATERIALIZED (SELECT image_id, catalog_index AS i, x, y, image_id || ':' || floor(x/50)::BIGINT || ':' || floor(y/50)::BIGINT AS cell FROM detections),
n AS MATERIALIZED (SELECT image_id, catalog_index AS i, x, y, image_id || ':' || (floor(x/50)::BIGINT + u) || ':' || (floor(y/50)::BIGINT + v) AS cell FROM detections, (VALUES (-1),(0),(1)) p(u), (VALUES (-1),(0),(1)) q(v)),
j AS MATERIALIZED (SELECT n.image_id, n.i AS a, g.i AS b, (n.x-g.x)*(n.x-g.x) + (n.y-g.y)*(n.y-g.y) AS d FROM n JOIN g USING (cell))
SELECT image_id, a, b, round(sqrt(d), 6) AS distance FROM j WHERE a < b AND d <= 2500.0""")
def close_pairs(det):
    return rounded(spatial.close_pairs(det, 50.0, "catalog_index", ("image_id",)))


@query("detections", sql="""WITH n AS (SELECT p.image_id, p.catalog_index, p.mag AS m, q.mag AS qm, sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)) AS d FROM detections p JOIN detections q ON p.image_id = q.image_id AND p.catalog_index <> q.catalog_index WHERE (p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) <= 10000.0)
SELECT d.image_id, d.catalog_index, count(n.d) AS n_near, round(min(n.d), 6) AS nearest, round(min(n.d) FILTER (qm < m), 6) AS nearest_brighter FROM detections d LEFT JOIN n USING (image_id, catalog_index) GROUP BY 1, 2""")
def neighbour_stats(det):
    return rounded(spatial.neighbours_in_tiles(det, 100.0, "catalog_index", "mag", ("image_id",)))


@query("detections", sql="""WITH t AS (SELECT image_id, catalog_index, mag, x, y FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mag, catalog_index) AS k FROM detections) WHERE k <= 1000), a AS (SELECT image_id, x, y, floor(x/100)::BIGINT + u AS cx, floor(y/100)::BIGINT + v AS cy FROM t, (VALUES (-1),(0),(1)) p(u), (VALUES (-1),(0),(1)) q(v)),
b AS (SELECT image_id, x + 47 AS x, y - 31 AS y, floor((x + 47)/100)::BIGINT AS cx, floor((y - 31)/100)::BIGINT AS cy FROM t), d AS (SELECT image_id, floor((b.x - a.x)/2)::BIGINT AS i, floor((b.y - a.y)/2)::BIGINT AS j FROM a JOIN b USING (image_id, cx, cy) WHERE abs(b.x - a.x) <= 100 AND abs(b.y - a.y) <= 100),
h AS (SELECT image_id, i, j, count(*) AS w FROM d GROUP BY 1, 2, 3), s AS (SELECT image_id, i + u AS i, j + v AS j, sum(w)::BIGINT AS votes FROM h, (VALUES (-1),(0),(1)) p(u), (VALUES (-1),(0),(1)) q(v) GROUP BY 1, 2, 3)
SELECT image_id, round((i+0.5e0)*2, 6) AS dx, round((j+0.5e0)*2, 6) AS dy, round(votes::DOUBLE, 6) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, i, j) AS k FROM s) WHERE k = 1""")
def offset_histogram_peak(det):
    t = spatial.brightest(det, ("image_id",), "mag", "catalog_index", 1000)
    a = t.select("image_id", "x", "y")
    b = t.select("image_id", (F.col("x") + 47).alias("x"), (F.col("y") - 31).alias("y"))
    return rounded(spatial.offset_peaks(a, b, ("image_id",), 100.0, 2.0).drop("scale"))


@query("stars", "images", sql="WITH b AS (SELECT image_id AS id, 150.0e0 + image_id*0.0005e0 AS r0, 150.05e0 + image_id*0.001e0 AS r1, 2.02e0 AS d0, 2.06e0 + image_id*0.0007e0 AS d1 FROM images) SELECT id, count(ra) AS n FROM b LEFT JOIN stars ON ra BETWEEN r0 AND r1 AND dec BETWEEN d0 AND d1 GROUP BY 1")
def footprint_count(stars, images):
    i = F.col("image_id")
    boxes = images.select(i.alias("id"), (i * 0.0005 + 150.0).alias("ra_min"), (i * 0.001 + 150.05).alias("ra_max"), F.lit(2.02).alias("dec_min"), (i * 0.0007 + 2.06).alias("dec_max"))
    return spatial.footprint_counts(boxes, stars, 0.02)


@query("matched", sql="""WITH c AS (SELECT image_id, source_id % 400 AS item, source_id AS owner, mag FROM matched), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, item ORDER BY mag, owner) AS k FROM c) WHERE k = 1), n AS (SELECT owner, count(*) AS n_owned FROM w GROUP BY 1 HAVING count(*) >= 2)
SELECT image_id, item, owner, n_owned FROM w JOIN n USING (owner)""")
def first_owner_dedup(matched):
    c = matched.select("image_id", (F.col("source_id") % 400).alias("item"), F.col("source_id").alias("owner"), "mag")
    return matching.first_owner(c, ["image_id", "item"], "owner", ["mag", "owner"]).drop("mag")


@query("matched", "images", sql="""WITH d AS (SELECT source_id, 2000.0e0 + (epoch_mjd-51544.5e0)/365.25e0 AS t, x, y, sqrt(cov_xx) AS sx, sqrt(cov_yy) AS sy FROM matched JOIN images USING (image_id)), m AS (SELECT source_id, avg(t) AS e, count(*) AS n, count(DISTINCT t) AS k FROM d GROUP BY 1),
s AS (SELECT source_id, any_value(e) AS e, any_value(n) AS n, any_value(k) AS k, sum(1/(sx*sx)) AS w, sum((t-e)/(sx*sx)) AS wt, sum((t-e)*(t-e)/(sx*sx)) AS wtt, sum(x/(sx*sx)) AS wv, sum(x*(t-e)/(sx*sx)) AS wtv FROM d JOIN m USING (source_id) GROUP BY 1)
SELECT source_id, round(e, 4) AS epoch, n, round(CASE WHEN k > 1 THEN (wtt*wv - wt*wtv)/(w*wtt - wt*wt) ELSE wv/w END, 4) AS x0, round(CASE WHEN k > 1 THEN (w*wtv - wt*wv)/(w*wtt - wt*wt) ELSE 0 END, 4) AS pm_x, round(CASE WHEN k > 1 THEN sqrt(w/(w*wtt - wt*wt)) END, 6) AS sigma_pm_x FROM s""")
def wls_pm_fit(matched, images):
    from skyspark.functions.sky import mjd_to_year

    d = matched.join(images.select("image_id", mjd_to_year(F.col("epoch_mjd")).alias("t")), "image_id").select("source_id", "t", "x", "y", F.sqrt("cov_xx").alias("sx"), F.sqrt("cov_yy").alias("sy"))
    p = fits.proper_motion(d, ["source_id"], "t", "x", "sx", "y", "sy")
    return p.select("source_id", r(F.col("epoch"), 4).alias("epoch"), "n", r(F.col("x0"), 4).alias("x0"), r(F.col("pm_x"), 4).alias("pm_x"), r(F.col("sigma_pm_x")).alias("sigma_pm_x"))


def _affine_rows(det):
    return det.select("image_id", F.col("x").alias("xs"), F.col("y").alias("ys"), (F.col("x") * 1.001 + F.col("y") * 0.002 + 3 + F.col("mag") * 0.01).alias("xt"), (F.col("y") * 1.001 - F.col("x") * 0.002 - 5 + F.col("qfit") * 0.1).alias("yt"), F.col("cov_xx").alias("cxx"), F.col("cov_xy").alias("cxy"), F.col("cov_yy").alias("cyy"))


@query("detections", sql="""WITH d AS (SELECT image_id, x AS xs, y AS ys, 1.001e0*x + 0.002e0*y + 3 + 0.01e0*mag AS xt, cov_xx, cov_xy, cov_yy, cov_xx*cov_yy - cov_xy*cov_xy AS det FROM detections), m AS (SELECT image_id, avg(xs) AS xo, avg(ys) AS yo, avg(xt) AS to_ FROM d GROUP BY 1)
SELECT image_id, count(*) AS n, round(avg(xs), 6) AS xs_o, round(sum(cov_yy/det), 3) AS w, round(sum((xs-xo)*cov_yy/det)/1000, 3) AS wx, round(sum((xs-xo)*(ys-yo)*cov_yy/det)/1000000, 3) AS wxy FROM d JOIN m USING (image_id) GROUP BY 1""")
def normal_equation_moments(det):
    m = fits.affine_moments(_affine_rows(det), ["image_id"])
    return m.select("image_id", "n", r(F.col("xs_o")).alias("xs_o"), r(F.col("g22xx"), 3).alias("w"), r(F.col("g02xx") / 1000, 3).alias("wx"), r(F.col("g01xx") / 1e6, 3).alias("wxy"))


def _fit_sql(basis: list[list[int]], prior: dict[tuple[int, int], str], target: dict[int, str]) -> str:
    """SQL of a weighted affine fit's deviation from the identity: sums, normal equations of the parameters that ``basis`` (6 x p) leaves, and their elimination step by step."""
    n = len(basis[0])
    g, w = ("p", "q", "1.0e0"), {(0, 0): "wx", (0, 1): "w", (1, 1): "wy"}
    entry = lambda k, m: (min(k // 3, m // 3), max(k // 3, m // 3), min(k % 3, m % 3), max(k % 3, m % 3))
    sums = {(*h, a, b): f"sum({g[a]}*{g[b]}*{c}) AS g{h[0]}{h[1]}{a}{b}" for h, c in w.items() for a in range(3) for b in range(a, 3)}
    right = [f"sum({g[k % 3]}*({'wx*u + w*v' if k < 3 else 'w*u + wy*v'})) AS r{k}" for k in range(6)]

    def linear(pairs):
        return " + ".join(f"({f})*{c}" for f, c in pairs if f) or "0.0e0"

    lhs = [[linear([(basis[k][i] * basis[m][j], "g{}{}{}{}".format(*entry(k, m))) for k in range(6) for m in range(6)]) + (f" + {prior[i, j]}" if (i, j) in prior else "") for j in range(n)] for i in range(n)]
    rhs = [linear([(basis[k][i], f"r{k}") for k in range(6)]) + (f" + {target[i]}" if i in target else "") for i in range(n)]
    rows = ", ".join("[" + ", ".join([*lhs[i], rhs[i]]) + "]" for i in range(n))
    keep = "image_id, n, xo, yo, uo, vo, uu, lhs"
    steps = [f"e{k} AS (SELECT {keep}, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 2}), lambda j: CASE WHEN i = {k} THEN m[i][j]/m[{k}][{k}] ELSE m[i][j] - m[i][{k}]*m[{k}][j]/m[{k}][{k}] END)) AS m FROM e{k - 1})" for k in range(1, n + 1)]
    full = [linear([(basis[k][i], f"m[{i + 1}][{n + 1}]") for i in range(n)]) for k in range(6)]
    quad = " + ".join(f"f{k}*f{m}*lhs[{6 * k + m + 1}]" for k in range(6) for m in range(6))
    return f"""WITH d AS (SELECT image_id, x AS xs, y AS ys, x*1.001e0 + y*0.002e0 + 3 + mag*0.01e0 AS xt, y*1.001e0 - x*0.002e0 - 5 + qfit*0.1e0 AS yt, cov_xx, cov_xy, cov_yy, cov_xx*cov_yy - cov_xy*cov_xy AS det FROM detections),
c AS (SELECT image_id, count(*) AS n, avg(xs) AS xo, avg(ys) AS yo, avg(xt) AS uo, avg(yt) AS vo FROM d GROUP BY 1),
t AS (SELECT image_id, n, xo, yo, uo, vo, xs - xo AS p, ys - yo AS q, xt - uo - (xs - xo) AS u, yt - vo - (ys - yo) AS v, cov_yy/det AS wx, -cov_xy/det AS w, cov_xx/det AS wy FROM d JOIN c USING (image_id)),
s AS (SELECT image_id, n, xo, yo, uo, vo, {", ".join(sums.values())}, {", ".join(right)}, sum(wx*u*u + 2*w*u*v + wy*v*v) AS uu FROM t GROUP BY ALL),
e0 AS (SELECT image_id, n, xo, yo, uo, vo, uu, [{", ".join("g{}{}{}{}".format(*entry(k, m)) for k in range(6) for m in range(6))}, {", ".join(f"r{k}" for k in range(6))}] AS lhs, [{rows}] AS m FROM s), {", ".join(steps)},
f AS (SELECT *, {", ".join(f"{x} AS f{k}" for k, x in enumerate(full))} FROM e{n})
SELECT image_id, n, round(1 + f0, 5) AS a, round(f1, 5) AS b, round(f3, 5) AS c, round(1 + f4, 5) AS d, round(xo, 5) AS xs_o, round(yo, 5) AS ys_o, round(uo + f2, 5) AS xt_o, round(vo + f5, 5) AS yt_o,
 round(uu - 2*({" + ".join(f"f{k}*lhs[{37 + k}]" for k in range(6))}) + ({quad}), 4) AS chi2 FROM f"""


SIX = [[int(i == j) for j in range(6)] for i in range(6)]
FOUR = [[1, 0, 0, 0], [0, -1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1]]


@query("detections", sql=_fit_sql(SIX, {(0, 0): "1e8", (4, 4): "1e8", (0, 4): "-1e8", (4, 0): "-1e8", (1, 1): "1e8", (3, 3): "1e8", (1, 3): "1e8", (3, 1): "1e8"}, {}))
def affine_six(det):
    """Weighted affine fit of each image."""
    return _fitted(fits.affine(_affine_rows(det), ["image_id"]))


@query("detections", sql=_fit_sql(FOUR, {(0, 0): "1/(0.02e0*0.02e0)", (1, 1): "1/(0.0035e0*0.0035e0)"}, {}))
def affine_four(det):
    """Weighted similarity fit of each image."""
    return _fitted(fits.similarity(_affine_rows(det), ["image_id"], scale=1.0))


def _fitted(f):
    return rounded(f.drop("chi2"), 5).join(rounded(f.select("image_id", "chi2"), 4), "image_id")


@query("detections", sql="""WITH d AS (SELECT image_id, floor(x/512)::BIGINT AS i, floor(y/512)::BIGINT AS j, x/512 - floor(x/512) AS u, y/512 - floor(y/512) AS v, flux FROM detections)
SELECT image_id, i + a AS i, j + b AS j, round(sum(flux * CASE a WHEN 0 THEN 1-u ELSE u END * CASE b WHEN 0 THEN 1-v ELSE v END), 3) AS flux, round(sum(CASE a WHEN 0 THEN 1-u ELSE u END * CASE b WHEN 0 THEN 1-v ELSE v END), 6) AS weight FROM d, (VALUES (0),(1)) p(a), (VALUES (0),(1)) q(b) GROUP BY 1, 2, 3""")
def drizzle_accumulate(det):
    from skyspark.operators.images import drizzle

    d = drizzle(det, ["image_id"], F.col("x") / 512, F.col("y") / 512, F.col("flux"))
    return d.select("image_id", "i", "j", r(F.col("value"), 3).alias("flux"), r(F.col("weight")).alias("weight"))


@query("detections", sql="SELECT image_id, source_id, round(max(flux), 4) AS most FROM detections GROUP BY 1, 2 ORDER BY most DESC, image_id, source_id LIMIT 25")
def influence_topn(det):
    return det.groupBy("image_id", "source_id").agg(r(F.max("flux"), 4).alias("most")).orderBy(F.desc("most"), "image_id", "source_id").limit(25)


@query("matched", sql="SELECT image_id, round(sqrt(median(chi2)/(2*ln(2.0e0))), 6) AS alpha, round(sum(least(1, 7/(5+chi2))), 6) AS n_eff, count(*) AS n FROM matched GROUP BY 1")
def alpha_inflation(matched):
    return matched.groupBy("image_id").agg(r(F.sqrt(F.median("chi2") / (2 * math.log(2)))).alias("alpha"), r(F.sum(F.least(F.lit(1.0), F.lit(7.0) / (F.col("chi2") + 5)))).alias("n_eff"), F.count("*").alias("n"))


@query("matched", "images", sql="""SELECT image_name, filter, n_matched, status FROM (SELECT image_name, filter, coalesce(n, 0) AS n_matched, CASE WHEN n IS NULL THEN 'no_matches' WHEN n < 500 THEN 'few_matches' ELSE 'success' END AS status FROM images LEFT JOIN (SELECT image_id, count(*) AS n FROM matched GROUP BY 1) USING (image_id))""")
def status_decision(matched, images):
    n = matched.groupBy("image_id").agg(F.count("*").alias("n_matched"))
    d = images.join(n, "image_id", "left")
    status = F.when(F.col("n_matched").isNull(), "no_matches").when(F.col("n_matched") < 500, "few_matches").otherwise("success")
    return d.select("image_name", "filter", F.coalesce("n_matched", F.lit(0)).alias("n_matched"), status.alias("status"))


@query("matched", "images", sql="SELECT image_id, source_id, round((mag - avg(mag) OVER (PARTITION BY source_id))/1.7e0, 6) AS residual, count(*) OVER (PARTITION BY source_id) AS n_images, row_number() OVER (PARTITION BY source_id ORDER BY epoch_mjd, image_id)::INT AS visit FROM matched JOIN images USING (image_id)")
def residual_dump(matched, images):
    s = Window.partitionBy("source_id")
    d = matched.join(images.select("image_id", "epoch_mjd"), "image_id")
    return d.select("image_id", "source_id", r((F.col("mag") - F.avg("mag").over(s)) / 1.7).alias("residual"), F.count("*").over(s).alias("n_images"), F.row_number().over(s.orderBy("epoch_mjd", "image_id")).alias("visit"))


@query("detections", sql="""WITH t AS (SELECT image_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mag, catalog_index) AS k FROM detections) WHERE k <= 200), a AS (SELECT image_id, s AS scale, x*(s + 1) AS x, y*(s + 1) AS y FROM t, (VALUES (-0.01e0), (0.0e0), (0.01e0)) v(s)), b AS (SELECT image_id, x*1.01e0 + 20 AS x, y*1.01e0 - 10 AS y FROM t),
d AS (SELECT image_id, scale, floor((b.x - a.x)/4)::BIGINT AS i, floor((b.y - a.y)/4)::BIGINT AS j FROM a JOIN b USING (image_id) WHERE abs(b.x - a.x) <= 60 AND abs(b.y - a.y) <= 60), h AS (SELECT image_id, scale, i, j, count(*) AS w FROM d GROUP BY 1, 2, 3, 4),
s AS (SELECT image_id, scale, i + u AS i, j + v AS j, sum(w)::BIGINT AS votes FROM h, (VALUES (-1),(0),(1)) p(u), (VALUES (-1),(0),(1)) q(v) GROUP BY 1, 2, 3, 4)
SELECT image_id, scale, round((i+0.5e0)*4, 6) AS dx, round((j+0.5e0)*4, 6) AS dy, round(votes::DOUBLE, 6) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, abs(scale), scale, i, j) AS k FROM s) WHERE k = 1""")
def scale_offset_sweep(det):
    """The change of scale and the shift that most pairs share, over trial scales."""
    t = spatial.brightest(det, ("image_id",), "mag", "catalog_index", 200)
    b = t.select("image_id", (F.col("x") * 1.01 + 20).alias("x"), (F.col("y") * 1.01 - 10).alias("y"))
    return rounded(spatial.offset_peaks(t.select("image_id", "x", "y"), b, ("image_id",), 60.0, 4.0, F.array(F.lit(-0.01), F.lit(0.0), F.lit(0.01))))
