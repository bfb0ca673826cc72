"""Queries over the association of detections to sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyspark.functions import sky as S
from skyspark.operators import association, masterlist, rounds, spatial
from skyspark.plans.adapters import oracle, view
from skyspark.plans.scalar import r
from skyspark.plans.tables import rounded

QUERIES, ORACLE = {}, {}


def query(*views: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(*[view(spark, d, v) for v in views])
        if sql:
            ORACLE[f.__name__] = oracle(sql, *views)
        return f

    return add


def positions(matched, stars, images):
    """Detections in a sky frame, a few mas about their star."""
    jitter = lambda c: (F.col(c) - F.floor(c) - 0.05) * 100.0
    d = matched.join(stars.select("source_id", "ra", "dec"), "source_id").join(images.select("image_id", "filter", F.col("epoch_mjd").alias("image_order")), "image_id")
    return d.select("filter", "image_order", F.col("image_id").alias("image"), F.col("catalog_index").alias("det"), "source_id", ((F.col("ra") - 150) * 3.6e6 + jitter("x")).alias("x"), ((F.col("dec") - 2) * 3.6e6 + jitter("y")).alias("y"), F.col("mag_err").alias("sigma"), "mag", "is_star")


@query("matched", "stars", "images")
def source_association(matched, stars, images):
    """Master list of each filter, tile by tile and image after image; tested for what must hold of it."""
    d = positions(matched, stars, images).drop("source_id", "is_star")
    d = rounds.Rounds(d.sparkSession).keep(d, "positions")  # read three times, made once
    out = association.associate_tiles(d, ["filter"], 40.0, 0.5, 60_000.0)
    return out.join(d.select("filter", "image", "det", "mag", "sigma"), ["filter", "image", "det"]).groupBy("filter", "first_image", "first_det").agg(F.count("*").alias("n_detect"), r(F.sum(F.col("mag") / F.col("sigma") / F.col("sigma")) / F.sum(1 / F.col("sigma") / F.col("sigma"))).alias("mag_wmean"))


@query("matched", "stars", "images")
def master_list(matched, stars, images):
    """Master list of each filter that grows in two runs, of the earlier images and of the later ones; tested against a sequential version over the whole table."""
    spark, c = matched.sparkSession, F.col
    held = rounds.Rounds(spark)
    d = held.keep(master_input(matched, stars, images), "rows")  # both runs read them
    master = masterlist.Master(spark, f"{rounds.shared_folder(spark)}/master-{uuid.uuid4().hex}", {"filter": "string"}, 60_000.0, 1_000.0, MASTER_RULES)
    master.grow(d.where(c("epoch") < 2010))
    master.grow(d.where(c("epoch") >= 2010))
    held.drop()
    return rounded(master.sources().select("filter", "first_order", "first_det", "n_detect", "star", "x", "y", "mag", "epoch"))


MASTER_RULES = masterlist.Rules(motion=1.0)


def master_input(matched, stars, images):
    """Detections as the master list takes them: images in order of their epochs."""
    c = F.col
    d = positions(matched, stars, images)
    year = S.mjd_to_year(c("image_order"))
    return d.select("filter", (c("image_order").cast("long") * 1_000_000_000 + c("image")).alias("image_order"), "det", "x", "y", c("sigma").alias("sigma_x"), c("sigma").alias("sigma_y"), "mag", c("sigma").alias("mag_err"), year.alias("epoch"), c("is_star").alias("star"))


@query("detections", sql="""WITH a AS (SELECT image_id, catalog_index AS a, x AS ax, y AS ay, 20 + 100*mag_err AS sa, mag AS ma, mag_err AS sma FROM detections WHERE qfit <= 0.5), b AS (SELECT image_id, catalog_index AS b, x AS bx, y AS by_, 100*mag_err AS sb, mag AS mb, mag_err AS smb FROM detections WHERE qfit > 0.5),
p AS (SELECT *, sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay)) AS d FROM a JOIN b USING (image_id) WHERE (bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) <= 22500.0), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, a ORDER BY d, b) AS k FROM p)
SELECT image_id, a, b, round(d, 6) AS distance FROM k WHERE k <= 5 AND d <= 3*sqrt(sa*sa + sb*sb + 100) AND abs(ma - mb) <= 3*sqrt(sma*sma + smb*smb + 0.01e0)""")
def two_set_match(det):
    side = lambda k, n, e: det.where(F.col("qfit") <= 0.5 if k == "a" else F.col("qfit") > 0.5).select("image_id", F.col("catalog_index").alias(k), "x", "y", e.alias(f"s{k}"), F.col("mag").alias(f"m{k}"), F.col("mag_err").alias(f"sm{k}"))
    a, b = side("a", 0, F.col("mag_err") * 100 + 20).withColumn("motion", F.lit(10.0)), side("b", 0, F.col("mag_err") * 100)
    out = spatial.match_sets(a, b, ("image_id",), 150.0, 3.0, 0.1)
    return out.select("image_id", "a", "b", r(F.col("distance")).alias("distance"))


@query("matched", "images", sql="""WITH s AS (SELECT filter, source_id, count(*) AS n, list(image_id ORDER BY image_id) AS l FROM matched JOIN images USING (image_id) GROUP BY 1, 2), g AS (SELECT *, CASE WHEN source_id % 3 = 0 THEN source_id // 6 END AS gid FROM s),
k AS (SELECT gid, sum(n)::BIGINT AS n_detect, list_sort(list_distinct(flatten(list(l)))) AS l FROM g WHERE gid IS NOT NULL GROUP BY 1), lead AS (SELECT gid, filter, source_id, row_number() OVER (PARTITION BY gid ORDER BY n DESC, filter, source_id) AS r FROM g WHERE gid IS NOT NULL)
SELECT gid, filter, source_id, n_detect, array_to_string(l, ',') AS indices FROM lead JOIN k USING (gid) WHERE r = 1 UNION ALL SELECT NULL, filter, source_id, n, array_to_string(l, ',') FROM g WHERE gid IS NULL""")
def merge_duplicates(matched, images):
    s = matched.join(images.select("image_id", "filter"), "image_id").groupBy("filter", "source_id").agg(F.count("*").alias("n_detect"), F.array_sort(F.collect_list("image_id")).alias("indices"))
    s = s.withColumn("gid", F.when(F.col("source_id") % 3 == 0, F.expr("source_id div 6")))
    return association.merge_by_id(s, "gid", ["filter", "source_id"]).select("gid", "filter", "source_id", "n_detect", F.array_join("indices", ",").alias("indices"))


@query("stars", sql="""WITH RECURSIVE s AS (SELECT source_id, (ra - 150)*3.6e6 AS x, (dec - 2)*3.6e6 AS y, gmag FROM stars), a AS (SELECT source_id AS a, x AS ax, y AS ay, gmag + 0.1e0 AS f, CASE WHEN source_id % 5 <> 0 THEN gmag - 0.3e0 END AS h FROM s WHERE source_id % 2 = 0),
b AS (SELECT source_id AS b, x + 100 AS bx, y AS by_, gmag FROM s WHERE source_id % 2 = 1), p AS (SELECT a, b, f, h, gmag, sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay)) AS d FROM a, b WHERE abs(bx-ax) <= 8000 AND abs(by_-ay) <= 8000),
n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p WHERE d <= 8000), o AS MATERIALIZED (SELECT a, b, d, row_number() OVER (ORDER BY d, a, b) AS k FROM n WHERE r <= 5 AND abs(f - gmag - 0.1e0) <= 2 AND (h IS NULL OR abs(h - gmag + 0.3e0) <= 2)),
g(k, a, b, d, won, ta, tb) AS (SELECT k, a, b, d, true, [a], [b] FROM o WHERE k = 1 UNION ALL SELECT k, a, b, d, free, CASE WHEN free THEN list_append(ta, a) ELSE ta END, CASE WHEN free THEN list_append(tb, b) ELSE tb END
 FROM (SELECT o.*, g.ta, g.tb, NOT list_contains(g.ta, o.a) AND NOT list_contains(g.tb, o.b) AS free FROM g JOIN o ON o.k = g.k + 1)) SELECT a, b, round(d, 4) AS distance FROM g WHERE won""")
def gaia_recovery(stars):
    """Unlabelled sources given a star each, one-to-one."""
    x, y = (F.col("ra") - 150) * 3.6e6, (F.col("dec") - 2) * 3.6e6
    a = stars.where("source_id % 2 = 0").select(F.col("source_id").alias("a"), x.alias("x"), y.alias("y"), (F.col("gmag") + 0.1).alias("F606W"), F.when(F.col("source_id") % 5 != 0, F.col("gmag") - 0.3).alias("F814W"))
    b = stars.where("source_id % 2 = 1").select(F.col("source_id").alias("b"), (x + 100).alias("x"), y.alias("y"), "gmag")
    return association.recover(a, b, 8000.0, 2.0, {"F606W": 0.1, "F814W": -0.3}).select("a", "b", r(F.col("distance"), 4).alias("distance"))


@query("detections", sql="""WITH RECURSIVE c AS (SELECT image_id, catalog_index AS i, mag, x, y, floor(x/60)::BIGINT AS cx, floor(y/60)::BIGINT AS cy FROM detections), n AS (SELECT *, cx + u AS nx, cy + v AS ny FROM c, (VALUES (-1),(0),(1)) p(u), (VALUES (-1),(0),(1)) q(v)),
l AS (SELECT n.image_id, n.i, list(c.i) AS near FROM n JOIN c ON n.image_id = c.image_id AND nx = c.cx AND ny = c.cy WHERE (c.mag < n.mag OR (c.mag = n.mag AND c.i < n.i)) AND sqrt((c.x-n.x)*(c.x-n.x) + (c.y-n.y)*(c.y-n.y)) <= 60 GROUP BY 1, 2),
o AS MATERIALIZED (SELECT c.image_id, c.i, coalesce(near, []) AS near, row_number() OVER (PARTITION BY c.image_id ORDER BY mag, c.i) AS k FROM c LEFT JOIN l USING (image_id, i)),
g(image_id, k, i, stays, kept) AS (SELECT image_id, k, i, true, [i] FROM o WHERE k = 1 UNION ALL SELECT image_id, k, i, free, CASE WHEN free THEN list_append(kept, i) ELSE kept END FROM (SELECT o.*, g.kept, NOT list_has_any(g.kept, o.near) AS free FROM g JOIN o ON o.image_id = g.image_id AND o.k = g.k + 1))
SELECT image_id, i AS catalog_index FROM g WHERE stays""")
def isolated_detections(det):
    """Detections that stay when brighter ones remove fainter ones within 60 pixels; the SQL takes an image's detections one after the other."""
    return spatial.isolated_keys(det, 60.0, ("image_id",), "catalog_index", "mag")


@query("matched", sql="SELECT source_id, round(sum((cov_yy*dx*dx + cov_xx*dy*dy - 2*cov_xy*dx*dy)/(cov_xx*cov_yy - cov_xy*cov_xy)), 4) AS chi2_hst, count(*) AS n_det_chi2, round(sum((cov_yy*dx*dx + cov_xx*dy*dy - 2*cov_xy*dx*dy)/(cov_xx*cov_yy - cov_xy*cov_xy))/greatest(2*count(*) - 5, 1), 4) AS chi2_hst_red FROM (SELECT *, (x - floor(x))*0.0317e0 AS dx, (y - floor(y))*0.0317e0 AS dy FROM matched) GROUP BY 1")
def star_chi2(matched):
    from skyspark.functions.covariance import squared_distance

    q = squared_distance((F.col("x") - F.floor("x")) * 0.0317, (F.col("y") - F.floor("y")) * 0.0317, (F.col("cov_xx"), F.col("cov_xy"), F.col("cov_yy")))
    s = matched.groupBy("source_id").agg(F.sum(q).alias("c"), F.count("*").alias("n"))
    return s.select("source_id", r(F.col("c"), 4).alias("chi2_hst"), F.col("n").alias("n_det_chi2"), r(F.col("c") / F.greatest(F.col("n") * 2 - 5, F.lit(1)), 4).alias("chi2_hst_red"))
