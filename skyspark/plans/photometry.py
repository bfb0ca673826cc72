"""Queries over photometric quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspark.operators import photometry
from skyspark.plans.adapters import registry
from skyspark.plans.scalar import r
from skyspark.plans.tables import rounded

QUERIES, ORACLE, query = registry()


@query("matched", sql="""WITH l AS (SELECT image_id, min(mag) AS low FROM matched GROUP BY 1), b AS (SELECT image_id, floor((mag - low)/0.5e0)::BIGINT AS bin, any_value(low) AS low, count(*) AS n, median(qfit) AS med, greatest((quantile_cont(qfit, 0.84) - quantile_cont(qfit, 0.16))/2, 0.01) AS h FROM matched JOIN l USING (image_id) GROUP BY 1, 2)
SELECT image_id, bin, round(low + (bin + 0.5e0)*0.5e0, 6) AS centre, n, round(med - 4*h, 6) AS lower, round(med + 4*h, 6) AS upper FROM b WHERE n >= 5""")
def magnitude_bin_bounds(matched):
    """Per image and half magnitude the range of a measure about its median."""
    p = F.percentile("qfit", F.array(F.lit(0.16), F.lit(0.84)))
    half = F.greatest((p[1] - p[0]) / 2, F.lit(0.01)) * 4
    return rounded(photometry.locus(matched, ["image_id"], "mag", {"lower": F.median("qfit") - half, "upper": F.median("qfit") + half}))


@query("matched", sql="""WITH l AS (SELECT image_id, min(mag) AS low FROM matched GROUP BY 1), b AS (SELECT image_id, floor((mag - low)/0.5e0)::BIGINT AS bin, any_value(low) AS low, count(*) AS n, least(quantile_cont(qfit, 0.25)*4, 1.5) AS lim FROM matched JOIN l USING (image_id) GROUP BY 1, 2),
t AS (SELECT image_id, low + (bin + 0.5e0)*0.5e0 AS c, lim, lead(low + (bin + 0.5e0)*0.5e0) OVER w AS c2, lead(lim) OVER w AS lim2, row_number() OVER w AS k, count(*) OVER (PARTITION BY image_id) AS n FROM b WHERE n >= 5 WINDOW w AS (PARTITION BY image_id ORDER BY bin)),
s AS (SELECT m.image_id, m.source_id, CASE WHEN t.c2 IS NULL THEN lim ELSE lim + (lim2 - lim)*greatest(0, least(1, (mag - c)/(c2 - c))) END AS v, row_number() OVER (PARTITION BY m.image_id, m.source_id ORDER BY CASE WHEN c <= mag THEN 0 ELSE 1 END, CASE WHEN c <= mag THEN -c ELSE c END) AS pick FROM matched m JOIN t ON t.image_id = m.image_id AND t.n >= 2)
SELECT m.image_id, m.source_id, round(coalesce(v, 1.5), 6) AS qfit_limit FROM matched m LEFT JOIN (SELECT * FROM s WHERE pick = 1) s ON m.image_id = s.image_id AND m.source_id = s.source_id""")
def qfit_limits(matched):
    """Each detection's limit of qfit from the stellar locus, interpolated between magnitude bins."""
    return photometry.qfit_limits(matched, ["image_id"], "mag", "qfit").select("image_id", "source_id", r(F.col("qfit_limit")).alias("qfit_limit"))


@query("detections")
def star_classification(det):
    """Likely stars and the growth of their errors, image by image; tested against a plain loop."""
    c = F.col
    noise = lambda k, w: F.lit(1.0) + (c(k) - F.floor(c(k)) - 0.05) * w
    d = det.select("image_id", "catalog_index", "flux", "mag", (c("qfit") * 0.3).alias("qfit"), "chi2", noise("x", 0.4).alias("concentration"), F.when(c("catalog_index") % 9 != 0, noise("y", 0.3)).alias("concentration_2x2"), noise("y", 0.2).alias("concentration_3x3"))
    out = photometry.classified(d, "image_id", 32.0)
    return out.select("image_id", "catalog_index", "is_star_candidate", r(c("chi2_scale")).alias("chi2_scale"))
