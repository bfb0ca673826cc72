"""Views of the test tables as stars, images and detections, and helpers that write a query's SQL for DuckDB.

Each view is one SQL text that Spark and DuckDB both read; the deterministic arithmetic gives equal bits in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STARS = """
SELECT CAST(p_partkey AS BIGINT) AS source_id,
 150.0e0 + (p_partkey % 97) * 0.002e0 + p_size * 0.0001e0 AS ra, 2.0e0 + (p_partkey % 89) * 0.002e0 AS dec,
 14.0e0 + (p_partkey % 70) / 10.0e0 AS gmag,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE ((p_partkey * 7) % 41 - 20) / 10.0e0 END AS pmra,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE ((p_partkey * 5) % 37 - 18) / 10.0e0 END AS pmdec,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey % 23) / 10.0e0 END AS parallax,
 CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 3 = 0 THEN 1.5e0 END AS pseudocolour,
 0.05e0 + (p_size % 10) * 0.02e0 AS ra_error, 0.04e0 + (p_size % 7) * 0.02e0 AS dec_error,
 0.06e0 + (p_size % 9) * 0.03e0 AS pmra_error, 0.05e0 + (p_size % 8) * 0.03e0 AS pmdec_error, 0.07e0 + (p_size % 6) * 0.02e0 AS parallax_error,
 ((p_partkey * 13) % 19 - 9) / 20.0e0 AS ra_dec_corr, ((p_partkey * 17) % 21 - 10) / 25.0e0 AS pmra_pmdec_corr,
 ((p_partkey * 3) % 13 - 6) / 40.0e0 AS ra_parallax_corr, ((p_partkey * 11) % 15 - 7) / 40.0e0 AS dec_parallax_corr,
 0.8e0 + (p_partkey % 10) * 0.1e0 AS ruwe, -0.5e0 + (p_partkey % 60) * 0.1e0 AS bp_rp, 1.0e0 + (p_partkey % 50) * 0.01e0 AS phot_bp_rp_excess_factor,
 (p_partkey % 5) * 0.07e0 AS ipd_gof_harmonic_amplitude, CAST(6 + p_partkey % 12 AS BIGINT) AS visibility_periods_used,
 (p_partkey % 7) * 0.5e0 AS astrometric_excess_noise_sig, CAST(CASE WHEN p_partkey % 11 = 0 THEN 3 WHEN p_partkey % 3 = 0 THEN 95 ELSE 31 END AS BIGINT) AS astrometric_params_solved
FROM {part}"""

IMAGES = """
SELECT concat('img', lpad(CAST(s_suppkey AS VARCHAR(12)), 5, '0')) AS image_name, CAST(s_suppkey AS BIGINT) AS image_id,
 53000.0e0 + (s_suppkey * 37) % 4000 AS epoch_mjd,
 CASE s_suppkey % 3 WHEN 0 THEN 'F606W' WHEN 1 THEN 'F814W' ELSE 'F475W' END AS filter,
 CASE s_suppkey % 2 WHEN 0 THEN 'ACS/WFC' ELSE 'WFC3/UVIS' END AS camera,
 150.1e0 AS ra0, 2.09e0 AS dec0, 50.0e0 AS pixel_scale_mas, ((s_suppkey * 3) % 11 - 5) / 50.0e0 AS true_zp
FROM {supplier}"""

DETECTIONS = """
SELECT CAST(l_suppkey AS BIGINT) AS image_id, CAST(l_partkey AS BIGINT) AS source_id,
 CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS BIGINT) AS catalog_index,
 16.0e0 + (l_partkey % 70) / 10.0e0 + ((l_suppkey * 3) % 11 - 5) / 50.0e0 + (l_discount - 0.05e0) AS mag, 0.01e0 + l_tax / 10.0e0 AS mag_err,
 (l_orderkey * 31 + l_linenumber * 977) % 4096 + l_discount AS x, (l_orderkey * 17 + l_partkey * 613) % 4096 + l_tax AS y,
 0.0004e0 + l_tax / 1000.0e0 AS cov_xx, 0.0005e0 + l_discount / 1000.0e0 AS cov_yy, (l_tax - 0.04e0) / 1000.0e0 AS cov_xy,
 l_quantity / 50.0e0 AS qfit, 0.5e0 + (l_linenumber % 7) * 0.5e0 AS chi2, l_returnflag <> 'R' AS is_star, CAST(l_orderkey % 64 AS INT) AS dq,
 l_extendedprice AS flux
FROM {lineitem}"""

#: One detection of each star in each image: the first of the image's catalogue.
MATCHED = """
SELECT image_id, source_id, min(catalog_index) AS catalog_index, min_by(mag, catalog_index) AS mag, min_by(mag_err, catalog_index) AS mag_err,
 min_by(x, catalog_index) AS x, min_by(y, catalog_index) AS y, min_by(is_star, catalog_index) AS is_star, min_by(qfit, catalog_index) AS qfit,
 min_by(chi2, catalog_index) AS chi2, min_by(cov_xx, catalog_index) AS cov_xx, min_by(cov_xy, catalog_index) AS cov_xy, min_by(cov_yy, catalog_index) AS cov_yy
FROM {detections} GROUP BY image_id, source_id"""

VIEWS = {"stars": STARS, "images": IMAGES, "detections": DETECTIONS, "matched": MATCHED}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the test data."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    needs = [t for t in ("part", "supplier", "lineitem", "detections") if "{" + t + "}" in sql]
    given = {t: view(spark, sf_dir, t) for t in needs}
    if "lineitem" in given:  # dealt by image before the view names and computes its columns: then Spark knows that image_id parts the rows as l_suppkey does, and they go through one shuffle, not two
        given["lineitem"] = given["lineitem"].repartition("l_suppkey")
    return spark.sql(sql, **given)


def oracle(sql: str, *views: str) -> str:
    """DuckDB SQL: the views that a query needs as common table expressions before it (after its own RECURSIVE, if it has that)."""
    wanted = [v for v in VIEWS if v in views or (v == "detections" and "matched" in views)]
    with_ = ", ".join(f"{v} AS ({VIEWS[v].format(part='part', supplier='supplier', lineitem='lineitem', detections='detections')})" for v in wanted)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = ", " + body[len("WITH RECURSIVE" if recursive else "WITH") :].strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{with_} {body}" if with_ else sql


def registry():
    """(queries, their SQL, decorator): the decorator registers a function of views, given by name, with its SQL."""
    queries, sqls = {}, {}

    def query(*views: str, sql: str | None = None):
        def add(f):
            queries[f.__name__] = lambda spark, d: f(*[view(spark, d, v) for v in views])
            if sql:
                sqls[f.__name__] = oracle(sql, *views)
            return f

        return add

    return queries, sqls, query
