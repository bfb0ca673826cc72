"""Comparisons: results against truth or catalogue, consistency of images, and the columns of quality tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyspark.functions.covariance import finite
from skyspark.functions.text import base_image
from skyspark.operators.robust import weighted_mean


def attach(left: DataFrame, right: DataFrame, left_key: str, right_key: str, columns: list[str]) -> DataFrame:
    """left with columns of the right row that has its key, null without one; the keys' names may differ. right has one row per key."""
    return left.join(right.select(F.col(right_key).alias("__key"), *columns), F.col(left_key) == F.col("__key"), "left").drop("__key")


def against_truth(results: DataFrame, truth: DataFrame, key: str, measures: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Inner join by key with, for each measure (value, true value, sigma), its residual and its pull; a sigma of 0 has no pull. Both sides' columns are at hand in the measures."""
    d = results.join(truth, key)
    for name, (value, true, sigma) in measures.items():
        d = d.withColumn(f"resid_{name}", value - true).withColumn(f"pull_{name}", (value - true) / F.nullif(sigma, F.lit(0.0)))
    return d


def images_against_truth(results: DataFrame, truth: DataFrame, name: str, terms: list[str]) -> DataFrame:
    """Residuals of images' terms: results by (sub-)image, truth by image with columns true_<term>; halves of a chip compare with their image."""
    d = results.withColumn("image_base", base_image(F.col(name))).join(truth.withColumnRenamed(name, "image_base"), "image_base")
    return d.withColumns({f"resid_{t}": F.col(t) - F.col(f"true_{t}") for t in terms})


def truth_summary(compared: DataFrame, names: list[str]) -> DataFrame:
    """Per measure: n, bias, rms about it, and mean and deviation of the pulls, over what isn't null."""
    rows = compared.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"resid_{k}").alias("resid"), F.col(f"pull_{k}").alias("pull")) for k in names])).alias("s")).select("s.*")
    return rows.groupBy("measure").agg(F.count("resid").alias("n"), F.avg("resid").alias("bias"), F.stddev_samp("resid").alias("rms"), F.avg("pull").alias("pull_mean"), F.stddev_samp("pull").alias("pull_std"))


def vector_chi2(df: DataFrame, residuals: list[str], covariance: str, name: str = "chi2") -> DataFrame:
    """df with d^T C^-1 d: residuals are columns, covariance an array of the matrix row by row (or of several matrices, summed, as arrays of arrays). Null where a residual or entry is missing, or C is singular."""
    n, names = len(residuals), df.columns
    at = [names.index(c) for c in (*residuals, covariance)]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema) + f"`{name}` double"

    def run(batches):
        for b in batches:
            d = np.column_stack([np.asarray(b.column(k).to_numpy(zero_copy_only=False), float) for k in at[:n]]) if b.num_rows else np.zeros((0, n))
            c = np.full((b.num_rows, n, n), np.nan)
            for i, x in enumerate(b.column(at[n]).to_pylist()):
                if x is not None and len(x) == n * n and None not in x:
                    c[i] = np.reshape(x, (n, n))
            ok = np.isfinite(d).all(1) & np.isfinite(c).all((1, 2))
            ok[ok] = np.abs(np.linalg.det(c[ok])) > 0
            out = np.full(b.num_rows, np.nan)
            out[ok] = np.einsum("ij,ij->i", d[ok], np.linalg.solve(c[ok], d[ok][..., None])[..., 0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=~ok)], [*names, name])

    return df.mapInArrow(run, schema)


def zero_point_consistency(df: DataFrame, star: str, image: str, mag: str, err: str, least: int = 5, warn: float = 0.1, fail: float = 0.5) -> DataFrame:
    """Per image with ``least`` detections: the median residual to the stars' weighted means, and whether it is ok, a warning or an error."""
    e = F.greatest(F.col(err), F.lit(1e-6))
    mean, _ = weighted_mean(F.col(mag), e)
    d = df.join(df.groupBy(star).agg(mean.alias("__mean")), star).groupBy(image).agg(F.count("*").alias("n"), F.median(F.col(mag) - F.col("__mean")).alias("offset")).where(F.col("n") >= least)
    return d.withColumn("verdict", F.when(F.abs("offset") > fail, "error").when(F.abs("offset") > warn, "warning").otherwise("ok"))


def source_quality(detections: DataFrame, stats: DataFrame, images: DataFrame, star: str, image: str, mag: str) -> DataFrame:
    """Rows of the per-image quality table: each detection with its star's statistics (mag_norm_wmean, n_same_filter, outlier_images array) and its image's (offset_mag_ok and others).

    A detection is consistent unless its image is among the star's outliers; with one detection in the filter that can't be told, and it is. Trustworthy: consistent, and its image's zero point is in order."""
    d = detections.join(stats, star, "left").join(images, image, "left")
    consistent = (F.col("n_same_filter") == 1) | ~F.coalesce(F.array_contains("outlier_images", F.col(image)), F.lit(False))
    d = d.withColumn("mag_residual_from_wmean", F.col(mag) - F.col("mag_norm_wmean")).withColumn("is_mag_consistent", F.coalesce(consistent, F.lit(True)))
    return d.withColumn("is_trustworthy", F.col("is_mag_consistent") & F.coalesce("offset_mag_ok", F.lit(False)))


def solo_quality(detections: DataFrame, image: str, mag: str) -> DataFrame:
    """Quality rows of images that have no partner in their filter: constants, their own magnitudes, and trust. Rows without a calibrated magnitude's image stay out."""
    known = detections.groupBy(image).agg(F.count_if(finite(F.col(mag))).alias("__n"), F.count("*").alias("n_shared_with_ref")).where("__n > 0").drop("__n")
    one = {"n_same_filter": 1, "mag_scale": "STMAG", "cross_image_zp": 0.0, "residual_after_zp": 0.0, "wcs_offset_px": 0.0, "same_camera_as_ref": True, "used_stmag": True, "offset_mag_ok": True, "is_mag_consistent": True, "is_trustworthy": True}
    d = detections.join(known, image).withColumns({k: F.lit(v) for k, v in one.items()})
    return d.withColumns({"mag_normalized": F.col(mag), "mag_norm_median": F.col(mag), "mag_norm_mad": F.lit(None).cast("double"), "ref_image": F.col(image)})


def field_summary(stars: DataFrame, results: DataFrame, images: DataFrame) -> DataFrame:
    """One row: catalogue stars and their magnitudes, stars fitted, median detections, median motion error, and images used."""
    a = stars.agg(F.count("*").alias("n_stars"), F.min("gmag").alias("g_min"), F.max("gmag").alias("g_max"))
    b = results.agg(F.count("*").alias("n_fitted"), F.median("n_hst_used").alias("n_detections_median"), ((F.median("sigma_pmra") + F.median("sigma_pmdec")) / 2).alias("sigma_pm_median"))
    return a.crossJoin(b).crossJoin(images.agg(F.count("*").alias("n_images")))  # three rows of totals
