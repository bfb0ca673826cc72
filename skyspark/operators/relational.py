"""Joins, rollups, pivots and row selections of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyspark.operators.rounds import Rounds


def conform(df: DataFrame, schema) -> DataFrame:
    """df with exactly the columns of a schema: names matched without case, missing ones null, NaN and infinities null in doubles."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for f in schema.fields:
        c = F.col(f"`{have[f.name.lower()]}`").cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        if f.dataType.typeName() == "double":
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def image_pairs(df: DataFrame, image: str, star: str, mag: str, least: int = 3) -> DataFrame:
    """Edges between images that share ``least`` stars or more, in both directions: a, b, zp (median of mag_a - mag_b), n."""
    rows = df.where(F.col(mag).isNotNull() & ~F.isnan(mag)).select(F.col(star).alias("s"), F.col(image).alias("i"), F.col(mag).alias("m"))
    # A star's images are listed once; each image is sent the rest of the list, two arrays instead of a row a pair, and meets its pairs where they are counted.
    seen = rows.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l")).select(F.col("l.i").alias("i"), F.col("l.m").alias("m"))
    rest = seen.select("i", "m", F.posexplode("i").alias("k", "a")).select("a", F.expr("m[k]").alias("ma"), F.expr("slice(i, k + 2, size(i))").alias("b"), F.expr("slice(m, k + 2, size(i))").alias("mb")).where("size(b) > 0")
    pairs = rest.repartition("a").select("a", "ma", F.explode(F.arrays_zip("b", "mb")).alias("p")).select("a", "ma", "p.b", "p.mb").where("a < b")
    half = pairs.groupBy("a", "b").agg(F.median(F.col("ma") - F.col("mb")).alias("zp"), F.count("*").alias("n")).where(F.col("n") >= least)
    return half.withColumn("way", F.explode(F.array(F.lit(1), F.lit(-1)))).select(F.when(F.col("way") == 1, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("way") == 1, F.col("b")).otherwise(F.col("a")).alias("b"), (F.col("zp") * F.col("way")).alias("zp"), "n")


def against_reference(df: DataFrame, image: str, star: str, mag: str, reference) -> DataFrame:
    """Per image: stars shared with the reference image and the median of reference - image."""
    ref = df.where(F.col(image) == reference).select(F.col(star), F.col(mag).alias("ref_mag"))
    return df.join(ref, star).groupBy(image).agg(F.count("*").alias("n_shared"), F.median(F.col("ref_mag") - F.col(mag)).alias("residual"))


def pivot_parameters(df: DataFrame, key: str, names: list[str], parameter: str = "parameter", value: str = "value") -> DataFrame:
    """One row per key with a column per named parameter; the names are given, so no job looks for them."""
    return df.groupBy(key).pivot(parameter, names).agg(F.first(value, True))


def unpivot_columns(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def catalogue_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (star, filter and camera) from rows per image: counts, lists in image order, all/any of flags, and medians. Needs image_name, catalog_index, mag, mag_mad, trusted, is_star, sigma, gmag."""
    order = F.array_sort(F.collect_list(F.struct("image_name", "catalog_index")))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_images"), F.transform(order, lambda x: x["image_name"]).alias("images"), F.transform(order, lambda x: x["catalog_index"]).alias("indices"), F.median("mag_mad").alias("mag_norm_mad"),
        F.count(F.when(F.col("trusted"), 1)).alias("n_trustworthy"), F.bool_and("trusted").alias("all_trustworthy"), F.bool_or("trusted").alias("any_trustworthy"), F.min_by("gmag", "image_name").alias("gaia_gmag"),
        F.median("sigma").alias("median_residual_sigma"), F.bool_and("is_star").alias("is_star_all_images"), F.bool_or("is_star").alias("is_star_any_image"), F.array_sort(F.collect_list(F.when(~F.col("is_star"), F.col("image_name")))).alias("non_star_images"),
    )


def trusted_detections(detections: DataFrame, catalogue: DataFrame, star: str, image: str) -> DataFrame:
    """detections with use_for_fit: false where the catalogue row that lists their image has no trustworthy image, or no star, or names the image an outlier. Detections that no row lists are used."""
    listed = catalogue.select(F.col(star).alias("s"), F.explode("images").alias("i"), "n_trustworthy", "is_star_any_image", "outlier_images")
    bad = (F.col("n_trustworthy") == 0) | ~F.col("is_star_any_image") | F.array_contains("outlier_images", F.col("i"))
    marks = listed.groupBy("s", "i").agg((~F.bool_or(bad)).alias("ok"))
    return detections.join(marks, (F.col(star) == F.col("s")) & (F.col(image) == F.col("i")), "left").withColumn("use_for_fit", F.coalesce("ok", F.lit(True))).drop("s", "i", "ok")


def split_chips(df: DataFrame, image: str, y: str, at: float = 2048.0, least: int = 20) -> DataFrame:
    """sub_name: the image with _lo or _hi, where both halves have ``least`` rows; else the image."""
    n = df.groupBy(image).agg(F.count(F.when(F.col(y) <= at, 1)).alias("lo"), F.count(F.when(F.col(y) > at, 1)).alias("hi"))
    both = (F.col("lo") >= least) & (F.col("hi") >= least)
    return df.join(n, image).withColumn("sub_name", F.concat(F.col(image).cast("string"), F.when(~both, "").when(F.col(y) <= at, "_lo").otherwise("_hi"))).drop("lo", "hi")


def split_amplifiers(df: DataFrame, image: str, x: str, y: str, at_x: float = 2048.0, at_y: float = 2048.0) -> DataFrame:
    side, height = F.when(F.col(x) <= at_x, "l").otherwise("r"), F.when(F.col(y) <= at_y, "lo").otherwise("hi")
    return df.withColumn("sub_name", F.concat(F.col(image).cast("string"), F.lit("_"), side, height))


def restrict(images: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, filters: list[str] | None = None, cameras: list[str] | None = None) -> DataFrame:
    for column, wanted in (("image_name", include), ("filter", filters), ("camera", cameras)):
        images = images.where(F.col(column).isin(wanted)) if wanted else images
    return images.where(~F.col("image_name").isin(exclude)) if exclude else images


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows of each group; order should be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def bounded_rank(df: DataFrame, order: list[Column], name: str = "rank", buckets: int = 64) -> DataFrame:
    """Rows numbered from 1 in one global order, by a prefix over range partitions instead of one task's window."""
    ranged = df.repartitionByRange(buckets, *order).withColumn("__p", F.spark_partition_id()).persist()
    counts = ranged.groupBy("__p").count()
    start = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.join(F.broadcast(start), "__p").withColumn(name, F.col("before") + local).drop("__p", "before")


def negative_ids(df: DataFrame, order: list[Column]) -> DataFrame:
    """hst_id -1, -2, ... in order."""
    return bounded_rank(df, order, "hst_id").withColumn("hst_id", -F.col("hst_id"))


def failed_manifest(selected: DataFrame, succeeded: DataFrame, key: str) -> DataFrame:
    """Selected keys with status ok or failed."""
    done = succeeded.select(key).distinct().withColumn("__done", F.lit(True))
    return selected.select(key).distinct().join(done, key, "left").select(key, F.when(F.col("__done"), "ok").otherwise("failed").alias("status"))


def master_sources(sources: DataFrame, most_per_image: int = 1000, least: int = 2) -> DataFrame:
    """The sources of a master list and the detections they own: gaia_id (negative without a catalogue star), src, sub_name, catalog_index.

    sources: src, gaia_id (null without a star), sigma, n_detect, and detections, an array of (sub_name, catalog_index); those without a star have passed the cut on plausibility. In each image only the ``most_per_image`` of
    these with the smallest sigma keep their detections. Then sources claim detections in order: with a star first, more detections first, smaller sigma first, src; the first claim counts. Without a star a source
    needs ``least`` detections after either step. Ids -1, -2, ... are given in the order of claims."""
    d = sources.select("src", "gaia_id", "sigma", "n_detect", F.explode("detections").alias("d")).select("src", "gaia_id", "sigma", "n_detect", "d.sub_name", "d.catalog_index")
    return master_claims(d, most_per_image, least)


def master_claims(rows: DataFrame, most_per_image: int = 1000, least: int = 2) -> DataFrame:
    """master_sources() of a row per source and detection: src, gaia_id, sigma, n_detect, sub_name, catalog_index, so that no source's detections need fit in one row."""
    held = Rounds(rows.sparkSession)
    d = held.keep(rows, "rows")
    free = F.col("gaia_id").isNull()
    ranked = d.where(free).select("sub_name", "src", "sigma").distinct()
    kept = top_per_group(ranked, ["sub_name"], [F.col("sigma").asc_nulls_last(), F.col("src")], most_per_image).select("sub_name", "src")
    capped = d.where(free).join(kept, ["sub_name", "src"], "left_semi")
    enough = lambda rows: rows.join(rows.groupBy("src").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("src"), "src", "left_semi")
    claims = held.keep(d.where(~free).unionByName(enough(capped)), "claims")
    order = [free.cast("int"), F.coalesce("n_detect", F.lit(0)).desc(), F.col("sigma").asc_nulls_last(), F.col("src")]
    owned = claims.withColumn("__r", F.row_number().over(Window.partitionBy("sub_name", "catalog_index").orderBy(*order))).where("__r = 1").drop("__r")
    ids = negative_ids(claims.where(free).select("src", "n_detect", "sigma").distinct(), [F.coalesce("n_detect", F.lit(0)).desc(), F.col("sigma").asc_nulls_last(), F.col("src")]).select("src", "hst_id")
    final = owned.where(~free).unionByName(enough(owned.where(free))).join(ids, "src", "left")
    return final.select(F.coalesce("gaia_id", "hst_id").alias("gaia_id"), "src", "sub_name", "catalog_index")
