"""Catalogue files, libraries of calibration files, and planned slices of a remote catalogue."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyspark.functions import covariance as V
from skyspark.operators.matching import first_per
from skyspark.operators.relational import conform

_DOUBLES = ("ra", "dec", *[f"{a}_error" for a in V.AXES], *V.CORRELATIONS.values(), "parallax", "pmra", "pmdec", "ref_epoch", "ruwe", "pseudocolour", "gmag", "gmag_error", "bpmag", "bpmag_error", "rpmag", "rpmag_error", "bp_rp", "bp_rp_error")
#: Ids are long from the first read: as doubles they would lose their last digits.
GAIA = T.StructType([T.StructField("source_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in _DOUBLES]])


def read_catalogue(spark: SparkSession, path: str, complete: bool = True) -> DataFrame:
    """Stars of all CSV files below path, one row per source_id, with bp_rp derived where it is missing; complete: only rows with finite position, magnitude and colour count
    (colour only where the files have one), so an id with an incomplete and a complete row keeps the complete one."""
    files = spark.read.option("header", "true").csv(path, pathGlobFilter="*.csv", recursiveFileLookup=True)
    have = {c.lower() for c in files.columns}
    rows = conform(files, GAIA).where("source_id IS NOT NULL").withColumn("bp_rp", F.coalesce("bp_rp", F.col("bpmag") - F.col("rpmag")))
    if complete:
        needed = ["ra", "dec", "gmag", *(["bp_rp"] if "bp_rp" in have or {"bpmag", "rpmag"} <= have else [])]
        rows = rows.dropna(subset=needed)
    return first_per(rows, ["source_id"], [F.col(c).asc_nulls_last() for c in ("ra", "dec", "gmag")])


def magnitude_slices(low: float, high: float, area: float) -> list[tuple[float, float]]:
    """Magnitude intervals, narrow at the faint end where the stars are, more of them for deeper and larger queries; each is a partition of the scan.

    The edges' distances from one magnitude beyond the faint limit are spaced evenly in the logarithm."""
    n = max(2, round((high - low) * high**2 * area * 5e-5))
    span = math.log10(high - low + 1)
    edges = [high + 1 - 10 ** (span * k / (n - 1)) for k in range(n)][::-1]
    edges[0], edges[-1] = low, high
    return list(zip(edges[:-1], edges[1:], strict=True))


def box(stars: DataFrame, ra: float, dec: float, width: float, height: float) -> DataFrame:
    """Stars in a box; the predicate on dec reaches the scan."""
    near = F.abs((F.col("ra") - ra + 540.0) % 360.0 - 180.0) * math.cos(math.radians(dec)) <= width / 2
    return stars.where(F.col("dec").between(dec - height / 2, dec + height / 2) & near)


def available(spark: SparkSession, library: str) -> DataFrame:
    """(detector, filter) that have both a point-spread function and a distortion file: STDPSFs/<det>/STDPSF_<det>_<filter>.fits and STDGDCs/..."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "STD*.fits").load(library).select("path")
    part = lambda kind: files.select(F.regexp_extract("path", rf"/{kind}_([^_/]+)_([^_/.]+)[^/]*\.fits$", 1).alias("detector"), F.regexp_extract("path", rf"/{kind}_([^_/]+)_([^_/.]+)[^/]*\.fits$", 2).alias("filter")).where("filter <> ''")
    return part("STDPSF").intersect(part("STDGDC"))


#: First days (MJD) of the eras that point-spread functions of ACS/WFC are filed under, and the eras to try in order (fixed values).
ERAS = ((54975.0, ("SM4", "SM3", "")), (52346.0, ("SM3", "")), (float("-inf"), ("",)))
#: Other names that a filter is filed under (fixed values).
FILED_AS = {"F850LP": "F850L"}


def library_files(spark: SparkSession, library: str) -> DataFrame:
    """(path, kind, frame, detector, filter, era) of a library's files: STDPSF_<detector>_<filter>[_SM3|_SM4].fits and STDGDC_[OFFICIAL_JFRAME_]<detector>_<filter>.fits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.fits").load(library).select("path")
    part = lambda k: F.regexp_extract("path", r"(?i)/STD(PSF|GDC)_(OFFICIAL_JFRAME_)?([A-Z0-9]+)_([A-Z0-9]+?)(?:_(SM[34]))?\.fits$", k)
    return files.select("path", F.upper(part(1)).alias("kind"), (part(2) != "").alias("frame"), F.upper(part(3)).alias("detector"), F.upper(part(4)).alias("filter"), F.upper(part(5)).alias("era")).where("kind <> ''")


def best_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """image_name, psf and gdc: the library's file for each image, null without one. images: image_name, detector, filter, epoch_mjd.

    A filter's own name comes before the one it may be filed under. Of functions the image's era comes first, then older ones (ACS only); of distortions the one in the common frame."""
    era = F.lit(None).cast("array<string>")
    for first, order in reversed(ERAS):
        era = F.when(F.col("epoch_mjd") >= first, F.array(*[F.lit(x) for x in order])).otherwise(era)
    names = F.filter(F.array(F.col("filter"), F.try_element_at(F.create_map(*[F.lit(x) for p in FILED_AS.items() for x in p]), F.col("filter"))), lambda x: x.isNotNull())
    asked = images.withColumn("eras", F.when(F.col("detector").startswith("ACS"), era).otherwise(F.array(F.lit("")))).withColumn("names", names)
    d = asked.select("image_name", F.upper("detector").alias("detector"), "eras", F.posexplode("names").alias("place", "name")).withColumn("filter", F.upper("name"))
    d = d.join(F.broadcast(files), ["detector", "filter"])  # a library is some hundred files
    rank = F.when(F.col("kind") == "PSF", F.array_position("eras", F.col("era"))).otherwise(F.when(F.col("frame"), 1).otherwise(2))
    d = d.withColumn("rank", rank).where("rank > 0").groupBy("image_name", "kind").agg(F.min_by("path", F.struct("place", "rank", "path")).alias("path"))
    found = d.groupBy("image_name").agg(F.max(F.when(F.col("kind") == "PSF", F.col("path"))).alias("psf"), F.max(F.when(F.col("kind") == "GDC", F.col("path"))).alias("gdc"))
    return images.select("image_name").join(found, "image_name", "left")
