"""Tables of a field's folder as DataFrames, checkpoints of a fit, and writers of catalogues.

A field's folder has an image per folder: <image>_flc.fits (or _cal.fits), its catalogue <image>_flc_catalog.fits, matched_gaia.csv and transformation.csv
(parameter, value). One set of functions serves both telescopes: ``HST`` and ``JWST`` differ by suffix, by the name of the index column, and by the header's times and positions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspark.functions import instrument as I
from skyspark.functions.text import header_filter
from skyspark.operators.blocks import Blocks
from skyspark.operators.relational import pivot_parameters, trusted_detections
from skyspark.operators.solver import N_R, Alignment
from skyspark.sources import catalog, fits, sinks

#: Least position error in pixels, and share of a star's window that may be saturated (fixed values).
LEAST_ERROR, MOST_SATURATED = 5e-3, 0.25
#: Kilometres in an astronomical unit.
KM_PER_AU = 149_597_870.7
TERMS = ("A", "B", "C", "D", "xs_o", "ys_o", "xt_o", "yt_o", "ratio", "rot_deg", "on_skew", "off_skew", "zp", "ra_cen", "dec_cen", "x_cen", "y_cen", "pixel_scale", "orientat")


@dataclass(frozen=True)
class Telescope:
    """What differs between telescopes."""

    suffix: str
    index: str
    begin: tuple[str, ...]
    end: tuple[str, ...]


HST = Telescope("_flc", "hst_index", ("EXPSTART",), ("EXPEND",))
JWST = Telescope("_cal", "jwst_index", ("EXPSTART", "MJD-BEG"), ("EXPEND", "MJD-END"))


def _of_folder(name: str, file: str):
    """The image's name: the folder that holds the file."""
    return F.regexp_extract(F.input_file_name(), rf"/([^/]+)/{file}$", 1).alias(name)


def matches(spark: SparkSession, root: str, telescope: Telescope = HST) -> DataFrame:
    """All images' matched_gaia.csv (columns in one order) with image_name and catalog_index; ids are long from the first read on."""
    rows = spark.read.option("header", "true").csv(root, recursiveFileLookup=True, pathGlobFilter="matched_gaia.csv")
    ids = {telescope.index: "catalog_index", "gaia_source_id": "source_id"}
    rest = [c for c in rows.columns if c not in ids]
    return rows.select(_of_folder("image_name", "matched_gaia.csv"), *[F.col(k).cast("long").alias(v) for k, v in ids.items()], *[F.col(c).cast("boolean" if c.startswith(("has_", "is_")) or c.endswith("is_star") else "double").alias(c) for c in rest])


def transformations(spark: SparkSession, root: str) -> DataFrame:
    """A row per image with the parameters TERMS of its transformation.csv, null where it lacks one."""
    rows = spark.read.option("header", "true").csv(root, recursiveFileLookup=True, pathGlobFilter="transformation.csv")
    return pivot_parameters(rows.select(_of_folder("image_name", "transformation.csv"), "parameter", F.col("value").cast("double").alias("value")), "image_name", list(TERMS))


def images(spark: SparkSession, root: str, telescope: Telescope = HST) -> DataFrame:
    """A row per image that has a header and a transformation: image_name, epoch_mjd (mid-exposure), instrument, detector, filter, pixel_scale_mas (CD matrix), ra0, dec0, rotation, the solver's terms a, b, c, d, w, z,
    and ox, oy, oz: the observer's place in au where the header has it."""
    keys = ["INSTRUME", "DETECTOR", "FILTER", "FILTER1", "FILTER2", *telescope.begin, *telescope.end, "CD1_1", "CD1_2", "CD2_1", "CD2_2", "JWST_X", "JWST_Y", "JWST_Z"]
    h = fits.read_headers(spark, root, keys, f"*{telescope.suffix}.fits")
    number = lambda k: F.col(f"`{k}`").cast("double")
    begin, end = F.coalesce(*map(number, telescope.begin)), F.coalesce(*map(number, telescope.end))
    head = h.select(
        F.regexp_replace("file", rf"{telescope.suffix}\.fits$", "").alias("image_name"), ((begin + F.coalesce(end, begin)) / 2).alias("epoch_mjd"), F.trim("INSTRUME").alias("instrument"), F.trim("DETECTOR").alias("detector"),
        header_filter(F.col("FILTER"), F.col("FILTER1"), F.col("FILTER2")).alias("filter"), I.cd_scale(*[number(k) for k in ("CD1_1", "CD1_2", "CD2_1", "CD2_2")]).alias("pixel_scale_mas"),
        *[(number(f"JWST_{k.upper()}") / KM_PER_AU).alias(f"o{k}") for k in "xyz"],
    )
    t = transformations(spark, root)
    c = F.col
    terms = I.solver_terms(*[c(k) for k in ("A", "B", "C", "D", "xs_o", "ys_o", "xt_o", "yt_o", "x_cen", "y_cen")], -c("orientat"))
    return head.join(t, "image_name").select(*head.columns, c("ra_cen").alias("ra0"), c("dec_cen").alias("dec0"), (-c("orientat")).alias("rotation"), *[v.alias(k) for k, v in zip("abcdwz", terms, strict=True)])


def detections(spark: SparkSession, root: str, telescope: Telescope = HST, half_width: int = 3, least_error: float = LEAST_ERROR) -> DataFrame:
    """Matched detections of all images by (image, row number): image_name, source_id, catalog_index, x, y (corrected), x_raw, y_raw, sx, sy, rho, cov_xx, cov_xy, cov_yy, qfit, mag, use_for_fit.

    Errors have a floor, correlations stay short of one, and stars with too much of their window saturated are not used."""
    schema = "catalog_index long, x double, y double, x_gdc double, y_gdc double, cov_xx_gdc double, cov_yy_gdc double, cov_xy_gdc double, mag double, qfit double, n_sat double"
    rows = fits.read_table(spark, root, schema, f"*{telescope.suffix}_catalog.fits", "catalog_index").withColumn("image_name", F.regexp_replace("file", rf"{telescope.suffix}_catalog\.fits$", ""))
    d = rows.join(matches(spark, root, telescope).select("image_name", "catalog_index", "source_id"), ["image_name", "catalog_index"])
    floor = lambda k: F.greatest(F.sqrt(F.greatest(F.col(k), F.lit(0.0))), F.lit(least_error))
    d = d.withColumns({"sx": floor("cov_xx_gdc"), "sy": floor("cov_yy_gdc")})
    d = d.withColumn("rho", F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.col("cov_xy_gdc") / (F.col("sx") * F.col("sy")))))
    used = F.col("n_sat") / (2 * half_width + 1) ** 2 < MOST_SATURATED
    return d.select(
        "image_name", "source_id", "catalog_index", F.col("x_gdc").alias("x"), F.col("y_gdc").alias("y"), F.col("x").alias("x_raw"), F.col("y").alias("y_raw"), "sx", "sy", "rho", (F.col("sx") * F.col("sx")).alias("cov_xx"),
        (F.col("rho") * F.col("sx") * F.col("sy")).alias("cov_xy"), (F.col("sy") * F.col("sy")).alias("cov_yy"), "qfit", "mag", used.alias("use_for_fit"),
    )


def load_field(spark: SparkSession, root: str, gaia: str, telescope: Telescope = HST, trust: DataFrame | None = None) -> dict[str, DataFrame]:
    """stars, images and detections of a field. trust: a catalogue per star (see relational.trusted_detections), by which detections are left out of the fit. Only stars that an image has stay."""
    det = detections(spark, root, telescope)
    if trust is not None:
        used = trusted_detections(det.withColumnRenamed("use_for_fit", "__sat"), trust, "source_id", "image_name")
        det = used.withColumn("use_for_fit", F.col("use_for_fit") & F.col("__sat")).drop("__sat")
    stars = catalog.read_catalogue(spark, gaia)
    return {"stars": stars.join(det, "source_id", "left_semi"), "images": images(spark, root, telescope), "detections": det}


def save_inputs(path: str, field: dict[str, DataFrame]) -> None:
    """A checkpoint of a fit's inputs, in the folder ``inputs`` of path; its status is written last."""
    spark, at = field["stars"].sparkSession, f"{path}/inputs"
    sinks.clear_status(spark, at)
    observed = field["stars"].join(field["detections"], "source_id", "left_semi")
    for name, df in (field | {"stars": observed}).items():
        sinks.write_result(df, f"{at}/{name}", ["image_name"] if name == "detections" else None)
    sinks.write_status(spark, at, {"status": "inputs"})


def _whole(spark: SparkSession, at: str, kind: str) -> dict:
    """The status of a checkpoint that was written whole, and is of that kind."""
    status = sinks.status_of(spark, at)
    if status is None or status.get("status") != kind:
        raise FileNotFoundError(f"no whole {kind} at {at}")
    return status


def load_inputs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The inputs of a checkpoint that was written whole."""
    _whole(spark, f"{path}/inputs", "inputs")
    return {name: spark.read.parquet(f"{path}/inputs/{name}") for name in ("stars", "images", "detections")}


def save_results(path: str, spark: SparkSession, solution: Alignment, stars: DataFrame) -> None:
    """A solution, in the folder ``results`` of path: its images with their terms, the blocks of their covariance (row by row), and the stars' posteriors."""
    at = f"{path}/results"
    sinks.clear_status(spark, at)
    rows = [(int(solution.images[i]), int(solution.images[j]), [float(v) for v in x.ravel()]) for (i, j), x in solution.blocks.held.items()]
    sinks.write_result(spark.createDataFrame([(int(i), [float(x) for x in solution.r[i]]) for i in solution.images], "image_id long, r array<double>"), f"{at}/images")
    sinks.write_result(spark.createDataFrame(rows, "i long, j long, block array<double>"), f"{at}/covariance")
    sinks.write_result(stars, f"{at}/posteriors")
    sinks.write_status(spark, at, {"status": "results", "steps": solution.steps, "converged": solution.converged})


def load_results(spark: SparkSession, path: str) -> tuple[Alignment, DataFrame]:
    """(solution, posteriors) as saved."""
    path = f"{path}/results"
    status = _whole(spark, path, "results")
    r = {x.image_id: np.array(x.r) for x in spark.read.parquet(f"{path}/images").collect()}
    order = sorted(r)
    at, n = {i: k for k, i in enumerate(order)}, len(r[order[0]]) if order else N_R
    held = {(at[x.i], at[x.j]): np.array(x.block).reshape(n, n) for x in spark.read.parquet(f"{path}/covariance").collect()}  # as many as the solver's own matrix has
    return Alignment(order, r, Blocks(len(order), n, held), status["steps"], status["converged"]), spark.read.parquet(f"{path}/posteriors")


def write_quality(df: DataFrame, path: str) -> None:
    """Quality rows of all images (see compare.source_quality and solo_quality), a partition per image."""
    sinks.write_result(df, path, ["image_name"])


def write_catalogue(df: DataFrame, path: str, form: str = "fits", most: int = 1_000_000) -> str:
    """A catalogue in the form that is asked for. fits: one FITS table of numbers and flags at ``path`` + .fits; the driver holds it, so one of more than ``most`` rows is refused. csv: files in ``path`` + .csv, of any size. Returns the path written."""
    if form == "csv":
        df.write.mode("overwrite").option("header", "true").csv(f"{path}.csv")
        return f"{path}.csv"
    if form != "fits":
        raise ValueError(f"a catalogue is written as fits or csv, not as {form!r}")
    other = [c for c, t in df.dtypes if t not in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")]
    if other:
        raise ValueError(f"a FITS catalogue has numbers and flags only, not {other}: write csv")
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a FITS catalogue of more than {most} rows would not fit the driver: write csv")
    rows = df.select(*[F.col(c).cast({"boolean": "boolean", "float": "double", "double": "double"}.get(t, "long")).alias(c) for c, t in df.dtypes])
    fits.write(f"{path}.fits", rows=rows.toPandas())
    return f"{path}.fits"
