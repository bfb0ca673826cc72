"""Writers of results. The old status goes before data is written and the new one comes after it, so a status always names whole data."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspark.functions.text import region_line


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_regions(df: DataFrame, path: str, radius: float = 0.5) -> None:
    """Region lines of the rows with finite positions."""
    ok = F.col("ra").isNotNull() & F.col("dec").isNotNull() & ~F.isnan("ra") & ~F.isnan("dec")
    df.where(ok).select(region_line(F.col("ra"), F.col("dec"), radius).alias("value")).write.mode("overwrite").text(path)


def parameters_hash(parameters: dict) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def write_status(spark: SparkSession, path: str, status: dict) -> None:
    """The status beside a result, written after it."""
    spark.createDataFrame([(json.dumps(status),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_status")


def clear_status(spark: SparkSession, path: str) -> None:
    """Takes a result's status away, before the result is written anew: what fails half way then has none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}_status")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def status_of(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(spark.read.text(f"{path}_status").first()[0])
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def cached(spark: SparkSession, path: str, parameters: dict, build) -> DataFrame:
    """The table at path if it was built with these parameters, else built, written and read again."""
    want = parameters_hash(parameters)
    if (status_of(spark, path) or {}).get("parameters") != want:
        clear_status(spark, path)
        write_result(build(), path)
        write_status(spark, path, {"status": "success", "parameters": want})
    return spark.read.parquet(path)
