"""Registry of the queries over the reference's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyspark.plans import comparisons, fields, floors, instruments, matches, photometry, pixels, scalar, solving, sources, tables

MODULES = (scalar, instruments, tables, comparisons, matches, photometry, floors, fields, pixels, solving, sources)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["epoch_propagation"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
