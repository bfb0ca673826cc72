"""Shared folder, tables written there, and column helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where the session has none (as in local tests) a temporary folder is set."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = java.get() if java.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="skyspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: its lineage is cut, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


class Scratch:
    """Tables of the shared folder that go together."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def stored(self, df: DataFrame, tag: str) -> DataFrame:
        self.held.append(stored(df, tag))
        return self.held[-1]

    def clear(self, *keep: DataFrame) -> None:
        """Removes all but some tables."""
        for df in self.held:
            if not any(df is k for k in keep):
                forget(df)
        self.held = [k for k in keep if any(df is k for df in self.held)]


def forget(df: DataFrame) -> None:
    """Remove the files of a table that ``stored`` returned and no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def make_dir(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.mkdirs(at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder that no later plan reads."""
    files, at = _folder(spark, path)
    files.delete(at, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 500):
    """Arrow batches in pieces of a few hundred rows, so that what a Python worker holds stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def remainder(c: Column, n: int) -> Column:
    """crc32 of a value as text, modulo n."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))
