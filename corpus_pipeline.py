"""A corpus pipeline: language identification, exact and near-duplicate removal, mixing and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet into the folder that all executors share and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspark.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from skyspark.llm import common as C

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less certain than that go. Certainty is a mean over pairs of classes at both levels, so it does not fall with
#: their number: 0.25 is a coin tossed twice, and short clean texts have about 0.38 or more.
LEAST_CERTAINTY = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised, with that language as their ``lang``, whatever they were labelled; the others go, and so do texts without a letter.
    Where no language can be learned, that is all that goes, and ``lang`` stays."""
    model = language_id.fit(language_id.learnable(docs))
    if model.families is None:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(docs.select(*COLUMNS), model).where((F.col("lang_pred") != "und") & (F.col("certainty") >= LEAST_CERTAINTY))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id, through a digest index that starts empty."""
    return exact_dedup.deduplicate(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return near_dedup.deduplicate(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source, each document as often as it is taken."""
    return mixing.repeated(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of every text."""
    ids = bpe.encode(docs, bpe.default_path(), keep=("doc_id", "source"))
    return ids.withColumn("n_tokens", F.size("ids"))


STAGES = [("language ID", identify), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("mixing", mix), ("BPE", encode)]

#: Stages 1 (fitted machines) and 5 (merges) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = C.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
