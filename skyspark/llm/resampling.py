"""Importance resampling towards a target distribution: hashed runs of 1 to 3 words, log-ratios per bucket, Gumbel keys.

Words and the CRC-32 of every run of words come from a vectorised automaton over Arrow's UTF-8 buffers (``byte_automaton``), once for the counts and once for
the weights; nothing per feature is written or shuffled. The counts are one array a task, which the shuffle sums by bucket: the driver gets ``BUCKETS`` numbers a table, whatever its
size. A document's weight is the sum of its features' gains (log-ratios in thousandths, rounded down); a Gumbel number from a hash of its id makes the
highest scores a draw without replacement in proportion to exp(weight). The drawn documents get their rank from a range partitioning by score, with
one row per partition for the prefix sums.

Defined results: a null text has no word; the weight of a text without one is 0; documents of fewer than ``LEAST`` words aren't drawn; ties go to the smaller doc_id, null first;
of rows that are alike in score and doc_id any comes first, and each has a rank of its own; an empty target or source counts as zeros; an empty table gives no rows; no other column than those named is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyspark.llm import common as C
from skyspark.llm.byte_automaton import Automaton
from skyspark.llm.sharding import crc_step

BUCKETS = 10_000
#: Words of a run at most, words of a document that may be drawn at least, per cent that are drawn.
ORDER, LEAST, PERCENT = 3, 20, 5
SEED = 42
#: Rows of a partition in the ranking, about.
PART_ROWS = 200_000

#: Letters of ASCII (A-Z count as a-z), digits and all bytes of other characters.
IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def automaton() -> Automaton:
    return Automaton(IS_WORD, FOLD)


def counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Number of features of all texts by bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in C.slices(batches):
            for _, _, crc in automaton().runs(b.column(0), order):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of a bucket's smoothed shares in target and source, rounded down."""
    m = len(source)
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + m)) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight. The gains, a number a bucket, go along with the function."""
    m = np.uint32(len(gain))

    def run(batches):
        for b in C.slices(batches):
            n, words, total = [np.zeros(b.num_rows, np.int64) for _ in range(3)]
            for k, row, crc in automaton().runs(b.column(1), order):
                some = np.bincount(row, minlength=b.num_rows)
                n += some
                total += np.bincount(row, gain[crc % m], b.num_rows).astype(np.int64)  # sums of whole numbers below 2**53: exact
                if k == 1:
                    words += some
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n), pa.array(total)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths, rounded down, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def rank(scored: DataFrame, percent: int = PERCENT, least: int = LEAST, part_rows: int = PART_ROWS) -> DataFrame:
    """scored (a stored table) with the rank of the drawn documents: the floor of ``percent`` of those with ``least`` words or more."""
    spark, may = scored.sparkSession, F.col("n_words") >= least
    total = scored.where(may).count()
    drawn = percent * total // 100
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_rows))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    rows = C.stored(scored.where(may).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Parts behind the cut need no order.
    placed = rows.join(starts, "part").withColumn("ahead", F.col("before") < drawn)
    at = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    first = placed.where("ahead").withColumn("rank", at).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = placed.where(~F.col("ahead")).unionByName(scored.where(~may), allowMissingColumns=True).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select(*scored.columns, F.col("rank").cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", seed: int = SEED, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null unless drawn)."""
    gain = gains(counts(docs, text), counts(target, target_text))
    weighed = weigh(docs, gain, text, doc_id)
    return rank(C.stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored"), percent, least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents, drawn towards benchmark."""
    out = resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _features(table: str, key: str) -> str:
    """Every feature of a table's texts, as (key, words, feature)."""
    return f"""SELECT k, len(w) AS words, array_to_string(w[i : i + n - 1], ' ') AS f
  FROM (SELECT {key} AS k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}) t,
  (VALUES (1), (2), (3)) o(n), unnest(range(1, len(w) - n + 2)) u(i)"""


SQL = f"""
WITH d AS ({_features("(SELECT *, row_number() OVER () AS r FROM documents)", "r")}),
b AS ({_features("benchmark", "item_id")}),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda p: ('0x' || p)::BIGINT)), lambda a, v: {crc_step()}), 4294967295) % {BUCKETS} AS h
  FROM (SELECT f FROM d UNION SELECT f FROM b)),
s AS (SELECT h, count(*) AS n FROM d JOIN c USING (f) GROUP BY 1),
t AS (SELECT h, count(*) AS n FROM b JOIN c USING (f) GROUP BY 1),
g AS (SELECT h, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + {BUCKETS})
  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (h)),
w AS (SELECT k, count(*) AS n_features, max(words) AS words, sum(gain)::BIGINT AS weight FROM d JOIN c USING (f) JOIN g USING (h) GROUP BY 1),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(words, 0) AS words, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM (SELECT *, row_number() OVER () AS k FROM documents) LEFT JOIN w USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= {LEAST} ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER (PARTITION BY words >= {LEAST}) AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {LEAST} AND k <= {PERCENT} * n // 100 THEN k END AS rank FROM r
"""
