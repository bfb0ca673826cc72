"""Mixing sources to target weights (native: DataFrame and SQL functions only).

Every document gets a hash-random key. Keys are spread evenly over their range, so cutting
the range at equal steps range-partitions a source without sampling; a source gets as many
buckets as its rows need, and a hot source is many small buckets. Token counts are
summed per bucket, an exclusive prefix over the bucket totals gives each bucket its start,
and a running sum inside each bucket gives each document its place in its source's stream.
The stream is cut at the source's exact budget; a budget above the source's size repeats the
stream, epoch after epoch, and cuts the last one.

Targets: sources in code-point order, null last, have the given weights, repeating. They share
the budget by weight; a target stops at ``limit`` times its source's size, and the excess is
shared again by weight until none is above. That is water-filling: sorted by size / weight,
the capped sources are a prefix, so one running sum finds it; of equal ratios the first open one has the level, which is the highest.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source
of its own; a source without words has target 0; the empty table gives no rows; repeated
rows are interchangeable; the one document at a source's cut is taken in part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyspark.llm import common as C

#: Rows of a bucket inside which a running sum is formed, on average.
BUCKET_ROWS = 2_000


def random_key(doc_id, seed: int = 0):
    """60 bits of md5 of the id (and of the seed, where it isn't 0): the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}" if seed else ""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """sizes: (source, source_size, n), one row per source. Adds target."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    base = sizes.withColumn("w", w).withColumn("cap", limit * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    base = base.withColumn("total", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    base = base.withColumn("level", level).withColumn("open", F.col("cap") / F.col("w") > F.col("level"))
    final = -F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), (-F.col("level")).alias("below")))).over(Window.partitionBy())["below"]
    return base.withColumn("final", final).select("source", "source_size", "n", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, seed: int = 0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and source."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(C.WORD)).cast("long")
    rows = C.stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), random_key(F.col(doc_id), seed).alias("key")), "mix")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, limit)
    plan = C.stored(plan.withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS).cast("long")), "targets")
    keyed = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "n")
    # key has 60 bits; its upper 30 times the number of buckets stays inside a long.
    keyed = keyed.withColumn("bucket", F.shiftright(F.shiftright("key", 30) * F.col("buckets"), 30))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), start.alias("start"))
    run = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = keyed.withColumn("upto", F.sum("size").over(run))
    placed = local.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    budget = F.least(F.round("target").cast("long"), limit * F.col("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    cut = F.col("budget") - F.col("epochs") * F.col("source_size") - (F.col("start") + F.col("upto") - F.col("size"))
    return (
        placed.withColumn("budget", budget).withColumn("epochs", epochs)
        .withColumn("taken", F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), cut)))
        .select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source")
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as it is taken. The document at a source's cut stays whole."""
    key, tag = options.get("doc_id", "doc_id"), uuid.uuid4().hex
    own, copies = f"id_{tag}", f"copies_{tag}"
    once = mix(docs, **options).where("taken > 0").groupBy(F.col("doc_id").alias(own)).agg(F.max(F.expr("(taken + size - 1) div size")).alias(copies))
    return docs.join(once, F.col(key).eqNullSafe(F.col(own))).withColumn(tag, F.explode(F.expr(f"sequence(1, {copies})"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents, weights 1, 2, 3 repeating, at most 3 epochs."""
    return mix(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3 * source_size::DOUBLE AS cap, sum(source_size::DOUBLE) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, min_by(level, cap / w) FILTER (cap / w > level) OVER () AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
  least(round(t.target)::BIGINT, 3 * t.source_size) AS budget,
  (sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, budget - epochs * source_size - start)))::BIGINT AS taken, source FROM e
"""
