"""Contiguous shards of equal size from global prefix sums (native: DataFrame and SQL functions only).

Documents are put into one global order by range partitioning. Each partition's total is
summed first, an exclusive prefix over these totals (one row per partition) gives every
partition its start, and a running sum inside each partition then gives each document its
offset in the whole corpus. A document goes to the shard in whose equal share of all bytes
its middle lies, so shards are contiguous in that order and differ by less than one
document from the target at either end.

The order is (md5 of the text, doc_id): equal texts lie side by side, and since doc_id
is part of the range key a hot text is spread over as many partitions as its rows need. There are as many
partitions as the rows need, whatever the session's number. Texts are read once: what is known of them is written and sorted from there.

Defined results: a null text has no bytes; the empty table gives no rows; with less bytes
than shards, or a document larger than a share, some shards stay empty; repeated rows are
interchangeable; rows with null doc_id sort first among equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyspark.llm import common as C

#: Bytes that each document costs besides its text.
OVERHEAD = 16


#: Rows of a partition, about.
PART_ROWS = 200_000


def text_key(text):
    """60 bits of md5 of a text: the same on every run and engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), text_key(t).alias("h"))


def assign(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id", part_rows: int = PART_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, and offset, its first byte in the global order."""
    spark = docs.sparkSession
    known = C.stored(measured(docs, text, doc_id), "measured")
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // part_rows))
    ranged = known.repartitionByRange(n, "h", "doc_id", "size").withColumn("part", F.spark_partition_id())
    rows = C.stored(ranged, "sized")
    C.forget(known)
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "n")], F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy("h", "doc_id", "size")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rows.join(starts, "part")
        .withColumn("offset", F.col("bytes_before") + F.sum("size").over(run) - F.col("size"))
        .withColumn("row", F.col("n_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((2 * F.col("offset") + F.col("size")).cast("decimal(38,0)") * shards / (2 * F.col("total")).cast("decimal(38,0)"))).cast("int"))
    )
    placed = C.stored(placed.select("doc_id", "size", "text_crc32", "offset", "row", "shard"), "sharded")
    C.forget(rows)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in shards 0 to 39."""
    return assign(C.table(spark, sf_dir, "documents"), 40)


def crc_step() -> str:
    """One byte v of a reflected CRC-32 with the register a, in SQL: the table of 256 is linear in the byte's bits."""
    out = "a >> 8"
    for bit in range(8):
        row = 1 << bit
        for _ in range(8):
            row = (row >> 1) ^ (0xEDB88320 * (row & 1))
        out = f"xor({out}, ((xor(a, v) >> {bit}) & 1) * {row})"
    return out


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda p: ('0x' || p)::BIGINT) AS l FROM t),
d AS (SELECT doc_id, (len(l) + {OVERHEAD})::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, l), lambda a, v: {crc_step()}), 4294967295) AS text_crc32, ('0x' || substr(md5(t), 1, 15))::BIGINT AS h FROM b),
o AS (SELECT *, (sum(size) OVER w)::BIGINT - size AS "offset", (sum(size) OVER ())::BIGINT AS total, row_number() OVER w AS k FROM d WINDOW w AS (ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least(39, ((2 * "offset" + size)::HUGEINT * 40) // (2 * total))::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, k - min(k) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard, "offset" FROM s
"""
