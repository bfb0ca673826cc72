"""Exact deduplication with a persistent digest index (native: DataFrame and SQL functions only).

The index is a table of digests, bucketed by digest and sorted inside its buckets, with one partition per batch of documents, under the batch's number and name. A batch is
reduced to one row per digest before anything is shuffled. Digests that earlier batches lack are found by a sort-merge anti-join
against their bucketed side, which isn't shuffled; they and the counts of those that are known already are written as the batch's
partition. What is new in a batch depends on the batches of smaller numbers alone, so a batch that is appended again, under its name, keeps its number and becomes
what it was, whatever came after it; one that failed half way is simply appended again. Reading sums
a digest's rows inside its bucket: the largest doc_id and the count over all batches.

A hot digest, such as a text that a third of all rows carry, never meets in one task: aggregation
combines before its shuffle (its result is written, as the optimiser would else join before it), and when rows get their group back,
digests of more than a ``hot_parts``-th of the rows (there can't be more than ``hot_parts`` of
them) are looked up in a broadcast of at most that many rows.

Defined results: a null text counts as the empty text; texts are equal when identical after
lower-casing A-Z; among equal texts the largest doc_id stays (null doc_ids sort lowest, and
of repeated rows with that doc_id all are marked kept in ``annotate``, one is kept by
``deduplicate``); with an index that holds earlier batches, ``annotate`` gives the state after this batch, and ``deduplicate`` drops
what an earlier batch has. A batch may be run again in any order: it brings the same rows as before, and of equal texts in several batches one stays. A batch is known by the name
that the caller gives it, or else by its rows; an empty table gives an empty result; other columns pass through
``deduplicate`` untouched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyspark.llm import common as C

#: Digests with more than a HOT_PARTSth of all rows are joined by broadcast; there are fewer than this many.
HOT_PARTS = 2000
#: Batches in which a table is appended to the index.
BATCHES = 2


def digest(text):
    """SHA-256 (32 bytes) of the normalised text in UTF-8."""
    return F.unhex(F.sha2(C.ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """A digest index kept at ``path``; opening it again in another session finds what was appended. The number of buckets is the index's for good: choose it for its final size."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or C.fresh_path(spark, "digest-index")
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, novel BOOLEAN, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        C.make_dir(spark, self.path)
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def rows(self) -> DataFrame:
        """(digest, keep_id, group_size, novel, batch): a row per digest and batch that has it."""
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size) over all batches; the bucketed rows are not shuffled."""
        return self.rows().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def numbers(self) -> dict[str, int]:
        """The batches by name and the numbers under which they were first appended. Read from the partitions' names, some bytes a batch."""
        found = [r[0].removeprefix("batch=").split("-", 1) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]
        return {name: int(n) for n, name in found}

    def append(self, digests: DataFrame, batch: str | None = None) -> str:
        """Adds (doc_id, digest) rows as a batch, or replaces the batch of that name (by default one that follows from the rows). Returns its partition, its number and name."""
        if batch is not None and not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch's name has letters, digits, - and _ only, not {batch!r}")
        groups = C.stored(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "digest-groups")
        if batch is None:
            n, one, two = groups.agg(F.count("*"), *[F.bit_xor(F.xxhash64(F.lit(k), "digest", "keep_id", "group_size")) for k in (1, 2)]).first()
            batch = f"{n}-{(one or 0) % (1 << 64):016x}{(two or 0) % (1 << 64):016x}"
        known_as = self.numbers()
        part = f"{known_as.get(batch, max(known_as.values(), default=0) + 1):09d}-{batch}"
        known = self.rows().where(F.col("batch") < part).select("digest")
        parts = [groups.hint("merge").join(known, "digest", how).withColumn("novel", F.lit(how == "left_anti")) for how in ("left_anti", "left_semi")]
        new = C.stored(parts[0].unionByName(parts[1]).select("digest", "keep_id", "group_size", "novel"), "digest-batch")
        dealt = new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{part}') SELECT * FROM {{dealt}}", dealt=dealt)
        self.spark.catalog.refreshTable(self.name)
        C.forget(groups)
        C.forget(new)
        return part

    def novel(self, digests: DataFrame) -> DataFrame:
        """The rows of digests whose digest the index lacks."""
        return digests.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def remove(self) -> None:
        """Drops the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        C.delete(self.spark, self.path)


def with_groups(rows: DataFrame, index: DigestIndex, total: int, hot_parts: int = HOT_PARTS) -> DataFrame:
    """rows with keep_id and group_size of their digest, without ever gathering a hot digest in one task. Hot is what is frequent in these rows, so an index of earlier batches broadcasts no more."""
    groups = index.read()
    often = rows.groupBy("digest").count().where(F.col("count") * hot_parts > F.lit(total)).select("digest")
    hot = C.stored(groups.join(F.broadcast(often), "digest"), "hot")
    marked = rows.join(F.broadcast(hot), "digest", "left")
    found = marked.where(F.col("group_size").isNotNull())
    rest = marked.where(F.col("group_size").isNull()).drop("keep_id", "group_size").hint("merge")
    return found.unionByName(rest.join(groups, "digest"))


def annotate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", index: DigestIndex | None = None, batches: int = BATCHES, hot_parts: int = HOT_PARTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Appends docs to the index in some batches (to a fresh one, removed afterwards, by default)."""
    rows = C.stored(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest")), "digests")
    own = index or DigestIndex(docs.sparkSession)
    name = uuid.uuid4().hex
    for k in range(batches):
        own.append(rows.where(F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(batches)) == k), f"{name}-{k}")
    out = with_groups(rows, own, rows.count(), hot_parts)
    out = C.stored(out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")), "annotated")
    C.forget(rows)
    if index is None:
        own.remove()
    return out


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """docs without the rows whose text another row with a larger doc_id or an earlier batch of the index has; of repeated rows (equal doc_id and text) one stays.

    The digests are appended to the index under the batch's name, by default one that follows from its rows, so that a rerun brings the same rows (to a fresh index by default, which is removed again), and those that were new to it bring their document; texts are shuffled once."""
    names, tag = docs.columns, uuid.uuid4().hex
    by, key = f"digest_{tag}", f"key_{tag}"
    own = index or DigestIndex(docs.sparkSession)
    part = own.append(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest")), batch)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    won = C.stored(own.rows().where((F.col("batch") == part) & F.col("novel")).select(F.col("digest").alias(by), named("keep_id").alias(key)), "digests-won")
    if index is None:
        own.remove()
    marked = docs.withColumns({by: digest(F.col(text)), key: named(doc_id)})
    once = Window.partitionBy(by, key).orderBy(F.lit(0))
    return marked.hint("merge").join(won, [by, key], "left_semi").withColumn(tag, F.row_number().over(once)).where(F.col(tag) == 1).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every row and whole text of documents."""
    return annotate(C.table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
