"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text; where its upper bits are zero a chunk ends. The hash
sees the last 8 bytes only, so an insertion moves no boundary beyond the next one, and a passage that
two documents share falls into the same chunks but at its ends. Chunks are deduplicated by their
digest (xxh3, 64 bits): a digest that occurs in two documents or more is repeated, and its first document is the
one with the smallest id. Adjacent repeated chunks form a run, and a run of at least
``WORDS`` words is a repeated passage; one chance collision of digests makes no run. A passage is given in stretches: a new
one begins where chunks that are here for the first time meet chunks that an earlier document has.

Chunk counts are combined before they are shuffled, and the join that brings them back can be split
where a chunk is very frequent; runs are formed per document.

Defined results: null and empty texts, and rows with null doc_id, have no passages; repetition inside one
document only (one doc_id) is none; rows that repeat an id and text give one result, rows that repeat an id
with another text are searched each; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyspark.llm import common as C

#: Bytes of a chunk at least and at most; boundaries come once in 2 ** BITS bytes.
LEAST, MOST, BITS = 8, 96, 5
#: Words of a passage, counted in whole chunks. What is left at its two ends, up to a chunk each, doesn't count, so passages of over 50 words are asked for by fewer:
#: of 2,080 documents of sf0.1 that share 51 words with another one, 28 finds 0.993 (20: 0.997, 36: 0.982), and a repeat of less than about 30 words is left alone.
WORDS = 28
GEAR = np.random.default_rng(20240301).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    h = GEAR[data]
    for back, shift in ((1, 2), (2, 4), (4, 8)):
        h[back:] = h[back:] + (h[:-back] << np.uint16(shift))
    out, last, n = [], 0, len(data)
    for cut in (np.flatnonzero(h >> np.uint16(16 - BITS) == 0) + 1).tolist():
        while cut - last > MOST:
            last += MOST
            out.append(last)
        if cut - last >= LEAST:
            out.append(cut)
            last = cut
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunks(text: str | None) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, int]:
    """Digest, start, end and words of each chunk, and the digest of the text; a word counts where it begins."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        none = np.zeros(0, np.int32)
        return [], none, none, none, 0
    data = np.frombuffer(raw, np.uint8)
    end = np.array(boundaries(data))
    start = np.concatenate([[0], end[:-1]])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
    digest = xxhash.xxh3_64_intdigest
    hashes = [digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return hashes, start.astype(np.int32), end.astype(np.int32), (begins[end] - begins[start]).astype(np.int32), digest(raw)


def chunked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, copy, digest, place): one row per chunk. copy tells texts with one id apart (32 bits of their digest); place is start << 16 | bytes << 8 | words, so what is shuffled per chunk is narrow."""

    def run(batches):
        for b in C.slices(batches):
            ids, copies, hashes, places = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h, start, end, words, own = chunks(t.as_py())
                hashes += h
                ids.append(np.full(len(h), i, np.int64))
                copies.append(np.full(len(h), short(own), np.int32))
                places.append((start.astype(np.int64) << 16) | (end - start) << 8 | words)
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(copies)), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(np.concatenate(places))], ["doc_id", "copy", "digest", "place"])

    given = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, copy int, digest long, place long")


def short(digest: int) -> int:
    """The lower 32 bits, with a sign."""
    return ((digest + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)


def passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """One row per stretch of a repeated passage of a document: doc_id, start, end (bytes), words, chunks, first_doc_id (smallest id that the first copy of one of its chunks has) and kept.

    A passage has at least ``words`` words in all its stretches. kept: the stretch's chunks are all here for the first time, so this copy stays when
    repeats are removed; in the others every chunk has its first copy in an earlier document."""
    every = C.stored(chunked(docs, text, doc_id), "chunks")
    # Written, so that the join reads two plain shuffles, which the engine can split where a digest is hot.
    seen = C.stored(every.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "repeated")
    by = Window.partitionBy("doc_id", "copy").orderBy("place")
    # Repeated rows give equal chunks at one place; the first of them counts.
    own = every.join(seen, "digest").select("doc_id", "copy", "place", "first").withColumn("again", F.lag("place").over(by)).where("again IS NULL OR again <> place")
    once = own.select("doc_id", "copy", "first", "place", F.shiftright("place", 16).alias("start"), (F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(255)).alias("end"), F.col("place").bitwiseAND(255).alias("words"))
    mine, apart = F.col("first") == F.col("doc_id"), F.coalesce(F.lag("end").over(by) != F.col("start"), F.lit(True))
    turn = F.coalesce(apart | (F.lag("mine").over(by) != F.col("mine")), F.lit(True))
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = once.withColumn("mine", mine).withColumns({"apart": apart.cast("int"), "turn": turn.cast("int")}).withColumns({"run": F.sum("apart").over(upto), "stretch": F.sum("turn").over(upto)})
    out = runs.groupBy("doc_id", "copy", "run", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.count("*").alias("chunks"), F.min("first").alias("first_doc_id"), F.first("mine").alias("kept"))
    whole = F.sum("words").over(Window.partitionBy("doc_id", "copy", "run"))
    return out.withColumn("whole", whole).where(F.col("whole") >= words).select("doc_id", "copy", "start", "end", "words", "chunks", "first_doc_id", "kept")


def removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """docs whose text lacks the stretches of at least ``words`` words that are repeats of earlier documents'; a cut never splits a character.

    What is shorter is no passage by itself and stays, as it does outside a passage. The first copy of a chunk always stays."""
    mark = F.struct("copy", "start", "end")
    spans = passages(docs, text, doc_id, words).where(~F.col("kept") & (F.col("words") >= words)).groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(mark)).alias("__spans"))
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for b in C.slices(batches):
            texts = []
            for t, cuts in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if cuts and t:
                    raw = t.encode("utf-8", "surrogatepass")
                    own = short(xxhash.xxh3_64_intdigest(raw))
                    parts, last = [], 0
                    for c in cuts:
                        if c["copy"] == own:
                            parts.append(raw[last : c["start"]])
                            last = c["end"]
                    t = b"".join([*parts, raw[last:]]).decode("utf-8", "ignore")
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.join(spans, F.col(doc_id) == F.col("__id"), "left").select(*names, "__spans").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: repeated passages of all whole texts of documents."""
    return passages(C.table(spark, sf_dir, "documents")).drop("copy")
