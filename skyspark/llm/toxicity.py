"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores each sentence from the distinct words it
holds and their beginnings (which carry over to inflections not seen), and the document's score is the noisy-or of its sentences: 1 - product(1 - p). The model
is fitted from document labels alone, through the noisy-or, so it also says which sentences
offend.

The fit runs on the driver over at most about ``SAMPLE`` labelled documents of each class, chosen
by a hash of the id and weighted back to their true share; what is in fewer than ``MIN_DOCS`` of
them, or says little about the label by itself (``MIN_ODDS``), is left out. A share of ``NOISE`` wrong labels is allowed for, which keeps single documents
from being learned by heart. Scoring runs over all rows and whole texts.

Defined results: null and empty texts, and texts without a word, have no sentence and score 0; without
positive or without negative labels every score is that class's share of the labels; of several labels of one
document the largest counts, null labels don't; documents without label are scored like all others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspark.llm import common as C

#: Labelled documents of each class that the fit uses, about.
SAMPLE = 2000
MIN_DOCS = 5
#: Log-odds ratio of a feature between toxic and other documents, at least.
MIN_ODDS = 1.0
NOISE = 0.04
#: Lengths of the beginnings of words.
STEMS = (4, 5, 6)
#: Words that a Python worker remembers the weight of.
WORDS = 500_000
SENTENCE = regex.compile(r"[^.!?\n]*[\p{L}\p{N}][^.!?\n]*[.!?]*")
WORD = regex.compile(r"[\p{L}\p{N}]+")


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    w = word.encode("utf-32-le", "surrogatepass")
    return [zlib.crc32(w), *[zlib.crc32(w[: 4 * n], n) for n in STEMS if len(word) > n]]


def bags(text: str | None) -> list[list[int]]:
    """Distinct features of each sentence."""
    return [sorted({f for w in set(WORD.findall(s.lower())) for f in features(w)}) for s in SENTENCE.findall(text or "")]


class Model:
    """weights: of features; bias: of a sentence without any; flat: the only score if there is nothing to learn."""

    def __init__(self, weights: dict[int, float], bias: float, flat: float | None = None):
        self.weights, self.bias, self.flat = weights, bias, flat
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        if len(self.known) >= WORDS:
            self.known.clear()
        w = self.known[word] = sum([self.weights.get(f, 0.0) for f in features(word)])
        return w

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, log-odds) of each sentence."""
        out, known = [], self.known
        for m in SENTENCE.finditer(text or ""):
            z = self.bias
            for w in set(WORD.findall(m[0].lower())):
                x = known.get(w)
                z += self.weight(w) if x is None else x
            out.append((m.start(), m.end(), z))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, probability) of the sentences that offend: those likelier to than not, or else the likeliest of a document that does."""
        found = self.sentences(text)
        if self.flat is not None:
            return self.flat, []
        if not found:
            return 0.0, []
        z = np.array([x[2] for x in found])
        p = float(-np.expm1(-np.logaddexp(0, z).sum()))
        prob = 1 / (1 + np.exp(-z))
        hits = [i for i in range(len(z)) if prob[i] >= 0.5] or ([int(np.argmax(z))] if p >= 0.5 else [])
        return min(1.0, max(0.0, p)), [(found[i][0], found[i][1], float(prob[i])) for i in hits]


def train(bagged: list[tuple[bytes, bytes, int, float]], steps: int = 300) -> Model:
    """bagged: of each document its sentences' features (uint32) one after the other, their numbers (int32), label and weight."""
    bagged = [b for b in bagged if len(b[1])]
    y = np.array([b[2] for b in bagged], np.int64)
    if not len(bagged) or y.min() == y.max():
        return Model({}, 0.0, float(y.mean()) if len(bagged) else 0.0)
    share = np.array([b[3] for b in bagged])
    share /= share.sum()
    sizes = [np.frombuffer(b[1], np.int32) for b in bagged]
    doc_of = np.repeat(np.arange(len(y)), [len(n) for n in sizes])
    m = len(doc_of)
    sentence_of = np.repeat(np.arange(m), np.concatenate(sizes))
    names = np.concatenate([np.frombuffer(b[0], np.uint32) for b in bagged])
    labels = [np.unique(np.concatenate([np.unique(np.frombuffer(b[0], np.uint32)) for b in bagged if b[2] == k]), return_counts=True) for k in (0, 1)]
    every = np.unique(np.concatenate([x[0] for x in labels]))
    docs = np.zeros((2, len(every)))
    for k, (f, n) in enumerate(labels):
        docs[k, np.searchsorted(every, f)] = n
    rates = (docs + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1)
    kept = (docs.sum(0) >= MIN_DOCS) & (np.abs(np.log(rates[1] / rates[0])) >= MIN_ODDS)
    every, rates = every[kept], rates[:, kept]
    n = len(every)
    if not n:
        return Model({}, 0.0, float((share * y).sum()))
    word_of = np.minimum(np.searchsorted(every, names), n - 1)
    on = every[word_of] == names
    word_of, sentence_of = word_of[on], sentence_of[on]
    w, bias = np.clip(np.log(rates[1] / rates[0]), -1, 3), -6.0
    first = [np.zeros(n + 1), np.zeros(n + 1)]
    for t in range(1, steps + 1):
        z = bias + np.bincount(sentence_of, w[word_of], m)
        total = np.bincount(doc_of, np.logaddexp(0, z), len(y))
        p = np.clip(-np.expm1(-total), 1e-9, 1 - 1e-9)
        seen = NOISE + (1 - 2 * NOISE) * p
        up = share * np.where(y == 1, -1 / seen, 1 / (1 - seen)) * (1 - 2 * NOISE) * (1 - p)  # by total
        gz = up[doc_of] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word_of, gz[sentence_of], n) + 1e-5 * w, gz.sum())
        first[0], first[1] = 0.9 * first[0] + 0.1 * grad, 0.99 * first[1] + 0.01 * grad * grad
        move = 0.1 * (first[0] / (1 - 0.9**t)) / (np.sqrt(first[1] / (1 - 0.99**t)) + 1e-6)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.005)
    return Model({int(f): float(x) for f, x in zip(every, w, strict=True) if x}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """labels: (doc_id, label) rows that may be learned from."""
    given = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    grain = 1 << 40
    share = {y: min(1.0, sample / n) for y, n in counts.items()}
    part = F.when(F.col("y") == 1, F.lit(int(share.get(1, 0) * grain))).otherwise(F.lit(int(share.get(0, 0) * grain)))
    chosen = given.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(grain)) < part).withColumnRenamed("doc_id", "__id")

    def run(batches):
        for b in C.slices(batches):
            found = [bags(t.as_py()) for t in b.column(0)]
            names = [np.array([f for s in x for f in s], np.uint32).tobytes() for x in found]
            sizes = [np.array([len(s) for s in x], np.int32).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.binary())], ["y", "features", "sizes"])

    # About 2 * sample ids at most: the broadcast is bounded by the parameter.
    rows = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("__id")).select(F.col(text).alias("text"), "y").mapInArrow(run, "y int, features binary, sizes binary")
    return train(sorted((bytes(r["features"]), bytes(r["sizes"]), r["y"], 1 / share[r["y"]]) for r in rows.toLocalIterator()))


def judge(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted, and offending: array of (start, end, score) of the sentences that offend, in characters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        m = sent.value
        for b in C.slices(batches):
            found = [m.score(t.as_py()) for t in b.column(1)]
            where = [[{"start": s, "end": e, "score": p} for s, e, p in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([int(x[0] >= 0.5) for x in found], pa.int32()), pa.array(where, span)], ["doc_id", "score", "predicted", "offending"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every whole text of documents."""
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(C.remainder(F.col("doc_id"), 5) != 0))
    return judge(docs, model).select("doc_id", (C.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "offending")
