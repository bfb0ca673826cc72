"""Quality by pairwise ranking: a Bradley-Terry model of which of two documents is better.

Every pair of a good and a bad labelled document is a preference. The score of a document is a linear function of its features, and the
probability that it is preferred to another one is the logistic function of the difference of their scores; the weights are fitted by the logistic loss on
differences of features. A document then counts as good from a quantile of the scores on, and its result is the logistic function of the distance to that
threshold: 0.5 or more from the quantile on.

Features of a whole text, none of them a word of a language: shares of classes of bytes (each ASCII sign by itself), length, and how much of the text
repeats itself (the word before, words, pairs and triples of words, lines, the commonest word). They come from Arrow's buffers, many texts at a time.

The fit takes every labelled document. Their features are written once; documents are dealt by a hash into groups of both classes (the rarer class's into several, where the other one
has many more), and in a group each document has at least ``ROUNDS`` pairings with documents of the other class. Newton's steps are passes over the groups, of which the driver gets
sums only. Sums are of whole numbers, so neither order nor partitions change them. The level of the quantile is the one that parts all labels with the fewest errors; of several, the middle
of the widest gap between scores. Scoring runs over all rows and whole texts.

Defined results: null texts count as empty ones, and both are scored like all others; without good or without bad labels every score is the good ones' share of the labels (0.5
without labels); of several labels of one document the largest counts, null labels don't; repeated rows get the same score; no other column than those named is read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyspark.llm import common as C
from skyspark.llm.byte_automaton import PIECE, Automaton, texts

#: Pairings of each labelled document.
ROUNDS = 8
#: Documents of the rarer class and of the other one in a group, about.
FEW, MANY = 64, 128
#: Sums are kept in units of these: of features and their squares, and of the loss and its derivatives.
UNIT, FINE = 1 << 24, 1 << 40
#: Weight of the squared weights in the loss, by pair.
RIDGE = 1e-3
#: Rows whose words are held at a time, at most.
ROWS = 100

SPACES = (0x20, *range(0x09, 0x0E))


def classes() -> tuple[np.ndarray, int]:
    """The class of each byte: every ASCII sign is one; so are capitals, small letters, digits, spaces, line ends, control characters and bytes of other characters."""
    of, n = np.zeros(256, np.int64), 7
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            of[b] = 6
        elif c == "\n":
            of[b] = 4
        elif b in SPACES:
            of[b] = 3
        elif b < 0x20 or b == 0x7F:
            of[b] = 5
        elif c.isalnum():
            of[b] = 2 if c.isdigit() else int(c.islower())
        else:
            of[b], n = n, n + 1
    return of, n


CLASS, CLASSES = classes()
WORDS = Automaton(np.array([b not in SPACES for b in range(256)]))
LINES = Automaton(np.array([b not in (0x0A, 0x0D) for b in range(256)]))
#: Log-shares of bytes; logs of bytes, words and their quotient; parts that repeat.
WIDTH = CLASSES + 3 + 7


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log(1 + per cent): 0 where there is nothing."""
    return np.log1p(100 * part / np.maximum(whole, 1))


def again(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: how many of the hashes were there before, and how often the commonest one is."""
    keys, times = np.unique(row.astype(np.uint64) << np.uint64(32) | h.astype(np.uint64), return_counts=True)
    of = (keys >> np.uint64(32)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, times)
    return np.bincount(row, minlength=n) - np.bincount(of, minlength=n), most


def gathered(machine: Automaton, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all words of a column."""
    found = [(row, crc) for _, row, crc in machine.runs(column, 1)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def features(column: pa.Array) -> np.ndarray:
    """A row of WIDTH numbers for each text."""
    n = len(column)
    raw, begin, end = texts(column)
    bytes_ = np.zeros((n, CLASSES), np.int64)
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        for at in range(a, b, PIECE):
            bytes_[i] += np.bincount(CLASS[raw[at : min(b, at + PIECE)]], minlength=CLASSES)
    size = (end - begin).astype(np.float64)
    row, word = gathered(WORDS, column)
    words = np.bincount(row, minlength=n).astype(np.float64)
    two, three = (row[1:] == row[:-1]), (row[2:] == row[:-2])
    pair = word[1:] * np.uint32(0x9E3779B1) ^ (word[:-1] + np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    triple = pair[1:] * np.uint32(0x27D4EB2F) ^ word[:-2] * np.uint32(0x165667B1)
    same = np.bincount(row[1:][two & (word[1:] == word[:-1])], minlength=n)
    (old, most), (old2, most2), (old3, _) = [again(r, h, n) for r, h in ((row, word), (row[1:][two], pair[two]), (row[2:][three], triple[three]))]
    line_row, line = gathered(LINES, column)
    old_lines, _ = again(line_row, line, n)
    lines = np.bincount(line_row, minlength=n)
    ratios = [share(x, y) for x, y in ((same, words), (old, words), (most, words), (old2, words), (most2, words), (old3, words), (old_lines, lines))]
    return np.column_stack([share(bytes_, size[:, None]), np.log1p(size), np.log1p(words), np.log1p(size / np.maximum(words, 1)), *ratios])


class Model:
    """weights, by standardised feature, with the features' centres and scales; threshold: a quantile of scores; flat: the only result if there is nothing to learn."""

    def __init__(self, weights=None, centre=None, scale=None, threshold: float = 0.0, flat: float | None = None):
        self.weights, self.centre, self.scale, self.threshold, self.flat = weights, centre, scale, threshold, flat

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Scores on the scale of the pairwise log-odds, summed feature by feature, so that no other row changes them."""
        z = (x - self.centre) / self.scale
        out = np.zeros(len(x))
        for k, w in enumerate(self.weights):
            out += w * z[:, k]
        return out

    def results(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.rank(x) - self.threshold, -700, 700)))


def pairs(good: int, bad: int, rounds: int = ROUNDS) -> np.ndarray:
    """Pairs (good, bad): in each round all of the larger class, each with one of the other, dealt anew."""
    rng, n, out = np.random.default_rng(1), max(good, bad), []
    for _ in range(rounds):
        out.append(np.column_stack([rng.permutation(n) % good, rng.permutation(n) % bad]))
    return np.concatenate(out)


def curved(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of log(1 + exp(-w . d)) over the rows of d, its gradient and its second derivatives, one after the other."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -700, 700)))
    return np.concatenate([[np.logaddexp(0, -d @ w).sum()], -d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, int]], width: int, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Weights that minimise the mean loss + ridge / 2 * w . w, by Newton's method with halved steps. sums: what ``curved`` gives at some weights for all pairs, and their number."""

    def at(v):
        total, n = sums(v)
        m = total / n
        return m[0] + ridge / 2 * v @ v, m[1 : width + 1] + ridge * v, m[width + 1 :].reshape(width, width) + ridge * np.eye(width)

    w = np.zeros(width)
    now, grad, curve = at(w)
    for _ in range(steps):
        if np.abs(grad).max() < 1e-9:
            break
        move = np.linalg.solve(curve, grad)
        step = 1.0
        new = at(w - move)
        while new[0] > now and step > 1e-6:
            step /= 2
            new = at(w - step * move)
        if new[0] > now:
            break
        w, gain, (now, grad, curve) = w - step * move, now - new[0], new
        if gain < 1e-12:
            break
    return w


def rank_weights(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Weights of the pairs (better, worse), row by row."""
    d = better - worse
    return newton(lambda w: (curved(d, w), len(d)), d.shape[1], ridge, steps)


def cut(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The quantile of the scores with the least weight of labels on its wrong side; of several, the middle of the widest gap."""
    by = np.argsort(scores, kind="stable")
    s, good, bad = scores[by], np.where(y[by] == 1, weight[by], 0), np.where(y[by] == 0, weight[by], 0)
    wrong = np.cumsum(good)[:-1] + bad.sum() - np.cumsum(bad)[:-1]  # with the cut behind each score but the last
    gap = s[1:] - s[:-1]
    wrong = np.where(gap > 0, wrong, np.inf)
    if not np.isfinite(wrong).any():
        return float(s[0])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9 * weight.sum())  # sums of weights are rounded
    k = best[np.argmax(gap[best])]
    return float(s[k] + gap[k] / 2)


def totals(rows: DataFrame, of: Callable, width: int) -> np.ndarray:
    """Sums over all of a table's Arrow batches, as Python's whole numbers; of(batch) yields arrays of them. A task sends one row."""

    def run(batches):
        total = np.zeros(width, object)
        for b in batches:
            for part in of(b):
                total = total + part
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, total))])], ["sums"])

    out = np.zeros(width, object)
    for r in rows.mapInArrow(run, "sums string").toLocalIterator():
        out = out + np.array([int(v) for v in r["sums"].split(" ")], object)
    return out


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, WIDTH)


def dealt(rows: DataFrame, few: int, n_few: int, n_many: int) -> DataFrame:
    """(good, bad): the features of a group's documents, one row a group. rows: id, y, x; few: the label of the rarer class. Its documents are in each group of their bucket, the others in one."""
    buckets = max(1, n_few // FEW)
    wide = max(1, -(-n_many // (buckets * MANY)))
    by = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id", "x"), F.lit(n))
    one = F.when(F.col("y") == few, F.sequence(F.lit(0), F.lit(wide - 1))).otherwise(F.array(by("group", wide).cast("int")))
    held = rows.select("y", "x", by("quality", buckets).alias("bucket"), F.explode(one).alias("group"))

    def gather(t: pa.Table) -> pa.Table:
        side = {0: [], 1: []}
        for y, x in zip(t["y"].to_pylist(), t["x"].to_pylist(), strict=True):
            side[y].append(x)
        return pa.table({"good": pa.array([b"".join(sorted(side[1]))], pa.binary()), "bad": pa.array([b"".join(sorted(side[0]))], pa.binary())})

    return held.groupBy("bucket", "group").applyInArrow(gather, "good binary, bad binary").where((F.length("good") > 0) & (F.length("bad") > 0))


def split(scored: DataFrame, held: C.Scratch) -> float:
    """``cut`` over a table (score, y) of any size: running sums within ranges of scores, and one row a range for the driver."""
    by = scored.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad"))
    by = held.stored(by.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    parts = sorted(by.groupBy("part").agg(F.min("score").alias("low"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect(), key=lambda r: r["low"])
    if sum(1 for _ in by.limit(2).collect()) < 2:
        return float(parts[0]["low"])
    # Wrong with the cut behind a score: the good ones up to it and the bad ones after it.
    rows, wrong = [], sum(r["bad"] for r in parts)
    for k, r in enumerate(parts):
        rows.append((r["part"], wrong, parts[k + 1]["low"] if k + 1 < len(parts) else None))
        wrong += r["good"] - r["bad"]
    before = scored.sparkSession.createDataFrame(rows, "part int, before long, after double")
    run = Window.partitionBy("part").orderBy("score")
    d = by.join(F.broadcast(before), "part").withColumn("wrong", F.col("before") + F.sum(F.col("good") - F.col("bad")).over(run)).withColumn("next", F.coalesce(F.lead("score").over(run), "after"))
    best = d.where("next IS NOT NULL").agg(F.min(F.struct("wrong", (F.col("score") - F.col("next")).alias("gap"), "score")).alias("b")).first()["b"]
    return float(best["score"] - best["gap"] / 2)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """labels: (doc_id, label) rows that may be learned from, all of them. The driver gets sums."""
    held = C.Scratch()
    given = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))

    def run(batches):
        for b in C.slices(batches, ROWS):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in features(b.column(1))], pa.binary())], ["id", "x"])

    # Numbers are joined, not texts: these are much longer.
    made = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL").mapInArrow(run, "id long, x binary")
    rows = held.stored(made.join(given, "id"), "quality")

    def moments(b):
        for part in C.slices([b], 16):  # so few that squares stay below 2 ** 63
            q, y = np.rint(matrix(part.column(1)) * UNIT).astype(np.int64), part.column(0).to_numpy()
            yield np.concatenate([[len(y), y.sum()], q.sum(0), (q * q).sum(0)]).astype(object)

    n, good, *rest = totals(rows.select("y", "x"), moments, 2 + 2 * WIDTH)
    if good in (0, n):
        held.clear()
        return Model(flat=float(good > 0) if n else 0.5)
    first, second = rest[:WIDTH], rest[WIDTH:]
    centre = np.array([a / n / UNIT for a in first])
    scale = np.sqrt(np.array([(n * b - a * a) / (n * n) for a, b in zip(first, second, strict=True)])) / UNIT
    scale = np.where(scale > 1e-9, scale, 1.0)
    few = int(2 * good < n)
    groups = held.stored(dealt(rows, few, good if few else n - good, n - good if few else good), "quality-groups")

    def sums(w):
        def of(b):
            for x, y in zip(b.column(0), b.column(1), strict=True):
                better, worse = [(np.frombuffer(v.as_py(), np.float64).reshape(-1, WIDTH) - centre) / scale for v in (x, y)]
                ab = pairs(len(better), len(worse))
                yield np.array([len(ab), *[int(v) for v in np.rint(curved(better[ab[:, 0]] - worse[ab[:, 1]], w) * FINE)]], object)

        n, *total = totals(groups, of, 2 + WIDTH + WIDTH * WIDTH)
        return np.array([v / FINE for v in total]), n

    model = Model(newton(sums, WIDTH), centre, scale)

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.rank(matrix(b.column(1)))), b.column(0)], ["score", "y"])

    model.threshold = split(rows.select("y", "x").mapInArrow(score, "score double, y int"), held)
    held.clear()
    return model


def judge(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted. The model is some fifty numbers."""

    def run(batches):
        for b in C.slices(batches, ROWS):
            p = model.results(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every whole text of documents."""
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    learnable = lambda df: df.where(C.remainder(F.col("doc_id"), 3) != 1)
    model = fit(learnable(docs), learnable(labels))
    return judge(docs, model).select("doc_id", (C.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
