"""Language identification by hierarchical discrimination.

A first stage predicts the language's family, a second one the language inside it; both are
one-versus-one linear support vector machines over hashed counts of 1 to 3 characters of the
whole text. The score is the product of both stages' probabilities; as those
of a stage sum to 1, it falls with the number of classes. The certainty does not: it is the product of the winners' mean
pairwise probabilities, 0.25 or more.

The machines are fitted by the driver on about ``SAMPLE`` labelled documents, the same
number of each language, chosen by a hash of the id, and on ``LEAST`` of each language where that is more: no language is
left out, however many there are. Everything else runs over all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text
if no labelled document may be learned from; with one known language, all texts with letters
are that with score 1; ties go to the first language by name; a language missing from
``FAMILIES`` is a family of its own, and where there are more than ``ALONE`` of them, they are families by the
likeness of their mean profiles; repeated rows get the same prediction; columns of docs that are named like a result are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspark.llm import common as C
from skyspark.llm.linear import OneVersusOne

#: Labelled documents that the fit uses, about.
SAMPLE = 2400
#: Of each language at least, about.
LEAST = 20
#: Languages of unknown family that are families of their own; more are grouped.
ALONE = 8
#: Hashed features.
WIDTH = 4096
#: Characters counted at a time.
PIECE = 1 << 20
GROUPS = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi", "romance": "fr es it pt ro ca gl oc la", "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk uz ky tk tt", "indo-aryan": "hi ur bn mr gu pa ne si", "dravidian": "ta te kn ml",
    "semitic": "ar he mt am", "celtic": "ga gd cy br", "malayo-polynesian": "id ms tl jv", "iranian": "fa ku ps tg",
}
FAMILIES = {code: family for family, codes in GROUPS.items() for code in codes.split()}

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def profile(text: str | None) -> np.ndarray | None:
    """Unit vector of the square roots of the counts; None without a letter. What is no letter counts as a space, runs of it as one."""
    if not text:
        return None
    counts, any_letter = np.zeros(WIDTH), False
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[c]
        if not is_letter.any():
            continue
        any_letter = True
        c = np.where(is_letter, c, 32)
        c = np.concatenate([[32], c[is_letter | np.concatenate([[True], is_letter[:-1]])], [32]]).astype(np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + c[1:] * np.uint32(0x27D4EB2F)
        three = (two[:-1] ^ np.uint32(0x165667B1)) * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0x85EBCA6B)
        for h in (one, two, three):
            counts += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=WIDTH)
    if not any_letter:
        return None
    x = np.sqrt(counts)
    return (x / np.sqrt((x * x).sum())).astype(np.float32)


def grouped(x: np.ndarray, labels: np.ndarray, names: list[str]) -> dict[str, str]:
    """Families of languages of unknown family: about the square root of their number, each about one of the languages least like those before it."""
    mean = np.array([x[labels == k].mean(0) for k in names], np.float64)
    mean /= np.sqrt((mean * mean).sum(1, keepdims=True))
    near = mean @ mean[0]
    heads = [0]
    while len(heads) < int(np.ceil(np.sqrt(len(names)))):
        heads.append(int(np.argmin(near)))
        near = np.maximum(near, mean @ mean[heads[-1]])
    own = np.argmax(np.round(mean @ mean[heads].T, 9), axis=1)
    return {k: f"like {names[heads[i]]}" for k, i in zip(names, own, strict=True)}


class Model:
    """The fitted hierarchy."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES):
        labels = np.array(langs, object)
        unknown = sorted({k for k in langs if k not in families})
        more = {k: f"only {k}" for k in unknown} if len(unknown) <= ALONE else grouped(x, labels, unknown)
        of = [families.get(k) or more[k] for k in langs]
        self.families = OneVersusOne(x, of) if langs else None
        at = np.array(of, object)
        self.inside = {f: OneVersusOne(x[at == f], [k for k, g in zip(langs, of, strict=True) if g == f]) for f in set(of)}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and certainties."""
        lang, score, sure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        found = [(i, x) for i, t in enumerate(texts) if (x := profile(t)) is not None] if self.families else []
        if not found:
            return lang, score, sure
        rows, x = np.array([i for i, _ in found]), np.array([x for _, x in found])
        p = self.families.scores(x)
        best, first = p.argmax(1), self.families.certainty(p)
        for f in np.unique(best):
            on, machine = np.flatnonzero(best == f), self.inside[self.families.classes[f]]
            q = machine.scores(x[on])
            for r, k in zip(rows[on], q.argmax(1), strict=True):
                lang[r] = machine.classes[k]
            score[rows[on]] = np.clip(p[on].max(1) * q.max(1), 0, 1)
            sure[rows[on]] = np.clip(first[on] * machine.certainty(q), 0, 1)
        return lang, score, sure


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, least: int = LEAST) -> Model:
    """labelled: the documents that may be learned from; rows with null lang are left out. The driver gets one row per language and the sample."""
    labelled = labelled.where(F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Model(np.zeros((0, WIDTH), np.float32), [])
    each, grain = max(least, sample / len(counts)), 1 << 40
    share = labelled.sparkSession.createDataFrame([(k, int(min(1.0, each / n) * grain)) for k, n in sorted(counts.items())], "lang string, share long")
    chosen = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(grain)) < F.col("share"))

    def run(batches):
        for b in C.slices(batches):
            rows = [(k, v) for k, t in zip(b.column(1).to_pylist(), b.column(0), strict=True) if (v := profile(t.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v.tobytes() for _, v in rows], pa.binary())], ["lang", "x"])

    rows = sorted((r["lang"], bytes(r["x"])) for r in chosen.select("text", "lang").mapInArrow(run, "lang string, x binary").toLocalIterator())
    x = np.empty((len(rows), WIDTH), np.float32)
    for i, (_, v) in enumerate(rows):
        x[i] = np.frombuffer(v, np.float32)
    langs = [k for k, _ in rows]
    del rows
    return Model(x, langs)


RESULTS = ("lang_pred", "score", "certainty")


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with lang_pred, score and certainty. The model, a few thousand weights per pair of languages of a family and of families, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema) + "lang_pred string, score double, certainty double"

    def run(batches):
        m = sent.value
        for b in C.slices(batches, 100):  # a hundred profiles at a time
            lang, *two = m.predict([t.as_py() for t in b.column(0)])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), *[pa.array(x, pa.float64()) for x in two]], [*names, *RESULTS])

    return docs.select(F.col(text).alias("__text"), *names).mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return docs.where(C.remainder(F.col("doc_id"), 3) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the language of every whole text of documents."""
    docs = C.table(spark, sf_dir, "documents")
    out = predict(docs, fit(learnable(docs)), keep=("doc_id",))
    return out.select("doc_id", (C.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
