"""Quality ranking, importance resampling and conversation repair against slow versions on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skyspark.llm import common as C
from skyspark.llm import conversations, quality, resampling
from skyspark.llm.byte_automaton import Automaton

DOCS = "doc_id long, text string, score string, weight int, part string, n_words int, rank string, y int, learn_id long, row int"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", 1, "p", 2, "r", 3, 4, 5) for i, t in rows], DOCS)


LONG = " ".join(f"word{i % 997}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "Same Text here"), (5, "Same Text here"), (6, LONG), (6, LONG), (None, "no id at all in this one"), (9, "É à É, x" * 3), (10, "x" * 100_000), (11, "!?|" * 50)]


def slow_features(text, order=3):
    folded = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, order + 1) for i in range(len(words) - k + 1)], len(words)


@pytest.mark.parametrize("limit", [5, 64, 1 << 20])
def test_automaton_equals_zlib(limit):
    rng = random.Random(3)
    texts = [t for _, t in EDGE] + ["".join(rng.choice("ab Zé0-\n") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts[5] = texts[6] = LONG[:3000]
    machine = Automaton(resampling.IS_WORD, resampling.FOLD, limit)
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["before", None, *texts]).slice(2), pa.array([], pa.string())):
        got = [[] for _ in texts]
        for _, row, crc in machine.runs(column, 3):
            for i, x in zip(row.tolist(), crc.tolist(), strict=True):
                got[i].append(x)
        if len(column):
            assert [sorted(g) for g in got] == [sorted(slow_features(t)[0]) for t in texts]
        else:
            assert not any(got)


def slow_resample(rows, target, buckets=10_000, percent=5, least=20):
    found = [(i, *slow_features(t)) for i, t in rows]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, f, _ in found:
        np.add.at(s, [x % buckets for x in f], 1)
    for text in target:
        np.add.at(t, [x % buckets for x in slow_features(text)[0]], 1)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.sum() + buckets) / ((s[k] + 1) * (t.sum() + buckets)))) for k in range(buckets)]
    out = []
    for i, f, n in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % buckets] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least, None])
    may = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[5] = k
    return sorted(((*r[:4], r[5]) for r in out), key=str)


def test_resampling_equals_slow_version(spark, sf):
    corpus = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    for rows, aims, percent in ((corpus, target, 5), (EDGE, target, 70), (EDGE, [None], 100), ([], target, 5), (EDGE[:3], [], 5)):
        out = resampling.resample(docs(spark, rows), docs(spark, [(0, t) for t in aims]), percent=percent)
        assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in out.drop("n_words").collect()), key=str) == slow_resample(rows, aims, percent=percent)


def test_resampling_ranks_over_many_parts(spark):
    """The order over parts is that of one sort, ties included."""
    scored = spark.range(5000).selectExpr("id AS doc_id", "20L AS n_words", "1L AS n_features", "0L AS weight", "id % 7 AS score")
    got = resampling.rank(scored, percent=60, part_rows=300).where("rank IS NOT NULL").orderBy("rank").collect()
    want = sorted(range(5000), key=lambda i: (-(i % 7), i))[:3000]
    assert [r.rank for r in got] == list(range(1, 3001)) and [r.doc_id for r in got] == want


def slow_quality(text):
    """Some of the features, word by word."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    log = lambda part, whole: math.log1p(100 * part / max(1, whole))
    pairs, triples = list(itertools.pairwise(words)), list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in re.split(rb"[\n\r]", raw) if x]
    most = lambda x: max([x.count(k) for k in set(x)], default=0)
    return [math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(raw) / max(1, len(words))), *[log(x, len(words)) for x in (
        sum(a == b for a, b in pairs), len(words) - len(set(words)), most(words), len(pairs) - len(set(pairs)), most(pairs), len(triples) - len(set(triples)))], log(len(lines) - len(set(lines)), len(lines))]


def test_quality_features():
    texts = [t if t != LONG else LONG[:8000] for _, t in EDGE] + ["a a a b\na a a b\r\nc!!", "| x | y |", "1 2\n\n1 2\n"]
    x = quality.features(pa.array(texts))
    assert x.shape == (len(texts), quality.WIDTH)
    assert np.allclose(x[:, quality.CLASSES :], [slow_quality(t) for t in texts])
    for t, v in zip(texts, x, strict=True):
        raw = (t or "").encode()
        assert math.isclose(v[quality.CLASS[ord("!")]], math.log1p(100 * raw.count(b"!") / max(1, len(raw))))
        assert np.array_equal(quality.features(pa.array([t], pa.string()))[0], v)  # whatever stands beside it


def test_quality_equals_pairwise_descent():
    """Newton's weights are those of plain gradient descent on the same pairs; the cut is the best of all."""
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.6, 1, (60, 4)), rng.normal(-0.2, 1, (40, 4))
    ab = quality.pairs(60, 40)
    assert set(ab[:, 0]) == set(range(60)) and set(ab[:, 1]) == set(range(40))
    a, b = good[ab[:, 0]], bad[ab[:, 1]]
    w = np.zeros(4)
    for _ in range(4000):
        p = 1 / (1 + np.exp((a - b) @ w))
        w -= 0.5 * (quality.RIDGE * w - (a - b).T @ p / len(a))
    assert np.allclose(quality.rank_weights(a, b), w, atol=1e-5)
    s = np.concatenate([good @ w, bad @ w])
    y = np.repeat([1, 0], [60, 40])
    weight = np.where(y == 1, 3.0, 1.0)
    wrong = lambda c: weight[(s >= c) != (y == 1)].sum()
    assert math.isclose(wrong(quality.cut(s, y, weight)), min(wrong(c) for c in (s[:, None] + [-1e-9, 1e-9]).ravel()))
    for apart in range(1, 60):  # labels that the scores part, with weights whose sums are rounded
        y = (np.arange(100) >= apart).astype(int)
        assert apart - 1 < quality.cut(np.arange(100.0), y, np.where(y == 1, 19.3 / 3, 1.1)) < apart


def test_quality(spark, sf):
    corpus, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.query(spark, sf).collect()
    assert len(got) == corpus.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    model = quality.fit(corpus, labels)
    edge = quality.judge(docs(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and len({r.score for r in edge if r.doc_id == 6}) == 1 and len({r.score for r in edge if r.doc_id in (1, 2)}) == 1
    assert quality.judge(docs(spark, []), model).count() == 0
    for y, flat in (([], 0.5), ([1], 1.0), ([0], 0.0), ([None], 0.5)):
        few = spark.createDataFrame([(4, k) for k in y] + [(None, 1)], "doc_id long, quality int")
        assert {r.score for r in quality.judge(docs(spark, EDGE), quality.fit(docs(spark, EDGE), few)).collect()} == {flat}


def test_quality_learns_from_all(spark):
    texts = [f"w{i % 97} " * (1 + i % 13) + "!" * (i % 7) for i in range(5000)]
    y = [int(i % 50 != 0 and i % 7 < 5) for i in range(5000)]
    d = docs(spark, list(enumerate(texts)))
    model = quality.fit(d, spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int").repartition(5))
    x = quality.features(pa.array(texts))
    assert np.allclose(model.centre, x.mean(0), atol=1e-6) and np.allclose(model.scale, np.where(x.std(0) > 1e-9, x.std(0), 1), atol=1e-6)
    again = quality.fit(d.repartition(7), spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int"))
    assert np.array_equal(model.weights, again.weights) and model.threshold == again.threshold
    y, s = np.array(y), model.rank(x)
    assert ((s >= model.threshold) == (y == 1)).mean() == ((s >= quality.cut(s, y, np.ones(5000))) == (y == 1)).mean() > 0.9


def test_quality_split_equals_cut(spark):
    rng = np.random.default_rng(5)
    for span in (1, 2, 30, 100_000):
        s, y = rng.integers(0, span, 400) / 8, rng.integers(0, 2, 400)
        scored = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, y int").repartition(4)
        assert quality.split(scored, C.Scratch()) == quality.cut(s, y, np.ones(400))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in quality.query(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.99 * len(held)


GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def slow_audit(symbols, extra=3):
    """The least (cost, labels) over all strings of edits: a search by cost, then label string, over all that can be done, without a machine for the grammar."""
    import heapq

    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(symbols) and GRAMMAR.match(roles):
            return cost, audit
        if (at, roles) in done:
            continue
        done.add((at, roles))
        ways = [(2, "I", at, roles + c) for c in "ua"] if len(roles) < len(symbols) + extra else []
        if at < len(symbols):
            role, fault = symbols[at]
            more = fault == 3
            ways.append((3, "D", at + 1, roles))
            if fault not in (1, 2):
                ways += [(more, "K", at + 1, roles + (role or "?"))] + [(2 + more, "R", at + 1, roles + c) for c in "ua"]
        for c, label, to, new in ways:
            if "?" not in new and re.match(r"s?((ua)*u?)\Z", new):
                heapq.heappush(heap, (cost + c, audit + label, to, new))


def test_composition_equals_search():
    machine = conversations.Composition()
    for n in range(4):
        for symbols in itertools.product([("s", 0), ("u", 0), ("a", 0), ("", 0), ("u", 1), ("a", 3), ("s", 3)], repeat=n):
            ahead, ways = machine.end, []
            for role, fault in reversed(symbols):
                ahead, way = machine.before(ahead, role, fault)
                ways.append(way.split(","))
            g, audit, cost = 0, "", 0
            for (role, fault), way in zip(symbols, reversed(ways), strict=True):
                audit += way[g]
                cost += {"D": 3, "K": 0, "R": 2}[way[g][-1]] + 2 * (len(way[g]) - 1) + (fault == 3 and way[g][-1] != "D")
                for label in way[g]:
                    if label != "D":
                        g = conversations.GRAMMAR[g][role if label == "K" else conversations.GIVEN[g]]
            audit, cost = audit + machine.last[g], cost + 2 * len(machine.last[g])
            assert (cost, audit) == slow_audit(symbols), symbols


def slow_repair(rows):
    """rows: (turn, role, text) of one conversation, present ones only. Its figures, edited row by row."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, symbols, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        plain = text.strip(conversations.SPACES)
        fault = 1 if not plain else 2 if (role, text) in seen else 3 if plain[-1] not in ".!?" else 0
        seen.add((role, text))
        symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault))
        if fault:
            counts[fault - 1] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = slow_audit(symbols)
    out, at, last = [], 0, ""
    for label in audit:
        given = "assistant" if last == "u" else "user"
        if label != "I":
            _, role, text = rows[at]
            at += 1
        if label != "D":
            out.append((role if label == "K" else given, "" if label == "I" else text))
            last = out[-1][0][:1]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    said = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()), out


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, True, "l") for r in rows], "conv_id long, turn long, role string, text string, digest string, fault int, gone boolean, labels string")


def test_repair_equals_slow_version(spark):
    rng = random.Random(7)
    rows = [(1, None, None, None), (1, 0, "system", "Be kind."), (2, 5, "tool", "x."), (3, 0, "user", ""), (None, 1, "user", "Who?"), (None, 0, "user", "Who?"), (4, -3, "assistant", "Yes. \n"), (4, 9, "user", "yes." + " a" * 50_000)]
    for conv in range(10, 90):
        for turn in range(rng.randrange(9)):
            for _ in range(1 + (rng.random() < 0.1)):
                rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "", "ape", None]), rng.choice(["One.", "Two!", "Three?", "cut", "cut ", " ", "é.", None])))
    df = talk(spark, rows).repartition(5)
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    want = {conv: slow_repair(x) for conv, x in by.items()}
    got = {r.conv_id: tuple(r)[1:] for r in conversations.audited(df).collect()}
    assert got == {conv: w[0] for conv, w in want.items()}
    said = {}
    for r in sorted(conversations.repair(df).where("edit <> 'D'").collect(), key=lambda r: r.at):
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    assert said == {conv: w[1] for conv, w in want.items() if w[1]}
    assert conversations.audited(talk(spark, [])).count() == 0


def test_repair_of_damaged_conversations(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    by = {}
    for r in table.collect():
        rows, kind = by.setdefault(r.conv_id, []), zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        rows += [(r.turn, "user" if kind == 4 else r.role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.query(spark, sf).collect()}
    assert got == {conv: slow_repair(rows)[0] for conv, rows in by.items()}


def test_repair_of_absent_and_long_conversations(spark):
    gone = spark.createDataFrame([(1, 0, "user", "Hm.", True), (1, 1, "user", "Hm.", True), (2, None, None, None, True)], "conv_id long, turn long, role string, text string, away boolean")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in conversations.audited(gone, absent="away").collect()) == [(k, 0, 0, 0, 0, 0, 0, "", empty) for k in (1, 2)]
    assert conversations.repair(gone, absent="away").count() == 0
    n = 20_000
    long = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('Row ', id, '.') AS text")
    [r] = conversations.audited(long).collect()
    said = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:Row {i}." for i in range(n))
    assert (r.audit, r.cost, r.repaired_sha256) == ("K" * n, 0, hashlib.sha256(said.encode()).hexdigest())
