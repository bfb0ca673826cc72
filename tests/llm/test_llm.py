"""The corpus operators against brute force, round trips and held-out accuracy on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyspark.llm import bpe, components, exact_dedup, language_id, mixing, near_dedup, sharding, substring_dedup, toxicity, url_filter, vp_ann

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, class string, key string"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    full = [(i, t, lang, s, None if t is None else len(t), "x", 7, "c", "k") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    long_text = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "Same Text here", "en", "b"), (5, "same text HERE", "en", None), (6, long_text, "en", "b"), (6, long_text, "en", "b"), (7, long_text + " tail", "fr", "a"), (8, "12 34", None, "a"), (None, "no id at all in this one", "en", "c"), (9, "É à É", "fr", "c"), (9, "other text same id", "fr", "c")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def groups_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    most = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((r.doc_id, most[lower(r.text)], len(groups[lower(r.text)]), r.doc_id == most[lower(r.text)], hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in rows), key=str)


@pytest.mark.parametrize("hot_parts", [2000, 3])  # with 3, hardly a digest of these small tables is looked up in the broadcast
def test_exact_dedup(edge, empty, corpus, hot_parts):
    for df in (edge, corpus, empty):
        rows = df.select("doc_id", "text").collect()
        got = sorted((tuple(r) for r in exact_dedup.annotate(df, hot_parts=hot_parts).collect()), key=str)
        assert got == groups_of(rows)
        left = exact_dedup.deduplicate(df)
        assert left.columns == df.columns
        assert sorted(lower(r.text) for r in left.collect()) == sorted({lower(r.text) for r in rows})
        kept = {(r.doc_id, lower(r.text)) for r in left.collect()}
        most = {(r[0], r[4]) for r in got if r[3]}
        assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept} == most


def test_exact_index_takes_batches(spark, edge, corpus):
    """Annotations after a batch are those of all batches together; a batch appended again changes nothing; deduplication drops what earlier batches have."""
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first, second = corpus.where("doc_id % 3 = 0"), corpus.where("doc_id % 3 <> 0")
    exact_dedup.annotate(first, index=index)
    got = sorted((tuple(r) for r in exact_dedup.annotate(second, index=index, hot_parts=5).collect()), key=str)
    want = [x for x in groups_of(corpus.collect()) if x[0] % 3]
    assert got == want
    digests = edge.select("doc_id", exact_dedup.digest(F.col("text")).alias("digest"))
    before = index.read().count()
    index.append(digests, "late")
    once = sorted(map(str, index.read().collect()))
    index.append(digests, "late")
    assert sorted(map(str, index.read().collect())) == once and len(once) > before
    new = docs(spark, [(90_000, "brand new text", "en", "a"), (90_001, "Brand NEW text", "en", "a")])
    left = exact_dedup.deduplicate(corpus.select("doc_id", "text").unionByName(new.select("doc_id", "text")), index=index)
    assert [r.doc_id for r in left.collect()] == [90_001]
    index.remove()


def test_exact_dedup_reruns(spark, edge, corpus):
    """The same batch three times brings the same rows; so do A, B, A and B again, and of each text one copy stays."""
    for name in (None, "a"):
        index = exact_dedup.DigestIndex(spark, buckets=4)
        one = corpus.where("doc_id % 3 <> 0").select("doc_id", "text")
        two = corpus.where("doc_id % 2 = 0").select("doc_id", "text")
        kept = lambda df, n: sorted(r.doc_id for r in exact_dedup.deduplicate(df, index=index, batch=n).collect())
        first = kept(one, name)
        assert first and kept(one, name) == first == kept(one.repartition(3), name)
        second = kept(two, name and "b")
        assert second and kept(one, name) == first and kept(two, name and "b") == second
        texts = {r.doc_id: lower(r.text) for r in corpus.collect()}
        both = [texts[i] for i in first + second]
        want = {lower(r.text) for df in (one, two) for r in df.collect()}
        assert len(both) == len(set(both)) and set(both) == want
        assert sorted(index.numbers().values()) == [1, 2]
        index.remove()
    with pytest.raises(ValueError, match="name"):
        exact_dedup.DigestIndex(spark, buckets=4).append(edge.select("doc_id", exact_dedup.digest(F.col("text")).alias("digest")), "a b")


def test_exact_index_persists(spark, edge):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    rows = edge.select("doc_id", exact_dedup.digest(F.col("text")).alias("digest"))
    index.append(rows)
    n = index.read().count()
    assert n == rows.select("digest").distinct().count() == index.rows().where("novel").count()
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert again.read().count() == n
    new = spark.createDataFrame([(99, "brand new")], "doc_id long, text string").select("doc_id", exact_dedup.digest(F.col("text")).alias("digest"))
    assert [r.doc_id for r in again.novel(rows.unionByName(new)).collect()] == [99]


@pytest.mark.parametrize(("shards", "part_rows"), [(3, 5), (40, sharding.PART_ROWS)])
def test_sharding(edge, empty, corpus, shards, part_rows):
    for df in (edge, corpus, empty):
        rows = sharding.assign(df, shards, part_rows=part_rows).collect()
        want = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect()), key=str)
        assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == want
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r)
        assert all(0 <= s < shards for s in by)
        total, most = sum(r["size"] for r in rows), max((r["size"] for r in rows), default=0)
        for own in by.values():
            assert sorted(r.slot for r in own) == list(range(len(own)))
            assert sum(r["size"] for r in own) <= total / shards + most
        order = sorted(rows, key=lambda r: r.offset)
        assert [r.shard for r in order] == sorted(r.shard for r in rows)


def test_mixing(edge, empty, corpus):
    import re

    for df in (edge, corpus, empty):
        rows = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(3)).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
        size = {}
        for r in df.collect():
            size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        order = sorted((k for k in size if k is not None)) + [k for k in size if k is None]
        weight, cap = {k: i % 3 + 1 for i, k in enumerate(order)}, {k: 3 * v for k, v in size.items()}
        target, open_, left = {}, set(order), float(sum(size.values()))
        while open_:
            unit = left / sum(weight[k] for k in open_)
            full = {k for k in open_ if cap[k] <= unit * weight[k]}
            if not full:
                target |= {k: unit * weight[k] for k in open_}
                break
            target |= {k: float(cap[k]) for k in full}
            left, open_ = left - sum(cap[k] for k in full), open_ - full
        taken = {}
        for r in rows:
            assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
            assert 0 <= r.taken <= 3 * r["size"]
            taken[r.source] = taken.get(r.source, 0) + r.taken
        assert all(abs(taken[k] - target[k]) <= 1 for k in taken)
        assert mixing.repeated(df).columns == df.columns


@pytest.mark.parametrize(("sizes", "want"), [((100, 200), (100, 200)), ((100, 200, 300), (100, 200, 300)), ((10, 400, 600), (30, 392, 588)), ((100, 200, 300, 100), (100, 200, 300, 100)), ((5, 50, 50), (15, 36, 54))])
def test_mixing_ties(spark, sizes, want):
    """Sources whose size / weight is equal share the level of the first of them."""
    given = spark.createDataFrame([(f"s{i}", n, 1) for i, n in enumerate(sizes)], "source string, source_size long, n long")
    assert [r.target for r in mixing.targets(given).orderBy("source").collect()] == pytest.approx(want)
    words = docs(spark, [(100 * i + k, " ".join(["w"] * (n // 5)), "en", f"s{i}") for i, n in enumerate(sizes) for k in range(5)])
    taken = mixing.mix(words).groupBy("source").agg(F.sum("taken").alias("n")).orderBy("source").collect()
    assert [r.n for r in taken] == list(want) and sum(want) == sum(sizes)


def fits(rule, host, path):
    return (host == rule[1] or host.endswith("." + rule[1])) and path.startswith(rule[2])


def test_url_filter(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "wwwexample.com", "net", "x.net", "example.com.", "EXAMPLE.com", "", "a..com", "com.net", "é.net"]
    paths = ["", "/", "/en", "/en/", "/en/a/b", "/es/1", "/fr/", "/e\U0010ffff", "/en/é"]
    urls = [None, "", "no scheme", "http://", "a://b://c/d"] + [f"http{'s' * rng.randint(0, 1)}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#x', chr(10)])}" for _ in range(300)]
    rules = [*url_filter.RULES, ("block", "a.www.example.com", "/en/a"), ("allow", "com", "/en/a/b"), ("block", "net", "/"), ("allow", "x.net", "/e"), ("block", "é.net", "/"), ("allow", "net", "/"), ("block", "", "/"), ("block", None, "/")]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    given = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, given).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = lower(rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        hits = [r for r in rules if r[1] and host and fits(r, host, path)]
        best = max(hits, key=lambda r: (len(r[1] + r[2]), r[1], r[0])) if hits else None
        assert got[i] == (host, path, best and best[1] + best[2], best[0] if best else "allow"), u
    assert url_filter.judge(pages.where("false"), given).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, given.where("false")).collect()} == {"allow"}


def test_language_id(corpus, edge, empty):
    model = language_id.fit(language_id.learnable(corpus))
    out = language_id.predict(corpus, model).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) >= 0.95
    assert all(0 <= r.score <= 1 for r in out)
    for r in language_id.predict(edge, model).collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(edge, nothing).collect()} == {"und"}
    again = language_id.predict(language_id.predict(edge, model), model)
    assert again.columns == [*edge.columns, "lang_pred", "score", "certainty"]
    assert sorted(map(str, again.collect())) == sorted(map(str, language_id.predict(edge, model).collect()))
    one = language_id.fit(edge.where("lang = 'fr'"))
    assert {(r.lang_pred, r.score) for r in language_id.predict(edge.where("doc_id = 6"), one).collect()} == {("fr", 1.0)}


def test_language_id_knows_every_language(spark):
    """More languages than rows of the sample would give by themselves: each can be predicted, the rarest too."""
    rng = random.Random(14)
    names = [f"x{i:02}" for i in range(60)]
    words = {k: ["".join(rng.choices(rng.sample("abcdefghijklmnopqrstuvwxyz", 7), k=rng.randint(3, 8))) for _ in range(60)] for k in names}
    rows = [(1000 * n + i, " ".join(rng.choices(words[k], k=60)), k, "a") for n, k in enumerate(names) for i in range(6 + 40 * (n % 3 == 0))]
    df = docs(spark, rows)
    model = language_id.fit(language_id.learnable(df), sample=100)
    assert 2 <= len(model.families.classes) <= 8 and sum(len(m.classes) for m in model.inside.values()) == 60
    out = language_id.predict(df, model).collect()
    assert {r.lang_pred for r in out} == set(names) and np.mean([r.lang == r.lang_pred for r in out]) >= 0.95


def test_bpe_equals_library(spark, corpus, edge, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    lib = tokenizers.Tokenizer.from_file(path)
    odd = [(1, "Hello wörld it's 42!!  a\xa0b", None, None), (2, "x <|endoftext|>y I'LL İstanbul <|ENDOFTEXT|>", None, None), (3, "ΑΣ ΑΣΑ 日本語 \x00\x1c\x85 =====----!!??", None, None), (4, "ab" * 5000, None, None)]
    for df in (corpus, edge, docs(spark, odd)):
        got = sorted((tuple(r) for r in bpe.round_trip(df, path).collect()), key=str)
        want = []
        for r in df.collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
        assert got == sorted(want, key=str)
    ids = bpe.encode(docs(spark, odd), path)
    back = {r.doc_id: r.text for r in bpe.decode(ids, path).collect()}
    assert back == {i: lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t, _, _ in odd}
    assert bpe.round_trip(empty, path).count() == 0


def test_bpe_every_code_point():
    """Every character by itself, beside a letter and doubled, is what the library makes of it; other files are refused."""
    import json

    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    lib = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    t = bpe.tokenizer(spec)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [" ".join(f"a{chr(i)}b {chr(i)}{chr(i)}1" for i in points[at : at + 64]) for at in range(0, len(points), 64)]
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        assert [t.encode(x) for x in some] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]
    for k in ("normalizer", "pre_tokenizer"):
        with pytest.raises(ValueError, match="otherwise"):
            bpe.Tokenizer(json.dumps(json.loads(spec) | {k: None}))


def test_bpe_long_words():
    """Words of any length are read once: equal to the library, and 5 MB in seconds."""
    import time

    tokenizers = pytest.importorskip("tokenizers")
    path, rng = bpe.default_path(), random.Random(11)
    lib = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        t = bpe.tokenizer(f.read())
    texts = ["".join(rng.choices("abcdefghijé日ß", k=n)) for n in (1, 2, 30, 3000, 200_000)] + ["a" * 50_000, "the" * 30_000, "=-" * 20_000]
    texts += ["".join(rng.choices("aeinstr", k=rng.randint(1, 40))) for _ in range(2000)]
    for x in texts:
        assert t.encode(x) == lib.encode(x, add_special_tokens=False).ids
    start = time.time()
    assert t.decode(t.encode("".join(rng.choices("etaoinshr", k=5_000_000)))).replace(" ", "").endswith("</w>")
    assert time.time() - start < 60


def test_bpe_table_is_the_gadgets():
    """The table has the arcs that the merges, applied one by one to an automaton written out in full, leave."""
    import json

    rng = random.Random(12)
    base = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    vocab, merges = list(base), []
    for _ in range(60):
        u = rng.choice([x for x in vocab if not x.endswith("</w>")])
        v = rng.choice(vocab)
        if u + v not in vocab and len(u + v) < 14:
            vocab.append(u + v)
            merges.append([u, v])
    ids = {s: i for i, s in enumerate(vocab)}
    arcs = {0: set(base)}
    for s in base:
        arcs[s] = set() if s.endswith("</w>") else set(base)
    for u, v in merges:
        if u in arcs and v in arcs[u]:
            arcs[u + v] = set(arcs[v])
            arcs[u].remove(v)
            for out in arcs.values():
                if u in out:
                    out.add(u + v)
    a = bpe.Automaton(ids, merges)
    place = {x[0]: x[1:] for x in [*a.inner, *a.final] if x is not None}
    for s, out in arcs.items():
        if s != 0 and not s.endswith("</w>"):
            got = {a.labels[t] for t, (part, at) in place.items() if not a.cells[a.page[a.row[ids[s]] + part] + at]}
            assert got == set(out), (s, json.dumps(merges))


def test_toxicity(spark, sf, edge, empty):
    rng = random.Random(5)
    words, bad = [f"w{i}" for i in range(60)], ["idiotic", "idiots", "idiotism", "scummy"]
    rows, labels = [], []
    for i in range(600):
        s = [" ".join(rng.choices(words, k=8)) + "." for _ in range(rng.randint(1, 6))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(s))
            s[at] = s[at][:-1] + " " + rng.choice(bad) + "."
        rows.append((i, " ".join(s), "en", "a"))
        labels.append((i, int(toxic), "t"))
    table, given = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    held = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(table, given.where(~held("doc_id")))
    out = toxicity.judge(table, model).where(held("doc_id")).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in out]) >= 0.97
    text = {i: t for i, t, _, _ in rows}
    found = [text[r.doc_id][s.start : s.end] for r in out if r.predicted for s in r.offending]
    assert found and np.mean([any(b in s for b in bad) for s in found]) >= 0.95
    for r in toxicity.judge(edge, model).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert toxicity.judge(empty, model).count() == 0
    assert {r.score for r in toxicity.judge(edge, toxicity.fit(empty, given)).collect()} == {0.0}


def test_toxicity_held_out(spark):
    """Held-out labels of the test documents, and labels that repeat or are null."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    twice = labels.unionByName(labels.where("doc_id % 7 = 0").withColumn("toxic", F.lit(None).cast("int"))).unionByName(labels.where("doc_id % 5 = 0").withColumn("toxic", F.lit(0)))
    model = toxicity.fit(d, twice.where(~held))
    out = toxicity.judge(d.where(held), model).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    toxic = [r for r in out if r.toxic]
    assert len(toxic) >= 50 and np.mean([r.predicted for r in toxic]) >= 0.85  # some labels are wrong: a tenth of these texts holds nothing offensive
    assert np.mean([r.predicted for r in out if not r.toxic]) <= 0.02


def brute_components(rows, percent=75):
    sets = []
    for i, t in rows:
        w = lower(t).split() if t else []
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower(t)).split(" ") if x] if t else []
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if i is not None else None) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(seed=1, families=12):
    rng = random.Random(seed)
    vocabulary, rows = [f"t{i}" for i in range(400)], []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randint(8, 120))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("limit", "most"), [(1000, near_dedup.GROUP_BYTES), (4, near_dedup.GROUP_BYTES), (1000, 16 * 150)])
def test_near_dedup(spark, edge, limit, most):
    rows = near_copies() + [(None, "a b c d e f"), (900, "a b c d e f"), (901, "A b\tc d e\nf"), (902, None), (903, ""), (904, "one"), (905, "one"), (905, "one")]
    df = docs(spark, [(i, t, "en", "a") for i, t in rows])
    got = near_dedup.annotate(df, limit=limit, most=most).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute_components(rows), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_templates(spark):
    """Pages of one template, half alike, and some copies of them: branching takes the template apart, and the copies are found."""
    rng = random.Random(15)
    template = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(template + [f"u{rng.randrange(10**6)}" for _ in range(28)])) for i in range(400)]
    for i in range(0, 400, 8):
        w = rows[i][1].split()
        w[70] = "changed"
        rows.append((1000 + i, " ".join(w)))
    got = near_dedup.annotate(docs(spark, [(i, t, "en", "a") for i, t in rows]), limit=30).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute_components(rows), key=str)


def exact_links(rows, percent=75):
    """The same as brute_components through the texts' shared shingles; for more rows."""
    sets, at = [], {}
    for k, (_, t) in enumerate(rows):
        w = [x for x in lower(t).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
        for x in sets[-1]:
            at.setdefault(x, []).append(k)
    same = {}
    for group in at.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                same[b, a] = same.get((b, a), 0) + 1
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in same.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("limit", [1000, 25])
def test_near_dedup_recall(spark, limit):
    """Every component of the documents at sf0.01."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.annotate(df, limit=limit).collect()) == exact_links(rows)


def test_near_dedup_edges(edge, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.annotate(edge).collect()}
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[4, 1] == got[5, 1] == 4
    assert near_dedup.annotate(empty).count() == 0
    assert near_dedup.deduplicate(edge).columns == edge.columns


def test_near_dedup_repeated_ids(spark):
    """An id with two texts goes only if neither stays; repeated rows of the document that stays are kept."""
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (5, "A b c d e f"), (5, "quite another text than that one here"), (6, "a b c d e f"), (None, "a b c d e f")]
    got = near_dedup.deduplicate(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t) for i, t in rows if i != 6)


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"{a:03}", f"{b:03}") for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(150))] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[find(a)] = find(b)
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}
    same = {}
    for n, root in got.items():
        same.setdefault(root, set()).add(find(n))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({find(n) for n in got})


def true_neighbours(rows, k=5):
    """Brute force; rows: (id, vector)."""
    good = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            out[i] = sorted((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j) for j, w in good if j != i and len(w) == len(v))[:k]
    return out


def found_neighbours(df, **options):
    got = {}
    for r in vp_ann.neighbours(df, **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(own) for q, own in got.items()}


@pytest.mark.parametrize(("factor", "shard", "leaf", "top", "least"), [(1.0, 40, 16, 64, 1.0), (1.0, 20, 8, 2, 1.0), (1.0, 10_000, 512, 64, 1.0), (2.5, 10_000, 512, 64, 1.0), (2.5, 60, 16, 2, 0.9)])
def test_vp_ann(spark, factor, shard, leaf, top, least):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) + 2 * rng.integers(0, 4, size=(300, 1))
    rows = [(i, [float(v) for v in x[i if i % 7 else 0]]) for i in range(300)]  # a hot vector's copies
    rows += [(300, None), (350, []), (400, [0.0] * 8), (450, [float("nan")] * 8), (500, [None] * 8), (550, [1.0, 2.0]), (551, [2.0, 1.0]), (None, [1.0] * 8)]
    rows += [(600, [float(1e200 * v) for v in x[3]]), (601, [float(1e-200 * v) for v in x[5]])]
    df = spark.createDataFrame([(i, v, 1, 0.5, 2) for i, v in rows], "vec_id long, embedding array<double>, cell int, score double, dim int")
    got, want = found_neighbours(df, factor=factor, shard=shard, leaf=leaf, top=top), true_neighbours(rows)
    assert set(got) == set(want)
    hits = total = 0
    for i, near in want.items():
        own = got[i]
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and len(own) == len(near)
        hits += len({j for _, j in near} & {j for _, j, _ in own})
        total += len(near)
        if least == 1:
            assert [(j, pytest.approx(-s, abs=1e-12)) for s, j in near] == [(j, s) for _, j, s in own]
    assert hits >= least * total
    assert vp_ann.neighbours(df.where("false")).count() == 0


def test_vp_ann_repeated_ids(spark):
    """Rows that share an id: each is a candidate, none is its own query's, and the queries of one id are one."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, -1.0])]
    got = found_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert [(r, j) for r, j, _ in got[50]] == [(1, 1), (2, 1), (3, 2), (4, 1), (5, 1)]


@pytest.mark.parametrize(("sf_dir", "shard"), [("sf0.1", vp_ann.SHARD), ("sf0.1", 150)])
def test_vp_ann_recall(spark, sf_dir, shard):
    """At least 0.9 of the true neighbours of the test vectors, with many cells too."""
    df = spark.read.parquet(f"/root/testdata/{sf_dir}/embeddings.parquet")
    want = true_neighbours([(r.vec_id, r.embedding) for r in df.collect()])
    got = found_neighbours(df, shard=shard, leaf=vp_ann.LEAF if shard == vp_ann.SHARD else 32, top=4)
    assert sum(len({j for _, j in near} & {j for _, j, _ in got[i]}) for i, near in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_substring_dedup(spark, edge, empty):
    rng = random.Random(6)
    fresh = lambda k: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(k))
    shared = [fresh(60) for _ in range(5)]
    rows, planted = [], {}
    for i in range(60):
        t = fresh(rng.randint(5, 200))
        if i % 3 == 0:
            p = shared[i // 3 % 5]
            t, planted[i] = f"{fresh(rng.randint(0, 40))} {p} {t}", p
        rows.append((i, t, "en", "a"))
    df = docs(spark, rows)
    found = substring_dedup.passages(df).collect()
    assert {r.doc_id for r in found} == set(planted)
    text = {i: t for i, t, _, _ in rows}
    for r in found:
        raw = text[r.doc_id].encode()
        assert raw[r.start : r.end].decode().strip() in planted[r.doc_id] or len(raw[r.start : r.end]) <= len(planted[r.doc_id]) + 2
        assert r.kept == (r.doc_id == r.first_doc_id)
    left = {r.doc_id: r.text for r in substring_dedup.removed(df).collect()}
    assert all(left[i] == text[i] for i in text if i not in planted)
    assert all(len(left[i]) < len(text[i]) for i in planted if i >= 15) and all(left[i] == text[i] for i in (0, 3, 6, 9, 12))
    assert {r.doc_id for r in substring_dedup.passages(edge).collect()} == {6, 7}
    assert substring_dedup.passages(empty).count() == 0
    assert substring_dedup.removed(edge).columns == edge.columns


def test_substring_dedup_keeps_one_copy(spark):
    """Copies of a text that also holds an older document's passage or one frequent chunk: the first copy stays, the others go."""
    rng = random.Random(8)
    fresh = lambda k: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(k))
    old, a, b, c = fresh(60), fresh(80), fresh(80), fresh(120)
    raw, ends = c.encode(), substring_dedup.boundaries(np.frombuffer(c.encode(), np.uint8))
    k = min(range(3, len(ends) - 3), key=lambda i: ends[i + 1] - ends[i - 1])
    piece = raw[ends[k - 1] : ends[k + 1]].decode()
    assert len(piece.split()) < substring_dedup.WORDS  # two whole chunks, no passage by themselves
    texts = {1: f"{fresh(40)} {old} {fresh(40)}", 2: f"{fresh(40)} {piece} {fresh(40)}", 5: f"{a} {old} {b}", 6: c, 9: f"{a} {old} {b}", 10: c, 12: f"{a} {old} {b}"}
    df = docs(spark, [(i, t, "en", "a") for i, t in texts.items()])
    left = {r.doc_id: r.text for r in substring_dedup.removed(df).collect()}
    for t in texts.values():
        data = t.encode()
        for s, e in zip(*[x.tolist() for x in substring_dedup.chunks(t)[1:3]], strict=True):
            assert any(data[s:e] in x.encode() for x in left.values())
    assert left[1] == texts[1] and left[2] == texts[2] and left[6] == c
    assert a[:-100] in left[5] and b[100:] in left[5] and old[100:-100] not in left[5]
    assert all(len(left[i]) < 0.05 * len(texts[i]) + 100 for i in (9, 10, 12))
    found = substring_dedup.passages(df).collect()
    assert all(r.kept == (r.doc_id == r.first_doc_id) for r in found)
    assert {(r.doc_id, r.kept) for r in found} == {(1, True), (5, True), (5, False), (6, True), (6, False), (9, False), (10, False), (12, False)}


def slow_chunks(raw):
    """Chunks byte by byte: the hash of the last eight bytes, each shifted by two bits more than the next."""
    out, start = [], 0
    for i in range(len(raw)):
        h = sum(int(substring_dedup.GEAR[raw[i - k]]) << (2 * k) for k in range(min(8, i + 1))) & 0xFFFF
        size = i + 1 - start
        if size == substring_dedup.MOST and i + 1 < len(raw) or h >> (16 - substring_dedup.BITS) == 0 and size >= substring_dedup.LEAST or i + 1 == len(raw):
            out.append((start, i + 1))
            start = i + 1
    return out


def test_substring_dedup_equals_brute_force(spark, corpus, edge):
    """Every stretch of the test documents, from chunks found byte by byte and digests compared in a dictionary."""
    for df in (corpus, edge.where("length(text) < 1000")):
        texts = sorted({(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if r.doc_id is not None and r.text})
        parts = {t: [(a, b, t.encode()[a:b]) for a, b in slow_chunks(t.encode())] for _, t in texts}
        owners = {}
        for i, t in texts:
            for _, _, c in parts[t]:
                owners.setdefault(c, set()).add(i)
        want = []
        for i, t in texts:
            raw, run = t.encode(), []

            def close(run, i=i, raw=raw):
                starts = [k for k in range(len(raw)) if raw[k] not in b" \t\n\v\f\r" and (k == 0 or raw[k - 1] in b" \t\n\v\f\r")]
                words = lambda a, b: sum(a <= k < b for k in starts)
                if run and words(run[0][0], run[-1][1]) >= substring_dedup.WORDS:
                    at = 0
                    while at < len(run):
                        to = at
                        while to < len(run) and (run[to][2] == i) == (run[at][2] == i):
                            to += 1
                        a, b = run[at][0], run[to - 1][1]
                        want.append((i, a, b, words(a, b), to - at, min(x[2] for x in run[at:to]), run[at][2] == i))
                        at = to

            for a, b, c in parts[t]:
                if len(owners[c]) > 1:
                    run.append((a, b, min(owners[c])))
                else:
                    close(run)
                    run = []
            close(run)
        got = [(r.doc_id, r.start, r.end, r.words, r.chunks, r.first_doc_id, r.kept) for r in substring_dedup.passages(df).collect()]
        assert sorted(got) == sorted(want) and (df is not corpus or len(got) > 20)


def test_chunks_resist_insertions():
    rng = random.Random(7)
    t = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(2000))
    a, b = set(substring_dedup.chunks(t)[0]), set(substring_dedup.chunks("x" * 13 + t[:500] + "inserted" + t[500:])[0])
    assert len(a - b) <= 6
    raw = t.encode()
    ends = substring_dedup.boundaries(np.frombuffer(raw, np.uint8))
    assert ends[-1] == len(raw) and all(substring_dedup.LEAST <= y - x <= substring_dedup.MOST for x, y in zip([0, *ends[:-2]], ends[:-1], strict=False))


def test_pipeline_keeps_many_languages(spark):
    """Ten families, one of them of four languages: the score of a certain prediction is low, and no document goes for that."""
    import corpus_pipeline

    rng = random.Random(9)
    langs = "en de nl sv fr ru lt fi tr hi ta ar ga".split()
    words = {k: ["".join(rng.choices(rng.sample("abcdefghijklmnopqrstuvwxyz", 9), k=rng.randint(2, 8))) for _ in range(150)] for k in langs}
    rows = [(40 * n + i, " ".join(rng.choices(words[k], k=(8, 30, 120)[i % 3])), k, "a") for n, k in enumerate(langs) for i in range(40)]
    df = docs(spark, [*rows, (9000, "12 34 !!", None, "a"), (9001, None, None, "a")])
    model = language_id.fit(language_id.learnable(df))
    assert len(model.families.classes) >= 8
    out = language_id.predict(df.where("doc_id < 9000"), model).collect()
    assert max(r.score for r in out) < 0.3 and min(r.certainty for r in out) >= 0.25 and np.mean([r.lang == r.lang_pred for r in out]) >= 0.95
    want = {i for i, _, _, _ in rows}
    kept = corpus_pipeline.identify(spark, df, "").collect()
    assert {r.doc_id for r in kept} == want
    predicted = {r.doc_id: r.lang_pred for r in out}
    assert all(r.lang == predicted[r.doc_id] for r in kept)
    mislabelled = corpus_pipeline.identify(spark, df.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("lang"))), "").where("doc_id % 3 = 0").collect()
    assert np.mean([r.lang == langs[r.doc_id // 40] for r in mislabelled]) >= 0.8  # unseen texts, a third of them of eight words
    assert {r.doc_id for r in corpus_pipeline.identify(spark, df.withColumn("lang", F.lit(None).cast("string")), "").collect()} == want


def test_pipeline(spark, sf):
    import corpus_pipeline

    steps, d = {}, spark.read.parquet(f"{sf}/documents.parquet")
    before = d.count()
    for name, f in corpus_pipeline.STAGES:
        d = f(spark, d, sf).persist()
        steps[name] = d.count()
        if name != "BPE":
            assert d.columns == list(corpus_pipeline.COLUMNS)
        if name == "exact dedup":
            assert d.select(F.lower("text")).distinct().count() >= steps[name] - 1
    assert steps["language ID"] >= 0.95 * before and steps["exact dedup"] < steps["language ID"]
    assert steps["MinHash near-dedup"] <= steps["exact dedup"]
    assert corpus_pipeline.run(spark, sf).count() == steps["BPE"]


def test_pipeline_edges(spark, edge, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, and an empty table through all stages."""
    import corpus_pipeline

    for name, df in (("edge", edge), ("none", empty)):
        df.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "source", "ids", "n_tokens"]
        rows = out.collect()
        assert all(r.n_tokens == len(r.ids) > 0 for r in rows)
        assert {r.doc_id for r in rows} <= {r.doc_id for r in edge.collect()}
        if name == "none":
            assert not rows
