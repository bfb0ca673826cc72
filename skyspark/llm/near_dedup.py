"""Near-duplicate documents by chosen-path set similarity join.

A document's set is its distinct word shingles; documents with equal sets are one class and are joined
once. A class is known by minwise values, one of each of ``WIDTH`` random orders. From the root
of each tree a class branches along chosen coordinates: each is chosen with probability
1 / (BRANCH * similarity * WIDTH) by a hash of the node, and classes with the same value there share the child. Nodes of
at most ``LIMIT`` classes are compared exhaustively; larger ones branch again, for as long as that makes them smaller.
Independent trees repeat this until a pair at the threshold is missed with negligible probability.

A pair at the threshold shares 1 / BRANCH children on average. That is more than 1, so a pair that links shares
nodes at every depth with a probability that doesn't fall to 0 (0.74 after the first branch, at least 0.48 after any
number), and pairs of less than BRANCH times the threshold come apart. A pair at the threshold is missed by all ``TREES`` with probability below 1e-9 where the first
branch suffices and about 2e-4 at any depth (over what its ``WIDTH`` minwise values can be, which all trees share).

Of two classes of a node with similarity s, both are in s / (BRANCH * threshold) of its children on average. A large node in which that is 1 or more
in the mean (over a hash sample of about ``PROBE`` classes), or one of more than ``TIGHT`` of its parent's classes, doesn't come apart by branching, as its classes
are close copies of each other; it is handled exactly instead: in the first round of trees in blocks that share a few pivots, which joins close copies into one component;
in the second, what isn't in a node's main component is compared with the whole node, in blocks (a pair that only the
second round's trees reach there is missed with probability of about 1e-3).

In a node, minwise values pick candidate pairs (estimates down to ``SLACK`` below the threshold, over five
standard deviations: one pair in 10 million at the threshold falls short), most similar first; each is confirmed on the full sets unless its ends are connected
already. So a group of n copies costs about n confirmations. Full sets are compared in groups of at most about ``GROUP_BYTES``: a node with more, such as one of
very long texts, is dealt in blocks, and every pair of blocks is a group. Equal nodes of different trees are compared
once, and the second round of trees looks only at pairs that the first left apart. Links go
through distributed connected components; neither links nor sets are collected.

Defined results: null texts and texts without words have the empty set, link to nothing and are kept; with fewer
words than a shingle has, the whole sequence is the only one; rows with null doc_id are kept, with null component,
and link to nothing; repeated rows are one class, and each of those with the smallest doc_id is kept (dropping
repeated rows is exact deduplication's); the empty table gives no rows; texts of any length are shingled whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyspark.llm import common as C
from skyspark.llm.components import components

#: Minwise values of a class.
WIDTH = 128
#: Classes that are compared exhaustively at most.
LIMIT = 1000
#: 1 / (BRANCH * threshold) coordinates are chosen on average: pairs less similar than BRANCH * threshold come apart with depth.
BRANCH = 0.733
#: A node with more than this share of its parent's classes doesn't get smaller by branching.
TIGHT = 0.8
#: Classes that tell whether a large node's classes are alike, about.
PROBE = 48
#: Trees of the two rounds.
TREES = (4, 12)
#: How far an estimate may be below the threshold.
SLACK = 0.2
#: Bytes of full sets that are compared in one group, about; a single set may be larger.
GROUP_BYTES = 64 << 20
PIVOTS = 8
MIX = np.uint64(0x9E3779B97F4A7C15)


def _orders() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, WIDTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, WIDTH, dtype=np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTES = np.random.default_rng(20240302).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at a time; a piece ends at white space.
PIECE = 1 << 20
_gap = re.compile(rb"[\x09-\x0d ]")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """MIX ** k and its inverse, modulo 2 ** 64, for k below n."""
    if n > len(_powers[0]):
        size = max(n, 1 << 16)
        for k, m in enumerate((int(MIX), pow(int(MIX), -1, 1 << 64))):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: a polynomial over its UTF-8 bytes, all words of a piece at once."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""  # bytes know no other letters and white space than ASCII's
    out, at = [], 0
    while at < len(raw):
        cut = _gap.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        d = np.frombuffer(raw, np.uint8, end - at, at)
        space = (d == 32) | ((d >= 9) & (d <= 13))
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        first, last = edge[::2], edge[1::2]
        p, inverse = powers(len(d) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[d] * p[: len(d)], dtype=np.uint64)])
        out.append(mixed((total[last] - total[first]) * inverse[first]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    last = len(w) - n + 1
    h = w[:last] + np.uint64(n)
    for k in range(1, n):
        h *= MIX
        h += w[k : last + k]
    h = mixed(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def minwise(s: np.ndarray) -> np.ndarray:
    """The least value of the set in each order; orders are multiplications of the hashes' upper halves by odd numbers, modulo 2 ** 32."""
    a, b = _orders_kept
    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (x[at : at + 256] * a + b).min(0), out=out)
    return out


_orders_kept = _orders()


def children(keys: np.ndarray, share: float) -> np.ndarray:
    """Which coordinates each node chooses: a row of WIDTH booleans per key."""
    h = mixed(keys[:, None] * MIX + np.arange(1, WIDTH + 1, dtype=np.uint64)) >> np.uint64(32)
    return h < np.uint64(int((1 << 32) / (share * WIDTH)))


def branch(keys: np.ndarray, sigs: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key of the child) of every branch that the classes take from their nodes."""
    row, at = np.nonzero(children(keys, share))
    return row, mixed(mixed(keys[row] * MIX + at.astype(np.uint64)) + sigs[row, at].astype(np.uint64) * MIX).view(np.int64)


class Union:
    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, i: int) -> int:
        of = self.of
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        self.of[j] = i


def likely(sigs: np.ndarray, sizes: np.ndarray, root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, estimate) of the pairs that may link and whose roots differ."""
    out = [[], [], []]
    for i in range(len(sigs) - 1):
        rest = sizes[i + 1 :]
        ok = np.flatnonzero((np.minimum(rest, sizes[i]) >= similarity * np.maximum(rest, sizes[i]) - 1e-9) & (root[i + 1 :] != root[i])) + i + 1
        if not len(ok):
            continue
        est = (sigs[ok] == sigs[i]).mean(1)
        hit = est >= similarity - SLACK
        if hit.any():
            out[0].append(np.full(hit.sum(), i))
            out[1].append(ok[hit])
            out[2].append(est[hit])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    same = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def profiles(docs: DataFrame, text: str, doc_id: str, size: int) -> DataFrame:
    """(doc_id, n_shingles, class, sig) of every row; class and sig are null without words."""

    def run(batches):
        for b in C.slices(batches):
            n, cls, sig = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "class", "sig"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, class binary, sig binary")


def sets_of(docs: DataFrame, text: str, doc_id: str, size: int, wanted: DataFrame) -> DataFrame:
    """(class, set) of the wanted (class, doc_id); a class's set is made from the text of its smallest doc_id."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id").select("class", "text")

    def run(batches):
        for b in C.slices(batches):
            keep, sets = [], []
            for c, t in zip(b.column(0), b.column(1), strict=True):
                s = shingles(t.as_py(), size).tobytes()
                if xxhash.xxh3_128_digest(s) == c.as_py():  # else another row with a repeated id
                    keep.append(c.as_py())
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(sets, pa.binary())], ["class", "set"])

    return given.mapInArrow(run, "class binary, set binary").dropDuplicates(["class"])


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, WIDTH)


def rooted(column) -> np.ndarray:
    return np.unique(np.array([bytes(x) for x in column.to_pylist()], object), return_inverse=True)[1]


def distinct_groups(rows: DataFrame) -> DataFrame:
    """rows (node, class) without the nodes that hold the same classes as another one."""
    h = F.xxhash64("class")
    about = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.min("class").alias("low"))
    first = about.where("n > 1").groupBy("n", "x", "s", "low").agg(F.min("node").alias("node")).select("node")
    return rows.join(first, "node", "left_semi")


class Join:
    """The similarity join over the classes of one table."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str, size: int, percent: int, limit: int = LIMIT, most: int = GROUP_BYTES):
        self.docs, self.text, self.doc_id, self.size, self.percent, self.limit, self.most = docs, text, doc_id, size, percent, limit, most
        self.similarity = percent / 100
        self.held = C.Scratch()
        self.rows = self.held.stored(profiles(docs, text, doc_id, size), "profiles")
        some = self.rows.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
        self.classes = self.held.stored(some.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")

    def nodes(self, trees: range) -> tuple[DataFrame, DataFrame | None]:
        """(node, class) of the nodes to compare exhaustively, and of those that are too large and tight."""
        seeds = mixed(np.array([*trees], np.uint64) + np.uint64(977))

        def plant(batches):
            for b in C.slices(batches, 1000):
                sigs, ids = _sigs(b.column(1)), b.column(0)
                for seed in seeds:
                    row, key = branch(np.full(len(sigs), seed), sigs, share)
                    yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(row)), pa.array(np.full(len(key), total))], ["node", "class", "above"])

        def grow(batches):
            for b in C.slices(batches, 1000):
                row, key = branch(b.column(0).to_numpy().view(np.uint64), _sigs(b.column(3)), share)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(1).take(at), b.column(2).take(at)], ["node", "class", "above"])

        def alike(t: pa.Table) -> pa.Table:
            sigs = _sigs(t["sig"])
            same = sum(int((sigs[i + 1 :] == sigs[i]).sum()) for i in range(len(sigs) - 1))
            return pa.table({"node": pa.array([t["node"][0].as_py()], pa.int64()), "alike": pa.array([same / (WIDTH * max(1, len(sigs) * (len(sigs) - 1) // 2))])})

        total, share, schema = self.classes.count(), self.similarity * BRANCH, "node long, class binary, above long"
        level = self.classes.select("class", "sig").mapInArrow(plant, schema)
        small, tight = [], []
        while True:
            # The first level is cheaper to make again than to write.
            level = self.held.stored(level, "nodes") if small else level
            sizes = self.held.stored(level.groupBy("node").agg(F.count("*").alias("count"), F.first("above").alias("above")).where("count > 1"), "sizes")
            fits = F.col("count") <= self.limit
            small.append(self.held.stored(level.join(sizes.where(fits).select("node"), "node").select("node", "class"), "small"))
            large = sizes.where(~fits)
            if large.isEmpty():
                break
            large = self.held.stored(level.select("node", "class").join(large, "node"), "large")
            probes = large.where(F.pmod(F.xxhash64("class", F.lit(4)), F.ceil(F.col("count") / PROBE)) == 0).select("node", "class").join(self.classes.select("class", "sig"), "class")
            found = probes.select("node", "sig").groupBy("node").applyInArrow(alike, "node long, alike double")
            verdict = (F.col("count") > F.col("above") * TIGHT) | (F.coalesce("alike", F.lit(0.0)) >= share)
            big = self.held.stored(sizes.where(~fits).join(found, "node", "left").select("node", verdict.alias("tight")), "big")
            large = self.held.stored(large.select("node", "class", "count").join(big, "node"), "judged")
            tight.append(large.where("tight").select("node", "class"))
            if big.where("NOT tight").isEmpty():
                break
            level = large.where("NOT tight").join(self.classes.select("class", "sig"), "class").select("node", "class", F.col("count").alias("above"), "sig").mapInArrow(grow, schema)
        out, rest = small[0], tight[0] if tight else None
        for x in small[1:]:
            out = out.unionByName(x)
        for x in tight[1:]:
            rest = rest.unionByName(x)
        return self.held.stored(distinct_groups(out), "groups"), None if rest is None else self.held.stored(rest, "tight-nodes")

    def by_bytes(self, groups: DataFrame) -> DataFrame:
        """(node, class) so that no group's full sets have much more than ``most`` bytes together: blocks of half of that, and a group for every two blocks."""
        run = Window.partitionBy("node").orderBy("class")
        held = groups.join(self.classes.select("class", "n"), "class").withColumn("block", F.floor((F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1) / max(1, self.most // 16)))
        held = held.withColumn("blocks", F.max("block").over(Window.partitionBy("node")) + 1)
        one = held.where("blocks = 1").select("node", "class")
        # Running sums skip numbers where a set is larger than a block; groups of one class go.
        two = held.where("blocks > 1").withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).where("other <> block").select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "class")
        return one.unionByName(two)

    def confirm(self, groups: DataFrame, roots: DataFrame | None) -> DataFrame:
        """The links inside groups (node, class), as many as connect what is linked; with roots, only those between components."""
        similarity, percent = self.similarity, self.percent

        def with_roots(rows: DataFrame) -> DataFrame:
            if roots is None:
                return rows.withColumn("root", F.col("class"))
            return rows.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))

        def parts(t: pa.Table) -> pa.Table:
            """The parts of a node that candidate pairs connect."""
            i, j, _ = likely(_sigs(t["sig"]), t["n"].to_numpy(), rooted(t["root"]), similarity)
            u = Union(t.num_rows)
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                u.join(a, b)
            at = np.unique(np.concatenate([i, j])) if len(i) else np.zeros(0, np.int64)
            lead = np.array([u.find(int(k)) for k in at], np.int64)
            key = mixed(np.uint64(t["node"][0].as_py() & 0xFFFFFFFFFFFFFFFF) * np.ones(len(at), np.uint64) + mixed(lead.astype(np.uint64) + np.uint64(1))).view(np.int64)
            return pa.table({"node": pa.array(key, pa.int64()), "class": t["class"].combine_chunks().take(pa.array(at))})

        narrow = with_roots(groups).join(self.classes.select("class", "n", "sig"), "class")
        tight = self.held.stored(narrow.groupBy("node").applyInArrow(parts, "node long, class binary"), "parts")
        tight = self.held.stored(distinct_groups(self.by_bytes(tight)), "tight")
        wanted = tight.select("class").distinct().join(self.classes.select("class", "doc_id"), "class")
        sets = sets_of(self.docs, self.text, self.doc_id, self.size, wanted).join(self.classes.select("class", "n", "sig"), "class")

        def links(t: pa.Table) -> pa.Table:
            i, j, est = likely(_sigs(t["sig"]), t["n"].to_numpy(), rooted(t["root"]), similarity)
            own = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
            u, root = Union(t.num_rows), rooted(t["root"])
            first: dict[int, int] = {}
            for k, r in enumerate(root.tolist()):  # what an earlier round connected is connected
                u.join(k, first.setdefault(r, k))
            order = np.lexsort((j, i, -est))
            for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                if u.find(a) != u.find(b) and linked(own[a], own[b], percent):
                    u.join(a, b)
            lead = np.array([u.find(k) for k in range(t.num_rows)])
            at = np.flatnonzero(lead != np.arange(t.num_rows))
            names = t["class"].combine_chunks()
            return pa.table({"u": names.take(pa.array(at)), "v": names.take(pa.array(lead[at]))})

        full = with_roots(tight).join(sets, "class")
        return self.held.stored(full.groupBy("node").applyInArrow(links, "u binary, v binary").distinct(), "links")

    def blocks(self, large: DataFrame) -> DataFrame:
        """Groups of at most about ``limit`` classes of each large node, all with the node's pivots."""
        order = F.xxhash64("class")
        n = large.groupBy("node").agg(F.ceil(F.count("*") / self.limit).alias("blocks"), F.min_by("class", order).alias("p"))
        held = large.join(n, "node")
        pivots = held.where(F.pmod(order, F.greatest(F.lit(1), F.col("blocks") * self.limit / PIVOTS).cast("long")) == 0).select("node", "class", "blocks").unionByName(n.select("node", F.col("p").alias("class"), "blocks"))
        out = held.select("node", "class", F.pmod(F.xxhash64("class", F.lit(1)), "blocks").alias("b")).unionByName(pivots.distinct().select("node", "class", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("b")))
        return out.select(F.xxhash64("node", "b").alias("node"), "class").distinct()

    def rest(self, large: DataFrame, roots: DataFrame) -> DataFrame:
        """Groups that hold every pair of classes of a large node that lie in different components."""
        half = max(1, self.limit // 2)
        rooted_rows = large.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        sizes = rooted_rows.groupBy("node", "root").count()
        main = sizes.groupBy("node").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
        main = main.where("all > most").withColumn("wide", F.ceil(F.col("all") / half)).withColumn("few", F.ceil((F.col("all") - F.col("most")) / half))
        rows = rooted_rows.join(main, "node")
        wide = rows.withColumn("i", F.pmod(F.xxhash64("class", F.lit(2)), "wide")).withColumn("j", F.explode(F.expr("sequence(0L, few - 1)")))
        few = rows.where("root <> main").withColumn("j", F.pmod(F.xxhash64("class", F.lit(3)), "few")).withColumn("i", F.explode(F.expr("sequence(0L, wide - 1)")))
        return wide.unionByName(few).select(F.xxhash64("node", "i", "j").alias("node"), "class").distinct()

    def run(self) -> DataFrame:
        """(class, root) of the classes that have links."""
        first, second = TREES
        groups, large = self.nodes(range(first))
        links = self.confirm(groups if large is None else groups.unionByName(self.held.stored(self.blocks(large), "blocks")), None)
        roots = components(links)
        self.held.clear(self.rows, self.classes)
        groups, large = self.nodes(range(first, first + second))
        links = self.confirm(groups if large is None else groups.unionByName(self.held.stored(self.rest(large, roots), "rest")), roots)
        # What the first round joined enters the last as one star each.
        out = components(links.unionByName(roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))))
        self.held.clear(self.rows, self.classes)
        C.forget(roots)
        return out


def annotate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 75, limit: int = LIMIT, most: int = GROUP_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, and class (hex; null without words)."""
    j = Join(docs, text, doc_id, size, percent, limit, most)
    roots = j.run().withColumnRenamed("node", "class")
    named = j.classes.select("class", "doc_id").join(roots, "class")
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    # One row per class; that of a class without links is its own smallest id.
    of = j.classes.select("class", "doc_id").join(roots, "class", "left").join(least, "root", "left").select("class", F.coalesce("least", "doc_id").alias("component_id"))
    out = j.rows.select("doc_id", "n_shingles", "class")
    take = F.col("class").isNotNull() & F.col("doc_id").isNotNull()
    alone = out.where(~take).withColumn("component_id", F.col("doc_id"))
    both = out.where(take).join(of, "class").select("doc_id", "n_shingles", "class", "component_id").unionByName(alone)
    return both.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lower(F.hex("class")).alias("class"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 75) -> DataFrame:
    """docs with one document of each component; rows without words all stay, and so do repeated rows of the document that stays.
    Rows that share an id but not their text go only if none of them stays, so no text is lost by its id."""
    gone = annotate(docs, text, doc_id, size, percent).groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("__any")).where("NOT __any").select("__id")
    return docs.join(gone, F.col(doc_id) == F.col("__id"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every whole text of documents, five words, similarity 0.75."""
    return annotate(C.table(spark, sf_dir, "documents")).drop("class")


#: All pairs that share a shingle, and their components; for tables of some thousand documents.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, i, n, concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o, lead(a, 4) OVER o) AS s FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE i <= n - 4 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS same FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN c x ON x.doc_id = u JOIN c y ON y.doc_id = v WHERE 100 * same >= 75 * (x.n + y.n - same)),
reach(doc_id, other) AS (SELECT u, v FROM e UNION SELECT r.doc_id, e.v FROM reach r JOIN e ON r.other = e.u),
m AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, m.least IS NULL OR d.doc_id <= m.least AS kept FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
