"""Approximate nearest neighbours by vantage-point trees per shard.

Vectors are scaled to length 1, where cosine order is the order of Euclidean distance, a metric. A
routing tree cuts space into cells of about ``SHARD`` vectors, so there are the more cells the more vectors there are. Its top is fitted by
the driver on about ``SAMPLE`` vectors; where more than ``TOP`` cells are wanted, a task for each of the top's cells fits what is below
on a sample of about ``CELL`` vectors of each final cell. The driver gets no more than the tree, at most ``TREE_BYTES``. Beyond that,
and where a cell can't be cut (copies of one vector), a cell's vectors are dealt by a hash of the id
over as many shards as its count needs, so a cell with a third of all rows is many shards of bounded size.
Inside a shard a vantage-point tree is built and searched for all its queries together.

Search runs in two rounds. A query first searches one shard of its own cell, which bounds the distance of its
k-th neighbour; with this bound it goes to every other shard whose cell the triangle inequality can't rule out.
Pruning is relaxed by ``factor``: a branch is left out if its lower bound, times the factor, exceeds the
k-th distance so far. With factor 1 no neighbour is lost; a larger factor visits less. How much can be left out is the data's: on
vectors drawn at random in 64 dimensions, all about equally far apart, no metric tree prunes much, and work per query grows with the number of
vectors; on vectors in clusters or of few degrees of freedom a query visits what is near. Recall at factors 2 and 3, measured on 20,000 vectors of five such kinds
with leaves of ``LEAF``: 0.995 and 0.953 at least.

Queries of a shard are dealt in blocks, each with a copy of the shard, so neither side of a task grows
with the data. A leaf is compared by one matrix product, and what comes near the bound is then
scored: scores are cosines of the original vectors in double precision, summed from the first component to the last, so that equal vectors tie exactly.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, as
queries or candidates; vectors of another dimension than the commonest are compared among themselves; rows with null ids
take no part; of repeated ids each row is a candidate of its own, a query skips all rows of its own
id, and one id that repeats with different vectors is one query that finds the best of all of them; with fewer than k candidates all are returned; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspark.llm import common as C

#: Vectors that the routing tree's top is fitted on, about, and cells that it may have.
SAMPLE, TOP = 4096, 64
#: Rows of a shard and queries of a block, about.
SHARD, BLOCK = 8192, 8192
#: Rows under which a vantage-point tree's node is a leaf; sampled rows of a cell, about.
LEAF, CELL = 512, 64
#: Bytes of the routing tree that are broadcast at most.
TREE_BYTES = 256 << 20
#: How far pruning is relaxed.
FACTOR = 2.5
EPS = 1e-9


class Node:
    __slots__ = ("inside", "outside", "point", "radius", "rows")

    def __init__(self, rows=None, point=None, radius=0.0, inside=None, outside=None):
        self.rows, self.point, self.radius, self.inside, self.outside = rows, point, radius, inside, outside


def build(x: np.ndarray, leaf: int) -> Node:
    """A tree over unit vectors; the vantage point is the vector farthest from the node's first one, the cut the median distance."""
    todo, root = [], Node(rows=np.arange(len(x)))
    todo.append(root)
    while todo:
        node = todo.pop()
        rows = node.rows
        if len(rows) <= leaf:
            continue
        point = x[rows[int(np.argmax(((x[rows] - x[rows[0]]) ** 2).sum(1)))]].copy()
        d = np.sqrt(((x[rows] - point) ** 2).sum(1))
        radius = float(np.median(d))
        near = d <= radius
        if near.all():  # many at one distance, such as copies
            near = d < radius
            radius = float(d[near].max()) if near.any() else 0.0
            if not near.any():
                continue
        node.point, node.radius, node.rows = point, radius, None
        node.inside, node.outside = Node(rows=rows[near]), Node(rows=rows[~near])
        todo += [node.inside, node.outside]
    return root


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows with 1 as largest absolute component, so that no square over- or underflows."""
    return x / np.abs(x).max(1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def summed(x: np.ndarray) -> np.ndarray:
    """Sums of rows, from the first component to the last."""
    return np.cumsum(x, axis=1)[:, -1]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b; both scaled."""
    return summed(a * b) / (np.sqrt(summed(a * a)) * np.sqrt(summed(b * b)))


NOBODY = np.iinfo(np.int64).max


class Best:
    """The k best of each query: scores and ids, best first."""

    def __init__(self, bound: np.ndarray, k: int):
        """bound: a score that the k-th neighbour is known to reach, or -inf."""
        self.score, self.id = np.repeat(bound[:, None], k, 1), np.full((len(bound), k), NOBODY)

    def distance(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the distance of the k-th."""
        s = self.score[q, -1]
        return np.where(np.isneginf(s), np.inf, np.sqrt(np.maximum(0, 2 - 2 * np.maximum(s, -1))) + EPS)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scored candidates: query, score and id of each."""
        k = self.score.shape[1]
        own = np.unique(q)
        who = np.concatenate([np.repeat(own, k), q])
        s, i = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((i, -s, who))
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        kept = order[place < k]
        self.score[own], self.id[own] = s[kept].reshape(-1, k), i[kept].reshape(-1, k)


class Shard:
    """Vectors with their tree, searched for many queries at once."""

    def __init__(self, raw: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.raw, self.ids, self.unit = scaled(raw), ids, unit(raw)
        self.root = build(self.unit, leaf)

    def search(self, raw: np.ndarray, ids: np.ndarray, best: Best, factor: float) -> None:
        """Adds what the shard holds to the queries' best; all queries go down together, the nearer side first."""
        q_unit, q_raw = unit(raw), scaled(raw)
        k = best.score.shape[1]

        def down(node: Node, q: np.ndarray) -> None:
            if not len(q):
                return
            if node.point is None:
                for at in range(0, len(node.rows), 2 * LEAF):  # a leaf of copies can be long
                    own = node.rows[at : at + 2 * LEAF]
                    about = q_unit[q] @ self.unit[own].T
                    about[ids[q][:, None] == self.ids[own][None, :]] = -np.inf
                    least = best.score[q, -1]
                    fresh = np.isneginf(least)
                    if fresh.any() and len(own) > k:
                        least = np.where(fresh, -np.partition(-about, k - 1, axis=1)[:, k - 1], least)
                    r, c = np.nonzero((about >= least[:, None] - EPS) & ~np.isneginf(about))
                    if len(r):
                        best.add(q[r], cosines(q_raw[q[r]], self.raw[own[c]]), self.ids[own[c]])
                return
            d = np.sqrt(((q_unit[q] - node.point) ** 2).sum(1))
            first = d <= node.radius
            down(node.inside, q[first])
            down(node.outside, q[~first])
            again = np.abs(d - node.radius) * factor <= best.distance(q) + EPS
            down(node.outside, q[first & again])
            down(node.inside, q[~first & again])

        down(self.root, np.arange(len(ids)))


class Router:
    """The routing tree; its leaves are numbered cells."""

    def __init__(self, x: np.ndarray, cells: int):
        """x: unit vectors of the sample."""
        self.dim = x.shape[1]
        self.root = build(x, max(CELL, -(-len(x) // max(1, cells)))) if len(x) else Node(rows=np.arange(0))
        self.number()

    def leaves(self) -> list[Node]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.point is None:
                out.append(node)
            else:
                todo += [node.outside, node.inside]
        return out

    def number(self) -> None:
        for i, leaf in enumerate(self.leaves()):
            leaf.rows = i
        self.cells = i + 1

    def branches(self) -> bytes:
        """The tree's radii (below 0: a leaf) and points, in the order of a walk."""
        radii, points, todo = [], [], [self.root]
        while todo:
            node = todo.pop()
            radii.append(-1.0 if node.point is None else node.radius)
            if node.point is not None:
                points.append(node.point)
                todo += [node.outside, node.inside]
        return np.array([len(radii), *radii, *np.concatenate([np.zeros(0), *points])], np.float64).tobytes()

    def graft(self, subtrees: dict[int, bytes]) -> None:
        """Puts the subtree of each cell in its place, and numbers the cells anew."""
        for leaf in self.leaves():
            if leaf.rows in subtrees:
                raw = np.frombuffer(subtrees[leaf.rows], np.float64)
                radii, points = iter(raw[1 : 1 + int(raw[0])]), iter(raw[1 + int(raw[0]) :].reshape(-1, self.dim))
                todo = [leaf]
                while todo:
                    node, radius = todo.pop(), float(next(radii))
                    if radius >= 0:
                        node.rows, node.radius, node.point = None, radius, next(points)
                        node.inside, node.outside = Node(rows=0), Node(rows=0)
                        todo += [node.outside, node.inside]
        self.number()

    def cell(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, q = todo.pop()
            if node.point is None:
                out[q] = node.rows
            elif len(q):
                near = ((x[q] - node.point) ** 2).sum(1) <= node.radius**2
                todo += [(node.inside, q[near]), (node.outside, q[~near])]
        return out

    def near(self, x: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that may hold vectors nearer than its reach to each row of x."""
        rows, cells, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(self.root, np.arange(len(x)))]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if node.point is None:
                rows.append(q)
                cells.append(np.full(len(q), node.rows))
                continue
            d = np.sqrt(((x[q] - node.point) ** 2).sum(1)) - node.radius
            todo += [(node.inside, q[d * factor <= reach[q] + EPS]), (node.outside, q[-d * factor <= reach[q] + EPS])]
        return np.concatenate(rows), np.concatenate(cells)


def clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part; v is array<float> where the table's is, else array<double>."""
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & some).withColumn("dim", F.size("v"))


def matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def fit_router(rows: DataFrame, dim: int, total: int, shard: int = SHARD, sample: int = SAMPLE, top: int = TOP, tree_bytes: int = TREE_BYTES) -> Router:
    """The routing tree for rows (vec_id, v, dim), of which ``total`` have dimension ``dim``."""
    grain = 1 << 40
    part = lambda n: F.pmod(F.xxhash64(F.lit("router"), "vec_id"), F.lit(grain)) < int(min(1.0, n / max(1, total)) * grain)
    rows = rows.where(F.col("dim") == dim)
    cells = min(-(-total // shard), max(1, tree_bytes // (8 * dim))) if dim else 1
    drawn = sorted((r["vec_id"], tuple(r["v"])) for r in rows.where(part(sample)).select("vec_id", "v").toLocalIterator())
    router = Router(unit(np.array([v for _, v in drawn], np.float64)) if drawn else np.zeros((0, dim)), min(cells, top))
    if cells <= top:
        return router
    sent = rows.sparkSession.sparkContext.broadcast(router)
    each = -(-cells // router.cells)

    def route(batches):
        r = sent.value
        for b in C.slices(batches, 2000):
            yield pa.RecordBatch.from_arrays([pa.array(r.cell(unit(matrix(b.column(1), r.dim)))), b.column(0), b.column(1)], ["cell", "vec_id", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    picked = C.stored(rows.where(part(CELL * cells)).select("vec_id", "v").mapInArrow(route, f"cell long, vec_id long, v {kind}"), "router-sample")
    # One row per cell of the top. A cell of copies would hold more of the sample than its tree needs.
    counts = picked.groupBy("cell").count().withColumn("share", F.least(F.lit(1.0), F.lit(2.0 * CELL * each) / F.col("count")))
    thin = picked.join(F.broadcast(counts), "cell").where(F.pmod(F.xxhash64(F.lit("thin"), "vec_id"), F.lit(grain)) < (F.col("share") * grain).cast("long"))

    def fit(t: pa.Table) -> pa.Table:
        order = np.argsort(t["vec_id"].to_numpy(), kind="stable")
        x = unit(matrix(t["v"].combine_chunks().take(pa.array(order)), dim))
        return pa.table({"cell": pa.array([t["cell"][0].as_py()], pa.int64()), "tree": pa.array([Router(x, each).branches()], pa.binary())})

    grown = thin.select("cell", "vec_id", "v").groupBy("cell").applyInArrow(fit, "cell long, tree binary")
    router.graft({r["cell"]: bytes(r["tree"]) for r in grown.toLocalIterator()})
    C.forget(picked)
    return router


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = FACTOR, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, leaf: int = LEAF, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row whose id is divisible by ``every``, among all other rows."""
    spark = vectors.sparkSession
    held = C.Scratch()
    rows = held.stored(clean(vectors, vec_id, embedding), "vectors")
    kind = rows.schema["v"].dataType.simpleString()
    dims = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()}
    dim, total = next(iter(dims.items())) if dims else (0, 0)
    sent = spark.sparkContext.broadcast(fit_router(rows, dim, total, shard, top=top))

    def route(batches):
        r = sent.value
        for b in C.slices(batches, 2000):
            sizes = b.column(2).to_numpy()
            cell = -np.asarray(sizes, np.int64)  # other dimensions are cells of their own
            on = np.flatnonzero(sizes == r.dim)
            if len(on):
                cell[on] = r.cell(unit(matrix(b.column(1).take(pa.array(on)), r.dim)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], ["vec_id", "v", "cell"])

    routed = held.stored(rows.mapInArrow(route, f"vec_id long, v {kind}, cell long"), "routed")
    # One row per cell: as many as the tree has and one per other dimension.
    counts = held.stored(routed.groupBy("cell").agg(F.ceil(F.count("*") / shard).alias("shards")), "cells")
    deal = lambda c: F.pmod(F.xxhash64(c), "shards")
    asked = routed.where(F.col("vec_id") % every == 0).withColumnsRenamed({"vec_id": "query_id", "v": "q"}).join(counts, "cell").withColumn("shard", deal("query_id"))
    members = routed.join(counts, "cell").withColumn("shard", deal("vec_id"))

    def visit(queries: DataFrame) -> DataFrame:
        """queries: (query_id, q, cell, shard, reach). (query_id, vec_id, score) of each one's k best of the shard."""
        blocks = queries.groupBy("cell", "shard").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        left = queries.join(blocks, ["cell", "shard"]).select("cell", "shard", F.pmod(F.xxhash64("query_id"), "blocks").alias("block"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("q").alias("v"), "reach")
        right = members.join(blocks, ["cell", "shard"]).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("cell", "shard", "block", F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v", F.lit(0.0).alias("reach"))

        def run(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            asks, column = t["asks"].to_numpy(), t["v"].combine_chunks()
            x, ids, reach = matrix(column, len(column[0])), t["id"].to_numpy(), t["reach"].to_numpy()
            # A bound from the round before, as if k unknown neighbours were that far away.
            best = Best(np.where(np.isfinite(reach[asks]), 1 - reach[asks] ** 2 / 2 - EPS, -np.inf), k)
            if asks.any() and not asks.all():
                Shard(x[~asks], ids[~asks], leaf).search(x[asks], ids[asks], best, factor)
            r, c = np.nonzero(best.id != NOBODY)
            return pa.table({"query_id": pa.array(ids[asks][r]), "vec_id": pa.array(best.id[r, c]), "score": pa.array(best.score[r, c])})

        return left.unionByName(right).groupBy("cell", "shard", "block").applyInArrow(run, "query_id long, vec_id long, score double")

    first = held.stored(visit(asked.drop("shards").withColumn("reach", F.lit(float("inf")))), "near")
    # The k-th best of the first shard bounds the distance; each query has a handful of rows here.
    worst = lambda rows, n: F.try_element_at(F.array_sort(F.collect_list(rows)), F.lit(n))
    kth = first.groupBy("query_id").agg(worst(-F.col("score"), k).alias("kth"))
    bounded = asked.join(kth, "query_id", "left").withColumn("reach", F.when(F.col("kth").isNull(), float("inf")).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 + 2 * F.col("kth"))) + EPS))

    def spread(batches):
        r = sent.value
        for b in C.slices(batches, 2000):
            own, reach = b.column(2).to_numpy(), b.column(3).to_numpy()
            on = np.flatnonzero(own >= 0)
            row, cell = np.flatnonzero(own < 0), own[own < 0]
            if len(on):
                q, c = r.near(unit(matrix(b.column(1).take(pa.array(on)), r.dim)), reach[on], factor)
                row, cell = np.concatenate([row, on[q]]), np.concatenate([cell, c])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell), b.column(3).take(at), pa.array(own[row]), b.column(4).take(at)], ["query_id", "q", "cell", "reach", "own", "seen"])

    spreads = bounded.select("query_id", "q", "cell", "reach", "shard").mapInArrow(spread, f"query_id long, q {kind}, cell long, reach double, own long, seen long")
    more = spreads.join(counts, "cell").withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)"))).where("cell <> own OR shard <> seen")
    more = held.stored(more.select("query_id", "q", "cell", "shard", "reach"), "spread")
    both = first.unionByName(visit(more))
    top_k = both.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id")))), 1, k).alias("top"))
    out = top_k.select("query_id", F.posexplode("top").alias("pos", "one")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.s")).alias("score"))
    out = C.stored(out, "neighbours")
    held.clear()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: rows of embeddings whose vec_id is divisible by 50, against all rows."""
    return neighbours(C.table(spark, sf_dir, "embeddings"))


#: Exact search. It has the query's rows where a shard is one leaf, as on tables of up to LEAF vectors; larger ones are held to their recall in the tests.
SQL = """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT vec_id, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS v FROM g),
n AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS size FROM s),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) / (q.size * c.size) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 5
"""
