"""Neighbour joins in the plane, as equi-joins on grid cells.

A cell is as wide as the search radius. The probe side is copied to the 3 x 3 cells around it, joined on
(keys, cell), and filtered by exact distance; nothing is broadcast and no pair is formed beyond
neighbouring cells."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from skyspark.operators.rounds import Rounds

#: Pairs that are compared at once.
PAIRS = 1 << 20


def _cells(df: DataFrame, x: str, y: str, radius: float, around: bool) -> DataFrame:
    cx, cy = F.floor(F.col(x) / radius).cast("long"), F.floor(F.col(y) / radius).cast("long")
    if not around:
        return df.withColumn("__cx", cx).withColumn("__cy", cy)
    near = F.array(*[F.struct((cx + i).alias("i"), (cy + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("__c", F.explode(near)).withColumn("__cx", F.col("__c.i")).withColumn("__cy", F.col("__c.j")).drop("__c")


def pairs_within(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = (), a: tuple[str, str] = ("x", "y"), b: tuple[str, str] = ("x", "y"), limit: Column | None = None) -> DataFrame:
    """All pairs of one key value nearer than radius (or than a column ``limit`` <= radius over the joined row), with dx, dy and distance. Other columns must have distinct names."""
    l = _cells(left.withColumnsRenamed({a[0]: "__ax", a[1]: "__ay"}), "__ax", "__ay", radius, True)  # noqa: E741
    r = _cells(right.withColumnsRenamed({b[0]: "__bx", b[1]: "__by"}), "__bx", "__by", radius, False)
    out = l.join(r, [*keys, "__cx", "__cy"]).withColumn("dx", F.col("__bx") - F.col("__ax")).withColumn("dy", F.col("__by") - F.col("__ay"))
    out = out.withColumn("distance", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where(F.col("distance") <= radius).drop("__cx", "__cy", "__ax", "__ay", "__bx", "__by")
    return out if limit is None else out.where(F.col("distance") <= limit)


def nearest(left: DataFrame, right: DataFrame, radius: float, k: int, left_id: list[str], right_id: str, keys: tuple[str, ...] = (), **options) -> DataFrame:
    """The k nearest right rows within radius of each left row, with rank; ties go to the smaller right id."""
    w = Window.partitionBy(*keys, *left_id).orderBy("distance", right_id)
    return pairs_within(left, right, radius, keys, **options).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def close_pairs(df: DataFrame, radius: float, key: str, keys: tuple[str, ...] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (a, b), a < b, of one table within radius."""
    a = df.select(*keys, F.col(key).alias("a"), F.col(x).alias("x"), F.col(y).alias("y"))
    return pairs_within(a, a.withColumnRenamed("a", "b"), radius, keys).where("a < b").select(*keys, "a", "b", "distance")


def neighbour_stats(df: DataFrame, radius: float, key: str, mag: str, keys: tuple[str, ...] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Per row: neighbours within radius, distance of the nearest and of the nearest brighter one."""
    a = df.select(*keys, F.col(key).alias("a"), F.col(mag).alias("ma"), F.col(x).alias("x"), F.col(y).alias("y"))
    b = df.select(*keys, F.col(key).alias("b"), F.col(mag).alias("mb"), F.col(x).alias("x"), F.col(y).alias("y"))
    # An outer join, so that rows without neighbours need no second reading of df.
    l, r = _cells(a, "x", "y", radius, True), _cells(b.withColumnsRenamed({"x": "__bx", "y": "__by"}), "__bx", "__by", radius, False)  # noqa: E741
    own = [*keys, "__cx", "__cy"]
    l, r = l.select(*own, "a", "ma", "x", "y"), r.withColumnsRenamed({k: f"__r{k}" for k in own})  # noqa: E741
    dx, dy = F.col("__bx") - F.col("x"), F.col("__by") - F.col("y")
    distance = F.sqrt(dx * dx + dy * dy)
    on = (F.col("a") != F.col("b")) & (distance <= radius)
    for k in own:
        on = on & (F.col(k) == F.col(f"__r{k}"))
    near = l.join(r, on, "left").groupBy(*keys, "a").agg(F.count("b").alias("n_near"), F.min(distance).alias("nearest"), F.min(F.when(F.col("mb") < F.col("ma"), distance)).alias("nearest_brighter"))
    return near.withColumnRenamed("a", key)


def neighbours_in_tiles(df: DataFrame, radius: float, key: str, mag: str, keys: tuple[str, ...] = (), x: str = "x", y: str = "y", tile: float = 128.0) -> DataFrame:
    """neighbour_stats() without a join, of rows whose key is unique in keys: neighbours within radius, distance of the nearest and of the nearest brighter one; 0 and nulls for a row without a finite place or with a null among its keys.

    A task counts one tile of one key value, ``tile`` radii wide, with a halo of a radius; no pair leaves it, and df, if parted by keys, is not shuffled again."""
    width, halo = tile * radius, 1.001 * radius
    start = -width / 4  # places from 0 to 0.75 of a tile lie in one, as an image's mostly do
    rows = df.select(*keys, F.col(key).alias("__key"), F.col(mag).cast("double").alias("__mag"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    out = StructType([*[f for f in rows.schema if f.name in (*keys, "__key")], *StructType.fromDDL("n_near long, nearest double, nearest_brighter double")])

    def count(t: pa.Table) -> pa.Table:
        px, py, m = (t[c].to_numpy() for c in ("__x", "__y", "__mag"))
        valued = t["__mag"].is_valid().to_numpy()
        placed = np.isfinite(px) & np.isfinite(py)
        mine = ~placed | ((np.floor((px - start) / width) == t["__tx"][0].as_py()) & (np.floor((py - start) / width) == t["__ty"][0].as_py()))
        n, nearest, brighter = np.zeros(len(t), np.int64), np.full(len(t), np.inf), np.full(len(t), np.inf)
        named = t["__key"].is_valid().to_numpy() & all(t[k][0].is_valid for k in keys)
        seen = np.flatnonzero(placed & named)
        if len(seen):
            cell = [np.floor(v[seen] / radius) for v in (px, py)]
            u, v = ((c - c.min()).astype(np.int64) + 1 for c in cell)
            span = int(v.max()) + 2
            order = np.argsort(u * span + v, kind="stable")
            seen, code = seen[order], (u * span + v)[order]
            own = np.flatnonzero(mine[seen])
            for d in (i * span + j for i in (-1, 0, 1) for j in (-1, 0, 1)):
                low, high = (np.searchsorted(code, code[own] + d, side) for side in ("left", "right"))
                total = np.cumsum(high - low)
                at = 0
                while at < len(own):
                    end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
                    many = (high - low)[at:end]
                    i = np.repeat(own[at:end], many)
                    j = np.repeat(low[at:end] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    i, j = seen[i], seen[j]
                    dx, dy = px[j] - px[i], py[j] - py[i]
                    distance = np.sqrt(dx * dx + dy * dy)
                    on = (distance <= radius) & (i != j)
                    i, j, distance = i[on], j[on], distance[on]
                    n += np.bincount(i, minlength=len(t))
                    np.minimum.at(nearest, i, distance)
                    # Magnitudes that are no numbers come last, as Spark orders them.
                    less = valued[i] & valued[j] & ((m[j] < m[i]) | (np.isnan(m[i]) & ~np.isnan(m[j])))
                    np.minimum.at(brighter, i[less], distance[less])
                    at = end
        k = np.flatnonzero(mine)
        far = [pa.array(np.where(np.isfinite(v[k]), v[k], 0.0), mask=~np.isfinite(v[k])) for v in (nearest, brighter)]
        t = t.take(pa.array(k))
        return pa.table({**{c: t[c] for c in (*keys, "__key")}, "n_near": n[k], "nearest": far[0], "nearest_brighter": far[1]})

    in_place = (F.abs("__x") < float("inf")) & (F.abs("__y") < float("inf"))
    tiles = rows
    for v, k, other in (("__x", "__tx", F.pmod(F.hash("__key"), F.lit(64)).cast("long")), ("__y", "__ty", F.lit(0).cast("long"))):
        ends = [F.floor((F.col(v) - start + d) / width) for d in (-halo, halo)]
        tiles = tiles.withColumn(k, F.explode(F.when(in_place, F.sequence(*ends)).otherwise(F.array(other))))
    return tiles.groupBy(*keys, "__tx", "__ty").applyInArrow(count, out).withColumnRenamed("__key", key)


def brightest(df: DataFrame, keys: tuple[str, ...], mag: str, key: str, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(mag, key))).where(F.col("__r") <= n).drop("__r")


def offset_peaks(left: DataFrame, right: DataFrame, keys: tuple[str, ...], reach: float, width: float, scales: Column | None = None) -> DataFrame:
    """Per key the shift (dx, dy) that most pairs of right - left share: the highest 3 x 3 sum of a histogram of the differences.

    Both sides are cut beforehand (see brightest), so a key's pairs are bounded; they are counted in the task that holds the key's rows, and no pair is shuffled.
    scales: an array of scale changes to try about (0, 0). Returns keys, scale, dx, dy, votes."""
    kinds = dict(left.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "scale double, dx double, dy double, votes double"
    n = int(np.ceil(reach / width)) + 2
    span = 2 * n + 1
    around = np.array([i * span + j for i in (-1, 0, 1) for j in (-1, 0, 1)])

    def votes(x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes by number, and their votes."""
        found = []
        for at in range(0, len(x), 256):
            dx, dy = bx - x[at : at + 256, None], by - y[at : at + 256, None]
            near = (np.abs(dx) <= reach) & (np.abs(dy) <= reach)
            found.append((np.floor(dx[near] / width).astype(np.int64) + n) * span + np.floor(dy[near] / width).astype(np.int64) + n)
        bins, count = np.unique(np.concatenate(found), return_counts=True)
        boxes, of = np.unique((bins[:, None] + around).ravel(), return_inverse=True)
        return boxes, np.bincount(of, np.repeat(count, 9), len(boxes))

    def peak(a: pa.Table, b: pa.Table) -> pa.Table:
        ax, ay, bx, by = [np.asarray(t[k].to_numpy(), np.float64) for t in (a, b) for k in ("x", "y")]
        lists = a["__scales"].to_pylist()
        trial, row = np.array([v for one in lists for v in one or ()], np.float64), np.repeat(np.arange(len(lists)), [len(one or ()) for one in lists])
        best = []
        with np.errstate(invalid="ignore"):
            for scale in np.unique(trial):
                of = row[trial == scale]
                boxes, sums = votes(ax[of] * (scale + 1), ay[of] * (scale + 1), bx, by)
                if len(boxes):
                    k = int(sums.argmax())  # of equal ones the smallest i, then j
                    best.append((-sums[k], abs(scale), scale, int(boxes[k])))
        if not best:
            return pa.table({f.name: pa.array([], f.type) for f in to_arrow_schema(out)})
        most, _, scale, box = min(best)
        dx, dy = (box // span - n + 0.5) * width, (box % span - n + 0.5) * width
        return pa.table({**{k: a[k].slice(0, 1) for k in keys}, "scale": [float(scale)], "dx": [dx], "dy": [dy], "votes": [float(-most)]})

    def side(df: DataFrame, *more: Column):
        return df.dropna(subset=list(keys)).select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *more).groupBy(*keys)

    trials = scales if scales is not None else F.array(F.lit(0.0))
    out = StructType.fromDDL(schema)
    return side(left, trials.cast("array<double>").alias("__scales")).cogroup(side(right)).applyInArrow(peak, schema)


def footprint_counts(boxes: DataFrame, points: DataFrame, cell: float = 0.1) -> DataFrame:
    """boxes: (id, ra_min, ra_max, dec_min, dec_max); points: (ra, dec). Points in each box, by a grid in degrees.

    Boxes meet only cells between the points' outermost ones. A cell inside a box, not on its edge, adds its number of points; only on the edge are points compared."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    p = points.select("ra", "dec").where((F.abs("ra") < float("inf")) & (F.abs("dec") < float("inf"))).withColumns({"__cx": at("ra"), "__cy": at("dec")})
    counts = p.groupBy("__cx", "__cy").agg(F.count("*").alias("n"))
    ends = counts.agg(*[f(f"__c{k}").alias(f"__{k}{e}") for k in "xy" for e, f in ((0, F.min), (1, F.max))])
    b = boxes.withColumns({"__l": at("ra_min"), "__r": at("ra_max"), "__b": at("dec_min"), "__t": at("dec_max")}).crossJoin(F.broadcast(ends))
    b = b.where("ra_min <= ra_max AND dec_min <= dec_max AND __l <= __x1 AND __r >= __x0 AND __b <= __y1 AND __t >= __y0")
    b = b.withColumn("__cx", F.explode(F.expr("sequence(greatest(__l, __x0), least(__r, __x1))"))).withColumn("__cy", F.explode(F.expr("sequence(greatest(__b, __y0), least(__t, __y1))")))
    inner = F.expr("__cx > __l AND __cx < __r AND __cy > __b AND __cy < __t")
    whole = b.where(inner).join(counts, ["__cx", "__cy"]).select("id", "n")
    part = b.where(~inner).join(p, ["__cx", "__cy"]).where("ra BETWEEN ra_min AND ra_max AND dec BETWEEN dec_min AND dec_max").groupBy("id").agg(F.count("*").alias("n"))
    inside = whole.unionByName(part).groupBy("id").agg(F.sum("n").alias("n"))
    return boxes.select("id").join(inside, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def match_sets(a: DataFrame, b: DataFrame, keys: tuple[str, ...], radius: float, sigma: float, floor: float, candidates: int = 5) -> DataFrame:
    """Candidate pairs of two lists under a radius of its own for each pair, sigma * sqrt(sa^2 + sb^2 + (pm dt)^2), and a magnitude gate sigma * sqrt(sma^2 + smb^2 + floor^2).

    a: keys, a, x, y, sa, ma, sma, motion (0 if none); b: keys, b, x, y, sb, mb, smb. The first ``candidates`` by distance of each a."""
    limit = F.sqrt(F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb") + F.col("motion") * F.col("motion")) * sigma
    gate = F.sqrt(F.col("sma") * F.col("sma") + F.col("smb") * F.col("smb") + floor * floor) * sigma
    ok = nearest(a, b, radius, candidates, ["a"], "b", keys)
    return ok.where((F.col("distance") <= limit) & (F.abs(F.col("ma") - F.col("mb")) <= gate))


def isolated(df: DataFrame, radius: float, keys: tuple[str, ...], key: str, mag: str, tile: float = 128.0, rounds: int = 1000) -> DataFrame:
    """Rows that stay when, brightest first, each row removes fainter ones within radius (see isolated_keys)."""
    return df.join(isolated_keys(df, radius, keys, key, mag, tile, rounds), [*keys, key], "left_semi")


def isolated_keys(df: DataFrame, radius: float, keys: tuple[str, ...], key: str, mag: str, tile: float = 128.0, rounds: int = 1000) -> DataFrame:
    """The keys and key (unique in them, neither null) of the rows that stay when, brightest first and of equal ones the smaller key first, each row removes fainter ones within radius.

    A row without magnitude or finite place neither removes nor is removed. A task sweeps one tile of one key value, ``tile`` radii wide, with a halo of six radii; no pair leaves it, and df, if
    parted by keys, is not shuffled again. What hangs on rows that a tile doesn't see stays open. The next round's tiles lie elsewhere and take only open rows and the rows kept near them; its brightest open row is always decided."""
    width, halo = tile * radius, 6 * radius
    around = [i * 1_000_000 + j for i in (-1, 0, 1) for j in (-1, 0, 1)]
    held, own = Rounds(df.sparkSession), ["__key", "__mag", "__x", "__y", "__stays"]
    rest = df.dropna(subset=[*keys, key]).select(*keys, F.col(key).alias("__key"), F.col(mag).alias("__mag"), F.col("x").cast("double").alias("__x"), F.col("y").cast("double").alias("__y"), F.lit(False).alias("__stays"))
    schema = StructType([StructField(f.name, f.dataType) for f in rest.schema])

    def swept(rest: DataFrame, n: int) -> DataFrame:
        """Rows that were open and now stay, or are open still. Places are given of open rows and of those that other tiles see or later rounds need."""
        start = -width * (0.25 + n * 0.618 % 1)  # at first, places from 0 to 0.75 of a tile less the halo lie in one tile, as an image's mostly do

        def sweep(t: pa.Table) -> pa.Table:
            t = t.take(pc.sort_indices(t, [("__stays", "descending"), ("__mag", "ascending"), ("__key", "ascending")]))
            place, known = [t[c].to_numpy() for c in ("__x", "__y")], t["__stays"].to_numpy()
            placed = np.isfinite(place[0]) & np.isfinite(place[1]) & t["__mag"].is_valid().to_numpy()
            mine, whole, edge, cell = np.ones(len(t), bool), np.ones(len(t), bool), np.zeros(len(t), bool), np.zeros(len(t), np.int64)
            for v, k in zip(place, ("__tx", "__ty"), strict=True):
                v, number = np.where(placed, v, v[placed][0] if placed.any() else 0.0), t[k][0].as_py()
                tile_of = lambda d, v=v: np.floor((v - start + d) / width)
                mine &= tile_of(0.0) == number
                whole &= (tile_of(2 * radius - halo) <= number) & (tile_of(halo - 2 * radius) >= number)  # all that is near was sent here
                edge |= tile_of(-halo) != tile_of(halo)
                at = np.floor(v / radius)
                cell = cell * 1_000_000 + (at - at.min()).astype(np.int64)
            kept, unsure = defaultdict(list), defaultdict(set)
            stays, opened, rows = ~placed, np.zeros(len(t), bool), np.flatnonzero(placed)

            def near(seen: dict[int, list | set], c: int, x: float, y: float) -> bool:
                return any(math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= radius for d in around if c + d in seen for u, v in seen[c + d])

            for first in range(0, len(rows), 65536):
                some = rows[first : first + 65536]
                for i, x, y, c, fixed, sees in zip(some.tolist(), *[v[some].tolist() for v in (*place, cell, known, whole)], strict=True):
                    if not fixed and near(kept, c, x, y):
                        continue
                    if not fixed and (not sees or near(unsure, c, x, y)):
                        unsure[c].add((x, y))
                        opened[i] = True
                    else:
                        kept[c].append((x, y))
                        stays[i] = True
            out = np.flatnonzero((mine | ~placed) & ~known & (stays | opened))
            t, given = t.take(out), pa.array((opened | (placed & edge) | (n > 0))[out])
            given = {c: pc.if_else(given, t[c], pa.scalar(None, t[c].type)) for c in ("__mag", "__x", "__y")}
            return pa.table({**{k: t[k] for k in (*keys, "__key")}, **given, "__stays": stays[out]})

        in_place = (F.abs("__x") < float("inf")) & (F.abs("__y") < float("inf")) & F.col("__mag").isNotNull()
        tiles = rest
        for v, k, other in (("__x", "__tx", F.pmod(F.hash("__key"), F.lit(64)).cast("long")), ("__y", "__ty", F.lit(0).cast("long"))):
            ends = [F.floor((F.col(v) - start + d) / width) for d in (-halo, halo)]
            tiles = tiles.withColumn(k, F.explode(F.when(in_place, F.sequence(*ends)).otherwise(F.array(other))))
        return tiles.groupBy(*keys, "__tx", "__ty").applyInArrow(sweep, schema)

    for n in range(rounds):
        done = held.add(swept(rest, n), "swept")
        still = done.where("NOT __stays")
        if still.isEmpty():
            held.drop()
            return held.all("swept").where("__stays").select(*keys, F.col("__key").alias(key))
        kept = done.where("__stays AND __x IS NOT NULL")
        kept = _cells(kept.unionByName(rest.where("__stays")) if n else kept, "__x", "__y", radius, False)
        beside = _cells(still, "__x", "__y", radius, True).select(*keys, "__cx", "__cy")
        rest = held.keep(still.unionByName(kept.join(beside, [*keys, "__cx", "__cy"], "left_semi").select(*keys, *own)), "rest")
    raise RuntimeError(f"isolated_keys did not end in {rounds} rounds")
