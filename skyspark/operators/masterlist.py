"""A master list of sources that grows over runs: a table in the shared folder, folded tile by tile.

A run brings new images. Their detections join the sources that earlier images left, one image after the other, and a source moves to the
inverse-variance mean of its detections. A source is named by its first detection, (first_order, first_det).

Under ``root`` each run writes ``run-N`` (links, and the sources that it changed) and, after that, ``run-N_status``; what has no status isn't read and is written
anew by the next run. ``compact`` writes all of it as ``base-N``, which stands for the runs up to N. One writer at a time.

Defined results: an image that an earlier run brought is left out, so a run may be repeated; an empty run changes nothing; images count in the order of their runs, and by image_order inside one, which must be
unique to an image; rows that repeat an (image_order, det) count once; detections without a position, error or magnitude are left out.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyspark.sources import sinks

#: What a source carries: its means, their weights, the mean epoch, whether any detection was a star, how many there are, and where the first one lay.
MEANS = ("x", "y", "wx", "wy", "mag", "wm", "epoch")
STATE = "first_order long, first_det long, x double, y double, wx double, wy double, mag double, wm double, epoch double, star boolean, n_detect long, x0 double, y0 double"
LINK = "image_order long, det long, first_order long, first_det long"
NEEDS = ("x", "y", "sigma_x", "sigma_y", "mag", "mag_err", "epoch")


class Rules:
    """When a detection may join a source: closer than ``sigma`` errors, to which a motion of ``motion`` mas a year since the source's mean epoch is added, and alike in magnitude
    within ``mag_sigma`` errors with a floor, or ``relaxed`` times that if it isn't a star."""

    def __init__(self, motion: float = 100.0, sigma: float = 5.0, mag_sigma: float = 3.0, floor: float = 0.1, relaxed: float = 1.5):
        self.motion, self.sigma, self.mag_sigma, self.floor, self.relaxed = motion, sigma, mag_sigma, floor, relaxed


class Grid:
    """Sources by cell, in levels of their error: a detection meets those that lie within its reach, and what an image costs grows with its detections alone.

    base: the error up to which sources are of level 0; each further level doubles it. drift: the largest motion that any pair is granted."""

    def __init__(self, sigma: float, base: float, drift: float):
        self.sigma, self.base, self.drift = sigma, base, drift
        self.levels: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.at: list[tuple[int, tuple[int, int]]] = []

    def put(self, j: int, x: float, y: float, error: float) -> None:
        """Source j (at most one more than there are) lies at (x, y) now."""
        level = 0 if error <= self.base else math.ceil(math.log2(error / self.base))
        side = self.side(level)
        place = level, (math.floor(x / side), math.floor(y / side))
        if j < len(self.at):
            if self.at[j] == place:
                return
            old, cell = self.at[j]
            self.levels[old][cell].remove(j)
            if not self.levels[old][cell]:
                del self.levels[old][cell]
            self.at[j] = place
        else:
            self.at.append(place)
        self.levels.setdefault(level, {}).setdefault(place[1], []).append(j)

    def side(self, level: int) -> float:
        return self.reach(level, self.base)

    def reach(self, level: int, error: float) -> float:
        """No pair of a source of this level and a detection of this error is farther apart."""
        return self.sigma * math.sqrt((self.base * 2.0**level) ** 2 + error * error + self.drift * self.drift) * (1 + 1e-9)

    def around(self, x: float, y: float, error: float):
        """All sources that a detection may reach, and some beyond."""
        for level, cells in self.levels.items():
            side, reach = self.side(level), self.reach(level, error)
            low, high = math.floor((x - reach) / side), math.floor((x + reach) / side)
            left, right = math.floor((y - reach) / side), math.floor((y + reach) / side)
            if (high - low + 1) * (right - left + 1) > len(cells):
                for (i, j), found in cells.items():
                    if low <= i <= high and left <= j <= right:
                        yield from found
                continue
            for i in range(low, high + 1):
                for j in range(left, right + 1):
                    yield from cells.get((i, j), ())


def fold(state: dict[str, np.ndarray], det: dict[str, np.ndarray], rules: Rules) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(sources, the source's row of each detection): detections, sorted by image_order, joined to sources image after image.

    Stars first, then the others; in each pass the closest pairs win, ties to the source and detection named first. A source takes one detection an image; what is left opens sources."""
    m = len(det["x"])
    s, d = {k: v.tolist() for k, v in state.items()}, {k: v.tolist() for k, v in det.items()}
    weight = {k: (1 / np.maximum(det[e], 1e-9) ** 2).tolist() for k, e in (("wx", "sigma_x"), ("wy", "sigma_y"), ("wm", "mag_err"))}
    spread = np.sqrt((det["sigma_x"] ** 2 + det["sigma_y"] ** 2) / 2)
    error, own, since = spread.tolist(), [-1] * m, np.concatenate([state["epoch"], det["epoch"]])
    drift = rules.motion * float(since.max() - since.min()) if len(since) else 0.0
    grid = Grid(rules.sigma, max(float(np.median(spread)) if m else 0.0, drift, 1e-6), drift)
    width = [math.sqrt((1 / a + 1 / b) / 2) for a, b in zip(s["wx"], s["wy"], strict=True)]
    for j, place in enumerate(zip(s["x"], s["y"], width, strict=True)):
        grid.put(j, *place)
    starts = np.flatnonzero(np.r_[True, det["image_order"][1:] != det["image_order"][:-1]]).tolist() if m else []
    for low, high in zip(starts, [*starts[1:], m], strict=bool(m)):
        busy, now = set(), d["epoch"][low]
        for star in (True, False):
            rows = [i for i in range(low, high) if d["star"][i] == star]
            factor, pairs = rules.mag_sigma * (1.0 if star else rules.relaxed), []
            for i in rows:
                x, y, mag, e = d["x"][i], d["y"][i], d["mag"][i], error[i]
                for j in grid.around(x, y, e):
                    if j not in busy and abs(mag - s["mag"][j]) < factor * math.sqrt(1 / s["wm"][j] + d["mag_err"][i] ** 2 + rules.floor**2):
                        gap, moved = math.hypot(x - s["x"][j], y - s["y"][j]), rules.motion * abs(s["epoch"][j] - now)
                        if gap < rules.sigma * math.sqrt(width[j] ** 2 + e**2 + moved**2):
                            pairs.append((gap, s["first_order"][j], s["first_det"][j], d["det"][i], i, j))
            for *_, i, j in sorted(pairs):
                if own[i] < 0 and j not in busy:
                    own[i] = j
                    busy.add(j)
            for i in rows:
                j = own[i]
                if j < 0:
                    own[i] = j = len(width)
                    busy.add(j)
                    for k in ("x", "y", "mag", "epoch", "star"):
                        s[k].append(d[k][i])
                    for k in weight:
                        s[k].append(weight[k][i])
                    for k, v in (("n_detect", 1), ("x0", d["x"][i]), ("y0", d["y"][i]), ("first_order", d["image_order"][i]), ("first_det", d["det"][i])):
                        s[k].append(v)
                    width.append(0.0)
                else:
                    for value, w in (("epoch", "wx"), ("x", "wx"), ("y", "wy"), ("mag", "wm")):
                        s[value][j] = (s[w][j] * s[value][j] + weight[w][i] * d[value][i]) / (s[w][j] + weight[w][i])
                    for w in weight:
                        s[w][j] += weight[w][i]
                    s["star"][j] |= star
                    s["n_detect"][j] += 1
                width[j] = math.sqrt((1 / s["wx"][j] + 1 / s["wy"][j]) / 2)
                grid.put(j, s["x"][j], s["y"][j], width[j])
    return {k: np.array(v, state[k].dtype) for k, v in s.items()}, np.array(own, np.int64)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def committed(spark: SparkSession, root: str) -> tuple[list[str], int]:
    """(folders that hold the list now, the next run's number)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*_status/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    names = [re.search(r"/((run|base)-(\d+))_status/", f.getPath().toString()) for f in found]
    runs = sorted((int(m[3]), m[2], m[1]) for m in names if m)
    base = max((k for k, kind, _ in runs if kind == "base"), default=-1)
    return [f"{root}/{name}" for k, kind, name in runs if k > base or (k == base and kind == "base")], max((k for k, _, _ in runs), default=-1) + 1


class Master:
    """The list at ``root``. keys: columns such as the filter, whose values have lists of their own, as (name, type); tile: the side of a tile in mas; halo: how far beyond it a task looks.

    The halo must be wider than a chain of detections that compete for one another; ``torn`` counts the sources for which it was not."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], tile: float, halo: float, rules: Rules | None = None):
        if not 0 < halo <= tile:
            raise ValueError("the halo is wider than 0 and no wider than a tile")
        self.spark, self.root, self.keys, self.tile, self.halo, self.rules = spark, root.rstrip("/"), keys, tile, halo, rules or Rules()
        self.kinds = "".join(f"`{k}` {t}, " for k, t in keys.items())

    def _table(self, name: str, schema: str) -> DataFrame:
        folders, _ = committed(self.spark, self.root)
        schema = f"{self.kinds}{schema}, run long"
        return self.spark.read.schema(schema).parquet(*[f"{f}/{name}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def links(self) -> DataFrame:
        """Every detection with its source: keys, image_order, det, first_order, first_det."""
        return self._table("links", LINK).drop("run")

    def sources(self) -> DataFrame:
        """The sources as the last run that touched each left them."""
        names = _names(STATE)
        last = self._table("sources", STATE).groupBy(*self.keys, "first_order", "first_det").agg(F.max_by(F.struct(*names[2:]), "run").alias("s"))
        return last.select(*self.keys, "first_order", "first_det", "s.*")

    def torn(self) -> int:
        """Sources whose number of detections isn't that of their links, as tiles saw them differently: 0 where the halo was wide enough."""
        n = self.links().groupBy(*self.keys, "first_order", "first_det").agg(F.count("*").alias("n"))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*self.keys, "first_order", "first_det")]
        both = self.sources().alias("a").join(n.alias("b"), same, "full")
        return both.where(~F.col("n").eqNullSafe(F.col("n_detect"))).count()

    def _spread(self, df: DataFrame, *places: tuple[str, str]) -> DataFrame:
        """Rows once in every tile whose halo they lie in, at any of the places (x, y)."""
        cell = lambda c, off: F.floor((F.col(c) + off) / self.tile).cast("long")
        steps = (-1, 0, 1)
        return df.withColumn("__t", F.explode(F.array_distinct(F.array(*[F.struct(cell(x, i * self.halo).alias("i"), cell(y, j * self.halo).alias("j")) for x, y in places for i in steps for j in steps]))))

    def grow(self, detections: DataFrame) -> None:
        """Brings new images in. detections: keys, image_order, det (long), x, y, sigma_x, sigma_y (mas), mag, mag_err, epoch (years), star (boolean); other columns aren't read."""
        keys, state = list(self.keys), _names(STATE)
        good = F.lit(True)
        for c in NEEDS:
            good = good & F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
        given = detections.where(good).select(*keys, *[F.col(c).cast("long").alias(c) for c in ("image_order", "det")], *[F.col(c).cast("double").alias(c) for c in NEEDS], F.coalesce("star", F.lit(False)).alias("star"))
        known = self.links().select(*keys, "image_order").distinct()
        new = given.alias("a").join(known.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "image_order")], "left_anti")
        once = Window.partitionBy(*keys, "image_order", "det").orderBy(*NEEDS, "star")
        new = self._spread(new.withColumn("__k", F.row_number().over(once)).where("__k = 1").drop("__k"), ("x", "y"))
        at = [*keys, "__i", "__j"]
        tiled = lambda df: df.withColumns({"__i": F.col("__t.i"), "__j": F.col("__t.j")}).drop("__t")
        # What a task needs of a source: it lies within the tile's halo, or began there.
        det, old = tiled(new), tiled(self._spread(self.sources(), ("x", "y"), ("x0", "y0")))
        touched = det.select(*at).distinct()
        old = old.alias("a").join(touched.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in at], "left_semi")
        kinds = dict(c.split() for c in f"{STATE}, {LINK}".split(", ")) | {c: "double" for c in NEEDS}
        every = sorted(set(kinds))
        pad = lambda df, kind: df.select(*at, F.lit(kind).alias("__kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in every])
        rows = pad(old, 0).unionByName(pad(det, 1))
        tile, rules, names = self.tile, self.rules, [*keys, "__kind", *_names(LINK), *state[2:], "run"]
        folders, number = committed(self.spark, self.root)

        def run(t: pa.Table) -> pa.Table:
            kind = t["__kind"].to_numpy()
            a, b = t.take(pa.array(np.flatnonzero(kind == 0))), t.take(pa.array(np.flatnonzero(kind == 1)))
            dtypes = {c: {"long": np.int64, "boolean": bool}.get(kinds[c], np.float64) for c in every}
            of = lambda part, cols: {c: np.array(part[c].to_numpy(zero_copy_only=False), dtypes[c]) for c in cols}
            d, s = of(b, ("image_order", "det", "star", *NEEDS)), of(a, state)
            order = np.lexsort((d["det"], d["image_order"]))
            d = {k: v[order] for k, v in d.items()}
            lead = np.lexsort((s["first_det"], s["first_order"]))
            s, own = fold({k: v[lead] for k, v in s.items()}, d, rules)
            i, j = (t[c][0].as_py() for c in ("__i", "__j"))
            here = lambda x, y: (np.floor(x / tile) == i) & (np.floor(y / tile) == j)
            mine, changed = here(d["x"], d["y"]), np.zeros(len(s["x"]), bool)
            changed[own] = True
            changed &= here(s["x0"], s["y0"])
            p, q, none = int(mine.sum()), int(changed.sum()), lambda n, c: pa.nulls(n, {"long": pa.int64(), "boolean": pa.bool_()}.get(kinds[c], pa.float64()))
            out = {k: pa.array([t[k][0].as_py()] * (p + q), t.schema.field(k).type) for k in keys}
            out["__kind"] = pa.array(["links"] * p + ["sources"] * q, pa.string())
            for c in ("image_order", "det"):
                out[c] = pa.concat_arrays([pa.array(d[c][mine]), none(q, c)])
            for c in ("first_order", "first_det"):
                out[c] = pa.concat_arrays([pa.array(s[c][own[mine]]), pa.array(s[c][changed])])
            for c in state[2:]:
                out[c] = pa.concat_arrays([none(p, c), pa.array(s[c][changed])])
            out["run"] = pa.array(np.full(p + q, number, np.int64))
            return pa.table({c: out[c] for c in names})

        schema = f"{self.kinds}__kind string, {LINK}, {', '.join(STATE.split(', ')[2:])}, run long"
        path = f"{self.root}/run-{number:06d}"
        rows.groupBy(*at).applyInArrow(run, schema).write.mode("overwrite").partitionBy("__kind").parquet(f"{path}/rows")
        both = self.spark.read.schema(schema).parquet(f"{path}/rows")
        self._write(path, both.where("__kind = 'links'"), both.where("__kind = 'sources'"))

    def _write(self, path: str, links: DataFrame, sources: DataFrame) -> None:
        """Both tables, by keys and place, and the status after them."""
        links.select(*self.keys, *_names(LINK), "run").write.mode("overwrite").parquet(f"{path}/links")
        sources.select(*self.keys, *_names(STATE), "run").write.mode("overwrite").parquet(f"{path}/sources")
        sinks.write_status(self.spark, path, {"status": "success"})

    def compact(self) -> None:
        """Writes the list as one base, so that later runs read each source once. The old folders stay until they are removed by hand, as plans may still read them."""
        folders, number = committed(self.spark, self.root)
        if folders:
            self._write(f"{self.root}/base-{number - 1:06d}", self._table("links", LINK), self.sources().withColumn("run", F.lit(number - 1).cast("long")))
