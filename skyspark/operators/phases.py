"""Alignment in rounds: about the solution's own places, with detections and stars judged between solutions, and stars that join later; and draws from its posterior.

Everything that lasts from round to round is a table of the shared folder, a row per detection or star (``Rounds``); the driver holds the images' solution alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspark.operators import solver
from skyspark.operators.compare import vector_chi2
from skyspark.operators.robust import adaptive_threshold
from skyspark.operators.rounds import Rounds

DIAGONAL = (0, 5, 9, 12, 14)


class Relinearised:
    """solution, the geometry (rows) about its stars' places, how many rounds there were, and whether the last moved no star by the tolerance."""

    def __init__(self, solution: solver.Alignment, rows: DataFrame, rounds: int, converged: bool):
        self.solution, self.rows, self.rounds, self.converged = solution, rows, rounds, converged


def relinearised(detections: DataFrame, stars: DataFrame, images: DataFrame, star_priors: DataFrame, most: int = 6, tolerance: float = 1e-3, nu: float | None = None, **options) -> Relinearised:
    """solver.align() about the stars' places at their images' epochs as the solution itself has them, not about their catalogue positions: for stars so fast that one plane's derivatives don't serve both ends.

    After each solution (an inner loop of its own) the geometry is made anew at its stars, in executors, until no star's place at any epoch moves by ``tolerance`` mas."""
    held = Rounds(detections.sparkSession)
    span = images.agg(F.max(F.abs("dt"))).first()[0] or 0.0
    at = solution = None
    converged, k = False, 0
    for k in range(1, most + 1):
        rows = held.keep(solver.geometry(detections, stars, images, at=at, **options), "rows")
        solution = solver.align(rows, star_priors, solution.r if solution else None, nu)
        new = held.keep(solver.conditional(rows, star_priors, solution.r, nu).select("star", "v"), f"at{k % 2}")
        old = F.array(*[F.lit(0.0)] * 5) if at is None else F.col("old")
        both = new if at is None else new.join(at.select("star", F.col("v").alias("old")), "star")
        far = [F.abs(F.col("v")[i] - old[i]) * w for i, w in enumerate((1.0, 1.0, span, span, 1.0))]
        moved = both.agg(F.max(sum(far[1:], far[0]))).first()[0]
        at = new
        if moved is None or moved < tolerance:
            converged = True
            break
    rows = held.add(solver.geometry(detections, stars, images, at=at, **options), "result")
    held.drop()
    return Relinearised(solution, rows, k, converged)


def posterior_samples(solution: solver.Alignment, spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """(sample, image_id, r): draws of all images' parameters from their joint posterior, by back-substitution through the factor of its precision (as sparse as the images' couplings), in executors.

    A draw's numbers follow from seed and sample alone. The factor is a broadcast of checked size."""
    if solution.precision is None:
        raise ValueError("this solution has no precision matrix, only covariances of coupled pairs: align again")
    factor = solution.precision.factor()
    if factor.nbytes() > solver.SENT_BYTES:
        raise ValueError(f"the factor has more than {solver.SENT_BYTES} bytes; align fewer images at a time")
    images = [int(i) for i in solution.images]
    sent = spark.sparkContext.broadcast((factor, np.array([solution.r[i] for i in solution.images])))

    def run(batches):
        f, mean = sent.value
        for b in batches:
            for s in b.column(0).to_pylist():
                z = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, s])).normal(size=(1, f.size, f.n))
                r = mean + f.draw(z)[0]
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(images), pa.int32()), pa.array(images), pa.array(list(r), pa.list_(pa.float64()))], ["sample", "image_id", "r"])

    return spark.range(0, count, 1, max(1, min(count, 2 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "sample int, image_id long, r array<double>")


@dataclass(frozen=True)
class Rules:
    """What stars and detections are held to.

    k, dead: limits are the median plus k lower half-widths; what is in stays up to k + dead (so that none goes back and forth). full, short: least limits of stars with and without motions (chi-square at 0.99 for 5 and
    2 degrees of freedom), and of detections (2 degrees). diffuse: limit for stars that are not anchored, about their own prior's widths (chi-square of 5 degrees at two sigmas). cook, sigma: a detection goes for
    good if its Cook's distance and its residual exceed these. least: detections that an image keeps. strict: share of the limit for detections of stars that are not anchored."""

    k: float = 5.0
    dead: float = 0.1
    full: float = 15.0863
    short: float = 9.2103
    diffuse: float = 11.3139
    cook: float = 1.0
    sigma: float = 2.0
    least: int = 4
    strict: float = 0.5


class State:
    """What a callback sees after each round, and may replace: ``marks`` (star, image, trusted, used, measured, out, soft), ``stars`` (star, has_pm, anchored, ok), ``priors``; and rows, solution, round."""

    def __init__(self, rows: DataFrame, marks: DataFrame, stars: DataFrame, priors: DataFrame, held: Rounds):
        self.rows, self.marks, self.stars, self.priors, self.held = rows, marks, stars, priors, held
        self.solution: solver.Alignment | None = None
        self.round = 0


def judged_stars(state: State, rules: Rules) -> DataFrame:
    """state.stars with ok judged anew: chi-square of each star's values about its prior, under both covariances, with a limit for stars with motions and one for those without."""
    c = F.col
    seen = state.marks.where("used OR measured").select("star", "image")
    post = solver.conditional(state.rows.join(seen, ["star", "image"]), state.priors, state.solution.r)
    d = post.select("star", "v", "cov_fixed").join(state.priors, "star").join(state.stars, "star")
    upper = {}
    for q, (i, j) in enumerate(zip(*solver.IU5, strict=True)):
        upper[int(i), int(j)] = upper[int(j), int(i)] = c("c")[q] + c("cov_fixed")[q]
    total = F.array(*[upper[i, j] for i in range(5) for j in range(5)])
    wide = sum((c("v")[i] * c("v")[i] / c("c")[q] for i, q in enumerate(DIAGONAL)), F.lit(0.0))
    d = d.select("star", "has_pm", "anchored", "ok", wide.alias("wide"), *[(c("v")[i] - c("v0")[i]).alias(f"d{i}") for i in range(5)], total.alias("cov"))
    d = vector_chi2(d, [f"d{i}" for i in range(5)], "cov")
    used = d.join(state.marks.where("used").select("star").distinct(), "star", "left_semi")
    floor = lambda: F.when(F.first("has_pm"), rules.full).otherwise(rules.short)
    limit = lambda k: F.greatest(adaptive_threshold(c("chi2"), k, 0.0, 0.0), floor())
    limits = used.groupBy("has_pm").agg(limit(rules.k).alias("admit"), limit(rules.k + rules.dead).alias("keep"))
    d = d.join(limits, "has_pm", "left")
    least = F.when(c("has_pm"), rules.full).otherwise(rules.short)
    near = c("chi2") < F.coalesce(F.when(c("ok"), c("keep")).otherwise(c("admit")), least)
    ok = F.coalesce(near & (c("anchored") | (c("wide") < rules.diffuse)), F.lit(False))
    return state.stars.drop("ok").join(d.select("star", ok.alias("ok")), "star", "left").withColumn("ok", F.coalesce("ok", F.lit(True)))


def judged_detections(state: State, rules: Rules) -> DataFrame:
    """state.marks with used judged anew and was, what it was; and cooks_d and sigma_resid."""
    c, key = F.col, ["star", "image"]
    rows = state.rows.join(state.marks.select(*key, (c("used") | c("measured")).alias("used")), key)
    table = solver.influence(rows, state.priors, state.solution).select(*key, "sigma_resid", "cooks_d")
    d = state.marks.join(table, key).join(state.stars.select("star", "ok", "anchored"), "star").withColumn("q", c("sigma_resid") * c("sigma_resid"))
    ref = F.when(c("ok") & c("trusted"), c("q"))
    every = F.when(c("ok"), c("q"))
    limit = lambda k: F.when(F.count(ref) >= 10, adaptive_threshold(ref, k, rules.short, rules.short)).otherwise(adaptive_threshold(every, k, rules.short, rules.short))
    limits = d.groupBy("image").agg(limit(rules.k).alias("admit"), limit(rules.k + rules.dead).alias("keep"))
    d = d.join(limits, "image")
    near = F.when(c("used"), c("q") < c("keep")).otherwise(c("q") < c("admit"))
    strict = c("trusted") | (c("q") < c("admit") * rules.strict)
    new = near & strict & c("ok") & ~c("out") & (c("trusted") | c("used"))
    return d.select(*key, "trusted", c("used").alias("was"), new.alias("used"), F.when(c("trusted"), new).otherwise(c("measured")).alias("measured"), "out", "soft", "sigma_resid", "cooks_d")


def ratchet(marks: DataFrame, rules: Rules) -> DataFrame:
    """marks with those detections out for good whose influence is too large, in images that keep enough."""
    bad = F.col("used") & ~F.col("out") & (F.col("cooks_d") > rules.cook) & (F.col("sigma_resid") > rules.sigma)
    d = marks.withColumn("bad", bad)
    stay = d.groupBy("image").agg((F.count_if(F.col("used") & ~F.col("bad")) >= rules.least).alias("enough"))
    d = d.join(stay, "image").withColumn("bad", F.col("bad") & F.col("enough"))
    return d.select(*[n for n in marks.columns if n not in ("out", "used", "measured")], (F.col("out") | F.col("bad")).alias("out"), (F.col("used") & ~F.col("bad")).alias("used"), (F.col("measured") & ~F.col("bad")).alias("measured"))


class LaterStars:
    """A callback that lets stars which are not anchored in at round ``enable``: until then their detections that lie more than ``far`` pixels off are noted softly, each round; then those ever noted go for good, and the stars that
    keep two detections are measured (their detections give them values, but don't move images). seeds: star, pmra, pmdec, the motions they begin with."""

    def __init__(self, enable: int = 5, far: float = 5.0, seeds: DataFrame | None = None):
        self.enable, self.far, self.seeds = enable, far, seeds

    def __call__(self, state: State) -> None:
        c, key = F.col, ["star", "image"]
        if state.round > self.enable:
            return
        kinds = state.stars.select("star", "anchored")
        if state.round < self.enable:
            r = state.solution.r
            n = len(next(iter(r.values())))
            images = state.rows.sparkSession.createDataFrame([(int(i), [float(x) for x in v]) for i, v in r.items()], "image long, r array<double>")  # a row an image
            dot = lambda row: sum((c(row)[q] * c("r")[q] for q in range(n)), F.lit(0.0))
            off = state.rows.join(images, "image").select(*key, F.hypot(c("bx") - dot("x_row"), c("by") - dot("y_row")).alias("off"))
            d = state.marks.join(off, key).join(kinds, "star")
            new = d.select(*[k for k in state.marks.columns if k != "soft"], (c("soft") + F.when(~c("anchored") & (c("off") > self.far), 1).otherwise(0)).alias("soft"))
        else:
            d = state.marks.join(kinds, "star").withColumn("out", c("out") | (~c("anchored") & (c("soft") > 0)))
            enough = d.where(~c("anchored") & ~c("out")).groupBy("star").agg((F.count("*") >= 2).alias("enough"))
            d = d.join(enough, "star", "left")
            joins = ~c("anchored") & ~c("out") & F.coalesce("enough", F.lit(False))
            new = d.select(*[k for k in state.marks.columns if k != "measured"], F.when(c("anchored"), c("measured")).otherwise(joins).alias("measured"))
            if self.seeds is not None:
                s = self.seeds.select("star", *[F.when(~F.isnan(k), c(k)).alias(k) for k in ("pmra", "pmdec")]).join(enough.where("enough"), "star", "left_semi")
                p = state.priors.join(s, "star", "left")
                both = c("pmra").isNotNull() & c("pmdec").isNotNull()
                v0 = F.when(both, F.array(c("v0")[0], c("v0")[1], c("pmra"), c("pmdec"), c("v0")[4])).otherwise(c("v0"))
                state.priors = state.held.keep(p.select("star", v0.alias("v0"), "c"), f"priors{state.round}")
        state.marks = state.held.keep(new, f"marks-called{state.round % 2}")


def align_phased(rows: DataFrame, star_priors: DataFrame, kinds: DataFrame, rules: Rules = Rules(), most: int = 12, callback: Callable[[State], None] | None = None, least_rounds: int = 2, nu: float | None = None, prefilter: bool = True) -> State:
    """Rounds of solving and judging, until a round changes nothing. kinds: star, has_pm, anchored (its detections may move images from the start) of every star.

    In a round the images are solved with the detections in use; stars are judged by their values (judged_stars), detections by their residuals (judged_detections); where neither changes a detection, the most influential go for
    good (ratchet); then the callback has its turn. With prefilter the first round judges detections only, so that a star isn't blamed for one gross error, and the callback has no turn. Flags of the last kind only grow and the others have a dead band, so rounds end; at least ``least_rounds`` are made."""
    held, key = Rounds(rows.sparkSession), ["star", "image"]
    rows = held.keep(rows, "rows")
    stars = held.keep(kinds.select("star", "has_pm", "anchored").withColumn("ok", F.lit(True)), "stars")
    flags = rows.select(*key).join(stars.select("star", F.col("anchored").alias("trusted")), "star")
    marks = held.keep(flags.select(*key, "trusted", F.col("trusted").alias("used"), F.col("trusted").alias("measured"), F.lit(False).alias("out"), F.lit(0).alias("soft")), "marks")
    state = State(rows, marks, stars, star_priors, held)
    plain = [*key, "trusted", "used", "measured", "out", "soft"]
    for state.round in range(1, most + 1):
        used = state.rows.join(state.marks.where("used").select(*key), key)
        state.solution = solver.align(used, state.priors, state.solution.r if state.solution else None, nu)
        if state.round > 1 or not prefilter:
            state.stars = held.keep(judged_stars(state, rules), "stars")
        new = held.keep(judged_detections(state, rules), "judged")
        changed = not new.where("used <> was").isEmpty()
        if not changed:
            after = held.keep(ratchet(new.drop("was"), rules), "ratchet")
            changed = after.where("out").count() != new.where("out").count()
            new = after
        state.marks = held.keep(new.select(*plain), "marks")
        if callback is not None and (state.round > 1 or not prefilter):  # the first solution still holds gross errors
            before = state.marks
            callback(state)
            changed = changed or state.marks is not before
        if not changed and state.round >= least_rounds:
            break
    state.marks, state.stars = held.add(state.marks, "final-marks"), held.add(state.stars, "final-stars")
    state.priors = held.add(state.priors, "final-priors")
    state.rows = held.add(state.rows, "final-rows")
    held.drop()
    return state
