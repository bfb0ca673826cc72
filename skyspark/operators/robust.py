"""Robust statistics of groups. Medians are exact; sums combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1.4826


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def mad(df: DataFrame, keys: list[str], value: str, scale: float = 1.0) -> DataFrame:
    """keys, n, median and the (scaled) median absolute deviation of a value."""
    med = df.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("median"))
    dev = df.join(med.select(*keys, "median"), keys).groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("median"))) * scale).alias("mad"))
    return med.join(dev, keys)


def weighted_mean(value: Column, error: Column) -> tuple[Column, Column]:
    """Aggregates: inverse-variance mean and its error."""
    w = 1 / (error * error)
    return F.sum(w * value) / F.sum(w), 1 / F.sqrt(F.sum(w))


def half_width(value: Column) -> Column:
    """Aggregate: half the distance between the 16th and 84th percentile."""
    p = F.percentile(value, F.array(F.lit(0.16), F.lit(0.84)))
    return (p[1] - p[0]) / 2


def adaptive_threshold(value: Column, k: float, floor: float, fallback: float, least: int = 10) -> Column:
    """Aggregate: median plus k lower half-widths, at least floor; fallback for small groups."""
    p = F.percentile(value, F.array(F.lit(0.16), F.lit(0.5)))
    return F.when(F.count(value) < least, fallback).otherwise(F.greatest(p[1] + F.greatest(p[1] - p[0], F.lit(1e-6)) * k, F.lit(floor)))


def clipped_median(df: DataFrame, keys: list[str], value: str, sigma: float = 3.5, least: int = 3) -> DataFrame:
    """keys, median of what lies within sigma scaled deviations; the plain median where fewer than ``least`` are left."""
    base = mad(df, keys, value, SCALE)
    near = F.when(F.abs(F.col(value) - F.col("median")) <= F.col("mad") * sigma, F.col(value))
    out = df.join(base, keys).groupBy(*keys).agg(F.first("median").alias("plain"), F.median(near).alias("clipped"), F.count(near).alias("kept"))
    return out.select(*keys, F.when(F.col("kept") >= least, F.col("clipped")).otherwise(F.col("plain")).alias("median"), F.col("kept"))


def source_magnitudes(df: DataFrame, star: str, image: str, mag: str, err: str, outlier: float = 3.0) -> DataFrame:
    """Per star over images: n, median, deviation, weighted mean and error, number of consistent images and sorted outliers. Errors get a floor of 0.01 mag."""
    rows = df.select(star, image, F.col(mag).alias("m"), (F.greatest(F.col(err), F.lit(1e-4)) + 0.01).alias("e"))
    mean, error = weighted_mean(F.col("m"), F.col("e"))
    one = rows.groupBy(star).agg(F.count("*").alias("n_same_filter"), F.median("m").alias("mag_norm_median"), mean.alias("mag_norm_wmean"), error.alias("mag_norm_werr"))
    out = F.abs((F.col("m") - F.col("mag_norm_wmean")) / F.col("e")) > outlier
    two = rows.join(one.select(star, "mag_norm_median", "mag_norm_wmean"), star).groupBy(star).agg(F.median(F.abs(F.col("m") - F.col("mag_norm_median"))).alias("mag_norm_mad"), F.count(F.when(~out, 1)).alias("n_consistent"), F.array_sort(F.collect_list(F.when(out, F.col(image)))).alias("outlier_images"))
    return one.join(two, star)


def zero_points(df: DataFrame, image: str, group: str, difference: str, least: int = 5) -> DataFrame:
    """Per image the median difference, or its group's median of medians, or the overall one, where it has fewer than ``least``."""
    own = df.groupBy(image, group).agg(F.count(difference).alias("n"), F.median(difference).alias("own"))
    good = own.where(F.col("n") >= least)
    by_group, overall = good.groupBy(group).agg(F.median("own").alias("of_group")), good.agg(F.median("own").alias("overall"))
    return own.join(by_group, group, "left").crossJoin(F.broadcast(overall)).select(image, group, "n", F.coalesce(F.when(F.col("n") >= least, F.col("own")), F.col("of_group"), F.col("overall")).alias("zp"))


def mode_zero_point(df: DataFrame, image: str, difference: str, width: float = 0.05, span: float = 1.0, near: float = 0.15) -> DataFrame:
    """Per image the peak of a smoothed histogram of the differences, refined by the median near it."""
    d = df.where(F.abs(F.col(difference)) < span).withColumn("bin", F.floor(F.col(difference) / width).cast("long"))
    counts = d.groupBy(image, "bin").agg(F.count("*").alias("n"))
    # [1, 2, 1] / 4 over neighbouring bins, also of bins that are empty themselves.
    spread = counts.select(image, F.explode(F.array(*[F.struct((F.col("bin") + k).alias("bin"), (F.col("n") * w).alias("w")) for k, w in ((-1, 0.25), (0, 0.5), (1, 0.25))])).alias("s"))
    smooth = spread.groupBy(image, "s.bin").agg(F.sum("s.w").alias("w"))
    peak = smooth.groupBy(image).agg(F.max_by("bin", F.struct(F.col("w"), -F.col("bin"))).alias("peak")).withColumn("peak", (F.col("peak") + 0.5) * width)
    return df.join(peak, image).where(F.abs(F.col(difference) - F.col("peak")) < near).groupBy(image).agg(F.first("peak").alias("peak"), F.count("*").alias("n"), F.median(difference).alias("zp"))


def reject_outliers(df: DataFrame, star: str, mag: str, err: str, factor: float = 5.0, floor: float = 0.5, least: int = 3, keep: int = 2) -> DataFrame:
    """Per star the weighted mean without magnitudes beyond max(factor scaled deviations, floor); all stay if fewer than ``keep`` would, or there are fewer than ``least``."""
    mean, _ = weighted_mean(F.col(mag), F.col(err))
    base = mad(df, [star], mag, SCALE).join(df.groupBy(star).agg(mean.alias("first_mean")), star)
    ok = (F.col("n") < least) | (F.abs(F.col(mag) - F.col("first_mean")) <= F.greatest(F.col("mad") * factor, F.lit(floor)))
    marked = df.join(base, star).withColumn("ok", ok)
    w = 1 / (F.col(err) * F.col(err))
    out = marked.groupBy(star).agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"), F.sum(w).alias("w"), F.sum(w * F.col(mag)).alias("wm"), F.sum(F.when(F.col("ok"), w)).alias("wk"), F.sum(F.when(F.col("ok"), w * F.col(mag))).alias("wmk"))
    enough = F.col("n_ok") >= keep
    return out.select(star, "n", F.when(enough, F.col("n_ok")).otherwise(F.col("n")).alias("n_used"), F.when(enough, F.col("wmk") / F.col("wk")).otherwise(F.col("wm") / F.col("w")).alias("mag"))


def global_median(df: DataFrame, value: Column, accuracy: int = 20_000) -> float | None:
    """The exact median of all rows' finite values; None without any.

    No task holds all values: a mergeable sketch first brackets the middle, rows outside the bracket are counted, and only those inside, about a ``accuracy`` / 4-th of them, are sorted, in range partitions."""
    d = df.select(value.cast("double").alias("v")).where(finite(F.col("v")))
    n, low, high = d.agg(F.count("*"), F.percentile_approx("v", 0.5 - 2 / accuracy, accuracy), F.percentile_approx("v", 0.5 + 2 / accuracy, accuracy)).first()
    if not n:
        return None
    wanted = sorted({(n - 1) // 2, n // 2})
    below, inside = d.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
    if below > wanted[0] or below + inside <= wanted[-1]:  # the sketch erred by more than its accuracy
        low, high, below = float("-inf"), float("inf"), 0
    counts = d.where(F.col("v").between(low, high)).groupBy("v").count()
    run = Window.partitionBy("part").orderBy("v")
    ranged = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()).persist()
    try:
        found, passed = [], below
        for part, total in sorted(map(tuple, ranged.groupBy("part").agg(F.sum("count")).collect())):  # a row per partition
            for k in wanted:
                if passed <= k < passed + total:
                    upto = ranged.where(F.col("part") == part).withColumn("upto", F.sum("count").over(run))
                    found.append(upto.where(F.col("upto") > k - passed).agg(F.min("v")).first()[0])
            passed += total
    finally:
        ranged.unpersist()
    return sum(found) / len(found)


def limits(df: DataFrame, x: str, y: str, sigma: float = 4.0, least: float = 0.1) -> DataFrame:
    """One row: plot limits about the medians of two columns, with one half-width."""
    mx, my = (global_median(df, F.col(c)) for c in (x, y))
    spread = [0.0 if m is None else global_median(df, F.abs(F.col(c) - m)) * SCALE for c, m in ((x, mx), (y, my))]
    half = max(*spread, least) * sigma
    edges = [None if m is None else m + s * half for m in (mx, my) for s in (-1, 1)]
    return df.sparkSession.createDataFrame([tuple(edges)], "x_low double, x_high double, y_low double, y_high double")


def extent(df: DataFrame, ra: str, dec: str, pad: float = 0.05) -> DataFrame:
    """One row: padded extent; RA runs from high to low."""
    a = df.agg(F.min(ra).alias("r0"), F.max(ra).alias("r1"), F.min(dec).alias("d0"), F.max(dec).alias("d1"))
    pr, pd = (F.col("r1") - F.col("r0")) * pad, (F.col("d1") - F.col("d0")) * pad
    return a.select((F.col("r1") + pr).alias("ra_left"), (F.col("r0") - pr).alias("ra_right"), (F.col("d0") - pd).alias("dec_low"), (F.col("d1") + pd).alias("dec_high"))


def pulls(df: DataFrame, keys: list[str], residual: Column, sigma: Column) -> DataFrame:
    """Per group n, mean and sample deviation of residual / sigma."""
    p = residual / sigma
    return df.groupBy(*keys).agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"))


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn("ecdf", F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)))


def running_medians(df: DataFrame, value: str, x: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Per bin of x: n, centre, median and half-width of a value, and the median smoothed over neighbouring bins (1, 2, 1)."""
    keys = keys or []
    b = df.withColumn("bin", F.floor(F.col(x) / width).cast("long")).groupBy(*keys, "bin").agg(F.count(value).alias("n"), F.median(value).alias("median"), half_width(F.col(value)).alias("half_width"))
    w = Window.partitionBy(*keys).orderBy("bin")
    before, after = F.lag("median").over(w), F.lead("median").over(w)
    smooth = (F.col("median") * 2 + F.coalesce(before, F.col("median")) + F.coalesce(after, F.col("median"))) / 4
    return b.select(*keys, "bin", ((F.col("bin") + 0.5) * width).alias("centre"), "n", "median", "half_width", smooth.alias("smooth"))
