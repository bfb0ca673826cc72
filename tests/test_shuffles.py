"""What neighbour counts, offset peaks, pairs of images and quality tables send through shuffles, and their rows against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyspark.operators import relational, spatial
from skyspark.plans import tables


def test_neighbour_stats_reads_its_table_twice_only(spark):
    rows = [(1, 1, 5.0, 0.0, 0.0), (1, 2, 4.0, 3.0, 4.0), (1, 3, 6.0, 90.0, 0.0), (1, 4, 6.0, None, 0.0), (2, 1, 5.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k int, i int, mag double, x double, y double")
    out = spatial.neighbour_stats(d, 10.0, "i", "mag", ("k",))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # a third reading for rows without neighbours before
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == [(1, 1, 1, 5.0, 5.0), (1, 2, 1, 5.0, None), (1, 3, 0, None, None), (1, 4, 0, None, None), (2, 1, 0, None, None)]


def test_neighbours_in_tiles_shuffle_rows_once(spark):
    """The rows of neighbour_stats(), whatever the tiles, by one shuffle of the rows and no join; parted by the key already, as the query's are, by none."""
    rng = np.random.default_rng(6)
    rows = [(None if k == 3 else int(k), i, None if i % 17 == 0 else math.nan if i % 19 == 0 else float(i * 7 % 23), None if i % 31 == 0 else float(x), math.nan if i % 29 == 0 else float(y)) for i, (k, x, y) in enumerate(zip(rng.integers(0, 4, 400), rng.uniform(-300, 300, 400), rng.uniform(-90, 90, 400), strict=True))]
    d = spark.createDataFrame(rows, "k int, i int, mag double, x double, y double")
    want = sorted(map(tuple, spatial.neighbour_stats(d, 25.0, "i", "mag", ("k",)).collect()), key=lambda r: r[1])
    for tile in (128.0, 2.0):
        out = spatial.neighbours_in_tiles(d, 25.0, "i", "mag", ("k",), tile=tile)
        assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want
    plan = spatial.neighbours_in_tiles(d.repartition("k"), 25.0, "i", "mag", ("k",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    query = tables.QUERIES["neighbour_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert query.count("Exchange") == 1 and "Join" not in query


def test_offset_peaks_shuffles_no_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(x), float(y)) for k in range(3) for x, y in rng.uniform(0, 300, (80, 2))] + [(7, float("nan"), 1.0), (None, 1.0, 1.0)]
    a = spark.createDataFrame(rows, "k int, x double, y double")
    b = a.where("k < 2 OR k IS NULL").select("k", (F.col("x") * 1.01 + 9).alias("x"), (F.col("y") * 1.01 - 4).alias("y"))
    scales = [-0.01, 0.0, 0.01]
    out = spatial.offset_peaks(a, b, ("k",), 40.0, 3.0, F.array(*map(F.lit, scales)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # the two sides by key; before, bins and boxes too
    want = []
    for k in range(2):
        p = np.array([r[1:] for r in rows if r[0] == k])
        tried = []
        for s in scales:
            bins = Counter((math.floor(u / 3), math.floor(v / 3)) for x, y in p for X, Y in p * 1.01 + (9, -4) if abs(u := X - x * (s + 1)) <= 40 and abs(v := Y - y * (s + 1)) <= 40)
            tried += [(-sum(bins[i + m, j + n] for m in (-1, 0, 1) for n in (-1, 0, 1)), abs(s), s, i, j) for i in range(-15, 15) for j in range(-15, 15)]
        v, _, s, i, j = min(tried)
        want.append((k, s, (i + 0.5) * 3, (j + 0.5) * 3, float(-v)))
    assert sorted(map(tuple, out.collect())) == want


def test_image_pairs_sends_lists_not_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(s), float(m)) for (i, s), m in zip({(a, b) for a, b in rng.integers(0, 12, (90, 2))}, rng.normal(20, 1, 90), strict=False)] + [(1, 1, None), (2, 1, float("nan"))]
    out = relational.image_pairs(spark.createDataFrame(rows, "i long, s long, m double"), "i", "s", "m")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 2  # by star, by image; before, partial medians of all pairs by both images
    by = {(i, s): m for i, s, m in rows if m is not None and m == m}
    diffs = {(a, b): [by[a, s] - by[b, s] for s in range(12) if (a, s) in by and (b, s) in by] for a in range(12) for b in range(12) if a != b}
    got = {(r.a, r.b): (r.zp, r.n) for r in out.collect()}
    assert {k: (pytest.approx(float(np.median(v))), len(v)) for k, v in diffs.items() if len(v) >= 3} == got


def test_source_quality_makes_the_matches_once(spark):
    from skyspark.plans import comparisons

    out = comparisons.QUERIES["source_quality"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in "".join(out.inputFiles()) and out.count()  # four times before


def test_detections_are_dealt_by_image_once(spark):
    from skyspark.plans import catalog

    plan = catalog.queries()["top_n_per_image"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # by l_suppkey and again by image_id before


def test_source_association_makes_the_positions_once(spark):
    from skyspark.plans import sources

    out = sources.QUERIES["source_association"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in "".join(out.inputFiles())  # twice before


def test_reclassified_catalogue_reads_its_table_once_a_step(spark):
    from skyspark.plans import floors

    out = floors.QUERIES["reclassified_catalogue"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 7  # 14 before, by a join of the table with itself


def _kept(rows, radius):
    """Sequential: (k, i, mag, x, y), brightest first; rows without magnitude or finite place stay apart."""
    apart = lambda r: r[2] is None or any(v is None or not math.isfinite(v) for v in r[3:])
    got, kept = {r[:2] for r in rows if apart(r)}, []
    for r in sorted((r for r in rows if not apart(r)), key=lambda r: (r[2] != r[2], r[2] if r[2] == r[2] else 0.0, r[1])):
        if all(r[0] != s[0] or math.sqrt((r[3] - s[3]) ** 2 + (r[4] - s[4]) ** 2) > radius for s in kept):
            kept.append(r)
    return got | {r[:2] for r in kept}


def test_isolated_crosses_tiles_and_keeps_what_has_no_magnitude(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i % 2), i, float(m), float(x), float(y)) for i, (m, x, y) in enumerate(zip(rng.integers(0, 40, 1200) / 4, *rng.uniform(-150, 150, (2, 1200)), strict=True))]
    rows += [(2, i, float(i), 4.0 * i, -3.0 * i) for i in range(60)]  # a chain through many tiles, faintest last
    rows += [(3, i, 1.0, 7.0, 7.0) for i in range(3000)]  # copies
    nan = float("nan")
    rows += [(4, 0, None, 0.0, 0.0), (4, 1, 2.0, 1.0, 0.0), (4, 2, None, 1.0, 1.0), (4, 3, 1.0, nan, 0.0), (4, 4, 1.0, None, 0.0), (4, 5, nan, 2.0, 0.0), (4, 7, nan, 30.0, 0.0), (4, 6, nan, 31.0, 0.0), (4, 8, 5.0, 33.0, float("inf"))]
    d = spark.createDataFrame(rows, "k int, i int, mag double, x double, y double").repartition(3)
    want = _kept(rows, 6.0)
    for tile in (2.0, 9.0, 128.0):
        got = [tuple(r) for r in spatial.isolated_keys(d, 6.0, ("k",), "i", "mag", tile).collect()]
        assert len(got) == len(want) and set(got) == want  # a row without magnitude removed its neighbours before, as if it were the brightest
    assert {(r.k, r.i) for r in spatial.isolated(d, 6.0, ("k",), "i", "mag").collect()} == want


def test_isolated_sends_each_detection_once(spark):
    from skyspark.plans import sources

    sc = spark.sparkContext
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in _stages(sc)}
    before = stages()
    out = sources.QUERIES["isolated_detections"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in "".join(out.inputFiles()) and out.count()
    sent = sum(n for i, n in stages().items() if i not in before)
    assert sent <= spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() + 100  # three times, and at size nine copies of each for the join, before


def _stages(sc):
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none, java = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util
    found = sc._jsc.sc().statusStore().stageList(java.ArrayList(), False, False, none, java.ArrayList()).iterator()
    while found.hasNext():
        yield found.next()
