"""Made fields: laws of the draws, reruns, and the truth found again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyspark.functions import covariance as K
from skyspark.operators import synthetic
from skyspark.plans import adapters


def test_offsets_follow_their_covariance(spark):
    errors = {"ra": 0.3, "dec": 0.2, "pmra": 0.15, "pmdec": 0.1, "parallax": 0.4}
    d = spark.range(20_000).select(F.col("id").alias("source_id"), F.lit(150.0).alias("ra"), F.lit(2.0).alias("dec"), *[F.lit(1.0).alias(k) for k in K.AXES[2:]], *[F.lit(v).alias(f"{k}_error") for k, v in errors.items()], *[F.lit(0.05 * i - 0.2).alias(n) for i, n in enumerate(K.CORRELATIONS.values())])
    t = synthetic.truth(d, 3)
    got = np.cov(np.array([tuple(r) for r in t.select(*synthetic.OFFSETS).collect()]).T)
    c = d.limit(1).select(*[v.alias(f"c{i}{j}") for (i, j), v in K.gaia_covariance(d.columns).items()]).first().asDict()
    want = np.array([[c[f"c{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
    size = np.sqrt(np.outer(np.diag(want), np.diag(want)))
    assert np.abs(got - want).max() < 0.04 * size.max() and (np.abs(got - want) / size).max() < 0.04
    key = lambda df: sorted(tuple(r) for r in df.select("source_id", "v_ra", "v_parallax").collect())
    assert key(synthetic.truth(d.repartition(7), 3)) == key(t) != key(synthetic.truth(d, 4))


def test_modes(spark, sf):
    stars = adapters.view(spark, sf, "stars")
    n, bare = stars.count(), stars.where("pmra IS NULL").count()
    assert synthetic.truth(stars, 1, measured_only=True).count() == n - bare > 0 < bare
    same = synthetic.truth(stars, 1, draw=False)
    assert same.where("v_ra <> 0 OR v_pmra <> 0 OR true_ra <> ra").count() == 0
    assert synthetic.truth(stars, 1, no_parallax=True).where("true_parallax <> 0").count() == 0
    assert synthetic.truth(stars.limit(0), 1).count() == 0


def test_linear_truth(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 4096, (2, 50))
    rows = [(k, float(a), float(b), (1 + k * 1e-3) * (a - 2048) + 0.02 * (b - 2048) + 7, -0.01 * (a - 2048) + 0.99 * (b - 2048) - k) for k in range(3) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    rows += [(9, float(k), 2.0 * k, 1.0, 1.0) for k in range(5)]  # in a line
    got = {r["image"]: r for r in synthetic.linear_truth(spark.createDataFrame(rows, "image int, x double, y double, u double, v double"), "image", "x", "y", "u", "v").collect()}
    for k in range(3):
        assert list(got[k])[2:] == pytest.approx([1 + k * 1e-3, 0.02, 7, -0.01, 0.99, -k], abs=1e-9)
    assert got[9]["true_a"] is None
