"""The growing master list against a plain sequential version, and its reruns."""

import math

import numpy as np
import pandas as pd
import pytest

from skyspark.operators import masterlist as M
from skyspark.plans import adapters
from skyspark.plans import sources as plans

KEYS = {"filter": "string"}


def field(images=8, stars=120, seed=5):
    """Stars over four tiles with motions, seen by images with errors; some are galaxies, some missing, some near one another."""
    rng = np.random.default_rng(seed)
    x, y, mag = rng.uniform(0, 40_000, stars), rng.uniform(0, 40_000, stars), rng.uniform(16, 22, stars)
    n = stars // 6
    x[:n], y[:n] = x[n : 2 * n] + rng.uniform(20, 90, n), y[n : 2 * n] + rng.uniform(-60, 60, n)
    pm, star, rows = rng.normal(0, 5, (stars, 2)), rng.random(stars) < 0.7, []
    for f in ("A", "B"):
        for k in range(images):
            t = 2005 + 1.3 * k
            for i in np.flatnonzero(rng.random(stars) < 0.85):
                e = rng.uniform(0.5, 2.0)
                rows.append((f, 10 * k + 3, int(i) * 7 % 1000, x[i] + pm[i, 0] * (t - 2010) + rng.normal(0, e), y[i] + pm[i, 1] * (t - 2010) + rng.normal(0, e), e, e * 1.1, mag[i] + rng.normal(0, 0.02), 0.02, t, bool(star[i]), int(i)))
    return pd.DataFrame(rows, columns=["filter", "image_order", "det", "x", "y", "sigma_x", "sigma_y", "mag", "mag_err", "epoch", "star", "truth"])


RULES = M.Rules(motion=10.0)


def sequential(df, rules=RULES):
    """{(filter, image_order, det): first detection}, and the sources: every pair compared, no tiles."""
    link, sources = {}, {}
    for f, part in df.groupby("filter"):
        own = []
        for order, image in part.groupby("image_order"):
            used = set()
            for star in (True, False):
                rows = list(image[image.star == star].sort_values("det").itertuples())
                pairs = []
                for d in rows:
                    for n, s in enumerate(own):
                        if n in used:
                            continue
                        a = math.sqrt((1 / s["wx"] + 1 / s["wy"]) / 2)
                        b = math.sqrt((d.sigma_x**2 + d.sigma_y**2) / 2)
                        gap = math.hypot(d.x - s["x"], d.y - s["y"])
                        gate = rules.mag_sigma * (1 if star else rules.relaxed) * math.sqrt(1 / s["wm"] + d.mag_err**2 + rules.floor**2)
                        if gap < rules.sigma * math.sqrt(a * a + b * b + (rules.motion * abs(s["epoch"] - d.epoch)) ** 2) and abs(d.mag - s["mag"]) < gate:
                            pairs.append((gap, s["name"], d.det, n, d))
                done = {}
                for _, _, det, n, d in sorted(pairs, key=lambda p: p[:3]):
                    if n not in used and det not in done:
                        used.add(n)
                        done[det] = n
                for d in rows:
                    w = {"wx": d.sigma_x**-2, "wy": d.sigma_y**-2, "wm": d.mag_err**-2}
                    if d.det in done:
                        s = own[done[d.det]]
                        for v, k in (("epoch", "wx"), ("x", "wx"), ("y", "wy"), ("mag", "wm")):
                            s[v] = (s[k] * s[v] + w[k] * getattr(d, v)) / (s[k] + w[k])
                        for k in w:
                            s[k] += w[k]
                        s["n"] += 1
                    else:
                        used.add(len(own))
                        s = {"name": (order, d.det), "x": d.x, "y": d.y, "mag": d.mag, "epoch": d.epoch, "n": 1} | w
                        own.append(s)
                    link[f, order, d.det] = s["name"]
        sources |= {(f, *s["name"]): s for s in own}
    return link, sources


def links_of(master):
    return {(r["filter"], r["image_order"], r["det"]): (r["first_order"], r["first_det"]) for r in master.links().collect()}


def rows_of(master):
    return sorted(tuple(r) for r in master.sources().collect())


def master(spark, path, halo=4000.0):
    return M.Master(spark, str(path), KEYS, 20_000.0, halo, RULES)


def test_runs_grow_to_what_one_run_makes(spark, tmp_path):
    df = field()
    link, sources = sequential(df)
    one, two = master(spark, tmp_path / "one"), master(spark, tmp_path / "two")
    one.grow(spark.createDataFrame(df))
    assert links_of(one) == link and len(link) == len(df)
    got = {tuple(r[k] for k in ("filter", "first_order", "first_det")): r for r in one.sources().collect()}
    assert got.keys() == sources.keys() and one.torn() == 0
    for k, s in sources.items():
        assert got[k]["n_detect"] == s["n"]
        assert [got[k][c] for c in M.MEANS] == pytest.approx([s[c] for c in M.MEANS], rel=1e-12)
    # Nearly all sources are one star's detections.
    named = df.assign(name=[link[k] for k in zip(df["filter"], df["image_order"], df["det"], strict=True)])
    assert (named.groupby(["filter", "name"])["truth"].nunique() == 1).mean() > 0.97

    early = spark.createDataFrame(df[df.image_order < 40])
    two.grow(early)
    two.grow(spark.createDataFrame(df))  # the early images again, which changes nothing, and the late ones
    assert rows_of(two) == rows_of(one) and links_of(two) == link
    two.grow(early)
    two.compact()
    assert rows_of(two) == rows_of(one) and links_of(two) == link and two.torn() == 0
    assert [f.rsplit("/", 1)[1] for f in M.committed(spark, str(tmp_path / "two"))[0]] == ["base-000002"]


def test_a_run_without_status_is_written_anew(spark, tmp_path):
    df = field(images=3, stars=30)
    m = master(spark, tmp_path / "m")
    m.grow(spark.createDataFrame(df))
    whole = rows_of(m)
    for f in sorted((tmp_path / "m" / "run-000000_status").iterdir()):
        f.unlink()
    assert rows_of(m) == [] and m.torn() == 0
    m.grow(spark.createDataFrame(df))
    assert rows_of(m) == whole


def test_odd_rows(spark, tmp_path):
    df = field(images=3, stars=30)
    m = master(spark, tmp_path / "m")
    m.grow(spark.createDataFrame(df).limit(0))
    assert rows_of(m) == [] and m.links().count() == 0
    odd = df.copy()
    odd.loc[:5, "x"] = np.nan
    odd["run"], odd["n_detect"] = 7, 9  # names of its own columns
    twice = pd.concat([odd, odd])
    m.grow(spark.createDataFrame(twice))
    assert m.links().count() == len(df) - 6 and m.torn() == 0
    with pytest.raises(ValueError):
        master(spark, tmp_path / "n", halo=0.0)


def test_query_is_the_sequential_list(spark, sf):
    df = plans.master_input(*[adapters.view(spark, sf, v) for v in ("matched", "stars", "images")]).toPandas()
    _, sources = sequential(df, plans.MASTER_RULES)
    got = {(r["filter"], r["first_order"], r["first_det"]): r for r in plans.QUERIES["master_list"](spark, sf).collect()}
    assert got.keys() == sources.keys() and len(got) > 100
    for k, s in sources.items():
        assert got[k]["n_detect"] == s["n"] and [got[k][c] for c in ("x", "y", "mag")] == pytest.approx([s[c] for c in ("x", "y", "mag")], abs=1e-5)


def test_an_image_meets_only_the_sources_near_it(monkeypatch):
    """What an image costs must not grow with the sources of the tile; errors of any size are seen."""
    rng = np.random.default_rng(2)
    kinds = {"long": np.int64, "boolean": bool}
    state = {c.split()[0]: np.zeros(0, kinds.get(c.split()[1], float)) for c in M.STATE.split(", ")}
    n, images = 3000, 200
    k = np.repeat(np.arange(images), n // images)
    error = np.where(rng.random(n) < 0.02, 800.0, rng.uniform(0.5, 2, n))
    x, y = rng.uniform(0, 20_000, n // 2), rng.uniform(0, 20_000, n // 2)
    at = rng.integers(0, n // 2, n)
    det = {"image_order": k, "det": np.arange(n), "x": x[at] + rng.normal(0, 1, n), "y": y[at] + rng.normal(0, 1, n), "sigma_x": error, "sigma_y": error, "mag": 16 + at % 50 * 0.1, "mag_err": np.full(n, 0.02), "epoch": 2000 + k * 0.05, "star": at % 3 > 0}
    seen, around = [], M.Grid.around
    monkeypatch.setattr(M.Grid, "around", lambda self, *a: [seen.append(j) or j for j in around(self, *a)])
    s, own = M.fold(state, det, RULES)
    assert len(seen) < 60 * n
    df = pd.DataFrame({**det, "filter": "A"})
    link, sources = sequential(df)
    assert [(s["first_order"][j], s["first_det"][j]) for j in own] == [link["A", a, b] for a, b in zip(k, det["det"], strict=True)]
    assert len(s["x"]) == len(sources) < n
