"""Image matching, searches and photometric classification against brute force and planted truth."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyspark.functions import text as T
from skyspark.operators import association, compare, imagematch, photometry, solver
from skyspark.sources import catalog, field
from skyspark.sources import fits as fits_files


def turned(z, scale, degrees, shift):
    return z * scale * np.exp(1j * math.radians(degrees)) + shift


@pytest.mark.parametrize("way", ["offset", "triangles", "pairs"])
def test_first_match(way):
    """Lists that share half their points: a pure shift, a turn that only triangles see, and one with magnitudes of no use."""
    rng = np.random.default_rng(7)
    z = rng.uniform(0, 1500, 40) + 1j * rng.uniform(0, 1500, 40)
    m = np.sort(rng.uniform(15, 20, 40))
    degrees, shift = (0.0, 40 - 25j) if way == "offset" else (35.0, 300 + 100j)
    w = turned(z, 1.0, degrees, shift) + rng.normal(0, 0.05, 40)
    n = m.copy() if way != "pairs" else np.where(np.arange(40) < 25, rng.permutation(40) * 0.01 + 15, 30.0)
    i, j = imagematch.first_match(z.real, z.imag, m, w.real, w.imag, n, turns=(-180, 180))
    assert len(i) >= 8 and (i == j).mean() >= 0.9
    none = imagematch.first_match(z.real, z.imag, m, w.real * 3, w.imag * 3, n)
    assert len(none[0]) == 0


def test_near_and_firsts():
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 100, (2, 60)), rng.uniform(0, 100, (2, 80))
    i, j, d = imagematch.near(a[0], a[1], b[0], b[1], 9.0, 3)
    want = []
    for k in range(60):
        far = np.hypot(b[0] - a[0][k], b[1] - a[1][k])
        want += [(k, int(q)) for q in np.argsort(far, kind="stable")[:3] if far[q] < 9.0]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want and np.allclose(d, np.hypot(b[0][j] - a[0][i], b[1][j] - a[1][i]))
    cost, g, h = rng.integers(0, 9, 50) / 2, rng.integers(0, 8, 50), rng.integers(0, 8, 50)
    f = pd.DataFrame({"c": cost, "g": g, "h": h}).sort_values("c", kind="stable").drop_duplicates("g").drop_duplicates("h")
    assert sorted(imagematch.firsts(cost, g, h).tolist()) == sorted(f.index.tolist())


@pytest.mark.parametrize("scale", [1.0, 1.01])
def test_match_images_recovers_planted(spark, scale):
    """Two images with junk, missing detections and magnitudes off by a zero point; one image with nothing in common."""
    rng = np.random.default_rng(5)
    star = pd.DataFrame({"image": "a", "star": np.arange(200) + 10**15, "x": rng.uniform(100, 3900, 200), "y": rng.uniform(100, 3900, 200), "mag": rng.uniform(15, 21, 200), "cxx": 1e-4, "cxy": 0.0, "cyy": 1e-4, "has_pm": rng.random(200) < 0.8})
    rows, truth = [], {}
    for name, degrees, shift in (("a", 0.05, 12 - 8j), ("b", -0.08, -30 + 20j), ("none", 0.0, 0.0)):
        z = star.x.to_numpy() - 2048 + 1j * (star.y.to_numpy() - 2048)
        w = turned(z, 1 / scale, degrees, shift) + 2048 + 2048j + rng.normal(0, 0.01, 200) + 1j * rng.normal(0, 0.01, 200)
        if name == "none":
            w = rng.uniform(0, 4096, 200) + 1j * rng.uniform(0, 4096, 200)
        seen = np.flatnonzero(rng.random(200) < 0.7)
        junk = rng.uniform(0, 4096, (60, 2))
        rows.append(pd.DataFrame({"image": name, "det": np.arange(len(seen) + 60), "x": np.r_[w.real[seen], junk[:, 0]], "y": np.r_[w.imag[seen], junk[:, 1]], "mag": np.r_[star.mag.to_numpy()[seen] - 2.5 + rng.normal(0, 0.02, len(seen)), rng.uniform(12, 19, 60)], "cxx": 1e-4, "cxy": 0.0, "cyy": 1e-4, "qfit": np.r_[rng.uniform(0.02, 0.3, len(seen)), rng.uniform(0.02, 2, 60)], "chi2": 1.0, "is_star": True}))
        truth[name] = (degrees, dict(zip(range(len(seen)), star.star.to_numpy()[seen], strict=True)))
    det = spark.createDataFrame(pd.concat(rows))
    stars = spark.createDataFrame(pd.concat([star.assign(image=k) for k in truth]))
    out = imagematch.match_images(det, stars, "image", imagematch.Options(scale=scale)).toPandas()
    for name in ("a", "b"):
        own, (degrees, pairs) = out[out.image == name], truth[name]
        assert own.ratio.iloc[0] == pytest.approx(scale, abs=2e-5) and own.rot_deg.iloc[0] == pytest.approx(degrees, abs=2e-3) and own.zp.iloc[0] == pytest.approx(2.5, abs=0.05)
        right = sum(pairs.get(d) == s for d, s in zip(own.det, own.star, strict=True))
        assert right >= 0.95 * len(pairs) and right >= 0.97 * len(own)
    assert (out.image != "none").all()
    assert imagematch.match_images(det.where("false"), stars.where("false"), "image").count() == 0


def test_anchor_is_sequential(spark):
    rng = random.Random(4)
    pairs = [(i, s, s * 7 % 20, d, rng.randrange(1, 40) / 4, rng.random() < 0.6) for i in range(2) for s in range(20) for d in range(25) if rng.random() < 0.5]
    got = {(r.image, r.star, r.det) for r in association.anchor(spark.createDataFrame(pairs, "image int, star int, rank int, det int, distance double, ok boolean"), "image", "star", "det", "rank", 3).collect()}
    want = set()
    for i in range(2):
        taken = set()
        for s in sorted(range(20), key=lambda s: (s * 7 % 20, s)):
            free = sorted((far, d, ok) for im, st, _, d, far, ok in pairs if (im, st) == (i, s) and d not in taken)[:3]
            hit = next((d for _, d, ok in free if ok), None)
            if hit is not None:
                taken.add(hit)
                want.add((i, s, hit))
    assert got == want


def test_image_order(spark):
    rng = np.random.default_rng(8)
    rows = [(f, f"i{k:02}", float(150 + rng.uniform(0, 0.2)), float(2 + rng.uniform(0, 0.2)), float(rng.uniform(50000, 60000)), k == 3) for f in "AB" for k in range(12)]
    got = {}
    for r in association.image_order(spark.createDataFrame(rows, "filter string, image string, ra double, dec double, mjd double, first boolean"), "filter", "first").orderBy("filter", "place").collect():
        got.setdefault(r.filter, []).append(r.image)
    for f in "AB":
        left = {r[1]: r[2:5] for r in rows if r[0] == f}
        seed = left.pop("i03")
        taken, order = [seed], ["i03"]
        while left:
            def score(k):
                near = min(math.hypot((left[k][0] - t[0]) * math.cos(math.radians(seed[1])), left[k][1] - t[1]) for t in taken)
                return (max(0, 1 - near / (4 / 60)) + 1e-3) * math.exp(-abs(left[k][2] - seed[2]) / 365.25 / 5)

            best = min(left, key=lambda k: (-score(k), k))
            order.append(best)
            taken.append(left.pop(best))
        assert got[f] == order


def catalogue(rng, n):
    mag = rng.uniform(16, 24, n)
    star = rng.random(n) < 0.8
    conc = [np.where(star, 1 + rng.normal(0, 0.02, n), rng.uniform(0.3, 2.5, n)) for _ in range(3)]
    conc[1][rng.random(n) < 0.1] = np.nan
    qfit = np.where(star, 0.02 + 10 ** ((mag - 24) / 3) * rng.uniform(0.5, 1.5, n), rng.uniform(0.2, 3, n))
    qfit[rng.random(n) < 0.02] = np.nan
    return mag, qfit, conc, star


def slow_stars(mag, qfit, conc):
    """The classification row by row and bin by bin."""
    n = len(mag)

    def binned(rows, value, summary):
        low, high = min(mag[i] for i in rows), max(mag[i] for i in rows)
        edges = [low]
        while edges[-1] < high:
            edges.append(low + 0.5 * len(edges))
        if edges[-1] == high:  # np.arange leaves its end out
            edges.append(low + 0.5 * len(edges))
        out = []
        for a, b in zip(np.arange(low, high + 0.5, 0.5)[:-1], np.arange(low, high + 0.5, 0.5)[1:], strict=True):
            x = [value[i] for i in rows if a <= mag[i] < b]
            if len(x) >= 5:
                out.append(((a + b) / 2, *summary(x)))
        return out

    def at(table, k, m):
        return float(np.interp(m, [t[0] for t in table], [t[k] for t in table]))

    ok = [math.isfinite(q) and q < 1.5 for q in qfit]
    rows = [i for i in range(n) if math.isfinite(qfit[i])]
    table = binned(rows, qfit, lambda x: (min(float(np.percentile(x, 25)) * 4, 1.5),))
    if len(table) >= 2:
        ok = [ok[i] and qfit[i] < at(table, 1, mag[i]) for i in range(n)]
    star = [ok[i] and (math.isnan(conc[1][i]) or 0.75 <= conc[1][i] <= 1 / 0.75) for i in range(n)]
    for _ in range(10):
        new = list(ok)
        for c in conc:
            rows = [i for i in range(n) if star[i] and math.isfinite(c[i]) and 0.5 <= c[i] <= 2.0]
            table = []
            if len(rows) >= 5:
                table = binned(rows, c, lambda x: (np.median(x) - 4 * max((np.percentile(x, 84) - np.percentile(x, 16)) / 2, 0.01), np.median(x) + 4 * max((np.percentile(x, 84) - np.percentile(x, 16)) / 2, 0.01)))
            for i in range(n):
                lo, hi = (at(table, 1, mag[i]), at(table, 2, mag[i])) if len(table) >= 2 else (0.75, 1 / 0.75)
                new[i] = new[i] and (math.isnan(c[i]) or lo <= c[i] <= hi)
        if new == star:
            break
        star = new
    return np.array(star)


def test_star_classification(spark):
    rng = np.random.default_rng(2)
    frames = []
    for name, n in (("a", 900), ("b", 400), ("few", 4)):
        mag, qfit, conc, star = catalogue(rng, n)
        assert (photometry.star_rows(mag, qfit, conc) == slow_stars(mag, qfit, conc)).all()
        if n > 100:
            assert (photometry.star_rows(mag, qfit, conc) & star).sum() >= 0.8 * star.sum()
        flux = 10 ** ((32 - mag) / 2.5)
        frames.append(pd.DataFrame({"image": name, "flux": flux, "mag": mag, "qfit": qfit, "chi2": np.where(star, 1 + (flux / flux.max()) + rng.normal(0, 0.1, n), 8.0), **dict(zip(photometry.CONCENTRATIONS, conc, strict=True))}))
    out = photometry.classified(spark.createDataFrame(pd.concat(frames)), "image", 32.0).toPandas()
    for frame in frames:
        own = out[out.image == frame.image.iloc[0]].sort_values("mag")
        frame = frame.sort_values("mag")
        star = photometry.star_rows(frame.mag.to_numpy(), frame.qfit.to_numpy(), [frame[c].to_numpy() for c in photometry.CONCENTRATIONS])
        assert (own.is_star_candidate.to_numpy() == star).all()
        assert np.allclose(own.chi2_scale, photometry.chi2_scales(frame.flux.to_numpy(), frame.chi2.to_numpy(), frame.qfit.to_numpy(), star, 32.0))


def test_chi2_bins_and_scales():
    rng = np.random.default_rng(6)
    mag = np.sort(rng.uniform(16, 22, 1500))
    chi2 = 1 + 0.5 * (22 - mag) / 6 + rng.normal(0, 0.05, 1500)
    mags, smoothed, raw, err, more, values = photometry.chi2_bins(mag, chi2)
    assert (np.diff(mags) > 0).all() and np.abs(smoothed - (1 + 0.5 * (22 - mags) / 6)).max() < 0.06 and (err >= 0.01).all() and len(raw) == len(mags)
    assert (more < mags[0]).all() and more[0] <= mag[0] and (values >= smoothed[0] - 0.1).all()
    assert photometry.chi2_bins(mag[:40], chi2[:40]) is None
    flux = 10 ** ((32 - mag) / 2.5)
    odd = np.r_[chi2[:-2], 9.0, np.nan]
    scale = photometry.chi2_scales(flux, odd, np.full(1500, 0.1), np.ones(1500, bool), 32.0)
    assert scale[-2] == 9.0 and scale[-1] == 1.0 and np.abs(scale[:-2] - (1 + 0.5 * (22 - mag[:-2]) / 6)).max() < 0.15


def test_monotone_cubic():
    x, y = np.array([0.0, 1.0, 2.5, 4.0, 5.0]), np.array([0.0, 1.0, 1.2, 3.0, 2.0])
    q = np.linspace(-1, 6, 700)
    v = photometry.monotone_cubic(x, y, q)
    assert np.allclose(photometry.monotone_cubic(x, y, x), y) and v[0] == 0 and v[-1] == 2
    up = (q >= 0) & (q <= 4)
    assert (np.diff(v[up]) >= -1e-12).all() and v.max() <= 3 + 1e-12


def test_vector_chi2(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(6, 3, 3))
    cov, d = a @ a.transpose(0, 2, 1) + np.eye(3), rng.normal(size=(6, 3))
    rows = [(i, *map(float, d[i]), [float(x) for x in cov[i].ravel()]) for i in range(6)] + [(6, None, 1.0, 1.0, [1.0] * 9), (7, 1.0, 1.0, 1.0, [0.0] * 9), (8, 1.0, 1.0, 1.0, None)]
    got = {r.i: r.chi2 for r in compare.vector_chi2(spark.createDataFrame(rows, "i int, a double, b double, c double, cov array<double>"), ["a", "b", "c"], "cov").collect()}
    assert all(got[i] == pytest.approx(d[i] @ np.linalg.inv(cov[i]) @ d[i]) for i in range(6)) and [got[i] for i in (6, 7, 8)] == [None] * 3


def test_corrected_inputs(spark, tmp_path):
    """Slices dense at the faint end, the complete row of an id, texts of CLEAR only, and both separators."""
    edges = [5.0, 11.3984, 15.3885, 17.8769, 19.4287, 20.3965, 21.0]
    slices = catalog.magnitude_slices(5, 21, 7 / (16 * 21**2 * 5e-5))
    assert [a for a, _ in slices] == pytest.approx(edges[:-1], abs=1e-3) and [b for _, b in slices] == pytest.approx(edges[1:], abs=1e-3)
    assert catalog.magnitude_slices(10, 12, 0.01) == [(10, 12)]
    (tmp_path / "a.csv").write_text("source_id,ra,dec,gmag,bpmag,rpmag\n7,,2.0,15,16,15\n7,1.0,2.0,15,16,15\n8,1.0,2.0,15,,15\n")
    assert [(r.source_id, r.ra, r.bp_rp) for r in catalog.read_catalogue(spark, str(tmp_path)).collect()] == [(7, 1.0, 1.0)]
    assert catalog.read_catalogue(spark, str(tmp_path), complete=False).count() == 2
    r = spark.range(1).select(T.clean_filter(F.lit(" CLEAR1L; CLEAR2S ")).alias("a"), T.clean_filter(F.lit("F1;F2"), True).alias("b"), T.names(F.lit("a; b,a")).alias("c"), T.names(F.lit(None).cast("string")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("CLEAR1L; CLEAR2S", "F2", ["a", "b"], [])


@pytest.mark.parametrize("telescope", [field.HST, field.JWST])
def test_field_round_trip(spark, tmp_path, telescope):
    """A small field's folder, loaded, saved as a checkpoint and loaded again; its fit's results too."""
    rng = np.random.default_rng(3)
    (tmp_path / "gaia").mkdir()
    (tmp_path / "gaia" / "g.csv").write_text("source_id,ra,dec,gmag,bp_rp,pmra,pmdec,parallax\n" + "".join(f"{10**18 + k},{150 + k * 1e-3},{2 + k * 1e-3},17,1,1,1,0.1\n" for k in range(30)))
    for name, shift in (("one", 0.0), ("two", 1.0)):
        d = tmp_path / "images" / name
        d.mkdir(parents=True)
        times = {"EXPSTART": 55000.0 + shift, "EXPEND": 55001.0 + shift} if telescope is field.HST else {"MJD-BEG": 55000.0 + shift, "MJD-END": 55001.0 + shift}
        fits_files.write(str(d / f"{name}{telescope.suffix}.fits"), [(np.zeros((4, 4)), {"EXTNAME": "SCI", "EXTVER": 1, "CD1_1": -1.39e-5, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 1.39e-5, "JWST_X": field.KM_PER_AU})], primary={"INSTRUME": "ACS", "DETECTOR": "WFC", "FILTER1": "CLEAR1L", "FILTER2": "F814W", **times})
        fits_files.write(str(d / f"{name}{telescope.suffix}_catalog.fits"), rows=pd.DataFrame({"x": rng.uniform(0, 4000, 25), "y": rng.uniform(0, 4000, 25), "x_gdc": rng.uniform(0, 4000, 25), "y_gdc": rng.uniform(0, 4000, 25), "cov_xx_gdc": 1e-4, "cov_yy_gdc": 1e-9, "cov_xy_gdc": 1e-3, "mag": 20.0, "qfit": 0.1, "n_sat": np.r_[np.zeros(24), 40.0]}))
        pick = rng.permutation(25)[:20]
        pick = np.unique(np.r_[pick, 24])
        (d / "matched_gaia.csv").write_text(f"{telescope.index},gaia_source_id,residual_mag,has_gaia_pms\n" + "".join(f"{i},{10**18 + int(i)},0.1,True\n" for i in pick))
        (d / "transformation.csv").write_text("parameter,value\n" + "".join(f"{k},{v}\n" for k, v in {"A": 1.0, "B": 0.0, "C": 0.0, "D": 1.0, "xs_o": 2000.0, "ys_o": 2000.0, "xt_o": 2010.0, "yt_o": 1990.0, "x_cen": 2048.0, "y_cen": 2048.0, "ra_cen": 150.0, "dec_cen": 2.0, "orientat": 0.0}.items()))
    f = field.load_field(spark, str(tmp_path / "images"), str(tmp_path / "gaia"), telescope)
    im = {r.image_name: r for r in f["images"].collect()}
    assert set(im) == {"one", "two"} and im["two"].epoch_mjd == 55001.5 and im["one"].filter == "F814W"
    assert im["one"].pixel_scale_mas == pytest.approx(1.39e-5 * 3.6e6) and (im["one"].w, im["one"].z) == pytest.approx((10.0, -10.0)) and im["one"].ox == pytest.approx(1.0) and im["one"].oy is None
    det = f["detections"].toPandas()
    assert (det.source_id - 10**18 == det.catalog_index).all() and (det.use_for_fit == (det.catalog_index != 24)).all()
    assert (det.sy == field.LEAST_ERROR).all() and (det.rho == 0.9999).all()
    assert {r.source_id for r in f["stars"].collect()} == set(det.source_id)
    with pytest.raises(FileNotFoundError):
        field.load_inputs(spark, str(tmp_path / "none"))
    field.save_inputs(str(tmp_path / "saved"), f)
    again = field.load_inputs(spark, str(tmp_path / "saved"))
    assert sorted(map(str, again["detections"].select(*f["detections"].columns).collect())) == sorted(map(str, f["detections"].collect())) and again["stars"].count() == f["stars"].count()
    c = rng.normal(size=(16, 16))
    one = solver.Alignment([1, 2], {1: np.arange(8.0), 2: -np.arange(8.0)}, c @ c.T, 3, True)
    field.save_results(str(tmp_path / "fit"), spark, one, again["stars"].select("source_id"))
    back, posteriors = field.load_results(spark, str(tmp_path / "fit"))
    assert np.allclose(back.cov, one.cov) and (back.r[2] == one.r[2]).all() and back.converged and posteriors.count() == again["stars"].count()
    path = field.write_catalogue(f["detections"].select("source_id", "x", "use_for_fit"), str(tmp_path / "cat"))
    assert path.endswith(".fits") and fits_files.read_table(spark, path, "source_id long, x double").agg(F.max("source_id")).first()[0] == int(det.source_id.max())
    assert field.write_catalogue(f["images"], str(tmp_path / "text"), "csv").endswith(".csv")
    with pytest.raises(ValueError, match="write csv"):
        field.write_catalogue(f["images"], str(tmp_path / "text"))
    with pytest.raises(ValueError, match="more than 1 rows"):
        field.write_catalogue(f["detections"].select("x"), str(tmp_path / "large"), most=1)
    field.save_results(str(tmp_path / "saved"), spark, one, again["stars"].select("source_id"))  # beside the inputs
    assert field.load_inputs(spark, str(tmp_path / "saved"))["images"].columns == again["images"].columns
    with pytest.raises(FileNotFoundError):
        field.load_results(spark, str(tmp_path / "none"))


def test_psf_grid_and_library(spark, tmp_path):
    """Functions that change over the detector, read from a library's file, and found for an image; photometry with them; a scaled distortion grid."""
    from skyspark.operators import images

    base = images.gaussian_psf(1.8).grid
    wide = images.gaussian_psf(2.4).grid
    cube = np.stack([base, wide, base, wide])
    grid = images.PsfGrid(cube, [0.0, 256.0], [0.0, 256.0])
    assert np.allclose(grid.mixed(0, 100), base) and np.allclose(grid.mixed(300, 0), wide)
    middle = grid.mixed(128, 128)
    assert (middle.max() < base.max()) and (middle.max() > wide.max()) and middle.sum() == pytest.approx(16, rel=1e-6)
    for kind, name in (("STDPSFs", "STDPSF_ACSWFC_F814W"), ("STDPSFs", "STDPSF_ACSWFC_F814W_SM4"), ("STDPSFs", "STDPSF_ACSWFC_F850L_SM3"), ("STDGDCs", "STDGDC_ACSWFC_F814W"), ("STDGDCs", "STDGDC_OFFICIAL_JFRAME_ACSWFC_F814W")):
        (tmp_path / "lib" / kind).mkdir(parents=True, exist_ok=True)
        fits_files.write(str(tmp_path / "lib" / kind / f"{name}.fits"), [(np.arange(12.0).reshape(3, 4) + k, {}) for k in range(3)])
    ask = spark.createDataFrame([("a", "ACSWFC", "F814W", 56000.0), ("b", "ACSWFC", "F814W", 53000.0), ("c", "ACSWFC", "F850LP", 56000.0), ("d", "WFC3UV", "F814W", 56000.0)], "image_name string, detector string, filter string, epoch_mjd double")
    got = {r.image_name: tuple(None if v is None else v.rsplit("/", 1)[-1] for v in (r.psf, r.gdc)) for r in catalog.best_files(ask, catalog.library_files(spark, str(tmp_path / "lib"))).collect()}
    assert got == {"a": ("STDPSF_ACSWFC_F814W_SM4.fits", "STDGDC_OFFICIAL_JFRAME_ACSWFC_F814W.fits"), "b": ("STDPSF_ACSWFC_F814W.fits", "STDGDC_OFFICIAL_JFRAME_ACSWFC_F814W.fits"), "c": ("STDPSF_ACSWFC_F850L_SM3.fits", None), "d": (None, None)}
    d = fits_files.read_distortion(spark, str(tmp_path / "lib" / "STDGDCs" / "STDGDC_ACSWFC_F814W.fits"))
    assert d.apply(np.array([1.0]), np.array([1.0]))[0][0] == 5.0 and d.mag[0, 0] == 2.0
    cards = [("SIMPLE", True), ("BITPIX", -64), ("NAXIS", 3), ("NAXIS1", 101), ("NAXIS2", 101), ("NAXIS3", 4), ("NXPSFS", 2), ("NYPSFS", 2), ("IPSFX01", 0.0), ("IPSFX02", 256.0), ("JPSFY01", 0.0), ("JPSFY02", 256.0)]
    (tmp_path / "psf.fits").write_bytes(fits_files._cards(cards) + cube.astype(">f8").tobytes())
    read = fits_files.read_psf(spark, str(tmp_path / "psf.fits"))
    assert np.allclose(read.cube, cube) and list(read.xs) == [0.0, 256.0]
    truth = [(30.3, 50.7, 20000.0), (128.2, 128.4, 50000.0), (225.6, 60.1, 30000.0)]
    ys, xs = np.mgrid[0:256, 0:256]
    img = np.full((256, 256), 100.0)
    for x, y, f in truth:
        img += f * grid.near(x, y).at(xs - x, ys - y)[0]
    fits_files.write(str(tmp_path / "img_flc.fits"), [(img, {"EXTNAME": "SCI", "EXTVER": 1})])
    tiles = fits_files.read_tiles(spark, str(tmp_path), pattern="img_flc.fits")
    fit, plain = images.photometry(tiles, read, 300.0).toPandas(), images.photometry(tiles, images.gaussian_psf(1.8), 300.0).toPandas()
    for x, y, f in truth:
        near = lambda t: t[(t.x - x) ** 2 + (t.y - y) ** 2 < 1].iloc[0]
        assert abs(near(fit).flux / f - 1) < 0.01 and abs(near(fit).x - x) < 0.01
    assert abs(near(plain).flux / f - 1) > 0.05  # the last star lies where the function is wide


def test_queries_equal_their_sql(spark, sf):
    """Every query of the reference's operators against its SQL at the smallest scale."""
    import duckdb

    import compare as script
    import __spark_entry__ as e
    from skyspark.plans import catalog as plans

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in script.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = []
    for name, sql in plans.oracle_sql().items():
        df = e.queries()[name](spark, sf)
        got = [r.asDict() for r in df.collect()]
        cur = con.execute(sql)
        key = sorted(d[0] for d in cur.description)
        want = [dict(zip([d[0] for d in cur.description], r, strict=True)) for r in cur.fetchall()]
        if key != sorted(df.columns) or sorted(map(repr, script.rows_of(got, key))) != sorted(map(repr, script.rows_of(want, key))):
            bad.append(name)
    assert not bad and len(plans.oracle_sql()) >= 100


def test_discovery_takes_all_stars_in_a_crowded_field():
    rng, n, k = np.random.default_rng(5), 3000, 60
    x, y, mag = rng.uniform(100, 3900, n), rng.uniform(100, 3900, n), rng.uniform(16, 22, n)
    cov = lambda m: np.tile([1e-4, 0.0, 1e-4], (m, 1))
    star = imagematch.Points(x, y, mag, cov(n), np.full(n, 1e-2), None, np.ones(n, bool))
    at = slice(n - k, n)  # the image's stars come after more than a thousand others that are measured as well
    det = imagematch.Points(x[at] + 12.0, y[at] - 9.0, mag[at], cov(k), np.full(k, 0.05), np.ones(k), np.ones(k, bool))
    t, _, i, j, *_ = imagematch.match(det, star, imagematch.Options())
    assert len(i) == k and (j == i + n - k).all() and abs(t.ratio - 1) < 1e-6


def crowded(seed: int):
    """Stars in dense rows, two at some places with other magnitudes, and 80 of them turned, scaled and shifted as an image's detections; the true star of each."""
    rng = np.random.default_rng(seed)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(-950, 5050, 7.2), np.arange(-920, 5020, 144.0)))
    on = np.repeat(np.arange(len(x)), rng.poisson(0.7, len(x)))
    x, y, mag = x[on], y[on], 14 + rng.permutation(len(on)) % 70 / 10
    k, turn = np.sort(rng.choice(len(on), 80, replace=False)), np.radians(0.06)
    dx, dy = x[k] - 2048 + 9, y[k] - 2048 - 12
    u, v = (np.cos(turn) * dx - np.sin(turn) * dy) * 1.0008 + 2048, (np.sin(turn) * dx + np.cos(turn) * dy) * 1.0008 + 2048
    cov = lambda n: np.tile([1e-4, 0.0, 1e-4], (n, 1))
    star = imagematch.Points(x, y, mag, cov(len(x)), np.full(len(x), 1e-2), None, np.ones(len(x), bool))
    det = imagematch.Points(u + rng.uniform(-0.01, 0.01, 80), v + rng.uniform(-0.01, 0.01, 80), mag[k] + 2 + rng.uniform(-0.02, 0.02, 80), cov(80) * 2, rng.uniform(0, 1, 80), rng.uniform(0.5, 3.5, 80), rng.random(80) < 0.67)
    return det, star, k


def test_crowded_rows_are_matched():
    """Where a fit to all first pairs agrees with none of them, those that fit worst go, and an image isn't lost."""
    for seed in (7, 18, 28, 32):
        det, star, k = crowded(seed)
        found = imagematch.match(det, star, imagematch.Options())
        assert found is not None
        _, _, i, j, *_ = found
        assert len(i) >= 76 and (j == k[i]).mean() > 0.97


def test_more_than_five_stars_share_a_place():
    """A detection's star isn't lost among others at its place, though they are nearer by a hair."""
    n = 12
    star = imagematch.Points(np.full(n, 2000.0) + np.arange(n)[::-1] * 1e-9, np.full(n, 2000.0), 14 + np.arange(n) * 0.5, np.tile([1e-4, 0.0, 1e-4], (n, 1)), np.full(n, 1e-2), None, np.ones(n, bool))
    det = imagematch.Points(np.array([2000.0]), np.array([2000.0]), star.mag[:1], star.cov[:1], np.zeros(1), np.ones(1), np.ones(1, bool))
    t = imagematch.Affine(np.eye(2), 2000.0, 2000.0, 2000.0, 2000.0, np.eye(6) * 1e-9)
    i, j, *_, cost = imagematch.candidates(t, det, star, np.zeros(2), 0.0, imagematch.Options())
    assert len(j) == n and j[np.argmin(cost)] == 0


def test_offset_histogram_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    ax, ay = rng.uniform(0, 500, (2, 300))
    whole = imagematch.peak_offset(ax, ay, ax + 7.3, ay - 4.1, 40.0, 1.0, (0.0, 0.01))
    monkeypatch.setattr(imagematch, "PAIRS", 1000)
    assert imagematch.peak_offset(ax, ay, ax + 7.3, ay - 4.1, 40.0, 1.0, (0.0, 0.01)) == whole and whole[3] >= 300


def test_near_predicted_equals_every_star_in_every_image(spark):
    """Against all stars in all images, with stars of a hundred cells' motion, at rest, without motions, and out of a footprint; and no row is made of a star and an image alone."""
    rng, n = np.random.default_rng(8), 60
    pm = np.where(np.arange(n) % 3 == 0, 0.0, rng.uniform(-900, 900, n))
    star = pd.DataFrame({"star": np.arange(n), "x": rng.uniform(-4000, 4000, n), "y": rng.uniform(-4000, 4000, n), "pm_x": pm, "pm_y": rng.permutation(pm)})
    star.loc[5, "pm_x"] = np.nan
    image = pd.DataFrame({"image": range(5), "dt": [-6.0, -1.5, 0.0, 3.25, 7.0], "x_low": -3500.0, "x_high": 3000.0, "y_low": -9000.0, "y_high": 9000.0})
    rows = [(int(i), int(200 * i + k), a, b) for i in range(5) for k, (a, b) in enumerate(rng.uniform(-6000, 6000, (200, 2)))]
    det = pd.DataFrame(rows, columns=["image", "det", "x", "y"])
    far = star.merge(image, how="cross").merge(det, on="image", suffixes=("", "_d"))
    far["distance"] = np.hypot(far.x_d - far.x - far.pm_x * far.dt, far.y_d - far.y - far.pm_y * far.dt)
    far = far[(far.distance <= 300) & far.x.between(far.x_low, far.x_high)]
    out = association.near_predicted(*[spark.createDataFrame(t) for t in (star, image, det)], 300.0)
    got = sorted((r.image, r.star, r.det, round(r.distance, 6)) for r in out.collect())
    assert len(got) > 50 and got == sorted((r.image, r.star, r.det, round(r.distance, 6)) for r in far.itertuples())


def test_second_pass_of_moving_stars(spark):
    """The same pairs as from a row per star and image."""
    rng, n = np.random.default_rng(9), 80
    star = pd.DataFrame({"star": np.arange(n), "x": rng.uniform(0, 4000, n), "y": rng.uniform(0, 4000, n), "pm_x": rng.normal(0, 200, n), "pm_y": rng.normal(0, 200, n), "sx": 20.0, "sy": 30.0, "spm_x": 5.0, "spm_y": 4.0, "m": rng.uniform(18, 19, n), "sm": 0.1})
    image = pd.DataFrame({"image": range(4), "dt": [-5.0, 0.0, 2.0, 9.0], "x_low": 0.0, "x_high": 3500.0, "y_low": -1e5, "y_high": 1e5})
    det = pd.DataFrame([(i, 300 * i + k, *p) for i in range(4) for k, p in enumerate(rng.uniform((-500, -500, 18), (4500, 4500, 19), (300, 3)))], columns=["image", "det", "x", "y", "mag"]).assign(smag=0.1)
    s, i, d = (spark.createDataFrame(t) for t in (star, image, det))
    zp = i.select("image", F.lit(0.05).alias("zp"))
    p = association.predicted(association.in_view(s, i)).drop("x", "y").withColumnsRenamed({"px": "x", "py": "y"})
    rows = lambda t: sorted((r.image, r.star, r.det, round(r.score, 6)) for r in t.collect())
    want = rows(association.second_pass(p, d, zp))
    assert len(want) > 20 and rows(association.propagated_pass(s, i, d, zp)) == want


def test_zero_points_of_moving_stars(spark):
    """The same medians as from a row per star and image; of two stars as near, the smaller id counts."""
    rng, n = np.random.default_rng(10), 300
    star = pd.DataFrame({"star": np.arange(n), "x": rng.uniform(0, 4000, n).round(-2), "y": rng.uniform(0, 4000, n).round(-2), "pm_x": 0.0, "pm_y": rng.normal(0, 50, n).round(-1), "m": rng.uniform(18, 19, n)})
    image = pd.DataFrame({"image": range(3), "dt": [-5.0, 0.0, 10.0], "x_low": 0.0, "x_high": 3500.0, "y_low": -1e5, "y_high": 1e5})
    det = pd.DataFrame([(i, k, *p) for i in range(3) for k, p in enumerate(rng.uniform((-500, -500, 18), (4500, 4500, 19), (300, 3)))], columns=["image", "det", "x", "y", "mag"]).round({"x": -2, "y": -2})
    s, i, d = (spark.createDataFrame(t) for t in (star, image, det))
    p = association.predicted(association.in_view(s, i), False).drop("x", "y").withColumnsRenamed({"px": "x", "py": "y"})
    rows = lambda t: sorted((r.image, round(r.zp, 9)) for r in t.collect())
    want = rows(association.rough_zero_points(p, d, 250.0))
    assert all(z for _, z in want) and rows(association.propagated_zero_points(s, i, d, 250.0)) == want
    plan = association.propagated_zero_points(s, i, d, 250.0)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_footprint_counts_of_boxes_far_beyond_the_points(spark):
    from skyspark.operators import spatial

    rng = np.random.default_rng(11)
    points = pd.DataFrame(rng.uniform(0, 1, (500, 2)).round(2), columns=["ra", "dec"])
    low, high = rng.uniform(-1, 1, (40, 2)).round(1), rng.uniform(0, 2, (40, 2)).round(1)
    low[0], high[0], low[1], high[1] = -1e12, 1e12, 5, 9
    boxes = pd.DataFrame({"id": range(40), "ra_min": low[:, 0], "ra_max": high[:, 0], "dec_min": low[:, 1], "dec_max": high[:, 1]})
    want = {b.id: int((points.ra.between(b.ra_min, b.ra_max) & points.dec.between(b.dec_min, b.dec_max)).sum()) for b in boxes.itertuples()}
    got = {r.id: r.n for r in spatial.footprint_counts(spark.createDataFrame(boxes), spark.createDataFrame(points), 0.1).collect()}
    assert got == want and got[0] == 500 and got[1] == 0


def test_master_claims_of_rows_equal_those_of_lists(spark):
    from skyspark.operators import relational

    rng = np.random.default_rng(12)
    rows = pd.DataFrame({"src": rng.integers(0, 30, 600), "sub_name": rng.integers(0, 8, 600).astype(str), "catalog_index": rng.integers(0, 60, 600)}).drop_duplicates()
    rows = rows.assign(gaia_id=rows.src.where(rows.src % 4 == 0).astype("Int64").astype(object).where(rows.src % 4 == 0, None), sigma=(rows.src % 7) / 10, n_detect=rows.src % 5)
    d = spark.createDataFrame(rows[["src", "gaia_id", "sigma", "n_detect", "sub_name", "catalog_index"]].values.tolist(), "src long, gaia_id long, sigma double, n_detect long, sub_name string, catalog_index long")
    lists = d.groupBy("src", "gaia_id", "sigma", "n_detect").agg(F.collect_list(F.struct("sub_name", "catalog_index")).alias("detections"))
    want = sorted(map(tuple, relational.master_sources(lists, 5, 2).collect()))
    assert len(want) > 100 and sorted(map(tuple, relational.master_claims(d, 5, 2).collect())) == want
