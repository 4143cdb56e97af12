"""Operators of whole frames, corrections and stitched movies against plain versions, and further queries against their SQL."""

import numpy as np
import pytest
from test_frames import frame_table, label_table
from test_queries import SF, shown
from test_queries import duck  # noqa: F401

from spotframe.functions import kernels as kn
from spotframe.operators import calib as cb
from spotframe.operators import frames as fr
from spotframe.operators import traces as tr
from spotframe.operators import voxels as vx
from spotframe.plans import ORACLES, QUERIES

MORE = [
    "p11_opened_threshold", "h3_open_labels", "h3_morph_dilate", "g37_spot_threshold", "p17_clicks_to_maximum", "g33_center_crop", "h11_paired_turns", "h8_crop_windows", "g39_other_samples", "j22_attach_spots", "j17_mine_triplets",
    "j18_mine_real_triplets", "j20_link_by_nucleus", "j21_random_controls", "g3_circularity", "h5_window_moments", "w12_interpolate", "w22_rolling_by_score", "w8_lag_correlation", "w9_autocorrelation", "w11_padded_cross_correlation", "s1_read_frames", "s7_embeddings", "g28_relate",
]


@pytest.mark.parametrize("name", MORE)
def test_same_rows_as_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(shown, r)) for r in cur.fetchall())


def blobs(places, shape=(9, 40, 40), height=100.0):
    z, x, y = np.indices(shape)
    return sum(height * np.exp(-(((z - a) / 1.2) ** 2 + ((x - b) / 1.8) ** 2 + ((y - c) / 1.8) ** 2) / 2) for a, b, c in places) + 5.0


def test_brightest_of_each_nucleus(spark):
    mask = np.zeros((9, 40, 40), dtype=int)
    mask[:, 2:18, 2:18], mask[:, 22:38, 22:38] = 3, 7
    places = [(4, 10, 11), (3, 30, 29)]
    out = fr.detect_spots(frame_table(spark, [blobs(places)]), labels=label_table(spark, [mask]), background=3, rad_xy=5, rad_z=2).orderBy("fit_no").collect()
    assert [(r.z, r.x, r.y) for r in out] == places and all(abs(r.width_x - 1.8) < 0.3 for r in out)


def test_screen_drops_faint_spots(spark):
    rng = np.random.default_rng(1)
    frames = [blobs([(4, 20, 20)]) + blobs([(4, 8, 8)], height=3.0) + rng.normal(size=(9, 40, 40)) * 0.2 for _ in range(5)]
    table = frame_table(spark, frames)
    cuts = fr.detection_thresholds(table, background=3)
    every = fr.detect_spots(table, background=3).filter("t = 2").count()
    kept = fr.detect_spots(table, background=3, thresholds=cuts).filter("t = 2").collect()
    assert every > 1 and [(r.x, r.y) for r in kept] == [(20, 20)]


def test_fits_in_rows(spark):
    frames = frame_table(spark, [blobs([(4, 12, 12)]), blobs([(4, 25, 20), (5, 9, 31)])])
    peaks = spark.createDataFrame([(0, 1, 5, 4, 25, 20), (0, 0, 9, 4, 12, 12), (0, 1, 6, 5, 9, 31)], "stack_id long, t int, fit_no long, z int, x int, y int")
    out = {r.fit_no: (r.t, r.z, r.x, r.y) for r in fr.fit_peaks(peaks, frames, 5, 2).collect()}
    assert out == {9: (0, 4, 12, 12), 5: (1, 4, 25, 20), 6: (1, 5, 9, 31)}


def test_masked_histograms_and_sweeps(spark):
    rng = np.random.default_rng(2)
    a, mask = rng.random((2, 6, 6)), (rng.random((2, 6, 6)) > 0.4).astype(int)
    frames, labels = frame_table(spark, [a]), label_table(spark, [mask])
    (r,) = fr.scalespace_histograms(frames, [1.0], 5, 0.0, 1.0, labels).collect()
    small = a.astype(np.float32).astype(float)
    assert r.hist == np.histogram(kn.gaussian_filter(small, 1.0)[mask > 0], 5, (0, 1))[0].tolist()
    (r,) = fr.threshold_sweep(frames, [0.5], labels).collect()
    assert r.objects == kn.connected_components((small > 0.5) & (mask > 0)).max()
    assert fr.threshold_sweep(frames, [0.5], labels.filter("label > 5")).collect()[0].objects == 0


def test_objects_per_slice(spark):
    a = np.zeros((2, 8, 8))
    a[0, 1:3, 1:3] = a[0, 5:8, 5:7] = 10
    a[0, 0, 7] = a[1, 4, 4] = 10  # single pixels are opened away
    a[1, 6:8, 6:8] = 10
    out = {r.z: r.objects for r in fr.objects_per_slice(frame_table(spark, [a]), 9.0, 0, 0.5).collect()}
    assert out == {0: 2, 1: 1}


def test_opening_is_the_union_of_whole_windows(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((2, 12, 12)) > 0.3
    got = {(r.z, r.x, r.y) for r in vx.opening(label_table(spark, [mask.astype(int)]), (1, 2, 2)).collect()}
    want = {(z, x + i, y + j) for z in range(2) for x in range(11) for y in range(11) if mask[z, x : x + 2, y : y + 2].all() for i in (0, 1) for j in (0, 1)}
    assert got == want


def test_correction_from_data_takes_the_depth_out(spark):
    depth = np.linspace(10, 22, 400)
    rows = [(i, float(d), float(800 * np.exp(-0.1 * d) + 60)) for i, d in enumerate(depth)]
    spots = spark.createDataFrame(rows, "id long, depth double, value double")
    bins = spots.selectExpr("cast(floor(depth / 0.5) as int) bin", "value").groupBy("bin").avg("value").withColumnRenamed("avg(value)", "mean")
    out = np.array([r.value for r in cb.depth_correct_from_data(spots, bins, "value", 15.0).orderBy("id").collect()])
    assert np.std(out) < 0.1 * np.std([v for *_, v in rows])


def test_smooth_mirrors_short_and_long_series(spark):
    rng = np.random.default_rng(4)
    series = [rng.random(n) for n in (1, 3, 40)]
    rows = [(0, k, t, float(v)) for k, s in enumerate(series) for t, v in enumerate(s)] + [(0, 9, t, None if t == 5 else 1.0) for t in range(12)]
    got = {(r.spot_id, r.t): r.value for r in tr.smooth(spark.createDataFrame(rows, "stack_id long, spot_id long, t int, value double"), 1.0).collect()}
    w = np.array(tr.gaussian_weights(1.0))
    for k, s in enumerate(series):
        padded = np.pad(s, len(w) // 2, mode="symmetric")
        for t in range(len(s)):
            assert got[k, t] == pytest.approx(float(padded[t : t + len(w)] @ w))
    assert [t for t in range(12) if got[9, t] is None] == list(range(1, 10))


def test_blocks_of_series(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a = [(0, int(p), float(v)) for p, v in zip(rng.permutation(90)[:60], rng.random(60), strict=True)]
    b = [(0, int(p), float(v)) for p, v in zip(rng.permutation(90)[:60], rng.random(60), strict=True)]
    x, y = (spark.createDataFrame(r, "stack_id long, pos long, value double") for r in (a, b))
    run = lambda: [sorted(map(tuple, f(x, y, 7).collect())) for f in (tr.lag_correlation, tr.cross_correlation, tr.padded_cross_correlation)]
    want = run()
    monkeypatch.setattr(tr, "BLOCK", 9)
    for p, q in zip(run(), want, strict=True):
        assert np.allclose(np.array(p, dtype=float), np.array(q, dtype=float))
    at = {p: v for _, p, v in b}
    for _, lag, c, n in want[0]:
        pairs = [(v, at[p - lag]) for _, p, v in a if p - lag in at]
        u, v = np.array(pairs).T
        assert n == len(pairs) and c == pytest.approx(np.cov(u, v)[0, 1] / (u.std() * v.std()))


@pytest.mark.parametrize("name", ["m5_all_pairs", "m5_pair_statistics"])
def test_all_pairs_of_the_whole_table(spark, duck, name):  # noqa: F811
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    rows = df.collect()
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(shown(r[c]) for c in columns) for r in rows) == sorted(tuple(map(shown, r)) for r in cur.fetchall())
    assert len(rows) == n * (n - 1) if name == "m5_all_pairs" else sum(r.n for r in rows) == n * (n - 1)


@pytest.mark.parametrize("odd", [[], [(3, [1.0], [2.0, 3.0])], [(3, None, [2.0, 3.0]), (4, [1.0, None], None)]])
def test_differences_of_odd_vectors(spark, odd):
    """Vectors of one length go by plain expressions, others by lambdas; nulls stay null."""
    from spotframe.operators import embed as em

    rows = [(1, [1.0, 2.0], [0.5, 4.0]), (2, [4.0, 8.0], [1.5, 2.0]), *odd]
    less = lambda a, b, k: None if k >= len(a) or k >= len(b) or a[k] is None or b[k] is None else a[k] - b[k]
    each = lambda a, b: None if a is None or b is None else [less(a, b, k) for k in range(max(len(a), len(b)))]
    square = lambda d: None if d is None or None in d else sum(x * x for x in d)
    want = [(i, j, each(f, g), square(each(p, q))) for i, f, p in rows for j, g, q in rows if i != j]
    got = em.all_difference_pairs(spark.createDataFrame(rows, "id long, features array<double>, params array<double>")).collect()
    assert sorted((r.id, r.other, r.difference, r.distance2) for r in got) == sorted(want)
