"""Plans that hold no table whole on the driver and no track whole in a row."""

import contextlib
import io

import numpy as np

from spotframe.operators import embed as em
from spotframe.operators import tracks as tk
from spotframe.operators import voxels as vx


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


VOXELS = "stack_id long, t int, z int, x int, y int, value double"


def test_clicks_are_never_broadcast(spark):
    v = spark.createDataFrame([(0, 0, z, x, y, float(z + x + y)) for z in range(3) for x in range(4) for y in range(4)], VOXELS)
    out = vx.clicks_to_maximum(v.filter("x = 1 AND y = 1 AND z = 1"), v, 3, 1)
    assert "BroadcastHashJoin" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [(0, 0, 2, 2, 2)]


def test_long_tracks_stream(spark):
    """Two spots a frame, the second always the nearer one from the third frame on; a frame is held at once, not the track."""
    labels = spark.createDataFrame([(0, t, 0, x, 0, 1) for t in range(300) for x in range(9)], "stack_id long, t int, z int, x int, y int, label int")
    fits = spark.createDataFrame([(0, t, 2 * t + i, 0.0, float(x), 0.0) for t in range(300) for i, x in enumerate((8, 1) if t > 1 else (0, 5))], "stack_id long, t int, fit_no long, z double, x double, y double")
    out = tk.link_by_nucleus(fits, labels, (1, 9, 1))
    assert "collect_list" not in plan(out)
    assert [(r.t, r.x) for r in out.orderBy("t").collect()] == [(t, 0.0 if t < 2 else 1.0) for t in range(300)]


def test_distances_of_a_stack_are_measured_by_blocks(spark):
    rows = spark.createDataFrame([(i, "s", "st", None if i < 2 else f"n{i % 2}", [float(i), 0.0]) for i in range(6)], "id long, sample string, stack string, nucleus string, embedding array<double>")
    out = em.distance_classes(rows, 2)
    assert "zip_with" not in plan(out) and "zipwith" not in plan(out).lower()
    assert sorted((r.id, r.other, r["class"], r.distance) for r in out.collect()) == [(i, j, "nucleus" if i > 1 and (i - j) % 2 == 0 else "stack", float(j - i)) for i in range(6) for j in range(i + 1, 6)]


def test_scores_are_never_shuffled(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(30, 2, 4))
    rows = spark.createDataFrame([(i, k, v[i, k].tolist(), v[i, 0, :2].tolist()) for i in range(30) for k in range(2)], "id long, sigma_no int, hist array<double>, params array<double>")
    out = em.score_by_sigma(rows, rows.filter("id % 10 = 0"))
    assert "zip_with" not in plan(out) and "zipwith" not in plan(out).lower()
    got = {(r.ref, r.id, r.sigma_no): (r.z, r.distance2) for r in out.collect()}
    assert len(got) == 3 * 30 * 2
    for (ref, i, k), (z, d) in got.items():
        s = np.sqrt(((v[:, k] - v[ref, k]) ** 2).sum(axis=1))
        assert abs(z - (s[i] - s.mean()) / s.std()) < 1e-9 and abs(d - ((v[i, 0, :2] - v[ref, 0, :2]) ** 2).sum()) < 1e-12
