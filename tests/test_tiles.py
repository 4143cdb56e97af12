"""Work on tiles gives what the kernels give for whole frames, whatever the tiling."""

import numpy as np
import pytest

from spotframe.functions import kernels as kn
from spotframe.operators import tiles

SIZE = (5, 13, 11)
TILINGS = [(5, 13, 11), (2, 4, 3), (8, 5, 20), (1, 1, 6)]


def voxels(spark, frames):
    rows = [(s, 0, t, int(z), int(x), int(y), float(a[z, x, y])) for (s, t), a in frames.items() for z, x, y in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "stack_id long, c int, t int, z int, x int, y int, value double").repartition(4)


def masks(spark, frames):
    rows = [(s, t, *map(int, at)) for (s, t), a in frames.items() for at in np.argwhere(a)]
    return spark.createDataFrame(rows, "stack_id long, t int, z int, x int, y int").repartition(4)


@pytest.mark.parametrize("tiling", TILINGS[:3])
def test_filters(spark, tiling):
    rng = np.random.default_rng(1)
    frames = {(s, t): rng.normal(size=SIZE) for s in (0, 3) for t in (1, 2)}
    df = voxels(spark, frames)
    for out, kernel in ((tiles.gaussian_voxels(df, 0.8, SIZE, tiling), lambda a: kn.gaussian_filter(a, 0.8)), (tiles.extreme_voxels(df, (1, 4, 3), SIZE, tiling, False), lambda a: kn.extreme_filter(a, (1, 4, 3), False))):
        got = {k: np.full(SIZE, np.nan) for k in frames}
        rows = out.collect()
        for r in rows:
            got[r.stack_id, r.t][r.z, r.x, r.y] = r.value
        assert len(rows) == 4 * np.prod(SIZE)
        for k, a in frames.items():
            assert np.allclose(got[k], kernel(a), atol=1e-12)


@pytest.mark.parametrize("tiling", TILINGS)
def test_connected_parts(spark, tiling):
    rng = np.random.default_rng(2)
    frames = {(s, t): rng.random(SIZE) < p for (s, t), p in {(0, 0): 0.3, (0, 1): 0.5, (4, 0): 0.15, (4, 9): 1.0}.items()}
    got = {k: np.zeros(SIZE, dtype=int) for k in frames}
    for r in tiles.label_voxels(masks(spark, frames), SIZE, tiling).collect():
        got[r.stack_id, r.t][r.z, r.x, r.y] = r.label
    for k, a in frames.items():
        assert (got[k] == kn.connected_components(a)).all(), k


@pytest.mark.parametrize("tiling", TILINGS)
def test_holes(spark, tiling):
    rng = np.random.default_rng(3)
    shell = np.zeros(SIZE, dtype=bool)
    shell[0:5, 2:11, 1:10] = True
    shell[1:4, 4:9, 3:8] = False
    spiral = shell.copy()
    spiral[2, 4:13, 5] = False  # a way out
    frames = {(0, 0): shell, (0, 1): spiral, (1, 0): rng.random(SIZE) < 0.7}
    got = {k: np.zeros(SIZE, dtype=bool) for k in frames}
    rows = tiles.fill_holes_voxels(masks(spark, frames), SIZE, tiling).collect()
    for r in rows:
        got[r.stack_id, r.t][r.z, r.x, r.y] = True
    assert len(rows) == sum(int(a.sum()) for a in got.values())  # no pixel twice
    for k, a in frames.items():
        assert (got[k] == kn.fill_holes(a)).all(), k


def test_nothing(spark):
    none = spark.createDataFrame([], "stack_id long, t int, z int, x int, y int")
    assert tiles.label_voxels(none, SIZE, (2, 2, 2)).count() == tiles.fill_holes_voxels(none, SIZE, (2, 2, 2)).count() == 0
