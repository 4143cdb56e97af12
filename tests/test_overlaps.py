"""Connecting of masks, label filters, boxes inside of images, all pairs of any number of rows."""

import numpy as np

from spotframe.operators import embed as em
from spotframe.operators import voxels as vx

LABELS = "stack_id long, t int, z int, x int, y int, label int"


def table(spark, rows):
    return spark.createDataFrame([(0, 0, 0, x, 0, k) for x, k in rows], LABELS)


def pairs(spark, a, b, how, **kw):
    keys = ["stack_id", "t"]
    return sorted((r.la, r.lb, r.n) for r in vx.connect_labels(vx.overlaps(table(spark, a), table(spark, b), keys), keys, how, **kw).collect())


def test_strategies(spark):
    # 1 falls into 7 and 8; 2 and 3 become 9, of which a part is new
    a = [(x, 1) for x in range(6)] + [(x, 2) for x in range(10, 14)] + [(x, 3) for x in range(14, 16)]
    b = [(x, 7) for x in range(4)] + [(x, 8) for x in range(4, 6)] + [(x, 9) for x in range(10, 22)]
    assert pairs(spark, a, b, "best") == [(1, 7, 4), (2, 9, 4)]
    assert pairs(spark, a, b, "split") == [(1, 7, 4), (1, 8, 2), (2, 9, 4)]
    assert pairs(spark, a, b, "merge") == [(1, 7, 4), (2, 9, 4), (3, 9, 2)]
    assert pairs(spark, a, b, "contained") == [(1, 7, 4), (1, 8, 2)]
    assert pairs(spark, a, b, "contained", share=0.3) == [(1, 7, 4), (1, 8, 2), (2, 9, 4)]
    assert pairs(spark, [(0, 1), (1, 2)], [(0, 5), (1, 5)], "split") == [(2, 5, 1)]  # equal overlaps: the larger label
    assert pairs(spark, [], b, "best") == []


def test_tracking_by_another_strategy(spark):
    from spotframe.operators import tracks as tk

    rows = [(0, 0, 0, x, 0, 1) for x in range(6)] + [(0, 1, 0, x, 0, 4 if x < 4 else 5) for x in range(6)] + [(0, 2, 0, x, 0, 6) for x in (4, 5)]
    df = spark.createDataFrame(rows, LABELS)
    split = lambda hits: vx.connect_labels(hits, ["stack_id", "t", "lag"], "split")
    best = {(r.t, r.label): r.track for r in tk.track_labels(df).collect()}
    assert best == {(0, 1): 1, (1, 4): 1, (1, 5): 2, (2, 6): 2}
    got = {(r.t, r.label): r.track for r in tk.track_labels(df, 2, split).collect()}
    # in a frame a track is given once, to the larger overlap
    assert got == {(0, 1): 1, (1, 4): 1, (1, 5): 2, (2, 6): 2}


def test_filter_labels_by_a_metric(spark):
    df = table(spark, [(x, k) for k in (1, 2, 3) for x in range(k * 10, k * 10 + k)])
    sizes = vx.label_sizes(df)
    kept = vx.filter_labels(df, sizes.withColumnRenamed("n", "value").filter("label <> 2"), 1, 2)
    assert {r.label for r in kept.collect()} == {1}
    assert {r.label for r in vx.filter_labels(df, sizes, 2, 3, "n").collect()} == {2, 3}


def test_boxes_inside(spark):
    spots = spark.createDataFrame([(k, z, x, y) for k, (z, x, y) in enumerate([(1.9, 2.0, 2.0), (0.9, 2.0, 2.0), (1.0, 1.0, 3.0), (1.0, 2.0, 2.9), (1.0, 3.0, 2.0)])], "k int, z double, x double, y double")
    assert [r.k for r in vx.boxes_inside(spots, (3, 3, 3), (3, 4, 4)).collect()] == [0, 3]


def test_all_pairs_in_blocks_and_in_tiles(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, x[:2].tolist(), x.tolist()) for i, x in enumerate(v)], "id long, features array<double>, params array<double>")
    want = {(i, j): round(float(((v[i] - v[j]) ** 2).sum()), 9) for i in range(60) for j in range(60) if i != j}
    read = lambda d: {(r.id, r.other): round(r.distance2, 9) for r in d.collect()}
    got = em.all_difference_pairs(df, 7)
    assert got.count() == len(want) and read(got) == want
    path = f"file://{tmp_path}/pairs"
    assert em.write_difference_pairs(df, path, 16) == 4
    assert read(spark.read.parquet(path)) == want
    assert em.write_difference_pairs(df, path, 16) == 0  # all tiles are there
    (tmp_path / "pairs" / "tile=2" / "_SUCCESS").unlink()
    assert em.write_difference_pairs(df, path, 16) == 1 and spark.read.parquet(path).count() == len(want)
    stats = {r.id: (r.n, round(r.mean, 9), round(r.largest, 9)) for r in em.pair_statistics(df).collect()}
    for i in range(60):
        own = [((v[i] - v[j]) ** 2).sum() for j in range(60) if j != i]
        assert stats[i] == (59, round(float(np.mean(own)), 9), round(float(max(own)), 9))
