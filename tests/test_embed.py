import numpy as np
import pytest
from pyspark.sql import functions as F

from spotframe.operators import embed as em
from spotframe.operators import spots as sp


def emb(spark, x, start=0):
    return spark.createDataFrame([(start + i, i, f"n{start + i}", v.tolist()) for i, v in enumerate(x)], "id long, pair long, name string, embedding array<double>")


def test_ranks(spark):
    x = np.random.default_rng(0).normal(size=(20, 16))
    same = em.rank_pairs(emb(spark, x), emb(spark, x, 100)).collect()
    assert len(same) == 20 and all(r.rank == 0 for r in same)
    mixed = em.rank_pairs(emb(spark, x), emb(spark, x[::-1], 100)).agg(F.avg("rank")).first()[0]
    assert mixed > 0


def test_knn_and_radius_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=(60, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    rows = emb(spark, x)
    got = {}
    for r in em.knn(rows, rows.filter("id < 7"), 3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == {i: np.argsort(d[i])[:3].tolist() for i in range(7)}
    hits = {r.id for r in em.radius_hits(rows.filter("id < 7"), rows, 1.0).collect()}
    assert hits == set(np.flatnonzero((d[:7] <= 1.0).any(axis=0)).tolist())


def test_zscore(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "a double, b double")
    out = np.array([tuple(r) for r in sp.zscore(df, ["a", "b"]).collect()])
    assert out[:, 0].mean() == pytest.approx(0) and out[:, 0].std() == pytest.approx(1) and (out[:, 1] == 0).all()


def test_triplets_by_distance_band(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 10, (100, 9))
    rows = spark.createDataFrame([(i, f"s{i}", v.tolist(), f"p{i}") for i, v in enumerate(p)], "id long, name string, params array<double>, positive string")
    near = em.mine_triplets(rows, rows, 4, 0.0, 0.1, 1, tries=100)
    far = em.mine_triplets(rows, rows, 4, 0.9, 1.0, 1, tries=100)
    assert near.agg(F.max("distance")).first()[0] < far.agg(F.min("distance")).first()[0]
    for df in (near, far):
        out = df.collect()
        assert len({(r.anchor, r.negative) for r in out}) == len(out) > 100
        assert all(r.positive == "p" + r.anchor[1:] and r.anchor != r.negative for r in out)


def test_triplets_of_short_anchors_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.normal(0, 1, (700, 3)), rng.normal(0, 1, (20, 3)) + 9])
    rows = spark.createDataFrame([(i, f"s{i}", v.tolist(), f"p{i}") for i, v in enumerate(p)], "id long, name string, params array<double>, positive string")
    z = (p - p.mean(axis=0)) / p.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    out = em.mine_triplets(rows, rows, 5, 0.0, 0.03, 1, tries=3).collect()
    by = {}
    for r in out:
        by.setdefault(int(r.anchor[1:]), {})[int(r.negative[1:])] = r.distance
        assert r.distance == pytest.approx(d[int(r.anchor[1:]), int(r.negative[1:])], abs=1e-9)
    assert sum(map(len, by.values())) == len(out)
    # the cuts are percentiles of the tried pairs: those of the seed
    tried = em.mine_triplets(rows, rows, 720, 0.0, 0.03, 1, tries=3)
    every = [r.distance for r in tried.collect()]
    eligible = ((d > 1e-12) & (d >= min(every) - 1e-9) & (d <= max(every) + 1e-9)).sum(axis=1)
    assert len(every) == eligible.sum() and (eligible < 5).any() and (eligible > 5).any()
    assert [len(by.get(i, {})) for i in range(720)] == np.minimum(eligible, 5).tolist()


def test_real_triplets(spark):
    names = [(i, f"s{i % 3}_st{i % 2}_n{i % 5}_{i}.pkl") for i in range(90)] + [(900, "s9_st9_n0_0.pkl")]
    rows = sp.parse_real_names(spark.createDataFrame(names, "id long, name string"))
    out = em.mine_real_triplets(rows, 3, 5).collect()
    part = lambda n: n.split("_")[:3]
    assert len(out) == 270
    for r in out:
        a, p, n = part(r.anchor), part(r.positive), part(r.negative)
        assert a[:2] == p[:2] and a[2] != p[2] and a[0] != n[0]


def test_models(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) * (10, 3, 1, 1, 1) + 4
    rows = emb(spark, x)
    c = np.array([r.components for r in em.pca(rows, rows, 2).orderBy("id").collect()])
    assert c.mean(axis=0) == pytest.approx([0, 0], abs=1e-9) and c.std(axis=0)[0] > 3 * c.std(axis=0)[1] > 1
    left = np.array([r.embedding for r in em.remove_components(rows, 1).orderBy("id").collect()])
    assert left.var(axis=0).sum() == pytest.approx(x.var(axis=0).sum() - c[:, 0].var(), rel=1e-6)
    two = np.concatenate([rng.normal(size=(40, 2)), rng.normal(size=(40, 2)) + 12])
    out = [r.cluster for r in em.cluster_params(emb(spark, two), 2, 1, "embedding").orderBy("id").collect()]
    assert len(set(out[:40])) == len(set(out[40:])) == 1 and out[0] != out[-1]
    line = spark.createDataFrame([(float(a), float(b), float(2.0 * a - b + 3)) for a, b in rng.normal(size=(50, 2))], "a double, b double, y double")
    coef, intercept = em.regress(line, ["a", "b"], "y")
    assert coef == pytest.approx([2, -1], abs=1e-3) and intercept == pytest.approx(3, abs=1e-3)


def test_embed_images(spark):
    images = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [3.0, 4.0])], "name string, pixels array<double>")
    out = em.embed_images(images, lambda: lambda batch: batch * 2).orderBy("name").collect()
    assert [(r.name, r.embedding) for r in out] == [("a", [2.0, 4.0]), ("c", [6.0, 8.0])]


def test_curation_guards(spark):
    spots = spark.createDataFrame([(0, 1, t, 7, 1.0) for t in range(3)], "stack_id long, spot_id long, t int, nuc_id int, value double")
    new = spark.createDataFrame([(0, 1, 5, 9.0)], "stack_id long, spot_id long, t int, value double")
    out = sp.apply_curation(spots, spots.filter("t = 1"), new).orderBy("t").collect()
    assert [(r.t, r.nuc_id, r.value) for r in out] == [(0, 7, 1.0), (2, 7, 1.0), (5, 7, 9.0)]
    with pytest.raises(ValueError):
        sp.apply_curation(spots, new, new)
    with pytest.raises(ValueError):
        sp.apply_curation(spots, spots.filter("t = 1"), spots.filter("t = 2").drop("nuc_id"))


def test_grid_correction_and_outside(spark):
    import math

    cells = spark.createDataFrame([(d, i, 1.0, 1.0, 1.0) for d in range(5) for i in range(5)], "depth_bin int, intensity_bin int, a double, b double, c double")
    spots = spark.createDataFrame([(0.25, 150.0), (0.25, 5000.0)], "depth double, v double")
    out = [r.v for r in sp.depth_correct_grid(spots, cells, "v", 10.0).orderBy("v").collect()]
    assert sorted(out) == pytest.approx([math.exp(-10) + 1, 5000.0])


def test_bins(spark):
    rows = spark.createDataFrame([(k * 0.5, k * 0.5) for k in range(20) for _ in range(10)], "depth double, v double")
    out = {r.bin: (r.mean, r.n) for r in sp.bin_values(rows, "depth", "v").collect()}
    assert out[0] == (0, 10) and out[11] == (5.5, 10) and out[90] == (None, 0) and len(out) == 100


def test_classes_in_blocks(spark):
    rows = [(i, "s", f"st{i % 2}", f"n{i % 3}", [float(i), 0.0]) for i in range(40)] + [(40, "q", "st0", "n0", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, sample string, stack string, nucleus string, embedding array<double>")
    want = {(a[0], b[0], "nucleus" if a[3] == b[3] else "stack") for a in rows for b in rows if a[0] < b[0] and a[1:3] == b[1:3]}
    for size in (3, 4096):
        out = em.distance_classes(df, size).collect()
        assert len(out) == len(want) and {(r.id, r.other, r["class"]) for r in out} == want
