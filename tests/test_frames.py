import math

import numpy as np
import pytest

from spotframe.functions import kernels as kn
from spotframe.operators import frames as fr
from spotframe.operators import spots as sp
from spotframe.operators import voxels as vx
from spotframe.sources import frames as src


def frame_table(spark, arrays, stack=0):
    rows = [(stack, 0, t, *a.shape, a.astype(float).ravel().tolist()) for t, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "stack_id long, c int, t int, nz int, nx int, ny int, pixels array<float>")


def label_table(spark, masks):
    rows = [(0, t, *map(int, p), int(m[tuple(p)])) for t, m in enumerate(masks) for p in np.argwhere(m > 0)]
    return spark.createDataFrame(rows, "stack_id long, t int, z int, x int, y int, label int")


CUBE = np.zeros((7, 9, 9), dtype=int)
CUBE[2:5, 3:6, 3:6] = 1


def test_size_filter(spark):
    labels = label_table(spark, [CUBE])
    assert [vx.filter_label_size(labels, a, b).count() for a, b in ((20, 30), (29, 30), (20, 25))] == [27, 0, 0]


def test_morphology(spark):
    labels = label_table(spark, [CUBE * 10])
    grown = vx.dilate(labels, (3, 3, 3), CUBE.shape)
    assert sum(r.label for r in grown.collect()) == 1250
    assert sum(r.label for r in vx.erode(labels, (3, 3, 3)).collect()) == 10
    with pytest.raises(ValueError):
        vx.dilate(labels, (2, 3, 3), CUBE.shape)


def test_relabel(spark):
    m = np.zeros((1, 9, 9), dtype=int)
    m[0, :2], m[0, 4], m[0, 7:] = 10, 81, 3
    out = {r.label for r in vx.relabel(label_table(spark, [m])).collect()}
    assert out == {0, 1, 2}


def test_holes_components_maxima():
    hole = CUBE.astype(bool).copy()
    hole[3, 4, 4] = False
    assert kn.fill_holes(hole).sum() == 27
    a = np.zeros((3, 10, 10))
    a[1, 2, 2], a[1, 7, 7] = 10, 8
    assert len(kn.local_maxima(a, (3, 3, 3))) == 2 and len(kn.local_maxima(a, (3, 3, 3), 8)) == 1
    m = np.array([[1, 1, 0, 1], [0, 0, 0, 1], [1, 0, 1, 1]], dtype=bool)
    assert kn.connected_components(m).tolist() == [[1, 1, 0, 2], [0, 0, 0, 2], [3, 0, 2, 2]]


def test_filters():
    a = np.zeros((7, 7))
    a[3, 3] = 1
    g = kn.gaussian_filter(a, 1.0)
    assert g.sum() == pytest.approx(1, abs=1e-6) and g[3, 3] == g.max() and np.allclose(g, g.T)
    assert kn.laplacian_of_gaussian(np.ones((9, 9)), 1.0) == pytest.approx(0, abs=1e-12)
    assert kn.gradient_magnitude(np.tile(np.arange(5.0), (5, 1)))[2, 2] == 8
    assert kn.extreme_filter(np.array([1, 5, 2, 0]), 3).tolist() == [5, 5, 5, 2]
    assert kn.extreme_filter(np.array([1, 5, 2, 0]), 3, False).tolist() == [1, 1, 0, 0]


def test_gaussian_values():
    p = np.array([[1.0, 0, 0, 0, 1, 1, 1]])
    assert kn.gaussian_values(p, np.array([[0.0, 0, 0], [1, 1, 1]]))[0] == pytest.approx([1, 0.2231301601])


def test_fits_recover_parameters_in_95_percent():
    rng = np.random.default_rng(0)
    n, grid = 100, np.stack(np.meshgrid(*[np.arange(s, dtype=float) for s in (7, 11, 11)], indexing="ij"), -1).reshape(-1, 3)
    p = np.column_stack([rng.uniform(50, 500, n), rng.uniform(2, 4, n), rng.uniform(4, 6, (n, 2)), rng.uniform(0.9, 1.6, (n, 3))])
    got, good = kn.fit_gaussians(kn.gaussian_values(p, grid).reshape(n, 7, 11, 11))
    assert good.all() and np.percentile(np.abs(got - p).max(axis=1), 95) <= 0.01
    bad, ok = kn.fit_gaussians(np.zeros((1, 3, 3, 3)))
    assert not ok[0] and bad[0, 0] == 0 and np.isinf(bad[0, 4:]).all()


def test_exponential_fit():
    x = np.arange(0, 20, 0.5)
    assert kn.fit_exponential(x, 900 * np.exp(-0.15 * x) + 40) == pytest.approx((900, 0.15, 40), rel=1e-4)


def test_detection_finds_planted_spots(spark):
    grid = np.stack(np.meshgrid(np.arange(9.0), np.arange(30.0), np.arange(30.0), indexing="ij"), -1).reshape(-1, 3)
    p = np.array([[300.0, 4, 8, 8, 1, 1.2, 1.2], [200.0, 4, 20, 22, 1, 1.2, 1.2]])
    a = kn.gaussian_values(p, grid).sum(axis=0).reshape(9, 30, 30)
    out = fr.detect_spots(frame_table(spark, [a])).filter("height > 50").collect()
    assert sorted((r.z, r.x, r.y, round(r.height)) for r in out) == [(4, 8, 8, 300), (4, 20, 22, 200)]
    peaks = spark.createDataFrame([(0, 0, 0, 4, 8, 9)], "stack_id long, t int, fit_no long, z int, x int, y int")
    (r,) = fr.fit_peaks(peaks, frame_table(spark, [a]), 5, 2).collect()
    assert (r.z, r.x, r.y) == (4, 8, 8) and r.height == pytest.approx(300, rel=0.01)


def test_curated_spots_are_fitted_where_they_were_put(spark):
    grid = np.stack(np.meshgrid(np.arange(9.0), np.arange(30.0), np.arange(30.0), indexing="ij"), -1).reshape(-1, 3)
    a = kn.gaussian_values(np.array([[300.0, 4, 8, 8, 1, 1.2, 1.2]]), grid).reshape(9, 30, 30)
    kind = "stack_id long, spot_id long, t int, nuc_id int, z double, x double, y double, height double, width_z double, width_x double, width_y double"
    spots = spark.createDataFrame([(0, 5, t, 7, 4.0, 20.0, 20.0, 1.0, 1.0, 1.0, 1.0) for t in (0, 1)], kind)
    new = spark.createDataFrame([(0, 5, 0, 4.2, 8.4, 9.0), (0, 5, 9, 4.0, 8.0, 8.0)], "stack_id long, spot_id long, t int, z double, x double, y double")
    out = {r.t: r for r in sp.curate(spots, spots.filter("t = 0"), new, frame_table(spark, [a]), 5, 2).collect()}
    assert sorted(out) == [0, 1, 9] and {r.nuc_id for r in out.values()} == {7}
    want = kn.fit_gaussians(a[None, 2:7, 3:14, 4:15])[0][0]
    assert (out[0].z, out[0].x, out[0].y) == (4.2, 8.4, 9.0) and (out[0].height, out[0].width_z, out[0].width_x, out[0].width_y) == pytest.approx((want[0], *want[4:7]))
    assert out[0].height == pytest.approx(300, rel=0.01) and out[9].height is None
    with pytest.raises(ValueError):
        sp.curate(spots, spots.limit(0), new, frame_table(spark, [a]), 5, 2)


def test_segmentation_and_histograms(spark):
    a = CUBE * 100.0
    out = fr.label_frames(frame_table(spark, [a]), 0.0, 50.0).collect()
    assert len(out) == 27 and {r.label for r in out} == {1}
    (h,) = fr.scalespace_histograms(frame_table(spark, [a]), [0.01], 4, 0.0, 100.0).collect()
    assert h.hist == [7 * 81 - 27.0, 0, 0, 27]
    (s,) = fr.threshold_sweep(frame_table(spark, [a]), [50.0]).collect()
    assert (s.objects, s.mean_size) == (1, 27.0)


def test_circularity_orders_shapes(spark):
    yy, xx = np.mgrid[:41, :41]
    disk = ((xx - 20) ** 2 + (yy - 20) ** 2 <= 15**2).astype(int)[None]
    bar = np.zeros((1, 41, 41), dtype=int)
    bar[0, 5:8, 2:38] = 2
    out = {r.label: r.circularity for r in fr.circularity(label_table(spark, [disk + bar * (disk == 0)])).collect()}
    assert 0.85 < out[1] < 1.2 and out[2] < 0.6


def test_boxes_at_the_edge(spark):
    v = spark.createDataFrame([(0, 0, 0, z, x, y, 1.0) for z in range(5) for x in range(11) for y in range(11)], "stack_id long, c int, t int, z int, x int, y int, value double")
    spot = spark.createDataFrame([(0, 0, 1, 2.0, 5.0, 5.0)], "stack_id long, t int, spot_id long, z double, x double, y double")
    out = vx.spot_boxes(spot, v, 0, (7, 13, 13), 0.0).collect()
    assert len(out) == 7 * 13 * 13 and sum(r.value for r in out) == 5 * 11 * 11
    assert all((r.value == 1) == (abs(r.dz) <= 2 and abs(r.dx) <= 5 and abs(r.dy) <= 5) for r in out)


def test_read_frames(spark, tmp_path):
    for t in range(3):
        np.save(tmp_path / f"f{t}.npy", np.full((2, 3, 4), t, dtype=np.uint16))
    np.save(tmp_path / ".hidden.npy", np.zeros((1, 1, 1)))
    out = src.read_frames(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r.t, r.nz, r.nx, r.ny, r.pixels[0]) for r in out] == [(t, 2, 3, 4, float(t)) for t in range(3)]
    assert src.to_voxels(src.read_frames(spark, str(tmp_path)), ["t"]).count() == 3 * 24
    np.save(tmp_path / "g.npy", np.zeros((2, 3, 5)))
    with pytest.raises(ValueError, match="shape"):
        src.read_frames(spark, str(tmp_path))


def test_channels_and_span(spark):
    files = spark.createDataFrame([("a_CamA_0.npy",), ("a_CamB_0.npy",), ("a_CamA_1.npy",), ("a_CamB_1.npy",), ("x.txt",)], "name string")
    assert sorted((r.channel, r.t) for r in src.assign_channels(files).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    with pytest.raises(ValueError):
        src.assign_channels(files.filter("name <> 'a_CamB_1.npy'"))
    with pytest.raises(ValueError):
        src.span(spark.createDataFrame([(0,), (3,)], "t int"), 1, 5)


def test_text_round_trips(spark, tmp_path):
    e = spark.createDataFrame([("a", [1.0, 2.5]), (".b", [0.0, 0.0])], "name string, embedding array<double>")
    src.write_embeddings(e, str(tmp_path / "p"))
    assert [r.name for r in spark.read.parquet(str(tmp_path / "p")).collect()] == ["a"]
    src.export_embeddings(e, str(tmp_path / "t"))
    assert sorted(map(tuple, src.read_exported(spark, str(tmp_path / "t")).collect())) == [(".b", [0.0, 0.0]), ("a", [1.0, 2.5])]
    t = spark.createDataFrame([("a", "b", "c")], "anchor string, positive string, negative string")
    src.write_triplets(t, str(tmp_path / "x"))
    assert src.read_triplets(spark, str(tmp_path / "x")).collect() == t.collect()


def voxel_table(spark, a):
    return spark.createDataFrame([(0, 0, 0, *map(int, p), float(a[tuple(p)])) for p in np.ndindex(a.shape)], "stack_id long, c int, t int, z int, x int, y int, value double")


def test_beads_and_foci(spark):
    a = np.zeros((9, 24, 24))
    for c in ((4, 6, 6), (4, 16, 15), (1, 22, 3)):  # the last one's box leaves the image
        a[tuple(slice(x - 1, x + 2) for x in c)] = 50
        a[c] = 100
    v = voxel_table(spark, a)
    out = fr.bead_boxes(frame_table(spark, [a]), v, 20.0, (5, 5, 5)).collect()
    assert len(out) == 2 * 125 and all((r.value == 1) == (r.dz == r.dx == r.dy == 0) for r in out)
    nucleus = spark.createDataFrame([(0, 0, 4, x, y, 1) for x in range(2, 12) for y in range(2, 12)], "stack_id long, t int, z int, x int, y int, label int")
    foci = {(r.x, r.y) for r in fr.mask_foci(v, nucleus, (24, 24), 0.5, 3).collect()}
    assert (6, 6) in foci and (16, 15) not in foci and len(foci) < 50


def test_fits_of_labelled_objects(spark):
    grid = np.stack(np.meshgrid(np.arange(7.0), np.arange(20.0), np.arange(20.0), indexing="ij"), -1).reshape(-1, 3)
    a = kn.gaussian_values(np.array([[100.0, 3, 9, 10, 1, 1.5, 1.5]]), grid).reshape(7, 20, 20)
    labels = label_table(spark, [(a > 50).astype(int)])
    (r,) = fr.fit_labelled_objects(frame_table(spark, [a]), labels, 1, 3, 6, 3).collect()
    assert (r.fit_no, r.z, r.x, r.y) == (1, 3, 9, 10) and r.height == pytest.approx(100, rel=0.01) and r.width_x == pytest.approx(1.5, rel=0.02)


def test_stitched_movies(spark):
    from spotframe.operators.calib import stitch_labels

    rows = lambda t, labels: [(0, t, 0, k, 0, label) for k, label in enumerate(labels)]
    schema = "stack_id long, t int, z int, x int, y int, label int"
    a, b = spark.createDataFrame(rows(0, [4, 7]), schema), spark.createDataFrame(rows(0, [1, 2, 3]), schema)
    m = vx.match_labels(a, b, ["stack_id", "t"])
    out = {(r.t, r.x): r.label for r in stitch_labels(a, b, 5, m).collect()}
    assert out == {(0, 0): 4, (0, 1): 7, (5, 0): 4, (5, 1): 7, (5, 2): 8}


@pytest.mark.parametrize("kind", ["gaussian", "dog", "log", "gradient", "min", "max"])
def test_filters_of_frames_against_direct_sums(spark, kind):
    """Every kind at every pixel, edges included, as a sum (or extreme) over its window of the mirrored frame."""
    rng = np.random.default_rng(5)
    shape, sigma, wide = (3, 6, 5), 0.7, 1.1
    frames_in = [rng.integers(-50, 200, shape).astype(float) for _ in range(3)]
    df = spark.createDataFrame([(k, 0, 0, *shape, a.ravel().tolist()) for k, a in enumerate(frames_in)], "stack_id long, c int, t int, nz int, nx int, ny int, pixels array<float>")

    def at(a, p):
        place = [i % (2 * n) for i, n in zip(p, a.shape, strict=True)]
        return a[tuple(i if i < n else 2 * n - 1 - i for i, n in zip(place, a.shape, strict=True))]

    def bell(s):
        r = int(4 * s + 0.5)
        w = {d: math.exp(-0.5 * (d / s) ** 2) for d in range(-r, r + 1)}
        return {d: v / sum(w.values()) for d, v in w.items()}

    def weighted(a, axes):
        out = np.zeros(a.shape)
        for p in np.ndindex(a.shape):
            out[p] = sum(at(a, (p[0] + i, p[1] + j, p[2] + k)) * u * v * w for i, u in axes[0].items() for j, v in axes[1].items() for k, w in axes[2].items())
        return out

    def second(s):
        w = {d: v * (d * d / s**4 - 1 / s**2) for d, v in bell(s).items()}
        return {d: v - sum(w.values()) / len(w) for d, v in w.items()}

    def extreme(a, pick):
        return np.array([pick(at(a, (p[0] + i, p[1] + j, p[2] + k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0)) for p in np.ndindex(a.shape)]).reshape(a.shape)

    step, flat = {-1: -1.0, 0: 0.0, 1: 1.0}, {-1: 1.0, 0: 2.0, 1: 1.0}
    direct = {
        "gaussian": lambda a: weighted(a, [bell(sigma)] * 3),
        "dog": lambda a: weighted(a, [bell(sigma)] * 3) - weighted(a, [bell(wide)] * 3),
        "log": lambda a: sum(weighted(a, [second(sigma) if i == k else bell(sigma) for i in range(3)]) for k in range(3)),
        "gradient": lambda a: np.sqrt(sum(weighted(a, [step if i == k else flat for i in range(3)]) ** 2 for k in range(3))),
        "min": lambda a: extreme(a, min),
        "max": lambda a: extreme(a, max),
    }[kind]
    out = {r.stack_id: np.array(r.pixels).reshape(shape) for r in fr.filter_frames(df, kind, sigma, wide, (3, 3, 2)).collect()}
    for k, a in enumerate(frames_in):
        assert out[k] == pytest.approx(direct(a), abs=1e-2)
