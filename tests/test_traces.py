import numpy as np
import pytest
from pyspark.sql import functions as F

from spotframe.operators import tracks as tk
from spotframe.operators import traces as tr

SCHEMA = "stack_id long, spot_id long, t int, value double"


def table(spark, *series, stack=0):
    return spark.createDataFrame([(stack, s, t, v) for s, values in enumerate(series) for t, v in enumerate(values)], SCHEMA)


def values(df, column="value", spot=0):
    return [r[column] for r in sorted(df.filter(f"spot_id = {spot}").collect(), key=lambda r: r.t)]


@pytest.mark.parametrize("window, step, want", [(1, 1, [None] + [1.0] * 9), (2, 1, [None, None] + [1.0] * 8), (2, 2, [None] * 3 + [2.0] * 7)])
def test_derivative(spark, window, step, want):
    x = table(spark, [float(v) for v in range(1, 11)])
    assert values(tr.derivative(x, window, step), "slope") == want


def test_min_length(spark):
    x = table(spark, [1.0] * 5, [1.0] * 3 + [None] * 2, [1.0] * 2)
    for n, spots in ((2, {0, 1, 2}), (3, {0, 1}), (4, {0})):
        assert {r.spot_id for r in tr.filter_min_length(x, n).collect()} == spots


def test_align_at_the_ends(spark):
    x = table(spark, [0.0, 1.0, 2.0, 3.0])
    triggers = spark.createDataFrame([(0, 0, 0), (0, 0, 3)], "stack_id long, spot_id long, t int")
    out = {(r.trigger, r.offset): r.value for r in tr.align_traces(x, triggers, 3).collect()}
    assert out == {(0, -1): None, (0, 0): 0.0, (0, 1): 1.0, (3, -1): 2.0, (3, 0): 3.0, (3, 1): None}
    with pytest.raises(ValueError):
        tr.align_traces(x, triggers, 4)


def test_interpolation_counts_filled_values(spark):
    x = table(spark, [None, 8.0, None, None, 0.0, None])
    assert values(tr.trim_and_interpolate(x)) == [8.0, 4.0, 2.0, 0.0]
    assert len(tr.trim_and_interpolate(table(spark, [1.0, *[None] * 9, 1.0])).collect()) == 11
    with pytest.raises(Exception, match="reaches further"):
        tr.trim_and_interpolate(table(spark, [1.0, *[None] * 10, 1.0])).collect()


def test_smooth_keeps_a_constant_and_mirrors(spark):
    assert values(tr.smooth(table(spark, [3.0] * 6), 1.0)) == pytest.approx([3.0] * 6)
    x = np.array([0.0, 0, 0, 5, 0, 1, 0])
    ext = np.concatenate([x[::-1], x, x[::-1]])
    w = tr.gaussian_weights(1.0)
    want = [float(sum(w[k + 4] * ext[7 + i + k] for k in range(-4, 5))) for i in range(7)]
    assert values(tr.smooth(table(spark, x.tolist()), 1.0)) == pytest.approx(want)


def test_partial_autocorrelation_of_ar1():
    acf = [0.6**k for k in range(5)]
    assert tr.partial_autocorrelation(acf) == pytest.approx([1, 0.6, 0, 0, 0], abs=1e-12)


def test_ar2_is_recovered(spark):
    rng, x = np.random.default_rng(0), [0.0, 0.0]
    for _ in range(3000):
        x.append(0.5 + 0.4 * x[-1] - 0.3 * x[-2] + rng.normal())
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "stack_id long, pos long, value double")
    assert tr.fit_ar2(df) == pytest.approx((0.5, 0.4, -0.3), abs=0.08)


def test_two_states_follow_the_levels(spark):
    rng = np.random.default_rng(1)
    states = [np.repeat([0, 1, 0, 1], 15) for _ in range(4)]
    df = table(spark, *[(s * 10 + rng.normal(size=60)).tolist() for s in states])
    out = tk.two_state_bursts(df, 8)
    for k, s in enumerate(states):
        assert np.mean(np.array(values(out, "state", k)) == s) > 0.97
    changes = tr.state_changes(out).filter("spot_id = 0").groupBy("change").count().collect()
    assert {r.change: r["count"] for r in changes} == {1: 2, -1: 1}


FITS = "stack_id long, t int, fit_no long, z double, x double, y double"


def linked(spark, rows, **kw):
    df = spark.createDataFrame([(0, t, i, 0.0, float(x), 0.0) for i, (t, x) in enumerate(rows)], FITS)
    return [r.spot_id for r in sorted(tk.link_nearest(df, **kw).collect(), key=lambda r: r.fit_no)]


def test_linking_rules(spark):
    assert linked(spark, [(0, 0), (1, 3), (1, 1)]) == [0, 1, 0]  # the nearer comes second and wins
    assert linked(spark, [(0, 0), (1, 10)], max_jump=10) == [0, 0]  # exactly the largest jump
    assert linked(spark, [(0, 0), (1, 10.5)], max_jump=10) == [0, 1]
    assert linked(spark, [(0, 0), (1, 50), (2, 0)], max_gap=1) == [0, 1, 0]  # a gap of one
    assert linked(spark, [(0, 0), (1, 50), (2, 50), (3, 0)], max_gap=1) == [0, 1, 1, 2]
    assert linked(spark, [(0, 0), (2, 0)], max_gap=1) == [0, 1]  # a frame without spots ends it


def plain_links(t, xyz, max_gap, max_jump):
    """Spot after spot, on lists."""
    tracks = []
    for i in sorted(range(len(t)), key=lambda i: (t[i], i)):
        placed = False
        for lag in range(1, max_gap + 2):
            back = [(float(np.linalg.norm(xyz[j] - xyz[i])), k, j) for k, tr in enumerate(tracks) for j in tr if t[j] == t[i] - lag]
            if not back:
                break
            d, k, j = min(back)
            if d > max_jump:
                continue
            own = [x for x in tracks[k] if t[x] == t[i]]
            if own and d >= np.linalg.norm(xyz[own[0]] - xyz[j]):
                continue
            if own:
                tracks[k].remove(own[0])
                tracks.append([own[0]])
            tracks[k].append(i)
            placed = True
            break
        if not placed:
            tracks.append([i])
    return {frozenset(tr) for tr in tracks}


def test_links_against_plain_version():
    from spotframe.functions import kernels as kn

    rng = np.random.default_rng(3)
    for _ in range(30):
        t = np.sort(rng.integers(0, 8, 60))
        xyz = rng.normal(size=(60, 3)) * 3
        got = {}
        for i, k in enumerate(kn.link_nearest(t, xyz, 1, 4.0).tolist()):
            got.setdefault(k, set()).add(i)
        assert {frozenset(v) for v in got.values()} == plain_links(t, xyz, 1, 4.0)


def test_bumped_spot_begins_a_track_and_late_one_looks_further(spark):
    # frame 1: the second spot is nearer and bumps the first, which doesn't look at frame 0's other spots again
    assert linked(spark, [(0, 0), (1, 1), (2, 3), (2, 2)], max_gap=1) == [0, 0, 1, 0]
    # frame 2: the second spot comes too late for the nearest track of frame 1 and takes one that ended in frame 0
    assert linked(spark, [(0, 20), (0, 0), (1, 1), (2, 1), (2, 11)], max_gap=1, max_jump=10) == [0, 1, 1, 1, 0]


def test_link_by_nucleus(spark):
    labels = spark.createDataFrame([(0, t, 0, x, y, 1) for t in range(4) for x in range(9) for y in range(3)], "stack_id long, t int, z int, x int, y int, label int")
    rows = [(0, 0), (0, 5), (1, 1), (2, 8), (2, 2), (3, 30)]
    df = spark.createDataFrame([(0, t, i, 0.0, float(x), 0.0) for i, (t, x) in enumerate(rows)], FITS)
    out = sorted((r.t, r.x, r.spot_id) for r in tk.link_by_nucleus(df, labels, (1, 40, 3)).collect())
    assert out == [(0, 0.0, 1), (1, 1.0, 1), (2, 2.0, 1)]  # first of frame 0; the nearer in frame 2; background gone


def test_tracks_carry_over_a_gap(spark):
    box = lambda t, x0, label: [(0, t, 0, x, 0, label) for x in range(x0, x0 + 4)]
    rows = box(0, 0, 5) + box(0, 10, 6) + box(1, 10, 1) + box(2, 1, 2) + box(2, 20, 3)
    labels = spark.createDataFrame(rows, "stack_id long, t int, z int, x int, y int, label int")
    out = {(r.t, r.label): r.track for r in tk.track_labels(labels).select("t", "label", "track").distinct().collect()}
    assert out[(1, 1)] == out[(0, 6)] and out[(2, 2)] == out[(0, 5)] and len({*out.values()}) == 3


def test_random_controls_stay_in_the_nucleus(spark):
    rows = [(0, 0, 1, x, y, 7) for x in range(5) for y in range(5)]
    labels = spark.createDataFrame(rows, "stack_id long, t int, z int, x int, y int, label int")
    spots = spark.createDataFrame([(0, 3, 0, 1.2, 7)], "stack_id long, spot_id long, t int, z double, nuc_id int")
    out = tk.random_controls(spots, labels, 10, 1).collect()
    assert len(out) == 10 and all((0, 0, r.z, r.x, r.y, 7) in rows for r in out) and len({(r.x, r.y) for r in out}) > 3


def test_shuffle_is_one_order(spark):
    x = table(spark, *[[1.0]] * 20)
    a, b = ({r.spot_id: r.place for r in tr.shuffle_spots(df, 3).collect()} for df in (x, x.withColumn("value", F.lit(2.0))))
    assert a == b and sorted(a.values()) == list(range(20)) and [a[k] for k in range(20)] != list(range(20))


def test_forward_backward_against_all_paths():
    import itertools

    from spotframe.functions import kernels as kn

    p = {"means": np.array([0.1, 0.8]), "stds": np.array([0.3, 0.2]), "start": np.array([0.6, 0.4]), "moves": np.array([[0.7, 0.3], [0.4, 0.6]])}
    x = np.random.default_rng(1).random((3, 5))
    g, xi, _ = kn.forward_backward(x, **p)
    best, moves = kn.viterbi(x, **p), np.zeros((2, 2))
    for k in range(3):
        weight = {}
        for path in itertools.product((0, 1), repeat=5):
            q = p["start"][path[0]]
            for a, b in zip(path, path[1:]):
                q *= p["moves"][a, b]
            for v, s in zip(x[k], path, strict=True):
                q *= np.exp(-0.5 * ((v - p["means"][s]) / p["stds"][s]) ** 2) / p["stds"][s]
            weight[path] = q
        total = sum(weight.values())
        assert tuple(best[k]) == max(weight, key=weight.get)
        for path, q in weight.items():
            for a, b in zip(path, path[1:]):
                moves[a, b] += q / total
        for i in range(5):
            assert abs(g[k, i, 1] - sum(q for path, q in weight.items() if path[i]) / total) < 1e-9
    assert np.allclose(xi, moves)


def test_tracks_do_not_hang_on_the_parts(spark):
    """Objects that end and begin elsewhere cut the stack; numbers go on over the cuts."""
    box_ = lambda t, x, label: [(0, t, 0, x + a, b, label) for a in range(3) for b in range(3)]
    rows = box_(0, 0, 1) + box_(1, 0, 4) + box_(2, 30, 1) + box_(3, 30, 1) + box_(3, 60, 2) + box_(7, 0, 1)
    labels = spark.createDataFrame(rows, "stack_id long, t int, z int, x int, y int, label int")
    out = {(r.t, r.label): r.track for r in tk.track_labels(labels).select("t", "label", "track").distinct().collect()}
    assert out == {(0, 1): 1, (1, 4): 1, (2, 1): 2, (3, 1): 2, (3, 2): 3, (7, 1): 4}


def test_lags_over_blocks(spark, monkeypatch):
    """Rows before, not positions before: gaps may be wider than blocks, and blocks may have one row."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(tr, "BLOCK", 4)
    rows = [(s, int(p), None if rng.random() < 0.1 else float(p * 10 + s)) for s in range(3) for p in sorted(rng.choice(120, 30, replace=False))]
    df = spark.createDataFrame(rows, "stack_id int, pos int, value double")
    got = {(r.stack_id, r.pos): list(r._lags) for r in tr.lagged(df, 3).collect()}
    for s in range(3):
        own = [(p, v) for k, p, v in rows if k == s]
        for i, (p, _) in enumerate(own):
            assert got[s, p] == [own[i - k][1] if i >= k else None for k in (1, 2, 3)]
    assert tr.lagged(df.limit(0), 2).count() == 0
