"""Components, walks over them, and links of dense movies against the whole-stack kernel."""

import random

import numpy as np
import pytest

from spotframe.functions import kernels as kn
from spotframe.operators import graph
from spotframe.operators import tracks as tk


def literal_roots(links):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {a: find(a) for a in list(root)}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_components_against_union_find(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "ONE_TASK", limit)
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 160)] + [(-5, k) for k in range(300, 340)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    links += [(b, a) for a, b in links[:20]] + [(2**62, -(2**62))]
    rows = [*links, (7, 7), (None, 3), (4, None)]
    got = graph.components(spark.createDataFrame(rows, "a long, b long")).collect()
    want = literal_roots([(a, b) for a, b in links if a != b])
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def movie(rng, stacks, frames, spots, spread, lattice=False):
    rows = []
    for s in range(stacks):
        for t in range(frames):
            if rng.random() < 0.1:
                continue
            for _ in range(rng.poisson(spots)):
                at = rng.integers(0, spread, 3) * 1.0 if lattice else rng.random(3) * spread
                rows.append((s, t, len(rows), *map(float, at)))
    return rows


def by_kernel(rows, max_gap, max_jump, xy, z):
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]))
        at = np.array([[r[3] * z, r[4] * xy, r[5] * xy] for r in own])
        first = {}
        for r, k in zip(own, kn.link_nearest(np.array([r[1] for r in own]), at, max_gap, max_jump).tolist()):
            first.setdefault(k, len(first))
            out[r[0], r[2]] = k
        order = {k: i for i, k in enumerate(first)}
        out |= {key: order[k] for key, k in out.items() if key[0] == s}
    return out


@pytest.mark.parametrize("shape", [(3, 12, 20, 12, False, 1, 2.0), (2, 10, 25, 5, True, 2, 1.5), (2, 15, 12, 40, False, 0, 6.0), (1, 6, 30, 3, True, 1, 0.0)])
def test_links_of_dense_movies_are_those_of_the_kernel(spark, shape):
    stacks, frames, spots, spread, lattice, gap, jump = shape
    rows = movie(np.random.default_rng(7), stacks, frames, spots, spread, lattice)
    df = spark.createDataFrame(rows, "stack_id long, t int, fit_no long, z double, x double, y double").repartition(5)
    got = tk.link_nearest(df.withColumn("extra", df.x * 2), gap, jump, scale_xy=1.25, scale_z=0.5)
    assert got.columns == [*df.columns, "extra", "spot_id"]
    assert {(r.stack_id, r.fit_no): r.spot_id for r in got.collect()} == by_kernel(rows, gap, jump, 1.25, 0.5)


def test_tiles_meet_over_their_borders(spark, monkeypatch):
    monkeypatch.setattr(tk, "TILE", 1)
    rows = movie(np.random.default_rng(9), 2, 8, 40, 9)
    df = spark.createDataFrame(rows, "stack_id long, t int, fit_no long, z double, x double, y double")
    assert {(r.stack_id, r.fit_no): r.spot_id for r in tk.link_nearest(df, 1, 1.5).collect()} == by_kernel(rows, 1, 1.5, 1.0, 1.0)


def test_repeated_spots_and_spots_without_a_place(spark):
    rows = [(0, 0, 1, 1.0, 1.0, 1.0), (0, 0, 1, 1.0, 1.0, 1.0), (0, 1, 2, 1.0, 1.0, 1.5), (0, 1, 3, None, 1.0, 1.0), (0, 2, 4, 1.0, 1.0, None)]
    got = tk.link_nearest(spark.createDataFrame(rows, "stack_id long, t int, fit_no long, z double, x double, y double"), 1, 2.0).collect()
    by = {(r.t, r.fit_no): r.spot_id for r in got if r.fit_no > 1}
    assert len(got) == 5 and sorted(r.spot_id for r in got if r.fit_no == 1) == [0, 1]
    assert by[1, 2] == 0 and len({by[1, 3], by[2, 4], 0, 1}) == 4


def test_a_dense_stack_runs_in_many_groups(spark):
    """Far apart spots that move a little: a component each, in one stack without an empty frame."""
    rows = [(0, t, t * 50 + k, 0.0, k * 100.0 + t % 3, 0.0) for t in range(20) for k in range(50)]
    df = spark.createDataFrame(rows, "stack_id long, t int, fit_no long, z double, x double, y double")
    out = tk.link_nearest(df, 1, 5.0)
    assert {(r.fit_no % 50): r.spot_id for r in out.collect()} == {k: k for k in range(50)}
    labels = [(0, t, 0, 2 * k + t % 2, y, k + 1) for t in range(6) for k in range(30) for y in range(3)]
    tracked = tk.track_labels(spark.createDataFrame([r for r in labels] + [(0, t, 0, 2 * k + 1 - t % 2, 1, k + 1) for t in range(6) for k in range(30)], "stack_id long, t int, z int, x int, y int, label int"))
    assert {(r.label, r.track) for r in tracked.collect()} == {(k + 1, k + 1) for k in range(30)}


def literal_tracks(labels, max_skip):
    """Tracks of one stack, frame after frame, on dictionaries of pixels."""
    frames: dict = {}
    for t, x, y, label in labels:
        frames.setdefault(t, {}).setdefault(label, set()).add((x, y))
    tracks, free = {}, 1
    for t in sorted(frames):
        offers = []
        for lag in range(1, max_skip + 2):
            back = frames.get(t - lag, {})
            n = {(a, b): len(frames[t][a] & back[b]) for a in frames[t] for b in back if frames[t][a] & back[b]}
            for (a, b), k in n.items():
                best_b = max((m, q) for (p, q), m in n.items() if p == a)[1]
                best_a = max((m, p) for (p, q), m in n.items() if q == b)[1]
                if best_b == b and best_a == a:
                    offers.append((lag, -k, a, b))
        mine, taken = {}, set()
        for lag, _, a, b in sorted(offers):
            old = tracks[t - lag, b]
            if a not in mine and old not in taken:
                mine[a] = old
                taken.add(old)
        for a in sorted(frames[t]):
            if a not in mine:
                mine[a], free = free, free + 1
            tracks[t, a] = mine[a]
    return tracks


def test_label_tracks_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    labels = [(t, x, y, int(rng.integers(1, 7))) for t in range(12) if t != 5 for x in range(8) for y in range(8) if rng.random() < 0.7]
    df = spark.createDataFrame([(0, t, 0, x, y, k) for t, x, y, k in labels], "stack_id long, t int, z int, x int, y int, label int")
    got = {(r.t, r.label): r.track for r in tk.track_labels(df, 2).collect()}
    assert got == literal_tracks(labels, 2)


def test_components_by_blocks(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(0, 400, size=(500, 2))
    rows = [(int(a), int(b), int(a) // 50, int(b) // 50) for a, b in n]
    links = spark.createDataFrame(rows, "a long, b long, x long, y long")
    plain = {r.node: r.root for r in graph.components(links.select("a", "b")).collect()}
    assert {r.node: r.root for r in graph.components(links).collect()} == plain


@pytest.mark.parametrize("kind", ["lattice", "cloud", "line", "one place", "far"])
def test_nearest_in_cells_is_the_nearest_of_all(kind):
    from spotframe.functions import kernels as kn

    rng = np.random.default_rng(7)
    made = {"lattice": lambda n: rng.integers(0, 12, size=(n, 3)) * 1.0, "cloud": lambda n: rng.normal(size=(n, 3)) * 8, "line": lambda n: np.column_stack([rng.uniform(0, 50, n), np.ones((n, 2))])}
    made |= {"one place": lambda n: np.ones((n, 3)), "far": lambda n: rng.choice([0.0, 1e6], size=(n, 3)) + rng.normal(size=(n, 3))}
    a, b = made[kind](150), made[kind](200)
    for most in (0.0, 1.0, 4.0, 1e7):
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        want = np.nonzero((d == d.min(axis=1)[:, None]) & (d <= most))
        r, c, far = kn.nearest_within(a, b, most, pairs=500)
        assert r.tolist() == want[0].tolist() and c.tolist() == want[1].tolist() and (far == d[r, c]).all()
