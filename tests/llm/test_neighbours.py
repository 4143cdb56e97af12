import math

import numpy as np

from spotframe.llm import neighbours


def brute(rows, every=50, k=5):
    fine = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)]
    x = np.array([v for _, v in fine])
    out = {}
    for i, q in fine:
        if i % every == 0:
            s = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
            out[i] = sorted({(-a, j) for a, (j, _) in zip(s.tolist(), fine) if j != i})[:k]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(have, want):
    return np.mean([len({v for _, v in have.get(q, [])} & {v for _, v in w}) / len(w) for q, w in want.items()])


def test_recall_of_the_shipped_settings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    have, want = got(neighbours.nearest(df)), brute(rows)
    assert recall(have, want) >= 0.98
    exact = {q: dict((v, s) for s, v in w) for q, w in brute(rows, k=len(rows)).items()}
    assert all(exact[q][v] == s for q, w in have.items() for s, v in w)


def test_dense_group(spark):
    """A third of the rows around one point, closer to each other than the codes can tell, and multiples of one vector."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64))
    centre = rng.normal(size=64)
    x[:1200] = centre + 0.3 * rng.normal(size=(1200, 64))
    x[1200:2000] = centre + 0.02 * rng.normal(size=(800, 64))
    x[2000:2100] = centre * np.arange(1, 101)[:, None]
    ids = rng.permutation(6000)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    have, want = got(neighbours.nearest(df)), brute(rows)
    assert recall(have, want) >= 0.98
    inside = {int(i) for i in ids[:2000]}
    assert recall(have, {q: w for q, w in want.items() if q in inside}) >= 0.95


def test_extreme_magnitudes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 8))
    plain = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(i, (v * 2.0 ** (0, 660, -700, -1000)[i % 4]).tolist()) for i, v in enumerate(x)]
    run = lambda rows: got(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert run(odd) == run(plain) == brute(plain)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, -0.0]), (2, [1.0, 1.0, 0.0]), (50, [0.0, 1.0, 0.0]), (50, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 1.0, 0.0]), (7, [None, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (100, [0.0, 0.0, 0.0]), (8, []), (9, [1.0, 0.0, 0.0])]
    rows += [(1000 + i * 7, [0.5, 0.5, 0.5]) for i in range(40)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, ids string")
    assert got(neighbours.nearest(df)) == brute(rows)
    ragged = df.unionByName(spark.createDataFrame([(150, [1.0, 2.0], "x"), (151, [1.0], "x")], df.schema))
    assert got(neighbours.nearest(ragged)) == brute(rows)
    few = df.filter("vec_id in (0, 1)")
    assert got(neighbours.nearest(few)) == {0: [(-1.0, 1)]}
    assert got(neighbours.nearest(df.filter("vec_id < 0"))) == {}


def test_anisotropic_codes_keep_the_products_of_near_neighbours():
    """Errors of the products of queries with their nearest rows fall against the plain loss, on whole vectors."""
    x = neighbours.unit(np.random.default_rng(0).normal(size=(4000, 64)))
    q = neighbours.unit(x[:200] + 0.12 * np.random.default_rng(1).normal(size=(200, 64)))
    gaps = []
    for eta in (1.0, neighbours.weight_of(64)):
        books = neighbours.fit_books(x, eta)
        codes, left = neighbours.encode(x, books, eta)
        codes = np.ascontiguousarray(codes.T)
        table = neighbours.tables(q, books)
        gaps.append(np.mean([abs(neighbours.scan(codes[:, i : i + 1], table[i])[0] - x[i] @ q[i]) for i in range(200)]))
    assert neighbours.weight_of(64) > 2 and gaps[1] < 0.85 * gaps[0]


def test_descent_does_not_raise_the_loss():
    x = neighbours.unit(np.random.default_rng(3).normal(size=(500, 10)))
    eta = 5.0
    books = neighbours.fit_books(x, eta)
    parts = neighbours.cut(x)

    def loss(sweeps):
        codes, along = neighbours.codes_of(parts, books, eta, sweeps)
        r = x - np.concatenate([books[s][codes[:, s]] for s in range(len(books))], axis=1)
        assert np.allclose((r * x).sum(axis=1), along)
        return (r**2).sum(axis=1) + (eta - 1) * along**2

    assert (loss(3) <= loss(2) + 1e-12).all() and loss(4).mean() < loss(1).mean()
    codes, left = neighbours.encode(x, books, eta)
    assert codes.shape == (500, 3) and (left > 0).all()
