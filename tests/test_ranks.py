"""Selected order statistics are those of the sorted values."""

import numpy as np
import pytest

from spotframe.operators import ranks


@pytest.mark.parametrize("small", [1, 40, 1 << 16])
def test_quantiles_of_groups_of_all_shapes(spark, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL", small)
    monkeypatch.setattr(ranks, "GRID", 20)
    rng = np.random.default_rng(6)
    groups = {1: rng.normal(size=900), 2: rng.integers(0, 4, 800) * 1.0, 3: np.full(500, 7.5), 4: 10.0 ** rng.uniform(-300, 300, 700), 5: [3.25], 6: np.append(rng.normal(size=50), [1e300, -1e300]), None: np.arange(120.0)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, None), (9, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    fractions = [0.0, 0.05, 0.5, 0.951, 1.0]
    got = {r.k: r.q for r in ranks.quantiles(df, ["k"], "v", fractions).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s, n = np.sort(vs), len(vs)
        for p, q in zip(fractions, got[k], strict=True):
            lo, hi = s[int(np.floor(p * (n - 1)))], s[int(np.ceil(p * (n - 1)))]
            want = lo + (hi - lo) * (p * (n - 1) - np.floor(p * (n - 1)))
            assert q == pytest.approx(want, rel=1e-9, abs=1e-12), (k, p)


def test_no_values(spark):
    assert ranks.quantiles(spark.createDataFrame([(1, None)], "k int, v double"), ["k"], "v", [0.5]).count() == 0
