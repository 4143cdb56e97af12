import numpy as np
import pytest
from xxhash import xxh64_intdigest

from spotframe.llm import simhash


def plain_fingerprint(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """Union-find over all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = np.array([f for _, f in rows], dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", ["", " \n", "One", "a B c", "É À b c d e", "a a a a a a", "x\x0by z w q　r s t", "w " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_anchors_meet_every_pair_of_a_segment():
    rng = np.random.default_rng(1)
    v = rng.integers(-(2**63), 2**63 - 1, 200)
    rows, anchors, homes = simhash.anchors_of(v)
    at = {}
    for r, a, h in zip(rows, anchors, homes, strict=True):
        at.setdefault(int(r), []).append((int(a), bool(h)))
    for i in range(200):
        flips = rng.choice(64, 4, replace=False)
        w = v[i : i + 1] ^ np.array([sum(1 << int(f) for f in flips)], dtype=np.uint64).view(np.int64)
        _, other, _ = simhash.anchors_of(w)
        assert {a for a, h in at[i] if h} & set(other.tolist())


def check(spark, rows, block=None):
    if block:
        old, simhash.BLOCK = simhash.BLOCK, block
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, extra int")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    fps = [(r[0], plain_fingerprint(r[1] or "")) for r in rows]
    want = sorted([(d, f"{f:016x}", c) for (d, f), c in zip(fps, plain_components(fps), strict=True)], key=str)
    if block:
        simhash.BLOCK = old
    assert got == want


def test_odd_rows(spark):
    check(spark, [(5, "a b c d e", "x", 1), (5, "a b c d e", "x", 1), (3, "A b C d e", None, None), (None, "a b c d e", "", 2), (9, None, "", 3), (2, "", "", 3), (7, "\n", "", 3), (None, "alone here", "", 1)])


def test_empty(spark):
    check(spark, [])


def test_table_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text, "", 0) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    long = " ".join(f"w{i}" for i in range(3000))
    rows += [(10_000 + k, f"{long} end{k}", "", 0) for k in range(60)]
    check(spark, rows)
    check(spark, rows, block=4)
