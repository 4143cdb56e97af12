import hashlib
from collections import Counter

import numpy as np
import pytest

from spotframe.llm import suffixes


def plain(rows, length):
    """Every window counted in a dictionary."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone[:-1]])
        out.append((doc, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, length=200):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, h string")
    out = suffixes.deduplicate(df, length).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out), key=str)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "anble", "thtion", "é", "ñoll", "er"], n).tolist())


@pytest.mark.parametrize("group", [4096, 3])
def test_planted(spark, group, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = np.random.default_rng(3)
    common = words(rng, 70)
    rows = [(i, words(rng, 60) + common + words(rng, 60)) for i in range(25)]
    rows += [(40 + i, words(rng, 200)) for i in range(10)]
    rows += [(60, rows[3][1]), (60, rows[3][1]), (61, rows[3][1][:150] + "X" + rows[3][1][151:])]
    rows += [(70, "ab" * 400), (71, "a" * 199), (72, "a" * 200), (73, "a" * 201), (74, None), (75, ""), (None, "b" * 300), (None, "b" * 250)]
    rows += [(80, "".join(f"line {k} of a list;" for k in range(60))), (81, "".join(f"line {k} of a list;" for k in range(20, 70)))]
    assert got(spark, rows) == plain(rows, 200)


def test_empty(spark):
    assert got(spark, []) == []


def test_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(spark, rows) == plain(rows, 200)


@pytest.mark.parametrize("length", [65, 70, 128, 200, 300])
def test_suffix_array_and_factors(length):
    rng = np.random.default_rng(length)
    data = np.concatenate([rng.integers(97, 99, 1500).astype(np.uint8), np.tile(np.frombuffer(b"abcde", dtype=np.uint8), 80)])
    data = np.concatenate([data, data[200:700], np.zeros(length + 8, dtype=np.uint8)])
    starts = np.arange(0, len(data) - 2 * length, 3)
    order, common = suffixes.suffix_array(data, starts, length)
    text = [bytes(data[s : s + length]) for s in starts]
    want = sorted(range(len(starts)), key=lambda i: (text[i], i))
    assert order.tolist() == want

    def both(a, b):
        return next((k for k in range(length) if a[k] != b[k]), length)

    assert common.tolist() == [0] + [both(text[a], text[b]) for a, b in zip(want, want[1:])]
    few = range(0, len(starts), 7)
    before, after = suffixes.longest_factors(order, common), suffixes.longest_factors(order, common, later=True)
    for i in few:
        assert before[i] == max((both(text[i], text[j]) for j in range(i)), default=0)
        assert after[i] == max((both(text[i], text[j]) for j in range(i + 1, len(starts))), default=0)


def test_long_texts_against_short_ones(spark):
    """Texts over the size of a chunk share passages with short texts, also over the cuts between their pieces."""
    rng = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnop qrstuv"))
    long = "".join(rng.choice(letters, 2_300_000).tolist())
    short = [(i, "x" * 50 + long[at : at + 400] + "y" * 50) for i, at in enumerate((0, suffixes.CHUNK - 200, suffixes.CHUNK - 1, 2 * suffixes.CHUNK - 150, 1_500_000, 2_299_600))]
    rows = [(100, long), (101, long[:1_200_000][::-1]), *short]
    assert got(spark, rows) == plain(rows, 200)


def test_one_letter(spark):
    """A run of one letter is few segments, not one for each byte."""
    doc, start, size, _, merged = suffixes.segments([b"a" * 2_000_000, b"ab" * 300_000], 200)
    assert len(doc) < 10 and size.sum() > 2_600_000 and merged.all()
    rows = [(1, "z" * 2_000_000), (2, "the end " + "z" * 250), (3, "ab" * 300_000), (4, "q" * 200), (5, "abc" * 66 + "ab"), (6, "abc" * 66 + "abc")]
    out = {r[0]: r[2:4] for r in got(spark, rows)}
    assert out == {1: (2_000_000, 1), 2: (250, 1), 3: (600_000, 1), 4: (0, 0), 5: (200, 1), 6: (200, 1)} and out[6] == (200, 1)


def test_parts_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 3000)
    rows = [(k, "w" * (500 + k)) for k in range(12)] + [(20 + k, "of the " * (40 + k)) for k in range(9)]
    assert got(spark, rows) == plain(rows, 200)


def test_segments_do_not_hang_on_the_chunk():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 5000).astype(np.uint8).tobytes()
    filler = rng.integers(97, 123, 900_000).astype(np.uint8).tobytes()
    alone = set(zip(*(x.tolist() for x in suffixes.segments([text], 200)[1:]), strict=True))
    beside = suffixes.segments([filler, text], 200)
    assert alone == {r[1:] for r in zip(*(x.tolist() for x in beside), strict=True) if r[0] == 1}
