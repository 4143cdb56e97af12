import numpy as np
import pytest

from spotframe.llm import decontamination as d


def brute(index, terms, threshold):
    score = {}
    for t in terms:
        for p in range(index.first[t], index.first[t + 1]):
            score[int(index.items[p])] = score.get(int(index.items[p]), 0) + float(index.impacts[p])
    return sorted(k for k, s in score.items() if s >= threshold - 1e-9)


def words(rng, n):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 400)


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.6])
def test_wand_finds_all_above_the_threshold(threshold, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 3)
    rng = np.random.default_rng(1)
    items = [(i, words(rng, int(rng.integers(5, 40)))) for i in range(150)]
    index = d.build(items)
    hits = 0
    for i in range(60):
        text = words(rng, 50) + " " + (items[i][1] if i % 2 else "")
        terms = sorted({index.vocabulary[w] for w in d.words_of(text) if w in index.vocabulary})
        got = d.wand(index, terms, threshold)
        assert sorted(k for k, _ in got) == brute(index, terms, threshold)
        hits += len(got)
    assert hits > 10


def plain(items, text):
    """All items against the whole text, by shingles alone."""
    out = []
    for i, t in items:
        q, a = (d.shingles(x) for x in d.question_and_answer(t))
        n = len(next(iter(q)))
        have = {tuple(w[i : i + n]) for w in [d.words_of(text)] for i in range(len(w) - n + 1)}
        if q and len(q & have) / len(q) >= 0.8 and (not a or len(a & have) / len(a) >= 0.8):
            out.append(i)
    return sorted(out)


def test_table_against_all_items(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = d.contaminated(docs, bench).collect()
    assert len(rows) == docs.count() and rows[0].__fields__ == [*docs.columns, "leaks"]
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in rows}
    assert got == {r.doc_id: plain(items, r.text) for r in rows}
    assert sum(map(bool, got.values())) >= 1


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(d, "ITEMS", 2)
    rng = np.random.default_rng(2)
    passage = [words(rng, 30) for _ in range(4)]
    bench = spark.createDataFrame([(0, passage[0]), (1, passage[1]), (1, passage[1]), (2, ""), (3, None), (None, passage[2]), (5, "What is it? Forty two.")], "item_id long, text string")
    long = words(rng, 30_000)
    rows = [(1, None), (2, ""), (3, f"a b {passage[0].upper()} c"), (3, f"a b {passage[0].upper()} c"), (None, f"{long} {passage[1]} {long}"), (5, passage[2]), (6, passage[3]), (7, " ".join(passage[0].split()[:20])), (8, "what is it? forty two"), (9, "what is it to me? forty two")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, leaks string")
    got = sorted(((r.doc_id, sorted((x.item_id for x in r.leaks), key=str)) for r in d.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [0]), (3, [0]), (None, [1]), (5, [None]), (6, []), (7, []), (8, [5]), (9, [])], key=str)
    assert all(not r.leaks for r in d.contaminated(docs, bench.filter("item_id > 50")).collect())
    assert d.contaminated(docs.filter("doc_id > 50"), bench).collect() == []


def test_scores_do_not_hang_on_the_blocks(spark, sf, monkeypatch):
    """Statistics are those of all items, however many indexes they fill; documents are written between passes."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    shown = lambda df: sorted((r.doc_id, sorted((x.item_id, round(x.score, 9), x.overlap) for x in r.leaks)) for r in df.collect())
    want = shown(d.contaminated(docs, bench))
    assert any(leaks for _, leaks in want)
    monkeypatch.setattr(d, "ITEMS", 12)
    assert shown(d.contaminated(docs, bench)) == want
    monkeypatch.setattr(d, "ITEM_BYTES", 3000)
    assert shown(d.contaminated(docs, bench)) == want
    one = d.statistics_of([(r.item_id, r.text) for r in bench.distinct().collect()])
    blocks = list(d.item_blocks(bench))
    assert len(blocks) > 2 and all(s.n == one.n and abs(s.mean - one.mean) < 1e-9 and all(one.df[w] == n for w, n in s.df.items()) for _, s, _ in blocks)
