import itertools
import zlib

import numpy as np

from spotframe.llm import langid


def model_of(weights=None):
    rng = np.random.default_rng(4)
    return langid.Model(["a", "b", "c"], rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32), rng.normal(size=(3, 3)), rng.normal(size=3))


def test_forward_backward_against_all_paths():
    m = model_of()
    rng = np.random.default_rng(5)
    emit = rng.normal(size=(6, 3)).astype(np.float32)
    sizes = np.array([4, 1, 0, 5])
    index = rng.integers(0, 6, sizes.sum())
    got = np.zeros((len(index), 3))
    m.posteriors(emit, index, sizes, lambda at, p: got.__setitem__(at, p))
    at = 0
    for n in sizes:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = sum(emit[index[at + t]][y] for t, y in enumerate(path)) + (m.starts[path[0]] if n else 0) + sum(m.moves[x, y] for x, y in zip(path, path[1:]))
            for t, y in enumerate(path):
                want[t, y] += np.exp(s)
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-4)
        at += n


def test_words_do_not_meet():
    alone = [model_of().scores([w])[0] for w in ("abc", "", "x\x02y", "é\x03")]
    together = model_of().scores(["abc", "", "x\x02y", "é\x03"])
    assert np.allclose(alone, together, atol=1e-4)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    out = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text and len(r.text.split()) > 3]
    assert all(out[r.doc_id].held_out for r in held) and len(held) > 20
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())


def fitted(texts, langs):
    v = langid.Vocabulary()
    for t, g in zip(texts, langs, strict=True):
        v.add(t, g)
    return langid.fit(v)


def log_likelihood(emit, index, sizes, y, moves, starts):
    """By enumeration of all paths."""
    out, at = 0.0, 0
    for n in sizes:
        def of(path):
            return sum(emit[index[at + t]][g] for t, g in enumerate(path)) + starts[path[0]] + sum(moves[a, b] for a, b in zip(path, path[1:]))  # noqa: B023

        out += of(y[at : at + n]) - np.log(sum(np.exp(of(p)) for p in itertools.product(range(3), repeat=int(n))))
        at += n
    return out


def test_gradients_against_differences():
    rng = np.random.default_rng(6)
    sizes = np.array([5, 1, 3])
    emit, index, y = rng.normal(size=(9, 3)), np.arange(9), rng.integers(0, 3, 9)
    m = model_of()
    gap, moves, starts = m.gradients(emit, index, sizes, y)
    for value, got in ((emit, gap), (m.moves, moves), (m.starts, starts)):
        for at in np.ndindex(value.shape):
            old, both = value[at], []
            for d in (1e-4, -1e-4):
                value[at] = old + d
                both.append(log_likelihood(emit, index, sizes, y, m.moves, m.starts))
            value[at] = old
            assert abs(got[at] + (both[0] - both[1]) / 2e-4) < 1e-3


def test_code_switched_words():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(v, 30)) for v in (["haus", "und", "schule"], ["casa", "que", "mente"]) for _ in range(40)]
    m = fitted(texts, ["de"] * 40 + ["es"] * 40)
    words = ["haus", "und", "12", "schule", "casa", "que", "77", "mente"]
    p = np.zeros((8, 2))
    m.posteriors(m.scores(words), np.arange(8), np.array([8]), lambda at, q: p.__setitem__(at, q))
    assert p.argmax(axis=1)[[0, 1, 3, 4, 5, 7]].tolist() == [0, 0, 0, 1, 1, 1]
    assert m.moves[0, 0] > m.moves[0, 1] and m.moves[1, 1] > m.moves[1, 0]


def test_planted_mixtures_of_the_table(spark, sf):
    """Stretches of 12 words of held-out documents, one language after the other: words get their own language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = langid.train(docs)
    rng = np.random.default_rng(3)
    held = {}
    for r in docs.filter(langid.held_out() & langid.F.col("lang").isNotNull()).orderBy("doc_id").collect():
        words = [w for w in (r.text or "").lower().split() if w.isalpha()]
        if len(words) >= 40:
            held.setdefault(r.lang, []).append(words)
    right = n = 0
    for _ in range(40):
        words, want = [], []
        for g in rng.permutation(sorted(held))[:3]:
            own = held[g][rng.integers(len(held[g]))]
            at = int(rng.integers(len(own) - 12))
            words += own[at : at + 12]
            want += [m.labels.index(g)] * 12
        p = np.zeros((len(words), len(m.labels)))
        m.posteriors(m.scores(words), np.arange(len(words)), np.array([len(words)]), p.__setitem__)
        right += (p.argmax(axis=1) == want).sum()
        n += len(want)
    assert right / n > 0.9


def test_reject(spark, sf):
    """Junk of letters and a language of another kind go, clean held-out documents stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = langid.train(docs)
    assert 0 < m.least_known < 1
    rng = np.random.default_rng(8)
    letters = np.array(list("bcdfghjklmnpqrstvwxzqxz"))
    junk = [" ".join("".join(rng.choice(letters, rng.integers(4, 11))) for _ in range(200)) for _ in range(20)]
    other = ["".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9FFF, 100)) for _ in range(5)] + [" ".join("кожен день вони шукали дорогу через ліс".split() * 10)]
    bad = spark.createDataFrame([(900_000 + k, t, None, "x", len(t)) for k, t in enumerate(junk + other)], docs.schema)
    kept = {r.doc_id for r in langid.accept(docs.unionByName(bad), m).collect()}
    assert not any(d >= 900_000 for d in kept)
    clean = [r.doc_id for r in docs.collect() if r.lang and r.text and len(r.text.split()) > 20]
    assert all(d in kept for d in clean)


def test_odd_rows(spark):
    rows = [(1, "haus und schule", "de", 1), (1, "haus und schule", "de", 1), (2, None, "es", 1), (3, "", None, 1), (4, " 12 .. \x02", "es", 1), (None, "casa que", "es", 1), (6, "casa mente", "es", 1), (7, "x" * 200_000, "es", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    out = langid.identify(df, langid.train(df)).collect()
    assert len(out) == 8
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {2, 3, 4}
    clash = df.withColumn("score", langid.F.lit("mine"))
    kept = langid.accept(clash, langid.train(df)).collect()
    assert kept[0].__fields__ == clash.columns and {r.score for r in kept} == {"mine"} and {r.doc_id for r in kept} == {1, 6, 7, None}
    helper = df.withColumnsRenamed({"lang_pred": "_h0"}).withColumn("_H1", langid.F.lit(5))
    assert {(r["_h0"], r["_H1"]) for r in langid.accept(helper, langid.train(df)).collect()} == {(1, 5)}
    empty = df.filter("doc_id > 100")
    assert langid.identify(empty, langid.train(empty)).collect() == []
    assert {r.lang_pred for r in langid.identify(df, langid.train(empty)).collect()} == {"und"}
