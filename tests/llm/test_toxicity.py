import itertools
import random
import zlib

import numpy as np

from spotframe.llm import toxicity as tx

INSULTS = ("grumblor", "snarkwit", "doltface")


def prose(rng, n):
    sounds = ["re", "an", "to", "lin", "ver", "mos", "tir", "el", "sa", "qui"]
    return ["".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(n, seed=1):
    rng, out = random.Random(seed), []
    for k in range(n):
        words, toxic = prose(rng, rng.randint(20, 80)), int(k % 4 == 0)
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append((" ".join(words[: len(words) // 2]) + ".\n" + " ".join(words[len(words) // 2 :]) + ".", toxic))
    return out


def literal_kernel(u: bytes, v: bytes):
    """Kernel and norms by listing every subsequence."""

    def features(x):
        x, out, squares = x.rstrip(b"\0"), {}, 0.0
        for n in (3, 4):
            for at in itertools.combinations(range(len(x)), n):
                if at[-1] - at[0] < tx.SPAN and all(x[i] for i in at):
                    w = tx.DECAY ** (at[-1] - at[0] + 1)
                    key = bytes(x[i] for i in at)
                    out[key] = out.get(key, 0.0) + w
                    squares += w * w
        return out, max(squares, 1e-12) ** 0.5

    (a, na), (b, nb) = features(u), features(v)
    return sum(w * b.get(k, 0.0) for k, w in a.items()) / na / nb


def test_kernel_against_all_subsequences():
    words = ["idiot", "i.d.i.o.t", "i d i o t", "idxiot", "banana", "a", "éclair", "x" * 40, "ab-cd", "straße", "st0p"]
    units = [u for w in words for u in tx.encode(w)]
    a = np.frombuffer(b"".join(units), dtype=np.uint8).reshape(-1, tx.WIDTH)
    got = tx.kernel(a, a)
    want = np.array([[literal_kernel(u, v) for v in units] for u in units])
    assert np.allclose(got, want, atol=1e-5)


def test_folded_table_is_the_machine_on_landmarks():
    rng = random.Random(3)
    marks = np.frombuffer(b"".join(u for w in prose(rng, 12) for u in tx.encode(w)), dtype=np.uint8).reshape(-1, tx.WIDTH)
    units = [u for w in [*prose(rng, 30), "a-b-c-d", "é à"] for u in tx.encode(w)]
    a = np.frombuffer(b"".join(units), dtype=np.uint8).reshape(-1, tx.WIDTH)
    alpha = np.array([rng.uniform(-1, 1) for _ in marks])
    table = np.zeros(tx.CODES)
    for code, w in tx._pairs(marks):
        np.add.at(table, code, np.where(tx._whole(code), w * (alpha / tx.norms(marks))[:, None], 0.0))
    assert np.allclose(tx.unit_scores(units, (table, 0.25)), tx.kernel(a, marks) @ alpha + 0.25, atol=1e-5)


def test_gaps_and_strange_characters_are_tolerated_and_prose_is_not_flagged():
    model = tx.fit(corpus(160))
    score = lambda texts: 1 / (1 + np.exp(-tx._inputs(tx.Scorer((model["table"], model["offset"])).features(texts)) @ model["curve"]))
    rng = random.Random(8)
    clean = [" ".join(prose(rng, 60)) for _ in range(60)]
    assert (score(clean) < 0.7).mean() >= 0.95
    for change in (str, str.upper, ".".join, " ".join, lambda w: w[:3] + "x" + w[3:], lambda w: w[:2] + w[2] * 2 + w[3:], lambda w: w.replace("o", "0")):
        dirty = [c + " " + " and ".join(change(w) for w in INSULTS) for c in clean]
        assert (score(dirty) >= 0.7).mean() >= 0.9, change


def test_newton_finds_the_least_loss():
    rng = np.random.default_rng(0)
    z, up, down = rng.normal(size=(60, 4)), rng.integers(0, 4, 60).astype(float), rng.integers(0, 4, 60).astype(float)
    w = tx.squared_hinge(z, up, down, 0.5)
    x = np.hstack([z, np.ones((60, 1))])

    def loss(w):
        f = x @ w
        return 0.5 * (w[:-1] @ w[:-1]) + up @ np.maximum(1 - f, 0) ** 2 + down @ np.maximum(1 + f, 0) ** 2

    assert all(loss(w + d) >= loss(w) - 1e-6 for d in rng.normal(size=(200, 5)) * 0.01)


def test_pieces_of_a_long_text_count_as_the_whole(monkeypatch):
    machine = (np.random.default_rng(1).normal(size=tx.CODES) * tx._whole(np.arange(tx.CODES)), -0.3)
    rng = random.Random(5)
    texts = [" ".join(prose(rng, n)) + " s p e l t out" for n in (0, 3, 400, 2000)]
    want = tx.Scorer(machine).features(texts)
    monkeypatch.setattr(tx, "CHUNK", 200)
    got = tx.Scorer(machine).features(texts)
    assert [f[:4] for f in got] == [f[:4] for f in want] and np.allclose([f[4] for f in got], [f[4] for f in want])
    monkeypatch.setattr(tx, "CACHE", 10)
    assert [f[:4] for f in tx.Scorer(machine).features(texts)] == [f[:4] for f in want]


def test_job_on_odd_rows(spark):
    rows = [(k, text, toxic) for k, (text, toxic) in enumerate(corpus(200, 4))]
    docs = [(k, text, k, "t") for k, text, _ in rows] + [(900, None, 1, "x"), (901, "", 1, "x"), (None, INSULTS[0], 1, "x"), (903, "a" * 60_000, 1, None), (3, rows[3][1], 7, "t")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, toxic int, Toxicity string")
    labels = spark.createDataFrame([(k, t) for k, _, t in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    out = tx.score(docs, model)
    assert [c.lower() for c in out.columns] == ["doc_id", "toxic", "toxicity", "toxic_words", "worst"]
    got = out.collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.toxicity <= 1 for r in got)
    scorer = tx.Scorer((model["table"], model["offset"]))
    texts = {k: t for k, t, _ in rows} | {900: "", 901: "", None: INSULTS[0], 903: "a" * 60_000}
    for r in got:
        f = scorer.features([texts[r.doc_id]])
        p = 1 / (1 + np.exp(-tx._inputs(f) @ model["curve"]))[0]
        assert abs(p - r.toxicity) < 1e-9 and (r.toxic_words, r.worst) == (f[0][1], f[0][3])
    held = [r for r in got if r.doc_id is not None and r.doc_id < 200 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.toxicity >= 0.7) == (rows[r.doc_id][2] == 1) for r in held]) >= 0.95
    # labels of rows held out change nothing
    other = labels.withColumn("toxic", tx.F.when(tx.held_out(), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    again = tx.train(docs, other)
    assert np.array_equal(again["table"], model["table"]) and np.array_equal(again["curve"], model["curve"])
    # without labels of both kinds
    assert tx.train(docs, labels.filter("toxic = 0")) == {"share": 0.0}
    assert {r.toxicity for r in tx.score(docs, {"share": 0.0}).collect()} == {0.0}
    assert tx.score(docs.limit(0), model).count() == 0 and tx.train(docs.limit(0), labels) == {"share": 0.0}
