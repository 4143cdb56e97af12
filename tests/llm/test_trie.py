import hashlib
import math
import random
import re
import zlib

from spotframe.llm import sequences, trie


def literal(rows):
    """The trie of (conv_id, turn, role, text) by dictionaries of whole prefixes."""
    convs: dict = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    nodes: dict = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        turns = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, d == len(turns)))
    out = {}
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        parent = min(c for c, _ in nodes[key[:-1]]) if key else None
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        leaf = lambda k: not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)
        row = (parent, len(members), sum(len(k) == len(key) + 1 for k in below), sum(map(leaf, below)), sum((len(nodes[k]) - 1) * words(k) for k in below), hashlib.sha256(ends.encode()).hexdigest())
        out[min(c for c, _ in members), len(key)] = row
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS pos", "2 AS D", "3 AS part")
    got = trie.prefix_trie(df.repartition(5)).collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in got}
    assert len(out) == len(got)
    return out


def test_against_dictionaries(spark):
    rng = random.Random(2)
    rows = []
    for c in range(-25, 90):
        like = rng.random() < 0.4  # many equal conversations
        for t in range(rng.randint(0, 7)):
            text = "same words here" if like else rng.choice(["", None, "a b", "c\td  e", "f"])
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]) if not like else "user", text))
    rows += [(None, 1, "user", "lost")] + rows[:9]
    assert run(spark, rows) == literal(rows)


def test_deep_chains_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(c, t, "user", f"w{t} x" if t < 30 or c % 2 else f"own{c} {t}") for c in (20, 21, 22, 23, 40) for t in range(45)]
    assert run(spark, rows) == literal(rows)


def test_empty_table_and_turnless_conversations(spark):
    assert run(spark, []) == {}
    rows = [(1, 0, "user", "a")]  # crc32("1") % 4 is 3 and conversation 0 isn't there: no turns are left
    assert zlib.crc32(b"1") % 4 == 3
    assert run(spark, rows) == literal(rows) == {(1, 0): (None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())}


def test_totals_of_random_trees(spark):
    rng, rows, want = random.Random(9), [], {}
    for base, shape in ((0, "chain"), (1000, "star"), (2000, "random"), (3000, "broom")):
        parent = {0: None}
        for k in range(1, 200):
            parent[k] = {"chain": k - 1, "star": 0, "random": rng.randrange(k), "broom": k - 1 if k < 100 else 99}[shape]
        depth = {0: 0}
        for k in range(1, 200):
            depth[k] = depth[parent[k]] + 1
        value = {k: rng.randint(0, 50) for k in parent}
        kids = [sum(p == k for p in parent.values()) for k in parent]
        total = dict(value)
        for k in range(199, 0, -1):
            total[parent[k]] += total[k]
        want |= {base + k: v for k, v in total.items()}
        rows += [(base + k, depth[k], base + parent[k] if k else None, depth[parent[k]] if k else None, kids[k], value[k]) for k in parent]
    df = spark.createDataFrame(rows, "c long, d long, pc long, pd long, kids long, v long")
    totals, _ = trie.subtree_totals(df, ["v"])
    assert {r.c: r.v for r in totals.collect()} == want


def test_positions_over_many_tasks(spark):
    rows = [(k, v) for k, n in ((None, 40), (3, 1), (4, 500), (5, 2), (6, 0), (7, 300)) for v in range(n)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(9)
    out, _ = sequences.numbered(df, "k", [df.v], "numbered")
    assert sorted((r.k or 0, r.v, r.pos) for r in out.collect()) == sorted((k or 0, v, v + 1) for k, v in rows)
