import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spotframe.llm import repair as rp

SPACE = " \t\n\v\f\r"


def grammar(n):
    """All strings of the grammar with up to n letters."""
    return [s for m in range(n // 2 + 1) for s in ("ua" * m, "s" + "ua" * m) if s != "s" and len(s) <= n]


def literal(rows):
    """Cost and least audit over all targets, by trying every edit (rows: initial, fault)."""
    best = None
    for target in grammar(2 * len(rows) + 2):

        @lru_cache(None)
        def go(i, j):
            out = []
            if i == len(rows) and j == len(target):
                return (0, "")
            if i < len(rows):
                initial, fault = rows[i]
                c, a = go(i + 1, j)
                out.append((c + 4, "D" + a))
                if j < len(target) and fault not in ("blank", "duplicate"):
                    extra = 3 if fault == "truncated" else 0
                    if initial == target[j]:
                        c, a = go(i + 1, j + 1)
                        out.append((c + extra, "K" + a))
                    if target[j] in "ua":
                        c, a = go(i + 1, j + 1)
                        out.append((c + 3 + extra, "R" + a))
            if j < len(target) and target[j] in "ua":
                c, a = go(i, j + 1)
                out.append((c + 3, "I" + a))
            return min(out, default=(1 << 30, ""))

        got = go(0, 0)
        best = min(best or got, got)
    return best


def faulted(rows):
    """(turn, role, text, fault) in order."""
    out, seen = [], set()
    for turn, role, text in rows:
        core = text.strip(SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marked = faulted(rows)
    cost, audit = literal(tuple((r[1][:1], r[3]) for r in marked))
    known = [r[0] for r in rows if r[0] is not None]
    lines, i, due = [], 0, 0
    kept = sum(c in "KRI" for c in audit)
    target = "ua" * (kept // 2) if kept % 2 == 0 else "s" + "ua" * (kept // 2)
    for c in audit:
        if c != "I":
            _, role, text, _ = marked[i]
            i += 1
        if c == "D":
            continue
        name = {"u": "user", "a": "assistant", "s": None}[target[due]]
        due += 1
        lines.append(f"{name}:" if c == "I" else f"{role}:{text}" if c == "K" else f"{name}:{text}")
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        **{k: sum(r[3] == k for r in marked) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("suaoxSUAO"), max_size=8))
def test_audits_are_those_of_all_edits(sig):
    rows = tuple((c.lower(), "blank" if c == "x" else "truncated" if c.isupper() else None) for c in sig)
    assert rp.whole_path(rp.paths("".join(sig), True)) == literal(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("suaoxSUAO"), min_size=2, max_size=14), st.integers(1, 5))
def test_pieces_join_to_the_whole(sig, step):
    sig = "".join(sig)
    cut = [list(rp.paths(sig[i : i + step])) for i in range(0, len(sig), step)]
    assert rp.whole_path(rp.joined(cut)) == rp.whole_path(rp.paths(sig, True))


def random_rows(rng, n, odd=False):
    roles = ["system", "user", "assistant", "tool", "", "s"] if odd else ["user", "assistant"]
    texts = ["Yes.", "No!", "Why?", "cut", "", " ", "cut .\t", "a. ", "é"]
    return [(None if odd and rng.random() < 0.1 else t + (rng.random() < 0.1), rng.choice(roles) if rng.random() < 0.3 else roles[t % 2], rng.choice(texts) + (str(rng.randint(0, 3)) + "." if rng.random() < 0.7 else "")) for t in range(n)]


def table(spark, convs):
    rows = [(c, t, role, text, False) for c, rs in convs.items() for t, role, text in rs]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean")


def test_whole_results_against_all_edits(spark):
    import random

    rng = random.Random(4)
    convs = {c: random_rows(rng, rng.randint(1, 9), odd=True) for c in range(60)}
    got = {r.conv_id: r.asDict() for r in rp.repair(table(spark, convs).repartition(7)).collect()}
    assert set(got) == set(convs)
    for c, rows in convs.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == expected([(t, role, text) for t, role, text in rows]), (c, rows)


def test_long_conversations_in_pieces_are_those_in_one(spark, monkeypatch):
    import random

    rng = random.Random(5)
    convs = {c: random_rows(rng, n) for c, n in enumerate((3, 90, 255, 256, 257, 700))}
    want = {}
    for c, rows in convs.items():
        marked = faulted(sorted(rows))
        sig = "".join("x" if f in ("blank", "duplicate") else r[:1].upper() if f else r[:1] for _, r, _, f in marked)
        cost, audit = rp.whole_path(rp.paths(sig, True))
        text = rp.repaired(audit, [m[1] for m in marked], [m[2] for m in marked])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        want[c] = (cost, audit, hashlib.sha256(text.encode()).hexdigest(), illegal, len({r[0] for r in rows}))
    got = {r.conv_id: r for r in rp.repair(table(spark, convs)).collect()}
    for c, (cost, audit, sha, illegal, turns) in want.items():
        r = got[c]
        known = [x[0] for x in convs[c]]
        assert (r.cost, r.audit, r.repaired_sha256, r.illegal, r.gaps) == (cost, audit, sha, illegal, max(known) - min(known) + 1 - turns)


def test_damage_and_odd_rows(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in [(0, "system", "Be good."), (1, "user", "Hi? You!"), (2, "assistant", "Yes."), (None, None, None)]]
    rows += [(None, 1, "user", "Hi."), (7, 1, "user", "Hi? You!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS pos", "1 AS piece")
    got = {r.conv_id: r.asDict() for r in rp.repair(rp.damage(df)).collect()}
    convs: dict = {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        role, text = (" " if v is None else v for v in (r, x))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[c] += [] if k == 0 else [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    assert set(got) == set(convs)
    for c, own in convs.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == expected(own), c


@pytest.mark.parametrize("gone", [True, False])
def test_nothing_left_and_nothing_there(spark, gone):
    df = spark.createDataFrame([(5, 1, "user", "Hi.", True)] if gone else [], "conv_id long, turn long, role string, text string, gone boolean")
    got = [tuple(r) for r in rp.repair(df).collect()]
    assert got == ([(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] if gone else [])
