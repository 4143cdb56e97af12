"""Repair of the turn structure of conversations by alignment with the strings of an alternating grammar.

The roles of a well-formed conversation spell ``(s?(ua)+)?``. The turns are aligned with each string of that grammar by a
Wagner-Fischer table: keep, rerole, delete, insert. The strings of one parity are ends of one another, so a table from the back holds all
lengths; cells that no alignment as cheap as the incumbent (a greedy one) can pass are left out (Ukkonen's band). The cheapest lengths are traced
back, and their audits compared.

A conversation is cut into pieces of ``PIECE`` rows. A piece is aligned for each state of the grammar that it may begin and end
in; pieces join like matrices whose product is the cheapest way (then the least audit) over the states between. So a conversation of any
number of turns is worked on in many tasks.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.llm.common import discard, written
from spotframe.llm.sequences import numbered

PIECE = 256  # rows that are aligned in one table; pieces joined at once
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, AFTER_S, WANT_A, WANT_U = range(4)  # states of the grammar; START and WANT_U may end a conversation
FAR = 1 << 40
BLANK = r"\A[\x20\x09-\x0D]*\z"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of the damage test: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (gone), emptied, stripped of ``[.!?]``, repeated or given to the user.

    Null roles and texts, and nulls in the checksum's text, are one space.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("copy"))


def _tables(sig: str, last: str, slack: int) -> list[np.ndarray]:
    """``V[i][r]``: least cost of rows i and on against the last r letters of ...uaua (ending with ``last``); FAR outside of the band.

    ``sig`` has a letter a row: x must be deleted, else the initial (o for any other), in upper case if truncated.
    ``slack``: what an alignment may cost above the least that any must.
    """
    n = len(sig)
    must = np.array([c == "x" for c in sig], dtype=bool)
    cut = np.array([c.isupper() for c in sig], dtype=bool)
    left = np.append(np.cumsum((~must)[::-1])[::-1], 0)  # rows from i on that may stay
    loose = np.append(np.cumsum(cut[::-1])[::-1], 0)  # of these the truncated ones, whose deletion costs but 1 more than keeping
    most = int(left[0]) + slack // INSERT
    r = np.arange(most + 1)
    letter = np.where(r % 2 == 1, last, "a" if last == "u" else "u")  # the r-th letter from the end
    out = [np.zeros(0, dtype=np.int64)] * (n + 1)
    for i in range(n, -1, -1):
        if i == n:
            row = INSERT * r
        else:
            below = out[i + 1]
            row = below + DELETE
            if not must[i]:
                stay = np.where(letter[1:] == sig[i].lower(), KEEP, REROLE) + TRUNCATED * cut[i]
                row[1:] = np.minimum(row[1:], below[:-1] + stay)
            row = np.minimum.accumulate(row - INSERT * r) + INSERT * r
        fewer = slack if slack <= loose[i] else int(loose[i]) + (slack - int(loose[i])) // DELETE
        out[i] = np.where((r >= left[i] - fewer) & (r <= left[i] + slack // INSERT), row, FAR)
    return out


def _trace(sig: str, v: list[np.ndarray], last: str, i: int, r: int) -> str:
    """The least audit among the cheapest of rows i and on against the last r letters."""
    out, n = [], len(sig)
    other = "a" if last == "u" else "u"
    while i < n or r:
        now = v[i][r]
        if i < n and v[i + 1][r] + DELETE == now:
            out.append("D")
            i += 1
        elif r and v[i][r - 1] + INSERT == now:
            out.append("I")
            r -= 1
        else:
            kept = sig[i].lower() == (last if r % 2 else other)
            out.append("K" if kept else "R")
            i, r = i + 1, r - 1
    return "".join(out)


def _incumbent(sig: str, entry: int, stop: int) -> int:
    """Cost of one alignment, by a greedy walk: missing letters are put in, strange rows get the role that is due."""
    state, cost = entry, 0
    for c in sig:
        if c == "x":
            cost += DELETE
            continue
        cost += TRUNCATED * c.isupper()
        c, due = c.lower(), "a" if state == WANT_A else "u"
        if c == "s" and state == START:
            state = AFTER_S
            continue
        if c in "ua" and c != due:
            cost += INSERT  # what is due is put in, and the row stays
            state = WANT_U if c == "a" else WANT_A
            continue
        cost += KEEP if c == due else REROLE
        state = WANT_A if due == "u" else WANT_U
    if state == stop:
        return cost
    return cost + INSERT * (2 if stop == WANT_U and state in (START, AFTER_S) else 1)


@lru_cache(maxsize=1 << 15)
def paths(sig: str, whole: bool = False) -> tuple[tuple[int, int, int, str], ...]:
    """(entry, exit, cost, audit) for the states that rows ``sig`` may begin and end in; ``whole``: from START to an end alone."""
    n, out = len(sig), {}
    entries = (START,) if whole else range(4)
    base = sum(DELETE if c == "x" else TRUNCATED * c.isupper() for c in sig)
    keeps = [i for i, c in enumerate(sig) if c in "sS"]

    def offer(entry: int, stop: int, cost: int, audit) -> None:
        old = out.get((entry, stop))
        if old is None or cost < old[0]:
            out[entry, stop] = (cost, [audit])
        elif cost == old[0]:
            old[1].append(audit)

    offer(START, START, DELETE * n, lambda: "D" * n)
    if not whole:
        offer(AFTER_S, AFTER_S, DELETE * n, lambda: "D" * n)
        for i in keeps:
            offer(START, AFTER_S, DELETE * (n - 1) + TRUNCATED * sig[i].isupper(), lambda i=i: "D" * i + "K" + "D" * (n - 1 - i))
    for stop, last in ((WANT_U, "a"),) if whole else ((WANT_U, "a"), (WANT_A, "u")):
        v = _tables(sig, last, max(_incumbent(sig, e, stop) for e in entries) - base)
        for e in entries:
            odd = (e == WANT_A) != (stop == WANT_A)  # how many letters lie between the states
            least = 2 if e in (START, AFTER_S) and stop == WANT_U else int(odd)
            for r in range(least, len(v[0]), 2):
                if v[0][r] < FAR:
                    offer(e, stop, int(v[0][r]), lambda r=r, v=v, last=last: _trace(sig, v, last, 0, r))
                if e == START:
                    for i in keeps:
                        if v[i + 1][r] < FAR:
                            offer(e, stop, DELETE * i + TRUNCATED * sig[i].isupper() + int(v[i + 1][r]), lambda i=i, r=r, v=v, last=last: "D" * i + "K" + _trace(sig, v, last, i + 1, r))
    return tuple((e, x, cost, min(f() for f in audits)) for (e, x), (cost, audits) in out.items())


def joined(pieces: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """Paths through pieces one after the other: the cheapest over the states between, of equal ones that of the least audit."""
    now = pieces[0]
    for more in pieces[1:]:
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for e, m, c, a in now:
            for m2, x, c2, a2 in more:
                if m == m2 and ((e, x) not in best or (c + c2, a + a2) < best[e, x]):
                    best[e, x] = (c + c2, a + a2)
        now = [(e, x, c, a) for (e, x), (c, a) in best.items()]
    return now


def whole_path(found) -> tuple[int, str]:
    return min((c, a) for e, x, c, a in found if e == START and x in (START, WANT_U))


class Rewriter:
    """Applies an audit to rows as they come; ``lines`` gives the repaired turns due before and with a row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _role(self) -> str:
        self.state, role = (WANT_U, "assistant") if self.state == WANT_A else (WANT_A, "user")
        return role

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield f"{self._role()}:"

    def lines(self, role: str, text: str):
        yield from self.inserts()
        op = self.audit[self.at]
        self.at += 1
        if op == "R":
            yield f"{self._role()}:{text}"
        elif op == "K":
            if self.state == START and role[:1] == "s":
                self.state = AFTER_S
            else:
                self._role()
            yield f"{role}:{text}"


def repaired(audit: str, roles, texts) -> str:
    w = Rewriter(audit)
    out = [line for role, text in zip(roles, texts, strict=True) for line in w.lines(role, text)]
    return "\n".join([*out, *w.inserts()])


PATHS = "array<struct<entry:int,stop:int,cost:long,audit:string>>"


def _pieces(groups: DataFrame) -> DataFrame:
    """Statistics and paths of each piece; a first piece that isn't full is the whole conversation, and gets its result here."""
    import pandas as pd

    passed = ["conv_id", "piece", "n_turns", "low", "high"]
    own = f"blank long, duplicate long, truncated long, illegal long, first string, last string, paths {PATHS}, cost long, audit string, repaired_sha256 string"
    names = ["blank", "duplicate", "truncated", "illegal", "first", "last", "paths", "cost", "audit", "repaired_sha256"]
    schema = ", ".join([f"{c} {groups.schema[c].dataType.simpleString()}" for c in passed] + [own])

    def one(r):
        roles, texts, first = list(r.roles), list(r.texts), set(r.firsts)
        sig, faults = [], [0, 0, 0]
        for pos, role, kind in zip(r.at, roles, r.kinds, strict=True):
            fault = 0 if kind == 1 else 1 if pos not in first else 2 if kind == 2 else 3
            if fault < 3:
                faults[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            sig.append("x" if fault < 2 else letter.upper() if fault == 2 else letter)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        ends = [*faults, illegal, roles[0][:1], roles[-1][:1]]
        whole = r.piece == 0 and len(roles) < PIECE
        found = paths("".join(sig), whole)
        if not whole:
            return [*ends, found, None, None, None]
        cost, audit = whole_path(found)
        return [*ends, None, cost, audit, hashlib.sha256(repaired(audit, roles, texts).encode("utf-8", "surrogatepass")).hexdigest()]

    def run(parts):
        for pdf in parts:
            more = pd.DataFrame([one(r) for r in pdf.itertuples()], columns=names, index=pdf.index, dtype=object)
            yield pd.concat([pdf[passed], more], axis=1)

    return groups.mapInPandas(run, schema)


def _join_pieces(pieces: DataFrame) -> tuple[DataFrame, list[str]]:
    """(conv_id, cost, audit) of conversations of many pieces, ``PIECE`` of them joined at once."""
    import pandas as pd

    now, made = pieces.filter("paths IS NOT NULL").select("conv_id", "piece", "paths"), []
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(parts):
        for pdf in parts:
            done = [joined([[(p["entry"], p["stop"], p["cost"], p["audit"]) for p in x["paths"]] for x in group]) for group in pdf["group"]]
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "piece": pdf["piece"], "paths": pd.Series(done, dtype=object, index=pdf.index)})

    while now.filter("piece > 0").limit(1).count():
        groups = now.groupBy("conv_id", F.floor(F.col("piece") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("piece", "paths"))).alias("group"))
        now, path = written(groups.mapInPandas(run, f"conv_id {kind}, piece long, paths {PATHS}"), "paths")
        made.append(path)
    ends = F.array_min(F.transform(F.filter("paths", lambda p: (p["entry"] == START) & p["stop"].isin(START, WANT_U)), lambda p: F.struct(p["cost"].alias("cost"), p["audit"].alias("audit"))))
    return now.select("conv_id", ends.alias("e")).select("conv_id", "e.*"), made


def _digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations of many pieces: rows stream by in order behind their audit, and only the digest's state is kept."""
    import pandas as pd

    kind = rows.schema["conv_id"].dataType.simpleString()
    lead = audits.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    ids = audits.select(F.col("conv_id").alias("_id"))
    feed = rows.join(ids, F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi").select("conv_id", "pos", "role", "text").unionByName(lead)

    def run(parts):
        mine, w, digest, started = None, None, None, False

        def put(lines):
            nonlocal started
            for line in lines:
                digest.update(("\n" if started else "").encode() + line.encode("utf-8", "surrogatepass"))
                started = True

        def close():
            put(w.inserts())
            return pd.DataFrame({"conv_id": pd.Series([mine], dtype=object), "repaired_sha256": [digest.hexdigest()]})

        for pdf in parts:
            for conv, pos, role, text in zip(pdf["conv_id"], pdf["pos"], pdf["role"], pdf["text"], strict=True):
                if pos == 0:
                    if w:
                        yield close()
                    mine, w, digest, started = conv if conv == conv else None, Rewriter(text), hashlib.sha256(), False
                else:
                    put(w.lines(role, text))
        if w:
            yield close()

    return feed.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInPandas(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``turns`` (conv_id, turn, role, text, gone).

    Rows that are ``gone`` only say that the conversation was there. Rows go by turn (null first), those of one turn by role, then text;
    repeated rows stay beside each other, and all but the first of a conversation with one role and text are duplicates. A null conv_id is a conversation. Null roles
    and texts count as one space (so such a text is blank). Texts of any length and conversations of any number of turns are taken whole.
    A conversation without rows has zeros, an empty audit and the digest of an empty text; an empty table gives no rows. Other columns aren't read.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text"), "gone")
    spark = turns.sparkSession
    rows, sorted_path = numbered(given.filter(~F.col("gone")).drop("gone"), "conv_id", [F.col("turn"), F.col("role"), F.col("text")], "turns")
    rows = rows.withColumn("piece", F.floor((F.col("pos") - 1) / PIECE).cast("long"))
    firsts = rows.groupBy("conv_id", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).agg(F.min("pos").alias("pos"))
    firsts = firsts.groupBy(F.col("conv_id").alias("_id"), F.floor((F.col("pos") - 1) / PIECE).cast("long").alias("_piece")).agg(F.collect_list("pos").alias("firsts"))
    kind = F.when(F.col("text").rlike(BLANK), 1).when(~F.col("text").rlike(ENDED), 2).otherwise(0)
    groups = rows.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "role", "text", kind.alias("kind")))).alias("s"))
    known = F.filter(F.transform("s", lambda x: x["turn"]), lambda t: t.isNotNull())
    spread = [F.size(F.array_distinct(known)).cast("long").alias("n_turns"), F.array_min(known).alias("low"), F.array_max(known).alias("high")]
    groups = groups.select("conv_id", "piece", *spread, *[F.col(f"s.{k}").alias(name) for k, name in (("pos", "at"), ("role", "roles"), ("text", "texts"), ("kind", "kinds"))])
    # a piece can hold nothing but repeats of earlier ones
    groups = groups.join(firsts, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("piece") == F.col("_piece")), "left").drop("_id", "_piece").withColumn("firsts", F.coalesce("firsts", F.array().cast("array<bigint>")))
    pieces, pieces_path = written(_pieces(groups), "pieces")

    order = W.partitionBy("conv_id").orderBy("piece")
    seam = (F.lag("high").over(order) == F.col("low")).cast("long")
    bad = (F.lag("last").over(order).isNotNull() & ~F.concat(F.lag("last").over(order), F.col("first")).isin("su", "ua", "au")).cast("long")
    marked = pieces.withColumn("seam", F.coalesce(seam, F.lit(0))).withColumn("illegal", F.col("illegal") + F.coalesce(bad, F.lit(0)))
    total = lambda c: F.sum(c).alias(c)
    gaps = F.max("high") - F.min("low") + 1 - (F.sum("n_turns") - F.sum("seam"))
    found = marked.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *map(total, ("blank", "duplicate", "truncated", "illegal")), *[F.max(c).alias(c) for c in ("cost", "audit", "repaired_sha256")])
    if pieces.filter("paths IS NOT NULL").limit(1).count():
        audits, made = _join_pieces(pieces)
        audits, _ = written(audits, "audits")
        discard(spark, *made)
        shas, _ = written(_digests(rows, audits), "digests")
        long = audits.join(shas, audits["conv_id"].eqNullSafe(shas["conv_id"])).select(audits["conv_id"].alias("_id"), F.col("cost").alias("_cost"), F.col("audit").alias("_audit"), F.col("repaired_sha256").alias("_sha"))
        found = found.join(long, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
        found = found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.coalesce("cost", "_cost").alias("cost"), F.coalesce("audit", "_audit").alias("audit"), F.coalesce("repaired_sha256", "_sha").alias("repaired_sha256"))
    discard(spark, sorted_path)
    ids = given.select(F.col("conv_id").alias("_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_id").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
