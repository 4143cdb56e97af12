"""Toxicity by a support vector machine on a gapped subsequence kernel.

A text is a bag of units: its words, windows of long ones, and spelled-out words (single characters between blanks). The kernel
of two units is the sum over all subsequences of three and four symbols that they share, each weighted by ``DECAY`` to the power of its span,
so a word still resembles itself when characters are put in, left out or pulled apart. Units begin and end with a mark; what isn't a
letter takes up room but is in no subsequence.

Labels are those of documents, and sentences take them over: units that lean to sentences of toxic documents beyond chance start as toxic; the machine is fitted on
Nyström features (the kernel to some landmark units), and before each further fit a unit of such a sentence keeps the label only if the machine finds it toxic. Copies of the
toxic ones with a character put in or with gaps join the last fits. Landmarks and weights fold into one table of weights by
subsequence, so a unit is scored by looking up its subsequences. A logistic curve over documents of folds left out turns a
document's units into a probability.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.llm.common import fresh, sliced

TRAIN_DOCS = 2000  # labelled documents that are learned from
TRAIN_CHARS = 50_000  # longer documents aren't learned from
TRAIN_UNITS = 8000  # units of these
LANDMARKS = 192
DECAY = 0.6
SPAN = 8  # of a subsequence, at most
LENGTH = 16  # symbols of a unit besides its marks; longer words are cut to windows with half of it in common
CHUNK = 1 << 20  # characters that are worked on at once
CACHE = 400_000  # words whose scores a task keeps
LEFT, RIGHT, ACCENTED_E, ACCENTED, OTHER = 27, 28, 29, 30, 31
SYMBOLS = 32
WIDTH = LENGTH + 2
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
CODES = SYMBOLS**3 + SYMBOLS**4  # of subsequences
SPELLED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
SENTENCE = re.compile(r"[^.!?\n]+")
CUT = re.compile(r"\s(?=\S\S)")


class _Symbols(dict):
    def __missing__(self, code: int) -> int:
        c = LOOKALIKE.get(chr(code), chr(code))
        base = unicodedata.normalize("NFKD", c)[:1]
        if "a" <= c <= "z":
            s = ord(c) - 96
        elif not c.isalpha():
            s = 0
        elif base == "e":
            s = ACCENTED_E
        else:
            s = ACCENTED if "a" <= base <= "z" else OTHER
        self[code] = s
        return s


_SYMBOLS = _Symbols()


def encode(word: str) -> list[bytes]:
    """The units of a word (lower case), each ``WIDTH`` symbols; none if it has no letter."""
    body = word.translate(_SYMBOLS).encode("latin-1").strip(b"\0")
    if not body:
        return []
    marked = bytes([LEFT]) + body + bytes([RIGHT])
    if len(marked) <= WIDTH:
        return [marked.ljust(WIDTH, b"\0")]
    return [marked[i : i + WIDTH].ljust(WIDTH, b"\0") for i in range(0, len(marked) - WIDTH // 2, WIDTH // 2)]


def chunks(text: str):
    """Pieces of a text of about ``CHUNK`` characters, cut between words (and not within spelled-out ones)."""
    at = 0
    while at < len(text):
        m = CUT.search(text, at + CHUNK, at + 2 * CHUNK) if len(text) - at > 2 * CHUNK else None
        to = m.end() if m else min(len(text), at + 2 * CHUNK)
        yield text[at:to]
        at = to


def words_of(piece: str) -> Counter:
    """Words of a piece with their counts; a spelled-out word is one word, with its blanks."""
    low = piece.lower()
    out = Counter(low.split())
    for m in SPELLED.finditer(low):
        out[m.group()] += 1
    return out


def _pairs(units: np.ndarray):
    """For each shape the codes of its subsequences at every place of each unit, and their weight; codes with a missing symbol have none (``_whole``)."""
    width = units.shape[1]
    s = np.zeros((len(units), width + SPAN), dtype=np.int32)
    s[:, :width] = units
    for a in range(1, SPAN):
        two = s[:, :width] * SYMBOLS + s[:, a : a + width]
        for b in range(a + 1, SPAN):
            three = two * SYMBOLS + s[:, b : b + width]
            yield three, DECAY ** (b + 1)
            for c in range(b + 1, SPAN):
                yield three * SYMBOLS + (s[:, c : c + width] + SYMBOLS**3), DECAY ** (c + 1)


def _whole(code: np.ndarray) -> np.ndarray:
    """Whether no symbol is missing: codes of three symbols come before those of four."""
    four = code >= SYMBOLS**3
    rest = np.where(four, code - SYMBOLS**3, code)
    out = ~four | (rest >= SYMBOLS**3)
    for k in range(3):
        out &= rest // SYMBOLS**k % SYMBOLS > 0
    return out


def _squares(units: np.ndarray) -> np.ndarray:
    total = np.zeros(len(units))
    for code, w in _pairs(units):
        total += _whole(code).sum(axis=1) * w * w
    return total


_BY_LENGTH: list[float] = []


def norms(units: np.ndarray) -> np.ndarray:
    """Root of the summed squares of the weights of a unit's subsequences; it hangs on the length alone for units without gaps."""
    if not _BY_LENGTH:
        _BY_LENGTH.extend(_squares(np.tril(np.ones((WIDTH + 1, WIDTH), dtype=np.uint8), -1)).tolist())
    length = WIDTH - np.argmax(units[:, ::-1] > 0, axis=1)
    total = np.array(_BY_LENGTH)[length]
    gaps = (units > 0).sum(axis=1) < length
    if gaps.any():
        total[gaps] = _squares(units[gaps])
    return np.sqrt(np.maximum(total, 1e-12))


def table_scores(units: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over a unit's subsequences of their weights in the table."""
    out = np.zeros(len(units))
    for code, w in _pairs(units):
        out += w * weights[code].sum(axis=1)
    return out


def kernel(units: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel of each unit with each landmark, over the norms of both."""
    codes = np.unique(np.concatenate([c.ravel() for c, _ in _pairs(landmarks)]))
    codes = codes[_whole(codes)]
    place = np.zeros(CODES, dtype=np.int32)
    place[codes] = np.arange(1, len(codes) + 1)
    table = np.zeros((len(codes) + 1, len(landmarks)), dtype=np.float32)
    for code, w in _pairs(landmarks):
        np.add.at(table, (place[code], np.arange(len(landmarks))[:, None]), w)
    table[0] = 0
    table /= norms(landmarks)[None].astype(np.float32)
    out = np.zeros((len(units), len(landmarks)))
    for at in range(0, len(units), 256):
        part = units[at : at + 256]
        flat, ws = [], []
        for code, w in _pairs(part):
            p = place[code]
            r, c = np.nonzero(p)
            flat.append(r * (len(codes) + 1) + p[r, c])
            ws.append(np.full(len(r), w))
        # the weights of each (unit, subsequence) first, then one product with the table
        dense = np.bincount(np.concatenate(flat), np.concatenate(ws), len(part) * (len(codes) + 1)).reshape(len(part), -1)
        seen = np.flatnonzero(dense.any(axis=0))
        out[at : at + 256] = dense[:, seen].astype(np.float32) @ table[seen]
    return out / norms(units)[:, None]


def squared_hinge(z: np.ndarray, up: np.ndarray, down: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights (the last one the offset) of a linear machine with squared hinge loss; rows count ``up`` times as toxic and ``down`` times as not."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w, reg = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    reg[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        f = x @ w
        return float(reg @ (w * w) + up @ np.maximum(1 - f, 0) ** 2 + down @ np.maximum(1 + f, 0) ** 2)

    now = loss(w)
    for _ in range(steps):
        f = x @ w
        a, b = up * (f < 1), down * (f > -1)
        move = np.linalg.solve((x * (a + b)[:, None]).T @ x + np.diag(reg), x.T @ (a - b)) - w
        step, new = 1.0, loss(w + move)
        while new > now and step > 1e-3:
            step /= 2
            new = loss(w + step * move)
        if new >= now * (1 - 1e-7):
            break
        w, now = w + step * move, new
    return w


def noisy(unit: bytes, k: int) -> bytes:
    """A copy with a character put in (odd k), or with gaps between all symbols, as room allows."""
    body = unit.rstrip(b"\0")[1:-1]
    if len(body) < 3:
        return unit
    if k % 2:
        at, c = 1 + (7 * k) % (len(body) - 1), 1 + (11 * k + len(body)) % 26
        body = body[:at] + bytes([c]) + body[at:]
    else:
        body = b"\0".join(bytes([c]) for c in body)
    return (bytes([LEFT]) + body[:LENGTH] + bytes([RIGHT])).ljust(WIDTH, b"\0")


def _sentence_units(text: str) -> list[set[bytes]]:
    out = [{u for w in words_of(s) for u in encode(w)} for s in SENTENCE.findall(text)]
    return [x for x in out if x]


def fit_units(docs: list[tuple[list[set[bytes]], int]]) -> tuple[np.ndarray, float] | None:
    """(table of weights by subsequence, offset) from documents as sentences of units; None if they have but one label."""
    up, down = Counter(), Counter()
    for sentences, toxic in docs:
        for s in sentences:
            (up if toxic else down).update(s)
    if not up or not down:
        return None
    share = sum(up.values()) / (sum(up.values()) + sum(down.values()))
    lean = {u: (n - share * (n + down[u])) / np.sqrt(n + down[u] + 3) for u, n in up.items()}
    order = lambda u: (zlib.crc32(u), u)
    toxic = sorted((u for u in lean if lean[u] > 0), key=lambda u: (-lean[u], *order(u)))[: TRAIN_UNITS // 3]
    rest = sorted((u for u in down if down[u]), key=lambda u: (-min(down[u], 3), *order(u)))[: TRAIN_UNITS - len(toxic)]
    names = list(dict.fromkeys([*toxic, *rest]))
    units = np.frombuffer(b"".join(names), dtype=np.uint8).reshape(-1, WIDTH)
    marks = list(dict.fromkeys([*toxic[: LANDMARKS // 2], *sorted(rest, key=order)]))[:LANDMARKS]
    landmarks = np.frombuffer(b"".join(marks), dtype=np.uint8).reshape(-1, WIDTH)
    value, vector = np.linalg.eigh(kernel(landmarks, landmarks))
    root = vector[:, value > 1e-6 * value.max()] / np.sqrt(value[value > 1e-6 * value.max()])
    z = kernel(units, landmarks) @ root
    n_up, n_down = (np.array([c[u] for u in names], dtype=np.float64) for c in (up, down))
    likely = np.array([lean.get(u, 0.0) >= 1 for u in names])
    p, n = np.where(likely, n_up, 0.0), np.where(likely, n_down, n_down + n_up)
    extra, more = np.zeros((0, z.shape[1])), np.zeros(0)
    for k in range(4):
        w = squared_hinge(np.vstack([z, extra]), np.append(p, more), np.append(n, np.zeros(len(more))), 1.0)
        f = z @ w[:-1] + w[-1]
        p, n = np.where(f > 0, n_up, 0.0), np.where(f > 0, n_down, n_down + n_up)
        mine = [u for u, hit in zip(names, (f > 0) & (n_up > n_down), strict=True) if hit]
        if not mine:
            break
        copies = [noisy(u, 2 * i + k % 2) for i, u in enumerate(mine)] + [noisy(u, 2 * i + 1 - k % 2) for i, u in enumerate(mine)]
        extra = kernel(np.frombuffer(b"".join(copies), dtype=np.uint8).reshape(-1, WIDTH), landmarks) @ root
        more = np.concatenate([p[(f > 0) & (n_up > n_down)]] * 2) / 2
    alpha = root @ w[:-1] / norms(landmarks)
    table = np.zeros(CODES)
    for code, weight in _pairs(landmarks):
        np.add.at(table, code, np.where(_whole(code), weight * alpha[:, None], 0.0))
    return table, float(w[-1])


def unit_scores(units: list[bytes], machine: tuple[np.ndarray, float]) -> np.ndarray:
    a = np.frombuffer(b"".join(units), dtype=np.uint8).reshape(-1, WIDTH)
    length = WIDTH - np.argmax(a[:, ::-1] > 0, axis=1)
    order, out = np.argsort(length, kind="stable"), np.zeros(len(a))
    for i in range(0, len(a), 2048):
        at = order[i : i + 2048]
        out[at] = table_scores(a[at, : length[at[-1]]], machine[0]) / norms(a[at]) + machine[1]
    return out


class Scorer:
    """Scores of words, kept from text to text."""

    def __init__(self, machine: tuple[np.ndarray, float]):
        self.machine, self.known = machine, {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        new = sorted(w for w in words if w not in self.known)
        parts = [encode(w) for w in new]
        flat = [u for p in parts for u in p]
        f = iter(unit_scores(flat, self.machine).tolist() if flat else ())
        for w, p in zip(new, parts, strict=True):
            self.known[w] = max([next(f) for _ in p], default=-1.0)

    def features(self, texts: list[str]) -> list[tuple[float, int, int, str | None, float]]:
        """(highest score, toxic words, words, worst word, sum of the scores of toxic words, each up to 1) of whole texts."""
        out = [(-1.0, 0, 0, None, 0.0)] * len(texts)
        waiting: list[tuple[int, Counter]] = []
        size = 0

        def settle() -> None:
            self.learn({w for _, words in waiting for w in words})
            for i, words in waiting:
                best, hits, total, worst, mass = out[i]
                for w, n in words.items():
                    f = self.known[w]
                    if f > 0:
                        hits, mass = hits + n, mass + n * min(f, 1.0)
                    if f > best or (f == best and worst is not None and w < worst):
                        best, worst = f, w
                out[i] = (best, hits, total + sum(words.values()), worst, mass)

        for i, text in enumerate(texts):
            for piece in chunks(text):
                waiting.append((i, words_of(piece)))
                size += len(piece)
                if size > CHUNK:
                    settle()
                    waiting, size = [], 0
        settle()
        return [(*x[:3], x[3] if x[0] > 0 else None, x[4]) for x in out]


def _inputs(found) -> np.ndarray:
    best, total, mass = (np.array([f[k] for f in found], dtype=np.float64) for k in (0, 2, 4))
    return np.stack([np.clip(best, -1.5, 1.5), np.log1p(mass), np.log1p(mass) * (mass > 2), mass / (total + 20), np.log1p(total) / 10, np.ones(len(best))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-4
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, x.T @ (y - p) - reg * w)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(rows: list[tuple[str, int]], folds: int = 2):
    """Model of (text, label) rows: the machine fitted on all, the curve on documents that their machine didn't see."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r))
    docs = [(_sentence_units(text), int(label)) for text, label in rows]
    machine = fit_units(docs)
    if machine is None:
        return {"share": float(np.mean([label for _, label in rows])) if rows else 0.0}
    seen, labels = [], []
    by_fold = [[i for i in range(len(rows)) if zlib.crc32(rows[i][0].encode("utf-8", "surrogatepass")) // 7 % folds == k] for k in range(folds)]
    for k in range(folds):
        part = fit_units([docs[i] for j in range(folds) if j != k for i in by_fold[j]])
        if part is not None:
            s = Scorer(part)
            seen += s.features([rows[i][0] for i in by_fold[k]])
            labels += [rows[i][1] for i in by_fold[k]]
    if len(set(labels)) < 2:
        return {"share": float(np.mean([label for _, label in rows]))}
    x = _inputs(seen)
    return {"table": machine[0].astype(np.float32), "offset": machine[1], "curve": logistic(x, np.array(labels, dtype=np.float64))}


def held_out(doc_id="doc_id"):
    """Rows whose labels aren't learned from: crc32 of the doc_id as text (null: empty) leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame):
    """Model from (doc_id, text) and (doc_id, toxic), both without nulls, of rows that aren't held out.

    The ``TRAIN_DOCS`` labels with the smallest hash count, of documents of at most ``TRAIN_CHARS`` characters, with ``TRAIN_UNITS`` units;
    only these come to the driver. Without labels of both kinds every score is the share of toxic ones (0 if there are none).
    """
    known = labels.filter(~held_out()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter("_id IS NOT NULL AND _toxic IN (0, 1)")
    some = known.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(TRAIN_DOCS)
    mine = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("_text")).filter(F.col("_text").isNotNull() & (F.length("_text") <= TRAIN_CHARS))
    rows = mine.join(F.broadcast(some), F.col("_doc") == F.col("_id")).orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(TRAIN_DOCS).select("_text", "_toxic")
    return fit([(r[0], r[1]) for r in rows.collect()])


def score(docs: DataFrame, model) -> DataFrame:
    """``docs`` without text, with toxicity (0 to 1), toxic_words (how many) and worst (the word with the highest score, null if none is toxic).

    Whole texts of any length count, a piece at a time; a null text counts as empty; repeated rows are scored alike; an empty table gives no rows. The
    model is sent to the tasks (its size is fixed). Columns named like the new ones are replaced, other columns stay.
    """
    import pandas as pd
    import pyarrow as pa

    new = ("toxicity", "toxic_words", "worst")
    (text,) = fresh(docs, 1)
    kept = [c for c in docs.columns if c.lower() not in ("text", *new)]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    schema = given.drop(text).withColumns({k: F.lit(None).cast(v) for k, v in zip(new, ("double", "long", "string"), strict=True)}).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        scorer = Scorer((model["table"], model["offset"])) if "table" in model else None
        for b in sliced(batches, text):
            texts = b.column(text).to_pylist()
            if scorer:
                found = scorer.features(texts)
                hits, worst = [f[1] for f in found], [f[3] for f in found]
                p = 1 / (1 + np.exp(-np.clip(_inputs(found) @ model["curve"], -30, 30)))
            else:
                p, hits, worst = np.full(len(texts), model["share"]), [0] * len(texts), [None] * len(texts)
            own = [b.column(i) for i, c in enumerate(b.schema.names) if c != text]
            yield pa.RecordBatch.from_arrays([*own, pa.array(p, pa.float64()), pa.array(hits, pa.int64()), pa.array(worst, pa.string())], names=[c for c in b.schema.names if c != text] + list(new))

    return given.mapInArrow(run, schema)
