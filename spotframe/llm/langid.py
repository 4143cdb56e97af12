"""Language identification of words and documents with a linear-chain conditional random field.

Words (between white space, in lower case) are labelled; a word's score for each language is the sum of learned weights
of its character n-grams of 1 to 4 within word bounds (those at a bound are its affixes) and of the whole word (the
lexicon), in hashed buckets. Transitions between languages are learned with them, from stretches of labelled documents set
together as in code-switched text. Forward-backward over a document's words gives each word's probabilities; their mean over
words with letters is the document's.

The model is fitted on the driver, on a sample of at most ``TRAIN_DOCS`` labelled documents of at most ``TRAIN_CHARS``
characters each and ``TRAIN_BYTES`` bytes together. It has ``2**BITS`` rows, whatever the corpus; prediction is one map over
whole texts without any shuffle.

A probability among the labels can't tell a text of none of them. For that the model keeps which character trigrams its sample
has (``KNOWN_BITS`` bits, hashed), and the share of them that nearly all documents of a held-back part of the sample reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.llm.common import fresh, sliced

BITS = 18
KNOWN_BITS = 22
TRAIN_DOCS, TRAIN_CHARS, TRAIN_BYTES = 2000, 100_000, 8 << 20
STEPS, STRETCHES, WORDS = 160, 128, 64
UNKNOWN = "und"


def gram_hashes(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the n-grams for n from 1 to 4 and of the whole words, and the word of each; one array each."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    first, word = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    hashes, owners = [], []
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, 5):
        h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        ok = np.flatnonzero(word[: len(h)] == word[n - 1 :])
        hashes.append(h[ok] + np.uint64(n << 40))
        owners.append(word[ok])
    place = np.arange(len(points)) - first[word]
    mixed = (points * np.uint64(0x9E3779B97F4A7C15)) ^ (points >> np.uint64(3))
    hashes.append(np.add.reduceat(mixed * (place.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(1)), first) if len(first) else np.array([], dtype=np.uint64))
    owners.append(np.arange(len(first), dtype=np.int32))
    return [(x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) for x in hashes], owners


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and of the whole words, and the word of each; sorted by word."""
    hashes, owners = gram_hashes(words)
    o = np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return np.concatenate([(x >> np.uint64(64 - BITS)).astype(np.int32) for x in hashes])[order], o[order]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``KNOWN_BITS`` bits of the words' trigrams, and the word of each."""
    hashes, owners = gram_hashes(words)
    return (hashes[2] >> np.uint64(64 - KNOWN_BITS)).astype(np.int32), owners[2]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    moves: np.ndarray  # from x to
    starts: np.ndarray
    known: np.ndarray | None = None  # a bit for each trigram hash that the sample has
    least_known: float = 0.0  # a text with a smaller share of known trigrams is of none of the labels

    def scores(self, words: list[str], block: int = 20_000) -> np.ndarray:
        """Words x labels."""
        out = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        for k in range(0, len(words), block):
            part = words[k : k + block]
            b, o = gram_buckets(part)
            out[k : k + len(part)] = np.add.reduceat(self.weights[b], np.searchsorted(o, np.arange(len(part))), axis=0)
        return out

    def familiar(self, words: list[str], block: int = 20_000) -> np.ndarray:
        """Words x (known trigrams, trigrams)."""
        out = np.zeros((len(words), 2))
        for k in range(0, len(words) if self.known is not None else 0, block):
            part = words[k : k + block]
            h, o = trigrams(part)
            hit = (self.known[h >> 3] >> (h & 7).astype(np.uint8)) & 1
            out[k : k + len(part), 0] = np.bincount(o, weights=hit, minlength=len(part))
            out[k : k + len(part), 1] = np.bincount(o, minlength=len(part))
        return out

    def posteriors(self, emit: np.ndarray, index: np.ndarray, sizes: np.ndarray, visit, pairs: np.ndarray | None = None) -> None:
        """Forward-backward over sequences laid end to end: ``emit`` (different words x labels) by ``index``.

        Calls ``visit(rows, probabilities)`` with the places of one word each of several sequences, last words first.
        The expected numbers of moves between labels, of all sequences together, are added to ``pairs``.
        """
        e = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float32)
        moves, start = np.exp(self.moves).astype(np.float32), np.exp(self.starts).astype(np.float32)
        order = np.argsort(-sizes, kind="stable")
        first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        ends = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # sequences of t words or more
        alphas = np.empty((len(index), len(self.labels)), dtype=np.float32)
        a = None
        for t, n in enumerate(ends.tolist()):
            at = first[:n] + t
            a = (start if a is None else a[:n] @ moves) * e[index[at]]
            a /= a.sum(axis=1, keepdims=True)
            alphas[at] = a
        beta = np.empty((0, len(self.labels)), dtype=np.float32)
        for t in range(len(ends) - 1, -1, -1):
            n, at = int(ends[t]), first[: ends[t]] + t
            new = np.ones((n, len(self.labels)), dtype=np.float32)
            new[: len(beta)] = beta
            p = alphas[at] * new
            p /= p.sum(axis=1, keepdims=True)
            visit(at, p)
            onward = new * e[index[at]]
            if pairs is not None and t:
                # the message up to the word before, the move, and all that follows: no evidence counts twice
                pair = alphas[at - 1][:, :, None] * moves[None] * onward[:, None, :]
                pairs += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0, dtype=np.float64)
            beta = onward @ moves.T
            beta /= beta.sum(axis=1, keepdims=True)

    def gradients(self, emit: np.ndarray, index: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the negative log-likelihood of the labels ``y``: by the scores of each word in its place, by moves and by starts."""
        gap = np.empty((len(index), len(self.labels)))
        moves = np.zeros_like(self.moves)
        self.posteriors(emit, index, sizes, gap.__setitem__, moves)
        gap[np.arange(len(y)), y] -= 1
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        inner = np.ones(len(index), dtype=bool)
        inner[first] = False
        np.subtract.at(moves, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
        return gap, moves, gap[first].sum(axis=0)


class Vocabulary:
    """Texts as numbers of their words; words are held once, texts not at all."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.docs: list[np.ndarray] = []
        self.langs: list[str] = []

    def add(self, text: str, lang: str) -> None:
        words = text.lower().split()
        if words:
            self.docs.append(np.array([self.ids.setdefault(w, len(self.ids)) for w in words], dtype=np.int32))
            self.langs.append(lang)

    def buckets(self, block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words' features, and where those of each word begin."""
        words, parts, sizes = list(self.ids), [], []
        for k in range(0, len(words), block):
            b, o = gram_buckets(words[k : k + block])
            parts.append(b)
            sizes.append(np.bincount(o, minlength=len(words[k : k + block])))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def fit(vocabulary: Vocabulary, seed: int = 7) -> Model:
    """A conditional random field by AdaGrad on stretches set together from labelled texts."""
    docs = vocabulary.docs
    labels = sorted(set(vocabulary.langs))
    rng = np.random.default_rng(seed)
    model = Model(labels, np.zeros((1 << BITS, len(labels)), dtype=np.float32), np.zeros((len(labels),) * 2), np.zeros(len(labels)))
    if not docs:
        return model
    learn_known(model, vocabulary)
    if len(labels) < 2:
        return model
    buckets, bounds = vocabulary.buckets()
    label_of = np.array([labels.index(g) for g in vocabulary.langs])
    by_label = [np.flatnonzero(label_of == g) for g in range(len(labels))]
    used = np.full_like(model.weights, 1e-3)
    used_moves, used_starts = np.full_like(model.moves, 1e-3), np.full_like(model.starts, 1e-3)
    for _ in range(STEPS):
        seqs, ys = [], []
        for _ in range(STRETCHES):
            x, y = [], []
            cuts = sorted(rng.choice(np.arange(1, WORDS), rng.integers(0, 3), replace=False).tolist())
            for n in np.diff([0, *cuts, WORDS]).tolist():
                g = int(rng.integers(len(labels)))
                k = by_label[g][rng.integers(len(by_label[g]))]
                at = int(rng.integers(max(1, len(docs[k]) - n + 1)))
                x.append(docs[k][at : at + n])
                y.append(np.full(len(x[-1]), g))
            seqs.append(np.concatenate(x))
            ys.append(np.concatenate(y))
        flat, y, sizes = np.concatenate(seqs), np.concatenate(ys), np.array([len(s) for s in seqs])
        present, index = np.unique(flat, return_inverse=True)
        grams = np.concatenate([np.arange(bounds[w], bounds[w + 1]) for w in present.tolist()])
        sizes_of = bounds[present + 1] - bounds[present]
        b = buckets[grams]
        emit = np.add.reduceat(model.weights[b], np.cumsum(sizes_of) - sizes_of, axis=0)
        gap, moves, starts = model.gradients(emit, index, sizes, y)
        n = len(flat)
        for value, grad, seen in ((model.moves, moves / n, used_moves), (model.starts, starts / n, used_starts)):
            seen += grad**2
            value -= 0.3 * grad / np.sqrt(seen)
        word_gap = np.zeros((len(present), len(labels)))
        np.add.at(word_gap, index, gap)
        spread = np.repeat(word_gap / n, sizes_of, axis=0)
        touched, inv = np.unique(b, return_inverse=True)
        grad = np.stack([np.bincount(inv, weights=spread[:, g], minlength=len(touched)) for g in range(len(labels))], axis=1)
        used[touched] += grad**2
        model.weights[touched] -= (0.3 * grad / np.sqrt(used[touched])).astype(np.float32)
    return model


def learn_known(model: Model, vocabulary: Vocabulary, held: int = 4, share: float = 0.002, slack: float = 0.6) -> None:
    """Which trigrams the sample has, and the share of them below which a text is of none of the labels.

    Each ``held``-th document is judged by the trigrams of the others: all but ``share`` of these reach a certain share of known
    trigrams, and the threshold is ``slack`` times that, so that clean texts of a language of the sample stay.
    """
    words = list(vocabulary.ids)
    grams, owners = [], []
    for k in range(0, len(words), 20_000):
        h, o = trigrams(words[k : k + 20_000])
        grams.append(h)
        owners.append(o + k)
    h, o = np.concatenate(grams), np.concatenate(owners)
    seen = np.zeros(len(words), dtype=bool)
    judged = [d for k, d in enumerate(vocabulary.docs) if k % held == 0 and len(d) >= 20]
    for k, d in enumerate(vocabulary.docs):
        if k % held:
            seen[d] = True

    def bits(which: np.ndarray) -> np.ndarray:
        flags = np.zeros(1 << KNOWN_BITS, dtype=np.uint8)
        flags[which] = 1
        return np.packbits(flags, bitorder="little")

    if len(judged) >= 20 and seen.any():
        known = bits(h[seen[o]])
        hits = np.bincount(o, weights=(known[h >> 3] >> (h & 7).astype(np.uint8)) & 1, minlength=len(words))
        every = np.bincount(o, minlength=len(words))
        plain = np.array([not any(c.isdigit() for c in w) for w in words])
        hits, every = hits * plain, every * plain
        shares = np.sort([hits[d].sum() / max(1, every[d].sum()) for d in judged])
        model.least_known = slack * float(shares[int(share * len(shares))])
    model.known = bits(h)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fit on a sample of the documents that aren't held out; lang gives labels, and text alone the features."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    total = known.count()
    share = min(1.0, 1.5 * TRAIN_DOCS / max(total, 1))
    mark = F.xxhash64("doc_id", "text")
    picked = known.filter((F.length("text") <= TRAIN_CHARS) & (F.pmod(mark, F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    rows = picked.groupBy(mark.alias("mark")).agg(F.min("text").alias("text"), F.min("lang").alias("lang")).orderBy(F.xxhash64("mark")).limit(TRAIN_DOCS)
    vocabulary, size = Vocabulary(), 0
    for r in rows.toLocalIterator():
        size += len(r["text"].encode("utf-8", "replace"))
        if size > TRAIN_BYTES:
            break
        vocabulary.add(r["text"], r["lang"])
    return fit(vocabulary)


def predict(model: Model, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each of a batch of texts, and the share of known trigrams of its words with letters and no digits."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(text.fill_null("")))
    words = lists.flatten().dictionary_encode()
    names = words.dictionary
    letters = pc.match_substring_regex(names, r"\pL").to_numpy(zero_copy_only=False)
    index = words.indices.to_numpy()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    n, k = len(text), max(1, len(model.labels))
    total, count, known = np.zeros((n, k)), np.zeros(n), np.ones(n)
    if model.labels and len(index):
        owner = np.repeat(np.arange(n), sizes)

        def visit(at, p):
            counted = letters[index[at]]
            total[owner[at]] += p * counted[:, None]
            count[owner[at]] += counted

        spelled = names.to_pylist()
        model.posteriors(model.scores(spelled), index, sizes, visit)
        if model.known is not None:
            digits = pc.match_substring_regex(names, "[0-9]").to_numpy(zero_copy_only=False)
            both = model.familiar(spelled) * (letters & ~digits)[:, None]
            hits, every = (np.bincount(owner, weights=both[index, c], minlength=n) for c in (0, 1))
            known = np.where(every > 0, hits / np.maximum(every, 1), 1.0)
    best = total.argmax(axis=1)
    said = [model.labels[g] if c else UNKNOWN for g, c in zip(best.tolist(), count.tolist(), strict=True)] if model.labels else [UNKNOWN] * n
    return said, np.clip(total[np.arange(n), best] / np.maximum(count, 1), 0, 1), known


def annotate(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """``docs`` with the predicted language, its mean probability and the share of known trigrams in three columns (any of these names are replaced).

    Null texts and texts without a letter are ``und`` with score 0, as is everything under a model without labels. Of languages
    with equal probabilities the first by name is taken. Texts of any length are read whole; some
    megabytes of them are in memory at once. Repeated rows and empty tables give as many rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    schema = docs.withColumn(names[0], F.lit("")).withColumn(names[1], F.lit(0.0)).withColumn(names[2], F.lit(0.0)).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches):
        for b in sliced(batches):
            said, score, known = predict(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], names=[*b.schema.names, *names])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``, as ``annotate``; a null doc_id isn't held out. Other columns aren't read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return annotate(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that have a language, in its columns; a null lang is filled with the predicted one.

    Null texts, texts without a letter and those with fewer known trigrams than ``model.least_known`` go. Repeated rows are judged
    alike; an empty table gives no rows; columns of any names stay as they are.
    """
    names = fresh(docs, 3)
    rows = annotate(docs, model, names).filter((F.col(names[0]) != UNKNOWN) & (F.col(names[2]) >= model.least_known))
    return rows.withColumn("lang", F.coalesce("lang", names[0])).select(docs.columns)
