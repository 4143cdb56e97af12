"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND, then a check of overlaps.

Every document is cut into passages half as long again as the longest item, so close that any run of that length is whole
in one of them, whole texts throughout; each passage is a query. Scores
are shares of what an item's own text would get, so one threshold holds for items of any length. The index keeps each
word's postings in blocks with the block's largest impact. Items are also cut into up to ``RANGES`` ranges: the largest impacts
of a passage's words in a range, and for common words the most that they give any item of the range together, bound what
its items can reach; by running sums all passages of a text are bounded at once, and those (nearly all) that stay below the
threshold in every range are left. The rest walk their postings by document-at-a-time WAND, skip blocks that can't reach
the threshold, and give every item above it.

An item is found in a document if a share ``OVERLAP`` of the five-word shingles of its question, and of its answer (its last
sentence; where it has one sentence, all is question), are in the passage.

Words are counted over all items of the benchmark, in Spark, so an item's score doesn't hang on the others of its index. Items are
dealt into indexes of about ``ITEMS`` by a hash; only one index at a time is made on the driver, with the statistics of its own
words. Each is broadcast for a map over the documents; after the maps of ``ITEM_BYTES`` of items the documents are written, so that
executors hold no more than these at once.
"""

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.llm.common import materialize

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
BLOCK, RANGES, COMMON = 16, 64, 0.3
ITEMS, ITEM_BYTES = 1024, 4 << 20
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of ``n`` words; of fewer words, the one run there is."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all but the last sentence, and of the last; an answer shorter than a shingle takes words before it along.

    All is question where there is one sentence, or too few words before the last.
    """
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if WORD.search(p)]
    whole, answer = words_of(text), words_of(parts[-1] if parts else "")
    question = words_of(" ".join(parts[:-1]))
    if len(question) < SHINGLE:
        return whole, []
    return question, whole[-max(SHINGLE, len(answer)) :] if len(answer) < SHINGLE else answer


@dataclass
class Index:
    vocabulary: dict[str, int]
    first: np.ndarray  # of each word's postings, and one more
    items: np.ndarray  # of each posting, ascending within a word
    impacts: np.ndarray  # share of the item's own score
    bound: np.ndarray  # largest impact of a word
    block_bound: list[list[float]]  # of a word's blocks of postings
    block_last: list[list[int]]  # the last item of each
    range_bound: np.ndarray  # words (and a row of zeros for all others) x ranges of items; zero for common words
    range_common: np.ndarray  # what the common words can give to an item of each range
    longest: int
    names: list  # item ids
    checks: list[tuple[set, set]]  # shingles of question and answer


@dataclass
class Statistics:
    """Of all items: their number, mean length in words, and for each word how many have it."""

    n: int
    mean: float
    df: dict[str, int]


def statistics_of(rows: list[tuple[int, str]]) -> Statistics:
    lists = [w for _, t in rows if (w := words_of(t))]
    df: dict[str, int] = {}
    for w in lists:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    return Statistics(len(lists), sum(map(len, lists)) / len(lists) if lists else 1.0, df)


def build(rows: list[tuple[int, str]], of_all: Statistics | None = None) -> Index:
    """Index of (item_id, text), with the statistics of all items, if these are but a part; items without words are left out."""
    rows = [(i, t, w) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])) if (w := words_of(t))]
    stats = of_all or statistics_of([(i, t) for i, t, _ in rows])
    n, mean, df = len(rows), stats.mean, stats.df
    counts = []
    for *_, w in rows:
        c: dict[str, int] = {}
        for x in w:
            c[x] = c.get(x, 0) + 1
        counts.append(c)
    df = {x: df[x] for c in counts for x in c}
    vocabulary = {x: k for k, x in enumerate(sorted(df))}
    postings: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
    for k, (c, (*_, w)) in enumerate(zip(counts, rows, strict=True)):
        score = {x: math.log(1 + (stats.n - df[x] + 0.5) / (df[x] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for x, f in c.items()}
        total = sum(score.values())
        for x, s in score.items():
            postings[vocabulary[x]].append((k, s / total))
    first = np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64)
    flat = [x for p in postings for x in p]
    blocks = [[p[i : i + BLOCK] for i in range(0, len(p), BLOCK)] for p in postings]
    per = max(4, -(-n // RANGES))
    ranges = max(1, -(-n // per))
    bounds, common, given = np.zeros((len(vocabulary) + 1, ranges), dtype=np.float32), np.zeros(ranges), np.zeros(n)
    for t in sorted(range(len(vocabulary)), key=lambda t: -len(postings[t])):
        more = np.array([i for i, _ in postings[t]]), np.array([s for _, s in postings[t]])
        if (given[more[0]] + more[1]).max() <= COMMON:
            given[more[0]] += more[1]
        else:
            np.maximum.at(bounds[t], more[0] // per, more[1])
    np.maximum.at(common, np.arange(n) // per, given)
    checks = [tuple(shingles(w) for w in question_and_answer(t)) for _, t, _ in rows]
    return Index(vocabulary, first, np.array([i for i, _ in flat], dtype=np.int64), np.array([s for _, s in flat]), np.array([max(s for _, s in p) for p in postings]), [[max(s for _, s in b) for b in w] for w in blocks], [[b[-1][0] for b in w] for w in blocks], bounds, common, max((len(w) for *_, w in rows), default=0), [i for i, *_ in rows], checks)


def wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items that reach the threshold for a set of words, by item."""
    first, items, impacts = index.first, index.items, index.impacts
    cursors = [[int(items[first[t]]), int(first[t]), t] for t in terms]  # item, place, word
    out, slack = [], 1e-9
    while cursors:
        cursors.sort()
        reach, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            reach += index.bound[c[2]]
            if reach >= threshold - slack:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # what the blocks that hold the item, or where it would be, can give
        best, end = 0.0, None
        for c in cursors[: pivot + 1]:
            t, k = c[2], (c[1] - int(first[c[2]])) // BLOCK
            last = index.block_last[t]
            while k < len(last) and last[k] < item:
                k += 1
            if k < len(last):
                best += index.block_bound[t][k]
                end = last[k] if end is None else min(end, last[k])
        if best < threshold - slack:
            to = (item if end is None else end) + 1  # no item up to the nearest end of a block can do it
            if pivot + 1 < len(cursors):
                to = min(to, cursors[pivot + 1][0])
            to = max(to, item + 1)
        elif cursors[0][0] == item:
            score = sum(float(impacts[c[1]]) for c in cursors[: pivot + 1])
            if score >= threshold - slack:
                out.append((item, score))
            to = item + 1
        else:
            to = item
        left = []
        for k, c in enumerate(cursors):
            if k <= pivot and c[0] < to:
                place = int(first[c[2]]) + int(np.searchsorted(items[first[c[2]] : first[c[2] + 1]], to))
                if place == first[c[2] + 1]:
                    continue
                c = [int(items[place]), place, c[2]]
            left.append(c)
        cursors = left
    return out


def passages(n: int, longest: int) -> np.ndarray:
    """First and last word (exclusive) of passages that hold every run of ``longest`` words of ``n``."""
    step = max(1, longest // 2)
    first = np.arange(0, max(1, n - longest + step), step) if n else np.array([], dtype=np.int64)
    return np.stack([first, np.minimum(n, first + longest + step)], axis=1)


def find(index: Index, words: list[str], threshold: float = THRESHOLD, chunk: int = 1 << 16) -> list[tuple[int, float, float]]:
    """(item, best score, overlap) of the items found in a text; overlap is the lesser of question's and answer's."""
    if not index.names or not words:
        return []
    longest = max(index.longest, SHINGLE)
    ids = np.fromiter(map(index.vocabulary.get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
    found: dict[int, tuple[float, float]] = {}
    spans = passages(len(words), longest)
    per = max(1, chunk // longest)
    for k in range(0, len(spans), per):
        part = spans[k : k + per]
        base, end = part[0, 0], part[-1, 1]
        total = np.zeros((end - base + 1, index.range_bound.shape[1]))
        np.cumsum(index.range_bound[ids[base:end]], axis=0, out=total[1:])
        could = (total[part[:, 1] - base] - total[part[:, 0] - base] + index.range_common >= threshold - 1e-4).any(axis=1)
        for a, b in part[could].tolist():
            terms = np.unique(ids[a:b])
            runs: dict[int, set] = {}
            for item, score in wand(index, terms[terms >= 0].tolist(), threshold):
                question, answer = index.checks[item]
                n = len(next(iter(question)))  # five, or all words of a shorter item
                have = runs[n] = runs.get(n) or shingles(words[a:b], n)
                overlap = min(len(question & have) / len(question), len(answer & have) / len(answer) if answer else 1.0)
                if overlap >= OVERLAP and overlap >= found.get(item, (0, 0))[1]:
                    found[item] = (max(score, found.get(item, (0, 0))[0]), overlap)
    return [(k, *v) for k, v in sorted(found.items())]


def item_blocks(benchmark: DataFrame):
    """(items, statistics of all items for their words, bytes) of one block of items after the other; equal items count once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()

    def split(batches):
        for b in batches:
            lists = [sorted(set(w)) for w in map(words_of, b.column("text").to_pylist())]
            sizes = [len(words_of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("text"), pa.array(lists, pa.list_(pa.string())), pa.array(sizes, pa.int64())], names=["item_id", "text", "words", "size"])

    items = materialize(rows.mapInArrow(split, "item_id long, text string, words array<string>, size long").filter("size > 0"), "items")
    n, mean, total = items.agg(F.count("*"), F.avg("size"), F.sum(F.octet_length("text"))).first()
    if not n:
        return
    blocks = max(1, -(-n // ITEMS), -(-total // ITEM_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    df = items.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    df = materialize(df, "item-words") if blocks > 1 else df
    for k in range(blocks):
        own = items.filter(F.col("block") == k)
        part = [(r["item_id"], r["text"]) for r in own.select("item_id", "text").collect()]
        if not part:
            continue
        if blocks == 1:
            yield part, None, total
            continue
        known = df.join(own.select(F.explode("words").alias("word")).distinct(), "word", "left_semi").collect()
        yield part, Statistics(n, mean, {r["word"]: r["n"] for r in known}), sum(len(t.encode("utf-8", "replace")) for _, t in part)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a column ``leaks``: array of structs (item_id, score, overlap) by item, empty for clean documents.

    Null and empty texts are clean, as all is under an empty benchmark; a null item_id stays null. Items that tie in score are all
    found; passages that tie for an item's overlap give the largest score. Texts of any length are read whole. Rows and columns of
    ``docs`` come back as they are (a column leaks is replaced), repeated rows too.
    """
    spark = docs.sparkSession
    leak = "array<struct<item_id:bigint,score:double,overlap:double>>"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64())]))
    docs = docs.drop("leaks").withColumn("leaks", F.array().cast(leak))
    schema = docs.schema
    held = 0
    for items, stats, size in item_blocks(benchmark):
        if held and held + size > ITEM_BYTES:
            docs, held = materialize(docs, "decontaminated-so-far"), 0
        held += size
        shared = spark.sparkContext.broadcast(build(items, stats))

        def run(batches, shared=shared):
            index = shared.value

            def leaks(text):
                words = words_of(text)
                return [{"item_id": index.names[k], "score": s, "overlap": o} for k, s, o in find(index, words, threshold)]

            for b in batches:
                before = b.column("leaks").to_pylist()
                new = [leaks(t) if t else [] for t in b.column("text").to_pylist()]
                columns = [pa.array([(x or []) + y for x, y in zip(before, new, strict=True)], kind) if n == "leaks" else b.column(n) for n in b.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

        docs = docs.mapInArrow(run, schema)
    return docs
