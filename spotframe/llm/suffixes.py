"""Exact-substring deduplication with suffix arrays over all documents.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Two such equal strings hold the same
smallest k-gram (by hash, the first of equals) at the same place, so each document is cut into segments: the bytes of a run of
windows with one smallest k-gram's hash. Windows can only be equal in segments with that hash ``h`` in common:

1. a map finds the segments (about one in 85 bytes) and, in its batch, the equal ones; of these one goes on, the others'
   spans are known to repeat. Segments whose ``h`` occurs once are dropped in one shuffle of small rows (no text);
2. equal segments fall together (pre-aggregated), so a group of copies is one class. Classes alone with their ``h`` are done,
   unless the segment has its k-gram at several places, so that it may hold a window twice;
3. the text of the other classes is fetched and suffix arrays are built over batches of whole groups, with the lengths of common
   prefixes. From the previous and the next smaller position in suffix order comes the longest-previous-factor array, the longest
   match of each suffix with an earlier one; from the previous and next greater position its mirror, with a later one. A window goes if
   either reaches ``length``;
4. groups of more than ``GROUP`` classes or ``GROUP_BYTES`` bytes are split; windows with no match in their part meet those of
   the other parts by digest.

Digests only group what is equal. No group is ever held whole in one task, nothing is collected by the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.llm.common import materialize

GRAM = 32
GROUP, GROUP_BYTES = 4096, 1 << 21
CHUNK = 1 << 20
PLACE = np.uint64(22)  # bits of a place in a chunk: hashes are compared by the others, whatever the chunk
SEGMENT = "kind int, deal long, h long, d long, c int, m int, key binary, start int, len int"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[4]
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each byte, as a number (the first byte counts most)."""
    return np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(">u8")[:, 0].astype(np.uint64)


def pieces(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """Text, first byte and bytes of pieces of at most ``CHUNK`` window starts; those of a text overlap by ``length - 1`` bytes."""
    out = []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), CHUNK):
            out.append((i, at, t[at : at + CHUNK + length - 1] if at or len(t) > CHUNK + length - 1 else t))
    return out


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte, bytes, k-gram hash and whether it has that k-gram at several places, of every segment of texts of ``length`` bytes or more.

    A segment is a run of windows whose smallest k-grams have one hash. Which k-gram is a window's smallest hangs on its bytes
    alone. Long texts are cut into pieces, so a run may come as several segments.
    """
    out = []
    parts, at = pieces(texts, length), 0
    while at < len(parts):
        to, n = at, 0
        while to < len(parts) and (to == at or n + len(parts[to][2]) <= CHUNK):
            n += len(parts[to][2])
            to += 1
        sizes = np.array([len(t) for _, _, t in parts[at:to]], dtype=np.int64)
        if n >= length:
            data = np.frombuffer(b"".join(t for _, _, t in parts[at:to]), dtype=np.uint8)
            w = _words(data)
            g = len(data) - GRAM + 1
            gram = _mix(w[:g] * _ODD[0] + w[8 : 8 + g] * _ODD[1] + w[16 : 16 + g] * _ODD[2] + w[24 : 24 + g] * _ODD[3])
            low = ((gram >> PLACE) << PLACE) | np.arange(g, dtype=np.uint64)
            width, span = length - GRAM + 1, 1
            while 2 * span <= width:
                low, span = np.minimum(low[:-span], low[span:]), 2 * span
            if span < width:
                low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
            place = (low & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
            low = gram[place]
            ends = np.cumsum(sizes)
            piece = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
            ok = np.flatnonzero(np.arange(len(low)) + length <= ends[piece])
            if len(ok):
                new = np.flatnonzero(np.concatenate([[True], (low[ok][1:] != low[ok][:-1]) | (piece[ok][1:] != piece[ok][:-1])]))
                first, last = ok[new], ok[np.concatenate([new[1:] - 1, [len(ok) - 1]])]
                text, begin = (np.array([p[k] for p in parts[at:to]], dtype=np.int64) for k in (0, 1))
                own = piece[first]
                out.append((text[own], first - (ends - sizes)[own] + begin[own], last - first + length, low[first], place[first] != place[last]))
        at = to
    if not out:
        return tuple(np.array([], dtype=np.int64) for _ in range(3)) + (np.array([], dtype=np.uint64), np.array([], dtype=bool))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _batch_segments(keys: list[bytes], texts: list[bytes], length: int) -> pa.RecordBatch:
    """Kind 0: spans that repeat inside the batch, joined; 1: one segment of a class, the first with its h; 2: others with its h."""
    from xxhash import xxh3_64_intdigest

    doc, start, size, gram, merged = segments(texts, length)
    d = np.array([xxh3_64_intdigest(texts[t][s : s + n]) for t, s, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)], dtype=np.uint64)
    order = np.lexsort((d, gram))
    new_h = np.concatenate([[True], gram[order][1:] != gram[order][:-1]])[: len(order)]
    new = new_h | np.concatenate([[True], d[order][1:] != d[order][:-1]])[: len(order)]
    at = np.flatnonzero(new)
    times = np.diff([*at, len(order)])
    h_at = np.flatnonzero(new_h)
    h_times = np.diff([*h_at, len(order)])
    one = order[at]  # one segment of each class
    kind = np.where(new_h[at], 1, 2)
    many_h = np.repeat(h_times, h_times)[at] > 1  # its h occurs again in the batch
    again = np.sort(order[np.repeat(times > 1, times)])
    r_doc, r_a = doc[again], start[again]
    r_b = r_a + size[again]
    if len(again):
        # segments come by text and place; their ends grow with their starts
        cut = np.flatnonzero(np.concatenate([[True], (r_doc[1:] != r_doc[:-1]) | (r_a[1:] > r_b[:-1])]))
        r_doc, r_a, r_b = r_doc[cut], r_a[cut], r_b[np.concatenate([cut[1:] - 1, [len(r_b) - 1]])]
    gram, d = gram.view(np.int64), d.view(np.int64)
    n0, n1 = len(r_doc), len(one)
    zero = np.zeros(n0, dtype=np.int64)
    h = gram[one]
    cat = lambda a, b, t: pa.array(np.concatenate([a, b]), t)
    return pa.RecordBatch.from_pydict(
        {
            "kind": cat(zero, kind, pa.int32()),
            "deal": cat(np.arange(n0), np.where(kind == 1, h, h ^ (d[one] | 1)), pa.int64()),
            "h": cat(zero, h, pa.int64()),
            "d": cat(zero, d[one], pa.int64()),
            # a segment with its k-gram at several places may hold a window twice, so it goes on as if its h came again
            "c": cat(zero, np.minimum(times, 2) + 2 * (many_h | merged[one]), pa.int32()),
            "m": cat(zero, merged[one], pa.int32()),
            "key": pa.array([keys[i] for i in r_doc.tolist()] + [keys[i] for i in doc[one].tolist()], pa.binary()),
            "start": cat(r_a, start[one], pa.int32()),
            "len": cat(r_b - r_a, size[one], pa.int32()),
        }
    )


def _met_again(batches):
    """Of rows sorted by kind and h: all but the segments of kind 1 whose h is alone."""
    held, last = None, None  # a row that may turn out alone; the h of the last group
    for b in batches:
        if not b.num_rows:
            continue
        kind, h, c = (b.column(x).to_numpy() for x in ("kind", "h", "c"))
        keep = (kind != 1) | (c > 2)
        one = np.flatnonzero(kind == 1)
        if len(one):
            g = h[one]
            same = np.concatenate([[g[0] == last if last is not None else False], g[1:] == g[:-1]])
            keep[one] |= same | np.concatenate([same[1:], [False]])
            if held is not None:
                if same[0]:
                    yield held
                held = None
            last = g[-1]
            if not keep[one[-1]]:
                held = b.slice(int(one[-1]), 1)
        yield b.filter(pa.array(keep))


def suffix_array(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in the order of their first ``length`` bytes (ties by position), as numbers of ``starts``, and the
    length, up to ``length``, of the prefix that each has in common with the one before it in that order.

    Ranks of 8 bytes are doubled; those of two overlapping parts give ``length``. ``data`` ends with ``length`` more bytes.
    """
    words = _words(data)
    rank, span = np.unique(words, return_inverse=True)[1].astype(np.int64), 8
    levels = []
    while span < length:
        levels.append((span, rank.astype(np.int32)))
        step = min(span, length - span)
        n = len(rank) - step
        pair = (rank[:n] << 32) | rank[step:]
        if span + step >= length:
            pair = pair[starts]
        order = np.argsort(pair, kind="stable")
        same = np.concatenate([[False], pair[order][1:] == pair[order][:-1]])[: len(order)]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(~same)
        span += step
    common = np.zeros(len(order), dtype=np.int32)
    common[same] = length
    at = np.flatnonzero(~same)[1:]
    x, y = starts[order[at - 1]], starts[order[at]]
    got = np.zeros(len(at), dtype=np.int64)
    for step, ranks in reversed(levels):  # spans of half the length and less; the longest may fit once and a part of it again
        for _ in range(1 + (2 * step < length and step == levels[-1][0])):
            hit = np.flatnonzero((got + step <= length) & (ranks[np.minimum(x + got, len(ranks) - 1)] == ranks[np.minimum(y + got, len(ranks) - 1)]))
            got[hit] += step
    last = words[np.minimum(x + got, len(words) - 1)] ^ words[np.minimum(y + got, len(words) - 1)]
    for bits in (32, 16, 8):
        zero = (last >> np.uint64(64 - bits)) == 0
        got += np.where(zero, bits // 8, 0)
        last = np.where(zero, last << np.uint64(bits), last)
    common[at] = np.minimum(got, length)
    return order, common


def longest_factors(order: np.ndarray, common: np.ndarray, later: bool = False) -> np.ndarray:
    """Of each suffix the longest prefix that it has in common with one at an earlier position (or ``later``): the LPF array.

    The nearest suffix before, and after, in suffix order with a smaller (greater) position shares the most. Both are found by
    jumps: a suffix that isn't one hands on its own candidate, and the least common prefix on the way goes with it.
    """
    n = len(order)
    place = -order if later else order
    out = np.zeros(n, dtype=np.int32)
    for back in (False, True):
        p = place[::-1] if back else place
        shared = np.concatenate([[0], common[1:][::-1]]) if back else common  # with the neighbour at k - 1
        to, least = np.arange(-1, n - 1), shared.astype(np.int32).copy()
        open_ = np.arange(1, n)
        open_ = open_[p[to[open_]] > p[open_]]
        while len(open_):
            via = to[open_]
            new_to, new_least = to[via], np.minimum(least[open_], least[via])
            to[open_], least[open_] = new_to, np.where(new_to >= 0, new_least, 0)
            open_ = open_[(new_to >= 0) & (new_least > 0)]
            open_ = open_[p[to[open_]] > p[open_]]
        least = np.where((to >= 0) & (p[np.maximum(to, 0)] < p), least, 0)
        np.maximum(out, least[::-1] if back else least, out=out)
    by_place = np.zeros(n, dtype=np.int32)
    by_place[order] = out
    return by_place


def _repeats(texts: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text: the places of its windows that occur again in any of the texts, and of those that occur nowhere before."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(length + 8), dtype=np.uint8)
    windows, first = sizes - length + 1, np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, common = suffix_array(data, first[text] + place, length)
    before = longest_factors(order, common) >= length
    again = before | (longest_factors(order, common, later=True) >= length)
    of_text = lambda x: np.split(place[x], np.searchsorted(text[x], np.arange(1, len(texts))))
    return of_text(np.flatnonzero(again)), of_text(np.flatnonzero(~before))


def _match(batches, length: int, most: int = 1 << 21):
    """Rows come by h and part. Whole groups are gathered up to ``most`` bytes; a group has GROUP classes, so it always fits."""
    from xxhash import xxh3_128_digest

    def flush(rows):
        found, new = _repeats([r[3] for r in rows], length)
        out = {k: [] for k in ("h", "d", "a", "b", "digest", "met")}

        def add(*x):
            for k, v in zip(out, x, strict=True):
                out[k].append(v)

        for (h, parts, d, text), hit, first in zip(rows, found, new, strict=True):
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                for a, b in zip(hit[np.concatenate([[0], cut + 1])].tolist(), hit[np.concatenate([cut, [len(hit) - 1]])].tolist(), strict=True):
                    add(h, d, a, b + length, None, True)
            if parts > 1:  # for the other parts, one of each equal window
                met = set(hit.tolist())
                for a in first.tolist():
                    add(h, d, a, a + length, xxh3_128_digest(text[a : a + length]), a in met)
        types = {"h": pa.int64(), "d": pa.int64(), "a": pa.int32(), "b": pa.int32(), "digest": pa.binary(), "met": pa.bool_()}
        return pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in types.items()})

    rows, n, last = [], 0, None
    for b in batches:
        for h, part, parts, d, text in zip(*(b.column(x).to_pylist() for x in ("h", "part", "parts", "d", "text")), strict=True):
            if (h, part) != last and n > most:
                yield flush(rows)
                rows, n = [], 0
            if (h, part) == last and rows[-1][2] == d:  # the same class, of a repeated row
                continue
            rows.append((h, parts, d, text))
            n, last = n + len(text), (h, part)
    if rows:
        yield flush(rows)


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(key, spans) of the keyed texts that have any span to remove; spans may overlap."""

    def cut(batches):
        for b in batches:
            keys, texts = b.column("key").to_pylist(), [t.encode("utf-8") for t in b.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                to, n = at, 0
                while to < len(texts) and (to == at or n < 16 * CHUNK):
                    n += len(texts[to])
                    to += 1
                yield _batch_segments(keys[at:to], texts[at:to], length)
                at = to

    found = docs.select("key", "text").mapInArrow(cut, SEGMENT).repartition("deal").sortWithinPartitions("kind", "h")
    seen = materialize(found.mapInArrow(_met_again, SEGMENT).drop("deal"), "segments")
    segs = seen.filter("kind > 0").withColumn("c", F.pmod(F.col("c") - 1, F.lit(2)) + 1)
    classes = materialize(segs.groupBy("h", "d").agg(F.sum("c").alias("c"), F.max("m").alias("m"), F.min(F.struct("key", "start", "len")).alias("rep")), "classes")
    # a class alone with its h goes on if it may hold a window twice
    size = F.col("rep.len").cast("long")
    several = classes.groupBy("h").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max("m").alias("m")).filter("n > 1 OR m > 0")
    several = several.select("h", F.least(F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("bytes") / GROUP_BYTES)), "n").cast("int").alias("parts"))
    wanted = classes.join(several, "h").select("h", F.pmod(F.xxhash64("d"), "parts").alias("part"), "parts", "d", "rep.*")
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "part", "parts", "d", "start", "len")).alias("segs"))
    fetched = docs.select("key", "text").join(by_text, "key")

    def fetch(batches):
        for b in batches:
            out = {k: [] for k in ("h", "part", "parts", "d", "text")}
            for segs, text in zip(b.column("segs").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8")
                for s in segs:
                    for k in ("h", "part", "parts", "d"):
                        out[k].append(s[k])
                    out["text"].append(raw[s["start"] : s["start"] + s["len"]])
            types = {"h": pa.int64(), "part": pa.int64(), "parts": pa.int32(), "d": pa.int64(), "text": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in types.items()})

    texts = fetched.mapInArrow(fetch, "h long, part long, parts int, d long, text binary").repartition("h", "part").sortWithinPartitions("h", "part", "d")
    matched = materialize(texts.mapInArrow(lambda batches: _match(batches, length), "h long, d long, a int, b int, digest binary, met boolean"), "matches")
    across = matched.filter("digest is not null")
    twice = across.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    whole = classes.filter("c > 1").select("h", "d", F.lit(0).alias("a"), F.col("rep.len").alias("b"))
    span = ["h", "d", "a", "b"]
    spans = whole.unionByName(matched.filter("digest is null").select(span)).unionByName(across.filter("not met").join(twice, "digest").select(span))
    placed = segs.join(spans, ["h", "d"]).select("key", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    known = seen.filter("kind = 0").select("key", F.col("start").alias("a"), (F.col("start") + F.col("len")).alias("b"))
    return placed.unionByName(known).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicate(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, kept, n_bytes, spans) per row: the bytes left of its UTF-8 text, and the maximal removed runs.

    Null text counts as empty; texts shorter than ``length`` bytes are kept. Every copy goes, the first included; strings
    are judged on the input, so ties don't arise. Repeated rows are documents of their own, so they remove each other. Texts of
    any length are taken whole, in pieces that overlap. Further columns are not read. An empty table gives no rows.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # the same text under the same id has the same key, and the same spans
    docs = docs.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")))))
    spans = repeated_spans(docs, length)

    def remove(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "kept", "n_bytes", "spans")}
            for doc, text, spans in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "spans")), strict=True):
                raw, runs = text.encode("utf-8"), join_spans([(s["a"], s["b"]) for s in spans or ()])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                out["doc_id"].append(doc)
                out["kept"].append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                out["n_bytes"].append(len(raw))
                out["spans"].append([{"start": x, "stop": y} for x, y in runs])
            types = {"doc_id": pa.int64(), "kept": pa.binary(), "n_bytes": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))}
            yield pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in types.items()})

    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(remove, "doc_id long, kept binary, n_bytes long, spans array<struct<start:int,stop:int>>")
