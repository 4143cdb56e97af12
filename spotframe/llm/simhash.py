"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at ``THRESHOLD`` or fewer differing bits. The bits are cut into three segments; two linked
fingerprints differ in at most one bit in one segment at least. The anchors of a segment are a covering code: the
perfect (15, 11) code on its first 15 bits, all values on the others, so each segment value has its one home anchor within
distance 1 (the covering radius). A fingerprint is sent to every anchor within radius + 1 of its segment (16 on average);
there the fingerprints at home are compared with all that came. So every link is met, in either direction.

Copies fall together first: only different fingerprints are sent. Anchors with many at home are cut into blocks of
``BLOCK`` at home, to each of which all that come are sent; what comes is streamed. Of the links met in a batch only a
spanning forest leaves the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.llm.common import materialize
from spotframe.llm.components import components

THRESHOLD = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
INNER = 15
BLOCK = 1024


def fingerprint(text: str, n_words: int = 4) -> int:
    """Bits set in over half of the XXH64 hashes (seed 42) of the text's shingles; 0 without words. Unsigned."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    if len(words) < n_words:
        return int.from_bytes(xxh64_digest(b" ".join(words), 42), "big")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = list(zip(starts[: len(words) - n_words + 1].tolist(), ends[n_words - 1 :].tolist(), strict=True))
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(pairs), 1 << 16):
        raw = b"".join([xxh64_digest(line[a:b], 42) for a, b in pairs[k : k + (1 << 16)]])
        counts += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(pairs)).tobytes(), "big")


def fingerprints(docs: DataFrame, n_words: int = 4) -> DataFrame:
    """(doc_id, fp) per row of ``docs``, fp as a signed long; null text counts as empty."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t or "", n_words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": pa.array(np.array(fps, dtype=np.uint64).view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndromes() -> np.ndarray:
    """Of each 15-bit value: the number (1 to 15) of the bit whose change makes it a code word, 0 if it is one."""
    v = np.arange(1 << INNER)
    out = np.zeros_like(v)
    for bit in range(INNER):
        out ^= ((v >> bit) & 1) * (bit + 1)
    return out


def anchors_of(fps: np.ndarray, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the fingerprint, anchor and whether it is the home, for every anchor within distance 2 of a segment."""
    values = [((fps.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64) for first, bits in SEGMENTS]
    return anchors_of_segments(values, [bits for _, bits in SEGMENTS], homes_only)


def anchors_of_segments(values: list[np.ndarray], widths: list[int], homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``anchors_of``, of the values of all segments (``INNER`` bits or more each) of some fingerprints."""
    syndrome, rows, anchors, homes = _syndromes(), [], [], []
    one = np.int64(1)
    for s, (v, bits) in enumerate(zip(values, widths, strict=True)):
        syn = syndrome[v & ((1 << INNER) - 1)]
        home = np.where(syn > 0, v ^ (one << np.maximum(syn - 1, 0)), v)
        spread, index = np.int64(s) << 32, np.arange(len(v))
        add = lambda i, a, h: (rows.append(i), anchors.append(a | spread), homes.append(np.full(len(i), h)))  # noqa: B023, E731
        add(index, home, True)
        if homes_only:
            continue
        off, on = np.flatnonzero(syn > 0), np.flatnonzero(syn == 0)
        for i in range(1, INNER + 1):  # two inner bits whose numbers add up to the syndrome
            at = off[((syn[off] ^ i) > i)]
            add(at, v[at] ^ (one << (i - 1)) ^ (one << ((syn[at] ^ i) - 1)), False)
        for j in range(INNER, bits):  # one outer bit, and the inner bit that leads home
            add(index, home ^ (one << j), False)
            for k in range(j):  # two outer bits, from code words alone
                if k >= INNER:
                    add(on, v[on] ^ (one << j) ^ (one << k), False)
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what a and b connect."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def meetings(batches, names: list[str], chunk: int = 1 << 20):
    """Of each batch its columns ``names`` and an iterator over (left, right): the rows of pairs that meet, ``left`` at home.

    Rows come by anchor and block, those at home first. The homes of the last group are kept for the next batch, where
    they stand before its rows; at most ``chunk`` pairs, or the homes of one row, are made at a time.
    """
    kept_key, kept = None, {}

    def pairs(rows, times, first, group):
        stop, at = np.cumsum(times), 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + chunk, "right")))
            r, t = rows[at:to], times[at:to]
            right = np.repeat(r, t)
            yield np.arange(len(right)) - np.repeat(np.cumsum(t) - t, t) + first[group[right]], right
            at = to

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column("anchor").to_numpy(), batch.column("block").to_numpy().astype(np.int64)], axis=1)
        columns = {c: batch.column(c).to_numpy() for c in names}
        home, old = batch.column("home").to_numpy(zero_copy_only=False), 0
        if kept_key is not None and (key[0] == kept_key).all():
            old = len(kept[names[0]])
            key = np.concatenate([np.repeat(kept_key[None], old, axis=0), key])
            columns = {c: np.concatenate([kept[c], columns[c]]) for c in names}
            home = np.concatenate([np.ones(old, dtype=bool), home])
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        size = np.diff([*first, len(key)])
        n_home = np.add.reduceat(home.astype(np.int64), first)
        kept_key, kept = key[-1], {c: v[first[-1] : first[-1] + n_home[-1]] for c, v in columns.items()}
        group = np.repeat(np.arange(len(first)), size)
        rows = np.flatnonzero((n_home[group] > 0) & (np.arange(len(key)) >= old))
        yield columns, pairs(rows, n_home[group[rows]], first, group)


def _compare(batches, threshold: int):
    for columns, pairs in meetings(batches, ["fp"]):
        got_a, got_b = [], []
        for left, right in pairs:
            x, y = columns["fp"][left], columns["fp"][right]
            near = (np.bitwise_count((x ^ y).view(np.uint64)) <= threshold) & (x != y)
            if near.any():
                a, b = _forest(x[near], y[near])
                got_a.append(a)
                got_b.append(b)
        if got_a:
            a, b = _forest(np.concatenate(got_a), np.concatenate(got_b))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def dealt(rows: DataFrame, spread, schema: str) -> DataFrame:
    """Rows by anchor and block, those at home first, as ``meetings`` wants them.

    ``spread(batches, homes_only)`` makes of ``rows`` those sent to anchors (columns of ``schema`` and home). Anchors with more
    than ``BLOCK`` at home are cut into blocks, each with its own homes and all that come.
    """
    sent = rows.mapInArrow(lambda batches: spread(batches, False), f"{schema}, home boolean")
    at_home = rows.mapInArrow(lambda batches: spread(batches, True), f"{schema}, home boolean")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    hot = materialize(at_home.groupBy("anchor").count().filter(F.col("count") > BLOCK).select("anchor", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-anchors")
    if hot.isEmpty():
        out = sent.withColumn("block", F.lit(0))
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        own = F.pmod(F.xxhash64(*names[1:]), blocks).cast("int")
        out = sent.join(hot, "anchor", "left").withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("home", F.col("home") & (F.col("block") == F.col("own")))
    return out.select(*names, "block", "home").repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"))


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between different fingerprints whose components are those of all links at ``threshold`` or fewer bits."""
    if threshold > 5:
        raise ValueError("three segments of covering radius 1 meet every link of up to 5 bits, not more")

    def spread(batches, homes_only):
        for b in batches:
            fp = b.column("fp").to_numpy()
            if len(fp):
                rows, anchors, homes = anchors_of(fp, homes_only)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchors), "fp": pa.array(fp[rows]), "home": pa.array(homes)})

    return dealt(fps.select("fp"), spread, "anchor long, fp long").mapInArrow(lambda batches: _compare(batches, threshold), "a long, b long")


def groups(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, root, component_id) for the fingerprints of a table (doc_id, fp)."""
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = materialize(components(links(classes, threshold)), "components")
    own = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(own.join(ids, "root").select("fp", "root", "component_id"), "groups")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, n_words: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``; component_id is the smallest doc_id reachable.

    Repeated rows give repeated rows; a null doc_id stays null and is never a component's id unless all its rows are
    null. Texts without words have fingerprint 0 and are linked like any other. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, n_words), "fingerprints")
    return fps.join(groups(fps, threshold), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
