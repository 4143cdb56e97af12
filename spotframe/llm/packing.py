"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

Plan: one map over the documents (tokens, pieces, checksums), written once; one shuffle of piece
lengths (no text, no ids) into groups of about ``group_docs`` documents; first-fit decreasing in each group.
A group's size doesn't depend on any key of the data: rows are dealt by a hash of their content and place.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.llm.common import materialize

MAX_WORDS, MAX_STEMS = 600_000, 1_200_000  # whose ids a worker remembers; beyond, it starts anew
SAMPLED = 64  # one stem of so many is encoded by the tokenizer too
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_MARK = "\x01"  # stands between words that are encoded together
_CLOSING = ".,;:!?#$%&*|)"


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class StemEncoder:
    """Ids of many stems (letters only) in one call.

    The merges of a vocabulary with word ends are stated as ranks over bytes, a control byte standing for the word
    end: it joins the byte before it first of all, then the merges follow in their order.
    """

    def __init__(self, tokenizer_path: str):
        import tiktoken

        with open(tokenizer_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{tokenizer_path}: a BPE vocabulary with word ends is asked for")
        byte_of, mark = _byte_of_char(), _MARK.encode()

        def raw(token: str) -> bytes:
            letters = token.removesuffix("</w>")
            return bytes(byte_of[c] for c in letters) + mark * (letters != token)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        names = [bytes([b]) + mark for b in range(256)] + [raw(a + b) for a, b in pairs]
        names += [x for b in range(256) if (x := bytes([b])) not in names[:256]]
        ranks = {x: k for k, x in enumerate(names)}
        known = {raw(t): k for t, k in model["vocab"].items() if not re.fullmatch(r"<\|\w+\|>", t)}
        self.ids = np.array([known.get(x, 0) for x in ranks], dtype="<u4")
        self.last = np.array([x.endswith(mark) for x in ranks])
        self.enc = tiktoken.Encoding("stems", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, stems: list[str]) -> list[bytes]:
        out = np.array(self.enc.encode_ordinary(_MARK.join(stems) + _MARK), dtype=np.int64)
        raw, ends = self.ids[out].tobytes(), ((np.flatnonzero(self.last[out]) + 1) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class WordEncoder:
    """Ids of whole texts. The vocabulary never merges across blanks, so each word between blanks is encoded once.

    A word of letters with closing marks is its letters (the stem, in lower case where plain ASCII) and its marks,
    which the vocabulary splits there too; so stems are shared by all their forms. What isn't plain goes to the tokenizer.
    """

    def __init__(self, tokenizer_path: str, end_id: int = 1):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.many = StemEncoder(tokenizer_path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.words: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {"": b""}
        self.tried = False

    def _encode(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _learn_stems(self, stems: list[str]) -> None:
        if len(self.stems) > MAX_STEMS:
            self.stems = {"": b""}
        plain = [s for s in stems if s.isalpha() and (s.isascii() or (s.islower() and s.lower() == s and unicodedata.is_normalized("NFC", s)))]
        for s in set(stems).difference(plain):
            self.stems[s] = self._encode(s)
        if plain and self.many is not None:
            new = dict(zip(plain, self.many(plain), strict=True))
            # the two ways must agree: on the first stems, then on a hashed sample of each batch
            some = [s for s in plain if zlib.crc32(s.encode("utf-8")) % SAMPLED == 0] if self.tried else plain[:200]
            self.tried = True
            if all(new[s] == self._encode(s) for s in some):
                self.stems.update(new)
                return
            self.many = None  # from now on the tokenizer alone
        for s in plain:
            self.stems[s] = self._encode(s)

    def _learn(self, words: set[str]) -> None:
        parts = []
        for w in words:
            stem = w.rstrip(_CLOSING)
            if stem.isalpha():
                parts.append((w, stem.lower() if stem.isascii() or stem.lower().isalpha() and "\u03a3" not in stem else stem, w[len(stem) :]))
            else:
                parts.append((w, w, ""))
        self._learn_stems(list({x for _, a, b in parts for x in (a, b) if x not in self.stems}))
        get = self.stems.get
        for w, a, b in parts:
            x, y = get(a), get(b)  # none only if the stems were just started anew
            self.words[w] = (self._encode(a) if x is None else x) + (self._encode(b) if y is None else y)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text with the end id, as little-endian unsigned 32-bit numbers."""
        for k in range(0, len(texts), 256):
            split = [None if any(s in t for s in self.special) else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts[k : k + 256]]
            if len(self.words) > MAX_WORDS:
                self.words = {"": b""}
            if new := set().union(*filter(None, split)).difference(self.words):
                self._learn(new)
            get = self.words.__getitem__
            for words, text in zip(split, texts[k : k + 256], strict=True):
                yield (self._encode(text) if words is None else b"".join(map(get, words))) + self.end


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 2048) -> DataFrame:
    """One row per piece: ``max_len`` ids each, the last of a document with what remains.

    Null text counts as empty (one piece that holds the end id alone); a null doc_id stays null. Repeated rows are
    documents of their own. Only doc_id and text are read, so further columns don't matter.
    """

    def run(batches):
        enc, row = WordEncoder(tokenizer_path), 0
        for b in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal")}
            docs_ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for doc, ids in zip(docs_ids, enc.ids(texts), strict=True):
                n, row = len(ids) // 4, row + 1
                for s in range(0, n, max_len):
                    e = min(n, s + max_len)
                    crc = zlib.crc32(ids[4 * s : 4 * e])
                    for k, v in zip(out, (doc, s, e - s, crc, n, row), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given (decreasing) order.

    The tree's leaves are the room left in each bin, each inner node the larger of its two children; the leftmost
    bin with room enough is found from the root in a logarithm of steps.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths.tolist():
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < n:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= n
        while node > 1:
            node //= 2
            a, b = room[2 * node], room[2 * node + 1]
            best = a if a > b else b
            if room[node] == best:
                break
            room[node] = best
    return np.array(bins, dtype=np.int64), np.array(offsets, dtype=np.int64)


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, group_docs: int = 2048) -> DataFrame:
    """Pack every document of ``docs`` into sequences of at most ``max_len`` ids; one row per piece (``PACKED``).

    Documents are dealt at random (by hash) into groups of about ``group_docs``; each group is packed alone, and
    sequence ids are group * 2**32 + bin. Ties of length go by doc_id, start and checksum. Null text counts as empty.
    A row's place in its partition takes part in the hash, so that a very common document is dealt over all groups; so another
    partitioning of the input may give another packing. Texts of any length are cut; repeated rows are documents of their own; other
    columns aren't read. An empty table gives no rows.
    """
    cut = materialize(pieces(docs, tokenizer_path, max_len), "pieces")
    groups = max(1, round(cut.filter("start = 0").count() / group_docs))

    def run(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), max_len)
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=int(key[0]) * 2**32 + bins, offset=offsets)

    group = F.pmod(F.xxhash64("doc_id", "doc_tokens", "deal"), F.lit(groups)).alias("group")
    return cut.withColumn("group", group).groupBy("group").applyInPandas(run, PACKED)
