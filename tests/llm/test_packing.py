import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spotframe.llm import packing
from spotframe.llm.queries import tokenizer_path

ODD = ["a<|endoftext|>b", "x \x01 y\x1cz q", "Σίσυφος ΟΔΟΣ ὈΔΟΣ", "é ́a don't we'll 12ab　q", "", " \n\t\r", "İstanbul ŉ ﬀ Å Ａ", "The. THE, the;; (the) #the", "日本語 テスト", "a​b 🙂🙂", "Á É é."]


def plain_ids(texts):
    tok = Tokenizer.from_file(tokenizer_path())
    return [[*e.ids, 1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(tokenizer_path()).ids(texts)]
    assert got == plain_ids(texts)


def test_ids_when_the_caches_start_anew(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "MAX_WORDS", 50)
    monkeypatch.setattr(packing, "MAX_STEMS", 40)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] * 14
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(tokenizer_path()).ids(texts)]
    assert got == plain_ids(texts)


def test_ids_of_all_different_words():
    import pyarrow.parquet as pq

    words = sorted({w for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist() for w in (t or "").split()})
    assert len(words) > 100_000
    lines = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
    got = packing.WordEncoder(tokenizer_path()).ids(lines)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == plain_ids(lines)


def test_tokenizer_takes_over_where_the_ways_differ():
    texts = [" ".join(f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst")] + ODD
    enc = packing.WordEncoder(tokenizer_path())
    right, enc.tried = enc.many, True
    enc.many = lambda stems: [x[:-4] for x in right(stems)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == plain_ids(texts) and enc.many is None


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_decreasing(seed):
    lengths = np.sort(np.random.default_rng(seed).integers(1, 101, 200))[::-1]
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room = []
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        want = next((k for k, r in enumerate(room) if r >= n), len(room))
        if want == len(room):
            room.append(100)
        assert (b, o) == (want, 100 - room[want])
        room[want] -= n


def check(rows, out, max_len):
    ids = defaultdict(list)
    for (doc, text), x in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        ids[doc].append(x)
    seqs = defaultdict(list)
    have = defaultdict(int)
    for p in out:
        seqs[p.sequence_id].append((p.offset, p.length))
        match = [x for x in ids[p.doc_id] if len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
        assert match
        have[p.doc_id] += p.length
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= max_len
    assert dict(have) == {d: sum(map(len, x)) for d, x in ids.items()}
    return sum(have.values()) / (max_len * len(seqs))


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, tokenizer_path()).collect(), 2048) > 0.98


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "z"), (5, "word " * 9000), *((10 + i, t) for i, t in enumerate(ODD))]
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, group int")
    check(rows, packing.pack(df, tokenizer_path()).collect(), 2048)
    check(rows, packing.pack(df, tokenizer_path(), 64, 3).collect(), 64)
    assert packing.pack(df.limit(0), tokenizer_path()).collect() == []
