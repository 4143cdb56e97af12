import gzip
import hashlib

from spotframe.llm import warc


def want(rows):
    first = {}
    for i, _, p in rows:
        p = p or ""
        if len(p.encode()) >= 1000 and i is not None:
            first[p] = max(first.get(p, i), i)
    out = []
    for i, u, p in rows:
        raw, to = (p or "").encode(), first.get(p or "")
        again = to is not None and i != to
        out.append((i, u, "revisit" if again else "response", to if again else None, hashlib.sha1(raw).hexdigest(), len(raw), None if again else raw))
    return sorted(out, key=str)


BIG = "é<p>" * 400
ROWS = [(1, "http://a/", BIG), (7, "http://b/ \r\n%0A%", BIG), (3, None, BIG), (None, "http://a/", BIG), (4, "http://a/", None), (5, "x", ""), (6, "x", "small"), (8, "x", "small"), (9, "x", "\r\n\r\nWARC/1.1\r\n\r\n"), (10, "x", "a" * 1000), (10, "x", "a" * 1000), (11, "y", "a" * 999), (12, "y", "a" * 999), (13, "z", "\x00" * 300_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "id long, uri string, payload string, shard string")


def as_rows(df):
    return sorted(((r.id, r.uri, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in df.collect()), key=str)


def test_round_trip_and_rolling(spark, tmp_path):
    manifest = warc.write(frame(spark, ROWS), str(tmp_path / "w"), roll_bytes=300)
    assert as_rows(warc.read(manifest)) == want(ROWS)
    files = manifest.collect()
    assert sum(f.records for f in files) == len(ROWS)
    assert all(f.bytes <= 300 or f.records == 1 for f in files) and len(files) > 3
    for f in files:
        raw = open(f.path, "rb").read()
        assert hashlib.sha1(raw).hexdigest() == f.sha1 and len(raw) == f.bytes
        assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type") == f.records  # plain gzip tools read it
    names = sorted(p.name for p in (tmp_path / "w" / "parts").iterdir() if not p.name.startswith(".tmp") and not p.name.endswith(".crc"))
    assert names == sorted(f.path.rsplit("/", 1)[1] for f in files)


def test_same_input_same_bytes(spark, tmp_path):
    a, b = (warc.write(frame(spark, rows), f"file://{tmp_path}/{n}").collect() for n, rows in (("a", ROWS), ("b", ROWS[::-1])))
    assert sorted(f.sha1 for f in a) == sorted(f.sha1 for f in b)


def test_commit_can_be_repeated_and_strays_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "w")
    manifest = warc.write(frame(spark, ROWS), folder)
    (tmp_path / "w" / "parts" / ".tmp-000000-0000-lost").write_bytes(b"half a rec")
    assert as_rows(warc.read(manifest)) == want(ROWS)


def test_empty(spark, tmp_path):
    assert warc.read(warc.write(frame(spark, []), str(tmp_path / "w"))).collect() == []


def test_pages(spark, sf, tmp_path):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert as_rows(warc.read(warc.write(frame(spark, rows), str(tmp_path / "w")))) == want(rows)


def test_read_back_in_several_tasks(spark, tmp_path):
    rows = [(k, f"http://{k % 7}/{k}", f"page {k} " * 50) for k in range(400)]
    manifest = warc.write(frame(spark, rows), str(tmp_path / "w"))
    out = warc.read(manifest)
    assert as_rows(out) == want(rows)
    assert out.rdd.getNumPartitions() == min(manifest.count(), 2 * spark.sparkContext.defaultParallelism) > 4
    records = [f.records for f in manifest.collect()]
    assert max(records) < 40  # of 400 in 48 shards


def test_schemes():
    from pyarrow import fs

    assert isinstance(warc.file_system("/a/b")[0], fs.LocalFileSystem) and warc.file_system("file:///a/b")[1] == "/a/b"
    assert warc.SCHEMES["s3a"] == "s3"
