"""WARC archives: a deterministic sharded writer and its reader.

Records are put in order of (uri, id, payload digest) and cut into ranges (shards). The cuts come from a sample that is picked
by a hash of the key alone, so they don't depend on partitions, machines or attempts, and any uri may be as common as it
likes. Each task writes one range as gzip members, one a record, and starts another file when the compressed size passes ``roll_bytes``.
A task writes files with temporary names and returns one manifest row a file; the manifest is written with Spark's own
commit, so it names the files of those task attempts alone that counted. A second job renames just these (a file that has
its final name already is left), then the manifest is read back. Files of lost or repeated attempts keep their temporary
names and are never read.

Headers are made anew from the record: the same input gives the same records in the same order, byte for byte.
"""

import base64
import hashlib
import io
import uuid
import zlib
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.llm.common import materialize, scratch

MANIFEST = "shard int, roll int, temporary string, path string, records long, bytes long, sha1 string"
RECORD = "id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}  # Spark's names of stores, and Arrow's
MOST_SHARDS = 1 << 15
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def record_bytes(rid: int | None, uri: str | None, kind: str, refers: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header alone; its payload's length and digest stand in the WARC header."""
    block = HTTP.format(size).encode() + (payload if kind == "response" else b"")
    hexed = lambda b: base64.b32encode(b).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if rid is None else rid}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += [f"WARC-Payload-Digest: sha1:{hexed(bytes.fromhex(digest))}", f"WARC-Block-Digest: sha1:{hexed(hashlib.sha1(block).digest())}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name, so equal data gives equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def keys_of(pages: DataFrame) -> DataFrame:
    """(uri, id, payload_digest, payload_bytes) of rows (id, uri, payload), written to the shared folder: payloads are read once for all that follows."""
    return materialize(pages.select("uri", "id", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-keys")


def mark_revisits(pages: DataFrame, keys: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to to rows (id, uri, payload) with these ``keys``.

    Of equal payloads of ``least_bytes`` or more the row with the largest id is the response (all rows of that id are, if
    it is repeated), the others revisit it; null ids count as smallest. Only payloads that occur twice or more are joined;
    they are written first, so that Spark knows their size: if it is small, payloads aren't shuffled for the join.
    """
    large = F.col("payload_bytes") >= least_bytes
    again = keys.filter(large).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("id").alias("first")).filter("n > 1 AND first IS NOT NULL").drop("n")
    again = materialize(again, "repeated-payloads")
    known = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    return known.join(again, "payload_digest", "left").select("id", "uri", "payload", "payload_bytes", "payload_digest", F.when(large & ~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers_to")).withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def cut_points(keys: DataFrame, rows: int, shards: int, per_shard: int = 8) -> list[tuple]:
    """The first keys of all shards but the first: of about ``shards * per_shard`` sampled keys, each ``per_shard``-th.

    ``MOST_SHARDS`` bounds what comes to the driver.
    """
    step = max(1, rows // (shards * per_shard))
    sample = keys.filter(F.pmod(F.xxhash64(*keys.columns), F.lit(step)) == 0).collect()
    ordered = sorted({key_of(*r) for r in sample})
    every = max(1, -(-len(ordered) // shards))
    return ordered[every::every]


def key_of(uri: str | None, rid: int | None, digest: str) -> tuple:
    """Sorts as the columns do, nulls first."""
    return uri is not None, uri or "", rid is not None, rid or 0, digest


def write(pages: DataFrame, folder: str, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20, least_shards: int = 48) -> DataFrame:
    """Write rows (id, uri, payload as text) into ``folder``; returns its manifest, a row a file (``MANIFEST``).

    Null payloads count as empty; null ids and uris have none in their headers. Shards have about ``shard_bytes`` of payload
    each, or less, so that there are ``least_shards`` of them, or more, if there would be over ``MOST_SHARDS``; files roll anyhow.
    Repeated rows are records of their own; equal keys share a shard. Payloads of any length are written whole, one in memory at
    a time besides its batch. Other columns, of any names, aren't read. An empty table gives no files.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("id").cast("long").alias("id"), F.col("uri").cast("string").alias("uri"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))
    keys = keys_of(pages)
    rows = mark_revisits(pages, keys)
    total, count = keys.agg(F.sum("payload_bytes"), F.count("*")).first()
    shards = min(MOST_SHARDS, max(least_shards, -(-(total or 0) // shard_bytes)))
    order = ["uri", "id", "payload_digest"]
    cuts = spark.sparkContext.broadcast(cut_points(keys.select(*order), count, shards))

    @F.pandas_udf("int")
    def shard_of(keys: pd.DataFrame) -> pd.Series:
        return pd.Series([bisect_right(cuts.value, key_of(u, None if i is None else int(i), d)) for u, i, d in zip(keys["uri"], keys["id"], keys["payload_digest"], strict=True)], dtype="int32")

    def pack(batches):
        fs, base = file_system(folder)
        fs.create_dir(f"{base}/parts", recursive=True)
        done, state = [], None

        def close():
            nonlocal state
            if state:
                state["sink"].close()
                done.append((state["shard"], state["roll"], state["name"], state["records"], state["bytes"], state["sha1"].hexdigest()))
                state = None

        roll = 0
        for b in batches:
            for shard, rid, uri, payload, size, digest, refers, kind in zip(*(b.column(c).to_pylist() for c in ("shard", "id", "uri", "payload", "payload_bytes", "payload_digest", "refers_to", "record_type")), strict=True):
                member = gzip_member(record_bytes(rid, uri, kind, refers, digest, size, payload.encode("utf-8")))
                if state and state["shard"] != shard:
                    close()
                    roll = 0
                elif state and state["bytes"] + len(member) > roll_bytes:
                    close()
                    roll += 1
                if not state:
                    name = f"{base}/parts/.tmp-{shard:06d}-{roll:04d}-{uuid.uuid4().hex}"
                    state = {"shard": shard, "roll": roll, "name": name, "sink": fs.open_output_stream(name, compression=None), "records": 0, "bytes": 0, "sha1": hashlib.sha1()}
                state["sink"].write(member)
                state["sha1"].update(member)
                state["records"] += 1
                state["bytes"] += len(member)
        close()
        names = ["shard", "roll", "temporary", "records", "bytes", "sha1"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = {n: pa.array([d[k] for d in done], t) for k, (n, t) in enumerate(zip(names, types, strict=True))}
        final = [f"{base}/parts/shard-{d[0]:06d}-{d[1]:04d}.warc.gz" for d in done]
        yield pa.RecordBatch.from_pydict({"shard": columns["shard"], "roll": columns["roll"], "temporary": columns["temporary"], "path": pa.array(final, pa.string()), "records": columns["records"], "bytes": columns["bytes"], "sha1": columns["sha1"]})

    def commit(batches):
        from pyarrow.fs import FileType

        fs, _ = file_system(folder)
        for b in batches:
            for old, new in zip(b.column("temporary").to_pylist(), b.column("path").to_pylist(), strict=True):
                if fs.get_file_info(old).type == FileType.File:
                    fs.move(old, new)
                elif fs.get_file_info(new).type != FileType.File:
                    raise FileNotFoundError(f"neither {old} nor {new}")
            yield b

    ranged = rows.withColumn("shard", shard_of(F.struct("uri", F.col("id").cast("string").alias("id"), "payload_digest"))).repartitionById(shards, "shard").sortWithinPartitions("shard", *order)
    ranged.mapInArrow(pack, MANIFEST).write.parquet(f"{folder}/claims")
    claims = spark.read.parquet(f"{folder}/claims")
    claims.mapInArrow(commit, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def parse(stream) -> list[tuple]:
    """The records of one archive (gzip members end to end), one by one; digests and lengths are checked."""
    unzip, rest = zlib.decompressobj(31), b""
    while True:
        data, out = rest or stream.read(1 << 20), io.BytesIO()
        rest = b""
        if not data:
            return
        while True:
            out.write(unzip.decompress(data))
            if unzip.eof:
                rest, unzip = unzip.unused_data, zlib.decompressobj(31)
                break
            data = stream.read(1 << 20)
            if not data:
                raise EOFError("an archive ends inside a record")
        head, _, block = out.getvalue().partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
        block = block[: int(fields["Content-Length"])]
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
            raise ValueError("a block doesn't have its digest")
        payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
            raise ValueError("a payload doesn't have its digest")
        number = lambda v: int(v[len("<urn:page:") : -1]) if v and v != "<urn:page:>" else None
        uri = fields.get("WARC-Target-URI")
        uri = uri if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        yield number(fields["WARC-Record-ID"]), uri, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), digest, int(fields["X-Payload-Length"]), payload


def read(manifest: DataFrame, batch_bytes: int = 16 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """All records of the files of a manifest (``RECORD``), payload null for revisits.

    Files are read as streams, one after the other; a task has about ``task_bytes`` of them, less if that leaves cores idle.
    """
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, place = file_system(path)
                rows, n = [], 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for r in parse(stream):
                        rows.append(r)
                        n += len(r[-1] or b"") + 200
                        if n > batch_bytes:
                            yield batch(rows)
                            rows, n = [], 0
                if rows:
                    yield batch(rows)

    size, files = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(files, max(-(-size // task_bytes), 2 * manifest.sparkSession.sparkContext.defaultParallelism)))
    return manifest.select("path", F.pmod(F.col("shard") + F.col("roll"), F.lit(tasks)).cast("int").alias("task")).repartitionById(tasks, "task").select("path").mapInArrow(run, RECORD)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write rows (id, uri, payload) to a new folder of the shared one and read them back."""
    return read(write(pages, scratch(spark, "warc")))
