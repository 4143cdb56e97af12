"""Frames and tables from files, and back."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FRAME = "path string, nz int, nx int, ny int, pixels array<float>"


def read_frames(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """(t, path, nz, nx, ny, pixels) of a folder's arrays, t by name; arrays of different shapes are an error. Hidden files are left out.

    Shapes come from the files' headers in a small job before; arrays are decoded once.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    files = files.filter(~F.element_at(F.split("path", "/"), -1).startswith(".")).select("path", "content")

    def shapes_of(heads):
        for pdf in heads:
            yield pd.DataFrame({"shape": sorted({str(_shape(h)) for h in pdf["head"]})})

    shapes = files.select(F.substring("content", 1, 1024).alias("head")).mapInPandas(shapes_of, "shape string").distinct().limit(2).collect()
    if len(shapes) > 1:
        raise ValueError(f"frames differ in shape: {[r['shape'] for r in shapes]}")

    def decode(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape((1,) * (3 - a.ndim) + a.shape)
                rows.append((path, *a.shape, a.astype(np.float32).ravel()))
            yield pd.DataFrame(rows, columns=["path", "nz", "nx", "ny", "pixels"])

    names = files.select("path").withColumn("t", F.row_number().over(W.orderBy("path")) - 1)
    return files.mapInPandas(decode, FRAME).join(names, "path").select("t", "path", "nz", "nx", "ny", "pixels")


def _shape(head: bytes) -> tuple[int, ...]:
    """The shape in the header of a .npy file, with leading ones up to three dimensions."""
    f = io.BytesIO(head)
    version = np.lib.format.read_magic(f)
    shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]
    return (1,) * (3 - len(shape)) + tuple(shape)


def write_frames(frames: DataFrame, folder: str) -> None:
    """One .npy file a row (name, nz, nx, ny, pixels), by tasks, in a folder that all of them share; a file is complete once it has its name."""
    from pyarrow import fs

    def run(parts):
        store, base = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for pdf in parts:
            for r in pdf.itertuples():
                out = io.BytesIO()
                np.save(out, np.asarray(r.pixels, dtype=np.float32).reshape(r.nz, r.nx, r.ny), allow_pickle=False)
                part = f"{base}/.{r.name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(out.getvalue())
                store.move(part, f"{base}/{r.name}.npy")
            yield pdf[["name"]]

    frames.select("name", "nz", "nx", "ny", "pixels").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


def to_voxels(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row a voxel, with the frame's keys."""
    rows = frames.select(*keys, "nx", "ny", F.posexplode("pixels").alias("i", "v"))
    i = F.col("i")
    return rows.select(*keys, F.floor(i / (F.col("nx") * F.col("ny"))).cast("int").alias("z"), (F.floor(i / F.col("ny")) % F.col("nx")).cast("int").alias("x"), (i % F.col("ny")).cast("int").alias("y"), F.col("v").cast("double").alias("value"))


def assign_channels(files: DataFrame) -> DataFrame:
    """Adds channel (0 for CamA, 1 for CamB) and t by name within it; an error if the channels have different numbers of files."""
    rows = files.withColumn("cam", F.regexp_extract("name", "Cam([AB])", 1)).filter("cam <> ''").withColumn("channel", F.when(F.col("cam") == "A", 0).otherwise(1)).drop("cam")
    if len({r["count"] for r in rows.groupBy("channel").count().collect()}) > 1:
        raise ValueError("channels have different numbers of files")
    return rows.withColumn("t", F.row_number().over(W.partitionBy("channel").orderBy("name")) - 1)


def span(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Frames first to last, numbered from 0; an error if there are fewer."""
    top = rows.agg(F.max("t")).first()[0]
    if top is not None and last > top:
        raise ValueError(f"the last frame is {top}")
    return rows.filter((F.col("t") >= first) & (F.col("t") <= last)).withColumn("t", F.col("t") - first)


def trim_incomplete(voxels: DataFrame) -> DataFrame:
    """Without the last frame of a stack if one of its slices is all 0."""
    last = voxels.groupBy("stack_id").agg(F.max("t").alias("t"))
    bad = voxels.join(last, ["stack_id", "t"]).groupBy("stack_id", "t", "z").agg(F.min("value").alias("a"), F.max("value").alias("b")).filter("a = 0 AND b = 0")
    return voxels.join(bad.select("stack_id", "t").distinct(), ["stack_id", "t"], "left_anti")


def read_object_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_embeddings(rows: DataFrame, path: str) -> None:
    """Parquet with the name in each row; hidden names are left out."""
    rows.filter(~F.col("name").startswith(".")).write.parquet(path)


def export_embeddings(rows: DataFrame, path: str) -> None:
    """Text: the name, then the numbers, between tabs."""
    rows.select(F.concat_ws("\t", "name", F.array_join(F.col("embedding").cast("array<string>"), "\t"))).write.text(path)


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.get(parts, 0).alias("name"), F.slice(parts, 2, 1 << 30).cast("array<double>").alias("embedding"))


def write_triplets(rows: DataFrame, path: str) -> None:
    rows.select("anchor", "positive", "negative").write.csv(path, compression="gzip")


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="anchor string, positive string, negative string")


def save_movie(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet, by stack."""
    for name, df in tables.items():
        df.write.partitionBy("stack_id").parquet(f"{folder}/{name}")
