"""What the operators of this subpackage share: tables, the shared folder, names of helper columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session has none (a plain local session) one is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="spotframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/spotframe/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where: lineage ends at files that every executor sees."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sliced(batches, column: str = "text", most: int = 4 << 20):
    """Arrow batches cut where their texts pass ``most`` bytes together (a longer text is alone), so that what is made of them stays small."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def fresh(df: DataFrame, n: int) -> tuple[str, ...]:
    """``n`` names for helper columns that ``df`` has none of."""
    taken = {c.lower() for c in df.columns}
    free = (f"_h{k}" for k in range(len(taken) + n))
    return tuple(x for x in free if x not in taken)[:n]
