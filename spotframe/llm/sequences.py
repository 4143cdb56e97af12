"""Positions of rows within the groups of a sorted table, whatever a group's size: no group is brought into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.llm.common import written


def numbered(rows: DataFrame, key: str, order: list[Column], name: str, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``rows`` (or its columns ``keep``, the key among them) with pos: the place of a row among those with its ``key``, from 1; and the path of the written table it reads.

    Rows are sorted by ranges of (key, order), so a large group lies in many tasks, each of which counts its runs of equal keys as they stream by.
    Only the first run of a task can go on from tasks before; what to add to it comes from one small row a task. A null key is
    a group; ``order`` should be total (rows that it leaves equal may come in either order). Columns pos and part must be free.
    """
    import numpy as np
    import pyarrow as pa

    keep = keep or rows.columns
    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).select(*keep, F.spark_partition_id().alias("part"))
    columns, at = dealt.columns, dealt.columns.index(key)
    schema = dealt.withColumn("pos", F.lit(0).cast("long")).schema

    def count(batches):
        last, n, began = None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(at).to_pylist()
            new = np.fromiter((k != before for k, before in zip(keys, [last, *keys], strict=False)), bool, len(keys))
            new[0] |= not began
            starts = np.flatnonzero(new)
            base = np.full(len(keys), -n)  # the run that comes in from the batch before has n rows already
            if len(starts):
                base[starts[0] :] = np.repeat(starts, np.diff(np.append(starts, len(keys))))
            pos = np.arange(len(keys)) - base + 1
            last, n, began = keys[-1], int(pos[-1]), True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos, pa.int64())], names=[*columns, "pos"])

    out, path = written(dealt.mapInArrow(count, schema), name)
    runs = out.groupBy("part", key).agg(F.max("pos").alias("n"))
    edges = runs.groupBy("part").agg(F.min_by(F.struct(key, "n"), F.struct(key)).alias("head"), F.max_by(F.struct(key, "n"), F.struct(key)).alias("tail"))
    first = edges.select("part", F.col("head.*")).unionByName(edges.select("part", F.col("tail.*"))).distinct()
    before = F.sum("n").over(W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    add = first.withColumn("add", before).filter("add IS NOT NULL").select(F.col("part").alias("_part"), F.col(key).alias("_key"), "add")
    # at most one row a task of the sort
    joined = out.join(F.broadcast(add), (F.col("part") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(*keep, (F.col("pos") + F.coalesce("add", F.lit(0))).alias("pos")), path
