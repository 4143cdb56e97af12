"""A movie that comes in piece by piece has the tracks of the whole one."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotframe.operators import tracks as tk
from spotframe.streaming.links import stream_links

SPOTS = "stack_id long, t int, fit_no long, z double, x double, y double"


def replay(spark, folder, df, pieces, **kw):
    """``pieces`` rows (piece, lower t, upper t) of the movie, one file and one batch each; a last row of another stack closes all frames."""
    at = F.timestamp_seconds((F.col("t") + 1) * 86400)  # a watermark begins at 0
    for n, (lo, hi, share) in enumerate(pieces):
        part = df.filter((F.col("t") >= lo) & (F.col("t") < hi) & (F.pmod(F.col("fit_no"), F.lit(2)) == share))
        part.withColumn("ts", at).coalesce(1).write.mode("append").parquet(f"{folder}/in/p={n}")
    end = spark.createDataFrame([(-1, 10_000, 0, 0.0, 0.0, 0.0)], SPOTS).withColumn("ts", F.timestamp_seconds(F.lit(86400 * 10_000)))
    end.coalesce(1).write.parquet(f"{folder}/in/p={len(pieces)}")
    out = []
    for n in range(len(pieces) + 1):  # each run goes on from the checkpoint of the one before, as after a loss
        stream = spark.readStream.schema(f"{SPOTS}, ts timestamp").parquet(f"{folder}/in/p=[0-{n}]")
        q = stream_links(stream, **kw).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/ck").format("parquet").start(f"{folder}/out")
        q.awaitTermination()
        out.append(spark.read.schema("stack_id long, t int, fit_no long, spot_id long").parquet(f"{folder}/out").filter("stack_id >= 0").count())
    got = spark.read.parquet(f"{folder}/out").filter("stack_id >= 0").collect()
    return {(r.stack_id, r.t, r.fit_no): r.spot_id for r in got}, len(got), out


@pytest.mark.parametrize("lattice", [False, True])
def test_tracks_of_a_replayed_movie(spark, tmp_path, lattice):
    rng = np.random.default_rng(3 + lattice)
    rows = []
    for s in range(2):
        for t in range(9):
            if (s, t) == (1, 4):
                continue  # looking back ends here
            for _ in range(14):
                z, x, y = (rng.integers(0, 5, 3) * 1.0 if lattice else rng.random(3) * 8).tolist()
                rows.append((s, t, len(rows), None if rng.random() < 0.05 else z, x, y))
    df = spark.createDataFrame(rows, SPOTS)
    # a frame comes in two pieces, even numbers and odd ones, not always one after the other
    pieces = [(0, 2, 0), (0, 3, 1), (2, 5, 0), (3, 5, 1), (5, 7, 0), (5, 7, 1), (7, 9, 0), (7, 9, 1)]
    got, n, counts = replay(spark, str(tmp_path), df, pieces, max_gap=1, max_jump=2.0, scale_z=0.5, late="3 days")
    want = {(r.stack_id, r.t, r.fit_no): r.spot_id for r in tk.link_nearest(df, 1, 2.0, scale_z=0.5).collect()}
    assert n == len(rows) and got == want
    assert counts[0] == 0 and 0 < counts[-2] < n  # frames come out while the movie goes on


def test_late_and_odd_rows(spark, tmp_path):
    day = lambda d: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=d)
    kind = f"{SPOTS}, ts timestamp"
    parts = [
        [(1, 0, 1, 0.0, 0.0, 0.0, day(0)), (1, 1, 2, 0.0, 0.5, 0.0, day(1)), (None, 1, 3, 0.0, 0.0, 0.0, day(1)), (1, None, 4, 0.0, 0.0, 0.0, day(1)), (1, 1, 5, 0.0, 0.0, 0.0, None)],
        [(1, 9, 6, 0.0, 0.0, 0.0, day(9))],
        [(1, 0, 7, 0.0, 0.0, 0.0, day(0)), (1, 9, 8, 0.0, 9.0, 0.0, day(9))],  # 7 is late, 8 is not
        [(2, 30, 9, 0.0, 0.0, 0.0, day(30))],
    ]
    for n in range(len(parts)):
        spark.createDataFrame(parts[n], kind).coalesce(1).write.parquet(f"{tmp_path}/in/p={n}")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/p=[0-9]")
        stream_links(stream, 1, 1.0).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").format("parquet").start(f"{tmp_path}/out").awaitTermination()
    got = {r.fit_no: r.spot_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: 0, 2: 0, 6: 1, 8: 2}
