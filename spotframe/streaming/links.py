"""Tracks while a movie is acquired: spots in, their numbers out as soon as a frame is complete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from spotframe.functions import kernels as kn

LINKED = "stack_id long, t int, fit_no long, spot_id long"
PLACED = "t int, fit_no long, z double, x double, y double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Linker(StatefulProcessor):
    """State of a stack: spots of frames that are still open, ends of the last ``max_gap`` + 1 frames, and the next numbers."""

    def __init__(self, max_gap: int, max_jump: float):
        self.max_gap, self.max_jump = max_gap, max_jump

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"ms long, {PLACED}")
        self.ends = handle.getListState("ends", "t int, z double, x double, y double, track long, spot_id long")
        self.next = handle.getValueState("next", "track long, spot_id long, after long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        after = self.next.get()[2] if self.next.exists() else None
        for pdf in rows:
            # a frame that is linked stays so
            new = [r for r in zip(*(pdf[c].tolist() for c in ("ms", "t", "fit_no", "z", "x", "y")), strict=True) if after is None or r[0] > after]
            if new:
                self.open.appendList(new)
            for ms in {r[0] for r in new}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs()
        pending = list(self.open.get())
        closed = sorted((r for r in pending if r[0] <= done), key=lambda r: r[:3])
        if not closed:  # an earlier timer of this batch has linked them
            return
        left = [r for r in pending if r[0] > done]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        track, number, _ = self.next.get() if self.next.exists() else (0, 0, 0)
        frames: dict[int, list] = {}
        for r in self.ends.get():
            frames.setdefault(r[0], []).append(r[1:])
        spots: dict[int, list] = {}
        for r in closed:
            spots.setdefault(r[1], []).append(r)
        out = []
        for t, mine in spots.items():
            xyz = np.array([r[3:] for r in mine], dtype=float)
            backs = []
            for lag in range(1, self.max_gap + 2):
                if t - lag not in frames:
                    break
                ends = np.array(frames[t - lag], dtype=float)
                backs.append((ends[:, :3], ends[:, 3].astype(int)))
            known = {e[3]: e[4] for f in frames.values() for e in f}
            tracks, track = kn.link_frame(xyz, backs, track, self.max_jump)
            for k in tracks.tolist():
                if k not in known:
                    known[k], number = number, number + 1
            frames[t] = [(*r[3:], k, known[k]) for r, k in zip(mine, tracks.tolist(), strict=True)]
            frames = {f: e for f, e in frames.items() if f >= t - self.max_gap}
            out += [(key[0], t, r[2], known[k]) for r, k in zip(mine, tracks.tolist(), strict=True)]
        self.ends.put([(f, *e) for f, own in frames.items() for e in own])
        self.next.update((track, number, closed[-1][0]))
        yield pd.DataFrame(out, columns=["stack_id", "t", "fit_no", "spot_id"])

    def close(self) -> None:
        pass


def stream_links(spots: DataFrame, max_gap: int = 1, max_jump: float = 10.0, scale_xy: float = 1.0, scale_z: float = 1.0, late: str = "2 days") -> DataFrame:
    """(stack_id, t, fit_no, spot_id) of a stream of spots (stack_id, t, ts, fit_no, z, x, y), by the rules and with the numbers of ``tracks.link_nearest``.

    ``ts`` is the time of the frame, one for each t and growing with it. A frame is linked once the watermark, ``late`` behind the newest ts, has passed it:
    its spots may come in any order and over many batches until then, later ones are dropped, and the frames after the watermark wait.
    A spot without a place begins a track; rows without stack_id, t, ts or fit_no are dropped; equal fit_no of a frame go by batch. State holds the open frames of a stack
    and the last ``max_gap`` + 1 that are linked, whatever the length of the movie. It lives in RocksDB, which this sets for the session.
    """
    spots.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    place = [(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) * s).alias(c) for c, s in (("z", scale_z), ("x", scale_xy), ("y", scale_xy))]
    known = spots.filter("stack_id IS NOT NULL AND t IS NOT NULL AND ts IS NOT NULL AND fit_no IS NOT NULL").withWatermark("ts", late)
    rows = known.select(F.col("stack_id").cast("long").alias("stack_id"), F.col("t").cast("int").alias("t"), "ts", F.unix_millis("ts").alias("ms"), F.col("fit_no").cast("long").alias("fit_no"), *place)
    return rows.groupBy("stack_id").transformWithStateInPandas(statefulProcessor=_Linker(max_gap, max_jump), outputStructType=LINKED, outputMode="Append", timeMode="EventTime")
