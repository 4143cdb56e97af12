"""Frames larger than a task: filters, connected parts and hole filling over tiles of a voxel table.

A tile is a group of voxels; filters get the voxels around it as well, so each tile's result is that of the whole frame. Parts of
different tiles that touch over a border are joined as a graph, whose nodes are the parts' first pixels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.functions import kernels as kn
from spotframe.operators import graph
from spotframe.sources.scratch import discard, written

Size = tuple[int, int, int]
FRAME = ["stack_id", "t"]
TILE = ["tz", "tx", "ty"]


def _spread(rows: DataFrame, size: Size, tile: Size, halo: Size) -> DataFrame:
    """Rows once for each tile that they lie in, or within ``halo`` of."""
    for k, n, m, h in zip("zxy", size, tile, halo, strict=True):
        last = (n - 1) // m
        low = F.greatest(F.floor((F.col(k) - h) / m), F.lit(0))
        high = F.least(F.floor((F.col(k) + h) / m), F.lit(last))
        rows = rows.withColumn(f"t{k}", F.explode(F.sequence(low, high)) if h else F.floor(F.col(k) / m))
    return rows


def _mirror(at: np.ndarray, n: int) -> np.ndarray:
    """Places in 0 to n - 1 for places beyond both ends, which are mirrored with the edge repeated."""
    at = at % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def _together(frames, most: int = 1 << 20):
    """The small tables of many tiles as fewer large ones."""
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= most:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


def filter_voxels(voxels: DataFrame, size: Size, tile: Size, halo: Size, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Voxels (stack_id, c, t, z, x, y, value) with ``work(array)`` in place of their values, as if it had seen the whole frame.

    A value of ``work`` may hang on voxels up to ``halo`` away. Every voxel of the image should be there once; missing ones count as 0 and come back with a value.
    """
    keys = ["stack_id", "c", "t", *TILE]
    groups = _spread(voxels.select("stack_id", "c", "t", "z", "x", "y", F.col("value").cast("double").alias("value")), size, tile, halo).groupBy(*keys).agg(F.collect_list(F.struct("z", "x", "y", "value")).alias("s"))

    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples():
                low = [int(a) * m for a, m in zip((r.tz, r.tx, r.ty), tile, strict=True)]
                high = [min(a + m, n) for a, m, n in zip(low, tile, size, strict=True)]
                start = [max(a - h, 0) for a, h in zip(low, halo, strict=True)]
                shape = [min(b + h, n) - a for a, b, h, n in zip(start, high, halo, size, strict=True)]
                near = np.zeros(shape)
                near[np.asarray(r.zs) - start[0], np.asarray(r.xs) - start[1], np.asarray(r.ys) - start[2]] = r.vs
                for axis, (a, b, h, n) in enumerate(zip(low, high, halo, size, strict=True)):
                    near = np.take(near, _mirror(np.arange(a - h, b + h), n) - start[axis], axis=axis)
                out = work(near)[tuple(slice(h, h + b - a) for a, b, h in zip(low, high, halo, strict=True))]
                z, x, y = (i.ravel() + a for i, a in zip(np.indices(out.shape), low, strict=True))
                yield pd.DataFrame({"stack_id": r.stack_id, "c": r.c, "t": r.t, "z": z, "x": x, "y": y, "value": out.ravel()})

    kinds = {c: voxels.schema[c].dataType.simpleString() for c in ("stack_id", "c", "t")}
    return groups.select(*keys, *[F.col(f"s.{k}").alias(f"{k[0]}s") for k in ("z", "x", "y", "value")]).mapInPandas(lambda parts: _together(run(parts)), f"stack_id {kinds['stack_id']}, c {kinds['c']}, t {kinds['t']}, z int, x int, y int, value double")


def gaussian_voxels(voxels: DataFrame, sigma: float, size: Size, tile: Size) -> DataFrame:
    h = len(kn.gaussian_weights(sigma)) // 2
    return filter_voxels(voxels, size, tile, (h, h, h), lambda a: kn.gaussian_filter(a, sigma))


def extreme_voxels(voxels: DataFrame, box: Size, size: Size, tile: Size, largest: bool = True) -> DataFrame:
    return filter_voxels(voxels, size, tile, box, lambda a: kn.extreme_filter(a, box, largest))


def _tiles(mask: DataFrame, size: Size, tile: Size, every: bool) -> DataFrame:
    """(stack_id, t, frame, tile, places): the mask's pixels of each tile as places within it; ``every``: tiles without pixels too."""
    cut = [-(-n // m) for n, m in zip(size, tile, strict=True)]
    frames = mask.select(*FRAME).distinct().withColumn("frame", (F.row_number().over(W.orderBy(*FRAME)) - 1).cast("long"))  # a row a frame
    number = (F.col("tz") * cut[1] + F.col("tx")) * cut[2] + F.col("ty")
    place = ((F.col("z") % tile[0]) * tile[1] + F.col("x") % tile[1]) * tile[2] + F.col("y") % tile[2]
    pixels = _spread(mask.select(*FRAME, "z", "x", "y").distinct(), size, tile, (0, 0, 0)).select(*FRAME, number.cast("long").alias("tile"), place.cast("int").alias("place"))
    groups = pixels.groupBy(*FRAME, "tile").agg(F.collect_list("place").alias("places"))
    if every:
        grid = frames.select(*FRAME, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cut[0] * cut[1] * cut[2] - 1).cast("long"))).alias("tile"))
        groups = grid.join(groups, [*FRAME, "tile"], "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    return groups.join(frames, FRAME)


def _local(r, size: Size, tile: Size, background: bool) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Of one tile the parts by pixel (0: none), the first pixel of each part in the frame's numbering, and the tile's corner."""
    cut = [-(-n // m) for n, m in zip(size, tile, strict=True)]
    low = [int(i) * m for i, m in zip(np.unravel_index(int(r.tile), cut), tile, strict=True)]
    mask = np.zeros(tile, dtype=bool)
    mask.ravel()[np.asarray(r.places, dtype=np.int64)] = True
    mask = mask[tuple(slice(0, min(m, n - a)) for a, m, n in zip(low, tile, size, strict=True))]
    parts = kn.connected_components(~mask if background else mask)
    flat = np.flatnonzero(parts)
    first = flat[np.unique(parts.ravel()[flat], return_index=True)[1]]
    at = np.unravel_index(first, parts.shape)
    pixel = ((at[0] + low[0]).astype(np.int64) * size[1] + at[1] + low[1]) * size[2] + at[2] + low[2]
    return parts, int(r.frame) * (size[0] * size[1] * size[2]) + pixel, low


def _roots(tiles: DataFrame, size: Size, tile: Size, background: bool) -> tuple[DataFrame, DataFrame]:
    """(node, root) of parts that go on in other tiles, and (node, edge) of all parts: whether they touch the image's edge."""

    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples():
                own, nodes, low = _local(r, size, tile, background)
                edge = np.zeros(len(nodes) + 1, dtype=bool)
                out = []
                for axis in range(3):
                    for end in (0, own.shape[axis] - 1):
                        face = np.take(own, end, axis=axis)
                        outside = low[axis] + end in (0, size[axis] - 1)
                        if outside:
                            edge[face.ravel()] = True
                        others = [k for k in range(3) if k != axis]
                        at = np.nonzero(face)
                        where = np.zeros((3, len(at[0])), dtype=np.int64)
                        where[others[0]], where[others[1]], where[axis] = at[0] + low[others[0]], at[1] + low[others[1]], low[axis] + end
                        # a border is named by its pixel on the lower side
                        if end == own.shape[axis] - 1 and low[axis] + end < size[axis] - 1:
                            out.append((where, face[at], axis))
                        if end == 0 and low[axis] > 0:
                            where = where.copy()
                            where[axis] -= 1
                            out.append((where, face[at], axis))
                rows = [pd.DataFrame({"node": nodes[k - 1], "edge": False, "border": ((w[0] * size[1] + w[1]) * size[2] + w[2]) * 3 + axis, "frame": int(r.frame)}) for w, k, axis in out if len(k)]
                rows.append(pd.DataFrame({"node": nodes, "edge": edge[1:], "border": -1, "frame": int(r.frame)}))
                yield pd.concat(rows)

    seen, _ = written(tiles.mapInPandas(lambda parts: _together(run(parts)), "node long, edge boolean, border long, frame long"), "tile-parts")
    links = seen.filter("border >= 0").groupBy("frame", "border").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    roots, _ = written(graph.components(links.select("a", "b")), "part-roots")
    return roots, seen.filter("border < 0").select("node", "edge")


def label_voxels(mask: DataFrame, size: Size, tile: Size) -> DataFrame:
    """(stack_id, t, z, x, y, label): parts of the pixels of ``mask`` that touch at faces, numbered from 1 in order of their first pixel in the frame."""
    tiles, path = written(_tiles(mask, size, tile, False), "tiles")
    roots, parts = _roots(tiles, size, tile, False)
    volume = size[0] * size[1] * size[2]
    parts = parts.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    order = W.partitionBy("frame").orderBy("root")
    numbers = parts.select("root", F.floor(F.col("root") / volume).alias("frame")).distinct().withColumn("label", F.row_number().over(order))
    numbers = parts.join(numbers, "root").select("node", "label")

    def run(groups):
        for pdf in groups:
            for r in pdf.itertuples():
                own, nodes, low = _local(r, size, tile, False)
                z, x, y = np.nonzero(own)
                yield pd.DataFrame({"stack_id": r.stack_id, "t": r.t, "z": z + low[0], "x": x + low[1], "y": y + low[2], "node": nodes[own[z, x, y] - 1]})

    kinds = {c: mask.schema[c].dataType.simpleString() for c in FRAME}
    pixels, _ = written(tiles.mapInPandas(lambda parts: _together(run(parts)), f"stack_id {kinds['stack_id']}, t {kinds['t']}, z int, x int, y int, node long"), "pixels")
    discard(mask.sparkSession, path)
    return pixels.join(numbers, "node").select(*FRAME, "z", "x", "y", "label")


def fill_holes_voxels(mask: DataFrame, size: Size, tile: Size) -> DataFrame:
    """(stack_id, t, z, x, y): the pixels of ``mask`` and those that it encloses, in frames that have any."""
    tiles, _ = written(_tiles(mask, size, tile, True), "tiles")
    roots, parts = _roots(tiles, size, tile, True)
    parts = parts.join(roots, "node", "left").select("node", "edge", F.coalesce("root", "node").alias("root"))
    open_ = parts.groupBy("root").agg(F.max("edge").alias("out")).filter("NOT out")
    volume = size[0] * size[1] * size[2]
    pixel = F.col("node") % volume
    at = [F.floor(pixel / (size[1] * size[2])), F.floor(pixel / size[2]) % size[1], pixel % size[2]]
    cut = [-(-n // m) for n, m in zip(size, tile, strict=True)]
    tz, tx, ty = (F.floor(a / m) for a, m in zip(at, tile, strict=True))
    holes = parts.join(open_, "root", "left_semi").select(F.floor(F.col("node") / volume).alias("frame"), ((tz * cut[1] + tx) * cut[2] + ty).cast("long").alias("tile"), "node")
    todo = tiles.join(holes.groupBy("frame", "tile").agg(F.collect_list("node").alias("nodes")), ["frame", "tile"])

    def run(groups):
        for pdf in groups:
            for r in pdf.itertuples():
                own, nodes, low = _local(r, size, tile, True)
                z, x, y = np.nonzero(np.append(False, np.isin(nodes, np.asarray(r.nodes)))[own])
                yield pd.DataFrame({"stack_id": r.stack_id, "t": r.t, "z": z + low[0], "x": x + low[1], "y": y + low[2]})

    kinds = {c: mask.schema[c].dataType.simpleString() for c in FRAME}
    filled = todo.mapInPandas(lambda parts: _together(run(parts)), f"stack_id {kinds['stack_id']}, t {kinds['t']}, z int, x int, y int")
    return mask.select(*FRAME, *[F.col(k).cast("int").alias(k) for k in "zxy"]).distinct().unionByName(filled)
