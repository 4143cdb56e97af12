"""Linking of spots and labels over time, and two-state traces."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.functions import kernels as kn
from spotframe.operators import graph
from spotframe.operators.voxels import nucleus_of
from spotframe.sources.scratch import discard, written

SPOT = ["stack_id", "spot_id"]
BLOCK = 8  # frames whose links are joined in one task


def link_nearest(fits: DataFrame, max_gap: int = 1, max_jump: float = 10.0, scale_xy: float = 1.0, scale_z: float = 1.0) -> DataFrame:
    """Adds spot_id: greedy links to the nearest spot of the frames before (``kernels.link_nearest`` has the rules).

    The nearest spots at each lag come from tiles of a grid (``nearest_before``). Spots that such links join, over any number of frames, are a component; what happens in one
    hangs on nothing outside, so components are walked through in order of frames, many at once (``graph.walk``). Spots without a place (null) begin tracks.
    """
    spark = fits.sparkSession
    place = [(F.col(c).cast("double") * s).alias(f"_{c}") for c, s in (("z", scale_z), ("x", scale_xy), ("y", scale_xy))]
    rows, rows_path = written(fits.select("*", *place, F.monotonically_increasing_id().alias("_id")), "fits")
    same = ["stack_id", "t", "_z", "_x", "_y"]
    order = W.partitionBy("stack_id").orderBy("t")
    frames = fits.select("stack_id", "t").distinct().withColumn("_n", F.row_number().over(order))
    back = (F.row_number().over(W.partitionBy("stack_id", F.col("t") - F.col("_n")).orderBy("t")) - 1).alias("_reach")  # frames before without a break
    frames = frames.select("stack_id", "t", back)
    places = rows.filter("_z IS NOT NULL AND _x IS NOT NULL AND _y IS NOT NULL").groupBy(*same).agg(F.min("_id").alias("_pid")).join(frames, ["stack_id", "t"])
    places, places_path = written(places, "places")
    near, near_path = written(nearest_before(places, max_gap + 1, max_jump), "nearest")
    back = F.col("t") - F.col("lag")
    roots = graph.components(near.select("_pid", F.explode("backs").alias("b"), F.struct("stack_id", F.floor(F.col("t") / BLOCK).alias("b")).alias("_u"), F.struct("stack_id", F.floor(back / BLOCK).alias("b")).alias("_v")))
    asks = near.groupBy("_pid").agg(F.array_sort(F.collect_list(F.struct("lag", "far", "backs"))).alias("n"))
    spots = rows.select("stack_id", "t", "fit_no", "_z", "_x", "_y", "_id").join(places.select(*same, "_pid"), same, "left")
    spots = spots.join(asks, "_pid", "left").join(roots.withColumnRenamed("node", "_pid"), "_pid", "left").withColumn("root", F.coalesce("root", "_id"))
    spots = spots.select("stack_id", "root", "t", "fit_no", "_id", "_pid", "_z", "_x", "_y", *[F.col(f"n.{k}").alias(k) for k in ("lag", "far", "backs")])

    def step(state, held):
        t, track, here = held[0][2], [0] * len(held), {}
        for i, (*_, lags, fars, backs) in enumerate(held):
            for lag, far, at in zip(lags, fars, backs, strict=True) if lags is not None else ():
                goal, there = min(state["frames"][t - lag][b] for b in at)  # of equally near ones the oldest track
                other = here.get(goal)
                if other is not None:
                    if far >= sum((a - b) ** 2 for a, b in zip(held[other][6:9], there, strict=True)) ** 0.5:
                        continue
                    track[other], here[state["free"]] = state["free"], other
                    state["free"] += 1
                track[i], here[goal] = goal, i
                break
            else:
                track[i], here[state["free"]] = state["free"], i
                state["free"] += 1
        mine = {}
        for v, k in zip(held, track, strict=True):
            mine[v[5]] = min(mine.get(v[5], (k, v[6:9])), (k, v[6:9]))
        state["frames"] = {f: x for f, x in state["frames"].items() if f >= t - max_gap} | {t: mine}
        return [(v[0], v[1], v[2], v[3], v[4], k) for v, k in zip(held, track, strict=True)]

    kinds = {c: fits.schema[c].dataType.simpleString() for c in ("stack_id", "t", "fit_no")}
    schema = f"stack_id {kinds['stack_id']}, root long, t {kinds['t']}, fit_no {kinds['fit_no']}, _id long, track long"
    walked = graph.walk(spots, ["stack_id", "root"], ["t", "fit_no", "_id"], ["fit_no", "_id", "_pid", "_z", "_x", "_y", "lag", "far", "backs"], lambda: {"free": 0, "frames": {}}, step, schema)
    out, _ = written(walked, "tracks")
    discard(spark, places_path, near_path)
    first = out.groupBy("stack_id", "root", "track").agg(F.min(F.struct("t", "fit_no", "_id")).alias("first"))
    number = first.withColumn("spot_id", (F.row_number().over(W.partitionBy("stack_id").orderBy("first")) - 1).cast("long")).drop("first")
    numbered = out.join(number, ["stack_id", "root", "track"]).select("_id", "spot_id")
    return rows.join(numbered, "_id").select(*fits.columns, "spot_id")


TILE = 8  # largest jumps along the edge of a tile


def nearest_before(places: DataFrame, lags: int, max_jump: float) -> DataFrame:
    """(stack_id, t, _pid, lag, far, backs): the nearest places lag frames before, all that are equally near, within ``max_jump``.

    ``places`` has (stack_id, t, _z, _x, _y, _pid, _reach), each place of a frame once. A tile of a frame meets what lies in it and around it in the frames before, so
    distances never leave a task, and no task holds more than some tiles.
    """
    import pandas as pd

    edge, reach = (max_jump * TILE or 1.0), max_jump * (1 + 1e-9)
    axes = ["_z", "_x", "_y"]
    cell = lambda c, by=0.0: F.floor((F.col(c) + by) / edge)
    asks = places.select("stack_id", "t", *[cell(c).alias(f"c{c}") for c in axes], F.lit(0).alias("lag"), "_pid", "_reach", *axes)
    later = places.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("t", F.col("t") + F.col("lag"))
    for c in axes:
        later = later.withColumn(f"c{c}", F.explode(F.sequence(cell(c, -reach), cell(c, reach))))
    both = asks.unionByName(later.select(asks.columns).withColumn("_reach", F.lit(0)))
    tiles = both.groupBy("stack_id", "t", *[f"c{c}" for c in axes]).agg(F.collect_list(F.struct("lag", "_pid", "_reach", *axes)).alias("s"), F.min("lag").alias("low"), F.max("lag").alias("high")).filter("low = 0 AND high > 0")

    def run(parts):
        for pdf in parts:
            out = []
            for stack, t, lag, pid, far_back, z, x, y in zip(*(pdf[c] for c in ("stack_id", "t", "lag", "_pid", "_reach", *axes)), strict=True):
                order = np.argsort(lag, kind="stable")
                at, pid, far_back = np.stack([z, x, y], axis=1)[order], pid[order], far_back[order]
                cuts = np.searchsorted(lag[order], np.arange(lags + 2))
                for k in range(1, lags + 1):
                    b, ids = at[cuts[k] : cuts[k + 1]], pid[cuts[k] : cuts[k + 1]]
                    ask = np.flatnonzero(far_back[: cuts[1]] >= k)
                    if not len(b) or not len(ask):
                        continue
                    r, c, far = kn.nearest_within(at[ask], b, max_jump)
                    if len(r):
                        rows, starts = np.unique(r, return_index=True)
                        out.append(pd.DataFrame({"stack_id": stack, "t": t, "_pid": pid[ask[rows]], "lag": k, "far": far[starts], "backs": np.split(ids[c], starts[1:])}))
            yield pd.concat(out) if out else pd.DataFrame([], columns=["stack_id", "t", "_pid", "lag", "far", "backs"])

    kinds = ", ".join(f"{c} {places.schema[c].dataType.simpleString()}" for c in ("stack_id", "t"))
    return tiles.select("stack_id", "t", *[F.col(f"s.{k}").alias(k) for k in ("lag", "_pid", "_reach", *axes)]).mapInPandas(run, f"{kinds}, _pid long, lag int, far double, backs array<long>")


def link_by_nucleus(fits: DataFrame, labels: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """One spot per nucleus and frame, numbered by first appearance; background spots go.

    Of two candidates the first stays while the track has at most one row, then the one nearer to the last kept position.
    """
    rows = nucleus_of(fits, labels, size).filter("nuc_id > 0")
    place = ["fit_no", "z", "x", "y"]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("stack_id", "nuc_id")}
    given = rows.select("stack_id", "nuc_id", F.col("t").cast("int").alias("t"), F.col("fit_no").cast("long").alias("fit_no"), *[F.col(c).cast("double").alias(c) for c in "zxy"])

    def d2(a, b):
        return (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3])

    def step(state, held):
        """One frame of a nucleus: only the last kept spot and the number of kept ones are held from the frames before."""
        best, before = held[0][3:], state["last"]
        if state["n"] >= 2:
            for v in held[1:]:
                if d2(v[3:], before) < d2(best, before):
                    best = v[3:]
        state["n"], state["last"] = state["n"] + 1, best
        return [(*held[0][:3], *best)]

    schema = f"stack_id {kinds['stack_id']}, nuc_id {kinds['nuc_id']}, t int, fit_no long, z double, x double, y double"
    kept, _ = written(graph.walk(given, ["stack_id", "nuc_id"], ["t", *place], place, lambda: {"n": 0, "last": None}, step, schema), "kept-spots")
    first = kept.groupBy("stack_id", "nuc_id").agg(F.min(F.struct("t", "fit_no")).alias("first"))
    number = first.withColumn("spot_id", F.row_number().over(W.partitionBy("stack_id").orderBy("first"))).drop("first")
    return kept.join(number, ["stack_id", "nuc_id"])


def track_labels(labels: DataFrame, max_skip: int = 2, update: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Labels carried forward: an object takes the track of its reciprocal best overlap one frame back, else further, up to max_skip + 1.

    Overlaps of all lags come from one join of pixels. Objects that links join, over any number of frames, are a component, and components are walked through in
    order of frames, many at once (``graph.walk``). ``update`` gives another choice of overlaps (stack_id, t, lag, la, lb, n, from la before to lb in frame t), such as one of
    ``voxels.connect_labels``. Of two objects of a frame that want one track the nearer lag wins, then the larger overlap. New objects get new numbers.
    """
    pix = ["stack_id", "z", "x", "y"]
    back = labels.select(*pix, F.col("label").alias("before"), F.explode(F.sequence(F.lit(1), F.lit(max_skip + 1))).alias("lag"), "t").withColumn("t", F.col("t") + F.col("lag"))
    hits = labels.join(back, [*pix, "t"]).groupBy("stack_id", "t", "lag", "label", "before").agg(F.count("*").alias("n"))
    best = lambda k, o: F.row_number().over(W.partitionBy("stack_id", "t", "lag", k).orderBy(F.desc("n"), F.desc(o)))
    links = hits.withColumn("_a", best("label", "before")).withColumn("_b", best("before", "label")).filter("_a = 1 AND _b = 1").select("stack_id", "t", "lag", "label", "before", "n")
    if update:
        links = update(hits.withColumnsRenamed({"before": "la", "label": "lb"})).select("stack_id", "t", "lag", F.col("lb").alias("label"), F.col("la").alias("before"), "n")
    links, links_path = written(links, "label-links")
    object_id = lambda t, label: F.xxhash64("stack_id", t, label)  # noqa: E731  # two objects with one hash do no more harm than to share a task
    roots = graph.components(links.select(object_id("t", "label").alias("a"), object_id((F.col("t") - F.col("lag")).cast(links.schema["t"].dataType), "before").alias("b")))
    offers = links.groupBy("stack_id", "t", "label").agg(F.array_sort(F.collect_list(F.struct("lag", F.col("n").cast("long").alias("n"), "before"))).alias("o"))
    objects = labels.select("stack_id", "t", "label").distinct().join(offers, ["stack_id", "t", "label"], "left").withColumn("node", object_id("t", "label"))
    objects = objects.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    objects = objects.select("stack_id", "root", "t", "label", *[F.col(f"o.{k}").alias(k) for k in ("lag", "n", "before")])

    def step(state, held):
        t, mine, taken = held[0][2], {}, set()
        for lag, _, label, before in sorted((lag, -n, v[3], before) for v in held if v[4] is not None for lag, n, before in zip(*v[4:7], strict=True)):
            old = state["frames"].get(t - lag, {}).get(before)
            if label not in mine and old is not None and old not in taken:
                mine[label] = old
                taken.add(old)
        for v in held:
            if v[3] not in mine:
                mine[v[3]] = state["free"]
                state["free"] += 1
        state["frames"] = {f: x for f, x in state["frames"].items() if f >= t - max_skip} | {t: mine}
        return [(*v[:4], mine[v[3]]) for v in held]

    kinds = {c: labels.schema[c].dataType.simpleString() for c in ("stack_id", "t", "label")}
    schema = f"stack_id {kinds['stack_id']}, root long, t {kinds['t']}, label {kinds['label']}, own long"
    out, _ = written(graph.walk(objects, ["stack_id", "root"], ["t", "label"], ["label", "lag", "n", "before"], lambda: {"free": 0, "frames": {}}, step, schema), "label-tracks")
    discard(labels.sparkSession, links_path)
    first = out.groupBy("stack_id", "root", "own").agg(F.min(F.struct("t", "label")).alias("first"))
    number = first.withColumn("track", F.row_number().over(W.partitionBy("stack_id").orderBy("first")).cast("int")).drop("first")
    return labels.join(out.join(number, ["stack_id", "root", "own"]).select("stack_id", "t", "label", "track"), ["stack_id", "t", "label"])


def two_state_bursts(traces: DataFrame, rounds: int = 25) -> DataFrame:
    """Adds state: 1 for the higher of two means of a hidden Markov model pooled over all traces, by its likeliest path.

    Each round sums small statistics of all traces; values are first scaled to 0-1 by spot, constant spots are left out. Traces are rows,
    kept on the executors for the rounds; those of one length in a batch are worked on together.
    """
    w = W.partitionBy(*SPOT)
    x = traces.filter("value IS NOT NULL").withColumn("v", F.try_divide(F.col("value") - F.min("value").over(w), F.max("value").over(w) - F.min("value").over(w))).filter("v IS NOT NULL")
    rows = x.groupBy(*SPOT).agg(F.sort_array(F.collect_list(F.struct("t", "value", "v"))).alias("s"))
    rows = rows.select(*SPOT, *[F.col(f"s.{k}").alias(k) for k in ("t", "value", "v")]).persist()
    p = {"means": np.array([0.2, 0.7]), "stds": np.array([0.2, 0.2]), "start": np.array([0.5, 0.5]), "moves": np.array([[0.8, 0.2], [0.2, 0.8]])}
    names = [f"{k}{i}" for k in ("g", "gx", "gxx", "s") for i in range(2)] + [f"m{i}{j}" for i in range(2) for j in range(2)]

    def by_length(pdf):
        for _, d in pdf.groupby(pdf["v"].map(len)):
            yield d, np.stack(d["v"].to_list())

    def statistics(p):
        def run(parts):
            total = np.zeros(len(names))
            for pdf in parts:
                for _, v in by_length(pdf):
                    g, xi, _ = kn.forward_backward(v, **p)
                    at = v[..., None]
                    total += np.concatenate([g.sum(axis=(0, 1)), (g * at).sum(axis=(0, 1)), (g * at**2).sum(axis=(0, 1)), g[:, 0].sum(axis=0), xi.ravel()])
            yield pd.DataFrame([total], columns=names)

        return run

    for _ in range(rounds):
        r = rows.select("v").mapInPandas(statistics(p), ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
        if not r["g0"] or not r["g1"]:
            break
        g, gx, gxx, s = (np.array([r[f"{k}0"], r[f"{k}1"]]) for k in ("g", "gx", "gxx", "s"))
        m = np.array([[r[f"m{i}{j}"] for j in range(2)] for i in range(2)])
        p = {"means": gx / g, "stds": np.sqrt(np.maximum(gxx / g - (gx / g) ** 2, 1e-4)), "start": s / s.sum(), "moves": m / m.sum(axis=1, keepdims=True)}
    rows.unpersist()
    high = int(p["means"][1] >= p["means"][0])

    def paths(parts):
        for pdf in parts:
            for d, v in by_length(pdf):
                n = v.shape[1]
                out = {k: np.repeat(d[k].to_numpy(), n) for k in SPOT} | {k: np.concatenate(d[k].to_list()) for k in ("t", "value")}
                yield pd.DataFrame(out | {"state": (kn.viterbi(v, **p) == high).ravel().astype("int32")})

    return rows.mapInPandas(paths, "stack_id long, spot_id long, t int, value double, state int")


def random_controls(spots: DataFrame, labels: DataFrame, n: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """(stack_id, spot_id, t, k, z, x, y): n hashed pixels of the spot's nucleus (nuc_id) in its slice and frame, none of ``exclude`` (stack_id, t, x, y)."""
    if exclude is not None:
        labels = labels.join(exclude.select("stack_id", "t", "x", "y").distinct(), ["stack_id", "t", "x", "y"], "left_anti")
    place = W.partitionBy("stack_id", "t", "z", "label").orderBy("x", "y")
    pix = labels.withColumn("place", F.row_number().over(place) - 1)
    size = labels.groupBy("stack_id", "t", "z", "label").agg(F.count("*").alias("size"))
    asks = spots.select("stack_id", "spot_id", "t", F.col("z").cast("int").alias("z"), F.col("nuc_id").alias("label")).join(size, ["stack_id", "t", "z", "label"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    mark = F.conv(F.substring(F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in ("stack_id", "spot_id", "t", "k")], F.lit(str(seed)))), 1, 12), 16, 10).cast("long")
    return asks.withColumn("place", mark % F.col("size")).join(pix, ["stack_id", "t", "z", "label", "place"]).select("stack_id", "spot_id", "t", "k", "z", "x", "y")
