"""Work on whole frames (keys, nz, nx, ny, pixels), one row a frame: no shuffle, a numpy helper in each task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.functions import kernels as kn

KEYS = ["stack_id", "c", "t"]
FIT = "stack_id long, t int, fit_no long, z double, x double, y double, height double, width_z double, width_x double, width_y double"


def array_of(r) -> np.ndarray:
    return np.asarray(r.pixels, dtype=np.float64).reshape(r.nz, r.nx, r.ny)


def map_frames(frames: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Frames with ``work(array)`` in place of their pixels."""

    def run(parts):
        for pdf in parts:
            pdf = pdf.copy()
            pdf["pixels"] = [work(array_of(r)).astype(np.float32).ravel() for r in pdf.itertuples()]
            yield pdf

    return frames.mapInPandas(run, frames.schema)


def filter_frames(frames: DataFrame, kind: str, sigma=1.0, wide=None, size=None) -> DataFrame:
    """kind: gaussian, dog (sigma and wide), log, gradient, min or max (size)."""
    work = {
        "gaussian": lambda a: kn.gaussian_filter(a, sigma),
        "dog": lambda a: kn.difference_of_gaussians(a, sigma, wide),
        "log": lambda a: kn.laplacian_of_gaussian(a, sigma),
        "gradient": kn.gradient_magnitude,
        "min": lambda a: kn.extreme_filter(a, size, False),
        "max": lambda a: kn.extreme_filter(a, size, True),
    }[kind]
    return map_frames(frames, work)


def segment_frames(frames: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Label rows (stack_id, t, z, x, y, label) of what ``work(array)`` numbers; background is left out."""

    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples():
                out = np.asarray(work(array_of(r)))
                at = np.argwhere(out > 0)
                yield pd.DataFrame({"stack_id": r.stack_id, "t": r.t, "z": at[:, 0], "x": at[:, 1], "y": at[:, 2], "label": out[out > 0]})

    return frames.mapInPandas(run, "stack_id long, t int, z int, x int, y int, label int")


def label_frames(frames: DataFrame, sigma: float = 1.0, threshold: float | None = None, low: int = 0, high: int = 1 << 30, holes: bool = False) -> DataFrame:
    """Smooth, threshold (Otsu's, if none is given), fill holes, number connected parts, keep sizes low to high."""

    def work(a):
        s = kn.gaussian_filter(a, sigma) if sigma else a
        mask = s > (kn.otsu(s) if threshold is None else threshold)
        parts = kn.connected_components(kn.fill_holes(mask) if holes else mask)
        n = np.bincount(parts.ravel())
        n[0] = 0
        return parts * ((n >= low) & (n <= high))[parts]

    return segment_frames(frames, work)


def with_mask(frames: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Frames with a column inside: the places of the pixels of any label, all of them (null) without labels."""
    if labels is None:
        return frames.withColumn("inside", F.lit(None).cast("array<int>"))
    at = labels.join(frames.select("stack_id", "t", "nx", "ny").distinct(), ["stack_id", "t"]).select("stack_id", "t", ((F.col("z") * F.col("nx") + F.col("x")) * F.col("ny") + F.col("y")).cast("int").alias("i"))
    inside = at.groupBy("stack_id", "t").agg(F.collect_set("i").alias("inside"))
    return frames.join(inside, ["stack_id", "t"], "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<int>")))


def mask_of(r) -> np.ndarray:
    mask = np.ones(r.nz * r.nx * r.ny, dtype=bool) if r.inside is None else np.zeros(r.nz * r.nx * r.ny, dtype=bool)
    if r.inside is not None:
        mask[np.asarray(r.inside, dtype=np.int64)] = True
    return mask.reshape(r.nz, r.nx, r.ny)


def threshold_sweep(frames: DataFrame, thresholds: list[float], labels: DataFrame | None = None) -> DataFrame:
    """(stack_id, t, threshold, objects, mean_size): parts above each threshold (and in a label), and their mean size within its 10-60 percentiles."""

    def run(parts):
        for pdf in parts:
            rows = []
            for r in pdf.itertuples():
                a, mask = array_of(r), mask_of(r)
                for h in thresholds:
                    n = np.bincount(kn.connected_components((a > h) & mask).ravel())[1:]
                    lo, hi = (np.percentile(n, [10, 60]) if len(n) else (0, 0))
                    inner = n[(n >= lo) & (n <= hi)]
                    rows.append((r.stack_id, r.t, h, len(n), float(inner.mean()) if len(inner) else None))
            yield pd.DataFrame(rows, columns=["stack_id", "t", "threshold", "objects", "mean_size"])

    return with_mask(frames, labels).mapInPandas(run, "stack_id long, t int, threshold double, objects int, mean_size double")


def objects_per_slice(frames: DataFrame, threshold: float, ref_slice: int, slope: float) -> DataFrame:
    """(stack_id, t, z, objects): parts of each slice above the sloped threshold, after an opening by 2 x 2 pixels."""

    def run(parts):
        for pdf in parts:
            rows = []
            for r in pdf.itertuples():
                a = array_of(r)
                for z, image in enumerate(a):
                    m = np.pad(image >= threshold + (z - ref_slice) * slope, 1)
                    whole = m[:-1, :-1] & m[1:, :-1] & m[:-1, 1:] & m[1:, 1:]
                    m = np.pad(whole, ((1, 0), (1, 0))) | np.pad(whole, ((0, 1), (1, 0))) | np.pad(whole, ((1, 0), (0, 1))) | np.pad(whole, ((0, 1), (0, 1)))
                    rows.append((r.stack_id, r.t, z, int(kn.connected_components(m[None]).max())))
            yield pd.DataFrame(rows, columns=["stack_id", "t", "z", "objects"])

    return frames.mapInPandas(run, "stack_id long, t int, z int, objects int")


def scalespace_histograms(frames: DataFrame, sigmas: list[float], bins: int, low: float, high: float, labels: DataFrame | None = None) -> DataFrame:
    """(stack_id, t, sigma_no, hist): counts of the frame (in a label) filtered at each scale; only counts leave the task."""

    def run(parts):
        for pdf in parts:
            rows = [(r.stack_id, r.t, k, np.histogram(kn.gaussian_filter(array_of(r), s)[mask_of(r)], bins, (low, high))[0].astype(float)) for r in pdf.itertuples() for k, s in enumerate(sigmas)]
            yield pd.DataFrame(rows, columns=["stack_id", "t", "sigma_no", "hist"])

    return with_mask(frames, labels).mapInPandas(run, "stack_id long, t int, sigma_no int, hist array<double>")


def local_maxima(frames: DataFrame, window: tuple[int, int, int], least_distance: float = 0.0) -> DataFrame:
    """(stack_id, t, peak, z, x, y): places of the largest value of their window, one for those that touch, none nearer than a distance to one before."""

    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples():
                at = np.asarray(kn.local_maxima(array_of(r), window, least_distance)).reshape(-1, 3)
                yield pd.DataFrame({"stack_id": r.stack_id, "t": r.t, "peak": np.arange(len(at)), "z": at[:, 0], "x": at[:, 1], "y": at[:, 2]})

    return frames.mapInPandas(run, "stack_id long, t int, peak int, z int, x int, y int")


def fill_holes(frames: DataFrame, threshold: float) -> DataFrame:
    """(stack_id, t, z, x, y, label): pixels above a threshold and those that they shut in, all labelled 1."""
    return segment_frames(frames, lambda a: kn.fill_holes(a > threshold).astype(np.int64))


def _fit_peaks(found: list[tuple[np.ndarray, np.ndarray]], rad_xy: int, rad_z: int) -> np.ndarray:
    """Rows z, x, y, height, widths for the peaks of several frames; all windows of one shape are fitted together.

    A failed fit keeps the peak's place.
    """
    owners = [(a, p) for a, peaks in found for p in peaks]
    out, groups = np.zeros((len(owners), 7)), {}
    for i, (a, p) in enumerate(owners):
        lo = np.maximum(p - (rad_z, rad_xy, rad_xy), 0)
        hi = np.minimum(p + (rad_z, rad_xy, rad_xy) + 1, a.shape)
        groups.setdefault(tuple(hi - lo), []).append((i, lo, a[tuple(slice(x, y) for x, y in zip(lo, hi, strict=True))]))
    for items in groups.values():
        fit, good = kn.fit_gaussians(np.stack([w for *_, w in items]))
        for (i, lo, _), f, ok in zip(items, fit, good, strict=True):
            a, p = owners[i]
            place = np.clip(np.rint(f[1:4] + lo), 0, np.array(a.shape) - 1) if ok else p
            out[i] = [*place, f[0], *f[4:7]]
    return out


MEASURES = ("z", "x", "y", "height", "width_z", "width_x", "width_y")


def detect_spots(frames: DataFrame, narrow=(0.7, 1.0, 1.0), wide=(2.0, 4.0, 4.0), window=(3, 9, 9), least_distance: float = 2.0, rad_xy: int = 5, rad_z: int = 2, background: int | None = None, labels: DataFrame | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """Fits of the peaks of a difference of Gaussians (less its minimum filter of size ``background``), made on the frame itself.

    Peaks are local maxima, with ``thresholds`` (stack_id, threshold) only those that reach the stack's; or, with ``labels``, the largest
    value of each label (the largest of the background, 0, isn't taken).
    """
    rows = frames if thresholds is None else frames.join(thresholds, "stack_id")
    in_labels, screened = labels is not None, thresholds is not None
    if in_labels:
        own = labels.groupBy("stack_id", "t").agg(F.collect_list(F.struct("z", "x", "y", "label")).alias("labels"))
        rows = rows.join(own, ["stack_id", "t"])

    def peaks_of(r, dog):
        if in_labels:
            best = {}
            for z, x, y, label in sorted((p["z"], p["x"], p["y"], p["label"]) for p in r.labels):
                if label > 0 and (label not in best or dog[z, x, y] > dog[best[label]]):
                    best[label] = (z, x, y)
            return np.array([best[k] for k in sorted(best)]).reshape(-1, 3)
        peaks = kn.local_maxima(dog, window, least_distance)
        return peaks if not screened else np.array([p for p in peaks if dog[tuple(p)] >= r.threshold]).reshape(-1, 3).astype(int)

    def run(parts):
        for pdf in parts:
            found = []
            for r in pdf.itertuples():
                a = array_of(r)
                found.append((a, peaks_of(r, background_free(a, narrow, wide, background))))
            sizes = [len(p) for _, p in found]
            f = _fit_peaks(found, rad_xy, rad_z)
            number = np.concatenate([np.arange(n) for n in sizes]) if sizes else []
            yield pd.DataFrame({"stack_id": np.repeat(pdf["stack_id"].to_numpy(), sizes), "t": np.repeat(pdf["t"].to_numpy(), sizes), "fit_no": number, **{n: f[:, k] for k, n in enumerate(MEASURES)}})

    return rows.mapInPandas(run, FIT)


def background_free(a: np.ndarray, narrow, wide, background: int | None) -> np.ndarray:
    dog = kn.difference_of_gaussians(a, narrow, wide)
    return dog if background is None else dog - kn.extreme_filter(dog, (background,) * 3, False)


def detection_thresholds(frames: DataFrame, narrow=(0.7, 1.0, 1.0), wide=(2.0, 4.0, 4.0), background: int | None = None) -> DataFrame:
    """(stack_id, threshold): Otsu's of the middle of each frame, filtered as for ``detect_spots``; the largest over the middle of the movie."""
    n = frames.groupBy("stack_id").agg((F.max("t") + 1).alias("n"))
    some = frames.join(n, "stack_id").filter((F.col("t") >= (F.col("n") * 0.3).cast("int")) & (F.col("t") < (F.col("n") * 0.7).cast("int"))).drop("n")

    def run(parts):
        for pdf in parts:
            rows = []
            for r in pdf.itertuples():
                a = array_of(r)
                a = a[:, int(a.shape[1] * 0.3) : max(int(a.shape[1] * 0.7), 1), int(a.shape[2] * 0.3) : max(int(a.shape[2] * 0.7), 1)]
                rows.append((r.stack_id, float(kn.otsu(background_free(a, narrow, wide, background)))))
            yield pd.DataFrame(rows, columns=["stack_id", "threshold"])

    return some.mapInPandas(run, "stack_id long, threshold double").groupBy("stack_id").agg(F.max("threshold").alias("threshold"))


def fit_peaks(peaks: DataFrame, frames: DataFrame, rad_xy: int = 10, rad_z: int = 2) -> DataFrame:
    """Fits at given peaks (stack_id, t, fit_no, z, x, y): those of a frame meet it in one row, and windows of many frames are fitted together."""
    own = peaks.groupBy("stack_id", "t").agg(F.sort_array(F.collect_list(F.struct(F.col("fit_no").cast("long").alias("fit_no"), *[F.col(k).cast("int").alias(k) for k in "zxy"]))).alias("peaks"))
    rows = frames.join(own, ["stack_id", "t"])

    def run(parts):
        for pdf in parts:
            found = [(array_of(r), np.array([[q["z"], q["x"], q["y"]] for q in r.peaks], dtype=int).reshape(-1, 3)) for r in pdf.itertuples()]
            sizes = [len(q) for _, q in found]
            f = _fit_peaks(found, rad_xy, rad_z)
            number = [q["fit_no"] for r in pdf.itertuples() for q in r.peaks]
            yield pd.DataFrame({"stack_id": np.repeat(pdf["stack_id"].to_numpy(), sizes), "t": np.repeat(pdf["t"].to_numpy(), sizes), "fit_no": number, **{n: f[:, k] for k, n in enumerate(MEASURES)}})

    return rows.mapInPandas(run, FIT)


def to_frames(voxels: DataFrame) -> DataFrame:
    """Frames from dense voxels (a frame has a bounded number of them)."""
    per = voxels.groupBy(*KEYS).agg(F.max("z").alias("nz"), F.max("x").alias("nx"), F.max("y").alias("ny"), F.sort_array(F.collect_list(F.struct("z", "x", "y", "value"))).alias("v"))
    return per.select(*[F.col(k).cast("long" if k == "stack_id" else "int").alias(k) for k in KEYS], *[(F.col(k) + 1).alias(k) for k in ("nz", "nx", "ny")], F.transform("v", lambda s: s["value"].cast("float")).alias("pixels"))


def circularity(labels: DataFrame, least: float | None = None, z: int | None = None) -> DataFrame:
    """(stack_id, t, label, circularity): 4 pi area / perimeter^2 on each object's largest slice, or slice ``z``; the perimeter counts border pixels.

    With ``least`` only objects of that circularity or more stay.

    Border pixels weigh 1, sqrt 2 or (1 + sqrt 2) / 2 by how many of their neighbours on the border are straight and diagonal
    ones: two straight, two diagonal, or one of each; a perimeter of 0 counts as 0.5.
    """
    slice_ = (labels if z is None else labels.filter(F.col("z") == z)).groupBy("stack_id", "t", "label", "z").agg(F.count("*").alias("area"))
    first = F.row_number().over(W.partitionBy("stack_id", "t", "label").orderBy(F.desc("area"), "z"))
    slice_ = slice_.withColumn("_r", first).filter("_r = 1").drop("_r")
    key = ["stack_id", "t", "label"]
    pix = labels.join(slice_, [*key, "z"]).select(*key, "area", "x", "y")

    def near(rows, points, name):
        moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in points])).alias("o")
        moved = rows.select(*key, "x", "y", moves).select(*key, (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"))
        return moved.groupBy(*key, "x", "y").agg(F.count("*").alias(name))

    straight, diagonal = [(0, 1), (0, -1), (1, 0), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    border = pix.join(near(pix, straight, "n"), [*key, "x", "y"], "left").filter(F.coalesce("n", F.lit(0)) < 4).drop("n")
    b = border.join(near(border, straight, "s"), [*key, "x", "y"], "left").join(near(border, diagonal, "d"), [*key, "x", "y"], "left").fillna(0, ["s", "d"])
    weight = F.when(F.col("s") >= 2, 1.0).when((F.col("s") == 1) & (F.col("d") >= 1), (1 + 2**0.5) / 2).when(F.col("d") >= 2, 2**0.5).otherwise(0.0)
    per = b.groupBy(*key).agg(F.sum(weight).alias("p"), F.first("area").alias("area"))
    p = F.when(F.col("p") == 0, 0.5).otherwise(F.col("p"))
    out = per.select(*key, (4 * 3.141592653589793 * F.col("area") / (p * p)).alias("circularity"))
    return out if least is None else out.filter(F.col("circularity") >= least)


def fit_labelled_objects(frames: DataFrame, labels: DataFrame, n: int | None = None, seed: int = 0, rad_xy: int = 10, rad_z: int = 2) -> DataFrame:
    """Fits at the centroids of labelled objects, of ``n`` hashed ones if given; fit_no is the label."""
    from spotframe.functions.scalar import hash_order
    from spotframe.operators.voxels import centroids

    peaks = centroids(labels).withColumn("fit_no", F.col("label").cast("long"))
    if n is not None:
        peaks = peaks.orderBy(hash_order(F.col("stack_id"), F.col("t"), F.col("label"), seed=seed)).limit(n)
    return fit_peaks(peaks.select("stack_id", "t", "fit_no", "z", "x", "y"), frames, rad_xy, rad_z)


def bead_boxes(frames: DataFrame, voxels: DataFrame, threshold: float, lengths: tuple[int, int, int], sigma: float = 1.0) -> DataFrame:
    """(stack_id, t, label, dz, dx, dy, value) from 0 to 1 around the centre of mass of each part above the threshold; boxes that leave the image go."""
    from spotframe.operators.voxels import POINT, normalize_minmax, spot_boxes

    parts = segment_frames(frames, lambda a: kn.connected_components(kn.gaussian_filter(a, sigma) > threshold))
    mass = parts.join(voxels.filter("c = 0").select(*POINT, "value"), POINT).groupBy("stack_id", "t", "label")
    center = mass.agg(*[F.rint(F.try_divide(F.sum(F.col(k) * F.col("value")), F.sum("value"))).alias(k) for k in "zxy"])
    boxes = spot_boxes(center, voxels, 0, lengths, float("-inf"), "label")
    whole = boxes.groupBy("stack_id", "t", "label").agg(F.min("value").alias("low")).filter(F.col("low") > float("-inf"))
    return normalize_minmax(boxes.join(whole.drop("low"), ["stack_id", "t", "label"]), ["stack_id", "t", "label"])


def mask_foci(voxels: DataFrame, labels: DataFrame, size: tuple[int, int], sigma: float = 1.0, grow: int = 3) -> DataFrame:
    """(stack_id, t, x, y) of bright bodies: smoothed z maximum above Otsu's threshold of the pixels in a nucleus, dilated by a square."""
    from spotframe.operators.voxels import dilate, otsu_threshold, project

    flat = project(voxels.filter("c = 0"), "z").withColumn("z", F.lit(0))
    smooth = to_voxel_rows(filter_frames(to_frames(flat.select("stack_id", "c", "t", "z", "x", "y", "value")), "gaussian", (0, sigma, sigma)))
    inside = smooth.join(labels.select("stack_id", "t", "x", "y").distinct(), ["stack_id", "t", "x", "y"], "left_semi")
    bright = inside.join(otsu_threshold(inside, ["stack_id", "t"]), ["stack_id", "t"]).filter("value > threshold")
    return dilate(bright.select("stack_id", "t", "z", "x", "y", F.lit(1).alias("label")), (1, grow, grow), (1, *size)).select("stack_id", "t", "x", "y")


def to_voxel_rows(frames: DataFrame) -> DataFrame:
    from spotframe.sources.frames import to_voxels

    return to_voxels(frames, ["stack_id", "t"])
