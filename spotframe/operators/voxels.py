"""Voxels (stack_id, c, t, z, x, y, value) and label masks (stack_id, t, z, x, y, label; background has no row).

Neighbourhoods are small tables of offsets: the few rows that ask (spots, label pixels) are exploded by them and meet the
voxels in an equi-join; voxels are never exploded and never joined by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.functions.scalar import hash_order

POINT = ["stack_id", "t", "z", "x", "y"]


def offsets(points: list[tuple[int, int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dx"), F.lit(c).alias("dy")) for a, b, c in points])).alias("o")


def box(nz: int, nx: int, ny: int) -> list[tuple[int, int, int]]:
    if not (nz % 2 and nx % 2 and ny % 2):
        raise ValueError("box lengths must be odd")
    return [(a, b, c) for a in range(-(nz // 2), nz // 2 + 1) for b in range(-(nx // 2), nx // 2 + 1) for c in range(-(ny // 2), ny // 2 + 1)]


def ellipsoid(r_xy: float, r_z: float) -> list[tuple[int, int, int]]:
    """Offsets with sqrt(a dz^2 + dx^2 + dy^2) <= r_xy, a = r_xy^2 / r_z^2."""
    a, n, m = (r_xy / r_z) ** 2, int(r_z), int(r_xy)
    return [(i, j, k) for i in range(-n, n + 1) for j in range(-m, m + 1) for k in range(-m, m + 1) if (a * i * i + j * j + k * k) ** 0.5 <= r_xy]


def around(spots: DataFrame, points: list[tuple[int, int, int]]) -> DataFrame:
    """Spots with the offsets and the coordinates they lead to, from truncated centres."""
    cols = [c for c in spots.columns if c not in ("z", "x", "y")]
    rows = spots.select(*cols, *[F.col(k).cast("int").alias(f"_{k}") for k in "zxy"]).select("*", offsets(points))
    return rows.select(*cols, "o.dz", "o.dx", "o.dy", *[(F.col(f"_{k}") + F.col(f"o.d{k}")).alias(k) for k in "zxy"])


def add_volume_mean(spots: DataFrame, voxels: DataFrame, channel: int, r_xy: float, r_z: float, key: str = "spot_id", scale_xy: float = 1.0, scale_z: float = 1.0) -> DataFrame:
    """(stack_id, t, key, mean) of the voxels in an ellipsoid around each spot, cut at the image's edge."""
    wanted = around(spots.select("stack_id", "t", key, "z", "x", "y"), ellipsoid(r_xy / scale_xy, r_z / scale_z))
    return wanted.join(voxels.filter(F.col("c") == channel).select(*POINT, "value"), POINT).groupBy("stack_id", "t", key).agg(F.avg("value").alias("mean"))


def spot_boxes(spots: DataFrame, voxels: DataFrame, channel: int, lengths: tuple[int, int, int], fill: float = 0.0, key: str = "spot_id") -> DataFrame:
    """(stack_id, t, key, dz, dx, dy, value) around each spot; outside of the image the fill value."""
    wanted = around(spots.select("stack_id", "t", key, "z", "x", "y"), box(*lengths))
    rows = wanted.join(voxels.filter(F.col("c") == channel).select(*POINT, "value"), POINT, "left")
    return rows.select("stack_id", "t", key, "dz", "dx", "dy", F.coalesce("value", F.lit(fill)).alias("value"))


def boxes_inside(spots: DataFrame, lengths: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Spots whose box lies wholly within an image of ``size``."""
    box(*lengths)
    inside = F.lit(True)
    for k, n, m in zip("zxy", lengths, size, strict=True):
        centre = F.col(k).cast("int")
        inside &= (centre >= n // 2) & (centre + n // 2 < m)
    return spots.filter(inside)


def spot_mean_over_time(spots: DataFrame, voxels: DataFrame, channel: int, inner: tuple[int, int, int], outer: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """(t, fg, net, n): means over all stacks' spots of a frame of what ``fg_bg_intensity`` says of their boxes; boxes that leave the image go."""
    boxes = spot_boxes(boxes_inside(spots, outer, size), voxels, channel, outer)
    per = fg_bg_intensity(boxes, inner, outer, ["stack_id", "t", "spot_id"])
    return per.groupBy("t").agg(F.avg("fg").alias("fg"), F.avg("net").alias("net"), F.count("*").alias("n"))


def fg_bg_intensity(boxes: DataFrame, inner: tuple[int, int, int], outer: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """fg: mean of the inner box; net: fg less the mean of what the outer box has besides; top: mean of the three largest inner values."""
    in_box = lambda n: (F.abs("dz") <= n[0] // 2) & (F.abs("dx") <= n[1] // 2) & (F.abs("dy") <= n[2] // 2)
    rows = boxes.withColumn("_in", in_box(inner)).filter(in_box(outer))
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_in").orderBy(F.desc("value"), "dz", "dx", "dy")))
    mean = lambda cond: F.avg(F.when(cond, F.col("value")))
    return rows.groupBy(*keys).agg(mean(F.col("_in")).alias("fg"), (mean(F.col("_in")) - mean(~F.col("_in"))).alias("net"), mean(F.col("_in") & (F.col("_r") <= 3)).alias("top"))


def window_moments(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Of each box the intensity-weighted centre (as offsets), the width of the profile line along each axis through it, and the largest value.

    Lines go through the truncated centre, counted from the box's corner. A width is the root of the weighted squared distance from
    the centre, null on a line that adds up to 0.
    """
    w = W.partitionBy(*keys)
    rows = boxes.select(*keys, "dz", "dx", "dy", "value", *[F.try_divide(F.sum(F.col(f"d{k}") * F.col("value")).over(w), F.sum("value").over(w)).alias(f"mean_{k}") for k in "zxy"], *[F.min(f"d{k}").over(w).alias(f"_low_{k}") for k in "zxy"])
    on = {k: F.col(f"d{k}") - F.col(f"_low_{k}") == (F.col(f"mean_{k}") - F.col(f"_low_{k}")).cast("int") for k in "zxy"}

    def width(k):
        line = on[next(i for i in "zxy" if i != k)] & on[next(i for i in "yxz" if i != k)]
        gap = F.col(f"d{k}") - F.col(f"mean_{k}")
        return F.sqrt(F.try_divide(F.sum(F.when(line, F.abs(gap * gap * F.col("value")))), F.sum(F.when(line, F.col("value"))))).alias(f"width_{k}")

    return rows.groupBy(*keys).agg(*[F.first(f"mean_{k}").alias(f"mean_{k}") for k in "zxy"], *[width(k) for k in "zxy"], F.max("value").alias("height"))


def nucleus_of(points: DataFrame, labels: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Adds nuc_id: the label at the truncated coordinates, clamped into the image; 0 in the background."""
    at = points.withColumns({f"_{k}": F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(k).cast("int"))) for k, n in zip("zxy", size, strict=True)})
    own = labels.select("stack_id", "t", *[F.col(k).alias(f"_{k}") for k in "zxy"], F.col("label").alias("nuc_id"))
    return at.join(own, ["stack_id", "t", "_z", "_x", "_y"], "left").withColumn("nuc_id", F.coalesce("nuc_id", F.lit(0))).drop("_z", "_x", "_y")


def spots_per_nucleus(points: DataFrame, labels: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """(stack_id, t, label, n) for every label, 0 where there is no spot."""
    n = nucleus_of(points, labels, size).filter("nuc_id > 0").groupBy("stack_id", "t", F.col("nuc_id").alias("label")).agg(F.count("*").alias("n"))
    return labels.select("stack_id", "t", "label").distinct().join(n, ["stack_id", "t", "label"], "left").fillna(0, ["n"])


def label_sizes(labels: DataFrame, keys: tuple[str, ...] = ("stack_id", "t")) -> DataFrame:
    return labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))


def filter_label_size(labels: DataFrame, low: int, high: int, keys: tuple[str, ...] = ("stack_id", "t")) -> DataFrame:
    kept = label_sizes(labels, keys).filter((F.col("n") >= low) & (F.col("n") <= high))
    return labels.join(kept.select(*keys, "label"), [*keys, "label"], "left_semi")


def centroids(labels: DataFrame) -> DataFrame:
    """Truncated mean coordinates of each label and frame."""
    return labels.groupBy("stack_id", "t", "label").agg(*[F.avg(k).cast("int").alias(k) for k in "zxy"])


def drop_edge_labels(labels: DataFrame, size: tuple[int, int], most: int = 0) -> DataFrame:
    """Labels with more than ``most`` pixels on the first or last row or column of their frame go."""
    edge = (F.col("x") == 0) | (F.col("x") == size[0] - 1) | (F.col("y") == 0) | (F.col("y") == size[1] - 1)
    bad = labels.groupBy("stack_id", "t", "label").agg(F.sum(edge.cast("int")).alias("_n")).filter(F.col("_n") > most)
    return labels.join(bad, ["stack_id", "t", "label"], "left_anti")


def relabel(labels: DataFrame, keep_order: bool = True) -> DataFrame:
    """Within a stack the largest object becomes 0, the rest 1.. by old label, or by size, largest first."""
    sizes = label_sizes(labels, ("stack_id",))
    rank = F.row_number().over(W.partitionBy("stack_id").orderBy(F.desc("n"), "label"))
    sizes = sizes.withColumn("_rank", rank)
    order = W.partitionBy("stack_id", F.col("_rank") == 1).orderBy("label" if keep_order else "_rank")
    new = sizes.withColumn("new", F.when(F.col("_rank") == 1, 0).otherwise(F.row_number().over(order))).select("stack_id", "label", "new")
    return labels.join(new, ["stack_id", "label"]).withColumn("label", F.col("new")).drop("new").select(labels.columns)


def filter_labels(labels: DataFrame, metrics: DataFrame, low: float, high: float, column: str = "value") -> DataFrame:
    """Labels whose metric lies between limits (both included); ``metrics`` has stack_id, t, label and ``column``, from any operator, and labels without one go."""
    kept = metrics.filter(F.col(column).between(low, high)).select("stack_id", "t", "label").distinct()
    return labels.join(kept, ["stack_id", "t", "label"], "left_semi")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, la, lb, n, size_a, size_b): pixels that objects of a and b have in common, and their sizes."""
    hits = a.withColumnRenamed("label", "la").join(b.withColumnRenamed("label", "lb"), [*keys, "z", "x", "y"]).groupBy(*keys, "la", "lb").agg(F.count("*").alias("n"))
    size = lambda d, k: d.groupBy(*keys, F.col("label").alias(f"l{k}")).agg(F.count("*").alias(f"size_{k}"))
    return hits.join(size(a, "a"), [*keys, "la"]).join(size(b, "b"), [*keys, "lb"]).select(*keys, "la", "lb", "n", "size_a", "size_b")


def connect_labels(hits: DataFrame, keys: list[str], how: str = "best", share: float = 0.5) -> DataFrame:
    """Rows of an overlap table that connect objects of two masks; of equal overlaps the larger label wins.

    best: both are each other's largest overlap. merge: each object of a goes to its largest overlap in b (so several of a may become one).
    split: each object of b comes from its largest overlap in a (so one of a may become several). contained: as split, where at least
    ``share`` of b's object lies in that of a (the table needs size_b).
    """
    first = lambda k, o: F.row_number().over(W.partitionBy(*keys, k).orderBy(F.desc("n"), F.desc(o))) == 1
    ranked = hits.withColumn("_a", first("la", "lb")).withColumn("_b", first("lb", "la"))
    rules = {"best": "_a AND _b", "merge": "_a", "split": "_b", "contained": f"_b AND n >= {share} * size_b"}
    return ranked.filter(rules[how]).drop("_a", "_b")


def match_labels(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, la, lb) of objects that overlap each other best; background takes part, and is then dropped. Ties go to the larger label.

    Overlaps with the background are sizes less the overlaps with objects, so background needs no rows.
    """
    hits = a.withColumnRenamed("label", "la").join(b.withColumnRenamed("label", "lb"), [*keys, "z", "x", "y"]).groupBy(*keys, "la", "lb").agg(F.count("*").alias("n"))
    size = lambda d, k: d.groupBy(*keys, F.col("label").alias(k)).agg(F.count("*").alias("s"))
    met = lambda k: hits.groupBy(*keys, k).agg(F.sum("n").alias("m"))
    free = lambda d, k: size(d, k).join(met(k), [*keys, k], "left").select(*keys, k, (F.col("s") - F.coalesce("m", F.lit(0))).alias("n")).filter("n > 0")
    every = hits.unionByName(free(a, "la").withColumn("lb", F.lit(0))).unionByName(free(b, "lb").withColumn("la", F.lit(0)))
    best = lambda k, o: F.row_number().over(W.partitionBy(*keys, k).orderBy(F.desc("n"), F.desc(o)))
    return every.withColumn("_a", best("la", "lb")).withColumn("_b", best("lb", "la")).filter("_a = 1 AND _b = 1 AND la > 0 AND lb > 0").select(*keys, "la", "lb", "n")


def fill_missing_labels(labels: DataFrame, frames: DataFrame, size: tuple[int, int, int], most: int = 2) -> DataFrame:
    """Labels that miss up to ``most`` frames between two of theirs get the earlier frame's pixels there, moved by half of the way between both centroids.

    Moved pixels are cut at the image's edge and only fill background; of two labels the larger wins. Frames
    (stack_id, t) tell which exist; gaps at either end of the movie repeat the label's first or last frame.
    """
    c = centroids(labels).select("stack_id", "label", "t", *[F.col(k).alias(f"c{k}") for k in "zxy"])
    order = W.partitionBy("stack_id", "label").orderBy("t")
    bounds = frames.groupBy("stack_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    c = c.join(bounds, "stack_id").withColumns({"next": F.lead("t").over(order), "before": F.lag("t").over(order), **{f"n{k}": F.lead(f"c{k}").over(order) for k in "zxy"}})
    shift = lambda k: (((F.col(f"c{k}") + F.col(f"n{k}")) / 2).cast("int") - F.col(f"c{k}")).alias(f"s{k}")
    none = [F.lit(0).alias(f"s{k}") for k in "zxy"]
    gap = c.filter((F.col("next") - F.col("t") > 1) & (F.col("next") - F.col("t") - 1 <= most)).select("stack_id", "label", "t", F.explode(F.sequence(F.col("t") + 1, F.col("next") - 1)).alias("to"), *map(shift, "zxy"))
    tail = c.filter(F.col("next").isNull() & (F.col("hi") > F.col("t")) & (F.col("hi") - F.col("t") <= most)).select("stack_id", "label", "t", F.explode(F.sequence(F.col("t") + 1, F.col("hi"))).alias("to"), *none)
    head = c.filter(F.col("before").isNull() & (F.col("t") > F.col("lo")) & (F.col("t") - F.col("lo") <= most)).select("stack_id", "label", "t", F.explode(F.sequence(F.col("lo"), F.col("t") - 1)).alias("to"), *none)
    moved = labels.join(gap.unionByName(tail).unionByName(head), ["stack_id", "label", "t"]).select("stack_id", F.col("to").alias("t"), *[(F.col(k) + F.col(f"s{k}")).alias(k) for k in "zxy"], "label")
    for k, n in zip("zxy", size, strict=True):
        moved = moved.filter((F.col(k) >= 0) & (F.col(k) < n))
    new = moved.join(labels, POINT, "left_anti").groupBy(*POINT).agg(F.max("label").alias("label"))
    return labels.unionByName(new)


def dilate(labels: DataFrame, element: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Labels grown by a box; a pixel that several reach, its own label too, takes the largest."""
    grown = around(labels.select("stack_id", "t", "label", "z", "x", "y"), box(*element))
    for k, n in zip("zxy", size, strict=True):
        grown = grown.filter((F.col(k) >= 0) & (F.col(k) < n))
    return grown.groupBy(*POINT).agg(F.max("label").alias("label"))


def erode(labels: DataFrame, element: tuple[int, int, int]) -> DataFrame:
    """Pixels whose whole box lies in the mask (outside of the image there is none)."""
    points = box(*element)
    near = around(labels.select("stack_id", "t", "z", "x", "y"), points).groupBy(*POINT).agg(F.count("*").alias("n")).filter(F.col("n") == len(points))
    return labels.join(near.select(*POINT), POINT, "left_semi")


def opening(mask: DataFrame, window: tuple[int, int, int]) -> DataFrame:
    """Pixels of a mask that some window of these lengths covers which lies in the mask as a whole."""
    points = [(i, j, k) for i in range(window[0]) for j in range(window[1]) for k in range(window[2])]
    back = [(-i, -j, -k) for i, j, k in points]
    corners = around(mask.select(*POINT), back).groupBy(*POINT).agg(F.count("*").alias("n")).filter(F.col("n") == len(points))
    return around(corners.select(*POINT), points).select(*POINT).distinct()


def morph_labels(labels: DataFrame, op: str, element: tuple[int, int, int], size: tuple[int, int, int], expand: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Dilate, erode or open the mask of all labels; the new pixels take the largest label within the box ``expand``, or go."""
    mask = labels.select(*POINT)
    if op == "dilate":
        new = dilate(mask.withColumn("label", F.lit(1)), element, size).select(*POINT)
    else:
        new = {"erode": erode, "open": opening}[op](mask, element).select(*POINT)
    return new.join(dilate(labels, expand, size), POINT)


def mask_voxels(voxels: DataFrame, labels: DataFrame, drop: bool = False) -> DataFrame:
    """Voxels outside of the mask become 0, or go."""
    if drop:
        return voxels.join(labels.select(*POINT), POINT, "left_semi")
    return voxels.join(labels.select(*POINT, F.lit(True).alias("_in")), POINT, "left").withColumn("value", F.when(F.col("_in"), F.col("value")).otherwise(0.0)).drop("_in")


def threshold_with_slope(voxels: DataFrame, threshold: float, ref_slice: int, slope: float) -> DataFrame:
    return voxels.filter(F.col("value") >= threshold + (F.col("z") - ref_slice) * slope)


def opened_threshold(voxels: DataFrame, threshold: float, ref_slice: int, slope: float) -> DataFrame:
    """The mask (stack_id, t, z, x, y) of one channel above the sloped threshold, without what no square of 2 x 2 pixels covers."""
    return opening(threshold_with_slope(voxels, threshold, ref_slice, slope).select(*POINT), (1, 2, 2))


def frame_bleach_factors(voxels: DataFrame) -> DataFrame:
    """(stack_id, c, t, factor): the channel's mean over the frame's."""
    per = voxels.groupBy("stack_id", "c", "t").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    whole = W.partitionBy("stack_id", "c")
    return per.select("stack_id", "c", "t", F.try_divide(F.sum("s").over(whole) / F.sum("n").over(whole), F.col("s") / F.col("n")).alias("factor"))


def nuclear_frame_mean(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    return voxels.join(labels.select(*POINT), POINT).groupBy("stack_id", "c", "t").agg(F.avg("value").alias("mean"))


def project(voxels: DataFrame, axis: str, how: str = "max") -> DataFrame:
    """Max, mean or sum along one axis (t, z, x or y)."""
    keys = [k for k in ("stack_id", "c", "t", "z", "x", "y") if k != axis]
    return voxels.groupBy(*keys).agg({"max": F.max, "mean": F.avg, "sum": F.sum}[how]("value").alias("value"))


def expand_projection(image: DataFrame, n: int) -> DataFrame:
    """An image repeated over ``n`` slices."""
    return image.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def radial_profile(image: DataFrame, center: tuple[int, int], keys: list[str]) -> DataFrame:
    r = F.sqrt(F.pow(F.col("x") - center[0], F.lit(2.0)) + F.pow(F.col("y") - center[1], F.lit(2.0))).cast("int")
    return image.groupBy(*keys, r.alias("r")).agg(F.avg("value").alias("mean"))


def subtract_background_channel(voxels: DataFrame, bg: int = 0, fg: int = 1) -> DataFrame:
    """Foreground less the background channel's mean over time, scaled by the channels' means, then moved up by |least value|."""
    back = voxels.filter(F.col("c") == bg).groupBy("stack_id", "z", "x", "y").agg(F.avg("value").alias("_b"))
    means = voxels.groupBy("stack_id").agg(F.try_divide(F.avg(F.when(F.col("c") == fg, F.col("value"))), F.avg(F.when(F.col("c") == bg, F.col("value")))).alias("_k"))
    rows = voxels.filter(F.col("c") == fg).join(back, ["stack_id", "z", "x", "y"]).join(means, "stack_id").withColumn("value", F.col("value") - F.col("_b") * F.col("_k"))
    low = rows.groupBy("stack_id").agg(F.abs(F.min("value")).alias("_low"))
    return rows.join(low, "stack_id").withColumn("value", F.col("value") + F.col("_low")).select(voxels.columns)


def normalize_minmax(voxels: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys)
    return voxels.withColumn("value", F.try_divide(F.col("value") - F.min("value").over(w), F.max("value").over(w) - F.min("value").over(w)))


def normalize_slices(voxels: DataFrame) -> DataFrame:
    """Slices divided by their mean and multiplied by the frame's."""
    frame, piece = W.partitionBy("stack_id", "c", "t"), W.partitionBy("stack_id", "c", "t", "z")
    return voxels.withColumn("value", F.try_divide(F.col("value"), F.avg("value").over(piece)) * F.avg("value").over(frame))


def normalize_masked(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """(v - least in mask) / (max - that), 0 outside; the mask is where the value is positive."""
    w, on = W.partitionBy(*keys), F.col("value") > 0
    low, high = F.min(F.when(on, F.col("value"))).over(w), F.max("value").over(w)
    return voxels.withColumn("value", F.when(on, F.try_divide(F.col("value") - low, high - low)).otherwise(0.0))


def signal_by_quantile(voxels: DataFrame, labels: DataFrame, c1: int, c2: int, n: int = 10) -> DataFrame:
    """Mean, median and count of channel c2 in each quantile of c1 inside the mask, by frame; edges belong to both sides."""
    v = voxels.join(labels.select(*POINT), POINT, "left_semi")
    both = v.filter(F.col("c") == c1).select(*POINT, F.col("value").alias("a")).join(v.filter(F.col("c") == c2).select(*POINT, F.col("value").alias("b")), POINT)
    cuts = both.groupBy("stack_id", "t").agg(F.expr(f"percentile(a, array({', '.join(str(k / n) for k in range(n + 1))}))").alias("cuts"))
    # a value between two cuts has one quantile, so rows are repeated only where they lie on a cut
    inner = F.slice("cuts", 2, n - 1)
    first, last = F.size(F.filter(inner, lambda c: c < F.col("a"))), F.size(F.filter(inner, lambda c: c <= F.col("a")))
    rows = both.join(cuts, ["stack_id", "t"]).withColumn("q", F.explode(F.sequence(first, last)))
    return rows.groupBy("stack_id", "t", "q").agg(F.avg("b").alias("mean"), F.expr("percentile(b, 0.5)").alias("median"), F.count("*").alias("n"))


def hotspot_overlap(voxels: DataFrame, labels: DataFrame, c1: int, c2: int, p: float = 0.9) -> DataFrame:
    """Share of mask pixels above the in-mask percentile of both channels, by frame."""
    v = voxels.join(labels.select(*POINT), POINT, "left_semi")
    both = v.filter(F.col("c") == c1).select(*POINT, F.col("value").alias("a")).join(v.filter(F.col("c") == c2).select(*POINT, F.col("value").alias("b")), POINT)
    cuts = both.groupBy("stack_id", "t").agg(F.expr(f"percentile(a, {p})").alias("pa"), F.expr(f"percentile(b, {p})").alias("pb"))
    return both.join(cuts, ["stack_id", "t"]).groupBy("stack_id", "t").agg(F.avg(((F.col("a") > F.col("pa")) & (F.col("b") > F.col("pb"))).cast("double")).alias("share"))


def histogram(rows: DataFrame, keys: list[str], value: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts in equal bins from low to high, the last one closed; values outside are dropped, empty bins present."""
    v = F.col(value)
    place = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    n = rows.filter((v >= low) & (v <= high)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    grid = rows.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(n, [*keys, "bin"], "left").fillna(0, ["n"])


def log_histogram(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of the bins of a histogram as log(share + least positive share)."""
    w = W.partitionBy(*keys)
    rows = counts.withColumn("share", F.try_divide("n", F.sum("n").over(w)))
    return rows.withColumn("log_share", F.ln(F.col("share") + F.min(F.when(F.col("share") > 0, F.col("share"))).over(w))).drop("share")


def otsu_threshold(voxels: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """The bin midpoint that parts values with the largest variance between both classes, from a histogram of each key's range.

    Ranges and counts are aggregates; only the bins of a key, not its values, come together.
    """
    w = W.partitionBy(*keys)
    ends = voxels.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
    rows = voxels.filter("value IS NOT NULL").select(*keys, "value").join(ends, keys).withColumn("bin", bin_)
    h = rows.groupBy(*keys, "bin", "lo", "hi").agg(F.count("*").alias("n")).withColumn("mid", F.col("lo") + (F.col("bin") + 0.5) * step)
    upto, after = w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0), w.orderBy("bin").rowsBetween(1, W.unboundedFollowing)
    weight = lambda f: F.sum("n").over(f)
    mean = lambda f: F.sum(F.col("n") * F.col("mid")).over(f) / F.sum("n").over(f)
    h = h.withColumn("_v", weight(upto) * weight(after) * F.pow(mean(upto) - mean(after), F.lit(2.0)))
    first = F.row_number().over(w.orderBy(F.desc_nulls_last("_v"), "bin"))
    return h.withColumn("_r", first).filter("_r = 1").select(*keys, F.col("mid").alias("threshold"))


def middle(voxels: DataFrame, low: float = 0.3, high: float = 0.7, axes: tuple[str, ...] = ("t", "x", "y")) -> DataFrame:
    """The voxels between two shares of each stack's length along some axes, truncated, the last excluded."""
    n = voxels.groupBy("stack_id").agg(*[(F.max(k) + 1).alias(f"_n{k}") for k in axes])
    out = voxels.join(n, "stack_id")
    for k in axes:
        out = out.filter((F.col(k) >= (F.col(f"_n{k}") * low).cast("int")) & (F.col(k) < (F.col(f"_n{k}") * high).cast("int")))
    return out.select(voxels.columns)


def spot_threshold(voxels: DataFrame, bins: int = 256) -> DataFrame:
    """(stack_id, threshold): the largest of the frames' Otsu thresholds, over the middle of the movie and of its images."""
    return otsu_threshold(middle(voxels), ["stack_id", "t"], bins).groupBy("stack_id").agg(F.max("threshold").alias("threshold"))


def max_in_nucleus(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """The brightest voxel of each label and frame; ties to the smaller coordinates."""
    first = F.row_number().over(W.partitionBy("stack_id", "c", "t", "label").orderBy(F.desc("value"), "z", "x", "y"))
    return voxels.join(labels, POINT).withColumn("_r", first).filter("_r = 1").drop("_r")


def concentration(voxels: DataFrame, labels: DataFrame, voxel_um3: float, kernel_sum: float, brightness: float) -> DataFrame:
    """Molecules = sum / kernel sum / (brightness / 33.54), over litres, in nM, by label and frame."""
    per = voxels.join(labels, POINT).groupBy("stack_id", "c", "t", "label").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    count = F.col("s") / kernel_sum / (brightness / 33.54)
    return per.select("stack_id", "c", "t", "label", (count / 6.02214076e23 / (F.col("n") * voxel_um3 * 1e-15) * 1e9).alias("nM"))


def fit_psf_scale(image: DataFrame, psf: DataFrame, last: int = 20000, step: int = 10) -> DataFrame:
    """The k of 0, step, .. last with the least sum of |value - k * psf| (both small images of dz, dx, dy)."""
    rows = image.join(psf, ["dz", "dx", "dy"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(step))))
    return rows.groupBy("k").agg(F.sum(F.abs(F.col("value") - F.col("k") * F.col("psf"))).alias("cost")).agg(F.min_by("k", F.struct("cost", "k")).alias("k"), F.min("cost").alias("cost"))


def movement(labels: DataFrame) -> DataFrame:
    """(stack_id, t, sx, sy): mean shift of the labels' centroids from frame 0, truncated."""
    c = centroids(labels)
    zero = c.filter("t = 0").select("stack_id", "label", F.col("x").alias("x0"), F.col("y").alias("y0"))
    return c.join(zero, ["stack_id", "label"]).groupBy("stack_id", "t").agg(F.avg(F.col("x") - F.col("x0")).cast("int").alias("sx"), F.avg(F.col("y") - F.col("y0")).cast("int").alias("sy"))


def shift_spots(spots: DataFrame, shifts: DataFrame, undo: bool = False) -> DataFrame:
    """Spots less the movement of their frame (``movement``), or with it again; frames without one stay."""
    sign = 1 if undo else -1
    return spots.join(shifts, ["stack_id", "t"], "left").withColumns({k: F.col(k) + sign * F.coalesce(f"s{k}", F.lit(0)) for k in "xy"}).select(spots.columns)


def flip(voxels: DataFrame, nx: int) -> DataFrame:
    return voxels.withColumn("x", nx - 1 - F.col("x"))


def rotate(voxels: DataFrame, n: int, quarter_turns: int) -> DataFrame:
    """Quarter turns in the plane of an n x n image."""
    for _ in range(quarter_turns % 4):
        voxels = voxels.withColumns({"x": n - 1 - F.col("y"), "y": F.col("x")})
    return voxels


def mean_image(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("dz", "dx", "dy").agg(F.avg("value").alias("value"))


def choose_turns(voxels: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """Each image of n x n pixels flipped or not and turned by a multiple of 90 degrees, as a hash of its keys says."""
    mark = hash_order(*[F.col(k) for k in keys], seed=seed)
    rows = voxels.withColumn("_k", F.conv(F.substring(mark, 1, 6), 16, 10).cast("long") % 8)
    x = F.when(F.col("_k") >= 4, n - 1 - F.col("x")).otherwise(F.col("x"))
    rows = rows.withColumn("_x", x)
    turn, y = F.col("_k") % 4, F.col("y")
    new_x = F.when(turn == 0, F.col("_x")).when(turn == 1, n - 1 - y).when(turn == 2, n - 1 - F.col("_x")).otherwise(y)
    new_y = F.when(turn == 0, y).when(turn == 1, F.col("_x")).when(turn == 2, n - 1 - y).otherwise(n - 1 - F.col("_x"))
    return rows.withColumns({"x": new_x.cast("int"), "y": new_y.cast("int")}).select(voxels.columns)


def paired_turns(voxels: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """Two choices of each image, tagged left and right."""
    return choose_turns(voxels, keys, n, seed).withColumn("set", F.lit("left")).unionByName(choose_turns(voxels, keys, n, seed + 1).withColumn("set", F.lit("right")))


def add_noise(voxels: DataFrame, keys: list[str], sigma: float, seed: int) -> DataFrame:
    """Values plus Gaussian noise; each image has its own deviation from 0 to ``sigma``, each voxel its own draw, all by hashes."""
    part = lambda m, at: (F.conv(F.substring(m, at, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    own = hash_order(*[F.col(k) for k in keys], seed=seed)
    each = hash_order(*[F.col(k) for k in (*keys, "z", "x", "y")], seed=seed)
    draw = F.sqrt(-2 * F.ln(part(each, 1))) * F.cos(2 * 3.141592653589793 * part(each, 13))
    return voxels.withColumn("value", F.col("value") + sigma * part(own, 1) * draw)


def center_crop(images: DataFrame, keys: list[str], lengths: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """(keys, dx, dy, value): a box around the largest pixel of each image (x, y, value); boxes that leave the image go."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"), "x", "y"))
    top = images.withColumn("_r", first).filter("_r = 1").select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"))
    for k, n, m in zip("xy", lengths, size, strict=True):
        top = top.filter((F.col(f"_{k}") >= n // 2) & (F.col(f"_{k}") + n // 2 < m))
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-(lengths[0] // 2), lengths[0] // 2 + 1) for j in range(-(lengths[1] // 2), lengths[1] // 2 + 1)])).alias("d")
    wanted = top.select("*", d).select(*keys, "d.dx", "d.dy", (F.col("_x") + F.col("d.dx")).alias("x"), (F.col("_y") + F.col("d.dy")).alias("y"))
    return wanted.join(images.select(*keys, "x", "y", "value"), [*keys, "x", "y"]).select(*keys, "dx", "dy", "value")


def clicks_to_maximum(clicks: DataFrame, voxels: DataFrame, length: int = 5, z_rad: int = 1) -> DataFrame:
    """Clicks (stack_id, t, z, x, y) moved to the slice within ``z_rad`` whose box has the largest mean, there to the largest pixel of the box; each once."""
    ask = clicks.select(*POINT).distinct().select(*POINT, *[F.col(k).alias(f"at_{k}") for k in "zxy"])
    # Spark takes what is asked to be as small as before it was exploded and would broadcast it
    near = around(ask, box(2 * z_rad + 1, length, length)).join(voxels.select(*POINT, "value").hint("merge"), POINT)
    key = ["stack_id", "t", "at_z", "at_x", "at_y"]
    slices = near.groupBy(*key, "z").agg(F.avg("value").alias("mean"), F.max_by(F.struct("x", "y"), F.struct("value", (-F.col("x")).alias("a"), (-F.col("y")).alias("b"))).alias("at"))
    best = slices.groupBy(*key).agg(F.max_by(F.struct("z", "at"), F.struct("mean", (-F.col("z")).alias("a"))).alias("b"))
    return best.select("stack_id", "t", "b.z", "b.at.x", "b.at.y").distinct()
