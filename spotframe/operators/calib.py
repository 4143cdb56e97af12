"""Calibration: depth and bleach curves, trimmed intensities, prepared histograms, curated tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.functions.kernels import fit_exponential
from spotframe.functions.scalar import hash_order
from spotframe.operators.embed import hash_places
from spotframe.operators.ranks import quantiles
from spotframe.operators.spots import ranks_of, start_per_frame
from spotframe.operators.voxels import POINT, around, box


def bleach_constant_depth(voxels: DataFrame, labels: DataFrame, movies: DataFrame, segments: DataFrame, ref_depth: float, size: tuple[int, int, int], channel: int = 0) -> DataFrame:
    """(stack_id, t, mean, fit, factor): mean background of the slice at a depth, its line over time, and fit / fit of frame 0.

    The slice is trunc((depth - start) / z interval), clamped. Background pixels have no label within two pixels, and lie
    two pixels or more from the image's edge; label pixels are exploded (few), not the background.
    """
    n = voxels.groupBy("stack_id").agg((F.max("t") + 1).alias("n"))
    start = start_per_frame(movies, segments, n).join(movies.select("stack_id", "z_interval"), "stack_id")
    at = start.select("stack_id", "t", F.greatest(F.lit(0), F.least(F.lit(size[0] - 1), ((F.lit(ref_depth) - F.col("start")) / F.col("z_interval")).cast("int"))).alias("z"))
    inner = (F.col("x") >= 2) & (F.col("x") < size[1] - 2) & (F.col("y") >= 2) & (F.col("y") < size[2] - 2)
    pixels = voxels.filter((F.col("c") == channel) & inner).join(at, ["stack_id", "t", "z"])
    near = around(labels.join(at, ["stack_id", "t", "z"]).select("stack_id", "t", "z", "x", "y"), box(1, 5, 5)).select(*POINT).distinct()
    mean = pixels.join(near, POINT, "left_anti").groupBy("stack_id", "t").agg(F.avg("value").alias("mean"))
    line = mean.groupBy("stack_id").agg(F.regr_slope("mean", "t").alias("_s"), F.regr_intercept("mean", "t").alias("_i"))
    return mean.join(line, "stack_id").select("stack_id", "t", "mean", (F.col("_s") * F.col("t") + F.col("_i")).alias("fit"), F.try_divide(F.col("_s") * F.col("t") + F.col("_i"), "_i").alias("factor"))


def trimmed_by_slice(rows: DataFrame, low: float = 0.1, high: float = 0.9, least: int = 4) -> DataFrame:
    """(stack_id, z, mean, n) of the values of each slice within its percentiles; slices with ``least`` values or fewer left have no mean."""
    cuts = quantiles(rows, ["stack_id", "z"], "value", [low, high]).select("stack_id", "z", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    kept = rows.join(cuts, ["stack_id", "z"]).filter("value >= lo AND value <= hi")
    return kept.groupBy("stack_id", "z").agg(F.when(F.count("*") > least, F.avg("value")).alias("mean"), F.count("*").alias("n"))


def depth_intensity(trimmed: DataFrame, stacks: DataFrame) -> DataFrame:
    """(stack_id, depth, mean): depth = z * dz + start - surface; stacks have stack_id, dz, start, surface."""
    return trimmed.filter("mean IS NOT NULL").join(stacks, "stack_id").select("stack_id", (F.col("z") * F.col("dz") + F.col("start") - F.col("surface")).alias("depth"), "mean")


def depth_curves(points: DataFrame) -> DataFrame:
    """(stack_id, a, b, c): an exponential for each calibration set (stack_id, depth, mean), fitted where its few points are."""

    def run(key, pdf):
        a, b, c = fit_exponential(pdf["depth"].to_numpy(), pdf["mean"].to_numpy())
        return pdf.iloc[:1][["stack_id"]].assign(a=a, b=b, c=c)

    return points.groupBy("stack_id").applyInPandas(run, "stack_id long, a double, b double, c double")


def depth_curves_to_grid(curves: DataFrame, depth_bins: int, intensity_bins: int) -> DataFrame:
    """(depth_bin, intensity_bin, a, b, c): cells of 0.1 um and 100 between two curves that follow each other at that depth.

    Parameters are linear between both curves; cells outside all curves are 0.
    """
    at = curves.withColumn("depth_bin", F.explode(F.sequence(F.lit(0), F.lit(depth_bins - 1)))).withColumn("v", F.col("a") * F.exp(-F.col("b") * F.col("depth_bin") * 0.1) + F.col("c"))
    order = W.partitionBy("depth_bin").orderBy("v", "stack_id")
    pair = at.withColumns({f"n{k}": F.lead(k).over(order) for k in ("v", "a", "b", "c")}).filter("nv > v")
    first, last = F.greatest(F.ceil(F.col("v") / 100), F.lit(0)).cast("int"), F.least(F.ceil(F.col("nv") / 100) - 1, F.lit(intensity_bins - 1)).cast("int")
    cells = pair.filter(first <= last).withColumn("intensity_bin", F.explode(F.sequence(first, last)))
    w = (F.col("intensity_bin") * 100 - F.col("v")) / (F.col("nv") - F.col("v"))
    inside = cells.select("depth_bin", "intensity_bin", *[(F.col(k) + w * (F.col(f"n{k}") - F.col(k))).alias(k) for k in "abc"])
    grid = curves.sparkSession.range(depth_bins).select(F.col("id").cast("int").alias("depth_bin"), F.explode(F.sequence(F.lit(0), F.lit(intensity_bins - 1))).alias("intensity_bin"))
    return grid.join(inside, ["depth_bin", "intensity_bin"], "left").fillna(0.0, ["a", "b", "c"])


def depth_correct_from_data(spots: DataFrame, bins: DataFrame, measure: str, target: float, size: float = 0.5, low: float = 12.0, high: float = 20.0) -> DataFrame:
    """Corrects by an exponential fitted to the bin means (bin, mean) between two depths; some tens of means go to the driver."""
    rows = bins.filter((F.col("bin") * size >= low) & (F.col("bin") * size <= high) & F.col("mean").isNotNull()).orderBy("bin").collect()
    a, b, _ = fit_exponential(np.array([r["bin"] * size for r in rows]), np.array([r["mean"] for r in rows]))
    return spots.withColumn(measure, F.col(measure) - a * F.exp(-b * F.col("depth")) + a * float(np.exp(-b * target)))


def prepare_histograms(hists: DataFrame, nbins: int) -> DataFrame:
    """(sim_id, sigma_no, hist): block means down to ``nbins``, as shares of their sum, as log(share + least positive share / 100)."""
    per = hists.select("sim_id", "sigma_no", F.size("hist").alias("n"), F.posexplode("hist").alias("i", "v"))
    block = per.groupBy("sim_id", "sigma_no", F.floor(F.col("i") * nbins / F.col("n")).cast("int").alias("b")).agg(F.avg("v").alias("v"))
    w = W.partitionBy("sim_id", "sigma_no")
    share = block.withColumn("s", F.try_divide("v", F.sum("v").over(w)))
    least = share.agg(F.min(F.when(F.col("s") > 0, F.col("s"))).alias("least"))
    rows = share.crossJoin(F.broadcast(least)).withColumn("l", F.ln(F.col("s") + F.col("least") / 100))
    return rows.groupBy("sim_id", "sigma_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "l"))), lambda s: s["l"]).alias("hist"))


def flatten_histograms(hists: DataFrame) -> DataFrame:
    """(sim_id, hist): the histograms of all sigmas of a sim, one after the other."""
    return hists.groupBy("sim_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sigma_no", "hist"))), lambda s: s["hist"])).alias("hist"))


def clean_clicks(lines: DataFrame) -> DataFrame:
    """(z, x, y) of text lines ``z x y``: comments, None and lines that aren't three numbers go, numbers are truncated, repeats fall together."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = lines.filter(~F.trim("value").startswith("#") & ~F.col("value").contains("None")).select(*[F.get(parts, k).try_cast("double").cast("int").alias(n) for k, n in enumerate("zxy")])
    return rows.dropna().distinct()


def filter_genes(table: DataFrame, kind: str) -> DataFrame:
    """Rows of a class with both measures positive, with their length."""
    return table.filter((F.col("class") == kind) & (F.col("m1") > 0) & (F.col("m2") > 0)).withColumn("length", F.col("end") - F.col("begin"))


def rename_to_template(sources: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(name, renamed): each source (id, name) gets the sample, stack and z of a hashed target and nucleus 1000 + its place; places are in hashed orders."""
    n = targets.count()
    t = hash_places(targets, "name", seed + 1).select(F.col("place").alias("k"), "sample", "stack", "z")
    s = hash_places(sources, "id", seed + 2).withColumn("k", F.conv(F.substring(hash_order(F.col("id"), seed=seed), 1, 12), 16, 10).cast("long") % n)
    return s.join(t, "k").select("name", F.concat_ws("_", "sample", "stack", (F.col("place") + 1000).cast("string"), "z").alias("renamed"))


def mean_signal_concentration(rows: DataFrame, background: float, kernel_sum: float, voxel_um3: float, brightness: float) -> DataFrame:
    """(stack_id, nM): (mean - background) / kernel sum * nM of one molecule per voxel / (brightness / 34)."""
    one = 1 / 6.02214076e23 / (voxel_um3 * 1e-15) * 1e9
    return rows.groupBy("stack_id").agg(((F.avg("value") - background) / kernel_sum * one / (brightness / 34)).alias("nM"))


def crop_objects(voxels: DataFrame, labels: DataFrame, lengths: tuple[int, int, int], size: tuple[int, int, int], margin: int = 0, grow: tuple[int, int, int] | None = None, starts: list[int] | None = None) -> DataFrame:
    """(stack_id, t, label, dz, dx, dy, value): a box around each object's centroid, 0 outside of its mask, which may first ``grow`` by a box.

    The centre moves up to ``margin`` pixels so that the box is inside the image; objects whose box still isn't, and boxes whose
    middle slice is empty, go. With ``starts`` there is a box for each of these first slices (column start) in place of that around the centroid in z.
    """
    center = labels.groupBy("stack_id", "t", "label").agg(*[F.avg(k).cast("int").alias(f"c{k}") for k in "zxy"])
    keys = ["stack_id", "t", "label"]
    if starts is not None:
        keys.append("start")
        center = center.withColumn("start", F.explode(F.array(*[F.lit(x) for x in starts]))).withColumn("cz", F.col("start") + lengths[0] // 2)
    for k, n, m in zip("zxy", lengths, size, strict=True):
        low, high = n // 2, m - 1 - n // 2
        moved = F.greatest(F.lit(low), F.least(F.lit(high), F.col(f"c{k}")))
        most = 0 if k == "z" and starts is not None else margin
        center = center.withColumn(k, moved).filter((F.abs(moved - F.col(f"c{k}")) <= most) & F.lit(low <= high)).drop(f"c{k}")
    wanted = around(center, box(*lengths))
    mask = labels.select(*POINT, "label") if grow is None else around(labels.select(*POINT, "label"), box(*grow)).select(*POINT, "label").distinct()
    own = wanted.join(mask, [*POINT, "label"], "left_semi")
    place = [*keys, "dz", "dx", "dy"]
    rows = own.join(voxels.select(*POINT, "c", "value"), POINT).groupBy(*place).agg(F.first("value").alias("value"))
    full = rows.filter("dz = 0 AND value <> 0").select(*keys).distinct()
    return wanted.select(*place).join(full, keys, "left_semi").join(rows, place, "left").fillna(0.0, ["value"])


def param_histograms(reference: DataFrame, sims: DataFrame, patterns: dict[str, str], param: int, cutoff: float, bins: int = 20) -> DataFrame:
    """(pattern, bin, n): for each name pattern the sims near its references' centroid, a histogram of one parameter from 0 to the largest."""
    from spotframe.operators.embed import sims_near_center
    from spotframe.operators.spots import match_names
    from spotframe.operators.voxels import histogram

    top = float(sims.agg(F.max(F.get("params", F.lit(param)))).first()[0])
    out = None
    for name, pattern in patterns.items():
        near = sims_near_center(match_names(reference, pattern), sims, cutoff).select(F.lit(name).alias("pattern"), F.get("params", F.lit(param)).alias("p"))
        out = near if out is None else out.unionByName(near)
    return histogram(out, ["pattern"], "p", bins, 0.0, top)


def stitch_labels(first: DataFrame, second: DataFrame, shift: int, matches: DataFrame) -> DataFrame:
    """Label rows of two movies in one: frames of the second move by ``shift``, labels with a match (la, lb) take la, others follow the first's largest."""
    top = first.agg(F.max("label").alias("top"))
    rows = second.join(matches.select(F.col("lb").alias("label"), "la"), "label", "left")
    new = ranks_of(rows.filter("la IS NULL").select("label").distinct(), [F.col("label")], F.floor(F.col("label") / 4096), "r")
    rows = rows.join(new, "label", "left").crossJoin(F.broadcast(top)).withColumn("label", F.coalesce("la", F.col("top") + F.col("r")).cast("int")).withColumn("t", F.col("t") + shift)
    return first.unionByName(rows.select(first.columns))


def attach_spots(first: DataFrame, second: DataFrame, labels: DataFrame, shift: int) -> DataFrame:
    """Spots (stack_id, spot_id, t, nuc_id) of two movies in one: those of the second, moved by ``shift`` frames, join the first's longest spot of the same nucleus.

    A spot's nucleus is its most frequent one (ties: the smaller); the second's nuclei are numbered anew by ``labels`` (label, new). Of the
    second's spots of one nucleus the longest (then the smallest id) is joined; all others follow the first's largest id.
    """
    def nucleus(spots):
        n = spots.groupBy("stack_id", "spot_id", "nuc_id").agg(F.count("*").alias("n"))
        return n.groupBy("stack_id", "spot_id").agg(F.max_by("nuc_id", F.struct("n", -F.col("nuc_id"))).alias("nuc"), F.sum("n").alias("length"))

    longest = lambda s: s.groupBy("stack_id", "nuc").agg(F.max_by("spot_id", F.struct("length", -F.col("spot_id"))).alias("spot_id"))
    moved = second.join(labels.select(F.col("label").alias("nuc_id"), "new"), "nuc_id", "left").withColumn("nuc_id", F.coalesce("new", "nuc_id")).withColumn("t", F.col("t") + shift).select(second.columns)
    goal = longest(nucleus(first)).select("stack_id", "nuc", F.col("spot_id").alias("goal"))
    joined = longest(nucleus(moved)).join(goal, ["stack_id", "nuc"]).select("stack_id", "spot_id", "goal")
    top = first.agg(F.max("spot_id").alias("top"))
    free = moved.select("stack_id", "spot_id").distinct().join(joined, ["stack_id", "spot_id"], "left_anti")
    free = ranks_of(free, [F.col("stack_id"), F.col("spot_id")], F.col("stack_id"), "r").crossJoin(F.broadcast(top)).select("stack_id", "spot_id", (F.coalesce("top", F.lit(0)) + F.col("r")).alias("goal"))
    new = joined.unionByName(free)
    return first.unionByName(moved.join(new, ["stack_id", "spot_id"]).withColumn("spot_id", F.col("goal")).select(first.columns))
