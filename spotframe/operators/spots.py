"""Fits, spots, movies and names: filters, joins with metadata, depth and bleach corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.functions.scalar import hash_order
from spotframe.operators.frames import fit_peaks


def peakiness(height: Column, width_x: Column, width_y: Column) -> Column:
    """ln(height / mean lateral width); an infinite width and a height of 0 count as 0.5, a negative height gives null."""
    width = (width_x + width_y) / 2
    width = F.when(F.abs(width) == float("inf"), 0.5).otherwise(width)
    height = F.when(height == 0, 0.5).otherwise(height)
    return F.when(height / width > 0, F.ln(height / width))


def filter_fits(fits: DataFrame, limit: float = 4.5, medians: DataFrame | None = None) -> DataFrame:
    """Fits that are peaked enough and, with ``medians`` (stack_id, t, median), higher than their frame's median."""
    kept = fits.filter(peakiness(F.col("height"), F.col("width_x"), F.col("width_y")) > limit)
    if medians is None:
        return kept
    return kept.join(medians, ["stack_id", "t"]).filter(F.when(F.col("height") == 0, 0.5).otherwise(F.col("height")) > F.col("median")).drop("median")


def frame_stats(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.groupBy("stack_id", "t").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.expr(f"percentile({value}, 0.5)").alias("median"))


def filter_fits_by_stats(fits: DataFrame, stats: DataFrame, k: float = 1.0, max_width: float = 15.0) -> DataFrame:
    """Fits of at least mean + k * std of their frame with a small mean lateral width."""
    return fits.join(stats.select("stack_id", "t", "mean", "std"), ["stack_id", "t"]).filter((F.col("height") >= F.col("mean") + k * F.col("std")) & ((F.col("width_x") + F.col("width_y")) / 2 < max_width)).drop("mean", "std")


def score_filter(fits: DataFrame, least: float) -> DataFrame:
    """log2(width_z * 256 / width_x) of at least ``least``."""
    return fits.filter(F.log2(F.col("width_z") * 256 / F.col("width_x")) >= least)


def apply_curation(spots: DataFrame, bad: DataFrame, new: DataFrame, strict: bool = True) -> DataFrame:
    """Rows (stack_id, spot_id, t) of ``bad`` go, those of ``new`` come with their spot's nucleus, that of its first row.

    Strict: an error if a bad row is missing or a new one exists already.
    """
    key = ["stack_id", "spot_id", "t"]
    left = spots.join(bad.select(key), key, "left_anti")
    if strict and (not bad.join(spots, key, "left_anti").isEmpty() or not new.join(left, key, "left_semi").isEmpty()):
        raise ValueError("a row to delete is missing, or one to insert exists")
    nucleus = spots.groupBy("stack_id", "spot_id").agg(F.min_by("nuc_id", "t").alias("nuc_id"))
    return left.unionByName(new.drop("nuc_id").join(nucleus, ["stack_id", "spot_id"]).select(left.columns))


def curate(spots: DataFrame, bad: DataFrame, new: DataFrame, frames: DataFrame, rad_xy: int = 10, rad_z: int = 2, strict: bool = True) -> DataFrame:
    """``apply_curation`` with rows of ``new`` (stack_id, spot_id, t, z, x, y) measured on ``frames``, which hold one channel.

    Height and widths are those of a Gaussian fitted around the given place, rounded; the place itself stays as it was given. A row whose frame isn't there has null measures. Only frames with new rows
    are read into tasks.
    """
    key = ["stack_id", "spot_id", "t"]
    at = [F.round(c).cast("int").alias(c) for c in "zxy"]
    fits = fit_peaks(new.select("stack_id", "t", F.col("spot_id").alias("fit_no"), *at), frames, rad_xy, rad_z)
    measured = fits.select("stack_id", F.col("fit_no").alias("spot_id"), "t", "height", "width_z", "width_x", "width_y")
    return apply_curation(spots, bad, new.select(*key, "z", "x", "y").join(measured, key, "left"), strict)


def start_per_frame(movies: DataFrame, segments: DataFrame, n_frames: DataFrame) -> DataFrame:
    """(stack_id, t, start): the segment's z start less the surface, which moves evenly from before to after. ``n_frames`` has stack_id, n."""
    stop = F.lead("start_frame").over(W.partitionBy("stack_id").orderBy("start_frame"))
    per = segments.withColumn("stop", stop).join(n_frames, "stack_id").join(movies, "stack_id")
    frames = per.withColumn("t", F.explode(F.sequence(F.col("start_frame"), F.greatest(F.coalesce("stop", "n") - 1, F.col("start_frame"))))).filter("t < n")
    return frames.select("stack_id", "t", (F.col("start_pos") - (F.col("surface_before") + F.col("t") * (F.col("surface_after") - F.col("surface_before")) / F.col("n"))).alias("start"))


def add_depth(spots: DataFrame, movies: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds depth = start of the frame + z * z_interval; the number of frames is the largest t + 1."""
    n = spots.groupBy("stack_id").agg((F.max("t") + 1).alias("n"))
    start = start_per_frame(movies, segments, n)
    return spots.join(start, ["stack_id", "t"]).join(movies.select("stack_id", "z_interval"), "stack_id").withColumn("depth", F.col("start") + F.col("z") * F.col("z_interval")).drop("start", "z_interval")


def focus_shift(fits: DataFrame, segments: DataFrame, undo: bool = False) -> DataFrame:
    """z plus (or less) the sum of all corrections of segments that began by its frame."""
    order = W.partitionBy("stack_id").orderBy("start_frame")
    per = segments.select("stack_id", "start_frame", F.sum("z_corr").over(order).alias("_shift"), F.lead("start_frame").over(order).alias("_stop"))
    at = (F.col("f.stack_id") == F.col("s.stack_id")) & (F.col("f.t") >= F.col("s.start_frame")) & (F.col("s._stop").isNull() | (F.col("f.t") < F.col("s._stop")))
    rows = fits.alias("f").join(per.alias("s"), at, "left").select("f.*", F.coalesce("s._shift", F.lit(0)).alias("_shift"))
    return rows.withColumn("z", F.col("z") - F.col("_shift") if undo else F.col("z") + F.col("_shift")).drop("_shift")


def divide_by_frame(spots: DataFrame, factors: DataFrame, columns: list[str]) -> DataFrame:
    rows = spots.join(factors.select("stack_id", "t", "factor"), ["stack_id", "t"], "left")
    return rows.withColumns({c: F.col(c) / F.col("factor") for c in columns}).drop("factor")


def depth_correct_grid(spots: DataFrame, grid: DataFrame, measure: str, target: float) -> DataFrame:
    """a * exp(-b * target) + c with the cell of (depth, intensity); where b is 0 the row's first cell with one, c from the point.

    Rows outside the grid stay as they are.
    """
    d, v = F.col("depth"), F.col(measure)
    rows = spots.withColumn("depth_bin", (d / 0.1).cast("int")).withColumn("intensity_bin", (v / 100).cast("int"))
    first = grid.filter("b <> 0").groupBy("depth_bin").agg(F.min_by(F.struct("a", "b"), "intensity_bin").alias("f"))
    rows = rows.join(grid, ["depth_bin", "intensity_bin"], "left").join(first, "depth_bin", "left")
    own = F.col("a") * F.exp(-F.col("b") * target) + F.col("c")
    low = F.col("f.a") * F.exp(-F.col("f.b") * target) + v - F.col("f.a") * F.exp(-F.col("f.b") * d)
    return rows.withColumn(measure, F.when(F.col("b").isNull(), v).when(F.col("b") != 0, own).otherwise(F.coalesce(low, v))).drop("a", "b", "c", "f", "depth_bin", "intensity_bin")


def depth_correct_curve(spots: DataFrame, measure: str, a: float, b: float, target: float) -> DataFrame:
    return spots.withColumn(measure, F.col(measure) - a * F.exp(-b * F.col("depth")) + a * F.exp(F.lit(-b * target)))


def depth_correct_linear(spots: DataFrame, columns: list[str], slope: float = -338.0, dz: float = 0.66) -> DataFrame:
    return spots.withColumns({c: F.col(c) - F.col("z") * dz * slope for c in columns})


def bin_values(spots: DataFrame, by: str, measure: str, size: float = 0.5, nbins: int = 100) -> DataFrame:
    """Mean and count by trunc(by / size), from 0 to nbins - 1, empty bins too; values outside are dropped."""
    rows = spots.withColumn("bin", (F.col(by) / size).cast("int")).filter((F.col(by) >= 0) & (F.col("bin") < nbins))
    per = rows.groupBy("bin").agg(F.avg(measure).alias("mean"), F.count(measure).alias("n"))
    return spots.sparkSession.range(nbins).select(F.col("id").cast("int").alias("bin")).join(per, "bin", "left").fillna(0, ["n"])


def gaussian_integral(spots: DataFrame, len_xy: int = 15, len_z: int = 5) -> DataFrame:
    """Adds gauss: mean of the fitted Gaussian over a window around its centre; the three axes are summed apart."""
    if not len_xy % 2 or not len_z % 2:
        raise ValueError("window lengths must be odd")
    total = F.col("height") / (len_xy * len_xy * len_z)
    for n, w in ((len_z, "width_z"), (len_xy, "width_x"), (len_xy, "width_y")):
        axis = F.lit(1.0)
        for k in range(1, n // 2 + 1):
            axis = axis + 2 * F.exp(-F.pow(F.lit(float(k)) / F.col(w), F.lit(2.0)) / 2)
        total = total * axis
    return spots.withColumn("gauss", total)


def mean_depth(spots: DataFrame) -> DataFrame:
    return spots.agg(F.avg("depth").cast("int").alias("depth"))


def relate(rows: DataFrame, a: str, b: str, upper: float | None = None) -> DataFrame:
    """Pearson, Spearman (average ranks) and least-squares line of b on a, over rows with both (below ``upper``).

    Ranks are those in a bucket of the range plus the rows of the buckets before, so no task orders all values.
    """
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if upper is not None:
        both = both.filter((F.col(a) < upper) & (F.col(b) < upper))
    for c in (a, b):
        n = both.groupBy(c).agg(F.count("*").alias("_n")).withColumn("_b", range_bucket(both, c))
        inside = F.sum("_n").over(W.partitionBy("_b").orderBy(c))
        sums = n.groupBy("_b").agg(F.sum("_n").alias("_s"))
        base = sums.select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_base"))
        place = n.withColumn("_in", inside).join(base, "_b").select(c, (F.col("_base") + F.col("_in") - (F.col("_n") - 1) / 2).alias(f"_r{c}"))
        both = both.join(place, c)
    return both.agg(F.corr(a, b).alias("pearson"), F.corr(f"_r{a}", f"_r{b}").alias("spearman"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.count("*").alias("n"))


def detrend(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Adds residual of the line of y on x."""
    line = rows.agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    return rows.crossJoin(F.broadcast(line)).withColumn("residual", F.col(y) - F.col("_s") * F.col(x) - F.col("_i")).drop("_s", "_i")


def zscore(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; 0 for a constant one."""
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(stats))
    return out.withColumns({c: F.when(F.col(f"_s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}).select(rows.columns)


def ranks_of(rows: DataFrame, order: list[Column], bucket: Column, place: str) -> DataFrame:
    """Adds the place, from 1, of each row in an order that begins with ``bucket`` (a number that grows with the order).

    A place is the rank in the bucket plus the rows of all buckets before; only the buckets' counts are ordered in one task.
    """
    rows = rows.withColumn("_b", bucket)
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    base = counts.select(F.col("_b").alias("_own"), (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_base"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy(*order))
    return rows.withColumn("_rank", rank).join(base, F.col("_b").eqNullSafe(F.col("_own"))).withColumn(place, F.col("_base") + F.col("_rank")).drop("_b", "_own", "_base", "_rank")


def range_bucket(rows: DataFrame, column: str, buckets: int = 4096) -> Column:
    """A number that grows with a numeric column, from its range: bucket 0 for the least value, null for null."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or not float(high) > float(low):
        return F.lit(0)
    v = F.col(column).cast("double")
    return F.floor((v - float(low)) / (float(high) - float(low)) * buckets).cast("long")


def sort_by_frequency(values: DataFrame, column: str) -> DataFrame:
    """Values with their counts and place, most frequent first, ties to the smaller value."""
    n = values.groupBy(column).agg(F.count("*").alias("n"))
    return ranks_of(n, [F.desc("n"), F.asc(column)], -F.col("n"), "place")


def sample_rows(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows without replacement, in an order by hash of their key."""
    return rows.orderBy(hash_order(F.col(key), seed=seed), key).limit(n)


# names


def parse_sim_names(rows: DataFrame) -> DataFrame:
    """Adds params: the nine numbers between the first and the last token; names with another number of tokens are dropped."""
    tokens = F.split("name", "_")
    return rows.filter(F.size(tokens) == 11).withColumn("params", F.transform(F.slice(tokens, 2, 9), lambda x: x.try_cast("double")))


def parse_real_names(rows: DataFrame) -> DataFrame:
    """Adds sample, stack, nucleus and z of names ``sample_stack_nucleus_z.pkl``."""
    tokens = F.split(F.regexp_replace("name", r"\.pkl$", ""), "_")
    return rows.filter(F.size(tokens) >= 4).withColumns({k: F.get(tokens, i) for i, k in enumerate(("sample", "stack", "nucleus", "z"))})


def match_names(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.filter(F.col("name").rlike(pattern))


def visible(files: DataFrame, extension: str | None = None) -> DataFrame:
    kept = files.filter(~F.col("name").startswith("."))
    return kept.filter(F.col("name").endswith(extension)) if extension else kept


def drop_items(rows: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    return rows.join(bad.select(key), key, "left_anti")


def load_named(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.join(names.select("name"), "name", "left_semi")


def count_nuclei(rows: DataFrame) -> DataFrame:
    """Different (stack, nucleus) by sample."""
    return rows.select("sample", "stack", "nucleus").distinct().groupBy("sample").agg(F.count("*").alias("nuclei"))


def decode_stack_ids(files: DataFrame, key: DataFrame) -> DataFrame:
    """Names ``old_nucleus_rest`` with the key's new stack; nuclei numbered from 0 in each new stack, in order of old stack, then nucleus."""
    tokens = F.split("name", "_")
    rows = files.filter(F.size(tokens) >= 3).withColumns({"old": F.get(tokens, 0), "nuc": F.get(tokens, 1), "rest": F.array_join(F.slice(tokens, 3, 100), "_")}).join(key, "old")
    nuclei = rows.select("new", "old", "nuc").distinct().withColumn("n", F.row_number().over(W.partitionBy("new").orderBy("old", "nuc")) - 1)
    return rows.join(nuclei, ["new", "old", "nuc"]).select("name", F.concat_ws("_", "new", F.col("n").cast("string"), "rest").alias("renamed"))


def pair_by_suffix(sims: DataFrame, reals: DataFrame) -> DataFrame:
    """A sim belongs to the real one whose name is its own without the first token."""
    return sims.select(F.col("name").alias("sim"), F.regexp_replace("name", "^[^_]*_", "").alias("name")).join(reals.select("name"), "name")


def object_hierarchy(tracks: DataFrame, nuclei: DataFrame, spots: DataFrame) -> DataFrame:
    """(track, nucleus, spot) for tracks (id, children as text 1,2,3), nuclei (id) and spots (id, parent); tracks without spots have no row."""
    members = tracks.select(F.col("id").alias("track"), F.explode(F.split("children", ",")).alias("c")).select("track", F.trim("c").try_cast("long").alias("nucleus"))
    return members.join(nuclei.select(F.col("id").alias("nucleus")), "nucleus").join(spots.select(F.col("id").alias("spot"), F.col("parent").alias("nucleus")), "nucleus").select("track", "nucleus", "spot")


def concat_stacks(parts: DataFrame) -> DataFrame:
    """Frames (part, t, ..) in one movie: t moves by the frames of the parts before; the first frame of a later part is a join."""
    per = parts.groupBy("part").agg((F.max("t") + 1).alias("n"))
    base = per.withColumn("base", F.sum("n").over(W.orderBy("part")) - F.col("n")).drop("n")
    return parts.join(F.broadcast(base), "part").withColumn("new_t", F.col("t") + F.col("base")).withColumn("join_frame", (F.col("t") == 0) & (F.col("base") > 0)).drop("base")


def select_columns(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of an object table under their short names."""
    return rows.select([F.col(k).alias(v) for k, v in names.items()])


def filter_nucleus_objects(rows: DataFrame, size: tuple[float, float], least_volume: float = 5000, label: str = "nucleus", file: str | None = None, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Objects (x_min, x_max, y_min, y_max, volume) whose box doesn't touch the image's edge and with more than a volume, with a label and the file's name.

    ``origin`` is taken off the box's coordinates afterwards.
    """
    out = rows
    for k, n in zip("xy", size, strict=True):
        out = out.filter((F.col(f"{k}_min") > 0) & (F.col(f"{k}_max") < n))
    out = out.filter(F.col("volume") > least_volume).withColumns({"label": F.lit(label), "file": F.lit(file).cast("string")})
    return out.withColumns({f"{k}_{e}": F.col(f"{k}_{e}") - o for k, o in zip("xy", origin, strict=True) for e in ("min", "max")})
