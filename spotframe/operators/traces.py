"""Time series per spot: tables (stack_id, spot_id, t, value), absent = no row, or null once made dense.

Windows are partitioned by (stack_id, spot_id), so a chain of them shares one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.operators.ranks import quantiles
from spotframe.operators.spots import range_bucket, ranks_of

SPOT = ["stack_id", "spot_id"]


def by_t() -> W:
    return W.partitionBy(*SPOT).orderBy("t")


def whole() -> W:
    return W.partitionBy(*SPOT)


def spot_table(spots: DataFrame, measure: str = "value") -> DataFrame:
    """Every spot at every frame from 0 to its stack's last, null where it is absent; of rows that repeat a frame the one with the largest value counts."""
    rows = spots.groupBy(*SPOT, "t").agg(F.max(measure).alias("value"))
    stop = rows.groupBy("stack_id").agg(F.max("t").alias("last"))
    grid = rows.select(*SPOT).distinct().join(stop, "stack_id").select(*SPOT, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("t"))
    return grid.join(rows, [*SPOT, "t"], "left")


def pivot_spots(traces: DataFrame) -> DataFrame:
    """Frames x spots of one or more stacks, for export only."""
    return traces.groupBy("stack_id", "t").pivot("spot_id").agg(F.first("value"))


def filter_min_length(traces: DataFrame, minlen: int, renumber: bool = False) -> DataFrame:
    """Spots with ``minlen`` known values or more; ``renumber`` gives them numbers from 0 within their stack."""
    kept = traces.withColumn("_n", F.count("value").over(whole())).filter(F.col("_n") >= minlen).drop("_n")
    return kept.withColumn("spot_id", F.dense_rank().over(W.partitionBy("stack_id").orderBy("spot_id")) - 1) if renumber else kept


def filter_duration(spots: DataFrame, min_len: int) -> DataFrame:
    """Tracks of ``min_len`` rows or more, numbered from 1 in order of their id."""
    kept = spots.withColumn("_n", F.count("*").over(whole())).filter(F.col("_n") >= min_len).drop("_n")
    return kept.withColumn("spot_id", F.dense_rank().over(W.partitionBy("stack_id").orderBy("spot_id")))


def rolling_mean(value: Column, window: int) -> Column:
    """Centred mean of ``window`` frames, null if one is missing or cut off; an even window reaches one further back."""
    frame = by_t().rowsBetween(-(window // 2), (window - 1) // 2)
    return F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))


def derivative(dense: DataFrame, window: int = 5, step: int = 1) -> DataFrame:
    """Adds ``slope``: the rolling mean less the one ``step`` frames before."""
    rows = dense.withColumn("_mean", rolling_mean(F.col("value"), window))
    return rows.withColumn("slope", F.col("_mean") - F.lag("_mean", step).over(by_t())).drop("_mean")


def normalize_trace(traces: DataFrame, how: str = "minmax") -> DataFrame:
    """Each spot's values from 0 to 1, or divided by their mean; null for a constant spot."""
    low, high = F.min("value").over(whole()), F.max("value").over(whole())
    if how == "minmax":
        return traces.withColumn("value", F.try_divide(F.col("value") - low, high - low))
    return traces.withColumn("value", F.try_divide("value", F.avg("value").over(whole())))


def find_rises(dense: DataFrame, window: int, lag: int, low: float, high: float, rise: bool = True, norm: bool = True) -> DataFrame:
    """Triggers (stack_id, spot_id, t): frames whose slope lies within (low, high), or (-high, -low) for falls."""
    rows = derivative(normalize_trace(dense) if norm else dense, window, lag)
    s = F.col("slope") if rise else -F.col("slope")
    return rows.filter((s > low) & (s < high)).select(*SPOT, "t")


def align_traces(traces: DataFrame, triggers: DataFrame, window: int = 11) -> DataFrame:
    """Values at each offset around each trigger, null past the ends or where absent; ``window`` is odd."""
    if window % 2 == 0:
        raise ValueError("window must be odd")
    k = window // 2
    wanted = triggers.select(*SPOT, F.col("t").alias("trigger"), F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("offset"))
    return wanted.withColumn("t", F.col("trigger") + F.col("offset")).join(traces.select(*SPOT, "t", "value"), [*SPOT, "t"], "left").select(*SPOT, "trigger", "offset", "value")


def triggered_average(traces: DataFrame, triggers: DataFrame, window: int = 31) -> DataFrame:
    """Mean and count over all triggers by offset."""
    return align_traces(traces, triggers, window).groupBy("offset").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def runs(traces: DataFrame, minlen: int = 20, buffer: int = 0) -> DataFrame:
    """Runs of ``minlen`` or more successive known values, set one after the other with ``buffer`` places between: adds run and pos.

    Runs of a stack go by spot and first frame; positions are sums over runs, not over rows.
    """
    known = traces.filter("value IS NOT NULL").withColumn("_island", F.col("t") - F.row_number().over(by_t()))
    per = known.groupBy(*SPOT, "_island").agg(F.count("*").alias("n"), F.min("t").alias("first")).filter(F.col("n") >= minlen)
    order = W.partitionBy("stack_id").orderBy("spot_id", "first")
    per = per.withColumn("run", F.row_number().over(order) - 1).withColumn("_base", F.sum(F.col("n") + buffer).over(order) - F.col("n") - buffer)
    return known.join(per, [*SPOT, "_island"]).select(*SPOT, "t", "value", "run", (F.col("_base") + F.col("t") - F.col("first")).alias("pos"))


BLOCK = 1 << 14  # positions of a series that are worked on together


def beside(rows: DataFrame, others: DataFrame, shifts: list[int]) -> DataFrame:
    """``rows`` (stack_id, pos, y) with an array column x: the values of ``others`` (stack_id, pos, x) at pos + shift, null where there is none.

    Series are cut in blocks of positions, and only others near a cut are in two blocks. One exchange serves all shifts: each is a window
    of one place in the same order.
    """
    lo, hi = min(shifts), max(shifts)
    block = lambda c: F.floor(c / BLOCK)
    own = rows.select("stack_id", "pos", block(F.col("pos")).alias("_b"), "y", F.lit(None).cast("double").alias("x"), F.lit(True).alias("_own"))
    near = others.select("stack_id", "pos", F.explode(F.sequence(block(F.col("pos") - hi), block(F.col("pos") - lo))).alias("_b"), F.lit(None).cast("double").alias("y"), "x", F.lit(False).alias("_own"))
    order = W.partitionBy("stack_id", "_b").orderBy("pos")
    at = F.array(*[F.first("x", True).over(order.rangeBetween(k, k)) for k in shifts])
    return own.unionByName(near).withColumn("_at", at).filter("_own").select("stack_id", "pos", "y", F.col("_at").alias("x"))


def per_shift(rows: DataFrame, shifts: list[int], name: str, values: dict) -> DataFrame:
    """(stack_id, name, values) of ``beside``: each value is a function of (y, x) to an aggregate over the rows of a stack; shifts without pairs have no row."""
    aggregates = []
    for i, k in enumerate(shifts):
        x = F.get("x", i)
        both = F.col("y").isNotNull() & x.isNotNull()
        y, x = F.when(both, F.col("y")), F.when(both, x)
        aggregates.append(F.struct(F.lit(k).alias(name), F.count(x).alias("n"), *[f(y, x).alias(c) for c, f in values.items()]).alias(f"_{i}"))
    out = rows.groupBy("stack_id").agg(*aggregates).select("stack_id", F.explode(F.array(*[F.col(f"_{i}") for i in range(len(shifts))])).alias("s"))
    return out.select("stack_id", "s.*").filter("n > 0")


def lag_correlation(dep: DataFrame, indep: DataFrame, nlags: int) -> DataFrame:
    """By lag from -nlags to nlags: n-1 covariance over population deviations, on rows with both values (tables of stack_id, pos, value)."""
    lags = list(range(-nlags, nlags + 1))
    both = beside(dep.select("stack_id", "pos", F.col("value").alias("y")), indep.select("stack_id", "pos", F.col("value").alias("x")), [-k for k in lags])
    out = per_shift(both, [-k for k in lags], "shift", {"correlation": lambda y, x: F.try_divide(F.covar_samp(y, x), F.stddev_pop(y) * F.stddev_pop(x))})
    return out.select("stack_id", (-F.col("shift")).alias("lag"), "correlation", "n")


def cross_correlation(a: DataFrame, b: DataFrame, nlags: int) -> DataFrame:
    """Sum of demeaned products at lags 0..nlags over the root of both sums of squares, by stack; with b = a the autocorrelation."""

    def centred(df, name):
        mean = df.groupBy("stack_id").agg(F.avg("value").alias("_m"))
        return df.select("stack_id", "pos", "value").join(mean, "stack_id").select("stack_id", "pos", (F.col("value") - F.col("_m")).alias(name))

    x, y = centred(a, "x"), centred(b, "y")
    square = lambda df, c, name: df.groupBy("stack_id").agg(F.sum(F.col(c) * F.col(c)).alias(name))
    scale = square(x, "x", "xx").join(square(y, "y", "yy"), "stack_id")
    sums = per_shift(beside(y, x, list(range(nlags + 1))), list(range(nlags + 1)), "lag", {"s": lambda y, x: F.sum(y * x)})
    return sums.join(scale, "stack_id").select("stack_id", "lag", F.try_divide("s", F.sqrt(F.col("xx") * F.col("yy"))).alias("r"))


def partial_autocorrelation(acf: list[float]) -> list[float]:
    """Durbin-Levinson on autocorrelations from lag 0; ``acf`` is a short list."""
    out, phi = [1.0], []
    for k in range(1, len(acf)):
        top = acf[k] - sum(p * acf[k - 1 - j] for j, p in enumerate(phi))
        last = top / (1 - sum(p * acf[j + 1] for j, p in enumerate(phi)))
        phi = [p - last * q for p, q in zip(phi, phi[::-1], strict=True)] + [last]
        out.append(last)
    return out


def lagged(series: DataFrame, lags: int) -> DataFrame:
    """Adds _lags: an array of the values of the ``lags`` rows before, nearest first, null where there are none.

    Series are cut in blocks of positions. Only the last rows of a block (one row a block) are ordered over the whole stack.
    """
    rows = series.withColumn("_b", F.floor(F.col("pos") / BLOCK))
    order = W.partitionBy("stack_id", "_b").orderBy("pos")
    last = rows.withColumn("_back", F.row_number().over(W.partitionBy("stack_id", "_b").orderBy(F.desc("pos")))).filter(F.col("_back") <= lags)
    tails = last.groupBy("stack_id", "_b").agg(F.array_sort(F.collect_list(F.struct("_back", "value"))).alias("_tail"))
    before = W.partitionBy("stack_id").orderBy("_b")
    # each block has a row at least, so as many blocks as lags hold enough
    carried = F.concat(*[F.coalesce(F.lag("_tail", k).over(before), F.array().cast(tails.schema["_tail"].dataType)) for k in range(1, lags + 1)])
    heads = tails.select("stack_id", "_b", carried.alias("_before"))
    n = F.row_number().over(order)
    inside = [F.lag("value", k).over(order) for k in range(1, lags + 1)]
    rows = rows.withColumn("_n", n).withColumn("_in", F.array(*inside)).join(heads, ["stack_id", "_b"])
    own = lambda k: F.when(F.col("_n") > k, F.get("_in", k - 1)).otherwise(F.get("_before", (F.lit(k) - F.col("_n")).cast("int"))["value"])
    return rows.withColumn("_lags", F.array(*[own(k) for k in range(1, lags + 1)])).drop("_b", "_n", "_in", "_before")


def prewhiten(series: DataFrame, const: float, coefs: list[float]) -> DataFrame:
    """Adds the residual of an autoregression; lags that are missing add nothing."""
    guess = F.lit(const)
    for k, c in enumerate(coefs):
        guess = guess + F.coalesce(F.get("_lags", k) * c, F.lit(0.0))
    return lagged(series, len(coefs)).withColumn("residual", F.col("value") - guess).drop("_lags")


def fit_ar2(series: DataFrame) -> tuple[float, float, float]:
    """Constant and two coefficients by least squares over all stacks; sums on Spark, a 3 x 3 solve on the driver."""
    import numpy as np

    rows = lagged(series, 2).select("value", F.get("_lags", 0).alias("a"), F.get("_lags", 1).alias("b")).dropna()
    x, names = {"1": F.lit(1.0), "a": F.col("a"), "b": F.col("b")}, ["1", "a", "b"]
    r = rows.agg(*[F.sum(x[i] * x[j]).alias(f"{i}{j}") for i in names for j in names], *[F.sum(x[i] * F.col("value")).alias(f"{i}y") for i in names]).first()
    return tuple(np.linalg.solve(np.array([[r[f"{i}{j}"] for j in names] for i in names], dtype=float), np.array([r[f"{i}y"] for i in names], dtype=float)).tolist())


def padded_cross_correlation(a: DataFrame, b: DataFrame, spread: int = 20) -> DataFrame:
    """Sums of products at offsets -spread..spread of two series (stack_id, pos, value; null = 0) over those of ones, scaled by the largest."""
    value = F.coalesce("value", F.lit(0.0))
    offsets = list(range(-spread, spread + 1))
    both = beside(a.select("stack_id", "pos", value.alias("y")), b.select("stack_id", "pos", value.alias("x")), offsets)
    sums = per_shift(both, offsets, "offset", {"r": lambda y, x: F.sum(y * x) / F.count(x)})
    return sums.select("stack_id", "offset", F.try_divide("r", F.max("r").over(W.partitionBy("stack_id"))).alias("r"))


def trim_and_interpolate(dense: DataFrame, reach: int = 9) -> DataFrame:
    """Drops nulls at both ends and fills inner ones with the mean of the value before (filled ones count) and the next known.

    A gap whose next known value is further than ``reach`` frames away is an error.
    """
    ahead = by_t().rowsBetween(0, W.unboundedFollowing)
    back = by_t().rowsBetween(W.unboundedPreceding, 0)
    known = F.col("value").isNotNull()
    rows = dense.withColumn("next", F.first("value", True).over(ahead)).withColumn("last", F.last("value", True).over(back)).filter("next IS NOT NULL AND last IS NOT NULL")
    rows = rows.withColumn("_next_t", F.first(F.when(known, F.col("t")), True).over(ahead)).withColumn("_k", F.col("t") - F.last(F.when(known, F.col("t")), True).over(back))
    # after k halvings of the distance to the next value, what is left of it is 2 ** -k
    filled = F.col("next") + (F.col("last") - F.col("next")) * F.pow(F.lit(0.5), F.col("_k"))
    checked = F.when(F.col("_next_t") - F.col("t") > reach, F.raise_error(F.lit("a gap reaches further than allowed")).cast("double")).otherwise(filled)
    return rows.withColumn("value", F.when(known, F.col("value")).otherwise(checked)).select(*SPOT, "t", "value")


def state_changes(states: DataFrame) -> DataFrame:
    """Frames where a 0/1 state starts (1) or ends (-1)."""
    return states.withColumn("change", F.col("state") - F.lag("state").over(by_t())).filter("change <> 0").select(*SPOT, "t", "change")


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def smooth(dense: DataFrame, sigma: float, keys: list[str] = SPOT) -> DataFrame:
    """Gaussian smoothing along t, the ends mirrored with the edge value repeated; null if a value is missing within reach.

    A series, with a row for every frame, is brought together once, as an array (a movie has a bounded number of frames); the mirror
    image of a frame is taken modulo twice the length.
    """
    weights = gaussian_weights(sigma)
    radius, lit = len(weights) // 2, F.array(*map(F.lit, weights))
    per = dense.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s")).select(*keys, F.col("s.t").alias("t"), F.col("s.value").alias("v"))
    n = F.size("v")

    def around(i):
        at = lambda j: F.pmod(i + j - radius, 2 * n)
        term = lambda w, j: w * F.get(F.col("v"), F.when(at(j) < n, at(j)).otherwise(2 * n - 1 - at(j)))
        return F.aggregate(F.transform(lit, term), F.lit(0.0), lambda total, x: total + x)

    rows = per.select(*keys, F.explode(F.arrays_zip("t", F.transform(F.sequence(F.lit(0), n - 1), around).alias("value"))).alias("r"))
    return rows.select(*keys, F.col("r.t").alias("t"), F.col("r.value").alias("value"))


def peaks_above(dense: DataFrame, threshold: float) -> DataFrame:
    """Of each run of values at or above the threshold, the first frame of its maximum."""
    high = dense.filter(F.col("value") >= threshold).withColumn("_island", F.col("t") - F.row_number().over(by_t()))
    best = F.row_number().over(W.partitionBy(*SPOT, "_island").orderBy(F.desc("value"), "t"))
    return high.withColumn("_r", best).filter("_r = 1").select(*SPOT, "t", "value")


def normalize_percentiles(traces: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(v - p5) / (p95 - p5) over each stack's values."""
    cuts = quantiles(traces, ["stack_id"], "value", [low, high]).select("stack_id", F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    return traces.join(cuts, "stack_id").withColumn("value", F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def number_spots(traces: DataFrame) -> DataFrame:
    """(stack_id, spot_id, new_id), from 0 by stack and spot: ranks within stacks plus the spots of the stacks before (one row a stack)."""
    spots = traces.select(*SPOT).distinct()
    per = spots.groupBy("stack_id").agg(F.count("*").alias("_n"))
    base = per.withColumn("_base", F.sum("_n").over(W.orderBy("stack_id")) - F.col("_n")).drop("_n")
    ranked = spots.withColumn("_r", F.row_number().over(W.partitionBy("stack_id").orderBy("spot_id")) - 1)
    return ranked.join(base, "stack_id").select(*SPOT, (F.col("_base") + F.col("_r")).alias("new_id"))


def combine_spots(traces: DataFrame) -> DataFrame:
    """Tracks of several sets in one table, later sets with the numbers that follow."""
    return traces.join(number_spots(traces), SPOT).select("new_id", "t", "value")


def concat_right(traces: DataFrame) -> DataFrame:
    """All stacks in one table with their last frames together and new spot numbers (0.. by stack and spot)."""
    ends = traces.groupBy("stack_id").agg(F.max("t").alias("_end"))
    last = ends.agg(F.max("_end").alias("_last"))
    return traces.join(ends, "stack_id").crossJoin(F.broadcast(last)).join(number_spots(traces), SPOT).select("new_id", (F.col("t") + F.col("_last") - F.col("_end")).alias("t"), "value")


def fill_minimum(dense: DataFrame, minlen: int) -> DataFrame:
    """Spots with more than ``minlen`` known values, null filled with the least value of all that stay."""
    kept = filter_min_length(dense, minlen + 1)
    return kept.crossJoin(F.broadcast(kept.agg(F.min("value").alias("_low")))).withColumn("value", F.coalesce("value", "_low")).drop("_low")


def nearest_known(spots: DataFrame, missing: DataFrame) -> DataFrame:
    """For each (stack_id, spot_id, t) of ``missing`` the spot's row with the nearest frame, the earlier of two."""
    rows = missing.select(*SPOT, F.col("t").alias("wanted")).join(spots, SPOT)
    first = F.row_number().over(W.partitionBy(*SPOT, "wanted").orderBy(F.abs(F.col("t") - F.col("wanted")), "t"))
    return rows.withColumn("_r", first).filter("_r = 1").drop("_r")


def rolling_by_score(scores: DataFrame, column: str, window: int = 20) -> DataFrame:
    """Mean of a column over the last ``window`` rows in order of (score, sim_id), null before there are as many.

    Rows have places in that order (ranks in buckets of the score's range), and blocks of places are tasks of their own: each has the
    ``window - 1`` rows before it too.
    """
    places = ranks_of(scores, [F.col("score"), F.col("sim_id")], range_bucket(scores, "score"), "_place")
    size = max(1 << 16, window)
    own = F.floor((F.col("_place") - 1) / size)
    last = F.floor((F.col("_place") - 1 + window - 1) / size)
    rows = places.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, last)))
    frame = W.partitionBy("_block").orderBy("_place").rowsBetween(-(window - 1), 0)
    rows = rows.withColumn("rolling", F.when(F.count(column).over(frame) == window, F.avg(column).over(frame)))
    return rows.filter("_block = _own").select(*scores.columns, "rolling")


def mean_std_over_time(traces: DataFrame, minlen: int) -> DataFrame:
    """Mean, population deviation and count by frame, over spots long enough."""
    return filter_min_length(traces, minlen).groupBy("stack_id", "t").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def spot_means(traces: DataFrame) -> DataFrame:
    return traces.groupBy(*SPOT).agg(F.avg("value").alias("mean"))


def frame_means(traces: DataFrame) -> DataFrame:
    return traces.groupBy("stack_id", "t").agg(F.avg("value").alias("mean"))


def bleach_by_frame_mean(traces: DataFrame, means: DataFrame, sigma: float = 10.0) -> DataFrame:
    """Values divided by the smoothed frame mean relative to its first frame; ``means`` has stack_id, t, mean for every frame."""
    level = smooth(means.withColumnRenamed("mean", "value"), sigma, ["stack_id"])
    level = level.withColumn("factor", F.col("value") / F.first("value").over(W.partitionBy("stack_id").orderBy("t"))).select("stack_id", "t", "factor")
    return traces.join(level, ["stack_id", "t"], "left").withColumn("value", F.col("value") / F.col("factor")).drop("factor")


def shuffle_spots(traces: DataFrame, seed: int) -> DataFrame:
    """One random order of spots: adds place, from 0 in each stack; equal for all tables with the same seed."""
    order = traces.select(*SPOT).distinct().withColumn("place", F.row_number().over(W.partitionBy("stack_id").orderBy(F.md5(F.concat_ws("_", F.col("spot_id").cast("string"), F.lit(str(seed)))), "spot_id")) - 1)
    return traces.join(order, SPOT)
