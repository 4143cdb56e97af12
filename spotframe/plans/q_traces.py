"""Queries over traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.operators import traces as tr
from spotframe.plans import tables as tb
from spotframe.plans.registry import query
from spotframe.plans.tables import with_tables


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


def dense(spark, sf):
    return tr.spot_table(tb.traces(spark, sf))


@query("w1_spot_table", with_tables("dense") + " SELECT stack_id, spot_id, t, value FROM dense")
def _(spark, sf):
    return dense(spark, sf).select("stack_id", "spot_id", "t", "value")


@query("w2_min_length", with_tables("traces") + """ SELECT stack_id, dense_rank() OVER (PARTITION BY stack_id ORDER BY spot_id) - 1 AS spot_id, t, value
  FROM (SELECT *, count(value) OVER (PARTITION BY stack_id, spot_id) AS n FROM traces) WHERE n >= 25""")
def _(spark, sf):
    return tr.filter_min_length(tb.traces(spark, sf), 25, True).select("stack_id", F.col("spot_id").cast("long").alias("spot_id"), "t", "value")


@query("w3_min_duration", with_tables("traces") + """ SELECT stack_id, dense_rank() OVER (PARTITION BY stack_id ORDER BY spot_id) AS spot_id, t, value
  FROM (SELECT *, count(*) OVER (PARTITION BY stack_id, spot_id) AS n FROM traces) WHERE n >= 27""")
def _(spark, sf):
    return tr.filter_duration(tb.traces(spark, sf), 27).select("stack_id", F.col("spot_id").cast("long").alias("spot_id"), "t", "value")


SLOPE = """, rolled AS (SELECT *, CASE WHEN count(value) OVER w = 4 THEN avg(value) OVER w END AS m FROM {source}
  WINDOW w AS (PARTITION BY stack_id, spot_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)),
slopes AS (SELECT *, m - lag(m, 2) OVER (PARTITION BY stack_id, spot_id ORDER BY t) AS slope FROM rolled)"""


@query("w4_derivative", with_tables("dense") + SLOPE.format(source="dense") + " SELECT stack_id, spot_id, t, round(slope, 6) AS slope FROM slopes")
def _(spark, sf):
    return tr.derivative(dense(spark, sf), 4, 2).select("stack_id", "spot_id", "t", r6("slope"))


NORMED = """, normed AS (SELECT stack_id, spot_id, t, (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) AS value FROM dense
  WINDOW w AS (PARTITION BY stack_id, spot_id))"""


@query("w5_rises", with_tables("dense") + NORMED + SLOPE.format(source="normed") + " SELECT stack_id, spot_id, t FROM slopes WHERE slope > 0.1 AND slope < 0.5")
def _(spark, sf):
    return tr.find_rises(dense(spark, sf), 4, 2, 0.1, 0.5)


@query("w5_falls", with_tables("dense") + NORMED + SLOPE.format(source="normed") + " SELECT stack_id, spot_id, t FROM slopes WHERE -slope > 0.1 AND -slope < 0.5")
def _(spark, sf):
    return tr.find_rises(dense(spark, sf), 4, 2, 0.1, 0.5, rise=False)


TRIGGERS = NORMED + SLOPE.format(source="normed") + """, triggers AS (SELECT stack_id, spot_id, t FROM slopes WHERE slope > 0.1 AND slope < 0.5),
aligned AS (SELECT g.stack_id, g.spot_id, g.t AS trigger, CAST(g.o AS INTEGER) AS "offset", v.value FROM (SELECT *, unnest(range(-5, 6)) AS o FROM triggers) g
  LEFT JOIN traces v ON v.stack_id = g.stack_id AND v.spot_id = g.spot_id AND v.t = g.t + g.o)"""


@query("j12_align", with_tables("dense") + TRIGGERS + ' SELECT stack_id, spot_id, trigger, "offset", value FROM aligned')
def _(spark, sf):
    return tr.align_traces(tb.traces(spark, sf), tr.find_rises(dense(spark, sf), 4, 2, 0.1, 0.5), 11)


@query("w6_triggered_average", with_tables("dense") + TRIGGERS + ' SELECT "offset", round(avg(value), 6) AS mean, count(value) AS n FROM aligned GROUP BY 1')
def triggered(spark, sf):
    out = tr.triggered_average(tb.traces(spark, sf), tr.find_rises(dense(spark, sf), 4, 2, 0.1, 0.5), 11)
    return out.select("offset", r6("mean"), "n")


RUNS = """, isl AS (SELECT *, t - row_number() OVER (PARTITION BY stack_id, spot_id ORDER BY t) AS island FROM traces),
per AS (SELECT stack_id, spot_id, island, count(*) AS n, min(t) AS first FROM isl GROUP BY 1, 2, 3 HAVING count(*) >= 6),
placed AS (SELECT *, row_number() OVER w - 1 AS run, sum(n + 3) OVER w - n - 3 AS base FROM per WINDOW w AS (PARTITION BY stack_id ORDER BY spot_id, first)),
runs AS (SELECT i.stack_id, i.spot_id, i.t, i.value, p.run, CAST(p.base + i.t - p.first AS BIGINT) AS pos FROM isl i JOIN placed p USING (stack_id, spot_id, island))"""


def runs_of(spark, sf):
    return tr.runs(tb.traces(spark, sf), 6, 3)


@query("w7_runs", with_tables("traces") + RUNS + " SELECT stack_id, spot_id, t, value, run, pos FROM runs")
def _(spark, sf):
    return runs_of(spark, sf).select("stack_id", "spot_id", "t", "value", F.col("run").cast("long").alias("run"), "pos")


def second_of(spark, sf):
    """Channel 2 at the positions of the runs of channel 1."""
    return runs_of(spark, sf).drop("value").join(tb.traces(spark, sf, 2), ["stack_id", "spot_id", "t"])


@query("w8_lag_correlation", with_tables("traces", "traces2") + RUNS + """, two AS (SELECT r.stack_id, r.pos, s.value FROM runs r JOIN traces2 s USING (stack_id, spot_id, t)),
shifted AS (SELECT stack_id, value AS x, pos, unnest(range(-4, 5)) AS lag FROM two)
SELECT s.stack_id, CAST(s.lag AS INTEGER) AS lag, round(covar_samp(r.value, x) / (stddev_pop(r.value) * stddev_pop(x)), 6) AS correlation, count(*) AS n
FROM shifted s JOIN runs r ON r.stack_id = s.stack_id AND r.pos = s.pos + s.lag GROUP BY 1, 2""")
def _(spark, sf):
    return tr.lag_correlation(runs_of(spark, sf), second_of(spark, sf), 4).select("stack_id", "lag", r6("correlation"), "n")


@query("w9_autocorrelation", with_tables("traces") + RUNS + """, d AS (SELECT stack_id, pos, value - avg(value) OVER (PARTITION BY stack_id) AS d FROM runs),
late AS (SELECT stack_id, pos, d AS e, unnest(range(0, 6)) AS lag FROM d)
SELECT a.stack_id, CAST(a.lag AS INTEGER) AS lag, round(sum(b.d * a.e) / any_value(q.s), 6) AS r FROM late a JOIN d b ON b.stack_id = a.stack_id AND b.pos = a.pos - a.lag
JOIN (SELECT stack_id, sum(d * d) AS s FROM d GROUP BY 1) q ON q.stack_id = a.stack_id GROUP BY 1, 2""")
def _(spark, sf):
    x = runs_of(spark, sf)
    return tr.cross_correlation(x, x, 5).select("stack_id", "lag", r6("r"))


@query("w10_prewhiten", with_tables("traces") + RUNS + """ SELECT stack_id, pos, round(value - (2.5 + coalesce(lag(value, 1) OVER w * 0.4, 0) + coalesce(lag(value, 2) OVER w * -0.2, 0)), 6) AS residual
FROM runs WINDOW w AS (PARTITION BY stack_id ORDER BY pos)""")
def _(spark, sf):
    return tr.prewhiten(runs_of(spark, sf), 2.5, [0.4, -0.2]).select("stack_id", "pos", r6("residual"))


@query("w11_padded_cross_correlation", with_tables("traces", "traces2") + RUNS + """, two AS (SELECT r.stack_id, r.pos, s.value FROM runs r JOIN traces2 s USING (stack_id, spot_id, t)),
sums AS (SELECT y.stack_id, y.o AS "offset", sum(x.value * y.value) / count(*) AS r FROM (SELECT stack_id, value, pos, unnest(range(-6, 7)) AS o FROM two) y
  JOIN runs x ON x.stack_id = y.stack_id AND x.pos = y.pos - y.o GROUP BY 1, 2)
SELECT stack_id, CAST("offset" AS INTEGER) AS "offset", round(r / max(r) OVER (PARTITION BY stack_id), 6) AS r FROM sums""")
def _(spark, sf):
    return tr.padded_cross_correlation(runs_of(spark, sf), second_of(spark, sf), 6).select("stack_id", "offset", r6("r"))


@query("w12_interpolate", with_tables("dense") + """, k AS (SELECT *, first_value(value IGNORE NULLS) OVER (PARTITION BY stack_id, spot_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next, last_value(value IGNORE NULLS) OVER w AS last,
  t - last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w AS k FROM dense WINDOW w AS (PARTITION BY stack_id, spot_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT stack_id, spot_id, t, round(coalesce(value, next + (last - next) * power(0.5, k)), 6) AS value FROM k WHERE next IS NOT NULL AND last IS NOT NULL""")
def _(spark, sf):
    return tr.trim_and_interpolate(dense(spark, sf), 30).select("stack_id", "spot_id", "t", r6("value"))


STATES = ", states AS (SELECT stack_id, spot_id, t, CAST(value > 2000 AS INTEGER) AS state FROM traces)"


@query("w14_state_changes", with_tables("traces") + STATES + """ SELECT stack_id, spot_id, t, change FROM (
  SELECT *, state - lag(state) OVER (PARTITION BY stack_id, spot_id ORDER BY t) AS change FROM states) WHERE change <> 0""")
def _(spark, sf):
    return tr.state_changes(tb.traces(spark, sf).withColumn("state", (F.col("value") > 2000).cast("int")))


@query("w15_peaks", with_tables("traces") + """, high AS (SELECT *, t - row_number() OVER (PARTITION BY stack_id, spot_id ORDER BY t) AS island FROM traces WHERE value >= 3000)
SELECT stack_id, spot_id, t, value FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, spot_id, island ORDER BY value DESC, t) AS r FROM high) WHERE r = 1""")
def _(spark, sf):
    return tr.peaks_above(tb.traces(spark, sf), 3000.0)


WEIGHTS = ", ".join(f"({k - 4}, {w!r})" for k, w in enumerate(tr.gaussian_weights(1.0)))
SMOOTH = f""", zero AS (SELECT stack_id, spot_id, t, coalesce(value, 0) AS value FROM dense),
size AS (SELECT stack_id, max(t) + 1 AS n FROM dense GROUP BY 1), weights(o, w) AS (VALUES {WEIGHTS}),
wanted AS (SELECT z.stack_id, z.spot_id, z.t, w.w, ((z.t + w.o) % (2 * s.n) + 2 * s.n) % (2 * s.n) AS a, s.n FROM zero z JOIN size s USING (stack_id), weights w),
smooth AS (SELECT q.stack_id, q.spot_id, q.t, sum(q.w * v.value) AS value FROM wanted q
  JOIN zero v ON v.stack_id = q.stack_id AND v.spot_id = q.spot_id AND v.t = CASE WHEN q.a < q.n THEN q.a ELSE 2 * q.n - 1 - q.a END GROUP BY 1, 2, 3)"""


@query("w16_smooth", with_tables("dense") + SMOOTH + " SELECT stack_id, spot_id, t, round(value, 5) AS value FROM smooth")
def _(spark, sf):
    return tr.smooth(dense(spark, sf).fillna(0.0, ["value"]), 1.0).select("stack_id", "spot_id", "t", F.round("value", 5).alias("value"))


FRAME_LEVEL = f""", means AS (SELECT stack_id, t, avg(value) AS value FROM traces GROUP BY 1, 2), size AS (SELECT stack_id, max(t) + 1 AS n FROM means GROUP BY 1),
weights(o, w) AS (VALUES {WEIGHTS}), wanted AS (SELECT z.stack_id, z.t, w.w, ((z.t + w.o) % (2 * s.n) + 2 * s.n) % (2 * s.n) AS a, s.n FROM means z JOIN size s USING (stack_id), weights w),
level AS (SELECT q.stack_id, q.t, sum(q.w * v.value) AS value FROM wanted q JOIN means v ON v.stack_id = q.stack_id AND v.t = CASE WHEN q.a < q.n THEN q.a ELSE 2 * q.n - 1 - q.a END GROUP BY 1, 2),
factor AS (SELECT stack_id, t, value / first_value(value) OVER (PARTITION BY stack_id ORDER BY t) AS factor FROM level)"""


@query("w17_bleach_by_frame_mean", with_tables("traces") + FRAME_LEVEL + " SELECT v.stack_id, spot_id, v.t, round(value / factor, 5) AS value FROM traces v LEFT JOIN factor f ON f.stack_id = v.stack_id AND f.t = v.t")
def _(spark, sf):
    x = tb.traces(spark, sf)
    return tr.bleach_by_frame_mean(x, tr.frame_means(x), 1.0).select("stack_id", "spot_id", "t", F.round("value", 5).alias("value"))


@query("w18_normalize_minmax", with_tables("dense") + NORMED + " SELECT stack_id, spot_id, t, round(value, 6) AS value FROM normed")
def _(spark, sf):
    return tr.normalize_trace(dense(spark, sf)).select("stack_id", "spot_id", "t", r6("value"))


@query("w18_normalize_mean", with_tables("traces") + " SELECT stack_id, spot_id, t, round(value / avg(value) OVER (PARTITION BY stack_id, spot_id), 6) AS value FROM traces")
def _(spark, sf):
    return tr.normalize_trace(tb.traces(spark, sf), "mean").select("stack_id", "spot_id", "t", r6("value"))


@query("w19_concat_right", with_tables("traces") + """, ends AS (SELECT stack_id, max(t) AS e FROM traces GROUP BY 1)
SELECT dense_rank() OVER (ORDER BY v.stack_id, v.spot_id) - 1 AS new_id, v.t + (SELECT max(e) FROM ends) - e AS t, value FROM traces v JOIN ends USING (stack_id)""")
def _(spark, sf):
    return tr.concat_right(tb.traces(spark, sf)).withColumn("new_id", F.col("new_id").cast("long"))


@query("w20_fill_minimum", with_tables("dense") + """, kept AS (SELECT * FROM (SELECT *, count(value) OVER (PARTITION BY stack_id, spot_id) AS n FROM dense) WHERE n > 25)
SELECT stack_id, spot_id, t, coalesce(value, (SELECT min(value) FROM kept)) AS value FROM kept""")
def _(spark, sf):
    return tr.fill_minimum(dense(spark, sf), 25).select("stack_id", "spot_id", "t", "value")


@query("w21_nearest_known", with_tables("dense") + """ SELECT stack_id, spot_id, wanted, t, value FROM (
  SELECT m.stack_id, m.spot_id, m.t AS wanted, v.t, v.value, row_number() OVER (PARTITION BY m.stack_id, m.spot_id, m.t ORDER BY abs(v.t - m.t), v.t) AS r
  FROM dense m JOIN traces v ON v.stack_id = m.stack_id AND v.spot_id = m.spot_id WHERE m.value IS NULL) WHERE r = 1""")
def _(spark, sf):
    return tr.nearest_known(tb.traces(spark, sf), dense(spark, sf).filter("value IS NULL")).select("stack_id", "spot_id", "wanted", "t", "value")


@query("w22_rolling_by_score", """ SELECT sim_id, score, round(CASE WHEN count(*) OVER w = 20 THEN avg(p) OVER w END, 6) AS rolling FROM (
  SELECT p_partkey AS sim_id, p_retailprice AS score, p_size AS p FROM part) WINDOW w AS (ORDER BY score, sim_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    scores = tb.read(spark, sf, "part").select(F.col("p_partkey").alias("sim_id"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("p"))
    return tr.rolling_by_score(scores, "p").select("sim_id", "score", r6("rolling"))


@query("w23_shuffle_spots", with_tables("traces") + """, o AS (SELECT stack_id, spot_id, row_number() OVER (PARTITION BY stack_id ORDER BY md5(spot_id || '_5'), spot_id) - 1 AS place FROM (SELECT DISTINCT stack_id, spot_id FROM traces))
SELECT stack_id, spot_id, t, value, place FROM traces JOIN o USING (stack_id, spot_id)""")
def _(spark, sf):
    return tr.shuffle_spots(tb.traces(spark, sf), 5).select("stack_id", "spot_id", "t", "value", F.col("place").cast("long").alias("place"))


@query("g38_normalize_p5_p95", with_tables("traces") + """, cuts AS (SELECT stack_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM traces GROUP BY 1)
SELECT stack_id, spot_id, t, round((value - lo) / (hi - lo), 6) AS value FROM traces JOIN cuts USING (stack_id)""")
def _(spark, sf):
    return tr.normalize_percentiles(tb.traces(spark, sf)).select("stack_id", "spot_id", "t", r6("value"))


@query("g40_mean_std_over_time", with_tables("traces") + """ SELECT stack_id, t, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n
  FROM (SELECT *, count(value) OVER (PARTITION BY stack_id, spot_id) AS c FROM traces) WHERE c >= 25 GROUP BY 1, 2""")
def _(spark, sf):
    return tr.mean_std_over_time(tb.traces(spark, sf), 25).select("stack_id", "t", r6("mean"), r6("std"), "n")


@query("g41_spot_means", with_tables("traces") + " SELECT stack_id, spot_id, round(avg(value), 6) AS mean FROM traces GROUP BY 1, 2")
def _(spark, sf):
    return tr.spot_means(tb.traces(spark, sf)).select("stack_id", "spot_id", r6("mean"))


@query("g41_frame_means", with_tables("traces") + " SELECT stack_id, t, round(avg(value), 6) AS mean FROM traces GROUP BY 1, 2")
def _(spark, sf):
    return tr.frame_means(tb.traces(spark, sf)).select("stack_id", "t", r6("mean"))


@query("u2_combine_spots", with_tables("traces") + """ SELECT dense_rank() OVER (ORDER BY stack_id, spot_id) - 1 AS spot, t, value FROM traces""")
def _(spark, sf):
    return tr.combine_spots(tb.traces(spark, sf)).select(F.col("new_id").alias("spot"), "t", "value")
