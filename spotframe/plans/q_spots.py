"""Queries over fits, spots, movies and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.functions import scalar as sc
from spotframe.operators import spots as sp
from spotframe.plans import tables as tb
from spotframe.plans.registry import query
from spotframe.plans.tables import with_tables

FIT = "stack_id, t, fit_no, z, x, y, height"
FITS = ["stack_id", "t", "fit_no", "z", "x", "y", "height"]


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


@query("p1_filter_fits", with_tables("fits") + f""" SELECT {FIT} FROM fits JOIN (SELECT stack_id, t, median(height) AS m FROM fits GROUP BY 1, 2) USING (stack_id, t)
  WHERE ln(height / ((width_x + width_y) / 2)) > 10.5 AND height > m""")
def _(spark, sf):
    f = tb.fits(spark, sf)
    return sp.filter_fits(f, 10.5, sp.frame_stats(f, "height").select("stack_id", "t", "median")).select(FITS)


@query("p16_filter_by_stats", with_tables("fits") + f""" SELECT {FIT} FROM fits JOIN (SELECT stack_id, t, avg(height) AS m, stddev_pop(height) AS s FROM fits GROUP BY 1, 2) USING (stack_id, t)
  WHERE height >= m + s AND (width_x + width_y) / 2 < 4""")
def _(spark, sf):
    f = tb.fits(spark, sf)
    return sp.filter_fits_by_stats(f, sp.frame_stats(f, "height"), 1.0, 4.0).select(FITS)


@query("p15_score_filter", with_tables("fits") + f" SELECT {FIT} FROM fits WHERE log2(width_z * 256 / width_x) >= 8.1")
def _(spark, sf):
    return sp.score_filter(tb.fits(spark, sf), 8.1).select(FITS)


@query("p14_clamp", with_tables("fits") + " SELECT fit_no, greatest(least(x, 50), 20) AS x FROM fits")
def _(spark, sf):
    return tb.fits(spark, sf).select("fit_no", sc.clamp(F.col("x"), 20.0, 50.0).alias("x"))


@query("p7_curation", with_tables("traces") + """, spots AS (SELECT stack_id, spot_id, t, spot_id % 5 + t // 10 AS nuc_id, value FROM traces)
SELECT stack_id, spot_id, t, nuc_id, value FROM spots WHERE NOT (t % 7 = 3) UNION ALL
SELECT stack_id, spot_id, t + 100, (SELECT arg_min(nuc_id, q.t) FROM spots q WHERE q.stack_id = s.stack_id AND q.spot_id = s.spot_id), -1.0 FROM spots s WHERE t % 11 = 4""")
def _(spark, sf):
    spots = tb.traces(spark, sf).select("stack_id", "spot_id", "t", (F.col("spot_id") % 5 + F.floor(F.col("t") / 10)).alias("nuc_id"), "value")
    new = spots.filter("t % 11 = 4").select("stack_id", "spot_id", (F.col("t") + 100).alias("t"), F.lit(-1.0).alias("value"))
    return sp.apply_curation(spots, spots.filter("t % 7 = 3"), new)


FRAMES = """, n AS (SELECT stack_id, max(t) + 1 AS n FROM fits GROUP BY 1), seg AS (SELECT *, lead(start_frame) OVER (PARTITION BY stack_id ORDER BY start_frame) AS stop FROM segments),
frames AS (SELECT s.stack_id, CAST(f.t AS INTEGER) AS t, s.start_pos - (m.surface_before + f.t * (m.surface_after - m.surface_before) / n.n) AS start
  FROM seg s JOIN movies m USING (stack_id) JOIN n USING (stack_id) JOIN (SELECT unnest(range(0, 200)) AS t) f ON f.t >= s.start_frame AND f.t < coalesce(s.stop, n.n) AND f.t < n.n)"""


@query("j5_start_per_frame", with_tables("fits", "movies", "segments") + FRAMES + " SELECT stack_id, t, round(start, 6) AS start FROM frames")
def _(spark, sf):
    n = tb.fits(spark, sf).groupBy("stack_id").agg((F.max("t") + 1).alias("n"))
    return sp.start_per_frame(tb.movies(spark, sf), tb.segments(spark, sf), n).select("stack_id", "t", r6("start"))


def deep(spark, sf):
    return sp.add_depth(tb.fits(spark, sf), tb.movies(spark, sf), tb.segments(spark, sf))


DEEP = FRAMES + ", deep AS (SELECT f.*, start + z * z_interval AS depth FROM fits f JOIN frames USING (stack_id, t) JOIN movies USING (stack_id))"


@query("j6_depth", with_tables("fits", "movies", "segments") + DEEP + " SELECT fit_no, round(depth, 6) AS depth FROM deep")
def _(spark, sf):
    return deep(spark, sf).select("fit_no", r6("depth"))


@query("g12_mean_depth", with_tables("fits", "movies", "segments") + DEEP + " SELECT CAST(trunc(avg(depth)) AS INTEGER) AS depth FROM deep")
def _(spark, sf):
    return sp.mean_depth(deep(spark, sf))


@query("j7_focus_shift", with_tables("fits", "segments") + """, s AS (SELECT stack_id, start_frame, sum(z_corr) OVER w AS shift, lead(start_frame) OVER w AS stop FROM segments WINDOW w AS (PARTITION BY stack_id ORDER BY start_frame))
SELECT f.fit_no, CAST(f.z + coalesce(s.shift, 0) AS DOUBLE) AS z FROM fits f LEFT JOIN s ON f.stack_id = s.stack_id AND f.t >= s.start_frame AND (s.stop IS NULL OR f.t < s.stop)""")
def _(spark, sf):
    return sp.focus_shift(tb.fits(spark, sf), tb.segments(spark, sf)).select("fit_no", "z")


@query("j4_divide_by_frame", with_tables("fits") + " SELECT fit_no, round(height / m, 6) AS height FROM fits JOIN (SELECT stack_id, t, avg(height) AS m FROM fits GROUP BY 1, 2) USING (stack_id, t)")
def _(spark, sf):
    f = tb.fits(spark, sf)
    return sp.divide_by_frame(f, sp.frame_stats(f, "height").withColumnRenamed("mean", "factor"), ["height"]).select("fit_no", r6("height"))


GRID = "grid AS (SELECT CAST(d AS INTEGER) AS depth_bin, CAST(i AS INTEGER) AS intensity_bin, 50.0 + i AS a, CASE WHEN i < 1500 THEN 0.0 ELSE 0.01 * (1 + d % 3) END AS b, i * 100.0 AS c FROM (SELECT unnest(range(0, 300)) AS d), (SELECT unnest(range(0, 4000)) AS i) WHERE i % 2 = 0)"


def grid(spark):
    d, i = F.col("d"), F.col("i")
    rows = spark.range(300).select(F.col("id").cast("int").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(3998), F.lit(2))).alias("i"))
    return rows.select(d.alias("depth_bin"), i.alias("intensity_bin"), (50.0 + i).alias("a"), F.when(i < 1500, 0.0).otherwise(0.01 * (1 + d % 3)).alias("b"), (i * 100.0).alias("c"))


@query("j13_depth_correct_grid", with_tables("fits", "movies", "segments") + DEEP + ", " + GRID + """, first AS (SELECT depth_bin, arg_min(a, intensity_bin) AS a, arg_min(b, intensity_bin) AS b FROM grid WHERE b <> 0 GROUP BY 1)
SELECT fit_no, round(CASE WHEN g.b IS NULL THEN height WHEN g.b <> 0 THEN g.a * exp(-g.b * 10) + g.c ELSE coalesce(f.a * exp(-f.b * 10) + height - f.a * exp(-f.b * depth), height) END, 4) AS height
FROM deep d LEFT JOIN grid g ON g.depth_bin = trunc(d.depth / 0.1) AND g.intensity_bin = trunc(d.height / 100) LEFT JOIN first f ON f.depth_bin = trunc(d.depth / 0.1)""")
def _(spark, sf):
    return sp.depth_correct_grid(deep(spark, sf), grid(spark), "height", 10.0).select("fit_no", F.round("height", 4).alias("height"))


@query("g29_depth_correct_curve", with_tables("fits", "movies", "segments") + DEEP + " SELECT fit_no, round(height - 900 * exp(-0.1 * depth) + 900 * exp(-0.1 * 12), 4) AS height FROM deep")
def _(spark, sf):
    return sp.depth_correct_curve(deep(spark, sf), "height", 900.0, 0.1, 12.0).select("fit_no", F.round("height", 4).alias("height"))


@query("g31_depth_correct_linear", with_tables("fits") + " SELECT fit_no, round(height - z * 0.66 * -338, 4) AS height FROM fits")
def _(spark, sf):
    return sp.depth_correct_linear(tb.fits(spark, sf), ["height"]).select("fit_no", F.round("height", 4).alias("height"))


@query("g11_bin_values", with_tables("fits", "movies", "segments") + DEEP + """ SELECT CAST(b AS INTEGER) AS bin, round(avg(height), 4) AS mean, count(height) AS n
  FROM (SELECT unnest(range(0, 100)) AS b) LEFT JOIN deep ON depth >= 0 AND trunc(depth / 0.5) = b GROUP BY 1""")
def _(spark, sf):
    return sp.bin_values(deep(spark, sf), "depth", "height").select("bin", F.round("mean", 4).alias("mean"), "n")


@query("g13_gaussian_integral", with_tables("fits") + """ SELECT fit_no, round(height / (15 * 15 * 5)
  * (SELECT sum(exp(-power(k / width_z, 2) / 2)) FROM (SELECT unnest(range(-2, 3)) AS k)) * (SELECT sum(exp(-power(k / width_x, 2) / 2)) FROM (SELECT unnest(range(-7, 8)) AS k))
  * (SELECT sum(exp(-power(k / width_y, 2) / 2)) FROM (SELECT unnest(range(-7, 8)) AS k)), 4) AS gauss FROM fits""")
def _(spark, sf):
    return sp.gaussian_integral(tb.fits(spark, sf)).select("fit_no", F.round("gauss", 4).alias("gauss"))


@query("g28_relate", """ WITH b AS (SELECT CAST(l_quantity AS DOUBLE) AS a, l_extendedprice AS b FROM lineitem WHERE l_quantity < 80000 AND l_extendedprice < 80000),
r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM b)
SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(regr_slope(b, a), 4) AS slope, round(regr_intercept(b, a), 4) AS intercept, count(*) AS n FROM r""")
def _(spark, sf):
    rows = tb.read(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return sp.relate(rows, "a", "b", 80000.0).select(r6("pearson"), r6("spearman"), F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("g44_detrend", with_tables("fits", "movies", "segments") + DEEP + " SELECT fit_no, round(height - s * depth - i, 3) AS residual FROM deep, (SELECT regr_slope(height, depth) AS s, regr_intercept(height, depth) AS i FROM deep)")
def _(spark, sf):
    return sp.detrend(deep(spark, sf), "depth", "height").select("fit_no", F.round("residual", 3).alias("residual"))


@query("g27_zscore", with_tables("fits") + " SELECT fit_no, round((height - avg(height) OVER ()) / stddev_pop(height) OVER (), 6) AS height, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS x, CAST(0 AS DOUBLE) AS k FROM fits")
def _(spark, sf):
    return sp.zscore(tb.fits(spark, sf).select("fit_no", "height", "x", F.lit(3.0).alias("k")), ["height", "x", "k"]).select("fit_no", r6("height"), r6("x"), "k")


@query("g6_frequency", " SELECT p_size, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_size) AS place FROM part GROUP BY 1")
def _(spark, sf):
    return sp.sort_by_frequency(tb.read(spark, sf, "part"), "p_size").select("p_size", "n", F.col("place").cast("long").alias("place"))


@query("k8_sample", with_tables("fits") + " SELECT fit_no, height FROM fits ORDER BY md5(fit_no || '_9'), fit_no LIMIT 500")
def _(spark, sf):
    return sp.sample_rows(tb.fits(spark, sf), 500, 9, "fit_no").select("fit_no", "height")


@query("p2_sim_names", with_tables("sims") + " SELECT id, CAST(string_split(name, '_')[2:10] AS DOUBLE[]) AS params FROM sims")
def _(spark, sf):
    return sp.parse_sim_names(tb.sim_names(spark, sf)).select("id", "params")


@query("p3_real_names", with_tables("emb") + """ SELECT id, string_split(n, '_')[1] AS sample, string_split(n, '_')[2] AS stack, string_split(n, '_')[3] AS nucleus, string_split(n, '_')[4] AS z FROM (SELECT id, replace(name, '.pkl', '') AS n FROM emb)""")
def _(spark, sf):
    return sp.parse_real_names(tb.named_embeddings(spark, sf)).select("id", "sample", "stack", "nucleus", "z")


@query("p4_match_names", with_tables("emb") + " SELECT id, name FROM emb WHERE regexp_matches(name, '^s[13]_st[2-4]')")
def _(spark, sf):
    return sp.match_names(tb.named_embeddings(spark, sf), "^s[13]_st[2-4]").select("id", "name")


@query("p12_drop_items", with_tables("emb") + " SELECT id, name FROM emb WHERE id NOT IN (SELECT id FROM emb WHERE id % 3 = 1)")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    return sp.drop_items(e, e.filter("id % 3 = 1"), "id").select("id", "name")


@query("j23_load_named", with_tables("emb") + " SELECT id, name FROM emb WHERE name IN (SELECT name FROM emb WHERE id % 4 = 1)")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    return sp.load_named(e, e.filter("id % 4 = 1")).select("id", "name")


@query("s10_visible", " SELECT name FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN '.' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN '.npy' ELSE '.txt' END AS name FROM part) WHERE name NOT LIKE '.%' AND name LIKE '%.npy'")
def _(spark, sf):
    p = F.col("p_partkey")
    return sp.visible(tb.read(spark, sf, "part").select(F.concat(F.when(p % 4 == 0, ".").otherwise(""), "p_name", F.when(p % 3 == 0, ".npy").otherwise(".txt")).alias("name")), ".npy")


@query("g35_count_nuclei", with_tables("emb") + " SELECT sample, count(*) AS nuclei FROM (SELECT DISTINCT string_split(name, '_')[1] AS sample, string_split(name, '_')[2] AS stack, string_split(name, '_')[3] AS nucleus FROM emb) GROUP BY 1")
def _(spark, sf):
    return sp.count_nuclei(sp.parse_real_names(tb.named_embeddings(spark, sf)))


@query("p8_decode_stack_ids", with_tables("emb") + """, k AS (SELECT 's' || unnest(range(0, 8)) AS old), key AS (SELECT old, 'new' || CAST(substr(old, 2) AS INTEGER) // 3 AS new FROM k),
r AS (SELECT name, new, old, string_split(name, '_')[2] AS nuc, array_to_string(string_split(name, '_')[3:], '_') AS rest FROM emb JOIN key ON old = string_split(name, '_')[1]),
n AS (SELECT new, old, nuc, row_number() OVER (PARTITION BY new ORDER BY old, nuc) - 1 AS n FROM (SELECT DISTINCT new, old, nuc FROM r))
SELECT name, new || '_' || n || '_' || rest AS renamed FROM r JOIN n USING (new, old, nuc)""")
def _(spark, sf):
    k = spark.range(8).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("old"), F.concat(F.lit("new"), F.floor(F.col("id") / 3).cast("string")).alias("new"))
    return sp.decode_stack_ids(tb.named_embeddings(spark, sf), k)


@query("j24_pair_by_suffix", with_tables("emb") + ", sims AS (SELECT 'q' || id % 5 || '_' || name AS sim FROM emb WHERE id % 2 = 0) SELECT sim, name FROM sims JOIN emb ON regexp_replace(sim, '^[^_]*_', '') = name")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    sims = e.filter("id % 2 = 0").select(F.concat(F.lit("q"), (F.col("id") % 5).cast("string"), F.lit("_"), "name").alias("name"))
    return sp.pair_by_suffix(sims, e).select("sim", "name")


@query("j8_object_hierarchy", """ WITH tracks AS (SELECT o_custkey AS id, array_to_string(list_sort(list(o_orderkey)), ', ') AS children FROM orders GROUP BY 1), m AS (SELECT id AS track, CAST(trim(unnest(string_split(children, ','))) AS BIGINT) AS nucleus FROM tracks)
SELECT track, nucleus, l_suppkey AS spot FROM m JOIN orders ON nucleus = o_orderkey JOIN lineitem ON l_orderkey = nucleus""")
def _(spark, sf):
    o = tb.read(spark, sf, "orders")
    tracks = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ", ").alias("children"))
    spots = tb.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("parent"))
    return sp.object_hierarchy(tracks, o.select(F.col("o_orderkey").alias("id")), spots)


@query("p5_object_columns", " SELECT l_orderkey AS id, l_linenumber AS parent, l_quantity AS volume, l_extendedprice AS intensity, l_discount AS sphericity FROM lineitem")
def _(spark, sf):
    names = {"l_orderkey": "id", "l_linenumber": "parent", "l_quantity": "volume", "l_extendedprice": "intensity", "l_discount": "sphericity"}
    return sp.select_columns(tb.read(spark, sf, "lineitem"), names)


@query("p6_filter_nuclei", """ SELECT l_orderkey AS id, l_quantity * 1000 AS volume, CAST(l_orderkey % 100 - 3 AS DOUBLE) AS x_min, CAST(l_orderkey % 100 + l_linenumber - 3 AS DOUBLE) AS x_max,
  CAST(l_suppkey % 40 AS DOUBLE) AS y_min, CAST(l_suppkey % 40 + 5 AS DOUBLE) AS y_max, 'n' AS label, 'f.csv' AS file FROM lineitem
  WHERE l_orderkey % 100 > 0 AND l_orderkey % 100 + l_linenumber < 100 AND l_suppkey % 40 > 0 AND l_suppkey % 40 + 5 < 42 AND l_quantity * 1000 > 5000""")
def _(spark, sf):
    k, y = F.col("l_orderkey") % 100, F.col("l_suppkey") % 40
    rows = tb.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") * 1000).alias("volume"), k.alias("x_min"), (k + F.col("l_linenumber")).alias("x_max"), y.alias("y_min"), (y + 5).alias("y_max"))
    return sp.filter_nucleus_objects(rows, (100, 42), 5000, "n", "f.csv", (3.0, 0.0))


@query("s5_concat_stacks", with_tables("traces") + """, parts AS (SELECT DISTINCT stack_id AS part, t FROM traces), per AS (SELECT part, max(t) + 1 AS n FROM parts GROUP BY 1), base AS (SELECT part, sum(n) OVER (ORDER BY part) - n AS base FROM per)
SELECT part, t, CAST(t + base AS BIGINT) AS new_t, t = 0 AND base > 0 AS join_frame FROM parts JOIN base USING (part)""")
def _(spark, sf):
    return sp.concat_stacks(tb.traces(spark, sf).select(F.col("stack_id").alias("part"), "t").distinct())


@query("f1_gaussian", with_tables("fits") + " SELECT fit_no, round(height * exp(-(power((z - 5) / width_z, 2) + power((x - 50) / width_x, 2) + power((y - 40) / width_y, 2)) / 2), 6) AS g FROM fits")
def _(spark, sf):
    c = F.col
    return tb.fits(spark, sf).select("fit_no", F.round(sc.gaussian_3d(c("z"), c("x"), c("y"), (5.0, 50.0, 40.0), (c("width_z"), c("width_x"), c("width_y")), c("height")), 6).alias("g"))


@query("f2_f3_densities", " SELECT p_partkey, round(exp(-power((p_size - 20) / 7.0, 2) / 2) / (7 * sqrt(2 * pi())), 9) AS pdf, round(power(0.3, 3) * power(0.7, p_size) * (p_size + 1) * (p_size + 2) / 2, 9) AS pmf FROM part")
def _(spark, sf):
    x = F.col("p_size").cast("double")
    return tb.read(spark, sf, "part").select("p_partkey", F.round(sc.gaussian_pdf(x, 20.0, 7.0), 9).alias("pdf"), F.round(sc.negative_binomial_pmf(x, 3, 0.3), 9).alias("pmf"))


@query("f4_f5_f9_f10_expressions", with_tables("fits") + """ SELECT fit_no, round(900 * exp(-0.1 * z) + 3, 6) AS e, round(power((z - 1) * 2.0, 2) + power((x - 2) * 0.5, 2) + power((y - 3) * 0.5, 2), 6) AS d2,
  round(x * 1e-9 * y * 1e-15 * 6.02214076e23, 3) AS n, round(2.5 * exp(-power((x * x) / (2 * 900.0), 1.5)), 6) AS s FROM fits""")
def _(spark, sf):
    c = F.col
    return tb.fits(spark, sf).select(
        "fit_no", F.round(sc.exponential(c("z"), 900.0, 0.1, 3.0), 6).alias("e"), F.round(sc.scaled_distance2(c("z"), c("x"), c("y"), F.lit(1.0), F.lit(2.0), F.lit(3.0), 2.0, 0.5), 6).alias("d2"),
        F.round(sc.molecules(c("x"), c("y")), 3).alias("n"), F.round(sc.super_gaussian(c("x") * c("x"), 2.5, 30.0, 1.5), 6).alias("s"),
    )
