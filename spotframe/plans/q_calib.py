"""Queries over calibration tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.operators import calib as cb
from spotframe.operators import embed as em
from spotframe.operators import spots as sp
from spotframe.operators import traces as tr
from spotframe.plans import tables as tb
from spotframe.plans.q_traces import RUNS, runs_of, second_of
from spotframe.plans.registry import query
from spotframe.plans.tables import with_tables

VL = with_tables("voxels", "labels", "movies", "segments")


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


@query("g15_trimmed_by_slice", with_tables("voxels") + """, c AS (SELECT stack_id, z, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM voxels WHERE c = 0 GROUP BY 1, 2)
SELECT stack_id, z, round(CASE WHEN count(*) > 4 THEN avg(value) END, 4) AS mean, count(*) AS n FROM voxels JOIN c USING (stack_id, z) WHERE voxels.c = 0 AND value >= lo AND value <= hi GROUP BY 1, 2""")
def _(spark, sf):
    return cb.trimmed_by_slice(tb.voxels(spark, sf).filter("c = 0")).select("stack_id", "z", F.round("mean", 4).alias("mean"), "n")


@query("g16_depth_intensity", with_tables("voxels") + """, c AS (SELECT stack_id, z, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM voxels WHERE c = 0 GROUP BY 1, 2),
m AS (SELECT stack_id, z, avg(value) AS mean FROM voxels JOIN c USING (stack_id, z) WHERE voxels.c = 0 AND value >= lo AND value <= hi GROUP BY 1, 2 HAVING count(*) > 4)
SELECT m.stack_id, CAST(z * 0.5 + n_nationkey * 1.5 - 2 AS DOUBLE) AS depth, round(mean, 4) AS mean FROM m JOIN nation ON n_nationkey = stack_id""")
def _(spark, sf):
    stacks = tb.read(spark, sf, "nation").select(F.col("n_nationkey").alias("stack_id"), F.lit(0.5).alias("dz"), (F.col("n_nationkey") * 1.5).alias("start"), F.lit(2.0).alias("surface"))
    return cb.depth_intensity(cb.trimmed_by_slice(tb.voxels(spark, sf).filter("c = 0")), stacks).select("stack_id", r6("depth"), F.round("mean", 4).alias("mean"))


@query("g25_prepare_histograms", with_tables("emb") + """, h AS (SELECT id AS sim_id, b, avg(v) AS v FROM (SELECT id, abs(unnest(embedding)) AS v, (unnest(range(0, 64)) * 8) // 64 AS b FROM emb) GROUP BY 1, 2), s AS (SELECT *, v / sum(v) OVER (PARTITION BY sim_id) AS s FROM h)
SELECT sim_id, 0 AS sigma_no, list(round(ln(s + (SELECT min(s) FROM s WHERE s > 0) / 100), 6) ORDER BY b) AS hist FROM s GROUP BY 1""")
def _(spark, sf):
    h = tb.named_embeddings(spark, sf).select(F.col("id").alias("sim_id"), F.lit(0).alias("sigma_no"), F.transform("embedding", F.abs).alias("hist"))
    return cb.prepare_histograms(h, 8).select("sim_id", "sigma_no", F.transform("hist", lambda x: F.round(x, 6)).alias("hist"))


@query("g30_depth_curves_grid", with_tables("fits") + """, u AS (SELECT stack_id AS id, 500.0 + avg(height) / 100 AS a, 0.02 + stack_id * 0.001 AS b, 100.0 * stack_id + count(*) % 50 AS c FROM fits GROUP BY 1),
atd AS (SELECT u.*, d, a * exp(-b * d * 0.1) + c AS v FROM u, (SELECT unnest(range(0, 40)) AS d)), p AS (SELECT *, lead(v) OVER w AS nv, lead(a) OVER w AS na, lead(b) OVER w AS nb, lead(c) OVER w AS nc FROM atd WINDOW w AS (PARTITION BY d ORDER BY v, id))
SELECT CAST(g.d AS INTEGER) AS depth_bin, CAST(i AS INTEGER) AS intensity_bin, round(coalesce(a + (i * 100 - v) / (nv - v) * (na - a), 0), 5) AS a, round(coalesce(b + (i * 100 - v) / (nv - v) * (nb - b), 0), 6) AS b, round(coalesce(c + (i * 100 - v) / (nv - v) * (nc - c), 0), 5) AS c
FROM (SELECT unnest(range(0, 40)) AS d) g CROSS JOIN (SELECT unnest(range(0, 60)) AS i) LEFT JOIN p ON p.d = g.d AND i * 100 >= v AND i * 100 < nv""")
def _(spark, sf):
    k = F.col("stack_id")
    curves = tb.fits(spark, sf).groupBy("stack_id").agg(F.avg("height").alias("m"), F.count("*").alias("n"))
    curves = curves.select("stack_id", (500.0 + F.col("m") / 100).alias("a"), (0.02 + k * 0.001).alias("b"), (100.0 * k + F.col("n") % 50).alias("c"))
    return cb.depth_curves_to_grid(curves, 40, 60).select("depth_bin", "intensity_bin", F.round("a", 5).alias("a"), r6("b"), F.round("c", 5).alias("c"))


@query("g45_mean_concentration", with_tables("voxels") + ' SELECT stack_id, round((avg(value) + 200000) / 250.0 * (1 / 6.02214076e23 / (0.02 * 1e-15) * 1e9) / (40 / 34.0), 4) AS "nM" FROM voxels GROUP BY 1')
def _(spark, sf):
    return cb.mean_signal_concentration(tb.voxels(spark, sf), -200000.0, 250.0, 0.02, 40.0).select("stack_id", F.round("nM", 4).alias("nM"))


@query("p9_rename_to_template", with_tables("emb", "sims") + """, t AS (SELECT row_number() OVER (ORDER BY md5(name || '_9'), name) - 1 AS k, string_split(replace(name, '.pkl', ''), '_') AS p FROM emb),
s AS (SELECT name, row_number() OVER (ORDER BY md5(id || '_10'), id) - 1 AS place, CAST('0x' || substr(md5(id || '_8'), 1, 12) AS BIGINT) % (SELECT count(*) FROM emb) AS k FROM sims)
SELECT name, p[1] || '_' || p[2] || '_' || (place + 1000) || '_' || p[4] AS renamed FROM s JOIN t USING (k)""")
def _(spark, sf):
    return cb.rename_to_template(tb.sim_names(spark, sf), sp.parse_real_names(tb.named_embeddings(spark, sf)), 8)


@query("p17_clean_clicks", """ SELECT DISTINCT CAST(trunc(l_quantity) AS INTEGER) AS z, l_linenumber AS x, CAST(l_suppkey % 9 AS INTEGER) AS y FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0""")
def _(spark, sf):
    k = F.col("l_orderkey")
    text = F.concat_ws(" ", F.col("l_quantity").cast("string"), F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 9).cast("string"))
    return cb.clean_clicks(tb.read(spark, sf, "lineitem").select(F.when(k % 5 == 0, F.concat(F.lit("# "), text)).when(k % 7 == 0, F.concat(F.lit("None "), text)).otherwise(text).alias("value")))


@query("p18_filter_genes", " SELECT l_orderkey, l_returnflag AS class, l_discount AS m1, l_tax AS m2, l_orderkey % 100 + l_quantity AS length FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0 AND l_tax > 0")
def _(spark, sf):
    rows = tb.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("class"), F.col("l_discount").alias("m1"), F.col("l_tax").alias("m2"), F.lit(0).alias("begin"), (F.col("l_orderkey") % 100 + F.col("l_quantity")).alias("end"))
    return cb.filter_genes(rows, "A").select("l_orderkey", "class", "m1", "m2", "length")


@query("g9_bleach_constant_depth", VL + """, big AS (SELECT stack_id, t, z, x * 2 + a.i AS x, y * 2 + b.i AS y, value + 1e6 AS value FROM voxels, (SELECT unnest(range(0, 2)) AS i) a, (SELECT unnest(range(0, 2)) AS i) b WHERE c = 0),
few AS (SELECT * FROM labels WHERE x = 0 AND y = 0 AND label = 1), n AS (SELECT stack_id, max(t) + 1 AS n FROM big GROUP BY 1), seg AS (SELECT *, lead(start_frame) OVER (PARTITION BY stack_id ORDER BY start_frame) AS stop FROM segments),
atd AS (SELECT s.stack_id, f.t, greatest(0, least(3, trunc((3.0 - (s.start_pos - (m.surface_before + f.t * (m.surface_after - m.surface_before) / n.n))) / 0.5))) AS z FROM seg s JOIN movies m USING (stack_id) JOIN n USING (stack_id) JOIN (SELECT unnest(range(0, 500)) AS t) f ON f.t >= s.start_frame AND f.t < coalesce(s.stop, n.n) AND f.t < n.n),
m AS (SELECT b.stack_id, b.t, avg(value) AS mean FROM big b JOIN atd USING (stack_id, t, z) WHERE b.x BETWEEN 2 AND 5 AND b.y BETWEEN 2 AND 5 AND NOT EXISTS (SELECT 1 FROM few l WHERE l.stack_id = b.stack_id AND l.t = b.t AND l.z = b.z AND abs(l.x - b.x) <= 2 AND abs(l.y - b.y) <= 2) GROUP BY 1, 2)
SELECT CAST(stack_id AS BIGINT) AS stack_id, t, round(mean, 3) AS mean, round((regr_slope(mean, t) OVER w * t + regr_intercept(mean, t) OVER w) / regr_intercept(mean, t) OVER w, 6) AS factor FROM m WINDOW w AS (PARTITION BY stack_id)""")
def _(spark, sf):
    v = tb.voxels(spark, sf).filter("c = 0").withColumn("i", F.explode(F.array(*map(F.lit, range(2))))).withColumn("j", F.explode(F.array(*map(F.lit, range(2)))))
    big = v.select(F.col("stack_id").cast("long").alias("stack_id"), "c", "t", "z", (F.col("x") * 2 + F.col("i")).alias("x"), (F.col("y") * 2 + F.col("j")).alias("y"), (F.col("value") + 1e6).alias("value"))
    few = tb.labels(spark, sf).filter("x = 0 AND y = 0 AND label = 1")
    out = cb.bleach_constant_depth(big, few, tb.movies(spark, sf), tb.segments(spark, sf), 3.0, (4, 8, 8))
    return out.select("stack_id", "t", F.round("mean", 3).alias("mean"), r6("factor"))


@query("g42_param_histograms", with_tables("sims") + """, p AS (SELECT id, name, CAST(string_split(name, '_')[2:10] AS DOUBLE[]) AS params FROM sims), pat(pattern, rx) AS (VALUES ('a', '^abc_1[0-9]_'), ('b', '^abc_4')),
c AS (SELECT pattern, list(m ORDER BY i) AS c FROM (SELECT pattern, i, avg(v) AS m FROM (SELECT pattern, unnest(params) AS v, unnest(range(1, 10)) AS i FROM p, pat WHERE regexp_matches(name, rx)) GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT pattern, params[1] AS v FROM p, c WHERE list_distance(params, c) <= 9), t AS (SELECT max(params[1]) AS top FROM p)
SELECT g.pattern, CAST(b AS INTEGER) AS bin, count(v) AS n FROM (SELECT pattern, unnest(range(0, 20)) AS b FROM pat) g CROSS JOIN t LEFT JOIN n ON n.pattern = g.pattern AND least(floor(v / (top / 20)), 19) = b GROUP BY 1, 2""")
def _(spark, sf):
    sims = sp.parse_sim_names(tb.sim_names(spark, sf)).withColumn("embedding", F.col("params"))
    return cb.param_histograms(sims, sims, {"a": "^abc_1[0-9]_", "b": "^abc_4"}, 0, 9.0)


@query("h8_crop_objects", with_tables("voxels", "labels") + """, c AS (SELECT stack_id, t, label, greatest(1, least(2, trunc(avg(z)))) AS z, greatest(1, least(2, trunc(avg(x)))) AS x, greatest(1, least(2, trunc(avg(y)))) AS y FROM labels GROUP BY 1, 2, 3
  HAVING abs(greatest(1, least(2, trunc(avg(z)))) - trunc(avg(z))) <= 1 AND abs(greatest(1, least(2, trunc(avg(x)))) - trunc(avg(x))) <= 1 AND abs(greatest(1, least(2, trunc(avg(y)))) - trunc(avg(y))) <= 1),
o AS (SELECT unnest(range(-1, 2)) AS d), w AS (SELECT c.stack_id, c.t, c.label, i.d AS dz, j.d AS dx, k.d AS dy, coalesce(CASE WHEN l.label IS NOT NULL THEN v.value END, 0) AS value FROM c, o i, o j, o k
  LEFT JOIN labels l ON l.stack_id = c.stack_id AND l.t = c.t AND l.label = c.label AND l.z = c.z + i.d AND l.x = c.x + j.d AND l.y = c.y + k.d LEFT JOIN voxels v ON v.c = 0 AND v.stack_id = c.stack_id AND v.t = c.t AND v.z = c.z + i.d AND v.x = c.x + j.d AND v.y = c.y + k.d)
SELECT stack_id, t, label, CAST(dz AS INTEGER) AS dz, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, value FROM w WHERE EXISTS (SELECT 1 FROM w q WHERE q.stack_id = w.stack_id AND q.t = w.t AND q.label = w.label AND q.dz = 0 AND q.value <> 0)""")
def _(spark, sf):
    return cb.crop_objects(tb.voxels(spark, sf).filter("c = 0"), tb.labels(spark, sf), (3, 3, 3), (4, 4, 4), 1)


@query("w9_cross_correlation", with_tables("traces", "traces2") + RUNS + """, a AS (SELECT stack_id, pos, value - avg(value) OVER (PARTITION BY stack_id) AS d FROM runs), two AS (SELECT r.stack_id, r.pos, s.value FROM runs r JOIN traces2 s USING (stack_id, spot_id, t)),
b AS (SELECT stack_id, pos, value - avg(value) OVER (PARTITION BY stack_id) AS d FROM two), q AS (SELECT x.stack_id, sqrt(x.s * y.s) AS s FROM (SELECT stack_id, sum(d * d) AS s FROM a GROUP BY 1) x JOIN (SELECT stack_id, sum(d * d) AS s FROM b GROUP BY 1) y USING (stack_id))
SELECT e.stack_id, CAST(e.lag AS INTEGER) AS lag, round(sum(b.d * e.d) / any_value(q.s), 6) AS r FROM (SELECT *, unnest(range(0, 6)) AS lag FROM a) e JOIN b ON b.stack_id = e.stack_id AND b.pos = e.pos - e.lag JOIN q ON q.stack_id = e.stack_id GROUP BY 1, 2""")
def _(spark, sf):
    return tr.cross_correlation(runs_of(spark, sf), second_of(spark, sf), 5).select("stack_id", "lag", r6("r"))


@query("m2_remove_components")
def _(spark, sf):
    return em.remove_components(tb.named_embeddings(spark, sf), 2).select("id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))
