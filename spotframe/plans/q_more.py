"""Queries over sources and sinks, opened masks, augmented images, stitched movies and further forms of operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spotframe.functions import scalar as sc
from spotframe.operators import calib as cb
from spotframe.operators import embed as em
from spotframe.operators import frames as fr
from spotframe.operators import spots as sp
from spotframe.operators import voxels as vx
from spotframe.plans import tables as tb
from spotframe.plans.q_embed import RANKS, halves
from spotframe.plans.q_frames import FILLED, both_channels, frames
from spotframe.plans.registry import query
from spotframe.plans.scratch import new_folder
from spotframe.plans.tables import with_tables
from spotframe.sources import frames as src

VL = with_tables("voxels", "labels")
POINT = ["stack_id", "t", "z", "x", "y"]


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


# masks and labels

OPENED = """, m AS (SELECT stack_id, t, z, x, y FROM voxels WHERE c = 0 AND value >= -60000 + (z - 2) * 9000.0), o(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
w AS (SELECT stack_id, t, z, x - a AS x, y - b AS y FROM m, o GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 4), opened AS (SELECT DISTINCT stack_id, t, z, CAST(x + a AS INTEGER) AS x, CAST(y + b AS INTEGER) AS y FROM w, o)"""


@query("p11_opened_threshold", with_tables("voxels") + OPENED + " SELECT * FROM opened")
def _(spark, sf):
    return vx.opened_threshold(tb.voxels(spark, sf).filter("c = 0"), -60000.0, 2, 9000.0).select(POINT)


MORPH = """, o(i, j, k) AS (SELECT a.d, b.d, c.d FROM (SELECT unnest(range(-1, 2)) AS d) a, (SELECT unnest(range(-1, 2)) AS d) b, (SELECT unnest(range(-1, 2)) AS d) c),
lookup AS (SELECT stack_id, t, z, x + j AS x, y + k AS y, max(label) AS label FROM few, o WHERE i = 0 AND x + j BETWEEN 0 AND 3 AND y + k BETWEEN 0 AND 3 GROUP BY 1, 2, 3, 4, 5)"""
FEW = ", few AS (SELECT * FROM labels WHERE (x + 2 * y + z + t) % 7 <> 0)"


@query("h3_open_labels", VL + FEW + """, q(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)), w AS (SELECT stack_id, t, z, x - a AS x, y - b AS y FROM few, q GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 4),
n AS (SELECT DISTINCT stack_id, t, z, x + a AS x, y + b AS y FROM w, q) SELECT l.* FROM few l JOIN n USING (stack_id, t, z, x, y)""")
def _(spark, sf):
    few = tb.labels(spark, sf).filter("(x + 2 * y + z + t) % 7 <> 0")
    return vx.morph_labels(few, "open", (1, 2, 2), (4, 4, 4)).select(*POINT, "label")


@query("h3_morph_dilate", VL + FEW + MORPH + """, n AS (SELECT DISTINCT stack_id, t, z, x + j AS x, y AS y FROM few, o WHERE i = 0 AND k = 0 AND x + j BETWEEN 0 AND 3)
SELECT stack_id, t, z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, label FROM n JOIN lookup USING (stack_id, t, z, x, y)""")
def _(spark, sf):
    few = tb.labels(spark, sf).filter("(x + 2 * y + z + t) % 7 <> 0")
    return vx.morph_labels(few, "dilate", (1, 3, 1), (4, 4, 4), (1, 3, 3)).select(*POINT, "label")


@query("g37_spot_threshold", VL + """, n AS (SELECT stack_id, max(t) + 1 AS n FROM voxels GROUP BY 1), v AS (SELECT v.* FROM voxels v JOIN n USING (stack_id) WHERE c = 0 AND t >= trunc(n * 0.3) AND t < trunc(n * 0.7) AND x = 1 AND y = 1),
r AS (SELECT stack_id, t, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM v WINDOW w AS (PARTITION BY stack_id, t)),
h AS (SELECT stack_id, t, lo, hi, CAST(least(floor((value - lo) / ((hi - lo) / 64)), 63) AS INTEGER) AS bin, count(*) AS n FROM r GROUP BY 1, 2, 3, 4, 5), m AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 64) AS mid FROM h),
c AS (SELECT *, sum(n) OVER u AS nu, sum(n) OVER d AS nd, sum(n * mid) OVER u / sum(n) OVER u AS mu, sum(n * mid) OVER d / sum(n) OVER d AS md FROM m
  WINDOW u AS (PARTITION BY stack_id, t ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY stack_id, t ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
f AS (SELECT stack_id, mid FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, t ORDER BY nu * nd * power(mu - md, 2) DESC NULLS LAST, bin) AS r FROM c) WHERE r = 1)
SELECT stack_id, round(max(mid), 3) AS threshold FROM f GROUP BY 1""")
def _(spark, sf):
    return vx.spot_threshold(tb.voxels(spark, sf).filter("c = 0"), 64).select("stack_id", F.round("threshold", 3).alias("threshold"))


SHIFT = """, cen AS (SELECT stack_id, t, label, trunc(avg(z)) AS z, trunc(avg(x)) AS x, trunc(avg(y)) AS y FROM labels GROUP BY 1, 2, 3),
s AS (SELECT c.stack_id, c.t, trunc(avg(c.x - z.x)) AS sx, trunc(avg(c.y - z.y)) AS sy FROM cen c JOIN cen z ON z.stack_id = c.stack_id AND z.label = c.label AND z.t = 0 GROUP BY 1, 2)"""


@query("j26_shift_spots", VL + SHIFT + " SELECT c.stack_id, c.t, c.label, CAST(c.z AS INTEGER) AS z, CAST(c.x - coalesce(sx, 0) AS INTEGER) AS x, CAST(c.y - coalesce(sy, 0) AS INTEGER) AS y FROM cen c LEFT JOIN s USING (stack_id, t)")
def _(spark, sf):
    labels = tb.labels(spark, sf)
    return vx.shift_spots(vx.centroids(labels), vx.movement(labels))


@query("j26_undo_shift", VL + " SELECT stack_id, t, label, CAST(trunc(avg(z)) AS INTEGER) AS z, CAST(trunc(avg(x)) AS INTEGER) AS x, CAST(trunc(avg(y)) AS INTEGER) AS y FROM labels GROUP BY 1, 2, 3")
def _(spark, sf):
    labels = tb.labels(spark, sf)
    shifts = vx.movement(labels)
    return vx.shift_spots(vx.shift_spots(vx.centroids(labels), shifts), shifts, undo=True)


@query("p17_clicks_to_maximum", VL + """, cl AS (SELECT DISTINCT stack_id, t, z AS cz, x AS cx, y AS cy FROM labels WHERE (x + y) % 2 = 0), n AS (SELECT cl.*, v.z, v.x, v.y, v.value FROM cl JOIN voxels v ON v.c = 0 AND v.stack_id = cl.stack_id AND v.t = cl.t AND abs(v.z - cz) <= 1 AND abs(v.x - cx) <= 1 AND abs(v.y - cy) <= 1),
a AS (SELECT *, avg(value) OVER (PARTITION BY stack_id, t, cz, cx, cy, z) AS m FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY stack_id, t, cz, cx, cy ORDER BY m DESC, z, value DESC, x, y) AS r FROM a)
SELECT DISTINCT stack_id, t, z, x, y FROM r WHERE r = 1""")
def _(spark, sf):
    clicks = tb.labels(spark, sf).filter("(x + y) % 2 = 0")
    return vx.clicks_to_maximum(clicks, tb.voxels(spark, sf).filter("c = 0"), 3, 1)


@query("g33_center_crop", VL + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, c, t, z ORDER BY value DESC, x, y) AS r FROM voxels) WHERE r = 1 AND x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 2)
SELECT v.stack_id, v.c, v.t, v.z, CAST(v.x - a.x AS INTEGER) AS dx, CAST(v.y - a.y AS INTEGER) AS dy, v.value FROM top a JOIN voxels v ON v.stack_id = a.stack_id AND v.c = a.c AND v.t = a.t AND v.z = a.z AND abs(v.x - a.x) <= 1 AND abs(v.y - a.y) <= 1""")
def _(spark, sf):
    return vx.center_crop(tb.voxels(spark, sf), ["stack_id", "c", "t", "z"], (3, 3), (4, 4))


TURN = """, k AS (SELECT *, CAST('0x' || substr(md5(stack_id || '_' || c || '_' || t || '_{seed}'), 1, 6) AS BIGINT) % 8 AS k FROM voxels), f AS (SELECT *, CASE WHEN k >= 4 THEN 3 - x ELSE x END AS fx FROM k),
{name} AS (SELECT stack_id, c, t, z, CAST(CASE k % 4 WHEN 0 THEN fx WHEN 1 THEN 3 - y WHEN 2 THEN 3 - fx ELSE y END AS INTEGER) AS x, CAST(CASE k % 4 WHEN 0 THEN y WHEN 1 THEN fx WHEN 2 THEN 3 - y ELSE 3 - fx END AS INTEGER) AS y, value FROM f)"""


@query("h11_paired_turns", VL + TURN.format(seed=5, name="a") + TURN.format(seed=6, name="b").replace(", k AS", ", k2 AS").replace(" f AS (SELECT *", " f2 AS (SELECT *").replace("FROM k)", "FROM k2)").replace("FROM f)", "FROM f2)") + " SELECT *, 'left' AS set FROM a UNION ALL SELECT *, 'right' FROM b")
def _(spark, sf):
    return vx.paired_turns(tb.voxels(spark, sf), ["stack_id", "c", "t"], 4, 5).select("stack_id", "c", "t", "z", "x", "y", "value", "set")


@query("h11_noise", VL + """, m AS (SELECT *, md5(stack_id || '_' || c || '_' || t || '_7') AS o, md5(stack_id || '_' || c || '_' || t || '_' || z || '_' || x || '_' || y || '_7') AS e FROM voxels),
u AS (SELECT *, (CAST('0x' || substr(o, 1, 12) AS BIGINT) + 1.0::DOUBLE) / (power(16, 12) + 1) AS s, (CAST('0x' || substr(e, 1, 12) AS BIGINT) + 1.0::DOUBLE) / (power(16, 12) + 1) AS a, (CAST('0x' || substr(e, 13, 12) AS BIGINT) + 1.0::DOUBLE) / (power(16, 12) + 1) AS b FROM m)
SELECT stack_id, c, t, z, x, y, round(value + 5000.0 * s * sqrt(-2 * ln(a)) * cos(2 * pi() * b), 3) AS value FROM u""")
def _(spark, sf):
    out = vx.add_noise(tb.voxels(spark, sf), ["stack_id", "c", "t"], 5000.0, 7)
    return out.select("stack_id", "c", "t", "z", "x", "y", F.round("value", 3).alias("value"))


@query("h8_crop_windows", VL + """, o AS (SELECT unnest(range(-1, 2)) AS d), g AS (SELECT DISTINCT stack_id, t, label, z, x + a.d AS x, y + b.d AS y FROM labels, o a, o b),
c AS (SELECT stack_id, t, label, s.s AS start, s.s + 1 AS z, greatest(1, least(2, trunc(avg(x)))) AS x, greatest(1, least(2, trunc(avg(y)))) AS y FROM labels, (SELECT unnest([0, 1]) AS s) s GROUP BY 1, 2, 3, 4
  HAVING abs(greatest(1, least(2, trunc(avg(x)))) - trunc(avg(x))) <= 1 AND abs(greatest(1, least(2, trunc(avg(y)))) - trunc(avg(y))) <= 1),
w AS (SELECT c.*, i.d AS dz, j.d AS dx, k.d AS dy, CAST(c.z + i.d AS INTEGER) AS pz, CAST(c.x + j.d AS INTEGER) AS px, CAST(c.y + k.d AS INTEGER) AS py FROM c, o i, o j, o k),
r AS (SELECT w.*, coalesce(CASE WHEN g.label IS NOT NULL THEN v.value END, 0) AS value FROM w LEFT JOIN g ON g.stack_id = w.stack_id AND g.t = w.t AND g.label = w.label AND g.z = pz AND g.x = px AND g.y = py
  LEFT JOIN (SELECT * FROM voxels WHERE c = 0) v ON v.stack_id = w.stack_id AND v.t = w.t AND v.z = pz AND v.x = px AND v.y = py),
f AS (SELECT DISTINCT stack_id, t, label, start FROM r WHERE dz = 0 AND value <> 0)
SELECT stack_id, t, label, CAST(start AS INTEGER) AS start, CAST(dz AS INTEGER) AS dz, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, value FROM r JOIN f USING (stack_id, t, label, start)""")
def _(spark, sf):
    return cb.crop_objects(tb.voxels(spark, sf).filter("c = 0"), tb.labels(spark, sf), (3, 3, 3), (4, 4, 4), 1, (1, 3, 3), [0, 1])


# embeddings, ranks, parameters


@query("g36_rank_table", with_tables("emb") + RANKS + """ SELECT 's' || label AS model, round(avg(CASE WHEN pair % 2 = 0 THEN rank END), 6) AS a, round(avg(CASE WHEN pair % 2 = 1 THEN rank END), 6) AS b
FROM ranks JOIN embeddings ON vec_id = pair * 2 GROUP BY 1""")
def _(spark, sf):
    left, right = halves(spark, sf)
    model = left.select("pair", F.split("name", "_")[0].alias("model"))
    ranks = em.rank_pairs(left, right, ties=False).join(model, "pair").select("model", F.when(F.col("pair") % 2 == 0, "a").otherwise("b").alias("set"), "rank")
    return em.rank_table(em.rank_summary(ranks)).select("model", r6("a"), r6("b"))


@query("g39_other_samples", with_tables("emb") + """, p AS (SELECT id, string_split(name, '_')[1] AS sample, embedding, row_number() OVER (ORDER BY md5(id || '_31'), id) - 1 AS place, count(*) OVER () AS n FROM emb),
a AS (SELECT DISTINCT id, sample, embedding, CAST('0x' || substr(md5(id || '_' || k || '_32'), 1, 12) AS BIGINT) % n AS place FROM p, (SELECT unnest(range(0, 20)) AS k))
SELECT a.id, p.id AS other, 'sample' AS class, round(list_distance(a.embedding, p.embedding), 6) AS distance FROM a JOIN p USING (place) WHERE a.sample <> p.sample AND list_distance(a.embedding, p.embedding) > 0""")
def _(spark, sf):
    rows = sp.parse_real_names(tb.named_embeddings(spark, sf))
    return em.other_sample_distances(rows, 20, 31).select("id", "other", "class", r6("distance"))


@query("k5_minmax_params", with_tables("sims") + """, p AS (SELECT id, unnest(range(0, 9)) AS i, unnest(CAST(string_split(name, '_')[2:10] AS DOUBLE[])) AS v FROM sims),
s AS (SELECT id, i, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END AS v FROM p WINDOW w AS (PARTITION BY i)) SELECT id, list(round(v, 6) ORDER BY i) AS params FROM s GROUP BY 1""")
def _(spark, sf):
    out = em.minmax_params(sp.parse_sim_names(tb.sim_names(spark, sf)))
    return out.select("id", F.transform("params", lambda v: F.round(v, 6)).alias("params"))


@query("m5_all_pairs", with_tables("sims") + """, p AS (SELECT id, CAST(string_split(name, '_')[2:10] AS DOUBLE[]) AS params FROM sims)
SELECT a.id, b.id AS other, [x[1] - x[2] FOR x IN list_zip(a.params[1:3], b.params[1:3])] AS difference, round(power(list_distance(a.params, b.params), 2), 4) AS distance2 FROM p a, p b WHERE a.id <> b.id""")
def _(spark, sf):
    """Every pair of the whole table with its difference; rows grow with the square of the table."""
    p = sp.parse_sim_names(tb.sim_names(spark, sf)).select("id", "params", F.slice("params", 1, 3).alias("features"))
    return em.all_difference_pairs(p).select("id", "other", "difference", F.round("distance2", 4).alias("distance2"))


@query("m5_pair_statistics", with_tables("sims") + """, p AS (SELECT id, CAST(string_split(name, '_')[2:10] AS DOUBLE[]) AS params FROM sims)
SELECT a.id, count(*) AS n, round(avg(power(list_distance(a.params, b.params), 2)), 4) AS mean, round(max(power(list_distance(a.params, b.params), 2)), 4) AS largest FROM p a JOIN p b ON a.id <> b.id GROUP BY 1""")
def _(spark, sf):
    """Of all pairs of the whole table what they say of each row; ``all_difference_pairs`` gives the pairs themselves."""
    out = em.pair_statistics(sp.parse_sim_names(tb.sim_names(spark, sf)).select("id", "params"))
    return out.select("id", "n", F.round("mean", 4).alias("mean"), F.round("largest", 4).alias("largest"))


@query("m5_hold_out", with_tables("sims") + " SELECT id, CAST('0x' || substr(md5(id || '_3'), 1, 8) AS BIGINT) < CAST(trunc(0.2 * power(16, 8)) AS BIGINT) AS held FROM sims")
def _(spark, sf):
    return em.hold_out(tb.sim_names(spark, sf), "id", 0.2, 3).select("id", "held")


@query("g25_flatten", with_tables("emb") + " SELECT id AS sim_id, [round(x, 6) FOR x IN list_concat(embedding[1:10], embedding[21:30])] AS hist FROM emb")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    part = lambda k, a: e.select(F.col("id").alias("sim_id"), F.lit(k).alias("sigma_no"), F.slice("embedding", a, 10).alias("hist"))
    return cb.flatten_histograms(part(1, 21).unionByName(part(0, 1))).select("sim_id", F.transform("hist", lambda x: sc.round_signed(x, 6)).alias("hist"))


@query("m4_regress", " SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def _(spark, sf):
    rows = tb.read(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    (slope,), intercept = em.regress(rows, ["x"], "y")
    return spark.range(1).select(F.round(F.lit(slope), 4).alias("slope"), F.round(F.lit(intercept), 3).alias("intercept"))


# corrections fitted to data (no SQL for the fits; tests hold them against known curves)


def deep_spots(spark, sf):
    """Spots with a depth from 0 to 24 and a height that falls with it."""
    depth = (F.col("fit_no") % 97) / 4.0
    return tb.fits(spark, sf).select("fit_no", depth.alias("depth"), (900 * F.exp(-0.08 * depth) + F.col("height") / 10_000 + 50).alias("height"))


@query("g29_correct_from_data")
def _(spark, sf):
    spots = deep_spots(spark, sf)
    bins = spots.groupBy(F.floor(F.col("depth") / 0.5).cast("int").alias("bin")).agg(F.avg("height").alias("mean"))
    return cb.depth_correct_from_data(spots, bins, "height", 15.0).select("fit_no", F.round("height", 3).alias("height"))


@query("g30_curves_from_data")
def _(spark, sf):
    rows = deep_spots(spark, sf).withColumn("stack_id", (F.col("fit_no") % 6).cast("long"))
    points = rows.groupBy("stack_id", F.floor("depth").cast("double").alias("depth")).agg(F.avg(F.col("height") + F.col("stack_id") * 100).alias("mean"))
    return cb.depth_curves_to_grid(cb.depth_curves(points), 40, 60).select("depth_bin", "intensity_bin", F.round("a", 3).alias("a"), F.round("b", 5).alias("b"), F.round("c", 3).alias("c"))


# stitched movies

STITCH = """, a AS (SELECT * FROM labels), b AS (SELECT stack_id, t, z, x, y, label + 1 AS label FROM labels), m(lb, la) AS (VALUES (2, 1), (3, 2), (4, 4)), top AS (SELECT max(label) AS top FROM a),
fresh AS (SELECT label, row_number() OVER (ORDER BY label) AS r FROM (SELECT DISTINCT label FROM b WHERE label NOT IN (SELECT lb FROM m)))"""


@query("j22_stitch_labels", VL + STITCH + """ SELECT * FROM a UNION ALL SELECT b.stack_id, CAST(b.t + 500 AS INTEGER), b.z, b.x, b.y, CAST(coalesce(m.la, top + r) AS INTEGER) FROM b LEFT JOIN m ON m.lb = b.label LEFT JOIN fresh ON fresh.label = b.label, top""")
def _(spark, sf):
    a = tb.labels(spark, sf)
    matches = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(x).alias("lb"), F.lit(y).alias("la")) for x, y in ((2, 1), (3, 2), (4, 4))])).alias("m")).select("m.lb", "m.la")
    return cb.stitch_labels(a, a.withColumn("label", F.col("label") + 1), 500, matches)


def track_spots(spark, sf):
    return tb.traces(spark, sf).select("stack_id", F.col("spot_id").cast("long").alias("spot_id"), "t", (F.col("spot_id") % 10 + (F.col("t") % 9 == 0).cast("int")).cast("long").alias("nuc_id"))


@query("j22_attach_spots", with_tables("traces") + """, f AS (SELECT stack_id, CAST(spot_id AS BIGINT) AS spot_id, t, spot_id % 10 + CAST(t % 9 = 0 AS INTEGER) AS nuc_id FROM traces), l(label, new) AS (VALUES (3, 4), (4, 3)),
s AS (SELECT stack_id, spot_id, t + 40 AS t, coalesce(new, nuc_id) AS nuc_id FROM f LEFT JOIN l ON label = nuc_id WHERE t < 20),
fn AS (SELECT stack_id, spot_id, arg_max(nuc_id, n * 1000 - nuc_id) AS nuc, sum(n) AS len FROM (SELECT stack_id, spot_id, nuc_id, count(*) AS n FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2),
sn AS (SELECT stack_id, spot_id, arg_max(nuc_id, n * 1000 - nuc_id) AS nuc, sum(n) AS len FROM (SELECT stack_id, spot_id, nuc_id, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
fl AS (SELECT stack_id, nuc, spot_id AS goal FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, nuc ORDER BY len DESC, spot_id) AS r FROM fn) WHERE r = 1), sl AS (SELECT stack_id, nuc, spot_id FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, nuc ORDER BY len DESC, spot_id) AS r FROM sn) WHERE r = 1),
j AS (SELECT sl.stack_id, sl.spot_id, goal FROM sl JOIN fl USING (stack_id, nuc)), free AS (SELECT stack_id, spot_id, row_number() OVER (ORDER BY stack_id, spot_id) + (SELECT max(spot_id) FROM f) AS goal FROM (SELECT DISTINCT stack_id, spot_id FROM s) q WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.stack_id = q.stack_id AND j.spot_id = q.spot_id)),
g AS (SELECT * FROM j UNION ALL SELECT * FROM free)
SELECT stack_id, spot_id, t, CAST(nuc_id AS BIGINT) AS nuc_id FROM f UNION ALL SELECT s.stack_id, g.goal, s.t, CAST(s.nuc_id AS BIGINT) FROM s JOIN g USING (stack_id, spot_id)""")
def _(spark, sf):
    first = track_spots(spark, sf)
    labels = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("label"), F.lit(y).cast("long").alias("new")) for x, y in ((3, 4), (4, 3))])).alias("m")).select("m.*")
    return cb.attach_spots(first, first.filter("t < 20"), labels, 40)


# whole frames; held against plain versions in tests


@query("k9_local_maxima", with_tables("voxels") + """, v AS MATERIALIZED (SELECT stack_id * 2 + c AS stack_id, t, z, x, y, value, min(value) OVER (PARTITION BY stack_id, c, t) AS low FROM voxels),
p AS (SELECT stack_id, t, z, x, y FROM v WHERE value > low AND NOT EXISTS (SELECT 1 FROM v n WHERE n.stack_id = v.stack_id AND n.t = v.t AND n.value > v.value AND abs(n.z - v.z) <= 1 AND abs(n.x - v.x) <= 1 AND abs(n.y - v.y) <= 1))
SELECT stack_id, t, CAST(row_number() OVER (PARTITION BY stack_id, t ORDER BY z, x, y) - 1 AS INTEGER) AS peak, z, x, y FROM p""")
def _(spark, sf):
    return fr.local_maxima(frames(spark, sf), (3, 3, 3), 1.0)


@query("h4_fit_peaks")
def _(spark, sf):
    peaks = vx.centroids(both_channels(tb.labels(spark, sf))).withColumn("fit_no", F.col("label").cast("long"))
    return fr.fit_peaks(peaks.select("stack_id", "t", "fit_no", "z", "x", "y"), frames(spark, sf), 1, 1)


@query("p7_curation_fitted")
def _(spark, sf):
    """Each seventh frame's spots are deleted and put again at their places, rounded, where they are fitted."""
    peaks = vx.centroids(both_channels(tb.labels(spark, sf))).select("stack_id", "t", F.col("label").cast("long").alias("fit_no"), "z", "x", "y")
    spots = fr.fit_peaks(peaks, frames(spark, sf), 1, 1).withColumnRenamed("fit_no", "spot_id").withColumn("nuc_id", F.col("spot_id"))
    bad = spots.filter("t % 7 = 3").select("stack_id", "spot_id", "t")
    again = peaks.withColumnRenamed("fit_no", "spot_id").filter("t % 7 = 3").select("stack_id", "spot_id", "t", *[F.round(k).alias(k) for k in "zxy"])
    return sp.curate(spots, bad, again, frames(spark, sf), 1, 1)


@query("h6_detect_in_nuclei")
def _(spark, sf):
    return fr.detect_spots(frames(spark, sf), (0.5,) * 3, (1.5,) * 3, rad_xy=2, rad_z=1, background=3, labels=both_channels(tb.labels(spark, sf)))


@query("h6_detect_above_threshold")
def _(spark, sf):
    f = frames(spark, sf)
    cuts = fr.detection_thresholds(f, (0.5,) * 3, (1.5,) * 3, 3)
    return fr.detect_spots(f, (0.5,) * 3, (1.5,) * 3, (3, 3, 3), 1.5, 2, 1, background=3, thresholds=cuts)


@query("h7_fit_labelled")
def _(spark, sf):
    return fr.fit_labelled_objects(frames(spark, sf), both_channels(tb.labels(spark, sf)), None, 0, 1, 1)


@query("h9_bead_boxes")
def _(spark, sf):
    v = tb.voxels(spark, sf)
    return fr.bead_boxes(fr.to_frames(v.filter("c = 0")), v, 60000.0, (3, 3, 3), 0.5).select("stack_id", "t", "label", "dz", "dx", "dy", r6("value"))


@query("h13_fill_holes", FILLED + " SELECT *, 1 AS label FROM filled")
def _(spark, sf):
    return fr.fill_holes(frames(spark, sf), 0.0)


@query("h15_mask_foci")
def _(spark, sf):
    return fr.mask_foci(tb.voxels(spark, sf), tb.labels(spark, sf), (4, 4), 0.5, 3)


@query("h16_objects_per_slice", with_tables("voxels").replace("WITH ", "WITH RECURSIVE ", 1) + """, m AS (SELECT stack_id * 2 + c AS stack_id, t, z, x, y FROM voxels WHERE value >= -60000 + (z - 2) * 9000.0), o(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
w AS (SELECT stack_id, t, z, x - a AS x, y - b AS y FROM m, o GROUP BY ALL HAVING count(*) = 4), op AS MATERIALIZED (SELECT DISTINCT stack_id, t, z, x + a AS x, y + b AS y FROM w, o),
reach AS (SELECT *, x * 4 + y AS root FROM op UNION SELECT g.stack_id, g.t, g.z, g.x, g.y, r.root FROM reach r, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy)
  JOIN op g ON g.stack_id = r.stack_id AND g.t = r.t AND g.z = r.z AND g.x = r.x + dx AND g.y = r.y + dy WHERE r.root < g.x * 4 + g.y),
n AS (SELECT stack_id, t, z, count(DISTINCT root) AS n FROM (SELECT stack_id, t, z, x, y, min(root) AS root FROM reach GROUP BY ALL) GROUP BY ALL)
SELECT f.stack_id, f.t, f.z, CAST(coalesce(n, 0) AS INTEGER) AS objects FROM (SELECT DISTINCT stack_id * 2 + c AS stack_id, t, z FROM voxels) f LEFT JOIN n USING (stack_id, t, z)""")
def _(spark, sf):
    return fr.objects_per_slice(frames(spark, sf), -60000.0, 2, 9000.0)


@query("h12_embed_images", with_tables("emb") + " SELECT name, [round(list_avg(embedding), 5), round(list_max(embedding), 5), round(list_min(embedding), 5)] AS embedding FROM emb")
def _(spark, sf):
    images = tb.named_embeddings(spark, sf).select("name", F.col("embedding").alias("pixels"))
    out = em.embed_images(images, lambda: lambda x: np.stack([x.mean(axis=1), x.max(axis=1), x.min(axis=1)], axis=1))
    return out.select("name", F.transform("embedding", lambda v: sc.round_signed(v, 5)).alias("embedding"))


# sources and sinks: written to a new folder and read back


@query("s1_read_frames", with_tables("voxels") + " SELECT CAST(row_number() OVER (ORDER BY 's' || lpad(CAST(stack_id AS VARCHAR), 4, '0') || '_t' || lpad(CAST(t AS VARCHAR), 6, '0')) - 1 AS INTEGER) AS t, 4 AS nz, 4 AS nx, 4 AS ny, sum(value) AS total FROM voxels WHERE c = 0 GROUP BY stack_id, voxels.t")
def _(spark, sf):
    f = fr.to_frames(tb.voxels(spark, sf).filter("c = 0"))
    name = F.concat(F.lit("s"), F.lpad(F.col("stack_id").cast("string"), 4, "0"), F.lit("_t"), F.lpad(F.col("t").cast("string"), 6, "0"))
    folder = new_folder(spark, "frames")
    src.write_frames(f.withColumn("name", name), folder)
    total = F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return src.read_frames(spark, folder).select("t", "nz", "nx", "ny", total.alias("total"))


@query("s2_assign_channels", " SELECT 'Cam' || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END || '_' || lpad(CAST(k AS VARCHAR), 8, '0') AS name, CAST(o_orderkey % 2 AS INTEGER) AS channel, CAST(row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY k) - 1 AS INTEGER) AS t FROM (SELECT o_orderkey * 2 + s AS o_orderkey, o_orderkey AS k FROM orders, (SELECT unnest([0, 1]) AS s))")
def _(spark, sf):
    k = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    names = tb.read(spark, sf, "orders").select(F.explode(F.array(*[F.concat(F.lit(c), k) for c in ("CamA_", "CamB_")])).alias("name"))
    return src.assign_channels(names).select("name", "channel", "t")


@query("s6_object_tables", " SELECT o_orderkey AS id, o_custkey AS parent, o_totalprice AS volume FROM orders")
def _(spark, sf):
    path = new_folder(spark, "objects")
    tb.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"), F.col("o_totalprice").alias("volume")).write.csv(path, header=True)
    return src.read_object_table(spark, path, "id long, parent long, volume double")


@query("s7_embeddings", with_tables("emb") + " SELECT name, embedding FROM emb WHERE id % 11 <> 0")
def _(spark, sf):
    path = new_folder(spark, "embeddings")
    rows = tb.named_embeddings(spark, sf).withColumn("name", F.when(F.col("id") % 11 == 0, F.concat(F.lit("."), "name")).otherwise(F.col("name")))
    src.write_embeddings(rows.select("name", "embedding"), f"{path}/parquet")
    src.export_embeddings(spark.read.parquet(f"{path}/parquet"), f"{path}/text")
    return src.read_exported(spark, f"{path}/text")


@query("s8_triplets", with_tables("emb") + " SELECT name AS anchor, 'p_' || name AS positive, 'n, \"' || name || '\"' AS negative FROM emb")
def _(spark, sf):
    path = new_folder(spark, "triplets")
    n = F.col("name")
    src.write_triplets(tb.named_embeddings(spark, sf).select(n.alias("anchor"), F.concat(F.lit("p_"), n).alias("positive"), F.concat(F.lit('n, "'), n, F.lit('"')).alias("negative")), path)
    return src.read_triplets(spark, path)


@query("s9_save_movie", VL + " SELECT 'voxels' AS kind, stack_id, count(*) AS n, sum(value) AS total FROM voxels GROUP BY 2 UNION ALL SELECT 'labels', stack_id, count(*), CAST(sum(label) AS DOUBLE) FROM labels GROUP BY 2")
def _(spark, sf):
    path = new_folder(spark, "movie")
    src.save_movie({"voxels": tb.voxels(spark, sf), "labels": tb.labels(spark, sf)}, path)
    per = lambda kind, c: spark.read.parquet(f"{path}/{kind}").groupBy(F.lit(kind).alias("kind"), F.col("stack_id").cast("int").alias("stack_id")).agg(F.count("*").alias("n"), F.sum(F.col(c).cast("double")).alias("total"))
    return per("voxels", "value").unionByName(per("labels", "label"))
