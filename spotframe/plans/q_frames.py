"""Queries over whole frames and linking; held against plain versions in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.functions import scalar as sc
from spotframe.operators import frames as fr
from spotframe.operators import tiles as ti
from spotframe.operators import tracks as tk
from spotframe.plans import tables as tb
from spotframe.plans.registry import query
from spotframe.plans.tables import with_tables


def frames(spark, sf):
    """All frames; the channel stands in the stack's number."""
    return fr.to_frames(tb.voxels(spark, sf).withColumn("stack_id", F.col("stack_id") * 2 + F.col("c")))


def both_channels(labels):
    return labels.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("stack_id", F.col("stack_id") * 2 + F.col("c")).drop("c")


def blurred(*sigmas: float) -> str:
    """SQL of frames of 4 x 4 x 4 after a gaussian filter of each width, as table g3 (stack_id, c, t, sigma_no, z, x, y, v); an axis is a table of weights."""
    widths = ", ".join(f"({k}, CAST({s} AS DOUBLE), {int(4 * s + 0.5)})" for k, s in enumerate(sigmas))
    return f""", sg(sigma_no, sigma, r) AS (VALUES {widths}), d AS (SELECT sigma_no, sigma, unnest(range(-r, r + 1)) AS d FROM sg), wd AS (SELECT sigma_no, d, exp(-0.5 * power(d / sigma, 2)) AS w FROM d),
wn AS (SELECT sigma_no, d, w / sum(w) OVER (PARTITION BY sigma_no) AS w FROM wd), wp AS (SELECT sigma_no, i, w, ((i + d) % 8 + 8) % 8 AS p FROM wn, (SELECT unnest(range(0, 4)) AS i)),
ax AS MATERIALIZED (SELECT sigma_no, i, CASE WHEN p < 4 THEN p ELSE 7 - p END AS j, sum(w) AS w FROM wp GROUP BY 1, 2, 3),
g1 AS (SELECT stack_id, c, t, sigma_no, i AS z, x, y, sum(value * w) AS v FROM voxels JOIN ax ON j = z GROUP BY ALL), g2 AS (SELECT stack_id, c, t, g.sigma_no, z, i AS x, y, sum(v * w) AS v FROM g1 g JOIN ax ON j = x AND ax.sigma_no = g.sigma_no GROUP BY ALL),
g3 AS (SELECT stack_id, c, t, g.sigma_no, z, x, i AS y, sum(v * w) AS v FROM g2 g JOIN ax ON j = y AND ax.sigma_no = g.sigma_no GROUP BY ALL)"""


@query("h1_gaussian_frames", with_tables("voxels") + blurred(1.0) + " SELECT stack_id * 2 + c AS stack_id, t, list(round(CAST(CAST(v AS FLOAT) AS DOUBLE), 1) ORDER BY z, x, y) AS pixels FROM g3 GROUP BY 1, 2")
def _(spark, sf):
    out = fr.filter_frames(frames(spark, sf), "gaussian", 1.0)
    return out.select("stack_id", "t", F.transform("pixels", lambda p: sc.round_signed(p.cast("double"), 1)).alias("pixels"))


@query("h2_label_frames")
def _(spark, sf):
    return fr.label_frames(frames(spark, sf), 0.5, low=2)


SIDES = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS d(dz, dx, dy)"
MASK = ", m AS MATERIALIZED (SELECT stack_id * 2 + c AS stack_id, t, z, x, y FROM voxels WHERE value > 0), f AS (SELECT DISTINCT stack_id, t FROM m)"
RECURSIVE = with_tables("voxels").replace("WITH ", "WITH RECURSIVE ", 1) + MASK


def mask(spark, sf):
    """Bright voxels of both channels; the channel stands in the stack's number."""
    return tb.voxels(spark, sf).filter("value > 0").withColumn("stack_id", F.col("stack_id") * 2 + F.col("c")).select("stack_id", "t", "z", "x", "y")


FILLED = RECURSIVE + f""", n AS (SELECT unnest(range(0, 4)) AS i),
free AS MATERIALIZED (SELECT f.stack_id, f.t, a.i AS z, b.i AS x, c.i AS y FROM f, n a, n b, n c EXCEPT SELECT * FROM m),
outside AS (SELECT * FROM free WHERE z IN (0, 3) OR x IN (0, 3) OR y IN (0, 3)
  UNION SELECT g.* FROM outside o, {SIDES} JOIN free g ON g.stack_id = o.stack_id AND g.t = o.t AND g.z = o.z + dz AND g.x = o.x + dx AND g.y = o.y + dy),
filled AS (SELECT * FROM m UNION ALL (SELECT * FROM free EXCEPT SELECT * FROM outside))"""


@query("h13_fill_holes_tiles", FILLED + " SELECT * FROM filled")
def _(spark, sf):
    return ti.fill_holes_voxels(mask(spark, sf), (4, 4, 4), (4, 4, 2))


@query("h2_label_tiles", RECURSIVE + f""", reach AS (SELECT stack_id, t, z, x, y, z * 16 + x * 4 + y AS root FROM m
  UNION SELECT g.stack_id, g.t, g.z, g.x, g.y, o.root FROM reach o, {SIDES} JOIN m g ON g.stack_id = o.stack_id AND g.t = o.t AND g.z = o.z + dz AND g.x = o.x + dx AND g.y = o.y + dy WHERE o.root < g.z * 16 + g.x * 4 + g.y)
SELECT stack_id, t, z, x, y, dense_rank() OVER (PARTITION BY stack_id, t ORDER BY root) AS label FROM (SELECT stack_id, t, z, x, y, min(root) AS root FROM reach GROUP BY ALL)""")
def _(spark, sf):
    return ti.label_voxels(mask(spark, sf), (4, 4, 4), (4, 4, 2))


@query("h14_scalespace_histograms", with_tables("voxels", "labels") + blurred(0.5, 1.0) + """, b AS (SELECT stack_id, c, t, sigma_no, CASE WHEN v = 200000 THEN 19 ELSE floor((v + 200000) / 20000) END AS bin, count(*) AS n FROM g3 SEMI JOIN labels USING (stack_id, t, z, x, y) GROUP BY ALL),
f AS (SELECT DISTINCT stack_id, c, t, sigma_no, unnest(range(0, 20)) AS bin FROM voxels, sg)
SELECT stack_id * 2 + c AS stack_id, t, sigma_no, list(CAST(coalesce(n, 0) AS DOUBLE) ORDER BY bin) AS hist FROM f LEFT JOIN b USING (stack_id, c, t, sigma_no, bin) GROUP BY ALL""")
def _(spark, sf):
    return fr.scalespace_histograms(frames(spark, sf), [0.5, 1.0], 20, -200000.0, 200000.0, both_channels(tb.labels(spark, sf)))


@query("h16_threshold_sweep", with_tables("voxels", "labels").replace("WITH ", "WITH RECURSIVE ", 1) + f""", q(threshold) AS (VALUES (CAST(0 AS DOUBLE)), (50000), (100000)),
m AS MATERIALIZED (SELECT stack_id * 2 + c AS stack_id, t, z, x, y, threshold FROM voxels SEMI JOIN labels USING (stack_id, t, z, x, y), q WHERE value > threshold),
reach AS (SELECT *, z * 16 + x * 4 + y AS root FROM m UNION SELECT g.stack_id, g.t, g.z, g.x, g.y, g.threshold, o.root FROM reach o, {SIDES}
  JOIN m g ON g.stack_id = o.stack_id AND g.t = o.t AND g.threshold = o.threshold AND g.z = o.z + dz AND g.x = o.x + dx AND g.y = o.y + dy WHERE o.root < g.z * 16 + g.x * 4 + g.y),
s AS (SELECT stack_id, t, threshold, root, count(*) AS n FROM (SELECT stack_id, t, threshold, z, x, y, min(root) AS root FROM reach GROUP BY ALL) GROUP BY ALL),
r AS (SELECT stack_id, t, threshold, count(*) AS objects, quantile_cont(n, 0.1) AS lo, quantile_cont(n, 0.6) AS hi FROM s GROUP BY ALL), k AS (SELECT s.stack_id, s.t, s.threshold, avg(n) AS mean_size FROM s JOIN r USING (stack_id, t, threshold) WHERE n BETWEEN lo AND hi GROUP BY ALL)
SELECT f.stack_id, f.t, f.threshold, CAST(coalesce(objects, 0) AS INTEGER) AS objects, mean_size FROM (SELECT DISTINCT stack_id * 2 + c AS stack_id, t, threshold FROM voxels, q) f LEFT JOIN r USING (stack_id, t, threshold) LEFT JOIN k USING (stack_id, t, threshold)""")
def _(spark, sf):
    return fr.threshold_sweep(frames(spark, sf), [0.0, 50000.0, 100000.0], both_channels(tb.labels(spark, sf)))


@query("h6_detect_spots")
def _(spark, sf):
    return fr.detect_spots(frames(spark, sf), (0.5,) * 3, (1.5,) * 3, (3, 3, 3), 1.5, 2, 1)


G3 = """, n AS (SELECT stack_id, t, label, z, count(*) AS area FROM labels GROUP BY 1, 2, 3, 4), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, t, label ORDER BY area DESC, z) AS r FROM n) WHERE r = 1),
pix AS (SELECT l.stack_id, l.t, l.label, s.area, l.x, l.y FROM labels l JOIN s USING (stack_id, t, label, z)), st(a, b) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)), di(a, b) AS (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)),
bo AS (SELECT p.* FROM pix p LEFT JOIN (SELECT stack_id, t, label, x + a AS x, y + b AS y, count(*) AS n FROM pix, st GROUP BY 1, 2, 3, 4, 5) q USING (stack_id, t, label, x, y) WHERE coalesce(n, 0) < 4),
k AS (SELECT bo.*, coalesce(s4.n, 0) AS s, coalesce(d4.n, 0) AS d FROM bo LEFT JOIN (SELECT stack_id, t, label, x + a AS x, y + b AS y, count(*) AS n FROM bo, st GROUP BY 1, 2, 3, 4, 5) s4 USING (stack_id, t, label, x, y)
  LEFT JOIN (SELECT stack_id, t, label, x + a AS x, y + b AS y, count(*) AS n FROM bo, di GROUP BY 1, 2, 3, 4, 5) d4 USING (stack_id, t, label, x, y)),
c AS (SELECT stack_id, t, label, any_value(area) AS area, sum(CASE WHEN s >= 2 THEN 1.0 WHEN s = 1 AND d >= 1 THEN (1 + sqrt(2)) / 2 WHEN d >= 2 THEN sqrt(2) ELSE 0 END) AS p FROM k GROUP BY 1, 2, 3)
SELECT stack_id, t, label, round(4 * pi() * area / power(CASE WHEN p = 0 THEN 0.5 ELSE p END, 2), 6) AS circularity FROM c WHERE 4 * pi() * area / power(CASE WHEN p = 0 THEN 0.5 ELSE p END, 2) >= 0.9"""


@query("g3_circularity", with_tables("voxels", "labels") + G3)
def _(spark, sf):
    return fr.circularity(tb.labels(spark, sf), 0.9).withColumn("circularity", F.round("circularity", 6))


@query("j10_track_labels")
def _(spark, sf):
    return tk.track_labels(tb.labels(spark, sf))


@query("j19_link_nearest")
def _(spark, sf):
    return tk.link_nearest(tb.fits(spark, sf), 1, 10.0).select("stack_id", "t", "fit_no", "spot_id")


J20 = with_tables("voxels", "labels").replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT l.stack_id, l.label AS nuc_id, l.t, CAST(l.z * 16 + l.x * 4 + l.y AS BIGINT) AS fit_no, CAST(l.z AS DOUBLE) AS z, CAST(l.x AS DOUBLE) AS x, CAST(l.y AS DOUBLE) AS y,
  row_number() OVER (PARTITION BY l.stack_id, l.label ORDER BY l.t, l.z * 16 + l.x * 4 + l.y) AS rn FROM labels l),
w AS (SELECT stack_id, nuc_id, rn, 1 AS n, t, fit_no, z, x, y, z AS bz, x AS bx, y AS by FROM r WHERE rn = 1 UNION ALL
  SELECT w.stack_id, w.nuc_id, r.rn, CASE WHEN r.t = w.t THEN w.n ELSE w.n + 1 END, r.t, CASE WHEN r.t = w.t AND NOT swap THEN w.fit_no ELSE r.fit_no END, CASE WHEN r.t = w.t AND NOT swap THEN w.z ELSE r.z END, CASE WHEN r.t = w.t AND NOT swap THEN w.x ELSE r.x END, CASE WHEN r.t = w.t AND NOT swap THEN w.y ELSE r.y END,
    CASE WHEN r.t = w.t THEN w.bz ELSE w.z END, CASE WHEN r.t = w.t THEN w.bx ELSE w.x END, CASE WHEN r.t = w.t THEN w.by ELSE w.y END
  FROM w JOIN r ON r.stack_id = w.stack_id AND r.nuc_id = w.nuc_id AND r.rn = w.rn + 1, LATERAL (SELECT w.n > 2 AND power(r.z - w.bz, 2) + power(r.x - w.bx, 2) + power(r.y - w.by, 2) < power(w.z - w.bz, 2) + power(w.x - w.bx, 2) + power(w.y - w.by, 2) AS swap)),
k AS (SELECT stack_id, nuc_id, t, arg_max(fit_no, rn) AS fit_no, arg_max(z, rn) AS z, arg_max(x, rn) AS x, arg_max(y, rn) AS y FROM w GROUP BY 1, 2, 3), f AS (SELECT stack_id, nuc_id, min((t, fit_no)) AS first FROM k GROUP BY 1, 2)
SELECT k.*, CAST(spot_id AS INTEGER) AS spot_id FROM k JOIN (SELECT stack_id, nuc_id, row_number() OVER (PARTITION BY stack_id ORDER BY first) AS spot_id FROM f) USING (stack_id, nuc_id)"""


@query("j20_link_by_nucleus", J20)
def _(spark, sf):
    p = tb.voxels(spark, sf).filter("c = 0").select("stack_id", "t", (F.col("z") * 16 + F.col("x") * 4 + F.col("y")).cast("long").alias("fit_no"), F.col("z").cast("double").alias("z"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return tk.link_by_nucleus(p, tb.labels(spark, sf), (4, 4, 4))


@query("j21_random_controls", with_tables("voxels", "labels") + """, few AS (SELECT DISTINCT stack_id, t, x, y FROM voxels WHERE c = 1 AND value > 150000), free AS (SELECT * FROM labels l WHERE NOT EXISTS (SELECT 1 FROM few f WHERE f.stack_id = l.stack_id AND f.t = l.t AND f.x = l.x AND f.y = l.y)),
pix AS (SELECT *, row_number() OVER (PARTITION BY stack_id, t, z, label ORDER BY x, y) - 1 AS place, count(*) OVER (PARTITION BY stack_id, t, z, label) AS size FROM free),
spots AS (SELECT stack_id, t * 64 + z * 16 + x * 4 + y AS spot_id, t, z, label, unnest(range(0, 3)) AS k FROM labels), size AS (SELECT stack_id, t, z, label, count(*) AS size FROM free GROUP BY 1, 2, 3, 4),
ask AS (SELECT s.*, CAST('0x' || substr(md5(stack_id || '_' || spot_id || '_' || t || '_' || k || '_21'), 1, 12) AS BIGINT) % size AS place FROM spots s JOIN size USING (stack_id, t, z, label))
SELECT stack_id, spot_id, t, CAST(k AS INTEGER) AS k, z, pix.x, pix.y FROM ask JOIN pix USING (stack_id, t, z, label, place)""")
def _(spark, sf):
    spots = tb.labels(spark, sf).select("stack_id", (F.col("t") * 64 + F.col("z") * 16 + F.col("x") * 4 + F.col("y")).alias("spot_id"), "t", "z", F.col("label").alias("nuc_id"))
    foci = tb.voxels(spark, sf).filter("c = 1 AND value > 150000").select("stack_id", "t", "x", "y")
    return tk.random_controls(spots, tb.labels(spark, sf), 3, 21, foci)


@query("w13_two_state_bursts")
def _(spark, sf):
    return tk.two_state_bursts(tb.traces(spark, sf))
