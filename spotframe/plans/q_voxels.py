"""Queries over voxels and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.operators import voxels as vx
from spotframe.plans import tables as tb
from spotframe.plans.registry import query
from spotframe.plans.tables import with_tables

SIZE = (4, 4, 4)
VL = with_tables("voxels", "labels")


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


def points(spark, sf):
    """One spot per frame of channel 0."""
    v = tb.voxels(spark, sf).filter("c = 0 AND z = 0 AND x = 0 AND y = 0")
    n = F.abs(F.col("value")).cast("long")
    return v.select("stack_id", "t", F.col("t").alias("spot_id"), (n % 4 + 0.5).alias("z"), (F.floor(n / 7) % 5 - 0.5).alias("x"), (F.floor(n / 31) % 4 + 0.0).alias("y"))


POINTS = ", points AS (SELECT stack_id, t, t AS spot_id, n % 4 + 0.5 AS z, (n // 7) % 5 - 0.5 AS x, CAST((n // 31) % 4 AS DOUBLE) AS y FROM (SELECT *, CAST(abs(value) AS BIGINT) AS n FROM voxels WHERE c = 0 AND z = 0 AND x = 0 AND y = 0))"


@query("j1_nucleus_of", VL + POINTS + """ SELECT p.stack_id, p.spot_id, coalesce(l.label, 0) AS nuc_id FROM points p LEFT JOIN labels l ON l.stack_id = p.stack_id AND l.t = p.t
  AND l.z = greatest(0, least(3, trunc(p.z))) AND l.x = greatest(0, least(3, trunc(p.x))) AND l.y = greatest(0, least(3, trunc(p.y)))""")
def _(spark, sf):
    return vx.nucleus_of(points(spark, sf), tb.labels(spark, sf), SIZE).select("stack_id", "spot_id", "nuc_id")


@query("g7_spots_per_nucleus", VL + POINTS + """, n AS (SELECT l.stack_id, l.t, l.label, count(*) AS n FROM points p JOIN labels l ON l.stack_id = p.stack_id AND l.t = p.t
  AND l.z = greatest(0, least(3, trunc(p.z))) AND l.x = greatest(0, least(3, trunc(p.x))) AND l.y = greatest(0, least(3, trunc(p.y))) GROUP BY 1, 2, 3)
SELECT d.stack_id, d.t, d.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT stack_id, t, label FROM labels) d LEFT JOIN n USING (stack_id, t, label)""")
def _(spark, sf):
    return vx.spots_per_nucleus(points(spark, sf), tb.labels(spark, sf), SIZE)


@query("j2_volume_mean", VL + POINTS + """ SELECT p.stack_id, p.t, p.spot_id, round(avg(v.value), 4) AS mean FROM points p JOIN voxels v ON v.stack_id = p.stack_id AND v.t = p.t AND v.c = 1
  AND sqrt(2.25 * power(v.z - trunc(p.z), 2) + power(v.x - trunc(p.x), 2) + power(v.y - trunc(p.y), 2)) <= 1.5 AND abs(v.z - trunc(p.z)) <= 1 AND abs(v.x - trunc(p.x)) <= 1 AND abs(v.y - trunc(p.y)) <= 1 GROUP BY 1, 2, 3""")
def _(spark, sf):
    return vx.add_volume_mean(points(spark, sf), tb.voxels(spark, sf), 1, 1.5, 1.0).select("stack_id", "t", "spot_id", F.round("mean", 4).alias("mean"))


BOXES = POINTS + """, o AS (SELECT unnest(range(-1, 2)) AS d), boxes AS (SELECT p.stack_id, p.t, p.spot_id, CAST(a.d AS INTEGER) AS dz, CAST(b.d AS INTEGER) AS dx, CAST(c.d AS INTEGER) AS dy, coalesce(v.value, -1.0) AS value
  FROM points p, o a, o b, o c LEFT JOIN voxels v ON v.stack_id = p.stack_id AND v.t = p.t AND v.c = 0 AND v.z = trunc(p.z) + a.d AND v.x = trunc(p.x) + b.d AND v.y = trunc(p.y) + c.d)"""


def boxes(spark, sf):
    return vx.spot_boxes(points(spark, sf), tb.voxels(spark, sf), 0, (3, 3, 3), -1.0)


@query("j3_spot_boxes", VL + BOXES + " SELECT * FROM boxes")
def _(spark, sf):
    return boxes(spark, sf)


@query("g14_fg_bg", VL + BOXES + """, k AS (SELECT *, abs(dz) <= 0 AND abs(dx) <= 1 AND abs(dy) <= 1 AS i FROM boxes), r AS (SELECT *, row_number() OVER (PARTITION BY stack_id, t, spot_id, i ORDER BY value DESC, dz, dx, dy) AS r FROM k)
SELECT stack_id, t, spot_id, round(avg(value) FILTER (i), 4) AS fg, round(avg(value) FILTER (i) - avg(value) FILTER (NOT i), 4) AS net, round(avg(value) FILTER (i AND r <= 3), 4) AS top FROM r GROUP BY 1, 2, 3""")
def _(spark, sf):
    out = vx.fg_bg_intensity(boxes(spark, sf), (1, 3, 3), (3, 3, 3), ["stack_id", "t", "spot_id"])
    return out.select("stack_id", "t", "spot_id", *[F.round(c, 4).alias(c) for c in ("fg", "net", "top")])


@query("g43_spot_mean_over_time", VL + BOXES + """, inside AS (SELECT stack_id, t, spot_id FROM points WHERE trunc(z) BETWEEN 1 AND 2 AND trunc(x) BETWEEN 1 AND 2 AND trunc(y) BETWEEN 1 AND 2),
f AS (SELECT b.stack_id, b.t, spot_id, avg(value) FILTER (dz = 0) AS fg, avg(value) FILTER (dz <> 0) AS bg FROM boxes b JOIN inside USING (stack_id, t, spot_id) GROUP BY 1, 2, 3)
SELECT t, round(avg(fg), 4) AS fg, round(avg(fg - bg), 4) AS net, count(*) AS n FROM f GROUP BY 1""")
def _(spark, sf):
    out = vx.spot_mean_over_time(points(spark, sf), tb.voxels(spark, sf), 0, (1, 3, 3), (3, 3, 3), SIZE)
    return out.select("t", F.round("fg", 4).alias("fg"), F.round("net", 4).alias("net"), "n")


@query("h5_window_moments", VL + BOXES + """, v AS (SELECT stack_id, t, spot_id, dz, dx, dy, abs(value) AS value FROM boxes), m AS (SELECT stack_id, t, spot_id, sum(dz * value) / sum(value) AS mz, sum(dx * value) / sum(value) AS mx, sum(dy * value) / sum(value) AS my, max(value) AS height FROM v GROUP BY 1, 2, 3),
k AS (SELECT *, dz + 1 = trunc(mz + 1) AS oz, dx + 1 = trunc(mx + 1) AS ox, dy + 1 = trunc(my + 1) AS oy FROM v JOIN m USING (stack_id, t, spot_id))
SELECT stack_id, t, spot_id, round(any_value(mz), 6) AS mean_z, round(any_value(mx), 6) AS mean_x, round(any_value(my), 6) AS mean_y, any_value(height) AS height,
  round(sqrt(sum(power(dz - mz, 2) * value) FILTER (ox AND oy) / nullif(sum(value) FILTER (ox AND oy), 0)), 6) AS width_z, round(sqrt(sum(power(dx - mx, 2) * value) FILTER (oz AND oy) / nullif(sum(value) FILTER (oz AND oy), 0)), 6) AS width_x,
  round(sqrt(sum(power(dy - my, 2) * value) FILTER (oz AND ox) / nullif(sum(value) FILTER (oz AND ox), 0)), 6) AS width_y FROM k GROUP BY 1, 2, 3""")
def _(spark, sf):
    out = vx.window_moments(boxes(spark, sf).withColumn("value", F.abs("value")), ["stack_id", "t", "spot_id"])
    return out.select("stack_id", "t", "spot_id", *map(r6, ("mean_z", "mean_x", "mean_y")), "height", *map(r6, ("width_z", "width_x", "width_y")))


@query("g33_mean_image", VL + BOXES + " SELECT dz, dx, dy, round(avg(value), 4) AS value FROM boxes GROUP BY 1, 2, 3")
def _(spark, sf):
    return vx.mean_image(boxes(spark, sf)).select("dz", "dx", "dy", F.round("value", 4).alias("value"))


@query("g34_psf_scale", VL + BOXES + """, img AS (SELECT dz, dx, dy, avg(abs(value)) AS value FROM boxes GROUP BY 1, 2, 3), c AS (SELECT k, sum(abs(value - k * 1000.0 / (1 + abs(dz) + abs(dx) + abs(dy)))) AS cost FROM img, (SELECT unnest(range(0, 201, 10)) AS k) GROUP BY 1)
SELECT CAST(arg_min(k, cost) AS INTEGER) AS k, round(min(cost), 2) AS cost FROM c""")
def _(spark, sf):
    img = vx.mean_image(boxes(spark, sf).withColumn("value", F.abs("value")))
    psf = img.select("dz", "dx", "dy", (1000.0 / (1 + F.abs("dz") + F.abs("dx") + F.abs("dy"))).alias("psf"))
    return vx.fit_psf_scale(img, psf, 200, 10).select("k", F.round("cost", 2).alias("cost"))


@query("g1_label_size", VL + " SELECT l.* FROM labels l JOIN (SELECT stack_id, t, label FROM labels GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 16 AND 20) USING (stack_id, t, label)")
def _(spark, sf):
    return vx.filter_label_size(tb.labels(spark, sf), 16, 20).select("stack_id", "t", "z", "x", "y", "label")


@query("g2_centroids", VL + " SELECT stack_id, t, label, CAST(trunc(avg(z)) AS INTEGER) AS z, CAST(trunc(avg(x)) AS INTEGER) AS x, CAST(trunc(avg(y)) AS INTEGER) AS y FROM labels GROUP BY 1, 2, 3")
def _(spark, sf):
    return vx.centroids(tb.labels(spark, sf))


@query("g4_edge_labels", VL + " SELECT l.* FROM labels l JOIN (SELECT stack_id, t, label FROM labels GROUP BY 1, 2, 3 HAVING count(*) FILTER (x = 0 OR x = 3 OR y = 0 OR y = 3) <= 11) USING (stack_id, t, label)")
def _(spark, sf):
    return vx.drop_edge_labels(tb.labels(spark, sf), (4, 4), 11).select("stack_id", "t", "z", "x", "y", "label")


@query("g5_relabel", VL + """, s AS (SELECT stack_id, label, row_number() OVER (PARTITION BY stack_id ORDER BY count(*) DESC, label) AS r FROM labels GROUP BY 1, 2),
n AS (SELECT stack_id, label, CASE WHEN r = 1 THEN 0 ELSE row_number() OVER (PARTITION BY stack_id, r = 1 ORDER BY label) END AS new FROM s)
SELECT stack_id, t, z, x, y, CAST(new AS INTEGER) AS label FROM labels JOIN n USING (stack_id, label)""")
def _(spark, sf):
    return vx.relabel(tb.labels(spark, sf))


@query("g3_largest_slice", VL + " SELECT stack_id, t, label, CAST(min(z) AS INTEGER) AS z, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, t, label ORDER BY n DESC, z) AS r FROM (SELECT stack_id, t, label, z, count(*) AS n FROM labels GROUP BY 1, 2, 3, 4)) WHERE r = 1 GROUP BY 1, 2, 3")
def _(spark, sf):
    per = tb.labels(spark, sf).groupBy("stack_id", "t", "label", "z").agg(F.count("*").alias("n"))
    return per.groupBy("stack_id", "t", "label").agg(F.max_by("z", F.struct("n", -F.col("z"))).alias("z"), F.max("n").alias("n"))


MATCH = """, a AS (SELECT * FROM labels), b AS (SELECT stack_id, t - 1 AS t, z, x, y, label FROM labels), full_a AS (SELECT v.stack_id, v.t, v.z, v.x, v.y, coalesce(a.label, 0) AS la, coalesce(b.label, 0) AS lb
  FROM (SELECT DISTINCT stack_id, t, z, x, y FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) v LEFT JOIN a USING (stack_id, t, z, x, y) LEFT JOIN b USING (stack_id, t, z, x, y)),
h AS (SELECT stack_id, t, la, lb, count(*) AS n FROM full_a GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY stack_id, t, la ORDER BY n DESC, lb DESC) AS ra, row_number() OVER (PARTITION BY stack_id, t, lb ORDER BY n DESC, la DESC) AS rb FROM h)
SELECT stack_id, t, la, lb, n FROM r WHERE ra = 1 AND rb = 1 AND la > 0 AND lb > 0"""


@query("j9_match_labels", VL + MATCH)
def _(spark, sf):
    a = tb.labels(spark, sf)
    return vx.match_labels(a, a.withColumn("t", F.col("t") - 1), ["stack_id", "t"]).select("stack_id", "t", "la", "lb", "n")


CONNECT = """, u AS (SELECT a.stack_id, a.t, a.label AS la, b.label AS lb, count(*) AS n FROM labels a JOIN labels b ON a.stack_id = b.stack_id AND a.t = b.t - 1 AND a.z = b.z AND a.x = b.x AND a.y = b.y GROUP BY 1, 2, 3, 4),
s AS (SELECT stack_id, t - 1 AS t, label AS lb, count(*) AS size_b FROM labels GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY stack_id, t, la ORDER BY n DESC, lb DESC) AS ra, row_number() OVER (PARTITION BY stack_id, t, lb ORDER BY n DESC, la DESC) AS rb FROM u JOIN s USING (stack_id, t, lb))"""


def connected(spark, sf, how):
    a, keys = tb.labels(spark, sf), ["stack_id", "t"]
    return vx.connect_labels(vx.overlaps(a, a.withColumn("t", F.col("t") - 1), keys), keys, how, 0.5).select(*keys, "la", "lb", "n")


@query("j9_connect_contained", VL + CONNECT + " SELECT stack_id, t, la, lb, n FROM r WHERE rb = 1 AND n >= 0.5 * size_b")
def _(spark, sf):
    return connected(spark, sf, "contained")


@query("j9_connect_merge", VL + CONNECT + " SELECT stack_id, t, la, lb, n FROM r WHERE ra = 1")
def _(spark, sf):
    return connected(spark, sf, "merge")


@query("g1_filter_labels", VL + " SELECT l.* FROM labels l JOIN (SELECT v.stack_id, v.t, label FROM labels k JOIN voxels v ON v.stack_id = k.stack_id AND v.t = k.t AND v.c = 1 AND v.z = k.z AND v.x = k.x AND v.y = k.y GROUP BY 1, 2, 3 HAVING avg(value) BETWEEN -200000 AND 200000) USING (stack_id, t, label)")
def _(spark, sf):
    labels, v = tb.labels(spark, sf), tb.voxels(spark, sf).filter("c = 1").drop("c")
    brightness = labels.join(v, ["stack_id", "t", "z", "x", "y"]).groupBy("stack_id", "t", "label").agg(F.avg("value").alias("value"))
    return vx.filter_labels(labels, brightness, -200000, 200000).select("stack_id", "t", "z", "x", "y", "label")


@query("j11_fill_missing", VL + """, c AS (SELECT stack_id, label, t, trunc(avg(z)) AS cz, trunc(avg(x)) AS cx, trunc(avg(y)) AS cy FROM labels GROUP BY 1, 2, 3), f AS (SELECT stack_id, min(t) AS lo, max(t) AS hi FROM voxels GROUP BY 1),
n AS (SELECT *, lead(t) OVER w AS nt, lag(t) OVER w AS pt, lead(cz) OVER w AS nz, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny FROM c JOIN f USING (stack_id) WINDOW w AS (PARTITION BY stack_id, label ORDER BY t)),
g AS (SELECT stack_id, label, t, unnest(range(t + 1, nt)) AS dest, trunc((cz + nz) / 2) - cz AS sz, trunc((cx + nx) / 2) - cx AS sx, trunc((cy + ny) / 2) - cy AS sy FROM n WHERE nt - t > 1 AND nt - t - 1 <= 2
  UNION ALL SELECT stack_id, label, t, unnest(range(t + 1, hi + 1)), 0, 0, 0 FROM n WHERE nt IS NULL AND hi > t AND hi - t <= 2
  UNION ALL SELECT stack_id, label, t, unnest(range(lo, t)), 0, 0, 0 FROM n WHERE pt IS NULL AND t > lo AND t - lo <= 2),
m AS (SELECT l.stack_id, g.dest AS t, l.z + sz AS z, l.x + sx AS x, l.y + sy AS y, l.label FROM labels l JOIN g USING (stack_id, label, t))
SELECT stack_id, t, z, x, y, label FROM labels UNION ALL
SELECT stack_id, CAST(t AS INTEGER), CAST(z AS INTEGER), CAST(x AS INTEGER), CAST(y AS INTEGER), max(label) FROM m WHERE z BETWEEN 0 AND 3 AND x BETWEEN 0 AND 3 AND y BETWEEN 0 AND 3 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.stack_id = m.stack_id AND l.t = m.t AND l.z = m.z AND l.x = m.x AND l.y = m.y) GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    return vx.fill_missing_labels(tb.labels(spark, sf), tb.voxels(spark, sf).select("stack_id", "t").distinct(), SIZE)


@query("h3_dilate", VL + """, o AS (SELECT unnest(range(-1, 2)) AS d) SELECT stack_id, t, CAST(z + a.d AS INTEGER) AS z, CAST(x + b.d AS INTEGER) AS x, CAST(y + c.d AS INTEGER) AS y, max(label) AS label FROM labels, o a, o b, o c
  WHERE z + a.d BETWEEN 0 AND 3 AND x + b.d BETWEEN 0 AND 3 AND y + c.d BETWEEN 0 AND 3 GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    return vx.dilate(tb.labels(spark, sf), (3, 3, 3), SIZE)


@query("h3_erode", VL + """ SELECT l.* FROM labels l WHERE (SELECT count(*) FROM labels m WHERE m.stack_id = l.stack_id AND m.t = l.t AND abs(m.z - l.z) <= 0 AND abs(m.x - l.x) <= 1 AND abs(m.y - l.y) <= 1) = 9""")
def _(spark, sf):
    return vx.erode(tb.labels(spark, sf), (1, 3, 3)).select("stack_id", "t", "z", "x", "y", "label")


@query("j26_movement", VL + """, c AS (SELECT stack_id, t, label, trunc(avg(x)) AS x, trunc(avg(y)) AS y FROM labels GROUP BY 1, 2, 3)
SELECT c.stack_id, c.t, CAST(trunc(avg(c.x - z.x)) AS INTEGER) AS sx, CAST(trunc(avg(c.y - z.y)) AS INTEGER) AS sy FROM c JOIN c z ON z.stack_id = c.stack_id AND z.label = c.label AND z.t = 0 GROUP BY 1, 2""")
def _(spark, sf):
    return vx.movement(tb.labels(spark, sf))


V = ["stack_id", "c", "t", "z", "x", "y"]


@query("p11_threshold_slope", VL + " SELECT stack_id, c, t, z, x, y FROM voxels WHERE value >= 50000 + (z - 2) * 9000.0")
def _(spark, sf):
    return vx.threshold_with_slope(tb.voxels(spark, sf), 50000.0, 2, 9000.0).select(V)


@query("p13_mask_voxels", VL + " SELECT v.stack_id, c, v.t, v.z, v.x, v.y, CASE WHEN l.label IS NULL THEN 0 ELSE value END AS value FROM voxels v LEFT JOIN labels l ON l.stack_id = v.stack_id AND l.t = v.t AND l.z = v.z AND l.x = v.x AND l.y = v.y")
def _(spark, sf):
    return vx.mask_voxels(tb.voxels(spark, sf), tb.labels(spark, sf)).select(*V, "value")


@query("g8_bleach_factors", VL + " SELECT stack_id, c, t, round(sum(s) OVER w / sum(n) OVER w / (s / n), 4) AS factor FROM (SELECT stack_id, c, t, sum(value + 1e6) AS s, count(*) AS n FROM voxels GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY stack_id, c)")
def _(spark, sf):
    v = tb.voxels(spark, sf).withColumn("value", F.col("value") + 1e6)
    return vx.frame_bleach_factors(v).select("stack_id", "c", "t", F.round("factor", 4).alias("factor"))


@query("g10_nuclear_mean", VL + " SELECT stack_id, c, t, round(avg(value), 4) AS mean FROM voxels JOIN labels USING (stack_id, t, z, x, y) GROUP BY 1, 2, 3")
def _(spark, sf):
    return vx.nuclear_frame_mean(tb.voxels(spark, sf), tb.labels(spark, sf)).select("stack_id", "c", "t", F.round("mean", 4).alias("mean"))


for _how, _fn in (("max", "max"), ("mean", "avg"), ("sum", "sum")):

    @query(f"g18_project_{_how}", VL + f" SELECT stack_id, c, t, x, y, round({_fn}(value), 3) AS value FROM voxels GROUP BY 1, 2, 3, 4, 5")
    def _(spark, sf, how=_how):
        return vx.project(tb.voxels(spark, sf), "z", how).withColumn("value", F.round("value", 3))


@query("g18_expand", VL + " SELECT stack_id, c, t, x, y, value, CAST(z AS INTEGER) AS z FROM (SELECT stack_id, c, t, x, y, max(value) AS value FROM voxels GROUP BY 1, 2, 3, 4, 5), (SELECT unnest(range(0, 3)) AS z)")
def _(spark, sf):
    return vx.expand_projection(vx.project(tb.voxels(spark, sf), "z"), 3)


@query("g17_radial_profile", VL + " SELECT stack_id, c, CAST(trunc(sqrt(power(x - 2, 2) + power(y - 2, 2))) AS INTEGER) AS r, round(avg(value), 4) AS mean FROM voxels GROUP BY 1, 2, 3")
def _(spark, sf):
    return vx.radial_profile(tb.voxels(spark, sf), (2, 2), ["stack_id", "c"]).select("stack_id", "c", "r", F.round("mean", 4).alias("mean"))


@query("g19_background_channel", VL + """, v AS (SELECT stack_id, c, t, z, x, y, value + 1e6 AS value FROM voxels), b AS (SELECT stack_id, z, x, y, avg(value) AS b FROM v WHERE c = 0 GROUP BY 1, 2, 3, 4), k AS (SELECT stack_id, avg(value) FILTER (c = 1) / avg(value) FILTER (c = 0) AS k FROM v GROUP BY 1),
r AS (SELECT stack_id, c, t, z, x, y, value - b * k AS value FROM v JOIN b USING (stack_id, z, x, y) JOIN k USING (stack_id) WHERE c = 1)
SELECT stack_id, c, t, z, x, y, round(value + abs(min(value) OVER (PARTITION BY stack_id)), 2) AS value FROM r""")
def _(spark, sf):
    return vx.subtract_background_channel(tb.voxels(spark, sf).withColumn("value", F.col("value") + 1e6)).select(*V, F.round("value", 2).alias("value"))


@query("g20_minmax", VL + " SELECT stack_id, c, t, z, x, y, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS value FROM voxels WINDOW w AS (PARTITION BY stack_id, c, t)")
def _(spark, sf):
    return vx.normalize_minmax(tb.voxels(spark, sf), ["stack_id", "c", "t"]).select(*V, r6("value"))


@query("g20_slices", VL + " SELECT stack_id, c, t, z, x, y, round((value + 1e6) / avg(value + 1e6) OVER (PARTITION BY stack_id, c, t, z) * avg(value + 1e6) OVER (PARTITION BY stack_id, c, t), 3) AS value FROM voxels")
def _(spark, sf):
    return vx.normalize_slices(tb.voxels(spark, sf).withColumn("value", F.col("value") + 1e6)).select(*V, F.round("value", 3).alias("value"))


@query("h10_normalize_masked", VL + " SELECT stack_id, c, t, z, x, y, CASE WHEN value > 0 THEN round((value - min(CASE WHEN value > 0 THEN value END) OVER w) / nullif(max(value) OVER w - min(CASE WHEN value > 0 THEN value END) OVER w, 0), 6) ELSE 0 END AS value FROM voxels WINDOW w AS (PARTITION BY stack_id, c, t)")
def _(spark, sf):
    return vx.normalize_masked(tb.voxels(spark, sf), ["stack_id", "c", "t"]).select(*V, r6("value"))


PAIR = ", p AS (SELECT a.stack_id, a.t, a.value AS a, b.value AS b FROM voxels a JOIN voxels b USING (stack_id, t, z, x, y) JOIN labels USING (stack_id, t, z, x, y) WHERE a.c = 0 AND b.c = 1)"


@query("g21_signal_by_quantile", VL + PAIR + """, q AS (SELECT stack_id, t, quantile_cont(a, [0.0, 0.25, 0.5, 0.75, 1.0]) AS cuts FROM p GROUP BY 1, 2)
SELECT stack_id, t, CAST(k AS INTEGER) AS q, round(avg(b), 4) AS mean, round(median(b), 4) AS median, count(*) AS n FROM p JOIN q USING (stack_id, t), (SELECT unnest(range(0, 4)) AS k) WHERE a >= cuts[k + 1] AND a <= cuts[k + 2] GROUP BY 1, 2, 3""")
def _(spark, sf):
    out = vx.signal_by_quantile(tb.voxels(spark, sf), tb.labels(spark, sf), 0, 1, 4)
    return out.select("stack_id", "t", "q", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "n")


@query("g22_hotspot_overlap", VL + PAIR + ", c AS (SELECT stack_id, t, quantile_cont(a, 0.6) AS pa, quantile_cont(b, 0.6) AS pb FROM p GROUP BY 1, 2) SELECT stack_id, t, round(avg(CASE WHEN a > pa AND b > pb THEN 1.0 ELSE 0.0 END), 6) AS share FROM p JOIN c USING (stack_id, t) GROUP BY 1, 2")
def _(spark, sf):
    return vx.hotspot_overlap(tb.voxels(spark, sf), tb.labels(spark, sf), 0, 1, 0.6).select("stack_id", "t", r6("share"))


HIST = """, h AS (SELECT g.stack_id, CAST(b AS INTEGER) AS bin, count(v.value) AS n FROM (SELECT stack_id, unnest(range(0, 20)) AS b FROM (SELECT DISTINCT stack_id FROM voxels)) g
  LEFT JOIN voxels v ON v.stack_id = g.stack_id AND v.value >= -200000 AND v.value <= 200000 AND least(floor((v.value + 200000) / 20000), 19) = b GROUP BY 1, 2)"""


@query("g23_histogram", VL + HIST + " SELECT stack_id, bin, n FROM h")
def _(spark, sf):
    return vx.histogram(tb.voxels(spark, sf), ["stack_id"], "value", 20, -200000.0, 200000.0)


@query("g24_log_histogram", VL + HIST + ", s AS (SELECT *, n / sum(n) OVER (PARTITION BY stack_id) AS s FROM h) SELECT stack_id, bin, n, round(ln(s + min(CASE WHEN s > 0 THEN s END) OVER (PARTITION BY stack_id)), 6) AS log_share FROM s")
def _(spark, sf):
    h = vx.histogram(tb.voxels(spark, sf), ["stack_id"], "value", 20, -200000.0, 200000.0)
    return vx.log_histogram(h, ["stack_id"]).select("stack_id", "bin", "n", r6("log_share"))


@query("g37_otsu", VL + """, r AS (SELECT stack_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM voxels WHERE c = 0 WINDOW w AS (PARTITION BY stack_id)),
h AS (SELECT stack_id, lo, hi, CAST(least(floor((value - lo) / ((hi - lo) / 64)), 63) AS INTEGER) AS bin, count(*) AS n FROM r GROUP BY 1, 2, 3, 4), m AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 64) AS mid FROM h),
c AS (SELECT *, sum(n) OVER u AS nu, sum(n) OVER d AS nd, sum(n * mid) OVER u / sum(n) OVER u AS mu, sum(n * mid) OVER d / sum(n) OVER d AS md FROM m
  WINDOW u AS (PARTITION BY stack_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY stack_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT stack_id, round(mid, 3) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY nu * nd * power(mu - md, 2) DESC NULLS LAST, bin) AS r FROM c) WHERE r = 1""")
def _(spark, sf):
    return vx.otsu_threshold(tb.voxels(spark, sf).filter("c = 0"), ["stack_id"], 64).select("stack_id", F.round("threshold", 3).alias("threshold"))


@query("k10_max_in_nucleus", VL + " SELECT stack_id, c, t, z, x, y, value, label FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, c, t, label ORDER BY value DESC, z, x, y) AS r FROM voxels JOIN labels USING (stack_id, t, z, x, y)) WHERE r = 1")
def _(spark, sf):
    return vx.max_in_nucleus(tb.voxels(spark, sf), tb.labels(spark, sf)).select(*V, "value", "label")


@query("g32_concentration", VL + " SELECT stack_id, c, t, label, round(sum(value) / 250.0 / (40 / 33.54) / 6.02214076e23 / (count(*) * 0.02 * 1e-15) * 1e9, 3) AS \"nM\" FROM voxels JOIN labels USING (stack_id, t, z, x, y) GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return vx.concentration(tb.voxels(spark, sf), tb.labels(spark, sf), 0.02, 250.0, 40.0).select("stack_id", "c", "t", "label", F.round("nM", 3).alias("nM"))


@query("h11_augment", VL + " SELECT stack_id, c, t, z, CAST(3 - y AS INTEGER) AS x, CAST(3 - x AS INTEGER) AS y, value FROM voxels")
def _(spark, sf):
    return vx.rotate(vx.flip(tb.voxels(spark, sf), 4), 4, 1).select(*V, "value")


@query("s4_trim_incomplete", VL + ", v AS (SELECT stack_id, t, z, CASE WHEN t % 5 = 4 AND z = 3 THEN 0 ELSE value END AS value FROM voxels WHERE c = 0), m AS (SELECT stack_id, max(t) AS last FROM v GROUP BY 1), bad AS (SELECT DISTINCT stack_id, t FROM v JOIN m USING (stack_id) WHERE t = last GROUP BY stack_id, t, z HAVING min(value) = 0 AND max(value) = 0) SELECT stack_id, t, count(*) AS n FROM v WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.stack_id = v.stack_id AND b.t = v.t) GROUP BY 1, 2")
def _(spark, sf):
    from spotframe.sources.frames import trim_incomplete

    v = tb.voxels(spark, sf).filter("c = 0").withColumn("value", F.when((F.col("t") % 5 == 4) & (F.col("z") == 3), 0.0).otherwise(F.col("value")))
    return trim_incomplete(v).groupBy("stack_id", "t").agg(F.count("*").alias("n"))


@query("s3_span", VL + " SELECT stack_id, CAST(t - 2 AS INTEGER) AS t, count(*) AS n FROM voxels WHERE t BETWEEN 2 AND 6 GROUP BY 1, 2")
def _(spark, sf):
    from spotframe.sources.frames import span

    return span(tb.voxels(spark, sf), 2, 6).groupBy("stack_id", "t").agg(F.count("*").alias("n"))
