"""Queries over embeddings, parameters and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.functions import scalar as sc
from spotframe.operators import embed as em
from spotframe.operators import spots as sp
from spotframe.plans import tables as tb
from spotframe.plans.registry import query
from spotframe.plans.tables import with_tables

EMB = with_tables("emb")
DIST = "list_distance"


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


@query("j14_near_center", EMB + """, m AS (SELECT i, avg(v) AS m FROM (SELECT unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM emb WHERE regexp_matches(name, '^s2_')) GROUP BY 1), c AS (SELECT list(m ORDER BY i) AS c FROM m)
SELECT id, round(list_distance(embedding, c), 6) AS distance FROM emb, c WHERE list_distance(embedding, c) <= 1.0""")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    return em.sims_near_center(sp.match_names(e, "^s2_"), e, 1.0).select("id", r6("distance"))


@query("p10_distance_band", EMB + ", q AS (SELECT embedding AS q FROM emb WHERE id = 7) SELECT id, round(list_distance(embedding, q), 6) AS distance FROM emb, q WHERE list_distance(embedding, q) > 0.9 AND list_distance(embedding, q) <= 1.3")
def _(spark, sf):
    return em.distance_band(em.nearest_to(tb.named_embeddings(spark, sf), 7), 0.9, 1.3).select("id", r6("distance"))


@query("k3_nearest", EMB + ", q AS (SELECT embedding AS q FROM emb WHERE id = 7) SELECT id, name, round(list_distance(embedding, q), 6) AS distance FROM emb, q")
def _(spark, sf):
    return em.nearest_to(tb.named_embeddings(spark, sf), 7).select("id", "name", r6("distance"))


@query("k2_knn_tags", EMB + """, d AS (SELECT a.id, b.id AS other, b.name AS tag, list_distance(a.embedding, b.embedding) AS distance FROM emb a, emb b WHERE regexp_matches(a.name, '^s1_'))
SELECT id, rank, other, tag, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d) WHERE rank <= 5""")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    near = em.knn(e, sp.match_names(e, "^s1_"), 5)
    return near.join(e.select(F.col("id").alias("other"), F.col("name").alias("tag")), "other").select("id", F.col("rank").cast("long").alias("rank"), "other", "tag", r6("distance"))


@query("j15_radius_hits", EMB + " SELECT DISTINCT b.id FROM emb a, emb b WHERE a.id % 50 = 0 AND list_distance(a.embedding, b.embedding) <= 1.1")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    return em.radius_hits(e.filter("id % 50 = 0"), e, 1.1)


def halves(spark, sf):
    e = tb.named_embeddings(spark, sf).withColumn("pair", F.floor(F.col("id") / 2))
    return e.filter("set = 'left'"), e.filter("set = 'right'")


RANKS = """, l AS (SELECT id, id // 2 AS pair, embedding FROM emb WHERE id % 2 = 0), r AS (SELECT id, id // 2 AS pair, embedding FROM emb WHERE id % 2 = 1), e AS (SELECT id, embedding FROM emb),
f AS (SELECT l.pair, count(*) FILTER (list_distance(l.embedding, c.embedding) < list_distance(l.embedding, r.embedding)) AS n FROM l JOIN r USING (pair), e c WHERE c.id <> l.id AND c.id <> r.id GROUP BY 1),
b AS (SELECT l.pair, count(*) FILTER (list_distance(r.embedding, c.embedding) < list_distance(l.embedding, r.embedding)) AS n FROM l JOIN r USING (pair), e c WHERE c.id <> l.id AND c.id <> r.id GROUP BY 1),
ranks AS (SELECT pair, f.n AS forward, b.n AS backward, (f.n + b.n) / 2 AS rank FROM f JOIN b USING (pair))"""


@query("k1_rank_pairs", EMB + RANKS + " SELECT pair, forward, backward, rank FROM ranks")
def _(spark, sf):
    return em.rank_pairs(*halves(spark, sf), ties=False)


@query("g36_rank_summary", EMB + RANKS + " SELECT 'm' AS model, CASE WHEN pair % 2 = 0 THEN 'a' ELSE 'b' END AS set, round(avg(rank), 6) AS mean_rank, round(avg(CASE WHEN rank = 0 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 4 THEN 1.0 ELSE 0 END), 6) AS top5 FROM ranks GROUP BY 1, 2")
def _(spark, sf):
    ranks = em.rank_pairs(*halves(spark, sf), ties=False).select(F.lit("m").alias("model"), F.when(F.col("pair") % 2 == 0, "a").otherwise("b").alias("set"), "rank")
    return em.rank_summary(ranks).select("model", "set", r6("mean_rank"), r6("top1"), r6("top5"))


@query("k4_topn_agreement", EMB + """, d AS (SELECT a.id, b.id AS other, list_distance(a.embedding, b.embedding) AS d, list_distance(a.embedding[1:9], b.embedding[1:9]) AS p FROM emb a, emb b WHERE a.id <> b.id),
n AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k, row_number() OVER (PARTITION BY id ORDER BY p, other) AS j FROM d) SELECT round(avg(CASE WHEN k <= 50 THEN 1.0 ELSE 0 END), 6) AS share FROM n WHERE j = 1""")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    first = e.withColumn("embedding", F.slice("embedding", 1, 9))  # nine parameters
    return em.topn_agreement(em.knn(e, e, 51), em.knn(first, first, 3), 50).select(r6("share"))


PARTS = ", p AS (SELECT id, CAST(string_split(name, '_')[2:10] AS DOUBLE[]) AS params FROM sims)"


def params(spark, sf):
    return sp.parse_sim_names(tb.sim_names(spark, sf)).withColumn("params", F.slice("params", 1, 4)).withColumn("embedding", F.col("params"))


ONE = with_tables("sims") + PARTS + """, k AS (SELECT id, params[1:4] AS p, unnest(range(1, 5)) AS k FROM p), w AS (SELECT id, p, k, p[k] AS v, [CASE WHEN k = 1 THEN -1 ELSE p[1] END, CASE WHEN k = 2 THEN -1 ELSE p[2] END, CASE WHEN k = 3 THEN -1 ELSE p[3] END, CASE WHEN k = 4 THEN -1 ELSE p[4] END] AS rest FROM k),
pairs AS (SELECT a.id, b.id AS other, CAST(a.k - 1 AS INTEGER) AS k, a.v - b.v AS difference, list_distance(a.p, b.p) AS distance FROM w a JOIN w b ON a.k = b.k AND a.rest = b.rest AND a.v <> b.v)"""


@query("j16_one_param_pairs", ONE + " SELECT id, other, k, difference, round(distance, 6) AS distance FROM pairs")
def _(spark, sf):
    return em.one_param_pairs(params(spark, sf), 4, 6).select("id", "other", "k", "difference", "distance")


@query("g26_joint_histogram", ONE + """, s AS (SELECT min(abs(difference)) AS p0, max(abs(difference)) AS p1, min(distance) AS e0, max(distance) AS e1 FROM pairs),
h AS (SELECT CAST(least(floor((abs(difference) - p0) * 6 / (p1 - p0)), 5) AS INTEGER) AS p_bin, CAST(least(floor((distance - e0) * 5 / (e1 - e0)), 4) AS INTEGER) AS e_bin, count(*) AS n FROM pairs, s GROUP BY 1, 2)
SELECT p_bin, e_bin, n, round(n / sum(n) OVER (PARTITION BY p_bin), 6) AS share FROM h""")
def _(spark, sf):
    return em.joint_histogram(em.one_param_counts(params(spark, sf), 4), 6, 5).select("p_bin", "e_bin", "n", r6("share"))


NAMED = ", n AS (SELECT id, string_split(name, '_')[1] AS sample, string_split(name, '_')[2] AS stack, string_split(name, '_')[3] AS nucleus, embedding FROM emb)"


@query("g39_distance_classes", EMB + NAMED + """ SELECT a.id, b.id AS other, CASE WHEN a.nucleus = b.nucleus THEN 'nucleus' ELSE 'stack' END AS class, round(list_distance(a.embedding, b.embedding), 6) AS distance
  FROM n a JOIN n b ON a.sample = b.sample AND a.stack = b.stack AND a.id < b.id WHERE list_distance(a.embedding, b.embedding) > 0""")
def _(spark, sf):
    return em.distance_classes(sp.parse_real_names(tb.named_embeddings(spark, sf))).select("id", "other", "class", r6("distance"))


@query("u1_combine", EMB + " SELECT id, name, 'a' AS tag FROM emb WHERE id % 2 = 0 UNION ALL SELECT id, name, 'b' FROM emb WHERE id % 3 = 0")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf).select("id", "name")
    return em.combine({"a": e.filter("id % 2 = 0"), "b": e.filter("id % 3 = 0")})


@query("u4_select_vs_all", EMB + ", q AS (SELECT embedding AS q FROM emb WHERE id = 7), d AS (SELECT id, round(list_distance(embedding, q), 6) AS distance FROM emb, q) SELECT id, distance, 'select' AS tag FROM d WHERE distance <= 1.2 UNION ALL (SELECT id, distance, 'all' FROM d ORDER BY md5(id || '_3'), id LIMIT 100)")
def _(spark, sf):
    return em.select_vs_all(em.nearest_to(tb.named_embeddings(spark, sf), 7).select("id", r6("distance")), 1.2, 100, 3)


@query("f6_vector_distances", EMB + ", q AS (SELECT embedding AS q FROM emb WHERE id = 3) SELECT id, round(list_distance(embedding, q), 6) AS e, round(power(list_distance(embedding, q), 2), 6) AS s, round(list_sum([abs(x[1] - x[2]) FOR x IN list_zip(embedding, q)]), 6) AS m FROM emb, q")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    rows = e.crossJoin(F.broadcast(e.filter("id = 3").select(F.col("embedding").alias("q"))))
    return rows.select("id", *[F.round(sc.vector_distance(F.col("embedding"), F.col("q"), m), 6).alias(k) for k, m in (("e", "euclidean"), ("s", "squared"), ("m", "manhattan"))])


@query("f7_histogram_similarity", EMB + """, h AS (SELECT id, [abs(x) FOR x IN embedding] AS h FROM emb), q AS (SELECT h AS q FROM h WHERE id = 3), z AS (SELECT id, h, q, list_zip(h, q) AS z FROM h, q)
SELECT id, round(list_sum([least(x[1], x[2]) FOR x IN z]), 6) AS i, round(list_sum([CASE WHEN x[1] <> 0 THEN power(x[1] - x[2], 2) / x[1] ELSE 0 END FOR x IN z]), 2) AS c,
  round(sqrt(greatest(0, 1 - list_sum([sqrt(x[1] * x[2]) FOR x IN z]) / sqrt(list_sum(h) * list_sum(q)))), 4) AS b, round((list_sum([x[1] * x[2] FOR x IN z]) - 64 * list_avg(h) * list_avg(q)) / sqrt((list_sum([x * x FOR x IN h]) - 64 * power(list_avg(h), 2)) * (list_sum([x * x FOR x IN q]) - 64 * power(list_avg(q), 2))), 6) AS r FROM z WHERE id <> 3""")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf).select("id", F.transform("embedding", F.abs).alias("h"))
    rows = e.crossJoin(F.broadcast(e.filter("id = 3").select(F.col("h").alias("q")))).filter("id <> 3")
    sim = lambda m, n: F.round(sc.histogram_similarity(F.col("h"), F.col("q"), m), n)
    return rows.select("id", sim("intersection", 6).alias("i"), sim("chisquare", 2).alias("c"), sim("bhattacharyya", 4).alias("b"), sim("correlation", 6).alias("r"))


@query("f8_triplet_loss", EMB + """, t AS (SELECT a.name AS anchor, b.name AS positive, c.name AS negative FROM emb a JOIN emb b ON b.id = a.id + 1 JOIN emb c ON c.id = a.id + 7)
SELECT anchor, positive, negative, round(greatest(power(list_distance(a.embedding, b.embedding), 2) - power(list_distance(a.embedding, c.embedding), 2) + 0.5, 0), 6) AS loss FROM t JOIN emb a ON a.name = anchor JOIN emb b ON b.name = positive JOIN emb c ON c.name = negative""")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    shift = lambda n, k: e.select((F.col("id") - k).alias("id"), F.col("name").alias(n))
    t = e.select("id", F.col("name").alias("anchor")).join(shift("positive", 1), "id").join(shift("negative", 7), "id")
    return em.triplet_loss(t.drop("id"), e).select("anchor", "positive", "negative", r6("loss"))


J17 = with_tables("sims") + """, p AS (SELECT id, name, unnest(range(0, 9)) AS i, unnest(CAST(string_split(name, '_')[2:10] AS DOUBLE[])) AS v FROM sims), st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM p GROUP BY 1),
z AS (SELECT id, name, list(CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END ORDER BY i) AS params FROM p JOIN st USING (i) GROUP BY 1, 2), b AS (SELECT row_number() OVER (ORDER BY md5(id || '_14'), id) - 1 AS place, name AS negative, params AS other FROM z),
c AS (SELECT count(*) AS n, (count(*) + 255) // 256 AS blocks, greatest(1, count(*) // 1000) AS share FROM z),
tries AS (SELECT z.*, k, CAST('0x' || substr(md5(id || '_' || k || '_13'), 1, 12) AS BIGINT) % n AS place FROM z, (SELECT unnest(range(0, 40)) AS k), c),
td AS (SELECT tries.*, round(list_distance(params, other), 9) AS d FROM tries JOIN b USING (place)),
cut AS (SELECT quantile_cont(d, 0.6) AS lo, quantile_cont(d, 0.95) AS hi FROM td, c WHERE CAST('0x' || substr(md5(id || '_cut_13'), 1, 12) AS BIGINT) % share = 0),
t1 AS (SELECT id, place, min(k) AS k FROM tries GROUP BY 1, 2), pairs AS (SELECT z.id, z.name, b.place, b.negative, round(list_distance(z.params, b.other), 9) AS d, (b.place // 256 + blocks - CAST('0x' || substr(md5(z.id || '_start_13'), 1, 12) AS BIGINT) % blocks) % blocks AS step FROM z, b, c),
k AS (SELECT pairs.*, coalesce(t1.k, 40 + step * 256 + pairs.place % 256) AS k FROM pairs LEFT JOIN t1 USING (id, place), cut WHERE d BETWEEN lo AND hi AND d <> 0)
SELECT name AS anchor, 'p_' || name AS positive, negative, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM k) WHERE r <= 5"""


@query("j17_mine_triplets", J17)
def _(spark, sf):
    p = sp.parse_sim_names(tb.sim_names(spark, sf))
    return em.mine_triplets(p.withColumn("positive", F.concat(F.lit("p_"), "name")), p, 5, 0.6, 0.95, 13).withColumn("distance", F.round("distance", 6))


MARK = "CAST('0x' || substr(md5(id || '_' || k || '_{}'), 1, 12) AS BIGINT)"


@query("j18_mine_real_triplets", EMB + f""", r AS (SELECT id, name, p[1] AS sample, p[2] AS stack, p[3] AS nucleus FROM (SELECT *, string_split(replace(name, '.pkl', ''), '_') AS p FROM emb)),
pos AS (SELECT *, row_number() OVER (PARTITION BY sample, stack ORDER BY nucleus, id) - 1 AS place, count(*) OVER (PARTITION BY sample, stack) AS n, count(*) OVER (PARTITION BY sample, stack, nucleus) AS own FROM r),
a AS (SELECT *, max(place) OVER (PARTITION BY sample, stack, nucleus) + 1 AS after, unnest(range(0, 3)) AS k FROM pos), ask AS (SELECT *, (after + {MARK.format(17)} % (n - own)) % n AS to FROM a WHERE n > own),
sam AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS s, count(*) OVER () AS number FROM (SELECT DISTINCT sample FROM r)), ins AS (SELECT sample, name, row_number() OVER (PARTITION BY sample ORDER BY id) - 1 AS q, count(*) OVER (PARTITION BY sample) AS m FROM r),
far AS (SELECT ask.*, (s + 1 + {MARK.format(18)} % (number - 1)) % number AS fs FROM ask JOIN sam USING (sample)), neg AS (SELECT far.*, g.sample AS fsample FROM far JOIN sam g ON g.s = far.fs)
SELECT neg.name AS anchor, p.name AS positive, i.name AS negative FROM neg JOIN pos p ON p.sample = neg.sample AND p.stack = neg.stack AND p.place = neg.to JOIN ins i ON i.sample = neg.fsample AND i.q = {MARK.format(19).replace('id ||', 'neg.id ||').replace('|| k', '|| neg.k')} % i.m""")
def _(spark, sf):
    return em.mine_real_triplets(sp.parse_real_names(tb.named_embeddings(spark, sf)), 3, 17)


@query("m5_difference_pairs", with_tables("sims") + PARTS + """, o AS (SELECT *, row_number() OVER (ORDER BY md5(id || '_4'), id) - 1 AS place FROM p), a AS (SELECT * FROM o WHERE place < 40), b AS (SELECT * FROM o WHERE place < 60)
SELECT a.id, b.id AS other, [x[1] - x[2] FOR x IN list_zip(a.params[1:3], b.params[1:3])] AS difference, round(power(list_distance(a.params, b.params), 2), 4) AS distance2 FROM a, b WHERE a.id <> b.id""")
def _(spark, sf):
    p = sp.parse_sim_names(tb.sim_names(spark, sf)).select("id", "params", F.slice("params", 1, 3).alias("features"))
    return em.difference_pairs(p, 40, 60, 4).select("id", "other", "difference", F.round("distance2", 4).alias("distance2"))


@query("m6_train_val", EMB + " SELECT id, place // 8 AS batch, CASE WHEN place // 8 < 50 THEN 'train' ELSE 'val' END AS part FROM (SELECT id, row_number() OVER (ORDER BY md5(id || '_6'), id) - 1 AS place FROM emb) WHERE place < 400")
def _(spark, sf):
    return em.train_val_split(tb.named_embeddings(spark, sf).select("id"), "id", 400, 8, 6)


@query("j25_merge_on_params", with_tables("sims") + PARTS + " SELECT a.id, a.params[1] AS f, b.params[2] AS g FROM p a JOIN p b ON a.params = b.params")
def _(spark, sf):
    p = sp.parse_sim_names(tb.sim_names(spark, sf))
    a, b = p.withColumn("features", F.get("params", 0)), p.withColumn("features", F.get("params", 1))
    return em.merge_on_params(a, b).select("id", F.col("features").alias("f"), F.col("other_features").alias("g"))


@query("k5_score_histograms", EMB + ", q AS (SELECT embedding AS q FROM emb WHERE id = 11), s AS (SELECT id, list_distance(embedding, q) AS score FROM emb, q) SELECT id, round(score, 6) AS score FROM s")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf).select("id", F.col("embedding").alias("hist"))
    return em.score_histograms(e, e.filter("id = 11"), "euclidean").select("id", r6("score"))


COST = """, s AS (SELECT l_orderkey % 10 AS ref, l_partkey AS id, l_linenumber % 3 AS sigma_no, max(l_discount) AS score FROM lineitem GROUP BY 1, 2, 3)"""


@query("k6_score_by_sigma", EMB + """, h AS (SELECT id, k AS sigma_no, embedding[k * 16 + 1:k * 16 + 16] AS hist, embedding[1:3] AS params FROM emb, (SELECT unnest(range(0, 4)) AS k)),
s AS (SELECT r.id AS ref, h.id, h.sigma_no, list_distance(h.hist, r.hist) AS score, power(list_distance(h.params, r.params), 2) AS d FROM h JOIN h r ON r.sigma_no = h.sigma_no WHERE r.id % 100 = 0)
SELECT ref, id, CAST(sigma_no AS INTEGER) AS sigma_no, round((score - avg(score) OVER w) / stddev_pop(score) OVER w, 6) AS z, round(d, 6) AS distance2 FROM s WINDOW w AS (PARTITION BY ref, sigma_no)""")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf).withColumn("sigma_no", F.explode(F.array(*map(F.lit, range(4)))))
    h = e.select("id", "sigma_no", F.slice("embedding", F.col("sigma_no") * 16 + 1, F.lit(16)).alias("hist"), F.slice("embedding", 1, 3).alias("params"))
    return em.score_by_sigma(h, h.filter("id % 100 = 0")).select("ref", "id", "sigma_no", r6("z"), r6("distance2"))


def scores(spark, sf):
    rows = tb.read(spark, sf, "lineitem").select((F.col("l_orderkey") % 10).alias("ref"), F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 3).alias("sigma_no"), F.col("l_discount").alias("score"))
    return rows.groupBy("ref", "id", "sigma_no").agg(F.max("score").alias("score"))


@query("k7_weighted_cost", "WITH x AS (SELECT 1)" + COST + ", p AS (SELECT ref, id, round(sum(score * CASE sigma_no WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END), 6) AS score, any_value(id % 17) AS distance FROM s GROUP BY 1, 2) SELECT CAST(sum(distance) AS BIGINT) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score, id) AS r FROM p) WHERE r <= 20")
def _(spark, sf):
    rows = scores(spark, sf).withColumn("score", F.round("score", 6)).withColumn("distance", F.col("id") % 17)
    return em.weighted_cost(rows, {0: 1.0, 1: 0.5, 2: 0.25}, 20).select(F.col("cost").cast("long").alias("cost"))


@query("m1_pca")
def _(spark, sf):
    e = tb.named_embeddings(spark, sf)
    return em.pca(e, e, 3).select("id", F.transform("components", lambda x: F.round(x, 6)).alias("components"))


@query("m3_cluster_params")
def _(spark, sf):
    return em.cluster_params(sp.parse_sim_names(tb.sim_names(spark, sf)), 2, 5).select("id", "cluster")
