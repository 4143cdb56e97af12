"""Library tables made from the star-schema tables, as DataFrames and as SQL (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def traces(spark: SparkSession, sf: str, channel: int = 1) -> DataFrame:
    """(stack_id, spot_id, t, value): users are spots, days are frames."""
    value = F.round(F.col("value") * 100).cast("long") if channel == 1 else F.get_json_object("props", "$.k").cast("long")
    rows = read(spark, sf, "events").select((F.col("user_id") % 4).alias("stack_id"), F.col("user_id").alias("spot_id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("t"), value.alias("v"))
    return rows.groupBy("stack_id", "spot_id", "t").agg(F.sum("v").cast("double").alias("value"))


def fits(spark: SparkSession, sf: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    return read(spark, sf, "orders").select((F.col("o_custkey") % 8).alias("stack_id"), ((F.year(d) - 1992) * 12 + F.month(d) - 1).alias("t"), k.alias("fit_no"), (k % 11).cast("double").alias("z"), (k % 97).cast("double").alias("x"), (F.col("o_custkey") % 89).cast("double").alias("y"), F.col("o_totalprice").alias("height"), (1 + k % 5).cast("double").alias("width_z"), (1 + k % 7).cast("double").alias("width_x"), (1 + k % 3).cast("double").alias("width_y"))


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    """(stack_id, c, t, z, x, y, value): each vector is a frame of 4 x 4 x 4; channel 1 is reversed."""
    e = read(spark, sf, "embeddings").withColumn("t", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    channels = F.array(F.struct(F.lit(0).alias("c"), F.col("embedding").alias("e")), F.struct(F.lit(1).alias("c"), F.reverse("embedding").alias("e")))
    rows = e.select(F.col("label").alias("stack_id"), "t", F.explode(channels).alias("k")).select("stack_id", "t", "k.c", F.posexplode("k.e").alias("i", "v"))
    i = F.col("i")
    return rows.select("stack_id", "c", "t", F.floor(i / 16).cast("int").alias("z"), (F.floor(i / 4) % 4).cast("int").alias("x"), (i % 4).cast("int").alias("y"), F.floor(F.col("v").cast("double") * 1000000).cast("double").alias("value"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """(stack_id, t, z, x, y, label): four blocks that move with t; every fifth frame is missing, one corner is background."""
    v = voxels(spark, sf).filter("c = 0 AND t % 5 <> 3 AND NOT (z = 0 AND x = 0 AND y = 0)")
    return v.select("stack_id", "t", "z", "x", "y", (1 + F.floor(((F.col("x") + F.col("t")) % 4) / 2) * 2 + F.floor(F.col("y") / 2)).cast("int").alias("label"))


def named_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, set, embedding)."""
    v = F.col("vec_id")
    name = F.concat(F.lit("s"), F.col("label").cast("string"), F.lit("_st"), (v % 7).cast("string"), F.lit("_n"), (v % 3).cast("string"), F.lit("_"), v.cast("string"), F.lit(".pkl"))
    return read(spark, sf, "embeddings").select(v.alias("id"), name.alias("name"), F.when(v % 2 == 0, "left").otherwise("right").alias("set"), F.col("embedding").cast("array<double>").alias("embedding"))


PARAMS = ("p_size", "p_partkey % 5", "p_partkey % 7", "p_partkey % 3", "p_partkey % 11", "p_partkey % 2", "p_partkey % 13", "p_partkey % 4", "p_partkey % 6")


def sim_names(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.expr(p).cast("string") for p in PARAMS]
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("_", F.lit("abc"), *parts, F.lit("rep0.pkl")).alias("name"))


def movies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, sf, "nation").select(k.cast("long").alias("stack_id"), (k * 0.5 + 1).cast("double").alias("surface_before"), (k * 0.25 + 2).cast("double").alias("surface_after"), F.lit(0.5).alias("z_interval"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Three segments per stack, from frames 0, 30 and 60."""
    k, n = F.col("n_nationkey"), F.col("n")
    rows = read(spark, sf, "nation").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select(k.cast("long").alias("stack_id"), n.alias("seg_no"), (n * 30).alias("start_frame"), (n * 1.5 + k).cast("double").alias("start_pos"), (n * 2).alias("z_corr"))


SQL = {
    "traces": """traces AS (SELECT user_id % 4 AS stack_id, user_id AS spot_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3)""",
    "traces2": """traces2 AS (SELECT user_id % 4 AS stack_id, user_id AS spot_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3)""",
    "dense": """dense AS (SELECT g.stack_id, g.spot_id, CAST(g.t AS INTEGER) AS t, v.value FROM (
    SELECT s.stack_id, s.spot_id, unnest(range(0, m.last + 1)) AS t FROM (SELECT DISTINCT stack_id, spot_id FROM traces) s
    JOIN (SELECT stack_id, max(t) AS last FROM traces GROUP BY 1) m USING (stack_id)) g
  LEFT JOIN traces v ON v.stack_id = g.stack_id AND v.spot_id = g.spot_id AND v.t = g.t)""",
    "fits": """fits AS (SELECT o_custkey % 8 AS stack_id, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS INTEGER) AS t, o_orderkey AS fit_no,
  CAST(o_orderkey % 11 AS DOUBLE) AS z, CAST(o_orderkey % 97 AS DOUBLE) AS x, CAST(o_custkey % 89 AS DOUBLE) AS y, o_totalprice AS height,
  CAST(1 + o_orderkey % 5 AS DOUBLE) AS width_z, CAST(1 + o_orderkey % 7 AS DOUBLE) AS width_x, CAST(1 + o_orderkey % 3 AS DOUBLE) AS width_y FROM orders)""",
    "voxels": """vox0 AS (SELECT label AS stack_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS t, embedding AS e FROM embeddings),
voxels AS (SELECT stack_id, c, t, CAST((i - 1) // 16 AS INTEGER) AS z, CAST(((i - 1) // 4) % 4 AS INTEGER) AS x, CAST((i - 1) % 4 AS INTEGER) AS y, floor(CAST(v AS DOUBLE) * 1000000) AS value FROM (
  SELECT stack_id, t, 0 AS c, unnest(range(1, 65)) AS i, unnest(e) AS v FROM vox0 UNION ALL
  SELECT stack_id, t, 1 AS c, unnest(range(1, 65)) AS i, unnest(list_reverse(e)) AS v FROM vox0))""",
    "labels": """labels AS (SELECT stack_id, t, z, x, y, CAST(1 + (((x + t) % 4) // 2) * 2 + y // 2 AS INTEGER) AS label FROM voxels WHERE c = 0 AND t % 5 <> 3 AND NOT (z = 0 AND x = 0 AND y = 0))""",
    "emb": """emb AS (SELECT vec_id AS id, 's' || label || '_st' || vec_id % 7 || '_n' || vec_id % 3 || '_' || vec_id || '.pkl' AS name,
  CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END AS set, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)""",
    "sims": "sims AS (SELECT p_partkey AS id, 'abc_' || " + " || '_' || ".join(PARAMS).replace("p_partkey %", "p_partkey %") + " || '_rep0.pkl' AS name FROM part)",
    "movies": "movies AS (SELECT CAST(n_nationkey AS BIGINT) AS stack_id, n_nationkey * 0.5 + 1 AS surface_before, n_nationkey * 0.25 + 2 AS surface_after, 0.5 AS z_interval FROM nation)",
    "segments": "segments AS (SELECT CAST(n_nationkey AS BIGINT) AS stack_id, n AS seg_no, n * 30 AS start_frame, CAST(n * 1.5 + n_nationkey AS DOUBLE) AS start_pos, n * 2 AS z_corr FROM nation, (SELECT unnest(range(0, 3)) AS n))",
}
NEEDS = {"dense": ("traces",), "labels": ("voxels",)}


def with_tables(*names: str) -> str:
    """A WITH clause of these tables and what they need."""
    out: list[str] = []
    for n in names:
        out += [x for x in (*NEEDS.get(n, ()), n) if x not in out]
    return "WITH " + ",\n".join(SQL[n] for n in out)
