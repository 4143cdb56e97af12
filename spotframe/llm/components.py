"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.llm.common import discard, written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    ``links`` has two long columns, in any order and direction, repeats and self-links allowed (both are dropped);
    links with a null end are dropped. Minima are pre-aggregated and written, so the joins with them have nothing but exchanges below and
    Spark splits the rows of a node with very many links over tasks. Each round is written to the shared folder, and what it was made
    of is deleted then. An empty table gives no rows.
    """
    a, b = links.columns[:2]
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e, path = written(e, "links")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large, large_path = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        low, low_path = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e, new_path = written(small, "stars")
        discard(e.sparkSession, path, least_path, large_path, low_path)
        path = new_path
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
