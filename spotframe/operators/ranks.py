"""Exact order statistics of groups of any size, without a state that grows with a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.sources.scratch import discard, written

SMALL = 1 << 16  # values that one aggregate may hold
GRID = 500  # ranks that a sketch is asked for
ACCURACY = 20_000  # of the sketch: a rank is off by this part of the values at most


def quantiles(rows: DataFrame, keys: list[str], value: str, fractions: list[float], rounds: int = 12) -> DataFrame:
    """(keys, q): an array of the ``fractions`` of each group's values, linear between neighbours as ``percentile`` has them; nulls don't count.

    Groups of up to ``SMALL`` values are sorted in an aggregate. Of larger ones a sketch of bounded size brackets each rank; what lies in the bracket is
    sketched again until it is small, and then counted by value, so that many equal values are one. A group without values gives no row.
    """
    given = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    sizes, sizes_path = written(given.groupBy(*keys).agg(F.count("*").alias("_n")), "group-sizes")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    exact = F.array(*[F.expr(f"percentile(_v, {p})") for p in fractions]).alias("q")
    large = sizes.filter(F.col("_n") > SMALL)
    if large.isEmpty():
        discard(rows.sparkSession, sizes_path)
        return given.groupBy(*keys).agg(exact)
    small = given.join(large, same(given, large), "left_anti").groupBy(*keys).agg(exact)
    at = lambda p: F.lit(p) * (F.col("_n") - 1)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.floor(at(p)).alias("r0"), F.ceil(at(p)).alias("r1"), (at(p) - F.floor(at(p))).alias("w")) for i, p in enumerate(fractions)]))
    none = F.lit(None).cast("double")
    wanted = large.select(*[F.col(k).alias(f"_{k}") for k in keys], each.alias("x")).select(*[f"_{k}" for k in keys], "x.*", none.alias("low"), none.alias("high"))
    names = [f"_{k}" for k in keys]
    wanted, path = written(wanted, "ranks")

    def met(ranks: DataFrame) -> DataFrame:
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        joined = given.join(ranks, on)
        return joined.withColumn("in", (F.col("low").isNull() | (F.col("_v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("_v") <= F.col("high"))))

    grid = f"percentile_approx(CASE WHEN in THEN _v END, array({', '.join(str(k / GRID) for k in range(GRID + 1))}), {ACCURACY})"
    for _ in range(rounds):
        seen = met(wanted).groupBy(*names, "f", "r0", "r1", "w", "low", "high").agg(F.count_if(F.col("_v") < F.col("low")).alias("below"), F.count_if("in").alias("m"), F.expr(grid).alias("g"))
        left = F.floor((F.col("r0") - F.col("below")) / F.col("m") * GRID).cast("int") - 1
        right = F.ceil((F.col("r1") - F.col("below") + 1) / F.col("m") * GRID).cast("int") + 1
        narrow = F.col("m") > SMALL
        low = F.when(narrow & (left >= 1), F.get("g", left)).otherwise(F.col("low"))
        high = F.when(narrow & (right < GRID), F.get("g", right)).otherwise(F.col("high"))
        new, new_path = written(seen.select(*names, "f", "r0", "r1", "w", low.alias("low"), high.alias("high"), (narrow & ~(low.eqNullSafe(F.col("low")) & high.eqNullSafe(F.col("high")))).alias("moved")), "ranks")
        moved = not new.filter("moved").isEmpty()
        discard(rows.sparkSession, path)
        wanted, path = new.drop("moved"), new_path
        if not moved:
            break
    found = met(wanted)
    below = found.groupBy(*names, "f").agg(F.count_if(F.col("_v") < F.col("low")).alias("below"))
    counts = found.filter("in").groupBy(*names, "f", "r0", "r1", "w", "_v").agg(F.count("*").alias("c"))
    counts = counts.join(below.toDF(*[f"b{k}" for k in names], "bf", "below"), [F.col(k).eqNullSafe(F.col(f"b{k}")) for k in names] + [F.col("f") == F.col("bf")])
    upto = F.sum("c").over(W.partitionBy(*names, "f").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("below")
    ranked = counts.withColumn("upto", upto)
    value_at = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("_v")))
    picked = ranked.groupBy(*names, "f").agg(value_at("r0").alias("v0"), value_at("r1").alias("v1"), F.first("w").alias("w"))
    one = picked.select(*names, F.struct("f", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("w")).alias("v")).alias("s"))
    big = one.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("q"))
    return small.unionByName(big.toDF(*keys, "q"))
