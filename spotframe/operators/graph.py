"""Connected components, and walks over components in order, one task for many components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.sources.scratch import discard, written


ONE_TASK = 1 << 20  # links that one task may hold


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of a link; root is the smallest node that can be reached.

    ``links`` has two long columns; nulls, repeats and self-links do no harm. Each node points to another; in a round it, and what it points to, move to the
    least that a neighbour's pointer points to, and pointers are shortened. Chains take a logarithm of rounds in practice. Minima
    are aggregated before they are dealt out, so a node with very many links is no hot key. Up to ``ONE_TASK`` different links go through the same
    rounds in one task. An empty table gives no rows.

    Two further columns may name the blocks that the two nodes lie in, if a block's links fit into a task: then each block is joined first, and only links between
    what was joined there go through the rounds.
    """
    a, b = links.columns[:2]
    spark = links.sparkSession
    if len(links.columns) == 4:
        return _by_blocks(links.toDF("u", "v", "bu", "bv").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v"), max_rounds)
    lower = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    lower, lower_path = written(lower, "links")
    if lower.count() <= ONE_TASK:
        return lower.coalesce(1).mapInPandas(_in_one_task, "node long, root long")
    edges, edges_path = written(lower.unionByName(lower.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    at, at_path = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("p")), "pointers")
    discard(spark, lower_path)
    before = None
    for _ in range(max_rounds):
        total = at.agg(F.sum(F.col("p").cast("decimal(20,0)"))).first()[0]
        if total == before:  # pointers only ever go down
            discard(spark, edges_path)
            return at.select("node", F.col("p").alias("root"))
        before = total
        far, far_path = written(at.join(at.select(F.col("node").alias("p"), F.col("p").alias("g")), "p").select("node", "p", "g"), "far-pointers")
        near = edges.join(far.select(F.col("node").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("g"))
        hooks = near.join(far.select(F.col("node").alias("u"), "p"), "u")
        offers = far.select("node", F.col("g").alias("m")).unionByName(hooks.select(F.col("u").alias("node"), F.col("g").alias("m"))).unionByName(hooks.select(F.col("p").alias("node"), F.col("g").alias("m")))
        new, new_path = written(offers.groupBy("node").agg(F.min("m").alias("p")), "pointers")
        discard(spark, at_path, far_path)
        at, at_path = new, new_path
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _by_blocks(links: DataFrame, max_rounds: int) -> DataFrame:
    links, links_path = written(links, "block-links")
    inside = links.filter("bu = bv").select("bu", "u", "v")

    def join(pdf):
        return next(_in_one_task(iter([pdf[["u", "v"]]])))

    local, local_path = written(inside.groupBy("bu").applyInPandas(join, "node long, root long"), "block-roots")
    at = lambda name, to: local.select(F.col("node").alias(name), F.col("root").alias(to))
    far = links.filter("bu <> bv").select("u", "v").join(at("u", "ru"), "u", "left").join(at("v", "rv"), "v", "left")
    between, between_path = written(far.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).distinct(), "links-between")
    top = components(between, max_rounds)
    top, _ = written(top, "roots")
    ends = local.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # nodes that have links between blocks alone
    alone = top.join(local.select("node"), "node", "left_anti")
    discard(links.sparkSession, links_path, between_path)
    return ends.unionByName(alone)


def _in_one_task(parts: Iterator) -> Iterator:
    import numpy as np
    import pandas as pd

    links = pd.concat([*parts, pd.DataFrame({"u": [], "v": []}, dtype="int64")])
    nodes, ends = np.unique(links[["u", "v"]].to_numpy(), return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    p = np.arange(len(nodes))
    while True:
        g, new = p[p], p[p]
        least = np.minimum(g[u], g[v])
        for at in (u, v, p[u], p[v]):
            np.minimum.at(new, at, least)
        if (new == p).all():
            break
        p = new
    yield pd.DataFrame({"node": nodes, "root": nodes[p]})


def walk(rows: DataFrame, group: list[str], order: list[str], columns: list[str], begin: Callable, step: Callable, schema: str) -> DataFrame:
    """``step(state, rows of one t)`` for each value of ``order[0]`` of each group, in order; ``begin()`` makes a group's first state.

    ``step`` returns tuples of ``schema``. Rows stream by sorted, many groups to a task, and only those of one group and t are held; so a
    large group takes time, not memory.
    """
    import pandas as pd

    names = [c.split(" ")[0] for c in schema.split(", ")]
    keys = [*group, order[0]]

    def run(parts: Iterator) -> Iterator:
        now, state, held = None, None, []
        for pdf in parts:
            out = []
            for values in zip(*(pdf[c].tolist() if pdf[c].dtype != object else pdf[c] for c in [*keys, *columns]), strict=True):
                key = values[: len(keys)]
                if key != now:
                    if held:
                        out += step(state, held)
                    if now is None or key[:-1] != now[:-1]:
                        state = begin()
                    now, held = key, []
                held.append(values)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(step(state, held), columns=names)

    return rows.repartition(*group).sortWithinPartitions(*group, *order).select(*keys, *columns).mapInPandas(run, schema)
