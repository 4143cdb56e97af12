"""Prefix trie of conversations, and totals over its subtrees by parallel tree contraction.

Nodes are found by hashes of prefixes (128 bits: exclusive-ors of XXH64 of place and turn, so that prefixes come from sums over blocks of turns).
A node is named by its smallest member and its depth.

Contraction: in each round all leaves are raked (their totals are known, and are added to their parents), then nodes of unary chains are
spliced out where they come before their neighbours in an order of (lowest set bit of the depth, hash), so that a chain loses every other node.
What a spliced node held goes onto the edge to its child. The rounds are logarithmic in the nodes. Then the spliced nodes come back in reverse order, each with its
child's total and what was between.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.llm.common import discard, written
from spotframe.llm.sequences import numbered

SHARED = 3  # turns that may come from another conversation, at most
FAMILY = 20  # conversations to a base
BLOCK = 1024  # turns whose hashes are summed in one group
WORD = r"[^\x20\x09-\x0D]+"


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(conv_id, n_turns, d, t1, t2, words): the turns of each rebuilt conversation by place d from 1; (conv_id, n_turns) of all; and written tables."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", one("role"), one("text"))
    rows = rows.withColumn("t1", F.xxhash64("role", "text")).withColumn("t2", F.xxhash64("text", "role", F.lit(1))).withColumn("words", F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0))).cast("long"))
    rows, path = numbered(rows, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], "turns", ["conv_id", "t1", "t2", "words"])
    heads = rows.filter(F.col("pos") <= SHARED).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("head"))
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(heads, "base", "left").withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", 1, F.col("h").cast("int"))).otherwise(F.array().cast(heads.schema["head"].dataType)))
    convs = convs.select("conv_id", "h", "head", F.size("head").cast("long").alias("k"), (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("n_turns"))
    convs, convs_path = written(convs, "convs")
    shared = convs.select("conv_id", "n_turns", F.posexplode("head").alias("d", "x")).select("conv_id", "n_turns", (F.col("d") + 1).cast("long").alias("d"), "x.t1", "x.t2", "x.words")
    mine = rows.join(convs.select("conv_id", "n_turns", "h", "k"), "conv_id").filter("pos > h").select("conv_id", "n_turns", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "t1", "t2", "words")
    return shared.unionByName(mine), convs.select("conv_id", "n_turns"), [path, convs_path]


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds h1, h2, the hash of the first d turns, and p1, p2, that of the first d - 1."""
    rows = rows.withColumn("m1", F.xxhash64("d", "t1", "t2")).withColumn("m2", F.xxhash64("t2", "d", "t1")).withColumn("block", F.floor((F.col("d") - 1) / BLOCK).cast("long")).drop("t1", "t2")
    by_turn = W.partitionBy("conv_id", "block").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = rows.withColumn("x1", F.bit_xor("m1").over(by_turn)).withColumn("x2", F.bit_xor("m2").over(by_turn))
    by_block = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("m1").alias("b1"), F.bit_xor("m2").alias("b2"))
    before = sums.select("conv_id", "block", F.bit_xor("b1").over(by_block).alias("b1"), F.bit_xor("b2").over(by_block).alias("b2")).filter("block > 0")
    out = here.join(before, ["conv_id", "block"], "left")
    xor = lambda a, b: F.col(a).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))
    out = out.withColumn("h1", xor("x1", "b1")).withColumn("h2", xor("x2", "b2"))
    return out.select("conv_id", "n_turns", "d", "words", "h1", "h2", xor("h1", "m1").alias("p1"), xor("h2", "m2").alias("p2"))


def _ends(rows: DataFrame) -> DataFrame:
    """(d, h1, h2, ends_sha256) of (d, h1, h2, conv_id): members stream by in order, and only the digest's state is kept."""
    import pandas as pd

    key = ["d", "h1", "h2"]

    def run(parts):
        now, digest = None, None
        for pdf in parts:
            out = []
            for d, a, b, conv in zip(*(pdf[c].tolist() for c in [*key, "conv_id"]), strict=True):
                if (d, a, b) == now:
                    digest.update(b",%d" % conv)
                    continue
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (d, a, b), hashlib.sha256(b"%d" % conv)
            yield pd.DataFrame(out, columns=[*key, "ends_sha256"])
        if now:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=[*key, "ends_sha256"])

    return rows.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInPandas(run, "d long, h1 long, h2 long, ends_sha256 string")


def subtree_totals(tree: DataFrame, values: list[str]) -> tuple[DataFrame, list[str]]:
    """(c, d, *values): for each node of a forest (c, d, pc, pd, kids, *values) the sums of ``values`` over its subtree; and the written tables it reads.

    (c, d) names a node, (pc, pd) its parent (null for a root), kids counts its children. Any shape will do: stars are summed by
    partial aggregates, chains are halved in a round.
    """
    spark, edge = tree.sparkSession, [f"e_{v}" for v in values]
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    now, path = written(tree.select("c", "d", "pc", "pd", "kids", *values, *[F.lit(0).cast("long").alias(e) for e in edge]), "trie")
    kept, spliced, raked = [path], [], []
    while True:
        leaves = now.filter("kids = 0")
        raked.append(leaves.select("c", "d", *values))
        up = leaves.filter("pc IS NOT NULL").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(F.count("*").alias("_n"), *[F.sum(F.col(v) + F.col(e)).alias(f"_{v}") for v, e in zip(values, edge, strict=True)])
        inner = now.filter("kids > 0").join(up, ["c", "d"], "left").select("c", "d", "pc", "pd", (F.col("kids") - F.coalesce("_n", F.lit(0))).alias("kids"), *[add(v, f"_{v}") for v in values], *edge)
        first = F.struct(F.col("d").bitwiseAND(-F.col("d")).alias("bit"), F.xxhash64("c", "d").alias("hash"), "c", "d")
        inner = inner.withColumn("unary", (F.col("kids") == 1) & F.col("pc").isNotNull()).withColumn("first", first)
        inner, path = written(inner, "inner")
        if inner.isEmpty():
            discard(spark, path)
            break
        # the only child that is left of a unary node, and its parent
        child = inner.groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(F.min(F.struct("first", "unary", *edge)).alias("w"))
        parent = inner.select(F.col("c").alias("pc"), F.col("d").alias("pd"), F.col("unary").alias("p_unary"), F.col("first").alias("p_first"))
        chain = inner.filter("unary").join(child, ["c", "d"]).join(parent, ["pc", "pd"])
        out = chain.filter((~F.col("w.unary") | (F.col("first") < F.col("w.first"))) & (~F.col("p_unary") | (F.col("first") < F.col("p_first"))))
        # what is between a spliced node's total and its child's; what is between the child's and that of its new parent
        own = [(F.col(v) + F.col("w")[e]).alias(v) for v, e in zip(values, edge, strict=True)]
        beyond = [(F.col(v) + F.col(e) + F.col("w")[e]).alias(e) for v, e in zip(values, edge, strict=True)]
        out = out.select("c", "d", "pc", "pd", F.col("w.first.c").alias("wc"), F.col("w.first.d").alias("wd"), *own, *beyond)
        log, log_path = written(out, "spliced")
        spliced.append(log)
        moves = log.select("c", "d", F.lit(True).alias("gone"), "pc", "pd", *edge).unionByName(log.select(F.col("wc").alias("c"), F.col("wd").alias("d"), F.lit(False).alias("gone"), "pc", "pd", *edge))
        moves = moves.select("c", "d", "gone", *[F.col(x).alias(f"_{x}") for x in ("pc", "pd", *edge)])
        following = inner.join(moves, ["c", "d"], "left").filter("gone IS NULL OR NOT gone").select("c", "d", *[F.coalesce(f"_{x}", x).alias(x) for x in ("pc", "pd")], "kids", *values, *[F.coalesce(f"_{x}", x).alias(x) for x in edge])
        now, now_path = written(following, "trie")
        kept += [log_path, now_path]
        discard(spark, path)
    totals = None
    for part in raked:
        totals = part if totals is None else totals.unionByName(part)
    for log in reversed(spliced):
        below = totals.select(F.col("c").alias("wc"), F.col("d").alias("wd"), *[F.col(v).alias(f"_{v}") for v in values])
        back, path = written(log.join(below, ["wc", "wd"]).select("c", "d", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]), "back")
        kept.append(path)
        totals = totals.unionByName(back)
    return totals, kept


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). Rows go by turn (null first), those of one turn by role, then
    text; repeated rows are turns of their own. Null roles and texts are empty, rows with a null conv_id are left out, the
    remainder that names the base has the sign of conv_id. Texts of
    any length and conversations of any number of turns are taken whole. An empty table gives no rows, not even a root. Other columns aren't read.
    """
    rows, convs, paths = rebuilt(turns)
    rows, rows_path = written(prefixes(rows), "prefixes")
    found = rows.groupBy("d", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(zero.alias("d"), zero.alias("h1"), zero.alias("h2"), "conv_id", "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes, nodes_path = written(found.unionByName(root), "nodes")
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent"))
    nodes = nodes.join(above, ["d", "p1", "p2"], "left")
    kids = nodes.filter("d > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("kids"))
    ended = rows.filter("d = n_turns").select("d", "h1", "h2", "conv_id").unionByName(convs.filter("n_turns = 0").select(zero.alias("d"), zero.alias("h1"), zero.alias("h2"), "conv_id"))
    nodes = nodes.join(kids, ["conv_id", "d"], "left").join(_ends(ended), ["d", "h1", "h2"], "left")
    nodes = nodes.select("conv_id", "d", "parent", "n_convs", "words", F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    nodes, _ = written(nodes, "trie-nodes")
    discard(turns.sparkSession, *paths, rows_path, nodes_path)
    tree = nodes.select(F.col("conv_id").alias("c"), "d", F.col("parent").alias("pc"), F.when(F.col("d") > 0, F.col("d") - 1).alias("pd"), "kids", (F.col("kids") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals, _ = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    out = nodes.join(totals.withColumnRenamed("c", "conv_id"), ["conv_id", "d"])
    return out.select("conv_id", F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256")
