"""Nearest neighbours by cosine with score-aware (anisotropic) product quantisation.

Vectors of length 1 are cut into subspaces of ``SUB`` dimensions; each part is replaced by one of 16 code words, so a code
has four bits. With r the residual of the whole vector x, the loss is |r|^2 + (eta - 1) <r, x>^2: the residual along the vector
shifts the largest inner products, so it costs ``eta`` times as much. All subspaces share that part, so codes are chosen
by coordinate descent over them, and code words solve the least squares of the same loss. eta comes from the
dimension d and the cosine ``FROM`` above which scores matter: (d - 1) FROM^2 / (1 - FROM^2).

A query's 16 products with each subspace's code words make its table; pairs of codes share a byte, so a scan adds one
entry of a 256-entry table per byte. In each block the k best estimates are computed anew from the original vectors in
double precision; then so is every other candidate whose estimate could reach the k-th of these: an estimate misses by
less than ``MARGIN`` * |r| / sqrt(d) but for about one in a thousand. So a dense group has no cap: all of it that may count is computed anew.

Equal vectors fall together first: a class keeps its ``k + 1`` smallest ids, all that any query can return. Classes are
dealt into blocks of about ``BLOCK`` rows, queries into blocks of ``QUERIES``; each pair of blocks is one group, so memory is
bounded and no group depends on the data; only k rows a query leave it. The books are fitted on a sample of at most ``FIT_ROWS`` vectors.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotframe.llm.common import materialize

SUB, CENTRES, FROM, MARGIN = 2, 16, 0.2, 3.0
FIT_ROWS, BLOCK, QUERIES = 8192, 4096, 4096


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is near 1: no product overflows, and none is rounded otherwise."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(rows) -> np.ndarray:
    x = scaled(np.array(list(rows), dtype=np.float64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def weight_of(dims: int, least: float = FROM) -> float:
    """eta: what the parallel residual costs."""
    return max(1.0, (dims - 1) * least**2 / (1 - least**2))


def cut(x: np.ndarray) -> np.ndarray:
    """Rows x subspaces x ``SUB``, padded with zeros."""
    n, dims = x.shape
    return np.pad(x, ((0, 0), (0, -dims % SUB))).reshape(n, -1, SUB)


def fit_books(x: np.ndarray, eta: float, plain: int = 8, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Code words (subspaces x 16 x SUB) of unit vectors: ``plain`` rounds for each subspace alone, then ``rounds`` of the whole loss."""
    parts = cut(x)
    n, subs, _ = parts.shape
    rng = np.random.default_rng(seed)
    books = np.stack([parts[rng.choice(n, CENTRES, replace=n < CENTRES), s] for s in range(subs)])
    for s in range(subs):
        for _ in range(plain):
            code = ((parts[:, s, None] - books[s][None]) ** 2).sum(axis=2).argmin(axis=1)
            size = np.bincount(code, minlength=CENTRES)
            mean = np.stack([np.bincount(code, weights=parts[:, s, d], minlength=CENTRES) for d in range(SUB)], axis=1)
            books[s] = np.where(size[:, None] > 0, mean / np.maximum(size, 1)[:, None], books[s])
    for _ in range(rounds):
        codes, along = codes_of(parts, books, eta)
        for s in range(subs):
            # over its members a code word c solves sum (I + (eta - 1) x x') c = sum (1 + (eta - 1) (rest + <x, x>)) x,
            # where x is the part and rest what the other subspaces have of the parallel residual
            p, code = parts[:, s], codes[:, s]
            rest = along - ((p - books[s][code]) * p).sum(axis=1)
            outer = (eta - 1) * p[:, :, None] * p[:, None, :] + np.eye(SUB)
            target = (1 + (eta - 1) * (rest + (p * p).sum(axis=1)))[:, None] * p
            for k in np.unique(code):
                own = code == k
                books[s, k] = np.linalg.solve(outer[own].sum(axis=0) + 1e-9 * np.eye(SUB), target[own].sum(axis=0))
            along = rest + ((p - books[s][code]) * p).sum(axis=1)
    return books


def codes_of(parts: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x subspaces) by coordinate descent, and what is left along each vector, <r, x>."""
    n, subs, _ = parts.shape
    codes = np.zeros((n, subs), dtype=np.int64)
    own = np.zeros((n, subs))
    for sweep in range(sweeps):
        changed = False
        along = own.sum(axis=1)
        for s in range(subs):
            gap = parts[:, s, None] - books[s][None]
            part = (gap * parts[:, s, None]).sum(axis=2)
            loss = (gap**2).sum(axis=2)
            rest = along - own[:, s]
            # the first sweep knows nothing of the subspaces to come
            best = (loss + (eta - 1) * ((rest[:, None] if sweep else 0) + part) ** 2).argmin(axis=1)
            changed |= bool((best != codes[:, s]).any())
            codes[:, s], own[:, s] = best, part[np.arange(n), best]
            along = rest + own[:, s]
        if sweep and not changed:
            break
    return codes, own.sum(axis=1)


def encode(x: np.ndarray, books: np.ndarray, eta: float) -> tuple[np.ndarray, np.ndarray]:
    """Two codes a byte: subspaces 2j (low four bits) and 2j + 1 of unit vectors; and the lengths of the residuals."""
    parts = cut(x)
    codes = codes_of(parts, books, eta)[0]
    left = np.sqrt(sum(((parts[:, s] - books[s][codes[:, s]]) ** 2).sum(axis=1) for s in range(len(books))))
    codes = codes.astype(np.uint8)
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | (codes[:, 1::2] << 4), left


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Queries x bytes x 256: the sum of both products for each byte value."""
    parts = np.pad(q, ((0, 0), (0, -q.shape[1] % SUB))).reshape(len(q), -1, SUB)
    one = np.einsum("qsd,scd->qsc", parts, books).astype(np.float32)
    if one.shape[1] % 2:
        one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
    return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(q), -1, 256)


def scan(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Approximate products of one query with all codes."""
    score = table[0][codes[0]]
    for j in range(1, len(codes)):
        score += table[j][codes[j]]
    return score


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, in double precision, each on its own row alone; of any finite magnitudes."""
    q, x = scaled(q.astype(np.float64)), scaled(x.astype(np.float64))
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows whose vector isn't null, empty or zero and holds no null or non-finite component."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.filter(F.exists("v", lambda c: c != 0) & F.col("vec_id").isNotNull())


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its ``k`` nearest other rows.

    Nearest first, ties to the smaller id; all candidates, if there are fewer. Rows without id and vectors that are null, empty, zero or
    hold null or non-finite components take no part (any finite magnitude does), nor do those of another length than the most common (ties: the longer).
    Rows that repeat an id with another vector are candidates under that id too, but never neighbours of the query with that
    id; a repeated query id asks with its smallest vector, repeated rows count once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("v") == (dims["d"] if dims else 0))
    # the window's limit holds before the shuffle too, so a very common vector leaves few rows
    few = rows.withColumn("place", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    classes = materialize(few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    asked = materialize(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, m = classes.count(), asked.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    mark = F.xxhash64("v")
    sample = classes.filter(F.pmod(mark, F.lit(1 << 20)) < int(min(1.0, FIT_ROWS / n) * (1 << 20)) + 1).select("v").limit(2 * FIT_ROWS).toPandas()["v"]
    eta = weight_of(dims["d"])
    books = spark.sparkContext.broadcast(fit_books(unit(sample if len(sample) else classes.select("v").limit(1).toPandas()["v"]), eta))

    def index(frames):
        for pdf in frames:
            codes, left = encode(unit(pdf["v"]), books.value, eta) if len(pdf) else ([], [])
            yield pdf.assign(codes=[c.tobytes() for c in codes], residual=np.asarray(left, dtype=np.float64))

    blocks, groups = -(-n // BLOCK), -(-m // QUERIES)
    indexed = materialize(classes.mapInPandas(index, "v array<double>, ids array<long>, codes binary, residual double"), "index")
    side = indexed.withColumn("block", F.pmod(mark, F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    ask = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def match(key, asks, rows):
        if not len(asks) or not len(rows):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        q, x = np.array(list(asks["v"]), dtype=np.float64), np.array(list(rows["v"]), dtype=np.float64)
        codes = np.ascontiguousarray(np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(rows), -1).T)
        ids, names = rows["ids"].tolist(), asks["vec_id"].tolist()
        slack = MARGIN * rows["residual"].to_numpy() / np.sqrt(x.shape[1])
        few, found = min(k + 1, len(x)), []
        for at in range(0, len(q), 64):
            for i, table in enumerate(tables(unit(q[at : at + 64]), books.value), at):
                estimate = scan(codes, table)
                top = np.argpartition(-estimate, few - 1)[:few]
                first = np.sort(exact(q[i], x[top]))
                # with the query's own vector among them, k others stand at the lowest of k + 1
                near = np.flatnonzero(estimate + slack >= first[0]) if len(first) > k else np.arange(len(x))
                near = np.union1d(near, top)
                scores = exact(q[i], x[near])
                if len(near) > 4 * few:  # ids are looked at for those alone that can be among the k
                    best = scores >= np.partition(scores, -few)[-few]
                    near, scores = near[best], scores[best]
                own = sorted((-s, v) for s, r in zip(scores.tolist(), near.tolist(), strict=True) for v in ids[r] if v != names[i])[:k]
                found += [(names[i], v, -s) for s, v in own]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = ask.groupBy("part", "block").cogroup(side.groupBy("part", "block")).applyInPandas(match, "query_id long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("gap"), "vec_id"))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.gap")).alias("score"))
