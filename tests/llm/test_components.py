import random

from spotframe.llm.components import components


def plain(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in rows:
        if a is not None and b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return sorted((x, find(x)) for x in list(root))


def got(spark, rows):
    return sorted(map(tuple, components(spark.createDataFrame(rows, "x long, y long")).collect()))


def test_chain_star_and_odd_links(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(1000, k) for k in range(1001, 1300)] + [(k, 5) for k in range(1290, 1310)]
    odd = [(None, 3), (4, None), (None, None), (7, 7), (8, 9), (9, 8), (8, 9), (-5, 2**62)]
    rows = chain + star + odd
    random.Random(1).shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_random_graphs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    assert got(spark, rows) == plain(rows)


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, 1)]) == []
