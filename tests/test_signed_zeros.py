"""Values that round to zero from below keep their sign, as in the queries' SQL."""

import duckdb
import pytest

from spotframe.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Vectors whose components, means and filtered values lie a little below, at and above zero."""
    path = tmp_path_factory.mktemp("tiny")
    small = [-4e-7, 4e-7, -0.0, 0.0, -1.0, 1.0, -6e-7, 6e-7] * 8
    vectors = [small, [-2e-6] * 64, [2e-6] * 64, [-5e-6 if k % 2 else 0.0 for k in range(64)], [-1e-6] + [0.0] * 63]
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.mark.parametrize("name", ["g25_flatten", "h12_embed_images", "h1_gaussian_frames"])
def test_sign_of_zero(spark, tiny, name):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{tiny}/embeddings.parquet/*.parquet')")
    cur = c.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r)) for r in cur.fetchall())
    got = sorted(repr(tuple(r[k] for k in columns)) for r in QUERIES[name](spark, tiny).collect())
    assert got == want and "-0.0" in str(want)
