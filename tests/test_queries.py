import os

import duckdb
import pytest

from spotframe.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["w6_triggered_average", "w16_smooth", "j9_match_labels", "j11_fill_missing", "g37_otsu", "j13_depth_correct_grid", "k1_rank_pairs", "j16_one_param_pairs", "p8_decode_stack_ids", "g21_signal_by_quantile"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        at = f"{SF}/{f}" if os.path.isfile(f"{SF}/{f}") else f"{SF}/{f}/*.parquet"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{at}')")
    return c


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(shown, r)) for r in cur.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys; import spotframe.plans; assert not any(m.startswith('spotframe.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_streamed_frames(spark, tmp_path):
    from spotframe.streaming.traces import DETECTION, read_detections, stream_traces, write_traces
    import datetime as dt

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(0, 1, day(1, 1), 2.0), (0, 1, day(1, 5), 4.0), (0, 1, day(2), 7.0), (0, 1, day(9), 1.0)]
    spark.createDataFrame(rows, DETECTION).write.parquet(str(tmp_path / "in"))
    write_traces(stream_traces(read_detections(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = {r.frame.day: (r.value, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: (3.0, 2), 2: (7.0, 1)}  # the last frame is still open
