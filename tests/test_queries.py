"""Every query with SQL gives what the SQL gives."""

import os

import duckdb
import pytest

from trialgrid.plans.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    out = QUERIES[name](spark, SF_DIR).toPandas()
    if name not in ORACLES:
        assert len(out)
        return
    told = db.execute(ORACLES[name]).df()
    columns = sorted(told.columns)
    assert columns == sorted(out.columns)
    mine, theirs = (d[columns].sort_values(columns).reset_index(drop=True).astype(str).replace({"None": "nan", "<NA>": "nan"}) for d in (out, told))
    assert mine.equals(theirs)


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    blocked = {"trialgrid.llm": None, "trialgrid.llm.queries": None}
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("trialgrid.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for name, value in blocked.items():
        monkeypatch.setitem(sys.modules, name, value)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert "rate_map" in entry.queries() and "rate_map" in entry.oracle_sql()
    assert not any(q.startswith("op") for q in entry.queries())


def test_long_trials_count(spark, tmp_path):
    rows = [(1, 10, "2024-01-01", "click"), (2, 10, "2024-01-10", "view"), (3, 10, "2024-01-28", "purchase")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").selectExpr("event_id", "user_id", "CAST(ts AS timestamp) AS ts", "event_type", "1D AS value", "'1' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    for name in ("trial_slice_all", "trial_buffered_all", "clock_consistency_all"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 1
