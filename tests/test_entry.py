"""The driver's contract: every query runs, has the columns of its SQL, and the engine stands without the optional subpackage."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__
from tidewright.oracle import SQL as ENGINE_SQL
from tidewright.queries import QUERIES as ENGINE
from tidewright.stored_oracle import STORED_SQL
from tidewright.stored_queries import STORED

QUERIES, SQL = {**ENGINE, **STORED}, {**ENGINE_SQL, **STORED_SQL}

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_query_of_the_engine_has_sql():
    assert set(QUERIES) == set(SQL)


@needs_data
def test_the_flagship_query_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "part", "events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    key = lambda row: tuple((x is not None, x) for x in row)
    expected = sorted(want.fetchall(), key=key)
    got = sorted((tuple(r) for r in QUERIES[name](spark, DATA).select(*names).collect()), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or x == pytest.approx(y, abs=2e-6) for x, y in zip(a, b, strict=True))


def test_import_without_the_optional_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "tidewright"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/tidewright/llm"], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(QUERIES) and out[1] == "0"
