"""Queries against their SQL, on the small tables that the driver provides."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


def names():
    from runledger.plans import catalog

    return sorted(catalog.ORACLES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    import duckdb

    from runledger.plans import catalog

    con = duckdb.connect()
    for t in os.listdir(DATA):
        path = f"{DATA}/{t}/*.parquet" if os.path.isdir(f"{DATA}/{t}") else f"{DATA}/{t}"
        con.execute(f"create view {t.split('.')[0]} as select * from '{path}'")
    got = catalog.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    cur = con.execute(catalog.ORACLES[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    want = sorted((tuple(r[at.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == want


def test_no_session_is_needed_to_list():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True, timeout=120)
