"""SQL of the training-data queries: text, and equal to the queries on the driver's tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


def test_oracles_are_sql():
    import __spark_entry__ as e

    assert all(isinstance(sql, str) for sql in e.oracle_sql().values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_every_oracle_equals_its_query(spark):
    import duckdb

    from runledger.llm import queries

    con = duckdb.connect()
    for t in os.listdir(DATA):
        path = f"{DATA}/{t}/*.parquet" if os.path.isdir(f"{DATA}/{t}") else f"{DATA}/{t}"
        con.execute(f"create view {t.split('.')[0]} as select * from '{path}'")
    assert queries.ORACLES
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, DATA)
        cols = sorted(got.columns)
        cur = con.execute(sql)
        at = [d[0] for d in cur.description]
        assert sorted(at) == cols, name
        want = sorted((tuple(r[at.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == want, name
