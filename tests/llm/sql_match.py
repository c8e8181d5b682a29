"""Compares a registered query with its SQL as DuckDB runs it."""

import os

import duckdb


def same(spark, queries, oracle, name, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = con.sql(oracle[name]).df()
    got = queries[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda d: sorted(str(tuple(None if v != v else v for v in r)) for r in d[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
