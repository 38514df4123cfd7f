"""Spark rows against DuckDB rows, order aside."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(source):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{source}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_equal(df, sql: str, sf_dir: str) -> None:
    names, expected = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = canonical(names, expected)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
