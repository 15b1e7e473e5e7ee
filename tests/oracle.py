"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(columns: list[str], found) -> list:
    return sorted((tuple(plain(x) for x in r) for r in found), key=repr)


def same(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = connection(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = rows(columns, ([r[names.index(c)] for c in columns] for r in found.fetchall()))
    assert rows(columns, df.select(*columns).collect()) == want
