"""Spark's rows against DuckDB's for the SQL of a query, whatever the order of rows and columns."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if (path := Path(sf_dir) / f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def spark_rows(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(row[n]) for n in names) for row in df.collect()), key=repr)


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list]:
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in at], sorted((tuple(_plain(row[k]) for k in at) for row in found.fetchall()), key=repr)
