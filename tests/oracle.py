"""Runs a query and its SQL, and compares the rows."""

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(frame) -> list[tuple]:
    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = [tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def by_sql(sql: str, sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection.execute(sql).df()


def check(df, sql: str, sf_dir: str) -> int:
    mine, theirs = df.toPandas(), by_sql(sql, sf_dir)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)
    return len(mine)
