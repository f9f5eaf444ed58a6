"""Side-by-side run of a Spark query and its SQL, value by value."""

import datetime
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float) and value != value:
        return "nan"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def differences(df, sql: str, sf_dir: str):
    """Rows only in Spark's result, and rows only in SQL's."""
    names, rows = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    ours = Counter(tuple(map(plain, r)) for r in df.select(*names).collect())
    theirs = Counter(tuple(map(plain, r)) for r in rows)
    return list((ours - theirs).items())[:5], list((theirs - ours).items())[:5], sum(ours.values())
