"""Run a registered query on Spark and its SQL in DuckDB and compare the rows as multisets."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """A value and its kind, so that 1, 1.00, '1' and TRUE differ."""
    if value is None or isinstance(value, (bool, str, dt.date)):
        return value
    if isinstance(value, Decimal):
        return ("dec", str(value))
    if isinstance(value, int):
        return ("int", value)
    raise TypeError(f"not comparable: {value!r}")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns differ: spark only {set(df.columns) - set(names)}, sql only {set(names) - set(df.columns)}"
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, df.collect())
    if want == got:
        return None
    extra, missing = got - want, want - got
    return (
        f"{sorted(names)}\nspark {sum(got.values())} rows, sql {sum(want.values())} rows\n"
        f"only spark ({sum(extra.values())}): {list(extra)[:3]}\nonly sql ({sum(missing.values())}): {list(missing)[:3]}"
    )
