"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import time
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    """Rows as text, so that types, signs of zero and every digit count."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, con, function, sql, sf_dir):
    """(error text or '', row count, seconds in Spark)."""
    start = time.time()
    df = function(spark, sf_dir)
    mine = df.collect()
    seconds = time.time() - start
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}", len(mine), seconds
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}", len(mine), seconds
    left, right = rows_of(df.columns, [tuple(r) for r in mine]), rows_of(names, theirs)
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        return f"{len(different)} rows differ, first {different[0][0]} / {different[0][1]}", len(mine), seconds
    return "", len(mine), seconds
