"""Compare queries with their oracles, as sets of rows with sorted columns."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x) + 0.0:.6f}".replace("-0.000000", "0.000000")
    if isinstance(x, int):
        return str(x)
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differ(spark_df, con, sql: str) -> str | None:
    """None if the results are the same, else what differs."""
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = con.execute(sql)
    names, want = rows_of([x[0] for x in found.description], found.fetchall())
    if got_names != names:
        return f"columns {got_names} and {names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {got[:2]} and {want[:2]}"
    odd = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(odd)} of {len(got)} rows, such as {odd[0][0]} and {odd[0][1]}" if odd else None
