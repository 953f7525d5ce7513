"""Compare a Spark result with the result of its SQL in DuckDB."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """Values as the two engines have in common; floats to nine digits."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What is different, or nothing."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    wanted = rows_of(names, result.fetchall())
    found = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    problems = []
    if len(found) != len(wanted):
        problems.append(f"{len(found)} rows instead of {len(wanted)}")
    for mine, theirs in zip(found, wanted):
        if mine != theirs:
            columns = sorted(names)
            problems += [f"{c}: {a!r} instead of {b!r}" for c, a, b in zip(columns, mine, theirs) if a != b][:4]
            break
    return problems
