"""Compare a query with its SQL oracle, value by value and type by type."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def differences(df, con, sql: str) -> tuple[int, list]:
    """Row count and the first rows that differ, after sorting columns and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    order = sorted(names)
    place = [names.index(n) for n in order]
    theirs = sorted((tuple(r[i] for i in place) for r in theirs), key=_key)
    ours = sorted((tuple(r) for r in df.select(*order).collect()), key=_key)
    assert len(ours) == len(theirs), (len(ours), len(theirs), ours[:2], theirs[:2])
    return len(ours), [(a, b) for a, b in zip(ours, theirs) if not all(map(_same, a, b))][:3]
