"""Comparison of registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return repr(value)


def lines(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


def family(kind: str) -> str:
    kind = kind.lower()
    if kind in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint"):
        return "integer"
    if kind in ("float", "double") or kind.startswith("decimal"):
        return "float"
    return {"varchar": "string"}.get(kind, kind)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a query; empty if nothing does."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    kinds = {d[0]: family(str(d[1])) for d in expected.description}
    wanted = lines(names, expected.fetchall())
    found = lines(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    ours = {c: family(k) for c, k in df.dtypes}
    out += [f"type of {c}: {ours[c]} against {kinds[c]}" for c in ours if ours[c] != kinds[c]]
    if len(found) != len(wanted):
        out.append(f"{len(found)} rows against {len(wanted)}")
    bad = [(a, b) for a, b in zip(found, wanted) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first: {bad[0][0][:600]} AGAINST {bad[0][1][:600]}")
    return out
