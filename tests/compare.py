"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb

SOURCES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(source_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES.split():
        file = Path(source_dir) / f"{name}.parquet"
        if file.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime):
        return value.date() if value.time() == datetime.min.time() else value
    if isinstance(value, (int, str, date)):
        return value
    return str(value)


def _table(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


# DuckDB types a Spark type may come back as.
_TYPES = {
    "int": {"INTEGER"},
    "bigint": {"BIGINT"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "date": {"DATE"},
    "boolean": {"BOOLEAN"},
}


def type_differences(frame, con, sql: str) -> list[str]:
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"type of {name}: {kind} != {described.get(name)}"
        for name, kind in frame.dtypes
        if described.get(name) not in _TYPES.get(kind, {kind.upper()})
    ]


def differences(frame, con, sql: str) -> list[str]:
    """Empty when columns, row counts and all values agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    got = frame.collect()
    if len(got) != len(expected):
        return [f"rows {len(got)} != {len(expected)}"]
    left, right = _table(frame.columns, got), _table(names, expected)
    wrong = [f"{a} != {b}" for a, b in zip(left, right, strict=True) if a != b]
    return [f"{len(wrong)} of {len(left)} rows differ", *wrong[:3]] if wrong else []
