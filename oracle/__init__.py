"""DuckDB statements the results are checked against, composed from tables.sql and queries.sql.

``-- :name columns`` starts a block; the columns are doubles rounded in the result, ``column:3`` to
three digits. A query gets a WITH clause holding exactly the tables it reads, directly or through
other tables. ``-- :name@variant`` is a table's definition in the queries of that variant, or a query
of that variant. A query ``x_naive``, over the four-week mean, also gives query ``x`` of variant
``ridge``, where ``x`` is not written out: the same SQL over the ridge model's forecast.
"""

from __future__ import annotations

import re
from pathlib import Path

DIGITS = 6
UNIT_DIGITS = 3
# Forecast units of a model differ between solvers in their last bits, so they compare to fewer digits.
UNITS = frozenset("forecast_units lower_ci upper_ci forecast_units_future units forecast".split())
TWIN, NAIVE = "ridge", "_naive"
_HEADER = re.compile(r"^-- :(\w+(?:@\w+)?)[ \t]*(.*)$", re.MULTILINE)


def _expand(sql: str) -> str:
    """``half_up(x, n)``: rounding through decimals, which drops the last bits of x first."""
    while (start := sql.find("half_up(")) >= 0:
        depth, comma, end = 0, -1, start + len("half_up")
        while True:
            char = sql[end]
            depth += (char == "(") - (char == ")")
            if char == "," and depth == 1:
                comma = end
            if depth == 0:
                break
            end += 1
        value, digits = sql[start + len("half_up(") : comma], sql[comma + 1 : end].strip()
        sql = f"{sql[:start]}CAST(round(CAST({value} AS DECIMAL(38, 10)), {digits}) AS DOUBLE){sql[end + 1 :]}"
    return sql


def _blocks(file: str) -> dict[str, tuple[str, list[str]]]:
    parts = _HEADER.split((Path(__file__).parent / file).read_text())[1:]
    triples = zip(parts[::3], parts[1::3], parts[2::3], strict=True)
    return {
        name: (body.strip().rstrip(";"), [c.strip() for c in cols.split(",") if c.strip()])
        for name, cols, body in triples
    }


def _needed(body: str, tables: dict, found: dict[str, str]) -> None:
    for word in re.findall(r"\w+", body):
        if word in tables and word not in found:
            inner = tables[word][0]
            _needed(inner, {k: v for k, v in tables.items() if k != word}, found)
            found[word] = inner


def _of(variant: str, tables: dict) -> dict:
    """The tables as a variant defines them."""
    own = {name.removesuffix(f"@{variant}"): block for name, block in tables.items() if variant and name.endswith(f"@{variant}")}
    return {name: block for name, block in tables.items() if "@" not in name} | own


def _rounded(column: str) -> str:
    name, _, digits = column.partition(":")
    return f'half_up("{name}", {digits or DIGITS}) AS "{name}"'


def statements() -> dict[str, str]:
    tables, queries = _blocks("tables.sql"), _blocks("queries.sql")
    named = {name.split("@")[0] for name in queries}
    for name, (body, doubles) in list(queries.items()):
        twin = name.removesuffix(NAIVE)
        if twin != name and twin not in named:
            queries[f"{twin}@{TWIN}"] = (body, [f"{c}:{UNIT_DIGITS}" if c in UNITS else c for c in doubles])
    out = {}
    for title, (body, doubles) in queries.items():
        name, _, variant = title.partition("@")
        ctes: dict[str, str] = {}
        _needed(body, _of(variant, tables), ctes)
        clause = ",\n".join(f"{t} AS (\n{sql}\n)" for t, sql in ctes.items())
        if doubles:
            body = f"SELECT * REPLACE ({', '.join(map(_rounded, doubles))}) FROM (\n{body}\n) AS result"
        out[name] = _expand(f"WITH {clause}\n{body}" if clause else body)
    return out
