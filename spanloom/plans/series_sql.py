"""Check SQL for the series operators, written densely: every series at every sample."""

from __future__ import annotations

from ..operators.families import FAMILIES
from ..operators.series import Grid, Matcher
from .inputs import WITH

_SOURCES = {
    "events": "ev",
    "conflicts": "(SELECT e.* FROM conflict_rows c JOIN ev e ON e.event_id = c.event_id)",
    "outcomes": (
        "(SELECT e.project_id, e.repository, e.branch, e.observed_at, o.kind, o.status, "
        "o.evidence_source, o.correlation_basis FROM outcome_rows o JOIN ev e ON e.event_id = o.event_id)"
    ),
}


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return "'" + str(value).replace("'", "''") + "'"


def leaf(name: str, grid: Grid, matchers: tuple[Matcher, ...] = ()) -> tuple[tuple[str, ...], str]:
    """(labels, SELECT of labels, bucket, value)."""
    family = FAMILIES[name]
    columns = family.label_columns
    label_sql = {l: f"COALESCE({c}, {_literal(d)})" for l, (c, d) in columns.items()}
    where = [
        f"epoch_us(observed_at) >= {grid.first_us}", f"epoch_us(observed_at) <= {grid.end_us}",
    ]
    if family.only:
        column, values = family.only
        where.append(f"{column} IN ({', '.join(map(_literal, values))})")
    for m in matchers:
        test = (
            f"{label_sql[m.label]} = {_literal(m.value)}" if m.op in ("=", "!=")
            else f"regexp_full_match({label_sql[m.label]}, {_literal(m.value)})"
        )
        where.append(f"NOT ({test})" if m.op in ("!=", "!~") else test)
    num, den, having = {
        "count": ("COUNT(*)", "COUNT(*)", ""),
        "flag": (f"SUM(CASE WHEN {family.value} THEN 1 ELSE 0 END)", "COUNT(*)", ""),
        "ratio": ("SUM(CASE WHEN status IN ('ok','success','succeeded') THEN 1 ELSE 0 END)", "COUNT(*)", ""),
        "sum": (f"SUM({family.value})", f"COUNT({family.value})", f"HAVING COUNT({family.value}) > 0"),
        "avg": (f"SUM({family.value})", f"COUNT({family.value})", f"HAVING COUNT({family.value}) > 0"),
    }[family.aggregate]
    bucket = "0" if grid.points == 1 else (
        f"LEAST(GREATEST((epoch_us(observed_at) - {grid.start_us} + {grid.step_us - 1000}) // {grid.step_us}, 0), {grid.points - 1})"
    )
    labels = family.labels
    select = "".join(f"{label_sql[l]} AS {l}, " for l in labels)
    names = "".join(f"{l}, " for l in labels)
    contrib = (
        f"SELECT {select}{bucket} AS bucket, CAST({num} AS DOUBLE) AS num, CAST({den} AS DOUBLE) AS den "
        f"FROM {_SOURCES[family.source]} WHERE {' AND '.join(where)} GROUP BY ALL {having}"
    )
    shared = " AND ".join(f"s.{l} = c.{l}" for l in labels)
    join = f"{shared} AND g.bucket = c.bucket" if labels else "g.bucket = c.bucket"
    over = f"OVER (PARTITION BY {', '.join(f's.{l}' for l in labels) or '1'} ORDER BY g.bucket)"
    cum_num, cum_den = f"SUM(COALESCE(c.num, 0)) {over}", f"SUM(COALESCE(c.den, 0)) {over}"
    value = cum_num if family.aggregate in ("count", "flag", "sum") else f"{cum_num} / NULLIF({cum_den}, 0)"
    return labels, (
        f"SELECT {''.join(f's.{l}, ' for l in labels)}g.bucket, {value} AS value FROM "
        f"(SELECT DISTINCT {names}1 AS one FROM ({contrib})) s "
        f"CROSS JOIN (SELECT unnest(generate_series(0, {grid.points - 1})) AS bucket) g "
        f"LEFT JOIN ({contrib}) c ON {join}"
    )


def agg(function: str, by: tuple[str, ...], inner: str) -> tuple[tuple[str, ...], str]:
    keys = "".join(f"{l}, " for l in by)
    value = {"sum": "SUM(value)", "avg": "AVG(value)", "max": "MAX(value)", "count": "CAST(COUNT(value) AS DOUBLE)"}[function]
    return by, f"SELECT {keys}bucket, {value} AS value FROM ({inner}) GROUP BY {keys}bucket"


def topk(k: int, labels: tuple[str, ...], grid: Grid, inner: str) -> tuple[tuple[str, ...], str]:
    order = "".join(f", {l} ASC" for l in sorted(labels))
    names = ", ".join(labels)
    return labels, (
        f"SELECT {names}, bucket, value FROM ({inner}) WHERE ({names}) IN (SELECT ({names}) FROM ("
        f"SELECT {names} FROM ({inner}) WHERE bucket = {grid.points - 1} "
        f"ORDER BY value DESC NULLS LAST{order} LIMIT {k}))"
    )


def divide(labels: tuple[str, ...], top: str, bottom: str) -> tuple[tuple[str, ...], str]:
    on = " AND ".join([*[f"a.{l} = b.{l}" for l in labels], "a.bucket = b.bucket"])
    return labels, (
        f"SELECT {''.join(f'a.{l}, ' for l in labels)}a.bucket, a.value / NULLIF(b.value, 0) AS value "
        f"FROM ({top}) a JOIN ({bottom}) b ON {on}"
    )


def or_zero(grid: Grid, inner: str) -> tuple[tuple[str, ...], str]:
    return (), (
        f"SELECT bucket, value FROM ({inner}) UNION ALL "
        f"SELECT bucket, 0.0 FROM (SELECT unnest(generate_series(0, {grid.points - 1})) AS bucket) "
        f"WHERE NOT EXISTS (SELECT 1 FROM ({inner}))"
    )


def matrix(labels: tuple[str, ...], inner: str, grid: Grid, value: str = "value") -> str:
    names = "".join(f"{l}, " for l in labels)
    return (
        f"{WITH} SELECT {names}CAST({grid.start_us} + bucket * {grid.step_us} AS BIGINT) AS sample_us, "
        f"{value} AS value FROM ({inner})"
    )


def report_sql(spec: tuple, grid: Grid, value: str = "value") -> str:
    op, arg, family, fixed = spec
    labels, inner = leaf(family, grid, fixed)
    if op == "topk":
        labels, inner = topk(arg, labels, grid, inner)
    elif op in ("sum", "avg", "max", "count"):
        labels, inner = agg(op, arg, inner)
    elif op == "sum_or_zero":
        labels, inner = or_zero(grid, agg("sum", (), inner)[1])
    elif op == "or_zero":
        labels, inner = or_zero(grid, inner)
    elif op == "share":
        by, part, whole = arg
        top = agg("sum", by, leaf(family, grid, (*fixed, part))[1])[1]
        bottom = agg("sum", by, leaf(family, grid, (*fixed, whole))[1])[1]
        labels, inner = divide(by, top, bottom)
    return matrix(labels, inner, grid, value)
