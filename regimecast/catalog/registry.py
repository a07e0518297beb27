"""Registered queries, each with the plain SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimecast.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The derived frames of sources.views, written as SQL.
VIEW_SQL = {
    "hourly_user": """SELECT user_id, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS y
        FROM events GROUP BY ALL""",
    "hourly_type": """SELECT event_type, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS y
        FROM events GROUP BY ALL""",
    "hourly_all": """SELECT date_trunc('hour', ts) AS ts, round(sum(value), 2) AS y
        FROM events GROUP BY ALL""",
    "daily_orders": """SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) AS y
        FROM orders GROUP BY ALL""",
    "hourly_gappy": """SELECT event_type, ts,
        CASE WHEN (epoch_ms(ts) // 3600000) % 11 <> 3 THEN y END AS y FROM hourly_type""",
    "hourly_dirty": """SELECT h.event_type, h.ts, h.y, c.copy::INTEGER AS copy
        FROM hourly_type h, (VALUES (1), (2)) c(copy)
        WHERE (epoch_ms(ts) // 3600000) % 53 <> 0
          AND (c.copy = 1 OR (epoch_ms(ts) // 3600000) % 97 = 0)""",
    "lagged": """SELECT * FROM (SELECT event_type, ts, y,
            lag(y, 1) OVER w AS lag1, lag(y, 24) OVER w AS lag24,
            round(avg(y) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 6) AS mean24
        FROM hourly_type WINDOW w AS (PARTITION BY event_type ORDER BY ts)) WHERE lag24 IS NOT NULL""",
    "pred_long": """SELECT event_type, ts, 'lag1' AS model, y, lag1 AS yhat FROM lagged
        UNION ALL SELECT event_type, ts, 'lag24', y, lag24 FROM lagged
        UNION ALL SELECT event_type, ts, 'mean24', y, mean24 FROM lagged""",
    "pred_pairs": """SELECT p.event_type, p.ts, p.model, p.y, p.yhat,
            round(p.yhat - 1.96 * s.s, 6) AS lower, round(p.yhat + 1.96 * s.s, 6) AS upper
        FROM pred_long p JOIN (SELECT event_type, model, stddev_pop(y - yhat) AS s
            FROM pred_long GROUP BY ALL) s USING (event_type, model)""",
    "emb_xy": """SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x, label FROM embeddings""",
    "uv": """SELECT l_orderkey, l_linenumber, l_quantity - 25.0 AS u,
        round(l_tax * 100.0 - 4.0, 6) + 0.0 AS v FROM lineitem""",
    "raw_strings": """SELECT o_orderkey AS id,
        CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y %H:%M')
             WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M')
             ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS mixed,
        strftime(o_orderdate, '%d-%m-%Y %H:%M') AS d1, strftime(o_orderdate, '%Y%m%d %H:%M') AS d2,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS d3, o_orderdate::DATE AS day,
        (o_orderkey % 24 + 1)::INTEGER AS h,
        CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE format('{:.2f}', o_totalprice) END AS amount
        FROM orders""",
}


def define_view(name: str, sql: str) -> None:
    """A further shared common table expression for the SQL side."""
    VIEW_SQL[name] = sql


# A mean over a power of two of cent amounts ends on an exact half digit, which the last bit of a
# sum would round either way. Both sides add this before rounding a result, so that every such half
# goes upwards.
NUDGE = 1e-9


def rounded(value: str | Column, digits: int = 6) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + NUDGE, digits) + 0.0


def nudge(sql: str) -> str:
    """The same for each round(x, 4) and round(x, 6) of a statement."""
    at = sql.find("round(")
    if at < 0:
        return sql
    start = at + len("round(")
    depth, comma, end = 1, start, start
    while depth:
        char = sql[end]
        depth += (char in "([") - (char in ")]")
        if char == "," and depth == 1:
            comma = end
        end += 1
    value, digits = nudge(sql[start:comma]), sql[comma + 1 : end - 1].strip()
    if digits in ("4", "6"):
        value = f"({value}) + {NUDGE!r}"
    return f"{sql[:start]}{value}, {digits}){nudge(sql[end:])}"


def _needed(sql: str, found: list[str]) -> None:
    for name, body in VIEW_SQL.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(body, found)
            if name not in found:
                found.append(name)


def expand(sql: str) -> str:
    """Prefix the common table expressions the statement mentions."""
    found: list[str] = []
    _needed(sql, found)
    ctes = [f"{n} AS MATERIALIZED ({VIEW_SQL[n]})" for n in found]
    body = nudge(sql.strip())
    if body.upper().startswith("WITH "):
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def query(name: str, sql: str | None = None):
    """Register ``fn(views)``; it runs over the whole tables of the folder it is given."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def oracle_statements() -> dict[str, str]:
    return {name: expand(sql) for name, sql in SQL.items()}
