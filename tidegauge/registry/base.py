"""Registration of a Spark query next to its SQL counterpart.

The output contract is declared once ("name:type ...") and applied to both sides: same
columns, same types, doubles rounded to the same number of digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.registry.inputs import CTES, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SQL_TYPES = {"int": "integer", "long": "bigint", "double": "double", "string": "varchar", "bool": "boolean"}
SPARK_TYPES = {"int": "int", "long": "bigint", "double": "double", "string": "string", "bool": "boolean"}


def _parse(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in columns.split()]


def shape(df: DataFrame, columns: str, digits: int) -> DataFrame:
    out = []
    for name, kind in _parse(columns):
        c = F.col(f"`{name}`").cast(SPARK_TYPES[kind])
        if kind == "double":
            c = F.round(c, digits) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def _needed(text: str) -> list[str]:
    """CTEs that a text uses, dependencies first."""
    seen: list[str] = []

    def visit(sql: str) -> None:
        for name, body in CTES.items():
            if name not in seen and re.search(rf"\b{name}\b", sql):
                visit(body)
                if name not in seen:
                    seen.append(name)

    visit(text)
    return seen


def full_sql(body: str, columns: str, digits: int) -> str:
    body = body.strip().rstrip(";")
    own = ""
    if body[:5].lower() == "with ":
        # "with a as (...), b as (...) select ..." -> split before the last top-level select
        depth, cut = 0, None
        for m in re.finditer(r"[()]|\bselect\b", body, re.I):
            if m.group() == "(":
                depth += 1
            elif m.group() == ")":
                depth -= 1
            elif depth == 0:
                cut = m.start()
                break
        own, body = body[5:cut].strip(), body[cut:]
    recursive = own.lower().startswith("recursive ")
    own = own[len("recursive "):] if recursive else own
    parts = [f"{n} as ({CTES[n]})" for n in _needed(own + " " + body)]
    if own:
        parts.append(own)
    cols = []
    for name, kind in _parse(columns):
        c = f'cast("{name}" as {SQL_TYPES[kind]})'
        cols.append((f"round({c}, {digits}) + 0.0e0" if kind == "double" else c) + f' as "{name}"')
    lead = "with recursive " if recursive else "with "
    head = lead + ", ".join(parts) + " " if parts else ""
    return f"{head}select {', '.join(cols)} from ({body}) as result"


_INPUTS: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, path: str) -> Inputs:
    """Lazy frames of a folder, analysed once per application (plans only, no data is kept)."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _INPUTS:
        _INPUTS[key] = Inputs(spark, path)
    return _INPUTS[key]


def query(name: str, columns: str, sql: str | None = None, digits: int = 9):
    """Register fn(inputs) -> DataFrame under a name."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return shape(fn(inputs(spark, path)), columns, digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = full_sql(sql, columns, digits)
        return fn

    return wrap
