"""Registered queries: an operator applied to the tables of a folder, and its DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradus.sources.fixtures import Fixtures
from gradus.sources.fixture_sql import FIXTURE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_fixtures(body: str) -> str:
    """body with the common table expressions of every fixture that it names, in order of need."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in FIXTURE_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ", ".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in needed)
    body = body.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def query(name: str, sql: str | None = None):
    """Register a function of the fixtures under `name`."""

    def add(f: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = with_fixtures(sql)
        return f

    return add
