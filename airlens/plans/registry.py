"""Registry of named queries and their comparison SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airlens.fixtures import VIEW_SQL, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it mentions, in dependency order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(VIEW_SQL[name])
    views = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in VIEW_SQL if name in needed)
    body = sql.strip()
    if not views:
        return body
    if re.match(r"WITH RECURSIVE\s", body, re.I):
        return f"WITH RECURSIVE {views},\n{body[14:].lstrip()}"
    if re.match(r"WITH\s", body, re.I):
        return f"WITH {views},\n{body[4:].lstrip()}"
    return f"WITH {views}\n{body}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under ``name``; without ``oracle`` only rows are checked."""

    def decorate(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        QUERIES[name] = lambda spark, folder: fn(Fixtures(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return decorate
