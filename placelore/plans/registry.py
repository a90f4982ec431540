"""Registry of named queries and the ANSI SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placelore.sources import proxies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: SQL as written, to be put together in larger checks.
RAW: dict[str, str] = {}
BY_NAME: dict[str, Callable[[proxies.Views], DataFrame]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views)`` under ``name``; ``sql`` may use the ``v_*`` views of the proxies module."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(proxies.Views(spark, sf_dir))

        QUERIES[name], BY_NAME[name] = run, fn
        if sql:
            RAW[name] = sql
            ORACLE[name] = with_views(sql)
        return fn

    return wrap


def with_views(sql: str) -> str:
    """Prefix the common table expressions that ``sql`` refers to, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in proxies.VIEW_SQL and name not in order:
                visit(proxies.VIEW_SQL[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    body = sql.strip()
    recursive = bool(re.match(r"with\s+recursive\b", body, re.I))
    ctes = [f"{n} as ({proxies.VIEW_SQL[n]})" for n in order]
    rest = re.match(r"with(\s+recursive)?\s+(.*)", body, re.I | re.S)
    head = "with recursive " if recursive else "with "
    if rest:
        return head + ",\n".join(ctes + [rest.group(2)])
    return (head + ",\n".join(ctes) + "\n" + body) if ctes else body
