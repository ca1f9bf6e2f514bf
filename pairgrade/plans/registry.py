"""Query registry: one Spark callable and, where SQL can say it, one oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairgrade.plans.inputs import Inputs
from pairgrade.plans.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``key``."""

    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = with_views(sql)
        return fn

    return wrap


def with_views(sql: str) -> str:
    """Prefix the CTEs of every stand-in view the text mentions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in needed)
    if re.match(r"with\b", body, re.I):
        return f"with {ctes},\n{re.sub(r'^with', '', body, count=1, flags=re.I).lstrip()}"
    return f"with {ctes}\n{body}"
