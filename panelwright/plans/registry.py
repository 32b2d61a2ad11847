"""Query catalogue: each entry binds operators to the tables and states the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from panelwright.plans.oracle_views import ORACLE_VIEWS
from panelwright.sources.views import VIEW_SQL, Inputs

SQL_VIEWS = {**VIEW_SQL, **ORACLE_VIEWS}

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def views_used(sql: str) -> list[str]:
    """View names a statement needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(body)
                order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """Prepend the view definitions as CTEs, since only the raw tables exist on the SQL side."""
    names = views_used(sql)
    text = sql.strip()
    if not names:
        return text
    ctes = ",\n".join(f"{name} AS ({SQL_VIEWS[name].strip()})" for name in names)
    if re.match(r"(?i)with\b", text):
        return f"WITH {ctes},\n" + re.sub(r"(?i)^with\b", "", text, count=1)
    return f"WITH {ctes}\n{text}"


@lru_cache(maxsize=4)
def inputs(spark: SparkSession, directory: str) -> Inputs:
    """Lazy tables of a directory, shared by the queries of a session so that footers are read once."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC wall-clock times
    return Inputs(spark, directory)


def bound(fn: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(inputs(spark, sf_dir))

    return run
