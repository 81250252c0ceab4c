"""Registry of queries: name -> DataFrame job, and the SQL that must return the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.fixtures import SQL_FIXTURES, Tables

JOBS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a job under ``name``; fixture tables used in ``sql`` are added as CTEs."""

    def add(job: Callable[[Tables], DataFrame]):
        JOBS[name] = job
        if sql is not None:
            SQL[name] = with_fixtures(sql)
        return job

    return add


def with_fixtures(sql: str) -> str:
    """Prefix the SQL with the definitions of the derived tables it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_FIXTURES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    own = re.match(r"(?is)with\s+(recursive\s+)?", body)
    ctes = [f"{name} AS ({SQL_FIXTURES[name]})" for name in needed]
    if own:
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[own.end():]])
    if not ctes:
        return body
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    job = JOBS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(Tables(spark, sf_dir))

    run.__name__ = name
    return run
