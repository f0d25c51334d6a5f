"""Registry of queries and the SQL that states their results."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakeloom.sources.fixtures import SQL_VIEWS, Tables


@dataclass(frozen=True)
class Query:
    name: str
    operator: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, operator: str, oracle: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, operator, build, oracle)
        return build

    return register


def with_views(sql: str) -> str:
    """Prepend the shared views that ``sql`` names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in SQL_VIEWS:
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(SQL_VIEWS[view])
                needed.append(view)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in needed)
    body = sql.strip()
    recursive = re.match(r"(?is)with\s+recursive\s+", body)
    plain = re.match(r"(?is)with\s+", body)
    if recursive:
        return f"WITH RECURSIVE {head},\n{body[recursive.end():]}"
    if plain:
        return f"WITH {head},\n{body[plain.end():]}"
    return f"WITH {head}\n{body}"


def load_all() -> dict[str, Query]:
    from lakeloom.plans import (  # noqa: F401
        incremental,
        io,
        lineage,
        mapping,
        models,
        partitioned,
        relational,
        runlog,
        scalars,
        streams,
    )

    return REGISTRY


def as_callable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.build(Tables(spark, sf_dir))

    run.__name__ = q.name
    return run
