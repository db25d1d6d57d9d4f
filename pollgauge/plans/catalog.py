"""Registry of queries over the driver tables and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pollgauge.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    twin: str | None

    @property
    def sql(self) -> str | None:
        return with_views(self.twin) if self.twin else None


REGISTRY: dict[str, Query] = {}
# Named sub-selects that the SQL twins share.
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = body.strip()


def with_views(sql: str) -> str:
    """Prefix a twin with the shared sub-selects that it names, each after those it needs."""
    ordered: list[str] = []

    def add(text: str) -> None:
        words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text))
        for name in VIEWS:
            if name in words and name not in ordered and text is not VIEWS[name]:
                add(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    add(sql)
    if not ordered:
        return sql.strip()
    parts = [f"{name} AS (\n{VIEWS[name]}\n)" for name in ordered]
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()


def query(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, run, sql)
        return fn

    return wrap
