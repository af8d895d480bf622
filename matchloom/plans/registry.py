"""Queries and their SQL, by the operator ids of the coverage list."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.plans.views import DUCK, Tables

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("scalars", "search", "matching", "vectors", "changes", "pricing", "quote", "reports", "documents", "ingest")


def with_views(sql: str) -> str:
    """SQL with ``{name}`` references: the fixture views it needs become CTEs before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{([a-z_]\w*)\}", text):
            if name in DUCK and name not in order:
                need(DUCK[name])
                order.append(name)

    def plain(text: str) -> str:
        return re.sub(r"\{([a-z_]\w*)\}", r"\1", text)

    need(sql)
    body = plain(sql).strip()
    if not order:
        return body
    # Stages are used by all that follow them, so they are computed once.
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n.startswith('v_stage_') else ''}({plain(DUCK[n]).strip()})" for n in order)
    return f"WITH {ctes},\n{body[4:].lstrip()}" if body.upper().startswith("WITH") else f"WITH {ctes}\n{body}"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self._sql: dict[str, str] = {}

    @property
    def oracles(self) -> dict[str, str]:
        return {name: with_views(text) for name, text in self._sql.items()}

    def add(self, name: str, sql: str | None = None):
        """Decorator: register ``fn(tables)`` as query ``name``, with its DuckDB SQL."""

        def wrap(fn: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql is not None:
                self._sql[name] = sql
            return fn

        return wrap


REGISTRY = Registry()
query = REGISTRY.add


def load() -> Registry:
    for m in _MODULES:
        importlib.import_module(f"matchloom.plans.{m}")
    return REGISTRY
