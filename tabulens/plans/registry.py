"""Registry of named queries: each is a Spark builder ``(spark, sf_dir) -> DataFrame``
over the test tables plus, where the result is SQL-expressible, the DuckDB
oracle text computing the same columns."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def _load():
    # importing the modules fills the registry
    from tabulens.plans import queries_profile  # noqa: F401
    from tabulens.plans import queries_analysis  # noqa: F401
    from tabulens.plans import queries_prep  # noqa: F401
    from tabulens.plans import queries_reports  # noqa: F401
    from tabulens.plans import queries_charts  # noqa: F401
    from tabulens.plans import queries_ml  # noqa: F401
    from tabulens.plans import queries_sources  # noqa: F401
    from tabulens.plans import queries_exact  # noqa: F401
    from tabulens.plans import queries_boards  # noqa: F401


def all_queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def headline() -> list[str]:
    _load()
    return list(HEADLINE)
