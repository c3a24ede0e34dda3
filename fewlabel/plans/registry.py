"""Registry of named queries: Spark builders plus DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is SQL over the
driver's pre-registered views.  Query modules register themselves on import.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # Import for side effects (registration).
    from fewlabel.plans import q_augment, q_features, q_io, q_metrics, q_models, q_prepare, q_sampling, q_ssl  # noqa: F401
