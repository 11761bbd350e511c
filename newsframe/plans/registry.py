"""How queries are registered: a function of (spark, sf_dir), with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """views: common table expressions that sql reads."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = (f"WITH RECURSIVE {', '.join(views)} " if views else "") + sql
        return function

    return add
