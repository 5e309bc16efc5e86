"""Named queries over the given tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Fixtures, oracle
from ..session import tune

_QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of the fixtures under its own name, with its checking SQL."""

    def register(fn):
        key = name or fn.__name__
        _QUERIES[key] = fn
        if sql:
            _ORACLES[key] = oracle(sql)
        return fn

    return register


def _load() -> None:
    from . import comparison, events, genes, junctions, sequences, tables  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Fixtures(tune(spark, fine=True), folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
