"""Registry of named queries: a Spark job and, where SQL can say it, its oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import round_to
from .oracle import compose
from .tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, steps: dict[str, str] | None = None):
    """Register a job over :class:`Tables` under ``name``."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = compose(oracle, steps)
        return fn
    return wrap


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return round_to(col, digits).alias(name or (c.split(".")[-1] if isinstance(c, str) else "value"))


def big(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("bigint").alias(name or (c if isinstance(c, str) else "value"))


_SHARED: dict[tuple[str, str], Tables] = {}


def tables_of(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables of a folder; queries of one session share staged intermediates."""
    return _SHARED.setdefault((spark.sparkContext.applicationId, sf_dir), Tables(spark, sf_dir))


def load() -> None:
    from . import queries_features, queries_field, queries_moves, queries_sources  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(tables_of(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracles() -> dict[str, str]:
    load()
    return dict(_ORACLES)
