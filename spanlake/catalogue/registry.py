"""Registered queries: a Spark callable, its declared output, and an equivalent SQL text.

The declared output ("query_id:l score:d") is applied to both sides, so integer
widths and the last digits of floating sums cannot differ between engines.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SPARK = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
_DUCK = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}
DIGITS = 6


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in _columns(spec):
        c = F.col(name).cast(_SPARK[kind])
        if kind == "d":
            c = F.round(c, DIGITS) + F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*cols)


def shape_sql(sql: str, spec: str) -> str:
    cols = []
    for name, kind in _columns(spec):
        c = f'CAST("{name}" AS {_DUCK[kind]})'
        if kind == "d":
            c = f"round({c}, {DIGITS}) + 0.0"
        cols.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(cols)} FROM ({sql}) shaped"


def query(name: str, spec: str, sql: str | None = None, views: str = ""):
    """Register ``fn(f)``, where ``f`` gives the fixture views of one data folder."""
    from .views import Views, with_views

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: shape(fn(Views(spark, sf_dir)), spec)
        if sql is not None:
            SQL[name] = shape_sql(with_views(sql, views), spec)
        return fn

    return register
