"""Registered queries: each runs one operator over whole driver tables; most carry a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.plans.feed_views import AS_OF, Feed


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    build: Callable[[Feed], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}
DAY = date(2024, 1, 15)


def query(operators: str, sql: str | None = None):
    """Register ``build``; ``operators`` names the inventory entries it covers."""

    def register(build: Callable[[Feed], DataFrame]) -> Callable[[Feed], DataFrame]:
        name = build.__name__
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, operators, build, sql)
        return build

    return register


def flat(df: DataFrame) -> DataFrame:
    """Columns in types that print alike in both engines: times as microseconds, lists as text, doubles rounded."""
    out = []
    for field in df.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(kind, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.array_join(c, ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def run(name: str, spark: SparkSession, directory: str) -> DataFrame:
    return flat(CATALOG[name].build(Feed(spark, directory)))


def load() -> dict[str, Query]:
    """All registered queries."""
    from tidewire.plans import (  # noqa: F401
        cycle_queries, feed_queries, merge_queries, score_queries, sink_queries, stream_queries, text_queries,
    )

    return CATALOG
