"""All queries of the library by name, each with SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read, spread

#: Tables whose rows hold long texts.
TEXTS = ("documents", "pages")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = read(spark, sf_dir, name)
    return spread(df) if name in TEXTS else df


from . import (  # noqa: E402, F401
    document_queries, event_queries, geometry_queries, layout_queries, match_queries, record_queries, store_queries, text_queries,
)
