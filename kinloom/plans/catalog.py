"""Registry of the runnable queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.plans.bridge import Bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Bridge], DataFrame]) -> Callable[[Bridge], DataFrame]:
    """Register a function of the bridge tables under its own name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Bridge(spark, sf_dir))
    return fn


def big(col: str, alias: str | None = None):
    return F.col(col).cast("bigint").alias(alias or col.split(".")[-1])


def joined(col: str, sep: str = ">", alias: str | None = None):
    return F.array_join(F.col(col), sep).alias(alias or col)


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    from kinloom.plans import (  # noqa: F401
        queries_edits,
        queries_events,
        queries_graph,
        queries_reader,
        queries_text,
        queries_work,
    )

    return dict(QUERIES)
