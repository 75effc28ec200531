"""Registry of the queries: name -> (Spark query, SQL that gives the same rows)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, removed when the driver's Python ends."""
    from lodestone.operators.lineage import keep_until_end, shared_folder

    return keep_until_end(spark, f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}")


def queries() -> dict:
    from lodestone.plans import aggregates, analysis, clones, files, joins, model, more, scalars  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(ORACLES)
