"""Queries of this subpackage over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


#: Texts can be long, so fewer rows than Spark's default cross to Python at once.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set(ARROW_ROWS, "500")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from tallyframe.llm import (  # noqa: E402, F401  each registers its queries
    q_conversations,
    q_dedup,
    q_lines,
    q_mix,
    q_quality,
    q_runs,
    q_text,
    q_web,
)
