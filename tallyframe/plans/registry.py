"""Registry of named queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.views import oracle_views

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    views: tuple[str, ...]
    floats: tuple[str, ...]
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(
    name: str,
    sql: str | None = None,
    views: Sequence[str] = (),
    floats: Sequence[str] = (),
    covers: str = "",
) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Register a query; its fractions are reported to six digits on both sides."""

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c).cast("double"), DIGITS) + 0.0 for c in floats}) if floats else out

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, sql, tuple(views), tuple(floats), tuple(covers.split()))
        return run

    return add


def oracle_text(q: Query) -> str:
    """Complete SQL of a query: views, body, rounding."""
    ctes = [f"{n} AS ({body})" for n, body in oracle_views(list(q.views)).items()]
    ctes.append(f"result AS ({q.sql})")
    fix = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in q.floats)
    columns = f"* REPLACE ({fix})" if fix else "*"
    return f"WITH {', '.join(ctes)} SELECT {columns} FROM result"
