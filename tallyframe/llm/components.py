"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage, drop_tables


def _hook(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move every larger neighbour of a vertex to the vertex's smallest neighbour; also the table that it reads."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))  # as a table, so that the join can split a hub
    moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").distinct(), low


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each edge points down; join a vertex and its lower neighbours to the lowest; also the table that it reads."""
    low = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))
    others = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(low.select("u", F.col("m").alias("v"))).distinct(), low


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(id, component)`` of every vertex that is not the smallest of its component.

    ``edges`` has two bigint columns ``u`` and ``v``; loops and NULLs are left
    out. All work is grouping and joins on the edges, which are written to the
    shared folder after each round; neighbours are never gathered in one place.
    """
    start = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v and u is not null and v is not null")
    now = cut_lineage(start.distinct())
    seen = None
    for _ in range(rounds):
        hooked, low = _hook(now)
        pressed, lowest = _compress(hooked)
        last, now = now, cut_lineage(pressed)
        drop_tables(last, low, lowest)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
