"""Bucketed ranks, running sums, quantiles and lookups against plain forms, with a hot group."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe import session
from tallyframe.functions.numbers import hash_text
from tallyframe.operators import scale as S
from tallyframe.operators.joins import salted_lookup


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows in one group, many equal values."""
    return spark.range(6000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 97 / 8 - 3).alias("v"),
    ).persist()


def test_rank_equals_row_number(hot):
    digest = hash_text(1, F.col("id"))
    ranked = S.grouped_rank(hot.withColumn("d", digest), ["g"], S.hash_bucket(F.col("d")), [F.col("d")], "r", "n")
    plain = ranked.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("d"))).withColumn(
        "c", F.count(F.lit(1)).over(Window.partitionBy("g"))
    )
    assert plain.where("r <> w OR n <> c").count() == 0 and plain.count() == 6000


def test_range_rank_with_a_hot_group(spark, hot):
    """Equal to row_number, and no range holds much more than its share though a third of the rows are one group."""
    rows = hot.withColumn("g", F.when(F.col("g") != "g7", F.col("g"))).withColumn("d", hash_text(1, F.col("id")))
    ranked = S.range_rank(rows, ["g"], [F.col("d")], "r", "n")
    plain = ranked.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("d"))).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("g")))
    assert plain.where("r <> w OR n <> c").count() == 0 and plain.count() == 6000
    first = S.range_rank(rows, ["g"], [F.col("d")], "r", limit=5)
    assert first.count() == 5 * rows.select("g").distinct().count() and first.agg(F.max("r")).first()[0] == 5
    dealt = rows.repartitionByRange(16, "g", "d").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert dealt < 3 * 6000 / 16
    assert S.range_rank(rows, [], [F.col("d")], "r").agg(F.count_distinct("r"), F.max("r")).first() == (6000, 6000)
    assert S.range_rank(rows.where("1 = 0"), ["g"], [F.col("d")], "r").collect() == []


def test_global_rank_is_dense(hot):
    digest = hash_text(1, F.col("id"))
    ranked = S.grouped_rank(hot.withColumn("d", digest), [], S.hash_bucket(F.col("d")), [F.col("d")], "r")
    low, high, n = ranked.agg(F.min("r"), F.max("r"), F.count_distinct("r")).first()
    assert (low, high, n) == (1, 6000, 6000)


def test_running_weight(hot):
    counts = hot.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    out = S.grouped_running(counts, ["g"], "v", "n").withColumn(
        "w", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    assert out.where("before <> w").count() == 0


def test_quantiles_match_numpy(hot):
    data = hot.toPandas()
    got = {r["g"]: r for r in S.quantiles(hot, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 0.95, "d": 1.0}).collect()}
    for g, part in data.groupby("g"):
        want = np.quantile(part["v"], [0.0, 0.37, 0.95, 1.0])
        assert np.allclose([got[g][k] for k in "abcd"], want)


def test_quantiles_skip_nulls(spark):
    df = spark.createDataFrame([("x", None), ("x", 2.0), ("x", 4.0), ("y", None)], "g string, v double")
    got = {r["g"]: r["m"] for r in S.quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {"x": 3.0}


def test_first_by_hash_takes_exact_numbers(hot):
    out = S.first_by_hash(hot, ["g"], hash_text(3, F.col("id")), 5)
    assert {r["n"] for r in out.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()} == {5}


def test_salted_lookup_equals_join(hot, spark):
    dim = hot.select("g").distinct().withColumn("size", F.length("g"))
    b = hot.join(dim, "g").select("id", "size").collect()
    for most in (1, 150, 10_000):
        a = salted_lookup(hot, dim, ["g"], hot_rows=most).select("id", "size").collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_tables_are_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_tables", lambda spark: f"file://{tmp_path}/own")
    assert session.cut_lineage(spark.range(5)).count() == 5 and os.listdir(f"{tmp_path}/own")
    session.release_tables(spark)
    assert not os.path.exists(f"{tmp_path}/own")
