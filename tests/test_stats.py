"""Tests and intervals against brute force and published figures."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import numbers as N
from tallyframe.operators import bootstrap as B
from tallyframe.operators import compare as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x", [0.0, 0.3, 1.0, 1.99, 2.0, 3.5, 6.0, 9.0])
def test_erfc(spark, x):
    assert one(spark, N.erfc(F.lit(x))) == pytest.approx(math.erfc(x), rel=1e-10, abs=1e-300)


@pytest.mark.parametrize("z", [0.25, 1.0, 3.7, 15.9, 16.0, 120.5, 1e6])
def test_ln_gamma(spark, z):
    assert one(spark, N.ln_gamma(F.lit(z))) == pytest.approx(math.lgamma(z), rel=1e-12, abs=1e-11)


def exact_binomial(b, c):
    n, k = b + c, min(b, c)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


@pytest.mark.parametrize("b,c", [(0, 0), (0, 3), (5, 5), (10, 24), (180, 240), (500, 700), (1, 90)])
def test_binomial(spark, b, c):
    assert one(spark, N.binomial_two_sided(F.lit(b), F.lit(c))) == pytest.approx(exact_binomial(b, c), rel=1e-9)


def test_binomial_of_very_many_flips(spark):
    # normal limit: z = 2
    p = one(spark, N.binomial_two_sided(F.lit(50_000_000), F.lit(50_020_000)))
    assert p == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-3)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(7)
    rows = [
        ("d", f"v{v}", int(rng.random() < 0.4 + v / 60), int(rng.random() < 0.55))
        for v in range(24)
        for _ in range(6 + v)
    ]
    return spark.createDataFrame(rows, "dataset string, video string, a int, b int").persist()


def brute_wilcoxon(d):
    d = np.asarray(d)
    size = np.abs(d)
    order = np.argsort(size, kind="stable")
    ranks = np.empty(len(d))
    i = 0
    ties = 0.0
    while i < len(d):
        j = i
        while j < len(d) and size[order[j]] == size[order[i]]:
            j += 1
        ranks[order[i:j]] = (i + 1 + j) / 2
        ties += (j - i) ** 3 - (j - i)
        i = j
    zero = ranks[d == 0].sum() / 2
    t = min(ranks[d > 0].sum() + zero, ranks[d < 0].sum() + zero)
    n = len(d)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, math.erfc(abs((t - n * (n + 1) / 4) / math.sqrt(var)) / math.sqrt(2)))


def test_wilcoxon(pairs):
    cells = C.paired_cells(pairs, ["dataset"])
    d = C.video_differences(cells, ["dataset"])
    got = C.wilcoxon(d, ["dataset"]).first()
    assert got["wilcoxon_p"] == pytest.approx(brute_wilcoxon([r["d"] for r in d.collect()]), rel=1e-9)


def test_wilcoxon_without_differences(spark):
    d = spark.createDataFrame([("d", "v1", 0.0), ("d", "v2", 0.0)], "dataset string, video string, d double")
    assert C.wilcoxon(d, ["dataset"]).first()["wilcoxon_p"] == 1.0


def test_paired_interval_matches_numpy(pairs):
    d = C.video_differences(C.paired_cells(pairs, ["dataset"]), ["dataset"])
    got = B.paired_interval(d, ["dataset"], reps=4000).first()
    x = np.array([r["d"] for r in d.collect()])
    rng = np.random.default_rng(1)
    boot = rng.choice(x, size=(20000, len(x))).mean(axis=1)
    low, high = np.quantile(boot, [0.025, 0.975])
    assert got["ci_low"] == pytest.approx(low, abs=0.02) and got["ci_high"] == pytest.approx(high, abs=0.02)


def test_two_level_bootstrap_matches_rows(pairs):
    """Binomial level two against resampling single questions."""
    cells = pairs.groupBy("dataset", "video").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("k"))
    got = B.bootstrap_interval(cells, ["dataset"], reps=2000).first()
    again = B.bootstrap_interval(cells.repartition(3), ["dataset"], reps=2000).first()
    assert got == again
    rng = np.random.default_rng(3)
    videos = [g["a"].to_numpy() for _, g in pairs.toPandas().groupby("video")]
    boot = []
    for _ in range(3000):
        drawn = [videos[i] for i in rng.integers(0, len(videos), len(videos))]
        boot.append(np.mean([rng.choice(v, len(v)).mean() for v in drawn]))
    low, high = np.quantile(boot, [0.025, 0.975])
    assert got["ci_low"] == pytest.approx(low, abs=0.025) and got["ci_high"] == pytest.approx(high, abs=0.025)


def test_shards_share_the_draws(spark):
    """Split over many shards, the draws are still uniform over the videos of each slice."""
    rows = [("a", f"v{k}", float(k)) for k in range(37)] + [("b", f"v{k}", float(k)) for k in range(3)]
    df = spark.createDataFrame(rows, "dataset string, video string, d double")
    draws = B.shard_draws(B._numbered(df, ["dataset"], 4), ["dataset"], 800, 1, 4)
    per_rep = draws.groupBy("dataset", "rep").agg(F.sum("draws").alias("n"), F.max("size").alias("size")).collect()
    assert len(per_rep) == 1600 and all(r["n"] == r["size"] for r in per_rep)
    per_shard = {r["shard"]: r["n"] / 800 for r in draws.where("dataset = 'a'").groupBy("shard").agg(F.sum("draws").alias("n")).collect()}
    assert sorted(per_shard) == list(range(10))
    for shard, mean in per_shard.items():
        assert mean == pytest.approx(1 if shard == 9 else 4, abs=0.35)
    means = [r["mean"] for r in B.paired_replicates(df, ["dataset"], 3000, 5, 4).where("dataset = 'a'").collect()]
    assert np.mean(means) == pytest.approx(18, abs=0.2)
    assert np.std(means) == pytest.approx(np.std(range(37)) / math.sqrt(37), rel=0.08)


@pytest.mark.parametrize("n,p", [(1, 0.5), (7, 0.9), (60, 0.02), (1000, 0.4), (100_000, 0.37)])
def test_binomial_draws(spark, n, p):
    u = (F.col("id") + 0.5) / 400
    got = [r["x"] for r in spark.range(400).select(N.binomial_draw(F.lit(n), F.lit(p), u).alias("x")).collect()]
    assert min(got) >= 0 and max(got) <= n
    assert np.mean(got) == pytest.approx(n * p, abs=0.1 * math.sqrt(n * p * (1 - p)) + 0.01)
    assert np.std(got) == pytest.approx(math.sqrt(n * p * (1 - p)), rel=0.1, abs=0.02)


def test_ranking(spark):
    rows = [(run, bucket, rep, base + (0.001 if run == "c" and rep == 0 else 0.0)) for run, base in (("a", 0.6), ("b", 0.5), ("c", 0.6), ("d", 0.2)) for bucket in "xy" for rep in range(50)]
    df = spark.createDataFrame(rows, "run string, bucket string, rep int, accuracy double")
    got = {r["run"]: tuple(r)[1:] for r in C.run_ranking(df).collect()}
    assert got["a"] == (2.5, 2, 0, pytest.approx(0.49), 2) and got["c"] == (2.5, 2, 0, pytest.approx(0.51), 1)
    assert got["b"] == (1.0, 1, 2, 0.0, 3) and got["d"] == (0.0, 0, 3, 0.0, 4)
    alone = C.run_ranking(df.where("run = 'a'")).first()
    assert tuple(alone) == ("a", 0.0, 0, 0, 1.0, 1)


def test_gap_decomposition_adds_up(spark):
    rows = [
        ("a", "1", 60, 45), ("a", "2", 40, 10), ("b", "1", 30, 24), ("b", "2", 70, 35),
    ]
    df = spark.createDataFrame(rows, "dataset string, group_code string, rows long, correct long")
    df = df.withColumn("micro_accuracy", F.col("correct") / F.col("rows")).withColumn("row_share", F.col("rows") / 100.0)
    out = {r["group_code"]: r for r in C.gap_decomposition(df, "a", "b").collect()}
    total = out["TOTAL"]
    gap = total["second_micro_accuracy"] - total["first_micro_accuracy"]
    assert gap == pytest.approx(0.59 - 0.55)
    assert total["composition_contribution"] + total["within_contribution"] == pytest.approx(gap)


def test_copeland_and_win_rate(spark):
    rows = [("x", b, 0.6, 0.7) for b in "123"] + [("y", b, 0.3, 0.5) for b in "123"] + [("z", b, 0.45, 0.65) for b in "123"]
    df = spark.createDataFrame(rows, "run string, bucket string, ci_low double, ci_high double")
    got = {r["run"]: (r["copeland"], r["wins"], r["losses"]) for r in C.copeland(df).collect()}
    assert got == {"x": (1.5, 1, 0), "y": (0.5, 0, 1), "z": (1.0, 0, 0)}
    reps = spark.createDataFrame([(0, "x", 1.0), (0, "y", 1.0), (1, "x", 0.5), (1, "y", 0.7)], "rep int, run string, score double")
    assert {r["run"]: r["win_rate"] for r in C.win_rate(reps).collect()} == {"x": 0.25, "y": 0.75}


def test_reranked_and_best_epochs(spark):
    rows = [("r", 1, 0.7, 0.2), ("r", 2, 0.7, 0.1), ("s", None, 0.3, 0.3)]
    df = spark.createDataFrame(rows, "run string, epoch int, accuracy double, other double")
    best = {r["run"]: r["epoch"] for r in C.best_epoch(df, ["run"]).collect()}
    assert best == {"r": 2, "s": None}
    changed = C.reranked_epochs(df.where("epoch IS NOT NULL"), ["run"], "accuracy", "other").first()
    assert (changed["epoch_by_accuracy"], changed["epoch_by_other"], changed["changed"]) == (2, 1, 1)


def test_block_draws_match_the_fold(spark):
    """Array draws give the numbers of the column form."""
    n, p = np.repeat([0, 1, 7, 60, 1000, 100_000], 200), np.repeat([0.5, 0.5, 0.9, 0.02, 0.4, 0.37], 200)
    u = np.tile((np.arange(200) + 0.5) / 200, 6)
    df = spark.createDataFrame([(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(n, p, u, strict=True))], "i int, n long, p double, u double")
    want = [r["x"] for r in df.select("i", N.binomial_draw(F.col("n"), F.col("p"), F.col("u")).alias("x")).orderBy("i").collect()]
    assert N.binomial_hits(n, p, u).tolist() == want


def test_bootstrap_work_goes_in_blocks(spark):
    """Rows that meet a shard's videos are (shard, block), not (shard, replicate)."""
    df = spark.createDataFrame([("a", f"v{k:03}", float(k)) for k in range(300)], "dataset string, video string, d double")
    numbered = B._numbered(df, ["dataset"], 100)
    assert B._dealt(numbered, ["dataset"], 1000, 1, 100, 300).count() == 3
    means = [r["mean"] for r in B.paired_replicates(df, ["dataset"], 1000, 1, 100).collect()]
    assert np.mean(means) == pytest.approx(149.5, abs=0.6)


def test_ranking_draws_once(spark):
    """The replicates are computed once, however often the ranking reads them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = [(run, "x", rep, 0.1 * rep) for run in "ab" for rep in range(10)]
    df = spark.createDataFrame(rows, "run string, bucket string, rep int, accuracy double").withColumn("accuracy", counted("accuracy"))
    C.run_ranking(df).collect()
    assert seen.value == 20
