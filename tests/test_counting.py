"""View combination, rule selection, recalibration and soft targets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import counting as K
from tallyframe.operators import learn

TILES = {"tile:top-left": 2, "tile:top-right": 1, "tile:bottom-left": 2, "tile:bottom-right": 0}
CASES = [
    ({"whole": 3, "hflip": 6, **TILES}, "whole", {3}),
    ({"whole": 3, **TILES}, "tiles", {5}),
    ({"whole": 3, "hflip": 4, "vflip": 4, "zoom": 2}, "vote", {4}),
    ({"whole": 2, "hflip": 4}, "vote", {2, 4}),
    ({"whole": 3, "hflip": 3, **TILES}, "max_whole_tiles", {5}),
    ({"whole": 4, "hflip": 4, **dict.fromkeys(TILES, 0)}, "max_whole_tiles", {4}),
    ({"whole": 1, "hflip": 1, **dict(zip(TILES, (1, 1, 0, 0)))}, "tiles_if_high", {1}),
    ({"whole": 3, "hflip": 3, **dict.fromkeys(TILES, 2)}, "tiles_if_high", {8}),
    ({"whole": 4, **dict(list(TILES.items())[:3])}, "tiles", {4}),
    ({}, "vote", {0}),
]


@pytest.fixture(scope="module")
def combined(spark):
    rows = [(i, v, str(n)) for i, (views, _, _) in enumerate(CASES) for v, n in (views or {"other": 1}).items()]
    df = spark.createDataFrame(rows, "i int, view_id string, value string")
    return {r["i"]: r for r in K.combine(K.pivot_views(df, ["i"])).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(combined, i):
    _, rule, want = CASES[i]
    assert combined[i][f"rule_{rule}"] in want


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        K.combine(spark.range(1), rules=["median"])


def test_class_sets(spark):
    rows = [("s", "whole", "Clip"), ("s", "zoom", "Clip, Sponge"), ("t", "whole", "None"), ("t", "zoom", "none")]
    df = spark.createDataFrame(rows, "sample_id string, view_id string, value string")
    got = {r["sample_id"]: (r["whole_n"], r["union_n"]) for r in K.class_set_counts(df, ["sample_id"]).collect()}
    assert got == {"s": (1, 2), "t": (0, 0)}


def test_folds_keep_videos_whole_and_even(spark):
    df = spark.range(1000).select(F.concat(F.lit("v"), (F.col("id") % 23).cast("string")).alias("video"))
    folds = K.video_folds(df, 5).collect()
    sizes = [sum(r["fold"] == f for r in folds) for f in range(5)]
    assert len(folds) == 23 and max(sizes) - min(sizes) <= 1


def test_recalibration_learns_a_shift(spark):
    df = spark.range(4000).select(
        F.concat(F.lit("v"), (F.col("id") % 40).cast("string")).alias("video"),
        F.lit(0).alias("template_id"),
        (F.col("id") % 6 + 1).cast("int").alias("pred"),
        (F.col("id") % 6 + 2).cast("int").alias("target"),
    )
    joint = K.joint_counts(df, K.video_folds(df, 5))
    got = K.calibration_gain(joint, 5).first()
    assert got["exact_clamped"] == 0.0 and got["exact_recalibrated"] == 1.0 and got["n"] == 4000
    assert K.shift_table(df).count() == 6


def test_soft_targets_sum_to_one(spark):
    df = spark.createDataFrame([(1, 1), (2, 5), (3, 16)], "qid int, target int")
    rows = learn.soft_target_rows(df, 1, 16, 0.1)
    sums = {r["qid"]: r["w"] for r in rows.groupBy("qid").agg(F.sum("weight").alias("w")).collect()}
    assert all(w == pytest.approx(1.0) for w in sums.values())
    edge = {r["label"]: r["weight"] for r in rows.where("qid = 1").collect()}
    assert edge == pytest.approx({0.0: 0.9, 1.0: 0.1})


def test_cross_fit_predicts_every_row_once(spark):
    df = spark.range(240).select(
        F.col("id").alias("qid"),
        F.concat(F.lit("v"), (F.col("id") % 12).cast("string")).alias("video"),
        (F.col("id") % 3 + 1).alias("target"),
        F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda c: F.when(c == F.col("id") % 3 + 1, 1.0).otherwise(0.0)).alias("X"),
    )
    out = learn.cross_fit(df, 1, 3, folds=3, eps=0.1)
    got = learn.report(out, "head").first()
    assert out.select("qid").distinct().count() == 240 and got["exact"] == 1.0


def test_trained_head_against_its_baseline(spark):
    """The head must beat a baseline that is right on a third of the rows by a clear margin."""
    df = spark.range(240).select(
        F.col("id").alias("qid"),
        F.concat(F.lit("v"), (F.col("id") % 12).cast("string")).alias("video"),
        (F.col("id") % 2).cast("int").alias("template_id"),
        (F.col("id") % 3 + 1).alias("target"),
        F.when(F.col("id") % 5 > 0, F.lit(2)).alias("baseline"),
        F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda c: F.when(c == F.col("id") % 3 + 1, 1.0).otherwise(0.0)).alias("X"),
    )
    got = {r["template_id"]: r for r in learn.against_baseline(learn.cross_fit(df, 1, 3, folds=3), df).collect()}
    assert set(got) == {0, 1, None} and got[None]["n"] == 240
    assert all(r["head"] > 0.95 and r["head_minus_baseline"] > 0.5 for r in got.values())
    folds = {(r["fold"], r["template_id"]): r for r in learn.fold_baselines(df, K.video_folds(df, 3)).collect()}
    assert len(folds) == 6 and sum(r["n"] for r in folds.values()) == 240 and sum(r["unreadable"] for r in folds.values()) == 48
    assert max(r["max_true"] for r in folds.values()) == 3
    assert sum(r["n"] * r["baseline_clamped"] for r in folds.values()) / 240 == pytest.approx(got[None]["baseline"])
