"""Frame sets as bits, clipping, missing files and copies against plain sets."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.numbers import zero_padded
from tallyframe.functions.text import seconds_stamp
from tallyframe.operators import frames as P
from tallyframe.operators.joins import first_available
from tallyframe.plans.catalog import QUERIES

ASKED = "qid int, dataset string, video string, start_s double, end_s double, fps int, stride int, max_frames int"


def brute(row):
    _, _, _, start, end, fps, stride, cap = row
    first, last = round(start * fps), round(end * fps)
    grid = list(range(first, max(first, last) + 1, stride))
    if len(grid) <= cap:
        return grid
    if cap == 1:
        return [grid[0]]
    return [grid[round(i * ((len(grid) - 1) / (cap - 1)))] for i in range(cap)]


@pytest.fixture(scope="module")
def asked():
    draw = random.Random(8)
    rows = []
    for q in range(120):
        start = draw.randint(0, 200) / 2
        end = start + draw.choice([0, -3, 1, 7.5, 40, 300])
        rows.append((q, draw.choice("ab"), f"v{q % 5}", start, end, draw.choice([25, 30]), draw.choice([1, 25, 64, 250]), draw.choice([1, 7, 64])))
    return [*rows, *[(q + 500, *r[1:]) for q, r in enumerate(rows[:20])]]


@pytest.fixture(scope="module")
def plan(asked):
    out = defaultdict(set)
    for r in asked:
        out[r[1], r[2]] |= set(brute(r))
    return out


def as_sets(df):
    out = defaultdict(set)
    for r in df.collect():
        assert r["frame"] not in out[r["dataset"], r["video"]]
        out[r["dataset"], r["video"]].add(r["frame"])
    return out


def files(spark, plan):
    rows = [(d, v, f, 0 if f % 5 == 0 else 9) for (d, v), fs in plan.items() for f in fs if f % 3] + [("a", "v1", -70, 4), ("a", "v1", 999_999, 4), ("z", "v9", 3, 1)]
    return spark.createDataFrame(rows, "dataset string, video string, frame long, size int"), {(d, v, f): s for d, v, f, s in rows}


def test_plan(spark, asked, plan):
    assert as_sets(P.build_plan(spark.createDataFrame(asked, ASKED))) == plan


def test_words_hold_negative_and_word_edges(spark):
    want = {("d", "v"): {-129, -128, -64, -1, 0, 63, 64, 127, 2**40}}
    df = spark.createDataFrame([("d", "v", f) for f in want["d", "v"]], "dataset string, video string, frame long")
    assert as_sets(P.listed_words(P.as_words(df, ["dataset", "video"], want=F.lit(True)), ["dataset", "video"], "want")) == want


@pytest.mark.parametrize("count", [0, 1, 63, 64, 65, 127, 128, 10_000])
def test_clip(spark, count):
    frames = [-3, 0, 5, 62, 63, 64, 65, 126, 127, 128, 9000]
    df = spark.createDataFrame([("d", "v", f) for f in frames], "dataset string, video string, frame long")
    words = P.as_words(df, ["dataset", "video"], want=F.lit(True))
    counts = spark.createDataFrame([("d", "v", count)], "dataset string, video string, frame_count long")
    clipped = P.clip_words(words, counts)
    inside = {f for f in frames if 0 <= f < count}
    assert as_sets(P.listed_words(clipped, ["dataset", "video"], "want")).get(("d", "v"), set()) == inside
    total = P.clip_summary(clipped).first()
    assert (total["kept"], total["clipped"]) == (len(inside), len(frames) - len(inside))
    assert P.clip_words(words, counts.where("1 = 0"), how="left").agg(F.sum(F.bit_count("clipped"))).first()[0] == 1  # below zero


def test_verify_and_coverage(spark, asked, plan):
    have, sizes = files(spark, plan)
    df = spark.createDataFrame(asked, ASKED)
    got = {(r["dataset"], r["video"]): tuple(r)[2:] for r in P.verify_plan(P.plan_words(df), have).collect()}
    want = {}
    for (d, v), fs in plan.items():
        own = {f: s for (x, y, f), s in sizes.items() if (x, y) == (d, v)}
        there = {f for f, s in own.items() if s}
        want[d, v] = (len(fs), len(fs - there), len(there - fs), len(own) - len(there))
    assert got == want
    for r in P.coverage(df, have).collect():
        mine = [q for q in asked if q[1] == r["dataset"]]
        assert r["questions"] == len(mine) and r["mean_frames_per_question"] == pytest.approx(sum(len(brute(q)) for q in mine) / len(mine))
        assert r["missing"] == sum(n[1] for (d, _), n in want.items() if d == r["dataset"])
    gone = sorted((d, v, f) for (d, v), fs in plan.items() for f in fs if not sizes.get((d, v, f)))
    assert [tuple(r) for r in P.missing_examples(df, have).collect()] == gone[:10]


def test_frames_of_a_question_are_clipped_and_there(spark, asked, plan):
    have, sizes = files(spark, plan)
    counts = {("a", "v1"): 900, ("b", "v2"): 40}
    df = spark.createDataFrame(asked, ASKED)
    known = spark.createDataFrame([(*k, n) for k, n in counts.items()], "dataset string, video string, frame_count long")
    got = defaultdict(list)
    for r in P.sampled_frames(df, known, have).orderBy("qid", "position").collect():
        got[r["qid"]].append(r["frame"])
    for q in asked:
        limit = counts.get((q[1], q[2]), 10**9)
        assert got[q[0]] == [f for f in brute(q) if 0 <= f < limit and (q[1], q[2], f) in sizes], q
    assert P.sampled_frames(df).count() == sum(len(brute(q)) for q in asked)


def test_copies_share_no_frame(spark):
    rows = [(q, c, 0.5 * q, 0.5 * q + 40, fps) for q in range(3) for c in range(1, 26) for fps in (25, 30)]
    df = spark.createDataFrame(rows, "qid int, copy_no int, start_s double, end_s double, fps int")
    frames = P.phased_frames(df, 96).groupBy("qid", "fps", "frame").agg(F.count("*").alias("n"))
    assert frames.agg(F.max("n")).first()[0] == 1
    offsets = [r[0] for r in spark.range(30).select(P.copy_offset(F.col("id") + 1, F.lit(30))).collect()]
    assert offsets[0] == 0 and sorted(offsets) == list(range(30))
    short = P.phased_frames(spark.createDataFrame([(1, 2, 3.0, 3.0, 25)], "qid int, copy_no int, start_s double, end_s double, fps int"), 96).collect()
    assert [r["frame"] for r in short] == [75]


def test_grids_by_words_equal_grids_by_rows(spark):
    keys = ["dataset", "video", "frame"]
    plan = spark.createDataFrame([("d", f"v{f % 3}", f * 25) for f in range(400)], "dataset string, video string, frame long")
    files = plan.where("frame % 4 > 0").withColumn("grid", F.lit("a")).union(plan.where("frame % 3 > 0").withColumn("grid", F.lit("b")))
    words = P.grid_words(P.as_words(plan, keys[:2], want=F.lit(True)), files, ["a", "b"])
    got = P.grid_frames(words, ["a", "b"]).select(*keys, "source")
    by_row = [files.where(F.col("grid") == g).withColumn("path", F.lit(g)) for g in ("a", "b")]
    want = first_available(plan, *by_row, keys, "path").select(*keys, F.coalesce("path", F.lit("none")).alias("source"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_grid_fallback_joins_words(spark, sf):
    plan = QUERIES["grid_fallback"].build(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert joins and all("frame#" not in line for line in joins)


def test_numbers_are_padded_without_formats(spark, sf):
    values = [0, 7, 42, 1234567, 123456789, -1, -42, -123456789, None]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    got = [r[0] for r in df.select(zero_padded(F.col("n"), 7)).collect()]
    assert got == [None if v is None else f"{v:07d}" for v in values]
    plan = QUERIES["frame_details"].build(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan


def test_strips_find_the_files_of_any_window(spark):
    draw = random.Random(11)
    rows = []
    for q in range(160):
        start = draw.choice([-500.0, 0.0, draw.randint(0, 4000) / 2, 383.5])
        end = start + draw.choice([0, 3, 400, 2_000, 90_000])
        rows.append((q, draw.choice("ab"), f"v{q % 4}", start, end, draw.choice([25, 30]), draw.choice([25, 30, 250, 300, 7, 64]), draw.choice([1, 2, 9, 64, 96])))
    wanted = {(q[1], q[2], f) for q in rows for f in brute(q)}
    there = {k for k in wanted if k[2] % 7 > 2} | {(d, v, f + 5) for d, v, f in wanted}
    have = spark.createDataFrame([*there, *list(there)[:50]], "dataset string, video string, frame long")
    got = defaultdict(list)
    for r in P.sampled_frames(spark.createDataFrame(rows, ASKED), inventory=have).orderBy("qid", "position").collect():
        got[r["qid"]].append((r["position"], r["frame"]))
    for q in rows:
        assert got[q[0]] == [(p, f) for p, f in enumerate(brute(q)) if (q[1], q[2], f) in there], q


def test_a_window_has_a_row_per_strip_or_frame(spark):
    rows = [(0, "a", "v", 0.0, 380.0, 25, 25, 64), (1, "a", "v", 0.0, 1e8, 25, 25, 64), (2, "a", "v", 1.0, 1e8, 30, 7, 3), (3, "a", "v", 0.0, 767.0, 25, 250, 96)]
    strips = P.window_strips(P.sized_windows(spark.createDataFrame(rows, ASKED))).groupBy("qid").count()
    assert dict(strips.collect()) == {0: 1, 1: 64, 2: 3, 3: 2}


def test_generated_methods_of_frame_details_are_compiled(spark, sf):
    """The JVM interprets methods of more than 8,000 bytes for good."""
    df = QUERIES["frame_details"].build(spark, sf)
    assert df.collect()
    debug = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.debug.package$").getField("MODULE$").get(None)
    parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    assert sizes and max(sizes) < 8000


def test_stamps_and_padded_numbers_of_any_size(spark):
    seconds = [0, 59, 60, 3599, 3600, 359_999, 360_000, 3_600_000, -1, -3600, -36_000, -360_001]
    df = spark.createDataFrame([(float(s),) for s in seconds], "s double")
    want = [f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}" for s in seconds]
    assert [r[0] for r in df.select(seconds_stamp(F.col("s"))).collect()] == want
    numbers = [-(10**6), -(10**6) + 1, 10**7 - 1, 10**7, -9, -10, 9, 99, 100, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for digits in (1, 2, 7):
        assert [r[0] for r in df.select(zero_padded(F.col("n"), digits)).collect()] == [f"{n:0{digits}d}" for n in numbers], digits
