"""Join contracts, replace-by-id, box checks and pool selection."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.plans.catalog import QUERIES
from tallyframe.operators import boxes as B
from tallyframe.operators import joins as J
from tallyframe.operators import pool as P
from tallyframe.operators import quality as Q
from tallyframe.operators import trainset as T


def test_replace_by_id(spark):
    base = spark.createDataFrame(
        [("a", "m", "p", "1", "1", 0.5, 0), ("b", "m", "p", "2", "2", 0.5, 1)],
        "sample_id string, model_name string, prompt string, raw_model_output string, prediction string, latency_sec double, ordinal int",
    )
    new = spark.createDataFrame([("b", "0", "bbox-json")], "sample_id string, prediction string, prompt_strategy string")
    got = {r["sample_id"]: r for r in J.replace_by_id(base, new, ["sample_id"], "hybrid").collect()}
    assert (got["a"]["changed_by_prompt"], got["b"]["changed_by_prompt"]) == (False, True)
    assert (got["b"]["prediction"], got["b"]["baseline_prediction"]) == ("0", "2")
    assert {r["model_name"] for r in got.values()} == {"hybrid"}
    assert (got["a"]["prompt_strategy"], got["b"]["prompt_strategy"]) == ("direct", "bbox-json")
    assert [got["a"]["ordinal"], got["b"]["ordinal"]] == [0, 1]


def test_contracts_fail_loudly(spark):
    twice = spark.createDataFrame([("d", 1), ("d", 1)], "dataset string, qid int")
    once = spark.createDataFrame([("d", 1), ("d", 2)], "dataset string, qid int")
    with pytest.raises(Exception, match="duplicate"):
        J.one_to_one(twice, once, ["dataset", "qid"]).collect()
    with pytest.raises(Exception, match="without a match"):
        J.covered(once, twice, ["dataset", "qid"]).collect()
    assert not J.same_ids(once, twice, ["dataset", "qid"]) and J.same_ids(once, once, ["dataset", "qid"])


def test_missing_replacement_columns(spark):
    with pytest.raises(ValueError, match="prompt_strategy"):
        Q.replacement_violations(spark.createDataFrame([("a", "q")], "sample_id string, question string"))


CASE = [("c", 960, 540, 1, 1, "heico")]
QUESTIONS = [
    ("c", 1, "total_instance_count", None, 2, "2", None),
    ("c", 2, "class_count", "Clip", 2, "2", None),
    ("c", 3, "class_inventory", None, None, "Clip", ["Clip"]),
]
TWO = [("c", 1, "b1", "Clip", 10.0, 20.0, 30.0, 40.0, False, False), ("c", 2, "b2", "clips", 100.0, 120.0, 25.0, 35.0, False, False)]


def build(spark, boxes=TWO, status="complete", unchecked=False, notes="", empty=False):
    checks = {k: not (unchecked and k == "qa_compared") for k in B.CHECKS}
    cases = spark.createDataFrame(CASE, "case_id string, image_width int, image_height int, rank int, batch int, dataset string")
    questions = spark.createDataFrame(
        QUESTIONS, "case_id string, qid int, kind string, target_class string, numeric_answer long, answer string, answer_classes array<string>"
    )
    raw = spark.createDataFrame(
        boxes, "case_id string, box_no int, box_id string, class_name string, x double, y double, width double, height double, difficult boolean, uncertain boolean"
    )
    note = spark.createDataFrame(
        [("c", status, empty, checks, notes, 3, "2026-01-01")],
        "case_id string, status string, no_foreign_objects boolean, checks map<string,boolean>, notes string, revision int, updated_at string",
    )
    return cases, questions, raw, note


def gate(spark, **kw):
    cases, questions, raw, note = build(spark, **kw)
    return B.completion_gate(note, questions, raw, cases).first()


def test_complete_case_passes(spark):
    got = gate(spark)
    assert (got["can_complete"], got["blocked"], got["box_count"]) == (1, 0, 2)


def test_removed_box_blocks_completion_only(spark):
    assert gate(spark, boxes=TWO[:1])["blocked"] == 1
    assert gate(spark, boxes=TWO[:1], status="needs_review")["blocked"] == 0


def test_open_check_and_uncertain_box_block(spark):
    assert gate(spark, unchecked=True)["blocked"] == 1
    unsure = [TWO[0], (*TWO[1][:-1], True)]
    assert gate(spark, boxes=unsure)["blocked"] == 1


@pytest.mark.parametrize(
    "change,rule",
    [
        ({4: 950.0}, "outside_image"),
        ({2: "a b"}, "invalid_id"),
        ({3: "Grasper"}, "unknown_class"),
        ({6: 1.0}, "too_small_or_negative"),
        ({5: float("nan")}, "not_finite"),
        ({2: "b2"}, "duplicate_id"),
    ],
)
def test_box_rules(spark, change, rule):
    row = list(TWO[0])
    for i, v in change.items():
        row[i] = v
    cases, _, raw, _ = build(spark, boxes=[tuple(row), TWO[1]])
    assert rule in {r["rule"] for r in B.box_violations(raw, cases).collect()}


def test_edge_tolerance(spark):
    near = [(*TWO[0][:4], 930.0, 20.0, 30.005, 40.0, False, False)]
    cases, _, raw, _ = build(spark, boxes=near)
    assert B.box_violations(raw, cases).count() == 0
    assert B.normalised_boxes(raw, cases).first()["width"] == 30.0


def test_skipped_needs_a_note(spark):
    _, _, raw, note = build(spark, status="skipped")
    assert {r["rule"] for r in B.annotation_violations(note, raw).collect()} == {"skipped_without_note"}


def test_pool_invariants(spark):
    cases = spark.range(900).select(
        F.concat(F.lit("case"), F.col("id").cast("string")).alias("case_id"),
        F.when(F.col("id") % 2 == 0, "heico").otherwise("lapchole").alias("dataset"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 20).cast("string"))).alias("video"),
        (F.col("id") % 37).alias("score"),
    )
    pool = P.select_pool(cases, 200).orderBy("rank").collect()
    assert [r["rank"] for r in pool] == list(range(1, 401))
    assert sum(r["dataset"] == "heico" for r in pool) == 200 and len({r["case_id"] for r in pool}) == 400
    assert all(a["score"] >= b["score"] for a, b in zip(pool, pool[1:]))
    assert [r["batch"] for r in pool] == [1 + i // 100 for i in range(400)]
    assert P.short_datasets(cases, 451).count() == 2


def test_rebalanced_totals(spark):
    df = spark.range(2000).select(
        F.col("id").alias("qid"), F.lit("segment").alias("track"),
        F.when(F.col("id") % 100 == 0, "4").when(F.col("id") % 3 == 0, "2").otherwise("1").alias("group_code"),
    )
    out = T.rebalanced(df, {"segment": 900}, 3, ["qid"])
    train = out.where("part = 'train'")
    assert abs(train.count() - 900) <= 3
    held = out.where("part = 'holdout'").select("qid")
    assert held.count() == 9 and train.join(held, "qid").count() == 0
    assert train.groupBy("qid", "copy_no").count().where("count > 1").count() == 0


def test_breaches_of_one_id_all_count(spark):
    """Each box of a repeated id keeps its own breaches, and the id is reported once."""
    boxes = [(1, "a b", "Clip", 1.0), (2, "a b", "Grasper", 1.0), (3, "c", "clips", 1e6)]
    raw = spark.createDataFrame([("c", n, i, k, x, 1.0, 5.0, 5.0) for n, i, k, x in boxes], "case_id string, box_no int, box_id string, class_name string, x double, y double, width double, height double")
    cases = spark.createDataFrame([("c", 100, 100)], "case_id string, image_width int, image_height int")
    got = sorted((r["box_id"], r["rule"]) for r in B.box_violations(raw, cases).collect())
    assert got == [("a b", "duplicate_id"), ("a b", "invalid_id"), ("a b", "invalid_id"), ("a b", "unknown_class"), ("c", "outside_image")]


def test_boxes_meet_their_cases_once(spark, sf):
    """One join for all rules, and an export that starts from its written images."""
    from tallyframe.plans import q_pool
    from tallyframe.plans.views import view

    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(B.box_violations(view(spark, sf, "box_rows"), view(spark, sf, "box_cases"))) == 1
    assert joins(q_pool.export_manifest(spark, sf)) <= 1


def test_large_tables_are_dealt_to_more_tasks(spark):
    from tallyframe.operators.scale import ROWS_A_TASK, dealt

    few, many = (dealt(["id"], n, spark.range(10))[0] for n in (10, 50 * ROWS_A_TASK))
    assert few.rdd.getNumPartitions() < 50 and many.rdd.getNumPartitions() == 50


def test_mismatches_read_class_answers_before_the_join(spark, sf):
    """Behind the join a filter and a projection would each read them again."""
    plan = QUERIES["answer_mismatches"].build(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join " in line)
    assert not any("split(" in line for line in plan[:join])
