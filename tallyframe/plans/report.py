"""The full-test report: ingest, contract checks, metric tables, CSV and provenance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import bootstrap as B
from tallyframe.operators import compare as C
from tallyframe.operators import diagnostics as D
from tallyframe.operators import joins as J
from tallyframe.operators import metrics as M
from tallyframe.operators import quality as Q
from tallyframe.session import cut_lineage
from tallyframe.sources import sinks

KEYS = ["dataset", "qid"]
PER_VIDEO = ("video",)  # tables that grow with the data
DIMS = ["dataset", "group_code", "capability_code", "answer_format", "generation", "ood", "clinical"]


def evaluation_table(annotations: DataFrame, results: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per question with everything the reports read, checked and kept.

    The three inputs must be unique on (dataset, id), cover the same ids, and
    agree on capability, format and video.
    """
    ann = annotations.select(
        "dataset",
        F.col("id").cast("string").alias("qid"),
        "video",
        "question",
        "answer",
        "answer_format",
        "generation",
        F.col("clinical_relevance").alias("clinical"),
        "ood",
        F.col("primary_capability").alias("capability_code"),
        F.substring("primary_capability", 1, 1).alias("group_code"),
        "secondary_capabilities",
        (text.stamp_seconds(F.col("timestamp_end")) - text.stamp_seconds(F.col("timestamp_start"))).alias("duration"),
    )
    res = results.select(
        "dataset",
        F.col("qID").alias("qid"),
        "evaluated_video",
        "evaluated_answer_format",
        F.col("evaluated_latency_sec").alias("latency_sec"),
        F.coalesce(F.col("timed_out") == 1, F.lit(False)).alias("timed_out"),
        F.col("correctness").alias("correct"),
    )
    pred = predictions.select(
        "dataset",
        F.col("sample_id").cast("string").alias("qid"),
        "raw_model_output",
        "prediction",
        "n_frames",
        "error",
    )
    for name, side in (("results", res), ("predictions", pred)):
        J.require_none(J.coverage_gaps(ann, side, KEYS), f"{name} do not cover the annotations")
    joined = cut_lineage(J.one_to_one(J.one_to_one(ann, res, KEYS), pred, KEYS))
    J.require_none(Q.unknown_capabilities(joined), "unknown capability")
    pairs = {"video": ("video", "evaluated_video"), "answer_format": ("answer_format", "evaluated_answer_format")}
    J.require_none(Q.failed(Q.column_pairs(joined, pairs)), "columns disagree")
    J.require_none(joined.where(F.col("correct").isNull()).select(*KEYS), "unparsed correctness")
    return joined.drop("evaluated_video", "evaluated_answer_format")


def report_tables(rows: DataFrame, first: str, second: str) -> Mapping[str, DataFrame]:
    """All report tables; the slices share one pre-aggregate."""
    cells = cut_lineage(M.video_cells(rows, DIMS))
    groups, leaves = M.by_group(cells), M.by_leaf(cells)
    levels = groups.withColumn("level", F.lit("group")).withColumnRenamed("group_code", "name").unionByName(
        leaves.withColumn("level", F.lit("leaf")).withColumnRenamed("capability_code", "name")
    )
    overall = M.overall(rows).join(
        B.bootstrap_interval(cells, ["dataset"]), "dataset", "left"
    ).join(M.bucket_macro(cells, ["dataset"], "ood").drop("buckets").withColumnRenamed("bucket_macro", "pre_evaluation_score"), "dataset")
    return {
        "dataset-overall": overall,
        "capability-group": groups,
        "capability-leaf": leaves,
        "capability-gap": C.capability_gap(levels, first, second),
        "answer-format": M.by_format(cells),
        "leaf-by-format": M.by_leaf_and_format(cells),
        "secondary-capability": M.by_secondary(rows),
        "gap-decomposition": C.gap_decomposition(groups, first, second),
        "slices": M.by_flag(cells),
        "video": M.by_video(cells),
        "runtime": M.latency_profile(rows),
        "time-diagnostics": D.time_diagnostics(rows),
        "numeric-diagnostics": D.numeric_diagnostics(rows),
        "set-cardinality": D.set_diagnostics(rows),
        "set-labels": D.label_diagnostics(rows),
        "categorical": D.categorical_diagnostics(rows),
        "cardinality-audit": D.cardinality_audit(rows),
        "bucket-cells": M.bucket_cells(cells),
    }


def write_reports(
    spark: SparkSession, rows: DataFrame, out: str, first: str, second: str, sources: list[str] | None = None
) -> None:
    """Every table as CSV, and the provenance of rows and source files."""
    for name, table in report_tables(rows, first, second).items():
        sinks.write_report(table, f"{out}/{name}", one_file=name not in PER_VIDEO)
    proof = sinks.provenance(rows).join(sinks.fingerprint(rows, ["dataset"]).drop("rows"), "dataset")
    sinks.write_json_lines(proof, f"{out}/provenance")
    if sources:
        sinks.write_json_lines(sinks.file_hashes(spark, sources), f"{out}/sources")
