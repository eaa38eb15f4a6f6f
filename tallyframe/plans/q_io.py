"""Queries: sinks read back, provenance and the two incremental flows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import metrics as M
from tallyframe.plans.q_metrics import _point
from tallyframe.plans.registry import query
from tallyframe.plans.views import table, view
from tallyframe.session import shared_folder
from tallyframe.sources import readers, sinks
from tallyframe.streaming import ingest, revisions


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "results_csv_round_trip",
    """SELECT CAST(qid AS VARCHAR) AS qID, video AS evaluated_video, CAST(ood AS INT) AS evaluated_ood, capability_code AS evaluated_primary,
              latency_sec AS evaluated_latency_sec, correct AS correctness FROM eval_rows""",
    ["eval_rows"], ("evaluated_latency_sec",), "A-04 A-10 H-23",
)
def results_csv_round_trip(spark, sf):
    rows = view(spark, sf, "eval_rows").select(
        F.col("qid").cast("string").alias("qID"), "video", F.initcap(F.col("ood").cast("string")).alias("ood"),
        F.col("clinical").cast("string").alias("clinical"), F.col("capability_code").alias("primary"), "answer_format",
        F.col("latency_sec").alias("latency"), F.col("timed_out").cast("string").alias("timed_out"),
        F.when(F.col("correct") == 1, "True").otherwise("0").alias("correctness"),
    )
    path = scratch(spark, "results")
    sinks.report_text(rows).write.option("header", True).csv(path)
    return readers.results(spark, path).select(
        "qID", "evaluated_video", "evaluated_ood", "evaluated_primary", "evaluated_latency_sec", "correctness"
    )


@query(
    "report_text",
    "SELECT dataset, capability_code, CAST(rows AS VARCHAR) AS rows, printf('%.9f', round(micro_accuracy, 12)) AS micro_accuracy FROM ("
    + _point("eval_big", "dataset, capability_code") + ")",
    ["eval_big"], covers="A-10",
)
def report_text(spark, sf):
    table_ = M.point_metrics(view(spark, sf, "eval_big"), ["dataset", "capability_code"])
    return sinks.report_text(table_).select("dataset", "capability_code", "rows", "micro_accuracy")


@query(
    "answers_as_json_lines",
    """SELECT '{"qID":"' || qid || '","content":' || CASE WHEN k % 4 = 0 THEN 'null' ELSE '"' || prediction || '"' END || ',"n":' || k || '}' AS line FROM answer_rows""",
    ["answer_rows"], covers="A-11",
)
def answers_as_json_lines(spark, sf):
    rows = view(spark, sf, "answer_rows").select(
        F.col("qid").cast("string").alias("qID"),
        F.when(F.col("k") % 4 > 0, F.col("prediction")).alias("content"),
        F.col("k").alias("n"),
    )
    return sinks.as_json_lines(rows)


@query(
    "table_fingerprint",
    """WITH r AS (SELECT c_mktsegment, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS h FROM customer),
            w AS (SELECT c_mktsegment, ('0x' || substr(h, 1, 15))::BIGINT AS x FROM r)
       SELECT c_mktsegment, count(*) AS rows, bit_xor(x) AS content_xor, CAST(sum(x) AS VARCHAR) AS content_sum FROM w GROUP BY 1""",
    covers="A-13",
)
def table_fingerprint(spark, sf):
    return sinks.fingerprint(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_mktsegment"])


@query(
    "source_provenance",
    """SELECT dataset, CAST(sum(n) AS BIGINT) AS rows, count(*) AS videos, CAST(sum(k) AS BIGINT) AS correct FROM (
         SELECT dataset, video, count(*) AS n, sum(correct) AS k FROM eval_big GROUP BY 1, 2) GROUP BY 1""",
    ["eval_big"], covers="A-13",
)
def source_provenance(spark, sf):
    return sinks.provenance(view(spark, sf, "eval_big"))


@query(
    "epoch_metrics_appended",
    "SELECT epoch, dataset, max(accuracy) AS accuracy, CAST(epoch * 100 AS BIGINT) AS global_step FROM epoch_scores GROUP BY 1, 2",
    ["epoch_scores"], ("accuracy",), "A-14",
)
def epoch_metrics_appended(spark, sf):
    rows = view(spark, sf, "epoch_scores").groupBy("epoch", "dataset").agg(F.max("accuracy").alias("accuracy"))
    path = scratch(spark, "epochs")
    sinks.append_epoch(rows.withColumn("global_step", (F.col("epoch") * 100).cast("bigint")), path)
    return sinks.read_epochs(spark, path).select("epoch", "dataset", "accuracy", "global_step")


@query(
    "rows_in_input_order",
    "SELECT o_orderkey, o_totalprice FROM orders", floats=("o_totalprice",), covers="A-01 A-03 A-09",
)
def rows_in_input_order(spark, sf):
    path = scratch(spark, "ordered")
    sinks.write_rows(table(spark, sf, "orders"), path, "o_orderkey", ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice")


@query(
    "resume_log_last_wins",
    """SELECT CAST(user_id AS VARCHAR) AS sample_id, arg_max(k, qid) AS k FROM eval_rows WHERE k % 10 > 0 GROUP BY 1""",
    ["eval_rows"], covers="A-06 E-08",
)
def resume_log_last_wins(spark, sf):
    rows = view(spark, sf, "eval_rows").select("qid", "user_id", "k")
    whole = F.to_json(F.struct(F.col("user_id").cast("string").alias("sample_id"), "k"))
    line = F.when(F.col("k") % 20 == 0, "").when(F.col("k") % 10 == 0, F.substring(whole, 1, 12)).otherwise(whole)
    path = scratch(spark, "log")
    rows.repartitionByRange("qid").sortWithinPartitions("qid").select(line.alias("value")).write.text(path)
    return readers.resume_log(spark, path, "sample_id string, k int", by_name=True)


@query(
    "first_record_per_user",
    "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1", covers="E-09",
)
def first_record_per_user(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return readers.first_per_key(df, ["user_id"], ["event_id"])


# -- incremental flows --------------------------------------------------------------------


def landed(rows: DataFrame, path: str, files: int, by: str) -> None:
    """More files for a stream, rows dealt to them by hash, so that event time jumps back and forth."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    writer = rows.repartition(files, by).write.mode("append").option("ignoreNullFields", False)
    writer.option("timestampFormat", f"{micros}XXX").option("timestampNTZFormat", micros).json(path)


def drained(writer) -> None:
    """Run a stream over everything there is, then stop."""
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()


def prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's answers as a log; arrival follows the question id, which rises with time."""
    rows = view(spark, sf, "answer_rows").select(
        "dataset", F.regexp_replace("video", "^v", "").alias("sample_id"), "answer_format", "question", "raw_model_output", "latency_sec", "error",
        F.timestamp_seconds(F.col("qid")).alias("arrived"),
    )
    return rows


def fed_predictions(spark: SparkSession, sf: str, log: DataFrame):
    """A store fed in two runs of several triggers each, one file a trigger, compacted on the way."""
    source, mark = scratch(spark, "log"), scratch(spark, "mark")
    store = ingest.prediction_store(scratch(spark, "predictions"), compact_every=2)
    half = F.pmod(F.xxhash64("sample_id", "arrived"), F.lit(2)) == 0
    for part in (half, ~half):  # the second run starts from the first one's checkpoint
        landed(log.where(part), source, 2, "arrived")
        drained(store.feed(ingest.prediction_stream(spark, source, files_per_trigger=1), mark))
    return store


@query(
    "incremental_predictions",
    """WITH l AS (SELECT dataset, user_id, arg_max(answer_format, qid) AS answer_format, arg_max(prediction, qid) AS prediction, arg_max(error, qid) AS error, arg_max(latency_sec, qid) AS latency
                  FROM answer_rows JOIN (SELECT event_id AS qid, user_id FROM events) USING (qid) GROUP BY 1, 2)
       SELECT dataset, answer_format, count(*) AS rows, count(*) FILTER (error <> '') AS errors, avg(latency) AS mean_latency_sec,
              avg(CAST(CASE answer_format WHEN 'binary' THEN prediction IN ('yes', 'no') WHEN 'number' THEN prediction <> 'cannot tell' WHEN 'percentage' THEN prediction <> 'half of it'
                WHEN 'time' THEN prediction <> 'later' WHEN 'fo_class' THEN prediction <> 'a grasper' ELSE TRUE END AS INT)) AS parse_rate FROM l GROUP BY 1, 2""",
    ["answer_rows"], ("mean_latency_sec", "parse_rate"), "S-01",
)
def incremental_predictions(spark, sf):
    store = fed_predictions(spark, sf, prediction_log(spark, sf))
    return ingest.live_totals(store.read(spark))


@query(
    "pending_requests",
    """SELECT dataset, answer_format, count(*) AS n FROM eval_rows WHERE (dataset, user_id) NOT IN (SELECT (dataset, user_id) FROM eval_rows WHERE k % 40 = 3) GROUP BY 1, 2""",
    ["eval_rows"], covers="S-01",
)
def pending_requests(spark, sf):
    rows = view(spark, sf, "eval_rows").withColumn("sample_id", F.col("user_id").cast("string"))
    done = prediction_log(spark, sf).join(rows.where("k % 40 = 3").select("dataset", "sample_id").distinct(), ["dataset", "sample_id"], "left_semi")
    store = fed_predictions(spark, sf, done.select(*prediction_log(spark, sf).columns))
    return ingest.pending(rows, store.read(spark)).groupBy("dataset", "answer_format").agg(F.count(F.lit(1)).alias("n"))


def fed_revisions(spark: SparkSession, sf: str):
    """The revision log through a guarded store in two runs; repeats may lie any time apart."""
    source, mark, alerts = scratch(spark, "log"), scratch(spark, "mark"), scratch(spark, "alerts")
    store = revisions.revision_store(scratch(spark, "revisions"), compact_every=2)
    log = view(spark, sf, "revision_log")
    half = F.pmod(F.xxhash64("case_id", "timestamp"), F.lit(2)) == 0
    for part in (half, ~half):
        landed(log.where(part), source, 2, "timestamp")
        drained(revisions.guarded_feed(store, revisions.revision_stream(spark, source, files_per_trigger=1), alerts, mark))
    return store, alerts


@query(
    "revision_states",
    """SELECT case_id, max(revision) AS revision, arg_max(status, (revision, timestamp)) AS status, arg_max(box_count, (revision, timestamp)) AS box_count,
              CAST(max(timestamp) AS VARCHAR) AS updated_at FROM revision_log GROUP BY 1""",
    ["revision_log"], covers="S-02",
)
def revision_states(spark, sf):
    store, _ = fed_revisions(spark, sf)
    return revisions.state_of(store.read(spark)).withColumn("updated_at", F.col("updated_at").cast("string"))


@query(
    "streamed_conflicts",
    """SELECT case_id, revision, CAST(count(*) AS BIGINT) AS writes, TRUE AS alerted FROM revision_log GROUP BY 1, 2 HAVING count(*) > 1""",
    ["revision_log"], covers="S-02",
)
def streamed_conflicts(spark, sf):
    """Repeated revisions of the whole log, each of which some batch must have reported."""
    store, alerts = fed_revisions(spark, sf)
    told = spark.read.parquet(f"{alerts}/batch=*").select("case_id", "revision").distinct().withColumn("alerted", F.lit(True))
    repeated = store.read(spark).where("writes > 1").select("case_id", "revision", "writes")
    return repeated.join(told, ["case_id", "revision"], "full").fillna(False, ["alerted"])


@query(
    "revision_conflicts",
    """WITH p AS (SELECT case_id, revision, count(*) AS n FROM revision_log GROUP BY 1, 2),
            c AS (SELECT case_id, CAST(sum(n) AS BIGINT) AS writes, count(*) AS revisions, max(revision) AS last_revision, CAST(sum(n - 1) AS BIGINT) AS repeated FROM p GROUP BY 1)
       SELECT *, last_revision - revisions AS gaps FROM c WHERE repeated > 0 OR last_revision <> revisions""",
    ["revision_log"], covers="S-02",
)
def revision_conflicts(spark, sf):
    return revisions.revision_conflicts(view(spark, sf, "revision_log"))


@query(
    "revision_progress",
    "SELECT status, count(*) AS cases FROM (SELECT case_id, arg_max(status, (revision, timestamp)) AS status FROM revision_log GROUP BY 1) GROUP BY 1",
    ["revision_log"], covers="S-02 D-27",
)
def revision_progress(spark, sf):
    return revisions.progress_counts(revisions.latest_state(view(spark, sf, "revision_log")))
