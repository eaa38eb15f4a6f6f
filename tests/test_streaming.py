"""Incremental ingest: restarts, repeated ids, late rows, conflicts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyframe.sources import folders
from tallyframe.streaming import ingest, revisions


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def record(i, minute, text="3 clips", error=""):
    return {
        "dataset": "heico", "sample_id": str(i), "answer_format": "number", "question": "How many?",
        "raw_model_output": text, "latency_sec": 1.0, "error": error, "arrived": f"2026-01-01T00:{minute:02d}:00Z",
    }


def drain(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def test_ingest_survives_restart_and_keeps_the_last(spark, tmp_path):
    src, store, mark = tmp_path / "in", ingest.prediction_store(str(tmp_path / "store")), str(tmp_path / "mark")
    write(src, "a.jsonl", [record(1, 1), record(2, 2, "none at all"), '{"sample_id": "9", "raw'])
    drain(store.feed(ingest.prediction_stream(spark, str(src)), mark))
    write(src, "b.jsonl", [record(2, 9, "5"), record(3, 10, "", "boom"), record(1, 0, "too old to count")])
    drain(store.feed(ingest.prediction_stream(spark, str(src)), mark))
    rows = {r["sample_id"]: r["raw_model_output"] for r in store.read(spark).collect()}
    assert rows == {"1": "3 clips", "2": "5", "3": ""}
    total = ingest.live_totals(store.read(spark)).first()
    assert (total["rows"], total["errors"]) == (3, 1) and abs(total["parse_rate"] - 2 / 3) < 1e-9


def test_running_totals_update(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "a.jsonl", [record(1, 1), record(2, 2)])
    totals = ingest.live_totals(ingest.prediction_stream(spark, str(src)))
    q = totals.writeStream.format("memory").queryName("totals").outputMode("complete").start()
    try:
        q.processAllAvailable()
        write(src, "b.jsonl", [record(3, 3, "no number")])
        q.processAllAvailable()
        row = spark.table("totals").first()
        assert row["rows"] == 3 and abs(row["parse_rate"] - 2 / 3) < 1e-9
    finally:
        q.stop()


def event(case, revision, status, minute):
    return {"timestamp": f"2026-01-01T00:{minute:02d}:00Z", "case_id": case, "revision": revision, "previous_status": "", "status": status, "box_count": revision, "client": "c"}


def test_revision_log(spark, tmp_path):
    src = tmp_path / "log"
    write(src, "a.jsonl", [event("x", 1, "in_progress", 1), event("x", 2, "complete", 2), event("y", 1, "in_progress", 3), event("y", 1, "skipped", 4), event("z", 2, "complete", 5)])
    q = revisions.latest_state(revisions.revision_stream(spark, str(src))).writeStream.format("memory").queryName("states").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = {r["case_id"]: (r["revision"], r["status"]) for r in spark.table("states").collect()}
    finally:
        q.stop()
    assert got == {"x": (2, "complete"), "y": (1, "skipped"), "z": (2, "complete")}
    log = spark.read.schema(revisions.schemas.REVISIONS).json(str(src))
    bad = {r["case_id"]: (r["repeated"], r["gaps"]) for r in revisions.revision_conflicts(log).collect()}
    assert bad == {"y": (1, 0), "z": (0, 1)}
    assert {r["status"]: r["cases"] for r in revisions.progress_counts(revisions.latest_state(log)).collect()} == {"complete": 2, "skipped": 1}
    assert revisions.compact(log).count() == 3


def test_a_repeat_is_found_a_week_later(spark, tmp_path):
    src, mark, alerts = tmp_path / "log", str(tmp_path / "mark"), str(tmp_path / "alerts")
    store = revisions.revision_store(str(tmp_path / "store"), compact_every=2)

    def feed():
        drain(revisions.guarded_feed(store, revisions.revision_stream(spark, str(src), files_per_trigger=1), alerts, mark))

    write(src, "a.jsonl", [event("y", 1, "a", 3), event("x", 1, "a", 4), event("x", 2, "b", 5)])
    feed()
    for k in range(4):  # other batches, so that the first one is only in a base by now
        write(src, f"b{k}.jsonl", [event("z", k + 1, "a", 10 + k)])
        feed()
    late = event("y", 1, "c", 3) | {"timestamp": "2026-01-08T00:00:00Z"}
    write(src, "c.jsonl", [late, event("z", 5, "a", 2)])
    feed()
    told = [(r["case_id"], r["revision"], r["new"], r["held"]) for r in spark.read.parquet(f"{alerts}/batch=*").collect()]
    assert told == [("y", 1, 1, 1)]
    rows = {(r["case_id"], r["revision"]): (r["writes"], r["status"]) for r in store.read(spark).collect()}
    assert rows["y", 1] == (2, "c") and len(rows) == 8
    assert {r["case_id"]: r["status"] for r in revisions.state_of(store.read(spark)).collect()} == {"x": "b", "y": "c", "z": "a"}
    assert [(r["case_id"], r["repeated"], r["gaps"]) for r in revisions.conflicts_of(store.read(spark)).collect()] == [("y", 1, 0)]
    assert len(folders.names(spark, f"{store.path}/base")) <= 2 and len(folders.names(spark, f"{store.path}/delta")) <= 4


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    store = revisions.revision_store(str(tmp_path / "store"), compact_every=2)
    rows = lambda *events: spark.createDataFrame([(e["case_id"], e["revision"], e["status"], 0) for e in events], "case_id string, revision long, status string, box_count int").withColumn("timestamp", F.lit("2026-01-01").cast("timestamp"))
    assert store.read(spark).collect() == []
    store.add(rows(event("x", 1, "a", 1)), 0)
    for _ in range(3):  # number 1 also compacts
        store.add(rows(event("x", 1, "b", 1), event("x", 2, "b", 1)), 1)
    assert {(r["revision"], r["writes"]) for r in store.read(spark).collect()} == {(1, 2), (2, 1)}
    assert {(r["revision"], r["writes"]) for r in store.read(spark, before=1).collect()} == {(1, 1)}


def test_pending_requests(spark):
    asked = spark.createDataFrame([("d", "1"), ("d", "2"), ("e", "1")], "dataset string, sample_id string")
    done = spark.createDataFrame([("d", "1")], "dataset string, sample_id string")
    assert {tuple(r) for r in ingest.pending(asked, done).collect()} == {("d", "2"), ("e", "1")}


def test_totals_also_run_on_tables(spark):
    df = spark.createDataFrame([("d", "number", "how", "4", 2.0, None)], "dataset string, answer_format string, question string, raw_model_output string, latency_sec double, error string")
    row = ingest.live_totals(df.withColumn("sample_id", F.lit("1"))).first()
    assert (row["rows"], row["errors"], row["parse_rate"]) == (1, 0, 1.0)
