"""Readers, sinks and the report over small files in the shape of real runs."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import frames as P
from tallyframe.operators import joins as J
from tallyframe.operators import quality as Q
from tallyframe.operators import runs as R
from tallyframe.plans import report
from tallyframe.sources import files, readers, sinks


def annotation(i, dataset):
    fmt = ["number", "time", "fo_class", "binary", "multiple_choice", "percentage"][i % 6]
    answer = {"number": "2", "time": "00:00:10", "fo_class": "Clip", "binary": "yes", "multiple_choice": "top", "percentage": "50"}[fmt]
    return (
        str(i), f"{dataset}-v{i % 4}.mp4", "Resection", "Select one answer: top; bottom", answer, fmt, "segment",
        "manual" if i % 2 else "automatic", i % 3 == 0, i % 5 == 0, "00:00:05", "00:01:05", ["1a", "2a", "3b", "4c"][i % 4], ["2b"],
    )


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Annotations of two datasets plus one scored run."""
    from tallyframe import schemas

    base = tmp_path_factory.mktemp("data")
    for dataset in ("heico", "lapchole"):
        rows = [annotation(i, dataset) for i in range(48)]
        spark.createDataFrame(rows, schemas.ANNOTATIONS).write.parquet(
            readers.annotation_path(str(base), dataset, "segment", "test")
        )
        run = base / "run" / dataset
        run.mkdir(parents=True)
        lines = ["qID,video,ood,clinical,primary,answer_format,latency,timed_out,correctness"]
        lines += [f"{r[0]},{r[1]},{r[9]},{r[8]},{r[12]},{r[5]},{int(r[0]) / 10},False,{'True' if int(r[0]) % 3 else '0'}" for r in rows]
        (run / "results.csv").write_text("\n".join(lines) + "\n")
        pred = [
            (r[0], "m", r[3], r[4], r[5], r[12], "2b|4c", r[8], r[9], r[1], r[10], r[11], "", "a|b", "00:00:01|00:00:02", 2, "p", r[4], r[4], r[4], int(r[0]) / 10, "")
            for r in rows
        ]
        spark.createDataFrame(pred, schemas.PREDICTIONS).write.parquet(str(run / "predictions.parquet"))
    return base


def loaded(spark, root):
    ann = readers.annotations(spark, str(root), "segment", "test", ["heico", "lapchole"])
    res = pred = None
    for d in ("heico", "lapchole"):
        r = readers.results(spark, str(root / "run" / d / "results.csv"), d)
        p = readers.predictions(spark, str(root / "run" / d / "predictions.parquet")).withColumn("dataset", F.lit(d))
        res = r if res is None else res.unionByName(r)
        pred = p if pred is None else pred.unionByName(p)
    return ann, res, pred


def test_multi_dataset_scan(spark, root):
    ann = readers.annotations(spark, str(root), "segment", "test", ["heico", "lapchole"], ["id", "video"])
    assert ann.columns == ["id", "video", "dataset"] and ann.count() == 96
    plan = ann._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,video:string>" in plan
    with pytest.raises(ValueError):
        readers.annotations(spark, str(root), "segment", "test", [])


def test_report_end_to_end(spark, root, tmp_path):
    rows = report.evaluation_table(*loaded(spark, root))
    assert rows.count() == 96
    tables = report.report_tables(rows, "heico", "lapchole")
    overall = {r["dataset"]: r for r in tables["dataset-overall"].collect()}
    assert overall["heico"]["rows"] == 48 and overall["heico"]["correct"] == 32 and overall["heico"]["videos"] == 4
    assert tables["capability-leaf"].count() == 30 and tables["capability-group"].count() == 10
    report.write_reports(spark, rows, str(tmp_path / "out"), "heico", "lapchole", [str(root / "run" / "heico" / "results.csv")])
    text = spark.read.option("header", True).csv(str(tmp_path / "out" / "capability-group")).collect()
    empty = [r for r in text if r["group_code"] == "5"]
    assert len(empty) == 2 and all(r["micro_accuracy"] is None and r["rows"] == "0" for r in empty)
    full = [r for r in text if r["group_code"] == "1"]
    assert all(len(r["micro_accuracy"].split(".")[1]) == 9 for r in full)


def test_report_rejects_gaps(spark, root):
    ann, res, pred = loaded(spark, root)
    with pytest.raises(J.ContractError, match="cover"):
        report.evaluation_table(ann, res, pred.where("sample_id <> '7'"))


def test_json_array_documents(spark, tmp_path):
    doc = [{"qID": "1", "videoID": "v", "start_time": 0.0, "end_time": 9.5, "procedure_type": "p", "question": "q\nr"}]
    (tmp_path / "request.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "answers.json").write_text(json.dumps([{"qID": "1", "content": "2", "latency": 0.5}]))
    assert readers.requests(spark, str(tmp_path / "request.json")).first()["end_time"] == 9.5
    assert readers.responses(spark, str(tmp_path / "answers.json")).first()["content"] == "2"


@pytest.mark.parametrize("split", [1, 2, 3, 7, 64, 1 << 20])
def test_json_arrays_in_parts(spark, tmp_path, split):
    """Strings with brackets, quotes and backslashes, cut anywhere."""
    records = [{"k": k, "text": t, "list": [1, [2, {"a": "]"}]]} for k, t in enumerate(["", "[", '"', "\\", '\\"', "},{", "é\n", "\\\\\"", '",']) ]
    (tmp_path / "a.json").write_text(json.dumps(records[:5], indent=2))
    (tmp_path / "b.json").write_text(" " + json.dumps(records[5:], ensure_ascii=False) + "\n")
    (tmp_path / "none.json").write_text("[ ]")
    got = files.json_items(spark, str(tmp_path), split).collect()
    assert sorted((json.loads(r["item"]) for r in got), key=lambda r: r["k"]) == records
    (tmp_path / "ids").mkdir()
    (tmp_path / "ids" / "ids.json").write_text('["a", "b,c", 7]')
    assert sorted(r["id"] for r in readers.json_ids(spark, str(tmp_path / "ids"), split).collect()) == ["7", "a", "b,c"]


def test_what_is_no_array_fails(spark, tmp_path):
    for text, why in (('{"a": 1}', "no JSON array"), ('[{"a": 1}, {"b": ', "ends inside")):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(Exception, match=why):
            files.json_items(spark, str(tmp_path / "x.json"), 4).collect()


def test_file_digests_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 7)
    for name, content in (("a", b"x" * 100), ("b", b"")):
        (tmp_path / name).write_bytes(content)
    got = {r["path"][-1]: (r["size"], r["sha256"]) for r in sinks.file_hashes(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()}
    assert got == {"a": (100, hashlib.sha256(b"x" * 100).hexdigest()), "b": (0, hashlib.sha256(b"").hexdigest())}


def test_a_resumed_log_counts_after_the_first(spark, tmp_path):
    """The newer file sorts earlier by name."""
    for name, k, at in (("z.jsonl", 1, 1_000_000_000), ("a.jsonl", 2, 1_100_000_000)):
        (tmp_path / name).write_text(json.dumps({"sample_id": "x", "k": k}))
        os.utime(tmp_path / name, (at, at))
    assert [r["k"] for r in readers.resume_log(spark, str(tmp_path), "sample_id string, k int").collect()] == [2]


def test_parts_of_one_log_count_by_name(spark, tmp_path):
    """The first part was finished last."""
    for name, k, at in (("part-00000.txt", 1, 1_100_000_000), ("part-00001.txt", 2, 1_000_000_000)):
        (tmp_path / name).write_text(json.dumps({"sample_id": "x", "k": k}))
        os.utime(tmp_path / name, (at, at))
    assert [r["k"] for r in readers.resume_log(spark, str(tmp_path), "sample_id string, k int", by_name=True).collect()] == [2]


def test_resume_log(spark, tmp_path):
    lines = ['{"sample_id":"a","k":1}', "", '{"sample_id":"b","k":2}', '{"sample_id":"a","k":3}', '{"k":9}', '{"sample_id":"b","k"']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = {r["sample_id"]: r["k"] for r in readers.resume_log(spark, str(tmp_path / "log.jsonl"), "sample_id string, k int").collect()}
    assert got == {"a": 3, "b": 2}


def test_file_inventory_and_plan_check(spark, tmp_path):
    for name, size in (("v1/frame0000000.jpg", 3), ("v1/frame0000025.jpg", 0), ("v1/frame0000099.jpg", 1), ("v1/notes.txt", 5)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * size)
    have = readers.file_inventory(spark, str(tmp_path)).withColumn("dataset", F.lit("heico"))
    rows = [(1, "heico", "v1", 0.0, 2.0, 25, 25, 64)]
    asked = spark.createDataFrame(rows, "qid int, dataset string, video string, start_s double, end_s double, fps int, stride int, max_frames int")
    got = P.verify_plan(P.plan_words(asked), have).first()
    assert (got["expected"], got["missing"], got["unexpected"], got["empty"]) == (3, 2, 1, 1)


def test_frame_counts(spark, tmp_path):
    (tmp_path / "counts.json").write_text(json.dumps({"video_frame_counts": {"a.mp4": 7, "b.mp4": 9}}, indent=1))
    assert {r["video"]: r["frame_count"] for r in readers.frame_counts(spark, str(tmp_path / "counts.json")).collect()} == {"a.mp4": 7, "b.mp4": 9}


def test_long_window_has_no_long_range(spark):
    """A window of a billion seconds plans its few frames at once."""
    rows = [(1, "heico", "v", 0.0, 1e9, 25, 1, 64)]
    df = spark.createDataFrame(rows, "qid int, dataset string, video string, start_s double, end_s double, fps int, stride int, max_frames int")
    frames = [r["frame"] for r in P.question_frames(df).orderBy("frame").collect()]
    assert len(frames) == 64 and frames[0] == 0 and frames[-1] == 25_000_000_000


def test_fingerprint_ignores_row_order_only(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    b = a.orderBy(F.desc("id")).repartition(5)
    c = a.withColumn("x", F.when(F.col("id") == 5, 11).otherwise(F.col("x")))
    prints = [tuple(sinks.fingerprint(d).first()) for d in (a, b, c)]
    assert prints[0] == prints[1] != prints[2]


def test_epoch_table_appends(spark, tmp_path):
    for epoch in (1, 2):
        row = [(epoch, "heico", 0.5 * epoch, 10 * epoch)]
        sinks.append_epoch(spark.createDataFrame(row, "epoch int, dataset string, accuracy double, global_step long"), str(tmp_path / "e"))
    assert readers and sinks.read_epochs(spark, str(tmp_path / "e")).count() == 2


def test_partitioned_layout_prunes(spark, root, tmp_path):
    ann = readers.annotations(spark, str(root), "segment", "test", ["heico", "lapchole"])
    ann.withColumn("split", F.lit("test")).write.partitionBy("dataset", "track", "split").parquet(str(tmp_path / "t"))
    part = readers.partitioned_annotations(spark, str(tmp_path / "t")).where("dataset = 'heico' AND split = 'test'")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert part.count() == 48 and "PartitionFilters: [isnotnull(dataset" in plan


def test_summary_and_settings(spark, tmp_path):
    (tmp_path / "summary.csv").write_text("level,name,accuracy,ci_low,ci_high,count\noverall,MEAN,0.5,0.4,0.6,10\nleaf,1a,,,,0\n")
    rows = {r["level"]: r for r in readers.summary(spark, str(tmp_path / "summary.csv")).collect()}
    assert rows["overall"]["accuracy"] == 0.5 and rows["leaf"]["accuracy"] is None
    for run, stride in (("a", 25), ("b", 30)):
        (tmp_path / f"meta-{run}.json").write_text(json.dumps({"stride": stride, "model_name": "m"}, indent=2))
    meta = readers.run_settings(spark, str(tmp_path / "meta-*.json")).withColumn("family", F.lit("f"))
    got = Q.settings_conflicts(meta, ["family"], ["stride", "model_name"]).collect()
    assert [(r["key"], r["lowest"], r["highest"]) for r in got] == [("stride", "25", "30")]


def test_run_discovery(spark):
    paths = [
        "/r/track-segment/lora/logs/eval_epoch_8/heico/predictions.parquet",
        "/r/track-segment/lora/logs/eval_epoch_8/heico/responses.json",
        "/r/track-frame/base/resp_test/responses.json",
        "/r/track-frame/base/smoke/predictions.parquet",
        "/r/track-frame/base/notes.txt",
    ]
    got = {r["run"]: r for r in R.describe_runs(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert len(got) == 2
    run = got["/r/track-segment/lora/logs/eval_epoch_8/heico"]
    assert (run["kind"], run["track"], run["dataset"], run["epoch"], run["method"]) == ("rich", "segment", "heico", 8, "lora")
    assert got["/r/track-frame/base/resp_test"]["kind"] == "legacy"
