"""Queries that write given tables in a source's layout and read them through its reader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.operators import frames as P
from tallyframe.operators import scoring as S
from tallyframe.plans.q_io import scratch
from tallyframe.plans.registry import query
from tallyframe.plans.views import table, view
from tallyframe.sources import files, readers

_HMS = "lpad(CAST(({0}) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({0}) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({0}) % 60 AS VARCHAR), 2, '0')"


def annotations(spark, sf) -> DataFrame:
    """The scored questions in the shape of annotation shards, with a dataset column."""
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    stamp = lambda x: F.concat(two(x / 3600), F.lit(":"), two(x % 3600 / 60), F.lit(":"), two(x % 60))
    start = F.col("qid") % 5000
    own = {
        "id": F.col("qid").cast("string"), "procedure_type": F.lit("Resection"), "track": F.lit("segment"), "clinical_relevance": F.col("clinical"),
        "timestamp_start": stamp(start), "timestamp_end": stamp(start + F.col("k")), "primary_capability": F.col("capability_code"),
        "secondary_capabilities": F.array(F.lit("2a"), F.col("group_code")),
    }
    rows = view(spark, sf, "answer_rows")
    wanted = [f.split(" ")[0] for f in schemas.ANNOTATIONS.split(", ")]
    return rows.select("dataset", *[own.get(n, F.col(n)).alias(n) for n in wanted])


@query(
    "annotation_shards",
    "SELECT CAST(qid AS VARCHAR) AS id, dataset, video, answer_format, ood FROM answer_rows", ["answer_rows"], covers="A-01 A-02 A-03",
)
def annotation_shards(spark, sf):
    root, rows = scratch(spark, "annotations"), annotations(spark, sf)
    for dataset in ("heico", "lapchole"):  # the default dataset lies at the root
        rows.where(F.col("dataset") == dataset).drop("dataset").write.parquet(readers.annotation_path(root, dataset, "segment", "test"))
    return readers.annotations(spark, root, "segment", "test", ["heico", "lapchole"], ["id", "video", "answer_format", "ood"])


@query(
    "requests_from_json_arrays",
    """SELECT CAST(qid AS VARCHAR) AS qid, video, CAST(qid % 5000 AS DOUBLE) AS start_time, CAST(qid % 5000 + k AS DOUBLE) AS end_time, question FROM answer_rows""",
    ["answer_rows"], ("start_time", "end_time"), "A-05 A-11 B-01",
)
def requests_from_json_arrays(spark, sf):
    """Annotations become requests in JSON arrays, read back in parts of 64 KB, so several tasks share a file."""
    path = scratch(spark, "requests")
    files.write_json_arrays(S.requests(annotations(spark, sf)).repartition(2, "qID"), path)
    read = readers.json_array(spark, path, schemas.REQUESTS, split_bytes=1 << 16)
    return read.select(F.col("qID").alias("qid"), F.col("videoID").alias("video"), "start_time", "end_time", "question")


@query(
    "subset_from_json_ids",
    "SELECT dataset, answer_format, count(*) AS n FROM eval_rows WHERE k % 3 = 1 GROUP BY 1, 2", ["eval_rows"], covers="A-05 C-06",
)
def subset_from_json_ids(spark, sf):
    """A subset given as a JSON array of ids, joined to its questions."""
    rows, path = view(spark, sf, "eval_rows"), scratch(spark, "ids")
    files.write_json_items(rows.where("k % 3 = 1").select(F.to_json(F.array(F.col("qid").cast("string"))).alias("item")).select(F.regexp_replace("item", r"^\[|\]$", "").alias("item")), path)
    ids = readers.json_ids(spark, path, split_bytes=1 << 14)
    wanted = rows.withColumn("id", F.col("qid").cast("string")).join(ids, "id", "left_semi")
    return wanted.groupBy("dataset", "answer_format").agg(F.count(F.lit(1)).alias("n"))


# real files: one per supplier and nation folder, every fifth of them empty
_FILES = "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS content FROM supplier WHERE s_suppkey % 4 > 0"


def supplier_files(spark, sf) -> tuple[str, DataFrame]:
    root = scratch(spark, "files")
    name = F.format_string("%s/n%d/frame%07d.jpg", F.lit(root), F.col("s_nationkey").cast("bigint"), F.col("s_suppkey").cast("bigint"))
    content = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.col("s_name"))
    rows = table(spark, sf, "supplier").where("s_suppkey % 4 > 0").select(name.alias("path"), content.alias("content"), "s_suppkey")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files.put_file(path, text.encode())
            yield batch.select(["path"])

    rows.select("path", "content").mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()
    return root, rows


@query(
    "plan_against_files",
    f"""WITH f AS ({_FILES}), w AS (SELECT s_nationkey, s_suppkey FROM supplier WHERE s_suppkey % 4 < 3)
        SELECT 'n' || s_nationkey AS video, count(w.s_suppkey) AS expected, count(*) FILTER (w.s_suppkey IS NOT NULL AND coalesce(content, '') = '') AS missing,
               count(*) FILTER (w.s_suppkey IS NULL AND content <> '') AS unexpected, count(*) FILTER (content = '') AS empty
        FROM w FULL JOIN f USING (s_nationkey, s_suppkey) GROUP BY s_nationkey HAVING count(w.s_suppkey) > 0""",
    covers="A-08 K-10",
)
def plan_against_files(spark, sf):
    """A frame plan against files as they lie in folders, empty ones included."""
    root, _ = supplier_files(spark, sf)
    video = F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("video")
    wanted = table(spark, sf, "supplier").where("s_suppkey % 4 < 3").select(video, F.col("s_suppkey").cast("bigint").alias("frame"))
    return P.verify_plan(P.as_words(wanted, ["video"], want=F.lit(True)), readers.file_inventory(spark, root), ["video"])


@query(
    "file_digests",
    f"SELECT s_suppkey, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256 FROM ({_FILES})", covers="A-13",
)
def file_digests(spark, sf):
    _, rows = supplier_files(spark, sf)
    return files.file_digests(rows).join(rows.select("path", "s_suppkey"), "path").select("s_suppkey", "size", "sha256")
