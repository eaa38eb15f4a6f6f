"""Readers: annotation shards, result tables, JSON documents, logs, file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.functions.text import listed, truth
from tallyframe.sources import files


def annotation_path(root: str, dataset: str, track: str, split: str, default: str = "heico") -> str:
    """The default dataset lies at the root, any other in a folder of its name."""
    base = root.rstrip("/") if dataset == default else f"{root.rstrip('/')}/{dataset}"
    return f"{base}/{track}/{split}"


def annotations(
    spark: SparkSession,
    root: str,
    track: str,
    split: str,
    datasets: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Union of dataset shards, each row tagged with its dataset.

    The declared schema spares the inference pass; columns not asked for are
    never read from the files.
    """
    if not datasets:
        raise ValueError("at least one dataset is required")
    out = None
    for dataset in datasets:
        part = spark.read.schema(schemas.ANNOTATIONS).parquet(annotation_path(root, dataset, track, split))
        part = part.withColumn("dataset", F.lit(dataset))
        out = part if out is None else out.unionByName(part)
    return out.select(*columns, "dataset") if columns else out


def partitioned_annotations(spark: SparkSession, root: str) -> DataFrame:
    """Annotation table laid out as ``dataset=/track=/split=`` folders."""
    return spark.read.parquet(root)


# --- fixed values: columns of a results file and what reports call them ---
RESULT_NAMES = {
    "video": "evaluated_video",
    "ood": "evaluated_ood",
    "clinical": "evaluated_clinical",
    "primary": "evaluated_primary",
    "answer_format": "evaluated_answer_format",
    "latency": "evaluated_latency_sec",
}
# --- end of fixed values ---


def results(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Scored rows from CSV: ids as text, columns prefixed, flags as 0/1."""
    raw = spark.read.schema(schemas.RESULTS).option("header", True).csv(path)
    out = raw.withColumnsRenamed(RESULT_NAMES)
    for flag in ("evaluated_ood", "evaluated_clinical", "timed_out", "correctness"):
        out = out.withColumn(flag, truth(F.col(flag)))
    return out if dataset is None else out.withColumn("dataset", F.lit(dataset))


def summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SUMMARY).option("header", True).csv(path)


def predictions(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Prediction rows with the joined text columns split into arrays."""
    df = spark.read.schema(schemas.PREDICTIONS).parquet(path)
    for joined in ("secondary_capabilities", "frame_paths", "frame_timestamps"):
        df = df.withColumn(joined, listed(F.col(joined)))
    return df.select(*columns) if columns else df


def json_array(spark: SparkSession, path: str, schema: str, split_bytes: int = files.SPLIT_BYTES) -> DataFrame:
    """JSON documents that each hold an array of records, large ones read by many tasks.

    Columns of ``schema`` that the job does not use are not parsed.
    """
    items = files.json_items(spark, path, split_bytes)
    return items.select(F.from_json("item", schema).alias("_r")).select("_r.*")


def json_ids(spark: SparkSession, path: str, split_bytes: int = files.SPLIT_BYTES) -> DataFrame:
    """A JSON array of ids, text or numbers, as text."""
    read = F.from_json(F.concat(F.lit("["), "item", F.lit("]")), "array<string>")
    return files.json_items(spark, path, split_bytes).select(F.get(read, F.lit(0)).alias("id"))


def requests(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.REQUESTS)


def responses(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.RESPONSES)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of every key; an aggregation, so a hot key is merged early."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first record of every key."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )


def resume_log(spark: SparkSession, path: str, schema: str, key: str = "sample_id", by_name: bool = False) -> DataFrame:
    """A JSONL log that may hold blank or cut lines; the last record of an id wins.

    A log in several files is ordered by their time of modification, then name, so a
    resumed run counts after the one it resumed; inside a file by byte order. The parts
    of one write are finished in any order: ``by_name`` orders a log of such files by name.
    """
    raw = (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    placed = raw.select(
        "*",
        F.col("_metadata.file_modification_time").alias("_time"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    good = placed.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull()).drop("_corrupt_record")
    order = ["_file", "_block", "_line"] if by_name else ["_time", "_file", "_block", "_line"]
    return last_per_key(good, [key], order).drop("_time", "_file", "_block", "_line")


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Frame files with video, index and size, empty ones too; contents are never read."""
    found = files.listed_files(spark, root).where(F.col("path").rlike(r"/[^/]+/frame\d+\.jpg$"))
    return found.select(
        "path",
        "size",
        F.regexp_extract("path", r"/([^/]+)/frame\d+\.jpg$", 1).alias("video"),
        F.regexp_extract("path", r"/frame(\d+)\.jpg$", 1).try_cast("bigint").alias("frame"),
    )


def frame_counts(spark: SparkSession, path: str) -> DataFrame:
    """``video -> frames`` of one JSON document as rows."""
    doc = spark.read.schema("video_frame_counts map<string,bigint>").option("multiLine", True).json(path)
    return doc.select(F.explode("video_frame_counts").alias("video", "frame_count"))


def run_settings(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """``(run, settings)``: documents by glob, or all of one name below a folder; the text is kept as JSON."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name) if name else spark.read
    found = reader.text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("run"), F.col("value").alias("settings"))
