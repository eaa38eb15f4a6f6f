"""Incremental prediction ingest: restart-safe, the last record of an id is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.sources.readers import last_per_key
from tallyframe.streaming.store import KeyedStore

PREDICTION_LOG = (
    "dataset string, sample_id string, answer_format string, question string, "
    "raw_model_output string, latency_sec double, error string, arrived timestamp"
)


def prediction_stream(spark: SparkSession, path: str, schema: str = PREDICTION_LOG, files_per_trigger: int = 1000) -> DataFrame:
    """New JSONL files as they land; cut lines are dropped."""
    raw = (
        spark.readStream.schema(f"{schema}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )
    return raw.where(F.col("_corrupt_record").isNull() & F.col("sample_id").isNotNull()).drop("_corrupt_record")


def _with_parse(df: DataFrame) -> DataFrame:
    question = F.col("question") if "question" in df.columns else None
    answer = text.normalize_answer(F.col("answer_format"), F.coalesce("raw_model_output", F.lit("")), question)
    return df.withColumn("prediction", answer).withColumn(
        "parsed", F.coalesce(text.is_readable(F.col("answer_format"), F.col("prediction")), F.lit(False)).cast("int")
    )


def live_totals(df: DataFrame) -> DataFrame:
    """Rows, errors, parse rate and mean latency; runs on streams and on tables."""
    return (
        _with_parse(df)
        .groupBy("dataset", "answer_format")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.length(F.coalesce("error", F.lit(""))) > 0).alias("errors"),
            F.avg("parsed").alias("parse_rate"),
            F.avg("latency_sec").alias("mean_latency_sec"),
        )
    )


def prediction_store(path: str, schema: str = PREDICTION_LOG, compact_every: int = 16) -> KeyedStore:
    """The latest arrival of every (dataset, id), however late it comes.

    Equal arrival times are settled by the later batch, then by content.
    """

    def last(rows: DataFrame) -> DataFrame:
        content = F.xxhash64(*[c for c in rows.columns if c != "batch"])
        kept = last_per_key(rows.withColumn("_content", content), ["dataset", "sample_id"], ["arrived", "batch", "_content"])
        return kept.drop("_content")

    return KeyedStore(path, schema, last, compact_every)


def pending(requests: DataFrame, stored: DataFrame, keys: Sequence[str] = ("dataset", "sample_id")) -> DataFrame:
    """Requests whose id has no stored prediction yet: what a restarted run still has to do."""
    return requests.join(stored.select(*keys), list(keys), "left_anti")
