"""Annotation revision log: latest state, conflicts and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyframe import schemas
from tallyframe.sources.readers import last_per_key
from tallyframe.streaming.store import KeyedStore


def revision_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schemas.REVISIONS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def latest_state(events: DataFrame) -> DataFrame:
    """Status of every case at its highest revision; batch or stream."""
    at = F.struct("revision", "timestamp")
    return events.groupBy("case_id").agg(
        F.max("revision").alias("revision"),
        F.max_by("status", at).alias("status"),
        F.max_by("box_count", at).alias("box_count"),
        F.max("timestamp").alias("updated_at"),
    )


def revision_conflicts(events: DataFrame) -> DataFrame:
    """Repeated revisions of a case, and cases whose revisions leave a gap.

    Without a conflict the revisions of a case are 1..n, so count, distinct
    count and maximum agree; no ordering of the log is needed.
    """
    return _conflicts(events.groupBy("case_id", "revision").agg(F.count(F.lit(1)).alias("n")))


def _conflicts(per: DataFrame) -> DataFrame:
    out = per.groupBy("case_id").agg(
        F.sum("n").alias("writes"),
        F.count(F.lit(1)).alias("revisions"),
        F.max("revision").alias("last_revision"),
        F.sum(F.col("n") - 1).alias("repeated"),
    )
    return out.withColumn("gaps", F.col("last_revision") - F.col("revisions")).where(
        (F.col("repeated") > 0) | (F.col("gaps") != 0)
    )


STORED = "case_id string, revision long, writes long, timestamp timestamp, status string, box_count int"


def revision_store(path: str, compact_every: int = 16) -> KeyedStore:
    """Writes of every (case, revision) and the last of them, over the whole log."""

    def merged(rows: DataFrame) -> DataFrame:
        writes = F.sum("writes").alias("writes") if "writes" in rows.columns else F.count(F.lit(1)).alias("writes")
        last = F.max(F.struct("timestamp", "batch", "status", "box_count")).alias("_last")
        found = rows.groupBy("case_id", "revision").agg(writes, last)
        return found.select("case_id", "revision", "writes", *[F.col(f"_last.{c}").alias(c) for c in ("timestamp", "status", "box_count", "batch")])

    return KeyedStore(path, STORED, merged, compact_every)


def guarded_feed(store: KeyedStore, stream: DataFrame, alerts: str, checkpoint: str) -> DataStreamWriter:
    """Feed the store, and write each batch's conflicts with all that came before.

    A conflict is a (case, revision) that the history or the batch itself already
    holds, no matter how long ago. ``alerts`` gets one folder per batch.
    """

    def add(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            new = kept.groupBy("case_id", "revision").agg(F.count(F.lit(1)).alias("new"))
            held = store.read(batch.sparkSession, before=number).select("case_id", "revision", F.col("writes").alias("held"))
            both = new.join(held, ["case_id", "revision"], "left").fillna(0, ["held"]).where("held + new > 1")
            both.write.mode("overwrite").parquet(f"{alerts}/batch={number}")
            store.add(kept, number)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def state_of(stored: DataFrame) -> DataFrame:
    """Status of every case at its highest revision, from the store."""
    at = F.struct("revision", "timestamp")
    return stored.groupBy("case_id").agg(
        F.max("revision").alias("revision"),
        F.max_by("status", at).alias("status"),
        F.max_by("box_count", at).alias("box_count"),
        F.max("timestamp").alias("updated_at"),
    )


def conflicts_of(stored: DataFrame) -> DataFrame:
    """``revision_conflicts`` of the whole log, from the store."""
    return _conflicts(stored.select("case_id", "revision", F.col("writes").alias("n")))


def progress_counts(state: DataFrame) -> DataFrame:
    """Cases per status."""
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("cases"))


def compact(log: DataFrame) -> DataFrame:
    """The last event of every case, for a smaller log."""
    return last_per_key(log, ["case_id"], ["revision", "timestamp"])
