"""Sinks: tables, report CSV, JSON lines, provenance and epoch metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import schemas
from tallyframe.sources import files


def write_rows(df: DataFrame, path: str, ordinal: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Rows as parquet; with an ordinal, files are range-sorted by it."""
    out = df
    if ordinal:
        out = out.repartitionByRange(F.col(ordinal)).sortWithinPartitions(ordinal)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def report_text(df: DataFrame) -> DataFrame:
    """Every column as text: nine decimals for fractions, empty for NULL and NaN."""
    cells = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            text = F.when(c.isNotNull() & ~F.isnan(c), F.format_string("%.9f", c))
        elif isinstance(field.dataType, T.ArrayType):
            text = F.array_join(c.cast("array<string>"), "|")
        else:
            text = c.cast("string")
        cells.append(F.coalesce(text, F.lit("")).alias(field.name))
    return df.select(*cells)


def write_report(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A report table as CSV with a header; ``one_file`` for tables of a few rows only."""
    out = report_text(df)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option(
        "emptyValue", ""
    ).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def as_json_lines(df: DataFrame, name: str = "line") -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def file_hashes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Size and SHA-256 of source files, each read in bounded pieces by one task."""
    return files.file_digests(spark.createDataFrame([(p,) for p in paths], "path string"))


def fingerprint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint of table contents: row count and combined row hashes."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    word = F.conv(F.substring(row, 1, 15), 16, 10).cast("bigint")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(word).alias("content_xor"),
        F.sum(word.cast("decimal(38,0)")).cast("string").alias("content_sum"),
    )


def provenance(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows, videos and correct rows per source."""
    cells = df.groupBy(*keys, "video").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("k"))
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("videos"), F.sum("k").alias("correct")
    )


def append_epoch(df: DataFrame, path: str) -> None:
    """Add the metrics of an epoch; each epoch is a partition of the table."""
    df.write.mode("append").partitionBy("epoch").parquet(path)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EPOCH_METRICS).parquet(path)
