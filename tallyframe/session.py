"""Session defaults, and tables in the shared folder that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyframe.sources import folders

# Runtime re-planning does the work a fixed hint cannot: it measures each
# exchange, switches a join to broadcast only when the measured side is small,
# and splits the partitions of a hot key.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(app: str = "tallyframe", cores: int = 8, shuffle: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir`` of the session.

    A local session may do without it and gets a temporary folder; a cluster
    may not, since a folder on one machine is lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def release_tables(spark: SparkSession) -> None:
    """Remove the tables that ``cut_lineage`` wrote for this application, once no result reads them."""
    folders.remove(spark, _tables(spark))


def drop_tables(*tables: DataFrame) -> None:
    """Remove tables of ``cut_lineage`` whose last reader has been written, and the shuffles behind them.

    For the code that made them: what it has written since starts from other files,
    so a task that runs again does not need these. Spark removes the shuffle files
    of plans that the driver no longer holds when it collects garbage, which it is
    asked to do here. Other DataFrames are left alone.
    """
    paths = [t._cut_path for t in tables if hasattr(t, "_cut_path")]
    for path in paths:
        folders.remove(tables[0].sparkSession, path)
    if paths:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back.

    What follows starts from files: it may read them several times, a lost
    executor costs a re-read, and the planner knows their size. The tables of an
    application lie in one folder; ``release_tables`` removes them, and
    ``drop_tables`` those that their maker is done with.
    """
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table
