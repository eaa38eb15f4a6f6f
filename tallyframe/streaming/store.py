"""A table of one row per key that micro-batches merge into, exact over the whole history.

Every micro-batch is reduced to one row per key and written under its number, so a
batch that runs again after a failure replaces its own rows and nothing is counted
twice. Every ``compact_every`` batches the rows so far merge into a new base, and
what the base before last was made of is removed: the table holds two bases and the
batches since, however long the stream runs. A base counts only once its write was
committed, so a reader never sees half of one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyframe.sources import folders


@dataclass(frozen=True)
class KeyedStore:
    """``merge`` turns rows of the store into one row per key.

    It must give the same for all rows at once as for merged parts merged again. It
    sees a column ``batch``, the number of the batch a row came with, and may use it.
    """

    path: str
    schema: str
    merge: Callable[[DataFrame], DataFrame]
    compact_every: int = 16

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the committed folders of a kind, ``base`` or ``delta``."""
        top = f"{self.path}/{kind}"
        found = [n.removeprefix("number=") for n in folders.names(spark, top) if n.startswith("number=")]
        return sorted(int(n) for n in found if folders.finished(spark, f"{top}/number={n}"))

    def _rows(self, spark: SparkSession, base: int, upto: int | None = None) -> DataFrame:
        """Rows of a base, if there is one, and of the batches after it."""
        batches = [n for n in self._numbers(spark, "delta") if n > base and (upto is None or n <= upto)]
        schema = f"{self.schema}, batch long"
        paths = [f"{self.path}/base/number={base}"] * (base >= 0) + [f"{self.path}/delta/number={n}" for n in batches]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def add(self, batch: DataFrame, number: int) -> None:
        """Merge a micro-batch; meant for ``foreachBatch``."""
        spark = batch.sparkSession
        rows = self.merge(batch.withColumn("batch", F.lit(number).cast("long")))
        rows.write.mode("overwrite").parquet(f"{self.path}/delta/number={number}")
        if (number + 1) % self.compact_every == 0:
            self._compact(spark, number)

    def _compact(self, spark: SparkSession, number: int) -> None:
        older = [n for n in self._numbers(spark, "base") if n < number]
        last = max(older, default=-1)
        self.merge(self._rows(spark, last, number)).write.mode("overwrite").parquet(f"{self.path}/base/number={number}")
        for n in older[:-1]:  # readers of the last base may still be under way, those of the one before are not
            folders.remove(spark, f"{self.path}/base/number={n}")
        for n in self._numbers(spark, "delta"):
            if n <= last:
                folders.remove(spark, f"{self.path}/delta/number={n}")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """One row per key; with ``before``, as it was before that batch."""
        bases = [n for n in self._numbers(spark, "base") if before is None or n < before]
        return self.merge(self._rows(spark, max(bases, default=-1), None if before is None else before - 1)).drop("batch")

    def feed(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
