"""Folders of any store that Spark reads: names, finished writes, removal."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly inside a folder; none if there is no such folder."""
    store, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write of this folder was committed."""
    return "_SUCCESS" in names(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    store, place = _at(spark, path)
    store.delete(place, True)
