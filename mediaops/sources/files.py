"""Folders of stored tables, in whatever store they lie."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and what it holds; nothing happens where there is none."""
    store, place = _store(spark, path)
    store.delete(place, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file that says a step is done; its folders are made."""
    store, place = _store(spark, path)
    store.create(place, True).close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    store, place = _store(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
