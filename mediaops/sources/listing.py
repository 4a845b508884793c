"""Objects below a path, listed by executors.

A tree is walked level by level: the folders of a level are rows of a table in the shared folder, dealt over tasks,
and each task lists its folders and writes the objects and folders it meets. The driver sees counts only. A folder
is listed by one task, which holds that listing in memory, however many objects lie in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.session import shared_dir

# Stores that tasks can list by themselves; s3a and s3n are s3. Others are listed by the driver.
SCHEMES = {"": "file", "file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfss": "abfss"}
ROWS = 10_000
FOUND = "key string, size long, last_modified timestamp, folder boolean"


def _address(path: str) -> str | None:
    """The path as tasks address it; nothing for stores they don't reach."""
    scheme, mark, rest = path.partition("://")
    if not mark:  # a local path, plain or as file:/…
        return "file://" + path.removeprefix("file:")
    return f"{SCHEMES[scheme]}://{rest}" if scheme in SCHEMES else None


def _lister(root: str):
    """Lists folders given by their keys below ``root``; one gone meanwhile is empty. Hidden names are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for batch in batches:
            for key in batch["key"]:
                rows = []
                for info in store.get_file_info(fs.FileSelector(f"{base}/{key}".rstrip("/"), allow_not_found=True)):
                    name = info.base_name
                    if name[:1] == "." or name[:1] == "_" and "=" not in name:
                        continue
                    folder = info.type == fs.FileType.Directory
                    rows.append((key + name + "/" * folder, None if folder else info.size, info.mtime, folder))
                    if len(rows) == ROWS:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return run


def _frame(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["key", "size", "last_modified", "folder"])
    return frame.astype({"size": "Int64", "folder": "bool", "last_modified": "datetime64[us, UTC]"})


def list_files(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(key, size, last_modified) of the objects below ``path`` whose key starts with ``prefix``.

    Folders that the prefix rules out are not opened. Names that start with ``.``, or with ``_`` and
    hold no ``=``, are left out, as Spark's own readers do. A path that isn't there, or holds nothing, has no rows.
    """
    root = _address(path.rstrip("/"))
    if root is None:
        return _by_driver(spark, path).filter(F.startswith("key", F.lit(prefix)))
    stage = shared_dir(spark, "listing")
    # folders on the way to the prefix are known without listing them
    start = prefix[: prefix.rfind("/") + 1]
    level, depth = spark.createDataFrame([(start,)], "key string"), 0
    while True:
        place = f"{stage}/level={depth:04d}"
        level.mapInPandas(_lister(root), FOUND).filter(F.startswith("key", F.lit(prefix))).write.mode("overwrite").parquet(place)
        level = spark.read.schema(FOUND).parquet(place).filter("folder").select("key")
        folders = level.count()
        if not folders:
            break
        # as many folders a task as keep the level's tasks short, and no fewer tasks than the cluster runs at once
        level = level.repartition(min(folders, max(spark.sparkContext.defaultParallelism, folders // 200)), "key")
        depth += 1
    return spark.read.schema(FOUND).parquet(*(f"{stage}/level={d:04d}" for d in range(depth + 1))).filter("not folder").drop("folder")


def _by_driver(spark: SparkSession, path: str) -> DataFrame:
    """The same of a store that only Spark reads: its file index lists the folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.regexp_replace("path", "^.*?\\Q" + path.rstrip("/") + "/\\E", "")
    return found.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
