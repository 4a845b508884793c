"""What several of the text operators need: stages in the shared folder, batches of text, connected classes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.session import shared_dir
from mediaops.sources.files import remove


class Stages:
    """Tables written once under the shared folder and read back: lineage ends there, on disks that all executors see."""

    def __init__(self, spark, name: str):
        self.spark, self.folder = spark, shared_dir(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *written: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in written:
            remove(self.spark, f"{self.folder}/{name}")


def whole(text: str | Column = "text") -> Column:
    """The text, an empty one where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """Two numbers without nulls that tell documents apart also where ids repeat; equal for repeated rows only."""
    number = docs[id_col].cast("long")
    text = whole(docs[text_col])
    return F.coalesce(number, F.lit(0).cast("long")), F.xxhash64(number.isNull(), text)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes of text; a longer text makes a piece of its own.

    After the last one the worker gives memory back.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            yield batch.slice(start, end - start)
    batch = lengths = part = None
    release()


def release() -> None:
    """Give memory that Python and Arrow hold unused back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def classes(edges: DataFrame, stages: Stages, name: str = "stars") -> DataFrame:
    """(node, root): the smallest node reachable over the undirected ``edges`` (a, b), for each node of an edge.

    Rounds of large-star and small-star contraction: every round hangs neighbours on the smallest node
    they see and is written out, until all hang on their smallest. Only whether they do comes to the driver.
    """
    now = stages.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-0",
    )
    step = 0
    while not _hang(now):
        step += 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stages.keep(small.union(met.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        stages.drop(f"{name}-{step - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()


def _hang(edges: DataFrame) -> bool:
    """Whether of the ``edges`` (u, v) with u > v each u has one v, which is no u itself: then v is its class's smallest."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    ends = ends.groupBy("node").agg(F.max("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return ends.where("up = 1 and n > 1").isEmpty()
