"""Repeated runs of lines by winnowing, the later ones deleted.

Lines become hashes; of every ``window`` neighbouring lines the smallest hash is a fingerprint, so a repeated run
of that many lines has a fingerprint at the same place in each copy. Fingerprints that stand alone are done with;
the others are widened both ways to the runs of ``window`` lines around them, each run is joined with its first
occurrence, and runs that overlap make up the longer ones. A line goes if a run that covers it stood earlier.

A line alone is shorter than the guarantee. It counts as a run of its own if it is long, or if it occurs so often
that it is no coincidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.llm.common import Stages, row_key, slices, whole

# Repeated runs of so many lines are found whatever the lines; a line alone if it has so many words or occurs so often.
WINDOW = 2
LONG, OFTEN = 20, 3


def line_hashes(text: str) -> tuple[list[int], np.ndarray]:
    """Numbers and hashes of the lines that hold more than white space, outer white space left off."""
    numbers, hashes = [], []
    for i, line in enumerate(text.split("\n")):
        if line := line.strip():
            numbers.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(line.encode()))
    return numbers, np.array(hashes, np.uint64)


def winnow(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``window`` lines: where its smallest hash is (the leftmost), and a hash of the run."""
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)
    mixed = np.zeros(len(runs), np.uint64)
    for column in runs.T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return runs.argmin(axis=1), mixed


def _runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            for k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                numbers, hashes = line_hashes(text)
                n = len(hashes)
                if not n:
                    continue
                lines = text.split("\n")
                # the last lines begin no whole run
                prints, runs = hashes.copy(), np.zeros(n, np.uint64)
                if n >= window:
                    least, mixed = winnow(hashes, window)
                    prints[: len(least)] = hashes[np.arange(len(least)) + least]
                    runs[: len(least)] = mixed
                whole_run = np.arange(n) <= n - window
                words = np.fromiter((len(lines[i].split()) for i in numbers), np.int32, n)
                own = (np.full(n, k1), np.full(n, k2), np.arange(n), hashes.view(np.int64), words)
                own += (prints.view(np.int64), np.where(whole_run, runs.view(np.int64), 0))
                for col, values in zip(cols, own, strict=True):
                    col.append(values)
            if cols[0]:
                flat = [np.concatenate(c) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat], ["k1", "k2", "at", "line", "words", "print", "run"])

    return run


def later_lines(
    docs: DataFrame, stages: Stages, window: int = WINDOW, long: int = LONG, often: int = OFTEN
) -> DataFrame:
    """(k1, k2, at): the places among a document's lines at which a run that stood earlier is repeated.

    Runs are ``window`` neighbouring lines, and single lines of ``long`` words or with ``often`` occurrences.
    Documents are ordered by id (nulls as zero), then by a hash of the text.
    """
    k1, k2 = row_key(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), whole().alias("text"))
    kinds = "k1 long, k2 long, at long, line long, words int, print long, run long"
    found = stages.keep(rows.mapInArrow(_runs(window), kinds), "lines")
    place = F.struct("k1", "k2", "at")

    runs = found.where("run <> 0")
    shared = runs.groupBy("print").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("print")
    live = stages.keep(runs.join(shared, "print").select("k1", "k2", "at", "print", "run"), "shared")
    first = live.groupBy("print", "run").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c"))
    first = stages.keep(first.where("c > 1").select("print", "run", "f"), "first")
    later = live.join(first, ["print", "run"]).where("struct(k1, k2, at) > f")
    covered = F.explode(F.sequence("at", F.col("at") + (window - 1))).alias("at")

    alone = found.groupBy("line").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c"), F.max("words").alias("w"))
    alone = alone.where((F.col("c") > 1) & ((F.col("w") >= long) | (F.col("c") >= often))).select("line", "f")
    alone = found.join(stages.keep(alone, "alone"), "line").where("struct(k1, k2, at) > f")
    return later.select("k1", "k2", covered).union(alone.select("k1", "k2", "at")).distinct()


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_llm_text"):
        kept, total, gone = [], [], []
        where = batch.schema.get_field_index
        for text, at in zip(batch.column(where("_llm_text")).to_pylist(), batch.column(where("_llm_at")).to_pylist(), strict=True):
            numbers = [i for i, x in enumerate(text.split("\n")) if x.strip()] if at else []
            dead = {numbers[i] for i in at or ()}
            lines = text.split("\n")
            total.append(len(lines))
            gone.append(len(dead))
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in dead) if dead else text)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
            [*batch.schema.names, "_llm_kept", "_llm_lines", "_llm_gone"],
        )


def remove_later_runs(
    docs: DataFrame, stages: Stages, window: int = WINDOW, long: int = LONG, often: int = OFTEN
) -> DataFrame:
    """``docs`` with columns _llm_kept (the text left), _llm_lines and _llm_gone (lines there were, and deleted).

    Lines are compared without outer white space; blank ones are no part of runs and stay. The first occurrence of
    a run stays, also when a document repeats itself. Of rows that repeat a whole row each is the first document's
    equal and loses what it loses. Null texts: empty; short ones keep all; no rows give none.
    """
    k1, k2 = row_key(docs)
    found = later_lines(docs, stages, window, long, often).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("_llm_at"))
    names = ["_llm_k1", "_llm_k2"]
    rows = docs.withColumns({"_llm_k1": k1, "_llm_k2": k2, "_llm_text": whole()})
    rows = rows.join(found.toDF(*names, "_llm_at"), names, "left").drop(*names)
    more = [T.StructField("_llm_kept", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("_llm_lines", "_llm_gone"))]
    schema = T.StructType([*rows.schema.fields, *more])
    return rows.mapInArrow(_without, schema).drop("_llm_at", "_llm_text")
