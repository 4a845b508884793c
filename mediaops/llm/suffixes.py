"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digits first.

Only windows of ``depth`` bytes matter, so suffixes are ordered through that depth and no further. A window
is stood for by one suffix inside it: the one whose next ``DIGIT`` bytes have the smallest hash (the leftmost
of equals). Equal windows choose it at the same offset, so four passes over ever fewer rows decide all:

1. first digit: suffixes whose DIGIT bytes start nowhere else leave;
2. whole reach: suffixes whose surroundings, over all windows they stand for, are equal to another's are
   repeated as a whole; one of each such class goes on;
3. second digit: what follows, or stands before, the first digit for half of what a window has besides it. Every
   window holds one of both; windows whose one is no other class's leave;
4. last digit: the remaining windows themselves; groups of two or more are exactly the repeated ones.

Digits are 64-bit hashes; windows are compared by first digit and window hash, 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import Stages, row_key, slices, whole

DEPTH = 400
# Odd multipliers of the polynomial hashes and of the mixing step, any would do.
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = 0xD6E8FEB86659FD93
# Bytes hashed at a time.
_PIECE = 1 << 19
_SPREAD = 1 << 16
_BYTES = np.random.default_rng(42).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes, modulo 2**64, of any stretch of a byte array."""

    def __init__(self, data: np.ndarray, which: int):
        n, inverse = len(data), pow(_BASE[which], -1, 1 << 64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * _powers(_BASE[which], n), out=self.sums[1:])
        self.back = _powers(inverse, n + 1)

    def windows(self, size: int) -> np.ndarray:
        """Of every stretch of ``size`` bytes."""
        out = self.sums[size:] - self.sums[: len(self.sums) - size]
        return _mixed(out * self.back[: len(out)])

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of each window of ``w`` values, by their upper 32 bits (the index takes the rest)."""
    n, mask = len(x), np.uint64(0xFFFFFFFF)
    tagged = (x & ~mask) | np.arange(n, dtype=np.uint64)
    pad = -n % w
    padded = np.concatenate([tagged, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (least & mask).astype(np.int64)


def _standing(data: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(doc index, suffix, first window, last window) of the suffixes that stand for windows inside documents."""
    digit = depth // 2
    if len(data) < depth:
        none = np.empty(0, np.int64)
        return none, none, none, none
    chosen = _window_minima(Rolling(data, 0).windows(digit), depth - digit + 1)
    doc = np.searchsorted(bounds, np.arange(len(chosen)), side="right") - 1
    inside = np.arange(len(chosen)) + depth <= bounds[doc + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, at, at
    new = np.flatnonzero(np.r_[True, (chosen[at][1:] != chosen[at][:-1]) | (doc[at][1:] != doc[at][:-1])])
    first, last = at[new], at[np.r_[new[1:] - 1, len(at) - 1]]
    return doc[first], chosen[first], first, last


def _i64(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64, copy=False).view(np.int64))


def _reaches(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=_PIECE):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
            whole_data, digit = np.frombuffer(b"".join(texts), np.uint8), depth // 2
            k1, k2 = (batch.column(i).to_numpy() for i in range(2))
            for begin in range(0, len(whole_data), _PIECE):  # a reach cut at a piece's end is only a smaller reach
                data = whole_data[begin : begin + _PIECE + depth - 1]
                doc, suffix, first, last = _standing(data, bounds - begin, depth)
                if not len(doc):
                    continue
                hashes = Rolling(data, 1)
                surroundings = hashes.stretches(first, last + depth)
                half = (depth - digit) // 2
                left, right = suffix - first >= half, suffix - last < half
                side = np.where(left, suffix - half, suffix), np.where(right, suffix + digit + half, suffix + digit)
                yield pa.RecordBatch.from_arrays(
                    [
                        _i64(hashes.stretches(suffix, suffix + digit)),
                        _i64(surroundings + (suffix - first).astype(np.uint64) * np.uint64(_MIX)),
                        _i64(np.where(left, hashes.stretches(side[0], suffix + digit), np.uint64(0))),
                        _i64(np.where(right, hashes.stretches(suffix, side[1]), np.uint64(0))),
                        pa.array(k1[doc]),
                        pa.array(k2[doc]),
                        pa.array(first + begin - bounds[doc]),
                        pa.array((last - first).astype(np.int32)),
                        pa.array((suffix - first).astype(np.int32)),
                    ],
                    ["g", "s", "l", "r", "k1", "k2", "first", "more", "off"],
                )

    return run


def _windows(depth: int):
    """Rows (k1, k2, text, spans of (g, first, more, off, n)): a row for each window of the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=_PIECE):
            for row in batch.to_pylist():
                raw = np.frombuffer(row["text"].encode(), np.uint8)
                spans = sorted(row["spans"], key=lambda x: x["first"])
                for _, near in groupby(spans, key=lambda x: x["first"] // _SPREAD):
                    part = list(near)
                    first = np.array([x["first"] for x in part], np.int64)
                    begin_at = int(first[0])
                    hashes = Rolling(raw[begin_at : begin_at + _SPREAD + 2 * depth], 0)
                    count = np.array([x["more"] for x in part], np.int64) + 1
                    which = np.repeat(np.arange(len(part)), count)
                    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    begin = first[which] + step
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array([x["g"] for x in part], np.int64)[which]),
                            _i64(hashes.stretches(begin - begin_at, begin - begin_at + depth)),
                            pa.array(np.array([x["n"] for x in part], np.int64)[which]),
                            pa.array(np.full(len(which), row["k1"], np.int64)),
                            pa.array(np.full(len(which), row["k2"], np.int64)),
                            pa.array(begin),
                        ],
                        ["g", "h", "n", "k1", "k2", "at"],
                    )

    return run


def repeated_spans(docs: DataFrame, stages: Stages, depth: int = DEPTH) -> DataFrame:
    """(k1, k2, start, end): byte stretches of the document with that key, each covered by repeated windows.

    The stretches may touch and overlap; a document of fewer than ``depth`` bytes has none. Rows that repeat a
    document count as further documents, so their windows occur elsewhere.
    """
    k1, k2 = row_key(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), whole().alias("text"))
    reach = rows.where(F.octet_length("text") >= depth).mapInArrow(
        _reaches(depth), "g long, s long, l long, r long, k1 long, k2 long, first long, more int, off int"
    )
    shared = reach.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g")
    shared = stages.keep(shared, "shared")
    live = stages.keep(reach.join(shared, "g"), "first_digit")
    reaches = live.groupBy("g", "s").agg(
        F.count(F.lit(1)).alias("n"), F.min("l").alias("l"), F.min("r").alias("r"),
        F.min(F.struct("k1", "k2", "first", "more", "off")).alias("one"),
    )
    reaches = stages.keep(reaches, "reaches")
    alike = live.join(reaches.where("n > 1").select("g", "s"), ["g", "s"])
    alike = alike.select("k1", "k2", F.col("first").alias("start"), (F.col("first") + F.col("more") + depth).alias("end"))
    half, sides = (depth - depth // 2) // 2, []
    for side in ("l", "r"):
        shared = reaches.where(F.col(side) != 0).groupBy("g", side).agg(F.count(F.lit(1)).alias("c"))
        shared = stages.keep(shared.where("c > 1").select("g", side), f"second_digit_{side}")
        sides.append(reaches.join(shared, ["g", side]).select("g", "n", "one.*"))
    # Windows by offset of the suffix in them: from half on they hold the left side, below it the right one.
    left = sides[0].withColumn("more", F.least(F.col("more"), F.col("off") - half))
    skip = F.greatest(F.lit(0), F.col("off") - (half - 1))
    right = sides[1].withColumns({"first": F.col("first") + skip, "more": F.col("more") - skip, "off": F.col("off") - skip})
    wanted = left.unionByName(right).groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "first", "more", "off", "n")).alias("spans"))
    windows = rows.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).mapInArrow(
        _windows(depth), "g long, h long, n long, k1 long, k2 long, at long"
    )
    windows = stages.keep(windows, "last_digit")
    twice = windows.groupBy("g", "h").agg(F.sum("n").alias("t")).where("t > 1").select("g", "h")
    twice = stages.keep(twice, "twice")
    single = windows.where("n = 1").join(twice, ["g", "h"])
    single = single.select("k1", "k2", F.col("at").alias("start"), (F.col("at") + depth).alias("end"))
    return alike.union(single)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            raw = text.encode()
            runs: list[list[int]] = []
            for a, b in sorted(zip(starts or (), ends or (), strict=True)):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            left = [0, *(b for _, b in runs)]
            kept = b"".join(raw[a:b] for a, b in zip(left, [*(a for a, _ in runs), len(raw)], strict=True))
            spans = ",".join(f"{a}:{b}" for a, b in runs)
            out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), spans))
        cols = [list(x) for x in zip(*out, strict=True)]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def remove_repeats(docs: DataFrame, stages: Stages, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs`` (doc_id, text).

    Every byte inside a ``depth``-byte string that also starts elsewhere (same document or another, repeated rows
    included) is removed; strings are judged on the input. A null text is empty; null and repeated ids stay rows;
    an empty table gives none; other columns are not read. ``spans`` lists the removed runs as start:end in bytes.
    """
    found = repeated_spans(docs, stages, depth)
    found = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    k1, k2 = row_key(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long"), whole().alias("text"))
    rows = rows.join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans.start", "spans.end")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    return rows.mapInArrow(_cut, schema)
