"""A Merkle manifest of documents, one tree for each language and one above them, with persistent versions.

Leaves are placed by a range shuffle. Aligned blocks of 1024 nodes are hashed a task each, their tops are the nodes
of the next round, and so on up; siblings found on the way are handed down once a block, not once a document. A
tampered leaf makes a version of the tree: in its block it copies the leaf's ancestors and shares every other
node; above the block the version goes on row by row, with the siblings of the block, until its own root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.llm.common import Stages

# Nodes of a block: 2 ** BITS.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TREE = ["none", "lang"]


def node(children: list[bytes]) -> bytes:
    """The digest above ``children``, which are hashed as hexadecimal text one after another."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def record(columns: list[Column]) -> Column:
    """What a leaf hashes: each value's count of UTF-8 bytes, a colon and the value, or ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def leaves(docs: DataFrame) -> DataFrame:
    """(none, lang, doc_id, digest, changed): a leaf for every row, and its tampered one (null where none is made).

    ``changed`` hashes n_chars + 1 where 7 divides the crc32 of the decimal doc_id; a null n_chars stays null, so
    that the tampered leaf equals the leaf, and a null doc_id is not tampered with.
    """
    more = F.try_add(docs["n_chars"], F.lit(1))
    own = [docs[c] for c in FIELDS]
    other = [more if c == "n_chars" else docs[c] for c in FIELDS]
    tampered = F.crc32(docs["doc_id"].cast("string")) % 7 == 0
    return docs.select(
        docs["lang"].isNull().alias("none"),
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"),
        docs["doc_id"].cast("long").alias("doc_id"),
        F.unhex(F.sha2(record(own), 256)).alias("digest"),
        F.when(tampered, F.unhex(F.sha2(record(other), 256))).alias("changed"),
    )


def _numbered(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True)):
                last, count = (key, count) if key == last else (key, 0)
                at[i] = count
                count += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at)],
                [*batch.schema.names, "part", "at"],
            )

    return run


def placed(rows: DataFrame, keys: list[str], order: list[Column], stages: Stages, name: str) -> DataFrame:
    """``rows`` with ``at``, the place by ``order`` among those of equal ``keys`` (sorted first), and ``n``, their number.

    Rows are dealt by range of keys and order, equal ones by their place in the table, and counted a partition;
    one row for each partition and key in it carries the counts on.
    """
    by = [*order, F.monotonically_increasing_id()]
    dealt = rows.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    dealt = stages.keep(dealt.mapInArrow(_numbered(keys), schema), name)
    counts = dealt.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy(*keys).orderBy("part")
    before = F.coalesce(F.sum("c").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select(*keys, "part", before.alias("before"), F.sum("c").over(every).alias("n"))
    return dealt.join(counts, [*keys, "part"]).withColumn("at", F.col("at") + F.col("before")).drop("part", "before")


def _block(bits: int, versions: bool):
    """Of a block's nodes: siblings level by level (empty: none), the block's top, and what a changed node copies."""
    size = 1 << bits

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        n = int(rows["n"].iloc[0])
        height = bits if n > size else (n - 1).bit_length()
        levels = [list(rows["digest"])]
        for _ in range(height):
            below = levels[-1]
            levels.append([node(below[i : i + 2]) for i in range(0, len(below), 2)])
        paths = [
            [level[other] if (other := (j >> i) ^ 1) < len(level) else b"" for i, level in enumerate(levels[:-1])]
            for j in range(len(rows))
        ]
        out = rows.assign(path=paths, top=[levels[-1][0]] * len(rows))
        if versions:
            out["copies"] = [
                None if new is None else copies(new, j, path)
                for j, (new, path) in enumerate(zip(rows["changed"], paths, strict=True))
            ]
        return out

    return run


def copies(digest: bytes, at: int, path: list[bytes]) -> list[bytes]:
    """The ancestors of a node at place ``at`` whose siblings are ``path``, lowest first."""
    out = []
    for level, other in enumerate(path):
        digest = node([other, digest] if at >> level & 1 else [digest, other])
        out.append(digest)
    return out


def climb(nodes: DataFrame, keys: list[str], stages: Stages, name: str, bits: int = BITS, versions: bool = False) -> DataFrame:
    """``nodes`` (keys, at, n, digest, ...) with path, the siblings up to the root of their tree, and top, that root.

    With ``versions`` also copies: the ancestors that the node ``changed`` copies in its block (null: not changed).
    A round hashes the blocks of one size; as many rounds as the largest tree has levels, divided by ``bits``.
    """
    spread = T.ArrayType(T.BinaryType())
    size, rounds, now = 1 << bits, [], nodes
    while True:
        first = versions and not rounds
        fields = [*now.schema.fields, T.StructField("block", T.LongType()), T.StructField("path", spread), T.StructField("top", T.BinaryType())]
        schema = T.StructType([*fields, *([T.StructField("copies", spread)] if first else [])])
        blocks = now.withColumn("block", F.shiftright("at", bits)).groupBy(*keys, "block")
        blocks = stages.keep(blocks.applyInPandas(_block(bits, first), schema), f"{name}-{len(rounds)}")
        rounds.append(blocks)
        most = blocks.agg(F.max("n")).first()[0]
        if most is None or most <= size:
            break
        now = blocks.where((F.col("at") % size == 0) & (F.col("n") > size))
        now = now.select(*keys, F.col("block").alias("at"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("digest"))
    found = rounds.pop()
    while rounds:
        above = found.select(*keys, F.col("at").alias("block"), F.col("path").alias("_path"), F.col("top").alias("_top"))
        found = rounds.pop().join(above, [*keys, "block"], "left")
        path = F.concat("path", F.coalesce("_path", F.array().cast("array<binary>")))
        found = found.withColumns({"path": path, "top": F.coalesce("_top", "top")}).drop("_path", "_top")
    return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        proofs, folded, versions = [], [], []
        for i, (digest, at, path, own, tree_at, tree_path) in enumerate(
            zip(col["digest"], col["at"], col["path"], col["copies"], col["tree_at"], col["tree_path"], strict=True)
        ):
            proofs.append(node([*path, *tree_path]))
            # A version goes on above its block; an untouched leaf is folded from the bottom.
            done = len(own) if own is not None else 0
            start = own[-1] if own else (col["changed"][i] if own is not None else digest)
            upper = copies(start, at >> done, path[done:])
            last = upper[-1] if upper else start
            above = copies(last, tree_at, tree_path)
            folded.append(above[-1] if above else last)
            versions.append(None if own is None else [*own, *upper, *above])
        root = col["root"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(col["doc_id"], pa.int64()),
                *(pa.array([x.hex() for x in xs], pa.string()) for xs in (col["digest"], col["top"], root, proofs, folded)),
                pa.array([x == y for x, y in zip(folded, root, strict=True)], pa.bool_()),
                pa.array(versions, pa.list_(pa.binary())),
            ],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "version"],
        )


def manifest(docs: DataFrame, stages: Stages, bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, version): one row for each of ``docs``.

    subroot is the root of the row's language, root the one above all languages (null first, then by bytes).
    proof_sha256 hashes the siblings from the leaf to root; folded_root is recomputed from the tampered leaf, else the
    leaf; version holds the nodes that the tampered leaf's version copies, lowest first (null: no version), all other
    nodes are those of the untampered tree. Leaves ascend by doc_id, nulls first; where an id repeats, by their digest.
    Repeated rows are leaves of their own; no rows give none; columns besides doc_id, source, lang, n_chars and text
    are not read. A tree of one node is that node.
    """
    rows = stages.keep(leaves(docs), "leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    # the null language is sorted after the empty one here: places are counted inside each
    nodes = placed(rows, _TREE, order, stages, "placed")
    nodes = climb(nodes, _TREE, stages, "blocks", bits, versions=True)
    trees = nodes.where("at = 0").select(*_TREE, F.col("top").alias("digest")).withColumn("all", F.lit(0))
    trees = stages.keep(trees, "trees")
    trees = placed(trees, ["all"], [F.col("none").desc(), F.col("lang")], stages, "placed-trees")
    trees = climb(trees, ["all"], stages, "tree-blocks", bits)
    trees = trees.select(
        *_TREE, F.col("at").alias("tree_at"), F.col("path").alias("tree_path"), F.col("top").alias("root")
    )
    found = nodes.join(trees, _TREE).select(
        "doc_id", "digest", "changed", "at", "path", "top", "copies", "tree_at", "tree_path", "root"
    )
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, version array<binary>"
    return found.mapInArrow(_verify, schema)
