"""Ranked search of documents, term at a time with limited accumulators.

Texts are counted once into vectors of the asked terms. Vectors are searched shard by shard, in the task that holds
them: an item's terms come rarest first, each adds its share to the accumulators of the documents in its posting
list. As soon as all that the remaining terms can add lies below the k-th best partial score, no new accumulators are
made; those there are go on to be updated, so that every score given out is exact. The best of the shards are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import Stages, slices, whole

TOP = 10
# Rows of (item, term) asked in one pass over the documents; items are dealt to as many passes as that takes.
ASKED = 500_000
# A shard ends after so many postings or documents.
POSTINGS, DOCUMENTS = 1 << 20, 1 << 16
_CHUNK = 4 << 20
# Separators become spaces, A-Z small letters; bytes above 127 belong to terms.
_FOLD = bytes(
    c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of a few megabytes."""
    data, start = text.encode().translate(_FOLD), 0
    while start < len(data):
        end = data.find(b" ", start + _CHUNK)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys, out, tf = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found: Counter = Counter()
            for some in terms(text):
                found.update(some)
            keys += [key] * len(found)
            out += found
            tf += found.values()
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(out, pa.binary()), pa.array(tf, pa.int64())], ["item", "term", "qtf"]
        )


def _vectors(place: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sizes, n, found, tf = [], [0], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count, own = 0, Counter()
                for some in terms(text):
                    count += len(some)
                    own.update(map(place.get, some))
                if not count:
                    continue
                own.pop(None, None)
                ids.append(doc_id)
                n.append(count)
                found += own
                tf += own.values()
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(found, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(tf, pa.int64())),
                ],
                ["doc_id", "n", "terms", "tf"],
            )

    return run


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 100 - 75 + (75 * n * documents) // total


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def best(query: list[tuple[int, int]], lists: dict, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``top`` documents of a shard for ``query``: pairs of term and factor, rarest first.

    ``lists``: documents, shares and the largest share of each term. Equal scores are told apart by ``ids``.
    """
    query = [(t, w) for t, w in query if w > 0 and t in lists]
    left = sum(w * lists[t][2] for t, w in query)
    score = np.zeros(len(ids), np.int64)
    open_, alive = True, None
    for t, w in query:
        where, share, most = lists[t]
        left -= w * most
        if open_:
            score[where] += w * share
            # What remains can lift no new document to the k-th best: no more accumulators.
            if len(where) and left < score.max():
                there = score[score > 0]
                if len(there) >= top and left < np.partition(there, -top)[-top]:
                    open_, alive = False, score > 0
        else:
            here = alive[where]
            score[where[here]] += w * share[here]
    found = np.flatnonzero(score)
    if len(found) > top:
        found = found[score[found] >= np.partition(score[found], -top)[-top]]
    found = found[np.lexsort((ids[found], -score[found]))][:top]
    return found, score[found]


def _search(queries: list[tuple[int, list[tuple[int, int]]]], documents: int, total: int, top: int):
    last = np.iinfo(np.int64).max

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        raw = table["doc_id"].combine_chunks()
        ids = raw.fill_null(last).to_numpy(zero_copy_only=False)
        m = length_norm(table["n"].to_numpy(), documents, total)
        own, tfs = (table[c].combine_chunks() for c in ("terms", "tf"))
        where = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(own.offsets.to_numpy()))
        term, tf = own.flatten().to_numpy(), tfs.flatten().to_numpy()
        order = np.argsort(term, kind="stable")
        where, term, tf = where[order], term[order], tf[order]
        share = (1_000_000_000 * tf) // (1000 * tf + 8 * m[where])
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        lists = {
            int(term[a]): (where[a:b], share[a:b], int(share[a:b].max()))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True)
        }
        items, at, scores = [], [], []
        for item, query in queries:
            found, score = best(query, lists, ids, top)
            items.append(np.full(len(found), item))
            at.append(found)
            scores.append(score)
        doc_id = raw.take(pa.array(np.concatenate(at)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(items).astype(np.int64)), doc_id, pa.array(np.concatenate(scores).astype(np.int64))],
            ["item", "doc_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, rows = [], 0, 0
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64)
            edges = [0, *(np.flatnonzero(np.diff(sizes // POSTINGS)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                if end > start:
                    held.append(batch.slice(start, end - start))
                    postings += int(sizes[end - 1] - (sizes[start - 1] if start else 0))
                    rows += end - start
                if postings >= POSTINGS or rows >= DOCUMENTS:
                    yield shard(held)
                    held, postings, rows = [], 0, 0
        if held:
            yield shard(held)

    return run


def search(docs: DataFrame, items: DataFrame, stages: Stages, top: int = TOP, asked: int = ASKED) -> DataFrame:
    """(item_id, rank, doc_id, score): for each of ``items`` (item_id, text) its ``top`` best of ``docs`` (doc_id, text).

    Terms are runs of ASCII letters, digits and everything beyond ASCII, A-Z in lower case, of whole texts. Scores are
    integers above zero; equal ones are ranked by ascending doc_id, null ids last. Null and empty texts have no terms
    and are found by nothing; repeated rows and ids of ``docs`` are documents of their own; rows of ``items`` equal in
    id and text count once; no documents or no items give no rows; other columns are not read. An item is held whole
    with its terms, as is each text; no other step holds more than a shard.
    """
    spark = stages.spark
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole(docs["text"]).alias("text"))
    items = items.select(items["item_id"].cast("long").alias("item_id"), whole(items["text"]).alias("text")).distinct()
    items = stages.keep(items.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "text")), "items")
    wanted = stages.keep(items.select("item", "text").mapInArrow(_counted, "item long, term binary, qtf long"), "asked")
    passes = -(-wanted.count() // asked)
    found, documents, total = None, 0, 0
    for number in range(passes):
        # At most about ``asked`` rows: the items are dealt to the passes by a hash.
        own = wanted.where(F.pmod("item", F.lit(passes)) == number).toPandas()
        place = {t: i for i, t in enumerate(sorted(set(own["term"])))}
        vectors = rows.mapInArrow(_vectors(place), "doc_id long, n long, terms array<int>, tf array<long>")
        vectors = stages.keep(vectors, f"vectors-{number}")
        if number == 0:
            documents, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").count()
        weights = {t: weight(documents, df) for t, df in counts.toPandas().itertuples(index=False)}  # a row a term of the pass
        queries: dict[int, list[tuple[int, int]]] = {}
        for item, term, qtf in own.itertuples(index=False):
            if (t := place[term]) in weights:
                queries.setdefault(item, []).append((t, qtf * weights[t]))
        plan = [(i, sorted(q, key=lambda x: (-weights[x[0]], x[0]))) for i, q in sorted(queries.items())]
        if not plan:
            continue
        some = vectors.mapInArrow(_search(plan, documents, total, top), "item long, doc_id long, score long")
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # The shards' best meet in parts first, so that an item's last sort doesn't grow with their number.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part")
    found = found.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    found = found.where(F.col("rank") <= top).drop("part")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    found = found.where(F.col("rank") <= top)
    return found.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
