"""SimHash near-duplicates: fingerprints of word shingles, linked by searches of BK-trees.

The forest has one set of trees for each value of each 16-bit block of the fingerprint; a tree larger than
``TREE`` is dealt into shards. Every fingerprint visits the shards of its own block values only, following
edges within the radius. With a radius below the number of blocks (3 of 64 bits) a linked pair agrees in some
block, and no link is lost.

Bits only estimate a similarity. Near copies by similarity are therefore found and measured on the shingles
themselves: of two sets at 0.8 or more, put in any one order, the first fifths share a shingle, so documents meet at
these, and the Jaccard similarity of those that meet is counted. Neither step loses or adds a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import Stages, classes, row_key, slices, whole

RADIUS = 3
WORDS = 3
BITS = 64
# For near copies by similarity: the Jaccard similarity of sets of five-word shingles.
SIMILAR = {"words": 5, "similarity": 0.8}
TREE = 4096
# Members of a shared shingle that meet all others in the first round, and how many times more do after each further one.
HUBS, MORE = 4, 4
# One document in so many is looked at for common shingles, at most so many of which come last in the order.
SAMPLE, COMMON = 16, 200_000
# Numbers a set is summed up in, for a bound on what two sets share: enough to tell strangers of some 3000 shingles apart.
MARKS = 128
# So many keys of documents (16 bytes each) are broadcast; more are met by a shuffle.
BROADCAST_ROWS = 1_000_000
_BLOCK = 2
_SEED = 42
_VOTES = 1 << 16


def simhash(text: str, words: int = WORDS, bits: int = BITS) -> int:
    """Majority vote over the bits of the shingles' hashes (XXH64, for more bits XXH3-128); zero without words."""
    found = text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        shingles = [line]
    else:
        size = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: len(found) - words + 1].tolist()
        shingles = [line[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    votes = np.zeros(bits, np.int64)
    for at in range(0, len(shingles), _VOTES):
        part = shingles[at : at + _VOTES]
        if bits == 64:
            digests = [[xxhash.xxh64_digest(x, _SEED) for x in part]]
        else:
            digests = [[xxhash.xxh3_128_digest(x, _SEED + i) for x in part] for i in range(bits // 128)]
        rows = [np.frombuffer(b"".join(d), np.uint8).reshape(len(part), -1) for d in digests]
        votes += np.concatenate([np.unpackbits(r, axis=1).sum(axis=0, dtype=np.uint32) for r in rows])
    return int.from_bytes(np.packbits(votes * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, fp, node) of every row; a null or empty text has fingerprint zero.

    ``fp`` holds the bits, highest first; ``node`` is a number for it: itself, or a hash of more than 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [simhash(t, words, bits).to_bytes(bits // 8, "big") for t in batch.column("text").to_pylist()]
            nodes = prints if bits == 64 else [xxhash.xxh3_64_digest(p) for p in prints]
            numbers = np.frombuffer(b"".join(nodes), ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(prints, pa.binary()), pa.array(numbers)], ["k1", "k2", "doc_id", "fp", "node"]
            )

    k1, k2 = row_key(docs, text_col=text_col)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long, fp binary, node long")


class BKTree:
    """Distinct fingerprints; children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.root = None

    def near(self, value: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            own, children = stack.pop()
            far = (own ^ value).bit_count()
            if far <= radius:
                found.append(own)
            for edge in range(far - radius, far + radius + 1):
                if edge in children:
                    stack.append(children[edge])
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while far := (node[0] ^ value).bit_count():
            if far not in node[1]:
                node[1][far] = (value, {})
                return
            node = node[1][far]


def _linked(radius: int):
    """Rows (key, shard, visitor, node, fp) in this order: builds each tree, then lets the visitors search it.

    Gives a spanning forest of the links that were found, not all of them: at most one a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, up, number = None, BKTree(), {}, {}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            left, right = [], []
            for key, shard, visit, node, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (key, shard):
                    at, tree, up, number = (key, shard), BKTree(), {}, {}
                value = int.from_bytes(fp, "big")
                near = tree.near(value, radius)
                if visit:
                    if near:
                        left.append(node)
                        right.append(number[near[0]])
                    value = near[0] if near else value
                else:
                    tree.add(value)
                    up[value], number[value] = value, node
                for other in near:
                    a, b = top(value), top(other)
                    if a != b:
                        left.append(number[a])
                        right.append(number[b])
                        up[max(a, b)] = min(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, bits: int = BITS, tree: int = TREE) -> DataFrame:
    """(a, b): links between distinct fingerprints (node, fp) at ``radius`` or fewer bits; a spanning forest for each tree."""
    blocks = [F.concat(F.lit(f"{i}:"), F.hex(F.substring("fp", i * _BLOCK + 1, _BLOCK))) for i in range(bits // 8 // _BLOCK)]
    rows = prints.select("node", "fp", F.explode(F.array(*blocks)).alias("key"))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree)
    large = large.select("key", F.ceil(F.col("n") / tree).alias("shards"))
    rows = rows.join(large, "key", "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("shards", F.lit(1).cast("long")))
    rows = rows.select("key", "node", "fp", own.alias("own"))
    rows = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("shard"), "own", "node", "fp")
    rows = rows.select("key", "shard", (F.col("own") != F.col("shard")).cast("int").alias("visit"), "node", "fp")
    rows = rows.repartition("key", "shard").sortWithinPartitions("key", "shard", "visit", "node")
    return rows.mapInArrow(_linked(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, stages: Stages, radius: int = RADIUS, words: int = WORDS, bits: int = BITS
) -> DataFrame:
    """(k1, k2, doc_id, fp, component_id, root) of every row: the smallest doc_id among the documents linked to it.

    Equal texts share a fingerprint and so a class; texts without words share fingerprint zero, linked like any
    other. A null doc_id is no smallest id unless a class has no other; no rows give no rows; repeated rows stay.
    Other columns of ``docs`` are not read.
    """
    prints = stages.keep(fingerprints(docs, words, bits), "prints")
    distinct = prints.groupBy("node", "fp").agg(F.min("doc_id").alias("least"))
    roots = classes(links(distinct.select("node", "fp"), radius, bits), stages)
    grouped = distinct.drop("fp").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    grouped = stages.keep(grouped, "grouped")
    least = stages.keep(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stages.keep(grouped.join(least, "root").select("node", "component_id", "root"), "named")
    return prints.join(named, "node").select("k1", "k2", "doc_id", "fp", "component_id", "root")


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a text of fewer words is one shingle, one without words none."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.int64)
    hashes = np.zeros(max(len(found), words), np.uint64)
    hashes[: len(found)] = [xxhash.xxh3_64_intdigest(w) for w in found]
    mixed = np.zeros(len(hashes) - words + 1, np.uint64)
    for i in range(words):
        mixed = (mixed ^ hashes[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def _least_shared(n: int, similarity: float) -> int:
    """Of a set's ``n`` shingles those that a set at ``similarity`` has, at least."""
    return math.ceil(similarity * n - 1e-9)


def _among(own: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``own`` are in the sorted ``some``: searched one by one, so that a set costs little however many ``some`` are."""
    if not len(some):
        return np.zeros(len(own), bool)
    return some[np.minimum(np.searchsorted(some, own), len(some) - 1)] == own


def _sets(words: int, similarity: float = 0, common: Broadcast | None = None):
    """Rows (.., text) to (.., node, n, rare, set): node is a hash of the set, zero without words.

    With ``common``, only the part of the set at which similar ones meet, those shingles last; rare is the share of others
    in hundredths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, sizes, rare, sets = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, words)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else 0)
                sizes.append(len(own))
                rare.append(0)
                if common is not None and len(own):
                    last = _among(own, common.value)
                    rare[-1] = round(100 - 100 * float(last.mean()))
                    own = np.concatenate([own[~last], own[last]])[: len(own) - _least_shared(len(own), similarity) + 1]
                sets.append(own)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets))
            cols = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32())]
            cols.append(pa.ListArray.from_arrays(pa.array(ends), flat))
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *cols], [*batch.schema.names[:at], "node", "n", "rare", "set"])

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, .., set) to (node, set, mark): how many of the set fall to each of ``MARKS`` places, up to 255."""
    for batch in batches:
        where = batch.schema.get_field_index
        sets = batch.column(where("set"))
        sizes = np.diff(sets.offsets.to_numpy())
        place = np.repeat(np.arange(len(sizes)) * MARKS, sizes) + (sets.flatten().to_numpy() & (MARKS - 1))
        marks = np.bincount(place, minlength=len(sizes) * MARKS).clip(max=255).astype(np.uint8).tobytes()
        marks = [marks[i : i + MARKS] for i in range(0, len(marks), MARKS)]
        yield pa.RecordBatch.from_arrays([batch.column(where("node")), sets, pa.array(marks, pa.binary())], ["node", "set", "mark"])


def _likely(similarity: float):
    """Of rows (a, b, na, nb, mark_a, mark_b) those that can be at ``similarity``, without marks: sets differ in as many
    shingles at least as their marks do, so no pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, MARKS) for i in (4, 5))
            differ = np.abs(a.astype(np.int16) - b).sum(axis=1)
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            kept = differ * (1 + similarity) <= (1 - similarity) * both + 1e-6
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(kept))

    return run


def _met_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their key those whose key comes more than once (and some at the ends of batches)."""
    for batch in batches:
        if batch.num_rows:
            keys = batch.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            some = np.r_[True, same] | np.r_[same, True]
            some[-1] = True  # the batch's first and last row may go with those before and after it
            yield batch.filter(pa.array(some))


def _meetings(first: int, last: int, similarity: float):
    """Rows (key, node, n, rest, root) in one order within each key: its members ``first`` to ``last`` - 1 meet all later ones.

    (a, b, na, nb) of those that meet, if their roots differ and the similarity is possible when this key is the first they
    share: then they have no more in common than the smaller ``rest``, the shingles from there on. (key, null..) of keys with
    members that have not met all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rank, hubs = None, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for key, node, n, rest, root in zip(*(c.to_numpy().tolist() for c in batch.columns), strict=True):
                if key != now:
                    now, rank, hubs = key, 0, []
                for node2, n2, rest2, root2 in hubs:
                    if root != root2 and min(rest, rest2) * (1 + similarity) + 1e-9 >= similarity * (n + n2):
                        out.append((node2, node, n2, n))
                if first <= rank < last:
                    hubs.append((node, n, rest, root))
                elif rank == last + 1:
                    out.append((key, None, None, None))
                rank += 1
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "na", "nb"])

    return run


def _joined(roots: DataFrame, links: DataFrame, stages: Stages, name: str) -> DataFrame:
    """(node, root): the classes ``roots`` after the links (a, b) more. Only links between two classes are contracted."""
    for end in ("a", "b"):
        links = links.join(roots.toDF(end, "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    own = classes(links, stages, f"stars-{name}").toDF("root", "above")
    moved = roots.join(own, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return stages.keep(moved.union(own).distinct(), f"roots-{name}")


def similar_copies(
    docs: DataFrame, stages: Stages, words: int, similarity: float, known: DataFrame | None = None
) -> DataFrame:
    """(k1, k2, doc_id, node, root) of every row: classes of the links between texts at ``similarity`` or more.

    That is the Jaccard similarity of the sets of shingles; all texts without words are one class. Members of a large
    group meet a few of it first, and those found alike by then need not meet each other. Nor do those that have one
    root in ``known`` (k1, k2, root): its classes hold as well.
    """
    spark = docs.sparkSession
    k1, k2 = row_key(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long"), whole().alias("text"))
    kinds = "node long, n int, rare int, set array<long>"

    def some(df: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
        """Rows of ``df`` with the keys in ``chosen``: broadcast up to a number of rows, else by a shuffle."""
        return df.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen, by, "left_semi")

    # Any order of the shingles finds all: that the common ones are those of a sample only saves meetings.
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    often = sample.mapInArrow(_sets(words), kinds).select(F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    often = often.where("c >= 4").orderBy(F.desc("c"), "s").limit(COMMON).select("s").toPandas()["s"]
    common = spark.sparkContext.broadcast(np.sort(often.to_numpy(np.int64)))
    prints = rows.mapInArrow(_sets(words, similarity, common), "k1 long, k2 long, doc_id long, " + kinds)
    prints = stages.keep(prints, "prints")
    nodes = prints.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("rep"), *(F.first(c).alias(c) for c in ("n", "rare", "set")))
    keys = nodes.select("node", "n", "rare", "rep", F.posexplode("set").alias("at", "key"))
    keys = keys.select("key", "node", "n", (F.col("n") - F.col("at")).alias("rest"), "rare", "rep.k1", "rep.k2")
    # Most shingles stand alone and move this once only.
    met = keys.repartition("key").sortWithinPartitions("key")
    kinds_of_key = "key long, node long, n int, rest int, rare int, k1 long, k2 long"
    keys = stages.keep(met.mapInArrow(_met_twice, kinds_of_key), "keys")
    chosen = keys.select("k1", "k2").distinct()
    sets = some(rows, chosen, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text").mapInArrow(_sets(words), kinds)
    sets = stages.keep(sets.select("node", "set").mapInArrow(_marked, "node long, set array<long>, mark binary"), "sets")
    open_keys, roots, first, last = keys.withColumn("root", F.col("node")), None, 0, HUBS
    if known is not None:
        named = prints.select("k1", "k2", "node").distinct().join(known.select("k1", "k2", "root").distinct(), ["k1", "k2"])
        least = named.groupBy("root").agg(F.min("node").alias("b"))
        found = named.join(least, "root").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
        roots = stages.keep(classes(found, stages, "stars-known"), "roots-known")
        open_keys = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    while True:
        # a group's original holds what its copies share: it comes before them
        met = open_keys.repartition("key").sortWithinPartitions("key", "rare", "node").select("key", "node", "n", "rest", "root")
        met = met.mapInArrow(_meetings(first, last, similarity), "a long, b long, na long, nb long")
        met = stages.keep(met, f"met-{first}")
        pairs = stages.keep(met.where("b is not null").distinct(), f"pairs-{first}")
        # most that meet are strangers who share a phrase, the more the larger the corpus: their sets need not move
        chosen = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        marks = some(sets.select("node", "mark"), chosen, ["node"])
        both = pairs.join(marks.toDF("a", "mark_a"), "a").join(marks.toDF("b", "mark_b"), "b")
        both = both.select("a", "b", "na", "nb", "mark_a", "mark_b")
        likely = stages.keep(both.mapInArrow(_likely(similarity), "a long, b long, na long, nb long"), f"likely-{first}")
        chosen = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        own = some(sets.select("node", "set"), chosen, ["node"])
        both = likely.join(own.toDF("a", "set_a"), "a").join(own.toDF("b", "set_b"), "b")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        links = both.where(shared + 1e-9 >= similarity * (F.col("na") + F.col("nb") - shared)).select("a", "b")
        links = stages.keep(links, f"links-{first}")
        if roots is None:
            roots = stages.keep(classes(links, stages, f"stars-{first}"), f"roots-{first}")
        elif not links.isEmpty():
            roots = _joined(roots, links, stages, str(first))
        left = keys.join(met.where("b is null").select(F.col("a").alias("key")), "key", "left_semi")
        left = left.join(roots, "node", "left").select("key", "node", "n", "rest", "rare", F.coalesce("root", "node").alias("root"))
        left = stages.keep(left, f"left-{first}")
        # done with: keys whose members are all of one root, but for those too far on to be like even the smallest
        able = left.join(left.groupBy("key").agg(F.min("n").alias("least")), "key")
        able = able.where(F.col("rest") * (1 + similarity) + 1e-9 >= similarity * (F.col("n") + F.col("least")))
        several = able.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
        before, open_keys = f"open-{last}", stages.keep(left.join(several, "key", "left_semi"), f"open-{last * MORE}")
        stages.drop(f"met-{first}", f"pairs-{first}", f"likely-{first}", f"left-{first}", before)
        if open_keys.isEmpty():
            stages.drop("keys", "sets")
            return prints.join(roots, "node", "left").select("k1", "k2", "doc_id", "node", F.coalesce("root", "node").alias("root"))
        first, last = last, last * MORE


def keep_first(
    docs: DataFrame,
    stages: Stages,
    radius: int = RADIUS,
    words: int = WORDS,
    bits: int = BITS,
    similarity: float | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with one row of each class: the smallest doc_id (nulls last; ties: by a hash of the text, then any).

    With a ``similarity``, classes are those of ``similar_copies`` (and ``known``); else they are linked by fingerprints.
    """
    if similarity is None:
        found = near_duplicates(docs, stages, radius, words, bits)
    else:
        found = similar_copies(docs, stages, words, similarity, known)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "k1", "k2")).alias("f")).select("f.k1", "f.k2")
    k1, k2 = row_key(docs)
    names = ("_llm_k1", "_llm_k2")
    kept = docs.withColumns(dict(zip(names, (k1, k2), strict=True)))
    kept = kept.join(first.toDF(*names), list(names), "left_semi")
    return kept.dropDuplicates(list(names)).select(*docs.columns)
