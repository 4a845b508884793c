"""Document fingerprints by SimHash, and their search by permuted block tables: DataFrame functions only.

Terms are pairs of neighbouring words, weighted by their length; each votes with its weight for the bits of its
hash, and a fingerprint bit is one where more than half of the weight voted for it. Two votes share a 64-bit sum.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import Stages, row_key, whole

RADIUS = 3
_SPACE = r"[\x20\x09-\x0D]+"
_PAIR = (1 << 32) + 1
_HALF = (1 << 32) - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _terms(text: Column) -> Column:
    """Structs (a, b) of neighbouring words; one word stands alone; a text without words has one empty pair."""
    words = _words(text)
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1)))
    return F.arrays_zip(words.alias("a"), rest.alias("b"))


def votes(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp, n): the fingerprint of ``text`` for each distinct combination of keys, and how many rows it has."""
    rows = df.select(*keys, F.posexplode_outer(_terms(F.col("text"))).alias("at", "t"))
    one = F.col("t.b").isNull()
    # The last word has a pair only where it is the first, too.
    counts = F.when(F.col("t.a").isNull() | one & (F.col("at") > 0), 0).otherwise(
        F.char_length("t.a") + F.coalesce(F.char_length("t.b"), F.lit(0))
    )
    rows = rows.select(
        *keys, F.coalesce("at", F.lit(0)).alias("at"), counts.cast("long").alias("w"), F.xxhash64("t.a", "t.b").alias("h")
    )
    sums = [
        F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_PAIR)) * F.col("w")).alias(f"s{i}") for i in range(32)
    ]
    found = rows.groupBy(*keys).agg(
        F.sum("w").alias("w"), F.sum((F.col("at") == 0).cast("long")).alias("n"), *sums
    )
    bits = [F.when(F.col(f"s{i}").bitwiseAND(F.lit(_HALF)) * 2 > F.col("w"), 1 << i).otherwise(0) for i in range(32)]
    bits += [
        F.when(F.shiftrightunsigned(F.col(f"s{i}"), 32) * 2 > F.col("w"), (1 << (32 + i)) - ((1 << 64) if i == 31 else 0)).otherwise(0)
        for i in range(32)
    ]
    fp = reduce(lambda x, y: x.bitwiseOR(y), (b.cast("long") for b in bits))
    return found.select(*keys, fp.alias("fp"), "n")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the share of differing bits stands for, zero where it is negative."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * (3.141592653589793 / 64)))


def search(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q, fp, bits): every fingerprint ``fp`` of ``prints`` at ``radius`` or fewer bits from a query's.

    Of radius + 2 blocks at least two agree; each pair of blocks, moved to the front, is the key of one table.
    """
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]

    def block(fp: str, i: int) -> Column:
        return F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    def tables(df: DataFrame, fp: str) -> DataFrame:
        keys = [
            F.struct(F.lit(k).alias("t"), (block(fp, i) * (1 << (edges[j + 1] - edges[j])) + block(fp, j)).alias("key"))
            for k, (i, j) in enumerate(combinations(range(blocks), 2))
        ]
        return df.select(fp, F.inline(F.array(*keys)))

    asked = tables(queries.select(F.col("fp").alias("q")).distinct(), "q")
    there = tables(prints.select("fp").distinct(), "fp")
    bits = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))).alias("bits")
    return asked.join(there, ["t", "key"]).select("q", "fp", bits).where(F.col("bits") <= radius).distinct()


def next_ids(docs: DataFrame, stages: Stages) -> DataFrame:
    """(none, id, next_none, next_id, half): each id's next by descending id (null last; after the last: the first).

    ``half`` is half the length of the id's longest text. Ids are dealt by range; one row a range finds the next range.
    """
    ids = docs.groupBy(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))
    ids = ids.agg(F.floor(F.max(F.char_length(whole())) / 2).cast("int").alias("half"))
    ids = ids.repartitionByRange(F.col("none"), F.col("id").desc()).withColumn("part", F.spark_partition_id())
    ids = stages.keep(ids, "ids")
    key, order = F.struct("none", "id"), [F.col("none"), F.col("id").desc()]
    first = ids.groupBy("part").agg(F.min(F.struct("none", (-F.col("id")).alias("minus"))).alias("f"))
    first = first.select("part", F.struct(F.col("f.none").alias("none"), (-F.col("f.minus")).alias("id")).alias("first"))
    # One row a partition.
    over = Window.orderBy("part")
    wrap = F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = first.select("part", F.coalesce(F.lead("first").over(over), wrap).alias("after"))
    ids = ids.withColumn("next", F.lead(key).over(Window.partitionBy("part").orderBy(*order)))
    ids = ids.join(F.broadcast(first), "part").withColumn("next", F.coalesce("next", "after"))
    return ids.select("none", "id", F.col("next.none").alias("next_none"), F.col("next.id").alias("next_id"), "half")


def compare_with_edits(docs: DataFrame, stages: Stages) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its text with the second half replaced.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near). The last
    floor(n_chars / 2) code points give way to the first as many, or all, of the next document's. n_near, for ids
    divisible by 100 (else null): distinct fingerprints within RADIUS bits, the own included. Null texts are empty
    and have fingerprint zero; null ids count as one id, the last; where an id repeats, the row with the smallest hash
    of its text is the next document; repeated rows stay; no rows give none; other columns are not read.
    """
    order = stages.keep(next_ids(docs, stages), "order")
    _, k2 = row_key(docs)
    none, number = docs["doc_id"].isNull(), F.coalesce(docs["doc_id"].cast("long"), F.lit(0))
    rows = docs.select(none.alias("none"), number.alias("id"), k2.alias("k2"), whole().alias("text"))
    wish = order.select(
        F.col("next_none").alias("none"), F.col("next_id").alias("id"), "half", F.col("none").alias("o_none"), F.col("id").alias("o_id")
    )
    found = rows.join(wish, ["none", "id"]).select("o_none", "o_id", F.struct("k2", F.expr("substring(text, 1, half)").alias("piece")).alias("p"))
    found = found.groupBy("o_none", "o_id").agg(F.min("p").alias("p"))
    found = found.select(F.col("o_none").alias("none"), F.col("o_id").alias("id"), F.col("p.k2").alias("next_k2"), F.col("p.piece").alias("piece"))
    both = rows.join(found, ["none", "id"])
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.ceil(n / 2)).cast("int")), F.substring(F.col("piece"), F.lit(1), F.floor(n / 2).cast("int")))
    both = both.select("none", "id", "k2", "next_k2", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    empty = F.lit(None).cast("binary")
    texts = F.array(
        F.struct(F.lit(0).alias("v"), F.col("text"), empty.alias("sha")),
        F.struct(F.lit(1).alias("v"), F.col("edited").alias("text"), F.unhex(F.sha2("edited", 256)).alias("sha")),
    )
    both = both.select("none", "id", "k2", "next_k2", "n_chars", F.inline(texts))
    prints = votes(both, ["none", "id", "k2", "next_k2", "n_chars", "v", "sha"])
    own = [F.max(F.when(F.col("v") == v, F.col("fp"))).alias(name) for v, name in ((0, "fp"), (1, "e_fp"))]
    prints = prints.groupBy("none", "id", "k2", "next_k2", "n_chars").agg(F.max("n").alias("n"), F.max("sha").alias("sha"), *own)
    prints = stages.keep(prints, "prints")
    nexts = prints.select(
        F.col("none").alias("next_none"), F.col("id").alias("next_id"), F.col("k2").alias("next_k2"), F.col("fp").alias("next_fp")
    )
    asked = prints.where("not none and id % 100 = 0")
    near = search(asked, prints).groupBy(F.col("q").alias("fp")).agg(F.count(F.lit(1)).alias("near"))
    near = stages.keep(near, "near")
    out = prints.join(order.drop("half"), ["none", "id"]).join(nexts, ["next_none", "next_id", "next_k2"])
    out = out.join(near, "fp", "left").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        hex64(F.col("fp")).alias("fingerprint"),
        hex64(F.col("e_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("e_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(~F.col("none") & (F.col("id") % 100 == 0), F.col("near")).alias("n_near"),
    )
