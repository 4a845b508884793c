"""Quality of documents by counted rules and by the log-likelihood ratio of hashed n-grams: DataFrame functions only.

Letters and signs of a text are told apart as tokens; single tokens and neighbouring pairs are hashed into buckets.
Two multinomials over the buckets are counted: one over trusted documents (the target), one over the whole corpus.
A document's ratio is the mean, over its n-grams, of the logarithm of the target's share of a bucket against the
corpus's; a document stays if no rule fails it and its ratio reaches a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import Stages, whole

BUCKETS = 1 << 14
# The target is counted on the documents of at most so many trusted ids, which are broadcast (a number each).
TARGET_IDS = 20_000
# Added to a bucket's count in the target, and to the count that the corpus's share lets expect there: what the target
# is too small to tell apart has a ratio near zero.
PRIOR = 20.0
THRESHOLD = -0.15
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
WINDOW = 8

_SPACE = r"[\x20\x09-\x0D]+"
_IN_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = "[#*$%&|<>]"
_TOKENS = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is computed once a row also where ``then`` names it inside other functions."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _pairs(values: Column, step: int, then: Callable[[Column, Column], Column]) -> Column:
    """``then`` of each element and the one ``step`` places after it."""
    size = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), size), F.slice(values, F.lit(step + 1), size), then)


def grams(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of the tokens of ``text``, then those of its neighbouring pairs, repeats included."""

    def place(h: Column) -> Column:
        return F.pmod(h, F.lit(buckets)).cast("int")

    hashes = F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), 0), lambda t: F.xxhash64(t))
    return let(
        hashes, lambda h: F.concat(F.transform(h, place), _pairs(h, 1, lambda x, y: place(F.xxhash64(x, y))))
    )


def _repeated(words: Column) -> Column:
    """How many words lie in runs of eight that the text holds twice or more.

    Runs are compared by a 64-bit hash. Where no four words repeat, or no eight, that is seen from their number; else
    runs are sorted by hash, and the words under each that has an equal neighbour are counted in order of their places.
    """

    def mix(x: Column, y: Column) -> Column:
        return F.xxhash64(x, y)

    def covered(places: Column) -> Column:
        gaps = _pairs(places, 1, lambda x, y: F.least(y - x, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

    def count(runs: Column) -> Column:
        order = F.array_sort(F.transform(runs, lambda r, at: F.struct(r.alias("r"), at.alias("at"))))

        def twins(order: Column) -> Column:
            same = F.transform(
                order,
                lambda x, i: F.when(
                    F.coalesce(F.get(order, i - 1)["r"] == x["r"], F.lit(False))
                    | F.coalesce(F.get(order, i + 1)["r"] == x["r"], F.lit(False)),
                    x["at"],
                ),
            )
            return F.sort_array(F.array_compact(same))

        return F.when(alone(runs), F.lit(0)).otherwise(let(let(order, twins), covered))

    def alone(runs: Column) -> Column:
        return F.size(F.array_distinct(runs)) == F.size(runs)

    def of_four(runs: Column) -> Column:
        return F.when(alone(runs), F.lit(0)).otherwise(let(_pairs(runs, 4, mix), count))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    by_two = let(hashes, lambda h: _pairs(h, 1, mix))
    return let(let(by_two, lambda h: _pairs(h, 2, mix)), of_four)


def rules(docs: DataFrame) -> DataFrame:
    """(all columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) for every row.

    Words are runs without white space (nulls have none). word_chars: their code points; n_symbols: characters of
    ``#*$%&|<>``; n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words in eight-word
    windows found twice or more. A row fails with fewer than 20 words, or if over 30 percent are repeated.
    """
    text = F.col("_llm_text")
    found = docs.withColumn("_llm_text", whole()).withColumn("_llm_words", F.array_remove(F.split(text, _SPACE), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_IN_WORD))
    counts = {
        "n_words": F.size("_llm_words"),
        "word_chars": F.char_length(F.array_join("_llm_words", "")),
        "n_symbols": F.regexp_count(text, F.lit(_SYMBOLS)),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeated(F.col("_llm_words")),
    }
    found = found.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_llm_text", "_llm_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return found.withColumn("base_failed", failed)


def trusted_ids(labels: DataFrame, most: int = TARGET_IDS) -> DataFrame:
    """(doc_id): at most ``most`` ids, the smallest by a hash, with quality 1 on all their labels.

    Ids whose crc32 as text leaves 1 when divided by 3 are held out: they never reach the target.
    """
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    ids = ids.agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).where("quality = 1")
    ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def ratios(docs: DataFrame, labels: DataFrame, stages: Stages, buckets: int = BUCKETS) -> DataFrame:
    """(ratios): one row, the logarithm of target against corpus for each bucket; zeros where either is empty.

    The corpus is every row of ``docs``, the target those of the trusted ids; repeated rows count each time.
    """
    spark = stages.spark
    ids = stages.keep(trusted_ids(labels), "ids").withColumn("target", F.lit(1))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole().alias("text"))
    rows = rows.join(F.broadcast(ids), "doc_id", "left")
    rows = rows.select(F.coalesce("target", F.lit(0)).alias("target"), F.explode(grams(F.col("text"), buckets)).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"))
    counts = stages.keep(counts, "buckets")
    sums = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    # One row for each bucket and one of sums: as many whatever the corpus holds.
    table = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    table = table.select(
        F.sort_array(F.collect_list(F.struct("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "target"))))).alias("t")
    )
    raw, target = sums.select("all_raw").scalar(), sums.select("all_target").scalar()
    table = table.select("t", raw.alias("all_raw"), target.alias("all_target"))

    def ratio(x: Column) -> Column:
        return F.ln(x["target"] + PRIOR) - F.ln(x["raw"] * (F.col("all_target") / F.col("all_raw")) + PRIOR)

    some = F.coalesce(F.col("all_target"), F.lit(0)) > 0
    return table.select(
        F.transform("t", lambda x: F.when(some, ratio(x)).otherwise(F.lit(0.0))).alias("ratios")
    )


def judge(
    docs: DataFrame, labels: DataFrame, stages: Stages, threshold: float = THRESHOLD, buckets: int = BUCKETS
) -> DataFrame:
    """``docs`` with the columns of ``rules`` and n_grams, llr (the mean log ratio) and kept.

    Every row is judged by itself against the same threshold. Rows without tokens have a ratio of zero (and fail by
    their words); without trusted documents all ratios are zero and the rules alone decide. Null texts are empty,
    repeated rows stay, no rows give none; other columns are carried along unread.
    """
    table = stages.keep(ratios(docs, labels, stages, buckets), "ratios")
    found = rules(docs).withColumn("_llm_grams", grams(whole(), buckets)).withColumn("_llm_ratios", table.scalar())

    def total(ratios: Column) -> Column:
        return F.aggregate("_llm_grams", F.lit(0.0), lambda sum_, g: sum_ + F.get(ratios, g))

    n = F.size("_llm_grams").cast("long")
    found = found.withColumns(
        {"n_grams": n, "llr": F.coalesce(let(F.col("_llm_ratios"), total) / F.when(n > 0, n), F.lit(0.0))}
    ).drop("_llm_grams", "_llm_ratios")
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
