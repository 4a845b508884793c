"""Benchmark questions in texts, also with other numbers, names and units: DataFrame functions only.

Text becomes a template: numbers, units after them and capitalised words inside sentences give way to typed
placeholders, the other words are lower-cased. Windows of five template tokens are hashed and joined with those
of the benchmark. An alignment (a constant shift between document and item) counts only if its slots are
consistent, that is if each value of the item turns into one value; a document leaks an item if at least 0.8
of the item's windows are met by such alignments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import Stages, row_key, whole

WORDS = 5
COVERED = 0.8
# A benchmark of at most so many windows (24 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000

NUMBER, UNIT, NAME = "\u0002", "\u0003", "\u0004"
_NUMBERS = r"\p{N}+(?:[.,:/]\p{N}+)*"
_UNITS = (
    "mm|cm|dm|m|km|inch|inches|ft|feet|yards?|miles?|mg|g|kg|t|lb|lbs|ounces?|pounds?|tons?|ml|cl|l|liters?|litres?|"
    "gallons?|ms|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|percent|dollars?|cents?|euros?|"
    "usd|eur|degrees?|watts?|kw|kwh|volts?|amperes?|hz|khz|mhz|ghz|bytes?|kb|mb|gb|tb|mph|kmh"
)
_LETTERS = r"[\p{L}\p{M}]"


def template(text: Column) -> Column:
    """The template's tokens; one for each number and each run of letters."""
    out = F.regexp_replace(text, "[\u0002-\u0004]", " ")
    out = F.regexp_replace(out, _NUMBERS, f" {NUMBER} ")
    out = F.regexp_replace(out, f"(?i)(?<={NUMBER}  ?)(?:{_UNITS})(?!{_LETTERS})", UNIT)
    out = F.regexp_replace(out, rf"(?<=[\p{{Ll}},;] )\p{{Lu}}{_LETTERS}*", NAME)
    return F.array_remove(F.split(F.lower(out), r"[^\p{L}\p{M}\x02-\x04]+"), "")


def values(text: Column) -> Column:
    """What stands in the text for each of the template's tokens, lower-cased."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "[\u0002-\u0004]", " "), F.lit(f"({_NUMBERS}|{_LETTERS}+)"), 1)


def windows(df: DataFrame, keys: list[str], words: int = WORDS) -> DataFrame:
    """(keys, at, win): a hash for every ``words`` neighbouring tokens of the template of ``text``."""
    hashes = df.select(*keys, F.transform(template(F.col("text")), lambda t: F.xxhash64(t)).alias("h"))
    count = F.greatest(F.size("h") - (words - 1), F.lit(0))
    shifted = [F.slice("h", F.lit(i + 1), count).alias(f"h{i}") for i in range(words)]
    # outer, as for the inner one a filter on the array's size would compute it a second time
    rows = hashes.select(*keys, F.posexplode_outer(F.arrays_zip(*shifted)).alias("at", "w")).where("at is not null")
    return rows.select(*keys, "at", F.xxhash64(*(F.col(f"w.h{i}") for i in range(words))).alias("win"))


def _slots(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, value) of the placeholders."""
    text = F.col("text")
    rows = df.select(*keys, F.arrays_zip(template(text).alias("t"), values(text).alias("v")).alias("z"))
    rows = rows.select(*keys, F.posexplode_outer("z").alias("at", "z"))
    return rows.where(F.col("z.t").isin(NUMBER, UNIT, NAME)).select(*keys, "at", F.col("z.v").alias("value"))


def leaks(docs: DataFrame, benchmark: DataFrame, stages: Stages, words: int = WORDS, covered: float = COVERED) -> DataFrame:
    """(k1, k2, doc_id, item_id, n_windows, n_met, n_slots, n_changed): the items each document of ``docs`` leaks.

    n_changed of the item's n_slots placeholders on counted alignments hold another value in the document. Items
    and documents of fewer than ``words`` tokens, empty or null have no windows and no leak. Repeated items
    (same item_id and text) count once; repeated documents give one row; other columns are not read.
    """
    k1, k2 = row_key(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long"), whole().alias("text"))
    items = benchmark.select(F.col("item_id").cast("long"), whole().alias("text")).distinct()
    items = items.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "text"))
    asked = stages.keep(windows(items, ["item_id", "item"], words).withColumnRenamed("at", "item_at"), "asked")
    size = asked.groupBy("item").agg(F.count(F.lit(1)).alias("n_windows"))
    small = asked.count() <= BROADCAST_WINDOWS
    met = windows(rows, ["k1", "k2", "doc_id"], words).join(F.broadcast(asked) if small else asked, "win")
    met = stages.keep(met.select("k1", "k2", "doc_id", "item_id", "item", "at", "item_at"), "met")

    def enough(found: DataFrame) -> DataFrame:
        found = found.groupBy("k1", "k2", "doc_id", "item_id", "item").agg(F.count_distinct("item_at").alias("n_met"))
        return found.join(size, "item").where(F.col("n_met") >= covered * F.col("n_windows"))

    likely = stages.keep(enough(met).select("k1", "k2", "item"), "likely")
    # A token's two places in every window that was met, once; then the values there, if the item has a placeholder.
    places = met.join(likely, ["k1", "k2", "item"])
    places = places.select("k1", "k2", "item", "at", "item_at", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("i"))
    places = places.select("k1", "k2", "item", (F.col("at") + F.col("i")).alias("at"), (F.col("item_at") + F.col("i")).alias("item_at"))
    wanted = _slots(items, ["item"]).toDF("item", "item_at", "asked")
    places = places.distinct().join(wanted, ["item", "item_at"])
    texts = rows.join(likely.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").drop("doc_id").distinct()
    slots = places.join(_slots(texts, ["k1", "k2"]), ["k1", "k2", "at"]).distinct()
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    judged = slots.groupBy("k1", "k2", "item", shift).agg(
        (F.count_distinct("asked", "value") > F.count_distinct("asked")).alias("torn"),
        F.count(F.lit(1)).alias("n_slots"),
        F.sum((F.col("asked") != F.col("value")).cast("long")).alias("n_changed"),
    )
    judged = stages.keep(judged, "judged")
    key = ["k1", "k2", "item", "shift"]
    sound = met.join(likely, ["k1", "k2", "item"]).withColumn("shift", shift)
    sound = sound.join(judged.where("torn").select(*key), key, "left_anti")
    counts = judged.where("not torn").groupBy("k1", "k2", "item").agg(
        F.sum("n_slots").alias("n_slots"), F.sum("n_changed").alias("n_changed")
    )
    out = enough(sound).join(counts, ["k1", "k2", "item"], "left").na.fill(0, ["n_slots", "n_changed"])
    return out.select("k1", "k2", "doc_id", "item_id", "n_windows", "n_met", "n_slots", "n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, stages: Stages) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    found = stages.keep(leaks(docs, benchmark, stages).select("k1", "k2").distinct(), "leaks")
    k1, k2 = row_key(docs)
    names = ["_llm_k1", "_llm_k2"]
    rows = docs.withColumns(dict(zip(names, (k1, k2), strict=True)))
    return rows.join(found.toDF(*names), names, "left_anti").select(*docs.columns)
