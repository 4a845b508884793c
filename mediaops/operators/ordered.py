"""Row numbers and carried values inside a key, without one task per key: a prefix scan in two phases.

A key may hold a large share of all rows (one huge job, one busy task), so a plain window by key is
avoided. Rows are dealt once by range of key *and* sequence and written as a stage; windows run inside (key,
range), and a key that goes over several ranges carries one small row from each to the next. Ranges hold as many
rows whatever the distances in the sequence. Results are those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaops.session import shared_dir

PART = "_part"


def dealt(df: DataFrame, keys: list, seq, parts: int | None = None) -> DataFrame:
    """``df`` as a stage, with ``_part``: rows of a key ascend with it. Several scans may share one stage.

    Keys and sequence are names, or columns with a direction.

    The input is computed and moved once; its ranges come from a sample, so they must not be drawn again.
    """
    by = [*keys, seq]
    rows = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return staged(rows.withColumn(PART, F.spark_partition_id()))


def staged(rows: DataFrame) -> DataFrame:
    """``rows`` written once and read back. A scan reads its input twice, so a chain of scans without stages between
    them computes its first one twice for each that follows, and twice again."""
    path = shared_dir(rows.sparkSession, "scan")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _ends(rows: DataFrame, keys: list[str], end) -> DataFrame:
    """One value for each range of the keys that go over several ranges; as many rows at most as ranges."""
    long = rows.groupBy(*keys).agg(F.min(PART).alias("_a"), F.max(PART).alias("_b")).filter("_a < _b").drop("_a", "_b")
    return rows.join(long, keys, "left_semi").groupBy(*keys, PART).agg(end)


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: list[str], seq: str, out: str = "row_no", parts: int | None = None) -> DataFrame:
    """1-based position of each row among those of its keys, in order of ``seq`` (long, unique per key).

    A frame that was ``dealt`` by the keys and ``seq`` before keeps its stage.
    """
    rows = df if PART in df.columns else dealt(df, keys, seq, parts)
    offsets = _ends(rows, keys, F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(_earlier(keys)))
    inside = Window.partitionBy(*keys, PART).orderBy(seq)
    found = (
        rows.withColumn(out, F.row_number().over(inside).cast("long"))
        .join(offsets.drop("_n"), [*keys, PART], "left")
        .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
        .drop("_before")
    )
    return found if PART in df.columns else found.drop(PART)


def running_sum(df: DataFrame, keys: list[str], seq: str, value, out: str, parts: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows up to each one, itself included, in order of ``seq``.

    A frame that was ``dealt`` by the keys and ``seq`` before keeps its stage.
    """
    rows = (df if PART in df.columns else dealt(df, keys, seq, parts)).withColumn("_value", value)
    offsets = _ends(rows, keys, F.sum("_value").alias("_n")).withColumn("_before", F.sum("_n").over(_earlier(keys)))
    inside = Window.partitionBy(*keys, PART).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        rows.withColumn(out, F.sum("_value").over(inside))
        .join(offsets.drop("_n"), [*keys, PART], "left")
        .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
        .drop("_value", "_before")
    )
    return found if PART in df.columns else found.drop(PART)


def carry_last(
    df: DataFrame, keys: list[str], seq: str, value, out: str, parts: int | None = None, strict: bool = True
) -> DataFrame:
    """Last non-null ``value`` before each row (``strict``) or up to it, in order of ``seq``.

    A frame that was ``dealt`` by the keys and ``seq`` before keeps its stage.
    """
    rows = (df if PART in df.columns else dealt(df, keys, seq, parts)).withColumn("_value", value)
    end = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(seq))).alias("_end")
    carried = _ends(rows, keys, end).withColumn("_carry", F.last("_end", ignorenulls=True).over(_earlier(keys)))
    inside = Window.partitionBy(*keys, PART).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    found = (
        rows.withColumn(out, F.last("_value", ignorenulls=True).over(inside))
        .join(carried.filter("_carry is not null").drop("_end"), [*keys, PART], "left")
        .withColumn(out, F.coalesce(out, "_carry"))
        .drop("_value", "_carry")
    )
    return found if PART in df.columns else found.drop(PART)
