"""A ledger that takes updates without being rewritten: changed rows beside its folders, folded in when it is read.

``<path>`` holds the rows by folder, ``<path>-changes`` one directory for each upsert with the rows it changed
(``gone`` where a row was removed). Of a key the rows of its last version count; keys without changes are read from
the folders. A compaction writes folders whose changes have outgrown a share of them, and gathers the other
changes in one directory. One writer at a time; a step that is run again after a failure ends with the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.sources.files import exists, mark, names, remove

KEYS = ["bucket", "job_id", "id"]
# Changes are folded into a folder's files when they are more than this share of its rows.
SHARE = 0.25


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}-changes"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions beside a ledger; as many at most as upserts since the last compaction."""
    found = [n for n in names(spark, _beside(path)) if n.startswith("version=")]
    return sorted(int(n.removeprefix("version=")) for n in found if exists(spark, f"{_beside(path)}/{n}/_SUCCESS"))


def same_keys(a: DataFrame, b: DataFrame, *more: str) -> Column:
    """Equal keys; keys may be null."""
    return reduce(Column.__and__, [a["bucket"] == b["bucket"], *(a[k].eqNullSafe(b[k]) for k in ("job_id", "id", *more))])


def _stored(spark: SparkSession, path: str) -> list[str]:
    """Folders of a ledger, at most as many as there are buckets."""
    return [n for n in names(spark, path) if n.startswith("bucket=")]


def ledger_schema(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> T.StructType:
    """Columns of a ledger besides its folder, read from one of its folders unless given."""
    if schema is None:
        return spark.read.parquet("/".join([path, *_stored(spark, path)[:1]])).schema
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _folders(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None) -> DataFrame:
    """Rows of a ledger's folders, or of some of them; no other is listed or opened."""
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.LongType())])
    wanted = None if buckets is None else {f"bucket={b}" for b in buckets}
    found = [n for n in _stored(spark, path) if wanted is None or n in wanted]
    if not found:
        return spark.createDataFrame([], whole)
    reader = spark.read.schema(whole).option("basePath", path)
    return reader.parquet(path) if wanted is None else reader.parquet(*(f"{path}/{n}" for n in found))


def _changes(spark: SparkSession, path: str, schema: T.StructType, found: list[int], buckets: list[int] | None) -> DataFrame:
    more = [T.StructField("bucket", T.LongType()), T.StructField("gone", T.BooleanType()), T.StructField("version", T.LongType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *more])).option("basePath", _beside(path))
    rows = rows.parquet(*(f"{_beside(path)}/version={n}" for n in found))
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


def read_rows(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    before: int | None = None,
    buckets: list[int] | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """Rows of a ledger with its changes folded in, those of some folders or before a version if asked for.

    Repeated keys keep all rows of their last version. Changes are a share of the ledger, so folding moves
    them by key and the folders' rows only where they don't fit a broadcast.
    """
    path = path.rstrip("/")
    schema = ledger_schema(spark, path, schema)
    rows = _folders(spark, path, schema, buckets)
    found = [n for n in versions(spark, path) if before is None or n < before]
    if found:
        changes = _changes(spark, path, schema, found, buckets)
        last = changes.groupBy(*KEYS).agg(F.max("version").alias("version"))
        live = changes.join(last, same_keys(changes, last, "version"), "left_semi").filter("not gone")
        rows = rows.join(last, same_keys(rows, last), "left_anti").unionByName(live.drop("gone", "version"))
    return rows if keep_bucket else rows.drop("bucket")


def put_version(rows: DataFrame, path: str, version: int) -> None:
    """Rows (a ledger's, ``bucket``, ``gone``) as one version; writing it again replaces it."""
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions(*KEYS)
    rows.write.mode("overwrite").parquet(f"{_beside(path)}/version={version}")


def forget(spark: SparkSession, path: str) -> None:
    """Remove all versions, after the ledger itself was replaced."""
    remove(spark, _beside(path))


def compact(spark: SparkSession, path: str, stage: str, write, share: float = SHARE, schema=None) -> None:
    """Fold changes into the folders that they have outgrown; the others' last changes become one version.

    ``write(rows with bucket)`` replaces the folders of the rows. The folded rows lie in ``stage`` first, and
    the old versions go last: until then they say the same as the folders.
    """
    found = versions(spark, path)
    if not found:
        return
    schema = ledger_schema(spark, path, schema)
    if not exists(spark, f"{stage}/done"):
        changes = _changes(spark, path, schema, found, None)
        stored = _folders(spark, path, schema, None).groupBy("bucket").agg(F.count(F.lit(1)).alias("stored"))
        due = changes.groupBy("bucket").agg(F.count(F.lit(1)).alias("changed")).join(stored, "bucket", "left")
        due = due.filter(F.col("changed") > share * F.coalesce("stored", F.lit(0)))
        heavy = [r.bucket for r in due.select("bucket").collect()]  # at most as many numbers as folders
        spark.createDataFrame([(b,) for b in heavy], "bucket long").coalesce(1).write.mode("overwrite").parquet(f"{stage}/heavy")
        read_rows(spark, path, schema, buckets=heavy, keep_bucket=True).write.mode("overwrite").parquet(f"{stage}/rows")
        last = changes.groupBy(*KEYS).agg(F.max("version").alias("version"))
        light = changes.join(last, same_keys(changes, last, "version"), "left_semi").filter(~F.col("bucket").isin(heavy))
        light.drop("version").write.mode("overwrite").parquet(f"{stage}/light")
        mark(spark, f"{stage}/done")
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.LongType())])
    rows = spark.read.schema(whole).parquet(f"{stage}/rows")
    heavy = spark.read.schema("bucket long").parquet(f"{stage}/heavy")
    write(rows)
    for row in heavy.join(rows.select("bucket"), "bucket", "left_anti").collect():
        remove(spark, f"{path}/bucket={row.bucket}")
    light = spark.read.schema(T.StructType([*whole.fields, T.StructField("gone", T.BooleanType())])).parquet(f"{stage}/light")
    put_version(light, path, found[-1] + 1)
    for n in found:
        remove(spark, f"{_beside(path)}/version={n}")
