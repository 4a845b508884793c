"""Writers: ledger layout, ledger upsert, reject reports, task queue stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.functions import columns as C
from mediaops.sources import changes
from mediaops.sources.files import exists, mark, names, remove

IDS_PER_BUCKET = 50_000
BUCKETS = 1024
# Upserts between two compactions.
VERSIONS = 16


def with_bucket(df: DataFrame, ids_per_bucket: int = IDS_PER_BUCKET, buckets: int = BUCKETS) -> DataFrame:
    """Folder of a task: its job and id range, dealt over a bounded number of folders; never null.

    A job's neighbouring ids share a folder; jobs lie apart although the ids of each start at one. Rows
    without an id lie with the job's first.
    """
    spot = F.coalesce("job_id", F.lit(0)) * 31 + C.int_div(F.coalesce("id", F.lit(0)), ids_per_bucket)
    return df.withColumn("bucket", F.pmod(spot, F.lit(buckets)).cast("long"))


def write_ledger(
    df: DataFrame, path: str, ids_per_bucket: int = IDS_PER_BUCKET, mode: str = "overwrite", buckets: int = BUCKETS
) -> None:
    """Ledger by job and id range (K1), sorted by job and id so that job filters skip row groups.

    An overwrite replaces the whole ledger, changes beside it included. Range partitioning splits a
    bucket that one huge job fills, and keeps the number of files near tasks plus buckets.
    """
    _write_buckets(with_bucket(df, ids_per_bucket, buckets), path, mode, "static")
    if mode == "overwrite":
        changes.forget(df.sparkSession, path)


def _write_buckets(df: DataFrame, path: str, mode: str, replaced: str) -> None:
    (
        df.repartitionByRange("bucket", "job_id", "id")
        .sortWithinPartitions("bucket", "job_id", "id")
        .write.mode(mode)
        .option("partitionOverwriteMode", replaced)
        .partitionBy("bucket")
        .parquet(path)
    )


def upsert_ledger(
    batch: DataFrame,
    path: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    stage: str,
    ids_per_bucket: int = IDS_PER_BUCKET,
    schema: str | T.StructType | None = None,
    before: Callable[[DataFrame, DataFrame], None] | None = None,
    buckets: int = BUCKETS,
    versions: int = VERSIONS,
    removes: bool = True,
) -> None:
    """Apply ``merge(rows, batch)`` to the stored rows of the batch's keys (K2), writing only what it changes.

    The folders that hold the keys are read, no other; the merged rows go beside the ledger as one more
    version, a key that the merge leaves out as gone (without ``removes`` it stays as it is, unwritten).
    ``changes.read_rows`` folds them in, and after
    ``versions`` of them ``compact_ledger`` does so for good. A run that is repeated with the same
    stage (same batch of the same stream) writes the same version again, or nothing where it was
    finished. ``before`` sees the rows and the batch ahead of the merge, under the same guarantee.
    ``batch`` needs ``job_id`` and ``id``; ``schema`` is needed where no ledger is stored yet.
    """
    spark = batch.sparkSession
    if exists(spark, f"{stage}/done"):
        return
    stored = changes.versions(spark, path)
    begun = [int(n.removeprefix("version-")) for n in names(spark, stage) if n.startswith("version-")]
    version = begun[0] if begun else max(stored, default=0) + 1
    if not begun:
        mark(spark, f"{stage}/version-{version}")
    if version not in stored:
        schema = changes.ledger_schema(spark, path, schema)
        keys = with_bucket(batch.select("job_id", "id"), ids_per_bucket, buckets).distinct()
        touched = [r.bucket for r in keys.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        found = changes.read_rows(spark, path, schema, version, touched, keep_bucket=True)
        found.join(keys, changes.same_keys(found, keys), "left_semi").write.mode("overwrite").parquet(f"{stage}/current")
        old = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.LongType())])).parquet(f"{stage}/current")
        current = old.drop("bucket")
        if before is not None:
            before(current, batch)
        merge(current, batch).select(*schema.names).write.mode("overwrite").parquet(f"{stage}/rows")
        rows = with_bucket(spark.read.schema(schema).parquet(f"{stage}/rows"), ids_per_bucket, buckets)
        put = rows.withColumn("gone", F.lit(False))
        if removes:
            gone = old.join(rows, changes.same_keys(old, rows), "left_anti")
            put = put.unionByName(gone.withColumn("gone", F.lit(True)))
        changes.put_version(put, path, version)
    if len(changes.versions(spark, path)) >= versions:
        compact_ledger(spark, path, f"{stage}/compact", schema=schema)
    mark(spark, f"{stage}/done")
    for name in ("current", "rows", "compact"):
        remove(spark, f"{stage}/{name}")


def compact_ledger(spark: SparkSession, path: str, stage: str, share: float = changes.SHARE, schema=None) -> None:
    """Fold the changes beside a ledger into the folders where they are more than ``share`` of the rows."""
    changes.compact(spark, path, stage, lambda rows: _write_buckets(rows, path, "overwrite", "dynamic"), share, schema)


def write_rejects(errors: DataFrame, path: str, mode: str = "overwrite", redact: bool = False) -> None:
    """Validation errors as JSON lines: line_number, content, message, fixed, fixed_url (K3).

    With ``redact``, URLs in the content, and where the message quotes it, are shortened as in other reports;
    for reports that go to others than who sent the lines.
    """
    if redact:
        quote = F.lit("'")
        shown = errors.withColumn("_shown", C.redact_key("content"))
        told = F.replace("message", F.concat(quote, "content", quote), F.concat(quote, "_shown", quote))
        errors = shown.withColumn("message", told).withColumn("content", F.col("_shown")).drop("_shown")
    errors.withColumnRenamed("line_no", "line_number").write.mode(mode).json(path)


def write_tasks_queue(tasks: DataFrame, path: str, batch_id: str) -> None:
    """New tasks as an append-only stage, one directory per batch (K4).

    Writing a batch again replaces its own directory only, so a retried batch adds nothing twice.
    """
    tasks.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def publish_tasks(tasks: DataFrame, topic: str, options: dict) -> None:
    """New tasks as Kafka messages keyed by job (K4); needs the Kafka connector on the class path."""
    (
        tasks.select(F.col("job_id").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
        .write.format("kafka")
        .options(topic=topic, **options)
        .save()
    )
