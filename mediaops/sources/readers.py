"""Readers: inventories, ledgers, task JSON, URL manifests, format lists, dimensions, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops import schemas
from mediaops.operators.inventory import clean_listing
from mediaops.sources.changes import read_rows, versions
from mediaops.sources.listing import list_files


def read_inventory(spark: SparkSession, path: str, prefix: str = "", format: str = "parquet", bucket: str = "") -> DataFrame:
    """Object listing below a prefix (S1): bucket, key, size, etag, last_modified.

    ``parquet`` and ``csv`` read a stored bucket inventory, and the prefix reaches the scan as a
    filter. ``files`` lists a tree level by level, folders by executors (``listing.list_files``).
    """
    if format == "files":
        listing = list_files(spark, path, prefix).select(F.lit(bucket).alias("bucket"), "key", "size", F.lit("").alias("etag"), "last_modified")
    else:
        reader = spark.read.schema(schemas.INVENTORY)
        if format == "csv":
            reader = reader.option("header", "true").option("escape", '"')
        listing = reader.format(format).load(path)
    return clean_listing(listing, prefix)


def read_ledger(spark: SparkSession, path: str, kind: str = "copy") -> DataFrame:
    """Task rows with the fixed schema of their kind: copy, download or merge, changes folded in."""
    fields = ", ".join(s.strip() for s in schemas.TASKS[kind].split(","))
    return read_rows(spark, path, fields) if versions(spark, path) else spark.read.schema(fields).parquet(path)


ZERO_TIME = "0001-01-01T00:00:00Z"


def flexible_timestamp(c) -> Column:
    """Timestamp from any of the writer layouts (S3).

    ``T`` or space, up to nine fraction digits, with or without a zone (none means UTC). The zero
    time, empty text and junk become null; fractions are cut to microseconds.
    """
    raw = F.trim(c)
    clock = F.substr(raw, F.lit(11))
    zoned = F.endswith(raw, F.lit("Z")) | F.contains(clock, F.lit("+")) | F.contains(clock, F.lit("-"))
    full = (F.length(raw) >= 19) & F.left(clock, F.lit(1)).isin("T", " ") & (raw != ZERO_TIME)
    utc = F.concat(raw, F.when(zoned, F.lit("")).otherwise(F.lit("Z")))
    return F.when(full, utc.try_cast("timestamp"))


def parse_task_json(df: DataFrame, column: str, kind: str = "copy") -> DataFrame:
    """JSON task strings as typed rows; input columns other than ``column`` are kept (S3)."""
    target = T.StructType.fromDDL(schemas.TASKS[kind])
    times = {f.name for f in target if isinstance(f.dataType, T.TimestampType)}
    wire = T.StructType([T.StructField(f.name, T.StringType() if f.name in times else f.dataType) for f in target])
    parsed = df.withColumn("_t", F.from_json(column, wire)).drop(column)
    fields = [
        (flexible_timestamp(F.col(f"_t.{f.name}")) if f.name in times else F.col(f"_t.{f.name}")).alias(f.name)
        for f in target
    ]
    return parsed.select(*[c for c in parsed.columns if c != "_t"], *fields)


def read_url_manifest(spark: SparkSession, paths) -> DataFrame:
    """Lines of URL lists with 1-based line numbers per file (S4): submission, line_no, line.

    Large files are read in splits by many tasks. Rows are numbered within their split, and the
    split offsets, one small row per split, are summed along each file.
    """
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("submission"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    earlier = Window.partitionBy("submission").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        rows.groupBy("submission", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    # The ids only order a split's lines, so it doesn't matter which task read the split.
    inside = F.row_number().over(Window.partitionBy("submission", "_block").orderBy("_id"))
    return (
        rows.withColumn("_line", inside)
        .join(splits, ["submission", "_block"])
        .select("submission", (F.col("_before") + F.col("_line")).alias("line_no"), "line")
    )


def explode_formats(items: DataFrame) -> DataFrame:
    """One row per (video, format) with its list position, from nested extractor output."""
    return items.select(F.col("id").alias("video_id"), F.posexplode("formats").alias("pos", "f")).select(
        "video_id",
        "pos",
        "f.format_id",
        "f.vcodec",
        "f.acodec",
        "f.height",
        "f.width",
        "f.abr",
        "f.language",
        F.coalesce(F.nullif("f.filesize", F.lit(0)), "f.filesize_approx").alias("filesize"),
        "f.url",
    )


def read_formats(spark: SparkSession, path: str) -> DataFrame:
    """Extractor output files, one JSON object per line, as format rows."""
    return explode_formats(spark.read.schema(schemas.FORMATS).json(path))


def drop_credentials(df: DataFrame) -> DataFrame:
    return df.drop(*schemas.CREDENTIALS)


def read_dims(spark: SparkSession, source: str, table: str | None = None, options: dict | None = None) -> DataFrame:
    """Job or client table without credential columns.

    ``source`` is a ``jdbc:`` URL with a table name, or a parquet path. Over JDBC the kept columns
    and later filters are pushed to the database; pass ``partitionColumn`` and bounds in
    ``options`` to read in parallel.
    """
    if source.startswith("jdbc:"):
        reader = spark.read.format("jdbc").option("url", source).option("dbtable", table)
        return drop_credentials(reader.options(**(options or {})).load())
    return drop_credentials(spark.read.parquet(source))


def decode_task_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Status, activation, progress and heartbeat messages from JSON text."""
    return raw.select(F.from_json(F.col(column).cast("string"), schemas.TASK_EVENT).alias("e")).select("e.*")


def stream_task_events(
    spark: SparkSession, source: str, format: str = "json", options: dict | None = None
) -> DataFrame:
    """Task messages as a stream (S7): json or parquet files, or Kafka (``source`` = topic)."""
    reader = spark.readStream.options(**(options or {}))
    if format == "kafka":
        return decode_task_events(reader.format("kafka").option("subscribe", source).load())
    return reader.schema(schemas.TASK_EVENT).format(format).load(source)


def stream_inventory(
    spark: SparkSession, path: str, prefix: str = "", schema: str = schemas.INVENTORY, files_per_trigger: int = 1000
) -> DataFrame:
    """Listing files as they arrive.

    Each trigger takes only new files; the stream's checkpoint stands for the last scan time, and
    ``maxFilesPerTrigger`` bounds a batch.
    """
    listing = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )
    return clean_listing(listing, prefix)
