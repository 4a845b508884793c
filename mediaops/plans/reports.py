"""Dashboards and reports: grouped aggregates, top-k, pages, shares, rates, log metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.operators.ordered import PART, carry_last, dealt, running_sum

# Histogram bounds in seconds.
DURATION_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def _done_count() -> Column:
    return F.sum(F.coalesce("success_count", "total_count", F.lit(0)))


def _done_bytes() -> Column:
    return F.sum(F.coalesce("success_size_bytes", F.lit(0)))


def dest_totals(jobs: DataFrame, meta: DataFrame) -> DataFrame:
    """Count and bytes per destination label.

    Jobs are first summed by (client id, label source), so the dimension join and the label run on
    few rows.
    """
    pre = jobs.groupBy("metadata_id", "dst_dir").agg(_done_count().alias("count"), _done_bytes().alias("size"))
    dim = meta.select(F.col("id").alias("metadata_id"), "client_name")
    return (
        pre.join(dim, "metadata_id", "left")
        .groupBy(C.dest_label("client_name", "metadata_id", "dst_dir").alias("label"))
        .agg(F.sum("count").alias("count"), F.sum("size").alias("size"))
    )


def top_by_size(totals: DataFrame, k: int = 10, tie: str = "label") -> DataFrame:
    """Top ``k`` groups by bytes (O2)."""
    return totals.orderBy(F.desc("size"), tie).limit(k)


def dest_stats(jobs: DataFrame, meta: DataFrame, k: int = 10) -> DataFrame:
    """Top destinations by bytes (A1)."""
    return top_by_size(dest_totals(jobs, meta), k)


def daily_stats(jobs: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Count and bytes per day over the trailing days (A2)."""
    return (
        jobs.filter(F.col("created_at") >= C.ts(as_of) - C.seconds(days * 86400))
        .groupBy(F.date_format(F.date_trunc("day", "created_at"), "yyyy-MM-dd").alias("date"))
        .agg(_done_count().alias("count"), _done_bytes().alias("size"))
        .orderBy("date")
    )


def last_days_present(jobs: DataFrame, days: int = 14) -> DataFrame:
    """Count and bytes of the last days that have jobs (A2 as the dashboard shows it)."""
    per_day = jobs.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(
        _done_count().alias("count"), _done_bytes().alias("size")
    )
    return per_day.orderBy(F.desc("date")).limit(days)


def client_stats(jobs: DataFrame, meta: DataFrame) -> DataFrame:
    """Count and bytes per client."""
    pre = jobs.groupBy("metadata_id").agg(_done_count().alias("count"), _done_bytes().alias("size"))
    dim = meta.select(F.col("id").alias("metadata_id"), "client_name")
    label = F.coalesce("client_name", F.concat(F.lit("meta-"), F.col("metadata_id").cast("string")))
    return pre.join(dim, "metadata_id", "left").select("metadata_id", label.alias("label"), "count", "size")


def share_of_total(totals: DataFrame, value: str = "size", label: str = "label") -> DataFrame:
    """Ratio of the total per slice with its cumulative start and end, largest first.

    Rows are dealt once by range of value and label into a stage; the running sum is windowed inside a range,
    and the ranges are chained by one row each. Equal values are split by label, so no window holds more than a
    range however many there are; rows equal in both are told apart by the hash of the whole row.
    """
    tie = F.xxhash64(*totals.columns)
    order = [F.desc(value), F.asc(label)]
    rows = dealt(totals.withColumn("_tie", tie), order, F.asc("_tie"))
    per_range = rows.groupBy(PART).agg(F.sum(value).alias("_s"))
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        PART,
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_s").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy(PART).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.col("_run")

    def ratio(x):
        return F.when(F.col("_total") > 0, F.round(x / F.col("_total"), 6)).otherwise(F.lit(0.0))

    return (
        rows.withColumn("_run", F.sum(value).over(inside))
        .join(offsets, PART)
        .withColumns(
            {
                "ratio": ratio(F.col(value)),
                "slice_start": ratio(upto - F.col(value)),
                "slice_end": ratio(upto),
            }
        )
        .drop(PART, "_tie", "_run", "_before", "_total")
    )


def page(df: DataFrame, number: int = 1, limit: int = 10, newest: str = "created_at", tie: str = "job_id") -> DataFrame:
    """One page, newest first, with the total row count (O1)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.orderBy(F.desc(newest), F.desc(tie)).offset((number - 1) * limit).limit(limit).withColumn("total", total)
    )


def queue_counts(queue: DataFrame, machines: DataFrame) -> DataFrame:
    """Entries per (job, queue) of the queues that should exist; malformed task ids are skipped (A4).

    Entries are counted before they meet the queue list, so the join moves one row per job and queue.
    """
    parts = F.split("queue_name", ":")
    job = C.int_div(F.col("task_id").try_cast("long"), 1_000_000)
    if "job_id" in queue.columns:
        job = F.coalesce("job_id", job)
    return (
        queue.select(
            job.alias("job_id"),
            "queue_name",
            F.get(parts, F.lit(2)).alias("queue_type"),
            F.get(parts, F.lit(3)).alias("machine_name"),
        )
        .filter("job_id is not null")
        .groupBy("job_id", "queue_type", "queue_name", "machine_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(queue_universe(machines).select("queue_type", "machine_name"), ["queue_type", "machine_name"], "left_semi")
    )


def queue_stats(queue: DataFrame, machines: DataFrame) -> DataFrame:
    """Per job: queue totals by type and the per-queue counts as a name-ordered list (A4).

    The lists hold one element per queue, not per entry.
    """
    per_queue = queue_counts(queue, machines)

    def listed(kind):
        rows = F.collect_list(F.when(F.col("queue_type") == kind, F.struct("queue_name", "machine_name", "n")))
        return F.array_sort(rows)

    def total(kind):
        return F.sum(F.when(F.col("queue_type") == kind, F.col("n")).otherwise(0))

    return per_queue.groupBy("job_id").agg(
        total("download_ready").alias("download_ready"),
        listed("download_ready").alias("download_queues"),
        total("metadata_retry").alias("metadata_retry"),
        listed("metadata_retry").alias("metadata_queues"),
        F.sum("n").alias("total"),
    )


def machine_names(config: DataFrame, distinct: bool = True) -> DataFrame:
    """Machines enabled in the worker configuration (A20): distinct and non-empty, or the raw list."""
    names = config.filter("enabled").select("machine_name")
    return names.filter("machine_name <> ''").distinct() if distinct else names


def queue_universe(machines: DataFrame) -> DataFrame:
    """Every queue there should be: both types for ``all`` and each enabled machine."""
    spark = machines.sparkSession
    shared = spark.range(1).select(F.lit("all").alias("machine_name"))
    kinds = F.array(F.lit("download_ready"), F.lit("metadata_retry"))
    return (
        shared.union(machine_names(machines))
        .distinct()
        .withColumn("queue_type", F.explode(kinds))
        .withColumn("queue_name", F.concat_ws(":", F.lit("queue"), "queue_type", "machine_name"))
    )


def histogram(value: Column, bounds=DURATION_BOUNDS) -> list[Column]:
    """Cumulative bucket counts (``le_<bound>``), total and sum of a duration column."""
    named = [F.count_if(value <= b).alias("le_" + str(b).replace(".", "_")) for b in bounds]
    return [*named, F.count(F.lit(1)).alias("requests")]


def http_metrics(requests: DataFrame) -> DataFrame:
    """Request count, duration histogram and 95th percentile per method, path and status."""
    return requests.groupBy("method", "path", "status").agg(
        *histogram(F.col("duration")),
        F.sum("duration_ms").alias("duration_ms"),
        F.percentile_approx("duration", 0.95, 10_000).alias("p95"),
    )


def task_metrics(log: DataFrame) -> DataFrame:
    """Outcomes, bytes and duration histogram per worker type and status."""
    return log.groupBy("worker_type", "outcome").agg(
        *histogram(F.col("duration")),
        F.sum("bytes").alias("bytes"),
        F.count_if(F.col("discovered")).alias("discovered"),
        F.count_if(F.col("retried")).alias("retried"),
        F.count_if(F.col("permanent")).alias("permanent"),
    )


# Fields of a copy timing line.
TIMING_FIELDS = [
    "source_fetch_ms",
    "source_fetch_ms_total",
    "dest_upload_ms",
    "dest_upload_ms_total",
    "retry_wait_ms_total",
    "total_copy_ms",
]


def parse_copy_log(lines: DataFrame) -> DataFrame:
    """Columns of the copy timing lines; other lines are dropped (A16). A key that is a signed URL is shortened for reports."""
    line = F.col("line")

    def number(name):
        return F.regexp_extract(line, rf"\b{name}=(\d+)", 1).try_cast("long")

    return lines.filter(line.startswith("Copy timing ")).select(
        "ts",
        F.regexp_extract(line, r"^Copy timing (\w+) for ", 1).alias("result"),
        C.redact_key(F.regexp_extract(line, r" for (\S+) part=", 1)).alias("key"),
        number("part").alias("part_number"),
        number("attempts").alias("attempts"),
        F.regexp_extract(line, r"\bfailed_stage=(\S+)", 1).alias("failed_stage"),
        F.regexp_extract(line, r"\berror_code=(\S+)", 1).alias("error_code"),
        *[number(f).alias(f) for f in TIMING_FIELDS],
    )


def copy_timing(lines: DataFrame) -> DataFrame:
    """Attempts and times per result and failed stage."""
    return (
        parse_copy_log(lines)
        .groupBy("result", "failed_stage")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.sum("attempts").alias("attempts"),
            *[F.sum(f).alias(f) for f in TIMING_FIELDS],
            F.max("total_copy_ms").alias("max_copy_ms"),
            F.percentile_approx("total_copy_ms", 0.5, 10_000).alias("median_copy_ms"),
        )
    )


def reachability_report(probes: DataFrame) -> DataFrame:
    """Per class: probes, accessible share, status counts and response times."""
    ok = F.col("status") == 200
    return probes.groupBy("class").agg(
        F.count(F.lit(1)).alias("probes"),
        F.count_if(ok).alias("accessible"),
        F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("ok_share"),
        F.count_if(F.col("status").isNull()).alias("no_answer"),
        F.count_if(F.col("status").between(300, 399)).alias("redirects"),
        F.count_if(F.col("status").between(400, 499)).alias("client_errors"),
        F.count_if(F.col("status") >= 500).alias("server_errors"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.sum("duration_ms").alias("sum_ms"),
    )


def rate_breaches(requests: DataFrame, limit: int, key: str = "machine", window_us: int = 60_000_000) -> DataFrame:
    """Requests that met a full window (W9): earlier requests in the trailing minute, wait in µs.

    A request is a breach when the minute before it already holds ``limit`` others; the wait lasts
    until the oldest leaves, plus 0.1 s. Requests are counted by moment first. Every moment puts a mark where
    its minute starts, and one scan over moments and marks in order gives the requests before each and the first
    moment from a mark on: a row is touched once however many a minute holds. Requests without a time count
    each other only.
    """
    by = ["_key", "_none"]  # the key and whether it is null
    rows = requests.withColumns(
        {"_us": F.unix_micros(F.col("ts").cast("timestamp")), "_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_none": F.col(key).isNull()}
    )
    moments = rows.groupBy(*by, "_us").agg(F.count(F.lit(1)).alias("_n"))
    # marks come before the moment they meet, as a minute holds its first microsecond
    ends = F.array(F.struct((F.col("_us") - window_us).alias("at"), F.lit(0).alias("own")), F.struct(F.col("_us").alias("at"), F.lit(1).alias("own")))
    points = moments.withColumn("_end", F.explode(ends)).select(
        *by, "_us", "_n", F.col("_end.own").alias("_own"), (F.coalesce("_end.at", F.lit(-(1 << 61))) * 2 + F.col("_end.own")).alias("_at")
    )
    points = dealt(points, by, "_at")
    own = F.col("_own") == 1
    counted = running_sum(points, by, "_at", F.when(own, F.col("_n")).otherwise(0), "_upto")
    reverse = counted.withColumns({"_back": -F.col("_at"), PART: -F.col(PART)})
    first = carry_last(reverse, by, "_back", F.when(own, F.col("_us")), "_first")
    judged = first.groupBy(*by, "_us").agg(
        F.max(F.when(own, F.col("_upto"))).alias("_upto"),
        F.max(F.when(~own, F.col("_upto"))).alias("_before"),
        F.max(F.when(~own, F.col("_first"))).alias("_oldest"),
    )
    judged = judged.withColumn("in_window", F.col("_upto") - F.col("_before") - 1).filter(F.col("in_window") >= limit)
    judged = judged.withColumn("wait_us", F.lit(window_us + 100_000) - (F.col("_us") - F.col("_oldest"))).alias("j")
    same = reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"j.{c}")) for c in [*by, "_us"]])
    return rows.alias("r").join(judged, same).select(*[F.col(f"r.`{c}`") for c in requests.columns], "in_window", "wait_us")
