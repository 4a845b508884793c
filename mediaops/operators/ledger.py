"""Task ledger and job table: states, transitions, counters, due and finished jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.operators.ordered import carry_last

COUNTED = {
    "pending": C.PENDING,
    "running": C.RUNNING,
    "success": C.COMPLETED,
    "failed": C.FAILED,
}


def due_jobs(jobs: DataFrame, as_of) -> DataFrame:
    """Pending jobs, and running periodic jobs whose last scan is missing or older than the interval."""
    return jobs.filter(is_due(as_of))


def is_due(as_of) -> Column:
    overdue = F.col("last_scan_time").isNull() | (
        F.col("last_scan_time") < C.ts(as_of) - C.seconds(F.col("periodic_interval"))
    )
    return (F.col("status") == C.PENDING) | (
        (F.col("status") == C.RUNNING) & (F.col("periodic_interval") > 0) & overdue
    )


def mark_scanning(jobs: DataFrame, as_of) -> DataFrame:
    """All jobs, the due ones with status ``SCANNING``."""
    return jobs.withColumn("status", F.when(is_due(as_of), F.lit(C.SCANNING)).otherwise(F.col("status")))


def cleanup_eligible(jobs: DataFrame) -> DataFrame:
    """Completed one-off jobs, every task succeeded, runtime markers not yet cleaned."""
    return jobs.filter(
        (F.col("status") == C.COMPLETED)
        & ~F.col("is_incremental")
        & (F.col("total_count") == F.col("success_count"))
        & ~F.col("cleaned")
    )


def is_finished() -> Column:
    return (
        (F.col("status") == C.RUNNING)
        & (F.col("pending_count") <= 0)
        & (F.col("running_count") <= 0)
        & (F.col("periodic_interval") <= 0)
        & F.col("last_scan_time").isNotNull()
    )


def complete_jobs(jobs: DataFrame, as_of) -> DataFrame:
    """Running one-off jobs with nothing left become ``COMPLETED`` with end time and duration (P10)."""
    now = C.ts(as_of)
    began = F.coalesce("start_time", "created_at")
    return jobs.withColumn("_done", is_finished()).withColumns(
        {
            "status": F.when(F.col("_done"), F.lit(C.COMPLETED)).otherwise(F.col("status")),
            "end_time": F.when(F.col("_done"), now).otherwise(F.col("end_time")),
            "duration_seconds": F.when(
                F.col("_done"), F.unix_timestamp(now) - F.unix_timestamp(began.cast("timestamp"))
            ).otherwise(F.col("duration_seconds")),
        }
    ).drop("_done")


def active_jobs(jobs: DataFrame, kind: str) -> DataFrame:
    """Jobs still worked on: running copy jobs; pending or running download and merge jobs."""
    states = [C.RUNNING] if kind == "copy" else [C.PENDING, C.RUNNING]
    return jobs.filter(F.col("status").isin(states))


def stuck_tasks(tasks: DataFrame, jobs: DataFrame, as_of, after_seconds: int = 3 * 3600) -> DataFrame:
    """In-work tasks of active jobs created over three hours ago, reset to pending."""
    now = C.ts(as_of)
    stuck = tasks.filter(
        F.col("status").isin(C.RUNNING, C.METADATA_PROCESSING)
        & (F.col("created_at") < now - C.seconds(after_seconds))
    )
    return stuck.join(active_jobs(jobs, "download").select("job_id"), "job_id", "left_semi").withColumns(
        {
            "old_status": F.col("status"),
            "status": F.lit(C.PENDING),
            "worker_id": F.lit(""),
            # Fixed value: message of a reset by the monitor.
            "error_message": F.lit("Reset by stuck monitor"),
            "updated_at": now,
        }
    )


def latest_update(updates: DataFrame, keys=("job_id", "task_id"), seq: str = "seq") -> DataFrame:
    """Last update per task in arrival order (W3); combines map-side."""
    rest = [c for c in updates.columns if c not in keys]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), seq).alias("_row"))
        .select(*[F.col(k) if k in keys else F.col(f"_row.{k}") for k in updates.columns])
    )


def transitions(
    events: DataFrame,
    keys=("job_id", "task_id"),
    seq: str = "seq",
    initial: str = C.PENDING,
    parts: int | None = None,
) -> DataFrame:
    """(old_status, new_status) moves per task; repeats of the same state are dropped.

    The first event of a task moves from ``initial`` (tasks are created pending).
    """
    return (
        carry_last(events, list(keys), seq, F.col("status"), "old_status", parts)
        .withColumn("old_status", F.coalesce("old_status", F.lit(initial)))
        .withColumnRenamed("status", "new_status")
        .filter("old_status <> new_status")
    )


def bucket_of(status, kind: str) -> Column:
    """Counter a state belongs to; unknown states of copy tasks count nowhere."""
    s = C.col(status)
    out = F.when(s == C.PENDING, "pending").when(s == C.COMPLETED, "success").when(s == C.FAILED, "failed")
    return out.otherwise("running") if kind == "download" else out.when(s == C.RUNNING, "running")


def transition_deltas(moves: DataFrame, kind: str = "copy") -> DataFrame:
    """Net change of each counter per job (A5): one partial-then-final aggregate."""
    old, new = bucket_of("old_status", kind), bucket_of("new_status", kind)

    def net(name):
        into = F.coalesce((new == name).cast("long"), F.lit(0))
        out_of = F.coalesce((old == name).cast("long"), F.lit(0))
        return F.sum(into - out_of).alias(f"{name}_delta")

    return moves.groupBy("job_id").agg(*[net(name) for name in COUNTED])


def success_bytes(moves: DataFrame) -> DataFrame:
    """Bytes added per job by moves into ``COMPLETED``."""
    return (
        moves.filter((F.col("new_status") == C.COMPLETED) & (F.col("old_status") != C.COMPLETED) & (F.col("size") > 0))
        .groupBy("job_id")
        .agg(F.sum("size").alias("success_bytes"))
    )


def apply_deltas(jobs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters and status of jobs after a batch of net changes.

    Deltas are summed before they are clamped at zero; the status is decided on the old counters
    plus the delta, first rule wins.
    """
    joined = jobs.join(deltas, "job_id", "left")
    moved = {n: F.greatest(F.lit(0), F.col(f"{n}_count") + F.coalesce(f"{n}_delta", F.lit(0))) for n in COUNTED}
    touched = F.coalesce(*[F.col(f"{n}_delta") for n in COUNTED]).isNotNull()
    status = (
        F.when(touched & (F.col("status") == C.PENDING) & (moved["running"] > 0), F.lit(C.RUNNING))
        .when(
            touched & (F.col("status") == C.RUNNING) & (moved["pending"] <= 0) & (moved["running"] <= 0),
            F.lit(C.COMPLETED),
        )
        .otherwise(F.col("status"))
    )
    changes = {f"{n}_count": F.when(touched, moved[n]).otherwise(F.col(f"{n}_count")) for n in COUNTED}
    if "success_bytes" in deltas.columns:
        changes["success_size_bytes"] = F.col("success_size_bytes") + F.coalesce("success_bytes", F.lit(0))
    return joined.withColumns({**changes, "status": status}).select(*jobs.columns)


def task_counts(tasks: DataFrame) -> DataFrame:
    """Counters and bytes per job derived from its tasks (A3); the truth the stored counters should match."""
    def n(state):
        return F.count_if(F.col("status") == state)

    return tasks.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        *[n(state).alias(f"{name}_count") for name, state in COUNTED.items()],
        F.sum(F.coalesce("size", F.lit(0))).alias("total_size_bytes"),
        F.sum(F.when(F.col("status") == C.COMPLETED, F.col("size")).otherwise(0)).alias("success_size_bytes"),
    )


def absolute_progress(reports: DataFrame, seq: str = "seq") -> DataFrame:
    """Job counters from absolute reports (A9): largest total seen, latest outcomes, rest pending.

    Reports without any count carry no progress and are passed over.
    """
    told = reports.filter("total_count > 0 or success_count > 0 or failed_count > 0")
    last = F.max_by(F.struct("total_count", "success_count", "failed_count", "status"), seq)
    return (
        told.groupBy("job_id")
        .agg(F.max("total_count").alias("top"), last.alias("l"))
        .select(
            "job_id",
            F.col("top").alias("total_count"),
            F.col("l.success_count").alias("success_count"),
            F.col("l.failed_count").alias("failed_count"),
            F.greatest(
                F.lit(0), F.col("l.total_count") - F.col("l.success_count") - F.col("l.failed_count")
            ).alias("pending_count"),
            F.col("l.status").alias("status"),
        )
    )


def ready_candidates(tasks: DataFrame, jobs: DataFrame, per_job: int, total: int) -> DataFrame:
    """Next pending tasks by id, at most ``per_job`` of a job and ``total`` overall.

    The per-job rank is a top-k window, which Spark limits before the shuffle
    (``WindowGroupLimit``), so a huge job sends at most ``per_job`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("id"))
    return (
        tasks.filter(F.col("status") == C.PENDING)
        .join(active_jobs(jobs, "copy").select("job_id"), "job_id", "left_semi")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= per_job)
        .orderBy("rank", "job_id", "id")
        .limit(total)
    )


def linked_job_status(links: DataFrame, downloads: DataFrame, copies: DataFrame, merges: DataFrame) -> DataFrame:
    """Each link row with status and counts of its download, copy and merge job."""
    out = links
    for name, jobs in (("download", downloads), ("copy", copies), ("merge", merges)):
        picked = jobs.select(
            F.col("job_id").alias(f"{name}_job_id"),
            F.col("status").alias(f"{name}_status"),
            F.col("total_count").alias(f"{name}_total"),
            F.col("success_count").alias(f"{name}_success"),
            F.col("failed_count").alias(f"{name}_failed"),
        )
        out = out.join(picked, f"{name}_job_id", "left")
    return out


def keyset_scan(df: DataFrame, after_id: int, n: int, by: str = "id") -> DataFrame:
    """Next ``n`` rows with id above ``after_id`` (O3); the bound reaches the scan."""
    return df.filter(F.col(by) > after_id).orderBy(by).limit(n)


def jobs_with_meta(jobs: DataFrame, meta: DataFrame) -> DataFrame:
    """Jobs with client and endpoint; an unknown client reads ``meta-<id>``."""
    dim = meta.select(F.col("id").alias("metadata_id"), "client_name", "endpoint")
    return jobs.join(dim, "metadata_id", "left").withColumn(
        "client_name", F.coalesce("client_name", F.concat(F.lit("meta-"), F.col("metadata_id").cast("string")))
    )
