"""Reconciliation of stale and unconfirmed work, retries, streaks and load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.operators.inventory import plan_dest_keys
from mediaops.operators.intake import is_retryable
from mediaops.operators.merges import reset_columns
from mediaops.operators.ordered import PART, carry_last, dealt, number_rows

CLAIM_STALE_SECONDS = 20 * 60
RUNNING_STALE_SECONDS = 15 * 60
CHECKPOINT_TTL_SECONDS = 72 * 3600

# Messages of the reconciler.
CLAIM_FAILED = (
    "reconciler marked claimed RUNNING task as FAILED: activation was never observed before the stale threshold"
)
RUNNING_FAILED = "reconciler marked stale RUNNING task as FAILED: no completion evidence found"


def completion_evidence(pending: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows with ``evidence``: the destination object exists and its size fits.

    ``pending``: dst_bucket, dst_key, size (an expected size of zero accepts any).
    """
    there = inventory.select(
        F.col("bucket").alias("dst_bucket"),
        F.col("key").alias("dst_key"),
        F.col("size").alias("_there"),
    )
    fits = F.col("_there").isNotNull() & ((F.col("size") <= 0) | (F.col("_there") == F.col("size")))
    return (
        pending.join(there, ["dst_bucket", "dst_key"], "left").withColumn("evidence", fits).drop("_there")
    )


def reconcile_completions(compensations: DataFrame, tasks: DataFrame, inventory: DataFrame) -> DataFrame:
    """Compensation rows with ``action`` (J9): drop reasons, ``complete`` or ``wait``."""
    held = tasks.select(
        "job_id",
        F.col("id").alias("task_id"),
        F.col("status").alias("_status"),
        F.coalesce("run_token", F.lit("")).alias("_held"),
    )
    action = (
        F.when(F.col("_status").isNull(), "drop_no_task")
        .when((F.col("_held") == "") | (F.col("_held") != F.col("run_token")), "drop_token")
        .when(F.col("_status") == C.COMPLETED, "drop_completed")
        .when(F.col("evidence"), "complete")
        .otherwise("wait")
    )
    return (
        completion_evidence(compensations, inventory)
        .join(held, ["job_id", "task_id"], "left")
        .withColumn("action", action)
        .drop("_status", "_held", "evidence")
    )


def stale_verdicts(
    markers: DataFrame, tasks: DataFrame, jobs: DataFrame, meta: DataFrame, inventory: DataFrame, as_of
) -> DataFrame:
    """Verdict on tasks whose claim or run marker went stale (J8 after T3, input of M7).

    Markers whose task left that run, or whose job is gone, yield no verdict.
    """
    now = C.ts(as_of)
    limit = F.when(F.col("kind") == "claimed", CLAIM_STALE_SECONDS).otherwise(RUNNING_STALE_SECONDS)
    stale = markers.filter(F.col("kind").isin("claimed", "last_seen")).filter(
        F.unix_timestamp("ts") <= F.unix_timestamp(now) - limit
    )
    live = tasks.filter(F.col("status") == C.RUNNING).select(
        "job_id", F.col("id").alias("task_id"), "run_token", "src", "size"
    )
    doubtful = stale.select("job_id", "task_id", "run_token", "kind").join(
        live, ["job_id", "task_id", "run_token"]
    )
    judged = completion_evidence(plan_dest_keys(doubtful, jobs, meta), inventory)
    claimed = F.col("kind") == "claimed"
    return judged.select(
        "job_id",
        F.col("task_id").alias("id"),
        "kind",
        F.when(F.col("evidence"), F.lit(C.COMPLETED)).otherwise(F.lit(C.FAILED)).alias("verdict"),
        F.when(F.col("evidence"), F.lit(""))
        .when(claimed, F.lit(CLAIM_FAILED))
        .otherwise(F.lit(RUNNING_FAILED))
        .alias("verdict_message"),
        F.when(F.col("evidence"), F.col("size")).otherwise(F.lit(0)).alias("verdict_size"),
    )


def orphans(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Tasks whose job no longer exists."""
    return tasks.join(jobs.select("job_id"), "job_id", "left_anti")


def marker_cleanup(markers: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runtime markers to delete with their removed tasks, and those that remain."""
    keys = ["job_id", "task_id"]
    gone = removed.select(*keys).distinct()
    return markers.join(gone, keys, "left_semi"), markers.join(gone, keys, "left_anti")


def retry_outcome(tasks: DataFrame, scheduled: DataFrame, auto_retry: bool, as_of) -> DataFrame:
    """Failed tasks with the outcome of a manual retry (M6): reset, skip_permanent or skip_scheduled."""
    marks = scheduled.select("job_id", F.col("task_id").alias("id")).distinct().withColumn("_due", F.lit(True))
    outcome = F.when(~is_retryable("copy"), "skip_permanent")
    if auto_retry:
        outcome = outcome.when(F.col("_due"), "skip_scheduled")
    return (
        tasks.filter(F.col("status") == C.FAILED)
        .join(marks, ["job_id", "id"], "left")
        .withColumn("outcome", outcome.otherwise("reset"))
        .drop("_due")
    )


def apply_retry(outcomes: DataFrame, as_of) -> DataFrame:
    """Tasks of ``retry_outcome`` with the reset ones put back to pending."""
    reset = F.col("outcome") == "reset"
    changes = {k: v for k, v in reset_columns(as_of).items() if k in outcomes.columns}
    return outcomes.withColumns({k: F.when(reset, v).otherwise(F.col(k)) for k, v in changes.items()})


def retry_counts(outcomes: DataFrame) -> DataFrame:
    """Per job: tasks reset, skipped for either reason, and the smallest reset id (M6)."""
    o = F.col("outcome")
    return outcomes.groupBy("job_id").agg(
        F.count_if(o == "reset").alias("reset_count"),
        F.count_if(o == "skip_permanent").alias("skipped_permanent"),
        F.count_if(o == "skip_scheduled").alias("skipped_scheduled"),
        F.min(F.when(o == "reset", F.col("id"))).alias("min_reset_id"),
    )


def retry_rewind(resets: DataFrame, offsets: DataFrame, sharded: bool = True) -> DataFrame:
    """Read offset per job after resets (A21): one below the smallest reset id, never forward.

    Legacy layouts restart at zero.
    """
    first = resets.groupBy("job_id").agg(F.min("id").alias("_min"))
    target = F.greatest(F.lit(0), F.col("_min") - 1) if sharded else F.lit(0)
    return (
        offsets.join(first, "job_id", "left")
        .withColumn("rewound", F.col("_min").isNotNull() & (F.col("read_offset") > target))
        .withColumn("new_offset", F.when(F.col("rewound"), target).otherwise(F.col("read_offset")))
        .drop("_min")
    )


def stuck_offsets(jobs: DataFrame, ledger: DataFrame, offsets: DataFrame) -> DataFrame:
    """Jobs with pending work whose read offset passed the largest id: offset back to zero."""
    top = ledger.groupBy("job_id").agg(F.max("id").alias("max_id"))
    return (
        jobs.filter(F.col("pending_count") > 0)
        .select("job_id", "pending_count")
        .join(offsets, "job_id")
        .join(top, "job_id")
        .filter((F.col("max_id") > 0) & (F.col("read_offset") >= F.col("max_id")))
        .withColumn("new_offset", F.lit(0).cast("long"))
    )


def due_batch(due: DataFrame, as_of, n: int, at: str = "ts", tie: tuple[str, ...] = ("job_id", "task_id")) -> DataFrame:
    """Oldest ``n`` entries due by ``as_of`` (O4): a top-k, not a full sort."""
    return due.filter(F.col(at) <= C.ts(as_of)).orderBy(at, *tie).limit(n)


def default_cap(max_workers: Column, reserved: Column, backlog: Column) -> Column:
    """Slots of the default pool: the reservation holds only while a resume backlog exists."""
    return F.when(max_workers <= 0, F.lit(0)).when(backlog <= 0, max_workers).otherwise(
        F.greatest(F.lit(0), max_workers - reserved)
    )


def pool_load(
    inflight: DataFrame, resume_index: DataFrame, as_of, max_workers: int = 64, reserved: int = 16
) -> DataFrame:
    """One row (A17): work in flight per pool, unexpired resume backlog, cap and free slots."""
    busy = inflight.select("pool", "job_id", "task_id", "run_token").distinct().agg(
        F.count_if(F.col("pool") == "default").alias("default_in_flight"),
        F.count_if(F.col("pool") == "resume").alias("resume_in_flight"),
    )
    backlog = (
        resume_index.filter(F.unix_timestamp("expires_at") >= F.unix_timestamp(C.ts(as_of)))
        .select("job_id", "task_id")
        .distinct()
        .agg(F.count(F.lit(1)).alias("n"))
        .scalar()
    )
    top, kept = F.lit(max_workers).cast("long"), F.lit(reserved).cast("long")
    free = F.greatest(F.lit(0), top - F.col("default_in_flight") - F.col("resume_in_flight"))
    return (
        busy.withColumn("resume_backlog", backlog)
        .withColumn("default_cap", default_cap(top, kept, F.col("resume_backlog")))
        .withColumns(
            {
                "resume_free": free,
                "default_free": F.least(
                    free, F.greatest(F.lit(0), F.col("default_cap") - F.col("default_in_flight"))
                ),
            }
        )
    )


def no_progress_streak(
    attempts: DataFrame, limit: int = 5, parts: int | None = None, keys=("job_id", "task_id")
) -> DataFrame:
    """Consecutive resumed attempts without a new part, and whether to abandon the upload.

    The streak is the distance from the last attempt that progressed or started afresh.
    """
    keys = list(keys)
    resets = ~F.col("resumed") | (F.col("after_parts") > F.col("before_parts"))
    numbered = number_rows(dealt(attempts, keys, "attempt", parts), keys, "attempt", "_pos")
    return (
        carry_last(numbered, keys, "attempt", F.when(resets, F.col("_pos")), "_reset", strict=False)
        .withColumn("streak", F.col("_pos") - F.coalesce("_reset", F.lit(0)))
        .withColumn("abandon", F.col("streak") >= limit)
        .drop("_pos", "_reset", PART)
    )


def endpoint_health(requests: DataFrame, key: str = "endpoint", seq: str = "seq", parts: int | None = None) -> DataFrame:
    """Per endpoint: requests, last state and trailing failure streak.

    Positions make the streak a difference of two maxima, so a hot endpoint still combines map-side.
    """
    bad = (F.coalesce("error", F.lit("")) != "") | F.col("status").isNull() | ~F.col("status").between(200, 399)
    last_good = F.coalesce(F.max(F.when(~F.col("bad"), F.col("_pos"))), F.lit(0))
    return (
        number_rows(requests.withColumn("bad", bad), [key], seq, "_pos", parts)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("bad")).alias("failures"),
            (F.max("_pos") - last_good).alias("fail_streak"),
            F.max("ts").alias("last_check"),
        )
        .withColumn("state", F.when(F.col("fail_streak") >= 1, "offline").otherwise("online"))
    )


def retry_or_fail(failures: DataFrame, max_retries: int = 3, parts: int | None = None, seq: str = "attempt") -> DataFrame:
    """Failures numbered per task (W12): below ``max_retries`` requeue, from there on permanent."""
    return number_rows(failures, ["job_id", "task_id"], seq, "failure_no", parts).withColumn(
        "action", F.when(F.col("failure_no") < max_retries, "requeue").otherwise("permanent")
    )
