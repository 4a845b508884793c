"""Updates applied to stored tables: patches, fenced updates, overwrites, commands.

A batch holds several updates per task, to be applied in order. Each merge is written as aggregates
over the batch (last given value, first time of a state), which Spark combines before the shuffle:
a task with millions of updates costs one row per map task, and no update is replayed one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.operators.ordered import carry_last

TASK = ["job_id", "id"]
RESTART = [C.RUNNING, C.PENDING, C.METADATA_PROCESSING]
STARTED = [C.RUNNING, C.METADATA_PROCESSING]
ENDED = [C.COMPLETED, C.FAILED]


def last_given(value: Column, given: Column, seq: str) -> Column:
    """Value of the last row (by ``seq``) on which ``given`` holds; null when there is none."""
    return F.max_by(value, F.when(given, F.col(seq)))


def first_given(value: Column, given: Column, seq: str) -> Column:
    return F.min_by(value, F.when(given, F.col(seq)))


def _has(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


PATCH_TEXT = ["url", "title", "video_id", "audio_url", "video_url", "worker_id"]
PATCH_SIZE = ["audio_size", "video_size"]


def merge_patch(ledger: DataFrame, updates: DataFrame, seq: str = "seq", at: str = "event_ts") -> DataFrame:
    """Apply partial updates to download tasks (M1).

    Empty text and zero sizes mean "keep"; a restart clears error and failure flag; start and end
    times are set once; updates of unknown tasks are ignored.
    """
    restart = F.col("status").isin(RESTART)
    texts = [c for c in PATCH_TEXT if c in updates.columns and c in ledger.columns]
    sizes = [c for c in PATCH_SIZE if c in updates.columns and c in ledger.columns]
    flagged = "is_download_fail" in updates.columns and "is_download_fail" in ledger.columns
    folds = [
        last_given(F.col("status"), _has("status"), seq).alias("_status"),
        last_given(
            F.when(restart, F.lit("")).otherwise(F.col("error_message")),
            F.coalesce(restart, F.lit(False)) | _has("error_message"),
            seq,
        ).alias("_error"),
        F.min(F.when(F.col("status").isin(STARTED), F.col(at))).alias("_started"),
        F.min(F.when(F.col("status").isin(ENDED), F.col(at))).alias("_ended"),
        F.max(at).alias("_touched"),
    ]
    folds += [last_given(F.col(c), _has(c), seq).alias(f"_{c}") for c in texts]
    folds += [last_given(F.col(c), F.col(c) != 0, seq).alias(f"_{c}") for c in sizes]
    if flagged:
        fold = last_given(
            ~F.coalesce(restart, F.lit(False)),
            F.coalesce(restart, F.lit(False)) | F.coalesce("is_download_fail", F.lit(False)),
            seq,
        )
        folds.append(fold.alias("_flag"))
    batch = updates.groupBy(*TASK).agg(*folds)
    changes = {
        "status": F.coalesce("_status", "status"),
        "error_message": F.coalesce("_error", "error_message"),
        "started_at": F.coalesce("started_at", "_started"),
        "completed_at": F.coalesce("completed_at", "_ended"),
        "updated_at": F.coalesce("_touched", "updated_at"),
        **{c: F.coalesce(f"_{c}", c) for c in texts + sizes},
    }
    if flagged:
        changes["is_download_fail"] = F.coalesce("_flag", "is_download_fail")
    return ledger.join(batch, TASK, "left").withColumns(changes).select(*ledger.columns)


def _fenced_batch(updates: DataFrame, seq: str, at: str) -> DataFrame:
    """One row per (task, token) of the batch: everything the merge needs, combined before the shuffle."""
    return (
        updates.withColumn("_token", F.coalesce("run_token", F.lit("")))
        .groupBy(*TASK, "_token")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(seq).alias("_first"),
            F.max(seq).alias("_last"),
            F.max(F.when(_has("status"), F.struct(seq, "status"))).alias("_status"),
            F.max(F.struct(F.col(seq), F.coalesce("error_message", F.lit("")).alias("error_message"))).alias("_error"),
            F.max(F.when(F.col("size") > 0, F.struct(seq, "size"))).alias("_size"),
            F.max(F.when(_has("worker_id"), F.struct(seq, "worker_id"))).alias("_worker"),
            F.min(F.when(F.col("status") == C.RUNNING, F.col(at))).alias("_started"),
            F.min(F.when(F.col("status").isin(ENDED), F.col(at))).alias("_ended"),
            F.min(F.struct(F.col(seq), F.col(at).alias("at"), F.coalesce("status", F.lit("")).alias("status"))).alias(
                "_head"
            ),
            F.max(at).alias("_touched"),
        )
    )


def merge_fenced(
    ledger: DataFrame, updates: DataFrame, seq: str = "seq", at: str = "event_ts"
) -> tuple[DataFrame, DataFrame]:
    """Apply copy-task updates under the run token (M2): returns ``(ledger, conflicts)``.

    The token in force is the ledger's, or the first one given in the batch when the ledger has
    none. An update with another token is a conflict and changes nothing. Accepted updates
    overwrite the error text even with an empty one.
    """
    batch = _fenced_batch(updates, seq, at)
    held = ledger.select(*TASK, F.coalesce("run_token", F.lit("")).alias("_held"))
    first = (
        batch.filter("_token <> ''")
        .groupBy(*TASK)
        .agg(F.min_by("_token", "_first").alias("_first_token"))
    )
    force = F.coalesce(F.nullif("_held", F.lit("")), F.col("_first_token"), F.lit(""))
    judged = (
        batch.join(held, TASK)
        .join(first, TASK, "left")
        .withColumn("_force", force)
        .withColumn("_ok", F.col("_token").isin("") | (F.col("_token") == F.col("_force")))
    )
    conflicts = (
        judged.filter("not _ok").groupBy(*TASK).agg(F.sum("_n").alias("conflicts"))
    )
    folded = (
        judged.filter("_ok")
        .groupBy(*TASK)
        .agg(
            F.max("_force").alias("_force"),
            *[F.max(c).alias(c) for c in ("_status", "_error", "_size", "_worker", "_touched")],
            *[F.min(c).alias(c) for c in ("_started", "_ended", "_head")],
        )
    )

    def first_time(stored: str, seen: str, states: list[str]) -> Column:
        """First time in one of the states; an update without a status keeps the stored state."""
        kept = F.col("status").isin(states) & (F.col("_head.status") == "")
        return F.coalesce(F.col(stored), F.when(kept, F.col("_head.at")), F.col(seen))

    merged = (
        ledger.join(folded, TASK, "left")
        .withColumns(
            {
                "_started_at": first_time("started_at", "_started", [C.RUNNING]),
                "_completed_at": first_time("completed_at", "_ended", ENDED),
            }
        )
        .withColumns(
            {
                "status": F.coalesce(F.col("_status.status"), F.col("status")),
                "error_message": F.coalesce(F.col("_error.error_message"), F.col("error_message")),
                "size": F.coalesce(F.col("_size.size"), F.col("size")),
                "worker_id": F.coalesce(F.col("_worker.worker_id"), F.col("worker_id")),
                "run_token": F.coalesce("_force", "run_token"),
                "started_at": F.col("_started_at"),
                "completed_at": F.col("_completed_at"),
                "updated_at": F.coalesce("_touched", "updated_at"),
            }
        )
        .select(*ledger.columns)
    )
    return merged, conflicts


RECORD_COLUMNS = [
    "status",
    "worker_id",
    "title",
    "video_id",
    "audio_url",
    "audio_size",
    "video_url",
    "video_size",
    "error_message",
]


def merge_overwrite(records: DataFrame, updates: DataFrame, as_of, seq: str = "seq") -> DataFrame:
    """Upsert task records on (job, id) (M3): matched rows take all nine columns, empty ones too.

    The first update of an unknown record creates it, so its URL and creation time come from there;
    rows with a zero key are refused.
    """
    zeros = {c: F.lit(0) if c.endswith("_size") else F.lit("") for c in RECORD_COLUMNS}
    # A column each, not a row of nine: those that nobody reads are neither sorted nor moved.
    last = [F.max_by(F.coalesce(F.col(c), zeros[c]), seq).alias(f"_u_{c}") for c in RECORD_COLUMNS]
    batch = (
        updates.filter((F.col("job_id") != 0) & (F.col("id") != 0))
        .groupBy(*TASK)
        .agg(F.max(seq).alias("_u"), *last, F.min_by("url", seq).alias("_url"))
    )
    hit = F.col("_u").isNotNull()
    old = records.withColumn("_old", F.lit(True))
    return (
        old.join(batch, TASK, "full_outer")
        .withColumns(
            {
                **{c: F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c)) for c in RECORD_COLUMNS},
                "url": F.when(F.col("_old").isNull(), F.col("_url")).otherwise(F.col("url")),
                "created_at": F.when(F.col("_old").isNull(), C.ts(as_of)).otherwise(F.col("created_at")),
                "updated_at": F.when(hit, C.ts(as_of)).otherwise(F.col("updated_at")),
            }
        )
        .select(*records.columns)
    )


def apply_job_updates(
    jobs: DataFrame, patches: DataFrame, seq: str = "seq", parts: int | None = None
) -> DataFrame:
    """Apply status patches and counter increments to jobs in order (M4).

    A patch with an end time sets the duration from its own start, else from the start known by
    then. Pending counts only fall here, so clamping the summed decrement at zero equals clamping
    each one.
    """
    begun = F.when(F.col("start_time").isNotNull(), F.col("start_time"))
    known = carry_last(patches, ["job_id"], seq, begun, "_begun", parts, strict=False)
    ended = F.col("end_time").isNotNull()
    batch = known.groupBy("job_id").agg(
        last_given(F.col("status"), _has("status"), seq).alias("_status"),
        last_given(F.col("result_message"), _has("result_message"), seq).alias("_message"),
        *[
            last_given(F.col(c), F.col(c).isNotNull(), seq).alias(f"_{c}")
            for c in ("last_scan_time", "start_time", "total_count")
        ],
        last_given(F.struct("end_time", "_begun"), ended, seq).alias("_end"),
        *[
            F.sum(F.coalesce(c, F.lit(0))).alias(f"_{c}")
            for c in ("inc_success", "inc_failed", "inc_success_bytes")
        ],
        F.count_if(F.col("inc_execution")).alias("_runs"),
    )
    began = F.coalesce(F.col("_end._begun"), F.col("start_time"))
    finished = F.col("_end.end_time")
    n = {c: F.coalesce(f"_{c}", F.lit(0)) for c in ("inc_success", "inc_failed", "inc_success_bytes")}
    return (
        jobs.join(batch, "job_id", "left")
        .withColumn(
            "duration_seconds",
            F.when(
                finished.isNotNull() & began.isNotNull(),
                C.int_div(F.unix_micros(finished.cast("timestamp")) - F.unix_micros(began.cast("timestamp")), 1_000_000),
            ).otherwise(F.col("duration_seconds")),
        )
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "result_message": F.coalesce("_message", "result_message"),
                "last_scan_time": F.coalesce("_last_scan_time", "last_scan_time"),
                "start_time": F.coalesce("_start_time", "start_time"),
                "end_time": F.coalesce(finished, F.col("end_time")),
                "total_count": F.coalesce("_total_count", "total_count"),
                "success_count": F.col("success_count") + n["inc_success"],
                "failed_count": F.col("failed_count") + n["inc_failed"],
                "success_size_bytes": F.col("success_size_bytes") + n["inc_success_bytes"],
                "pending_count": F.when(
                    n["inc_success"] + n["inc_failed"] > 0,
                    F.greatest(F.lit(0), F.col("pending_count") - n["inc_success"] - n["inc_failed"]),
                ).otherwise(F.col("pending_count")),
                "execution_count": F.col("execution_count") + F.coalesce("_runs", F.lit(0)),
            }
        )
        .select(*jobs.columns)
    )


def reset_columns(as_of) -> dict[str, Column]:
    none = F.lit(None).cast("timestamp")
    return {
        "status": F.lit(C.PENDING),
        "error_message": F.lit(""),
        "run_token": F.lit(""),
        "worker_id": F.lit(""),
        "started_at": none,
        "completed_at": none,
        "updated_at": C.ts(as_of),
    }


def reset_for_retry(tasks: DataFrame, as_of) -> DataFrame:
    """Tasks put back to pending with run fields cleared (M5)."""
    return tasks.withColumns({k: v for k, v in reset_columns(as_of).items() if k in tasks.columns})


def terminal_update(
    tasks: DataFrame, verdicts: DataFrame, as_of
) -> DataFrame:
    """Set verdict tasks to COMPLETED or FAILED (M7).

    ``verdicts``: job_id, id, verdict, verdict_message, verdict_size. Adds ``success_bytes``: the
    task's size, else the verdict's, counted only on the first completion.
    """
    picked = verdicts.filter(F.col("verdict").isin(ENDED)).select(
        *TASK, "verdict", "verdict_message", "verdict_size"
    )
    hit = F.col("verdict").isNotNull()
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(F.coalesce("verdict_size", F.lit(0)))
    first = hit & (F.col("status") != C.COMPLETED) & (F.col("verdict") == C.COMPLETED)
    now = C.ts(as_of)
    return (
        tasks.join(picked, TASK, "left")
        .withColumn("success_bytes", F.when(first, F.greatest(size, F.lit(0))).otherwise(F.lit(0)))
        .withColumns(
            {
                "status": F.coalesce("verdict", "status"),
                "error_message": F.when(hit, F.coalesce("verdict_message", F.lit(""))).otherwise(
                    F.col("error_message")
                ),
                "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
                "completed_at": F.when(hit, now).otherwise(F.col("completed_at")),
            }
        )
        .drop("verdict", "verdict_message", "verdict_size")
    )


def apply_job_commands(jobs: DataFrame, commands: DataFrame, seq: str = "seq") -> DataFrame:
    """Last command per job (M8): ``start``, ``stop``, ``delete`` (marks completed), ``rewind``.

    ``start`` clears the fields of the previous run; ``rewind`` sets the read offset to zero.
    """
    last = commands.groupBy("job_id").agg(F.max_by("command", seq).alias("_c"))
    start = F.col("_c") == "start"
    none = F.lit(None).cast("timestamp")
    changes = {
        "status": F.when(start, F.lit(C.PENDING))
        .when(F.col("_c") == "stop", F.lit(C.STOPPED))
        .when(F.col("_c") == "delete", F.lit(C.COMPLETED))
        .otherwise(F.col("status")),
        "start_time": F.when(start, none).otherwise(F.col("start_time")),
        "end_time": F.when(start, none).otherwise(F.col("end_time")),
        "last_scan_time": F.when(start, none).otherwise(F.col("last_scan_time")),
        "duration_seconds": F.when(start, F.lit(0)).otherwise(F.col("duration_seconds")),
        "result_message": F.when(start, F.lit("")).otherwise(F.col("result_message")),
        "scan_offset": F.when(F.col("_c") == "rewind", F.lit(0)).otherwise(F.col("scan_offset")),
    }
    return (
        jobs.join(last, "job_id", "left")
        .withColumns({k: v for k, v in changes.items() if k in jobs.columns})
        .select(*jobs.columns)
    )


def delete_pending(jobs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and records that stay once pending jobs are removed (M9)."""
    gone = jobs.filter(F.col("status") == C.PENDING).select("job_id")
    return jobs.filter(F.col("status") != C.PENDING), records.join(gone, "job_id", "left_anti")


def insert_tasks(ledger: DataFrame, rows: DataFrame, keys=("id",), seq: str | None = None) -> DataFrame:
    """Bulk insert by id (M10): a new row replaces a stored one; within the batch the last wins."""
    if seq is not None:
        rest = [c for c in rows.columns if c not in keys]
        rows = (
            rows.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), seq).alias("_r"))
            .select(*keys, "_r.*")
            .drop(seq)
        )
    return ledger.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows.select(*ledger.columns))


def remove_tasks(ledger: DataFrame, ids: DataFrame, keys=("job_id", "id")) -> DataFrame:
    """Ledger without the listed tasks; unknown ids are ignored."""
    return ledger.join(ids.select(*keys), list(keys), "left_anti")


def judge_checkpoint_changes(changes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Checkpoint saves and clears with a ``verdict``: ok, token_required, token_mismatch, no_upload_id."""
    task = tasks.select(
        "job_id",
        F.col("id").alias("task_id"),
        F.col("status").alias("_status"),
        F.coalesce("run_token", F.lit("")).alias("_held"),
    )
    guarded = (F.col("_status") == C.RUNNING) & (F.trim("_held") != "")
    verdict = (
        F.when((F.col("op") == "save") & C.is_blank("upload_id"), "no_upload_id")
        .when(guarded & C.is_blank("last_run_token"), "token_required")
        .when(guarded & (F.col("last_run_token") != F.col("_held")), "token_mismatch")
        .otherwise("ok")
    )
    return (
        changes.join(task, ["job_id", "task_id"], "left").withColumn("verdict", verdict).drop("_status", "_held")
    )


def merge_checkpoints(
    checkpoints: DataFrame, changes: DataFrame, tasks: DataFrame, as_of, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Save or clear multipart checkpoints (M12): returns ``(checkpoints, refused)``.

    The last accepted change of a task decides. A save replaces the row, keeps a sent creation time
    and sets ``updated_at``; a clear removes it.
    """
    keys = ["job_id", "task_id"]
    judged = judge_checkpoint_changes(changes, tasks)
    refused = judged.filter("verdict <> 'ok'")
    rest = [c for c in checkpoints.columns if c not in keys]
    body = F.struct("op", *[F.col(c) for c in rest])
    last = judged.filter("verdict = 'ok'").groupBy(*keys).agg(F.max_by(body, seq).alias("_r")).select(*keys, "_r.*")
    saved = last.filter("op = 'save'").withColumns(
        {"created_at": F.coalesce("created_at", C.ts(as_of)), "updated_at": C.ts(as_of)}
    )
    kept = checkpoints.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(saved.select(*checkpoints.columns)), refused
