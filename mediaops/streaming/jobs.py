"""Streams over stored tables and on Spark's own windows: counters, fences, objects, metrics, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.functions import columns as C
from mediaops.operators import inventory as inv
from mediaops.operators import ledger, merges
from mediaops.operators.ordered import carry_last
from mediaops.sources import changes
from mediaops.sources.files import exists, remove
from mediaops.sources.sinks import IDS_PER_BUCKET, upsert_ledger, write_ledger
from mediaops.streaming.run import HASHES_PER_BUCKET, hashed, read_stage, read_stages, run_batches, write_stage
from mediaops.streaming.state import ANSWER, KEY, TOKENS, judge_messages

WATERMARK = "10 minutes"
SEEN = "job_id long, id long, seq long, status string"
# A job is one row: fewer folders than for tasks.
JOB_BUCKETS = 64
DELTAS = "job_id long, pending_delta long, running_delta long, success_delta long, failed_delta long, success_bytes long"


def batch_moves(seen: DataFrame, batch: DataFrame) -> DataFrame:
    """(old, new) moves of a batch, the first of each task from its known state (pending when new).

    Events older than the known state are ignored. The same moves as ``transitions`` gives over all
    events at once, however they are cut into batches.
    """
    known = seen.select(*KEY, F.col("seq").alias("_seq"), F.col("status").alias("_status"))
    fresh = (
        batch.select(*KEY, "seq", "status", "size")
        .join(known, KEY, "left")
        .filter(F.col("_seq").isNull() | (F.col("seq") > F.col("_seq")))
    )
    return (
        carry_last(fresh, KEY, "seq", F.col("status"), "old_status")
        .withColumn("old_status", F.coalesce("old_status", "_status", F.lit(C.PENDING)))
        .withColumnRenamed("status", "new_status")
        .filter("old_status <> new_status")
        .drop("_seq", "_status")
    )


def _latest_seen(seen: DataFrame, batch: DataFrame) -> DataFrame:
    return ledger.latest_update(seen.unionByName(batch.select(*KEY, "seq", "status")), KEY)


def job_deltas(moves: DataFrame, kind: str = "copy") -> DataFrame:
    """Counter changes and success bytes per job of one batch of moves."""
    return (
        ledger.transition_deltas(moves, kind)
        .join(ledger.success_bytes(moves), "job_id", "left")
        .na.fill(0, ["success_bytes"])
    )


def follow_tasks(
    events: DataFrame,
    path: str,
    also: Callable[[DataFrame, int], None],
    ids_per_bucket: int = IDS_PER_BUCKET,
    checkpoint: str | None = None,
) -> None:
    """Keep the last status of every task below ``path`` and hand each batch's moves to ``also``.

    The moves are handed over before the state advances, so a repeated batch sees the same moves.
    """
    path = path.rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        upsert_ledger(
            batch,
            f"{path}/seen",
            _latest_seen,
            f"{path}/stage/batch={batch_id}",
            ids_per_bucket,
            schema=SEEN,
            before=lambda current, rows: also(batch_moves(current, rows), batch_id),
        )

    run_batches(events.select(*KEY, "seq", "status", "size"), handle, path, checkpoint)


def stream_job_counters(events: DataFrame, path: str, kind: str = "copy", checkpoint: str | None = None) -> DataFrame:
    """Running per-job counters from status events (T1): the sum of each micro-batch's changes."""
    follow_tasks(events, path, lambda moves, n: write_stage(job_deltas(moves, kind), f"{path}/deltas", n, lasting=True), checkpoint=checkpoint)
    return running_counters(events.sparkSession, path)


def running_counters(spark: SparkSession, path: str) -> DataFrame:
    names = [f.split()[0] for f in DELTAS.split(", ")][1:]
    return read_stages(spark, f"{path}/deltas", DELTAS).groupBy("job_id").agg(*[F.sum(n).alias(n) for n in names])


def stream_completion_monitor(
    events: DataFrame, jobs: DataFrame, path: str, as_of=None, checkpoint: str | None = None
) -> DataFrame:
    """Job table after each trigger: counters moved, finished jobs completed.

    The table is stored once; the first batch judges all jobs, a later one the jobs whose counters it moves,
    as no other can finish then. Changed jobs are written beside the table and folded in like a ledger's
    (``id`` is 0, so ``jobs`` must not have that column). Returns the table after the last batch.
    """
    spark = events.sparkSession
    path = path.rstrip("/")
    table, schema = f"{path}/jobs", T.StructType([*jobs.schema.fields, T.StructField("id", T.LongType())])
    if "id" in jobs.columns:
        raise ValueError("jobs are stored by job_id and id: rename their column id")

    def step(moves: DataFrame, batch_id: int) -> None:
        if not exists(spark, f"{table}/_SUCCESS"):
            write_ledger(jobs.withColumn("id", F.lit(0).cast("long")), table, buckets=JOB_BUCKETS)
        write_stage(job_deltas(moves), f"{path}/deltas", batch_id)
        deltas = read_stage(spark, f"{path}/deltas", batch_id, DELTAS)
        due = deltas if batch_id else jobs.select("job_id").distinct().join(deltas, "job_id", "left")
        now = as_of if as_of is not None else F.current_timestamp()
        upsert_ledger(
            due.withColumn("id", F.lit(0).cast("long")),
            table,
            lambda current, rows: ledger.complete_jobs(ledger.apply_deltas(current, rows.drop("id")), now),
            f"{path}/stage-jobs/batch={batch_id}",
            schema=schema,
            buckets=JOB_BUCKETS,
        )
        remove(spark, f"{path}/deltas/batch={batch_id - 1}")

    follow_tasks(events, path, step, checkpoint=checkpoint)
    if not exists(spark, f"{table}/_SUCCESS"):
        return jobs
    return changes.read_rows(spark, table, schema).select(*jobs.columns)


def stream_fenced_state(
    messages: DataFrame, path: str, ids_per_bucket: int = IDS_PER_BUCKET, checkpoint: str | None = None
) -> DataFrame:
    """Latest task state under run-token fencing (T7): an answer per message, split by ``accepted``.

    A batch is judged once; tokens and states follow from its answers and are written beside those kept by
    id range. No watermark applies: late messages are judged, not dropped.
    """
    spark = messages.sparkSession
    path = path.rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        def answer(current: DataFrame, rows: DataFrame) -> None:
            write_stage(judge_messages(current, rows), f"{path}/out", batch_id, lasting=True)

        def advance(current: DataFrame, rows: DataFrame) -> DataFrame:
            answers = read_stage(spark, f"{path}/out", batch_id, ANSWER)
            return ledger.latest_update(answers.select(*KEY, "seq", "run_token", "status"), KEY).drop("seq")

        upsert_ledger(batch, f"{path}/tokens", advance, f"{path}/stage/batch={batch_id}", ids_per_bucket, schema=TOKENS, before=answer)

    run_batches(messages.select(*KEY, "seq", "kind", "run_token", "status"), handle, path, checkpoint)
    return read_stages(spark, f"{path}/out", ANSWER)


def new_objects(inventory: DataFrame) -> DataFrame:
    """Objects once per job across rescans, from the stream's own state (T4).

    State grows with the number of keys; ``stream_new_objects`` keeps it by hash range in the shared folder instead.
    """
    return inventory.dropDuplicates(["job_id", "key"])


FOUND = "job_id long, id long, src string, size long, pos long, status string"
KNOWN = "job_id long, id long, src string"
TOPS = "job_id long, id long"


def stream_new_objects(
    inventory: DataFrame, path: str, hashes_per_bucket: int = HASHES_PER_BUCKET, checkpoint: str | None = None
) -> DataFrame:
    """Discovered objects become pending tasks once per job (T4).

    Keys seen are kept by job and hash range, with the largest id of each job: a batch opens the ranges of
    its own keys and writes those it adds, the tasks of earlier batches are not read. A repeated batch does
    not see its own first attempt and rewrites the same directory.
    """
    spark = inventory.sparkSession
    path = path.rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        def find(current: DataFrame, rows: DataFrame) -> None:
            tops = read_stage(spark, f"{path}/tops", batch_id - 1, TOPS)
            fresh = inv.new_inputs(rows.drop("id"), current)
            tasks = inv.allocate_ids(fresh, tops).select(
                "job_id", "id", F.col("key").alias("src"), "size", "pos", F.lit(C.PENDING).alias("status")
            )
            write_stage(tasks, f"{path}/out", batch_id, lasting=True)
            found = read_stage(spark, f"{path}/out", batch_id, FOUND).select("job_id", "id")
            write_stage(tops.unionByName(found).groupBy("job_id").agg(F.max("id").alias("id")), f"{path}/tops", batch_id)

        def add(current: DataFrame, rows: DataFrame) -> DataFrame:
            found = read_stage(spark, f"{path}/out", batch_id, FOUND).select("job_id", hashed("src").alias("id"), "src")
            # known keys with the number of a new one are written with it
            beside = current.join(found, ["job_id", "id"], "left_semi")
            return found.unionByName(beside)

        upsert_ledger(
            batch.select("job_id", "key", "pos", "size", hashed("key").alias("id")),
            f"{path}/known",
            add,
            f"{path}/stage/batch={batch_id}",
            hashes_per_bucket,
            schema=KNOWN,
            before=find,
            removes=False,
        )
        remove(spark, f"{path}/tops/batch={batch_id - 2}")

    run_batches(inventory, handle, path, checkpoint)
    return read_stages(spark, f"{path}/out", FOUND)


def outcome_windows(log: DataFrame, at: str = "event_ts", delay: str = WATERMARK, width: str = "1 minute") -> DataFrame:
    """Outcomes and latency per tumbling minute."""
    return (
        log.withColumn(at, F.col(at).cast("timestamp"))
        .withWatermark(at, delay)
        .groupBy(F.window(at, width).alias("w"), "outcome")
        .agg(
            F.count(F.lit(1)).alias("tasks"),
            F.sum("duration_ms").alias("duration_ms"),
            F.max("duration_ms").alias("max_ms"),
        )
        .select("w.start", "outcome", "tasks", "duration_ms", "max_ms")
    )


def request_rate(
    log: DataFrame, at: str = "event_ts", delay: str = WATERMARK, width: str = "60 seconds", step: str = "5 seconds"
) -> DataFrame:
    """Requests per machine in the last minute, every five seconds."""
    return (
        log.withColumn(at, F.col(at).cast("timestamp"))
        .withWatermark(at, delay)
        .groupBy(F.window(at, width, step).alias("w"), "machine")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("w.start", "machine", "requests")
    )


def worker_sessions(log: DataFrame, at: str = "event_ts", delay: str = WATERMARK, gap: str = "15 minutes") -> DataFrame:
    """Activity sessions per worker, ended by fifteen silent minutes.

    Sessions are merged where they are read first (a session setting), so a busy worker moves few rows.
    """
    return (
        log.withColumn(at, F.col(at).cast("timestamp"))
        .withWatermark(at, delay)
        .groupBy(F.session_window(at, gap).alias("w"), "worker_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("worker_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
    )


def stream_upsert(
    updates: DataFrame,
    ledger_path: str,
    stage_root: str,
    fenced: bool = True,
    ids_per_bucket: int = IDS_PER_BUCKET,
    checkpoint: str | None = None,
) -> None:
    """Apply each micro-batch of updates to the stored ledger (T10), idempotent by batch id.

    A batch writes the rows it changes beside the ledger; ``ids_per_bucket`` must be the ledger's and
    ``changes.read_rows`` reads it. Stages and the checkpoint lie below ``stage_root``: a later run with
    the same root takes up new updates only.
    """

    def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
        return merges.merge_fenced(current, batch)[0] if fenced else merges.merge_patch(current, batch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        upsert_ledger(batch, ledger_path, merge, f"{stage_root.rstrip('/')}/batch={batch_id}", ids_per_bucket)

    run_batches(updates, handle, stage_root, checkpoint)
