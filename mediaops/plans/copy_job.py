"""Whole jobs composed from the operators: plan a copy job, sync two listings, retry failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.operators import inventory as inv
from mediaops.operators import parts, reconcile


def plan_new_tasks(inventory: DataFrame, jobs: DataFrame, ledger: DataFrame, as_of) -> DataFrame:
    """Pending tasks for the objects of due jobs: filter by globs, drop known keys, number them.

    Listing rows of jobs that are not due fall out of the glob join, before the dedup shuffle.
    """
    from mediaops.operators.ledger import due_jobs

    wanted = inv.glob_filter(inventory, due_jobs(jobs, as_of))
    fresh = inv.new_inputs(wanted, ledger)
    now = C.ts(as_of)
    return inv.allocate_ids(fresh, ledger).select(
        "id",
        "job_id",
        F.col("key").alias("src"),
        "size",
        F.lit("").alias("run_token"),
        F.lit(C.PENDING).alias("status"),
        F.lit("").alias("error_message"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def plan_transfers(tasks: DataFrame, jobs: DataFrame, meta: DataFrame, allow_empty: bool = False, **policy) -> DataFrame:
    """Part rows with destination of the tasks that may move: zero-size rule, keys, part ranges."""
    ready = inv.zero_size_policy(tasks, allow_empty).filter(F.col("status") == C.PENDING)
    return parts.plan_parts(inv.plan_dest_keys(ready, jobs, meta), **policy)


def plan_sync(src: DataFrame, dst: DataFrame, **policy) -> DataFrame:
    """Part rows of the objects that are new or changed at the destination."""
    moving = inv.sync_diff(src, dst).filter("state <> 'same'")
    return parts.plan_parts(moving, policy.pop("policy", "aligned"), **policy)


def retry_failed(
    tasks: DataFrame, scheduled: DataFrame, offsets: DataFrame, as_of, auto_retry: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Manual retry: failed tasks with their outcome applied, and the rewound read offsets."""
    outcomes = reconcile.retry_outcome(tasks, scheduled, auto_retry, as_of)
    resets = outcomes.filter("outcome = 'reset'")
    return reconcile.apply_retry(outcomes, as_of), reconcile.retry_rewind(resets, offsets)
