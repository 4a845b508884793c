"""Queries over errors, reconciliation, retries, streaks and load."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaops.operators import errors
from mediaops.operators import reconcile as rec
from workload.inventory import DEST
from workload.registry import EVENTS_NOW, JOBS_NOW, query

# What the failures of v_errors come to, from the rules of the stage they happened in. A source's answer is judged by
# its status alone; a destination's by the store's code, then its status; without a status the text decides, and a
# read or write that says nothing known is a failed fetch. Elsewhere the code and the text decide.
TEXT_CLASS = """case when lower(error_message) like '%timeout%' then 'NetworkTimeout'
    when lower(error_message) like '%connection reset%' then 'NetworkConnectionLost'
    when lower(error_message) like '%enotfound%' then 'DnsFailure' when lower(error_message) like '%unsupported protocol%' then 'InvalidUrl' end"""
STORE_CLASS = """case when error_message like '%<Code>SlowDown</Code>%' then 'DestSlowDown'
    when error_message like '%<Code>NoSuchUpload</Code>%' then 'DestNoSuchUpload' end"""
CLASSED = f"""select *, stage as stage0, case when k in (7, 8) then json_extract_string(error_message, '$.error.code')
    when stage = 'source_fetch' and status_code > 0 then case status_code when 404 then 'SourceNotFound' when 403 then 'SourceAccessDenied'
      when 429 then 'SourceRateLimited' when 408 then 'SourceTimeout' when 400 then 'SourceFetchFailed' else 'SourceUpstreamError' end
    when stage <> 'source_fetch' and store is not null then store
    when stage = 'dest_put' and status_code > 0 then case status_code when 404 then 'DestNotFound' when 403 then 'DestAccessDenied'
      when 429 then 'DestRateLimited' when 408 then 'DestTimeout' when 400 then 'DestBadRequest' else 'DestUpstreamError' end
    when said is not null then said when stage in ('source_fetch', 'dest_put') then 'FetchFailed' else 'UnhandledError' end as error_class,
    case when k in (7, 8) or stage <> 'source_fetch' and store is not null then 'dest_put' else stage end as error_stage, k in (3, 8, 9) as fatal
  from (select *, attempt % 16 as k, {TEXT_CLASS} as said, {STORE_CLASS} as store from v_errors)"""
JUDGED = f"""select *, not fatal and (error_class in ('DestSlowDown', 'NetworkTimeout', 'NetworkConnectionLost', 'DnsFailure', 'FetchFailed',
      'SourceRateLimited', 'SourceTimeout', 'SourceUpstreamError', 'DestRateLimited', 'DestTimeout', 'DestUpstreamError')
    or error_class = 'UnhandledError' and status_code in (408, 425, 429, 500, 502, 503, 504)) as retryable from ({CLASSED})"""


@query("p11_classify_errors", f"select attempt, error_class, error_stage, retryable, fatal from ({JUDGED})")
def _(v):
    return errors.classify_errors(v.errors).select("attempt", "error_class", "error_stage", "retryable", "fatal")


@query(
    "p11_worker_verdicts",
    """with e as (select *, attempt % 16 as k from v_errors)
    select attempt, case when k in (7) then true when k in (8) then false else status_code in (408, 425, 429, 500, 502, 503, 504)
        and k not in (3, 9) end as response_retryable,
      k in (0, 1) as list_parts_retryable, k = 3 as upload_is_gone, k = 1 as download_retryable, k in (0, 1, 10, 13) as metadata_retryable
    from e""",
)
def _(v):
    m = "error_message"
    return v.errors.select(
        "attempt",
        errors.response_retryable(m, "status_code").alias("response_retryable"),
        errors.list_parts_retryable(m).alias("list_parts_retryable"),
        errors.upload_is_gone(m).alias("upload_is_gone"),
        errors.download_retryable(m).alias("download_retryable"),
        errors.metadata_retryable(m).alias("metadata_retryable"),
    )


@query(
    "a12_error_breakdown",
    f"""with j as (select * from ({JUDGED}) where status = 'FAILED'), t as (select count(*) as n from j)
    select coalesce(job_id, -1) as job_id, coalesce(error_class, 'all') as error_class, count(*) as failures,
      count(*) filter (retryable) as retryable_failures, round(count(*) / any_value(t.n), 6) as share
    from j cross join t group by cube (job_id, error_class)""",
)
def _(v):
    classified = errors.classify_errors(v.errors.filter("status = 'FAILED'"))
    return (
        errors.error_breakdown(classified)
        .drop("level")
        .fillna(-1, ["job_id"])
        .fillna("all", ["error_class"])
    )


@query(
    "j8_completion_evidence",
    """select c.job_id, c.task_id, d.size is not null and (c.size <= 0 or d.size = c.size) as evidence
    from v_comp c left join v_dst_objects d on d.bucket = c.dst_bucket and d.key = c.dst_key""",
)
def _(v):
    return rec.completion_evidence(v.comp, v.dst_objects).select("job_id", "task_id", "evidence")


ACTION = """select c.job_id, c.task_id, c.size, case when t.id is null then 'drop_no_task'
    when t.run_token = '' or t.run_token <> c.run_token then 'drop_token' when t.status = 'COMPLETED' then 'drop_completed'
    when d.size is not null and (c.size <= 0 or d.size = c.size) then 'complete' else 'wait' end as action
  from (select * replace (case when task_id % 23 = 0 then task_id + 1 else task_id end as task_id) from v_comp) c
    left join v_dst_objects d on d.bucket = c.dst_bucket and d.key = c.dst_key
    left join v_tasks t on t.job_id = c.job_id and t.id = c.task_id"""


def compensations(v):
    lost = F.when(F.col("task_id") % 23 == 0, F.col("task_id") + 1).otherwise(F.col("task_id"))
    return v.comp.withColumn("task_id", lost)


@query("j9_reconcile_completions", f"select job_id, task_id, action from ({ACTION})")
def _(v):
    return rec.reconcile_completions(compensations(v), v.tasks, v.dst_objects).select("job_id", "task_id", "action")


@query(
    "m7_terminal_update",
    f"""with a as (select job_id, task_id, size as vsize from ({ACTION}) where action = 'complete')
    select t.job_id, t.id, case when a.task_id is not null then 'COMPLETED' else status end as status,
      case when a.task_id is not null then '' else error_message end as error_message,
      case when a.task_id is not null and status <> 'COMPLETED' then case when size > 0 then size else greatest(vsize, 0) end else 0 end as success_bytes,
      @us(case when a.task_id is not null then timestamp '{JOBS_NOW}' else completed_at end) as completed_at
    from v_tasks t left join a on a.job_id = t.job_id and a.task_id = t.id""",
)
def _(v):
    from mediaops.operators.merges import terminal_update

    acts = rec.reconcile_completions(compensations(v), v.tasks, v.dst_objects).filter("action = 'complete'")
    verdicts = acts.select(
        "job_id",
        F.col("task_id").alias("id"),
        F.lit("COMPLETED").alias("verdict"),
        F.lit("").alias("verdict_message"),
        F.col("size").alias("verdict_size"),
    )
    return terminal_update(v.tasks, verdicts, JOBS_NOW).select(
        "job_id", "id", "status", "error_message", "success_bytes", "completed_at"
    )


@query(
    "j8_stale_verdicts",
    f"""with d as ({DEST}), m as (select job_id, id, run_token, case when l % 2 = 0 then 'claimed' else 'last_seen' end as kind,
        created_at + to_seconds(l * 60) as ts from (select *, size % 7 as l from v_tasks)),
      o as (select dst_bucket as bucket, dst_key as key, max(size) as size from d group by 1, 2)
    select d.job_id, d.id, m.kind, case when o.size is not null and (d.size <= 0 or o.size = d.size) then 'COMPLETED' else 'FAILED' end as verdict,
      case when o.size is not null and (d.size <= 0 or o.size = d.size) then d.size else 0 end as verdict_size
    from d join m on m.job_id = d.job_id and m.id = d.id left join o on o.bucket = dst_bucket and o.key = dst_key
    where d.status = 'RUNNING' and epoch(m.ts) <= epoch(timestamp '{JOBS_NOW}')
      - case m.kind when 'claimed' then 1200 else 900 end""",
)
def _(v):
    from mediaops.functions.columns import seconds
    from mediaops.operators.inventory import plan_dest_keys

    step = F.col("size") % 7
    markers = v.tasks.select(
        F.when(step % 2 == 0, "claimed").otherwise("last_seen").alias("kind"),
        "job_id",
        F.col("id").alias("task_id"),
        "run_token",
        (F.col("created_at") + seconds(step * 60)).alias("ts"),
    )
    stored = (
        plan_dest_keys(v.tasks, v.jobs, v.meta)
        .groupBy(F.col("dst_bucket").alias("bucket"), F.col("dst_key").alias("key"))
        .agg(F.max("size").alias("size"))
    )
    return rec.stale_verdicts(markers, v.tasks, v.jobs, v.meta, stored, JOBS_NOW).drop("verdict_message")


@query(
    "j10_orphans",
    """select t.job_id, t.id from v_tasks t where not exists (select 1 from v_jobs j where j.job_id = t.job_id
      and j.status <> 'PENDING')""",
)
def _(v):
    return rec.orphans(v.tasks, v.jobs.filter("status <> 'PENDING'")).select("job_id", "id")


REMOVED = "select job_id, id from v_event_ledger where status = 'RUNNING'"


@query("j11_marker_cleanup", f"""select kind, m.job_id, task_id, run_token, count(*) as n from v_markers m
    where (m.job_id, task_id) in ({REMOVED}) group by all""")
def _(v):
    removed = v.event_ledger.filter("status = 'RUNNING'").select("job_id", F.col("id").alias("task_id"))
    gone, _ = rec.marker_cleanup(v.markers, removed)
    return gone.groupBy("kind", "job_id", "task_id", "run_token").agg(F.count(F.lit(1)).alias("n"))


@query("j11_markers_kept", f"""select kind, m.job_id, task_id, run_token, count(*) as n from v_markers m
    where (m.job_id, task_id) not in ({REMOVED}) group by all""")
def _(v):
    removed = v.event_ledger.filter("status = 'RUNNING'").select("job_id", F.col("id").alias("task_id"))
    _, kept = rec.marker_cleanup(v.markers, removed)
    return kept.groupBy("kind", "job_id", "task_id", "run_token").agg(F.count(F.lit(1)).alias("n"))


OUTCOME = """select e.*, case when regexp_matches(lower(error_message), 'sourcenotfound|source fetch returned 404') then 'skip_permanent'
    when s.job_id is not null then 'skip_scheduled' else 'reset' end as outcome
  from (select * from v_errors where status = 'FAILED') e left join (select distinct job_id, attempt from v_errors where is_download_fail) s
    on s.job_id = e.job_id and s.attempt = e.id"""


def outcomes(v):
    scheduled = v.errors.filter("is_download_fail").select("job_id", F.col("id").alias("task_id"))
    return rec.retry_outcome(v.errors, scheduled, True, EVENTS_NOW)


@query("m6_retry_outcome", f"select job_id, id, outcome from ({OUTCOME})")
def _(v):
    return outcomes(v).select("job_id", "id", "outcome")


@query(
    "m6_apply_retry",
    f"""select job_id, id, case when outcome = 'reset' then 'PENDING' else status end as status,
      case when outcome = 'reset' then '' else error_message end as error_message,
      case when outcome = 'reset' then '' else run_token end as run_token,
      case when outcome = 'reset' then -1 else @us(started_at) end as started_at from ({OUTCOME})""",
)
def _(v):
    return rec.apply_retry(outcomes(v), EVENTS_NOW).select("job_id", "id", "status", "error_message", "run_token", "started_at")


COUNTS = f"""select job_id, count(*) filter (outcome = 'reset') as reset_count, count(*) filter (outcome = 'skip_permanent') as skipped_permanent,
  count(*) filter (outcome = 'skip_scheduled') as skipped_scheduled, min(id) filter (outcome = 'reset') as min_reset_id from ({OUTCOME}) group by 1"""


@query("m6_retry_counts", COUNTS)
def _(v):
    return rec.retry_counts(outcomes(v))


@query(
    "a21_retry_rewind",
    """with r as (select job_id, min(id) as m from v_tasks where status = 'FAILED' group by 1)
    select j.job_id, scan_offset * 60000 as read_offset, m is not null and scan_offset * 60000 > greatest(0, m - 1) as rewound,
      case when m is not null and scan_offset * 60000 > greatest(0, m - 1) then greatest(0, m - 1) else scan_offset * 60000 end as new_offset
    from v_jobs j left join r on r.job_id = j.job_id""",
)
def _(v):
    offsets = v.jobs.select("job_id", (F.col("scan_offset") * 60000).alias("read_offset"))
    return rec.retry_rewind(v.tasks.filter("status = 'FAILED'"), offsets)


@query(
    "a22_stuck_offsets",
    """select j.job_id, pending_count, scan_offset * 60000 as read_offset, max_id, 0::bigint as new_offset
    from v_jobs j join (select job_id, max(id) as max_id from v_tasks group by 1) t on t.job_id = j.job_id
    where pending_count > 0 and max_id > 0 and scan_offset * 60000 >= max_id""",
)
def _(v):
    offsets = v.jobs.select("job_id", (F.col("scan_offset") * 60000).alias("read_offset"))
    return rec.stuck_offsets(v.jobs, v.tasks, offsets)


@query(
    "o4_due_batch",
    """select job_id, task_id, run_token, @us(ts) as ts from v_markers where kind = 'retry_due'
      and v_markers.ts <= timestamp '2024-01-20 00:00:00' order by v_markers.ts, job_id, task_id limit 200""",
)
def _(v):
    due = v.markers.filter("kind = 'retry_due'").select("job_id", "task_id", "run_token", "ts")
    return rec.due_batch(due, "2024-01-20 00:00:00", 200)


@query(
    "a17_pool_load",
    f"""with f as (select count(distinct (job_id, task_id, run_token)) filter (pool = 'default') as d,
        count(distinct (job_id, task_id, run_token)) filter (pool = 'resume') as r from v_markers where kind = 'in_flight'),
      b as (select count(distinct (job_id, task_id)) as n from v_markers where kind = 'resume' and expires_at >= timestamp '{EVENTS_NOW}'),
      c as (select d, r, n, case when n <= 0 then 5160 else 5160 - 528 end as cap, greatest(0, 5160 - d - r) as free from f cross join b)
    select d as default_in_flight, r as resume_in_flight, n as resume_backlog, cap::bigint as default_cap, free as resume_free,
      least(free, greatest(0, cap - d)) as default_free from c""",
)
def _(v):
    return rec.pool_load(
        v.markers.filter("kind = 'in_flight'"), v.markers.filter("kind = 'resume'"), EVENTS_NOW, max_workers=5160, reserved=528
    )


@query(
    "w10_no_progress_streak",
    """with a as (select *, not resumed or after_parts > before_parts as reset from v_attempts),
      i as (select *, sum(reset::int) over (partition by job_id, task_id order by attempt) as island from a),
      s as (select *, row_number() over (partition by job_id, task_id, island order by attempt) - case when island > 0 then 1 else 0 end as streak from i)
    select job_id, task_id, attempt, streak, streak >= 5 as abandon from s""",
)
def _(v):
    return rec.no_progress_streak(v.attempts, parts=5).select("job_id", "task_id", "attempt", "streak", "abandon")


@query(
    "w11_endpoint_health",
    """with r as (select *, error <> '' or status is null or status not between 200 and 399 as bad from v_requests),
      g as (select endpoint, max(seq) filter (not bad) as good from r group by 1)
    select r.endpoint, count(*) as requests, count(*) filter (bad) as failures,
      count(*) filter (seq > coalesce(good, -1)) as fail_streak, max(@us(ts)) as last_check,
      case when count(*) filter (seq > coalesce(good, -1)) >= 1 then 'offline' else 'online' end as state
    from r join g on g.endpoint = r.endpoint group by 1""",
)
def _(v):
    return rec.endpoint_health(v.requests, parts=5)


@query(
    "w12_retry_or_fail",
    """select job_id, task_id, attempt, n as failure_no, case when n < 3 then 'requeue' else 'permanent' end as action
    from (select *, row_number() over (partition by job_id, task_id order by attempt) as n from v_errors where status = 'FAILED')""",
)
def _(v):
    failures = v.errors.filter("status = 'FAILED'")
    return rec.retry_or_fail(failures, parts=5).select("job_id", "task_id", "attempt", "failure_no", "action")
