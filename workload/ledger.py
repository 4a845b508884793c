"""Queries over jobs and task ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaops.operators import ledger, merges
from workload.registry import EVENTS_NOW, JOBS_NOW, query

DUE = f"""(status = 'PENDING' or status = 'RUNNING' and periodic_interval > 0 and (last_scan_time is null
  or last_scan_time < timestamp '{JOBS_NOW}' - to_seconds(periodic_interval)))"""


@query("p1_due_jobs", f"select job_id, status from v_jobs where {DUE}")
def _(v):
    return ledger.due_jobs(v.jobs, JOBS_NOW).select("job_id", "status")


@query("p2_mark_scanning", f"select job_id, case when {DUE} then 'SCANNING' else status end as status from v_jobs")
def _(v):
    return ledger.mark_scanning(v.jobs, JOBS_NOW).select("job_id", "status")


@query(
    "p9_cleanup_eligible",
    """select job_id from v_jobs where status = 'COMPLETED' and not is_incremental and total_count = success_count and not cleaned""",
)
def _(v):
    return ledger.cleanup_eligible(v.jobs).select("job_id")


@query(
    "p10_complete_jobs",
    f"""with d as (select *, status = 'RUNNING' and pending_count <= 0 and running_count <= 0 and periodic_interval <= 0
        and last_scan_time is not null as done from v_jobs)
    select job_id, case when done then 'COMPLETED' else status end as status,
      @us(case when done then timestamp '{JOBS_NOW}' else end_time end) as end_time,
      case when done then epoch(timestamp '{JOBS_NOW}')::bigint - epoch(coalesce(start_time, created_at))::bigint
        else duration_seconds end as duration_seconds from d""",
)
def _(v):
    return ledger.complete_jobs(v.jobs, JOBS_NOW).select("job_id", "status", "end_time", "duration_seconds")


@query("p13_active_jobs", "select job_id, status from v_jobs where status in ('PENDING', 'RUNNING')")
def _(v):
    return ledger.active_jobs(v.jobs, "download").select("job_id", "status")


@query("p13_active_copy_jobs", "select job_id, status from v_jobs where status = 'RUNNING'")
def _(v):
    return ledger.active_jobs(v.jobs, "copy").select("job_id", "status")


@query(
    "p14_stuck_tasks",
    f"""select d.job_id, d.id, 'PENDING' as status, d.status as old_status, 'Reset by stuck monitor' as error_message
    from v_downloads d join v_jobs j on j.job_id = d.job_id where d.status in ('RUNNING', 'METADATA_PROCESSING')
      and j.status in ('PENDING', 'RUNNING') and d.created_at < timestamp '{JOBS_NOW}' - interval 3 hour""",
)
def _(v):
    return ledger.stuck_tasks(v.downloads, v.jobs, JOBS_NOW).select(
        "job_id", "id", "status", "old_status", "error_message"
    )


LATEST = """select * from (select *, row_number() over (partition by job_id, task_id order by seq desc) as rn from v_task_events)
  where rn = 1"""


@query("w3_latest_update", f"select job_id, task_id, seq, status, run_token, size from ({LATEST})")
def _(v):
    return ledger.latest_update(v.task_events).select("job_id", "task_id", "seq", "status", "run_token", "size")


MOVES = """select * from (select job_id, task_id, seq, size, audio_url, video_url, status as new_status,
  coalesce(lag(status) over (partition by job_id, task_id order by seq), 'PENDING') as old_status from v_task_events)
  where old_status <> new_status"""


@query("w4_transitions", f"select job_id, task_id, seq, old_status, new_status from ({MOVES})")
def _(v):
    # Few ranges, so that some task's history is cut as a hot task's would be.
    return ledger.transitions(v.task_events, parts=5).select("job_id", "task_id", "seq", "old_status", "new_status")


def delta_sql(bucket: str) -> str:
    def one(c, b):
        return f"sum(({c.format('new')} = '{b}')::int - ({c.format('old')} = '{b}')::int)::bigint"

    return f"""select job_id, {one(bucket, 'P')} as pending_delta, {one(bucket, 'R')} as running_delta,
      {one(bucket, 'C')} as success_delta, {one(bucket, 'F')} as failed_delta from ({MOVES}) group by job_id"""


COPY_BUCKET = "case {}_status when 'PENDING' then 'P' when 'RUNNING' then 'R' when 'COMPLETED' then 'C' when 'FAILED' then 'F' else '-' end"
DOWNLOAD_BUCKET = "case {}_status when 'PENDING' then 'P' when 'COMPLETED' then 'C' when 'FAILED' then 'F' else 'R' end"


@query("a5_transition_deltas", delta_sql(COPY_BUCKET))
def _(v):
    return ledger.transition_deltas(ledger.transitions(v.task_events), "copy")


@query("a5_transition_deltas_download", delta_sql(DOWNLOAD_BUCKET))
def _(v):
    return ledger.transition_deltas(ledger.transitions(v.task_events), "download")


SUCCESS = f"select job_id, sum(size)::bigint as success_bytes from ({MOVES}) where new_status = 'COMPLETED' and size > 0 group by 1"


@query("a8_success_bytes", SUCCESS)
def _(v):
    return ledger.success_bytes(ledger.transitions(v.task_events))


@query(
    "a6_apply_deltas",
    f"""with d as ({delta_sql(COPY_BUCKET)}), b as ({SUCCESS}),
    n as (select j.job_id, j.status, d.job_id is not null as hit, greatest(0, pending_count + coalesce(pending_delta, 0)) as p,
        greatest(0, running_count + coalesce(running_delta, 0)) as r, greatest(0, success_count + coalesce(success_delta, 0)) as s,
        greatest(0, failed_count + coalesce(failed_delta, 0)) as f, success_size_bytes + coalesce(success_bytes, 0) as bytes
      from v_jobs j left join d on d.job_id = j.job_id left join b on b.job_id = j.job_id)
    select job_id, case when hit and status = 'PENDING' and r > 0 then 'RUNNING'
        when hit and status = 'RUNNING' and p <= 0 and r <= 0 then 'COMPLETED' else status end as status,
      p as pending_count, r as running_count, s as success_count, f as failed_count, bytes as success_size_bytes from n""",
)
def _(v):
    moves = ledger.transitions(v.task_events)
    deltas = ledger.transition_deltas(moves).join(ledger.success_bytes(moves), "job_id", "left")
    return ledger.apply_deltas(v.jobs, deltas).select(
        "job_id", "status", "pending_count", "running_count", "success_count", "failed_count", "success_size_bytes"
    )


REPORTS = """select job_id, seq, size % 50 as total_count, size % 17 as success_count, size % 5 as failed_count,
  status from v_task_events"""


@query(
    "a9_absolute_progress",
    f"""with r as (select * from ({REPORTS}) where total_count > 0 or success_count > 0 or failed_count > 0),
    l as (select *, max(total_count) over (partition by job_id) as top,
      row_number() over (partition by job_id order by seq desc) as rn from r)
    select job_id, top as total_count, success_count, failed_count,
      greatest(0, total_count - success_count - failed_count) as pending_count, status from l where rn = 1""",
)
def _(v):
    told = v.task_events.select(
        "job_id",
        "seq",
        (F.col("size") % 50).alias("total_count"),
        (F.col("size") % 17).alias("success_count"),
        (F.col("size") % 5).alias("failed_count"),
        "status",
    )
    return ledger.absolute_progress(told)


@query(
    "w14_ready_candidates",
    """select job_id, id, rank from (select t.job_id, id, row_number() over (partition by t.job_id order by id) as rank
      from v_tasks t join v_jobs j on j.job_id = t.job_id where t.status = 'PENDING' and j.status = 'RUNNING')
    where rank <= 3 order by rank, job_id, id limit 2000""",
)
def _(v):
    return ledger.ready_candidates(v.tasks, v.jobs, per_job=3, total=2000).select("job_id", "id", "rank")


@query(
    "j15_linked_job_status",
    """select l.c_custkey as id, d.status as download_status, d.total_count as download_total, c.status as copy_status,
      c.success_count as copy_success, m.status as merge_status, m.failed_count as merge_failed
    from customer l left join v_jobs d on d.job_id = l.c_custkey + 1 left join v_jobs c on c.job_id = l.c_custkey * 2 + 1
      left join v_jobs m on m.job_id = l.c_custkey * 3 + 1""",
)
def _(v):
    links = v.customer.select(
        F.col("c_custkey").alias("id"),
        (F.col("c_custkey") + 1).alias("download_job_id"),
        (F.col("c_custkey") * 2 + 1).alias("copy_job_id"),
        (F.col("c_custkey") * 3 + 1).alias("merge_job_id"),
    )
    return ledger.linked_job_status(links, v.jobs, v.jobs, v.jobs).select(
        "id", "download_status", "download_total", "copy_status", "copy_success", "merge_status", "merge_failed"
    )


@query("o3_keyset_scan", "select id, job_id, status from v_tasks where id > 5000000000 order by id limit 500")
def _(v):
    return ledger.keyset_scan(v.tasks.select("id", "job_id", "status"), 5_000_000_000, 500)


# ---- merges -------------------------------------------------------------------------------------


@query(
    "m1_merge_patch",
    """with f as (select job_id, task_id, arg_max(status, seq) as status,
        arg_max(case when status in ('RUNNING', 'PENDING', 'METADATA_PROCESSING') then '' else error_message end, seq)
          filter (status in ('RUNNING', 'PENDING', 'METADATA_PROCESSING') or error_message <> '') as error,
        arg_max(worker_id, seq) filter (worker_id <> '') as worker, arg_max(audio_url, seq) filter (audio_url <> '') as audio,
        arg_max(video_url, seq) filter (video_url <> '') as video, min(event_ts) filter (status = 'RUNNING') as started,
        min(event_ts) filter (status in ('COMPLETED', 'FAILED')) as ended, max(event_ts) as touched
      from v_task_events group by 1, 2)
    select l.job_id, l.id, coalesce(f.status, l.status) as status, coalesce(error, error_message) as error_message,
      coalesce(worker, worker_id) as worker_id, coalesce(audio, audio_url) as audio_url, coalesce(video, video_url) as video_url,
      @us(coalesce(started_at, started)) as started_at, @us(coalesce(completed_at, ended)) as completed_at,
      @us(coalesce(touched, updated_at)) as updated_at
    from v_event_ledger l left join f on f.job_id = l.job_id and f.task_id = l.id""",
)
def _(v):
    updates = v.task_events.withColumnRenamed("task_id", "id")
    return merges.merge_patch(v.event_ledger, updates).select(
        "job_id", "id", "status", "error_message", "worker_id", "audio_url", "video_url", "started_at", "completed_at", "updated_at"
    )


FENCE = """with t as (select l.job_id, l.id, coalesce(nullif(l.run_token, ''), (select arg_min(u.run_token, u.seq) from v_task_events u
        where u.job_id = l.job_id and u.task_id = l.id and u.run_token <> ''), '') as force from v_event_ledger l),
    u as (select e.*, t.force, e.run_token in ('', t.force) as ok from v_task_events e join t on t.job_id = e.job_id and t.id = e.task_id)"""


# Each task after all its accepted updates.
MERGED = (
    FENCE
    + """, f as (select job_id, task_id, any_value(force) as force, arg_max(status, seq) as status,
        arg_max(error_message, seq) as error, arg_max(size, seq) filter (size > 0) as size,
        arg_max(worker_id, seq) filter (worker_id <> '') as worker, min(event_ts) filter (status = 'RUNNING') as started,
        min(event_ts) filter (status in ('COMPLETED', 'FAILED')) as ended, max(event_ts) as touched
      from u where ok group by 1, 2)
    select l.job_id, l.id, coalesce(f.status, l.status) as status, coalesce(force, run_token) as run_token,
      coalesce(error, error_message) as error_message, coalesce(f.size, l.size) as size, coalesce(worker, worker_id) as worker_id,
      @us(coalesce(started_at, started)) as started_at, @us(coalesce(completed_at, ended)) as completed_at,
      @us(coalesce(touched, updated_at)) as updated_at"""
)


@query("m2_merge_fenced", MERGED + " from v_event_ledger l left join f on f.job_id = l.job_id and f.task_id = l.id")
def _(v):
    updates = v.task_events.withColumnRenamed("task_id", "id")
    merged, _ = merges.merge_fenced(v.event_ledger, updates)
    return merged.select(
        "job_id", "id", "status", "run_token", "error_message", "size", "worker_id", "started_at", "completed_at", "updated_at"
    )


@query("m2_conflicts", FENCE + " select job_id, task_id as id, count(*) as conflicts from u where not ok group by 1, 2")
def _(v):
    _, conflicts = merges.merge_fenced(v.event_ledger, v.task_events.withColumnRenamed("task_id", "id"))
    return conflicts


RECORD_UPDATES = """select id + case when id % 3 = 0 then 7 else 0 end as id, job_id, seq, status, worker_id, title, video_id,
  audio_url, audio_size, video_url, video_size, error_message, url from (
    select *, 1 as seq from v_downloads union all
    select * replace ('' as worker_id, 0 as audio_size, 'later' as title), 2 as seq from v_downloads where status = 'FAILED')"""


def record_updates(v):
    again = v.downloads.filter("status = 'FAILED'").withColumns(
        {"worker_id": F.lit(""), "audio_size": F.lit(0).cast("long"), "title": F.lit("later"), "seq": F.lit(2)}
    )
    return v.downloads.withColumn("seq", F.lit(1)).unionByName(again).withColumn(
        "id", F.col("id") + F.when(F.col("id") % 3 == 0, 7).otherwise(0)
    )


@query(
    "m3_merge_overwrite",
    f"""with u as (select * from ({RECORD_UPDATES}) where job_id <> 0 and id <> 0 qualify row_number() over
        (partition by job_id, id order by seq desc) = 1)
    select coalesce(r.job_id, u.job_id) as job_id, coalesce(r.id, u.id) as id, coalesce(u.status, r.status) as status,
      coalesce(u.worker_id, r.worker_id) as worker_id, coalesce(u.title, r.title) as title,
      coalesce(u.audio_size, r.audio_size) as audio_size, coalesce(r.url, u.url) as url,
      @us(coalesce(r.created_at, timestamp '{EVENTS_NOW}')) as created_at,
      @us(case when u.id is not null then timestamp '{EVENTS_NOW}' else r.updated_at end) as updated_at
    from v_downloads r full outer join u on u.job_id = r.job_id and u.id = r.id""",
)
def _(v):
    return merges.merge_overwrite(v.downloads, record_updates(v), EVENTS_NOW).select(
        "job_id", "id", "status", "worker_id", "title", "audio_size", "url", "created_at", "updated_at"
    )


PATCHES = """select job_id, seq, case when seq % 4 = 0 then '' else status end as status,
  case when seq % 3 = 0 then event_ts end as last_scan_time, error_message as result_message,
  case when seq % 5 = 0 then event_ts end as start_time, case when seq % 6 = 0 then event_ts end as end_time,
  case when seq % 7 = 0 then size end as total_count, seq % 2 as inc_success, seq % 3 as inc_failed,
  size as inc_success_bytes, seq % 10 = 0 as inc_execution from v_task_events"""


@query(
    "m4_apply_job_updates",
    f"""with p as (select *, last_value(start_time ignore nulls) over (partition by job_id order by seq) as begun from ({PATCHES})),
    f as (select job_id, arg_max(status, seq) filter (status <> '') as status,
        arg_max(result_message, seq) filter (result_message <> '') as message, arg_max(last_scan_time, seq) as scanned,
        arg_max(start_time, seq) as started, arg_max(end_time, seq) as ended,
        max(seq) filter (end_time is not null) as end_seq, arg_max(total_count, seq) as total,
        sum(inc_success)::bigint as s, sum(inc_failed)::bigint as f, sum(inc_success_bytes)::bigint as b,
        count(*) filter (inc_execution) as runs from p group by 1)
    select j.job_id, coalesce(f.status, j.status) as status, coalesce(message, result_message) as result_message,
      @us(coalesce(scanned, last_scan_time)) as last_scan_time, @us(coalesce(started, j.start_time)) as start_time,
      @us(coalesce(ended, j.end_time)) as end_time,
      coalesce((epoch_us(ended) - epoch_us(coalesce(p.begun, j.start_time))) // 1000000, duration_seconds) as duration_seconds,
      coalesce(total, total_count) as total_count, success_count + coalesce(s, 0) as success_count,
      failed_count + coalesce(f, 0) as failed_count, case when s + f > 0 then greatest(0, pending_count - s - f) else pending_count end
        as pending_count, success_size_bytes + coalesce(b, 0) as success_size_bytes, execution_count + coalesce(runs, 0) as execution_count
    from v_jobs j left join f on f.job_id = j.job_id left join (select job_id, seq, begun from p) p on p.job_id = f.job_id and p.seq = f.end_seq""",
)
def _(v):
    e = v.task_events
    every = lambda n, c: F.when(F.col("seq") % n == 0, F.col(c))
    patches = e.select(
        "job_id",
        "seq",
        F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("status")).alias("status"),
        every(3, "event_ts").alias("last_scan_time"),
        F.col("error_message").alias("result_message"),
        every(5, "event_ts").alias("start_time"),
        every(6, "event_ts").alias("end_time"),
        every(7, "size").alias("total_count"),
        (F.col("seq") % 2).alias("inc_success"),
        (F.col("seq") % 3).alias("inc_failed"),
        F.col("size").alias("inc_success_bytes"),
        (F.col("seq") % 10 == 0).alias("inc_execution"),
    )
    return merges.apply_job_updates(v.jobs, patches, parts=5).select(
        "job_id", "status", "result_message", "last_scan_time", "start_time", "end_time", "duration_seconds", "total_count",
        "success_count", "failed_count", "pending_count", "success_size_bytes", "execution_count",
    )


@query(
    "m5_reset_for_retry",
    f"""select job_id, id, 'PENDING' as status, '' as error_message, '' as run_token, '' as worker_id, -1::bigint as started_at,
      -1::bigint as completed_at, @us(timestamp '{JOBS_NOW}') as updated_at from v_tasks where status = 'FAILED'""",
)
def _(v):
    return merges.reset_for_retry(v.tasks.filter("status = 'FAILED'"), JOBS_NOW).select(
        "job_id", "id", "status", "error_message", "run_token", "worker_id", "started_at", "completed_at", "updated_at"
    )


@query(
    "m8_apply_job_commands",
    """with c as (select job_id, arg_max(event_type, event_id) as c from (select user_id % 10 * 7 + 1 as job_id, * from events) group by 1)
    select j.job_id, case c when 'click' then 'PENDING' when 'view' then 'STOPPED' when 'purchase' then 'COMPLETED' else status end as status,
      case when c = 'click' then -1 else @us(start_time) end as start_time, case when c = 'click' then '' else result_message end as result_message,
      case when c = 'error' then 0 else scan_offset end as scan_offset
    from v_jobs j left join c on c.job_id = j.job_id""",
)
def _(v):
    names = {"click": "start", "view": "stop", "purchase": "delete", "error": "rewind"}
    mapping = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    commands = v.events.select(
        (F.col("user_id") % 10 * 7 + 1).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.coalesce(F.try_element_at(mapping, F.col("event_type")), F.lit("none")).alias("command"),
    )
    return merges.apply_job_commands(v.jobs, commands).select("job_id", "status", "start_time", "result_message", "scan_offset")


@query(
    "m9_delete_pending",
    """select j.job_id, count(d.id) as records from v_jobs j left join v_downloads d on d.job_id = j.job_id
    where j.status <> 'PENDING' group by 1""",
)
def _(v):
    jobs, records = merges.delete_pending(v.jobs, v.downloads)
    n = records.groupBy("job_id").agg(F.count(F.lit(1)).alias("records"))
    return jobs.select("job_id").join(n, "job_id", "left").na.fill(0, ["records"])


@query(
    "m10_insert_tasks",
    """with n as (select id + case when id % 3 = 0 then 7 else 0 end as id, job_id, 'NEW' as status from v_tasks
        where status = 'FAILED')
    select id, job_id, status from n union all select id, job_id, status from v_tasks t
      where not exists (select 1 from n where n.job_id = t.job_id and n.id = t.id)""",
)
def _(v):
    kept = v.tasks.select("id", "job_id", "status")
    rows = kept.filter("status = 'FAILED'").select(
        (F.col("id") + F.when(F.col("id") % 3 == 0, 7).otherwise(0)).alias("id"), "job_id", F.lit("NEW").alias("status")
    )
    return merges.insert_tasks(kept, rows, keys=("job_id", "id"))


@query(
    "m11_remove_tasks",
    "select job_id, id, status from v_tasks where status <> 'COMPLETED'",
)
def _(v):
    done = v.tasks.filter("status = 'COMPLETED'").select("job_id", "id")
    unknown = v.jobs.select("job_id", F.lit(-1).cast("long").alias("id"))
    return merges.remove_tasks(v.tasks.select("job_id", "id", "status"), done.unionByName(unknown))


CHANGES = """select job_id, task_id, case when task_id % 5 = 0 then 'clear' else 'save' end as op, task_id as seq, upload_id,
  case when task_id % 7 = 1 then '' when task_id % 7 = 2 then 'other' else last_run_token end as last_run_token, size + 1 as size,
  case when task_id % 2 = 0 then created_at end as created_at from v_ckpt"""
VERDICT = """case when op = 'save' and trim(c.upload_id) = '' then 'no_upload_id'
    when t.status = 'RUNNING' and t.run_token <> '' and c.last_run_token = '' then 'token_required'
    when t.status = 'RUNNING' and t.run_token <> '' and c.last_run_token <> t.run_token then 'token_mismatch' else 'ok' end"""
JUDGED = f"""select c.*, {VERDICT} as verdict from ({CHANGES}) c left join v_tasks t on t.job_id = c.job_id and t.id = c.task_id"""


def checkpoint_changes(v):
    m = F.col("task_id") % 7
    return v.ckpt.withColumns(
        {
            "op": F.when(F.col("task_id") % 5 == 0, "clear").otherwise("save"),
            "seq": F.col("task_id"),
            "last_run_token": F.when(m == 1, "").when(m == 2, "other").otherwise(F.col("last_run_token")),
            "size": F.col("size") + 1,
            "created_at": F.when(F.col("task_id") % 2 == 0, F.col("created_at")),
        }
    )


@query(
    "m12_merge_checkpoints",
    f"""with j as ({JUDGED})
    select k.job_id, k.task_id, coalesce(j.upload_id, k.upload_id) as upload_id, coalesce(j.size, k.size) as size,
      @us(case when j.task_id is null then k.created_at else coalesce(j.created_at, timestamp '{JOBS_NOW}') end) as created_at,
      @us(case when j.task_id is null then k.updated_at else timestamp '{JOBS_NOW}' end) as updated_at
    from v_ckpt k left join (select * from j where verdict = 'ok') j on j.job_id = k.job_id and j.task_id = k.task_id
    where j.op is null or j.op = 'save'""",
)
def _(v):
    kept, _ = merges.merge_checkpoints(v.ckpt, checkpoint_changes(v), v.tasks, JOBS_NOW)
    return kept.select("job_id", "task_id", "upload_id", "size", "created_at", "updated_at")


@query("m12_refused_checkpoints", f"select job_id, task_id, op, verdict from ({JUDGED}) where verdict <> 'ok'")
def _(v):
    _, refused = merges.merge_checkpoints(v.ckpt, checkpoint_changes(v), v.tasks, JOBS_NOW)
    return refused.select("job_id", "task_id", "op", "verdict")
