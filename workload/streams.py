"""Streaming queries: the given tables as file streams, run to the end, with a batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaops.session import shared_dir
from mediaops.sources import changes, sinks
from mediaops.sources.files import names as listed
from mediaops.streaming import jobs as sj
from mediaops.streaming import state as ss
from mediaops.streaming.run import run_available
from workload.inventory import SIDES
from workload.ledger import COPY_BUCKET, MERGED, MOVES, SUCCESS, delta_sql
from workload.registry import JOBS_NOW, query
from workload.storage import WHOLE
from workload.views import Views


# What the rows of a streamed table are in order of, and how many batches they make.
ORDER = {"events": "event_id", "part": "p_partkey"}
BATCHES = 4


def streamed(v: Views, name: str, batches: int = BATCHES, even: bool = False) -> Views:
    """The same views with the named table read as a file stream of some batches, the rows in order.

    Batches hold about as many rows each, or (``even``) as many values of the order, as ``BATCH_OF`` says in SQL.
    """
    live = Views(v.spark, v.folder)
    still, at = v.get(name), F.col(ORDER[name])
    if even:
        top = still.agg(F.max(at)).first()[0] or 0
        cuts = [top * n // batches for n in range(1, batches)]
    else:
        cuts = still.select(at.alias("at")).approxQuantile("at", [n / batches for n in range(1, batches)], 0.001)
    path = shared_dir(v.spark, f"feed-{name}")
    # A trigger takes a number of files: pieces of other numbers would run into each other's batches.
    files = still.rdd.getNumPartitions()
    empty = v.spark.createDataFrame([], still.schema).coalesce(1)
    for n, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True), 1):
        piece = still
        piece = piece if low is None else piece.filter(at > low)
        piece = piece if high is None else piece.filter(at <= high)
        piece.repartition(files, at).write.mode("append").parquet(path)
        for _ in range(n * files - sum(f.endswith(".parquet") for f in listed(v.spark, path))):
            empty.write.mode("append").parquet(path)
    feed = v.spark.readStream.schema(still.schema).option("maxFilesPerTrigger", files)
    live._made[name] = feed.parquet(path)
    return live


@query(
    "t1_stream_job_counters",
    f"""select d.*, coalesce(success_bytes, 0) as success_bytes from ({delta_sql(COPY_BUCKET)}) d
      left join ({SUCCESS}) b on b.job_id = d.job_id""",
)
def _(v):
    events = streamed(v, "events").task_events.withColumnRenamed("task_id", "id")
    return sj.stream_job_counters(events, shared_dir(v.spark, "counters"))


BEATS = "select 'w' || user_id % 5 as worker_id, epoch_us(ts) as us from events"


@query(
    "t2_stream_worker_liveness",
    f"""with b as (select *, lag(us) over w as prev, lead(us) over w as next, max(us) over () - 600000000 as mark from ({BEATS})
        window w as (partition by worker_id order by us))
    select worker_id, true as alive, us as at from b where prev is null or us - prev >= 120000000
    union all select worker_id, false, us + 120000000 from b
      where (next is not null and next - us >= 120000000) or (next is null and us + 120000000 <= mark)""",
)
def _(v):
    beats = streamed(v, "events").events.select(
        F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("worker_id"), F.col("ts").alias("event_ts")
    )
    return ss.stream_worker_liveness(beats, shared_dir(v.spark, "liveness"))


MESSAGE = {"click": "claim", "signup": "activate", "view": "progress", "purchase": "done", "error": "done"}


@query(
    "t3_stream_stale_tasks",
    """with recursive m as (select user_id % 10 as job_id, user_id as task_id, 't' || event_id % 3 as run_token, epoch_us(ts) as us,
        event_type as k, row_number() over (partition by user_id, event_id % 3 order by event_id) as n from events),
    s as (select *, false as hit, '' as old_phase, 0::bigint as old_due from (select job_id, task_id, run_token, 0::bigint as n, '' as phase,
          null::bigint as due from m where n = 1) i
      union all select m.job_id, m.task_id, m.run_token, m.n,
        case when k = 'click' then 'claimed' when k = 'signup' then 'active' when k = 'view' and s.due > us then s.phase else '' end,
        case when k = 'click' then us + 1200000000 when k = 'signup' then us + 900000000 when k = 'view' and s.due > us
          then case when s.phase = 'active' then us + 900000000 else s.due end end,
        coalesce(s.due <= us, false), s.phase, s.due
      from s join m on m.task_id = s.task_id and m.run_token = s.run_token and m.n = s.n + 1),
    o as (select job_id, task_id, run_token, old_phase as phase, old_due as due from s where hit
      union all select job_id, task_id, run_token, arg_max(phase, n), arg_max(coalesce(due, 9000000000000000000), n) as d from s group by 1, 2, 3
        having d <= (select max(us) - 600000000 from m))
    select job_id, task_id, run_token, case phase when 'claimed' then 'stale_claim' else 'stale_running' end as kind, due as at from o""",
)
def _(v):
    kinds = F.create_map(*[F.lit(x) for p in MESSAGE.items() for x in p])
    messages = streamed(v, "events").events.select(
        (F.col("user_id") % 10).alias("job_id"),
        F.col("user_id").alias("task_id"),
        F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("run_token"),
        F.col("ts").alias("event_ts"),
        F.col("event_id").alias("seq"),
        F.try_element_at(kinds, F.col("event_type")).alias("kind"),
    )
    return ss.stream_stale_tasks(messages, shared_dir(v.spark, "stale"))


@query(
    "t4_stream_new_objects",
    """select job_id, key as src, pos, size, row_number() over (partition by job_id order by pos) as id from (
      select *, row_number() over (partition by job_id, key order by pos) as rn from v_inv_src) where rn = 1""",
)
def _(v):
    tasks = sj.stream_new_objects(streamed(v, "part").inv_src, shared_dir(v.spark, "ledger"))
    return tasks.select("job_id", "src", "pos", "size", "id")


@query("t4_distinct_objects", "select distinct job_id, key from v_inv_src")
def _(v):
    return run_available(sj.new_objects(streamed(v, "part").inv_src)).select("job_id", "key")


@query(
    "t5_stream_pairs",
    f"""with s as ({SIDES}), f as (select job_id, pair_id, greatest(min(pos) filter (is_video), min(pos) filter (not is_video)) as done
        from s group by 1, 2 having count(distinct is_video) = 2)
    select s.job_id, s.pair_id, arg_max(key, pos) filter (is_video) as video_key, arg_max(size, pos) filter (is_video) as video_size,
      arg_max(key, pos) filter (not is_video) as audio_key, arg_max(size, pos) filter (not is_video) as audio_size
    from s join f on f.job_id = s.job_id and f.pair_id = s.pair_id and s.pos <= done group by 1, 2""",
)
def _(v):
    return ss.stream_pairs(streamed(v, "part").media, shared_dir(v.spark, "pairs"))


@query(
    "t6_stream_retry_due",
    """with e as (select *, epoch_us(event_ts) as us, lead(epoch_us(event_ts)) over (partition by job_id, task_id order by event_ts, seq) as next,
        max(epoch_us(event_ts)) over () - 600000000 as mark from v_task_events)
    select job_id, task_id, us + 3600000000 as at from e where status = 'FAILED'
      and (next is not null and next >= us + 3600000000 or next is null and us + 3600000000 <= mark)""",
)
def _(v):
    return ss.stream_retry_due(streamed(v, "events").task_events, shared_dir(v.spark, "due"), cooldown_seconds=3600)


@query(
    "t7_stream_fenced_state",
    """with recursive e as (select *, status = 'RUNNING' and run_token <> '' as claim,
        row_number() over (partition by job_id, task_id order by seq) as n from v_task_events),
    s as (select job_id, task_id, 0::bigint as n, -1::bigint as seq, true as accepted, '' as sent_token, '' as run_token, 'PENDING' as status
        from (select distinct job_id, task_id from e) d
      union all select e.job_id, e.task_id, e.n, e.seq, e.claim or s.run_token = '' or e.run_token = '' or e.run_token = s.run_token,
        e.run_token, case when e.claim or s.run_token = '' then e.run_token else s.run_token end,
        case when e.claim or s.run_token = '' or e.run_token = '' or e.run_token = s.run_token then e.status else s.status end
      from s join e on e.job_id = s.job_id and e.task_id = s.task_id and e.n = s.n + 1)
    select job_id, task_id as id, seq, accepted, sent_token, run_token, status from s where n > 0""",
)
def _(v):
    messages = streamed(v, "events").task_events.withColumnRenamed("task_id", "id").withColumn(
        "kind", F.when(F.col("status") == "RUNNING", "claim").otherwise("update")
    )
    return sj.stream_fenced_state(messages, shared_dir(v.spark, "fence"))


@query(
    "t8_stream_checkpoint_expiry",
    """with e as (select *, epoch_us(event_ts) as us, lead(epoch_us(event_ts)) over (partition by job_id, task_id order by event_ts, seq) as next,
        max(epoch_us(event_ts)) over () - 600000000 as mark from v_task_events)
    select job_id, task_id, us + 28800000000 as at from e where status <> 'COMPLETED'
      and (next is not null and next >= us + 28800000000 or next is null and us + 28800000000 <= mark)""",
)
def _(v):
    changes = streamed(v, "events").task_events.withColumn(
        "op", F.when(F.col("status") == "COMPLETED", "clear").otherwise("save")
    )
    return ss.stream_checkpoint_expiry(changes, shared_dir(v.spark, "expiry"), ttl_seconds=8 * 3600)


CLOSED = "(select max(epoch_us(ts)) - 600000000 from v_requests)"


@query(
    "t9_outcome_windows",
    f"""select (epoch_us(ts) // 60000000) * 60000000 as start, outcome, count(*) as tasks, sum(duration_ms)::bigint as duration_ms,
      max(duration_ms) as max_ms from v_requests group by 1, 2 having (epoch_us(any_value(ts)) // 60000000 + 1) * 60000000 <= {CLOSED}""",
)
def _(v):
    return run_available(sj.outcome_windows(streamed(v, "events").requests, at="ts"))


@query(
    "t9_request_rate",
    f"""with r as (select machine, (epoch_us(ts) // 5000000 - unnest(range(12))) * 5000000 as start from v_requests)
    select start, machine, count(*) as requests from r where start + 60000000 <= {CLOSED} group by 1, 2""",
)
def _(v):
    return run_available(sj.request_rate(streamed(v, "events").requests, at="ts"))


@query(
    "t9_worker_sessions",
    f"""with b as (select *, sum((prev is null or us - prev >= 900000000)::int) over (partition by worker_id order by us) as s from (
        select *, lag(us) over (partition by worker_id order by us) as prev from ({BEATS})))
    select worker_id, min(us) as session_start, max(us) + 900000000 as session_end, count(*) as events from b
    group by worker_id, s having max(us) + 900000000 <= {CLOSED}""",
)
def _(v):
    log = streamed(v, "events").events.select(
        F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("worker_id"), F.col("ts").alias("event_ts")
    )
    return run_available(sj.worker_sessions(log))


@query(
    "t10_stream_upsert",
    MERGED + WHOLE,
)
def _(v):
    path, stage = shared_dir(v.spark, "ledger"), shared_dir(v.spark, "upsert")
    sinks.write_ledger(v.event_ledger, path, ids_per_bucket=20)
    updates = streamed(v, "events").task_events.withColumnRenamed("task_id", "id")
    sj.stream_upsert(updates, path, stage, ids_per_bucket=20)
    return changes.read_rows(v.spark, path)


BATCH_OF = " + ".join(f"(seq > (select max(event_id) * {n} // {BATCHES} from events))::int" for n in range(1, BATCHES)) + " + 1"


def _net(bucket: str) -> str:
    old, new = COPY_BUCKET.format("old"), COPY_BUCKET.format("new")
    return f"sum(({new} = '{bucket}')::int - ({old} = '{bucket}')::int)::bigint"


@query(
    "t11_stream_completion_monitor",
    f"""with recursive d as (select job_id, {BATCH_OF} as batch, {_net("P")} as p, {_net("R")} as r, {_net("C")} as s, {_net("F")} as f,
        sum(case when new_status = 'COMPLETED' and size > 0 then size else 0 end)::bigint as bytes from ({MOVES}) group by 1, 2),
    s as (select job_id, 0 as n, status, pending_count as p, running_count as r, success_count as s, failed_count as f,
        success_size_bytes::bigint as bytes, end_time, duration_seconds, periodic_interval <= 0 and last_scan_time is not null as once,
        coalesce(start_time, created_at) as began from v_jobs
      union all select job_id, n, case when done then 'COMPLETED' else status end, p, r, s, f, bytes,
        case when done then timestamp '{JOBS_NOW}' else end_time end,
        case when done then epoch(timestamp '{JOBS_NOW}')::bigint - epoch(began)::bigint else duration_seconds end, once, began
      from (select *, status = 'RUNNING' and p <= 0 and r <= 0 and once as done from (
        select job_id, n, case when hit and status = 'PENDING' and r > 0 then 'RUNNING'
          when hit and status = 'RUNNING' and p <= 0 and r <= 0 then 'COMPLETED' else status end as status,
          p, r, s, f, bytes, end_time, duration_seconds, once, began from (
          select s.job_id, s.n + 1 as n, s.status, d.job_id is not null as hit, s.end_time, s.duration_seconds, s.once, s.began,
            case when d.job_id is null then s.p else greatest(0, s.p + d.p) end as p, case when d.job_id is null then s.r else greatest(0, s.r + d.r) end as r,
            case when d.job_id is null then s.s else greatest(0, s.s + d.s) end as s, case when d.job_id is null then s.f else greatest(0, s.f + d.f) end as f,
            s.bytes + coalesce(d.bytes, 0) as bytes
          from s left join d on d.job_id = s.job_id and d.batch = s.n + 1 where s.n < {BATCHES}))))
    select job_id, status, p as pending_count, r as running_count, s as success_count, f as failed_count, bytes as success_size_bytes,
      @us(end_time) as end_time, duration_seconds from s where n = {BATCHES}""",
)
def _(v):
    events = streamed(v, "events", even=True).task_events.withColumnRenamed("task_id", "id")
    latest = sj.stream_completion_monitor(events, v.jobs, shared_dir(v.spark, "jobs"), as_of=JOBS_NOW)
    return latest.select(
        "job_id", "status", "pending_count", "running_count", "success_count", "failed_count", "success_size_bytes", "end_time", "duration_seconds"
    )
