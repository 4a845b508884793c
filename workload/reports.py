"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.operators import ledger
from mediaops.plans import reports
from workload.registry import EVENTS_NOW, JOBS_NOW, query

LABEL = """coalesce(client_name, 'meta-' || metadata_id) || ' | ' ||
  case when split_part(trim(dst_dir, '/'), '/', 2) <> ''
    then split_part(trim(dst_dir, '/'), '/', 1) || '/' || split_part(trim(dst_dir, '/'), '/', 2)
    else coalesce(nullif(split_part(trim(dst_dir, '/'), '/', 1), ''), '-') end"""
DEST = f"""select {LABEL} as label, sum(coalesce(success_count, total_count, 0))::bigint as count,
  sum(coalesce(success_size_bytes, 0))::bigint as size
  from v_jobs left join v_meta on v_meta.id = metadata_id group by 1"""


@query("a1_dest_stats", f"{DEST} order by size desc, label limit 10")
def _(v):
    return reports.dest_stats(v.jobs, v.meta)


@query("o2_top_by_size", f"{DEST} order by size desc, label limit 25")
def _(v):
    return reports.top_by_size(reports.dest_totals(v.jobs, v.meta), 25)


@query(
    "a2_daily_stats",
    f"""select strftime(created_at, '%Y-%m-%d') as date, sum(coalesce(success_count, total_count, 0))::bigint as count,
      sum(coalesce(success_size_bytes, 0))::bigint as size
    from v_jobs where created_at >= timestamp '{JOBS_NOW}' - interval 14 day group by 1""",
)
def _(v):
    return reports.daily_stats(v.jobs, JOBS_NOW)


@query(
    "a2_last_days_present",
    """select strftime(created_at, '%Y-%m-%d') as date, sum(success_count)::bigint as count,
      sum(success_size_bytes)::bigint as size from v_jobs group by 1 order by 1 desc limit 14""",
)
def _(v):
    return reports.last_days_present(v.jobs)


@query(
    "a3_task_counts",
    """select job_id, count(*) as total_count, count(*) filter (status = 'PENDING') as pending_count,
      count(*) filter (status = 'RUNNING') as running_count, count(*) filter (status = 'COMPLETED') as success_count,
      count(*) filter (status = 'FAILED') as failed_count, sum(size)::bigint as total_size_bytes,
      sum(case when status = 'COMPLETED' then size else 0 end)::bigint as success_size_bytes
    from v_tasks group by job_id""",
)
def _(v):
    return ledger.task_counts(v.tasks)


@query(
    "a4_queue_stats",
    """with e as (
      select queue_name, split_part(queue_name, ':', 3) as queue_type, split_part(queue_name, ':', 4) as machine,
        try_cast(task_id as bigint) // 1000000 as job_id from v_queue),
    q as (select job_id, queue_type, queue_name, count(*) as n from e
      where job_id is not null and (machine = 'all' or machine in (
        select machine_name from v_machines where enabled and machine_name <> '')) group by 1, 2, 3)
    select job_id, sum(case when queue_type = 'download_ready' then n else 0 end)::bigint as download_ready,
      coalesce(string_agg(case when queue_type = 'download_ready' then queue_name || '=' || n end, ',' order by queue_name), '')
        as download_queues,
      sum(case when queue_type = 'metadata_retry' then n else 0 end)::bigint as metadata_retry,
      coalesce(string_agg(case when queue_type = 'metadata_retry' then queue_name || '=' || n end, ',' order by queue_name), '')
        as metadata_queues,
      sum(n)::bigint as total
    from q group by job_id""",
)
def _(v):
    def text(c):
        return F.array_join(
            F.transform(c, lambda q: F.concat(q["queue_name"], F.lit("="), q["n"].cast("string"))), ","
        ).alias(c)

    out = reports.queue_stats(v.queue, v.machines)
    return out.select("job_id", "download_ready", text("download_queues"), "metadata_retry", text("metadata_queues"), "total")


@query(
    "a11_client_stats",
    """select metadata_id, coalesce(client_name, 'meta-' || metadata_id) as label, sum(success_count)::bigint as count,
      sum(success_size_bytes)::bigint as size
    from v_jobs left join v_meta on v_meta.id = metadata_id group by 1, 2""",
)
def _(v):
    return reports.client_stats(v.jobs, v.meta)


BOUNDS = ", ".join(
    f"count(*) filter (duration <= {b}) as le_{str(b).replace('.', '_')}" for b in reports.DURATION_BOUNDS
)


def in_rank(found, log, key: list[str], value: str, quantile: str, share: float, rows: str):
    """Whether a quantile from a sketch has its rank, instead of its value, on which engines differ.

    To half a percent of the rows (fifty times the sketch's error) and one row, as small groups have none closer.
    """
    below, upto = F.col(value) < F.col(quantile), F.col(value) <= F.col(quantile)
    rank = log.join(found.select(*key, quantile), key).groupBy(*key).agg(F.count_if(below).alias("_below"), F.count_if(upto).alias("_upto"))
    wanted, near = F.col(rows) * share, F.col(rows) * 0.005 + 1
    ok = (F.col("_below") <= wanted + near) & (F.col("_upto") >= wanted - near)
    return found.join(rank, key).withColumn(f"{quantile}_in_rank", ok).drop(quantile, "_below", "_upto")


@query(
    "a14_http_metrics",
    f"""select method, path, coalesce(status, 0)::bigint as status, {BOUNDS}, count(*) as requests,
      sum(duration_ms)::bigint as duration_ms, true as p95_in_rank from v_requests group by 1, 2, 3""",
)
def _(v):
    log = v.requests.fillna(0, ["status"])
    return in_rank(reports.http_metrics(log), log, ["method", "path", "status"], "duration", "p95", 0.95, "requests")


@query(
    "a15_task_metrics",
    f"""select worker_type, outcome, {BOUNDS}, count(*) as requests, sum(bytes)::bigint as bytes,
      count(*) filter (discovered) as discovered, count(*) filter (retried) as retried,
      count(*) filter (permanent) as permanent from v_requests group by 1, 2""",
)
def _(v):
    return reports.task_metrics(v.requests)


TIMING = ", ".join(
    f"sum(regexp_extract(line, '\\b{f}=(\\d+)', 1)::bigint)::bigint as {f}" for f in reports.TIMING_FIELDS
)


@query(
    "a16_copy_timing",
    f"""select regexp_extract(line, '^Copy timing (\\w+) for ', 1) as result,
      regexp_extract(line, 'failed_stage=(\\S+)', 1) as failed_stage, count(*) as parts,
      sum(regexp_extract(line, 'attempts=(\\d+)', 1)::bigint)::bigint as attempts, {TIMING},
      max(regexp_extract(line, 'total_copy_ms=(\\d+)', 1)::bigint) as max_copy_ms,
      true as median_copy_ms_in_rank
    from v_copy_log where line like 'Copy timing %' group by 1, 2""",
)
def _(v):
    found, lines = reports.copy_timing(v.copy_log), reports.parse_copy_log(v.copy_log)
    return in_rank(found, lines, ["result", "failed_stage"], "total_copy_ms", "median_copy_ms", 0.5, "parts")


@query(
    "a16_copy_log_lines",
    """select regexp_extract(line, '^Copy timing (\\w+) for ', 1) as result, regexp_extract(line, ' for (\\S+) part=', 1) as key,
      regexp_extract(line, 'part=(\\d+)', 1)::bigint as part_number, regexp_extract(line, 'error_code=(\\S+)', 1) as error_code,
      count(*) as lines, max(@us(ts)) as last_us from v_copy_log where line like 'Copy timing %' group by 1, 2, 3, 4""",
)
def _(v):
    return (
        reports.parse_copy_log(v.copy_log)
        .groupBy("result", "key", "part_number", "error_code")
        .agg(F.count(F.lit(1)).alias("lines"), F.max("ts").alias("last_us"))
    )


@query(
    "a16_copy_log_signed",
    """select 'https://store.example/' || regexp_extract(line, ' for (\\S+) part=', 1) || '?partNumber=7&uploadId=01234567...' as key,
      count(*) as lines from v_copy_log where line like 'Copy timing %' group by 1""",
)
def _(v):
    signed = " for https://store.example/$1?sig=s&uploadId=0123456789abcdef&partNumber=7 part="
    lines = v.copy_log.withColumn("line", F.regexp_replace("line", r" for (\S+) part=", signed))
    return reports.parse_copy_log(lines).groupBy("key").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "w13_share_of_equal_values",
    """with t as (select l_orderkey * 10 + l_linenumber as label, l_quantity::bigint as size from lineitem),
      c as (select label, size, sum(size) over () as total,
        sum(size) over (order by size desc, label rows between unbounded preceding and current row) as upto from t)
    select label, size, round(size / total, 6) as ratio, round((upto - size) / total, 6) as slice_start,
      round(upto / total, 6) as slice_end from c""",
)
def _(v):
    label = F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")
    return reports.share_of_total(v.lineitem.select(label.alias("label"), F.col("l_quantity").cast("long").alias("size")))


@query(
    "a19_reachability_report",
    """select class, count(*) as probes, count(*) filter (status = 200) as accessible,
      round(count(*) filter (status = 200) / count(*), 6) as ok_share, count(*) filter (status is null) as no_answer,
      count(*) filter (status between 300 and 399) as redirects, count(*) filter (status between 400 and 499) as client_errors,
      count(*) filter (status >= 500) as server_errors, min(duration_ms) as min_ms, max(duration_ms) as max_ms,
      sum(duration_ms)::bigint as sum_ms from v_requests group by class""",
)
def _(v):
    return reports.reachability_report(v.requests)


@query(
    "a20_machine_names",
    "select distinct machine_name from v_machines where enabled and machine_name <> ''",
)
def _(v):
    return reports.machine_names(v.machines)


@query("a20_machine_names_raw", "select machine_name from v_machines where enabled")
def _(v):
    return reports.machine_names(v.machines, distinct=False)


@query(
    "u3_queue_universe",
    """select m as machine_name, k as queue_type, 'queue:' || k || ':' || m as queue_name
    from (select 'all' as m union select machine_name from v_machines where enabled and machine_name <> '')
      cross join (values ('download_ready'), ('metadata_retry')) t(k)""",
)
def _(v):
    return reports.queue_universe(v.machines)


@query(
    "j1_jobs_with_meta",
    """select job_id, metadata_id, coalesce(client_name, 'meta-' || metadata_id) as client_name,
      coalesce(endpoint, '') as endpoint, status from v_jobs left join v_meta on v_meta.id = metadata_id""",
)
def _(v):
    return (
        ledger.jobs_with_meta(v.jobs, v.meta)
        .fillna("", ["endpoint"])
        .select("job_id", "metadata_id", "client_name", "endpoint", "status")
    )


@query(
    "w9_rate_breaches",
    """with r as (select seq, machine, epoch_us(ts) as us from v_requests),
      c as (select seq, machine, us, count(*) over w - 1 as in_window, min(us) over w as oldest from r
        window w as (partition by machine order by us range between 3600000000 preceding and current row))
    select seq, machine, in_window, 3600100000 - (us - oldest) as wait_us from c where in_window >= 4""",
)
def _(v):
    rows = reports.rate_breaches(v.requests, limit=4, window_us=3_600_000_000)
    return rows.select("seq", "machine", "in_window", "wait_us")


@query(
    "w13_share_of_total",
    f"""with t as ({DEST}), s as (select sum(size) as total from t),
      c as (select label, count, size, sum(size) over (order by size desc, label) as upto from t)
    select label, count, size, round(size / total, 6) as ratio, round((upto - size) / total, 6) as slice_start,
      round(upto / total, 6) as slice_end from c cross join s""",
)
def _(v):
    return reports.share_of_total(reports.dest_totals(v.jobs, v.meta))


@query(
    "o1_page",
    """select job_id, status, @us(created_at) as created_at, (select count(*) from v_jobs) as total
    from v_jobs order by v_jobs.created_at desc, job_id desc limit 10 offset 20""",
)
def _(v):
    return reports.page(v.jobs.select("job_id", "status", "created_at"), number=3)


@query(
    "o1_page_with_counts",
    """with p as (select job_id, status, created_at from v_jobs order by created_at desc, job_id desc limit 25 offset 25)
    select p.job_id, p.status, @us(p.created_at) as created_at, (select count(*) from v_jobs) as total,
      count(t.id) as tasks, count(*) filter (t.status = 'COMPLETED') as done
    from p left join v_tasks t on t.job_id = p.job_id group by all""",
)
def _(v):
    listed = reports.page(v.jobs.select("job_id", "status", "created_at"), number=2, limit=25)
    counts = ledger.task_counts(v.tasks).select(
        "job_id", F.col("total_count").alias("tasks"), F.col("success_count").alias("done")
    )
    return listed.join(counts, "job_id", "left").na.fill(0, ["tasks", "done"])


@query(
    "c_human_bytes",
    """with s as (select job_id, total_size_bytes * (job_id % 3) * (job_id % 1000) as n from v_jobs)
    select case when n <= 0 then '0 B' when n >= 1024 * 1024 * 1024 then 'GB' when n >= 1048576 then 'MB'
      when n >= 1024 then 'KB' else 'B' end as unit, count(*) as jobs from s group by 1""",
)
def _(v):
    n = F.col("total_size_bytes") * (F.col("job_id") % 3) * (F.col("job_id") % 1000)
    text = C.human_bytes(n)
    unit = F.when(text == "0 B", text).otherwise(F.regexp_extract(text, r"([A-Z]+)$", 1))
    return v.jobs.groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("jobs"))
