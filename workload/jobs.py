"""Queries over whole jobs composed from several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaops.operators import inventory as inv
from mediaops.plans import copy_job
from workload.inventory import DEST, GLOB, SRC
from workload.ledger import DUE
from workload.registry import EVENTS_NOW, JOBS_NOW, query

WANTED = f"""select i.* from (select *, regexp_extract(key, '[^/]*$') as base from v_inv_src where not key like '%/') i
  join (select * from v_jobs where {DUE}) j on j.job_id = i.job_id where {GLOB}"""


@query(
    "job_plan_new_tasks",
    f"""with f as (select * from (select *, row_number() over (partition by job_id, key order by pos) as rn from ({WANTED})) where rn = 1),
      n as (select * from f where not exists (select 1 from v_tasks t where t.job_id = f.job_id and t.src = f.key))
    select n.job_id, coalesce(top, 0) + row_number() over (partition by n.job_id order by pos) as id, key as src, size, 'PENDING' as status
    from n left join (select job_id, max(id) as top from v_tasks group by 1) m on m.job_id = n.job_id""",
)
def _(v):
    tasks = copy_job.plan_new_tasks(v.inv_src, v.jobs, v.tasks, JOBS_NOW)
    return tasks.select("job_id", "id", "src", "size", "status")


@query(
    "job_plan_transfers",
    f"""select job_id, id, dst_bucket, dst_key, case when size < 8388608 then -1 else n + 1 end as part_number,
      case when size < 8388608 then size else least((n + 1) * 5242880, size) - n * 5242880 end as part_bytes
    from (select *, unnest(range(case when size < 8388608 then 1 else (size - 1) // 5242880 + 1 end)) as n
      from ({DEST}) where status = 'PENDING' and size <> 0)""",
)
def _(v):
    planned = copy_job.plan_transfers(v.tasks, v.jobs, v.meta)
    return planned.select("job_id", "id", "dst_bucket", "dst_key", "part_number", "part_bytes")


@query(
    "job_plan_sync",
    f"""select s.job_id, s.key, state, count(*) as parts, sum(s.size)::bigint as bytes from (
      select s.*, case when d.size is null then 'new' else 'changed' end as state from ({SRC}) s left join v_inv_dst d on d.rel_key = s.rel_key
      where d.size is null or d.size <> s.size) s group by 1, 2, 3""",
)
def _(v):
    src = inv.first_seen(inv.clean_listing(v.inv_src))
    planned = copy_job.plan_sync(src, v.inv_dst)
    return planned.groupBy("job_id", "key", "state").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("part_bytes").alias("bytes")
    )


# Failed tasks with a due retry: their own id is among the scheduled ones (every third of a job's).
FAILED = """select t.*, case when regexp_matches(lower(error_message), 'sourcenotfound|source fetch returned 404|zerosizedisabled') then 'skip_permanent'
    when id % 3 = 0 then 'skip_scheduled' else 'reset' end as outcome from v_tasks t where status = 'FAILED'"""


def retried(v):
    scheduled = v.tasks.filter("id % 3 = 0").select("job_id", F.col("id").alias("task_id"))
    offsets = v.jobs.select("job_id", (F.col("scan_offset") * 60000).alias("read_offset"))
    return copy_job.retry_failed(v.tasks, scheduled, offsets, EVENTS_NOW)


@query(
    "job_retry_failed",
    f"""select job_id, id, outcome, case when outcome = 'reset' then 'PENDING' else status end as status,
      case when outcome = 'reset' then '' else worker_id end as worker_id from ({FAILED})""",
)
def _(v):
    return retried(v)[0].select("job_id", "id", "outcome", "status", "worker_id")


@query(
    "job_retry_offsets",
    f"""with r as (select job_id, greatest(0, min(id) - 1) as m from ({FAILED}) where outcome = 'reset' group by 1)
    select j.job_id, scan_offset * 60000 as read_offset, coalesce(scan_offset * 60000 > m, false) as rewound,
      case when scan_offset * 60000 > m then m else scan_offset * 60000 end as new_offset
    from v_jobs j left join r on r.job_id = j.job_id""",
)
def _(v):
    return retried(v)[1]
