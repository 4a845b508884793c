"""Queries over multipart uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaops.operators import parts
from workload.inventory import DEST
from workload.registry import query

COLUMNS = ["job_id", "id", "num_parts", "part_number", "first_byte", "last_byte", "part_bytes"]


def parts_sql(per: str, single: str) -> str:
    return f"""select job_id, id, n as num_parts, case when single then -1 else i + 1 end as part_number, i * step as first_byte,
        least((i + 1) * step, size) - 1 as last_byte, least((i + 1) * step, size) - i * step as part_bytes
      from (select *, unnest(range(n)) as i from (select *, case when single then greatest(size, 1) else per end as step,
          case when single then 1 else (size + per - 1) // per end as n
        from (select job_id, id, size, {per} as per, {single} as single from v_tasks)))"""


@query("x1_plan_parts", parts_sql("greatest(5242880, size // 10000)", "size < 8388608"))
def _(v):
    return parts.plan_parts(v.tasks.select("job_id", "id", "size")).select(*COLUMNS)


@query("x2_plan_parts_fixed", parts_sql("6291456", "size <= 6291456"))
def _(v):
    return parts.plan_parts(v.tasks.select("job_id", "id", "size"), "fixed").select(*COLUMNS)


@query("x2_invalid_sizes", "select job_id, id, size, 'invalid content length' as error from v_tasks where size <= 0")
def _(v):
    planned = parts.plan_parts(v.tasks.select("job_id", "id", "size"), "fixed")
    return planned.filter("error is not null").select("job_id", "id", "size", "error")


@query(
    "x3_plan_parts_aligned",
    parts_sql("case when size > 1048576 * 8 then ((size // 8 - 1) // 1048576 + 1) * 1048576 else 1048576 end", "size < 1048576"),
)
def _(v):
    # Eight parts of 1 MiB as the limit, so that most objects grow their chunk.
    return parts.plan_parts(
        v.tasks.select("job_id", "id", "size"), "aligned", chunk=1 << 20, max_parts=8
    ).select(*COLUMNS)


@query(
    "x4_pending_uploads",
    """select u.upload_id, num_parts, count(distinct part_number) filter (trim(etag, '"') <> '') as present,
      num_parts - count(distinct part_number) filter (trim(etag, '"') <> '') as missing
    from v_uploads u left join v_parts p on p.upload_id = u.upload_id where dst_key like 'out/%' group by 1, 2 having missing > 0""",
)
def _(v):
    return parts.pending_uploads(v.uploads, v.parts, "out/").select("upload_id", "num_parts", "present", "missing")


PER = "greatest(5242880, t.size // 10000)"


@query(
    "j12_resume_eligible",
    f"""with d as ({DEST}), r as (select t.job_id, t.id, case when c.task_id is null or trim(c.upload_id) = '' then 'no_checkpoint'
        when t.src = '' or t.size <= 0 then 'no_source' when t.size < 1048576 then 'below_threshold' when c.size <> t.size then 'size'
        when c.bucket <> t.dst_bucket then 'bucket' when c.key <> t.dst_key then 'key' when c.part_size <> {PER} then 'part_size'
        when c.num_parts <> (t.size - 1) // {PER} + 1 then 'num_parts' else 'ok' end as reason
      from d t left join (select c.*, case when c.dst_bucket = 'other' then 'other' else d.dst_bucket end as bucket,
          case when c.task_id % 7 = 0 then 'elsewhere' else d.dst_key end as key
        from v_ckpt c join d on d.job_id = c.job_id and d.id = c.task_id) c on c.job_id = t.job_id and c.task_id = t.id)
    select job_id, id, case when reason = 'ok' then 'resume' else 'default' end as pool, reason from r""",
)
def _(v):
    from mediaops.operators.inventory import plan_dest_keys

    spoilt = F.col("dst_bucket") == "other"
    held = v.ckpt.withColumn("_spoilt", spoilt).drop("dst_bucket", "dst_key")
    checkpoints = plan_dest_keys(held, v.jobs, v.meta).withColumns(
        {
            "dst_bucket": F.when(F.col("_spoilt"), "other").otherwise(F.col("dst_bucket")),
            "dst_key": F.when(F.col("task_id") % 7 == 0, "elsewhere").otherwise(F.col("dst_key")),
        }
    )
    return parts.resume_eligible(v.tasks, v.jobs, v.meta, checkpoints, threshold=1 << 20).select(
        "job_id", "id", "pool", "reason"
    )


@query(
    "j14_missing_parts",
    """select u.upload_id, n + 1 as part_number from (select *, unnest(range(num_parts)) as n from v_uploads) u
    where not exists (select 1 from v_parts p where p.upload_id = u.upload_id and p.part_number = n + 1 and trim(etag, '"') <> '')""",
)
def _(v):
    planned = parts.plan_parts(v.uploads.select("upload_id", F.greatest("size", F.lit(1)).alias("size")), threshold=0)
    return parts.missing_parts(planned, v.parts).select("upload_id", "part_number")


@query(
    "j14_upload_state",
    """select u.upload_id, num_parts, count(distinct part_number) filter (trim(etag, '"') <> '') as present,
      num_parts = count(distinct part_number) filter (trim(etag, '"') <> '') as complete
    from v_uploads u left join v_parts p on p.upload_id = u.upload_id group by 1, 2""",
)
def _(v):
    return parts.upload_state(v.uploads, v.parts).select("upload_id", "num_parts", "present", "complete")


@query(
    "a13_verify_parts",
    """with s as (select upload_id, count(*) as n, min(part_number) as lo, max(part_number) as hi, sum(size)::bigint as b
        from v_parts where trim(etag, '"') <> '' group by 1)
    select u.upload_id, u.num_parts, u.size, coalesce(n, 0) as parts, coalesce(b, 0) as bytes,
      case when coalesce(n, 0) <> num_parts then 'incomplete' when lo <> 1 or hi <> num_parts then 'gap'
        when b <> size then 'size_mismatch' else 'ok' end as verdict
    from v_uploads u left join s on s.upload_id = u.upload_id""",
)
def _(v):
    return parts.verify_parts(v.parts, v.uploads).select("upload_id", "num_parts", "size", "parts", "bytes", "verdict")
