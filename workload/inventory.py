"""Queries over object listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.functions.globs import glob_regex
from mediaops.operators import inventory as inv
from mediaops.session import shared_dir
from mediaops.sources import readers
from workload.registry import EVENTS_NOW, query

CLEAN = "select * from v_inv_src where not key like '%/'"


LISTED = """select 'b' || job_id % 5 as bucket, key, size, lower(trim(etag, '"')) as etag, @us(last_modified) as last_modified from v_inv_src
    where key like 'src/%' and not key like '%/'"""


def _stored_listing(v, format):
    path = shared_dir(v.spark, "inventory")
    bucket = F.concat(F.lit("b"), (F.col("job_id") % 5).cast("string")).alias("bucket")
    listing = v.inv_src.select(bucket, "key", "size", "etag", "last_modified")
    listing.write.option("header", "true").option("escape", '"').format(format).save(path)
    return readers.read_inventory(v.spark, path, "src/", format)


@query("s1_read_inventory", LISTED)
def _(v):
    return _stored_listing(v, "parquet")


@query("s1_read_inventory_csv", LISTED)
def _(v):
    return _stored_listing(v, "csv")


@query(
    "s1_read_inventory_files",
    """select 'shop' as bucket, 'src/status=' || o_orderstatus || '/year=' || year(o_orderdate) as folder, count(*) * 11 as bytes,
      max(o_orderkey % 3) >= 0 as dated from orders group by 2""",
)
def _(v):
    path = shared_dir(v.spark, "tree")
    lines = v.orders.select(
        F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("value")
    )
    lines.write.partitionBy("status", "year").text(f"{path}/src")
    lines.limit(1).select("value").write.text(f"{path}/other")
    found = readers.read_inventory(v.spark, path, "src/", "files", "shop")
    folder = F.regexp_replace("key", "/[^/]*$", "").alias("folder")
    return found.groupBy("bucket", folder).agg(
        F.sum("size").alias("bytes"), (F.min("last_modified") > F.lit("2020-01-01").cast("timestamp")).alias("dated")
    )


# What the patterns of v_jobs mean, said once more in plain SQL.
GLOB = """(include = '' or include = '[bad'
    or include = '*.mp4' and base like '%.mp4' or include = 'p?*' and base like 'p_%'
    or include = 'src/*/p[0-9]*[^05]?mp4' and regexp_full_match(key, 'src/[^/]*/p[0-9][^/]*[^05][^/]mp4')
    or include = '*[24680].m*' and regexp_full_match(base, '[^/]*[24680]\\.m[^/]*'))
  and not (exclude = '*3.m4a' and base like '%3.m4a' or exclude = 'p1*' and base like 'p1%'
    or exclude = 'src/?/*7.m4a' and regexp_full_match(key, 'src/[^/]/[^/]*7\\.m4a'))"""
MATCHED = f"""select i.*, include, exclude from (select *, regexp_extract(key, '[^/]*$') as base from ({CLEAN})) i
  join v_jobs on v_jobs.job_id = i.job_id where {GLOB}"""


@query("p3_glob_filter", f"select job_id, pos, key, size from ({MATCHED})")
def _(v):
    return inv.glob_filter(v.inv_src, v.jobs).select("job_id", "pos", "key", "size")


@query(
    "p3_glob_regex",
    "select include as pattern, include = '' or include = '[bad' as no_filter, count(*) as jobs from v_jobs group by 1, 2",
)
def _(v):
    return v.jobs.groupBy(F.col("include").alias("pattern"), glob_regex("include").isNull().alias("no_filter")).agg(
        F.count(F.lit(1)).alias("jobs")
    )


REL = """case when src_dir = '' then k when k = src_dir then '' when starts_with(k, src_dir || '/')
  then substr(k, length(src_dir) + 2) else k end"""
BUCKET = """case when endpoint like 's3://%' then split_part(substr(endpoint, 6), '.', 1)
  else trim(regexp_extract(endpoint, '^https?://[^/]*/(.*)$', 1), '/') end"""
DEST = f"""select t.*, endpoint, coalesce({BUCKET}, '') as dst_bucket,
    case when trim(dst_dir, '/') = '' then rel when rel = '' then trim(dst_dir, '/') else trim(dst_dir, '/') || '/' || rel end as dst_key
  from (select *, {REL} as rel from (select t.*, t.src as k, j.dst_dir, j.src_dir, j.metadata_id
    from v_tasks t join v_jobs j on j.job_id = t.job_id)) t left join v_meta m on m.id = metadata_id"""


@query(
    "p4_plan_dest_keys",
    f"""select job_id, id, dst_bucket, dst_key, coalesce(case when endpoint like 's3://%'
        then 'http://' || dst_bucket || '.' || regexp_replace(substr(endpoint, 6), '^[^.]*\\.', '')
        else regexp_extract(endpoint, '^https?://') || dst_bucket || '.' || regexp_extract(endpoint, '^https?://([^/]*)', 1) end
      || '/' || dst_key, '') as dst_url from ({DEST})""",
)
def _(v):
    return (
        inv.plan_dest_keys(v.tasks, v.jobs, v.meta)
        .fillna("", ["dst_url"])
        .select("job_id", "id", "dst_bucket", "dst_key", "dst_url")
    )


@query(
    "p4_plan_output_keys",
    f"""select job_id, id, prefix || '/' || '20240131/' || video_id || '_' ||
      trim(regexp_replace(title, '[^A-Za-z0-9._-]', '_', 'g'), '_') || '.mp4' as output_key from v_downloads""",
)
def _(v):
    tasks = v.downloads.withColumns({"template": F.lit("/$(date +%Y%m%d)/%(id)_%(title).%(ext)"), "ext": F.lit("mp4")})
    return inv.plan_output_keys(tasks, EVENTS_NOW).select("job_id", "id", "output_key")


@query(
    "p5_endpoint_policy",
    """with h as (select job_id, endpoint, coalesce(regexp_extract(endpoint, '^[a-z0-9]+://([^/:]+)', 1), '') as host
        from v_jobs left join v_meta on v_meta.id = metadata_id)
    select job_id, case when host = '' then 'no_host'
        when not (host = 'localhost' or host like '10.%' or (host like '172.%' and try_cast(split_part(host, '.', 2) as int) between 16 and 31)
          or host like '%internal%') then 'not_private' else 'ok' end as reason,
      host <> '' and (host = 'localhost' or host like '10.%' or (host like '172.%' and try_cast(split_part(host, '.', 2) as int) between 16 and 31)
          or host like '%internal%') as allowed from h""",
)
def _(v):
    return inv.endpoint_policy(v.jobs, v.meta, keywords=["internal"]).select("job_id", "reason", "allowed")


@query(
    "p5_endpoint_policy_provider",
    """with h as (select job_id, endpoint, coalesce(regexp_extract(endpoint, '^[a-z0-9]+://([^/:]+)', 1), '') as host
        from v_jobs left join v_meta on v_meta.id = metadata_id)
    select job_id, case when host = '' then 'no_host' when not contains(endpoint, 'bkt1') then 'zone'
        when not (contains(host, 'aliyuncs.com') and contains(host, 'internal')) then 'provider' else 'ok' end as reason from h""",
)
def _(v):
    return inv.endpoint_policy(v.jobs, v.meta, require_private=False, provider="oss", zone="bkt1").select("job_id", "reason")


@query(
    "p8_zero_size_policy",
    """select job_id, id, case when size = 0 then 'FAILED' else status end as status, case when size = 0
      then 'ZeroSizeDisabled: zero-byte transfer disabled by config' else error_message end as error_message from v_tasks""",
)
def _(v):
    return inv.zero_size_policy(v.tasks).select("job_id", "id", "status", "error_message")


FIRST = f"select *, row_number() over (partition by job_id, key order by pos) as rn from ({CLEAN})"
NEW = f"""select f.* from ({FIRST}) f where rn = 1 and not exists
  (select 1 from v_tasks t where t.job_id = f.job_id and t.src = f.key)"""


@query("w1_first_seen", f"select job_id, key, pos, size from ({FIRST}) where rn = 1")
def _(v):
    return inv.first_seen(inv.clean_listing(v.inv_src)).select("job_id", "key", "pos", "size")


@query("j6_new_inputs", f"select job_id, key, pos, size from ({NEW})")
def _(v):
    return inv.new_inputs(inv.clean_listing(v.inv_src), v.tasks).select("job_id", "key", "pos", "size")


@query(
    "w2_allocate_ids",
    f"""select n.job_id, n.key, coalesce(m.top, 0) + row_number() over (partition by n.job_id order by pos) as id
    from ({NEW}) n left join (select job_id, max(id) as top from v_tasks group by 1) m on m.job_id = n.job_id""",
)
def _(v):
    new = inv.new_inputs(inv.clean_listing(v.inv_src), v.tasks)
    return inv.allocate_ids(new, v.tasks, parts=20).select("job_id", "key", "id")


@query(
    "w2_allocate_ids_legacy",
    f"""select f.job_id, key, coalesce(top, f.job_id * 1000000) + row_number() over (partition by f.job_id order by pos) as id
    from ({FIRST}) f left join (select job_id, max(id) as top from v_event_ledger where job_id % 2 = 0 group by 1) m on m.job_id = f.job_id
    where rn = 1""",
)
def _(v):
    # jobs with tasks go on after their largest id, the others start at their own base
    seen = inv.first_seen(inv.clean_listing(v.inv_src))
    return inv.allocate_ids(seen, v.event_ledger.filter("job_id % 2 = 0"), legacy_base=True).select("job_id", "key", "id")


@query(
    "a7_added_bytes",
    f"""select j.job_id, case when n > 0 and status = 'COMPLETED' then 'RUNNING' else status end as status,
      total_count + coalesce(n, 0) as total_count, pending_count + coalesce(n, 0) as pending_count,
      total_size_bytes + coalesce(b, 0) as total_size_bytes
    from v_jobs j left join (select job_id, count(*) as n, sum(greatest(size, 0))::bigint as b from ({NEW}) group by 1) a
      on a.job_id = j.job_id""",
)
def _(v):
    added = inv.added_bytes(inv.new_inputs(inv.clean_listing(v.inv_src), v.tasks))
    return inv.apply_added(v.jobs, added).select("job_id", "status", "total_count", "pending_count", "total_size_bytes")


@query(
    "a10_scan_summary",
    f"""select s.job_id, seen, coalesce(matched, 0) as matched, coalesce(b, 0) as matched_bytes,
      seen - coalesce(matched, 0) as skipped, ceil(seen / 1000)::bigint as pages
    from (select job_id, count(*) as seen from v_inv_src group by 1) s left join
      (select job_id, count(*) as matched, sum(size)::bigint as b from ({MATCHED}) group by 1) m on m.job_id = s.job_id""",
)
def _(v):
    return inv.scan_summary(v.inv_src, inv.glob_filter(v.inv_src, v.jobs))


@query(
    "a10_sizes_by_type",
    f"""select case when audio_url like '%mime=%' then 'audio/mp4' else 'video/mp4' end as content_type,
      count(*) as objects, sum(audio_size)::bigint as bytes from v_downloads group by 1""",
)
def _(v):
    rows = v.downloads.select(
        F.concat("video_id", F.lit("_video.MP4")).alias("key"), F.col("audio_size").alias("size"), "audio_url"
    )
    return inv.sizes_by_type(rows, F.col("audio_url"))


SRC = f"select * from ({FIRST}) where rn = 1"


@query(
    "j2_sync_diff",
    f"""select s.job_id, s.key, case when d.size is null then 'new' when d.size <> s.size then 'changed' else 'same' end as state
    from ({SRC}) s left join v_inv_dst d on d.rel_key = s.rel_key""",
)
def _(v):
    src = inv.first_seen(inv.clean_listing(v.inv_src))
    return inv.sync_diff(src, v.inv_dst).select("job_id", "key", "state")


@query(
    "j2_sync_diff_etag",
    f"""select s.job_id, s.key, case when d.size is null then 'new' when d.size <> s.size or d.etag <> lower(trim(s.etag, '"'))
      then 'changed' else 'same' end as state
    from ({SRC}) s left join v_inv_dst d on d.rel_key = s.rel_key""",
)
def _(v):
    src = inv.first_seen(inv.clean_listing(v.inv_src))
    return inv.sync_diff(src, v.inv_dst, compare_etag=True).select("job_id", "key", "state")


@query(
    "j3_sync_delete_candidates",
    f"select s.job_id, s.key, s.size from ({SRC}) s join v_inv_dst d on d.rel_key = s.rel_key and d.size = s.size",
)
def _(v):
    src = inv.first_seen(inv.clean_listing(v.inv_src))
    return inv.sync_delete_candidates(src, v.inv_dst).select("job_id", "key", "size")


SIDES = """select job_id, pos, key, size, regexp_extract(key, '^(.*/)?[^/]*$', 1) as dir,
    split_part(split_part(regexp_extract(key, '[^/]*$'), '_video.', 1), '_audio.', 1) as pair_id,
    contains(key, '_video.') as is_video from v_media where contains(key, '_video.') or contains(key, '_audio.')"""


def pairs_sql(keys: str) -> str:
    return f"""select job_id, pair_id, max(key) filter (is_video) as video_key, max(size) filter (is_video) as video_size,
        max(key) filter (not is_video) as audio_key, max(size) filter (not is_video) as audio_size
      from (select *, row_number() over (partition by {keys}, is_video order by pos desc) as rn from ({SIDES}))
      where rn = 1 group by {keys} having count(*) = 2"""


@query("j4_pair_media", pairs_sql("job_id, pair_id"))
def _(v):
    return inv.pair_media(v.media)


@query("j4_pair_media_within_dir", pairs_sql("job_id, pair_id, dir"))
def _(v):
    return inv.pair_media(v.media, within_dir=True)


@query(
    "j5_skip_existing",
    """with r as (select d.job_id, d.id, s.side, coalesce(o.size, 0) as size
        from (select *, coalesce(nullif(download_mode, ''), 'both') as mode from v_downloads) d
        join (values ('audio', '_audio.m4a'), ('video', '_video.mp4')) s(side, suffix) on mode in (s.side, 'both')
        left join v_outputs o on o.key = d.prefix || '/' || d.video_id || s.suffix),
      a as (select job_id, id, max(size) filter (side = 'audio') as a, max(size) filter (side = 'video') as v
        from r group by 1, 2 having min(size) > 0)
    select d.job_id, d.id, case when a.id is not null then 'COMPLETED' else status end as status,
      coalesce(a, 0) as audio_size, coalesce(v, 0) as video_size
    from v_downloads d left join a on a.job_id = d.job_id and a.id = d.id""",
)
def _(v):
    tasks = v.downloads.drop("audio_size", "video_size")
    return inv.skip_existing(tasks, v.outputs).select("job_id", "id", "status", "audio_size", "video_size")


@query(
    "j5_merged_outputs",
    f"""select job_id, pair_id, 'p/' || pair_id || '.mp4' as output_key, o.key is not null as exists,
      coalesce(o.size, 0) as output_size
    from ({pairs_sql("job_id, pair_id")}) p left join (select regexp_replace(key, '_.*$', '.mp4') as key, max(size) as size
      from v_media group by 1) o on o.key = 'p/' || pair_id || '.mp4'""",
)
def _(v):
    have = v.media.groupBy(F.regexp_replace("key", "_.*$", ".mp4").alias("key")).agg(F.max("size").alias("size"))
    pairs = inv.pair_media(v.media).withColumn("prefix", F.lit("p/"))
    return inv.merged_outputs(pairs, have).select("job_id", "pair_id", "output_key", "exists", "output_size")


@query(
    "j7_exclude_permanent",
    f"""select p.* from ({pairs_sql("job_id, pair_id")}) p where not exists (select 1 from v_media m
      where m.job_id = p.job_id and m.key like '%_other.txt' and split_part(split_part(m.key, '/', 2), '_other', 1) = p.pair_id)""",
)
def _(v):
    failed = v.media.filter(F.col("key").like("%\\_other.txt")).select(
        "job_id", F.split_part(C.basename("key"), F.lit("_other"), F.lit(1)).alias("pair_id")
    )
    return inv.exclude_permanent(inv.pair_media(v.media), failed)


@query(
    "u2_all_task_ids",
    """select distinct job_id, try_cast(task_id as bigint) as task_id from (
      select job_id, cast(id as varchar) as task_id from v_tasks union all
      select 0, task_id from v_queue) where try_cast(task_id as bigint) is not null""",
)
def _(v):
    legacy = v.tasks.select("job_id", F.col("id").cast("string").alias("task_id"))
    sharded = v.queue.select(F.lit(0).cast("long").alias("job_id"), "task_id")
    return inv.all_task_ids(legacy, sharded)
