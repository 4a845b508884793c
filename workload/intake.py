"""Queries over URL manifests, submissions and queue routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.operators import intake
from mediaops.sources import readers
from workload.registry import query

SOURCES_NOW = "2023-11-14 22:20:00"  # epoch 1700000400

CANDIDATES = """select submission, line_no, page_id, trim(trim(trim(c), '`"''')) as candidate, url_no from (
  select submission, line_no, page_id, unnest(regexp_split_to_array(line, '[\\n\\r\\t ,;|]+')) as c,
    generate_subscripts(regexp_split_to_array(line, '[\\n\\r\\t ,;|]+'), 1) as url_no from v_url_lines)
  where trim(trim(trim(c), '`"''')) <> ''"""
URL = "(?i)^(https?://)?(www\\.)?(youtube\\.com/watch\\?v=|youtu\\.be/|youtube\\.com/embed/|m\\.youtube\\.com/watch\\?v=)([a-zA-Z0-9_-]{11})([?&][^\\s]*)?$"
VALID = f"""select *, case when regexp_extract(candidate, '{URL}', 4) <> '' then 'url'
    when regexp_full_match(candidate, '[a-zA-Z0-9_-]{{11}}') then 'id' else 'bad' end as kind from ({CANDIDATES})"""


@query("n1_split_candidates", f"select submission, line_no, candidate, url_no - 1 as item_no from ({CANDIDATES})")
def _(v):
    return intake.split_candidates(v.url_lines)


@query(
    "n2_validate_urls",
    f"""select submission, line_no, candidate, kind, case kind when 'url' then regexp_extract(candidate, '{URL}', 4)
      when 'id' then candidate else '' end as video_id, case kind when 'url' then candidate
      when 'id' then 'https://www.youtube.com/watch?v=' || candidate end as url, kind = 'id' as fixed from ({VALID})""",
)
def _(v):
    return intake.validate_urls(intake.split_candidates(v.url_lines)).select(
        "submission", "line_no", "candidate", "kind", "video_id", "url", "fixed"
    )


# Messages of the report.
REJECTS = f"""select submission, line_no, candidate as content, case kind when 'id' then 'Line contains only video_id ''' || candidate ||
        ''', not a valid YouTube URL. Please use format: https://www.youtube.com/watch?v=' || candidate
        else 'Invalid format: ''' || candidate || '''. Expected YouTube URL (e.g., https://www.youtube.com/watch?v=VIDEO_ID) or video_id' end
        as message, kind = 'id' as fixed, case kind when 'id' then 'https://www.youtube.com/watch?v=' || candidate end as fixed_url
    from ({VALID}) where kind <> 'url'"""


@query("n2_manifest_errors", REJECTS)
def _(v):
    return intake.manifest_errors(intake.validate_urls(intake.split_candidates(v.url_lines)))


@query(
    "n3_accept_manifest",
    f"""select submission, count(*) filter (kind <> 'bad') as valid_count, count(*) filter (kind <> 'url') as error_count,
      count(*) as total_count, count(*) filter (kind <> 'url') = 0 as accepted from ({VALID}) group by 1""",
)
def _(v):
    return intake.accept_manifest(intake.validate_urls(intake.split_candidates(v.url_lines)))


@query(
    "n3_accepted_urls",
    f"""select submission, line_no, candidate as url from ({VALID}) v
    where submission not in (select submission from ({VALID}) where kind <> 'url')""",
)
def _(v):
    valid = intake.validate_urls(intake.split_candidates(v.url_lines))
    return intake.accepted_urls(valid).select("submission", "line_no", "url")


@query(
    "n4_append_tasks",
    f"""with u as (select substr(submission, 2)::bigint * 2 + 1 as job_id, candidate as url, line_no * 1000 + url_no as pos from ({VALID})),
      m as (select job_id, max(id) as top from v_downloads group by 1)
    select u.job_id, u.url, 'PENDING' as status, coalesce(top, u.job_id * 1000000) + row_number() over (partition by u.job_id order by pos) as id
    from u left join m on m.job_id = u.job_id""",
)
def _(v):
    cands = intake.split_candidates(v.url_lines)
    urls = cands.select(
        (F.substr("submission", F.lit(2)).cast("long") * 2 + 1).alias("job_id"),
        F.col("candidate").alias("url"),
        (F.col("line_no") * 1000 + F.col("item_no") + 1).alias("pos"),
    )
    return intake.append_tasks(urls, v.downloads, SOURCES_NOW).select("job_id", "url", "status", "id")


@query(
    "u1_union_manifests",
    """select 'typed' as origin, line from v_url_lines union all select 'linked', url from pages
    union all select 'file', line from v_url_lines""",
)
def _(v):
    def tag(df, name, c):
        return df.select(F.lit(name).alias("origin"), F.col(c).alias("line"))

    return intake.union_manifests(
        tag(v.url_lines, "typed", "line"), tag(v.pages, "linked", "url"), tag(v.url_lines, "file", "line")
    )


@query(
    "p15_normalize_jobs",
    """select job_id, 'PENDING' as status, case when is_incremental and interval0 <= 0 then 600 else interval0 end as periodic_interval,
      case when download_mode = '' then 'both' else download_mode end as download_mode,
      case when video_strategy = '' then 'highest_quality' else video_strategy end as video_strategy,
      coalesce(n, 0) as total_count, coalesce(n, 0) as pending_count
    from (select *, case when job_id % 2 = 0 then 0 else periodic_interval end as interval0 from v_jobs) j
      left join (select job_id as jid, count(*) as n from v_tasks group by 1) t on jid = job_id""",
)
def _(v):
    jobs = v.jobs.withColumn(
        "periodic_interval", F.when(F.col("job_id") % 2 == 0, 0).otherwise(F.col("periodic_interval"))
    )
    return intake.normalize_jobs(jobs, v.tasks).select(
        "job_id", "status", "periodic_interval", "download_mode", "video_strategy", "total_count", "pending_count"
    )


@query(
    "p16_expand_linked_jobs",
    """with s as (select p_partkey as id, (p_partkey % 4)::bigint as n from part where p_partkey % 4 > 0)
    select id, 'download' as kind, '' as src_dir, 'pipeline/' || id || '/raw/' as dst_dir, false as delete_source,
      0 as periodic_interval, n as total_count from s
    union all select id, 'copy', 'pipeline/' || id || '/raw/', 'pipeline/' || id || '/process/', true, 60, 0 from s
    union all select id, 'merge', 'pipeline/' || id || '/process/', '', false, 60, 0 from s""",
)
def _(v):
    specs = v.part.select(
        F.col("p_partkey").alias("id"),
        F.lit(1).alias("metadata_id"),
        F.array_repeat("p_name", (F.col("p_partkey") % 4).cast("int")).alias("urls"),
    )
    return intake.expand_linked_jobs(specs).select(
        "id", "kind", "src_dir", "dst_dir", "delete_source", "periodic_interval", "total_count"
    )


def stale_sql(c: str) -> str:
    return f"""(contains({c}, 'r2.cloudflarestorage.com') and contains({c}, 'x-id=PutObject')
      or contains({c}, 'googlevideo.com') and try_cast(regexp_extract({c}, 'expire=(\\d+)', 1) as bigint)
        - epoch(timestamp '{SOURCES_NOW}')::bigint <= 180)"""


@query(
    "p6_stale_sources",
    f"""select job_id, id, 'PENDING' as status from v_downloads
    where coalesce({stale_sql('audio_url')}, false) or coalesce({stale_sql('video_url')}, false)""",
)
def _(v):
    return intake.stale_sources(v.downloads, SOURCES_NOW).select("job_id", "id", "status")


@query("p7_downloadable", "select job_id, id from v_downloads where audio_url <> '' or video_url <> ''")
def _(v):
    return intake.downloadable(v.downloads).select("job_id", "id")


@query(
    "p7_promoted",
    """select job_id, task_id, seq from (select *, coalesce(lag(status) over (partition by job_id, task_id order by seq), 'PENDING') as old
      from v_task_events) where status = 'METADATA_FETCHED' and old <> status and (audio_url <> '' or video_url <> '')""",
)
def _(v):
    from mediaops.operators.ledger import transitions

    return intake.promoted(transitions(v.task_events)).select("job_id", "task_id", "seq")


@query(
    "j13_route_queue",
    """select d.job_id, d.id, 'queue:' || case when audio_url <> '' or video_url <> '' then 'download_ready' else 'metadata_retry' end
      || ':' || coalesce(nullif(j.machine_name, ''), nullif(w.machine_name, ''), 'all') as queue_name
    from v_downloads d left join v_jobs j on j.job_id = d.job_id left join v_machines w on w.worker_id = d.worker_id""",
)
def _(v):
    return intake.route_queue(v.downloads, v.jobs, v.machines).select("job_id", "id", "queue_name")


@query(
    "j16_machine_tasks",
    "select t.job_id, t.id from v_tasks t join v_jobs j on j.job_id = t.job_id where machine_name in ('', 'm2')",
)
def _(v):
    return intake.machine_tasks(v.tasks, v.jobs, "m2").select("job_id", "id")


@query(
    "p12_retryable_copy",
    """select job_id, id from v_tasks where status = 'FAILED' and not regexp_matches(lower(error_message),
      'sourcenotfound|source fetch returned 404|zerosizedisabled|zero-byte transfer disabled by config')""",
)
def _(v):
    return intake.retryable_tasks(v.tasks, "copy").select("job_id", "id")


@query(
    "p12_retryable_download",
    """select job_id, id from v_downloads where status = 'FAILED' and (is_download_fail
      or contains(error_message, 'Sign in to confirm you’re not a bot'))""",
)
def _(v):
    return intake.retryable_tasks(v.downloads, "download").select("job_id", "id")


@query(
    "p12_retryable_bulk",
    """select job_id, id from v_downloads where status = 'FAILED' and error_message not in
      ('Sign in to confirm you’re not a bot', 'Private video. Sign in', 'Video unavailable')""",
)
def _(v):
    return intake.retryable_tasks(v.downloads, "bulk").select("job_id", "id")


@query("p12_retryable_merge", "select job_id, id from v_downloads where status = 'FAILED'")
def _(v):
    return intake.retryable_tasks(v.downloads, "merge").select("job_id", "id")


@query(
    "s3_parse_task_json",
    """select id, job_id, src, size, run_token, status, error_message, worker_id, case id % 12 when 10 then -1
        when 11 then epoch_us(d + interval 3723 second + interval 500 millisecond) - 0
        else epoch_us(d + interval 3723 second) + case id % 12 when 0 then 123456 when 2 then 123456 when 3 then 123456 when 4 then 123000
          when 6 then 123456 when 7 then 123456 when 8 then 123000 else 0 end end as started_at,
      -1::bigint as completed_at, epoch_us(d) as created_at, -1::bigint as updated_at
    from (select *, date_trunc('day', created_at)::timestamp as d from v_tasks)""",
)
def _(v):
    return readers.parse_task_json(v.task_json, "raw")


@query(
    "c_member_fields",
    """select event_id, split_part(member, ':', 1)::bigint as job_id, split_part(member, ':', 2)::bigint as task_id,
      substr(member, length(split_part(member, ':', 1)) + length(split_part(member, ':', 2)) + 3) as run_token
    from v_member_text where regexp_matches(member, '^[1-9]\\d*:[1-9]\\d*:.+$')""",
)
def _(v):
    rows = v.member_text.withColumn("m", C.member_fields("member")).filter("m is not null")
    return rows.select("event_id", "m.job_id", "m.task_id", "m.run_token")
