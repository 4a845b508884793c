"""Queries over the readers and writers: tables go out to the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaops.operators import intake, merges
from mediaops.operators import inventory as inv
from mediaops.session import shared_dir
from mediaops.sources import changes, readers, sinks
from workload.inventory import NEW
from workload.ledger import MERGED
from workload.intake import REJECTS
from workload.registry import JOBS_NOW, query

# The columns that a merge doesn't touch.
WHOLE = """, src, audio_url, video_url, @us(created_at) as created_at
    from v_event_ledger l left join f on f.job_id = l.job_id and f.task_id = l.id"""

TASK = """id, job_id, src, size, run_token, status, error_message, worker_id, @us(started_at) as started_at,
  @us(completed_at) as completed_at, @us(created_at) as created_at, @us(updated_at) as updated_at"""


@query("s2_read_ledger", f"select {TASK} from v_tasks")
def _(v):
    path = shared_dir(v.spark, "ledger")
    v.tasks.write.parquet(path)
    return readers.read_ledger(v.spark, path, "copy")


@query(
    "k1_write_ledger",
    f"""select job_id, id, key as src, size, (job_id * 31 + id // 50000) % 1024 as bucket from (
      select n.job_id, n.key, n.size, coalesce(m.top, 0) + row_number() over (partition by n.job_id order by pos) as id
      from ({NEW}) n left join (select job_id, max(id) as top from v_event_ledger group by 1) m on m.job_id = n.job_id)""",
)
def _(v):
    path = shared_dir(v.spark, "ledger")
    new = inv.new_inputs(inv.clean_listing(v.inv_src), v.tasks)
    tasks = inv.allocate_ids(new, v.event_ledger).select("job_id", "id", F.col("key").alias("src"), "size")
    sinks.write_ledger(tasks, path)
    return v.spark.read.parquet(path)


@query(
    "k2_upsert_ledger",
    MERGED + WHOLE,
)
def _(v):
    path, stage = shared_dir(v.spark, "ledger"), shared_dir(v.spark, "upsert")
    sinks.write_ledger(v.event_ledger, path, ids_per_bucket=30)
    updates = v.task_events.withColumnRenamed("task_id", "id")
    for _ in range(2):  # the repeated run finds its stage finished and changes nothing
        sinks.upsert_ledger(updates, path, lambda cur, new: merges.merge_fenced(cur, new)[0], stage, ids_per_bucket=30)
    return changes.read_rows(v.spark, path)


@query(
    "k3_write_rejects",
    f"select submission, line_no as line_number, content, message, fixed, fixed_url from ({REJECTS})",
)
def _(v):
    path = shared_dir(v.spark, "rejects")
    sinks.write_rejects(intake.manifest_errors(intake.validate_urls(intake.split_candidates(v.url_lines))), path)
    schema = "submission string, line_number long, content string, message string, fixed boolean, fixed_url string"
    return v.spark.read.schema(schema).json(path)


# Every line also brings a signed URL; the report shows its address, part and the start of its upload id.
SIGNED = "https://store.example/k"


@query(
    "k3_write_rejects_redacted",
    f"""with bad as (select *, case when contains(content, '://') then regexp_replace(content, '[?#].*', '') else content end as shown from ({REJECTS})),
      more as (select submission, line_no, '{SIGNED}' || v.page_id || '?partNumber=3&uploadId=' || substr(md5(p.url), 1, 8) || '...' as shown
        from v_url_lines v join pages p on p.page_id = v.page_id)
    select submission, line_no as line_number, shown as content, replace(message, '''' || content || '''', '''' || shown || '''') as message,
      fixed, fixed_url from bad
    union all select submission, line_no, shown, 'Invalid format: ''' || shown ||
      '''. Expected YouTube URL (e.g., https://www.youtube.com/watch?v=VIDEO_ID) or video_id', false, null from more""",
)
def _(v):
    path = shared_dir(v.spark, "rejects")
    link = F.concat(F.lit(f" {SIGNED}"), F.col("page_id").cast("string"), F.lit("?sig=s&uploadId="), F.md5("url"), F.lit("&partNumber=3#end"))
    lines = v.url_lines.join(v.pages.select("page_id", "url"), "page_id").withColumn("line", F.concat("line", link))
    sinks.write_rejects(intake.manifest_errors(intake.validate_urls(intake.split_candidates(lines))), path, redact=True)
    schema = "submission string, line_number long, content string, message string, fixed boolean, fixed_url string"
    return v.spark.read.schema(schema).json(path)


@query("k4_write_tasks_queue", "select job_id, id, status, case when status = 'PENDING' then 'a' else 'b' end as batch from v_tasks")
def _(v):
    path = shared_dir(v.spark, "queue")
    rows = v.tasks.select("job_id", "id", "status")
    for batch, part in (("a", rows.filter("status = 'PENDING'")), ("b", rows.filter("status <> 'PENDING'")), ("a", rows.filter("status = 'PENDING'"))):
        sinks.write_tasks_queue(part, path, batch)
    return v.spark.read.parquet(path)


@query(
    "s4_read_url_manifest",
    """select 'm' || page_id % 7 as manifest, row_number() over (partition by page_id % 7 order by page_id) as line_no, line from v_url_lines""",
)
def _(v):
    path = shared_dir(v.spark, "manifests")
    lines = v.url_lines.select(F.concat(F.lit("m"), (F.col("page_id") % 7).cast("string")).alias("manifest"), "line", "page_id")
    lines.repartition("manifest").sortWithinPartitions("manifest", "page_id").select("manifest", "line").write.partitionBy(
        "manifest"
    ).text(path)
    read = readers.read_url_manifest(v.spark, f"{path}/manifest=*")
    return read.select(F.regexp_extract("submission", "manifest=([^/]+)", 1).alias("manifest"), "line_no", "line")


@query(
    "s5_read_formats",
    """select video_id || '-' || cast(pos as varchar) as video_id, n as pos, format_id || '-' || n as format_id, coalesce(height, -1) as height,
      coalesce(filesize, n) as filesize from (select *, unnest(range(2)) as n from v_formats)""",
)
def _(v):
    path = shared_dir(v.spark, "formats")

    def entry(n):
        return F.struct(
            F.concat("format_id", F.lit(f"-{n}")).alias("format_id"), "vcodec", "acodec", "height", "width", "abr", "language",
            "filesize", F.lit(n).cast("long").alias("filesize_approx"), "url",
        )

    nested = v.formats.select(
        F.concat("video_id", F.lit("-"), F.col("pos").cast("string")).alias("id"), F.array(entry(0), entry(1)).alias("formats")
    )
    # Extractor output is kept packed; files are small enough to be read side by side, as a packed one isn't split.
    nested.write.option("compression", "gzip").option("maxRecordsPerFile", 500_000).json(path)
    rows = readers.read_formats(v.spark, path)
    return rows.select("video_id", "pos", "format_id", "height", "filesize").fillna(-1, ["height"])


@query("s6_read_dims", "select id, client_name, endpoint from v_meta")
def _(v):
    path = shared_dir(v.spark, "meta")
    v.meta.withColumns({"ak": F.lit("x"), "sk_encrypted": F.lit("y")}).write.parquet(path)
    return readers.read_dims(v.spark, path)


MESSAGES = """select seq, @us(event_ts) as event_ts, job_id, task_id, run_token, worker_id, status, size, error_message from v_task_events"""


@query("s7_stream_task_events", MESSAGES)
def _(v):
    from mediaops.streaming.run import run_available

    path = shared_dir(v.spark, "messages")
    v.task_events.withColumn("kind", F.lit("update")).drop("audio_url", "video_url").write.option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    ).json(path)
    return run_available(readers.stream_task_events(v.spark, path)).drop("kind")


@query(
    "s8_stream_inventory",
    "select bucket, key, size, lower(etag) as etag from v_inv_dst",
)
def _(v):
    from mediaops.streaming.run import run_available

    path = shared_dir(v.spark, "listing")
    v.inv_dst.select("bucket", "key", "size", "etag", F.lit(JOBS_NOW).cast("timestamp").alias("last_modified")).write.parquet(path)
    return run_available(readers.stream_inventory(v.spark, path)).drop("last_modified")
