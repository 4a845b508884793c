"""URL intake, job submission defaults, source checks and queue routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.functions import rules
from mediaops.operators.errors import contains_any, straight_quotes
from mediaops.operators.inventory import allocate_ids

# Accepted video URLs and bare ids.
VIDEO_URL = (
    r"(?i)^(https?://)?(www\.)?"
    r"(youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/|m\.youtube\.com/watch\?v=)"
    r"([a-zA-Z0-9_-]{11})([?&][^\s]*)?$"
)
VIDEO_ID = r"^[a-zA-Z0-9_-]{11}$"
WATCH_URL = "https://www.youtube.com/watch?v="


def split_candidates(lines: DataFrame) -> DataFrame:
    """One row per candidate of each manifest line, quotes stripped, empties dropped."""
    parts = F.split("line", r"[\n\r\t ,;|]+")
    return (
        lines.select("submission", "line_no", F.posexplode(parts).alias("item_no", "candidate"))
        .withColumn("candidate", F.trim(F.btrim(F.trim("candidate"), F.lit("`\"'"))))
        .filter("candidate <> ''")
    )


def validate_urls(candidates: DataFrame) -> DataFrame:
    """Candidates with ``kind`` url, id or bad, ``video_id``, the URL to use and the error text."""
    c = F.col("candidate")
    from_url = F.regexp_extract(c, VIDEO_URL, 4)
    kind = F.when(from_url != "", "url").when(c.rlike(VIDEO_ID), "id").otherwise("bad")
    rewritten = F.concat(F.lit(WATCH_URL), c)
    return candidates.withColumns({"kind": kind}).withColumns(
        {
            "video_id": F.when(F.col("kind") == "url", from_url).when(F.col("kind") == "id", c).otherwise(""),
            "url": F.when(F.col("kind") == "url", c).when(F.col("kind") == "id", rewritten),
            "fixed": F.col("kind") == "id",
            # Messages of the report.
            "message": F.when(
                F.col("kind") == "id",
                F.concat(
                    F.lit("Line contains only video_id '"), c,
                    F.lit("', not a valid YouTube URL. Please use format: "), rewritten,
                ),
            ).when(
                F.col("kind") == "bad",
                F.concat(
                    F.lit("Invalid format: '"), c,
                    F.lit("'. Expected YouTube URL (e.g., https://www.youtube.com/watch?v=VIDEO_ID) or video_id"),
                ),
            ).otherwise(""),
        }
    )


def manifest_errors(validated: DataFrame) -> DataFrame:
    """Error report of the validated candidates (fixed ones included), for ``write_rejects``."""
    return validated.filter("kind <> 'url'").select(
        "submission",
        "line_no",
        F.col("candidate").alias("content"),
        "message",
        "fixed",
        F.when(F.col("fixed"), F.col("url")).alias("fixed_url"),
    )


def accept_manifest(validated: DataFrame) -> DataFrame:
    """Per submission: counts and ``accepted``; any error, even a fixed one, rejects it all."""
    return validated.groupBy("submission").agg(
        F.count_if(F.col("kind") != "bad").alias("valid_count"),
        F.count_if(F.col("kind") != "url").alias("error_count"),
        F.count(F.lit(1)).alias("total_count"),
        (F.count_if(F.col("kind") != "url") == 0).alias("accepted"),
    )


def accepted_urls(validated: DataFrame) -> DataFrame:
    """URLs of the submissions without errors: anti join on the rejected submissions."""
    rejected = validated.filter("kind <> 'url'").select("submission").distinct()
    return validated.join(rejected, "submission", "left_anti")


def append_tasks(urls: DataFrame, ledger: DataFrame, as_of, order: str = "pos") -> DataFrame:
    """New pending tasks of a job from its URLs.

    Ids continue from the job's largest, or start at ``job_id * 1e6``; URLs are not de-duplicated;
    an id that exists is skipped. ``urls``: job_id, url, and the arrival order.
    """
    rows = allocate_ids(urls, ledger, order, legacy_base=True)
    return rows.join(ledger.select("job_id", "id"), ["job_id", "id"], "left_anti").select(
        "job_id",
        "id",
        "url",
        F.lit(C.PENDING).alias("status"),
        C.ts(as_of).alias("created_at"),
        C.ts(as_of).alias("updated_at"),
    )


def union_manifests(*manifests: DataFrame) -> DataFrame:
    """Uploaded, typed and linked lists together, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), manifests)


def normalize_jobs(jobs: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Submission defaults (P15): status, scan interval, mode, strategy, counts of the given tasks."""
    short = F.col("is_incremental") & (F.col("periodic_interval") <= 0)
    changes = {"status": F.lit(C.PENDING)}
    if "periodic_interval" in jobs.columns:
        changes["periodic_interval"] = F.when(short, F.lit(600)).otherwise(F.col("periodic_interval"))
    for name, default in (("download_mode", "both"), ("video_strategy", "highest_quality")):
        if name in jobs.columns:
            changes[name] = F.coalesce(C.present(name), F.lit(default))
    out = jobs.withColumns(changes)
    if tasks is not None:
        n = tasks.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
        out = (
            out.join(n, "job_id", "left")
            .withColumns({c: F.coalesce("_n", F.lit(0)) for c in ("total_count", "pending_count")})
            .drop("_n")
        )
    return out


def expand_linked_jobs(specs: DataFrame) -> DataFrame:
    """One combined request becomes its download, copy and merge job.

    ``specs``: id, metadata_id, urls (array). Copy and merge jobs rescan each minute; the copy job
    deletes its sources.
    """
    n = F.size("urls").cast("long")
    raw = F.concat(F.lit("pipeline/"), F.col("id").cast("string"), F.lit("/raw/"))
    work = F.concat(F.lit("pipeline/"), F.col("id").cast("string"), F.lit("/process/"))
    none = F.lit("")

    def row(kind, src, dst, deletes, interval, count):
        return F.struct(
            F.lit(kind).alias("kind"),
            src.alias("src_dir"),
            dst.alias("dst_dir"),
            F.lit(deletes).alias("delete_source"),
            F.lit(interval > 0).alias("is_incremental"),
            F.lit(interval).alias("periodic_interval"),
            count.alias("total_count"),
        )

    jobs = F.array(
        row("download", none, raw, False, 0, n),
        row("copy", raw, work, True, 60, F.lit(0).cast("long")),
        row("merge", work, none, False, 60, F.lit(0).cast("long")),
    )
    return specs.filter(n > 0).select(
        "id", "metadata_id", F.lit(C.PENDING).alias("status"), F.inline(jobs)
    )


def needs_refresh(url, as_of, margin: int = 180) -> Column:
    """Source URL about to expire, or presigned for the wrong method."""
    # Hosts and parameters that tell.
    host = F.coalesce(F.lower(F.try_parse_url(C.col(url), F.lit("HOST"))), F.lit(""))
    upload_sign = F.contains(host, F.lit("r2.cloudflarestorage.com")) & (
        F.lower(F.coalesce(C.query_param(url, "x-id"), F.lit(""))) == "putobject"
    )
    expires = C.query_param(url, "expire").try_cast("long")
    old = F.contains(host, F.lit("googlevideo.com")) & (expires - F.unix_timestamp(C.ts(as_of)) <= margin)
    return upload_sign | F.coalesce(old, F.lit(False))


def stale_sources(tasks: DataFrame, as_of) -> DataFrame:
    """Tasks with a stale audio or video URL, back to pending."""
    return tasks.filter(needs_refresh("audio_url", as_of) | needs_refresh("video_url", as_of)).withColumn(
        "status", F.lit(C.PENDING)
    )


def has_source(audio="audio_url", video="video_url") -> Column:
    return (F.coalesce(audio, F.lit("")) != "") | (F.coalesce(video, F.lit("")) != "")


def downloadable(tasks: DataFrame) -> DataFrame:
    """Tasks with at least one source URL."""
    return tasks.filter(has_source())


def promoted(moves: DataFrame) -> DataFrame:
    """Transitions into ``METADATA_FETCHED`` of tasks with a source URL: these become ready."""
    return moves.filter((F.col("new_status") == C.METADATA_FETCHED) & has_source())


def route_queue(tasks: DataFrame, jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """Queue of each task (J13): its job's machine, else the reporting worker's, else ``all``.

    Tasks with a source URL go to the download queue, the others to the metadata queue.
    """
    bound = jobs.select("job_id", F.col("machine_name").alias("_job_machine"))
    seen = workers.select("worker_id", F.col("machine_name").alias("_worker_machine"))
    kind = F.when(has_source(), F.lit("download_ready")).otherwise(F.lit("metadata_retry"))
    machine = F.coalesce(C.present("_job_machine"), C.present("_worker_machine"), F.lit("all"))
    return (
        tasks.join(bound, "job_id", "left")
        .join(seen, "worker_id", "left")
        .withColumns({"machine": machine, "queue_type": kind})
        .withColumn("queue_name", F.concat_ws(":", F.lit("queue"), "queue_type", "machine"))
        .drop("_job_machine", "_worker_machine")
    )


def machine_tasks(tasks: DataFrame, jobs: DataFrame, machine: str) -> DataFrame:
    """Tasks a machine may take: those of jobs bound to it or to none."""
    open_to = F.coalesce("machine_name", F.lit("")).isin("", machine)
    return tasks.join(jobs.filter(open_to).select("job_id"), "job_id", "left_semi")


def retryable_tasks(tasks: DataFrame, kind: str) -> DataFrame:
    """Failed tasks worth a retry.

    ``copy``: no permanent marker; ``download``: flagged as download failure or stopped by the bot
    check; ``bulk``: none of the permanent phrases; ``merge``: any failed task.
    """
    return tasks.filter(is_retryable(kind))


def is_retryable(kind: str) -> Column:
    failed = F.col("status") == C.FAILED
    if kind == "copy":
        return failed & ~contains_any("error_message", rules.COPY_PERMANENT)
    if kind == "download":
        bot = F.contains(straight_quotes(F.coalesce("error_message", F.lit(""))), F.lit(rules.BOT_CHECK))
        return failed & (F.coalesce("is_download_fail", F.lit(False)) | bot)
    if kind == "bulk":
        return failed & ~contains_any("error_message", rules.DOWNLOAD_PERMANENT)
    if kind == "merge":
        return failed
    raise ValueError(f"unknown kind: {kind}")
