"""Schemas of the stored tables and messages."""

from __future__ import annotations

# Credential columns a source may carry; never kept.
CREDENTIALS = ["ak", "sk_encrypted", "cookie_content"]

COPY_TASK = """
    id long, job_id long, src string, size long, run_token string, status string, error_message string,
    worker_id string, started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp
"""

DOWNLOAD_TASK = """
    id long, job_id long, url string, title string, video_id string, audio_url string, audio_size long,
    video_url string, video_size long, status string, is_download_fail boolean, error_message string,
    worker_id string, started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp
"""

MERGE_TASK = """
    id long, job_id long, video_key string, audio_key string, video_size long, audio_size long,
    retry_count long, status string, error_message string, worker_id string, started_at timestamp,
    completed_at timestamp, created_at timestamp, updated_at timestamp
"""

TASKS = {"copy": COPY_TASK, "download": DOWNLOAD_TASK, "merge": MERGE_TASK}

JOB = """
    job_id long, metadata_id long, src_dir string, dst_dir string, include string, exclude string,
    delete_source boolean, is_incremental boolean, periodic_interval int, last_scan_time timestamp,
    status string, start_time timestamp, end_time timestamp, duration_seconds long, execution_count long,
    total_count long, pending_count long, running_count long, success_count long, failed_count long,
    total_size_bytes long, success_size_bytes long, result_message string, cleaned boolean,
    machine_name string, created_at timestamp, updated_at timestamp
"""

INVENTORY = "bucket string, key string, size long, etag string, last_modified timestamp"

FORMATS = """
    id string, title string, formats array<struct<format_id: string, vcodec: string, acodec: string,
    height: int, width: int, abr: double, language: string, filesize: long, filesize_approx: long, url: string>>
"""

TASK_EVENT = """
    seq long, event_ts timestamp, kind string, job_id long, task_id long, run_token string, worker_id string,
    status string, size long, error_message string
"""
