"""Streams fed file by file give what one batch over all rows gives, and what a replay gives."""

from __future__ import annotations

import datetime as dt
import functools
import random

import pytest
from pyspark.sql import functions as F

from mediaops.operators import ledger, merges
from mediaops.session import shared_dir
from mediaops.sources import changes, sinks
from mediaops.streaming import jobs as sj
from mediaops.streaming import state as ss

T0 = dt.datetime(2024, 1, 1)
SCHEMA = """seq long, event_ts timestamp, job_id long, task_id long, id long, worker_id string, run_token string, kind string,
    status string, size long, error_message string, op string"""
FILES = 3


def rows(seed=1, n=240):
    rnd = random.Random(seed)
    out, now = [], 0
    for seq in range(n):
        now += rnd.choice([1, 5, 40, 90, 400])
        t = rnd.randrange(1, 5)
        out.append(
            (
                seq, T0 + dt.timedelta(seconds=now), 1 + t % 2, t, t, f"w{rnd.randrange(3)}", rnd.choice(["", "a", "b"]),
                rnd.choice(["claim", "activate", "progress", "progress", "done"]),
                rnd.choice(["PENDING", "RUNNING", "COMPLETED", "FAILED", "FAILED"]), rnd.choice([0, 3]),
                rnd.choice(["", "SourceNotFound"]), rnd.choice(["save", "save", "clear"]),
            )
        )
    return out


@pytest.fixture(scope="module")
def feeds(spark):
    """The same events as one file and as several files in order."""
    data = rows()
    whole, pieces = shared_dir(spark, "whole"), shared_dir(spark, "pieces")
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(whole)
    step = len(data) // FILES
    for n in range(FILES):
        spark.createDataFrame(data[n * step : (n + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(pieces)

    def open_stream(path):
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)

    return data, lambda: open_stream(whole), lambda: open_stream(pieces)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "run",
    [
        lambda e, p: ss.stream_worker_liveness(e, p),
        lambda e, p: ss.stream_stale_tasks(e, p, claim_seconds=120, running_seconds=90),
        lambda e, p: ss.stream_retry_due(e, p),
        lambda e, p: ss.stream_checkpoint_expiry(e, p, ttl_seconds=300),
        lambda e, p: sj.stream_fenced_state(e, p, ids_per_bucket=2),
        lambda e, p: sj.stream_job_counters(e, p),
    ],
    ids=["liveness", "stale", "retry_due", "expiry", "fence", "counters"],
)
def test_batches_do_not_matter(spark, feeds, run):
    _, whole, pieces = feeds
    one = result(run(whole(), shared_dir(spark, "one")))
    many = result(run(pieces(), shared_dir(spark, "many")))
    assert one and one == many


def test_stale_tasks_equal_replay(spark, feeds):
    data, _, pieces = feeds
    got = result(ss.stream_stale_tasks(pieces(), shared_dir(spark, "stale"), claim_seconds=120, running_seconds=90))
    want, state = [], {}
    mark = max(r[1] for r in data) - dt.timedelta(minutes=10)
    limit = {"claimed": dt.timedelta(seconds=120), "active": dt.timedelta(seconds=90)}
    label = {"claimed": "stale_claim", "active": "stale_running"}
    for r in data:
        key, now, kind = (r[2], r[3], r[6]), r[1], r[7]
        if key in state and state[key][1] <= now:
            phase, due = state.pop(key)
            want.append((*key, label[phase], due))
        if kind == "claim":
            state[key] = ("claimed", now + limit["claimed"])
        elif kind == "activate" or (kind == "progress" and key in state and state[key][0] == "active"):
            state[key] = ("active", now + limit["active"])
        elif kind == "done":
            state.pop(key, None)
    want += [(*k, label[p], due) for k, (p, due) in state.items() if due <= mark]
    assert got == sorted(want)


def test_progress_before_activation_creates_nothing(spark):
    path = shared_dir(spark, "in")
    row = (1, T0, 1, 1, 1, "w", "t", "progress", "RUNNING", 0, "", "save")
    late = (2, T0 + dt.timedelta(days=1), 9, 9, 9, "w", "t", "done", "RUNNING", 0, "", "save")
    spark.createDataFrame([row, late], SCHEMA).write.parquet(path)
    events = spark.readStream.schema(SCHEMA).parquet(path)
    assert result(ss.stream_stale_tasks(events, shared_dir(spark, "out"))) == []


def test_fence_equals_replay(spark, feeds):
    data, _, pieces = feeds
    got = {r.seq: r for r in sj.stream_fenced_state(pieces(), shared_dir(spark, "fence"), ids_per_bucket=2).collect()}
    token, status = {}, {}
    for r in data:
        seq, key, sent, kind, told = r[0], r[4], r[6], r[7], r[8]
        held = token.get(key, "")
        claim = kind == "claim" and sent != ""
        ok = claim or not held or not sent or sent == held
        token[key] = sent if claim or not held else held
        if ok:
            status[key] = told
        assert (got[seq].accepted, got[seq].run_token, got[seq].status) == (ok, token[key], status.get(key, "PENDING"))


def test_counters_equal_batch(spark, feeds):
    data, whole, pieces = feeds
    events = spark.createDataFrame(data, SCHEMA)
    batch = ledger.transition_deltas(ledger.transitions(events))
    want = {r.job_id: (r.pending_delta, r.running_delta, r.success_delta, r.failed_delta) for r in batch.collect()}
    got = {
        r.job_id: (r.pending_delta, r.running_delta, r.success_delta, r.failed_delta)
        for r in sj.stream_job_counters(pieces(), shared_dir(spark, "counters")).collect()
    }
    assert got == want


def test_upsert_equals_batch_merge(spark, feeds):
    data, _, pieces = feeds
    base = spark.range(1, 7).select(
        "id", (F.col("id") % 2 + 1).alias("job_id"), F.lit("s").alias("src"), F.lit(1).cast("long").alias("size"),
        F.when(F.col("id") < 3, "a").otherwise("").alias("run_token"), F.lit("PENDING").alias("status"), F.lit("").alias("error_message"),
        F.lit("").alias("worker_id"), *[F.lit(None).cast("timestamp").alias(c) for c in ("started_at", "completed_at", "created_at", "updated_at")],
    )
    path, stage = shared_dir(spark, "ledger"), shared_dir(spark, "stage")
    sinks.write_ledger(base, path, ids_per_bucket=2)
    sj.stream_upsert(pieces(), path, stage, ids_per_bucket=2)
    want, _ = merges.merge_fenced(base, spark.createDataFrame(data, SCHEMA))
    got = changes.read_rows(spark, path).select(*base.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


LISTING = "job_id long, pos long, key string, size long"


def listing(spark, pages):
    path = shared_dir(spark, "listing")
    for page in pages:
        spark.createDataFrame(page, LISTING).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(path)


def test_objects_once_across_rescans(spark):
    pages = [[(1, 0, "a", 1), (1, 1, "b", 2)], [(1, 2, "a", 9), (1, 3, "c", 3), (2, 4, "a", 4)], [(1, 5, "c", 5), (2, 6, "d", 6)]]
    got = sj.stream_new_objects(listing(spark, pages), shared_dir(spark, "found"))
    assert result(got.select("job_id", "id", "src", "size")) == [(1, 1, "a", 1), (1, 2, "b", 2), (1, 3, "c", 3), (2, 1, "a", 4), (2, 2, "d", 6)]


def test_pairs_complete_on_the_second_side(spark):
    pages = [
        [(1, 0, "x_video.mp4", 1), (1, 1, "y_audio.m4a", 2)],
        [(1, 2, "d/x_video.mp4", 3), (1, 3, "z_video.mp4", 4)],
        [(1, 4, "x_audio.m4a", 5), (1, 5, "x_video.mp4", 6)],
        [(1, 6, "x_audio.m4a", 7), (1, 7, "y_video.mp4", 8)],
    ]
    got = ss.stream_pairs(listing(spark, pages), shared_dir(spark, "pairs"))
    assert result(got) == [(1, "x", "d/x_video.mp4", 3, "x_audio.m4a", 5), (1, "y", "y_video.mp4", 8, "y_audio.m4a", 2)]


def pages_of(rnd, keys, pages=4, size=16):
    """Listing pages with rescans: positions go on, keys come again."""
    out, pos = [], 0
    for _ in range(pages):
        page = []
        for _ in range(size):
            page.append((rnd.randrange(1, 4), pos, rnd.choice(keys), rnd.randrange(9)))
            pos += 1
        out.append(page)
    return out


def test_objects_equal_replay(spark, monkeypatch):
    """Keys that share a number are told apart, also after a compaction and in a second run."""
    monkeypatch.setattr("mediaops.streaming.run.HASHES", 3)
    monkeypatch.setattr(sj, "upsert_ledger", functools.partial(sinks.upsert_ledger, versions=3))
    pages = pages_of(random.Random(4), [f"k{n}" for n in range(25)])
    want, top, seen = [], {}, set()
    for job, pos, key, size in (row for page in pages for row in page):
        if (job, key) not in seen:
            seen.add((job, key))
            top[job] = top.get(job, 0) + 1
            want.append((job, top[job], key, size, pos, "PENDING"))
    path, feed = shared_dir(spark, "found"), shared_dir(spark, "listing")
    for part in (pages[:3], pages[3:]):
        for page in part:
            spark.createDataFrame(page, LISTING).coalesce(1).write.mode("append").parquet(feed)
        got = sj.stream_new_objects(spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(feed), path)
    assert result(got) == sorted(want)


def test_a_batch_opens_its_own_ranges(spark, monkeypatch):
    """The folders of other jobs' keys are not read, and a rescan adds no rows to the keys seen."""
    opened, plain = [], changes.read_rows

    def noted(spark, path, schema=None, before=None, buckets=None, keep_bucket=False):
        opened.append(sorted(buckets))
        return plain(spark, path, schema, before, buckets, keep_bucket)

    monkeypatch.setattr(changes, "read_rows", noted)
    pages = [[(1, n, f"k{n}", 1) for n in range(40)], [(2, 40, "k1", 1)], [(1, 41, "k7", 1)]]
    path = shared_dir(spark, "found")
    got = sj.stream_new_objects(listing(spark, pages), path)
    assert got.count() == 41
    assert len(opened[0]) > 10 and len(opened[1]) == len(opened[2]) == 1
    assert spark.read.parquet(f"{path}/known-changes/version=3").count() == 0


def test_pairs_equal_replay(spark, monkeypatch):
    monkeypatch.setattr("mediaops.streaming.run.HASHES", 3)
    monkeypatch.setattr(ss, "upsert_ledger", functools.partial(sinks.upsert_ledger, versions=3))
    pages = pages_of(random.Random(5), [f"{d}n{n}_{side}" for d in ("", "d/") for n in range(9) for side in ("video.mp4", "audio.m4a")])
    sides, done, want = {}, set(), []
    for job, _, key, size in (row for page in pages for row in page):
        name, side = key.rsplit("/", 1)[-1].split("_", 1)
        if (job, name) in done:
            continue
        held = sides.setdefault((job, name), {})
        held[side] = (key, size)
        if len(held) == 2:
            done.add((job, name))
            want.append((job, name, *held["video.mp4"], *held["audio.m4a"]))
    path, feed = shared_dir(spark, "pairs"), shared_dir(spark, "listing")
    for part in (pages[:2], pages[2:]):
        for page in part:
            spark.createDataFrame(page, LISTING).coalesce(1).write.mode("append").parquet(feed)
        got = ss.stream_pairs(spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(feed), path)
    assert want and result(got) == sorted(want)


def test_completion_monitor_equals_replay(spark, feeds):
    """Counter moves decide the status first (without an end time); the monitor ends what is still running."""
    data, _, pieces = feeds
    now = dt.datetime(2024, 2, 1)
    jobs = spark.createDataFrame(
        [(j, "RUNNING", 0, 0, 0, 0, 0, 0, T0, None, 0, T0, T0) for j in (1, 2, 3)],
        "job_id long, status string, pending_count long, running_count long, success_count long, failed_count long, success_size_bytes long, "
        "periodic_interval int, last_scan_time timestamp, end_time timestamp, duration_seconds long, start_time timestamp, created_at timestamp",
    )
    names = {"PENDING": 0, "RUNNING": 1, "COMPLETED": 2, "FAILED": 3}
    counts = {j: [0, 0, 0, 0] for j in (1, 2, 3)}
    status, ended, task = {j: "RUNNING" for j in counts}, {j: None for j in counts}, {}
    step = len(data) // FILES
    for n in range(FILES):
        delta = {}
        for r in data[n * step : (n + 1) * step]:
            job, key, new = r[2], r[4], r[8]
            old = task.get(key, "PENDING")
            task[key] = new
            if old != new:
                d = delta.setdefault(job, [0, 0, 0, 0])
                d[names[old]] -= 1
                d[names[new]] += 1
        for job, c in counts.items():
            if job in delta:
                counts[job] = c = [max(0, a + b) for a, b in zip(c, delta[job])]
                if status[job] == "PENDING" and c[1] > 0:
                    status[job] = "RUNNING"
                elif status[job] == "RUNNING" and c[0] <= 0 and c[1] <= 0:
                    status[job] = "COMPLETED"
            if status[job] == "RUNNING" and c[0] <= 0 and c[1] <= 0:
                status[job], ended[job] = "COMPLETED", now
    out = sj.stream_completion_monitor(pieces(), jobs, shared_dir(spark, "jobs"), as_of="2024-02-01 00:00:00")
    got = {
        r.job_id: (r.status, [r.pending_count, r.running_count, r.success_count, r.failed_count], r.end_time) for r in out.collect()
    }
    assert got == {j: (status[j], counts[j], ended[j]) for j in counts}
    assert got[3] == ("COMPLETED", [0, 0, 0, 0], now)


def test_completion_monitor_writes_moved_jobs(spark):
    """Jobs no batch moves are stored once; a later batch writes one row for each job it moves."""
    jobs = spark.createDataFrame(
        [(j, "RUNNING", 5, 0, 0, 0, 0, 0, T0, None, 0, T0, T0) for j in range(1, 51)],
        "job_id long, status string, pending_count long, running_count long, success_count long, failed_count long, success_size_bytes long, "
        "periodic_interval int, last_scan_time timestamp, end_time timestamp, duration_seconds long, start_time timestamp, created_at timestamp",
    )
    feed, path = shared_dir(spark, "feed"), shared_dir(spark, "path")
    for seq, job in ((1, 1), (2, 2), (3, 2)):
        row = (seq, T0, job, seq, seq, "w", "", "", "COMPLETED", 3, "", "")
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed)
    out = sj.stream_completion_monitor(events, jobs, path, as_of="2024-02-01 00:00:00")
    got = {r.job_id: (r.pending_count, r.success_count, r.success_size_bytes) for r in out.collect()}
    assert got == {j: {1: (4, 1, 3), 2: (3, 2, 6)}.get(j, (5, 0, 0)) for j in range(1, 51)}
    assert [spark.read.parquet(f"{path}/jobs-changes/version={n}").count() for n in (2, 3)] == [1, 1]
    with pytest.raises(ValueError):
        sj.stream_completion_monitor(events, jobs.withColumnRenamed("job_id", "id"), shared_dir(spark, "path"))


def in_two_runs(spark, data, run):
    """Results of a run over the first half of the files and of a second one, on the same path, over all of them."""
    feed, path = shared_dir(spark, "feed"), shared_dir(spark, "path")
    out = []
    for half in (data[: len(data) // 2], data[len(data) // 2 :]):
        spark.createDataFrame(half, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        out.append(run(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed), path))
    return out[-1]


@pytest.mark.parametrize(
    "run",
    [
        lambda e, p: ss.stream_worker_liveness(e, p),
        lambda e, p: ss.stream_stale_tasks(e, p, claim_seconds=120, running_seconds=90),
        lambda e, p: ss.stream_retry_due(e, p),
        lambda e, p: ss.stream_checkpoint_expiry(e, p, ttl_seconds=300),
        lambda e, p: sj.stream_fenced_state(e, p, ids_per_bucket=2),
        lambda e, p: sj.stream_job_counters(e, p),
    ],
    ids=["liveness", "stale", "retry_due", "expiry", "fence", "counters"],
)
def test_a_second_run_goes_on(spark, feeds, run):
    data, whole, _ = feeds
    assert result(in_two_runs(spark, data, run)) == result(run(whole(), shared_dir(spark, "once")))


def test_upsert_takes_up_new_updates(spark, feeds):
    data, _, _ = feeds
    base = spark.range(1, 7).select(
        "id", (F.col("id") % 2 + 1).alias("job_id"), F.lit("s").alias("src"), F.lit(1).cast("long").alias("size"),
        F.lit("").alias("run_token"), F.lit("PENDING").alias("status"), F.lit("").alias("error_message"),
        F.lit("").alias("worker_id"), *[F.lit(None).cast("timestamp").alias(c) for c in ("started_at", "completed_at", "created_at", "updated_at")],
    )
    path = shared_dir(spark, "ledger")
    sinks.write_ledger(base, path, ids_per_bucket=2)
    in_two_runs(spark, data, lambda e, p: sj.stream_upsert(e, path, p, ids_per_bucket=2))
    want, _ = merges.merge_fenced(base, spark.createDataFrame(data, SCHEMA))
    assert sorted(map(str, changes.read_rows(spark, path).select(*base.columns).collect())) == sorted(map(str, want.collect()))


def test_a_path_refuses_another_checkpoint(spark, feeds):
    _, whole, _ = feeds
    path = shared_dir(spark, "path")
    sj.stream_job_counters(whole(), path)
    with pytest.raises(ValueError):
        sj.stream_job_counters(whole(), path, checkpoint=shared_dir(spark, "other"))


def test_late_cancel_counts(spark):
    """Failed at 0:00, completed at 0:10, known after the watermark has passed 0:20: never due. Unknown late rows are given out."""
    def at(minutes, seq, task, status):
        return (seq, T0 + dt.timedelta(minutes=minutes), 1, task, task, "w", "", "", status, 0, "", "")

    feed, path = shared_dir(spark, "feed"), shared_dir(spark, "path")
    for part in ([at(0, 1, 1, "FAILED"), at(0, 2, 2, "FAILED")], [at(30, 9, 7, "RUNNING")], [at(10, 3, 1, "COMPLETED"), at(11, 4, 5, "FAILED")], [at(200, 10, 7, "RUNNING")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed)
    due = ss.stream_retry_due(events, path, cooldown_seconds=3600).collect()
    assert [r.task_id for r in due] == [2]
    assert [r.task_id for r in spark.read.parquet(f"{path}/late").collect()] == [5]


def test_a_cancel_ahead_of_its_order(spark):
    """A completion read one batch before the failure it follows: within the delay it still counts."""
    feed = shared_dir(spark, "feed")
    for part in ([(2, 5, "COMPLETED")], [(1, 1, "FAILED")], [(3, 300, "RUNNING")]):
        rows = [(seq, T0 + dt.timedelta(minutes=m), 1, 1, 1, "w", "", "", st, 0, "", "") for seq, m, st in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed)
    assert result(ss.stream_retry_due(events, shared_dir(spark, "due"), cooldown_seconds=3600)) == []


def test_gathered_stages(spark):
    """Directories stay few, a stop at any point loses and doubles nothing, and unfinished gatherings are not read."""
    from mediaops.sources.files import names, remove
    from mediaops.streaming import run

    path, schema = shared_dir(spark, "stages") + "/out", "n long, at timestamp"

    def rows(n):
        return spark.createDataFrame([(n, T0), (n, None)][: n % 3], schema)

    def kept():
        return sorted(r.n for r in run.read_stages(spark, path, schema).collect())

    assert kept() == []
    for n in range(20):
        if n in (6, 9):  # a gathering that stopped before its end
            spark.createDataFrame([(-1, T0)], schema).write.parquet(f"{path}-gathered/batches-{0 if n == 9 else 3}-{n - 1}")
            remove(spark, f"{path}-gathered/batches-{0 if n == 9 else 3}-{n - 1}/_SUCCESS")
            assert -1 not in kept()
        run.gather_stages(spark, path, schema, n, width=3) if n else None
        run.write_stage(rows(n), path, n)
        if n in (3, 9, 10, 18):  # the batch runs again, once with a source of its gathering still there
            if n == 18:
                rows(2).write.parquet(f"{path}/batch=2")
            run.gather_stages(spark, path, schema, n, width=3)
            run.write_stage(rows(n), path, n)
        assert kept() == [k for k in range(n + 1) for _ in range(k % 3)]
    assert sorted(names(spark, f"{path}-gathered")) == ["batches-0-8", "batches-9-17"]
    assert sorted(names(spark, path)) == ["batch=18", "batch=19"]


def test_streamed_pieces_are_the_batches(spark, tmp_path):
    """A table of several partitions of which few hold a piece's rows: each trigger still takes one piece, whole."""
    from mediaops.streaming.run import run_batches
    from workload.streams import streamed
    from workload.views import Views

    table = spark.range(400).selectExpr("id as event_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) as ts", "id % 7 as user_id", "'view' as event_type", "1.0D as value")
    table.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # one row group: the other partitions are empty
    try:
        for even in (False, True):
            seen = {}
            feed = streamed(Views(spark, str(tmp_path)), "events", even=even).events
            assert spark.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions() > 1
            run_batches(feed, lambda df, n, seen=seen: seen.update({n: sorted(r.event_id for r in df.collect())}), shared_dir(spark, "pieces"))
            assert len(seen) == 4
            assert [x for n in sorted(seen) for x in seen[n]] == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
