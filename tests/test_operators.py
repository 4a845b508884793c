"""Operators on small cases: reports, errors, retries, parts, pools, formats, intake, storage."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mediaops.operators import errors, formats, intake, ledger, parts, reconcile
from mediaops.operators import inventory as inv
from mediaops.plans import reports
from mediaops.session import shared_dir
from mediaops.sources import changes, readers, sinks
from mediaops.sources.files import remove

MIB = 1 << 20


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_permanent_failures(spark):
    rows = [
        (1, "FAILED", "SourceNotFound: x"), (2, "FAILED", "Source fetch returned 404"), (3, "FAILED", "ZeroSizeDisabled: y"),
        (4, "FAILED", "source fetch returned 502"), (5, "FAILED", ""), (6, "COMPLETED", ""), (7, "FAILED", None),
    ]
    df = spark.createDataFrame(rows, "id long, status string, error_message string")
    assert sorted(r.id for r in intake.retryable_tasks(df, "copy").collect()) == [4, 5, 7]
    assert sorted(r.id for r in intake.retryable_tasks(df, "merge").collect()) == [1, 2, 3, 4, 5, 7]


def test_bot_check_spellings(spark):
    rows = [(1, "Sign in to confirm you’re not a bot"), (2, "Sign in to confirm you're not a bot"), (3, "other")]
    df = spark.createDataFrame(rows, "id long, error_message string").withColumns(
        {"status": F.lit("FAILED"), "is_download_fail": F.lit(False)}
    )
    assert sorted(r.id for r in intake.retryable_tasks(df, "download").collect()) == [1, 2]
    assert sorted(r.id for r in intake.retryable_tasks(df, "bulk").collect()) == [3]


@pytest.mark.parametrize(
    "status,body,retryable",
    [
        (429, "", True),
        (502, "bad gateway", True),
        (403, "forbidden", False),
        (500, "missing required environment variables", False),
        (500, "NoSuchUpload", False),
        (502, '{"error":{"code":"X","stage":"s","message":"m","retryable":true}}', True),
        (502, '{"error":{"code":"X","stage":"s","message":"m","retryable":false}}', False),
        (502, '{"error":{"code":"AccessDenied","stage":"s","message":"m","retryable":true}}', False),
    ],
)
def test_response_classes(spark, status, body, retryable):
    df = spark.createDataFrame([(status, body)], "s int, b string")
    assert df.select(errors.response_retryable("b", "s")).first()[0] is retryable


def test_list_parts_errors(spark):
    rows = [("context deadline exceeded", True), ("StatusCode: 503, x", True), ("read: connection reset by peer", True), ("StatusCode: 403", False)]
    df = spark.createDataFrame(rows, "m string, want boolean")
    assert all(r[0] == r[1] for r in df.select(errors.list_parts_retryable("m"), "want").collect())


def test_extra_rules_come_before_the_tables(spark):
    df = spark.createDataFrame([("quota exceeded", 500, "dest_put")], "error_message string, status_code int, stage string")
    r = errors.classify_errors(df, extra_rules=[("quota", "Quota", False)]).first()
    assert (r.error_class, r.retryable) == ("Quota", False)


@pytest.mark.parametrize("backlog,cap", [(10, 384), (0, 512)])
def test_default_cap(spark, backlog, cap):
    df = spark.range(1).select(reconcile.default_cap(F.lit(512), F.lit(128), F.lit(backlog)))
    assert df.first()[0] == cap


@pytest.mark.parametrize("default,resume,free_default,free_resume", [(384, 0, 0, 128), (250, 200, 62, 62), (300, 212, 0, 0)])
def test_pool_load(spark, default, resume, free_default, free_resume):
    rows = [("default", 1, n, "t") for n in range(default)] + [("resume", 2, n, "t") for n in range(resume)]
    busy = spark.createDataFrame(rows, "pool string, job_id long, task_id long, run_token string")
    idx = spark.createDataFrame([(9, 9, dt.datetime(2024, 1, 2)), (9, 8, dt.datetime(2023, 1, 1))], "job_id long, task_id long, expires_at timestamp")
    r = reconcile.pool_load(busy, idx, "2024-01-01 00:00:00", 512, 128).first()
    assert (r.resume_backlog, r.default_cap, r.default_free, r.resume_free) == (1, 384, free_default, free_resume)


@pytest.mark.parametrize("offset,task,new", [(130999, 127244, 127243), (6000, 127244, 6000), (5, 0, 0)])
def test_rewind(spark, offset, task, new):
    resets = spark.createDataFrame([(1, task), (1, task + 5)], "job_id long, id long")
    offsets = spark.createDataFrame([(1, offset)], "job_id long, read_offset long")
    assert reconcile.retry_rewind(resets, offsets).first().new_offset == new
    assert reconcile.retry_rewind(resets, offsets, sharded=False).first().new_offset == 0


def checkpoint(spark, **change):
    size = 64 * MIB
    base = dict(job_id=1, task_id=2, upload_id="u", size=size, dst_bucket="bkt", dst_key="backup/a.bin", part_size=5 * MIB,
                num_parts=13, src_identity=f"src/a.bin|{size}")
    base.update(change)
    return spark.createDataFrame([tuple(base.values())], "job_id long, task_id long, upload_id string, size long, dst_bucket string, "
                                 "dst_key string, part_size long, num_parts long, src_identity string")


@pytest.mark.parametrize(
    "change,reason",
    [({}, "ok"), ({"part_size": 5 * MIB + 1}, "part_size"), ({"dst_key": "x"}, "key"), ({"upload_id": " "}, "no_checkpoint"),
     ({"size": 1}, "size"), ({"dst_bucket": "y"}, "bucket"), ({"num_parts": 12}, "num_parts"), ({"src_identity": "z"}, "identity")],
)
def test_resume(spark, change, reason):
    tasks = spark.createDataFrame([(1, 2, "src/a.bin", 64 * MIB)], "job_id long, id long, src string, size long")
    jobs = spark.createDataFrame([(1, 5, "src", "backup")], "job_id long, metadata_id long, src_dir string, dst_dir string")
    meta = spark.createDataFrame([(5, "s3://bkt.host.example.com")], "id long, endpoint string")
    r = parts.resume_eligible(tasks, jobs, meta, checkpoint(spark, **change), check_identity=True).first()
    assert (r.reason, r.pool) == (reason, "resume" if reason == "ok" else "default")


@pytest.mark.parametrize("policy,kw", [("threshold", {}), ("threshold", {"max_parts": 3}), ("fixed", {}), ("aligned", {"max_parts": 4})])
def test_parts_tile_the_object(spark, policy, kw):
    sizes = [1, 5 * MIB, 8 * MIB - 1, 8 * MIB, 64 * MIB + 1, 100 * MIB, 333 * MIB + 7]
    df = spark.createDataFrame([(n,) for n in sizes], "size long")
    got = parts.plan_parts(df, policy, **kw).groupBy("size").agg(
        F.sum("part_bytes").alias("b"), F.min("first_byte").alias("lo"), F.max("last_byte").alias("hi"),
        F.count(F.lit(1)).alias("n"), F.max("num_parts").alias("want"), F.sum(F.col("first_byte")).alias("f"), F.sum("last_byte").alias("l"),
    )
    for r in got.collect():
        assert (r.b, r.lo, r.hi, r.n) == (r["size"], 0, r["size"] - 1, r.want)
        assert r.l - r.f == r["size"] - r.n


def test_part_edges(spark):
    df = spark.createDataFrame([(0,), (-1,), (None,)], "size long")
    got = {r["size"]: r for r in parts.plan_parts(df).collect()}
    assert (got[0].part_number, got[0].part_bytes, got[0].error) == (-1, 0, None)
    assert got[-1].error and got[None].error
    assert {r["size"]: r.error is None for r in parts.plan_parts(df, "fixed").collect()} == {0: False, -1: False, None: False}
    big = spark.createDataFrame([(10_000 * 5 * MIB * 2 + 1,)], "size long")
    assert parts.plan_parts(big).filter("over_limit").count() == 10_001


def test_upload_verdicts(spark):
    objects = spark.createDataFrame([("a", 2, 10), ("b", 2, 10), ("c", 2, 10), ("d", 2, 10)], "upload_id string, num_parts long, size long")
    rows = [("a", 1, "x", 6), ("a", 2, "x", 4), ("b", 1, "x", 6), ("b", 2, '""', 4), ("c", 2, "x", 6), ("c", 3, "x", 4), ("d", 1, "x", 6), ("d", 2, "x", 5)]
    up = spark.createDataFrame(rows, "upload_id string, part_number long, etag string, size long")
    got = {r.upload_id: r.verdict for r in parts.verify_parts(up, objects).collect()}
    assert got == {"a": "ok", "b": "incomplete", "c": "gap", "d": "size_mismatch"}
    state = {r.upload_id: (r.missing, r.complete) for r in parts.upload_state(objects, up).collect()}
    assert state == {"a": (0, True), "b": (1, False), "c": (1, False), "d": (0, True)}


def test_url_forms(spark):
    lines = ["https://www.youtube.com/watch?v=abcdefghijk", "youtu.be/abcdefghijk?t=1", "HTTP://M.YOUTUBE.COM/watch?v=abcdefghijk&x=1",
             "youtube.com/embed/abcdefghijk", "abcdefghijk", "https://youtu.be/short", "https://vimeo.com/1"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "submission string, line_no long, line string")
    got = [r.kind for r in intake.validate_urls(intake.split_candidates(df)).orderBy("line_no").collect()]
    assert got == ["url", "url", "url", "url", "id", "bad", "bad"]


def test_status_machine_uses_old_counts(spark):
    jobs = spark.createDataFrame(
        [(1, "PENDING", 2, 0, 0, 0, 0), (2, "RUNNING", 0, 1, 0, 0, 0), (3, "RUNNING", 1, 0, 0, 0, 0), (4, "PENDING", 0, 0, 0, 0, 0)],
        "job_id long, status string, pending_count long, running_count long, success_count long, failed_count long, success_size_bytes long",
    )
    deltas = spark.createDataFrame([(1, -1, 1, 0, 0), (2, 0, -3, 1, 0), (3, 0, 0, 0, 0)], "job_id long, pending_delta long, running_delta long, success_delta long, failed_delta long")
    got = {r.job_id: (r.status, r.running_count) for r in ledger.apply_deltas(jobs, deltas).collect()}
    assert got == {1: ("RUNNING", 1), 2: ("COMPLETED", 0), 3: ("RUNNING", 0), 4: ("PENDING", 0)}


def fmt(video, pos, height, **kw):
    base = dict(format_id=f"f{pos}", vcodec="avc1", acodec="none", height=height, width=1, abr=0.0, language=None, filesize=1,
                url="https://r1.googlevideo.com/x")
    base.update(kw)
    return (video, pos, *base.values())


FORMAT = "video_id string, pos long, format_id string, vcodec string, acodec string, height int, width int, abr double, language string, filesize long, url string"


@pytest.mark.parametrize(
    "heights,picks",
    [
        ([360, 1080, 720, 2160, 1080], {"highest_quality": 5, "hd_priority": 5, "ultra_priority": 4, "min_1080p": 5}),
        ([720, 1440, 2160], {"highest_quality": 3, "hd_priority": 1, "ultra_priority": 3, "min_1080p": 2}),
        ([360, 480, None], {"highest_quality": 3, "hd_priority": None, "ultra_priority": 3, "min_1080p": None}),
        ([900, 1440], {"highest_quality": 2, "hd_priority": 2, "ultra_priority": 2, "min_1080p": 2}),
    ],
)
def test_video_strategies(spark, heights, picks):
    df = spark.createDataFrame([fmt("v", i, h) for i, h in enumerate(heights, 1)] + [fmt("v", 9, 4320, url="https://x/y.m3u8")], FORMAT)
    got = {r.strategy: int(r.format_id[1:]) if r.format_id else None for r in formats.pick_video(df).collect()}
    assert got == picks


def test_audio_and_mixed(spark):
    sound = dict(vcodec="none", acodec="mp4a")
    both = dict(acodec="mp4a")
    df = spark.createDataFrame(
        [fmt("a", 1, 0, **sound, language="en"), fmt("a", 2, 0, **sound), fmt("b", 1, 360, **both, format_id="18"), fmt("b", 2, 720, **both)], FORMAT
    )
    assert one(formats.pick_audio(df), "video_id", "format_id") == [("a", "f1")]
    assert one(formats.pick_mixed(df), "video_id", "format_id") == [("b", "18")]


def test_pairs_and_dirs(spark):
    rows = [(1, 0, "p/x_video.mp4", 1), (1, 1, "q/x_audio.m4a", 2), (1, 2, "q/x_video.mp4", 3), (1, 3, "p/y_video.mp4", 4)]
    df = spark.createDataFrame(rows, "job_id long, pos long, key string, size long")
    assert one(inv.pair_media(df), "pair_id", "video_key", "audio_size") == [("x", "q/x_video.mp4", 2)]
    assert one(inv.pair_media(df, within_dir=True), "video_key") == [("q/x_video.mp4",)]


def test_new_inputs_twice_adds_nothing(spark):
    src = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "a", 2), (1, 2, "b", 3), (2, 3, "a", 4)], "job_id long, pos long, key string, size long")
    empty = spark.createDataFrame([], "job_id long, id long, src string")
    first = inv.allocate_ids(inv.new_inputs(src, empty), empty, parts=3)
    assert sorted(one(first, "job_id", "id", "key", "size")) == [(1, 1, "a", 1), (1, 2, "b", 3), (2, 1, "a", 4)]
    known = first.select("job_id", "id", F.col("key").alias("src"))
    assert inv.new_inputs(src, known).count() == 0


def test_private_hosts(spark):
    rows = [("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("192.168.0.9", True), ("127.0.0.1", True), ("8.8.8.8", False),
            ("localhost", True), ("10.example.com", False), ("[::1]", True), ("fd00::1", True), ("300.1.1.1", False)]
    df = spark.createDataFrame(rows, "h string, want boolean")
    assert all(r[0] == r[1] for r in df.select(inv.is_private_host("h"), "want").collect())


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 0), ("d", 2)], "label string, size long")
    got = {r.label: (r.slice_start, r.slice_end) for r in reports.share_of_total(df).collect()}
    assert got == {"b": (0.0, 0.7), "d": (0.7, 0.9), "a": (0.9, 1.0), "c": (1.0, 1.0)}


def test_share_of_equal_values(spark):
    rows = [(f"l{n % 90}", 5 if n % 3 else n) for n in range(400)] + [("z", 0)]
    df = spark.createDataFrame(rows, "label string, size long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = sorted((r.size, r.label, r.slice_start, r.slice_end) for r in reports.share_of_total(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    total, upto, want = sum(s for _, s in rows), 0, []
    for label, size in sorted(rows, key=lambda r: (-r[1], r[0])):
        want.append((size, label, round(upto / total, 6), round((upto + size) / total, 6)))
        upto += size
    assert got == sorted(want)
    assert reports.share_of_total(df.limit(0)).count() == 0


def test_rate_breaches_equal_brute_force(spark):
    import random

    rnd = random.Random(1)
    times = sorted(rnd.randrange(0, 600) for _ in range(300))
    rows = [(n, "m", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s, microseconds=n)) for n, s in enumerate(times)]
    df = spark.createDataFrame(rows, "seq long, machine string, ts timestamp")
    got = {r.seq: (r.in_window, r.wait_us) for r in reports.rate_breaches(df, limit=25).collect()}
    want = {}
    us = [t * 1_000_000 + n for n, t in enumerate(times)]
    for n, now in enumerate(us):
        held = [x for x in us[:n] if x >= now - 60_000_000]
        if len(held) >= 25:
            want[n] = (len(held), 60_100_000 - (now - held[0]))
    assert want and got == want


def test_rate_breaches_of_dense_machines_and_rows_without_time(spark):
    import random

    rnd = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(n, rnd.choice(["a", "b", None]), rnd.choice([*[None] * 5, *range(40)])) for n in range(200)]
    times = [(n, m, None if x is None else t0 + dt.timedelta(seconds=5 * x)) for n, m, x in rows]
    df = spark.createDataFrame(times, "seq long, machine string, ts timestamp").repartition(3)
    want = {}
    for n, m, x in rows:
        held = [y for _, k, y in rows if k == m and (y is None if x is None else y is not None and x - 12 <= y <= x)]
        if len(held) > 5:
            want[n] = (m, len(held) - 1, None if x is None else 60_100_000 - 5_000_000 * (x - min(held)))
    got = {r.seq: (r.machine, r.in_window, r.wait_us) for r in reports.rate_breaches(df, limit=5).collect()}
    assert {k: (got.get(k), want.get(k)) for k in {*got, *want} if got.get(k) != want.get(k)} == {}
    assert any(w is None for _, _, w in want.values())


def test_http_percentile_and_buckets(spark):
    df = spark.createDataFrame([("GET", "/", 200, x / 100, x) for x in range(1, 101)], "method string, path string, status int, duration double, duration_ms long")
    r = reports.http_metrics(df).first()
    assert (r.requests, r.le_0_25, r.le_0_5, r.p95) == (100, 25, 50, 0.95)


def test_ledger_layout_and_upsert(spark):
    path, stage = shared_dir(spark, "ledger"), shared_dir(spark, "stage")
    rows = spark.range(1, 101).select("id", F.lit(1).cast("long").alias("job_id"), F.lit("PENDING").alias("status"))
    sinks.write_ledger(rows, path, ids_per_bucket=10)

    def merge(current, batch):
        new = batch.select("id", F.col("status").alias("new"))
        return current.join(new, "id", "left").withColumn("status", F.concat("status", F.coalesce("new", F.lit("")))).drop("new")

    batch = spark.createDataFrame([(1, 5, "+"), (1, 95, "+")], "job_id long, id long, status string")
    for _ in range(2):
        sinks.upsert_ledger(batch, path, merge, stage, ids_per_bucket=10)
    out = changes.read_rows(spark, path)
    assert out.count() == 100
    assert sorted(one(out.filter("status <> 'PENDING'"), "id", "status")) == [(5, "PENDING+"), (95, "PENDING+")]


def test_ledger_forgets_what_is_gone(spark):
    path = shared_dir(spark, "ledger")

    def rows(*ids):
        return spark.createDataFrame([(j, i, "x") for j, i in ids], "job_id long, id long, status string")

    sinks.write_ledger(rows((1, 1), (1, 60000), (2, 1)), path)
    assert len(set(one(spark.read.parquet(path), "bucket"))) == 3  # jobs and id ranges lie apart
    sinks.write_ledger(rows((1, 2), (1, 60000), (2, 1)), path)
    assert sorted(one(spark.read.parquet(path), "job_id", "id")) == [(1, 2), (1, 60000), (2, 1)]
    gone = rows((1, 60000))
    for _ in range(2):
        stage = shared_dir(spark, "stage")
        sinks.upsert_ledger(gone, path, lambda cur, new: cur.join(new, ["job_id", "id"], "left_anti"), stage)
        assert sorted(one(changes.read_rows(spark, path), "job_id", "id")) == [(1, 2), (2, 1)]
    sinks.compact_ledger(spark, path, shared_dir(spark, "stage"))
    assert sorted(one(spark.read.parquet(path), "job_id", "id")) == [(1, 2), (2, 1)]


def ledger_rows(spark, *rows):
    return spark.createDataFrame(rows, "job_id long, id long, status string")


def put(current, batch):
    """The batch's rows instead of the stored ones; a status of '-' removes the row."""
    kept = current.join(batch, (current.job_id.eqNullSafe(batch.job_id)) & (current.id.eqNullSafe(batch.id)), "left_anti")
    return kept.unionByName(batch.filter("status <> '-'"))


def test_upsert_keeps_rows_without_ids(spark):
    path = shared_dir(spark, "ledger")
    sinks.write_ledger(ledger_rows(spark, (1, None, "a"), (1, None, "b"), (None, 4, "c"), (2, 1, "d")), path)
    sinks.upsert_ledger(ledger_rows(spark, (2, None, "e")), path, lambda cur, new: cur.unionByName(new), shared_dir(spark, "stage"))
    want = [(1, None, "a"), (1, None, "b"), (2, None, "e"), (2, 1, "d"), (None, 4, "c")]
    assert sorted(map(str, changes.read_rows(spark, path).collect())) == sorted(map(str, ledger_rows(spark, *want).collect()))
    sinks.compact_ledger(spark, path, shared_dir(spark, "stage"), share=0)
    assert sorted(map(str, spark.read.parquet(path).drop("bucket").collect())) == sorted(map(str, ledger_rows(spark, *want).collect()))


@pytest.mark.parametrize("share", [0.0, 0.25, 9.0])
def test_compaction_changes_no_row(spark, share):
    """Random upserts, compactions between them, against a dictionary; what is written follows the batch."""
    rng, path = random.Random(int(share)), shared_dir(spark, "ledger")
    want = {(j, i): "s" for j in (1, 2) for i in range(1, 61)}
    sinks.write_ledger(ledger_rows(spark, *((*k, v) for k, v in want.items())), path, ids_per_bucket=10)
    for n in range(5):
        keys = [(rng.randint(1, 3), rng.randint(1, 70)) for _ in range(rng.randint(1, 12))]
        batch = {k: rng.choice([f"u{n}", f"w{n}", "-"]) for k in keys}
        sinks.upsert_ledger(ledger_rows(spark, *((*k, v) for k, v in batch.items())), path, put, shared_dir(spark, "stage"), ids_per_bucket=10)
        want = {k: v for k, v in {**want, **batch}.items() if v != "-"}
        newest = changes.versions(spark, path)[-1]
        assert spark.read.parquet(f"{path}-changes/version={newest}").count() <= len(batch)
        if n % 2:
            stage = shared_dir(spark, "stage")
            for _ in range(2):
                sinks.compact_ledger(spark, path, stage, share)
            assert len(changes.versions(spark, path)) == 1
        assert {(r.job_id, r.id): r.status for r in changes.read_rows(spark, path).collect()} == want
        assert changes.read_rows(spark, path).count() == len(want)
    if share == 0:
        assert {(r.job_id, r.id): r.status for r in spark.read.parquet(path).collect()} != {} and changes.versions(spark, path)


def test_upserts_compact_by_themselves(spark):
    path = shared_dir(spark, "ledger")
    sinks.write_ledger(ledger_rows(spark, *((1, i, "s") for i in range(9))), path)
    for n in range(4):
        sinks.upsert_ledger(ledger_rows(spark, (1, n, f"u{n}")), path, put, shared_dir(spark, "stage"), versions=2)
        assert len(changes.versions(spark, path)) <= 2
    assert sorted(one(changes.read_rows(spark, path), "id", "status")) == [(i, f"u{i}" if i < 4 else "s") for i in range(9)]


def test_an_interrupted_upsert_is_written_once(spark):
    """A run that fails after the merge, or before its mark, and is run again with the same stage."""
    path, stage = shared_dir(spark, "ledger"), shared_dir(spark, "stage")
    sinks.write_ledger(ledger_rows(spark, (1, 1, "s"), (1, 2, "s")), path)

    def add(current, batch):
        return current.withColumn("status", F.concat("status", F.lit("+")))

    def fails(current, batch):
        raise RuntimeError

    batch = ledger_rows(spark, (1, 1, "x"))
    with pytest.raises(RuntimeError):
        sinks.upsert_ledger(batch, path, fails, stage)
    for _ in range(3):
        sinks.upsert_ledger(batch, path, add, stage)
        remove(spark, f"{stage}/done")
    assert sorted(one(changes.read_rows(spark, path), "id", "status")) == [(1, "s+"), (2, "s")]


def test_source_failures_by_stage(spark):
    code = "<Error><Code>AccessDenied</Code></Error>"
    rows = [
        ("source_fetch", 403, code, "SourceAccessDenied", "source_fetch", False),
        ("dest_put", 403, code, "AccessDenied", "dest_put", False),
        ("source_fetch", 0, "read ended early", "FetchFailed", "source_fetch", True),
        ("dest_put", None, "write ended early", "FetchFailed", "dest_put", True),
        ("source_fetch", 0, "dial tcp: i/o timeout", "NetworkTimeout", "source_fetch", True),
        ("unknown", 0, "what", "UnhandledError", "unknown", False),
    ]
    df = spark.createDataFrame(rows, "stage string, status_code int, error_message string, c string, s string, r boolean")
    for r in errors.classify_errors(df).collect():
        assert (r.error_class, r.error_stage, r.retryable) == (r.c, r.s, r.r)


def test_manifest_line_numbers_across_splits(spark):
    path = shared_dir(spark, "manifest")
    lines = [f"line {n} " + "x" * (n % 40) for n in range(2000)]
    spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n long, line string").coalesce(1).sortWithinPartitions("n").select(
        "line"
    ).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_url_manifest(spark, path)
        assert rows.select("submission").distinct().count() == 1
        got = [(r.line_no, r.line) for r in rows.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate(lines, 1))


def test_inventory_from_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.mp4").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"1")
    got = one(readers.read_inventory(spark, str(tmp_path), prefix="a/", format="files", bucket="b"), "bucket", "key", "size")
    assert got == [("b", "a/x.mp4", 3)]


def test_files_level_by_level(spark, tmp_path):
    want = {}
    for n in range(60):
        key = "/".join(["a", f"d{n % 3}", f"e=_{n % 5}"][: n % 4]) + f"/f{n}.mp4"
        key = key.lstrip("/")
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(b"x" * n)
        want[key] = n
    for hidden in ("_SUCCESS", "a/.part", "_temp/f.mp4"):
        (tmp_path / hidden).parent.mkdir(exist_ok=True)
        (tmp_path / hidden).write_bytes(b"1")
    (tmp_path / "empty").mkdir()
    for prefix in ("", "a/", "a/d1", "a/d1/e=_2/", "f1", "none/at/all"):
        for root in (str(tmp_path), f"file://{tmp_path}/"):
            got = one(readers.read_inventory(spark, root, prefix, "files"), "key", "size")
            assert sorted(got) == sorted((k, n) for k, n in want.items() if k.startswith(prefix))
    assert readers.read_inventory(spark, str(tmp_path / "missing"), format="files").count() == 0


def test_prefix_reaches_the_scan(spark):
    path = shared_dir(spark, "inv")
    spark.createDataFrame([("b", "a/x", 1, '"AB"', None)], "bucket string, key string, size long, etag string, last_modified timestamp").write.parquet(path)
    plan = readers.read_inventory(spark, path, prefix="a/").select("key", "size")._jdf.queryExecution().toString()
    assert "StringStartsWith(key,a/)" in plan and "ReadSchema: struct<key:string,size:bigint>" in plan


def test_formats_are_stored_packed(spark, tmp_path):
    import glob

    import workload

    base = spark.conf.get("spark.checkpoint.dir")
    found = workload.QUERIES["s5_read_formats"](spark, "/root/testdata/sf0.001")
    assert found.count() == 2 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    files = glob.glob(f"{base}/formats-*/part-*")
    assert files and all(f.endswith(".json.gz") for f in files)


def test_shuffle_files_go_and_frames_are_read_again(spark):
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    df = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    first = sorted(tuple(r) for r in df.collect())
    assert first == sorted(tuple(r) for r in df.collect()) and sum(n for _, n in first) == 1000
