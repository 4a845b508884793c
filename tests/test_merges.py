"""Ordered merges held against a row-by-row replay, on random batches."""

from __future__ import annotations

import datetime as dt
import random

from mediaops.operators import ledger, merges, reconcile
from mediaops.operators.ordered import carry_last, number_rows
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
LEDGER = """id long, job_id long, src string, size long, run_token string, status string, error_message string,
    worker_id string, started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp"""
UPDATE = "seq long, event_ts timestamp, job_id long, id long, run_token string, worker_id string, status string, size long, error_message string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def make(seed):
    rnd = random.Random(seed)
    tasks = [
        dict(
            id=i, job_id=1 + i % 2, src=f"s{i}", size=rnd.choice([0, 5]), run_token=rnd.choice(["", "a"]),
            status=rnd.choice(["PENDING", "RUNNING"]), error_message="old", worker_id="w0",
            started_at=rnd.choice([None, at(-9)]), completed_at=None, created_at=at(-99), updated_at=at(-99),
        )
        for i in range(1, 9)
    ]
    updates = [
        dict(
            seq=n, event_ts=at(n), job_id=1 + i % 2, id=i, run_token=rnd.choice(["", "a", "b"]), worker_id=rnd.choice(["", "w1", "w2"]),
            status=rnd.choice(["", "PENDING", "RUNNING", "COMPLETED", "FAILED"]), size=rnd.choice([0, 7, 9]),
            error_message=rnd.choice(["", "boom"]),
        )
        for n in range(200)
        for i in [rnd.randrange(1, 11)]
    ]
    return tasks, updates


def replay_fenced(tasks, updates):
    state = {(t["job_id"], t["id"]): dict(t) for t in tasks}
    conflicts = {}
    for u in sorted(updates, key=lambda u: u["seq"]):
        key = (u["job_id"], u["id"])
        t = state.get(key)
        if t is None:
            continue
        if t["run_token"] and u["run_token"] and t["run_token"] != u["run_token"]:
            conflicts[key] = conflicts.get(key, 0) + 1
            continue
        t["run_token"] = u["run_token"] or t["run_token"]
        t["status"] = u["status"] or t["status"]
        t["size"] = u["size"] if u["size"] > 0 else t["size"]
        t["worker_id"] = u["worker_id"] or t["worker_id"]
        t["error_message"] = u["error_message"]
        t["updated_at"] = u["event_ts"]
        if t["status"] == "RUNNING" and t["started_at"] is None:
            t["started_at"] = u["event_ts"]
        if t["status"] in ("COMPLETED", "FAILED") and t["completed_at"] is None:
            t["completed_at"] = u["event_ts"]
    return state, conflicts


def test_fenced_merge_equals_replay(spark):
    for seed in range(4):
        tasks, updates = make(seed)
        names = [c.strip().split()[0] for c in LEDGER.split(",")]
        cur = spark.createDataFrame([tuple(t[n] for n in names) for t in tasks], LEDGER)
        ups = spark.createDataFrame([tuple(u.values()) for u in updates], UPDATE)
        merged, conflicts = merges.merge_fenced(cur, ups)
        want, want_conflicts = replay_fenced(tasks, updates)
        got = {(r.job_id, r.id): r.asDict() for r in merged.collect()}
        assert got == want
        assert {(r.job_id, r.id): r.conflicts for r in conflicts.collect()} == want_conflicts


def test_patch_merge_equals_replay(spark):
    tasks, updates = make(11)
    names = [c.strip().split()[0] for c in LEDGER.split(",")]
    cur = spark.createDataFrame([tuple(t[n] for n in names) for t in tasks], LEDGER)
    ups = spark.createDataFrame([tuple(u.values()) for u in updates], UPDATE)
    state = {(t["job_id"], t["id"]): dict(t) for t in tasks}
    for u in updates:
        t = state.get((u["job_id"], u["id"]))
        if t is None:
            continue
        for c in ("status", "error_message", "worker_id"):
            t[c] = u[c] or t[c]
        if u["status"] in ("RUNNING", "PENDING", "METADATA_PROCESSING"):
            t["error_message"] = ""
        if u["status"] == "RUNNING" and t["started_at"] is None:
            t["started_at"] = u["event_ts"]
        if u["status"] in ("COMPLETED", "FAILED") and t["completed_at"] is None:
            t["completed_at"] = u["event_ts"]
        t["updated_at"] = u["event_ts"]
    got = {(r.job_id, r.id): r.asDict() for r in merges.merge_patch(cur, ups).collect()}
    assert got == state


def test_conflict_leaves_row_unchanged(spark):
    row = (1, 1, "s", 5, "mine", "RUNNING", "", "w", at(0), None, at(0), at(0))
    cur = spark.createDataFrame([row], LEDGER)
    up = spark.createDataFrame([(1, at(9), 1, 1, "other", "w9", "COMPLETED", 9, "")], UPDATE)
    merged, conflicts = merges.merge_fenced(cur, up)
    assert tuple(merged.first()) == row
    assert conflicts.first().conflicts == 1


def test_reset_clears_run_fields(spark):
    cur = spark.createDataFrame([(1, 1, "s", 5, "t", "FAILED", "e", "w", at(0), at(1), at(0), at(0))], LEDGER)
    r = merges.reset_for_retry(cur, "2024-05-05 00:00:00").first()
    assert (r.status, r.error_message, r.run_token, r.worker_id, r.started_at, r.completed_at) == ("PENDING", "", "", "", None, None)
    assert r.updated_at == dt.datetime(2024, 5, 5)


def test_numbering_and_carry_over_spans(spark):
    rnd = random.Random(5)
    rows = [(k, s, rnd.choice([None, s])) for k in "ab" for s in rnd.sample(range(-50, 500), 120)]
    df = spark.createDataFrame(rows, "k string, s long, v long")
    got = number_rows(df, ["k"], "s", "n", parts=7)
    got = carry_last(got, ["k"], "s", F.col("v"), "before", parts=7)
    got = carry_last(got, ["k"], "s", F.col("v"), "upto", parts=7, strict=False)
    found = {(r.k, r.s): (r.n, r.before, r.upto) for r in got.collect()}
    for key in "ab":
        last = None
        for n, (_, s, v) in enumerate(
            sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 1
        ):
            after = v if v is not None else last
            assert found[key, s] == (n, last, after)
            last = after


def test_counters_from_moves_equal_counts(spark):
    """Counters rebuilt from transitions equal those counted from the final states."""
    rnd = random.Random(3)
    events = [
        (n, 1 + t % 3, t, rnd.choice(["PENDING", "RUNNING", "COMPLETED", "FAILED"]), 10) for n in range(300) for t in [rnd.randrange(20)]
    ]
    df = spark.createDataFrame(events, "seq long, job_id long, task_id long, status string, size long")
    moves = ledger.transitions(df, parts=5)
    deltas = {r.job_id: r for r in ledger.transition_deltas(moves).collect()}
    final = ledger.task_counts(ledger.latest_update(df))
    for r in final.collect():
        d = deltas[r.job_id]
        assert (d.running_delta, d.success_delta, d.failed_delta) == (r.running_count, r.success_count, r.failed_count)
        assert d.pending_delta == r.pending_count - r.total_count


def test_streak(spark):
    rows = [(1, 1, n, *x) for n, x in enumerate([(False, 0, 0), (True, 0, 0), (True, 0, 0), (True, 0, 1), (True, 1, 1)] + [(True, 1, 1)] * 4)]
    df = spark.createDataFrame(rows, "job_id long, task_id long, attempt long, resumed boolean, before_parts long, after_parts long")
    got = [(r.streak, r.abandon) for r in reconcile.no_progress_streak(df, parts=3).orderBy("attempt").collect()]
    assert got == [(0, False), (1, False), (2, False), (0, False), (1, False), (2, False), (3, False), (4, False), (5, True)]


def test_overwrite_moves_only_columns_that_are_read(spark):
    texts = {c: F.concat(F.lit(f"{c}-"), F.col("seq").cast("string")) for c in merges.RECORD_COLUMNS if not c.endswith("_size")}
    sizes = {c: F.col("seq") for c in merges.RECORD_COLUMNS if c.endswith("_size")}
    rows = spark.range(12).selectExpr("id % 2 + 1 as job_id", "id % 3 + 1 as id", "id as seq").withColumns({**texts, **sizes, "url": F.lit("u")})
    old = rows.where("id = 1").withColumns({"created_at": F.lit(T0), "updated_at": F.lit(T0)}).drop("seq").dropDuplicates(["job_id", "id"])
    merged = merges.merge_overwrite(old, rows, "2024-01-02 00:00:00")
    last = {(r.job_id, r.id): r.seq for r in rows.groupBy("job_id", "id").agg(F.max("seq").alias("seq")).collect()}
    assert {(r.job_id, r.id): (r.status, r.video_size) for r in merged.collect()} == {k: (f"status-{n}", n) for k, n in last.items()}
    plan = merged.select("job_id", "id", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert "video_url-" not in plan and "status-" in plan
