"""Keyed stream operators with deadlines: liveness, staleness, retries, expiry, pairs, fencing.

Each is a step over (state, batch) in column operations; ``run_armed`` carries the state along. A
deadline that passes before the key's next event takes effect first, whether both meet in one batch
or the watermark passes it between batches, so results do not depend on batch boundaries. Events of
a key are ordered by ``seq``, the sequence number their sender gives them in time order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.functions import rules
from mediaops.operators.errors import contains_any
from mediaops.operators.ordered import PART, carry_last, dealt, staged
from mediaops.sources.sinks import upsert_ledger
from mediaops.streaming.run import (
    HASHES_PER_BUCKET,
    hashed,
    read_stage,
    read_stages,
    run_armed,
    run_batches,
    write_stage,
)


def micros(c: str = "event_ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _us(seconds: int) -> int:
    return seconds * 1_000_000


def with_next(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Value of the key's next row: a carry along the reversed order."""
    rows = df if PART in df.columns else dealt(df, keys, "seq")
    reverse = rows.withColumns({"_back": -F.col("seq"), PART: -F.col(PART)})
    found = carry_last(reverse, keys, "_back", value, out).withColumn(PART, -F.col(PART)).drop("_back")
    return found if PART in df.columns else found.drop(PART)


def armed(
    rows: DataFrame, keys: list[str], ttl: Column | int, mark: Column, heard: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split rows (keys, seq, us, arm) into those whose deadline passed and those still pending.

    A row with ``arm`` sets a deadline ``us + ttl``; the key's next row cancels it unless the
    deadline came first. Without a next row the watermark decides, or any later event of the key
    in ``heard``, which may hold events that cancel nothing.
    """
    due = F.col("us") + ttl
    judged = with_next(rows, keys, F.col("us"), "_next").filter("arm")
    limit = mark
    if heard is not None:
        judged = judged.join(heard.groupBy(*keys).agg(F.max("us").alias("_heard")), keys, "left")
        limit = F.greatest(mark, F.col("_heard"))
    passed = F.when(F.col("_next").isNull(), due <= limit).otherwise(due <= F.col("_next"))
    judged = staged(judged.withColumns({"due": due, "_passed": passed}))
    pending = judged.filter("not _passed and _next is null").select(*rows.columns)
    return judged.filter("_passed").select(*rows.columns, "due"), pending


# ---- T2 -----------------------------------------------------------------------------------------

LIVENESS = "worker_id string, at timestamp, alive boolean"


def liveness_step(ttl: int):
    def step(state: DataFrame, batch: DataFrame, mark: Column):
        beats = batch.select("worker_id", "us").distinct().withColumn("held", F.lit(False))
        rows = state.withColumn("held", F.lit(True)).unionByName(beats)
        seen = carry_last(rows, ["worker_id"], "us", F.col("us"), "prev")
        gap = F.col("prev").isNotNull() & (F.col("us") - F.col("prev") >= ttl)
        fresh = seen.filter(~F.col("held") & (F.col("prev").isNull() | gap))
        last = rows.groupBy("worker_id").agg(F.max("us").alias("us"))
        gone = F.col("us") + ttl <= mark

        def out(df, us, alive):
            return df.select("worker_id", F.timestamp_micros(us).alias("at"), F.lit(alive).alias("alive"))

        output = (
            out(fresh, F.col("us"), True)
            .unionByName(out(fresh.filter("prev is not null"), F.col("prev") + ttl, False))
            .unionByName(out(last.filter(gone), F.col("us") + ttl, False))
        )
        return last.filter(~gone), output

    return step


def stream_worker_liveness(heartbeats: DataFrame, path: str, ttl_seconds: int = 120, checkpoint: str | None = None) -> DataFrame:
    """Workers going up at the first heartbeat and down two minutes after the last."""
    beats = heartbeats.select("worker_id", micros().alias("us"))
    run_armed(beats, liveness_step(_us(ttl_seconds)), "worker_id string, us long", path, checkpoint=checkpoint)
    return read_stages(heartbeats.sparkSession, f"{path}/out", LIVENESS)


# ---- T3 -----------------------------------------------------------------------------------------

RUN = ["job_id", "task_id", "run_token"]
STALE = "job_id long, task_id long, run_token string, kind string, at timestamp"


def staleness_step(claim_us: int, running_us: int):
    def step(state: DataFrame, batch: DataFrame, mark: Column):
        rows = dealt(state.unionByName(batch.select(*RUN, "seq", "us", "kind")), RUN, "seq")
        progress = F.col("kind") == "progress"
        chain = staged(carry_last(rows, RUN, "seq", F.col("us"), "_prev"))
        late = progress & (F.col("_prev").isNull() | (F.col("us") - F.col("_prev") >= running_us))
        broken = late | F.col("kind").isin("claim", "done")
        chain = carry_last(chain, RUN, "seq", F.when(broken, F.col("seq")), "_broken", strict=False)
        chain = carry_last(chain, RUN, "seq", F.when(F.col("kind") == "activate", F.col("seq")), "_active", strict=False)
        live = F.col("_active").isNotNull() & (F.coalesce("_broken", F.lit(-1)) < F.col("_active"))
        effective = staged(
            chain.filter(~progress | live)
            .withColumn("kind", F.when(progress, F.lit("activate")).otherwise(F.col("kind")))
            .select(*RUN, "seq", "us", "kind", PART)
            .withColumn("arm", F.col("kind") != "done")
        )
        limit = F.when(F.col("kind") == "claim", F.lit(claim_us)).otherwise(F.lit(running_us))
        passed, pending = armed(effective, RUN, limit, mark, heard=rows)
        output = passed.select(
            *RUN,
            F.when(F.col("kind") == "claim", "stale_claim").otherwise("stale_running").alias("kind"),
            F.timestamp_micros("due").alias("at"),
        )
        return pending.drop("arm", PART), output

    return step


def stream_stale_tasks(
    messages: DataFrame,
    path: str,
    claim_seconds: int = 20 * 60,
    running_seconds: int = 15 * 60,
    checkpoint: str | None = None,
) -> DataFrame:
    """Runs claimed but never activated for 20 minutes, or active and silent for 15.

    ``kind`` of a message: claim, activate, progress or done. Progress refreshes an active run and
    creates nothing; a message under another token belongs to another run.
    """
    rows = messages.select(*RUN, "seq", micros().alias("us"), "kind")
    schema = "job_id long, task_id long, run_token string, seq long, us long, kind string"
    run_armed(rows, staleness_step(_us(claim_seconds), _us(running_seconds)), schema, path, checkpoint=checkpoint)
    return read_stages(messages.sparkSession, f"{path}/out", STALE)


# ---- T6, T8 -------------------------------------------------------------------------------------

TASK = ["job_id", "task_id"]
DUE = "job_id long, task_id long, at timestamp"


def deadline_step(ttl: int):
    def step(state: DataFrame, batch: DataFrame, mark: Column):
        rows = state.unionByName(batch.select(*TASK, "seq", "us", "arm"))
        passed, pending = armed(rows, TASK, ttl, mark)
        # Rows newer than the watermark stay as what they are, so that an earlier one still to come meets its next row.
        recent = rows.filter(F.col("us") > mark).join(pending.select(*TASK, "seq"), [*TASK, "seq"], "left_anti")
        return pending.unionByName(recent.withColumn("arm", F.lit(False))), passed.select(*TASK, F.timestamp_micros("due").alias("at"))

    return step


def _deadlines(stream: DataFrame, arm: Column, ttl_seconds: int, path: str, checkpoint: str | None) -> DataFrame:
    rows = stream.select(*TASK, "seq", micros().alias("us"), F.coalesce(arm, F.lit(False)).alias("arm"))
    schema = "job_id long, task_id long, seq long, us long, arm boolean"
    run_armed(rows, deadline_step(_us(ttl_seconds)), schema, path, checkpoint=checkpoint)
    return read_stages(stream.sparkSession, f"{path}/out", DUE)


def stream_retry_due(events: DataFrame, path: str, cooldown_seconds: int = 60, checkpoint: str | None = None) -> DataFrame:
    """Failed tasks due for retry after the cooldown, unless their state changed meanwhile.

    Permanent failures are never scheduled; a further failure restarts the cooldown.
    """
    retryable = (F.col("status") == C.FAILED) & ~contains_any("error_message", rules.COPY_PERMANENT)
    return _deadlines(events, retryable, cooldown_seconds, path, checkpoint)


def stream_checkpoint_expiry(changes: DataFrame, path: str, ttl_seconds: int = 72 * 3600, checkpoint: str | None = None) -> DataFrame:
    """Checkpoints expiring 72 hours after their last save; a clear ends them at once."""
    return _deadlines(changes, F.col("op") == "save", ttl_seconds, path, checkpoint)


# ---- T5 -----------------------------------------------------------------------------------------

SIDE = "job_id long, pair_id string, is_video boolean, pos long, key string, size long"
PAIR = "job_id long, pair_id string, video_key string, video_size long, audio_key string, audio_size long"


def pair_sides(inventory: DataFrame) -> DataFrame:
    """Objects that are one side of a pair: job, pair name, side, position, key, size."""
    name = C.basename("key")
    is_video = F.contains(name, F.lit("_video."))
    is_audio = ~is_video & F.contains(name, F.lit("_audio."))
    tag = F.when(is_video, F.split_part(name, F.lit("_video."), F.lit(1))).when(
        is_audio, F.split_part(name, F.lit("_audio."), F.lit(1))
    )
    return inventory.select(
        "job_id", tag.alias("pair_id"), is_video.alias("is_video"), "pos", "key", "size"
    ).filter("pair_id is not null")


def complete_pairs(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs at the moment both sides are there, and the last key of each lone side."""
    keys = ["job_id", "pair_id"]
    video = F.col("is_video")
    first = sides.groupBy(*keys).agg(
        F.min(F.when(video, F.col("pos"))).alias("_v"), F.min(F.when(~video, F.col("pos"))).alias("_a")
    )
    held = sides.join(first, keys)
    both = F.col("_v").isNotNull() & F.col("_a").isNotNull()
    row = F.struct("key", "size")
    pairs = (
        held.filter(both & (F.col("pos") <= F.greatest("_v", "_a")))
        .groupBy(*keys)
        .agg(
            F.max_by(row, F.when(video, F.col("pos"))).alias("v"), F.max_by(row, F.when(~video, F.col("pos"))).alias("a")
        )
        .select(
            *keys,
            F.col("v.key").alias("video_key"),
            F.col("v.size").alias("video_size"),
            F.col("a.key").alias("audio_key"),
            F.col("a.size").alias("audio_size"),
        )
    )
    lone = (
        held.filter(~both)
        .groupBy(*keys, "is_video")
        .agg(F.max("pos").alias("pos"), F.max_by(row, "pos").alias("r"))
        .select(*keys, "is_video", "pos", "r.key", "r.size")
    )
    return pairs, lone


def stream_pairs(
    inventory: DataFrame, path: str, hashes_per_bucket: int = HASHES_PER_BUCKET, checkpoint: str | None = None
) -> DataFrame:
    """A pair as soon as its second side arrives in any later listing page (T5).

    The later key wins per side until the pair completes; the first completion stands. Lone sides and the
    names of finished pairs are kept by job and hash range: a batch opens the ranges of its own names and
    writes the names it changes, however many were finished before.
    """
    spark = inventory.sparkSession
    path = path.rstrip("/")
    name = ["job_id", "pair_id"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        def open_sides(current: DataFrame, rows: DataFrame) -> DataFrame:
            done = current.filter("done").select(*name)
            return current.filter("not done").drop("done").unionByName(rows).join(done, name, "left_anti")

        def complete(current: DataFrame, rows: DataFrame) -> None:
            write_stage(complete_pairs(open_sides(current, rows))[0], f"{path}/out", batch_id, lasting=True)

        def advance(current: DataFrame, rows: DataFrame) -> DataFrame:
            sides = open_sides(current, rows)
            ended = read_stage(spark, f"{path}/out", batch_id, PAIR).select(*name).withColumn("done", F.lit(True))
            lone = complete_pairs(sides)[1].withColumn("done", F.lit(False))
            # other finished names with the number of an open one are written with it
            beside = current.filter("done").join(sides.select("job_id", "id").distinct(), ["job_id", "id"], "left_semi")
            changed = lone.unionByName(ended, allowMissingColumns=True).withColumn("id", hashed("pair_id"))
            return changed.unionByName(beside)

        upsert_ledger(
            batch.withColumn("id", hashed("pair_id")),
            f"{path}/sides",
            advance,
            f"{path}/stage/batch={batch_id}",
            hashes_per_bucket,
            schema=SIDE + ", id long, done boolean",
            before=complete,
            removes=False,
        )

    run_batches(pair_sides(inventory), handle, path, checkpoint)
    return read_stages(spark, f"{path}/out", PAIR)


# ---- T7 -----------------------------------------------------------------------------------------

KEY = ["job_id", "id"]
TOKENS = "job_id long, id long, run_token string, status string"
ANSWER = "job_id long, id long, seq long, accepted boolean, sent_token string, run_token string, status string"


def judge_messages(state: DataFrame, messages: DataFrame) -> DataFrame:
    """Answer to each message under the run-token fence.

    In force is the token of the last claim, else the one the task holds, else the first token an
    update brought. Updates under another token are rejected. The status is that of the last
    accepted message.
    """
    sent = F.coalesce("run_token", F.lit(""))
    rows = messages.select(
        *KEY,
        "seq",
        sent.alias("sent_token"),
        ((F.col("kind") == "claim") & (sent != "")).alias("claim"),
        C.present("status").alias("told"),
    )
    held = state.select(*KEY, F.col("run_token").alias("_held"), F.col("status").alias("_status"))
    brought = F.when((F.col("sent_token") != "") & ~F.col("claim"), F.col("seq"))
    first = rows.groupBy(*KEY).agg(F.min_by("sent_token", brought).alias("_first"), F.min(brought).alias("_since"))
    rows = dealt(rows, KEY, "seq")
    claimed = carry_last(rows, KEY, "seq", F.when(F.col("claim"), F.col("sent_token")), "_claimed")
    force = F.coalesce(
        F.col("_claimed"), C.present("_held"), F.when(F.col("_since") < F.col("seq"), F.col("_first")), F.lit("")
    )
    fits = F.col("claim") | (F.col("sent_token") == "") | (F.col("_force") == "") | (F.col("sent_token") == F.col("_force"))
    judged = (
        claimed.join(held, KEY, "left")
        .join(first, KEY)
        .withColumn("_force", force)
        .withColumn("accepted", fits)
        .withColumn(
            "run_token",
            F.when(F.col("claim") | (F.col("_force") == ""), F.col("sent_token")).otherwise(F.col("_force")),
        )
    )
    told = F.when(F.col("accepted"), F.col("told"))
    return carry_last(judged, KEY, "seq", told, "_told", strict=False).select(
        *KEY,
        "seq",
        "accepted",
        "sent_token",
        "run_token",
        F.coalesce("_told", "_status", F.lit(C.PENDING)).alias("status"),
    )
