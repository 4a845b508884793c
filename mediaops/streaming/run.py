"""Running streams: finite runs over what is available, per-batch stages, state between batches.

Keyed state lives in tables below the shared folder and every step is a DataFrame job: a busy key is
split like any other hot key, nothing passes through Python row by row, and a batch that is run again
after a failure starts from the state before it and rewrites its own directories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.session import shared_dir
from mediaops.sources.files import exists, names, remove

WATERMARK_SECONDS = 600
# Text keys take the place of ids in stored tables by hash; a job's lie in so many ranges.
HASHES = 1 << 40
HASHES_PER_BUCKET = HASHES // 64
# Directories of finished batches that become one.
GATHER = 16


def hashed(key: str) -> Column:
    """Number of a text key in a stored table; keys of one number share its rows, so they are compared as well."""
    return F.pmod(F.xxhash64(key), F.lit(HASHES))


def run_available(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process everything available into a stage in the shared folder and return the stage.

    The file sink commits whole batches, so a batch retried after a failure adds nothing twice.
    """
    spark = stream.sparkSession
    out = shared_dir(spark, "stage")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint or shared_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def claim(spark: SparkSession, path: str, checkpoint: str | None) -> str:
    """Checkpoint of the stream that writes below ``path``: given, or kept there.

    Stages are numbered by the checkpoint's batches, so a path that holds batches of another or a
    lost checkpoint is refused: numbers would start again and new rows pass for finished ones.
    """
    path = path.rstrip("/")
    checkpoint = (checkpoint or f"{path}/checkpoint").rstrip("/")
    begun = exists(spark, f"{checkpoint}/metadata")
    if exists(spark, f"{path}/owner/_SUCCESS"):
        owner = spark.read.text(f"{path}/owner").first()[0]
        held = set(names(spark, path)) - {"owner", "checkpoint"}
        if owner != checkpoint or held and not begun:
            raise ValueError(f"{path} holds batches of the checkpoint {owner}")
    elif begun:
        raise ValueError(f"the checkpoint {checkpoint} belongs to another path than {path}")
    else:
        spark.createDataFrame([(checkpoint,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/owner")
    return checkpoint


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], path: str, checkpoint: str | None = None) -> None:
    """Call ``handle(batch, batch_id)`` for everything new; handlers must be idempotent by id.

    A later run with the same ``path`` goes on where the last one ended.
    """
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", claim(stream.sparkSession, path, checkpoint))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_stage(df: DataFrame, path: str, batch_id: int, lasting: bool = False) -> None:
    """One directory per batch; running a batch again replaces its own directory only.

    A ``lasting`` stage is kept whole for ``read_stages``: directories of finished batches are gathered as it grows.
    """
    if lasting and batch_id:
        gather_stages(df.sparkSession, path, df.schema, batch_id)
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def read_stage(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """Stage of one batch; empty for the batch before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/batch={batch_id}")


def _spans(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Directories of gathered batches, each batch in one of them, and the first batch that isn't gathered."""
    wide: dict[int, int] = {}
    for name in names(spark, f"{path}-gathered"):
        first, last = map(int, name.removeprefix("batches-").split("-"))
        if last > wide.get(first, -1) and exists(spark, f"{path}-gathered/{name}/_SUCCESS"):
            wide[first] = last
    chosen, at = [], 0
    while at in wide:
        chosen.append(f"{path}-gathered/batches-{at}-{wide[at]}")
        at = wide[at] + 1
    return chosen, at


def _single(spark: SparkSession, path: str, at: int) -> list[str]:
    return [f"{path}/{n}" for n in names(spark, path) if n.startswith("batch=") and int(n[6:]) >= at]


def gather_stages(spark: SparkSession, path: str, schema, batch_id: int, width: int = GATHER) -> None:
    """Before batch ``batch_id``: every ``width`` batches become one directory, every ``width`` of those one again.

    A row is rewritten once for each power of ``width``, and at most ``width`` directories of each power stay. All
    batches before are finished. What was gathered goes only when its new directory is complete; readers skip what
    a stop left behind, and the repeated batch removes it.
    """
    path, span = path.rstrip("/"), 1
    while batch_id % (span * width) == 0:
        span *= width
    spans, at = _spans(spark, path)
    if span == 1 or not exists(spark, path):
        return
    if at < batch_id:
        first = min(batch_id - span, at)
        held = [s for s in spans if int(s.rsplit("-", 2)[1]) >= first] + _single(spark, path, at)
        if held:
            rows = spark.read.schema(schema).parquet(*held)
            rows.write.mode("overwrite").parquet(f"{path}-gathered/batches-{first}-{batch_id - 1}")
            spans, at = _spans(spark, path)
    kept = {s.rsplit("/", 1)[1] for s in spans}
    for name in names(spark, f"{path}-gathered"):
        if name not in kept and int(name.rsplit("-", 1)[1]) < at:
            remove(spark, f"{path}-gathered/{name}")
    for name in names(spark, path):
        if name.startswith("batch=") and int(name[6:]) < at:
            remove(spark, f"{path}/{name}")


def read_stages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches written below ``path``, those gathered included; none give no rows."""
    path = path.rstrip("/")
    spans, at = _spans(spark, path)
    found = spans + _single(spark, path, at)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


Step = Callable[[DataFrame, DataFrame, object], tuple[DataFrame, DataFrame]]


def run_armed(
    stream: DataFrame,
    step: Step,
    state_schema: str,
    path: str,
    delay_seconds: int = WATERMARK_SECONDS,
    checkpoint: str | None = None,
) -> None:
    """Run ``step(state, batch, mark) -> (state, output)`` over a stream with event time in ``us``.

    ``mark`` (a scalar column) is the watermark: the largest event time seen less the delay. Rows
    older than the mark before the batch are late: one that follows the pending event of its key is
    judged like any other, the rest, whose deadlines are decided, is given out under ``late``.
    ``path`` receives ``out`` and ``late``, gathered as they grow (``read_stages``), and ``state`` and ``mark`` of
    the last two batches. State holds pending deadlines, and for some steps the rows newer than the mark.
    """
    spark = stream.sparkSession
    path = path.rstrip("/")
    delay = delay_seconds * 1_000_000
    fields = [f.split()[0] for f in state_schema.split(", ")]
    order = "seq" if "seq" in fields else "us"
    keys = [f for f in fields if f not in ("seq", "us", "arm", "kind")]

    def handle(batch: DataFrame, batch_id: int) -> None:
        before = read_stage(spark, f"{path}/mark", batch_id - 1, "us long")
        floor = F.coalesce(before.agg(F.max("us")).scalar(), F.lit(-(1 << 62)))
        marks = before.unionByName(batch.agg((F.max("us") - delay).alias("us"))).agg(F.max("us").alias("us"))
        write_stage(marks, f"{path}/mark", batch_id)
        mark = read_stage(spark, f"{path}/mark", batch_id, "us long").agg(F.max("us")).scalar()
        state = read_stage(spark, f"{path}/state", batch_id - 1, state_schema)
        held = (state.filter("arm") if "arm" in fields else state).groupBy(*keys).agg(F.min(order).alias("_held"))
        late = batch.filter(F.col("us") < floor).join(held, keys, "left")
        after = F.coalesce(F.col(order) > F.col("_held"), F.lit(False))
        write_stage(late.filter(~after).select(*batch.columns), f"{path}/late", batch_id, lasting=True)
        on_time = batch.filter(F.col("us") >= floor).unionByName(late.filter(after).select(*batch.columns))
        new_state, output = step(state, on_time, mark)
        write_stage(output, f"{path}/out", batch_id, lasting=True)
        write_stage(new_state, f"{path}/state", batch_id)
        for table in ("state", "mark"):  # a repeated batch needs the one before it only
            remove(spark, f"{path}/{table}/batch={batch_id - 2}")

    run_batches(stream, handle, path, checkpoint)
