"""Object listings: filter, de-duplicate, diff, pair and plan destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.functions.globs import glob_regex, glob_subject
from mediaops.operators.ordered import number_rows


def clean_listing(listing: DataFrame, prefix: str = "") -> DataFrame:
    """Objects below ``prefix``; directory markers dropped, etag unquoted and lower-cased."""
    kept = listing.filter(~F.endswith("key", F.lit("/")))
    if prefix:
        kept = kept.filter(F.startswith("key", F.lit(prefix)))
    return kept.withColumn("etag", C.clean_etag("etag")) if "etag" in listing.columns else kept


def glob_filter(inventory: DataFrame, jobs: DataFrame) -> DataFrame:
    """Objects passing their job's include and exclude globs.

    The patterns become regular expressions once per job row; the listing then joins by job, so a job's
    objects follow each other. ``regexp_instr`` keeps the last compiled pattern, where ``rlike`` would
    compile one for each object. A malformed pattern filters nothing.
    """
    rules = jobs.select(
        "job_id",
        F.col("include").alias("_include"),
        F.col("exclude").alias("_exclude"),
        glob_regex("include").alias("_include_re"),
        glob_regex("exclude").alias("_exclude_re"),
    )
    wanted = F.col("_include_re").isNull() | (F.regexp_instr(glob_subject("_include", "key"), F.col("_include_re")) > 0)
    unwanted = F.col("_exclude_re").isNotNull() & (F.regexp_instr(glob_subject("_exclude", "key"), F.col("_exclude_re")) > 0)
    return (
        inventory.filter(~F.endswith("key", F.lit("/")))
        .join(rules, "job_id")
        .filter(wanted & ~unwanted)
        .drop("_include", "_exclude", "_include_re", "_exclude_re")
    )


def destinations(jobs: DataFrame, meta: DataFrame) -> DataFrame:
    """Per job: trimmed directories, destination bucket and URL root, worked out once for all its tasks."""
    return (
        jobs.select("job_id", "metadata_id", C.trim_slashes("src_dir").alias("src_base"), C.trim_slashes("dst_dir").alias("dst_root"))
        .join(meta.select(F.col("id").alias("metadata_id"), "endpoint"), "metadata_id", "left")
        .withColumn("dst_bucket", F.coalesce(C.endpoint_bucket("endpoint"), F.lit("")))
        .withColumn("url_root", C.object_url("endpoint", "dst_bucket", F.lit("")))
        .drop("metadata_id", "endpoint")
    )


def plan_dest_keys(tasks: DataFrame, jobs: DataFrame, meta: DataFrame) -> DataFrame:
    """Destination bucket, key and URL of each task."""
    return (
        tasks.join(destinations(jobs, meta), "job_id")
        .withColumn("dst_key", C.join_key("dst_root", C.below("src_base", "src")))
        .withColumn("dst_url", F.concat("url_root", "dst_key"))
        .drop("src_base", "dst_root", "url_root")
    )


def plan_output_keys(tasks: DataFrame, as_of) -> DataFrame:
    """Output key from a name template: ``prefix``, ``template``, ``video_id``, ``title``, ``ext``."""
    return tasks.withColumn(
        "output_key",
        C.under_prefix("prefix", C.render_template("template", as_of, "video_id", "title", "ext")),
    )


# Host rules by provider guard.
PROVIDER_HOSTS = {
    ("aliyun", "aliyuncs", "oss"): ("aliyuncs.com", "internal"),
    ("ivolces", "volcengine", "volc", "tos"): ("ivolces.com", "tos-s3-"),
}


def is_private_host(host) -> Column:
    """Loopback or private-range address, or ``localhost``."""
    h = C.col(host)
    octets = F.split(h, r"\.")
    a = F.get(octets, F.lit(0)).try_cast("int")
    b = F.get(octets, F.lit(1)).try_cast("int")
    v4 = h.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$") & (
        a.isin(10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    )
    v6 = h.rlike(r"^\[?(::1|f[cd][0-9a-f:]+)\]?$")
    return (h == "localhost") | F.coalesce(v4, F.lit(False)) | v6


def endpoint_policy(
    jobs: DataFrame,
    meta: DataFrame,
    keywords: list[str] | None = None,
    require_private: bool = True,
    provider: str = "",
    zone: str = "",
) -> DataFrame:
    """Jobs with ``allowed`` and ``reason``: private or keyword endpoint, zone and provider rule (P5)."""
    host = F.coalesce(C.endpoint_host("endpoint"), F.lit(""))
    words = F.array(*[F.lit(k.lower()) for k in (keywords or [])]).cast("array<string>")
    near = is_private_host("_host") | F.exists(words, lambda k: F.contains(F.col("_host"), k))
    needed = next((v for names, v in PROVIDER_HOSTS.items() if provider.lower() in names), ())
    fits = F.lit(True)
    for piece in needed:
        fits = fits & F.contains(F.col("_host"), F.lit(piece))
    in_zone = F.contains(F.coalesce("endpoint", F.lit("")), F.lit(zone))
    reason = F.when(F.col("_host") == "", F.lit("no_host")).when(~in_zone, F.lit("zone"))
    if require_private:
        reason = reason.when(~near, F.lit("not_private"))
    reason = reason.when(~fits, F.lit("provider")).otherwise(F.lit("ok"))
    return (
        jobs.join(meta.select(F.col("id").alias("metadata_id"), "endpoint"), "metadata_id", "left")
        .withColumn("_host", host)
        .withColumn("reason", reason)
        .withColumn("allowed", F.col("reason") == "ok")
        .drop("_host")
    )


def zero_size_policy(tasks: DataFrame, allow: bool = False) -> DataFrame:
    """Zero-byte objects fail unless allowed."""
    if allow:
        return tasks
    empty = F.col("size") == 0
    # Fixed value: the message carries a permanent-failure marker.
    note = "ZeroSizeDisabled: zero-byte transfer disabled by config"
    return tasks.withColumns(
        {
            "status": F.when(empty, F.lit(C.FAILED)).otherwise(F.col("status")),
            "error_message": F.when(empty, F.lit(note)).otherwise(F.col("error_message")),
        }
    )


def first_seen(inputs: DataFrame, keys=("job_id", "key"), order: str = "pos") -> DataFrame:
    """First arrival of each object (W1). ``min_by`` combines map-side, so repeated keys shuffle once."""
    rest = [c for c in inputs.columns if c not in keys]
    return (
        inputs.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_row"))
        .select(*[F.col(k) if k in keys else F.col(f"_row.{k}") for k in inputs.columns])
    )


def new_inputs(inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Objects their job has not seen: first occurrence, then anti join on (job, source key)."""
    known = ledger.select("job_id", F.col("src").alias("key"))
    return first_seen(inputs).join(known, ["job_id", "key"], "left_anti")


def allocate_ids(
    new: DataFrame,
    ledger: DataFrame,
    order: str = "pos",
    legacy_base: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Contiguous ids per job after the largest known one.

    Numbering starts at 1, or at ``job_id * 1e6`` with ``legacy_base``. It runs by (job, range of the
    listing), so one huge job is spread over many tasks.
    """
    top = ledger.groupBy("job_id").agg(F.max("id").alias("_top"))
    base = F.col("job_id") * 1_000_000 if legacy_base else F.lit(0)
    return (
        number_rows(new, ["job_id"], order, "_n", parts)
        .join(top, "job_id", "left")
        .withColumn("id", F.coalesce("_top", base) + F.col("_n"))
        .drop("_n", "_top")
    )


def added_bytes(new: DataFrame, size=("size",)) -> DataFrame:
    """Count and bytes of new tasks per job; sizes of zero or less add nothing."""
    total = sum((F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in size), F.lit(0).cast("long"))
    return new.groupBy("job_id").agg(F.count(F.lit(1)).alias("added"), F.sum(total).alias("added_bytes"))


def apply_added(jobs: DataFrame, added: DataFrame) -> DataFrame:
    """Job totals after tasks were added; a completed job runs again."""
    n, size = F.coalesce("added", F.lit(0)), F.coalesce("added_bytes", F.lit(0))
    return (
        jobs.join(added, "job_id", "left")
        .withColumns(
            {
                "status": F.when((n > 0) & (F.col("status") == C.COMPLETED), F.lit(C.RUNNING)).otherwise(
                    F.col("status")
                ),
                "total_count": F.col("total_count") + n,
                "pending_count": F.col("pending_count") + n,
                "total_size_bytes": F.col("total_size_bytes") + size,
            }
        )
        .drop("added", "added_bytes")
    )


def scan_summary(inventory: DataFrame, matched: DataFrame) -> DataFrame:
    """Objects seen, matched and skipped, matched bytes and listing pages (an estimate) per job (A10).

    Both inputs are aggregated before they meet, so the join moves one row per job.
    """
    seen = inventory.groupBy("job_id").agg(F.count(F.lit(1)).alias("seen"))
    kept = matched.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("size").alias("matched_bytes")
    )
    return (
        seen.join(kept, "job_id", "left")
        .na.fill(0, ["matched", "matched_bytes"])
        .withColumns(
            {
                "skipped": F.col("seen") - F.col("matched"),
                "pages": F.ceil(F.col("seen") / 1000).cast("long"),
            }
        )
    )


def sizes_by_type(inventory: DataFrame, url=None) -> DataFrame:
    """Objects and bytes per content type (A10 by type)."""
    kind = C.content_type(url if url is not None else F.lit(None).cast("string"), "key")
    return inventory.groupBy(kind.alias("content_type")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes")
    )


def sync_diff(src: DataFrame, dst: DataFrame, compare_etag: bool = False) -> DataFrame:
    """Source objects with ``state`` new, changed or same against the destination."""
    there = dst.select(
        "rel_key",
        F.col("size").alias("dst_size"),
        *([F.col("etag").alias("_dst_etag")] if compare_etag else []),
    )
    changed = F.col("dst_size") != F.col("size")
    if compare_etag:
        changed = changed | (C.clean_etag("_dst_etag") != C.clean_etag("etag"))
    state = F.when(F.col("dst_size").isNull(), "new").when(changed, "changed").otherwise("same")
    return src.join(there, "rel_key", "left").withColumn("state", state).drop("_dst_etag")


def sync_delete_candidates(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Source objects already at the destination with the same size."""
    return src.join(dst.select("rel_key", "size"), ["rel_key", "size"], "left_semi")


def pair_media(inventory: DataFrame, within_dir: bool = False) -> DataFrame:
    """Complete (video, audio) pairs by base name before ``_video.`` / ``_audio.``.

    One conditional aggregate per (job, name); the later key wins on each side. With ``within_dir``
    the two sides must share a directory.
    """
    name = C.basename("key")
    is_video = F.contains(name, F.lit("_video."))
    is_audio = ~is_video & F.contains(name, F.lit("_audio."))
    tag = F.when(is_video, F.split_part(name, F.lit("_video."), F.lit(1))).when(
        is_audio, F.split_part(name, F.lit("_audio."), F.lit(1))
    )
    keys = ["job_id", "pair_id"]
    sides = inventory.select(
        "job_id",
        tag.alias("pair_id"),
        is_video.alias("is_video"),
        "pos",
        "key",
        "size",
        F.regexp_extract("key", "^(.*/)?[^/]*$", 1).alias("dir"),
    ).filter("pair_id is not null")
    if within_dir:
        keys = keys + ["dir"]
    row = F.struct("key", "size")
    return (
        sides.groupBy(*keys)
        .agg(
            F.max_by(row, F.when(F.col("is_video"), F.col("pos"))).alias("v"),
            F.max_by(row, F.when(~F.col("is_video"), F.col("pos"))).alias("a"),
        )
        .filter("v is not null and a is not null")
        .select(
            "job_id",
            "pair_id",
            F.col("v.key").alias("video_key"),
            F.col("v.size").alias("video_size"),
            F.col("a.key").alias("audio_key"),
            F.col("a.size").alias("audio_size"),
        )
    )


def exclude_permanent(pairs: DataFrame, failed: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pairs whose task is not in the permanent-failure set."""
    return pairs.join(failed.select("job_id", key), ["job_id", key], "left_anti")


def required_outputs(tasks: DataFrame) -> DataFrame:
    """One row per output a download task must leave behind, by ``download_mode``."""
    mode = F.coalesce(C.present("download_mode"), F.lit("both"))
    sides = F.array_compact(
        F.array(
            F.when(mode.isin("both", "audio"), F.struct(F.lit("audio").alias("side"), F.lit("m4a").alias("ext"))),
            F.when(mode.isin("both", "video"), F.struct(F.lit("video").alias("side"), F.lit("mp4").alias("ext"))),
        )
    )
    return tasks.withColumn("_o", F.explode(sides)).select(
        "job_id",
        "id",
        F.col("_o.side").alias("side"),
        C.under_prefix(
            "prefix", F.concat("video_id", F.lit("_"), F.col("_o.side"), F.lit("."), F.col("_o.ext"))
        ).alias("key"),
    )


def skip_existing(tasks: DataFrame, inventory: DataFrame) -> DataFrame:
    """Download tasks all of whose outputs exist with a size above zero become ``COMPLETED``."""
    have = inventory.select("key", F.col("size").alias("_size"))
    done = (
        required_outputs(tasks)
        .join(have, "key", "left")
        .groupBy("job_id", "id")
        .agg(
            F.every(F.coalesce(F.col("_size") > 0, F.lit(False))).alias("_done"),
            F.coalesce(F.max(F.when(F.col("side") == "audio", F.col("_size"))), F.lit(0)).alias("audio_size"),
            F.coalesce(F.max(F.when(F.col("side") == "video", F.col("_size"))), F.lit(0)).alias("video_size"),
        )
        .filter("_done")
    )
    # Fixed value: message of a skipped task.
    note = "Skipped download: target objects already exist in R2"
    return (
        tasks.join(done, ["job_id", "id"], "left")
        .withColumns(
            {
                "status": F.when(F.col("_done"), F.lit(C.COMPLETED)).otherwise(F.col("status")),
                "error_message": F.when(F.col("_done"), F.lit(note)).otherwise(F.col("error_message")),
            }
        )
        .na.fill(0, ["audio_size", "video_size"])
        .drop("_done")
    )


def merged_outputs(pairs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Pairs with their merged output key and whether it is already there (J5 for merge jobs)."""
    have = inventory.select(F.col("key").alias("output_key"), F.col("size").alias("output_size"))
    key = F.regexp_replace(F.concat(F.rtrim("prefix", F.lit("/")), F.lit("/"), "pair_id", F.lit(".mp4")), "^/", "")
    return (
        pairs.withColumn("output_key", key)
        .join(have, "output_key", "left")
        .withColumn("exists", F.col("output_size").isNotNull())
        .na.fill(0, ["output_size"])
    )


def all_task_ids(legacy: DataFrame, sharded: DataFrame) -> DataFrame:
    """Distinct task ids over both layouts, ascending; text that is no number is left out."""
    def ids(df):
        return df.select("job_id", F.col("task_id").try_cast("long").alias("task_id")).filter("task_id is not null")

    return ids(legacy).union(ids(sharded)).distinct().orderBy("job_id", "task_id")
