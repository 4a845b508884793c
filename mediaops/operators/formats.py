"""Media formats: choice of video, audio and mixed format, ranking and reports.

Choices are ``max_by`` aggregates over a sortable key: one pass, combined before the shuffle, however
many formats a video lists. A strategy is a ranking expression, so adding one is adding a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _height() -> Column:
    return F.coalesce(F.col("height"), F.lit(0))


def is_audio() -> Column:
    return (F.coalesce("vcodec", F.lit("")) == "none") & (F.coalesce("acodec", F.lit("")) != "none")


def is_video() -> Column:
    return (F.coalesce("vcodec", F.lit("")) != "none") & (F.coalesce("acodec", F.lit("")) == "none")


def is_mixed() -> Column:
    return (F.coalesce("vcodec", F.lit("")) != "none") & (F.coalesce("acodec", F.lit("")) != "none")


def usable_url(url: str = "url") -> Column:
    """Direct https media URL (fixed values: host and excluded forms)."""
    u = F.coalesce(F.col(url), F.lit(""))
    return (
        F.startswith(u, F.lit("https://"))
        & F.contains(u, F.lit("googlevideo.com"))
        & ~F.contains(u, F.lit(".m3u8"))
    )


def strategy_tier(strategy: str) -> Column:
    """Preference of a video-only format under a strategy: higher wins, null never qualifies."""
    h = _height()
    if strategy == "highest_quality":
        return F.lit(1)
    if strategy == "hd_priority":
        return F.when(h == 1080, 4).when(h == 720, 3).when(h > 1080, 2).when(h >= 720, 1)
    if strategy == "ultra_priority":
        return F.when(h > 1080, 3).when(h == 1080, 2).otherwise(1)
    if strategy == "min_1080p":
        return F.when(h >= 1080, -h)
    raise ValueError(f"unknown strategy: {strategy}")


STRATEGIES = ("highest_quality", "hd_priority", "ultra_priority", "min_1080p")


def _picked(formats: DataFrame) -> Column:
    return F.struct("format_id", "height", "abr", "language", "filesize", "url")


def pick_video(formats: DataFrame, strategy: str | None = None) -> DataFrame:
    """Best video-only format per video for each strategy, or for the one given.

    Ties go to the later listed; a missing height counts as zero. Videos without a qualifying
    format appear with ``failed`` set.
    """
    names = [strategy] if strategy else list(STRATEGIES)
    fit = is_video() & usable_url()
    aggs = []
    for name in names:
        tier = strategy_tier(name)
        key = F.when(fit & tier.isNotNull(), F.struct(tier.alias("tier"), F.col("pos").alias("pos")))
        aggs.append(F.max_by(_picked(formats), key).alias(name))
    best = formats.groupBy("video_id").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("pick")) for n in names])
    return best.select("video_id", F.inline(rows)).select(
        "video_id",
        "strategy",
        F.col("pick.format_id").alias("format_id"),
        F.col("pick.height").alias("height"),
        F.col("pick.filesize").alias("filesize"),
        F.col("pick.url").alias("url"),
        F.col("pick").isNull().alias("failed"),
    )


def pick_audio(formats: DataFrame) -> DataFrame:
    """Last-listed audio-only format with a usable URL, English preferred."""
    key = F.struct((F.coalesce("language", F.lit("")) == "en").cast("int").alias("en"), F.col("pos").alias("pos"))
    return (
        formats.filter(is_audio() & usable_url())
        .groupBy("video_id")
        .agg(F.max_by(_picked(formats), key).alias("p"))
        .select("video_id", "p.format_id", "p.language", "p.abr", "p.filesize", "p.url")
    )


def pick_mixed(formats: DataFrame, strategy: str = "highest_quality", mode: str = "both") -> DataFrame:
    """Mixed format for videos without separate audio and video (W7): ``18``, else the last listed.

    One aggregate decides both the need and the choice, instead of anti joins against W5 and W6.
    """
    tier = strategy_tier(strategy)
    sound = F.lit(mode in ("both", "audio")) & is_audio() & usable_url()
    sight = F.lit(mode in ("both", "video")) & is_video() & usable_url() & tier.isNotNull()
    key = F.struct((F.col("format_id") == "18").cast("int").alias("known"), F.col("pos").alias("pos"))
    return (
        formats.groupBy("video_id")
        .agg(
            F.bool_or(sound | sight).alias("split"),
            F.max_by(_picked(formats), F.when(is_mixed() & usable_url(), key)).alias("p"),
        )
        .filter("not split and p is not null")
        .select("video_id", "p.format_id", "p.height", "p.filesize", "p.url")
    )


def format_class() -> Column:
    return F.when(is_mixed(), "mixed").when(is_video(), "video").when(is_audio(), "audio").otherwise("other")


def rank_formats(formats: DataFrame) -> DataFrame:
    """Rank by (height, abr) descending within video and class.

    The rank of a value is one more than the rows above it, so ranks come from the counts per
    distinct (height, abr): a video with very many formats is counted before anything is ordered.
    """
    listed = formats.filter(F.coalesce("url", F.lit("")) != "").withColumns(
        {"class": format_class(), "_h": _height().cast("long"), "_a": F.coalesce("abr", F.lit(0)).cast("long")}
    )
    keys = ["video_id", "class"]
    above = Window.partitionBy(*keys).orderBy(F.desc("_h"), F.desc("_a")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        listed.groupBy(*keys, "_h", "_a")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("rank", F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1)
        .drop("_n")
    )
    return listed.join(ranks, [*keys, "_h", "_a"]).drop("_h", "_a")


# Quality label by smallest height.
QUALITY_LABELS = [
    (4320, "8K"),
    (2160, "4K"),
    (1440, "1440p"),
    (1080, "1080p"),
    (720, "720p"),
    (480, "480p"),
    (360, "360p"),
    (240, "240p"),
]


def quality_label(height="height", width="width") -> Column:
    """Label of a resolution; ``Unknown`` without width and height."""
    h, w = F.col(height), F.col(width)
    out = F.when((F.coalesce(h, F.lit(0)) == 0) | (F.coalesce(w, F.lit(0)) == 0), "Unknown")
    for least, label in QUALITY_LABELS:
        out = out.when(h >= least, label)
    return out.otherwise("144p")


def format_report(formats: DataFrame) -> DataFrame:
    """Per video: formats by class, heights of usable videos, best height and label, size."""
    kind = format_class()
    seen = is_video() & usable_url()
    best = F.max_by(F.struct("height", "width"), F.when(seen, F.struct(_height().alias("h"), F.col("pos").alias("p"))))
    return (
        formats.groupBy("video_id")
        .agg(
            *[F.count_if(kind == k).alias(f"{k}_formats") for k in ("audio", "video", "mixed")],
            F.array_sort(F.collect_set(F.when(seen, _height()))).alias("heights"),
            F.coalesce(F.max(F.when(seen, _height())), F.lit(0)).alias("max_height"),
            F.count_if(seen & (_height() >= 1080)).alias("at_least_1080"),
            best.alias("_best"),
            F.sum(F.coalesce("filesize", F.lit(0))).alias("bytes"),
        )
        .withColumns(
            {
                "label": quality_label("_best.height", "_best.width"),
                "size_mb": F.round(F.col("bytes") / (1024 * 1024), 2),
            }
        )
        .drop("_best")
    )
