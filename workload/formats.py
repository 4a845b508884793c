"""Queries over media formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaops.operators import formats
from workload.registry import query

GOOD = """url like 'https://%' and contains(url, 'googlevideo.com') and not contains(url, '.m3u8')"""
CLASS = """case when vcodec <> 'none' and acodec <> 'none' then 'mixed' when vcodec <> 'none' then 'video'
  when acodec <> 'none' then 'audio' else 'other' end"""
BASE = f"select *, coalesce(height, 0) as h, {CLASS} as class, {GOOD} as good from v_formats"
TIERS = {
    "highest_quality": "1",
    "hd_priority": "case when h = 1080 then 4 when h = 720 then 3 when h > 1080 then 2 when h >= 720 then 1 end",
    "ultra_priority": "case when h > 1080 then 3 when h = 1080 then 2 else 1 end",
    "min_1080p": "case when h >= 1080 then -h end",
}
ONE = """select v.video_id, '{name}' as strategy, p.format_id, p.height, p.filesize, p.url, p.video_id is null as failed
  from (select distinct video_id from v_formats) v left join (
    select * from (select *, row_number() over (partition by video_id order by tier desc, pos desc) as rn
      from (select *, {tier} as tier from b where class = 'video' and good) where tier is not null) where rn = 1) p
  on p.video_id = v.video_id"""


@query(
    "w5_pick_video",
    f"with b as ({BASE}) " + " union all ".join(ONE.format(name=n, tier=t) for n, t in TIERS.items()),
)
def _(v):
    return formats.pick_video(v.formats)


@query("w5_pick_video_hd", f"with b as ({BASE}) " + ONE.format(name="hd_priority", tier=TIERS["hd_priority"]))
def _(v):
    return formats.pick_video(v.formats, "hd_priority")


@query(
    "w6_pick_audio",
    f"""select video_id, format_id, language, abr, filesize, url from (select *, row_number() over (partition by video_id
      order by coalesce(language, '') = 'en' desc, pos desc) as rn from ({BASE}) where class = 'audio' and good) where rn = 1""",
)
def _(v):
    return formats.pick_audio(v.formats)


@query(
    "w7_pick_mixed",
    f"""with b as ({BASE}) select video_id, format_id, height, filesize, url from (
      select *, row_number() over (partition by video_id order by format_id = '18' desc, pos desc) as rn from b
      where class = 'mixed' and good) where rn = 1 and video_id not in (
        select video_id from b where good and class in ('audio', 'video'))""",
)
def _(v):
    return formats.pick_mixed(v.formats)


@query(
    "w8_rank_formats",
    f"""select video_id, class, format_id, pos, rank() over (partition by video_id, class
      order by h desc, coalesce(abr, 0) desc) as rank from ({BASE}) where url <> ''""",
)
def _(v):
    return formats.rank_formats(v.formats).select("video_id", "class", "format_id", "pos", "rank")


LABEL = """case when coalesce(h, 0) = 0 or coalesce(w, 0) = 0 then 'Unknown' when h >= 4320 then '8K' when h >= 2160 then '4K'
  when h >= 1440 then '1440p' when h >= 1080 then '1080p' when h >= 720 then '720p' when h >= 480 then '480p' when h >= 360 then '360p'
  when h >= 240 then '240p' else '144p' end"""


@query(
    "a18_format_report",
    f"""with b as ({BASE}), r as (select video_id, count(*) filter (class = 'audio') as audio_formats,
        count(*) filter (class = 'video') as video_formats, count(*) filter (class = 'mixed') as mixed_formats,
        coalesce(array_to_string(list_sort(list(distinct h) filter (class = 'video' and good)), ','), '') as heights,
        coalesce(max(h) filter (class = 'video' and good), 0) as max_height,
        count(*) filter (class = 'video' and good and h >= 1080) as at_least_1080, sum(coalesce(filesize, 0))::bigint as bytes from b group by 1),
      t as (select video_id, height as h, width as w from (select *, row_number() over (partition by video_id order by h desc, pos desc) as rn
        from b where class = 'video' and good) where rn = 1)
    select r.*, {LABEL} as label, round(bytes / 1048576.0, 2) as size_mb from r left join t on t.video_id = r.video_id""",
)
def _(v):
    return formats.format_report(v.formats).withColumn("heights", F.array_join(F.col("heights").cast("array<string>"), ","))
