"""Views over the given tables, shared by the Spark queries and their SQL.

Each view is one SELECT in both dialects. ``div`` is integer division, ``@sec(x)`` an interval of x
seconds, ``@range(n)`` one row per 0..n-1; every view keeps all rows of its table (gaps for joins come from renamed keys, not from
dropped rows).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

TASK_ID = "(l_partkey * 10000 + l_suppkey) * 1000 + l_linenumber * 100 + cast(l_quantity as bigint)"

VIEWS = {
    "v_jobs": """
        select o_orderkey + 1 as job_id, o_custkey as metadata_id,
          'src/' || cast((o_orderkey + 1) % 5 as varchar(9)) as src_dir,
          case when o_orderkey % 13 = 0 then '' else '/' || lower(split_part(o_orderpriority, '-', 2)) || '/'
            || cast(o_custkey % 7 as varchar(9)) || '/x' end as dst_dir,
          case o_orderkey % 6 when 0 then '*.mp4' when 1 then '' when 2 then 'src/*/p[0-9]*[^05]?mp4'
            when 3 then '[bad' when 4 then 'p?*' else '*[24680].m*' end as include,
          case o_orderkey % 5 when 0 then '*3.m4a' when 1 then 'p1*' when 2 then 'src/?/*7.m4a' else '' end as exclude,
          o_orderkey % 4 = 1 as delete_source,
          o_orderkey % 3 <> 0 as is_incremental,
          cast(case o_orderkey % 3 when 0 then 0 when 1 then 600 else 86400 end as int) as periodic_interval,
          case when o_orderkey % 5 = 0 then null else cast(o_orderdate as timestamp) + @sec(o_orderkey % 100000) end
            as last_scan_time,
          case o_orderstatus when 'F' then 'COMPLETED' when 'P' then 'RUNNING' else 'PENDING' end as status,
          case when o_orderstatus = 'O' then null else cast(o_orderdate as timestamp) + @sec(3600) end as start_time,
          case when o_orderstatus = 'F' then cast(o_orderdate as timestamp) + @sec(7200 + o_orderkey % 977) end as end_time,
          case when o_orderstatus = 'F' then 3600 + o_orderkey % 977 else 0 end as duration_seconds,
          o_orderkey % 4 as execution_count,
          10 + o_orderkey % 90 as total_count,
          case when o_orderstatus = 'F' then 0 else o_orderkey % 4 end as pending_count,
          case when o_orderstatus = 'P' then o_orderkey % 3 else 0 end as running_count,
          10 + o_orderkey % 90 - (case when o_orderstatus = 'F' then 0 else o_orderkey % 4 end)
            - (case when o_orderstatus = 'P' then o_orderkey % 3 else 0 end)
            - (case when o_orderkey % 3 = 0 then 0 else o_orderkey % 5 end) as success_count,
          case when o_orderkey % 3 = 0 then 0 else o_orderkey % 5 end as failed_count,
          cast(floor(o_totalprice * 100) as bigint) as total_size_bytes,
          cast(floor(o_totalprice * 50) as bigint) as success_size_bytes,
          'scan ' || cast(o_orderkey % 10 as varchar(9)) as result_message,
          o_orderkey % 8 = 3 as cleaned,
          case o_orderkey % 4 when 0 then '' else 'm' || cast(o_orderkey % 4 as varchar(9)) end as machine_name,
          case o_orderkey % 4 when 0 then '' when 1 then 'audio' when 2 then 'video' else 'both' end as download_mode,
          case o_orderkey % 3 when 0 then '' when 1 then 'hd_priority' else 'min_1080p' end as video_strategy,
          cast(o_orderdate as timestamp) as created_at,
          cast(o_orderdate as timestamp) as updated_at,
          o_orderkey * 31 as scan_offset
        from {orders}
    """,
    "v_meta": """
        select case when c_custkey % 11 = 0 then c_custkey + 1000000000000 else c_custkey end as id,
          lower(c_mktsegment) || '-' || lower(n_name) as client_name,
          case c_custkey % 6
            when 0 then 's3://bkt' || cast(n_nationkey as varchar(9)) || '.oss-a-internal.aliyuncs.com'
            when 1 then 'https://store.example.com/bkt' || cast(n_nationkey as varchar(9)) || '/'
            when 2 then 'https://10.0.' || cast(n_nationkey as varchar(9)) || '.7:9000/bkt'
            when 3 then 's3://bkt' || cast(n_nationkey as varchar(9)) || '.tos-s3-a.ivolces.com'
            when 4 then 'http://localhost/bkt' || cast(n_nationkey as varchar(9))
            else 'https://172.' || cast(10 + n_nationkey as varchar(9)) || '.0.1/bkt' end as endpoint
        from {customer} join {nation} on c_nationkey = n_nationkey
    """,
    "v_tasks": f"""
        select {TASK_ID} as id, l_orderkey + 1 as job_id,
          'src/' || cast((l_orderkey + 1) % 5 as varchar(9)) || '/p' || cast((l_orderkey + 1) * 10 + l_linenumber as varchar(20))
            || case when ((l_orderkey + 1) * 10 + l_linenumber) % 2 = 0 then '.mp4' else '.m4a' end as src,
          case when l_suppkey % 50 = 7 then 0 else cast(floor(l_extendedprice * 200) as bigint) end as size,
          case when l_partkey % 5 = 0 then '' else 't' || cast(l_suppkey % 3 as varchar(9)) end as run_token,
          case when l_returnflag = 'A' and l_linestatus = 'F' then 'COMPLETED' when l_returnflag = 'A' then 'RUNNING'
            when l_returnflag = 'R' and l_linestatus = 'F' then 'FAILED' when l_returnflag = 'R' then 'PENDING'
            when l_linestatus = 'F' then 'COMPLETED' else 'RUNNING' end as status,
          case when l_returnflag = 'R' then case l_partkey % 6 when 0 then 'Source fetch returned 404 Not Found'
            when 1 then 'ZeroSizeDisabled: zero-byte transfer disabled by config' when 2 then 'dial tcp: i/o timeout'
            when 3 then 'Source fetch returned 502' when 4 then 'SourceNotFound: gone' else 'connection reset by peer' end
            else '' end as error_message,
          'w' || cast(l_suppkey % 20 as varchar(9)) as worker_id,
          case when l_returnflag = 'R' and l_linestatus = 'O' or l_linenumber = 3 then null
            else cast(l_shipdate as timestamp) + @sec(60 * l_linenumber) end as started_at,
          case when l_linestatus = 'F' then cast(l_shipdate as timestamp) + @sec(3600 * l_linenumber) end as completed_at,
          cast(l_shipdate as timestamp) as created_at,
          cast(l_shipdate as timestamp) + @sec(l_partkey % 100000) as updated_at
        from {{lineitem}}
    """,
    "v_downloads": f"""
        select {TASK_ID} as id, l_orderkey + 1 as job_id,
          'https://www.youtube.com/watch?v=' || substr(md5(cast(l_partkey as varchar(20))), 1, 11) as url,
          'Title ' || cast(l_partkey as varchar(20)) || '/part: ' || cast(l_linenumber as varchar(9)) || '!' as title,
          'v' || cast(l_orderkey * 10 + l_linenumber as varchar(20)) as video_id,
          case when l_suppkey % 4 = 0 then '' else 'https://r1.googlevideo.com/videoplayback?expire='
            || cast(1700000000 + l_partkey % 1000 as varchar(20)) || '&mime=audio%2Fmp4' end as audio_url,
          cast(floor(l_extendedprice) as bigint) as audio_size,
          case when l_suppkey % 6 = 0 then '' when l_suppkey % 6 = 1
              then 'https://acc.r2.cloudflarestorage.com/b/k?x-id=' || case when l_partkey % 2 = 0 then 'PutObject' else 'GetObject' end
            else 'https://r2.googlevideo.com/videoplayback?expire=' || cast(1700000200 + l_partkey % 777 as varchar(20)) end
            as video_url,
          cast(floor(l_extendedprice * 10) as bigint) as video_size,
          case when l_returnflag = 'A' and l_linestatus = 'F' then 'COMPLETED' when l_returnflag = 'A' then 'METADATA_FETCHED'
            when l_returnflag = 'R' and l_linestatus = 'F' then 'FAILED' when l_returnflag = 'R' then 'PENDING'
            when l_linestatus = 'F' then 'RUNNING' else 'METADATA_PROCESSING' end as status,
          l_partkey % 7 = 0 as is_download_fail,
          case when l_returnflag = 'R' then case l_partkey % 5 when 0 then 'Sign in to confirm you’re not a bot'
            when 1 then 'Private video. Sign in' when 2 then 'HTTP Error 503' when 3 then 'Video unavailable'
            else 'proxy error' end else '' end as error_message,
          'w' || cast(l_suppkey % 20 as varchar(9)) as worker_id,
          case when l_linenumber = 3 then null else cast(l_shipdate as timestamp) end as started_at,
          case when l_linestatus = 'F' then cast(l_shipdate as timestamp) + @sec(3600) end as completed_at,
          cast(l_shipdate as timestamp) as created_at, cast(l_shipdate as timestamp) as updated_at,
          'dl/' || cast(l_orderkey % 3 as varchar(9)) as prefix,
          case l_orderkey % 4 when 0 then '' when 1 then 'audio' when 2 then 'video' else 'both' end as download_mode
        from {{lineitem}}
    """,
    "v_task_json": """
        select '{"id":' || cast(id as varchar(20)) || ',"job_id":' || cast(job_id as varchar(20)) || ',"src":"' || src
          || '","size":' || cast(size as varchar(20)) || ',"run_token":"' || run_token || '","status":"' || status
          || '","error_message":"' || error_message || '","worker_id":"' || worker_id || '","started_at":"'
          || case id % 12 when 0 then day || 'T01:02:03.123456789Z' when 1 then day || 'T01:02:03Z'
            when 2 then day || 'T01:02:03.123456789' when 3 then day || 'T01:02:03.123456' when 4 then day || 'T01:02:03.123'
            when 5 then day || 'T01:02:03' when 6 then day || ' 01:02:03.123456789' when 7 then day || ' 01:02:03.123456'
            when 8 then day || ' 01:02:03.123' when 9 then day || ' 01:02:03' when 10 then '0001-01-01T00:00:00Z'
            else day || 'T03:02:03.5+02:00' end
          || '","completed_at":"","created_at":"' || day || 'T00:00:00Z","updated_at":"junk"}' as raw
        from (select *, substr(cast(created_at as varchar(30)), 1, 10) as day from {v_tasks}) t
    """,
    "v_task_events": """
        select event_id as seq, cast(ts as timestamp) as event_ts, user_id % 10 + 1 as job_id, user_id + 1 as task_id,
          case when event_id % 7 = 0 then '' else 't' || cast(event_id % 3 as varchar(9)) end as run_token,
          case when event_id % 4 = 0 then '' else 'w' || cast(user_id % 5 as varchar(9)) end as worker_id,
          case event_type when 'signup' then 'PENDING' when 'click' then 'RUNNING' when 'view' then 'METADATA_FETCHED'
            when 'purchase' then 'COMPLETED' else 'FAILED' end as status,
          cast(floor(value * 100) as bigint) as size,
          case when event_type = 'error' then 'err ' || cast(event_id % 5 as varchar(9)) else '' end as error_message,
          case when event_id % 3 = 0 then '' else 'https://r1.googlevideo.com/a?id=' || cast(event_id as varchar(20)) end as audio_url,
          case when event_id % 5 < 3 then '' else 'https://r1.googlevideo.com/v?id=' || cast(event_id as varchar(20)) end as video_url
        from {events}
    """,
    "v_event_ledger": """
        select user_id + 1 as id, user_id % 10 + 1 as job_id, 'src/u' || cast(user_id as varchar(20)) as src,
          cast(max(event_id) as bigint) as size,
          case when user_id % 3 = 0 then '' else 't' || cast(user_id % 3 as varchar(9)) end as run_token,
          case when user_id % 2 = 0 then 'PENDING' else 'RUNNING' end as status, 'old error' as error_message,
          'w0' as worker_id, case when user_id % 4 = 0 then cast(min(ts) as timestamp) end as started_at,
          cast(null as timestamp) as completed_at, cast(min(ts) as timestamp) as created_at,
          cast(min(ts) as timestamp) as updated_at, '' as audio_url, 'https://old/v' as video_url
        from {events} group by user_id
    """,
    "v_markers": """
        select case event_type when 'click' then 'claimed' when 'view' then 'last_seen' when 'error' then 'retry_due'
            when 'signup' then 'in_flight' else 'resume' end as kind,
          user_id % 10 + 1 as job_id, user_id + 1 as task_id, 't' || cast(event_id % 3 as varchar(9)) as run_token,
          case when event_id % 2 = 0 then 'default' else 'resume' end as pool,
          cast(ts as timestamp) as ts, cast(ts as timestamp) + @sec(72 * 3600) as expires_at
        from {events}
    """,
    "v_member_text": """
        select event_id, case event_id % 5 when 0 then cast(user_id as varchar(20)) || ':' || cast(event_id as varchar(20)) || ':tok:' || event_type
            when 1 then cast(user_id + 1 as varchar(20)) || ':' || cast(event_id + 1 as varchar(20)) || ':tok'
            when 2 then 'x:' || cast(event_id as varchar(20)) || ':tok' when 3 then '1:2'
            else '4:' || cast(event_id as varchar(20)) || ':' end as member
        from {events}
    """,
    "v_inv_src": """
        select job_id, pos, 'src/' || cast(job_id % 5 as varchar(9)) || '/' || name as key, name as rel_key, size, etag, last_modified from (
          select p_partkey div 10 + 1 as job_id, p_partkey * 3 as pos,
            'p' || cast((p_partkey div 10 + 1) * 10 + p_partkey % 10 as varchar(20))
              || case when p_partkey % 2 = 0 then '.mp4' else '.m4a' end as name,
            case when p_partkey % 97 = 5 then 0 else cast(floor(p_retailprice * 100) as bigint) * (1 + p_partkey % 7) end as size,
            '"' || upper(md5(cast(p_partkey as varchar(20)))) || '"' as etag, timestamp '2024-01-01 00:00:00' as last_modified
          from {part}
          union all
          select p_partkey div 10 + 1, p_partkey * 3 + 1, case when p_partkey % 10 = 0 then 'd' || cast(p_partkey as varchar(20)) || '/' else
              'p' || cast((p_partkey div 10 + 1) * 10 + (p_partkey + 1) % 10 as varchar(20))
              || case when (p_partkey + 1) % 2 = 0 then '.mp4' else '.m4a' end end, 1, '"AB"', timestamp '2024-01-02 00:00:00'
          from {part}) t
    """,
    "v_inv_dst": """
        select 'bkt' || cast(p_partkey % 3 as varchar(9)) as bucket, 'out/' || name as key, name as rel_key, size, etag from (
          select p_partkey, case when p_partkey % 3 = 0 then 'x' else 'p' end
              || cast((p_partkey div 10 + 1) * 10 + p_partkey % 10 as varchar(20))
              || case when p_partkey % 2 = 0 then '.mp4' else '.m4a' end as name,
            cast(floor(p_retailprice * 100) as bigint) * (1 + p_partkey % 7) + case when p_partkey % 5 = 0 then 7 else 0 end as size,
            md5(cast(p_partkey + case when p_partkey % 4 = 0 then 1 else 0 end as varchar(20))) as etag
          from {part}) t
    """,
    "v_dst_objects": """
        select 'bkt' || cast(l_orderkey % 3 as varchar(9)) as bucket,
          case when l_partkey % 4 = 0 then 'gone/' else 'out/' end || cast((l_orderkey + 1) * 10 + l_linenumber as varchar(20)) || '/'
            || cast(l_partkey as varchar(20)) || '/' || cast(l_suppkey as varchar(20)) || '/' || cast(cast(l_quantity as int) as varchar(9)) as key,
          cast(floor(l_extendedprice * 200) as bigint) + case when l_partkey % 5 = 0 then 1 else 0 end as size
        from {lineitem}
    """,
    "v_outputs": """
        select key, cast(max(size) as bigint) as size from (
          select 'dl/' || cast(l_orderkey % 3 as varchar(9)) || '/v' || cast(l_orderkey * 10 + l_linenumber as varchar(20))
              || case when side = 0 then '_audio.m4a' else '_video.mp4' end as key,
            case when l_partkey % 4 = 0 then 0 else cast(floor(l_extendedprice) as bigint) end as size
          from (select *, @range(2) as side from {lineitem}) t) u
        group by key
    """,
    "v_media": """
        select p_partkey div 500 + 1 as job_id, p_partkey * 2 as pos, 'p/' || cast(p_partkey div 2 as varchar(20))
            || case when p_partkey % 11 = 3 then '_other.txt' when p_partkey % 2 = 0 then '_video.mp4' else '_audio.m4a' end as key,
          cast(floor(p_retailprice) as bigint) as size, 'merged/' as prefix
        from {part}
        union all
        select p_partkey div 500 + 1, p_partkey * 2 + 1000000000, case when p_partkey % 3 = 0 then 'q/' else 'r/' end || cast(p_partkey div 7 as varchar(20))
            || case when p_partkey % 2 = 0 then '_video.webm' else '_audio.opus' end, cast(floor(p_retailprice) as bigint) + 1, 'merged/'
        from {part}
    """,
    "v_url_lines": """
        select 's' || cast(page_id div 3 as varchar(20)) as submission, page_id % 3 + 1 as line_no,
          case page_id % 9 when 0 then 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || ',youtu.be/' || substr(md5(url), 5, 11)
            when 1 then '  "' || substr(md5(url), 1, 11) || '" ; HTTPS://m.YouTube.com/watch?v=' || substr(md5(url), 2, 11) || '&t=10'
            when 2 then url || '|`youtube.com/embed/' || substr(md5(url), 3, 11) || '?rel=0`'
            when 8 then '' else 'https://youtu.be/' || substr(md5(url), 4, 11) end as line,
          page_id
        from {pages}
    """,
    "v_formats": f"""
        select 'v' || cast(l_orderkey as varchar(20)) as video_id, {TASK_ID} as pos,
          case when l_linenumber = 7 and l_partkey % 2 = 0 then '18' else 'f' || cast(l_partkey as varchar(20)) end as format_id,
          case when l_partkey % 3 = 0 then 'none' else 'avc1' end as vcodec,
          case when l_partkey % 3 = 1 then 'none' else 'mp4a' end as acodec,
          case when l_suppkey % 17 = 0 then null when l_quantity < 5 then 144 when l_quantity < 10 then 360 when l_quantity < 20 then 480
            when l_quantity < 30 then 720 when l_quantity < 40 then 1080 when l_quantity < 45 then 1440 else 2160 end as height,
          case when l_suppkey % 19 = 0 then null else 1920 end as width,
          cast(l_suppkey % 200 as double) as abr,
          case when l_partkey % 4 = 0 then 'en' when l_partkey % 4 = 1 then 'de' end as language,
          case when l_partkey % 10 = 0 then null else cast(floor(l_extendedprice * 100) as bigint) end as filesize,
          case l_suppkey % 8 when 0 then 'https://r1.googlevideo.com/x.m3u8' when 1 then 'quic://r1.googlevideo.com/x'
            when 2 then '' when 3 then 'https://other.example.com/x'
            else 'https://r1.googlevideo.com/x?i=' || cast(l_partkey as varchar(20)) end as url
        from {{lineitem}}
    """,
    "v_errors": """
        select event_id as attempt, user_id % 10 + 1 as job_id, user_id + 1 as task_id, event_id as id,
          case when event_type in ('error', 'view', 'click') then 'FAILED' else 'COMPLETED' end as status,
          case event_id % 16 when 0 then 'dial tcp: i/o timeout' when 1 then 'read: connection reset by peer'
            when 2 then '<Error><Code>SlowDown</Code><Message>reduce rate</Message></Error>'
            when 3 then '<Error><Code>NoSuchUpload</Code></Error>' when 4 then 'Source fetch returned 404 Not Found'
            when 5 then 'lookup host: ENOTFOUND' when 6 then 'unsupported protocol scheme'
            when 7 then '{"error":{"code":"DestSlowDown","stage":"dest_put","message":"slow","retryable":true}}'
            when 8 then '{"error":{"code":"AccessDenied","stage":"dest_put","message":"Access Denied","retryable":true}}'
            when 9 then 'missing required environment variables' when 10 then 'Sign in to confirm you’re not a bot'
            when 11 then 'Private video' when 12 then 'SourceNotFound' when 13 then 'HTTP Error 503'
            when 14 then 'upstream said no' else '' end as error_message,
          cast(case event_id % 8 when 0 then 500 when 1 then 404 when 2 then 429 when 3 then 403 when 4 then 408 when 5 then 503
            when 6 then 0 else 400 end as int) as status_code,
          case event_id % 3 when 0 then 'source_fetch' when 1 then 'dest_put' else 'unknown' end as stage,
          event_id % 4 = 0 as is_download_fail, 'tok' as run_token, 'w1' as worker_id, cast(ts as timestamp) as started_at,
          cast(ts as timestamp) as completed_at, cast(ts as timestamp) as updated_at
        from {events}
    """,
    "v_ckpt": """
        select job_id, id as task_id, src, case when id % 4 = 1 and id % 3 = 0 then size + 1 else size end as size,
          case when id % 9 = 4 then '' else 'u' || cast(id as varchar(20)) end as upload_id,
          case when id % 4 = 1 and id % 3 = 1 then 'other' else 'bkt' || cast(job_id % 3 as varchar(9)) end as dst_bucket,
          'out/' || cast(id as varchar(20)) as dst_key,
          case when size div 10000 < 5242880 then 5242880 else size div 10000 end + case when id % 4 = 1 and id % 3 = 2 then 1 else 0 end as part_size,
          case when size <= 0 then 1 else (size - 1) div 5242880 + 1 end as num_parts,
          src || '|' || cast(size as varchar(20)) as src_identity, run_token as last_run_token,
          created_at, updated_at
        from {v_tasks}
    """,
    "v_parts": """
        select upload_id, n + 1 as part_number, case when (task_id + n) % 6 = 0 then '' else '"e' || cast(n as varchar(20)) || '"' end as etag,
          case when task_id % 13 = 0 then 1 else 0 end + case when n + 1 = num_parts then size - n * 5242880 else 5242880 end as size
        from (select *, @range(num_parts) as n from {v_uploads}) t
    """,
    "v_uploads": """
        select job_id, id as task_id, 'u' || cast(job_id as varchar(20)) || '-' || cast(id as varchar(20)) as upload_id, size,
          case when size <= 0 then 1 else (size - 1) div 5242880 + 1 end as num_parts,
          'out/' || cast(job_id % 10 as varchar(9)) || '/' || cast(id as varchar(20)) as dst_key
        from {v_tasks}
    """,
    "v_attempts": """
        select event_id as attempt, user_id % 10 + 1 as job_id, user_id + 1 as task_id, event_type <> 'signup' as resumed,
          event_id % 50 as before_parts, event_id % 50 + case when event_type = 'purchase' then 1 else 0 end as after_parts
        from {events}
    """,
    "v_comp": f"""
        select l_orderkey + 1 as job_id, {TASK_ID} as task_id,
          case when l_suppkey % 10 = 9 then 'stale' when l_partkey % 5 = 0 then '' else 't' || cast(l_suppkey % 3 as varchar(9)) end as run_token,
          case when l_suppkey % 7 = 0 then 0 else cast(floor(l_extendedprice * 200) as bigint) end as size,
          'bkt' || cast(l_orderkey % 3 as varchar(9)) as dst_bucket,
          'out/' || cast((l_orderkey + 1) * 10 + l_linenumber as varchar(20)) || '/'
            || cast(l_partkey as varchar(20)) || '/' || cast(l_suppkey as varchar(20)) || '/' || cast(cast(l_quantity as int) as varchar(9)) as dst_key
        from {{lineitem}}
    """,
    "v_queue": """
        select 'queue:download:' || case when l_partkey % 2 = 0 then 'download_ready' else 'metadata_retry' end || ':'
            || case l_suppkey % 4 when 0 then 'all' else 'm' || cast(l_suppkey % 12 as varchar(9)) end as queue_name,
          case when l_partkey % 50 = 0 then 'bad-' || cast(l_partkey as varchar(20))
            else cast((l_orderkey + 1) * 1000000 + l_linenumber as varchar(20)) end as task_id
        from {lineitem}
    """,
    "v_machines": """
        select case when s_suppkey % 13 = 0 then '' else 'm' || cast(s_suppkey % 12 as varchar(9)) end as machine_name,
          s_suppkey % 5 < 2 and s_suppkey % 12 <> 3 as enabled, 'w' || cast(s_suppkey as varchar(20)) as worker_id
        from {supplier}
    """,
    "v_requests": """
        select event_id as seq, cast(ts as timestamp) as ts, 'm' || cast(user_id % 4 as varchar(9)) as machine,
          'http://p' || cast(user_id as varchar(20)) as endpoint,
          case when event_type in ('view', 'click') then 'GET' else 'POST' end as method,
          '/jobs/' || event_type as path,
          case event_id % 9 when 0 then 500 when 1 then 404 when 2 then 302 when 3 then null else 200 end as status,
          case when event_id % 31 = 0 then 'eof' else '' end as error,
          value / 10.0 as duration, cast(floor(value * 100) as bigint) as duration_ms,
          case event_id % 3 when 0 then 'copy' when 1 then 'merge' else 'download' end as worker_type,
          case event_type when 'purchase' then 'success' when 'error' then 'failed' else 'skipped' end as outcome,
          cast(floor(value * 1000) as bigint) as bytes, event_type = 'signup' as discovered,
          event_type = 'error' and event_id % 2 = 0 as retried, event_type = 'error' and event_id % 7 = 0 as permanent,
          event_type as class
        from {events}
    """,
    "v_copy_log": """
        select cast(ts as timestamp) as ts, case event_type
          when 'error' then 'Copy timing failed for k/' || cast(user_id as varchar(20)) || '.mp4 part=' || cast(event_id % 10 as varchar(9))
            || ' attempts=' || cast(1 + event_id % 3 as varchar(9)) || '/3 failed_stage=' || case when event_id % 2 = 0 then 'dest_put' else 'source_fetch' end
            || ' error_code=E' || cast(event_id % 4 as varchar(9))
          when 'signup' then 'Copy success for k/' || cast(user_id as varchar(20))
          else 'Copy timing success for k/' || cast(user_id as varchar(20)) || '.mp4 part=' || cast(event_id % 10 as varchar(9))
            || ' attempts=' || cast(1 + event_id % 3 as varchar(9)) || '/3' end
          || ' source_fetch_ms=' || cast(event_id % 90 as varchar(9)) || ' source_fetch_ms_total=' || cast(event_id % 190 as varchar(9))
          || ' dest_upload_ms=' || cast(event_id % 80 as varchar(9)) || ' dest_upload_ms_total=' || cast(event_id % 180 as varchar(9))
          || ' retry_wait_ms_total=' || cast(event_id % 70 as varchar(9)) || ' total_copy_ms=' || cast(event_id % 900 as varchar(9)) as line
        from {events}
    """,
}

_NAME = re.compile(r"\{(\w+)\}")


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def _spark_sql(sql: str) -> str:
    sql = re.sub(r"(\{\w+\})|([{}])", lambda m: m.group(1) or m.group(2) * 2, sql)
    sql = re.sub(r"@range\((\w+)\)", r"explode(sequence(0L, cast(\1 as bigint) - 1))", sql)
    return sql.replace("@sec(", "(interval 1 second) * (")


def _duck_sql(sql: str) -> str:
    sql = re.sub(r"@range\((\w+)\)", r"unnest(range(\1))", sql)
    return sql.replace(" div ", " // ").replace("@sec(", "(interval 1 second) * (")


class Views:
    """Lazy DataFrames of the views over one data folder: ``v.jobs`` is view ``v_jobs``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def get(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                sql = VIEWS[name]
                self._made[name] = self.spark.sql(_spark_sql(sql), **{n: self.get(n) for n in _needs(sql)})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name if name in BASE else f"v_{name}")


def with_views(sql: str) -> str:
    """DuckDB statement with the views it names as leading common table expressions."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in used:
                visit(VIEWS[name])
                if name not in used:
                    used.append(name)

    visit(sql)
    parts = [f"{n} as ({_NAME.sub(lambda m: m.group(1), _duck_sql(VIEWS[n])).strip()})" for n in used]
    body = sql.strip()
    if not parts:
        return body
    joined = ",\n".join(parts)
    if re.match(r"with recursive\s", body, re.I):
        return f"with recursive {joined},\n{body[14:].strip()}"
    if re.match(r"with\s", body, re.I):
        return f"with {joined},\n{body[4:].strip()}"
    return f"with {joined}\n{body}"
