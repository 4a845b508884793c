"""Column expressions shared by the operators. All are Spark built-ins, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task and job states.
PENDING = "PENDING"
RUNNING = "RUNNING"
COMPLETED = "COMPLETED"
FAILED = "FAILED"
STOPPED = "STOPPED"
SCANNING = "SCANNING"
METADATA_PROCESSING = "METADATA_PROCESSING"
METADATA_FETCHED = "METADATA_FETCHED"

MIB = 1 << 20

# Content type by file extension.
CONTENT_TYPES = {
    "mp4": "video/mp4",
    "webm": "video/webm",
    "mkv": "video/x-matroska",
    "avi": "video/x-msvideo",
    "mov": "video/quicktime",
    "m4a": "audio/mp4",
    "mp3": "audio/mpeg",
    "opus": "audio/opus",
    "ogg": "audio/ogg",
    "wav": "audio/wav",
    "flac": "audio/flac",
    "aac": "audio/aac",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value) -> Column:
    """A timestamp column from a column, a datetime or ISO text (the ``as_of`` of every operator)."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def seconds(n) -> Column:
    """A day-time interval of ``n`` seconds (``n`` a number or a column)."""
    if not isinstance(n, Column):
        n = F.lit(n)
    return F.make_dt_interval(secs=n)


def text(c) -> Column:
    """Null and blank text become the empty string."""
    return F.coalesce(F.trim(col(c)), F.lit(""))


def present(c) -> Column:
    """Text that counts as given: null when empty."""
    return F.nullif(col(c), F.lit(""))


def is_blank(c) -> Column:
    return text(c) == ""


def trim_slashes(c) -> Column:
    return F.btrim(text(c), F.lit("/"))


def basename(c) -> Column:
    return F.regexp_extract(col(c), "[^/]*$", 0)


def extension(c) -> Column:
    return F.lower(F.regexp_extract(col(c), r"\.([^.]+)$", 1))


def dest_label(client, metadata_id, dst_dir) -> Column:
    """``client | first[/second]`` segment of the destination, ``-`` when it is empty."""
    path = trim_slashes(dst_dir)
    first = F.split_part(path, F.lit("/"), F.lit(1))
    second = F.split_part(path, F.lit("/"), F.lit(2))
    owner = F.coalesce(col(client), F.concat(F.lit("meta-"), col(metadata_id).cast("string")))
    place = F.when(second != "", F.concat_ws("/", first, second)).otherwise(
        F.coalesce(F.nullif(first, F.lit("")), F.lit("-"))
    )
    return F.concat_ws(" | ", owner, place)


def below(base, key) -> Column:
    """Key below a trimmed directory: empty for the directory itself, unchanged when it lies elsewhere."""
    base, name = col(base), F.regexp_replace(col(key), "^/", "")
    return (
        F.when(base == "", name)
        .when(name == base, F.lit(""))
        .when(F.startswith(name, F.concat(base, F.lit("/"))), F.substr(name, F.length(base) + 2))
        .otherwise(name)
    )


def join_key(root, rel) -> Column:
    """Trimmed directory and relative key joined by one slash; either may be empty."""
    return F.concat_ws("/", present(root), present(rel))


def relative_key(src_dir, key) -> Column:
    """Key below ``src_dir``: empty for the directory itself, unchanged when it lies elsewhere."""
    return below(trim_slashes(src_dir), key)


def dest_key(dst_dir, src_dir, key) -> Column:
    """Destination key: trimmed ``dst_dir`` and the relative key."""
    return join_key(trim_slashes(dst_dir), relative_key(src_dir, key))


def endpoint_bucket(endpoint) -> Column:
    """Bucket named by an endpoint: first host label of ``s3://``, otherwise the URL path."""
    e = col(endpoint)
    return F.when(
        F.startswith(e, F.lit("s3://")), F.split_part(F.substr(e, F.lit(6)), F.lit("."), F.lit(1))
    ).otherwise(F.coalesce(F.btrim(F.try_parse_url(e, F.lit("PATH")), F.lit("/")), F.lit("")))


def endpoint_host(endpoint) -> Column:
    return F.lower(F.try_parse_url(F.trim(col(endpoint)), F.lit("HOST")))


def object_url(endpoint, bucket, key) -> Column:
    """Virtual-host style URL ``scheme://bucket.host/key``; ``s3://`` endpoints lose their bucket label."""
    e = col(endpoint)
    is_s3 = F.startswith(e, F.lit("s3://"))
    bare = F.when(is_s3, F.concat(F.lit("http://"), F.substr(e, F.lit(6)))).when(
        F.contains(e, F.lit("://")), e
    ).otherwise(F.concat(F.lit("http://"), e))
    scheme = F.regexp_extract(bare, "^([^:]+)://", 1)
    authority = F.regexp_extract(bare, "^[^:]+://([^/?#]*)", 1)
    host = F.when(
        is_s3 & F.contains(authority, F.lit(".")), F.regexp_replace(authority, r"^[^.]*\.", "")
    ).otherwise(authority)
    return F.concat(scheme, F.lit("://"), col(bucket), F.lit("."), host, F.lit("/"), col(key))


def query_param(url, name: str) -> Column:
    """Decoded query parameter, null when absent or when the URL does not parse."""
    return F.try_url_decode(F.try_parse_url(col(url), F.lit("QUERY"), F.lit(name)))


def content_type(url, key) -> Column:
    """The ``mime`` query parameter of the source, otherwise the type of the key's extension."""
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(
        present(query_param(url, "mime")),
        F.try_element_at(table, extension(key)),
        F.lit(DEFAULT_CONTENT_TYPE),
    )


def safe_title(c) -> Column:
    """Title usable in a key: other than letters, digits, dot, dash and underscore become ``_``."""
    return F.btrim(F.regexp_replace(col(c), "[^A-Za-z0-9._-]", "_"), F.lit("_"))


# Date codes of a name template and their Spark pattern letters.
DATE_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def render_template(template, as_of, video_id, title, ext) -> Column:
    """Expand ``%(id) %(title) %(ext)`` and ``$(date +codes)`` of an output-name template."""
    t = col(template)
    pieces = F.regexp_extract_all(t, F.lit(r"(?s)\$\(date \+[^)]*\)|(?:(?!\$\(date \+[^)]*\)).)+"), F.lit(0))

    def expand(piece: Column) -> Column:
        stamp = F.regexp_extract(piece, r"^\$\(date \+([^)]*)\)$", 1)
        for code, letters in DATE_CODES.items():
            stamp = F.replace(stamp, F.lit(code), F.date_format(ts(as_of), letters))
        return F.when(piece.rlike(r"^\$\(date \+[^)]*\)$"), stamp).otherwise(piece)

    name = F.array_join(F.transform(pieces, expand), "")
    for mark, value in (("%(id)", col(video_id)), ("%(title)", safe_title(title)), ("%(ext)", col(ext))):
        name = F.replace(name, F.lit(mark), F.coalesce(value, F.lit("")))
    return F.regexp_replace(name, "^/", "")


def under_prefix(prefix, name) -> Column:
    """``prefix/name`` with exactly one slash between; the bare name when the prefix is empty."""
    p = F.coalesce(col(prefix), F.lit(""))
    return F.when(p == "", col(name)).otherwise(F.concat(F.rtrim(p, F.lit("/")), F.lit("/"), col(name)))


def part_size(size, min_part: int, max_parts: int = 10_000) -> Column:
    """Part size of a multipart upload: a ten-thousandth of the object, at least ``min_part``."""
    return F.greatest(int_div(size, max_parts), F.lit(min_part).cast("long"))


def int_div(a, b) -> Column:
    """Integer division (toward zero) of two long columns or numbers."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", col(a).cast("long"), b.cast("long"))


def part_count(size, per_part) -> Column:
    return int_div(col(size) - 1, per_part) + 1


def source_identity(src, size, etag) -> Column:
    """``src|size[|etag]`` with the etag unquoted."""
    tag = present(F.btrim(text(etag), F.lit('"')))
    return F.concat_ws("|", col(src), col(size).cast("string"), tag)


def clean_etag(c) -> Column:
    return F.lower(F.btrim(F.trim(col(c)), F.lit('"')))


def redact_url(url) -> Column:
    """URL for reports: upload ids shortened to eight characters, no other query part kept."""
    u = col(url)
    base = F.regexp_extract(u, "^[^?#]*", 0)
    part = query_param(u, "partNumber")
    upload = query_param(u, "uploadId")
    kept = F.concat_ws(
        "&",
        F.when(F.length(part) > 0, F.concat(F.lit("partNumber="), part)),
        F.when(F.length(upload) > 0, F.concat(F.lit("uploadId="), F.left(upload, F.lit(8)), F.lit("..."))),
    )
    return F.when(F.try_parse_url(u, F.lit("HOST")).isNull(), F.lit("<invalid_url>")).otherwise(
        F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    )


def redact_key(key) -> Column:
    """An object key as it is; a URL in its place as ``redact_url`` shows it."""
    return F.when(F.contains(col(key), F.lit("://")), redact_url(key)).otherwise(col(key))


def human_bytes(c) -> Column:
    """Size with a binary unit and two decimals, for reports."""
    n = col(c).cast("double")
    out = F.when(n.isNull() | (n <= 0), F.lit("0 B"))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out = out.when(n >= float(1024**power), F.concat(F.format_number(n / float(1024**power), 2), F.lit(" " + unit)))
    return out


def member_fields(member) -> Column:
    """``job:task:token`` text as a struct; null unless both ids are positive and the token is given."""
    bits = F.split(col(member), ":", 3)
    job = F.get(bits, F.lit(0)).try_cast("long")
    task = F.get(bits, F.lit(1)).try_cast("long")
    token = F.get(bits, F.lit(2))
    return F.when(
        (F.size(bits) == 3) & (job > 0) & (task > 0) & (F.trim(token) != ""),
        F.struct(job.alias("job_id"), task.alias("task_id"), token.alias("run_token")),
    )
