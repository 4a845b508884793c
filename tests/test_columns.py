"""Column expressions: keys, endpoints, templates, globs, part sizes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mediaops.functions import columns as C
from mediaops.functions.globs import glob_regex, glob_subject
from mediaops.sources.readers import flexible_timestamp


def values(spark, rows, names, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_dest_key(spark):
    rows = [
        ("foo/bar", "backup", "foo/bar/a.txt"),
        ("foo/bar", "backup", "foo/bar"),
        ("foo/bar", "", "foo/bar/a/b.txt"),
        ("foo/bar", "backup", "foo/bar2/a.txt"),
        ("", "backup", "a/b.txt"),
        ("/foo/bar/", "/backup/", "/foo/bar/x"),
    ]
    got = values(spark, rows, ["s", "d", "k"], C.dest_key("d", "s", "k"))
    assert got == ["backup/a.txt", "backup", "a/b.txt", "backup/foo/bar2/a.txt", "backup/a/b.txt", "backup/x"]


def test_endpoint_bucket(spark):
    rows = [("s3://bkt.oss.example.com",), ("https://host.example.com/bkt/",), ("://bad-endpoint",)]
    assert values(spark, rows, ["e"], C.endpoint_bucket("e")) == ["bkt", "bkt", ""]


def test_object_url(spark):
    rows = [("s3://bkt.oss.example.com", "b", "k"), ("https://host:9000/p", "b", "k"), ("host", "b", "k")]
    got = values(spark, rows, ["e", "b", "k"], C.object_url("e", "b", "k"))
    assert got == ["http://b.oss.example.com/k", "https://b.host:9000/k", "http://b.host/k"]


def test_dest_label(spark):
    rows = [("c", 1, d) for d in ("", "/a", "a/b/c", "a//b")] + [(None, 7, "/x/")]
    got = values(spark, rows, ["c", "m", "d"], C.dest_label("c", "m", "d"))
    assert got == ["c | -", "c | a", "c | a/b", "c | a", "meta-7 | x"]


def test_template_and_title(spark):
    rows = [("/$(date +%Y/%m)/%(id)-%(title).%(ext)", "v1", " a/b: c! ", "mp4"), ("plain", "v", "t", "x")]
    got = values(spark, rows, ["t", "id", "title", "ext"], C.render_template("t", "2024-03-05 01:02:03", "id", "title", "ext"))
    assert got == ["2024/03/v1-a_b__c.mp4", "plain"]


def test_content_type(spark):
    rows = [("https://h/x?mime=audio%2Fmp4", "a.MP4"), ("https://h/x", "a.MKV"), (None, "noext"), ("", "a.")]
    got = values(spark, rows, ["u", "k"], C.content_type("u", "k"))
    assert got == ["audio/mp4", "video/x-matroska", "application/octet-stream", "application/octet-stream"]


def test_source_identity(spark):
    rows = [("u", 5, ""), ("u", 5, ' "abc" ')]
    assert values(spark, rows, ["s", "n", "e"], C.source_identity("s", "n", "e")) == ["u|5", "u|5|abc"]


def test_member_fields(spark):
    rows = [("12:34:token-1",), ("12:34:",), ("x:34:t",), ("12:34",), ("0:3:t",), ("1:2:a:b",)]
    got = values(spark, rows, ["m"], C.member_fields("m")["run_token"])
    assert got == ["token-1", None, None, None, None, "a:b"]


def test_redact_url(spark):
    rows = [("https://h/p?partNumber=3&uploadId=abcdefghijk&sig=z",), ("not a url",)]
    assert values(spark, rows, ["u"], C.redact_url("u")) == ["https://h/p?partNumber=3&uploadId=abcdefgh...", "<invalid_url>"]
    rows = [("k/a.mp4",), ("https://h/p?sig=z&uploadId=abcdefgh...",), ("://x?sig=z",), (None,)]
    assert values(spark, rows, ["u"], C.redact_key("u")) == ["k/a.mp4", "https://h/p?uploadId=abcdefgh...", "<invalid_url>", None]


def test_human_bytes(spark):
    rows = [(0,), (10,), (1536,), (5 << 20,), (3 << 30,)]
    assert values(spark, rows, ["n"], C.human_bytes("n")) == ["0 B", "10.00 B", "1.50 KB", "5.00 MB", "3.00 GB"]


@pytest.mark.parametrize(
    "pattern,key,match",
    [
        ("*.mp4", "d/a.mp4", True),
        ("*.mp4", "d/a.mp4x", False),
        ("a/*.mp4", "a/b.mp4", True),
        ("a/*.mp4", "a/b/c.mp4", False),
        ("?.txt", "x/a.txt", True),
        ("?.txt", "x/ab.txt", False),
        ("[a-c]*", "x/bob", True),
        ("[^a-c]*", "x/bob", False),
        ("[^a-c]*", "x/dob", True),
        ("a\\*b", "a*b", True),
        ("a\\*b", "axb", False),
        ("a.b", "axb", False),
        ("a+b(c)", "a+b(c)", True),
        ("[\\]x]y", "]y", True),
        ("a/[^b]c", "a//c", True),
        ("é?", "éü", True),
        ("[bad", "zzz", None),
        ("[]a]", "a", None),
        ("x\\", "x", None),
        ("[a-]", "a", None),
        ("", "anything", None),
    ],
)
def test_globs(spark, pattern, key, match):
    df = spark.createDataFrame([(pattern, key)], ["p", "k"])
    regex, hit = df.select(glob_regex("p"), F.rlike(glob_subject("p", "k"), glob_regex("p"))).first()
    assert (regex is None) == (match is None)
    assert hit is match


def test_flexible_timestamp(spark):
    rows = [
        ("2024-01-02T03:04:05.123456789Z",), ("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.123456789",),
        ("2024-01-02T03:04:05.123456",), ("2024-01-02T03:04:05.123",), ("2024-01-02T03:04:05",),
        ("2024-01-02 03:04:05.123456789",), ("2024-01-02 03:04:05.123456",), ("2024-01-02 03:04:05.123",),
        ("2024-01-02 03:04:05",), ("2024-01-02T05:04:05+02:00",), ("0001-01-01T00:00:00Z",), ("",), ("junk",), ("2024-01-02",), (None,),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.unix_micros(flexible_timestamp(F.col("t")))).collect()]
    base = 1704164645_000000
    full, ms = base + 123456, base + 123000
    assert got == [full, base, full, full, ms, base, full, full, ms, base, base] + [None] * 5


def test_part_size(spark):
    rows = [(64 << 20,), (10_000 * (6 << 20),)]
    assert values(spark, rows, ["n"], C.part_size("n", 5 << 20)) == [5 << 20, 6 << 20]
