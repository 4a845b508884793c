"""Error triage: classify failure text, status and code; summarise failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions import rules
from mediaops.functions.columns import col, text

ENVELOPE = "error struct<code: string, stage: string, message: string, retryable: boolean>"


def straight_quotes(c) -> Column:
    """Curly apostrophes become straight ones, so that phrases match either spelling."""
    return F.translate(col(c), "’‘", "''")


def contains_any(message, phrases) -> Column:
    """True when the lower-cased text holds one of the phrases (one alternation, matched in the JVM)."""
    escaped = "|".join("\\Q" + p + "\\E" for p in phrases)
    return F.coalesce(F.lower(straight_quotes(message)).rlike(escaped), F.lit(False))


def _verdict(cls, stage, retryable) -> Column:
    return F.struct(
        F.lit(cls).alias("error_class"),
        (stage if isinstance(stage, Column) else F.lit(stage)).alias("stage"),
        F.lit(retryable).alias("retryable"),
    )


def _network(message: Column, stage: Column, chain):
    for phrases, cls, retryable in rules.NETWORK_PHRASES:
        hit = contains_any(message, phrases)
        chain = F.when(hit, _verdict(cls, stage, retryable)) if chain is None else chain.when(
            hit, _verdict(cls, stage, retryable)
        )
    return chain


def _by_status(chain, at: Column, status: Column, stage: Column, table, upstream, other):
    for code, (cls, retryable) in table.items():
        chain = chain.when(at & (status == code), _verdict(cls, stage, retryable))
    chain = chain.when(at & status.between(500, 599), _verdict(upstream[0], stage, upstream[1]))
    return chain.when(at & (status > 0), _verdict(other[0], stage, other[1]))


def classify_errors(
    df: DataFrame,
    message: str = "error_message",
    status: str = "status_code",
    stage: str = "stage",
    extra_rules=(),
) -> DataFrame:
    """Add ``error_class``, ``error_stage``, ``retryable`` and ``fatal`` to rows holding a failure.

    Order of evidence: a structured JSON envelope; ``extra_rules`` (phrase, class, retryable); an
    object-store ``<Code>``, unless a source sent it; the HTTP status of a source read or destination
    write; network phrases; a read or write that ended without a status. A fatal marker in the text or code makes the verdict final. One projection, no shuffle.
    """
    msg = text(message)
    body = F.from_json(msg, ENVELOPE)["error"]
    given = body.isNotNull() & (
        (text(body["code"]) != "") | (text(body["stage"]) != "") | (text(body["message"]) != "")
    )
    where = F.coalesce(F.col(stage), F.lit("unknown")) if stage in df.columns else F.lit("unknown")
    http = F.coalesce(F.col(status).cast("int"), F.lit(0))
    store_code = F.regexp_extract(msg, "(?i)<Code>([^<]+)</Code>", 1)

    chain = F.when(
        given,
        F.struct(
            F.coalesce(body["code"], F.lit("")).alias("error_class"),
            F.coalesce(body["stage"], F.lit("")).alias("stage"),
            F.coalesce(body["retryable"], F.lit(False)).alias("retryable"),
        ),
    )
    for phrase, cls, retryable in extra_rules:
        chain = chain.when(contains_any(msg, [phrase.lower()]), _verdict(cls, where, retryable))
    for code, (cls, retryable) in rules.STORE_CODES.items():
        chain = chain.when((where != "source_fetch") & (store_code == code), _verdict(cls, "dest_put", retryable))
    chain = _by_status(
        chain, where == "source_fetch", http, where, rules.SOURCE_STATUS, rules.SOURCE_5XX, rules.SOURCE_OTHER
    )
    chain = _by_status(chain, where == "dest_put", http, where, rules.DEST_STATUS, rules.DEST_5XX, rules.DEST_OTHER)
    chain = _network(msg, where, chain)
    thrown = where.isin("source_fetch", "dest_put") & (http <= 0)
    chain = chain.when(thrown, _verdict("FetchFailed", where, True))
    verdict = chain.otherwise(
        F.struct(
            F.lit("UnhandledError").alias("error_class"),
            where.alias("stage"),
            http.isin(rules.RETRYABLE_STATUS).alias("retryable"),
        )
    )
    judged = F.when(given, F.concat_ws(" ", body["code"], body["message"])).otherwise(msg)
    return (
        df.withColumn("_v", verdict)
        .withColumn("fatal", contains_any(judged, rules.FATAL_MARKERS))
        .withColumns(
            {
                "error_class": F.col("_v.error_class"),
                "error_stage": F.col("_v.stage"),
                "retryable": F.col("_v.retryable") & ~F.col("fatal"),
            }
        )
        .drop("_v")
    )


def response_retryable(message, status) -> Column:
    """Whether a failed copy response deserves another try (envelope first, fatal markers last)."""
    msg = text(message)
    body = F.from_json(msg, ENVELOPE)["error"]
    given = body.isNotNull() & (
        (text(body["code"]) != "") | (text(body["stage"]) != "") | (text(body["message"]) != "")
    )
    fatal_env = contains_any(F.concat_ws("\n", body["message"], body["code"]), rules.FATAL_MARKERS)
    plain = F.coalesce(col(status).isin(rules.RETRYABLE_STATUS), F.lit(False))
    return F.when(given, F.coalesce(body["retryable"], F.lit(False)) & ~fatal_env).otherwise(
        plain & ~contains_any(msg, rules.FATAL_MARKERS)
    )


def list_parts_retryable(message) -> Column:
    return contains_any(message, rules.LIST_PARTS_RETRYABLE)


def upload_is_gone(message) -> Column:
    """The multipart upload no longer exists, so its checkpoint is worthless."""
    return contains_any(
        message, ["nosuchupload", "no such upload", "status code: 404", "statuscode: 404", "statuscode:404"]
    )


def download_retryable(message) -> Column:
    return contains_any(message, rules.DOWNLOAD_RETRYABLE)


def metadata_retryable(message) -> Column:
    return contains_any(message, rules.METADATA_RETRYABLE) & ~contains_any(message, rules.METADATA_FINAL)


def error_breakdown(classified: DataFrame) -> DataFrame:
    """Failures per job and class with subtotals (``cube``) and the share of all failures.

    Counted once per (job, class, stage, retryable) before the cube, so a hot job moves few rows.
    The total is the cube's own grand-total row, carried over by a scalar subquery.
    """
    base = classified.groupBy("job_id", "error_class", "error_stage", "retryable").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = base.agg(F.sum("n")).scalar()
    cube = base.cube("job_id", "error_class").agg(
        F.sum("n").alias("failures"),
        F.sum(F.when(F.col("retryable"), F.col("n")).otherwise(0)).alias("retryable_failures"),
        F.grouping_id().alias("level"),
    )
    return cube.withColumn("share", F.round(F.col("failures") / total, 6))
