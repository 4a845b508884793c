"""Registry of check queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.session import configure
from workload.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Moments the queries look from.
JOBS_NOW = "2001-08-02 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and timestamps as epoch microseconds (-1 for none), as both engines agree on."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(-1).cast("long"))
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` as a query; ``sql`` is its DuckDB twin (``@us(x)`` = epoch µs or -1)."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(Views(configure(spark), folder)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            text = with_views(sql)
            while "@us(" in text:
                at = text.index("@us(")
                depth, end = 0, at + 3
                for end in range(at + 3, len(text)):
                    depth += {"(": 1, ")": -1}.get(text[end], 0)
                    if depth == 0:
                        break
                text = f"{text[:at]}coalesce(epoch_us({text[at + 4:end]}), -1){text[end + 1:]}"
            ORACLES[name] = text
        return fn

    return register
