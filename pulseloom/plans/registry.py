"""Registered queries and their SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The event stream as the SQL of the oracles sees it.
EV = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, user_id % 8 AS device, event_type, value, props, CAST(props->>'k' AS BIGINT) AS k FROM events)"
HOUR, DAY, SECOND = 3_600_000_000, 86_400_000_000, 1_000_000


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, folder) under a name, with the SQL that must give the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def us_of(c: str) -> object:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, us, user_id, device, event_type, value, props, k of the event stream."""
    e = read(spark, d, "events")
    return e.select("event_id", us_of("ts").alias("us"), "user_id", (F.col("user_id") % 8).alias("device"), "event_type", "value", "props", F.get_json_object("props", "$.k").cast("long").alias("k"))


from . import matching_queries, ordered_queries, statistics_queries, stream_queries, telemetry_queries  # noqa: E402, F401
