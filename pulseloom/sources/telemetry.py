"""Telemetry ingest: topic and JSON payload rows to typed points. Every function works on batch and stream frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The typed fields of each device measurement; 64-bit numbers that travel as strings are cast after.
SCHEMAS = {
    "ftm": ("ts DOUBLE, session_id BIGINT, rtt_ps BIGINT, rssi BIGINT, t1 STRING, t2 STRING, t3 STRING, t4 STRING", ["t1", "t2", "t3", "t4"]),
    "ftm_stats": ("ts DOUBLE, session_id BIGINT, status BIGINT, count BIGINT, rtt_avg_ps BIGINT, rtt_min_ps BIGINT, rtt_max_ps BIGINT, rssi_avg BIGINT, rssi_min BIGINT, rssi_max BIGINT", []),
    "dtc_request": ("ts DOUBLE, cycle_counter STRING, local_ticks STRING, base_period BIGINT, base_period_frac BIGINT", ["cycle_counter", "local_ticks"]),
    "crm_stats": ("ts DOUBLE, samples BIGINT, new_samples BIGINT, r_squared DOUBLE, std_ns DOUBLE, ppm_lr DOUBLE", []),
    "dtr_feedback": ("ts DOUBLE, period_ticks BIGINT, period_ticks_delta BIGINT, cycle_delta BIGINT", []),
    "sdr_stats": ("ts DOUBLE, count BIGINT, mean_ns DOUBLE, std_ns DOUBLE, min_ns DOUBLE, max_ns DOUBLE, max_jitter_ns DOUBLE, p50_ns DOUBLE, p95_ns DOUBLE, p99_ns DOUBLE, p999_ns DOUBLE, overflow_count BIGINT, channel_a_edges BIGINT, channel_b_edges BIGINT, matched_count BIGINT", []),
    "sdr_phase_noise": ("ts DOUBLE, sample_count BIGINT, duration_seconds DOUBLE, pulse_freq DOUBLE, rms_rad DOUBLE, rms_jitter_ns DOUBLE, " + ", ".join(f"f_{x} DOUBLE" for x in ("0p2", "0p5", "1", "2", "5", "10", "20", "50", "100", "200", "500")), []),
}


def ingest(raw: DataFrame, measurement: str) -> DataFrame:
    """device, measurement, arrival and typed fields of raw(topic, payload, arrival) rows on topics fts/<device>/<measurement>.

    Payloads that aren't JSON give null fields; strings that aren't numbers give null numbers.
    """
    schema, wide = SCHEMAS[measurement]
    parts = F.split("topic", "/")
    own = measurement.removeprefix("sdr_") if measurement.startswith("sdr_") else measurement
    rows = raw.where(parts[F.size(parts) - 1] == own).select(parts[1].alias("device") if not measurement.startswith("sdr_") else F.lit("sdr").alias("device"), F.lit(measurement).alias("measurement"), "arrival", F.from_json("payload", schema).alias("f"))
    out = rows.select("device", "measurement", "arrival", "f.*")
    return out.withColumns({c: F.expr(f"try_cast({c} AS BIGINT)") for c in wide})


def ingest_edges(raw: DataFrame) -> DataFrame:
    """arrival, ts, both edges and their delay: null unless both are there."""
    rows = raw.select("arrival", F.from_json("payload", "ts DOUBLE, channel_a_edge_ns BIGINT, channel_b_edge_ns BIGINT").alias("f")).select("arrival", "f.*")
    return rows.withColumn("delay_ns", F.col("channel_b_edge_ns") - F.col("channel_a_edge_ns"))


def ingest_health(raw: DataFrame) -> DataFrame:
    """name, host, tags, t_ns, field, value of generic metrics {name, tags, fields, timestamp}, one row per field."""
    rows = raw.select(F.from_json("payload", "name STRING, tags MAP<STRING, STRING>, fields MAP<STRING, DOUBLE>, timestamp BIGINT").alias("m"))
    return rows.select(F.col("m.name").alias("name"), F.col("m.tags")["host"].alias("host"), F.col("m.tags").alias("tags"), F.col("m.timestamp").alias("t_ns"), F.explode("m.fields").alias("field", "value"))


def ingest_broker_stats(raw: DataFrame) -> DataFrame:
    """measurement, field, value of one-value topics under $SYS/broker/: the rest of the path names the field."""
    inside = raw.where(F.startswith("topic", F.lit("$SYS/broker/")))
    return inside.select(F.lit("mosquitto").alias("measurement"), F.translate(F.substring_index(F.regexp_replace("topic", r"^\$SYS/broker/", ""), "\u0000", 1), "/", "_").alias("field"), F.expr("try_cast(payload AS DOUBLE)").alias("value"))


def stamp_arrival(raw: DataFrame, now: Column) -> DataFrame:
    """raw with t_ns, the event's own time where the payload has one, else its arrival, on a topic by device and measurement."""
    # Seconds as a decimal: a double has no room for nanoseconds since 1970.
    own = (F.from_json("payload", "ts DECIMAL(20,9)")["ts"] * F.lit(1_000_000_000).cast("decimal(10,0)")).cast("long")
    parts = F.split("topic", "/")
    return raw.withColumn("t_ns", F.coalesce(own, now)).withColumn("topic", F.format_string("fts_ts/%s/%s", parts[1], parts[2]))


def route_bucket(df: DataFrame, allow: str, deny: str | None = None) -> DataFrame:
    """df with bucket: fts for measurements that match the allow pattern and not the deny one, else health."""
    good = F.col("measurement").rlike(allow) & (~F.col("measurement").rlike(deny) if deny else F.lit(True))
    return df.withColumn("bucket", F.when(F.coalesce(good, F.lit(False)), "fts").otherwise("health"))


def tag_site(df: DataFrame) -> DataFrame:
    """df with site: cloud without a topic, else lab; the topic goes, and whole numbers become floats, so that sites agree on types."""
    whole = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    out = df.withColumn("site", F.when(F.col("topic").isNull(), "cloud").otherwise("lab")).drop("topic")
    return out.withColumns({c: F.col(c).cast("double") for c in whole})


def payload(df: DataFrame, columns: list[str], zero: bool = False) -> Column:
    """A JSON payload of columns; nulls are left out, or zero for statistics."""
    return F.to_json(F.struct(*[(F.coalesce(F.col(c), F.lit(0)) if zero else F.col(c)).alias(c) for c in columns]))
