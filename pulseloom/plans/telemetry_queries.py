"""Ingest, projection, filter and sink queries over events and the dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from ..operators import flux, sinks
from ..sources import logs, shared, telemetry
from .registry import DAY, EV, HOUR, events, query, read
from .statistics_queries import FTM, ftm_entries


def raw(spark: SparkSession, d: str) -> DataFrame:
    """Events as landed messages: topic, payload, arrival."""
    topic = F.format_string("fts/dev%d/%s", "device", F.when(F.col("event_type") == "click", "dtc_request").otherwise("ftm"))
    body = F.to_json(F.struct((F.col("us") / 1e6).alias("ts"), F.col("event_id").cast("string").alias("cycle_counter"), F.col("us").cast("string").alias("local_ticks"), F.col("k").alias("base_period"), F.lit(1).alias("base_period_frac")))
    return events(spark, d).select("event_id", topic.alias("topic"), body.alias("payload"), (F.col("us") * 1000).alias("arrival"))


@query("ingest_telemetry", f"WITH {EV} SELECT 'dev' || device AS device, us * 1000 AS arrival, event_id AS cycle_counter, us AS local_ticks, k AS base_period, CAST(1 AS BIGINT) AS base_period_frac FROM ev WHERE event_type = 'click'")
def ingest_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.ingest(raw(spark, d).drop("event_id"), "dtc_request").select("device", "arrival", "cycle_counter", "local_ticks", "base_period", "base_period_frac")


def _messages(spark: SparkSession, d: str, topic: str, **fields: object) -> DataFrame:
    """Events as messages on one device topic each, with a JSON payload of the given fields."""
    body = F.to_json(F.struct((F.col("us") / 1e6).alias("ts"), *[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]))
    return events(spark, d).select(F.format_string(f"fts/dev%d/{topic}", "device").alias("topic"), body.alias("payload"), (F.col("us") * 1000).alias("arrival"))


@query("ingest_ftm", f"WITH {EV} SELECT 'dev' || device AS device, us * 1000 AS arrival, event_id AS session_id, k * 1000 AS rtt_ps, -k AS rssi, us AS t1, us + 1 AS t2, us + 2 AS t3, CASE WHEN k > 50 THEN us + 3 END AS t4 FROM ev")
def ingest_ftm(spark: SparkSession, d: str) -> DataFrame:
    raw = _messages(spark, d, "ftm", session_id="event_id", rtt_ps="k * 1000", rssi="-k", t1="CAST(us AS STRING)", t2="CAST(us + 1 AS STRING)", t3="CAST(us + 2 AS STRING)", t4="IF(k > 50, CAST(us + 3 AS STRING), 'none')")
    return telemetry.ingest(raw, "ftm").drop("measurement", "ts")


@query("ingest_ftm_stats", f"WITH {EV} SELECT 'dev' || device AS device, us * 1000 AS arrival, event_id AS session_id, k % 2 AS status, k AS count, k * 10 AS rtt_avg_ps, k * 9 AS rtt_min_ps, k * 11 AS rtt_max_ps, CAST(NULL AS BIGINT) AS rssi_avg FROM ev")
def ingest_ftm_stats(spark: SparkSession, d: str) -> DataFrame:
    raw = _messages(spark, d, "ftm_stats", session_id="event_id", status="k % 2", count="k", rtt_avg_ps="k * 10", rtt_min_ps="k * 9", rtt_max_ps="k * 11")
    return telemetry.ingest(raw, "ftm_stats").drop("measurement", "ts", "rssi_min", "rssi_max")


@query("ingest_crm_stats", f"WITH {EV} SELECT 'dev' || device AS device, us * 1000 AS arrival, k AS samples, k % 7 AS new_samples, value AS r_squared, value / 8 AS std_ns, -value AS ppm_lr FROM ev")
def ingest_crm_stats(spark: SparkSession, d: str) -> DataFrame:
    raw = _messages(spark, d, "crm_stats", samples="k", new_samples="k % 7", r_squared="value", std_ns="value / 8", ppm_lr="-value")
    return telemetry.ingest(raw, "crm_stats").drop("measurement", "ts")


@query("ingest_dtr_feedback", f"WITH {EV} SELECT 'dev' || device AS device, us * 1000 AS arrival, k * 40 AS period_ticks, k - 50 AS period_ticks_delta, k % 3 AS cycle_delta FROM ev")
def ingest_dtr_feedback(spark: SparkSession, d: str) -> DataFrame:
    raw = _messages(spark, d, "dtr_feedback", period_ticks="k * 40", period_ticks_delta="k - 50", cycle_delta="k % 3")
    return telemetry.ingest(raw, "dtr_feedback").drop("measurement", "ts")


@query("payload_stats", f"WITH {EV} SELECT event_id, '{{\"count\":' || k || ',\"mean_ns\":' || CASE WHEN k < 50 THEN k * 3 ELSE 0 END || '}}' AS payload FROM ev")
def payload_stats(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumns({"count": F.col("k"), "mean_ns": F.when(F.col("k") < 50, F.col("k") * 3)})
    return e.select("event_id", telemetry.payload(e, ["count", "mean_ns"], zero=True).alias("payload"))


@query("ingest_edges", f"WITH {EV} SELECT us AS arrival, CASE WHEN k < 80 THEN us * 1000 END AS channel_a_edge_ns, CASE WHEN k > 20 THEN us * 1000 + k END AS channel_b_edge_ns, CASE WHEN k < 80 AND k > 20 THEN k END AS delay_ns FROM ev")
def ingest_edges(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.when(F.col("k") < 80, F.col("us") * 1000), F.when(F.col("k") > 20, F.col("us") * 1000 + F.col("k"))
    e = events(spark, d).select(F.col("us").alias("arrival"), F.to_json(F.struct((F.col("us") / 1e6).alias("ts"), a.alias("channel_a_edge_ns"), b.alias("channel_b_edge_ns"))).alias("payload"))
    return telemetry.ingest_edges(e).select("arrival", "channel_a_edge_ns", "channel_b_edge_ns", "delay_ns")


@query("ingest_stats", f"WITH {EV} SELECT us AS arrival, k AS count, value AS mean_ns, CAST(NULL AS DOUBLE) AS std_ns FROM ev")
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.lit("sdr/stats").alias("topic"), F.to_json(F.struct((F.col("us") / 1e6).alias("ts"), F.col("k").alias("count"), F.col("value").alias("mean_ns"))).alias("payload"), F.col("us").alias("arrival"))
    return telemetry.ingest(e, "sdr_stats").select("arrival", "count", "mean_ns", "std_ns")


@query("ingest_phase_noise", f"WITH {EV} SELECT us AS arrival, k AS sample_count, value AS f_0p2, CAST(NULL AS DOUBLE) AS f_500 FROM ev")
def ingest_phase_noise(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.lit("sdr/phase_noise").alias("topic"), F.to_json(F.struct((F.col("us") / 1e6).alias("ts"), F.col("k").alias("sample_count"), F.col("value").alias("f_0p2"))).alias("payload"), F.col("us").alias("arrival"))
    return telemetry.ingest(e, "sdr_phase_noise").select("arrival", "sample_count", "f_0p2", "f_500")


@query("ingest_health", f"WITH {EV} SELECT 'cpu' AS name, 'host' || device AS host, us * 1000 AS t_ns, f.field, f.value FROM ev, LATERAL (SELECT 'k' AS field, CAST(k AS DOUBLE) AS value UNION ALL SELECT 'value', value) f")
def ingest_health(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.to_json(F.struct(F.lit("cpu").alias("name"), F.struct(F.format_string("host%d", "device").alias("host")).alias("tags"), F.struct("k", "value").alias("fields"), (F.col("us") * 1000).alias("timestamp"))).alias("payload"))
    return telemetry.ingest_health(e).drop("tags")


@query("ingest_sys", f"WITH {EV} SELECT 'mosquitto' AS measurement, event_type || '_device' || device || '_value' AS field, value FROM ev")
def ingest_sys(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.format_string("$SYS/broker/%s/device%d/value", "event_type", "device").alias("topic"), F.col("value").cast("string").alias("payload"))
    return telemetry.ingest_broker_stats(e)


@query("stamp_route", f"WITH {EV} SELECT event_id, 'fts_ts/dev' || device || '/' || event_type AS topic, CASE WHEN k < 50 THEN us * 1000 ELSE us * 1000 + 7 END AS t_ns FROM ev")
def stamp_route(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", F.format_string("fts/dev%d/%s", "device", "event_type").alias("topic"), F.when(F.col("k") < 50, F.to_json(F.struct((F.col("us") / 1e6).alias("ts")))).otherwise(F.lit("{}")).alias("payload"), (F.col("us") * 1000 + 7).alias("arrival"))
    return telemetry.stamp_arrival(e, F.col("arrival")).select("event_id", "topic", "t_ns")


@query("route_bucket", f"WITH {EV} SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') AND event_type <> 'view' THEN 'fts' ELSE 'health' END AS bucket FROM ev")
def route_bucket(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.route_bucket(events(spark, d).withColumn("measurement", F.col("event_type")), "^(click|view|purchase)$", "^view$").select("event_id", "bucket")


@query("tag_site", f"WITH {EV} SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN k < 30 THEN 'cloud' ELSE 'lab' END AS site, CAST(k AS DOUBLE) AS k FROM ev")
def tag_site(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("k") >= 30, F.lit("health/x")).alias("topic"), "k")
    return telemetry.tag_site(e)


@query("payload_edges", f"WITH {EV} SELECT event_id, CASE WHEN k < 50 THEN '{{\"channel_a_edge_ns\":' || us * 1000 || ',\"k\":' || k || '}}' ELSE '{{\"k\":' || k || '}}' END AS payload FROM ev")
def payload_edges(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("channel_a_edge_ns", F.when(F.col("k") < 50, F.col("us") * 1000))
    return e.select("event_id", telemetry.payload(e, ["channel_a_edge_ns", "k"]).alias("payload"))


@query("monotonic_violations", f"WITH {EV}, l AS (SELECT event_id, device, value, lag(value) OVER (PARTITION BY device ORDER BY us, event_id) AS p FROM ev) SELECT event_id, device, value, p AS before FROM l WHERE value < p")
def monotonic_violations(spark: SparkSession, d: str) -> DataFrame:
    return sinks.monotonic_violations(events(spark, d), ["device"], ["us", "event_id"], "value", DAY).select("event_id", "device", "value", "before")


@query("clamp_points", "SELECT vec_id, CAST(i AS INTEGER) - 1 AS pos, CAST(greatest(-32768, least(32767, (i - 1) * 500 - 40000)) AS INTEGER) AS off FROM embeddings, (SELECT unnest(range(1, 256)) AS i)")
def clamp_points(spark: SparkSession, d: str) -> DataFrame:
    """Every vector five times over, 320 points, of which the format holds 255."""
    long = F.flatten(F.array_repeat("embedding", 5))
    e = read(spark, d, "embeddings").select("vec_id", F.transform(long, lambda v, i: F.struct((i * 500 - 40000).alias("off"), v.alias("v"))).alias("points"))
    out = sinks.clamp_points(e, "points")
    return out.select("vec_id", F.posexplode("points").alias("pos", "p")).select("vec_id", "pos", F.col("p.off").alias("off"))


@query("export_csv", f"WITH {EV} SELECT event_id, printf('%.9f', event_id / 500) AS time_s, printf('%.3f', value) AS delay_ns FROM ev")
def export_csv(spark: SparkSession, d: str) -> DataFrame:
    # 500 samples a second: times end after three decimals, which both engines print alike.
    e = events(spark, d).select(F.col("event_id").alias("id"), F.col("event_id").alias("t"), "value")
    out = sinks.export_delays(e, "t", "value", 500, keep=["id"])
    return out.withColumnRenamed("id", "event_id")


@query("export_summary", f"WITH {EV} SELECT event_type, '{{\"n\":' || count(*) || ',\"mean\":' || round(avg(value), 3) || '}}' AS summary FROM ev GROUP BY event_type")
def export_summary(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"))
    return sinks.summary_json(s, ["event_type"])


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Signups as annotations."""
    return events(spark, d).where("event_type = 'signup'").select(F.timestamp_micros("us").alias("ts"), F.format_string("user%d", "user_id").alias("experiment"), F.lit("event").alias("type"), F.col("props").alias("description"))


_NOTES = "SELECT us, 'user' || user_id AS experiment, 'event' AS type, props AS description FROM ev WHERE event_type = 'signup'"


@query("export_annotations", f"WITH {EV}, n AS ({_NOTES}) SELECT CAST(to_json({{'time': strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ'), 'experiment': experiment, 'type': type, 'description': description}}) AS VARCHAR) AS value FROM n")
def export_annotations(spark: SparkSession, d: str) -> DataFrame:
    return sinks.annotations_export(notes(spark, d))


@query("import_annotations", f"WITH {EV} {_NOTES}")
def import_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations that replaced others, as they are read afterwards."""
    path = shared.new_folder(spark, "notes")
    sinks.annotations_import(notes(spark, d).limit(3), path)
    sinks.annotations_import(notes(spark, d), path)
    return spark.read.parquet(path).select(F.unix_micros("ts").alias("us"), "experiment", "type", "description")


@query("sink_delays", f"WITH {EV} SELECT event_type, CAST(us AS DOUBLE) AS time_samples, value AS delay_ns FROM ev WHERE k <> 0")
def sink_delays(spark: SparkSession, d: str) -> DataFrame:
    path = shared.new_folder(spark, "delays")
    sinks.write_delays(events(spark, d).withColumn("delay", F.when(F.col("k") != 0, F.col("value"))), path, "us", "delay", ["event_type"])
    return spark.read.parquet(path)


@query("sink_edges", f"WITH {EV} SELECT device, us, event_id FROM ev")
def sink_edges(spark: SparkSession, d: str) -> DataFrame:
    """The first half of the events written as edges, the second appended to them."""
    path, e = shared.new_folder(spark, "edges"), events(spark, d).select("device", "us", "event_id")
    middle = e.agg(F.expr("(min(us) + max(us)) div 2")).first()[0] or 0
    sinks.write_edges(e.where(F.col("us") < middle), path, ["device"], ["event_id"], "us")
    sinks.write_edges(e.where(F.col("us") >= middle), path, ["device"], ["event_id"], "us", append=True)
    return spark.read.parquet(path)


@query("delete_range", f"WITH {EV} SELECT event_id FROM ev WHERE NOT (us >= 1704672000000000 AND us < 1705276800000000 AND event_type = 'view')")
def delete_range(spark: SparkSession, d: str) -> DataFrame:
    return flux.without_range(events(spark, d), "us", 1704672000000000, 1705276800000000, event_type="view").select("event_id")


@query("experiment_log", f"""WITH {EV}, c AS (SELECT device, event_id AS ord, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'stop' ELSE 'event' END AS type, 'x' || k AS experiment FROM ev), s AS (SELECT *, CASE type WHEN 'start' THEN experiment WHEN 'stop' THEN '' END AS st FROM c),
 a AS (SELECT *, nullif(last_value(st IGNORE NULLS) OVER (PARTITION BY device ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS active FROM s)
 SELECT device, ord, 1 AS step, CASE type WHEN 'start' THEN experiment ELSE coalesce(active, 'unnamed') END AS experiment, type, '' AS description FROM a UNION ALL SELECT device, ord, 0, active, 'stop', 'auto' FROM a WHERE type = 'start' AND active IS NOT NULL""")
def experiment_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "stop").otherwise("event")
    c = events(spark, d).select("device", F.col("event_id").alias("ord"), kind.alias("type"), F.format_string("x%d", "k").alias("experiment"), F.lit(None).cast("string").alias("description"))
    return sinks.experiment_log(c, ["device"])


@query("f_range", f"WITH {EV} SELECT event_id, us FROM ev WHERE us >= 1704672000000000 AND us < 1705276800000000")
def f_range(spark: SparkSession, d: str) -> DataFrame:
    return flux.f_range(events(spark, d), "us", 1704672000000000, 1705276800000000).select("event_id", "us")


@query("f_relative", f"WITH {EV}, m AS (SELECT max(us) AS now FROM ev) SELECT event_id FROM ev, m WHERE us >= now - {3 * DAY} AND us < now - {6 * HOUR}")
def f_relative(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return flux.f_range(e, "us", "-3d", "-6h", e.agg(F.max("us")).first()[0] or 0).select("event_id")


@query("f_fields", f"WITH {EV} SELECT event_id FROM ev WHERE event_type IN ('click', 'view') AND device <> 3")
def f_fields(spark: SparkSession, d: str) -> DataFrame:
    return flux.f_tags(events(spark, d), eq={"event_type": ["click", "view"], "user_id": ""}, neq={"device": 3}).select("event_id")


@query("f_regex", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[05]$') AND regexp_matches(c_mktsegment, '^(BUILDING|HOUSEHOLD)$')")
def f_regex(spark: SparkSession, d: str) -> DataFrame:
    return flux.f_tags(read(spark, d, "customer"), regex={"c_name": "[05]$", "c_mktsegment": "^(BUILDING|HOUSEHOLD)$"}).select("c_custkey", "c_name")


@query("f_exists", f"WITH {EV} SELECT event_id FROM ev WHERE CASE WHEN k < 50 THEN k END IS NOT NULL")
def f_exists(spark: SparkSession, d: str) -> DataFrame:
    return flux.f_tags(events(spark, d).withColumn("tag", F.when(F.col("k") < 50, F.col("k"))), exists=["tag"]).select("event_id")


@query("m_units", f"WITH {EV} SELECT event_id, value / 1000 AS ns, value / 60 AS per_s, value * 8 AS bits, value + k AS high, value - k AS low FROM ev")
def m_units(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumns({"ns": F.col("value"), "per_s": F.col("value"), "bits": F.col("value")})
    e = flux.m_scale(flux.m_scale(flux.m_scale(e, "ns", div=1000), "per_s", div=60), "bits", mul=8)
    return e.select("event_id", "ns", "per_s", "bits", (F.col("value") + F.col("k")).alias("high"), (F.col("value") - F.col("k")).alias("low"))


@query("m_relabel", f"WITH {EV} SELECT event_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' ELSE 'other' END AS event_type, event_type || ' dev ' || device AS label FROM ev")
def m_relabel(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("label", F.concat_ws(" dev ", "event_type", F.col("device").cast("string")))
    return flux.m_relabel(e, "event_type", {"click": "A", "view": "B"}, "other").select("event_id", "event_type", "label")


@query("m_keep", f"WITH {EV} SELECT us AS _time, value AS _value, 'total' AS cpu FROM ev")
def m_keep(spark: SparkSession, d: str) -> DataFrame:
    return flux.m_keep(events(spark, d), {"_time": "us", "_value": "value", "cpu": F.lit("total")})


@query("clamp_i32", f"WITH {EV} SELECT event_id, CAST(greatest(-2147483648, least(2147483647, us - 1705000000000000)) AS INTEGER) AS rtt FROM ev")
def clamp_i32(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", units.clamp_int32(F.col("us") - 1705000000000000).alias("rtt"))


@query("pivot_fields", f"WITH {EV} SELECT device, us // {HOUR} AS hour, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM ev GROUP BY ALL")
def pivot_fields(spark: SparkSession, d: str) -> DataFrame:
    narrow = events(spark, d).groupBy("device", F.expr(f"us div {HOUR}").alias("hour"), "event_type").agg(F.max("value").alias("value"))
    return flux.pivot_fields(narrow, ["device", "hour"], "event_type", "value", ["click", "view"])


@query("unpivot_fields", f"WITH {FTM} SELECT device, session, i, u.field, u.value FROM f, LATERAL (SELECT 't1' AS field, t1 AS value UNION ALL SELECT 't2', t2 UNION ALL SELECT 't3', t3 UNION ALL SELECT 't4', t4) u")
def unpivot_fields(spark: SparkSession, d: str) -> DataFrame:
    return flux.unpivot_fields(ftm_entries(spark, d).select("device", "session", "i", "t1", "t2", "t3", "t4"), ["device", "session", "i"], ["t1", "t2", "t3", "t4"])


@query("unit_conv", f"WITH {EV} SELECT event_id, k * 25 AS ticks_ns, CAST(floor(us / 25.0) AS BIGINT) AS ticks, k + device / 65536 AS period, round(k / 1e7 * 1e9, 3) AS ns FROM ev")
def unit_conv(spark: SparkSession, d: str) -> DataFrame:
    units.register(spark)
    e = events(spark, d)
    return e.select("event_id", F.expr("ticks_to_ns(k)").alias("ticks_ns"), units.ns_to_ticks(F.col("us")).alias("ticks"), F.expr("fixed_period(CAST(k AS DOUBLE), CAST(device AS DOUBLE))").alias("period"), F.round(units.samples_to_ns(F.col("k"), 1e7), 3).alias("ns"))


@query("scalar_topic", "SELECT page_id, split_part(url, '/', 3) AS host, replace(split_part(url, '/', 3), '.', '_') AS field, CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END AS secure, regexp_extract(url, '/([0-9]+)', 1) AS number, instr(url, '\\') AS slash FROM pages")
def scalar_topic(spark: SparkSession, d: str) -> DataFrame:
    host = F.split("url", "/")[2]
    return read(spark, d, "pages").select("page_id", host.alias("host"), F.translate(host, ".", "_").alias("field"), F.when(F.startswith("url", F.lit("https")), 1).otherwise(0).alias("secure"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"), F.instr("url", "\\").cast("long").alias("slash"))


@query("scalar_time", f"WITH {EV} SELECT event_id, us // 60000000 AS minute, us * 1000 AS t_ns, us // 1000 AS ms, lpad(CAST(us // {HOUR} % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(us // 60000000 % 60 AS VARCHAR), 2, '0') AS label FROM ev")
def scalar_time(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.expr("TIMESTAMP_NTZ'1970-01-01' + make_dt_interval(0, 0, 0, us / 1e6)"))
    return events(spark, d).select("event_id", F.expr("us div 60000000").alias("minute"), (F.col("us") * 1000).alias("t_ns"), F.expr("us div 1000").alias("ms"), F.date_format(stamp, "HH:mm").alias("label"))


@query("scalar_json", f"WITH {EV} SELECT event_id, k, CAST(NULL AS VARCHAR) AS missing, '{{\"k\":' || k || ',\"t\":\"' || event_type || '\"}}' AS packed FROM ev")
def scalar_json(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), F.get_json_object("props", "$.none").alias("missing"), F.to_json(F.struct("k", F.col("event_type").alias("t"))).alias("packed"))


@query("scalar_map", f"WITH {EV} SELECT event_id, CAST(k AS DOUBLE) AS k, 0.0 AS d, 2 AS size FROM ev")
def scalar_map(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("k"), F.col("k"), F.lit("topic"), F.lit(1).cast("long"))
    kept = F.map_concat(F.map_filter(m, lambda n, v: n != "topic"), F.create_map(F.lit("site"), F.lit(1).cast("long")))
    floats = F.transform_values(kept, lambda n, v: v.cast("double"))
    return events(spark, d).select("event_id", floats["k"].alias("k"), F.coalesce(F.try_element_at(floats, F.lit("d")), F.lit(0.0)).alias("d"), F.size(floats).alias("size"))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as console lines: dated sessions, failed ones, times alone, noise; a file per user."""
    at = F.expr("TIMESTAMP_NTZ'1970-01-01' + make_dt_interval(0, 0, 0, us / 1e6)")
    body = F.when(F.col("k") % 10 == 0, F.format_string("FTM,%d,250,0,,,,,,", "event_id")).otherwise(F.format_string("FTM,%d,0,%d,%d,%d,%d,-%d,-80,-20", "event_id", F.col("k") % 65, "k", F.col("k") - 1, F.col("k") + 1, F.col("k") % 60))
    line = F.when(F.col("event_type") == "error", F.lit("boot: ready")).when(F.col("event_type") == "view", F.concat(F.date_format(at, "HH:mm:ss"), F.lit(" "), body)).otherwise(F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("] "), body))
    lines = events(spark, d).select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return shared.saved(lines, "lines")


@query("log_ftm", f"""WITH {EV}, b AS (SELECT *, us // {DAY} AS day, first_value(CASE WHEN event_type NOT IN ('view', 'error') THEN us // {DAY} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS base FROM ev)
 SELECT CAST(user_id AS VARCHAR) AS file, event_id AS line_no, CASE WHEN event_type = 'view' THEN base * {DAY} + us % {DAY} // 1000000 * 1000000 ELSE us END AS us, CASE WHEN k % 10 = 0 THEN 250 ELSE 0 END AS status, CASE WHEN k % 10 = 0 THEN 0 ELSE k % 65 END AS entries, CASE WHEN k % 10 <> 0 THEN k END AS rtt_avg, CASE WHEN k % 10 <> 0 THEN -(k % 60) END AS rssi_avg FROM b WHERE event_type <> 'error'""")
def log_ftm(spark: SparkSession, d: str) -> DataFrame:
    out = logs.parse_ftm_log(log_lines(spark, d))
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return out.select("file", "line_no", us.alias("us"), "status", "entries", "rtt_avg", "rssi_avg")


@query("log_device", f"WITH {EV} SELECT event_id AS line_no, event_id AS run, k AS \"offset\", k - 14 AS min, k + 14 AS max FROM ev WHERE event_type = 'click'")
def log_device(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    line = F.when(F.col("event_type") == "click", F.format_string("I (12) MAC_TIMER_ALIGN,%d,%d,%d,%d", "event_id", "k", F.col("k") - 14, F.col("k") + 14)).when(F.col("event_type") == "view", F.lit("MAC_TIMER_ALIGN,run,offset,min,max")).otherwise(F.lit("MAC_TIMER_ALIGN,1,2"))
    lines = e.select(F.lit("console").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return logs.parse_device_log(lines, "MAC_TIMER_ALIGN").drop("file")


def _console(spark: SparkSession, d: str, tag: str, form: str, *fields: object) -> DataFrame:
    """Clicks as console records; views as headers and the rest as broken ones."""
    line = F.when(F.col("event_type") == "click", F.format_string(f"I (12) {tag}," + form, *fields)).when(F.col("event_type") == "view", F.lit(f"{tag},a,b")).otherwise(F.lit(f"{tag},1"))
    return logs.parse_device_log(events(spark, d).select(F.lit("console").alias("file"), F.col("event_id").alias("line_no"), line.alias("line")), tag).drop("file")


@query("log_regr", f"WITH {EV} SELECT event_id AS line_no, k AS new, event_id AS session, k % 128 AS n, k / 64 AS slope_m1, k / 16 AS std_ns, k / 128 AS r2, us AS local_ref, us + k AS remote_ref FROM ev WHERE event_type = 'click'")
def log_regr(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return _console(spark, d, "REGR", "%d,%d,%d,%s,%s,%s,%d,%d", "k", "event_id", k % 128, (k / 64).cast("string"), (k / 16).cast("string"), (k / 128).cast("string"), "us", F.col("us") + k)


@query("log_dtc", f"WITH {EV} SELECT event_id AS line_no, event_id AS cycle, us AS local_ticks, k * 65536 AS base_period_fp16 FROM ev WHERE event_type = 'click'")
def log_dtc(spark: SparkSession, d: str) -> DataFrame:
    return _console(spark, d, "DTC", "%d,%d,%d", "event_id", "us", F.col("k") * 65536)


@query("log_dtr", f"WITH {EV} SELECT event_id AS line_no, event_id AS cycle, k % 3 AS cycle_delta, k * 40 AS period_ticks, k - 50 AS period_ticks_delta FROM ev WHERE event_type = 'click'")
def log_dtr(spark: SparkSession, d: str) -> DataFrame:
    return _console(spark, d, "DTR", "%d,%d,%d,%d", "event_id", F.col("k") % 3, F.col("k") * 40, F.col("k") - 50)


@query("panel_clock_offset", f"WITH {FTM}, o AS (SELECT device, session % 97 AS minute, (min(t2) - min(t1) + min(t3) - min(t4)) / 2.0 / 1000 AS offset_ns FROM f WHERE device IN (1, 2, 5) GROUP BY device, session, i) SELECT device, (minute // 5 + 1) * 5 AS window_end, round(avg(offset_ns), 6) AS value FROM o GROUP BY ALL")
def panel_clock_offset(spark: SparkSession, d: str) -> DataFrame:
    """The clock-offset panel: chosen devices, fields pivoted beside each other, the offset in ns, its mean per window."""
    f = ftm_entries(spark, d).withColumn("minute", F.col("session") % 97)
    narrow = flux.f_tags(f, eq={"device": [1, 2, 5]}).unpivot(["device", "session", "i", "minute"], ["t1", "t2", "t3", "t4"], "field", "value")
    narrow = narrow.groupBy("device", "session", "i", "minute", "field").agg(F.min("value").alias("value"))
    wide = flux.pivot_fields(narrow, ["device", "session", "i", "minute"], "field", "value", ["t1", "t2", "t3", "t4"])
    offset = wide.withColumn("offset_ns", F.expr("(t2 - t1 + t3 - t4) / 2"))
    return flux.agg_window(flux.m_scale(offset, "offset_ns", div=1000), "minute", 5, "mean", ["device"], "offset_ns").select("device", "window_end", F.round("value", 6).alias("value"))


@query("remote_at_t2", f"WITH {FTM} SELECT device, session, i, t1 + ((t4 - t1) - (t3 - t2)) // 2 AS remote FROM f")
def remote_at_t2(spark: SparkSession, d: str) -> DataFrame:
    f = ftm_entries(spark, d)
    return f.select("device", "session", "i", units.remote_time(F.col("t1"), (F.col("t4") - F.col("t1")) - (F.col("t3") - F.col("t2"))).alias("remote"))


@query("edge_choice", f"WITH {EV} SELECT event_id, 'rising' AS kind FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'both' FROM ev WHERE event_id % 2 = 1")
def edge_choice(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", (F.col("event_id") % 2).alias("edge_type"))
    kinds = [units.edge_choice(e, k).select("event_id", F.lit(k).alias("kind")) for k in ("rising", "both")]
    return kinds[0].unionByName(kinds[1])
