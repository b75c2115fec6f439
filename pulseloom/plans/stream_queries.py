"""Streams and binary sources over data that Spark derives from the events."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import detect
from ..operators.scale import prefix
from ..sources import binary, logs, shared, telemetry
from ..streaming import minutes, streams
from . import ordered_queries
from .ordered_queries import APART, THRESHOLD, _debounced
from .registry import DAY, EV, HOUR, ORACLES, events, query
from .statistics_queries import TOL

_EDGE, _DELAY, _IQ = "<dB7x", "<dd", "<ff"


def _written(df: DataFrame, folder: str, name: str, pack: Callable[[tuple], bytes], channels: bool = False) -> str:
    """Rows of df as binary files in `folder`: one per task, or with `channels` one for each value of the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = pafs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        task, n, at, out = TaskContext.get(), 0, None, None
        temporary = f"{root}/{task.partitionId():05d}.{task.taskAttemptId()}.part"

        def close() -> None:
            out.close()
            place.move(temporary, f"{root}/{name.format(at)}" if channels else f"{root}/{task.partitionId():05d}_{name}")

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = row[0] if channels else 0
                if out is None or key != at:
                    if out is not None:
                        close()
                    out, at = place.open_output_stream(temporary), key
                out.write(pack(row[1:] if channels else row))
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([{"n": n}], pa.schema([("n", pa.int64())]))

    df.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


#: Captures of clicks on so many channels, in the order of their ids.
CHANNELS = 16
_CLICKS = f"WITH {EV}, c AS (SELECT CAST(user_id % {CHANNELS} AS INTEGER) AS channel, row_number() OVER (PARTITION BY user_id % {CHANNELS} ORDER BY event_id) - 1 AS rec, CAST(us AS DOUBLE) AS t, CAST(event_id % 2 AS TINYINT) AS edge_type FROM ev WHERE event_type = 'click')"


def _channels(df: DataFrame) -> DataFrame:
    """df(channel, event_id, ...) with each channel's rows in one task, in order."""
    return df.repartition(CHANNELS, "channel").sortWithinPartitions("channel", "event_id").drop("event_id")


def _edges(spark: SparkSession, d: str) -> str:
    e = events(spark, d).where("event_type = 'click'").select((F.col("user_id") % CHANNELS).alias("channel"), "event_id", F.col("us").cast("double"), (F.col("event_id") % 2).cast("int"))
    return _written(_channels(e), shared.new_folder(spark, "edges"), "edges_ch{}.bin", lambda r: struct.pack(_EDGE, *r), channels=True)


@query("src_edges_v1", f"{_CLICKS} SELECT channel, t, edge_type FROM c")
def src_edges_v1(spark: SparkSession, d: str) -> DataFrame:
    return binary.read_edges(spark, _edges(spark, d)).select("channel", "t", "edge_type")


@query("src_edges_range", f"{_CLICKS} SELECT channel, rec, t, edge_type FROM c WHERE rec >= 10 AND rec < 100")
def src_edges_range(spark: SparkSession, d: str) -> DataFrame:
    return binary.read_edges(spark, _edges(spark, d), 10, 100).select("channel", "rec", "t", "edge_type")


@query("src_edges_where", f"{_CLICKS} SELECT channel, rec, t, edge_type FROM c WHERE rec BETWEEN 5 AND 40 AND channel IN (1, 3)")
def src_edges_where(spark: SparkSession, d: str) -> DataFrame:
    """A record range and channels as filters, which the source takes."""
    return binary.read_edges(spark, _edges(spark, d)).where("rec between 5 and 40 and channel in (1, 3)").select("channel", "rec", "t", "edge_type")


@query("src_edges_tail_limited", f"{_CLICKS} SELECT 'edges_ch' || channel || '.bin' AS file, channel, rec, t, edge_type FROM c")
def src_edges_tail_limited(spark: SparkSession, d: str) -> DataFrame:
    """Growing captures, a tenth of the clicks in a batch."""
    clicks = events(spark, d).where("event_type = 'click'").count()
    return streams.run_tail(binary.tail_edges(spark, _edges(spark, d), max(1, -(-clicks // 10))), shared.new_folder(spark, "tail"))


@query("src_edges_tail", f"{_CLICKS} SELECT 'edges_ch' || channel || '.bin' AS file, channel, rec, t, edge_type FROM c")
def src_edges_tail(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_to_table(binary.tail_edges(spark, _edges(spark, d)), shared.new_folder(spark, "tail"))


@query("src_edges_v2", f"WITH {EV}, c AS (SELECT user_id % {CHANNELS} AS channel, event_id, row_number() OVER (PARTITION BY user_id % {CHANNELS} ORDER BY event_id) - 1 AS rec, value, k FROM ev) SELECT rec, event_id AS trigger_idx, CAST(event_id % 2 AS TINYINT) AS edge_type, CAST(value AS FLOAT) AS peak, i AS off, CAST(CASE i WHEN 0 THEN value ELSE coalesce(k, 0) END AS FLOAT) AS v FROM c, (SELECT unnest([0, 1]) AS i)")
def src_edges_v2(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select((F.col("user_id") % CHANNELS).alias("channel"), "event_id", F.col("event_id").alias("at"), (F.col("event_id") % 2).cast("int"), F.col("value").cast("double"), F.col("k"))
    folder = _written(_channels(e), shared.new_folder(spark, "edges"), "edges_v2_ch{}.bin", lambda r: struct.pack(binary.V2_HEADER, r[0], r[1], 2, r[2]) + struct.pack(binary.V2_POINT, 0, r[2]) + struct.pack(binary.V2_POINT, 1, float(r[3] or 0)), channels=True)
    return binary.read_edges_v2(spark, folder).select("rec", "trigger_idx", "edge_type", "peak", F.inline("points")).withColumn("off", F.col("off").cast("int"))


@query("src_delays", "SELECT CAST(event_id AS DOUBLE) AS t, value AS delay_ns FROM events WHERE event_type = 'view'")
def src_delays(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("event_type = 'view'").select(F.col("event_id").cast("double"), F.col("value").cast("double"))
    return binary.read_delays(spark, _written(e, shared.new_folder(spark, "delays"), "delays.bin", lambda r: struct.pack(_DELAY, *r))).select("t", "delay_ns")


@query("src_iq", "SELECT CAST(value AS FLOAT) AS a, CAST(event_id AS FLOAT) AS b FROM events")
def src_iq(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("value").cast("double"), F.col("event_id").cast("double"))
    return binary.read_iq(spark, _written(e, shared.new_folder(spark, "iq"), "capture.bin", lambda r: struct.pack(_IQ, *r))).select("a", "b")


@query("src_iq_skip", f"WITH {EV}, c AS (SELECT user_id % {CHANNELS} AS channel, event_id, row_number() OVER (PARTITION BY user_id % {CHANNELS} ORDER BY event_id) - 1 AS idx FROM ev) SELECT idx, CAST(event_id AS FLOAT) AS a FROM c WHERE idx >= 20")
def src_iq_skip(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each capture after its first two seconds, at ten a second."""
    e = events(spark, d).select((F.col("user_id") % CHANNELS).alias("channel"), "event_id", F.col("event_id").cast("double").alias("a"), F.col("value").cast("double"))
    return binary.read_iq(spark, _written(_channels(e), shared.new_folder(spark, "iq"), "capture{}.bin", lambda r: struct.pack(_IQ, *r), channels=True), 2, 10).select("idx", "a")


@query("src_lines", f"WITH {EV}, c AS (SELECT user_id % {CHANNELS} AS channel, event_id, k, row_number() OVER (PARTITION BY user_id % {CHANNELS} ORDER BY event_id) - 1 AS line_no FROM ev) SELECT channel, line_no, 'I (' || event_id || ') FTM,' || k AS line FROM c WHERE event_id % 5 > 0")
def src_lines(spark: SparkSession, d: str) -> DataFrame:
    """Console logs, one file a channel, with every fifth line empty."""
    folder = shared.new_folder(spark, "lines")
    line = F.when(F.col("event_id") % 5 > 0, F.format_string("I (%d) FTM,%d", "event_id", "k")).otherwise(F.lit(""))
    e = events(spark, d).select((F.col("user_id") % CHANNELS).alias("channel"), "event_id", line.alias("value"))
    e.repartition(CHANNELS, "channel").sortWithinPartitions("channel", "event_id").drop("event_id").write.partitionBy("channel").text(folder)
    return logs.read_lines(spark, folder).select(F.regexp_extract("file", r"channel=(\d+)/", 1).cast("long").alias("channel"), "line_no", "line")


@query("src_meta", "SELECT CAST(2e6 AS DOUBLE) AS sample_rate, count(*) AS samples, CAST(10000000 AS BIGINT) AS freq FROM events")
def src_meta(spark: SparkSession, d: str) -> DataFrame:
    folder = shared.new_folder(spark, "meta")
    events(spark, d).groupBy(F.lit(10_000_000).alias("freq")).agg(F.count("*").alias("samples"), F.lit(2e6).alias("sample_rate")).select("sample_rate", "samples", "freq").coalesce(1).write.json(folder)
    return logs.read_meta(spark, folder)


def _annotations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Signups as annotation files, every seventh one without its time; good and bad rows as read back."""
    folder = shared.new_folder(spark, "annotations")
    time = F.when(F.col("event_id") % 7 > 0, F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    rows = events(spark, d).where("event_type = 'signup'").select(time.alias("time"), F.format_string("user%d", "user_id").alias("experiment"), F.lit("event").alias("type"), F.format_string("k=%d", "k").alias("description"))
    rows.groupBy((F.crc32(F.col("experiment").cast("binary")) % 4).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.partitionBy("part").text(folder)
    return logs.read_annotations(spark, folder)


@query("src_annotations", f"WITH {EV} SELECT us, 'user' || user_id AS experiment, 'event' AS type, 'k=' || k AS description FROM ev WHERE event_type = 'signup' AND event_id % 7 > 0")
def src_annotations(spark: SparkSession, d: str) -> DataFrame:
    return _annotations(spark, d)[0].select(F.unix_micros("ts").alias("us"), "experiment", "type", "description")


@query("src_annotations_rejected", f"WITH {EV} SELECT 'user' || user_id AS experiment, 'event' AS type, 'k=' || k AS description FROM ev WHERE event_type = 'signup' AND event_id % 7 = 0")
def src_annotations_rejected(spark: SparkSession, d: str) -> DataFrame:
    return _annotations(spark, d)[1].select("experiment", "type", "description")


def _stream(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a stream of files."""
    folder = shared.new_folder(spark, name)
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(folder)


HOLD = 2 * TOL
#: Clicks and views of each device, debounced to five tolerances, where the two-pointer rule equals the plain join.
_EDGES = f"""{EV}, c AS (SELECT device, event_type, us, row_number() OVER (PARTITION BY device, event_type ORDER BY us, event_id) AS rn FROM ev WHERE event_type IN ('click', 'view')),
 w AS (SELECT device, event_type, us, rn, us AS last, true AS keep FROM c WHERE rn = 1 UNION ALL SELECT c.device, c.event_type, c.us, c.rn, CASE WHEN c.us - w.last >= {5 * TOL} THEN c.us ELSE w.last END, c.us - w.last >= {5 * TOL} FROM w JOIN c ON c.device = w.device AND c.event_type = w.event_type AND c.rn = w.rn + 1),
 e AS (SELECT device, event_type, us FROM w WHERE keep), a AS (SELECT device, us AS us_a FROM e WHERE event_type = 'click'), b AS (SELECT device, us AS us_b FROM e WHERE event_type = 'view'), p AS (SELECT a.device, us_a, us_b FROM a JOIN b ON a.device = b.device AND abs(us_b - us_a) <= {TOL}),
 m AS (SELECT device AS capture_id, us_a, us_b, us_b - us_a AS delay_us, 'matched' AS status FROM p UNION ALL SELECT device, us_a, NULL, NULL, 'unmatched_a' FROM a ANTI JOIN p USING (device, us_a) UNION ALL SELECT device, NULL, us_b, NULL, 'unmatched_b' FROM b ANTI JOIN p USING (device, us_b))"""


def device_edges(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("event_type in ('click', 'view')").select(F.col("device").alias("capture_id"), F.when(F.col("event_type") == "click", "a").otherwise("b").alias("side"), "us", "event_id")
    return detect.debounce(e, ["capture_id", "side"], ["us", "event_id"], "us", 5 * TOL, DAY).select("capture_id", "side", "us")


def _captures(edges: DataFrame) -> int:
    return edges.select("capture_id").distinct().count()


@query("stream_match", f"WITH RECURSIVE {_EDGES}, l AS (SELECT device, max(us) AS last FROM e GROUP BY 1) SELECT m.* FROM m JOIN l ON capture_id = device WHERE least(coalesce(us_a, us_b), coalesce(us_b, us_a)) <= last - {HOLD}")
def stream_match(spark: SparkSession, d: str) -> DataFrame:
    edges = shared.saved(device_edges(spark, d), "edges")
    stream = _ordered_stream(spark, edges, "edges", "capture_id", "us", 6 * DAY)
    return streams.run_to_table(streams.stream_match(stream, "capture_id", TOL, HOLD), shared.new_folder(spark, "match"), keys=_captures(edges))


@query("stream_match_finalize", f"WITH RECURSIVE {_EDGES} SELECT * FROM m")
def stream_match_finalize(spark: SparkSession, d: str) -> DataFrame:
    """A stopped stream's decisions, and those on what its state still held."""
    edges, folder = shared.saved(device_edges(spark, d), "edges"), shared.new_folder(spark, "match")
    done = streams.run_to_table(streams.stream_match(_ordered_stream(spark, edges, "edges", "capture_id", "us", 6 * DAY), "capture_id", TOL, HOLD), folder, keys=_captures(edges))
    return done.unionByName(streams.finish_matches(spark, folder, "capture_id", TOL))


#: Parts of the data that arrive one after the other.
PARTS = 4


@query("stream_match_timed", f"WITH RECURSIVE {_EDGES} SELECT * FROM m")
def stream_match_timed(spark: SparkSession, d: str) -> DataFrame:
    """As stream_match_finalize, but silent devices are decided by the clock of all, and the query is stopped after each part."""
    edges, source, folder = shared.saved(device_edges(spark, d), "edges"), shared.new_folder(spark, "edges"), shared.new_folder(spark, "match")
    first, last = edges.agg(F.min("us"), F.max("us")).first()
    keys = _captures(edges)
    part = F.least(F.floor((F.col("us") - (first or 0)) * PARTS / ((last or 0) - (first or 0) + 1)), F.lit(PARTS - 1))
    for k in range(PARTS):
        # A part is one batch, as the clock must not run ahead of edges that come with it.
        edges.where(part == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(edges.schema).parquet(source)
        done = streams.run_to_table(streams.stream_match(stream, "capture_id", TOL, HOLD, 2 * HOLD), folder, keys=keys)
    return done.unionByName(streams.finish_matches(spark, folder, "capture_id", TOL))


_STATS = ("mean", "std", "max_dev", "p50", "p95", "p99", "p999")
_WINDOWS = f"""WITH {EV}, x AS (SELECT us // {HOUR} * {HOUR} AS window_start, value AS delay, avg(value) OVER (PARTITION BY us // {HOUR}) AS mu FROM ev), y AS (SELECT *, abs(delay - mu) AS dev FROM x),
 g AS (SELECT window_start, count(*) AS n, round(avg(delay), 9) AS mean, round(stddev_pop(delay), 9) AS std, min(delay) AS min, max(delay) AS max, round(max(dev), 9) AS max_dev, round(quantile_cont(dev, 0.5), 9) AS p50, round(quantile_cont(dev, 0.95), 9) AS p95, round(quantile_cont(dev, 0.99), 9) AS p99, round(quantile_cont(dev, 0.999), 9) AS p999 FROM y GROUP BY 1),
 f AS (SELECT g.* FROM g WHERE n >= 2 AND window_start > (SELECT min(us) FROM ev))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in _STATS})


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """The stream of closed hours of event values, its pairs as a table, and the start of the data."""
    e = events(spark, d)
    pairs = e.select(F.timestamp_micros("us").alias("ts"), "us", F.col("value").alias("delay"))
    start = e.agg(F.min("us")).first()[0] or 0
    return minutes.stream_minute_stats(_ordered_stream(spark, pairs, "pairs", "us", "us", 6 * DAY), "ts", "delay", "1 hour", 2, "1 hour", start), pairs, start


@query("stream_minute", f"{_WINDOWS} SELECT * FROM f WHERE window_start + {2 * HOUR} <= (SELECT max(us) FROM ev)")
def stream_minute(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(streams.run_to_table(_windows(spark, d)[0], shared.new_folder(spark, "minutes")))


@query("stream_minute_hook", f"{_WINDOWS} SELECT * FROM f WHERE window_start + {2 * HOUR} <= (SELECT max(us) FROM ev)")
def stream_minute_hook(spark: SparkSession, d: str) -> DataFrame:
    """Closed windows as a hook gets them, batch by batch."""
    folder = shared.new_folder(spark, "hook")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    minutes.run_minutes(_windows(spark, d)[0], folder, put)
    return _rounded(spark.read.parquet(f"{folder}/out").drop("batch"))


@query("stream_finalize", f"{_WINDOWS} SELECT * FROM f")
def stream_finalize(spark: SparkSession, d: str) -> DataFrame:
    """A stopped stream's closed windows, and those that it still held open."""
    windows, pairs, start = _windows(spark, d)
    closed = streams.run_to_table(windows, shared.new_folder(spark, "minutes"))
    return _rounded(closed.unionByName(minutes.open_windows(closed, pairs, "ts", "delay", "1 hour", 2, start)))


def user_signals(spark: SparkSession, d: str) -> DataFrame:
    """series, idx, v, us: the event values of each user about their middle, as signals of their own."""
    e = events(spark, d).select(F.col("user_id").cast("string").alias("series"), "us", "event_id", (F.col("value") - 50).alias("v"))
    return prefix(e, ["series"], ["us", "event_id"], DAY, rn="idx").select("series", "idx", "v", "us")


def _ordered_stream(spark: SparkSession, df: DataFrame, name: str, key: str, t: str, width: int) -> DataFrame:
    """df as a stream of files in the order of t: one part of `width` after the other, a key's rows of it in one file.

    df is computed once and kept by part, so a part is written from its own rows.
    """
    folder, kept = shared.new_folder(spark, name), shared.new_folder(spark, f"{name}-parts")
    df.withColumn("_part", F.expr(f"{t} div {width}")).where("_part is not null").write.partitionBy("_part").parquet(kept)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.LongType())])).parquet(kept)
    df.limit(0).write.parquet(folder)
    for (k,) in sorted(rows.select("_part").distinct().collect()):
        # The source takes files by their time, so a part is written whole before the next one begins.
        rows.where(F.col("_part") == k).drop("_part").repartition(4, key).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(folder)


def _crossings(samples: str) -> str:
    """SQL of the debounced crossings of each series of samples(series, idx, v), series being a number."""
    near = f"SELECT series, idx, v, lag(v) OVER (PARTITION BY series ORDER BY idx) AS p FROM ({samples})"
    both = f"SELECT series * 2 AS k, idx - 1 + (-{THRESHOLD} - p) / (v - p) AS t, 0 AS h FROM x WHERE p > -{THRESHOLD} AND v <= -{THRESHOLD} UNION ALL SELECT series * 2 + 1, idx - 1 + ({THRESHOLD} - p) / (v - p), 0 FROM x WHERE p < {THRESHOLD} AND v >= {THRESHOLD}"
    return f"WITH RECURSIVE {EV}, x AS ({near}), " + _debounced(both, "SELECT CAST(k // 2 AS VARCHAR) AS series, round(t, 6) AS t, CAST(k % 2 AS INTEGER) AS edge_type FROM w WHERE keep")


_USERS = "SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS idx, value - 50 AS v FROM ev"
SKIP, RESET = 10, 5.0


@query("stream_detect", _crossings(_USERS))
def stream_detect(spark: SparkSession, d: str) -> DataFrame:
    samples = _ordered_stream(spark, user_signals(spark, d), "samples", "series", "us", 6 * DAY)
    out = streams.run_to_table(streams.stream_detect(samples.select("series", "idx", "v"), "series", THRESHOLD, APART), shared.new_folder(spark, "detect"))
    return out.withColumn("t", F.round("t", 6))


@query("stream_detect_settled", _crossings(f"SELECT s.* FROM ({_USERS}) s JOIN (SELECT series, min(idx) AS start FROM ({_USERS}) WHERE idx >= {SKIP} AND abs(v) < {RESET} GROUP BY 1) f ON s.series = f.series AND idx >= start"))
def stream_detect_settled(spark: SparkSession, d: str) -> DataFrame:
    """stream_detect after a skipped start and a first calm sample."""
    samples = _ordered_stream(spark, user_signals(spark, d), "samples", "series", "us", 6 * DAY)
    out = streams.run_to_table(streams.stream_detect(samples.select("series", "idx", "v"), "series", THRESHOLD, APART, SKIP, RESET), shared.new_folder(spark, "detect"))
    return out.withColumn("t", F.round("t", 6))


#: Samples of a part at most: a task of the stream holds those of a batch.
SAMPLES = 1 << 20


def _signal_stream(spark: SparkSession, d: str, method: str, rounded: bool = True, **levels: float) -> DataFrame:
    """The edges of the one long signal as a stream, and those its state held at the end."""
    s, folder = shared.saved(ordered_queries.signal(spark, d).select("series", "idx", "v"), "signal"), shared.new_folder(spark, "detect")
    width = max(1, min(SAMPLES, -(-(s.agg(F.max("idx")).first()[0] or 0) // PARTS)))
    out = streams.run_to_table(streams.stream_detect_ahead(_ordered_stream(spark, s, "samples", "series", "idx", width), "series", method, THRESHOLD, **levels), folder)
    out = out.unionByName(streams.finish_detect(spark, folder, "series", method, THRESHOLD, **levels))
    return out.withColumn("t", F.round("t", 6)).withColumn("height", F.round("height", 6)) if rounded else out


@query("stream_detect_peaks", ORACLES["detect_peaks"])
def stream_detect_peaks(spark: SparkSession, d: str) -> DataFrame:
    return _signal_stream(spark, d, "peaks", min_distance=APART).drop("idx")


@query("stream_detect_hysteresis", ORACLES["detect_hysteresis"])
def stream_detect_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return _signal_stream(spark, d, "hysteresis", reset=10).select("series", "idx", "edge_type")


@query("stream_detect_linreg", ORACLES["detect_linreg"])
def stream_detect_linreg(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the stream, debounced in the order of their times: of so rough a signal that isn't the order of samples."""
    found = _signal_stream(spark, d, "linreg", rounded=False)
    kept = detect.debounce(found, ["series", "edge_type"], ["t", "idx"], "t", APART)
    return kept.withColumn("t", F.round("t", 6)).withColumn("height", F.round("height", 6)).drop("idx")


@query("stream_match_hook", ORACLES["stream_match"])
def stream_match_hook(spark: SparkSession, d: str) -> DataFrame:
    """Decided edges as a hook gets them, batch by batch."""
    folder = shared.new_folder(spark, "hook")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    edges = shared.saved(device_edges(spark, d), "edges")
    stream = _ordered_stream(spark, edges, "edges", "capture_id", "us", 6 * DAY)
    streams.run_hook(streams.stream_match(stream, "capture_id", TOL, HOLD), folder, put, keys=_captures(edges))
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("stream_route", f"WITH {EV} SELECT 'fts/' || device || '/' || event_type AS topic, props AS payload, us AS arrival, event_type AS measurement, CASE WHEN event_type IN ('click', 'view') THEN 'fts' ELSE 'health' END AS bucket FROM ev")
def stream_route(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.format_string("fts/%d/%s", "device", "event_type").alias("topic"), F.col("props").alias("payload"), F.col("us").alias("arrival"))
    routed = streams.run_routed(_stream(spark, e, "raw"), shared.new_folder(spark, "route"), lambda b: telemetry.route_bucket(b.withColumn("measurement", F.element_at(F.split("topic", "/"), -1)), "^(click|view)$"), "bucket")
    return routed.select("topic", "payload", "arrival", "measurement", "bucket")


@query("stream_stamped", f"WITH {EV} SELECT event_id, 'fts_ts/dev' || device || '/' || event_type AS topic, CASE WHEN k < 50 THEN us * 1000 END AS own_ns, k < 50 OR k IS NULL AS has_own FROM ev")
def stream_stamped(spark: SparkSession, d: str) -> DataFrame:
    """Messages stamped as they arrive; those with a time of their own keep it, the others have their arrival."""
    own = F.coalesce(F.col("k") < 50, F.lit(True))
    e = events(spark, d).select("event_id", F.format_string("fts/dev%d/%s", "device", "event_type").alias("topic"), F.when(own, F.to_json(F.struct((F.col("us") / 1e6).alias("ts")))).otherwise(F.lit("{}")).alias("payload"))
    out = streams.run_stamped(_stream(spark, e, "raw"), shared.new_folder(spark, "stamped"))
    kept = F.col("t_ns") != F.col("arrival")
    return out.select("event_id", "topic", F.when(kept, F.col("t_ns")).alias("own_ns"), kept.alias("has_own"))


@query("stream_dedup", f"WITH {EV} SELECT event_id, us, value FROM ev")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", F.timestamp_micros("us").alias("ts"), "value")
    twice = e.unionByName(e.where("event_id % 3 = 0"))
    out = streams.run_to_table(streams.stream_dedup(_stream(spark, twice, "twice"), ["event_id"], "ts", "40 days"), shared.new_folder(spark, "dedup"))
    return out.select("event_id", F.unix_micros("ts").alias("us"), "value")


@query("detect_equals_stream", _crossings(_USERS))
def detect_batch(spark: SparkSession, d: str) -> DataFrame:
    """The batch side of stream_detect."""
    return detect.detect_crossings(user_signals(spark, d), ["series"], "idx", "v", THRESHOLD, APART, 1024).withColumn("t", F.round("t", 6))
