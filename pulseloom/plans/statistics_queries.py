"""Statistics over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands, match, scale, stats
from ..operators.scale import prefix
from .registry import DAY, EV, HOUR, SECOND, events, query, read

TOL = 60 * SECOND
ROUND = 6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, ROUND).alias(c) if c in names else F.col(c) for c in df.columns])


def clicks_and_views(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d)
    return e.where("event_type = 'click'").select(F.col("us").alias("t_a"), F.col("event_id").alias("id_a")), e.where("event_type = 'view'").select(F.col("us").alias("t_b"), F.col("event_id").alias("id_b"))


PAIRS = f"{EV}, pairs AS (SELECT a.us AS t_a, b.us AS t_b, a.event_id AS id_a, b.event_id AS id_b, b.us - a.us AS delay FROM ev a JOIN ev b ON a.event_type = 'click' AND b.event_type = 'view' AND b.us BETWEEN a.us - {TOL} AND a.us + {TOL})"
_JITTER = """round(avg(delay), 6) AS mean, round(stddev_pop(delay), 6) AS std, min(delay) AS min, max(delay) AS max, round(max(dev), 6) AS max_dev,
 round(quantile_cont(dev, 0.5), 6) AS p50, round(quantile_cont(dev, 0.95), 6) AS p95, round(quantile_cont(dev, 0.99), 6) AS p99, round(quantile_cont(dev, 0.999), 6) AS p999"""
_STATS = ("mean", "std", "max_dev", "p50", "p95", "p99", "p999")


@query("jitter_stats", f"WITH {PAIRS}, m AS (SELECT *, t_a // {DAY} AS day FROM pairs), c AS (SELECT *, abs(delay - avg(delay) OVER (PARTITION BY day)) AS dev FROM m) SELECT day, count(*) AS n, {_JITTER} FROM c GROUP BY day")
def jitter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bands.band_jitter(*clicks_and_views(spark, d), "t_a", "t_b", TOL, DAY, [], []).withColumnRenamed("bucket", "day"), *_STATS)


@query("jitter_stats_all", f"WITH c AS (SELECT l_quantity AS delay, abs(l_quantity - avg(l_quantity) OVER ()) AS dev FROM lineitem) SELECT count(*) AS n, {_JITTER}, round(avg(delay) * 1e-9 * 2000 * 360, 9) AS phase_mean_deg, round(stddev_pop(delay) * 1e-9 * 2000 * 360, 9) AS phase_std_deg FROM c")
def jitter_all(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(stats.jitter_stats(read(spark, d, "lineitem"), "l_quantity", [], 2000), *_STATS)
    return out.withColumn("phase_mean_deg", F.round("phase_mean_deg", 9)).withColumn("phase_std_deg", F.round("phase_std_deg", 9))


@query("compare_runs", f"WITH m AS (SELECT l_returnflag, l_linestatus, l_quantity AS delay FROM lineitem), c AS (SELECT *, abs(delay - avg(delay) OVER (PARTITION BY l_returnflag, l_linestatus)) AS dev FROM m) SELECT l_returnflag, l_linestatus, count(*) AS n, {_JITTER} FROM c GROUP BY ALL")
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.jitter_stats(read(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]), *_STATS)


@query("tolerance_join", f"WITH {PAIRS} SELECT * FROM pairs")
def tolerance_join(spark: SparkSession, d: str) -> DataFrame:
    return scale.band_join(*clicks_and_views(spark, d), "t_a", "t_b", TOL).select("t_a", "t_b", "id_a", "id_b", (F.col("t_b") - F.col("t_a")).alias("delay"))


@query("phase_error", f"WITH {PAIRS} SELECT id_a, id_b, round(delay / 1e6 * 0.001 * 360, 9) AS degrees FROM pairs")
def phase_error(spark: SparkSession, d: str) -> DataFrame:
    pairs = scale.band_join(*clicks_and_views(spark, d), "t_a", "t_b", TOL)
    return pairs.select("id_a", "id_b", F.round(stats.phase_degrees((F.col("t_b") - F.col("t_a")) / 1e6, 0.001), 9).alias("degrees"))


@query("unmatched", f"""WITH {EV}, a AS (SELECT us FROM ev WHERE event_type = 'click'), b AS (SELECT us FROM ev WHERE event_type = 'view')
 SELECT 'a' AS side, us AS t FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE abs(b.us - a.us) <= {TOL}) UNION ALL SELECT 'b', us FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE abs(b.us - a.us) <= {TOL})""")
def unmatched(spark: SparkSession, d: str) -> DataFrame:
    a, b = clicks_and_views(spark, d)
    return match.unmatched(a, b, "t_a", "t_b", TOL)


_PERIODS = f"{EV}, p AS (SELECT *, us - lag(us) OVER (PARTITION BY event_type ORDER BY us, event_id) AS period FROM ev)"


def periods_of(spark: SparkSession, d: str) -> DataFrame:
    e = prefix(events(spark, d), ["event_type"], ["us", "event_id"], DAY, lags={"before": "us"}, rn="position")
    return e.withColumn("period", F.col("us") - F.col("before"))


@query("periods", f"WITH {_PERIODS} SELECT event_id, event_type, period FROM p")
def periods(spark: SparkSession, d: str) -> DataFrame:
    return periods_of(spark, d).select("event_id", "event_type", "period")


@query("period_stats", f"WITH {_PERIODS} SELECT event_type, count(*) AS n, round(avg(period), 2) AS mean, round(stddev_pop(period), 2) AS std, min(period) AS min, max(period) AS max, round(1e6 / avg(period), 9) AS freq, round(-(avg(period) - 1e9) / 1e9 * 1e6, 3) AS ppm FROM p WHERE period IS NOT NULL GROUP BY 1")
def period_stats(spark: SparkSession, d: str) -> DataFrame:
    out = stats.period_stats(periods_of(spark, d), "period", 1e9, ["event_type"])
    return out.withColumns({"mean": F.round("mean", 2), "std": F.round("std", 2), "ppm": F.round("ppm", 3), "freq": F.round("freq", 9)})


@query("frequency_skew", f"""WITH {_PERIODS}, r AS (SELECT event_type, period, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS rn FROM p), m AS (SELECT least(max(rn) FILTER (event_type = 'click'), max(rn) FILTER (event_type = 'view')) AS n FROM r),
 s AS (SELECT avg(period) FILTER (event_type = 'click') AS ma, avg(period) FILTER (event_type = 'view') AS mb, count(period) FILTER (event_type = 'click') AS n FROM r, m WHERE rn <= m.n)
 SELECT round((ma - mb) / ma * 1e6, 6) AS ppm, round((ma - mb) / ma * 1e9, 3) AS ns_per_s, n FROM s""")
def frequency_skew(spark: SparkSession, d: str) -> DataFrame:
    p = periods_of(spark, d)
    out = stats.frequency_skew(p.where("event_type = 'click'"), p.where("event_type = 'view'"), "period", "position")
    return out.select(F.round("ppm", 6).alias("ppm"), F.round("ns_per_s", 3).alias("ns_per_s"), "n")


@query("period_diff", f"""WITH {_PERIODS}, r AS (SELECT event_type, period, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS position FROM p)
 SELECT a.position, (b.period - a.period) * 1000 AS diff_ns FROM r a JOIN r b ON a.event_type = 'click' AND b.event_type = 'view' AND a.position = b.position""")
def period_diff(spark: SparkSession, d: str) -> DataFrame:
    p = periods_of(spark, d)
    a = p.where("event_type = 'click'").select("position", F.col("period").alias("pa"))
    b = p.where("event_type = 'view'").select("position", F.col("period").alias("pb"))
    return a.join(b, "position").select("position", ((F.col("pb") - F.col("pa")) * 1000).alias("diff_ns"))


RESERVOIR = 500


@query("online_reservoir", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber) AS place FROM lineitem),
 m AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1), s AS (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS a FROM r WHERE place <= {RESERVOIR} GROUP BY 1)
 SELECT l_returnflag, n, round(mean, 4) AS mean, min, max, CAST(len(a) AS INTEGER) AS held, {", ".join(f"a[CAST(floor(len(a) * {q}) AS INTEGER) + 1] AS {name}" for name, q in stats.QUANTILES.items())}, round(greatest(abs(a[1] - mean), abs(a[-1] - mean)), 4) AS max_dev FROM m JOIN s USING (l_returnflag)""")
def online_reservoir(spark: SparkSession, d: str) -> DataFrame:
    """Moments of all prices, percentiles of a bounded sample."""
    out = stats.reservoir_stats(read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], ["l_orderkey", "l_linenumber"], RESERVOIR).drop("std")
    return out.withColumn("mean", F.round("mean", 4)).withColumn("max_dev", F.round("max_dev", 4))


@query("online_stats", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def online_stats(spark: SparkSession, d: str) -> DataFrame:
    out = stats.online_stats(read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", "mean", "std", "min", "max")
    return out.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@query("discrete_pct", "WITH r AS (SELECT l_returnflag AS f, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT f AS l_returnflag, max(v) FILTER (i = CAST(floor(n * 0.5) AS BIGINT)) AS p50, max(v) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(v) FILTER (i = CAST(floor(n * 0.99) AS BIGINT)) AS p99, max(v) FILTER (i = CAST(floor(n * 0.999) AS BIGINT)) AS p999 FROM r GROUP BY 1")
def discrete_pct(spark: SparkSession, d: str) -> DataFrame:
    return stats.online_stats(read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "p50", "p95", "p99", "p999")


def ftm_entries(spark: SparkSession, d: str) -> DataFrame:
    """Line items as round-trip frames: device, session, four times in ps, rssi."""
    li = read(spark, d, "lineitem")
    t1 = F.col("l_orderkey") * 1_000_000
    t2, dwell = t1 + F.col("l_partkey") * 1000, F.col("l_suppkey") * 500
    return li.select((F.col("l_suppkey") % 8).alias("device"), F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("i"), t1.alias("t1"), t2.alias("t2"), (t2 + dwell).alias("t3"), (t2 + dwell + F.col("l_partkey") * 1000 + F.col("l_linenumber") * 7).alias("t4"), (-F.col("l_quantity")).cast("int").alias("rssi"))


FTM = "f AS (SELECT l_suppkey % 8 AS device, l_orderkey AS session, l_linenumber AS i, l_orderkey * 1000000 AS t1, l_orderkey * 1000000 + l_partkey * 1000 AS t2, l_orderkey * 1000000 + l_partkey * 1000 + l_suppkey * 500 AS t3, l_orderkey * 1000000 + l_partkey * 2000 + l_suppkey * 500 + l_linenumber * 7 AS t4, CAST(-l_quantity AS INTEGER) AS rssi FROM lineitem)"


@query("ftm_components", f"WITH {FTM} SELECT device, session, i, t4 - t1 AS round_trip, t3 - t2 AS turn, (t4 - t1) - (t3 - t2) AS rtt, (t2 - t1 + t3 - t4) / 2.0 AS offset_ps FROM f")
def ftm_components(spark: SparkSession, d: str) -> DataFrame:
    t1, t2, t3, t4 = (F.col(f"t{k}") for k in range(1, 5))
    return ftm_entries(spark, d).select("device", "session", "i", (t4 - t1).alias("round_trip"), (t3 - t2).alias("turn"), ((t4 - t1) - (t3 - t2)).alias("rtt"), ((t2 - t1 + t3 - t4) / 2).alias("offset_ps"))


@query("session_stats", f"WITH {FTM}, s AS (SELECT *, (t4 - t1) - (t3 - t2) AS rtt FROM f) SELECT device, session, count(*) AS n, CAST(sum(rtt) // count(rtt) AS BIGINT) AS rtt_avg, min(rtt) AS rtt_min, max(rtt) AS rtt_max, CAST(sum(rssi) // count(rssi) AS BIGINT) AS rssi_avg, min(rssi) AS rssi_min, max(rssi) AS rssi_max FROM s GROUP BY ALL")
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    f = ftm_entries(spark, d).withColumn("rtt", (F.col("t4") - F.col("t1")) - (F.col("t3") - F.col("t2")))
    return stats.session_stats(f, ["device", "session"])


_SESSIONS = "s AS (SELECT o_orderpriority AS label, CASE o_orderstatus WHEN 'F' THEN 250 ELSE 0 END AS status, CASE o_orderstatus WHEN 'F' THEN 0 ELSE o_custkey % 65 END AS entries, CASE o_orderstatus WHEN 'F' THEN NULL ELSE o_totalprice END AS rtt, CASE o_orderstatus WHEN 'F' THEN NULL ELSE -(o_custkey % 90) END AS rssi FROM orders)"


@query("session_quality", f"""WITH {_SESSIONS}, g AS (SELECT *, coalesce(status = 0 AND entries > 0, false) AS ok FROM s)
 SELECT label, count(*) AS sessions, count(*) FILTER (ok) AS ok, round(count(*) FILTER (ok) / count(*), 6) AS success_rate, round(coalesce(sum(entries), 0) / (64 * count(*)), 6) AS entry_rate,
 round(avg(rtt) FILTER (ok), 4) AS rtt_mean, round(stddev_pop(rtt) FILTER (ok), 4) AS rtt_std, min(rtt) FILTER (ok) AS rtt_min, max(rtt) FILTER (ok) AS rtt_max, round(avg(rssi) FILTER (ok), 4) AS rssi_mean, round(stddev_pop(rssi) FILTER (ok), 4) AS rssi_std, min(rssi) FILTER (ok) AS rssi_min, max(rssi) FILTER (ok) AS rssi_max FROM g GROUP BY 1""")
def session_quality(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("o_orderstatus") == "F"
    s = read(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.when(bad, 250).otherwise(0).alias("status"), F.when(bad, 0).otherwise(F.col("o_custkey") % 65).alias("entries"), F.when(~bad, F.col("o_totalprice")).alias("rtt"), F.when(~bad, -(F.col("o_custkey") % 90)).alias("rssi"))
    out = rounded(stats.session_quality(s, ["label"]), "success_rate", "entry_rate")
    return out.select(*[F.round(c, 4).alias(c) if c in ("rtt_mean", "rtt_std", "rssi_mean", "rssi_std") else F.col(c) for c in out.columns])


@query("signal_stats", f"WITH {EV} SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ev GROUP BY 1")
def signal_stats(spark: SparkSession, d: str) -> DataFrame:
    out = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return rounded(out, "mean", "std")


_HIST = "e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd, count(*) AS n FROM lineitem)"


@query("histogram", f"WITH {_HIST}, b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, l_returnflag, lo, (hi - lo) / 50 AS w FROM lineitem, e) SELECT bin, l_returnflag, round(min(lo) + bin * min(w), 6) AS lo, round(min(lo) + bin * min(w) + min(w), 6) AS hi, count(*) AS n FROM b GROUP BY bin, l_returnflag")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.histogram(read(spark, d, "lineitem"), "l_extendedprice", 50, ["l_returnflag"]), "lo", "hi")


@query("histogram_fit", f"WITH {_HIST}, b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, lo, (hi - lo) / 30 AS w, mu, sd, e.n AS total FROM lineitem, e), g AS (SELECT bin, min(lo) AS lo, min(w) AS w, min(mu) AS mu, min(sd) AS sd, min(total) AS total, count(*) AS n FROM b GROUP BY bin) SELECT bin, round(lo + bin * w, 6) AS lo, round(lo + bin * w + w, 6) AS hi, n, round(exp(-pow((lo + bin * w + w / 2 - mu) / sd, 2) / 2) / (sd * sqrt(2 * pi())) * total * w, 4) AS fit FROM g")
def histogram_fit(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(stats.histogram(read(spark, d, "lineitem"), "l_extendedprice", 30, fit=True), "lo", "hi")
    return out.withColumn("fit", F.round("fit", 4))


@query("run_stats", "SELECT l_orderkey % 500 AS run, count(*) AS n, count(DISTINCT l_quantity) AS \"distinct\", arg_max(l_extendedprice, struct_pack(a := l_orderkey * 10 + l_linenumber, b := l_partkey, c := l_suppkey, d := l_extendedprice)) AS last, count(*) = 100 AS is_full FROM lineitem GROUP BY 1")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice")
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("run"), "l_quantity", "l_extendedprice", order.alias("ord"))
    marked = stats.run_stats(li.withColumn("price_of_run", F.col("l_extendedprice")), "run", "l_quantity", "ord")
    last = li.groupBy("run").agg(F.max_by("l_extendedprice", "ord").alias("last"))
    return marked.drop("last").join(last, "run")


@query("drop_last_run", f"WITH {EV}, r AS (SELECT event_id, event_id // 101 AS run FROM ev), l AS (SELECT max_by(run, event_id) AS run FROM r) SELECT event_id, run FROM r WHERE NOT (run = (SELECT run FROM l) AND (SELECT count(*) FROM r WHERE run = (SELECT run FROM l)) < 100)")
def drop_last_run(spark: SparkSession, d: str) -> DataFrame:
    return stats.drop_last_run(events(spark, d).select("event_id", F.expr("event_id div 101").alias("run")), "run", "event_id")


@query("interval_intersect", """WITH i AS (SELECT l_suppkey AS k, l_shipdate, epoch_us(l_shipdate) // 86400000000 - l_partkey AS lo, epoch_us(l_shipdate) // 86400000000 + l_partkey * 5 AS hi FROM lineitem), g AS (SELECT k, max(lo) AS lo, min(hi) AS hi FROM i GROUP BY k)
 SELECT k, CASE WHEN lo <= hi THEN lo END AS lo, CASE WHEN lo <= hi THEN hi END AS hi, CASE WHEN lo <= hi THEN (lo + hi) / 2 END AS mid, CASE WHEN lo <= hi THEN hi - lo END AS width FROM g""")
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    i = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (day - F.col("l_partkey")).alias("lo"), (day + F.col("l_partkey") * 5).alias("hi"))
    return stats.interval_intersection(i, "lo", "hi", ["k"])


@query("block_stats", f"WITH {EV}, r AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1) // 50 AS block FROM ev) SELECT event_type, block, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM r GROUP BY ALL HAVING count(*) = 50 OR block = 0")
def block_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.block_stats(events(spark, d), "value", 50, ["event_type"], ["us", "event_id"], DAY), "mean", "std")


_BINS = [0.0001, 0.0002, 0.0003]


@query("minute_stats", f"""WITH {PAIRS}, m AS (SELECT t_a // {HOUR} AS bucket, delay FROM pairs), g AS (SELECT bucket, count(*) AS n, avg(delay) AS mean, stddev_pop(delay) AS std, min(delay) AS min, max(delay) AS max FROM m GROUP BY 1)
 SELECT bucket, n, round(mean, 6) AS mean, round(std, 6) AS std, min, max FROM g WHERE n >= 2 AND bucket > (SELECT min(us) // {HOUR} FROM ev)""")
def minute_stats(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.minutes import minute_stats as run

    pairs = scale.band_join(*clicks_and_views(spark, d), "t_a", "t_b", TOL).withColumn("delay", F.col("t_b") - F.col("t_a"))
    start = events(spark, d).agg(F.min("us").alias("start"))
    return rounded(run(pairs, start, "t_a", "delay", HOUR, 2), "mean", "std")


@query("run_rollup", "WITH r AS (SELECT l_orderkey % 500 AS run, count(*) AS n, count(DISTINCT l_quantity) AS d FROM lineitem GROUP BY 1) SELECT count(*) AS runs, round(avg(n), 6) AS n_mean, min(n) AS n_min, max(n) AS n_max, round(avg(d), 6) AS distinct_mean, min(d) AS distinct_min, max(d) AS distinct_max, CAST(count(*) FILTER (n = 100) AS BIGINT) AS full FROM r")
def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("run"), "l_quantity", "l_orderkey")
    return rounded(stats.run_rollup(stats.run_stats(li, "run", "l_quantity", "l_orderkey")), "n_mean", "distinct_mean")


@query("running_intersection", f"WITH {EV}, i AS (SELECT event_id, device, us, k - 1000 + event_id % 50 AS lo, k + 1000 - event_id % 70 AS hi FROM ev) SELECT event_id, max(lo) OVER w AS lo_so_far, min(hi) OVER w AS hi_so_far FROM i WINDOW w AS (PARTITION BY device ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)")
def running_intersection(spark: SparkSession, d: str) -> DataFrame:
    i = events(spark, d).select("event_id", "device", "us", (F.col("k") - 1000 + F.col("event_id") % 50).alias("lo"), (F.col("k") + 1000 - F.col("event_id") % 70).alias("hi"))
    return stats.running_intersection(i, "lo", "hi", ["device"], ["us", "event_id"], DAY).select("event_id", "lo_so_far", "hi_so_far")


@query("minute_report", f"""WITH {PAIRS}, s AS (SELECT min(us) // {HOUR} AS first FROM ev), m AS (SELECT t_a // {HOUR} AS bucket, t_a, id_a, id_b, delay, avg(delay) OVER (PARTITION BY t_a // {HOUR}) AS mu FROM pairs), c AS (SELECT *, abs(delay - mu) AS dev FROM m),
 g AS (SELECT bucket, count(*) AS n, {_JITTER} FROM c GROUP BY 1), x AS (SELECT us // {HOUR} AS bucket, count(*) FILTER (event_type = 'click') AS edges_a, count(*) FILTER (event_type = 'view') AS edges_b, max(k) AS overflow FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1),
 r AS (SELECT bucket, delay * 1e-9 * 2 * pi() * 1000 AS y, row_number() OVER (PARTITION BY bucket ORDER BY t_a, id_a, id_b) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM m), h AS (SELECT bucket, n, i, (y - avg(y) OVER (PARTITION BY bucket)) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS z, 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) AS w FROM r WHERE n > 1),
 p AS (SELECT bucket, n, sum(w * w) AS s2, sum(z * z) AS zz, sum(z) AS dc, sum(z * cos(2 * pi() * ((n // 2) * i % n) / n)) AS cl, sum(z * sin(2 * pi() * ((n // 2) * i % n) / n)) AS sl FROM h GROUP BY 1, 2),
 q AS (SELECT bucket, sqrt(greatest((n * zz - dc * dc - CASE WHEN n % 2 = 1 THEN cl * cl + sl * sl ELSE 0 END) / (1000 * s2) * 1000 / n, 0)) AS rms FROM p WHERE s2 > 1e-12)
 SELECT g.*, edges_a, edges_b, overflow, round(rms, 6) AS rms_rad FROM g JOIN x USING (bucket) LEFT JOIN q USING (bucket), s WHERE n >= 2 AND bucket > first""")
def minute_report(spark: SparkSession, d: str) -> DataFrame:
    """All statistics of each closed window, with the edges of both channels and the overflow counter beside them."""
    from ..streaming.minutes import band_report as run

    e = events(spark, d).where("event_type in ('click', 'view')")
    edges = e.select("us", F.when(F.col("event_type") == "click", "a").otherwise("b").alias("side"), F.col("k").alias("overflow"))
    out = run(*clicks_and_views(spark, d), "t_a", "t_b", TOL, edges, events(spark, d).agg(F.min("us").alias("start")), ["id_a"], ["id_b"], 1000.0, HOUR, 2)
    return rounded(out.drop("rms_jitter_ns"), *_STATS, "rms_rad")
