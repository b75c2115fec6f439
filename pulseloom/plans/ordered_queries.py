"""Ordered queries: detection, differences, windows, top-k, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, flux, spectrum
from ..operators.scale import prefix
from .registry import DAY, EV, HOUR, SECOND, events, query, read

#: The event values about their middle as a sampled signal, one series for all.
SIGNAL = f"{EV}, s AS (SELECT event_id AS idx, value - 50 AS v FROM ev), n AS (SELECT idx, v, lag(v) OVER (ORDER BY idx) AS p, lead(v) OVER (ORDER BY idx) AS nx FROM s)"
THRESHOLD, APART = 30.0, 20


def signal(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.lit("x").alias("series"), F.col("event_id").alias("idx"), (F.col("value") - 50).alias("v"))


def _debounced(candidates: str, keep: str, tie: str = "t") -> str:
    """Recursive SQL that keeps candidates (k, t, ...) at least APART after the last kept of their kind."""
    return f"""c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, {tie}) AS rn FROM ({candidates})), w AS (SELECT k, t, h, rn, t AS last, true AS keep FROM c WHERE rn = 1
 UNION ALL SELECT c.k, c.t, c.h, c.rn, CASE WHEN c.t - w.last >= {APART} THEN c.t ELSE w.last END, c.t - w.last >= {APART} FROM w JOIN c ON c.k = w.k AND c.rn = w.rn + 1) {keep}"""


@query("detect_crossings", f"WITH RECURSIVE {SIGNAL}, " + _debounced(f"SELECT 0 AS k, idx - 1 + (-{THRESHOLD} - p) / (v - p) AS t, 0 AS h FROM n WHERE p > -{THRESHOLD} AND v <= -{THRESHOLD} UNION ALL SELECT 1, idx - 1 + ({THRESHOLD} - p) / (v - p), 0 FROM n WHERE p < {THRESHOLD} AND v >= {THRESHOLD}", "SELECT 'x' AS series, round(t, 6) AS t, k AS edge_type FROM w WHERE keep"))
def detect_crossings(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect_crossings(signal(spark, d), ["series"], "idx", "v", THRESHOLD, APART, 1024).withColumn("t", F.round("t", 6))


_VERTEX = "CASE WHEN abs(p - 2 * v + nx) < 1e-10 THEN 0 ELSE greatest(-1, least(1, (p - nx) / (2 * (p - 2 * v + nx)))) END"


@query("detect_peaks", f"WITH RECURSIVE {SIGNAL}, " + _debounced(f"SELECT CASE WHEN v < 0 THEN 0 ELSE 1 END AS k, idx + {_VERTEX} AS t, v AS h FROM n WHERE (v > p AND v > nx AND v > {THRESHOLD}) OR (v < p AND v < nx AND v < -{THRESHOLD})", "SELECT 'x' AS series, round(t, 6) AS t, k AS edge_type, round(h, 6) AS height FROM w WHERE keep"))
def detect_peaks(spark: SparkSession, d: str) -> DataFrame:
    out = detect.detect_peaks(signal(spark, d), ["series"], "idx", "v", THRESHOLD, APART, 1024)
    return out.withColumn("t", F.round("t", 6)).withColumn("height", F.round("height", 6))


@query("detect_hysteresis", f"WITH {SIGNAL}, g AS (SELECT *, sum(CASE WHEN abs(v) < 10 THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS seg FROM s) SELECT 'x' AS series, min(idx) AS idx, CASE WHEN v <= -{THRESHOLD} THEN 0 ELSE 1 END AS edge_type FROM g WHERE abs(v) >= {THRESHOLD} GROUP BY seg, 3")
def detect_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect_hysteresis(signal(spark, d), ["series"], "idx", "v", -THRESHOLD, THRESHOLD, 10, 1024).select("series", "idx", "edge_type")


_LINREG = f"""f AS (SELECT idx AS j, CASE WHEN p > -{THRESHOLD} AND v <= -{THRESHOLD} THEN 0 ELSE 1 END AS k FROM n WHERE (p > -{THRESHOLD} AND v <= -{THRESHOLD}) OR (p < {THRESHOLD} AND v >= {THRESHOLD})),
 a AS (SELECT j, k, s.idx AS i, CASE k WHEN 0 THEN -v ELSE v END AS y FROM f JOIN s ON s.idx BETWEEN j - 11 AND j + 15),
 pk AS (SELECT j, k, max(y) FILTER (i >= j) AS top, arg_max(i, struct_pack(y := y, m := -i)) FILTER (i >= j) AS peak FROM a GROUP BY j, k),
 fl AS (SELECT j, k, top, i - j AS x, y FROM a JOIN pk USING (j, k) WHERE i >= peak - 10 AND i < peak AND y >= top * 0.2 AND y <= top * 0.8),
 ft AS (SELECT j, k, any_value(top) AS h, CAST(count(*) AS DOUBLE) AS c, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, min(x) AS x0 FROM fl GROUP BY j, k),
 fs AS (SELECT *, CASE WHEN c >= 2 AND abs(c * sxx - sx * sx) >= 1e-12 THEN (c * sxy - sx * sy) / (c * sxx - sx * sx) END AS slope FROM ft)"""


@query("detect_linreg", f"WITH RECURSIVE {SIGNAL}, {_LINREG}, " + _debounced("SELECT k, CASE WHEN slope IS NULL OR abs(slope) < 1e-12 THEN j + x0 ELSE j + (h * 0.5 - (sy - slope * sx) / c) / slope END AS t, h, j FROM fs", "SELECT 'x' AS series, round(t, 6) AS t, k AS edge_type, round(h, 6) AS height FROM w WHERE keep", "j"))
def detect_linreg(spark: SparkSession, d: str) -> DataFrame:
    out = detect.detect_linreg(signal(spark, d), ["series"], "idx", "v", THRESHOLD, min_distance=APART, width=1024)
    return out.withColumn("t", F.round("t", 6)).withColumn("height", F.round("height", 6))


@query("refine_parabolic", f"WITH {SIGNAL} SELECT 'x' AS series, idx, round(CASE WHEN p IS NULL OR nx IS NULL OR abs(p - 2 * v + nx) < 1e-10 OR abs((p - nx) / (2 * (p - 2 * v + nx))) > 1 THEN idx ELSE idx + (p - nx) / (2 * (p - 2 * v + nx)) END, 6) AS t FROM n")
def refine_parabolic(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d)
    return detect.refine_parabolic(s, ["series"], "idx", "v", s.select("series", "idx")).withColumn("t", F.round("t", 6))


@query("regress_points", """WITH e AS (SELECT vec_id, list_max(embedding) AS peak, embedding AS y, CAST(len(embedding) AS DOUBLE) AS n FROM embeddings), s AS (SELECT vec_id, CAST(peak AS DOUBLE) AS peak, n, n * (n - 1) / 2 AS sx, (n - 1) * n * (2 * n - 1) / 6 AS sxx, list_sum(list_transform(y, lambda v: CAST(v AS DOUBLE))) AS sy, list_sum(list_transform(y, lambda v, i: CAST(v AS DOUBLE) * (i - 1))) AS sxy FROM e),
 r AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM s) SELECT vec_id, round(CASE WHEN abs(slope) < 1e-12 THEN vec_id + n // 2 ELSE vec_id + (peak * 0.5 - (sy - slope * sx) / n) / slope END, 2) AS t FROM r""")
def regress_points(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v, i: F.struct(i.alias("off"), v.alias("v"))).alias("points"))
    e = e.withColumn("peak", F.array_max(F.transform("points", lambda p: p["v"])).cast("double"))
    return detect.regress_points(e, "vec_id", "peak", "points").select("vec_id", F.round("t", 2).alias("t"))


@query("skip_settle", f"WITH {SIGNAL} SELECT 'x' AS series, idx, round(v, 6) AS v FROM s WHERE idx >= (SELECT min(idx) FROM s WHERE idx >= 100 AND abs(v) < 5)")
def skip_settle(spark: SparkSession, d: str) -> DataFrame:
    return detect.skip_settle(signal(spark, d), ["series"], "idx", "v", 100, 5).select("series", "idx", F.round("v", 6).alias("v"))


@query("status_deltas", f"WITH {EV}, t AS (SELECT device, us // {HOUR} AS hour, count(*) AS n FROM ev GROUP BY ALL), c AS (SELECT device, hour, CAST(sum(n) OVER (PARTITION BY device ORDER BY hour) AS BIGINT) AS total FROM t) SELECT device, hour, total, total - coalesce(lag(total) OVER (PARTITION BY device ORDER BY hour), 0) AS delta FROM c")
def status_deltas(spark: SparkSession, d: str) -> DataFrame:
    hourly = events(spark, d).groupBy("device", F.expr(f"us div {HOUR}").alias("hour")).agg(F.count("*").alias("n"))
    total = prefix(hourly, ["device"], ["hour"], 24, sums={"total": "n"})
    seen = prefix(total, ["device"], ["hour"], 24, lags={"before": "total"})
    return seen.select("device", "hour", "total", (F.col("total") - F.coalesce("before", F.lit(0))).alias("delta"))


@query("every_nth", f"WITH {EV}, r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS rn FROM ev) SELECT event_type, event_id FROM r WHERE (rn - 1) % 10 = 0")
def every_nth(spark: SparkSession, d: str) -> DataFrame:
    return flux.every_nth(events(spark, d), ["event_type"], ["us", "event_id"], 10, DAY).select("event_type", "event_id")


@query("derivative", f"WITH {EV}, c AS (SELECT device, event_id, us, (event_id * 37) % 4000 AS v FROM ev), l AS (SELECT *, lag(v) OVER w AS p, lag(us) OVER w AS pu FROM c WINDOW w AS (PARTITION BY device ORDER BY us, event_id)) SELECT device, event_id, round(CASE WHEN us > pu THEN CASE WHEN v < p THEN v ELSE v - p END / ((us - pu) / 1e6) END, 6) AS rate FROM l WHERE pu IS NOT NULL")
def derivative(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).select("device", "event_id", "us", (F.col("event_id") * 37 % 4000).alias("v"))
    return flux.derivative(c, ["device"], ["us", "event_id"], "us", "v", SECOND, width=DAY).select("device", "event_id", F.round("rate", 6).alias("rate"))


def _window(fn: str) -> str:
    return f"WITH {EV} SELECT device, event_type, (us // {HOUR} + 1) * {HOUR} AS window_end, {fn} AS value FROM ev GROUP BY ALL"


@query("agg_window_mean", _window("round(avg(value), 6)"))
def agg_window_mean(spark: SparkSession, d: str) -> DataFrame:
    return flux.agg_window(events(spark, d), "us", HOUR, "mean", ["device", "event_type"], "value").withColumn("value", F.round("value", 6))


@query("agg_window_last", _window("arg_max(value, struct_pack(a := us, b := event_id))"))
def agg_window_last(spark: SparkSession, d: str) -> DataFrame:
    return flux.agg_window(events(spark, d), "us", HOUR, "last", ["device", "event_type"], "value", "event_id")


@query("window_range", f"WITH {EV} SELECT device, (us // {DAY} + 1) * {DAY} AS window_end, round(avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type = 'click'), 6) AS range FROM ev GROUP BY ALL")
def window_range(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("lo", F.when(F.col("event_type") == "click", F.col("value"))).withColumn("hi", F.when(F.col("event_type") == "purchase", F.col("value")))
    return flux.window_range(e, "us", DAY, ["device"], "lo", "hi").withColumn("range", F.round("range", 6))


@query("series_calcs", f"WITH {EV} SELECT device, event_type, round(avg(value), 6) AS mean, max(value) AS max, arg_max(value, struct_pack(a := us, b := event_id)) AS last, round(stddev_pop(value), 6) AS std FROM ev GROUP BY ALL")
def series_calcs(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("device", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"), F.max_by("value", F.struct("us", "event_id")).alias("last"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("rolling_stats", f"WITH {EV}, x AS (SELECT us, value, unnest([0, 1, 2, 3, 4, 5]) AS j FROM ev) SELECT event_w * {10 * HOUR // 60} AS window_start, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM (SELECT us // {10 * HOUR // 60} - j AS event_w, value FROM x) GROUP BY event_w")
def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.minutes import rolling_stats as run

    return run(events(spark, d), "us", "value", HOUR, HOUR // 6)


@query("latest_n", f"WITH {EV} SELECT event_id, us, value FROM ev WHERE event_type = 'view' ORDER BY us DESC, event_id DESC LIMIT 25")
def latest_n(spark: SparkSession, d: str) -> DataFrame:
    return flux.latest_n(events(spark, d).where("event_type = 'view'").select("event_id", "us", "value"), ["us", "event_id"], 25)


@query("first_last", f"WITH {EV} SELECT user_id, arg_min(value, struct_pack(a := us, b := event_id)) AS first, arg_max(value, struct_pack(a := us, b := event_id)) AS last FROM ev GROUP BY 1")
def first_last(spark: SparkSession, d: str) -> DataFrame:
    return flux.first_last(events(spark, d), ["user_id"], ["us", "event_id"], "value")


@query("experiment_list", f"WITH {EV} SELECT user_id, max(us) AS latest, count(*) AS events FROM ev WHERE event_type = 'signup' GROUP BY 1 ORDER BY latest DESC, user_id LIMIT 20")
def experiment_list(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'signup'").groupBy("user_id").agg(F.max("us").alias("latest"), F.count("*").alias("events")).orderBy(F.desc("latest"), "user_id").limit(20)


@query("experiment_duration", f"WITH {EV}, t AS (SELECT user_id, event_type, min(us) AS us FROM ev WHERE event_type IN ('signup', 'purchase') GROUP BY ALL), p AS (SELECT user_id, max(us) FILTER (event_type = 'signup') AS start_us, max(us) FILTER (event_type = 'purchase') AS stop_us FROM t GROUP BY 1) SELECT user_id, stop_us - start_us AS duration FROM p")
def experiment_duration(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d).where("event_type in ('signup', 'purchase')").groupBy("user_id", "event_type").agg(F.min("us").alias("us"))
    return flux.pivot_fields(t, ["user_id"], "event_type", "us", ["signup", "purchase"]).select("user_id", (F.col("purchase") - F.col("signup")).alias("duration"))


@query("unique_first", f"WITH {EV} SELECT DISTINCT ON (user_id) user_id, event_id, us FROM ev ORDER BY user_id, us, event_id")
def unique_first(spark: SparkSession, d: str) -> DataFrame:
    return flux.unique_first(events(spark, d).select("user_id", "event_id", "us"), "user_id", ["us", "event_id"])


@query("tag_values", "SELECT DISTINCT x AS tag FROM (SELECT c_mktsegment AS x FROM customer UNION ALL SELECT p_type FROM part UNION ALL SELECT n_name FROM nation)")
def tag_values(spark: SparkSession, d: str) -> DataFrame:
    sides = [read(spark, d, t).select(F.col(c).alias("tag")) for t, c in (("customer", "c_mktsegment"), ("part", "p_type"), ("nation", "n_name"))]
    return flux.tag_values(sides, "tag")


@query("union_literal", "SELECT DISTINCT c_mktsegment AS tag FROM customer UNION ALL SELECT 'None' UNION ALL SELECT 'now'")
def union_literal(spark: SparkSession, d: str) -> DataFrame:
    return flux.union_literal(read(spark, d, "customer").select(F.col("c_mktsegment").alias("tag")).distinct(), [{"tag": "None"}, {"tag": "now"}])


@query("phase_noise", f"""WITH {EV}, r AS (SELECT event_type, value * 1e-9 * 2 * pi() * 1000 AS y, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS i FROM ev), g AS (SELECT *, count(*) OVER w AS n, avg(y) OVER w AS mu FROM r WINDOW w AS (PARTITION BY event_type)),
 h AS (SELECT event_type, n, i, (y - mu) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS z, pow(0.5 - 0.5 * cos(2 * pi() * i / (n - 1)), 2) AS w2 FROM g), k AS (SELECT h.*, b.f, CAST(floor(b.f / (1000.0 / n)) AS BIGINT) AS k0 FROM h, (SELECT unnest([10.0, 50.0, 100.0, 200.0]) AS f) b),
 s AS (SELECT event_type, f, n, k0, sum(w2) AS s2, sum(z * cos(2 * pi() * ((k0 * i) % n) / n)) AS a, sum(z * sin(2 * pi() * ((k0 * i) % n) / n)) AS b, sum(z * cos(2 * pi() * (((k0 + 1) * i) % n) / n)) AS c, sum(z * sin(2 * pi() * (((k0 + 1) * i) % n) / n)) AS e FROM k GROUP BY ALL),
 p AS (SELECT event_type, f, n, 2 * (a * a + b * b) / (1000.0 * s2) AS p0, 2 * (c * c + e * e) / (1000.0 * s2) AS p1, f / (1000.0 / n) - k0 AS part FROM s) SELECT event_type, f, n, CASE WHEN f >= 10000.0 / n THEN round(10 * log10((p0 + part * (p1 - p0)) / 2), 3) END AS l_f FROM p""")
def phase_noise(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_type", "us", "event_id", "value")
    wide = spectrum.phase_noise(e, "value", ["us", "event_id"], 1000.0, ["event_type"], [10.0, 50.0, 100.0, 200.0], DAY)
    long = wide.unpivot(["event_type", "n"], [c for c in wide.columns if c.startswith("f_")], "name", "l_f")
    return long.select("event_type", F.regexp_replace(F.substring("name", 3, 9), "p", ".").cast("double").alias("f"), "n", F.round("l_f", 3).alias("l_f"))


_HANNED = f"""{EV}, r AS (SELECT event_type, value * 1e-9 * 2 * pi() * 1000 AS y, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS i FROM ev), g AS (SELECT *, count(*) OVER w AS n, avg(y) OVER w AS mu FROM r WINDOW w AS (PARTITION BY event_type)),
 h AS (SELECT event_type, n, i, (y - mu) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS z, pow(0.5 - 0.5 * cos(2 * pi() * i / (n - 1)), 2) AS w2 FROM g)"""


@query("phase_noise_rms", f"""WITH {_HANNED}, p AS (SELECT event_type, n, sum(w2) AS s2, sum(z * z) AS zz, sum(z) AS dc, sum(z * cos(2 * pi() * ((n // 2) * i % n) / n)) AS cl, sum(z * sin(2 * pi() * ((n // 2) * i % n) / n)) AS sl FROM h GROUP BY 1, 2),
 q AS (SELECT event_type, n, sqrt((n * zz - dc * dc - CASE WHEN n % 2 = 1 THEN cl * cl + sl * sl ELSE 0 END) / s2 / n) AS rms FROM p) SELECT event_type, n, round(rms, 12) AS rms_rad, round(rms / (2 * pi() * 1000) * 1e9, 6) AS rms_jitter_ns FROM q""")
def phase_noise_rms(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_type", "us", "event_id", "value")
    return spectrum.phase_noise(e, "value", ["us", "event_id"], 1000.0, ["event_type"], [10.0], DAY).select("event_type", "n", F.round("rms_rad", 12).alias("rms_rad"), F.round("rms_jitter_ns", 6).alias("rms_jitter_ns"))


@query("band_rms", f"""WITH {_HANNED}, b AS (SELECT event_type, n, unnest(range(CAST(ceil(10.0 * n / 1000) AS BIGINT), CAST(floor(20.0 * n / 1000) AS BIGINT) + 1)) AS bin FROM (SELECT DISTINCT event_type, n FROM h)),
 k AS (SELECT h.event_type, h.n, bin, sum(z * cos(2 * pi() * (bin * i % h.n) / h.n)) AS re, sum(z * sin(2 * pi() * (bin * i % h.n) / h.n)) AS im FROM h JOIN b ON h.event_type = b.event_type GROUP BY 1, 2, 3),
 w AS (SELECT event_type, sum(w2) AS s2 FROM h GROUP BY 1), s AS (SELECT event_type, n, sum((re * re + im * im) * CASE WHEN bin = 0 OR bin = n // 2 THEN 1 ELSE 2 END) AS squares FROM k GROUP BY 1, 2) SELECT event_type, n, round(sqrt(squares / s2 / n), 12) AS band_rms FROM s JOIN w USING (event_type)""")
def band_rms(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_type", "us", "event_id", "value")
    return spectrum.band_rms(e, "value", ["us", "event_id"], 1000.0, 10.0, 20.0, ["event_type"], DAY).withColumn("band_rms", F.round("band_rms", 12))
