"""Windowed statistics, one definition for batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bands, spectrum, stats


def minute_stats(pairs: DataFrame, start: DataFrame, t_a: str, delay: str, every_us: int = 60_000_000, least: int = 10) -> DataFrame:
    """bucket, n, mean, std, min, max of each closed, epoch-aligned window of matched pairs.

    A pair belongs to the window of its A edge. Windows with fewer than `least` pairs and the first, incomplete
    one (that of start, one row) are dropped.
    """
    bucket = F.expr(f"{t_a} div {every_us}")
    out = pairs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(delay).alias("mean"), F.stddev_pop(delay).alias("std"), F.min(delay).alias("min"), F.max(delay).alias("max"))
    first = start.select(F.expr(f"start div {every_us}").alias("_first"))
    return out.where(F.col("n") >= least).join(F.broadcast(first), F.col("bucket") > F.col("_first")).drop("_first")


def minute_report(pairs: DataFrame, edges: DataFrame, start: DataFrame, t_a: str, delay: str, order: list[str], pulse_freq: float, every_us: int = 60_000_000, least: int = 10) -> DataFrame:
    """bucket, n, mean to p999, edges_a, edges_b, overflow, rms_rad, rms_jitter_ns of each closed window.

    edges(us, side, overflow) are all edges of both channels, `a` and `b`; the overflow counter is carried as its largest
    value. A pair belongs to the window of its A edge, an edge to its own. Windows with fewer than `least` pairs and
    the first, incomplete one are dropped.
    """
    placed = pairs.withColumn("bucket", F.expr(f"{t_a} div {every_us}"))
    noise = spectrum.phase_noise(placed, delay, order, pulse_freq, ["bucket"], [], every_us).where(F.col("rms_rad").isNotNull() & ~F.isnan("rms_rad"))
    out = stats.jitter_stats(placed, delay, ["bucket"]).join(noise.select("bucket", "rms_rad", "rms_jitter_ns"), "bucket", "left")
    return _reported(out, edges, start, every_us, least)


def band_report(a: DataFrame, b: DataFrame, ta: str, tb: str, tol: int, edges: DataFrame, start: DataFrame, order_a: list[str], order_b: list[str], pulse_freq: float, every_us: int = 60_000_000, least: int = 10) -> DataFrame:
    """minute_report of all pairs of a and b with |tb - ta| at most tol, in the order of ta, order_a, order_b, without making a table of them."""
    return _reported(bands.band_jitter(a, b, ta, tb, tol, every_us, order_a, order_b, pulse_freq), edges, start, every_us, least)


def _reported(out: DataFrame, edges: DataFrame, start: DataFrame, every_us: int, least: int) -> DataFrame:
    counts = edges.groupBy(F.expr(f"us div {every_us}").alias("bucket")).agg(*[F.sum((F.col("side") == x).cast("long")).alias(f"edges_{x}") for x in ("a", "b")], F.max("overflow").alias("overflow"))
    first = start.select(F.expr(f"start div {every_us}").alias("_first"))
    met = out.where(F.col("n") >= least).join(counts, "bucket").join(F.broadcast(first), F.col("bucket") > F.col("_first"))
    own = [c for c in out.columns if not c.startswith("rms_")]
    return met.select(*own, "edges_a", "edges_b", "overflow", "rms_rad", "rms_jitter_ns")


def quantile_of(ordered: Column, q: float) -> Column:
    """The interpolated quantile of a sorted array."""
    place = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
    return a + (place - low) * (b - a)


def stream_minute_stats(pairs: DataFrame, ts: str, delay: str, every: str = "1 minute", least: int = 10, lateness: str = "1 minute", start_us: int | None = None) -> DataFrame:
    """window_start, n, mean, std, min, max, max_dev, p50..p999 of closed windows of a stream of pairs, by the time of the A edge.

    Percentiles are of |delay - mean| and exact, so a window's delays are kept until it closes (8 bytes each). The first,
    incomplete window (that of start_us) and those before it are dropped, as in minute_stats.
    """
    out = pairs.withWatermark(ts, lateness).groupBy(F.window(ts, every)).agg(F.count("*").alias("n"), F.avg(delay).alias("mean"), F.stddev_pop(delay).alias("std"), F.min(delay).alias("min"), F.max(delay).alias("max"), F.collect_list(F.col(delay).cast("double")).alias("_all"))
    out = out.where(F.col("n") >= least).withColumn("_dev", F.sort_array(F.transform("_all", lambda x: F.abs(x - F.col("mean")))))
    picks = [F.array_max("_dev").alias("max_dev"), *[quantile_of(F.col("_dev"), q).alias(n) for n, q in stats.QUANTILES.items()]]
    out = out.select(F.unix_micros("window.start").alias("window_start"), "n", "mean", "std", "min", "max", *picks)
    return out if start_us is None else out.where(F.col("window_start") > start_us)


def open_windows(closed: DataFrame, pairs: DataFrame, ts: str, delay: str, every: str = "1 minute", least: int = 10, start_us: int | None = None) -> DataFrame:
    """The windows that a stopped stream still held open, from its pairs after the last closed window."""
    last = closed.agg(F.max("window_start").alias("_last"))
    starts = F.unix_micros(F.window(ts, every)["start"])
    rest = pairs.withColumn("_start", starts).join(F.broadcast(last), F.col("_last").isNull() | (F.col("_start") > F.col("_last"))).drop("_start", "_last")
    return stream_minute_stats(rest, ts, delay, every, least, "0 seconds", start_us)


def run_minutes(windows: DataFrame, folder: str, on_minute: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream of closed windows over all data there is and hands each batch of them, with its number, to a hook.

    A batch may come again after a failure, with the same number.
    """
    windows.writeStream.foreachBatch(on_minute).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def rolling_stats(df: DataFrame, us: str, value: str, size_us: int, slide_us: int) -> DataFrame:
    """window_start, n, mean, min, max over windows of size_us that start every slide_us; a row is in size / slide of them."""
    copies = size_us // slide_us
    starts = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: (F.floor(F.col(us) / slide_us) - j) * slide_us)
    rows = df.select(F.explode(starts).alias("window_start"), value)
    return rows.groupBy(F.col("window_start").cast("long").alias("window_start")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
