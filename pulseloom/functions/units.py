"""Scalar conversions of times, counters and powers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the devices: a tick's length in ns, and the two wraps of the time counters in ps.
TICK_NS = 25
WRAP_PS, SHORT_WRAP_PS = 2**32 * 1_000_000, 2**48


def samples_to_ns(samples: Column, rate: float) -> Column:
    return samples / rate * 1e9


def ticks_to_ns(ticks: Column) -> Column:
    return ticks * TICK_NS


def ns_to_ticks(ns: Column) -> Column:
    return F.floor(ns / TICK_NS).cast("long")


def fixed_period(whole: Column, fraction: Column) -> Column:
    """A period whose fraction is in 65536ths."""
    return whole + fraction / 65536


def clamp_int32(v: Column) -> Column:
    return F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), v)).cast("int")


def unwrap_offset(master_us: Column) -> Column:
    """What to add to a doubly wrapped counter of ps to get the true ps; decimal, as ps overflow 64 bits after 106 days."""
    ps = master_us.cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return (ps - (ps % F.lit(WRAP_PS).cast("decimal(20,0)")) % F.lit(SHORT_WRAP_PS).cast("decimal(20,0)")).cast("decimal(38,0)")


def remote_time(t1: Column, rtt: Column) -> Column:
    """The remote time at the arrival of a frame: its sending and half the round trip, truncated towards zero."""
    return t1 + F.call_function("div", rtt, F.lit(2))


def edge_choice(edges: DataFrame, kind: str, edge_type: str = "edge_type") -> DataFrame:
    """The rising (0) or falling (1) edges; `both` can't be matched one to one and falls back to falling."""
    return edges.where(F.col(edge_type) == (0 if kind == "rising" else 1))


def register(spark: SparkSession) -> None:
    """The conversions as SQL functions of the session."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ticks_to_ns(x BIGINT) RETURNS BIGINT RETURN x * {TICK_NS}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fixed_period(w DOUBLE, f DOUBLE) RETURNS DOUBLE RETURN w + f / 65536")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION phase_degrees(delay_s DOUBLE, freq DOUBLE) RETURNS DOUBLE RETURN delay_s * freq * 360")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rtt_ps(t1 BIGINT, t2 BIGINT, t3 BIGINT, t4 BIGINT) RETURNS BIGINT RETURN (t4 - t1) - (t3 - t2)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION remote_time(t1 BIGINT, rtt BIGINT) RETURNS BIGINT RETURN t1 + rtt div 2")
    # The time at half the peak by least squares through points, the middle point's where no line fits.
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION regress_time(trigger BIGINT, peak DOUBLE, points ARRAY<STRUCT<off: INT, v: DOUBLE>>) RETURNS DOUBLE RETURN aggregate(points,
        named_struct('n', 0D, 'sx', 0D, 'sy', 0D, 'sxy', 0D, 'sxx', 0D),
        (s, p) -> named_struct('n', s.n + 1, 'sx', s.sx + p.off, 'sy', s.sy + p.v, 'sxy', s.sxy + p.off * p.v, 'sxx', s.sxx + CAST(p.off AS DOUBLE) * p.off),
        s -> CASE WHEN s.n >= 2 AND abs(s.n * s.sxx - s.sx * s.sx) >= 1e-12D AND abs((s.n * s.sxy - s.sx * s.sy) / (s.n * s.sxx - s.sx * s.sx)) >= 1e-12D
             THEN trigger + (peak * 0.5D - (s.sy - (s.n * s.sxy - s.sx * s.sy) / (s.n * s.sxx - s.sx * s.sx) * s.sx) / s.n) / ((s.n * s.sxy - s.sx * s.sy) / (s.n * s.sxx - s.sx * s.sx))
             ELSE trigger + CAST(coalesce(get(points, CAST(size(points) div 2 AS INT)).off, 0) AS DOUBLE) END)""")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION unwrap_offset(us BIGINT) RETURNS DECIMAL(38,0) RETURN CAST(us AS DECIMAL(20,0)) * 1000000 - (CAST(us AS DECIMAL(20,0)) * 1000000 % {WRAP_PS}BD) % {SHORT_WRAP_PS}BD")
