"""Checks and projections before writing, and the experiment log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import prefix


def monotonic_violations(df: DataFrame, by: list[str], order: list[str], t: str, width: float = 1e9) -> DataFrame:
    """Rows whose t lies before that of the row before them in their key."""
    return prefix(df, by, order, width, lags={"before": t}).where(F.col(t) < F.col("before"))


def write_edges(df: DataFrame, path: str, by: list[str], order: list[str], t: str, append: bool = False) -> None:
    """Writes a series as Parquet; refuses times that run backwards, and an existing target unless it is appended to.

    Appended rows must not lie before the last ones of their key that are there. What is checked is what is written:
    both come from one scan, which is kept until the check has passed.
    """
    seen = prefix(df, by, order, 1e9, lags={"_before": t}).persist()
    try:
        if seen.where(F.col(t) < F.col("_before")).limit(1).count():
            raise ValueError(f"{t} runs backwards")
        if append:
            there = df.sparkSession.read.parquet(path).groupBy(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]).alias("_key") if by else F.lit(0).alias("_key")).agg(F.max(t).alias("_last"))
            key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]) if by else F.lit(0)
            if seen.withColumn("_own", key).join(there, F.col("_own") == F.col("_key")).where(F.col(t) < F.col("_last")).limit(1).count():
                raise ValueError(f"{t} lies before what is there")
        seen.select(df.columns).write.mode("append" if append else "errorifexists").parquet(path)
    finally:
        seen.unpersist()


def write_delays(df: DataFrame, path: str, t: str, delay: str, keep: list[str] | None = None) -> None:
    """Writes time_samples and delay_ns of a delay series as Parquet; rows without a delay are left out."""
    df.where(F.col(delay).isNotNull()).select(*(keep or []), F.col(t).cast("double").alias("time_samples"), F.col(delay).cast("double").alias("delay_ns")).write.mode("errorifexists").parquet(path)


def clamp_points(df: DataFrame, points: str, max_n: int = 255) -> DataFrame:
    """At most max_n points, offsets within 16 bits."""
    return df.withColumn(points, F.transform(F.slice(points, 1, max_n), lambda p: F.struct(F.greatest(F.lit(-32768), F.least(F.lit(32767), p["off"])).cast("int").alias("off"), p["v"].alias("v"))))


def export_delays(df: DataFrame, t: str, delay: str, rate: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """time_s with 9 and delay_ns with 3 decimals as text; without a rate t is an index."""
    first = F.format_string("%.9f", F.col(t) / rate).alias("time_s") if rate else F.col(t).alias("index")
    return df.select(*(keep or []), first, F.format_string("%.3f", F.col(delay).cast("double")).alias("delay_ns"))


def summary_json(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, F.to_json(F.struct(*[c for c in df.columns if c not in by])).alias("summary"))


def annotations_export(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), "experiment", "type", "description")).alias("value"), "ts", "experiment", "type").orderBy("ts", "experiment", "type").select("value")


def annotations_import(df: DataFrame, path: str) -> None:
    """Replaces all annotations."""
    df.write.mode("overwrite").parquet(path)


def experiment_log(cmds: DataFrame, by: list[str], width: float = 65536) -> DataFrame:
    """by..., ord, step, experiment, type, description of a log of commands(by..., ord, type, experiment, description).

    A start while another experiment is active first stops that one. Events and stops belong to the active
    experiment, or to `unnamed`. Names with a backslash are rejected. The state before each command is found in two
    levels, by buckets of `width` of ord, which is numeric and differs within a key: no key is one task.
    """
    good = cmds.where(~F.coalesce(F.contains("experiment", F.lit("\\")), F.lit(False)) & ~F.coalesce(F.contains("description", F.lit("\\")), F.lit(False)))
    state = F.when(F.col("type") == "start", F.struct(F.col("experiment").alias("name"))).when(F.col("type") == "stop", F.struct(F.lit(None).cast("string").alias("name")))
    rows = prefix(good.withColumn("_set", state), by, ["ord"], width, lasts={"_state": "_set"}).withColumn("_active", F.col("_state.name"))
    own = rows.select(*by, F.col("ord"), F.lit(1).alias("step"), F.when(F.col("type") == "start", F.col("experiment")).otherwise(F.coalesce("_active", F.lit("unnamed"))).alias("experiment"), "type", F.coalesce("description", F.lit("")).alias("description"))
    stops = rows.where("type = 'start' and _active is not null").select(*by, "ord", F.lit(0).alias("step"), F.col("_active").alias("experiment"), F.lit("stop").alias("type"), F.lit("auto").alias("description"))
    return own.unionByName(stops)
