"""Console logs of the devices, as rows (file, line_no, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fields of the session record, and of the other console records, with their types.
SESSION = ["session", "status", "entries", "rtt_avg", "rtt_min", "rtt_max", "rssi_avg", "rssi_min", "rssi_max"]
RECORDS = {
    "REGR": [("new", "bigint"), ("session", "bigint"), ("n", "bigint"), ("slope_m1", "double"), ("std_ns", "double"), ("r2", "double"), ("local_ref", "bigint"), ("remote_ref", "bigint")],
    "DTC": [("cycle", "bigint"), ("local_ticks", "bigint"), ("base_period_fp16", "bigint")],
    "DTR": [("cycle", "bigint"), ("cycle_delta", "bigint"), ("period_ticks", "bigint"), ("period_ticks_delta", "bigint")],
    "MAC_TIMER_ALIGN": [("run", "bigint"), ("offset", "bigint"), ("min", "bigint"), ("max", "bigint")],
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line of the lines of text files that aren't empty; empty ones are counted.

    A file is read block by block: lines are numbered within their block, and the blocks before it are added, so files of
    any size are split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    placed = lines.withColumn("_n", F.row_number().over(Window.partitionBy("file", "_block").orderBy("_id")))
    sizes = placed.groupBy("file", "_block").agg(F.max("_n").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "_block", before.alias("_before"))
    return placed.join(starts, ["file", "_block"]).where("line <> ''").select("file", (F.col("_n") + F.col("_before") - 1).alias("line_no"), "line")


def parse_ftm_log(lines: DataFrame) -> DataFrame:
    """file, line_no, ts, session...: FTM records anywhere in a line, empty fields null.

    Stamps are `[date time]`, `date time` or a time alone, which takes the date of the first dated session earlier
    in the file; without one ts is null. Midnight isn't noticed. Malformed records and headers are left out.
    """
    parts = F.struct(
        F.split(F.regexp_extract("line", r"FTM,(.*)$", 1), ",").alias("body"),
        F.regexp_extract("line", r"(\d{4}-\d\d-\d\d)[ T]\d\d:\d\d:\d\d", 1).alias("_date"),
        F.regexp_extract("line", r"(\d\d:\d\d:\d\d(?:\.\d{1,6})?)", 1).alias("_time"),
    )
    # As a generator's row, the parts are made once for each line and not once for each use.
    rows = lines.where(F.contains("line", F.lit("FTM,"))).select("file", "line_no", F.inline(F.array(parts))).where("size(body) >= 9")
    fields = [F.expr(f"try_cast(nullif(trim(try_element_at(body, {k + 1})), '') AS BIGINT)").alias(c) for k, c in enumerate(SESSION)]
    rows = rows.select("file", "line_no", *fields, "_date", "_time").where("session is not null and status is not null")
    dated = rows.where("_date <> ''").groupBy(F.col("file").alias("_file")).agg(F.min("line_no").alias("_since"), F.min_by("_date", "line_no").alias("_base"))
    rows = rows.join(dated, (F.col("file") == F.col("_file")) & (F.col("line_no") >= F.col("_since")), "left")
    day = F.when(F.col("_date") != "", F.col("_date")).otherwise(F.col("_base"))
    ts = F.try_to_timestamp(F.when(F.col("_time") != "", F.concat(day, F.lit(" "), F.col("_time"))))
    return rows.select("file", "line_no", ts.alias("ts"), *SESSION)


def parse_device_log(lines: DataFrame, tag: str) -> DataFrame:
    """file, line_no and typed fields of one kind of console record; headers and malformed lines are left out."""
    fields = RECORDS[tag]
    body = F.split(F.regexp_extract("line", rf"(?:^|[^A-Z_]){tag},(.*)$", 1), ",")
    rows = lines.where(F.contains("line", F.lit(tag + ","))).withColumn("body", body).where(F.size("body") == len(fields))
    out = rows.select("file", "line_no", *[F.expr(f"try_cast(trim(body[{k}]) AS {t})").alias(c) for k, (c, t) in enumerate(fields)])
    return out.where(" and ".join(f"`{c}` is not null" for c, _ in fields))


def read_meta(spark: SparkSession, path: str, sample_rate: float | None = None, default_rate: float = 10e6) -> DataFrame:
    """The capture's side file with its sample rate: a rate other than the default that the caller names goes first."""
    meta = spark.read.json(path, multiLine=True)
    there = F.col("sample_rate").cast("double") if "sample_rate" in meta.columns else F.lit(None).cast("double")
    named = F.lit(sample_rate if sample_rate not in (None, default_rate) else None).cast("double")
    return meta.withColumn("sample_rate", F.coalesce(named, there, F.lit(default_rate)))


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of annotation files: good have time, experiment and type; times may end in Z."""
    raw = spark.read.schema("time STRING, experiment STRING, type STRING, description STRING, _bad STRING").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)
    ok = F.col("time").isNotNull() & F.col("experiment").isNotNull() & F.col("type").isNotNull() & F.try_to_timestamp("time").isNotNull()
    good = raw.where(ok).select(F.try_to_timestamp("time").alias("ts"), "experiment", "type", F.coalesce("description", F.lit("")).alias("description"))
    return good, raw.where(~ok)
