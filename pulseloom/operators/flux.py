"""Dashboard-style operators: time ranges, tags, windows, pivots, derivatives."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import prefix


#: The units of relative times, in microseconds.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def instant(value: object, now: int | None = None) -> object:
    """A time as it is, or microseconds from one like -5m or 30d, relative to now; now() is now itself."""
    if not isinstance(value, str):
        return value
    if value == "now()":
        return now
    found = re.fullmatch(r"([+-]?\d+)(us|ms|s|m|h|d|w)", value)
    if not found or now is None:
        raise ValueError(f"{value!r} isn't a time relative to now")
    return now + int(found[1]) * UNITS[found[2]]


def f_range(df: DataFrame, ts: str, start: object = None, stop: object = None, now: int | None = None) -> DataFrame:
    """Rows in [start, stop), each a time, a time relative to now, or open."""
    start, stop = instant(start, now), instant(stop, now)
    out = df if start is None else df.where(F.col(ts) >= F.lit(start))
    return out if stop is None else out.where(F.col(ts) < F.lit(stop))


def without_range(df: DataFrame, ts: str, start: object = None, stop: object = None, now: int | None = None, **tags: object) -> DataFrame:
    """df without the rows in [start, stop) whose tags have the given values: what a delete leaves."""
    gone = F.lit(True)
    for limit, test in ((instant(start, now), lambda x: F.col(ts) >= F.lit(x)), (instant(stop, now), lambda x: F.col(ts) < F.lit(x))):
        gone = gone if limit is None else gone & test(limit)
    for c, v in tags.items():
        gone = gone & (F.col(c) == F.lit(v))
    return df.where(~F.coalesce(gone, F.lit(False)))


def f_tags(df: DataFrame, eq: dict | None = None, neq: dict | None = None, regex: dict | None = None, exists: list[str] | None = None) -> DataFrame:
    """Rows whose tags equal (one of), differ from, match, or exist; an empty value or list means all."""
    tests: list[Column] = []
    for c, v in (eq or {}).items():
        values = v if isinstance(v, list) else [v]
        if [x for x in values if x not in ("", None)]:
            tests.append(F.col(c).isin([x for x in values if x not in ("", None)]))
    tests += [F.col(c) != v for c, v in (neq or {}).items()]
    tests += [F.col(c).rlike(v) for c, v in (regex or {}).items() if v]
    tests += [F.col(c).isNotNull() for c in exists or []]
    return df.where(functools.reduce(operator.and_, tests)) if tests else df


def m_scale(df: DataFrame, col: str, mul: float = 1, div: float = 1) -> DataFrame:
    return df.withColumn(col, F.col(col) * mul / div)


def m_relabel(df: DataFrame, col: str, mapping: dict[str, str], default: str | None = None) -> DataFrame:
    out = F.lit(default) if default is not None else F.col(col)
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, F.lit(v)).otherwise(out)
    return df.withColumn(col, out)


def m_keep(df: DataFrame, cols: dict[str, str | Column]) -> DataFrame:
    """Only the named columns: {new name: column name or expression}."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])


def pivot_fields(df: DataFrame, keys: list[str], field: str, value: str, fields: list[str]) -> DataFrame:
    """Narrow to wide; the fields are named, so no job is needed to find them."""
    return df.groupBy(*keys).pivot(field, fields).agg(F.first(value, ignorenulls=True))


def unpivot_fields(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    return df.unpivot(ids, cols, "field", "value")


def window_start(us: str, every_us: int) -> Column:
    return (F.floor(F.col(us) / every_us) * every_us).cast("long")


def agg_window(df: DataFrame, us: str, every_us: int, fn: str, by: list[str], value: str, tiebreak: str | None = None) -> DataFrame:
    """by..., window_end (µs), value: mean or last per epoch-aligned window; empty windows are absent."""
    last = F.max_by(value, F.struct(us, tiebreak) if tiebreak else F.col(us))
    agg = {"mean": F.avg(value), "last": last, "min": F.min(value), "max": F.max(value), "sum": F.sum(value), "count": F.count(value)}[fn]
    return df.groupBy(*by, (window_start(us, every_us) + every_us).alias("window_end")).agg(agg.alias("value"))


def window_range(df: DataFrame, us: str, every_us: int, by: list[str], lo: str, hi: str) -> DataFrame:
    """by..., window_end, range: the windowed mean of hi less that of lo."""
    return df.groupBy(*by, (window_start(us, every_us) + every_us).alias("window_end")).agg((F.avg(hi) - F.avg(lo)).alias("range"))


def derivative(df: DataFrame, by: list[str], order: list[str], us: str, value: str, unit_us: int = 1_000_000, on_reset: str = "zero", width: float | None = None) -> DataFrame:
    """df with rate per unit of a counter; the first row of a series goes, a fall restarts at zero or gives null."""
    seen = prefix(df, by, order, width, lags={"_v": value, "_u": us}) if width else df.withColumn("_v", F.lag(value).over(Window.partitionBy(*by).orderBy(*order))).withColumn("_u", F.lag(us).over(Window.partitionBy(*by).orderBy(*order)))
    fallen = F.col(value) < F.col("_v")
    grown = F.when(fallen, F.col(value) if on_reset == "zero" else F.lit(None)).otherwise(F.col(value) - F.col("_v"))
    span = (F.col(us) - F.col("_u")) / unit_us
    return seen.where("_u is not null").withColumn("rate", F.when(span > 0, grown / span)).drop("_v", "_u")


def unique_first(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """The first row of each value of col in the given order."""
    one = df.groupBy(col).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return one.select("_row.*")


def tag_values(dfs: list[DataFrame], col: str) -> DataFrame:
    return functools.reduce(DataFrame.union, [d.select(col) for d in dfs]).distinct()


def union_literal(df: DataFrame, rows: list[dict]) -> DataFrame:
    extra = df.sparkSession.createDataFrame([tuple(r.get(c) for c in df.columns) for r in rows], df.schema)
    return df.unionByName(extra)


def first_last(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    key = F.struct(*order)
    return df.groupBy(*by).agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"))


def latest_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def every_nth(df: DataFrame, by: list[str], order: list[str], n: int, width: float) -> DataFrame:
    """Rows 1, 1 + n, 1 + 2n ... of each key."""
    return prefix(df, by, order, width, rn="_rn").where((F.col("_rn") - 1) % n == 0).drop("_rn")
