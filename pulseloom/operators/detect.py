"""Edge detection on sampled signals, as ordered expressions on (key, index, value) rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scale import bucket_of, prefix


def _exits(times: Iterator, min_distance: float) -> list[tuple]:
    """(to, exit): the last kept time of a bucket for each way into it, its times given in order.

    Whatever was kept before, the first row kept here is one of those from the first up to the first at least
    min_distance after it. All of them are followed at once; ways that meet go on as one. A pair stands for the
    ways up to `to` and after the pair before, which all end at `exit`.
    """
    ways, parent, ends, first, opened = deque(), [], [], None, True
    entries = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for t in times:
        if entries and t == entries[-1]:
            continue
        first = t if first is None else first
        due = None
        while ways and t - ways[0][0] >= min_distance:
            i = ways.popleft()[1]
            if due is None:
                due = i
            else:
                parent[i] = due
        if opened:
            entries.append(t)
            parent.append(len(parent) if due is None else due)
            ends.append(t)
            due = parent[-1]
            opened = t - first < min_distance
        if due is not None:
            ends[due] = t
            ways.append((t, due))
    out: list[tuple] = []
    for i, t in enumerate(entries):
        end = ends[root(i)]
        if out and out[-1][1] == end:
            out.pop()
        out.append((t, end))
    return out


def debounce(df: DataFrame, by: list[str], order: list[str], t: str, min_distance: float, width: float | None = None) -> DataFrame:
    """The rows at least min_distance after the last kept one of their key; t is order[0], rows without it are dropped.

    A two-level scan: buckets of `width` (min_distance at least) are summed up to their last kept time for each way
    into them, the summaries are chained per key, and each bucket is gone through again from the time kept before
    it. Rows stream through in order; a task holds numbers for the rows within min_distance of a bucket's start.
    """
    if min_distance <= 0:
        return df
    own, kind, n = df.columns, df.schema[t].dataType, len(by)
    keys = [df.schema[c] for c in by] + [T.StructField("_b", T.LongType())]
    cut = df.where(F.col(t).isNotNull()).withColumn("_b", bucket_of(t, max(width or 1000 * min_distance, min_distance)))

    def groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
        """(key, its rows' other values) of batches that start with `size` columns of a key and are sorted by it."""
        rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for key, some in groupby(rows, lambda r: r[:size]):
            yield key, (r[size:] for r in some)

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def in_parts(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        while part := list(islice(rows, 10_000)):
            yield batch_of(part, schema)

    summary = T.StructType([*keys, T.StructField("to", kind), T.StructField("exit", kind)])
    summary_arrow = to_arrow_schema(summary)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_parts(((*key, *pair) for key, rows in groups(batches, n + 1) for pair in _exits((r[0] for r in rows), min_distance)), summary_arrow)

    ways = cut.select(*by, "_b", F.col(t).alias("_t")).repartition(*by, "_b").sortWithinPartitions(*by, "_b", "_t").mapInArrow(sum_up, summary)
    start = T.StructType([*keys, T.StructField("_last", kind)])
    start_arrow = to_arrow_schema(start)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, rows in groups(batches, n):
            last = None
            for b, pairs in groupby(rows, lambda r: r[0]):
                yield *key, b, last
                last = next((end for _, to, end in pairs if last is None or to - last >= min_distance), last)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_parts(chained(batches), start_arrow)

    starts = (ways.repartition(*by) if by else ways.repartition(1)).sortWithinPartitions(*by, "_b", "to").mapInArrow(chain, start)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each bucket's first row is its start, with the time kept before it.
        last = None
        for batch in batches:
            mask = []
            for is_start, before, time in zip(*[batch.column(c).to_pylist() for c in ("_start", "_last", "_time")], strict=True):
                good = not is_start and (last is None or time - last >= min_distance)
                last = before if is_start else time if good else last
                mask.append(good)
            yield batch.select(own).filter(pa.array(mask, pa.bool_()))

    rows = cut.select("*", F.lit(None).cast(kind).alias("_last"), F.lit(False).alias("_start"), F.col(t).alias("_time"))
    heads = starts.select(*[c if c in by else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in own], "_b", "_last", F.lit(True).alias("_start"), F.lit(None).cast(kind).alias("_time"))
    both = heads.unionByName(rows).repartition(*by, "_b").sortWithinPartitions(*by, "_b", F.col("_start").desc(), *order)
    return both.mapInArrow(keep, df.schema)


def _near(df: DataFrame, by: list[str], idx: str, v: str, width: float, after: bool = False) -> DataFrame:
    """df with the value before (and after) each sample, across bucket borders."""
    return prefix(df, by, [idx], width, lags={"_prev": v}, leads={"_next": v} if after else None)


def detect_crossings(df: DataFrame, by: list[str], idx: str, v: str, threshold: float, min_distance: float, width: float = 65536) -> DataFrame:
    """by..., t, edge_type: threshold crossings with linear interpolation, debounced per type.

    edge_type 0 (rising) is a fall through -threshold, 1 (falling) a rise through +threshold.
    """
    near = _near(df, by, idx, v, width).where("_prev is not null")
    a, b = F.col("_prev"), F.col(v)
    rise, fall = (a > -threshold) & (b <= -threshold), (a < threshold) & (b >= threshold)
    level = F.when(rise, F.lit(-float(threshold))).otherwise(F.lit(float(threshold)))
    found = near.where(rise | fall).select(*by, (F.col(idx) - 1 + (level - a) / (b - a)).alias("t"), F.when(rise, 0).otherwise(1).alias("edge_type"), F.col(idx).alias("idx"))
    return debounce(found, [*by, "edge_type"], ["t", "idx"], "t", min_distance).select(*by, "t", "edge_type")


def vertex(before: Column, at: Column, after: Column) -> Column:
    """Offset of a parabola's vertex through three samples, within -1..1; 0 if they are flat."""
    bend = before - 2 * at + after
    return F.when(F.abs(bend) < 1e-10, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (before - after) / (2 * bend))))


def detect_peaks(df: DataFrame, by: list[str], idx: str, v: str, min_height: float, min_distance: float, width: float = 65536) -> DataFrame:
    """by..., t, edge_type, height: strict local extrema beyond min_height at their parabolic vertex, debounced per type."""
    near = _near(df, by, idx, v, width, after=True)
    p, c, n = F.col("_prev"), F.col(v), F.col("_next")
    top, bottom = (c > p) & (c > n) & (c > min_height), (c < p) & (c < n) & (c < -min_height)
    found = near.where(top | bottom).select(*by, (F.col(idx) + vertex(p, c, n)).alias("t"), F.when(bottom, 0).otherwise(1).alias("edge_type"), c.alias("height"), F.col(idx).alias("idx"))
    return debounce(found, [*by, "edge_type"], ["t", "idx"], "t", min_distance).select(*by, "t", "edge_type", "height")


def detect_hysteresis(df: DataFrame, by: list[str], idx: str, v: str, neg: float, pos: float, reset: float, width: float = 65536) -> DataFrame:
    """by..., idx, edge_type: the first sample of each polarity since |v| was last below reset."""
    segments = prefix(df.withColumn("_reset", F.when(F.abs(F.col(v)) < reset, 1).otherwise(0)), by, [idx], width, sums={"segment": "_reset"})
    kind = F.when(F.col(v) <= neg, 0).when(F.col(v) >= pos, 1)
    return segments.withColumn("edge_type", kind).where("edge_type is not null").groupBy(*by, "segment", "edge_type").agg(F.min(idx).alias("idx")).drop("segment")


def refine_parabolic(df: DataFrame, by: list[str], idx: str, v: str, at: DataFrame) -> DataFrame:
    """at(by..., idx) with t: the vertex through idx - 1, idx and idx + 1; unchanged at borders, flat spots and far vertices."""
    samples = df.select(*by, F.col(idx).alias("_i"), F.col(v).alias("_v"))
    wanted = at.select(*by, idx, F.explode(F.array(F.col(idx) - 1, F.col(idx), F.col(idx) + 1)).alias("_i"))
    met = wanted.join(samples, [*by, "_i"]).groupBy(*by, idx).agg(*[F.max(F.when(F.col("_i") == F.col(idx) + k, F.col("_v"))).alias(n) for k, n in ((-1, "_p"), (0, "_c"), (1, "_n"))])
    bend = F.col("_p") - 2 * F.col("_c") + F.col("_n")
    off = (F.col("_p") - F.col("_n")) / (2 * bend)
    good = bend.isNotNull() & (F.abs(bend) >= 1e-10) & (F.abs(off) <= 1)
    return met.select(*by, idx, F.when(good, F.col(idx) + off).otherwise(F.col(idx).cast("double")).alias("t"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fit_time(points: Column, level: Column, trigger: Column, fallback: Column) -> Column:
    """trigger + the offset at which the least-squares line through points(x, y) reaches level; sums are of offsets."""
    n = F.size(points).cast("double")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("sx", "sy", "sxy", "sxx")])

    def add(s: Column, p: Column) -> Column:
        x, y = p["x"].cast("double"), p["y"].cast("double")
        return F.struct((s["sx"] + x).alias("sx"), (s["sy"] + y).alias("sy"), (s["sxy"] + x * y).alias("sxy"), (s["sxx"] + x * x).alias("sxx"))

    def line(s: Column) -> Column:
        flat = n * s["sxx"] - s["sx"] * s["sx"]
        slope = (n * s["sxy"] - s["sx"] * s["sy"]) / flat
        cut = (s["sy"] - slope * s["sx"]) / n
        return F.when((n < 2) | (F.abs(flat) < 1e-12), fallback).when(F.abs(slope) < 1e-12, fallback).otherwise(trigger + (level - cut) / slope)

    return once(F.aggregate(points, zero, add), line)


def regress_points(df: DataFrame, trigger: str, peak: str, points: str) -> DataFrame:
    """df with t: the time at half the peak by least squares on points(off, v); few or flat points fall back to the middle one."""
    pairs = F.transform(points, lambda p: F.struct(p["off"].alias("x"), p["v"].alias("y")))
    middle = F.get(points, F.floor(F.size(points) / 2).cast("int"))["off"]
    spare = F.col(trigger) + F.coalesce(middle.cast("double"), F.lit(0.0))
    return df.withColumn("t", fit_time(pairs, F.col(peak) * 0.5, F.col(trigger).cast("double"), spare))


def detect_linreg(df: DataFrame, by: list[str], idx: str, v: str, threshold: float, peak_search: int = 15, low: float = 0.2, high: float = 0.8, min_distance: float = 0, width: float = 65536) -> DataFrame:
    """by..., t, edge_type, height: crossings timed by least squares on the flank before the peak that follows.

    The flank are the points of the 10 samples before the peak between low and high of it; candidates without
    any are skipped before the debounce, so they don't reset it. Indexes are consecutive within a key.
    """
    near = _near(df, by, idx, v, width).where("_prev is not null")
    a, b = F.col("_prev"), F.col(v)
    rise, fall = (a > -threshold) & (b <= -threshold), (a < threshold) & (b >= threshold)
    found = near.where(rise | fall).select(*by, F.col(idx).alias("_at"), F.when(rise, 0).otherwise(1).alias("edge_type"))
    wanted = found.select("*", F.explode(F.sequence(F.col("_at") - 11, F.col("_at") + peak_search)).alias(idx))
    around = wanted.join(df.select(*by, idx, v), [*by, idx]).groupBy(*by, "_at", "edge_type").agg(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.when(F.col("edge_type") == 0, -F.col(v)).otherwise(F.col(v)).cast("double").alias("v")))).alias("w"))
    after = F.filter("w", lambda p: p["i"] >= F.col("_at"))
    top = F.array_max(F.transform(after, lambda p: F.struct(p["v"].alias("v"), (-p["i"]).alias("i"))))

    def flank(top: Column) -> Column:
        peak = -top["i"]
        inside = F.filter("w", lambda p: (p["i"] >= peak - 10) & (p["i"] < peak) & (p["v"] >= top["v"] * low) & (p["v"] <= top["v"] * high))
        return F.struct(top["v"].alias("height"), F.transform(inside, lambda p: F.struct((p["i"] - F.col("_at")).alias("x"), p["v"].alias("y"))).alias("points"))

    # As a generator's row, the flank is made once for each candidate.
    marked = around.select(*by, "_at", "edge_type", F.inline(F.array(once(top, flank)))).where("size(points) > 0")
    time = fit_time(F.col("points"), F.col("height") * 0.5, F.col("_at").cast("double"), F.col("_at") + F.get("points", F.lit(0))["x"].cast("double"))
    timed = marked.select(*by, time.alias("t"), "edge_type", "height", F.col("_at").alias("idx"))
    return (debounce(timed, [*by, "edge_type"], ["t", "idx"], "t", min_distance) if min_distance else timed).select(*by, "t", "edge_type", "height")


def skip_settle(df: DataFrame, by: list[str], idx: str, v: str, skip: int, reset: float) -> DataFrame:
    """The samples from the first one at or after `skip` with |v| below reset."""
    first = df.where((F.col(idx) >= skip) & (F.abs(F.col(v)) < reset)).groupBy(*by).agg(F.min(idx).alias("_start"))
    joined = df.join(first, by) if by else df.join(F.broadcast(first), F.col(idx) >= F.col("_start"))
    return joined.where(F.col(idx) >= F.col("_start")).drop("_start")
