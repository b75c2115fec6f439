"""Jitter, period, skew, session and histogram statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .scale import prefix

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def phase_degrees(delay_s: Column, freq: float) -> Column:
    return delay_s * freq * 360


def _with_group_value(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """df beside aggregates of its group (one row per group, joined back)."""
    one = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    if not by:
        return df.join(F.broadcast(one), F.lit(True))
    keys = one.select(*[F.col(c).alias(f"_g_{c}") for c in by], *aggs)
    match = F.col(by[0]).eqNullSafe(F.col(f"_g_{by[0]}"))
    for c in by[1:]:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return df.join(keys, match).drop(*[f"_g_{c}" for c in by])


#: Points of the sketch that narrows a rank down, and rows of a group that are sorted together at most.
GRID, SORTED = 256, 1 << 16


def exact_quantiles(df: DataFrame, v: str, by: list[str], quantiles: dict[str, float], discrete: bool = False, most: int = SORTED, also: dict[str, Column] | None = None) -> DataFrame:
    """by..., a column for each of quantiles {name: share} of v, exactly and without a group in one task; also other aggregates.

    Selection by rounds: a mergeable sketch of each group's values gives two of them that surely enclose the rank,
    whatever the values look like, and what lies below is counted. A round keeps about a hundredth of the rows of a
    rank, until no more than `most` are left (or only equal ones), which are counted by value and sorted. Counts prove
    each step: where a sketch should err, the bounds before it hold. Ranks are interpolated between neighbours;
    `discrete` takes the value at index int(n share). Nulls don't count, NaN is the largest value.
    """
    group = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit(0).alias("one"))
    names, also = list(quantiles), also or {}
    rows = df.where(F.col(v).isNotNull()).select("*", group.alias("_g"), F.col(v).cast("double").alias("_v"))
    shares = [i / GRID for i in range(GRID + 1)]

    def grid(x: Column) -> Column:
        return F.percentile_approx(x, F.array(*[F.lit(s) for s in shares]), 20 * GRID)

    first = rows.groupBy("_g").agg(F.count("*").alias("_n"), grid(F.col("_v")).alias("_grid"), *[c.alias(n) for n, c in also.items()])
    # A round's bounds: old ones, and closer ones from the grid around the rank; bounds and counts are one row a group.
    state = first.select("_g", "_n", *also, *[c for k, name in enumerate(names) for c in (
        (F.floor(F.col("_n") * F.lit(quantiles[name])) if discrete else F.floor((F.col("_n") - 1) * F.lit(quantiles[name]))).alias(f"_r{k}"),
        F.lit(float("-inf")).alias(f"_lo{k}"), F.lit(float("nan")).alias(f"_hi{k}"), F.lit(0).cast("long").alias(f"_below{k}"), F.col("_n").alias(f"_in{k}"), F.lit(None).cast("double").alias(f"_next{k}"), F.col("_grid").alias(f"_grid{k}"))])
    state = saved(state, "ranks")
    large = F.array_max(F.array(*[F.when(F.col(f"_lo{k}") < F.col(f"_hi{k}"), F.col(f"_in{k}")).otherwise(0) for k in range(len(names))]))
    left = state.agg(F.max(large)).first()[0] or 0
    while left > most:
        closer = []
        for k in range(len(names)):
            place = (F.col(f"_r{k}") - F.col(f"_below{k}")) / F.col(f"_in{k}") * GRID
            low, high = F.floor(place).cast("int") - 1, F.ceil(place).cast("int") + 2
            points = F.col(f"_grid{k}")
            closer += [F.when(low >= 0, F.greatest(F.col(f"_lo{k}"), F.element_at(points, F.greatest(low, F.lit(0)) + 1))).otherwise(F.col(f"_lo{k}")).alias(f"_to{k}"), F.when(high <= GRID, F.least(F.col(f"_hi{k}"), F.element_at(points, F.least(high, F.lit(GRID)) + 1))).otherwise(F.col(f"_hi{k}")).alias(f"_up{k}")]
        asked = state.select("*", *closer)
        met = _beside_group(rows.select("_g", "_v"), asked.select(F.col("_g").alias("_og"), *[F.col(f"_{x}{k}") for k in range(len(names)) for x in ("to", "up")]))
        aggs = []
        for k in range(len(names)):
            inside = (F.col("_v") >= F.col(f"_to{k}")) & (F.col("_v") <= F.col(f"_up{k}"))
            aggs += [F.count_if(F.col("_v") < F.col(f"_to{k}")).alias(f"_b{k}"), F.count_if(inside).alias(f"_i{k}"), F.min(F.when(F.col("_v") > F.col(f"_up{k}"), F.col("_v"))).alias(f"_x{k}"), grid(F.when(inside, F.col("_v"))).alias(f"_p{k}")]
        counted = asked.join(met.groupBy("_g").agg(*aggs), "_g")
        new = []
        for k in range(len(names)):
            good = (F.col(f"_b{k}") <= F.col(f"_r{k}")) & (F.col(f"_r{k}") < F.col(f"_b{k}") + F.col(f"_i{k}"))
            new += [F.col(f"_r{k}"), *[F.when(good, F.col(f"_{n}{k}")).otherwise(F.col(f"_{o}{k}")).alias(f"_{o}{k}") for o, n in (("lo", "to"), ("hi", "up"), ("below", "b"), ("in", "i"), ("next", "x"), ("grid", "p"))]]
        state = saved(counted.select("_g", "_n", *also, *new), "ranks")
        before, left = left, state.agg(F.max(large)).first()[0] or 0
        if left >= before:
            break
    # What lies within the bounds, by value; equal values are one row.
    met = _beside_group(rows.select("_g", "_v"), state.select(F.col("_g").alias("_og"), *[F.col(f"_{x}{k}") for k in range(len(names)) for x in ("lo", "hi")]))
    within = F.filter(F.array(*[F.when((F.col("_v") >= F.col(f"_lo{k}")) & (F.col("_v") <= F.col(f"_hi{k}")), F.lit(k)) for k in range(len(names))]), lambda x: x.isNotNull())
    values = met.select("_g", F.explode(within).alias("_k"), "_v").groupBy("_g", "_k", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_g", "_k").orderBy("_v"))
    ranked = _beside_group(values.withColumn("_upto", upto), state.select(F.col("_g").alias("_og"), F.array(*[F.struct(F.col(f"_r{k}").alias("r"), F.col(f"_below{k}").alias("b")) for k in range(len(names))]).alias("_ranks")))
    place = F.element_at("_ranks", F.col("_k") + 1)
    at = place.getField("r") - place.getField("b")
    ranked = ranked.select("_g", "_k", "_v", (F.col("_upto") - F.col("_c")).alias("_from"), "_upto", at.alias("_at"))

    def pick(k: int, after: int) -> Column:
        index = F.col("_at") + after
        return F.max(F.when((F.col("_k") == k) & (index >= F.col("_from")) & (index < F.col("_upto")), F.col("_v")))

    found = ranked.groupBy("_g").agg(*[pick(k, after).alias(f"_v{k}_{after}") for k in range(len(names)) for after in (0, 1)])
    out = state.join(found, "_g")
    one = []
    for k, name in enumerate(names):
        low, high = F.col(f"_v{k}_0"), F.coalesce(f"_v{k}_1", f"_next{k}")
        part = (F.col("_n") - 1) * F.lit(quantiles[name]) - F.col(f"_r{k}")
        one.append((low if discrete else low + part * F.coalesce(high - low, F.lit(0.0))).alias(name))
    return out.select(*[F.col(f"_g.k{i}").alias(c) for i, c in enumerate(by)], *also, *one)


def _beside_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the columns of their group (one row for each, as _og)."""
    return rows.join(groups, F.col("_g") == F.col("_og")).drop("_og")


def jitter_stats(df: DataFrame, delay: str, by: list[str] | None = None, pulse_freq: float | None = None, approx: bool = False) -> DataFrame:
    """by..., n, mean, std (population), min, max, max_dev, p50..p999 of |delay - mean|, phase mean and std in degrees (delay in ns).

    Percentiles are exact (see exact_quantiles), or with `approx` of one pass and bounded error. Delays are written
    once, as all passes but the first need the mean.
    """
    by = by or []
    once = saved(df.where(F.col(delay).isNotNull()).select(*by, delay), "delays")
    rows = _with_group_value(once, by, _mean=F.avg(delay)).withColumn("_dev", F.abs(F.col(delay) - F.col("_mean")))
    aggs = {"n": F.count("*"), "mean": F.avg(delay), "std": F.stddev_pop(delay), "min": F.min(delay), "max": F.max(delay), "max_dev": F.max("_dev")}
    if approx:
        out = rows.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()], *[F.percentile_approx("_dev", q, 10_000).alias(n) for n, q in QUANTILES.items()])
    else:
        out = exact_quantiles(saved(rows.select(*by, delay, "_dev"), "deviations"), "_dev", by, QUANTILES, also=aggs)
    if pulse_freq is not None:
        out = out.withColumn("phase_mean_deg", phase_degrees(F.col("mean") * 1e-9, pulse_freq)).withColumn("phase_std_deg", phase_degrees(F.col("std") * 1e-9, pulse_freq))
    return out


def period_stats(df: DataFrame, period: str, nominal: float, by: list[str] | None = None) -> DataFrame:
    """by..., n, mean, std, min, max of a period in µs, its frequency in Hz and its error against nominal in ppm."""
    out = df.where(F.col(period).isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(period).alias("mean"), F.stddev_pop(period).alias("std"), F.min(period).alias("min"), F.max(period).alias("max"))
    return out.withColumn("freq", F.when(F.col("mean") != 0, 1e6 / F.col("mean"))).withColumn("ppm", -(F.col("mean") - nominal) / nominal * 1e6)


def frequency_skew(pa: DataFrame, pb: DataFrame, period: str, position: str | None = None) -> DataFrame:
    """ppm, ns_per_s, n of b's periods against a's; with `position` both are cut to their common number of rows first."""
    if position:
        ends = pa.agg(F.max(position).alias("x")).join(pb.agg(F.max(position).alias("y")), F.lit(True)).select(F.least("x", "y").alias("_n"))
        pa, pb = (p.join(F.broadcast(ends), F.col(position) <= F.col("_n")) for p in (pa, pb))
    a = pa.agg(F.avg(period).alias("ma"), F.count(period).alias("na"))
    b = pb.agg(F.avg(period).alias("mb"), F.count(period).alias("nb"))
    ppm = F.coalesce((F.col("ma") - F.col("mb")) / F.col("ma") * 1e6, F.lit(0.0))
    return a.join(b, F.lit(True)).select(ppm.alias("ppm"), (ppm * 1000).alias("ns_per_s"), F.least("na", "nb").alias("n"))


def online_stats(df: DataFrame, v: str, by: list[str]) -> DataFrame:
    """by..., n, mean, std, min, max, and percentiles that pick the value at index int(n p) without interpolation."""
    moments = {"n": F.count("*"), "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}
    return exact_quantiles(df, v, by, QUANTILES, discrete=True, also=moments)


def reservoir(df: DataFrame, v: str, by: list[str], unique: list[str], size: int) -> DataFrame:
    """The rows of df with a value whose hash of `unique` (what tells rows apart) is among the `size` smallest of their group.

    A uniform sample that doesn't depend on the order of rows, and merges: the smallest of several parts' reservoirs
    are the reservoir of all. Each task passes `size` rows of a group on at most. Rows that repeat `unique` are told
    apart by their value.
    """
    order = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in unique])), *unique, v)
    kept = df.where(F.col(v).isNotNull()).withColumn("_place", F.row_number().over(order))
    return kept.where(F.col("_place") <= size).drop("_place")


def reservoir_stats(df: DataFrame, v: str, by: list[str], unique: list[str], size: int = 10_000) -> DataFrame:
    """by..., n, mean, std, min, max of all rows, and of a reservoir its size, p50..p999 and the largest deviation from the mean.

    Percentiles pick the value at index int(size p) of the sorted reservoir, without interpolation. Moments merge as
    sums do; the reservoir, of at most `size` values a group, is sorted in one array.
    """
    moments = df.where(F.col(v).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    sample = reservoir(df, v, by, unique, size).groupBy(*by).agg(F.sort_array(F.collect_list(F.col(v).cast("double"))).alias("_all"))
    group = [F.struct(*by).alias("_g")] if by else [F.lit(0).alias("_g")]
    met = moments.select("*", *group).join(sample.select(*group, "_all").withColumnRenamed("_g", "_h"), F.col("_g") == F.col("_h"))
    held = F.size("_all")
    picks = [F.get("_all", F.least(F.floor(held * F.lit(q)).cast("int"), held - 1)).alias(name) for name, q in QUANTILES.items()]
    far = F.greatest(F.abs(F.get("_all", F.lit(0)) - F.col("mean")), F.abs(F.get("_all", held - 1) - F.col("mean")))
    return met.select(*by, "n", "mean", "std", "min", "max", held.alias("held"), *picks, far.alias("max_dev"))


def session_stats(df: DataFrame, by: list[str], rtt: str = "rtt", rssi: str = "rssi") -> DataFrame:
    """by..., n, and truncated average, min, max of rtt and rssi (64-bit division as in C)."""
    out = []
    for c in (rtt, rssi):
        out += [F.expr(f"sum({c}) div count({c})").alias(f"{c}_avg"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *out)


def session_quality(df: DataFrame, by: list[str], frames: int = 64) -> DataFrame:
    """by..., sessions, ok, success_rate, entry_rate and rtt / rssi statistics over successful sessions of df(status, entries, rtt, rssi)."""
    ok = F.coalesce((F.col("status") == 0) & (F.col("entries") > 0), F.lit(False))
    aggs = [F.count("*").alias("sessions"), F.sum(ok.cast("long")).alias("ok"), (F.sum(ok.cast("long")) / F.count("*")).alias("success_rate"), (F.coalesce(F.sum("entries"), F.lit(0)) / (frames * F.count("*"))).alias("entry_rate")]
    for c in ("rtt", "rssi"):
        v = F.when(ok, F.col(c))
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*aggs)


def histogram(df: DataFrame, v: str, bins: int, by: list[str] | None = None, fit: bool = False) -> DataFrame:
    """bin, by..., lo, hi, n: equal bins over all values' range, the last one closed; fit adds the normal curve's expected count."""
    by = by or []
    ends = df.agg(F.min(v).alias("_min"), F.max(v).alias("_max"), F.avg(v).alias("_mu"), F.stddev_pop(v).alias("_sd"), F.count(v).alias("_all"))
    rows = df.where(F.col(v).isNotNull()).join(F.broadcast(ends), F.lit(True)).withColumn("_w", (F.col("_max") - F.col("_min")) / bins)
    k = F.when(F.col("_w") == 0, 0).otherwise(F.least(F.floor((F.col(v) - F.col("_min")) / F.col("_w")), F.lit(bins - 1))).cast("int")
    out = rows.withColumn("bin", k).groupBy("bin", *by).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("_min", "_w", "_mu", "_sd", "_all")])
    lo = F.col("_min") + F.col("bin") * F.col("_w")
    keep = ["bin", *by, lo.alias("lo"), (lo + F.col("_w")).alias("hi"), "n"]
    if fit:
        z = (lo + F.col("_w") / 2 - F.col("_mu")) / F.col("_sd")
        keep.append((F.exp(-z * z / 2) / (F.col("_sd") * F.sqrt(2 * F.pi())) * F.col("_all") * F.col("_w")).alias("fit"))
    return out.select(*keep)


def block_stats(df: DataFrame, v: str, n: int, by: list[str], order: list[str], width: float) -> DataFrame:
    """by..., block, mean, std of each n consecutive rows; an incomplete tail is dropped unless it is all there is."""
    rows = prefix(df, by, order, width, rn="_rn").withColumn("block", F.floor((F.col("_rn") - 1) / n))
    out = rows.groupBy(*by, "block").agg(F.count("*").alias("_n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return out.where((F.col("_n") == n) | (F.col("block") == 0)).drop("_n")


def run_stats(df: DataFrame, run: str, value: str, order: str, full: int = 100) -> DataFrame:
    """run, n, distinct, last of each run, with is_full."""
    return df.groupBy(run).agg(F.count("*").alias("n"), F.count_distinct(value).alias("distinct"), F.max_by(value, order).alias("last")).withColumn("is_full", F.col("n") == full)


def run_rollup(runs: DataFrame) -> DataFrame:
    """One row over run_stats: mean, min and max of rows and distinct values a run, and how many runs are full."""
    spans = [f(c).alias(f"{c}_{name}") for c in ("n", "distinct") for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return runs.agg(F.count("*").alias("runs"), *spans, F.sum(F.col("is_full").cast("long")).alias("full"))


def drop_last_run(df: DataFrame, run: str, order: str, full: int = 100) -> DataFrame:
    """df without the run of its last row, if that run has fewer than `full` rows."""
    last = df.agg(F.max_by(run, order).alias("_last"))
    short = df.join(F.broadcast(last), F.col(run) == F.col("_last"), "left_semi").groupBy(run).count().where(F.col("count") < full).select(run)
    return df.join(short, run, "left_anti")


def interval_intersection(df: DataFrame, lo: str, hi: str, by: list[str]) -> DataFrame:
    """by..., lo, hi, mid, width of the intersection of all intervals; null where it is empty."""
    out = df.groupBy(*by).agg(F.max(lo).alias("lo"), F.min(hi).alias("hi"))
    good = F.col("lo") <= F.col("hi")
    return out.select(*by, F.when(good, F.col("lo")).alias("lo"), F.when(good, F.col("hi")).alias("hi"), F.when(good, (F.col("lo") + F.col("hi")) / 2).alias("mid"), F.when(good, F.col("hi") - F.col("lo")).alias("width"))


def running_intersection(df: DataFrame, lo: str, hi: str, by: list[str], order: list[str], width: float) -> DataFrame:
    """df with the intersection (lo_so_far, hi_so_far) of all intervals up to each row; empty where it is inverted."""
    turned = df.withColumn("_high", -F.col(hi))
    out = prefix(turned, by, order, width, tops={"lo_so_far": lo, "_high_so_far": "_high"})
    return out.withColumn("hi_so_far", -F.col("_high_so_far")).drop("_high", "_high_so_far")


def edge_accounting(matches: DataFrame, by: list[str] | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """by..., edges of a and b, matched, rejected, unmatched of a match table; with skipped(side), edges left out before it too."""
    s = F.col("status")
    if skipped is not None:
        counts = skipped.agg(*[F.sum((F.col("side") == x).cast("long")).alias(f"skipped_{x}") for x in ("a", "b")])
        return edge_accounting(matches, by).join(F.broadcast(counts), F.lit(True))
    return matches.groupBy(*(by or [])).agg(F.sum(s.isin("matched", "unmatched_a", "rejected").cast("long")).alias("edges_a"), F.sum(s.isin("matched", "unmatched_b").cast("long")).alias("edges_b"), *[F.sum((s == x).cast("long")).alias(x) for x in ("matched", "rejected", "unmatched_a", "unmatched_b")])
