"""Statistics of all pairs of two series within a tolerance, whose pairs never leave the task that makes them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .stats import QUANTILES

#: Pairs that a task holds at once.
CHUNK = 1 << 18


def _cells(a: DataFrame, b: DataFrame, ta: str, tb: str, tol: int, every: int, order_a: list[str], order_b: list[str]) -> DataFrame:
    """slot, bucket, ta (by time and order_a), tb (by order_b) of stretches of some tolerances: a's rows in them, and b's within tol."""
    parts = -(-every // (4 * tol))
    while every % parts:
        parts += 1
    g = every // parts
    left = a.where(F.col(ta).isNotNull()).select(F.expr(f"{ta} div {g}").alias("slot"), F.struct(F.col(ta).cast("long").alias("t"), *order_a).alias("_a"))
    slots = F.explode(F.sequence(F.expr(f"({tb} - {tol}) div {g}"), F.expr(f"({tb} + {tol}) div {g}")))
    right = b.where(F.col(tb).isNotNull()).select(slots.alias("slot"), F.struct(*order_b, F.col(tb).cast("long").alias("t")).alias("_b"))
    # As many tasks as there are partitions, however short the lists are: their pairs aren't.
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right, allowMissingColumns=True).repartition(tasks, "slot").groupBy("slot")
    met = both.agg(*[F.sort_array(F.collect_list(c)).getField("t").alias(f"t{c}") for c in ("_a", "_b")]).where("size(t_a) > 0 and size(t_b) > 0")
    return saved(met.select("slot", F.expr(f"slot div {parts}").alias("bucket"), F.col("t_a").alias("ta"), F.col("t_b").alias("tb")), "cells")


def _windows(a: np.ndarray, b: np.ndarray, tol: int) -> tuple[np.ndarray, np.ndarray]:
    """From where to where b, sorted, lies within tol of each of a."""
    return np.searchsorted(b, a - tol, "left"), np.searchsorted(b, a + tol, "right")


def _pairs(low: np.ndarray, high: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers in a and b of all pairs, in parts of about `chunk`."""
    count = high - low
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        done = ends[at] - count[at]
        to = max(at + 1, int(np.searchsorted(ends, done + chunk, "right")))
        row = np.repeat(np.arange(at, to), count[at:to])
        yield row, np.arange(len(row)) + (low[at:to] - (ends[at:to] - count[at:to] - done))[row - at]
        at = to


def _places(d: np.ndarray, mean: float) -> np.ndarray:
    """Numbers from 1 that grow with |d - mean|: two whole numbers d have each, one on either side."""
    m = int(np.floor(mean))
    return np.where(d > m, d - m, m - d + 1)


def _mapped(cells: DataFrame, run: Callable[[np.ndarray, np.ndarray, dict], list[dict]], schema: str, names: list[str]) -> DataFrame:
    """The rows that run makes of each cell's ta, tb and other columns."""

    arrow = pa.schema([(n, pa.float64() if n[0] == "f" else pa.int64()) for n in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for batch in batches:
            others = [c for c in batch.schema.names if c not in ("ta", "tb")]
            for i, more in enumerate(batch.select(others).to_pylist()):
                made += run(*(batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("ta", "tb")), more)
                if len(made) >= 10_000:
                    yield pa.RecordBatch.from_pylist(made, arrow)
                    made = []
        yield pa.RecordBatch.from_pylist(made, arrow)

    return cells.mapInArrow(rows, schema)


def band_jitter(a: DataFrame, b: DataFrame, ta: str, tb: str, tol: int, every: int, order_a: list[str], order_b: list[str], pulse_freq: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """bucket, n, mean, std (population), min, max, max_dev, p50..p999 of |delay - mean| over all pairs of whole times with |tb - ta|
    at most tol, delay = tb - ta; a pair belongs to the bucket, `every` wide, of ta. With pulse_freq also rms_rad and rms_jitter_ns.

    As stats.jitter_stats and spectrum.phase_noise (in the order of ta, order_a, order_b) of scale.band_join, exactly.
    Only times travel: a cell of a few tolerances makes its pairs in parts and passes on counts and sums. Pairs are
    numbered from the counts of the cells before. A rank is found in three rounds of counts of |delay - mean|, each
    closer by the same factor, so nothing of the pairs is sorted or kept.
    """
    cells = _cells(a, b, ta, tb, tol, every, order_a, order_b)

    def count(a: np.ndarray, b: np.ndarray, cell: dict) -> list[dict]:
        b = np.sort(b)
        low, high = _windows(a, b, tol)
        some = high > low
        if not some.any():
            return []
        a, low, high = a[some], low[some], high[some]
        sums = np.concatenate(([0], np.cumsum(b - a[0])))
        s = sums[high] - sums[low] - (high - low) * (a - a[0])
        return [{"slot": cell["slot"], "bucket": cell["bucket"], "n": int((high - low).sum()), "s": int(s.sum()), "low": int((b[low] - a).min()), "high": int((b[high - 1] - a).max())}]

    counts = saved(_mapped(cells, count, "slot long, bucket long, n long, s long, low long, high long", ["slot", "bucket", "n", "s", "low", "high"]), "counts")
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("double").alias("_s"), F.min("low").alias("min"), F.max("high").alias("max"))
    buckets = saved(buckets.select("bucket", "n", (F.col("_s") / F.col("n")).alias("mean"), "min", "max"), "buckets")
    before = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("slot", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(buckets.select("bucket", "n", "mean"), "bucket")
    grid = int(np.ceil((2 * tol + 2) ** (1 / 3))) + 1
    moments = ["f_sq", "f_s2", "f_zz", "f_dc", "f_cl", "f_sl"]

    def first(a: np.ndarray, b: np.ndarray, cell: dict) -> list[dict]:
        bucket, n, mean, at = cell["bucket"], cell["n"], cell["mean"], cell["start"]
        order = np.argsort(b, kind="stable")
        sorted_already = bool((order[1:] > order[:-1]).all())
        low, high = _windows(a, b[order], tol)
        total, found = dict.fromkeys(moments, 0.0), np.zeros(grid, np.int64)
        for row, col in _pairs(low, high, chunk):
            col = order[col]
            if pulse_freq is not None and not sorted_already:
                base = row * len(b)
                col = np.sort(base + col) - base
            d = b[col] - a[row]
            found += np.bincount(_places(d, mean) // grid**2, minlength=grid)
            off = d - mean
            total["f_sq"] += float(off @ off)
            # Under the window, series of fewer than three rows are all zero.
            if pulse_freq is not None and n > 2:
                i = at + np.arange(len(d))
                w = 0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1))
                z = off * (1e-9 * 2 * np.pi * pulse_freq) * w
                total["f_s2"] += float(w @ w)
                total["f_zz"] += float(z @ z)
                total["f_dc"] += float(z.sum())
                if n % 2:
                    angle = 2 * np.pi * ((n // 2 * i) % n) / n
                    total["f_cl"] += float(z @ np.cos(angle))
                    total["f_sl"] += float(z @ np.sin(angle))
            at += len(d)
        return [{"bucket": bucket, "c": c, "cnt": int(found[c])} for c in np.flatnonzero(found).tolist()] + [{"bucket": bucket, **total}]

    given = cells.drop("bucket").join(starts, "slot")
    made = _mapped(given, first, f"bucket long, c long, cnt long, {', '.join(f'{m} double' for m in moments)}", ["bucket", "c", "cnt", *moments])
    made = saved(made.groupBy("bucket", "c").agg(F.sum("cnt").alias("cnt"), *[F.sum(m).alias(m) for m in moments]), "places")
    ranks = []
    for k, q in enumerate(QUANTILES.values()):
        rank = F.floor((F.col("n") - 1) * F.lit(q))
        ranks += [F.struct(F.lit(2 * k + i).alias("j"), F.least(rank + i, F.col("n") - 1).alias("r")) for i in (0, 1)]
    state = buckets.select("bucket", "mean", F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("below"), F.inline(F.array(*ranks)))

    def closer(state: DataFrame, counted: DataFrame, *order: str) -> DataFrame:
        """Each rank's row of counted(bucket, parent, cnt, ...): what lies below it and its own place."""
        met = state.join(counted, ["bucket", "parent"]).withColumn("_dev", F.abs(F.col("d") - F.col("mean")))
        upto = F.col("below") + F.sum("cnt").over(Window.partitionBy("bucket", "j").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("_upto", upto).where((F.col("r") < F.col("_upto")) & (F.col("r") >= F.col("_upto") - F.col("cnt")))
        return met.select("bucket", "mean", F.col("c").alias("parent"), (F.col("_upto") - F.col("cnt")).alias("below"), "j", "r", "_dev")

    def within(level: int) -> Callable[[np.ndarray, np.ndarray, dict], list[dict]]:
        def run(a: np.ndarray, b: np.ndarray, cell: dict) -> list[dict]:
            # Equal times have equal delays.
            (a, many_a), (b, many_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
            wide, chosen, out = grid ** (3 - level), np.array(cell["chosen"]), {}
            for row, col in _pairs(*_windows(a, b, tol), chunk):
                d = b[col] - a[row]
                place = _places(d, cell["mean"])
                good = np.flatnonzero(np.isin(place // (wide * grid), chosen))
                keys, which = np.unique(d[good] if level == 3 else place[good] // wide, return_inverse=True)
                for key, many in zip(keys.tolist(), np.bincount(which, many_a[row[good]] * many_b[col[good]], len(keys)).tolist(), strict=True):
                    out[key] = out.get(key, 0) + int(many)
            kept = sorted(out.items())
            if level < 3:
                return [{"bucket": cell["bucket"], "parent": c // grid, "c": c, "d": 0, "cnt": n} for c, n in kept]
            parents = (_places(np.array([d for d, _ in kept], np.int64), cell["mean"]) // grid).tolist()
            return [{"bucket": cell["bucket"], "parent": p, "c": p, "d": d, "cnt": n} for p, (d, n) in zip(parents, kept, strict=True)]

        return run

    state = saved(closer(state, made.where("c is not null").select("bucket", F.lit(0).cast("long").alias("parent"), "c", F.lit(0).cast("long").alias("d"), "cnt"), "c"), "ranks").drop("_dev")
    for level in (2, 3):
        asked = cells.join(state.groupBy("bucket", "mean").agg(F.collect_set("parent").alias("chosen")), "bucket")
        counted = _mapped(asked, within(level), "bucket long, parent long, c long, d long, cnt long", ["bucket", "parent", "c", "d", "cnt"])
        counted = counted.groupBy("bucket", "parent", "c", "d").agg(F.sum("cnt").alias("cnt"))
        state = saved(closer(state, counted, *(("c",) if level == 2 else ("_dev", "d"))), "ranks")
        state = state.drop("_dev") if level == 2 else state
    devs = state.groupBy("bucket").agg(*[F.max(F.when(F.col("j") == k, F.col("_dev"))).alias(f"_v{k}") for k in range(2 * len(QUANTILES))])
    out = buckets.join(devs, "bucket").join(made.where("c is null").drop("c", "cnt"), "bucket")
    picks = []
    for k, (name, q) in enumerate(QUANTILES.items()):
        place = (F.col("n") - 1) * F.lit(q)
        picks.append((F.col(f"_v{2 * k}") + (place - F.floor(place)) * (F.col(f"_v{2 * k + 1}") - F.col(f"_v{2 * k}"))).alias(name))
    columns = ["bucket", "n", "mean", F.sqrt(F.col("f_sq") / F.col("n")).alias("std"), "min", "max", F.greatest(F.col("mean") - F.col("min"), F.col("max") - F.col("mean")).alias("max_dev"), *picks]
    if pulse_freq is not None:
        n = F.col("n")
        power = (n * F.col("f_zz") - F.col("f_dc") ** 2 - F.col("f_cl") ** 2 - F.col("f_sl") ** 2) / F.col("f_s2") / n
        rms = F.when(F.col("f_s2") > 1e-12, F.sqrt(F.greatest(power, F.lit(0.0))))
        columns += [rms.alias("rms_rad"), (rms / (2 * np.pi * pulse_freq) * 1e9).alias("rms_jitter_ns")]
    return out.select(*columns)
