"""Counters and clock models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .match import as_of, runs
from .scale import bucket_of, prefix


def unwrap(df: DataFrame, by: list[str], order: list[str], val: str, wrap: int, wrap2: int = 0, offset0: int = 0, width: float = 1e9) -> DataFrame:
    """df with unwrapped and wraps: a fall below a non-zero value adds wrap, or wrap2 if the value before was below wrap2."""
    seen = prefix(df, by, order, width, lags={"_before": val})
    fell = (F.col(val) < F.col("_before")) & (F.col("_before") != 0)
    step = F.when(F.col("_before") < wrap2, F.lit(wrap2)).otherwise(F.lit(wrap)) if wrap2 > 0 else F.lit(wrap)
    marked = seen.withColumn("_add", F.when(fell, step).otherwise(0).cast("long")).withColumn("_one", F.when(fell, 1).otherwise(0).cast("long"))
    out = prefix(marked, by, order, width, sums={"_offset": "_add", "wraps": "_one"})
    return out.withColumn("unwrapped", F.col(val) + F.col("_offset") + offset0).drop("_before", "_add", "_one", "_offset")


def _fits(rn: np.ndarray, x: np.ndarray, e: np.ndarray, ok: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """slope, back, x_ref, y_ref, r2, std of e over x in the last n rows up to each of the places `at`; rows that aren't ok don't count."""
    place = at[:, None] - np.arange(n)[::-1]
    used = (place > (at - rn[at])[:, None]) & ok[place]
    count = np.maximum(used.sum(axis=1), 1)
    sums, centred = [], []
    for v in (x, e):
        d = np.where(used, v[place] - v[at][:, None], 0)
        sums.append(d.sum(axis=1))
        centred.append(np.where(used, d - (sums[-1] / count)[:, None], 0.0))
    dx, de = centred
    with np.errstate(all="ignore"):
        slope = (dx * de).sum(axis=1) / (dx * dx).sum(axis=1)
        left = ((de - slope[:, None] * dx) ** 2).sum(axis=1)
        fit = 1 - left / ((dx + de) ** 2).sum(axis=1)
        back = np.where(slope == -1, np.nan, -slope / (1 + slope))
    mean_e = (sums[1] + count * e[at]) / count
    x_ref = x[at] + np.floor(sums[0] / count + 0.5).astype(np.int64)
    y_ref = x_ref + (np.sign(mean_e) * np.floor(np.abs(mean_e) + 0.5)).astype(np.int64)
    return [slope, back, x_ref, y_ref, fit, np.sqrt(left / count)]


#: Rows whose samples are looked back on together.
PART = 128


def clock_model(df: DataFrame, by: list[str], order: list[str], session: str, x: str, y: str, n: int = 128, min_n: int = 32, r2: float = 0.999, width: float = 65536, block: int = 1024) -> DataFrame:
    """by..., session, n, slope_m1, slope_back_m1, x_ref, y_ref, r2, std, valid after each session's last sample.

    A regression over the last n samples: rows are numbered by a two-level scan (order as for scale.prefix) and cut
    into blocks, which also hold the n rows before them. Rows travel twice, as a few numbers each, and only the last sample of a session in its block looks back on n, whose values are taken relative to it and to their means. With e = y - x the slope less one and the residual keep their precision. x and y are whole numbers;
    samples without one of them count, but don't take part. Without any spread of x there is no slope.
    """
    block = max(block, n)
    sorts = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*by, bucket_of(order[0], width).alias("_b"), *[F.col(c).alias(o) for c, o in zip(order, sorts, strict=True)], F.col(session).alias("_session"), F.col(x).cast("long").alias("_x"), (F.col(y) - F.col(x)).cast("long").alias("_e"))
    ok = F.col("_x").isNotNull() & F.col("_e").isNotNull()
    rows = rows.withColumns({"_ok": ok, **{c: F.coalesce(c, F.lit(0).cast("long")) for c in ("_x", "_e")}})
    # Buckets are counted alone; how many rows lie before a bucket comes as a row before all others.
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c")).select(*by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    both = starts.unionByName(rows, allowMissingColumns=True).select(*by, "_b", *sorts, "_session", "_x", "_e", "_ok", "_start")
    dealt = both.repartition(*by, "_b").sortWithinPartitions(*by, "_b", F.col("_start").isNull(), *sorts)
    placed = T.StructType([*[both.schema[c] for c in by], T.StructField("_in", T.LongType()), T.StructField("_rn", T.LongType()), *[both.schema[c] for c in ("_session", "_x", "_e", "_ok")]])
    placed_arrow = to_arrow_schema(placed)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their numbers, once for each block that holds them."""
        for _, parts in runs(batches, len(by) + 1):
            at, parts = parts[0]["_start"][0].as_py(), [parts[0].slice(1), *parts[1:]]
            for part in parts:
                rn = np.arange(at + 1, at + 1 + part.num_rows)
                at, own = at + part.num_rows, (rn - 1) // block
                ahead = np.flatnonzero((rn - 1) % block >= block - n)
                for where, shift in ((np.arange(len(rn)), 0), (ahead, 1)):
                    kept = part.take(pa.array(where))
                    columns = [*[kept[c] for c in by], pa.array(own[where] + shift), pa.array(rn[where]), *[kept[c] for c in ("_session", "_x", "_e", "_ok")]]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, placed_arrow, strict=True)], schema=placed_arrow)

    rows = dealt.mapInArrow(number, placed)
    values = {"slope_m1": "double", "slope_back_m1": "double", "x_ref": "long", "y_ref": "long", "r2": "double", "std": "double"}
    made = T.StructType([*[rows.schema[c] for c in by], rows.schema["_session"], T.StructField("_rn", T.LongType()), *[T.StructField(c, T.DoubleType() if t == "double" else T.LongType()) for c, t in values.items()]])
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in runs(batches, len(by) + 1):
            table = pa.Table.from_batches(parts)
            rn, xs, es, ok = (table[c].to_numpy() for c in ("_rn", "_x", "_e", "_ok"))
            codes = table["_session"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            last = len(codes) - 1 - np.unique(codes[::-1], return_index=True)[1]
            last = np.sort(last[(rn[last] - 1) // block == key[-1]])
            for k in range(0, len(last), PART):
                at = last[k : k + PART]
                seen = np.minimum(rn[at], n)
                columns = [pa.array(v, t.type, mask=(seen < min_n) | ~np.isfinite(v)) for v, t in zip(_fits(rn, xs, es, ok, at, n), list(arrow)[-6:], strict=True)]
                kept = table.select([*by, "_session"]).take(pa.array(at)).combine_chunks()
                heads = [c.chunk(0).cast(f.type) for c, f in zip(kept.columns, arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(rn[at]), *columns], schema=arrow)

    fits = rows.repartition(*by, "_in").sortWithinPartitions(*by, "_in", "_rn").mapInArrow(run, made)
    # Aggregates of plain numbers are hashed, and those that nobody asks for are left out.
    out = fits.groupBy(*by, "_session").agg(F.max("_rn").alias("_n"), *[F.max_by(c, "_rn").alias(c) for c in values])
    out = out.select(*by, F.col("_session").alias(session), F.least("_n", F.lit(n)).cast("long").alias("n"), *values)
    return out.withColumn("valid", F.coalesce(F.col("r2") > r2, F.lit(False)))


def project_clock(df: DataFrame, models: DataFrame, t: str, on: list[str], direction: str = "to_remote") -> DataFrame:
    """df with the latest valid model (local_ref, remote_ref, m1) at or before t, and t on the other clock."""
    to_remote = direction == "to_remote"
    own, other = ("local_ref", "remote_ref") if to_remote else ("remote_ref", "local_ref")
    met = as_of(df, models, t, own, on)
    d = F.col(t) - F.col(own)
    slope = F.col("m1") if to_remote else -F.col("m1") / (1 + F.col("m1"))
    return met.withColumn("remote" if to_remote else "local", (F.col(other) + d + F.round(d * slope)).cast("long"))


def aligned_cycle(df: DataFrame, remote: str, period: int, compensation: int) -> DataFrame:
    """df with the period boundary after next to the nearest one, its time, and the time compensated."""
    cycle = F.expr(f"({remote} + {period // 2}) div {period} + 2")
    return df.withColumn("cycle", cycle).withColumn("target", F.col("cycle") * period + compensation)
