"""Ordered computations without a global order: two-level prefix scans, islands, band joins.

A window over one long series is one task. Here a series is cut into buckets of known width, each bucket is
scanned alone, one summary row per bucket is scanned in turn, and the two are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(t: str | Column, width: float) -> Column:
    return F.floor(F.col(t) / width if isinstance(t, str) else t / width).cast("long")


def bucket_key(by: list[str], order: str, width: float) -> Column:
    """The key of a row's bucket. Structs are equal where their nulls are, so joins and windows on it share one shuffle."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], bucket_of(order, width).alias("b"))


def prefix(df: DataFrame, by: list[str], order: list[str], width: float, sums: dict[str, str] | None = None, lags: dict[str, str] | None = None, rn: str | None = None, leads: dict[str, str] | None = None, tops: dict[str, str] | None = None, lasts: dict[str, str] | None = None) -> DataFrame:
    """df with running sums and maxima {new: column}, values of the row before or after {new: column}, the last values of
    the rows before that aren't null {new: column}, and row numbers from 1.

    order[0] is numeric and cut into buckets of `width`; order ends with a unique column. The bucket summaries are the
    buckets' own last (and first) rows as scanned, so both sides of the join back read one shuffle of df.
    """
    sums, lags, leads, tops, lasts = sums or {}, lags or {}, leads or {}, tops or {}, lasts or {}
    own = df.columns
    cut = df.withColumn("_k", bucket_key(by, order[0], width))
    inside = Window.partitionBy("_k").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    exprs = [F.row_number().over(inside).alias("_rn")]
    exprs += [F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_s_{n}") for n, c in sums.items()]
    exprs += [F.lag(c).over(inside).alias(f"_l_{n}") for n, c in lags.items()]
    exprs += [F.lead(c).over(inside).alias(f"_d_{n}") for n, c in leads.items()]
    exprs += [F.max(c).over(upto).alias(f"_m_{n}") for n, c in tops.items()]
    exprs += [F.last(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_p_{n}") for n, c in lasts.items()]
    scanned = cut.select("*", *exprs)
    ends = scanned.groupBy("_k").agg(F.max_by(F.struct("*"), "_rn").alias("_e"), F.min_by(F.struct(*own), "_rn").alias("_f"))
    over = Window.partitionBy(*[F.col(f"_k.k{i}") for i in range(len(by))]).orderBy("_k.b")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(
        F.col("_k").alias("_j"),
        F.coalesce(F.sum("_e._rn").over(before), F.lit(0)).alias("_n0"),
        F.col("_e._rn").alias("_n1"),
        *[F.coalesce(F.sum(f"_e._s_{n}").over(before), F.lit(0)).alias(f"_t0_{n}") for n in sums],
        *[F.max(f"_e._m_{n}").over(before).alias(f"_m0_{n}") for n in tops],
        *[F.last(F.coalesce(f"_e.{c}", f"_e._p_{n}"), ignorenulls=True).over(before).alias(f"_p0_{n}") for n, c in lasts.items()],
        *[F.lag(f"_e.{c}").over(over).alias(f"_e0_{n}") for n, c in lags.items()],
        *[F.lead(f"_f.{c}").over(over).alias(f"_f0_{n}") for n, c in leads.items()],
    )
    out = scanned.join(starts, F.col("_k") == F.col("_j"))
    made = [(F.col(f"_s_{n}") + F.col(f"_t0_{n}")).alias(n) for n in sums]
    made += [F.greatest(f"_m_{n}", f"_m0_{n}").alias(n) for n in tops]
    made += [F.coalesce(f"_p_{n}", f"_p0_{n}").alias(n) for n in lasts]
    made += [F.when(F.col("_rn") == 1, F.col(f"_e0_{n}")).otherwise(F.col(f"_l_{n}")).alias(n) for n in lags]
    made += [F.when(F.col("_rn") == F.col("_n1"), F.col(f"_f0_{n}")).otherwise(F.col(f"_d_{n}")).alias(n) for n in leads]
    made += [(F.col("_rn") + F.col("_n0")).alias(rn)] if rn else []
    return out.select(*own, *made)


def islands(df: DataFrame, by: list[str], order: list[str], gap: float, width: float, strict: bool = False, name: str = "island") -> DataFrame:
    """df with a running number of islands: a new one starts where order[0] is at least (strict: more than) `gap` after the row before.

    One scan: cuts inside a bucket are counted there, and whether its first row is a cut follows from the summaries.
    """
    t, own = order[0], df.columns

    def far(distance: Column) -> Column:
        return distance > gap if strict else distance >= gap

    inside = Window.partitionBy("_k").orderBy(*order)
    cut = df.withColumn("_k", bucket_key(by, t, width))
    seen = cut.select("*", F.row_number().over(inside).alias("_rn"), F.lag(t).over(inside).alias("_before"))
    marked = seen.withColumn("_cut", F.when(far(F.col(t) - F.col("_before")), 1).otherwise(0))
    scanned = marked.select("*", F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_cuts"))
    ends = scanned.groupBy("_k").agg(F.max_by(F.struct("*"), "_rn").alias("_e"), F.min(t).alias("_first"))
    over = Window.partitionBy(*[F.col(f"_k.k{i}") for i in range(len(by))]).orderBy("_k.b")
    last = F.lag(F.col(f"_e.{t}")).over(over)
    starts = ends.select("_k", F.col("_e._cuts").alias("_cuts"), F.when(last.isNull() | far(F.col("_first") - last), 1).otherwise(0).alias("_new"))
    sums = F.sum(F.col("_cuts") + F.col("_new")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cuts")
    starts = starts.select(F.col("_k").alias("_j"), sums.alias("_base"))
    return scanned.join(starts, F.col("_k") == F.col("_j")).select(*own, (F.col("_base") + F.col("_cuts")).alias(name))


def band_join(a: DataFrame, b: DataFrame, ta: str, tb: str, tol: float, strict: bool = False, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Pairs with |tb - ta| at most (strict: below) tol, as a hash join on buckets of width tol.

    b's rows are exploded to their three neighbour buckets, so a left join keeps a's unmatched rows exactly.
    Columns of the two sides must differ, but for those in `on`.
    """
    on = on or []
    left = a.withColumn("_bucket", bucket_of(ta, tol))
    near = bucket_of(tb, tol)
    right = b.withColumn("_near", F.explode(F.array(near - 1, near, near + 1)))
    right = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in b.columns], "_near")
    distance = F.abs(F.col(tb) - F.col(ta))
    match = (F.col("_bucket") == F.col("_near")) & (distance < tol if strict else distance <= tol)
    for c in on:
        match = match & (F.col(c) == F.col(f"_on_{c}"))
    return left.join(right, match, how).drop("_bucket", "_near", *[f"_on_{c}" for c in on])
