"""Matching of two event series within a tolerance, and as-of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .scale import band_join, bucket_key, bucket_of, prefix

STATUSES = ("matched", "unmatched_a", "unmatched_b", "rejected")


class _Nearest:
    """Each a takes the nearest b that lies behind the last one taken; earlier b win ties.

    The state at a border is how many of the b within tol of it are behind: those taken, and those before them.
    """

    reach = (1, 1)

    def __init__(self, tol: float, strict: bool, alone: str) -> None:
        self.tol, self.strict, self.alone = tol, strict, alone

    def ready(self, t: np.ndarray, side: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Takes a bucket's rows in order; b also from the buckets beside it, as far as tol."""
        self.a, self.b = t[side == 0], t[side == 1]
        of_b = side == 1
        self.first = int(((place < 0) | low)[of_b].sum())
        self.last = len(self.b) - int(((place > 0) | high)[of_b].sum())
        self.count = self.first + 1
        right = np.searchsorted(self.b, self.a)
        left = np.searchsorted(self.b, self.b[np.maximum(right - 1, 0)]) if len(self.b) else right
        near = right.copy()
        if len(self.b):
            before, after = np.abs(self.a - self.b[left]), np.abs(self.b[np.minimum(right, len(self.b) - 1)] - self.a)
            near = np.where((right > 0) & ((right == len(self.b)) | (before <= after)), left, right)
        inner, outer = ("right", "left") if self.strict else ("left", "right")
        low_b, high_b = np.searchsorted(self.b, self.a - self.tol, inner), np.searchsorted(self.b, self.a + self.tol, outer)
        self.steps = list(zip(near.tolist(), low_b.tolist(), high_b.tolist(), strict=True))

    def exits(self) -> list[int]:
        """The state after the bucket for each state before it.

        None lies behind the last b within tol, so an a with any b within tol takes a state x to x + 1 between near + 1
        and high: steps of this kind are one of them in the end, whatever their number.
        """
        moved, least, most = 0, 0, self.first
        for near, low, high in self.steps:
            if low < high:
                moved, least, most = moved + 1, min(max(least, near) + 1, high), min(max(most, near) + 1, high)
        return [max(0, min(max(at + moved, least), most) - self.last) for at in range(self.count)]

    def rows(self, entry: int) -> tuple[list[tuple], list[tuple]]:
        """Rows (t_a, t_b, status), and of b near a border (which one, number, t_b) those that this bucket's a leave alone."""
        at, out, taken = entry, [], np.zeros(len(self.b), bool)
        a, b = self.a.tolist(), self.b.tolist()
        for x, (near, low, high) in zip(a, self.steps, strict=True):
            c = max(near, at)
            if low <= c < high:
                at, taken[c] = c + 1, True
                out.append((x, b[c], "matched"))
            else:
                out.append((x, None, self.alone))
        free = np.flatnonzero(~taken).tolist()
        out += [(None, b[k], "unmatched_b") for k in free if self.first <= k < self.last]
        return out, [(0, k, b[k]) for k in free if k < self.first] + [(1, k - self.last, b[k]) for k in free if k >= self.last]


class _TwoPointer:
    """The two fronts pair if at most tol apart, else the earlier one is dropped.

    At any time only one side waits, its latest rows one behind the other: the state at a border is how many of the
    rows up to tol before it wait, of a (positive) or of b (negative).
    """

    reach = (1, 0)

    def __init__(self, tol: float) -> None:
        self.tol = tol

    def ready(self, t: np.ndarray, side: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Takes a bucket's rows in order, those up to tol before it first."""
        old = place < 0
        self.side = side.tolist()
        self.t, self.start = (t[side == 0].tolist(), t[side == 1].tolist()), tuple(int((old & (side == s)).sum()) for s in (0, 1))
        self.events = self.side[int(old.sum()) :]
        self.edge = tuple(len(self.t[s]) - int((high & (side == s)).sum()) for s in (0, 1))
        self.count = self.start[0] + self.start[1] + 1

    def _walk(self, entry: int, out: list[tuple]) -> None:
        at, tol = list(self.start), self.tol
        wait, head = (0, at[0] - entry) if entry > 0 else (1, at[1] + entry)
        for s in self.events:
            t = self.t[s][at[s]]
            if wait == s:
                # Rows of its own side that are too old stay in line: they are dropped when the other side comes.
                at[s] += 1
                continue
            while head < at[wait] and self.t[wait][head] < t - tol:
                out.append(self._alone(wait, head))
                head += 1
            if head < at[wait]:
                out.append((self.t[wait][head], t, "matched") if wait == 0 else (t, self.t[wait][head], "matched"))
                head += 1
                at[s] += 1
            else:
                wait, head = s, at[s]
                at[s] += 1
        # What lies further than tol before the end can meet nothing beyond it.
        while head < min(at[wait], self.edge[wait]):
            out.append(self._alone(wait, head))
            head += 1

    def _alone(self, s: int, k: int) -> tuple:
        return (self.t[0][k], None, "unmatched_a") if s == 0 else (None, self.t[1][k], "unmatched_b")

    def exits(self) -> list[int]:
        """The state after the bucket for each state before it.

        A row of a takes a state x to x + 1 once the b that wait too long have left, so no more of them than lie within
        tol; a row of b the other way. Steps of this kind are one of them in the end, whatever their number.
        """
        at, old, tol = list(self.start), [0, 0], self.tol
        moved, least, most = 0, -self.start[1], self.start[0]
        for s in self.events:
            t, other = self.t[s][at[s]], self.t[1 - s]
            while old[1 - s] < at[1 - s] and other[old[1 - s]] < t - tol:
                old[1 - s] += 1
            near = at[1 - s] - old[1 - s]
            if s == 0:
                moved, least, most = moved + 1, max(least, -near) + 1, max(most, -near) + 1
            else:
                moved, least, most = moved - 1, min(least, near) - 1, min(most, near) - 1
            at[s] += 1
        low, high = -(at[1] - min(at[1], self.edge[1])), at[0] - min(at[0], self.edge[0])
        least, most = (min(max(x, low), high) for x in (least, most))
        return [min(max(entry + moved, least), most) for entry in range(-self.start[1], self.start[0] + 1)]

    def rows(self, entry: int) -> tuple[list[tuple], list[tuple]]:
        out: list[tuple] = []
        self._walk(entry, out)
        return out, []


def _fold(how: str, tol: float) -> _Nearest | _TwoPointer:
    return _TwoPointer(tol) if how == "two_pointer" else _Nearest(tol, how == "nearest", "unmatched_a" if how == "nearest" else "rejected")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, list[pa.RecordBatch]]]:
    """(key, its rows) of batches that start with `keys` columns and are sorted by them."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in codes:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = [batch.column(c)[i].as_py() for c in range(keys)]
            if parts and own != key:
                yield key, parts
                parts = []
            key = own
            parts.append(batch.slice(i, j - i))
    if parts:
        yield key, parts


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(key, columns of its rows) of batches that start with `keys` columns and are sorted by them."""
    for key, parts in runs(batches, keys):
        yield key, [np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in range(keys, parts[0].num_columns)]


def in_buckets(rows: DataFrame, on: list[str], tol: float, how: str, width: float) -> DataFrame:
    """on..., bucket, t, side, place, low, high of rows(on..., t, side), each in its bucket and in those beside it as far as tol reaches.

    place tells whether a row's own bucket lies before (-1) or after (1); low and high, whether a row in its own
    bucket also lies in the one before or after.
    """
    home, below, above = bucket_of("t", width), bucket_of(F.col("t") - tol, width), bucket_of(F.col("t") + tol, width)
    back, both = _fold(how, tol).reach[1] == 1, how == "two_pointer"
    near = F.array_distinct(F.array(home, F.when(F.lit(back) & (F.col("side") == 1), below).otherwise(home), F.when((F.col("side") == 1) | F.lit(both), above).otherwise(home)))
    cut = rows.where("t is not null").select(*on, F.explode(near).alias("bucket"), "t", "side", home.alias("home"), (below < home).alias("low"), (above > home).alias("high"))
    own = F.col("home") == F.col("bucket")
    return cut.select(*on, "bucket", "t", "side", F.signum(F.col("home") - F.col("bucket")).cast("int").alias("place"), (F.col("low") & own).alias("low"), (F.col("high") & own).alias("high"))


def match(a: DataFrame, b: DataFrame, ta: str, tb: str, tol: float, how: str = "nearest", on: list[str] | None = None, width: float | None = None) -> DataFrame:
    """on..., t_a, t_b, delay, status of matched and unmatched rows of a and b.

    how: 'nearest' (closer than tol), 'two_pointer' and 'greedy_reject' (at most tol), or 'band': all pairs
    within tol, which equals the others where each series' gaps exceed 2 tol. With 'nearest' and 'greedy_reject' each
    a in order takes the nearest b behind the last one taken, so matched pairs never cross.

    The greedy ones are compositions of buckets of `width` (three tol at least): a bucket is summed up to the state
    after it for each state it can be entered in, of which there are no more than rows within tol of its start; each row
    moves the state by one between two bounds, so a summary costs a pass however many states there are. The summaries
    are chained per key, and each bucket is gone through once more from its true state. No list holds more than a
    bucket, whether the data have gaps or not. Rows without a time are dropped; null keys are a key.

    Rejected rows carry the delay to the nearest b after the last one taken before them; without any they are left out.
    """
    on = on or []
    left = a.select(*on, F.col(ta).cast("long").alias("t_a"))
    right = b.select(*on, F.col(tb).cast("long").alias("t_b"))
    if how == "band":
        pairs = band_join(left, right, "t_a", "t_b", tol, on=on, how="left").select(*on, "t_a", "t_b")
        alone = band_join(right, left, "t_b", "t_a", tol, on=on, how="left").where("t_a is null").select(*on, F.col("t_a"), "t_b")
        both = pairs.unionByName(alone)
        return both.select(*on, "t_a", "t_b", (F.col("t_b") - F.col("t_a")).alias("delay"), F.when(F.col("t_b").isNull(), "unmatched_a").when(F.col("t_a").isNull(), "unmatched_b").otherwise("matched").alias("status"))
    wide = max(width or 1000 * tol, 3 * tol, 1)
    cut = in_buckets(left.select(*on, F.col("t_a").alias("t"), F.lit(0).alias("side")).unionByName(right.select(*on, F.col("t_b").alias("t"), F.lit(1).alias("side"))), on, tol, how, wide)
    kinds, n = ", ".join(f"`{c}` {a.schema[c].dataType.simpleString()}" for c in on), len(on)
    head = f"{kinds}, " if on else ""
    keys = [*on, "bucket"]

    def with_key(done: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * (len(on) + len(names)), [*arrow_keys, *types], strict=True)], [*on, *names])

    arrow_keys = [f.type for f in to_arrow_schema(a.select(*on).schema)] if on else []

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, fold = [], _fold(how, tol)
        for key, columns in _grouped(batches, n + 1):
            fold.ready(*columns)
            exits = fold.exits()
            done.append((*key, exits if any(exits) else [], 0 if how != "two_pointer" else fold.start[1]))
            if len(done) >= 1000:
                yield with_key(done, [pa.int64(), pa.list_(pa.int32()), pa.int32()], ["bucket", "exits", "zero"])
                done = []
        yield with_key(done, [pa.int64(), pa.list_(pa.int32()), pa.int32()], ["bucket", "exits", "zero"])

    dealt = cut.repartition(*keys).sortWithinPartitions(*keys, "t", "side")
    sums = dealt.mapInArrow(sum_up, f"{head}bucket long, exits array<int>, zero int")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, 0
        for batch in batches:
            done = []
            for *key, bucket, exits, zero in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                # Where no bucket was before, nothing lies within tol of the border.
                state = state if last == (key, bucket - 1) else 0
                done.append((*key, bucket, state))
                last, state = (key, bucket), exits[state + zero] if exits else 0
            yield with_key(done, [pa.int64(), pa.int32()], ["bucket", "state"])

    starts = (sums.repartition(*on) if on else sums.repartition(1)).sortWithinPartitions(*keys).mapInArrow(chain, f"{head}bucket long, state int").where("state <> 0")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _fold(how, tol)
        types, names = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32()], ["t_a", "t_b", "status", "border", "number"]
        done: list[tuple] = []
        for key, (t, side, place, low, high) in _grouped(batches, n + 1):
            # The state a bucket is entered in comes as a row before all others.
            given = side < 0
            fold.ready(*(c[~given] for c in (t, side, place, low, high)))
            out, near_border = fold.rows(int(t[given][0]) if given.any() else 0)
            done += [(*key[:-1], *r, None, None) for r in out]
            done += [(*key[:-1], None, y, "half", key[-1] + which, k) for which, k, y in near_border]
            if len(done) >= 10_000:
                yield with_key(done, types, names)
                done = []
        yield with_key(done, types, names)

    entries = starts.select(*keys, F.col("state").cast("long").alias("t"), F.lit(-1).alias("side"), F.lit(0).alias("place"), F.lit(False).alias("low"), F.lit(False).alias("high"))
    both = entries.unionByName(cut).repartition(*keys).sortWithinPartitions(*keys, F.when(F.col("side") < 0, 0).otherwise(1), "t", "side")
    out = both.mapInArrow(replay, f"{head}t_a long, t_b long, status string, border long, number int")
    if how != "two_pointer":
        # A b near a border is unmatched if neither bucket beside it took it: one row a border in place of two.
        alone = F.count("*").over(Window.partitionBy(*on, "border", "number"))
        half = out.where("status = 'half'").withColumn("_n", alone).withColumn("_first", F.row_number().over(Window.partitionBy(*on, "border", "number").orderBy("t_b"))).where("_n = 2 and _first = 1")
        out = out.where("status <> 'half'").unionByName(half.withColumn("status", F.lit("unmatched_b")).select(*out.columns))
    out = out.withColumn("delay", F.col("t_b") - F.col("t_a")).select(*on, "t_a", "t_b", "delay", "status")
    if how != "greedy_reject":
        return out
    rejected = out.where("status = 'rejected'").select(*on, "t_a")
    taken = out.where("status = 'matched'").select(*on, F.col("t_a").alias("taken_a"), F.col("t_b").alias("taken_b"))
    left_over = as_of(rejected, taken, "t_a", "taken_a", on, width=wide).drop("taken_a").withColumn("t_from", F.greatest("t_a", F.col("taken_b") + 1))
    back = as_of(left_over, right, "t_a", "t_b", on, width=wide).withColumn("t_back", F.when(F.col("taken_b").isNull() | (F.col("t_b") > F.col("taken_b")), F.col("t_b"))).drop("t_b")
    both = as_of(back, right, "t_from", "t_b", on, direction="forward", width=wide).withColumnRenamed("t_b", "t_next")
    near = F.when(F.col("t_next").isNull() | (F.col("t_a") - F.col("t_back") <= F.col("t_next") - F.col("t_a")), F.col("t_back")).otherwise(F.col("t_next"))
    both = both.withColumn("t_b", near).where("t_b is not null")
    rejects = both.select(*on, "t_a", "t_b", (F.col("t_b") - F.col("t_a")).alias("delay"), F.lit("rejected").alias("status"))
    return out.where("status <> 'rejected'").unionByName(rejects)


def as_of(left: DataFrame, right: DataFrame, t_left: str, t_right: str, on: list[str] | None = None, direction: str = "backward", width: float = 3_600_000_000) -> DataFrame:
    """left with the columns of the latest right row at or before (forward: the earliest at or after) its time.

    A two-level scan: both sides are cut into buckets of `width`, each bucket takes its own right rows, and the
    nearest right row of the buckets before (after) comes from one summary row per bucket. Names of the sides must
    differ, but for `on`. Rows without a time get none.
    """
    on = on or []
    mine = [c for c in left.columns if c not in on]
    other = [c for c in right.columns if c not in on]
    l = left.select(*on, F.col(t_left).alias("_t"), F.lit(1).alias("_left"), F.struct(*mine).alias("_mine"), F.lit(None).cast(right.select(F.struct(*other)).schema[0].dataType).alias("_other"))
    r = right.select(*on, F.col(t_right).alias("_t"), F.lit(0).alias("_left"), F.lit(None).cast(left.select(F.struct(*mine)).schema[0].dataType).alias("_mine"), F.struct(*other).alias("_other")).where("_t is not null")
    back = direction == "backward"
    cut = l.unionByName(r).withColumn("_k", bucket_key(on, "_t", width))
    inside = Window.partitionBy("_k").orderBy(F.col("_t").asc() if back else F.col("_t").desc(), "_left")
    scanned = cut.withColumn("_rn", F.row_number().over(inside)).withColumn("_found", F.last("_other", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # A bucket's last row has found its last right row; both sides of the join read one shuffle.
    ends = scanned.groupBy("_k").agg(F.max_by(F.struct("*"), "_rn").alias("_e"))
    over = Window.partitionBy(*[F.col(f"_k.k{i}") for i in range(len(on))]).orderBy(F.col("_k.b").asc_nulls_first() if back else F.col("_k.b").desc_nulls_first())
    starts = ends.select(F.col("_k").alias("_j"), F.last("_e._found", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_start"))
    found = scanned.where("_left = 1").join(starts, F.col("_k") == F.col("_j")).withColumn("_found", F.coalesce("_found", "_start"))
    return found.select(*on, *[F.col(f"_mine.{c}").alias(c) for c in mine], *[F.col(f"_found.{c}").alias(c) for c in other])


def pair_by_position(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], width: float) -> DataFrame:
    """The i-th row of a beside the i-th of b, up to the shorter; columns of the sides must differ."""
    left = prefix(a, [], order_a, width, rn="position")
    right = prefix(b, [], order_b, width, rn="_position")
    return left.join(right, left.position == right._position).drop("_position")


def unmatched(a: DataFrame, b: DataFrame, ta: str, tb: str, tol: float) -> DataFrame:
    """side, t of the rows of either series without a partner within tol."""
    alone_a = band_join(a.select(ta), b.select(tb), ta, tb, tol, how="left_anti").select(F.lit("a").alias("side"), F.col(ta).alias("t"))
    alone_b = band_join(b.select(tb), a.select(ta), tb, ta, tol, how="left_anti").select(F.lit("b").alias("side"), F.col(tb).alias("t"))
    return alone_a.unionByName(alone_b)


def align_common_start(a: DataFrame, b: DataFrame, t: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both series from the first time at which both have begun, and one row with start and the time skipped in each."""
    first = a.agg(F.min(t).alias("a0")).join(b.agg(F.min(t).alias("b0")), F.lit(True))
    first = first.select(F.greatest("a0", "b0").alias("common_start"), "a0", "b0")
    starts = first.select("common_start")
    cut_a = a.join(F.broadcast(starts), F.col(t) >= F.col("common_start")).drop("common_start")
    cut_b = b.join(F.broadcast(starts), F.col(t) >= F.col("common_start")).drop("common_start")
    return cut_a, cut_b, first.select("common_start", (F.col("common_start") - F.col("a0")).alias("skipped_a"), (F.col("common_start") - F.col("b0")).alias("skipped_b"))


#: A span covers at least so many whole cells of its level, and at most twice as many.
CELLS = 16


def _level(length: Column) -> Column:
    """The power of two that a span's cells are wide: so that CELLS of them are no longer than the span."""
    steps = F.array(*[F.lit(CELLS << k).cast("long") for k in range(1, 58)])
    return F.size(F.filter(steps, lambda x: x <= length))


def span_cells(spans: DataFrame) -> DataFrame:
    """spans(..., t_from, t_to) once for each cell of its level that it touches, at most 2 CELLS + 1 of them whatever its length; _level, _cell."""
    placed = spans.where("t_from < t_to").withColumn("_level", _level(F.col("t_to") - F.col("t_from")))
    return placed.withColumn("_cell", F.explode(F.sequence(F.expr("shiftright(t_from, _level)"), F.expr("shiftright(t_to - 1, _level)"))))


def annotate(telemetry: DataFrame, spans: DataFrame, t: str) -> DataFrame:
    """telemetry rows that lie in a span (experiment, t_from, t_to), with its name, for any number of spans of any lengths.

    A hash join on dyadic cells: a span lies in a few cells as wide as a part of it, a row in one cell of each width
    that spans have, of which there are fewer than 64. A row and a span meet in one cell at most. Rows without a time
    and empty spans meet nothing.
    """
    cut = span_cells(spans.withColumns({c: F.col(c).cast("long") for c in ("t_from", "t_to")}))
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())
    near = telemetry.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(F.col(t).cast("long"), k).alias("c")) for k in levels] or [F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("c"))])))
    met = near.join(cut, (F.col("_at.k") == F.col("_level")) & (F.col("_at.c") == F.col("_cell")) & (F.col(t) >= F.col("t_from")) & (F.col(t) < F.col("t_to")))
    return met.drop("_at", "_level", "_cell", "t_from", "t_to")


#: Values below this are summed as decimals, whose differences are exact.
PLAIN = 1e9


def annotated_stats(telemetry: DataFrame, spans: DataFrame, t: str, value: str, width: float = 3_600_000_000) -> DataFrame:
    """experiment, n, mean of the telemetry rows that lie in spans (experiment, t_from, t_to), as of annotate's rows, without making these.

    Counts and sums of a span are differences of running ones at its ends, by a two-level scan over rows and ends
    together: the work grows with rows and spans, not with their pairs. Sums are exact to ten decimals; for values that
    aren't finite or lie beyond PLAIN annotate makes the pairs.
    """
    v = F.col(value).cast("double")
    placed = spans.where("t_from < t_to")
    rows = telemetry.where(F.col(t).isNotNull()).select(F.col(t).alias("_t"), F.lit(1).alias("_row"), v.isNotNull().cast("long").alias("_m"), F.when(F.abs(v) < PLAIN, v.cast("decimal(20,10)")).alias("_v"))
    # At equal times ends come first: a row at t_from is inside, one at t_to isn't.
    ends = placed.select("experiment", F.explode(F.array(F.struct(F.col("t_from").alias("_t"), F.lit(False).alias("_to")), F.struct(F.col("t_to").alias("_t"), F.lit(True).alias("_to")))).alias("_end"))
    both = rows.unionByName(ends.select("experiment", "_end.*", F.lit(0).alias("_row")), allowMissingColumns=True)
    seen = prefix(both, [], ["_t", "_row"], width, sums={"_n": "_row", "_count": "_m", "_sum": "_v"}).where("_row = 0")
    sums = {c: F.sum(F.when(F.col("_to"), F.col(c)).otherwise(-F.col(c))) for c in ("_n", "_count", "_sum")}
    out = seen.groupBy("experiment").agg(*[x.alias(c) for c, x in sums.items()]).where("_n > 0").withColumn("_sum", F.col("_sum").cast("double"))
    odd = telemetry.where(F.abs(v) >= PLAIN)
    if not odd.isEmpty():
        more = annotate(odd.select(t, v.alias("_v")), placed, t).groupBy(F.col("experiment").alias("_x")).agg(F.sum("_v").alias("_more"))
        out = out.join(more, F.col("experiment").eqNullSafe(F.col("_x")), "left").withColumn("_sum", F.col("_sum") + F.coalesce("_more", F.lit(0.0)))
    return out.select("experiment", F.col("_n").cast("long").alias("n"), F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count")).alias("mean"))
