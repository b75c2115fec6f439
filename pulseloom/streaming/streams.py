"""Structured Streaming operators: matching, detection, routing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.match import match
from ..sources import telemetry


def stream_match(edges: DataFrame, by: str, tol_us: int, hold_back_us: int, grace_us: int | None = None) -> DataFrame:
    """by, us_a, us_b, delay_us, status of a stream of edges(by, side, us), sides `a` and `b`, matched by the two-pointer rule.

    The fronts of a key pair if at most tol_us apart, else the earlier one is unmatched. An edge is decided when its key
    has come hold_back_us further (more than tol_us, as half a period is), so that its partner has arrived: edges of a key
    may be out of order by up to hold_back_us - tol_us. The state of a key is the edges of that span; those left when a
    stream stops are decided by finish_matches.

    With grace_us (hold_back_us at least, as a period is) a key that falls silent is decided by the clock of all keys,
    the latest edge of any: pairs hold_back_us after it, edges without a partner grace_us after it. The clock moves
    between batches; an edge more than hold_back_us behind it is dropped.
    """
    more = (grace_us or hold_back_us) - hold_back_us

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], None)
        sides, latest = [list(held[0]), list(held[1])], -(2**62) if held[2] is None else held[2]
        # A key whose time is out comes without rows.
        for new in pdfs:
            for k, side in ((0, "a"), (1, "b")):
                sides[k] += new.loc[new["side"] == side, "us"].tolist()
            latest = max(latest, int(new["us"].max())) if len(new) else latest
        clock = latest - hold_back_us
        if grace_us is not None:
            clock = max(clock, state.getCurrentWatermarkMs() * 1000)
        found, rest = _decide(sorted(sides[0]), sorted(sides[1]), tol_us, clock, clock - more)
        state.update((*rest, latest))
        if grace_us is not None and (rest[0] or rest[1]):
            first = min(x[0] for x in rest if x)
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, -(-(first + (0 if rest[0] and rest[1] else more)) // 1000)))
        yield pd.DataFrame([(key[0], *r) for r in found], columns=[by, "us_a", "us_b", "status"]).astype({"us_a": "Int64", "us_b": "Int64"})

    kind = dict(edges.dtypes)[by]
    timeout = GroupStateTimeout.NoTimeout
    if grace_us is not None:
        edges = edges.withColumn("_ts", F.timestamp_micros("us")).withWatermark("_ts", f"{hold_back_us} microseconds")
        timeout = GroupStateTimeout.EventTimeTimeout
    out = edges.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, us_a long, us_b long, status string", "a array<long>, b array<long>, latest long", "append", timeout)
    return out.select(by, "us_a", "us_b", (F.col("us_b") - F.col("us_a")).alias("delay_us"), "status")


def _decide(a: list[int], b: list[int], tol: int, until: int, alone: int | None = None) -> tuple[list[tuple], tuple[list[int], list[int]]]:
    """(us_a, us_b, status) of all decisions whose earlier edge lies at or before `until` (without a partner: `alone`), and the edges left."""
    i = j = 0
    out: list[tuple] = []
    alone = until if alone is None else alone
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and abs(a[i] - b[j]) <= tol:
            if min(a[i], b[j]) > until:
                break
            out.append((a[i], b[j], "matched"))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and a[i] < b[j]):
            if a[i] > alone:
                break
            out.append((a[i], None, "unmatched_a"))
            i += 1
        else:
            if b[j] > alone:
                break
            out.append((None, b[j], "unmatched_b"))
            j += 1
    return out, (a[i:], b[j:])


def held_edges(spark: SparkSession, folder: str, by: str) -> DataFrame:
    """by, side, us of the edges that a stopped query of stream_match with its state in `folder` still holds, from that state."""
    state = spark.read.format("statestore").load(f"{folder}/state").select(F.col(f"key.{by}").alias(by), "value.groupState.*")
    return state.select(by, F.lit("a").alias("side"), F.explode("a").alias("us")).unionByName(state.select(by, F.lit("b").alias("side"), F.explode("b").alias("us")))


def finish_matches(spark: SparkSession, folder: str, by: str, tol_us: int) -> DataFrame:
    """What a stopped stream of stream_match held, matched to the end, from its state alone: the source isn't read again."""
    held = held_edges(spark, folder, by)
    left, right = (held.where(F.col("side") == side).select(by, F.col("us").alias(t)) for side, t in (("a", "t_a"), ("b", "t_b")))
    return match(left, right, "t_a", "t_b", tol_us, "two_pointer", [by]).select(by, F.col("t_a").alias("us_a"), F.col("t_b").alias("us_b"), F.col("delay").alias("delay_us"), "status")


def _samples(pdfs: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """idx and v of a key's new samples, in order."""
    parts = [(x["idx"].to_numpy(np.int64), x["v"].to_numpy(float)) for x in pdfs]
    idx, v = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(idx, kind="stable")
    return idx[order], v[order]


def stream_detect(samples: DataFrame, by: str, threshold: float, min_distance: float, skip: int = 0, reset: float | None = None) -> DataFrame:
    """by, t, edge_type of threshold crossings in a stream of samples(by, idx, v) whose batches are in order.

    Samples before `skip` are left out, and with `reset` all before the first with |v| below it. The state of a key is
    its last sample, the last kept crossing of each type and whether it has settled, so borders between batches change
    nothing: the stream's edges are the batch operators'.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_idx, last_v, rise, fall, settled = state.get if state.exists else (None, None, None, None, reset is None)
        idx, v = _samples(pdfs)
        first = int(np.searchsorted(idx, skip))
        if not settled:
            calm = np.flatnonzero(np.abs(v[first:]) < reset)
            first, settled = (first + int(calm[0]), True) if len(calm) else (len(idx), False)
        idx, v = idx[first:], v[first:]
        if last_idx is not None:
            idx, v = np.concatenate(([last_idx], idx)), np.concatenate(([last_v], v))
        before, now = v[:-1], v[1:]
        kinds = np.where((before > -threshold) & (now <= -threshold), 0, np.where((before < threshold) & (now >= threshold), 1, -1))
        hits = np.flatnonzero(kinds >= 0)
        level = np.where(kinds[hits] == 0, -threshold, threshold)
        times = idx[hits + 1] - 1 + (level - before[hits]) / (now[hits] - before[hits])
        kept, found = [rise, fall], []
        # Only crossings are gone through one by one: whether one is kept depends on the one kept before.
        for t, kind in zip(times.tolist(), kinds[hits].tolist(), strict=True):
            if kept[kind] is None or t - kept[kind] >= min_distance:
                found.append((key[0], t, kind))
                kept[kind] = t
        if len(idx):
            last_idx, last_v = int(idx[-1]), float(v[-1])
        state.update((last_idx, last_v, *kept, settled))
        if found:
            yield pd.DataFrame(found, columns=[by, "t", "edge_type"])

    return samples.groupBy(by).applyInPandasWithState(step, f"{by} string, t double, edge_type int", "idx long, v double, rise double, fall double, settled boolean", "append", GroupStateTimeout.NoTimeout)


#: Samples before and after one that decide on it, for each method.
_REACH = {"peaks": (1, 1), "hysteresis": (0, 0), "linreg": (11, 15)}
_AHEAD = "idx array<long>, v array<double>, open int, rise double, fall double, low boolean, high boolean"


def _line_time(x: np.ndarray, y: np.ndarray, level: float, at: int) -> float:
    """at + the offset at which the least-squares line through the points reaches level; the first point's where there is none."""
    n, sx, sy = float(len(x)), float(x.sum()), float(y.sum())
    sxy, sxx = float((x * y).sum()), float((x * x).sum())
    flat = n * sxx - sx * sx
    slope = (n * sxy - sx * sy) / flat if n >= 2 and abs(flat) >= 1e-12 else 0.0
    return float(at + x[0]) if abs(slope) < 1e-12 else at + (level - (sy - slope * sx) / n) / slope


def _found(method: str, idx: np.ndarray, v: np.ndarray, low: int, high: int, threshold: float) -> list[tuple[float, int, float, int]]:
    """(time, edge_type, height, sample) of the candidates among samples low to high, whose surroundings are all there."""
    now, before = v[max(low, 1) : high], v[max(low, 1) - 1 : max(high - 1, 0)]
    place = np.arange(max(low, 1), max(high, max(low, 1)))
    if method == "peaks":
        after = np.append(v, np.nan)[place + 1] if len(place) else now
        top, bottom = (now > before) & (now > after) & (now > threshold), (now < before) & (now < after) & (now < -threshold)
        at = np.flatnonzero(top | bottom)
        bend = before[at] - 2 * now[at] + after[at]
        off = np.where(np.abs(bend) < 1e-10, 0.0, np.clip((before[at] - after[at]) / np.where(bend == 0, 1, 2 * bend), -1, 1))
        return list(zip((idx[place[at]] + off).tolist(), np.where(bottom[at], 0, 1).tolist(), now[at].tolist(), idx[place[at]].tolist(), strict=True))
    rise, fall = (before > -threshold) & (now <= -threshold), (before < threshold) & (now >= threshold)
    out = []
    for j in place[rise | fall].tolist():
        kind = 0 if rise[j - place[0]] else 1
        first, last = np.searchsorted(idx, (idx[j] - 11, idx[j] + 16))
        i, y = idx[first:last], v[first:last] * (-1 if kind == 0 else 1)
        peak = j - first + int(np.argmax(y[j - first :]))
        flank = np.flatnonzero((i >= i[peak] - 10) & (i < i[peak]) & (y >= y[peak] * 0.2) & (y <= y[peak] * 0.8))
        if len(flank):
            out.append((_line_time((i[flank] - idx[j]).astype(float), y[flank], y[peak] * 0.5, int(idx[j])), kind, float(y[peak]), int(idx[j])))
    return out


def _detected(method: str, held: tuple | None, idx: np.ndarray, v: np.ndarray, threshold: float, min_distance: float, reset: float, ending: bool = False) -> tuple[list[tuple], tuple]:
    """What a key's next samples decide, and what is held then; `ending` decides on all with what is there."""
    old_idx, old_v, waiting, rise, fall, low, high = held or ([], [], 0, None, None, False, False)
    before, after = _REACH[method]
    idx, v = np.concatenate((np.array(old_idx, np.int64), idx)), np.concatenate((np.array(old_v, float), v))
    start, stop = len(old_idx) - waiting, len(idx) if ending else max(len(old_idx) - waiting, len(idx) - after)
    found: list[tuple] = []
    if method == "hysteresis":
        seen = [low, high]
        for k in np.flatnonzero((np.abs(v[start:stop]) < reset) | (np.abs(v[start:stop]) >= threshold)) + start:
            seen = [False, False] if abs(v[k]) < reset else seen
            kind = 0 if v[k] <= -threshold else 1 if v[k] >= threshold else None
            if kind is not None and not seen[kind]:
                found.append((float(idx[k]), kind, float(v[k]), int(idx[k])))
                seen[kind] = True
        low, high = seen
    else:
        kept = [rise, fall]
        for t, kind, height, sample in _found(method, idx, v, start, stop, threshold):
            if not min_distance or kept[kind] is None or t - kept[kind] >= min_distance:
                found.append((t, kind, height, sample))
                kept[kind] = t
        rise, fall = kept
    first = max(0, stop - before)
    return found, (idx[first:].tolist(), v[first:].tolist(), len(idx) - stop, rise, fall, low, high)


def stream_detect_ahead(samples: DataFrame, by: str, method: str, threshold: float, min_distance: float = 0, reset: float = 0) -> DataFrame:
    """by, t, edge_type, height, idx (the sample) of a stream of samples(by, idx, v) whose batches are in order.

    method: 'peaks' (as detect_peaks, beyond threshold), 'linreg' (as detect_linreg, of crossings of threshold) or
    'hysteresis' (as detect_hysteresis with -threshold, threshold and reset; t is the sample). A key holds the samples
    before and after the ones not yet decided, 26 at most, so borders between batches change nothing; what a stopped
    stream still held is decided by finish_detect. Edges are debounced in the order of their samples, which is that of their times in smooth signals.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found, held = _detected(method, state.get if state.exists else None, *_samples(pdfs), threshold, min_distance, reset)
        state.update(held)
        for k in range(0, len(found), 100_000):
            yield pd.DataFrame([(key[0], *f) for f in found[k : k + 100_000]], columns=[by, "t", "edge_type", "height", "idx"])

    return samples.groupBy(by).applyInPandasWithState(step, f"{by} {dict(samples.dtypes)[by]}, t double, edge_type int, height double, idx long", _AHEAD, "append", GroupStateTimeout.NoTimeout)


def finish_detect(spark: SparkSession, folder: str, by: str, method: str, threshold: float, min_distance: float = 0, reset: float = 0) -> DataFrame:
    """What a stopped stream of stream_detect_ahead still held, decided with the samples there are, from its state alone."""
    state = spark.read.format("statestore").load(f"{folder}/state").select(F.col(f"key.{by}").alias(by), "value.groupState.*")
    kind = dict(state.dtypes)[by]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, *held in frame.itertuples(index=False):
                held = [None if isinstance(x, float) and np.isnan(x) else x for x in held]
                found, _ = _detected(method, (list(held[0]), list(held[1]), int(held[2]), *held[3:]), np.zeros(0, np.int64), np.zeros(0), threshold, min_distance, reset, ending=True)
                out += [(key, *f) for f in found]
            yield pd.DataFrame(out, columns=[by, "t", "edge_type", "height", "idx"])

    return state.mapInPandas(run, f"{by} {kind}, t double, edge_type int, height double, idx long")


@contextmanager
def _state_tasks(spark: SparkSession, keys: int | None) -> Iterator[None]:
    """Streams that start inside deal their state to at most as many tasks as there are `keys`.

    Each batch starts all tasks of a state and commits each one's files, keys or not, so idle ones are what a batch of
    few keys costs. A stream keeps the number it began with; the session has its own again once it has started.
    """
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    if keys is not None:
        spark.conf.set(name, str(max(1, min(int(own), keys))))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def run_hook(stream: DataFrame, folder: str, hook: Callable[[DataFrame, int], None], keys: int | None = None) -> None:
    """Runs a stream of decisions over all data there is and hands each batch of them, with its number, to a hook, as
    edges are matched. A batch may come again after a failure, with the same number. `keys`: see _state_tasks."""
    with _state_tasks(stream.sparkSession, keys):
        query = stream.writeStream.foreachBatch(hook).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def run_stamped(stream: DataFrame, folder: str, clock: Callable[[], int] = time.time_ns) -> DataFrame:
    """Stamps each batch of a stream of raw messages(topic, payload, ...) with its arrival, once, and returns all so far.

    Returns the messages as stamp_arrival makes them (an event's own time is kept), with `arrival` in ns and `batch`. A
    batch's stamp is written before its rows, and is later than that of the batch before whatever the clock says: what
    is run again after a stop keeps its stamps, so ordering by arrival replays the messages as they came.
    """
    spark = stream.sparkSession

    def stamp_of(number: int) -> int | None:
        try:
            return spark.read.schema("stamp long").parquet(f"{folder}/stamps/batch={number}").agg(F.max("stamp")).first()[0]
        except AnalysisException:
            return None

    def put(batch: DataFrame, number: int) -> None:
        stamp = stamp_of(number)
        if stamp is None:
            stamp = max(clock(), (stamp_of(number - 1) or 0) + 1)
            spark.createDataFrame([(stamp,)], "stamp long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/stamps/batch={number}")
        telemetry.stamp_arrival(batch, F.lit(stamp)).withColumn("arrival", F.lit(stamp)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def stream_dedup(edges: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """Edges that overlapping chunks deliver twice, once."""
    return edges.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", keys: int | None = None) -> DataFrame:
    """Runs a stream over all data there is and returns what it wrote; state and output are in `folder`. `keys`: see _state_tasks."""
    with _state_tasks(stream.sparkSession, keys):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_tail(stream: DataFrame, folder: str, timeout: float | None = None) -> DataFrame:
    """Follows a stream batch by batch for `timeout` seconds, or until nothing new is there, and returns what it wrote.

    What a batch that is stopped half-way has read is read again by the next run with this folder.
    """
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    try:
        if timeout is None:
            query.processAllAvailable()
        else:
            query.awaitTermination(timeout)
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_routed(stream: DataFrame, folder: str, route: Callable[[DataFrame], DataFrame], by: str) -> DataFrame:
    """Runs a stream through a batch function, into one folder per value of `by`."""

    def put(batch: DataFrame, number: int) -> None:
        # A batch that is run again overwrites its own folder, so nothing is written twice.
        route(batch).write.mode("overwrite").partitionBy(by).parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")
