"""Binary captures: edge, delay and sample files as a data source with byte-range partitions."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .shared import new_folder

#: The layout of each file's fixed-width records, little-endian, with the columns they give.
KINDS = {
    "edges": (np.dtype([("t", "<f8"), ("edge_type", "u1"), ("pad", "V7")]), [("t", pa.float64()), ("edge_type", pa.int8())], "t double, edge_type tinyint"),
    "delays": (np.dtype([("t", "<f8"), ("delay_ns", "<f8")]), [("t", pa.float64()), ("delay_ns", pa.float64())], "t double, delay_ns double"),
    "iq": (np.dtype([("a", "<f4"), ("b", "<f4")]), [("a", pa.float32()), ("b", pa.float32())], "a float, b float"),
}
V2_HEADER, V2_POINT = "<qBBf", "<hf"
_ROWS = 65536


@dataclass
class Records(InputPartition):
    """Records [start, stop) of a file."""

    path: str
    start: int
    stop: int


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)


def _files(path: str) -> tuple[pafs.FileSystem, list[tuple[str, int]]]:
    place, root = _place(path)
    info = place.get_file_info(root)
    found = [info] if info.is_file else place.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return place, sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".bin", ".cfile")))


def _channel(path: str) -> int | None:
    found = re.search(r"ch(\d+)\.bin$", path)
    return int(found[1]) if found else None


class _Base:
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options["kind"]
        self.first = int(options.get("start", 0))
        self.last = int(options.get("stop", 2**62))
        self.records = int(options.get("partition_records", 1 << 20))
        self.width = KINDS[self.kind][0].itemsize
        self.channels: set[int] | None = None

    def ranges(self) -> list[Records]:
        """Whole records of all files; other record ranges and other channels aren't read at all."""
        out = []
        for path, size in _files(self.path)[1]:
            if self.channels is None or _channel(path) in self.channels:
                high = min(self.last, size // self.width)
                out += [Records(path, k, min(k + self.records, high)) for k in range(self.first, high, self.records)]
        return out

    def rows(self, part: Records) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        place = _place(self.path)[0]
        dtype, columns, _ = KINDS[self.kind]
        with place.open_input_file(part.path) as f:
            for k in range(part.start, part.stop, _ROWS):
                n = min(_ROWS, part.stop - k)
                data = np.frombuffer(f.read_at(n * self.width, k * self.width), dtype)
                name = part.path.rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([_channel(name)] * n, pa.int32()), pa.array(np.arange(k, k + n))] + [pa.array(np.ascontiguousarray(data[c]), t) for c, t in columns], ["file", "channel", "rec", *[c for c, _ in columns]])


class RecordReader(_Base, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes bounds on rec and values of channel, so that only their bytes are read; others are left to Spark."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("rec",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value + (not isinstance(f, LessThan)))
            elif name == ("channel",) and isinstance(f, (EqualTo, In)):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.channels = given - {None} if self.channels is None else self.channels & given
            elif name not in (("rec",), ("channel",)) or not isinstance(f, IsNotNull):
                yield f
            elif name == ("channel",):
                yield f

    def partitions(self) -> list[Records]:
        return self.ranges() or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)


class RecordTail(_Base, DataSourceStreamReader):
    """Follows growing files; an offset is the number of whole records of each file.

    With `max_records` a batch gets at most so many records of all files together. Spark doesn't tell a source where
    the last batch ended, so what is planned is written to a file in `progress` before it is handed out: a restarted
    query goes on from there. If the plan was lost with the driver, one batch holds two portions.
    """

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.most = int(options["max_records"]) if "max_records" in options else None
        self.progress = options.get("progress")
        self.planned: dict[str, int] | None = None

    def _plans(self) -> tuple[pafs.FileSystem, str]:
        place, root = _place(self.progress)
        return place, f"{root}/planned.json"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        there = {path: size // self.width for path, size in _files(self.path)[1]}
        if self.most is None:
            return there
        place, plans = self._plans()
        if self.planned is None:
            self.planned = {}
            if place.get_file_info(plans).is_file:
                with place.open_input_stream(plans) as f:
                    self.planned = json.loads(f.read())
        left = self.most
        for path, high in there.items():
            low = self.planned.get(path, 0)
            there[path] = low + min(left, max(0, high - low))
            left -= there[path] - low
        if there != self.planned:
            place.create_dir(plans.rsplit("/", 1)[0], recursive=True)
            with place.open_output_stream(plans) as f:
                f.write(json.dumps(there).encode())
        self.planned = there
        return there

    def partitions(self, start: dict, end: dict) -> list[Records]:
        out = []
        for path, high in end.items():
            low = start.get(path, 0)
            out += [Records(path, k, min(k + self.records, high)) for k in range(low, high, self.records)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)


class CaptureRecords(DataSource):
    """Format capture_records: load(path) with the options kind, start, stop, partition_records and (streams) max_records."""

    @classmethod
    def name(cls) -> str:
        return "capture_records"

    def schema(self) -> str:
        return "file string, channel int, rec long, " + KINDS[self.options["kind"]][2]

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options)

    def streamReader(self, schema: StructType) -> RecordTail:
        return RecordTail(self.options)


def _load(spark: SparkSession, path: str, kind: str, start: int | None, stop: int | None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureRecords)
    reader = spark.read.format("capture_records").option("kind", kind)
    for k, v in (("start", start), ("stop", stop)):
        reader = reader if v is None else reader.option(k, v)
    return reader.load(path)


def read_edges(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """file, channel, rec, t, edge_type of 16-byte edge records; a record range reads its own bytes only, whether it is
    given here or as a filter on rec, and a filter on channel reads its own files."""
    return _load(spark, path, "edges", start, stop)


def read_delays(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, "delays", None, None).drop("channel")


def read_iq(spark: SparkSession, path: str, skip_s: float = 0, sample_rate: float = 10e6) -> DataFrame:
    """file, idx, a, b of complex samples; skipped seconds aren't read."""
    return _load(spark, path, "iq", int(skip_s * sample_rate), None).drop("channel").withColumnRenamed("rec", "idx")


def tail_edges(spark: SparkSession, path: str, max_records: int | None = None, progress: str | None = None) -> DataFrame:
    """A stream over growing edge files, whole records only, at most max_records of them in a batch.

    A query that is to be restarted needs the same `progress` folder each time, as it does the same checkpoint.
    """
    spark.dataSource.register(CaptureRecords)
    stream = spark.readStream.format("capture_records").option("kind", "edges")
    if max_records is not None:
        stream = stream.option("max_records", max_records).option("progress", progress or new_folder(spark, "progress"))
    return stream.load(path)


_V2_SCHEMA = "path string, rec long, trigger_idx long, edge_type tinyint, peak float, points array<struct<off:smallint,v:float>>"
#: Bytes of a header and of a point, where a header holds the number of points, and the longest record.
_HEAD, _POINT, _COUNT_AT = struct.calcsize(V2_HEADER), struct.calcsize(V2_POINT), 9
_LONGEST = _HEAD + 255 * _POINT
#: Bytes of a range; most tasks that ranges are dealt to.
V2_RANGE, _MOST_TASKS = 4 << 20, 100_000


def v2_exits(data: bytes, length: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """For each offset at which a range of `length` bytes could be entered, where the next one is entered (-1: the file
    ends before) and how many whole records begin in between.

    `data` goes on behind the range as far as a header needs; `left` are the file's bytes from the range's start. Ways
    that meet go on as one.
    """
    ways = min(_LONGEST, length)
    exits, counts = np.zeros(_LONGEST, np.int16), np.zeros(_LONGEST, np.int32)
    # An entry beyond a short range leads through it to the next.
    exits[ways:] = np.arange(ways, _LONGEST) - length
    seen: dict[int, tuple[int, int]] = {}
    for entry in range(ways):
        at, n, own = entry, 0, []
        while at < length and at not in seen:
            after = at + _HEAD + data[at + _COUNT_AT] * _POINT if at + _HEAD <= left else left + 1
            if after > left:
                break
            own.append(at)
            at, n = after, n + 1
        if at in seen:
            way, before = seen[at]
            exits[entry], counts[entry] = exits[way], n + counts[way] - before
        else:
            exits[entry], counts[entry] = (at - length if at >= length else -1), n
        for k, place in enumerate(own):
            seen[place] = (entry, k)
    return exits, counts


def v2_records(data: bytes, entry: int, length: int, left: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Headers, and points, of the whole records that begin in a range entered at `entry`; data holds the last one's end too."""
    at, begin = entry, []
    while at < length and at + _HEAD <= left:
        after = at + _HEAD + data[at + _COUNT_AT] * _POINT
        if after > left:
            break
        begin.append(at)
        at = after
    raw, begin = np.frombuffer(data, np.uint8), np.array(begin, np.int64)
    heads = raw[begin[:, None] + np.arange(_HEAD)].view(np.dtype([("trigger", "<i8"), ("type", "u1"), ("n", "u1"), ("peak", "<f4")]))[:, 0] if len(begin) else np.zeros(0, [("trigger", "<i8"), ("type", "u1"), ("n", "u1"), ("peak", "<f4")])
    many = heads["n"].astype(np.int64)
    ends = np.cumsum(many)
    place = np.repeat(begin + _HEAD - (ends - many) * _POINT, many) + np.arange(many.sum()) * _POINT
    points = raw[place[:, None] + np.arange(_POINT)].view(np.dtype([("off", "<i2"), ("v", "<f4")]))[:, 0] if len(place) else np.zeros(0, [("off", "<i2"), ("v", "<f4")])
    items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points["off"])), pa.array(np.ascontiguousarray(points["v"]))], ["off", "v"])
    return begin, heads, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), items)


def read_edges_v2(spark: SparkSession, path: str, range_bytes: int = V2_RANGE) -> DataFrame:
    """path, rec, trigger_idx, edge_type, peak, points(off, v) of variable-length records; a cut-off tail is dropped.

    Records don't tell where others begin, but none is longer than 1,544 bytes: each range of a file is summed up to
    where it is left, and how many records it holds, for each offset it could be entered at; the sums are chained in
    order, and then every range is read by itself, with its right record numbers. A file that changes meanwhile is
    read as it was listed. No files give no rows.
    """

    def raw(name: str, number: int, more: int) -> bytes:
        with _place(path)[0].open_input_file(name) as f:
            return f.read_at(range_bytes + more, number * range_bytes)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, number in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                left = size - number * range_bytes
                exits, counts = v2_exits(raw(name, number, _HEAD), min(range_bytes, left), left)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, size, number, exits.tobytes(), counts.tobytes())], ["path", "size", "number", "exits", "counts"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, entry, rec = None, 0, 0
        for batch in batches:
            done = []
            for name, size, number, exits, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != file:
                    file, entry, rec = name, 0, 0
                if entry < 0:
                    continue
                done.append((name, size, number, entry, rec))
                rec, entry = rec + int(np.frombuffer(counts, np.int32)[entry]), int(np.frombuffer(exits, np.int16)[entry])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * 5, [pa.string(), *[pa.int64()] * 4], strict=True)], ["path", "size", "number", "entry", "rec"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, number, entry, rec in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                left = size - number * range_bytes
                _, heads, points = v2_records(raw(name, number, _LONGEST), entry, min(range_bytes, left), left)
                n = len(heads)
                columns = [pa.array([name] * n, pa.string()), pa.array(np.arange(rec, rec + n)), *[pa.array(np.ascontiguousarray(heads[c]).astype(t)) for c, t in (("trigger", np.int64), ("type", np.int8), ("peak", np.float32))], points]
                made = pa.RecordBatch.from_arrays(columns, ["path", "rec", "trigger_idx", "edge_type", "peak", "points"])
                for k in range(0, n, _ROWS):
                    yield made.slice(k, _ROWS)

    files = [(name, size) for name, size in _files(path)[1] if size]
    tasks = max(1, min(_MOST_TASKS, sum(-(-size // range_bytes) for _, size in files)))
    ranges = spark.createDataFrame(files, "path string, size long").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {range_bytes}"))).alias("number"))
    sums = ranges.repartition(tasks).mapInArrow(sum_up, "path string, size long, number long, exits binary, counts binary")
    starts = sums.repartition("path").sortWithinPartitions("path", "number").mapInArrow(chain, "path string, size long, number long, entry long, rec long")
    return starts.repartition(tasks).mapInArrow(decode, _V2_SCHEMA)
