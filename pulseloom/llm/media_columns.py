"""Media columns: texts stored losslessly as 8-bit grey images in archives, and a data source that reads them back.

An archive directory holds pairs of files: NAME.pack with whole PNG files one after the other, and NAME.idx with
a fixed-width entry (offset, length, doc_id, has_id, unpadded bytes) for each, in order of offset. Its manifest, a
Parquet table of its own, names the archives that count.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .common import id_and_text, new_path

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, LEVEL = 64, 4
ENTRY, ENTRY_BYTES = "<QQqqQ", 40
RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 8 << 20, 2 << 20, 3
_ARCHIVE_BYTES = 256 << 20


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes) -> bytes:
    """payload, a multiple of WIDTH long, as an 8-bit grey PNG of that width: a sample is a byte."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks_of(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk of a PNG; raises ValueError if it is cut off or a checksum fails."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kind = 8, b""
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at) if at + 12 <= len(media) else (len(media), b"")
        body = media[at + 8 : at + 8 + size]
        if len(media) < at + 12 + size or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        yield kind, body
        at += 12 + size
    if kind != b"IEND":
        raise ValueError("the PNG has no end")


def from_image(media: bytes) -> bytes:
    """The samples of an image that to_image made; raises ValueError if any checksum fails."""
    data, head = [], b""
    for kind, body in chunks_of(media):
        head = body if kind == b"IHDR" else head
        if kind == b"IDAT":
            data.append(body)
    width, height = struct.unpack_from(">II", head)
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a PNG filter that isn't expected")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, standard deviation, entropy in bits, sign changes about the mean, and the darkest and lightest sample."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    levels = np.arange(256)
    mean = float((counts * levels).sum()) / len(samples)
    deviation = (float((counts * (levels - mean) ** 2).sum()) / len(samples)) ** 0.5
    above = samples > mean
    changes = int((above[1:] != above[:-1]).sum())
    there = np.flatnonzero(counts)
    return f"mean={mean:.4f};std={deviation:.4f};entropy={max(0.0, float(-(share * np.log2(share)).sum())):.4f};changes={changes};min={there[0]};max={there[-1]}"


def write_media(docs: DataFrame, folder: str) -> str:
    """Writes each row's text to archives in folder, and their manifest (path, bytes, members); returns the manifest's path.

    Each attempt of a task writes under names of its own. The manifest is written as a table, whose commit takes
    one attempt of each task, so archives of lost or doubled attempts are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = pafs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        task, number, out = TaskContext.get(), 0, None
        name, offset, index = "", 0, []

        def close() -> pa.RecordBatch:
            out.close()
            with place.open_output_stream(f"{root}/{name}.idx") as side:
                side.write(b"".join(index))
            return pa.RecordBatch.from_pylist([{"path": f"{root}/{name}.pack", "bytes": offset, "members": len(index)}], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())]))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if out is None:
                    name = f"media-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}"
                    number += 1
                    out, offset, index = place.open_output_stream(f"{root}/{name}.pack"), 0, []
                data = text.encode("utf-8", "surrogatepass")
                media = to_image(padded(data))
                out.write(media)
                index.append(struct.pack(ENTRY, offset, len(media), 0 if doc_id is None else doc_id, doc_id is not None, len(data)))
                offset += len(media)
                if offset >= _ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    manifest = f"{folder.rstrip('/')}/manifest"
    id_and_text(docs).mapInArrow(run, "path string, bytes long, members long").write.mode("overwrite").parquet(manifest)
    return manifest


@dataclass
class ByteRange(InputPartition):
    """The members of an archive whose first byte lies in [start, stop)."""

    path: str
    start: int
    stop: int


class MediaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def _place(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder)

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the archives in the manifest, whose indexes must be whole; of all archives in the folder if there is no manifest."""
        place, root = self._place()
        listed = f"{root}/manifest"
        if place.get_file_info(listed).type == pafs.FileType.NotFound:
            files = place.get_file_info(pafs.FileSelector(root, allow_not_found=True))
            packs = sorted((f.path, f.size) for f in files if f.path.endswith(".pack"))
        else:
            parts = sorted(f.path for f in place.get_file_info(pafs.FileSelector(listed)) if f.path.endswith(".parquet"))
            rows = [row for p in parts for row in pq.read_table(place.open_input_file(p)).to_pylist()]
            packs = sorted((r["path"], r["bytes"]) for r in rows)
            sides = place.get_file_info([r["path"].removesuffix(".pack") + ".idx" for r in rows])
            for row, side in zip(rows, sides, strict=True):
                if side.size != ENTRY_BYTES * row["members"]:
                    raise OSError(f"{side.path} doesn't index {row['members']} members")
        found = [ByteRange(path, at, min(at + self.range_bytes, size)) for path, size in packs for at in range(0, size, self.range_bytes)]
        return found or [ByteRange("", 0, 0)]

    def members(self, place: pafs.FileSystem, part: ByteRange) -> Iterator[tuple]:
        """The index entries of a range, found by bisection: only its own part of the index is read."""
        side = part.path.removesuffix(".pack") + ".idx"
        with place.open_input_file(side) as index:
            low, high = 0, index.size() // ENTRY_BYTES

            def entry(k: int) -> tuple:
                return struct.unpack(ENTRY, index.read_at(ENTRY_BYTES, k * ENTRY_BYTES))

            end = high
            while low < high:
                mid = (low + high) // 2
                if entry(mid)[0] < part.start:
                    low = mid + 1
                else:
                    high = mid
            while low < end:
                block = index.read_at(ENTRY_BYTES * min(4096, end - low), low * ENTRY_BYTES)
                for one in struct.iter_unpack(ENTRY, block):
                    if one[0] >= part.stop:
                        return
                    yield one
                low += len(block) // ENTRY_BYTES

    def member(self, place: pafs.FileSystem, path: str, offset: int, length: int, first: pa.NativeFile | None) -> bytes:
        """One member's bytes; a failed or damaged read is tried again from a fresh handle, for this member alone."""
        for attempt in range(self.attempts):
            try:
                if attempt == 0 and first is not None:
                    media = first.read_at(length, offset)
                else:
                    with place.open_input_file(path) as again:
                        media = again.read_at(length, offset)
                if len(media) == length:
                    for _ in chunks_of(media):
                        pass
                    return media
                error: Exception = ValueError("short")
            except (OSError, ValueError) as e:
                error = e
            time.sleep(0.05 * 4**attempt)
        raise OSError(f"{path} at {offset}: {error}")

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        place, _ = self._place()
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()], strict=True)], ["doc_id", "n_bytes", "media", "archive", "offset"])

        with place.open_input_file(partition.path) as pack:
            for offset, length, doc_id, has_id, n_bytes in self.members(place, partition):
                rows.append((doc_id if has_id else None, n_bytes, self.member(place, partition.path, offset, length, pack), partition.path, offset))
                held += length
                if held >= self.batch_bytes or len(rows) >= 1000:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()


class MediaArchives(DataSource):
    """Format media_archives: load(folder), with the options range_bytes, batch_bytes and attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary, archive string, offset long"

    def reader(self, schema: StructType) -> MediaReader:
        return MediaReader(self.options)


def read_media(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    """doc_id, n_bytes, media, archive, offset of every member of the archives in folder."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of media(doc_id, n_bytes, media), from the samples as they were stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column("media").to_pylist():
                payload = from_image(stored)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores the text of every row of docs in folder (a new one in the shared folder), reads all back and describes it.

    A null text is the empty text, whose payload is 64 zero bytes. Equal texts give equal values; null and
    repeated doc_ids are kept as they are; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "media")
    write_media(docs, folder)
    return media_features(read_media(spark, folder))
