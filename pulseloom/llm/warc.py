"""Dictionary-compressed WARC archives: a writer, a reader, and revisit records for equal payloads.

An archive starts with a skippable frame that holds the Zstandard dictionary built from the archive's own first
records; every record follows as a frame of its own, so any record can be read by its offset alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import copies, join_skewed, new_path, saved

#: The skippable frame's magic number of dictionaries, and the profile of revisits.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1000
LEVEL, DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS = 3, 32 << 10, 1 << 20, 200
_ARCHIVE_BYTES, _CHUNK = 256 << 20, 256 << 10


def response_id(size: int, digest: str) -> str:
    """The record id of the one response to which revisits of a payload refer."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'sha1:{digest}:{size}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None, date: str, shared: bool = False) -> bytes:
    """One WARC record: a response, or (kind revisit, with an empty payload) a revisit of the page refers_to.

    Every record has an id of its own; that of a response whose payload is shared follows from the payload.
    A url with line breaks can't be a header: it is escaped there, and given once more as JSON.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = kind == "revisit"
    block = http if revisit else http + payload
    own = response_id(size, digest) if shared and not revisit else f"<urn:uuid:{uuid.uuid4()}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if "\r" in url or "\n" in url:
            lines.append("Target-JSON: " + json.dumps(url))
    lines += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Refers-To: {response_id(size, digest)}", f"WARC-Profile: {REVISIT}"]
        if refers_to is not None:
            lines.append(f"Refers-To-Page: {refers_to}")
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary built from records; of too few to train on, their own beginning."""
    if not records:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Writes records to one archive; those up to the sample's bound wait for the dictionary that they build."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.waiting, self.bytes, self.size, self.records, self.compress = out, [], 0, 0, 0, None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compress:
            self._put(self.compress(data))
            return
        self.waiting.append(data)
        self.bytes += len(data)
        if self.bytes >= SAMPLE_BYTES or len(self.waiting) >= SAMPLE_RECORDS:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _start(self) -> None:
        dictionary = dictionary_of([r[: SAMPLE_BYTES // 8] for r in self.waiting])
        if dictionary:
            body = dictionary.as_bytes()
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True).compress
        waiting, self.waiting = self.waiting, []
        for data in waiting:
            self._put(self.compress(data))

    def close(self) -> None:
        if self.waiting:
            self._start()


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, one frame after the other in bounded memory."""
    data = source.read(_CHUNK)
    dictionary = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        end = 8 + struct.unpack_from("<I", data, 4)[0]
        while len(data) < end:
            data += source.read(_CHUNK)
        body, data = data[8:end], data[end:]
        kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        dictionary = zstandard.ZstdCompressionDict(body, dict_type=kind)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := source.read(_CHUNK)):
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = source.read(_CHUNK)
            if not data:
                raise EOFError("the archive ends inside a record")
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def write_archives(records: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Writes records(page_id, url, html, size, payload_digest, kind, refers_to, shared) to archives in folder; path, records, bytes of each.

    Each attempt of a task writes under names of its own, and only the archives that the rows of this result name
    count: what a lost or doubled attempt leaves is never read. An archive ends after about 256 MB of payload.
    """
    when = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = pafs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        task, number = TaskContext.get(), 0
        writer, held, name = None, 0, ""

        def close() -> pa.RecordBatch:
            writer.close()
            writer.out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{root}/{name}", "records": writer.records, "bytes": writer.size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for page_id, url, html, size, digest, kind, refers_to, shared in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                if writer is None:
                    name = f"pages-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.zst"
                    number += 1
                    writer, held = Writer(place.open_output_stream(f"{root}/{name}", compression=None)), 0
                payload = html.encode("utf-8", "surrogatepass") if kind == "response" else b""
                writer.add(record(page_id, url, payload, size, digest, kind, refers_to, when, shared))
                held += len(payload)
                if held >= _ARCHIVE_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return records.select("page_id", "url", "html", "size", "payload_digest", "kind", "refers_to", "shared").mapInArrow(run, "path string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record; the paths are dealt to tasks.

    Length and digest of a response come from its payload as read back; those of a revisit from its record.
    """

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def target(headers: dict[str, str]) -> str | None:
        return json.loads(headers["Target-JSON"]) if "Target-JSON" in headers else headers.get("WARC-Target-URI")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = pafs.FileSystem.from_uri(folder)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names)
            rows.clear()
            return made

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with place.open_input_stream(path, compression=None) as source:
                    for headers, block in read_records(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if headers["WARC-Type"] == "response":
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            size = int(http.rpartition(b"Content-Length: ")[2])
                            digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((number(headers.get("Page-ID")), size, digest, headers["WARC-Type"], number(headers.get("Refers-To-Page")), target(headers)))
                        if len(rows) >= 5000:
                            yield out()
        yield out()

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, size, payload_digest, kind, refers_to, shared: of rows with equal payloads of at least
    `least` bytes, one of the largest page_id is the response and all others are revisits of it, without their html.

    A null page_id counts as the smallest. If several rows of a payload have its largest page_id, the one of the
    smallest url is the response (nulls first); of wholly equal rows one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    rows = rows.withColumn("same", F.when(F.col("size") >= least, F.concat_ws(":", "size", "payload_digest")))
    by_page = rows.where("same is not null").groupBy("same", "page_id").agg(F.count("*").alias("n"))
    groups = by_page.groupBy("same").agg(F.sum("n").alias("copies"), F.max(F.struct("page_id"))["page_id"].alias("response"), F.max_by("n", F.struct("page_id")).alias("tops"))
    groups = saved(groups.where("copies > 1"), "payloads")
    met = join_skewed(rows, groups, "same", "copies", pages.count()).withColumn("top", F.col("page_id").eqNullSafe(F.col("response")))
    out = ["page_id", "url", "html", "size", "payload_digest", "kind", "refers_to", "shared"]
    shared = F.col("copies").isNotNull()
    kind = F.when(shared & ~F.col("top"), "revisit").otherwise("response")
    revisit = F.when(F.col("kind") == "revisit", F.col("response"))
    plain = met.withColumn("kind", kind).withColumn("refers_to", revisit).withColumn("shared", shared).withColumn("html", F.when(F.col("kind") == "response", F.col("html")))
    if not groups.where("tops > 1").limit(1).count():
        return plain.select(out)
    # Rows that tie for the response are counted and written anew: no group of them meets in one task.
    tied = met.where("tops > 1 and top")
    one = tied.groupBy("same").agg(F.min(F.struct("url"))["url"].alias("url"), F.min("html").alias("html"), F.first("page_id").alias("page_id"), F.first("size").alias("size"), F.first("payload_digest").alias("payload_digest"))
    each = tied.groupBy("same", "page_id", "url", "size", "payload_digest").agg(F.count("*").alias("n"))
    first = one.select(F.col("same").alias("_same"), F.col("url").alias("_url"))
    rest = each.join(first, F.col("same") == F.col("_same")).withColumn("n", F.col("n") - F.col("url").eqNullSafe(F.col("_url")).cast("int")).where("n > 0")
    rest = copies(rest, "n", ["payload_digest", "url"], "_copy")
    rest = rest.select("page_id", "url", F.lit(None).cast("string").alias("html"), "size", "payload_digest", F.lit("revisit").alias("kind"), F.col("page_id").alias("refers_to"), F.lit(True).alias("shared"))
    responses = one.withColumn("kind", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")).withColumn("shared", F.lit(True))
    return plain.where("tops is null or tops = 1 or not top").select(out).unionByName(responses.select(out)).unionByName(rest.select(out))


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, date: str | None = None) -> DataFrame:
    """Writes pages(page_id, url, html, ...) to archives in folder (a new one in the shared folder) and reads them back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record. A null html is
    an empty payload. Of equal payloads of at least `least` bytes exactly one row is the response, also among
    repeated rows and null page_ids (see with_revisits). Other columns are ignored; an empty table gives no
    archive and an empty result. `date` is the records' WARC-Date, by default the time of writing.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    # One short row for each archive comes to the driver.
    written = write_archives(with_revisits(pages, least), folder, date).select("path").collect()
    return read_archives(spark, folder, [r["path"] for r in written])
