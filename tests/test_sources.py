"""Binary sources: ranges of variable-length records, filters that are read by the source, bounded tails."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from pulseloom.sources import binary, logs
from pulseloom.streaming import streams


def v2_file(path, seed, records, cut=0):
    rng, out, want = random.Random(seed), bytearray(), []
    for k in range(records):
        n = rng.choice([0, 1, 2, 7, 255, 13])
        points = [(rng.randrange(-32768, 32768), float(rng.randrange(1000))) for _ in range(n)]
        trigger = rng.randrange(-(2**62), 2**62)
        out += struct.pack(binary.V2_HEADER, trigger, k % 2, n, k / 4) + b"".join(struct.pack(binary.V2_POINT, *p) for p in points)
        want.append((k, trigger, k % 2, k / 4, points))
    path.write_bytes(bytes(out[: len(out) - cut]))
    return want


@pytest.mark.parametrize("size", [64, 1000, 1544, 4096, 1 << 20])
def test_variable_records_are_read_range_by_range(spark, tmp_path, size):
    want = {"edges_v2_ch0.bin": v2_file(tmp_path / "edges_v2_ch0.bin", 1, 60), "edges_v2_ch1.bin": v2_file(tmp_path / "edges_v2_ch1.bin", 2, 40, cut=3)[:-1], "edges_v2_ch2.bin": v2_file(tmp_path / "edges_v2_ch2.bin", 3, 1, cut=5)[:-1]}
    (tmp_path / "edges_v2_ch3.bin").write_bytes(b"")
    got = binary.read_edges_v2(spark, str(tmp_path), size)
    for name, rows in want.items():
        mine = sorted((r.rec, r.trigger_idx, r.edge_type, r.peak, [(p.off, p.v) for p in r.points]) for r in got.where(F.col("path").endswith(name)).collect())
        assert mine == rows
    assert got.count() == sum(map(len, want.values()))


def test_no_variable_records(spark, tmp_path):
    assert binary.read_edges_v2(spark, str(tmp_path)).count() == 0


def test_ranges_are_tasks_of_their_own(spark, tmp_path):
    v2_file(tmp_path / "edges_v2_ch0.bin", 4, 500)
    ranges = -(-(tmp_path / "edges_v2_ch0.bin").stat().st_size // 4096)
    got = binary.read_edges_v2(spark, str(tmp_path), 4096)
    assert ranges > 20 and got.rdd.getNumPartitions() == ranges
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 500 / 4


def edge_files(path, channels, records):
    for c in range(channels):
        (path / f"edges_ch{c}.bin").write_bytes(b"".join(struct.pack("<dB7x", 10.0 * k + c, k % 2) for k in range(records)))


def test_filters_reach_the_source(spark, tmp_path):
    edge_files(tmp_path, 4, 300)
    df = binary.read_edges(spark, str(tmp_path))
    for condition, n in (("rec >= 10 and rec < 20 and channel = 2", 10), ("rec > 290", 36), ("rec <= 3 and channel in (0, 3)", 8), ("rec = 5", 4), ("channel = 9", 0), ("rec > 5 and rec < 3", 0), ("channel is null", 0), ("edge_type = 1 and rec < 10", 20), ("channel in (1, null)", 300)):
        got = df.where(condition)
        assert got.count() == n, condition
    reader = binary.RecordReader({"path": str(tmp_path), "kind": "edges"})
    left = list(reader.pushFilters([binary.GreaterThanOrEqual(("rec",), 10), binary.LessThan(("rec",), 20), binary.EqualTo(("channel",), 2), binary.EqualTo(("edge_type",), 1)]))
    assert left == [binary.EqualTo(("edge_type",), 1)]
    assert [(p.start, p.stop, p.path.rsplit("/", 1)[1]) for p in reader.partitions()] == [(10, 20, "edges_ch2.bin")]
    plan = df.where("rec >= 10 and rec < 20")._jdf.queryExecution().executedPlan().toString()
    assert ") Filter" not in plan


def test_tail_is_bounded_and_goes_on(spark, tmp_path):
    data, folder = tmp_path / "in", str(tmp_path / "run")
    data.mkdir()
    edge_files(data, 2, 50)
    got = streams.run_tail(binary.tail_edges(spark, str(data), 10, f"{folder}/progress"), folder)
    assert got.count() == 100 and got.select("channel", "rec").distinct().count() == 100
    assert sum(1 for p in (tmp_path / "run/state/commits").iterdir() if p.name.isdigit()) >= 10
    # More records, and half of one, arrive; a run with a time limit reads on from there.
    edge_files(data, 2, 60)
    with open(data / "edges_ch0.bin", "ab") as f:
        f.write(b"half")
    got = streams.run_tail(binary.tail_edges(spark, str(data), 10, f"{folder}/progress"), folder, timeout=15)
    assert got.count() == 120 and got.select("channel", "rec").distinct().count() == 120


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    rng, want = random.Random(3), {}
    for name in ("a.log", "b.log"):
        lines = ["" if rng.random() < 0.2 else f"{name} {k} " + "x" * rng.randrange(200) for k in range(400)]
        (tmp_path / name).write_text(("\r\n" if name == "b.log" else "\n").join(lines) + "\n")
        want |= {(name, k): line for k, line in enumerate(lines) if line}
    (tmp_path / "empty.log").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        df = logs.read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want
