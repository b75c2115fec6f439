from __future__ import annotations

import decimal

import duckdb
import pytest

from pulseloom.plans import registry, stream_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with their columns in the order of names; whole numbers stay exact, so longs beyond 2 ** 53 count to the last digit."""

    def one(x):
        if isinstance(x, (bool, int, str)) or x is None:
            return x
        if isinstance(x, (float, decimal.Decimal)):
            return None if x != x else int(x) if x == int(x) and abs(x) < 2**53 else float(x)
        if isinstance(x, (list, tuple)):
            return [one(y) for y in x]
        return str(x)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(one(r[k]) for k in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, small, tables, name):
    got = registry.QUERIES[name](spark, small)
    want = tables.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.columns, got.collect()) == plain(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_whole_numbers_are_compared_exactly():
    big = 1704067589165274880
    assert plain(["a"], [(big,)]) != plain(["a"], [(big + 120,)])
    assert plain(["a"], [(3,)]) == plain(["a"], [(3.0,)])


def test_tailed_file_equals_the_read_one(spark, small):
    tail = registry.QUERIES["src_edges_tail"](spark, small).select("channel", "t", "edge_type").collect()
    assert sorted(tail) == sorted(registry.QUERIES["src_edges_v1"](spark, small).collect())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_detection_carries_over_batches_and_keys(spark, small, monkeypatch):
    from pulseloom.plans import stream_queries
    from pulseloom.streaming import streams

    runs = []
    run = streams.run_to_table
    monkeypatch.setattr(streams, "run_to_table", lambda stream, folder, *a: (runs.append(folder), run(stream, folder, *a))[1])
    got = registry.QUERIES["stream_detect"](spark, small).collect()
    want = registry.QUERIES["detect_equals_stream"](spark, small).collect()
    assert sorted((r.series, round(r.t, 6), r.edge_type) for r in got) == sorted((r.series, round(r.t, 6), r.edge_type) for r in want)
    users = stream_queries.user_signals(spark, small).select("series").distinct().count()
    assert users > 1 and len({r.series for r in got}) > 1
    commits = spark.read.format("binaryFile").load(f"{runs[0]}/state/commits/[0-9]*")
    assert commits.count() > 1


def test_first_window_is_dropped_and_the_last_ones_come_at_the_end(spark, small):
    hour = 3600 * registry.SECOND
    first = registry.events(spark, small).selectExpr("min(us)").first()[0] // hour
    stream = {tuple(r) for r in registry.QUERIES["stream_minute"](spark, small).collect()}
    whole = {tuple(r) for r in registry.QUERIES["stream_finalize"](spark, small).collect()}
    assert all(r[0] // hour > first for r in stream | whole)
    assert len(stream) > 1 and stream <= whole


def test_rows_of_an_ordered_stream_are_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(500).selectExpr("id % 7 as k", "id as t").mapInArrow(count, "k long, t long")
    stream = stream_queries._ordered_stream(spark, df, "counted", "k", "t", 50)
    assert stream.isStreaming and made.value == 500


def test_parts_of_a_long_signal_hold_few_samples(spark, small, monkeypatch):
    def parts() -> int:
        folders = []
        new_folder = stream_queries.shared.new_folder
        with monkeypatch.context() as m:
            m.setattr(stream_queries.shared, "new_folder", lambda *a: folders.append(new_folder(*a)) or folders[-1])
            m.setattr(stream_queries.streams, "run_to_table", lambda stream, folder: stream_queries.streams.finish_detect(spark, folder, "series", "peaks", 1.0))
            m.setattr(stream_queries.streams, "finish_detect", lambda *a, **k: spark.createDataFrame([], "series string, t double, edge_type int, height double, idx long"))
            stream_queries._signal_stream(spark, small, "peaks")
        return len(spark.read.parquet(next(f for f in folders if "samples-parts" in f)).select("_part").distinct().collect())

    few = parts()
    monkeypatch.setattr(stream_queries, "SAMPLES", 20)
    most = spark.read.parquet(f"{small}/events.parquet").count() / 20
    assert few <= stream_queries.PARTS + 1 and parts() >= most

