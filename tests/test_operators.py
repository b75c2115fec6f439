from __future__ import annotations

import random
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseloom.operators import bands, clock, detect, flux, match, scale, sinks, spectrum, stats
from pulseloom.plans import registry


def series(spark, times, name="t"):
    return spark.createDataFrame([(int(t), k) for k, t in enumerate(times)], f"{name} long, id_{name} long")


def naive_nearest(a, b, tol, strict=True):
    start, pairs = 0, []
    for x in a:
        best = min(range(start, len(b)), key=lambda k: (abs(b[k] - x), k), default=None)
        if best is not None and (abs(b[best] - x) < tol if strict else abs(b[best] - x) <= tol):
            pairs.append((x, b[best]))
            start = best + 1
    return pairs


def naive_two_pointer(a, b, tol):
    i = j = 0
    pairs = []
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tol:
            pairs.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return pairs


@pytest.mark.parametrize("how,naive", [("nearest", naive_nearest), ("two_pointer", naive_two_pointer)])
def test_dense_matching_equals_a_plain_loop(spark, how, naive):
    rng = random.Random(4)
    a, b = (sorted(rng.sample(range(6000), 400)) for _ in range(2))
    got = match.match(series(spark, a, "t_a"), series(spark, b, "t_b"), "t_a", "t_b", 9, how, width=500).collect()
    pairs = sorted((r.t_a, r.t_b) for r in got if r.status == "matched")
    assert pairs == sorted(naive(a, b, 9))
    assert sorted(r.t_a for r in got if r.status == "unmatched_a") == sorted(set(a) - {x for x, _ in pairs})
    assert sorted(r.t_b for r in got if r.status == "unmatched_b") == sorted(set(b) - {y for _, y in pairs})


def test_a_taken_b_passes_those_before_it(spark):
    got = match.match(series(spark, [10, 11], "t_a"), series(spark, [7, 10], "t_b"), "t_a", "t_b", 5, "nearest", width=100).collect()
    assert sorted((r.t_a or -1, r.t_b or -1, r.status) for r in got) == [(-1, 7, "unmatched_b"), (10, 10, "matched"), (11, -1, "unmatched_a")]


@pytest.mark.parametrize("how", ["nearest", "two_pointer", "greedy_reject"])
@pytest.mark.parametrize("width", [1, 40, 1000, 10**6])
def test_gapless_matching_equals_a_plain_loop(spark, how, width):
    rng = random.Random(width)
    # Keys: dense on both sides, many more a, many more b, in step, repeated times, gaps, one side only, a null key.
    sides = {
        "dense": [sorted(rng.sample(range(900), 500)) for _ in range(2)],
        "a": [sorted(rng.sample(range(900), 600)), sorted(rng.sample(range(900), 60))],
        "b": [sorted(rng.sample(range(900), 60)), sorted(rng.sample(range(900), 600))],
        "step": [list(range(0, 900, 7)), list(range(3, 900, 7))],
        "same": [sorted(rng.choices(range(0, 300, 10), k=200)) for _ in range(2)],
        "gaps": [sorted(rng.sample(range(-9000, 9000), 90)) for _ in range(2)],
        "alone": [[1, 2, 3], []],
        None: [sorted(rng.sample(range(400), 150)) for _ in range(2)],
    }
    a = spark.createDataFrame([(k, t) for k, (x, _) in sides.items() for t in x] + [("a", None)], "key string, t_a long").repartition(3)
    b = spark.createDataFrame([(k, t) for k, (_, y) in sides.items() for t in y], "key string, t_b long").repartition(3)
    got = match.match(a, b, "t_a", "t_b", 9, how, on=["key"], width=width).collect()
    for key, (x, y) in sides.items():
        pairs = naive_two_pointer(x, y, 9) if how == "two_pointer" else naive_nearest(x, y, 9, how == "nearest")
        mine = [r for r in got if r.key == key]
        assert sorted((r.t_a, r.t_b) for r in mine if r.status == "matched") == sorted(pairs), key
        if how != "greedy_reject":
            assert sorted([r.t_a for r in mine if r.status == "unmatched_a"] + [p for p, _ in pairs]) == sorted(x), key
        assert sorted([r.t_b for r in mine if r.status == "unmatched_b"] + [p for _, p in pairs]) == sorted(y), key
        assert all(r.delay == r.t_b - r.t_a for r in mine if r.status == "matched")


@pytest.mark.parametrize("how", ["nearest", "two_pointer"])
def test_gapless_keys_are_matched_bucket_by_bucket(spark, how):
    # No gap is beyond tol, so all rows hang together; no list holds more than a bucket and what lies near it.
    a = spark.range(20_000).selectExpr("id * 5 as t_a")
    b = spark.range(20_000).selectExpr("id * 5 + 2 as t_b")
    rows = a.selectExpr("t_a as t", "0 as side").unionByName(b.selectExpr("t_b as t", "1 as side"))
    most = match.in_buckets(rows, [], 9, how, 1000).groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 200 + 12
    assert match.match(a, b, "t_a", "t_b", 9, how, width=1000).groupBy("status").count().collect() == [("matched", 20_000)]


def test_rejects_carry_the_nearest_delay(spark):
    got = match.match(series(spark, [100, 500, 900], "t_a"), series(spark, [105, 700], "t_b"), "t_a", "t_b", 10, "greedy_reject", width=1000).collect()
    assert sorted((r.t_a or -1, r.t_b, r.status) for r in got) == [(-1, 700, "unmatched_b"), (100, 105, "matched"), (500, 700, "rejected"), (900, 700, "rejected")]


def test_dense_rejects_equal_a_plain_loop(spark):
    rng = random.Random(8)
    a, b = (sorted(rng.sample(range(9000), 300)) for _ in range(2))
    start, want = 0, []
    for x in a:
        if start < len(b):
            k = min(range(start, len(b)), key=lambda k: (abs(b[k] - x), k))
            want.append((x, b[k], "rejected" if abs(b[k] - x) > 9 else "matched"))
            start = start if abs(b[k] - x) > 9 else k + 1
    got = match.match(series(spark, a, "t_a"), series(spark, b, "t_b"), "t_a", "t_b", 9, "greedy_reject", width=500).where("status in ('matched', 'rejected')").collect()
    assert sorted((r.t_a, r.t_b, r.status) for r in got) == sorted(want)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("width", [1, 9, 10**6])
def test_as_of_equals_a_plain_loop(spark, direction, width):
    rng = random.Random(5)
    left = [(rng.choice(["a", "b", "c", None]), rng.randrange(600), k) for k in range(300)] + [("a", None, 900)]
    right = [(key, t, 1000 * t) for key, t in {(rng.choice(["a", "b", None]), rng.randrange(100, 500)) for _ in range(90)}] + [("a", None, 7)]
    got = match.as_of(spark.createDataFrame(left, "key string, t long, id long").repartition(5), spark.createDataFrame(right, "key string, u long, v long"), "t", "u", ["key"], direction, width)
    want = []
    for key, t, k in left:
        near = [(u, v) for x, u, v in right if x == key and u is not None and t is not None and (u <= t if direction == "backward" else u >= t)]
        want.append((key, t, k, *((max if direction == "backward" else min)(near) if near else (None, None))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    windows = [line.split("windowspecdefinition(")[1] for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_other" in line and "windowspecdefinition(" in line]
    assert windows and all("_k#" in w.split(" ASC")[0].split(" DESC")[0] for w in windows)


@pytest.mark.parametrize("width", [1, 7, 100, 10**6])
def test_prefix_equals_one_window(spark, width):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(500), k, rng.randrange(-5, 9)) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, t long, id long, v long").repartition(5)
    got = scale.prefix(df, ["key"], ["t", "id"], width, sums={"s": "v"}, lags={"l": "v"}, rn="r")
    w = Window.partitionBy("key").orderBy("t", "id")
    want = df.select("*", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("v").over(w).alias("l"), F.row_number().over(w).cast("long").alias("r"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_debounce_equals_a_plain_loop(spark):
    rng = random.Random(2)
    times = sorted(rng.sample(range(9000), 900))
    kept = [times[0]]
    for t in times[1:]:
        if t - kept[-1] >= 25:
            kept.append(t)
    got = detect.debounce(series(spark, times), [], ["t", "id_t"], "t", 25, 300)
    assert sorted(r.t for r in got.collect()) == kept


@pytest.mark.parametrize("width", [1, 40, 300, 10**6])
def test_debounce_of_dense_keys_holds_no_key_at_once(spark, width):
    rng = random.Random(3)
    # Keys: all times alike dense, times in step (ways into a bucket never meet), repeated times, gaps, one row, null key.
    rows = [("a", rng.randrange(3000)) for _ in range(2500)] + [("b", 3 * k) for k in range(900)] + [("c", 7 * (k // 4)) for k in range(800)]
    rows += [("d", rng.randrange(10**5)) for _ in range(300)] + [("e", 5)] + [(None, rng.randrange(400)) for _ in range(300)]
    rows = [(key, t / 8, k) for k, (key, t) in enumerate(rows)]
    want = []
    for key in ("a", "b", "c", "d", "e", None):
        last = None
        for t, k in sorted((t, k) for x, t, k in rows if x == key):
            if last is None or t - last >= 5.125:
                want.append((key, t, k))
                last = t
    got = detect.debounce(spark.createDataFrame(rows, "key string, t double, id long").repartition(5), ["key"], ["t", "id"], "t", 5.125, width)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_band_join_is_a_hash_join_without_duplicates(spark):
    a, b = series(spark, range(0, 1000, 10), "t_a"), series(spark, range(3, 1000, 10), "t_b")
    got = scale.band_join(a, b, "t_a", "t_b", 5)
    assert got.count() == got.distinct().count() == 100
    plan = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_locked_and_jittered_edges(spark):
    pairs = spark.range(120_000).select((F.col("id") * 5000).alias("t"), F.lit(7).alias("delay"))
    r = stats.jitter_stats(pairs, "delay", [], 2000).first()
    assert (r.n, r["mean"], r["std"], r.p999) == (120_000, 7, 0, 0)
    noisy = pairs.withColumn("delay", (F.pmod(F.xxhash64("t"), F.lit(2001)) - 1000).cast("double"))
    r = stats.jitter_stats(noisy, "delay").first()
    assert abs(r["mean"]) < 8 and abs(r["std"] - 577.6) < 5


def test_drift_is_found(spark):
    a = spark.range(1, 5000).select(F.col("id").alias("p"), F.lit(5000.0).alias("period"))
    b = a.withColumn("period", F.col("period") * (1 - 0.3e-6))
    assert abs(stats.frequency_skew(a, b, "period", "p").first().ppm - 0.3) < 1e-6


def test_tone_is_one_peak(spark):
    tone = spark.range(4000).select(F.lit("x").alias("k"), F.col("id").alias("i"), (50 * F.sin(2 * F.pi() * 10 * F.col("id") / 1000)).alias("d"))
    r = spectrum.phase_noise(tone, "d", ["i"], 1000.0, ["k"], [10.0, 50.0, 200.0], 1000).first()
    assert r.f_10 > r.f_50 + 60 and abs(r.rms_jitter_ns - 50 / 2**0.5) < 0.5
    band = spectrum.band_rms(tone, "d", ["i"], 1000.0, 9.0, 11.0, ["k"], 1000).first()
    assert abs(band.band_rms - r.rms_rad) / r.rms_rad < 0.01
    assert spectrum.band_rms(tone, "d", ["i"], 1000.0, 600.0, 700.0, ["k"], 1000).first().band_rms is None


def test_counters_unwrap_to_their_own_steps(spark):
    wrap, short, step = 2**32 * 1_000_000, 2**48, 10**14
    df = spark.range(1, 5000).select(F.lit(1).alias("dev"), F.col("id"), ((F.col("id") * step) % wrap).alias("v"))
    got = clock.unwrap(df, ["dev"], ["id"], "v", wrap, width=100)
    assert got.where(F.col("unwrapped") != F.col("id") * step).count() == 0
    both = df.withColumn("v", ((F.col("id") * (short // 50)) % wrap) % short)
    got = clock.unwrap(both, ["dev"], ["id"], "v", short, wrap % short, width=100)
    steps = got.select((F.col("unwrapped") - F.lag("unwrapped").over(Window.orderBy("id"))).alias("d"))
    assert steps.where("d <= 0").count() == 0


def test_clock_model_keeps_nanoseconds(spark):
    x = 10**15 + F.col("id") * 10**10
    df = spark.range(200).select(F.lit(1).alias("dev"), F.col("id").alias("o"), F.expr("id div 50").alias("s"), x.alias("x"), (x + F.col("id") * 83_240 + F.pmod(F.xxhash64("id"), F.lit(7)) - 3).cast("long").alias("y"))
    rows = {r.s: r for r in clock.clock_model(df, ["dev"], ["o"], "s", "x", "y").collect()}
    assert abs(rows[3].slope_m1 - 8.324e-6) < 1e-9 and 1 < rows[3]["std"] < 3 and rows[3].valid and rows[3].n == 128


def test_clock_model_in_blocks_equals_one_window(spark):
    x = F.col("o") * 1000
    df = spark.range(900).select((F.col("id") % 2).alias("dev"), F.col("id").alias("o")).select("dev", "o", F.expr("o div 20").alias("s"), x.alias("x"), (x + F.col("o") * 3 + F.pmod(F.xxhash64("o"), F.lit(7))).alias("y"))
    one, cut = (sorted(clock.clock_model(df, ["dev"], ["o"], "s", "x", "y", 40, 8, width=100, block=b).collect()) for b in (10**6, 40))
    assert len(one) == 90 and one == cut
    plan = clock.clock_model(df, ["dev"], ["o"], "s", "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_in#" in line for line in plan.splitlines() if "regr_slope" in line and "windowspecdefinition" in line)


def test_peaks_crossings_and_settling(spark):
    def spike(i):
        k = (i - 20) % 100
        return 10 - abs(k - 5) * 2 if k <= 10 else 0

    df = spark.createDataFrame([("x", i, float(spike(i))) for i in range(1000)], "s string, idx long, v double")
    assert sorted(r.t for r in detect.detect_peaks(df, ["s"], "idx", "v", 5, 20, 64).collect()) == [25.0 + 100 * k for k in range(10)]
    assert sorted(r.t for r in detect.detect_crossings(df, ["s"], "idx", "v", 5, 20, 64).collect()) == [22.5 + 100 * k for k in range(10)]
    assert sorted(r.t for r in detect.detect_linreg(df, ["s"], "idx", "v", 5, min_distance=20, width=64).collect()) == [22.5 + 100 * k for k in range(10)]
    assert detect.skip_settle(df, ["s"], "idx", "v", 24, 1).agg(F.min("idx")).first()[0] == 30


def test_filters_with_empty_values_mean_all(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "tag string, n int")
    assert flux.f_tags(df, eq={"tag": ""}).count() == flux.f_tags(df, eq={"tag": []}).count() == flux.f_tags(df).count() == 2
    assert flux.f_tags(df, eq={"tag": ["a", ""]}).count() == flux.f_tags(df, exists=["n"]).count() == 1


def test_sinks_refuse(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, 7)], "o long, t long")
    sinks.write_edges(df, str(tmp_path / "e"), [], ["o"], "t")
    with pytest.raises(Exception, match="exist"):
        sinks.write_edges(df, str(tmp_path / "e"), [], ["o"], "t")
    with pytest.raises(ValueError, match="backwards"):
        sinks.write_edges(df.withColumn("t", -F.col("t")), str(tmp_path / "f"), [], ["o"], "t")


@pytest.mark.parametrize("width", [1, 9, 10**6])
def test_prefix_looks_ahead_and_keeps_maxima(spark, width):
    rows = [(k, random.Random(k).randrange(50), None if k % 3 == 0 else "g", k % 7 if k % 5 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, t long, by string, v long")
    over = Window.partitionBy("by").orderBy("t", "id")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.lead("v").over(over).alias("after"), F.lag("v").over(over).alias("before"), F.max("v").over(upto).alias("top"), F.row_number().over(over).alias("rn"))
    got = scale.prefix(df, ["by"], ["t", "id"], width, lags={"before": "v"}, leads={"after": "v"}, tops={"top": "v"}, rn="rn").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("width", [1, 13, 10**6])
def test_islands_equal_one_window(spark, width):
    times = sorted(random.Random(4).sample(range(3000), 300)) * 2
    df = spark.createDataFrame([(t, k, k % 2) for k, t in enumerate(times)], "t long, id long, side int")
    got = {r.id: r.island for r in scale.islands(df, ["side"], ["t", "id"], 15, width).collect()}
    for side in (0, 1):
        island, before = 0, None
        for t, k in sorted((t, k) for k, t in enumerate(times) if k % 2 == side):
            island += before is None or t - before >= 15
            assert got[k] == island
            before = t


def test_ordered_scans_read_their_input_once(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") * 7 % 300).alias("t")).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    for out in (scale.prefix(df, [], ["t", "id"], 50, sums={"s": "id"}, lags={"l": "id"}), scale.islands(df, [], ["t", "id"], 1, 50)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
        assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("cells", [1, 5, 4096])
def test_quantiles_equal_a_sorted_list(spark, cells):
    r = random.Random(5)
    rows = [(g, float(r.choice([r.gauss(0, 1), 0.25, 7.0]))) for g in ("a", None, "b") for _ in range(r.randrange(1, 90))] + [("c", None), ("d", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for discrete in (False, True):
        asked = {k: q for k, q in shares.items() if q < 1 or not discrete}
        for got in stats.exact_quantiles(df, "v", ["g"], asked, discrete, cells).collect():
            values = sorted(v for g, v in rows if g == got.g and v is not None)
            for name, q in asked.items():
                place = len(values) * q if discrete else (len(values) - 1) * q
                low = int(place)
                want = values[low] if discrete else values[low] + (place - low) * (values[min(low + 1, len(values) - 1)] - values[low])
                assert abs(got[name] - want) < 1e-12
    assert stats.exact_quantiles(df, "v", ["g"], shares).count() == 4
    assert stats.exact_quantiles(df, "v", [], {"p50": 0.5}).count() == 1


def test_an_outlier_puts_no_more_rows_in_a_task(spark, monkeypatch):
    # 200,000 values beside one of 1e9: what is sorted together is a small part, and the ranks are exact.
    df = spark.range(200_000).select(((F.col("id") * 7919 % 200_000) / 8).alias("v")).unionByName(spark.createDataFrame([(1e9,)], "v double"))
    monkeypatch.setattr(stats, "SORTED", 1000)
    tables = []
    save = stats.saved
    monkeypatch.setattr(stats, "saved", lambda d, name: (tables.append(save(d, name)), tables[-1])[1])
    got = stats.exact_quantiles(df, "v", [], {"p50": 0.5, "p999": 0.999, "p100": 1.0}, most=1000).first()
    assert got.p50 == 100_000 / 8 and abs(got.p999 - 199_800 / 8) < 1e-9 and got.p100 == 1e9
    # Rows within the bounds of each rank, which are sorted together.
    last = tables[-1].first()
    assert len(tables) > 1 and max(last[f"_in{k}"] for k in range(3)) <= 200_000 / 64


@pytest.mark.parametrize("n", [150, 151, 211])
def test_long_series_have_the_spectrum_of_the_whole(spark, n):
    r = random.Random(n)
    rows = [(g, k, r.gauss(0, 20)) for g in (1, 2) for k in range(n - g)]
    df = spark.createDataFrame(rows, "g int, k long, v double")
    whole = {x.g: (x.n, x.band_rms) for x in spectrum.band_rms(df, "v", ["k"], 100.0, 5.0, 20.0, ["g"]).collect()}
    long = {x.g: (x.n, x.band_rms) for x in spectrum.band_rms(df, "v", ["k"], 100.0, 5.0, 20.0, ["g"], whole=10).collect()}
    assert whole.keys() == long.keys() == {1, 2}
    for g in whole:
        assert whole[g][0] == long[g][0] == n - g and abs(whole[g][1] / long[g][1] - 1) < 1e-9
    none = spectrum.band_rms(df, "v", ["k"], 100.0, 49.999, 49.9991, ["g"]).collect()
    assert all(x.band_rms is None for x in none)


def test_streamed_matching_of_dense_edges_equals_a_plain_loop(spark, tmp_path):
    from pulseloom.streaming import streams

    r = random.Random(11)
    edges = sorted((r.randrange(4000), s, c) for c in (1, 2) for s in "ab" for _ in range(250))
    folder = str(tmp_path / "in")
    for part in range(0, 4000, 800):
        some = [(c, s, t) for t, s, c in edges if part <= t < part + 800]
        spark.createDataFrame(r.sample(some, len(some)), "capture int, side string, us long").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("capture int, side string, us long").option("maxFilesPerTrigger", 1).parquet(folder)
    done = streams.run_to_table(streams.stream_match(stream, "capture", 6, 20), str(tmp_path / "out"))
    # What was held comes from the state alone: the source is gone.
    shutil.move(folder, str(tmp_path / "gone"))
    every = done.unionByName(streams.finish_matches(spark, str(tmp_path / "out"), "capture", 6)).collect()
    for c in (1, 2):
        a, b = ([t for t, s, k in edges if k == c and s == side] for side in "ab")
        pairs = naive_two_pointer(a, b, 6)
        assert sorted((x.us_a, x.us_b) for x in every if x.capture == c and x.status == "matched") == sorted(pairs)
        assert sorted(x.us_a for x in every if x.capture == c and x.us_a is not None) == a and sorted(x.us_b for x in every if x.capture == c and x.us_b is not None) == b
    assert 0 < done.count() < len(every)


@pytest.mark.parametrize("method", ["peaks", "hysteresis", "linreg"])
@pytest.mark.parametrize("seed", range(3))
def test_detection_with_look_ahead_equals_any_cut(method, seed):
    import numpy as np

    from pulseloom.streaming import streams

    rng = np.random.default_rng(seed)
    v = np.sin(np.arange(600) / 9) * 20 + rng.normal(0, 2, 600)
    idx = np.arange(5, 605)

    def edges(cuts):
        out, held = [], None
        for a, b in zip([0, *cuts], [*cuts, len(v)], strict=True):
            found, held = streams._detected(method, held, idx[a:b], v[a:b], 8.0, 30.0, 3.0)
            out += found
            assert len(held[0]) <= 26
        return out + streams._detected(method, held, idx[:0], v[:0], 8.0, 30.0, 3.0, ending=True)[0]

    whole = edges([])
    assert len(whole) > 5
    for _ in range(20):
        assert edges(sorted(rng.integers(0, 600, rng.integers(0, 300)).tolist())) == whole


@pytest.mark.parametrize("method", ["peaks", "hysteresis", "linreg"])
def test_streamed_edges_equal_the_batch_forms(spark, tmp_path, method):
    import numpy as np

    from pulseloom.streaming import streams

    rng = np.random.default_rng(7)
    rows = [(s, k, float(x)) for s in ("p", "q") for k, x in enumerate(np.sin(np.arange(300) / 7) * 20 + rng.normal(0, 1, 300))]
    folder = str(tmp_path / "in")
    for part in range(0, 300, 75):
        spark.createDataFrame([r for r in rows if part <= r[1] < part + 75], "series string, idx long, v double").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("series string, idx long, v double").option("maxFilesPerTrigger", 1).parquet(folder)
    levels = {"reset": 3.0} if method == "hysteresis" else {"min_distance": 20.0}
    got = streams.run_to_table(streams.stream_detect_ahead(stream, "series", method, 8.0, **levels), str(tmp_path / "out"))
    got = got.unionByName(streams.finish_detect(spark, str(tmp_path / "out"), "series", method, 8.0, **levels)).collect()
    df = spark.createDataFrame(rows, "series string, idx long, v double")
    if method == "peaks":
        want = detect.detect_peaks(df, ["series"], "idx", "v", 8.0, 20.0)
    elif method == "linreg":
        want = detect.detect_linreg(df, ["series"], "idx", "v", 8.0, min_distance=20.0)
    else:
        want = detect.detect_hysteresis(df, ["series"], "idx", "v", -8.0, 8.0, 3.0).withColumn("t", F.col("idx"))
    assert len(got) > 10 and sorted((r.series, round(r.t, 6), r.edge_type) for r in got) == sorted((r.series, round(r.t, 6), r.edge_type) for r in want.collect())


@pytest.mark.parametrize("width", [1, 37, 5000, 10**9])
def test_command_logs_equal_a_plain_loop(spark, width):
    rng = random.Random(13)
    rows = [(key, k, rng.choices(["start", "stop", "event"], [1, 1, 6])[0], rng.choice(["x", "y", "bad\\name", None]), rng.choice([None, "d"])) for key in ("a", None, "b") for k in rng.sample(range(5000), 1000)]
    rows += [("late", 5, "event", "x", None), ("late", 4000, "start", "x", None), ("late", 4999, "event", "y", "d")]
    want = []
    for key in ("a", None, "b", "late"):
        active = None
        for _, k, kind, name, text in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if name and "\\" in name:
                continue
            if kind == "start" and active is not None:
                want.append((key, k, 0, active, "stop", "auto"))
            want.append((key, k, 1, name if kind == "start" else active or "unnamed", kind, text or ""))
            active = name if kind == "start" else None if kind == "stop" else active
    log = sinks.experiment_log(spark.createDataFrame(rows, "device string, ord long, type string, experiment string, description string").repartition(4), ["device"], width)
    assert sorted(map(tuple, log.collect()), key=str) == sorted(want, key=str)
    windows = [line.split("windowspecdefinition(")[1] for line in log._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_set" in line and "windowspecdefinition(" in line]
    assert windows and all("_k#" in w.split(" ASC")[0] for w in windows)


def test_arrivals_are_stamped_once(spark, tmp_path):
    from pulseloom.streaming import streams

    source, times = str(tmp_path / "in"), iter([500, 400, 900, 950, 990, 999])

    def arrive(first, n):
        rows = [(k, "fts/d1/x", '{"ts": 1.5}' if k % 2 else "{}") for k in range(first, first + n)]
        spark.createDataFrame(rows, "id long, topic string, payload string").coalesce(1).write.mode("append").parquet(source)

    def run(folder):
        stream = spark.readStream.schema("id long, topic string, payload string").option("maxFilesPerTrigger", 1).parquet(source)
        return sorted(map(tuple, streams.run_stamped(stream, str(tmp_path / folder), lambda: next(times)).select("id", "topic", "t_ns", "arrival").collect()))

    arrive(0, 4)
    arrive(4, 2)
    first = run("a")
    # The clock went back, the stamps don't.
    assert [r[3] for r in first] == [500] * 4 + [501] * 2
    assert [r[2] for r in first] == [500, 1_500_000_000, 500, 1_500_000_000, 501, 1_500_000_000] and {r[1] for r in first} == {"fts_ts/d1/x"}
    # Stopped between the stamp of the last batch and its commit: run again, it keeps its stamp; new ones follow.
    for name in ("1", ".1.crc"):
        (tmp_path / "a/state/commits" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "a/out/batch=1")
    arrive(6, 3)
    again = run("a")
    assert again[:6] == first and [r[3] for r in again[6:]] == [900] * 3


def test_regression_has_a_name_in_sql(spark):
    from pulseloom.functions import units

    units.register(spark)
    r = random.Random(9)
    rows = [(k, float(r.randrange(1, 9)), [(o, float(r.randrange(-5, 6))) for o in range(r.randrange(0, 6))]) for k in range(60)] + [(7, 4.0, [(0, 2.0), (1, 2.0)]), (8, 4.0, [(3, 1.0), (3, 2.0)])]
    df = spark.createDataFrame(rows, "trigger long, peak double, points array<struct<off:int,v:double>>")
    for x in detect.regress_points(df, "trigger", "peak", "points").withColumn("named", F.expr("regress_time(trigger, peak, points)")).collect():
        assert abs(x.t - x.named) < 1e-9


def test_clock_models_of_a_null_key(spark):
    rows = [(key, k, k // 50, 1000 * k, 1000 * k + k) for key in ("a", None) for k in range(100)]
    df = spark.createDataFrame(rows, "device string, ord long, session long, x long, y long")
    out = clock.clock_model(df, ["device"], ["ord"], "session", "x", "y").collect()
    assert {(r.device, r.session, r.n) for r in out} == {(d, s, 50 * (s + 1)) for d in ("a", None) for s in (0, 1)}


def test_reservoirs_merge(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), k, float(rng.randrange(1000))) for k in range(900)] + [("a", 1000, None)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    whole = stats.reservoir(df, "v", ["g"], ["id"], 50)
    parts = [stats.reservoir(df.where(F.col("id") % 3 == k), "v", ["g"], ["id"], 50) for k in range(3)]
    merged = stats.reservoir(parts[0].unionByName(parts[1]).unionByName(parts[2]), "v", ["g"], ["id"], 50)
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert whole.count() == 150
    for r in stats.reservoir_stats(df, "v", ["g"], ["id"], 50).collect():
        held, every = sorted(x.v for x in whole.collect() if x.g == r.g), [v for g, _, v in rows if g == r.g and v is not None]
        assert (r.n, r.held, r.min, r.max) == (len(every), 50, min(every), max(every)) and abs(r.mean - sum(every) / len(every)) < 1e-9
        assert [r.p50, r.p95, r.p99, r.p999] == [held[int(50 * q)] for q in (0.5, 0.95, 0.99, 0.999)]
        assert abs(r.max_dev - max(abs(v - r.mean) for v in held)) < 1e-9
    assert "WindowGroupLimit" in whole._jdf.queryExecution().executedPlan().toString()


def test_spans_of_any_length_take_few_cells(spark):
    rng = random.Random(6)
    year = 365 * 86_400_000_000
    spans = [("ten years", -3 * year, 7 * year), ("instant", 5, 6), ("empty", 9, 9), ("back", 9, 3)] + [(f"s{k}", a, a + rng.choice([1, 3, 17, 1000, 10**9, 10**13])) for k in range(60) for a in [rng.randrange(-(10**14), 10**14)]]
    frame = spark.createDataFrame(spans, "experiment string, t_from long, t_to long")
    cells = match.span_cells(frame).groupBy("experiment").count().collect()
    assert max(r["count"] for r in cells) < 64
    times = [5, 6, -3 * year, 7 * year - 1, 7 * year, 0, None] + [a + d for _, a, b in spans for d in (-1, 0, b - a - 1, b - a)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "id long, us long")
    got = sorted((r.id, r.experiment) for r in match.annotate(rows, frame, "us").collect())
    assert got == sorted((k, n) for k, t in enumerate(times) if t is not None for n, a, b in spans if a <= t < b)
    assert match.annotate(rows, frame.limit(0), "us").count() == 0


def test_a_silent_key_is_decided_by_the_clock_of_all(spark, tmp_path):
    from pulseloom.streaming import streams

    ms, folder = 1000, str(tmp_path / "in")
    # Key 1 falls silent after 310 ms; key 2 goes on. Tolerance 6 ms, pairs after 20 ms, alone after 40 ms.
    parts = [[(1, "a", 100), (1, "b", 103), (1, "a", 300), (1, "b", 310), (2, "a", 305)], [(2, "a", 322), (2, "b", 324)], [(2, "a", 336)], [(2, "b", 380)], [(2, "a", 900)], [(2, "b", 905)]]

    def run(edges):
        spark.createDataFrame([(c, s, t * ms) for c, s, t in edges], "capture int, side string, us long").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("capture int, side string, us long").parquet(folder)
        out = streams.run_to_table(streams.stream_match(stream, "capture", 6 * ms, 20 * ms, 40 * ms), str(tmp_path / "out"))
        return sorted(((r.us_a or 0) // ms, (r.us_b or 0) // ms, r.status) for r in out.where("capture = 1").collect())

    seen = [run(p) for p in parts]
    assert seen[0] == [(100, 103, "matched")]
    assert seen[1] == seen[0]
    # The clock has come 40 ms beyond what is alone, without any later edge of the key.
    assert seen[-1] == [(0, 310, "unmatched_b"), (100, 103, "matched"), (300, 0, "unmatched_a")]
    assert streams.held_edges(spark, str(tmp_path / "out"), "capture").where("capture = 1").count() == 0


def test_a_silent_key_gets_its_pair(spark, tmp_path):
    from pulseloom.streaming import streams

    folder = str(tmp_path / "in")
    for edges in ([(1, "a", 100_000), (1, "b", 104_000), (2, "a", 101_000)], [(2, "a", 200_000)], [(2, "a", 300_000)]):
        spark.createDataFrame(edges, "capture int, side string, us long").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("capture int, side string, us long").parquet(folder)
        out = streams.run_to_table(streams.stream_match(stream, "capture", 6_000, 20_000, 40_000), str(tmp_path / "out"))
    assert [tuple(r)[1:] for r in out.where("capture = 1").collect()] == [(100_000, 104_000, 4_000, "matched")]


def test_relative_times_and_deletes(spark):
    df = spark.createDataFrame([(k * 60_000_000, "x" if k % 2 else None) for k in range(20)], "us long, tag string")
    now = 20 * 60_000_000
    assert flux.f_range(df, "us", "-5m", "now()", now).count() == 5
    assert flux.f_range(df, "us", 0, "-15m", now).count() == 5
    with pytest.raises(ValueError, match="relative"):
        flux.f_range(df, "us", "yesterday", now=now)
    assert flux.without_range(df, "us", "-10m", None, now, tag="x").count() == 15
    assert flux.without_range(df, "us").count() == 0


def test_edges_are_appended_in_order_only(spark, tmp_path):
    path = str(tmp_path / "e")
    df = spark.createDataFrame([(1, k, k * 10) for k in range(5)], "key int, id long, t long")
    sinks.write_edges(df, path, ["key"], ["id"], "t")
    with pytest.raises(ValueError, match="before what is there"):
        sinks.write_edges(df.withColumn("id", F.col("id") + 9), path, ["key"], ["id"], "t", append=True)
    with pytest.raises(ValueError, match="backwards"):
        sinks.write_edges(df.withColumn("t", -F.col("t")), path, ["key"], ["id"], "t", append=True)
    sinks.write_edges(df.withColumn("t", F.col("t") + 40), path, ["key"], ["id"], "t", append=True)
    assert spark.read.parquet(path).count() == 10


def test_arrival_stamps_keep_nanoseconds(spark):
    from pulseloom.sources import telemetry

    rows = [("fts/dev1/ftm", '{"ts": 1704067589.165274881}', 5), ("fts/dev1/ftm", '{"ts": 1.704067589165275E9}', 5), ("fts/dev1/ftm", "{}", 5), ("fts/dev1/ftm", '{"ts": "soon"}', 5)]
    got = telemetry.stamp_arrival(spark.createDataFrame(rows, "topic string, payload string, arrival long"), F.col("arrival")).collect()
    assert [r.t_ns for r in got] == [1704067589165274881, 1704067589165275000, 5, 5]


@pytest.mark.parametrize("how", ["nearest", "two_pointer"])
def test_matching_with_a_key_where_tasks_are_empty(spark, how):
    a = spark.createDataFrame([("x", 10), ("y", 50)], "k string, t_a long")
    b = spark.createDataFrame([("x", 12), ("y", 90)], "k string, t_b long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = sorted(tuple(r) for r in match.match(a, b, "t_a", "t_b", 5, how, ["k"], 20).fillna(-1).collect())
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)
    assert got == [("x", 10, 12, 2, "matched"), ("y", -1, 90, -1, "unmatched_b"), ("y", 50, -1, -1, "unmatched_a")]


@pytest.mark.parametrize("how", ["nearest", "two_pointer"])
def test_a_dense_bucket_is_summed_up_in_one_pass(how):
    """Its states never meet: each row of a takes the same number of them one further."""

    class Counted(list):
        seen = 0

        def __iter__(self):
            for x in super().__iter__():
                Counted.seen += 1
                yield x

    n, tol = 2000, 300
    rows = sorted((t, side, -1 if t < 0 else 0) for t in range(-tol, n) for side in (0, 1) if side == 1 or t >= 0 or how == "two_pointer")
    t, side, place = (np.array(c) for c in zip(*rows, strict=True))
    fold = match._fold(how, tol)
    fold.ready(t, side, place, (place == 0) & (t < tol) & (side == 1), np.zeros(len(t), bool))
    name = "steps" if how == "nearest" else "events"
    setattr(fold, name, Counted(getattr(fold, name)))
    assert len(fold.exits()) == fold.count > tol and Counted.seen <= 2 * n


def test_stats_of_spans_equal_those_of_their_rows(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2000), rng.choice([None, rng.uniform(-50, 50), 7.25])) for _ in range(500)] + [(None, 1.0), (40, float("nan")), (700, float("inf")), (900, 1e300), (950, -1e12), (960, 0.125)]
    spans = [(k, *sorted((rng.randrange(2000), rng.randrange(2000)))) for k in range(60)] + [(None, 0, 30), (3, 100, 130), (90, 5, 5), (91, 960, 961), (92, None, 7), (93, 3000, 4000)]
    telemetry, spans = spark.createDataFrame(rows, "us long, value double"), spark.createDataFrame(spans, "experiment long, t_from long, t_to long")
    want = match.annotate(telemetry, spans, "us").groupBy("experiment").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    plan = match.annotated_stats(telemetry, spans, "us", "value", 100)
    got, want = ({r.experiment: (r.n, r.mean) for r in x.collect()} for x in (plan, want))
    assert set(got) == set(want) and {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    for k, (_, mean) in want.items():
        assert (got[k][1] is None) == (mean is None) and (mean is None or got[k][1] == pytest.approx(mean, abs=1e-9, rel=1e-12, nan_ok=True))


def test_spans_that_all_hold_all_rows_make_no_pairs(spark):
    telemetry = spark.range(3000).selectExpr("id + 10 as us", "double(id) as value")
    spans = spark.range(3000).selectExpr("id as experiment", "id div 1000 as t_from", "5000 + id as t_to")
    stats = match.annotated_stats(telemetry, spans, "us", "value", 500)
    assert {(r.n, r.mean) for r in stats.collect()} == {(3000, 1499.5)} and stats.count() == 3000
    # No join compares times: the only one is that of a bucket with its start.
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "t_from#" not in "".join(x for x in plan.splitlines() if "Join " in x)


def test_a_long_spectrum_is_exchanged_in_blocks(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(g, k, rng.random()) for g, n in (("a", 301), (None, 5), ("b", 1024), ("c", 2), ("d", 260)) for k in range(n)], "g string, k long, v double")
    one, cut = (spectrum.band_rms(df, "v", ["k"], 100.0, 5.0, 50.0, ["g"], whole=w) for w in (10_000, 4))
    got, want = ({r.g: (r.n, r.band_rms) for r in x.collect()} for x in (cut, one))
    assert {g: n for g, (n, _) in got.items()} == {g: n for g, (n, _) in want.items()}
    assert all(got[g][1] == (None if x is None else pytest.approx(x, rel=1e-9)) for g, (_, x) in want.items())
    # Three rounds: the filter comes with the columns, and the way back starts where the product is.
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 4


def test_clock_model_rows_meet_no_key(spark):
    """Rows aren't joined by key, sparse buckets look far back, samples without a value count only, and x without spread has no slope."""
    rng = random.Random(6)
    rows = [(key, o, o // 30, 1000 * o, None if o % 17 == 0 else 1000 * o + 3 * o + rng.randrange(9)) for key in ("a", None) for o in sorted(rng.sample(range(2000), 500))]
    rows += [("flat", o, 0, 5, 5 + o) for o in range(20)]
    df = spark.createDataFrame(rows, "dev string, o long, s long, x long, y long")
    made = clock.clock_model(df, ["dev"], ["o"], "s", "x", "y", 40, 8, width=7, block=64)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.dev, r.s): r for r in made.collect()}
    for key in ("a", None):
        own = [r for r in rows if r[0] == key]
        last = {r[2]: i for i, r in enumerate(own)}
        assert {s for k, s in got if k == key} == set(last)
        for s, i in last.items():
            r, seen = got[key, s], own[max(0, i - 39) : i + 1]
            assert r.n == len(seen)
            if r.n >= 8:
                x, e = (np.array(v, float) for v in zip(*[(q[3], q[4] - q[3]) for q in seen if q[4] is not None], strict=True))
                slope = np.polyfit(x - x.mean(), e, 1)[0]
                assert abs(r.slope_m1 - slope) < 1e-12 and abs(r["std"] - np.std(e - slope * x)) < 1e-7 and r.x_ref == int(np.floor(x.mean() + 0.5))
            else:
                assert r.slope_m1 is None and not r.valid
    assert got["flat", 0].slope_m1 is None and got["flat", 0].n == 20 and not got["flat", 0].valid


def test_band_jitter_equals_that_of_the_pairs(spark):
    """Unordered ids, ties, rows without a time, and parts of few pairs; buckets with one pair, an even and an odd number of them."""
    rng = random.Random(5)
    times = [[rng.randrange(3000) for _ in range(90)] + [5 * k for k in range(30)] + [7000, None] for _ in range(2)]
    a, b = (spark.createDataFrame([(t, rng.randrange(10**6)) for t in x], f"t_{n} long, id_{n} long") for n, x in zip("ab", times, strict=True))
    pairs = scale.band_join(a, b, "t_a", "t_b", 60).withColumn("delay", F.col("t_b") - F.col("t_a")).withColumn("bucket", F.expr("t_a div 500"))
    want = {r.bucket: r for r in stats.jitter_stats(pairs, "delay", ["bucket"]).collect()}
    noise = {r.bucket: r.rms_rad for r in spectrum.phase_noise(pairs, "delay", ["t_a", "id_a", "id_b"], 1000.0, ["bucket"], [], 500).collect()}
    got = bands.band_jitter(a, b, "t_a", "t_b", 60, 500, ["id_a"], ["id_b"], 1000.0, 50).collect()
    assert {r.bucket for r in got} == set(want) and any(r.n == 1 for r in got) and {r.n % 2 for r in got} == {0, 1}
    for r in got:
        w = want[r.bucket]
        assert (r.n, r.min, r.max) == (w.n, w.min, w.max)
        assert all(abs(r[c] - w[c]) < 1e-9 for c in ("mean", "std", "max_dev", *stats.QUANTILES))
        assert r.rms_rad is None if r.n < 3 else abs(r.rms_rad - noise[r.bucket]) < 1e-12


def test_minute_report_makes_no_table_of_pairs(spark, tmp_path):
    """In an hour of dense clicks and views, what is kept between steps is far less than their pairs."""
    kinds = F.when(F.col("id") % 2 == 0, "click").otherwise("view")
    dense = spark.range(600).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(7_200_000_000) + F.col("id") * 100_000).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), kinds.alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"))
    early = dense.where("event_id = 0").withColumn("ts", F.timestamp_micros(F.lit(0)).cast("timestamp_ntz"))
    dense.unionByName(early).write.parquet(f"{tmp_path}/events.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    old = set(shared.iterdir()) if shared.exists() else set()
    (r,) = registry.QUERIES["minute_report"](spark, str(tmp_path)).collect()
    kept = [spark.read.parquet(str(f)).count() for f in set(shared.iterdir()) - old]
    assert r.n == 300 * 300 and kept and max(kept) < 3000


def test_stream_match_has_no_state_tasks_without_keys(spark, small):
    """The state of eight devices is dealt to eight tasks at most, however many the session has, and the session keeps its number."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    old = set(shared.iterdir()) if shared.exists() else set()
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        assert registry.QUERIES["stream_match_timed"](spark, small).count() > 0
        assert spark.conf.get("spark.sql.shuffle.partitions") == "12"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    (state,) = [f / "state" / "state" / "0" for f in set(shared.iterdir()) - old if f.name.startswith("match-")]
    assert 0 < len([f for f in state.iterdir() if f.name.isdigit()]) <= 8
