"""Phase-noise spectra of delay series, by sums over single frequency bins instead of a transform."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import prefix
from .stats import _with_group_value

#: The offsets in Hz at which the single-sideband noise is reported.
LOG_BINS = [0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0]


def field_name(f: float) -> str:
    return "f_" + (f"{f:g}".replace(".", "p"))


def _windowed(df: DataFrame, delay: str, order: list[str], pulse_freq: float, by: list[str], width: float) -> DataFrame:
    """by..., _i, _n, _z (phase less its mean, under a Hann window), _w2 (the window squared)."""
    rows = prefix(df.where(F.col(delay).isNotNull()), by, order, width, rn="_rn").withColumn("_phase", F.col(delay) * 1e-9 * 2 * F.pi() * pulse_freq)
    rows = _with_group_value(rows, by, _n=F.count("*"), _mu=F.avg("_phase"))
    hann = 0.5 - 0.5 * F.cos(2 * F.pi() * (F.col("_rn") - 1) / (F.col("_n") - 1))
    # Under the window, series of fewer than three rows are all zero.
    return rows.where("_n > 2").select(*by, (F.col("_rn") - 1).alias("_i"), "_n", ((F.col("_phase") - F.col("_mu")) * hann).alias("_z"), (hann * hann).alias("_w2"))


def phase_noise(df: DataFrame, delay: str, order: list[str], pulse_freq: float, by: list[str], bins: list[float] | None = None, width: float = 1e9) -> DataFrame:
    """by..., n, rms_rad, rms_jitter_ns, f_<bin>...: one-sided noise of a delay series in ns, in dB at each offset.

    An offset needs only its two neighbour bins, so each is four sums; total power follows from the squares.
    Offsets below ten resolutions of the series or beyond half the pulse rate are null.
    """
    bins = LOG_BINS if bins is None else bins
    rows = _windowed(df, delay, order, pulse_freq, by, width)
    n = F.col("_n")

    def angle(k: Column) -> Column:
        return 2 * F.pi() * ((k * F.col("_i")) % n) / n

    aggs: list[Column] = [F.first("_n").alias("n"), F.sum("_w2").alias("_s2"), F.sum(F.col("_z") * F.col("_z")).alias("_zz"), F.sum("_z").alias("_dc")]
    last = F.floor(n / 2)
    aggs += [F.sum(F.col("_z") * F.cos(angle(last))).alias("_cl"), F.sum(F.col("_z") * F.sin(angle(last))).alias("_sl")]
    for f in bins:
        low = F.floor(F.lit(f) * n / pulse_freq)
        for j in (0, 1):
            aggs += [F.sum(F.col("_z") * F.cos(angle(low + j))).alias(f"_c{field_name(f)}_{j}"), F.sum(F.col("_z") * F.sin(angle(low + j))).alias(f"_s{field_name(f)}_{j}")]
    out = rows.groupBy(*by).agg(*aggs)
    count, scale = F.col("n"), pulse_freq * F.col("_s2")
    step = pulse_freq / count
    # All squares but the first; one-sided power counts every bin twice but the last, which for an even length is single anyway.
    single = F.when(count % 2 == 1, F.col("_cl") ** 2 + F.col("_sl") ** 2).otherwise(0.0)
    power = (count * F.col("_zz") - F.col("_dc") * F.col("_dc") - single) / scale * step
    rms = F.sqrt(F.greatest(power, F.lit(0.0)))
    cols = []
    for f in bins:
        name = field_name(f)
        low = F.floor(F.lit(f) * count / pulse_freq)
        p0, p1 = ((F.col(f"_c{name}_{j}") ** 2 + F.col(f"_s{name}_{j}") ** 2) * F.when(low + j == F.floor(count / 2), 1).otherwise(2) / scale for j in (0, 1))
        part = F.lit(f) * count / pulse_freq - low
        level = 10 * F.log10((p0 + part * (p1 - p0)) / 2)
        cols.append(F.when((F.lit(f) >= 10 * step) & (F.lit(f) <= pulse_freq / 2), level).alias(name))
    return out.select(*by, "n", rms.alias("rms_rad"), (rms / (2 * np.pi * pulse_freq) * 1e9).alias("rms_jitter_ns"), *cols)


#: Rows or columns of a long transform that go together to a task.
BLOCK = 64


def _chirp(i: np.ndarray, n: int) -> np.ndarray:
    """Angles from whole numbers below 2 n, so that long series keep their precision; squares are below 2 ** 63."""
    return np.exp(1j * np.pi * ((i * i) % (2 * n)) / n)


def _long_squares(rows: DataFrame, sizes: DataFrame, by: list[str], longest: int, pulse_freq: float, lo: float, hi: float) -> DataFrame:
    """by..., _squares: one-sided sums of squares in [lo, hi] Hz of series rows(by..., _i, _n, _z) of any length up to `longest`.

    Chirps turn the transform of n places into a convolution, whose own transforms have side * side places, in two rounds
    each: place side * a + b goes to column b for a transform over a, then frequency c + side * d to row c for one over
    b. What a round leaves in row c is what the way back starts from, so there are two exchanges of all places, and they
    travel in blocks of BLOCK rows of 16 bytes a number. The filter is made where its columns are.
    """
    side = 1
    while side * side < 2 * longest:
        side *= 2
    size, block = side * side, min(BLOCK, side)
    types = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n in by)
    place = np.arange(side)

    def turns(b: np.ndarray, c: np.ndarray, sign: int) -> np.ndarray:
        return np.exp(sign * 2j * np.pi * ((b * c) % size) / size)

    def frame(key: tuple, made: list[tuple], names: list[str]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *x) for x in made], columns=[*by, *names])

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, b = int(pdf["_n"].iloc[0]), int(key[-1])
        own = pdf[pdf["_i"] >= 0]
        i = own["_i"].to_numpy()
        z, at = np.zeros(side, complex), side * place + b
        z[i // side] = own["_z"].to_numpy() * _chirp(i, n).conj()
        far = np.minimum(at, size - at)
        with_turns = turns(b, place, -1)
        x, h = np.fft.fft(z) * with_turns, np.fft.fft(np.where(far < n, _chirp(np.minimum(far, n), n), 0)) * with_turns
        return frame(key[:-1], [(k // block, n, b, x[k : k + block].tobytes(), h[k : k + block].tobytes()) for k in range(0, side, block)], ["_block", "_n", "_b", "_x", "_h"])

    def second(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c, order = int(key[-1]) * block + np.arange(block)[:, None], pdf["_b"].to_numpy()
        product = np.full((block, side), 1 / size, complex)
        for name in ("_x", "_h"):
            cells = np.zeros((block, side), complex)
            cells[:, order] = np.frombuffer(b"".join(pdf[name]), complex).reshape(-1, block).T
            product *= np.fft.fft(cells, axis=1)
        back = np.fft.ifft(product, axis=1) * side * turns(c, place, 1)
        return frame(key[:-1], [(k // block, int(pdf["_n"].iloc[0]), int(key[-1]), back[:, k : k + block].tobytes()) for k in range(0, side, block)], ["_block", "_n", "_b", "_x"])

    def third(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, cells = int(pdf["_n"].iloc[0]), np.zeros((block, side), complex)
        for k, x in zip(pdf["_b"], pdf["_x"], strict=True):
            cells[:, k * block : (k + 1) * block] = np.frombuffer(x, complex).reshape(block, block).T
        # The last factor of the chirps has absolute value one: power needs none of it.
        power = np.abs(np.fft.ifft(cells, axis=1) * side) ** 2
        at = int(key[-1]) * block + np.arange(block)[:, None] + side * place
        freq = at * pulse_freq / n
        inside = (at <= n // 2) & (freq >= lo) & (freq <= hi)
        squares = power * np.where((at == 0) | (at == n // 2), 1.0, 2.0)
        return frame(key[:-1], [(float(squares[inside].sum()),)] if inside.any() else [], ["_squares"])

    # Columns that a short series leaves empty have their part of the filter.
    empty = sizes.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long"))).alias("_b"), F.lit(-1).cast("long").alias("_i"), F.col("n").alias("_n"), F.lit(0.0).alias("_z"))
    placed = rows.select(*by, (F.col("_i") % side).cast("long").alias("_b"), F.col("_i").cast("long").alias("_i"), "_n", "_z").unionByName(empty)
    columns = placed.groupBy(*by, "_b").applyInPandas(first, f"{types}_block long, _n long, _b long, _x binary, _h binary")
    tiles = columns.groupBy(*by, "_block").applyInPandas(second, f"{types}_block long, _n long, _b long, _x binary")
    parts = tiles.groupBy(*by, "_block").applyInPandas(third, f"{types}_squares double")
    return parts.groupBy(*by).agg(F.sum("_squares").alias("_squares"))


def band_rms(df: DataFrame, delay: str, order: list[str], pulse_freq: float, lo: float, hi: float, by: list[str], width: float = 1e9, whole: int = 1 << 20) -> DataFrame:
    """by..., n, band_rms: noise of a delay series in [lo, hi] Hz in rad; null if the band holds no bin.

    The spectrum is that of the whole series. Series of up to `whole` rows are transformed in a task of their own;
    longer ones by transforms whose tasks hold the square root of their length, with the same result.
    """
    rows = _windowed(df, delay, order, pulse_freq, by, width)
    sizes = df.where(F.col(delay).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    norm = rows.groupBy(*by).agg(F.sum("_w2").alias("_s2"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    types = ", ".join(f"{n} {t}" for n, t in df.dtypes if n in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(int(pdf["_n"].iloc[0]))
        z[pdf["_i"].to_numpy()] = pdf["_z"].to_numpy()
        spectrum = np.fft.rfft(z)
        freq = np.arange(len(spectrum)) * pulse_freq / len(z)
        double = np.full(len(spectrum), 2.0)
        double[[0, -1]] = 1.0
        chosen = (freq >= lo) & (freq <= hi)
        return pd.DataFrame([[*key, float((np.abs(spectrum) ** 2 * double)[chosen].sum()) if chosen.any() else None]], columns=[*by, "_squares"])

    short = rows.where(F.col("_n") <= whole).groupBy(*by).applyInPandas(run, f"{types}, _squares double")
    squares = short
    if longest > whole:
        long = rows.where(F.col("_n") > whole)
        squares = short.unionByName(_long_squares(long, sizes.where(F.col("n") > whole), by, longest, pulse_freq, lo, hi))
    out = sizes.join(norm, by, "left").join(squares, by, "left")
    return out.select(*by, "n", F.sqrt(F.col("_squares") / F.col("_s2") / F.col("n")).alias("band_rms"))
