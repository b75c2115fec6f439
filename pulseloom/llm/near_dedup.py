"""Near-duplicate classes through SetSketch registers.

Every text is sketched once: registers are exponentially spaced, truncated minima over its distinct word
shingles, so sketches of parts merge by a maximum. Bands of registers meet in buckets, the joint likelihood of
two sketches prunes pairs, full shingle sets confirm the rest, and confirmed links are contracted to classes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, join_skewed, saved, small_batches

WORDS = 5
BANDS, ROWS, REGISTERS = 32, 4, 384
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Standard errors below the threshold at which the likelihood still keeps a pair for the exact check.
MARGIN = 4.0
#: Members of one bucket that meet in a task, and how many of a large bucket's best linked ones meet all others of it.
BLOCK, PIVOTS = 256, 32
#: So many ids (8 MB) may be broadcast to pick their texts; more are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000
#: Bytes of the sets that meet in one group (two longer ones meet alone), and links that are contracted in one task; more take rounds.
SETS, MOST_LOCAL_LINKS = 32 << 20, 1 << 20
#: Bytes of text that are hashed at once.
_PIECE = 4 << 20

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_NEAR = _RANDOM.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = _RANDOM.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROUND = _RANDOM.integers(0, 2**31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = re.compile(rb"[ \t\n\x0b\f\r]")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data, and where each begins."""
    chars = np.frombuffer(data, dtype=np.uint8)
    inside = np.flatnonzero(~_SPACE[chars])
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.ones(len(inside), bool)
    first[1:] = np.diff(inside) > 1
    at = np.flatnonzero(first)
    lengths = np.diff(np.append(at, len(inside)))
    place = np.arange(len(inside)) - np.repeat(at, lengths)
    values = _BYTE[_LOWER[chars[inside]]] * _NEAR[place & 1023]
    late = np.flatnonzero(place >= 1024)
    if len(late):
        values[late] *= _FAR[(place[late] >> 10) & 1023] + (place[late] >> 20).astype(np.uint64) * np.uint64(2)
    return _mix(np.add.reduceat(values, at) + lengths.astype(np.uint64)), inside[at]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's words begin (with the end of the last).

    A long text is hashed piece by piece, cut at spaces, so that memory follows its words and not its bytes.
    """
    if len(texts) == 1 and len(texts[0]) > _PIECE:
        text, parts, at = texts[0], [], 0
        while at < len(text):
            cut = _BLANK.search(text, min(at + _PIECE, len(text)))
            end = cut.end() if cut else len(text)
            parts.append(_hashed(text[at:end])[0])
            at = end
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    hashes, begin = _hashed(b" ".join(texts) + b" ")
    return hashes, np.concatenate(([0], np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[tuple[np.ndarray, bytes]]:
    """Each text's sorted distinct shingle hashes and a digest of its word sequence."""
    hashes, begin = word_hashes(texts)
    runs = max(0, len(hashes) - words + 1)
    shingles = np.zeros(runs, np.uint64)
    for i in range(words):
        shingles += hashes[i : i + runs] * _PLACE[i]
    shingles = _mix(shingles + np.uint64(words))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        digest = hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest()
        if b - a >= words:
            one = np.sort(shingles[a : b - words + 1])
            keep = np.ones(len(one), bool)
            keep[1:] = one[1:] != one[:-1]
            yield one[keep], digest
        elif b > a:
            yield _mix(np.array([(hashes[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)), digest
        else:
            yield np.zeros(0, np.uint64), digest


def minima(shingles: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """For each register the least of the shingles' 32-bit hashes."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(registers, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(out, (low[i : i + 1024, None] * _ROUND[None, :registers]).min(axis=0), out=out)
    return out


def to_registers(least: np.ndarray) -> np.ndarray:
    """Minima as exponential variates on a logarithmic scale, truncated to 0..TOP."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def _beyond(x: np.ndarray) -> np.ndarray:
    """The chance that one register exceeds the other, where x is the part of the union that only one set holds."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likely(over: np.ndarray, under: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, registers: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """Whether the maximum-likelihood Jaccard similarity is at least `least`, and the share of equal registers.

    The log-likelihood over the counts of larger, smaller and equal registers is concave in the similarity, so
    the maximum lies above `least` exactly if the slope there is not negative. Set sizes are known exactly.
    """
    u, v = na / (na + nb), nb / (na + nb)
    equal = registers - over - under
    step = 1e-4

    def value(j: float) -> np.ndarray:
        p, q = np.maximum(_beyond(u - v * j), 1e-9), np.maximum(_beyond(v - u * j), 1e-9)
        return over * np.log(p) + under * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-9))

    fits = np.minimum(na, nb) >= (least + MARGIN / 100) * np.maximum(na, nb) * 0.9
    return fits & (value(least + step) >= value(least - step)), equal / registers


def least_likely(threshold: float, registers: int = REGISTERS) -> float:
    return threshold - MARGIN * (threshold * (1 - threshold) / registers) ** 0.5


def sketches(docs: DataFrame, words: int = WORDS, registers: int = REGISTERS) -> DataFrame:
    """doc_id, digest (of the word sequence), n_shingles, regs (little-endian 16-bit registers) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            digests, counts, least = [], [], []
            for one, digest in shingle_sets([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], words):
                digests.append(digest)
                counts.append(len(one))
                least.append(minima(one, registers))
            regs = to_registers(np.stack(least))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "digest", "n_shingles", "regs"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, digest binary, n_shingles long, regs binary")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """id, t, shingles (sorted 64-bit hashes) of the texts in wanted(id, t); t is the hash of a text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            sets = list(shingle_sets([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([d for _, d in sets], pa.binary()), pa.array([one.tobytes() for one, _ in sets], pa.binary())], ["id", "digest", "shingles"])

    ids, texts = wanted.select(F.col("id").alias("doc_id")).distinct(), id_and_text(docs)
    if wanted.count() <= MOST_BROADCAST_IDS:
        picked = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    else:
        # Texts are dealt by a part of their own too, so that rows of a repeated id don't meet in one task.
        part = F.pmod(F.xxhash64("text"), F.lit(16)).cast("int")
        picked = texts.withColumn("part", part).join(ids.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["doc_id", "part"], "left_semi").drop("part")
    sets = picked.mapInArrow(run, "id long, digest binary, shingles binary").select("id", F.xxhash64("digest").alias("t"), "shingles")
    return sets.join(wanted, ["id", "t"], "left_semi").dropDuplicates(["id", "t"])


_PAIR = ["a", "ta", "b", "tb"]
#: What names a group of texts whose full sets meet.
_GROUP = ["key", "lo", "hi", "part"]


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _likely_members(rows: list[tuple], threshold: float, registers: int, forest: bool, width: int) -> np.ndarray:
    """Which texts of one block, or of two blocks, of a bucket have a likely partner of another class there; with
    `forest` only those at the ends of a maximum spanning forest of the classes by similarity.

    A pair that meets in several bands belongs to the first of them alone.
    """
    known = np.array([r[2] for r in rows], np.int64)
    side = np.array([r[3] for r in rows])
    n = np.array([r[4] for r in rows], np.float64)
    regs = np.frombuffer(b"".join(r[5] for r in rows), "<u2").reshape(len(rows), registers)
    band = rows[0][6]
    least = least_likely(threshold, registers)
    out = np.zeros(len(rows), bool)
    found: list[tuple[float, int, int]] = []
    for i in range(len(rows) - 1):
        later = np.arange(i + 1, len(rows))
        later = later[(known[later] != known[i]) & ((side[later] != side[i]) | (side[i] == 2))]
        later = later[np.minimum(n[later], n[i]) >= threshold * np.maximum(n[later], n[i])]
        if band and len(later):
            before = (regs[later, : band * width] == regs[i, : band * width]).reshape(len(later), band, width)
            later = later[~before.all(axis=2).any(axis=1)]
        if not len(later):
            continue
        over, under = (regs[later] > regs[i]).sum(axis=1), (regs[later] < regs[i]).sum(axis=1)
        ok, equal = likely(over, under, n[later], np.full(len(later), n[i]), least, registers)
        if forest:
            found += [(-e, i, j) for e, j in zip(equal[ok].tolist(), later[ok].tolist(), strict=True)]
        elif ok.any():
            out[i] = out[later[ok]] = True
    # Members of one class are joined already: a block's forest has no more links than it has classes.
    first: dict[int, int] = {}
    parent = [first.setdefault(k, i) for i, k in enumerate(known.tolist())]
    for _, i, j in sorted(found):
        a, b = _root(parent, i), _root(parent, j)
        if a != b:
            parent[a] = b
            out[i] = out[j] = True
    return out


def _parts(size: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """(number, rows) of parts in which every two rows meet: one of all rows, or every two of chunks that hold half of `most` bytes each."""
    total = np.cumsum(size)
    if not len(size) or total[-1] <= most:
        return [(0, np.arange(len(size)))]
    chunk = (total - size) // max(1, most // 2)
    chunks = np.split(np.arange(len(size)), np.flatnonzero(np.diff(chunk)) + 1)
    pairs = [(x, y) for y in range(1, len(chunks)) for x in range(y)] or [(0, 0)]
    return [(k, np.union1d(chunks[x], chunks[y])) for k, (x, y) in enumerate(pairs)]


def _involved(dealt: DataFrame, reps: DataFrame, threshold: float, registers: int, forest: bool, width: int) -> DataFrame:
    """key, lo, hi, part, id, t, known of the texts that full sets must be compared of; all of one (key, lo, hi, part) with each other.

    dealt has key, lo, hi, id, t, known, side, band; `width` registers are a band. The rows of one (key, lo, hi)
    meet: all of side 2 with each other, those of side 0 with those of side 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, done = None, [], []

        def close() -> None:
            if len(rows) > 1:
                some = np.flatnonzero(_likely_members(rows, threshold, registers, forest, width))
                for part, own in _parts(np.array([8 * rows[k][4] for k in some], np.int64), SETS):
                    done.extend((*at, part, *rows[k][:3]) for k in some[own])

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * 7, types, strict=True)], names)

        for batch in batches:
            for key, lo, hi, *row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
                if (key, lo, hi) != at:
                    close()
                    at, rows = (key, lo, hi), []
                    if len(done) > 50_000:
                        yield out()
                        done.clear()
                rows.append(row)
        close()
        yield out()

    names = [*_GROUP, "id", "t", "known"]
    rows = dealt.join(reps.select("id", "t", "n", "regs"), ["id", "t"]).select("key", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "id", "t", "known", "side", "n", "regs", "band")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "key long, lo int, hi int, part int, id long, t long, known long")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id", "t"), blocks).cast("int")


def _own_blocks(members: DataFrame) -> DataFrame:
    """Each member in one block of its bucket: small buckets whole, of large ones the same number of rows as members."""
    return members.withColumn("lo", _block(F.ceil(F.col("size") / BLOCK))).withColumn("hi", F.col("lo")).withColumn("known", F.col("id")).withColumn("side", F.lit(2))


def _with_pivots(members: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """The members of large buckets with, in each block, the PIVOTS members of the bucket that have most links."""
    large = members.where(F.col("size") > BLOCK).join(found, "id", "left").withColumn("known", F.coalesce("component", "id")).drop("component")
    degree = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ta").alias("t")), F.struct(F.col("b").alias("id"), F.col("tb").alias("t")))).alias("e")).select("e.*").groupBy("id", "t").agg(F.count("*").alias("degree"))
    order = Window.partitionBy("key").orderBy(F.desc("degree"), "id", "t")
    best = large.join(degree, ["id", "t"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    out = ["key", "lo", "hi", "id", "t", "known", "side", "band"]
    pivots = best.withColumn("lo", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(0))
    return pivots.unionByName(large.withColumn("lo", _block(blocks)).withColumn("side", F.lit(1)), True).withColumn("hi", F.col("lo")).select(out)


def _across(placed: DataFrame, total: int) -> DataFrame:
    """Members of the buckets that still hold several classes, dealt so that every two of different classes meet.

    The rows of a bucket's largest class meet those of the others, which also meet each other: with few others, the
    number of rows stays that of the members.
    """
    each = placed.groupBy("key", "known").agg(F.count("*").alias("n"))
    mixed = each.groupBy("key").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("known", F.struct("n", "known")).alias("major")).where("most < size")
    met = join_skewed(placed, saved(mixed, "mixed"), "key", "size", total).where("size is not null")
    minor = F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int")
    blocks = F.ceil(F.col("most") / BLOCK).cast("int")
    met = met.withColumn("minor", minor).withColumn("is_minor", F.col("known") != F.col("major"))
    met = met.withColumn("own", F.when(F.col("is_minor"), _block(F.col("minor"))).otherwise(F.col("minor") + _block(blocks)))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_minor"), F.col("minor") + blocks).otherwise(F.col("minor")) - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return met.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "t", "known", side.alias("side"), "band")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements every two of the sorted sets have in common.

    Elements that the same sets hold are one column with their number as its weight, so sets with a common part cost
    no more than its columns; where there are many columns, the sets are compared two by two.
    """
    size, n = np.array([len(s) for s in sets]), len(sets)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(n), size)[order]
    begin = np.flatnonzero(np.diff(every, prepend=~every[:1]))
    many = np.diff(np.append(begin, len(every)))
    mark = np.random.default_rng(1).integers(0, 2**64, n, dtype=np.uint64)
    name = np.add.reduceat(mark[owner], begin) if len(begin) else np.zeros(0, np.uint64)
    begin, name, many = begin[many > 1], name[many > 1], many[many > 1]
    _, first, weight = np.unique(name, return_index=True, return_counts=True)
    out = np.zeros((n, n))
    # Multiplications of the columns against steps of the searches.
    if len(first) * n > 64 * (size.sum() + 1) * 8:
        for i in range(n):
            for j in range(i):
                one, two = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
                out[i, j] = out[j, i] = (two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum() if len(one) else 0
        return out
    for k in range(0, len(first), 4096):
        at, times = begin[first[k : k + 4096]], many[first[k : k + 4096]]
        held = np.zeros((len(at), n))
        ends = np.cumsum(times)
        place = np.arange(ends[-1]) - np.repeat(ends - times, times) + np.repeat(at, times)
        held[np.repeat(np.arange(len(at)), times), owner[place]] = 1
        out += (held * weight[k : k + 4096, None]).T @ held
    return out


def _links_of(rows: list[tuple], threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """Links between texts (id, t, known, set) of different classes: a forest that joins what all links join, around the texts with most links."""
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    known, size = np.array([r[2] for r in rows]), np.array([len(s) for s in sets])
    same, hundred = common_counts(sets), round(threshold * 100)
    linked = (100 * same >= hundred * (size[:, None] + size - same)) & (same > 0)
    np.fill_diagonal(linked, False)
    first: dict[int, int] = {}
    parent = [first.setdefault(k, i) for i, k in enumerate(known.tolist())]
    for i in np.argsort(-linked.sum(axis=1), kind="stable").tolist():
        for j in np.flatnonzero(linked[i]).tolist():
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[a] = b
                one, two = sorted((rows[i][:2], rows[j][:2]))
                yield (*one, *two)


def confirmed(involved: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, ta, b, tb) that join what the full sets of each group of `involved` link; a set travels once a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, done = None, [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(4)], _PAIR)
            done.clear()
            return made

        for batch in small_batches(batches, "shingles", SETS // 4):
            for *group, i, t, known, shingles in zip(*[batch.column(c).to_pylist() for c in (*_GROUP, "id", "t", "known", "shingles")], strict=True):
                if group != at:
                    if len(rows) > 1:
                        done.extend(_links_of(rows, threshold))
                    at, rows = group, []
                rows.append((i, t, known, shingles))
            if len(done) > 50_000:
                yield out()
        if len(rows) > 1:
            done.extend(_links_of(rows, threshold))
        yield out()

    met = involved.join(sets, ["id", "t"]).select(*_GROUP, "id", "t", "known", "shingles")
    return met.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, "a long, ta long, b long, tb long")


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of links between a and b, and the smallest id that each reaches; memory of a few times the links."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        # Roots take the smaller label too, so paths shorten by half and more each time.
        for end in (one, two, label[one], label[two]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest reachable id) of every id in links(a, b).

    Up to MOST_LOCAL_LINKS links (16 MB), after each task's own are contracted, are joined in one task. More are by
    alternating large-star and small-star steps: a number of rounds in the logarithm of the longest path, each a table
    in the shared folder.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if parts:
            ids, least = least_reachable(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["id", "component"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of one partition's batch as stars around their local minima."""
        for batch in batches:
            parent: dict[int, int] = {}

            def root(i: int, parent: dict[int, int] = parent) -> int:
                while parent.setdefault(i, i) != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            stars = [(i, root(i)) for i in list(parent)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, r in stars if i != r], pa.int64()), pa.array([r for i, r in stars if i != r], pa.int64())], ["u", "v"])

    edges = saved(links.select("a", "b").where("a <> b").mapInArrow(local, "u long, v long"), "edges")
    if edges.count() <= MOST_LOCAL_LINKS:
        return saved(edges.repartition(1).mapInArrow(together, "id long, component long"), "components")
    edges = edges.distinct()
    while True:
        both = edges.union(edges.select("v", "u"))
        least = saved(both.groupBy("u").agg(F.count("*").alias("degree"), F.min("v").alias("m")).select("u", "degree", F.least("u", "m").alias("m")), "least")
        met = join_skewed(both, least, "u", "degree", 2 * edges.count())
        large = saved(met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        down = large.groupBy("u").agg(F.count("*").alias("degree"), F.min("v").alias("m"))
        small = join_skewed(large, down, "u", "degree", large.count()).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = saved(small, "edges")
        # Stars are reached when no centre is a leaf and no leaf has two centres.
        stars = edges.groupBy("u").count().where("count > 1").limit(1).count() + edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        if not stars:
            break
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return saved(leaves.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")


def near_duplicates(docs: DataFrame, threshold: float = 0.75, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, registers: int = REGISTERS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text, ...).

    Texts are lower-cased (A-Z) and split at space and \\x09-\\x0D; a set holds the distinct `words`-word shingles,
    of a shorter text its whole sequence. Two documents are linked if their sets' Jaccard similarity is at least
    `threshold`; component_id is the smallest doc_id reachable through links.

    Null, empty and blank texts have no shingle, link to nothing and are their own component. Rows without a
    doc_id get a null component_id and are not kept. Rows that repeat a doc_id count as one document with all
    their texts: what any of them links to is in one component. An empty table gives an empty result. Other
    columns are ignored.

    1. Equal word sequences collapse to the smallest doc_id (map-side combined, so huge groups cost one row a task).
    2. Registers are banded: a pair at the threshold misses all 32 bands of 4 with a chance of about 5e-6.
    3. The texts at the ends of the spanning forest of the likely pairs of each bucket's blocks meet there with their
       full sets; in buckets of several blocks so do all members with the best linked ones. Last, all texts with a
       likely partner of another class meet with it. A set travels once a block and is compared with all others of
       the block at once; no pair is ever a row of its own, and none is left out.
    """
    if bands * rows > registers:
        raise ValueError("bands * rows exceeds the number of registers")
    all_rows = saved(sketches(docs, words, registers), "sketches")
    named = all_rows.where("doc_id is not null and n_shingles > 0").withColumn("t", F.xxhash64("digest"))
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("t").alias("t"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    reps = saved(classes, "reps")
    keys = F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(regs, {2 * rows * b + 1}, {2 * rows})")) for b in range(bands)])
    banded = reps.select("id", "t", "n", F.posexplode(keys).alias("band", "key"))
    # Two texts alone in a bucket that differ in size too much to be linked need not meet.
    full = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    full = full.where("lo < hi").where((F.col("size") > 2) | (F.col("least") >= F.lit(threshold) * F.col("most"))).select("key", "size")
    banded = banded.drop("n")
    total = bands * reps.count()
    full = saved(full, "buckets")
    # Fewer than 256 keys hold over 1/256 of all rows each: those are broadcast, and their rows shuffle nowhere.
    hot = F.broadcast(full.where(F.col("size") * 256 > total))
    cold = banded.join(hot, "key", "left_anti").join(full.where(F.col("size") * 256 <= total), "key")
    members = saved(banded.join(hot, "key").unionByName(cold), "members")

    several = named.groupBy("doc_id").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low < high").select("doc_id")
    own = named.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(reps.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    sets, found = None, components(own)
    large = members.where(F.col("size") > BLOCK).limit(1).count()

    def settle(dealt: DataFrame, forest: bool) -> DataFrame:
        """Joins the classes that the full sets of likely members of dealt blocks link; returns these links."""
        nonlocal sets, found
        involved = saved(_involved(dealt, reps, threshold, registers, forest, rows), "involved")
        wanted = involved.select("id", "t").distinct()
        wanted = saved(wanted if sets is None else wanted.join(sets.select("id", "t"), ["id", "t"], "left_anti"), "wanted")
        more = saved(sets_of(docs, wanted, words), "shingles")
        sets = more if sets is None else sets.unionByName(more)
        links = saved(confirmed(involved, sets, threshold), "links")
        found = components(_as_links(found).union(links.select("a", "b")))
        return links

    links = settle(_own_blocks(members), True)
    if large:
        settle(_with_pivots(members, links, found), True)
    # Two texts alone in a bucket have met already.
    placed = members.where("size > 2").drop("size").join(found, "id", "left").select("id", "t", "key", "band", F.coalesce("component", "id").alias("known"))
    settle(_across(placed, members.count()), False)

    known = reps.select(F.hex("digest").alias("digest"), "copies", "id").join(found, "id", "left").select("digest", "copies", F.coalesce("component", "id").alias("component"))
    out = join_skewed(all_rows.where("n_shingles > 0").select("doc_id", F.hex("digest").alias("digest"), "n_shingles"), known, "digest", "copies", all_rows.count())
    blank = all_rows.where("n_shingles = 0").select("doc_id", "n_shingles").join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", "component").unionByName(blank.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _as_links(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("a"), F.col("component").alias("b"))
