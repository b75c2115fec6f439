"""Ranked lexical search, reversed: the index is over the items' terms, and documents stream through it.

Items are few beside documents, so the inverted index (term -> items) is broadcast in rounds of bounded size. A first
pass counts, over all documents, what the weights need; a second adds each document's term counts into the scores of
the items that hold the terms, and keeps a bounded heap an item. The heaps of all tasks are merged in two levels.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, saved, small_batches
from .terms import counted, term_lists

K = 10
#: A round broadcasts items with about so many bytes of distinct terms, and about so many items.
ROUND_BYTES, ROUND_ITEMS = 8 << 20, 4096
#: Weights: the least length factor in percent, and what of the length counts.
FLAT, SLOPE = 10, 90
#: Cells of a table of scores (documents x items), and tasks whose heaps meet first.
_CELLS, _FAN = 1 << 20, 64
_LAST = 2**63


def items_with_terms(items: DataFrame) -> DataFrame:
    """number (one a row), item_id, terms (distinct), size (their bytes) of every row of items(item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            terms = [sorted({t for part in term_lists(text) for t in part}) for text in batch.column("text").to_pylist()]
            size = [sum(len(t) + 8 for t in own) for own in terms]
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("item_id"), pa.array(terms, pa.list_(pa.binary())), pa.array(size, pa.int64())], ["number", "item_id", "terms", "size"])

    rows = items.select(F.monotonically_increasing_id().alias("number"), F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return saved(rows.mapInArrow(run, "number long, item_id long, terms array<binary>, size long"), "items")


def in_rounds(items: DataFrame, size: int, rows: int) -> tuple[DataFrame, list[int]]:
    """items with their round, and the rounds there are: none holds over twice `size` bytes or `rows` items, unless it is one item."""
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("rows")).first()
    rounds = max(1, -(-total["size"] // size), -(-total["rows"] // rows))
    while True:
        placed = items.withColumn("round", F.pmod(F.xxhash64("number"), F.lit(rounds)))
        each = placed.groupBy("round").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        if not each.where((F.col("rows") > 1) & ((F.col("size") > 2 * size) | (F.col("rows") > 2 * rows))).limit(1).count():
            return placed, sorted(r["round"] for r in each.select("round").collect())
        rounds *= 2


def term_statistics(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Over all rows of docs: how many have a term, how many terms they have, and how many hold each of `terms`."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: k for k, t in enumerate(sent.value)}
        wanted, held, docs, length = frozenset(index), np.zeros(len(index), np.int64), 0, 0
        for batch in small_batches(batches, "text", 1 << 20):
            for text in batch.column("text").to_pylist():
                n, found = 0, set()
                for part in term_lists(text):
                    n += len(part)
                    found |= wanted & set(part)
                docs, length = docs + (n > 0), length + n
                held[[index[t] for t in found]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]), pa.int64()), pa.array(np.append(held[some], [docs, length]), pa.int64())], ["term", "n"])

    counts = id_and_text(docs).select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms), np.int64)
    whole = {-1: 0, -2: 0}
    # A row for each of the broadcast terms at most.
    for term, n in counts.collect():
        if term < 0:
            whole[term] = n
        else:
            out[term] = n
    sent.unpersist()
    return whole[-1], whole[-2], out


class Heaps:
    """The k best documents of each item so far, by falling score, then rising doc_id (null last)."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, ids: list[int | None], scores: np.ndarray) -> None:
        """scores[document, item]; what can't reach an item's k-th score is not looked at."""
        for d, i in zip(*np.nonzero(scores >= self.least), strict=True):
            heap, entry = self.heaps[i], (int(scores[d, i]), -_LAST if ids[d] is None else -ids[d])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


class Index:
    """Terms with their weights and the items that hold them."""

    def __init__(self, terms: list[bytes], weights: np.ndarray, begin: np.ndarray, items: np.ndarray, numbers: list[int], ids: list[int | None], docs: int, length: int) -> None:
        self.terms, self.weights, self.begin, self.items = terms, weights, begin, items
        self.numbers, self.ids, self.docs, self.length = numbers, ids, docs, length

    def search(self, batches: Iterator[pa.RecordBatch], k: int) -> list[tuple[int, int | None, int]]:
        """(item, doc_id, score) of the k best documents of each item among the rows of batches(doc_id, text)."""
        index = {t: n for n, t in enumerate(self.terms)}
        wanted, heaps, width = frozenset(index), Heaps(len(self.numbers), k), max(1, len(self.numbers))
        spread = np.diff(self.begin)
        ids, hits, held = [], [], 0

        def close() -> None:
            doc, term, tf, m = (np.array(c, np.int64) for c in zip(*hits, strict=True))
            part = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            many = spread[term]
            ends = np.cumsum(many)
            place = np.arange(ends[-1]) - np.repeat(ends - many, many) + np.repeat(self.begin[term], many)
            scores = np.zeros(len(ids) * width, np.int64)
            np.add.at(scores, np.repeat(doc, many) * width + self.items[place], np.repeat(part, many))
            heaps.add(ids, scores.reshape(len(ids), width))

        for batch in small_batches(batches, "text", 1 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, counts = counted(text, wanted)
                if not counts:
                    continue
                m = FLAT + SLOPE * n * self.docs // self.length
                hits += [(len(ids), index[t], tf, m) for t, tf in counts.items()]
                held += sum(int(spread[index[t]]) for t in counts)
                ids.append(doc_id)
                if len(ids) * width >= _CELLS or held >= _CELLS:
                    close()
                    ids, hits, held = [], [], 0
        if ids:
            close()
        return [(i, None if d == -_LAST else -d, s) for i, heap in enumerate(heaps.heaps) for s, d in heap]


def index_of(items: list[tuple[int, int | None, list[bytes]]], docs: DataFrame) -> Index:
    """The index of items (number, item_id, distinct terms), weighted by statistics over all docs."""
    postings: dict[bytes, list[int]] = {}
    for i, (_, _, terms) in enumerate(items):
        for t in terms:
            postings.setdefault(t, []).append(i)
    terms = sorted(postings)
    n, length, held = term_statistics(docs, terms)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    begin = np.concatenate(([0], np.cumsum([len(postings[t]) for t in terms]))).astype(np.int64)
    rows = np.array([i for t in terms for i in postings[t]], np.int64)
    return Index(terms, weights, begin, rows, [i[0] for i in items], [i[1] for i in items], n, length)


def ranked_search(items: DataFrame, docs: DataFrame, k: int = K, round_bytes: int = ROUND_BYTES, round_items: int = ROUND_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items the k documents of docs with the highest score above 0.

    Terms are maximal runs of 0-9, A-Z (lower-cased), a-z and characters beyond ASCII, in the whole text. A term's
    weight is floor(1000 ln((2 N + 2) / (2 df + 1))), N the documents with a term and df those that hold it; with n
    terms in the document, L in all and m = 10 + 90 n N div L, a term that occurs tf times adds
    weight * (10^9 tf div (1000 tf + 8 m)), in whole numbers. Equal scores go by ascending doc_id.

    Items are broadcast in rounds of bounded size; a round scans docs twice, and nothing of docs is shuffled but k
    rows an item and task, which are merged in two levels.

    Null and empty texts have no term: such items get no rows, such documents no rank. Rows that repeat a doc_id are
    documents of their own and may take several ranks; a null doc_id ranks after all of its score; rows that repeat
    an item_id are ranked each by itself. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    placed, rounds = in_rounds(items_with_terms(items), round_bytes, round_items)
    texts = id_and_text(docs)
    schema = "number long, item_id long, doc_id long, score long, part int"
    found = None
    for number in rounds:
        rows = placed.where(F.col("round") == number).select("number", "item_id", "terms").orderBy("number").toArrow()
        index = index_of(list(zip(*[rows[c].to_pylist() for c in ("number", "item_id", "terms")], strict=True)), docs)
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, part = sent.value, TaskContext.get().partitionId() // _FAN
            best = index.search(batches, k)
            columns = [[index.numbers[i] for i, _, _ in best], [index.ids[i] for i, _, _ in best], [d for _, d, _ in best], [s for _, _, s in best]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([part] * len(best), pa.int32())], ["number", "item_id", "doc_id", "score", "part"])

        heaps = saved(texts.mapInArrow(run, schema), "heaps")
        sent.unpersist()
        found = heaps if found is None else found.unionByName(heaps)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["number", "part"], ["number"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
