"""Best-fit packing of token sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_and_text, saved

CAPACITY, END = 1024, 2
#: Pieces that are packed together; memory and time of a task depend on it, not on the size of the table.
CHUNK = 16384
#: The search of a chunk ends after so many bins in a row that no step can empty further, or after so many steps.
PATIENCE, STEPS = 64, 20_000
#: Underfull bins of so many partitions are packed anew together; at most the CHUNK / KEPT pieces of the emptiest of each.
FAN, KEPT = 64, 8


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. A bit mask of free spaces finds the tightest bin at once."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        if at := mask >> n:
            space = n + ((at & -at).bit_length() - 1)
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        if space > n:
            free[space - n].append(b)
            mask |= 1 << (space - n)
    return bins


class _Search:
    """Bins under local search; each step raises the sum of squared fills, so the search ends."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int) -> None:
        self.size, self.capacity = sizes, capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(sizes[i] for i in b) for b in self.bins]
        self.open = {k for k, n in enumerate(self.fill) if n < capacity}
        self.known: dict[int, tuple[dict, dict]] = {}

    def sums(self, b: int) -> tuple[dict[int, tuple], dict[int, tuple]]:
        """An item of each size in bin b, and two items of each sum that no single item has."""
        if b not in self.known:
            one: dict[int, tuple] = {}
            for i in self.bins[b]:
                one.setdefault(self.size[i], (i,))
            count: dict[int, list[int]] = {}
            for i in self.bins[b]:
                count.setdefault(self.size[i], []).append(i)
            two: dict[int, tuple] = {}
            there = sorted(count)
            for x, n in enumerate(there):
                for m in there[x:]:
                    if n + m not in one and (n != m or len(count[n]) > 1):
                        two.setdefault(n + m, (count[n][0], count[m][1 if n == m else 0]))
            self.known[b] = one, two
        return self.known[b]

    def shift(self, give: tuple, take: tuple, source: int, target: int) -> None:
        for items, a, b in ((give, source, target), (take, target, source)):
            for i in items:
                self.bins[a].remove(i)
                self.bins[b].append(i)
                self.fill[a] -= self.size[i]
                self.fill[b] += self.size[i]
        for b in (source, target):
            self.known.pop(b, None)
            if self.bins[b] and self.fill[b] < self.capacity:
                self.open.add(b)
            else:
                self.open.discard(b)

    def step(self, e: int) -> bool:
        """The best move, one-for-one, two-for-one or one-for-two exchange that empties bin e into a fuller one.

        All underfull bins are looked at; for each thing that one of them could give back, a mask of what e
        has finds the largest thing that still fits.
        """
        one, two = self.sums(e)
        some, more = sum(1 << n for n in one), sum(1 << n for n in (*one, *two))
        best, chosen = 0, None
        for b in self.open:
            space, ahead = self.capacity - self.fill[b], self.fill[b] - self.fill[e]
            if b == e or ahead < 0 or space * (ahead + space) <= best:
                continue
            own, pairs = self.sums(b)
            for back, mask in ((((0, ()),), some), (own.items(), more), (pairs.items(), some)):
                for n, take in back:
                    fits = mask & ((2 << (n + space)) - 1)
                    gain = fits.bit_length() - 1 - n
                    if gain > 0 and gain * (ahead + gain) > best:
                        best, chosen = gain * (ahead + gain), (one.get(n + gain) or two[n + gain], take, b)
        if chosen is None:
            return False
        self.shift(chosen[0], chosen[1], e, chosen[2])
        return True


def improve(sizes: list[int], bins: list[list[int]], capacity: int = CAPACITY, patience: int = PATIENCE, steps: int = STEPS) -> list[list[int]]:
    """Swap-based local search: empties the least filled bin, then the next; ends at the lower bound of bins, after
    `patience` bins in a row that stay as they are, or after `steps` steps."""
    search, stuck = _Search(sizes, bins, capacity), set()
    least, left = -(-sum(sizes) // capacity), len(bins)
    while left > least and len(stuck) < patience and steps > 0:
        e = min(search.open - stuck, key=lambda b: (search.fill[b], b), default=None)
        if e is None:
            break
        steps -= 1
        if not search.step(e):
            stuck.add(e)
        elif not search.bins[e]:
            left -= 1
            stuck.clear()
    return [b for b in search.bins if b]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def id_encoder(path: str | None = None) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit numbers, as the tokenizer of the file gives them.

    The vocabulary is read by `tokenizers` from its file. Its numbers are the order of its merges, so the ids come
    from the same vocabulary as ranks, which takes half the time; an added token in the text is one id, as with the
    tokenizer. Tests hold the ids against the tokenizer's own.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer, byte = Tokenizer.from_file(path or tokenizer_path()), byte_of_char()
    added = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}
    ranks = {bytes(byte[c] for c in piece): k for piece, k in tokenizer.get_vocab().items() if piece not in added}
    encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> bytes:
        return np.asarray(encoding.encode(text, allowed_special="all"), "<u4").tobytes()

    return encode


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones from the end, what is left over comes first."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def _pieces_of(batches: Iterator[pa.RecordBatch], capacity: int, end: int, tokenizer: str | None) -> Iterator[tuple]:
    """doc_id, piece, start, length, ids_crc32 of every piece of batches(doc_id, text)."""
    encode, mark = id_encoder(tokenizer), np.asarray([end], "<u4").tobytes()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = encode(text) + mark
            for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                yield doc_id, k, start, length, crc32(ids[4 * start : 4 * (start + length)])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True)


def pack_rows(rows: DataFrame, pieces: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], capacity: int, chunk: int, number: int, last: bool) -> DataFrame:
    """The pieces that `pieces` makes of rows, with sequence_id, offset and waiting: packed partition by partition, `chunk` at a time.

    A chunk's emptiest bins go on to the next chunk; those of the last chunk, unless `last`, are marked as waiting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = (number << 58) + (TaskContext.get().partitionId() << 38)
        pending: list[tuple] = []

        def flush(ending: bool) -> pa.RecordBatch:
            nonlocal pending, next_id
            sizes = [p[3] for p in pending]
            bins = improve(sizes, best_fit(sizes, capacity), capacity)
            bins.sort(key=lambda b: -sum(sizes[i] for i in b))
            keep: list[int] = []
            while not (ending and last) and bins and sum(sizes[i] for i in bins[-1]) < capacity and len(keep) + len(bins[-1]) <= chunk // KEPT:
                keep += bins.pop()
            rows = []
            for b in bins:
                offset = 0
                for i in b:
                    rows.append((*pending[i], next_id, offset, False))
                    offset += sizes[i]
                next_id += 1
            if ending:
                rows += [(*pending[i], None, None, True) for i in keep]
            pending = [pending[i] for i in keep]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, types, strict=True)], names)

        for row in pieces(batches):
            pending.append(row)
            if len(pending) >= chunk:
                yield flush(False)
        if pending:
            yield flush(True)

    names = [*_NAMES, "sequence_id", "offset", "waiting"]
    types = [*_TYPES, pa.int64(), pa.int64(), pa.bool_()]
    return rows.mapInArrow(run, _PIECE + ", sequence_id long, offset long, waiting boolean")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs.

    Each partition packs its rows as they come, `chunk` pieces at a time, without a shuffle and in bounded memory, so
    rows that stand together (such as a mixture) stay together. The pieces of its emptiest bins, a bounded number,
    are packed anew with those of other partitions, FAN partitions in a task, until one task is left: underfull
    bins don't add up with partitions. The search of each chunk ends as `improve` says.

    sequence_id differs between runs if the input's order does. Null and empty texts become the end id alone.
    Repeated rows and null doc_ids are packed like any other row; an empty table gives no sequences; other columns
    are ignored. A text in which an added token of the vocabulary is written out holds its id, as the tokenizer has it.
    """
    packed = saved(pack_rows(id_and_text(docs), lambda batches: _pieces_of(batches, capacity, end, tokenizer), capacity, chunk, 0, False), "packed")
    done, number = packed.where("not waiting"), 1
    waiting = packed.where("waiting")
    while (left := waiting.count()) > 0:
        tasks = -(-left // (FAN * chunk // KEPT))
        again = waiting.select(*_NAMES).repartition(tasks, "doc_id", "piece", "ids_crc32")
        packed = saved(pack_rows(again, _rows_of, capacity, chunk, number, tasks == 1), "packed")
        done, waiting, number = done.unionByName(packed.where("not waiting")), packed.where("waiting"), number + 1
        if tasks == 1:
            break
    return done.select(*_NAMES, "sequence_id", "offset")
