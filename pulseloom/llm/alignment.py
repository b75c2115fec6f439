"""Alignment of two tokenizers' tokens by merge-path partitioning.

The ends of a text's A tokens and of its B tokens are two rising lists. Diagonals of their merge, found by binary
search, cut the merge into pieces of equal work; a piece knows where its first tokens begin and which tokens follow,
so it finds its overlaps by itself, in whatever task it lies. What a piece leaves open at its borders is stitched
into groups afterwards. Pieces of short texts are the whole text and need no stitching.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, new_path, saved, small_batches
from .packing import byte_of_char, tokenizer_path

#: Ends of tokens in a piece; a longer text has several pieces.
PIECE = 32768
#: Pairs of ids whose counts are broadcast in a round (16 bytes each); more take several rounds.
PAIRS = 4 << 20
#: Characters of a text that are encoded at once, and bytes of pieces that are aligned at once.
_CHARS, _BYTES = 1 << 18, 1 << 21
_TENS = np.array([0, 10, 100, 1000, 10000])
#: A single space between two characters that aren't white space: both vocabularies begin a token there.
_GAP = re.compile(r"(?<=\S) (?=\S)")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, a: str, b: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        byte, tokenizer = byte_of_char(), Tokenizer.from_file(a)
        added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in piece): k for piece, k in tokenizer.get_vocab().items() if piece not in added}
        self.a = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, k in ranks.items():
            self.a_bytes[k] = piece
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        #: Whether no piece goes on after a word with white space, so that texts can be encoded word by word.
        self.cuts = all(re.fullmatch("▁*[^▁]*", p) for p in pieces)
        self.lengths = [np.array([len(x) for x in c], np.int64) for c in (self.a_bytes, self.b_bytes)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a space and the text in A, and of the text in B (which adds the space); None if either doesn't give its bytes back.

        A long text is encoded in parts, cut where both begin a token.
        """
        a, b, at, whole = array("H"), array("H"), 0, " " + text
        while at < len(whole):
            gap = _GAP.search(whole, at + _CHARS) if self.cuts and len(whole) - at > _CHARS else None
            end = gap.start() if gap else len(whole)
            part = whole[at:end]
            raw = part.encode()
            one, two = self.a.encode_ordinary(part), self.b.encode(part[1:], out_type=int)
            if b"".join(map(self.a_bytes.__getitem__, one)) != raw or b"".join(map(self.b_bytes.__getitem__, two)) != raw:
                return None
            a.extend(one)
            b.extend(two)
            at = end
        return np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def merge_path(a: np.ndarray, b: np.ndarray, step: int) -> list[tuple[int, int]]:
    """Where each `step`-th diagonal of the merge of two rising lists lies: so many of a and so many of b come before.

    All diagonals are searched at once; equal ends stay in one piece.
    """
    d = np.arange(step, len(a) + len(b), step)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(d), bool)
        first[open_] = a[middle[open_]] <= b[(d - middle - 1)[open_]]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    i, j = low, d - low
    inside = (i > 0) & (j < len(b))
    j[inside] += a[i[inside] - 1] == b[j[inside]]
    return [(0, 0), *zip(i.tolist(), j.tolist(), strict=True), (len(a), len(b))]


_PIECES = "row long, doc_id long, piece int, pieces int, a binary, b binary, a_start long, b_start long, a_next int, b_next int"


def pieces_of(docs: DataFrame, step: int = PIECE, a: str | None = None, b: str | None = None) -> DataFrame:
    """The pieces of every row of docs: ids of the A and B tokens that end there, where the first of each begin, and the ids that follow (or -1).

    A text without tokens is one piece without ids.
    """
    paths = (a or tokenizer_path(), b or piece_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*paths)
        a_length, b_length = both.lengths
        for batch in small_batches(batches, "text", 1 << 20):
            rows: list[tuple] = []
            for row, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "text")], strict=True):
                ids = both.encode(text) if text else None
                if ids is None:
                    rows.append((row, doc_id, 0, 1, b"", b"", 0, 0, -1, -1))
                    continue
                a_ends, b_ends = np.cumsum(a_length[ids[0]]), np.cumsum(b_length[ids[1]])
                cuts = merge_path(a_ends, b_ends, step)
                for k, ((i, j), (m, n)) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    starts = (int(a_ends[i - 1]) if i else 0, int(b_ends[j - 1]) if j else 0)
                    after = (int(ids[0][m]) if m < len(ids[0]) else -1, int(ids[1][n]) if n < len(ids[1]) else -1)
                    rows.append((row, doc_id, k, len(cuts) - 1, ids[0][i:m].tobytes(), ids[1][j:n].tobytes(), *starts, *after))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 10, types, strict=True)], [f.split()[0] for f in _PIECES.split(", ")])

    made = id_and_text(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, _PIECES)
    path = new_path(docs.sparkSession, "pieces")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


class Aligned:
    """The overlaps and groups of some pieces that are aligned at once.

    The pieces lie one behind the other, each followed by a mark of both sides that ends where nothing else does: the
    tokens that follow the piece stand there, and it closes what the piece leaves open.
    """

    def __init__(self, batch: pa.RecordBatch, a_length: np.ndarray, b_length: np.ndarray) -> None:
        a, b = ([np.frombuffer(x, np.uint16) for x in batch.column(c).to_pylist()] for c in ("a", "b"))
        starts = [batch.column(c).to_numpy() for c in ("a_start", "b_start")]
        nexts = [np.maximum(batch.column(c).to_numpy(), 0).astype(np.uint16) for c in ("a_next", "b_next")]
        self.pieces = batch.num_rows
        #: Of both sides: ids, begin (of each piece), ends, piece.
        self.ids, self.begin, lengths = [], [], []
        for own, after in zip((a, b), nexts, strict=True):
            self.begin.append(np.concatenate(([0], np.cumsum([len(x) + 1 for x in own]))))
            ids = np.empty(self.begin[-1][-1], np.uint16)
            for k, x in enumerate(own):
                ids[self.begin[-1][k] : self.begin[-1][k + 1] - 1] = x
                ids[self.begin[-1][k + 1] - 1] = after[k]
            self.ids.append(ids)
        for ids, begin, table in zip(self.ids, self.begin, (a_length, b_length), strict=True):
            length = table[ids]
            length[begin[1:] - 1] = 0
            lengths.append(length)
        sums = [np.concatenate(([0], np.cumsum(length))) for length in lengths]
        origin = np.minimum(*starts)
        last = [start + total[begin[1:]] - total[begin[:-1]] for start, total, begin in zip(starts, sums, self.begin, strict=True)]
        base = np.concatenate(([0], np.cumsum(np.maximum(*last) - origin + 2)))
        self.ends = []
        for start, total, begin in zip(starts, sums, self.begin, strict=True):
            ends = total[1:] + np.repeat(base[:-1] + start - origin - total[begin[:-1]], np.diff(begin))
            ends[begin[1:] - 1] = base[1:] - 1
            self.ends.append(ends)
        # For each end of one side the token of the other that covers it, and whether both end there.
        self.cover = [np.searchsorted(self.ends[1 - s], self.ends[s]) for s in (0, 1)]
        self.common = [self.ends[1 - s][self.cover[s]] == self.ends[s] for s in (0, 1)]
        self.real = []
        for begin in self.begin:
            real = np.ones(begin[-1], bool)
            real[begin[1:] - 1] = False
            self.real.append(real)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups of each piece."""
        groups = np.add.reduceat(self.common[0] & self.real[0], self.begin[0][:-1]) if self.pieces else np.zeros(0, np.int64)
        return np.diff(self.begin[0]) - 1, np.diff(self.begin[1]) - 1, groups

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (A id << 16 | B id) of all overlaps, piece by piece, and where each piece's begin.

        Every end of a token ends exactly one overlap.
        """
        one, two = self.real[0], self.real[1] & ~self.common[1]
        pairs = np.concatenate((self.ids[0][one].astype(np.uint32) << 16 | self.ids[1][self.cover[0][one]], self.ids[0][self.cover[1][two]].astype(np.uint32) << 16 | self.ids[1][two]))
        piece = np.concatenate([np.repeat(np.arange(self.pieces, dtype=np.int64), np.diff(self.begin[s]))[x] for s, x in ((0, one), (1, two))])
        keys = np.sort(piece << 32 | pairs)
        return (keys & 0xFFFFFFFF).astype(np.uint32), np.searchsorted(keys, np.arange(self.pieces + 1, dtype=np.int64) << 32)

    def texts(self, names: list[np.ndarray]) -> list[bytes]:
        """The groups of each piece as `a1,a2|b1;a3|b2,b3;`, from tables of numbers by mark and id; what is open at its end has commas only."""
        group = [np.cumsum(c) - c for c in self.common]
        total = int(group[0][-1]) + 1 if len(group[0]) else 0
        sizes = [np.bincount(g, minlength=total) for g in group]
        before = [np.concatenate(([0], np.cumsum(s))) for s in sizes]
        out = np.zeros(len(self.ids[0]) + len(self.ids[1]), "S6")
        place = [np.arange(len(self.ids[0])) + before[1][group[0]], np.arange(len(self.ids[1])) + before[0][group[1] + 1]]
        for s, mark in ((0, 1), (1, 2)):
            out[place[s]] = np.where(self.real[s], names[0][self.ids[s]], b"")
            last = self.common[s] & self.real[s]
            out[place[s][last]] = names[mark][self.ids[s][last]]
        long = np.zeros(len(out), np.int64)
        for s in (0, 1):
            long[place[s][self.real[s]]] = 1 + np.searchsorted(_TENS, self.ids[s][self.real[s]], "right")
        cuts = np.concatenate(([0], np.cumsum(long)))[self.begin[0] + self.begin[1]]
        text = out.tobytes().translate(None, b"\0")
        return [text[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def fragments(self, names: list[np.ndarray]) -> list[tuple[bool, str, str, str, str, str]]:
        """Of each piece: whether a group ends there, the ids of both sides up to its first common end, the groups after it, and the ids after the last one."""
        out = []
        for k, text in enumerate(self.texts(names)):
            tail = []
            for s in (0, 1):
                x, y = self.begin[s][k], self.begin[s][k + 1] - 1
                ends = np.flatnonzero(self.common[s][x:y])
                tail.append(",".join(map(str, self.ids[s][x + ends[-1] + 1 if len(ends) else x : y].tolist())))
            first, last = text.find(b";"), text.rfind(b";")
            if first < 0:
                out.append((False, *tail, "", "", ""))
            else:
                out.append((True, *text[:first].decode().split("|"), text[first + 1 : max(last, first + 1)].decode(), *tail))
        return out


def number_names(count: int) -> list[np.ndarray]:
    """For each mark (between ids of a side, between the sides, between groups) the ids as text with the mark behind."""
    return [np.array([f"{k}{mark}".encode() for k in range(count)], "S6") for mark in ",|;"]


def _in_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to some MB of ids."""
    for batch in batches:
        size = np.cumsum([len(a) + len(b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)])
        cuts = [0, *(np.flatnonzero(np.diff(size // _BYTES)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                yield batch.slice(i, j - i)


def pair_counts(pieces: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """pair, n, best: in how many rows each pair is linked, and whether that is the most of its A id."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, waiting, held = tokenizers(*paths).lengths, [], 0
        pairs, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def merge() -> None:
            nonlocal pairs, counts, waiting, held
            new, times = np.unique(np.concatenate(waiting), return_counts=True)
            pairs, at = np.unique(np.concatenate((pairs, new)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, times)), len(pairs)).astype(np.int64)
            waiting, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], ["pair", "n"])

        for batch in _in_portions(batches):
            found, begin = Aligned(batch, *lengths).links()
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            new[begin[:-1][begin[:-1] < len(found)]] = True
            waiting.append(found[new])
            held += int(new.sum())
            if held > PAIRS:
                merge()
                if len(pairs) > PAIRS:
                    yield out()
                    pairs, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if waiting:
            merge()
        yield out()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = tokenizers(*paths).lengths
        for batch in _in_portions(batches):
            found, begin = Aligned(batch, *lengths).links()
            row = np.repeat(batch.column("row").to_numpy(), np.diff(begin))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(found.astype(np.int64))], ["row", "pair"])

    # A text in one piece is counted where it lies; of texts in several pieces each pair counts once.
    short = pieces.where("pieces = 1").mapInArrow(whole, "pair long, n long")
    long = pieces.where("pieces > 1").mapInArrow(cut, "row long, pair long").distinct().select("pair", F.lit(1).cast("long").alias("n"))
    counts = saved(short.unionByName(long).groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    most = counts.groupBy(F.shiftright("pair", 16).alias("id")).agg(F.max("n").alias("most"))
    met = counts.withColumn("id", F.shiftright("pair", 16)).join(most, "id")
    return saved(met.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


_OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _scored(pieces: DataFrame, paths: tuple[str, str], sent, whole: bool, first: bool) -> DataFrame:
    """Pieces with their numbers, by the counts that were sent; whole texts with their digest, others with what stitching needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = tokenizers(*paths).lengths
        pairs, counts, best = sent.value
        names = number_names(max(len(x) for x in lengths))
        for batch in _in_portions(batches):
            aligned = Aligned(batch, *lengths)
            found, begin = aligned.links()
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            at = np.flatnonzero(new)
            here = np.minimum(np.searchsorted(pairs, found[at]), max(0, len(pairs) - 1))
            known = pairs[here] == found[at] if len(pairs) else np.zeros(len(at), bool)
            times = np.diff(np.append(at, len(found)))
            total = np.concatenate(([0], np.cumsum(np.repeat(np.where(known, counts[here], 0) if len(pairs) else np.zeros(len(at), np.int64), times))))
            tops = np.concatenate(([0], np.cumsum(np.repeat(known & best[here] if len(pairs) else known, times))))
            n_a, n_b, n_groups = aligned.counts()
            numbers = [n_a, n_b, n_groups, np.diff(begin), np.diff(tops[begin]), np.diff(total[begin])]
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("piece"), *(pa.array(x.astype(np.int64)) for x in numbers)]
            if whole and first:
                columns.append(pa.array([hashlib.sha256(t[:-1]).hexdigest() if t else "" for t in aligned.texts(names)], pa.string()))
            elif first:
                columns += [pa.array(c, t) for c, t in zip(zip(*aligned.fragments(names), strict=True), [pa.bool_(), *[pa.string()] * 5], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "piece", *_OUT, *extra])

    extra = ([] if not first else ["groups_sha256"] if whole else ["closed", "head_a", "head_b", "inner", "tail_a", "tail_b"])
    kinds = ["boolean" if c == "closed" else "string" for c in extra]
    schema = "row long, doc_id long, piece int, " + ", ".join(f"{c} long" for c in _OUT) + "".join(f", {c} {t}" for c, t in zip(extra, kinds, strict=True))
    return pieces.where("pieces = 1" if whole else "pieces > 1").mapInArrow(run, schema)


def stitched(parts: DataFrame) -> DataFrame:
    """One row for each row of several pieces: their sums, and the digest of the groups, of which those across borders are put together.

    The pieces of a row come in order to one task, which holds what is open and a running digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, doc_id, sums, digest, some, open_ = None, None, [], None, False, ([], [])

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [*[pa.int64()] * 8, pa.string()], strict=True)], ["row", "doc_id", *_OUT, "groups_sha256"])

        for batch in batches:
            done = []
            for own, doc, *numbers, closed, head_a, head_b, inner, tail_a, tail_b in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", *_OUT, "closed", "head_a", "head_b", "inner", "tail_a", "tail_b")], strict=True):
                if own != row:
                    if row is not None:
                        done.append((row, doc_id, *sums, digest.hexdigest()))
                    row, doc_id, sums, digest, some, open_ = own, doc, [0] * len(_OUT), hashlib.sha256(), False, ([], [])
                sums = [x + y for x, y in zip(sums, numbers, strict=True)]
                for side, head in zip(open_, (head_a, head_b), strict=True):
                    side.extend([head] if head else [])
                if closed:
                    digest.update(((";" if some else "") + ",".join(open_[0]) + "|" + ",".join(open_[1]) + (";" + inner if inner else "")).encode())
                    some, open_ = True, ([tail_a] if tail_a else [], [tail_b] if tail_b else [])
            if done:
                yield out(done)
        if row is not None:
            yield out([(row, doc_id, *sums, digest.hexdigest())])

    schema = "row long, doc_id long, " + ", ".join(f"{c} long" for c in _OUT) + ", groups_sha256 string"
    return parts.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(run, schema)


def aligned_tokens(docs: DataFrame, step: int = PIECE, pairs: int = PAIRS, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    A encodes a space and the text by a byte-level vocabulary, B the text by a piece model that adds the space; the
    strings of special tokens in a text are plain text. Byte offsets at which tokens of both end cut them into
    groups; an A and a B token whose bytes overlap are linked. An id pair counts in as many rows as hold it linked:
    n_best are the links whose pair has the most of its A id, count_sum the sum over all links. The digest is over
    `a1,a2|b1;a3|b2,b3`, the ids of all groups in order.

    Texts are encoded once; ids (16 bits each) are written, and read twice: to count pairs, and to score with the
    counts, which are broadcast in rounds of at most about `pairs`. Only texts of several pieces are shuffled.

    Null and empty texts, and those whose tokens in A or B don't give the bytes of a space and the text back, have no
    tokens: zeros and an empty digest. Rows with a null or repeated doc_id are rows of their own, and each counts. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    paths = (a or tokenizer_path(), b or piece_path())
    pieces = pieces_of(docs, step, *paths)
    known = pair_counts(pieces, paths)
    rounds = max(1, -(-known.count() // pairs))
    placed = known.withColumn("place", F.pmod(F.xxhash64("pair"), F.lit(rounds)))
    more = None
    for number in range(rounds):
        mine = placed.where(F.col("place") == number).orderBy("pair").select("pair", "n", "best").toArrow()
        sent = spark.sparkContext.broadcast((mine["pair"].to_numpy().astype(np.uint32), mine["n"].to_numpy(), mine["best"].to_numpy(zero_copy_only=False)))
        short, long = (_scored(pieces, paths, sent, whole, number == 0) for whole in (True, False))
        if number == 0:
            out = short.drop("piece").unionByName(stitched(long).select(*short.drop("piece").columns))
        else:
            part = saved(short.unionByName(long).groupBy("row").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum")), "round")
            more = part if more is None else more.unionByName(part)
    if more is not None:
        added = more.groupBy("row").agg(F.sum("more_best").alias("more_best"), F.sum("more_sum").alias("more_sum"))
        out = out.join(added, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return out.select("doc_id", *_OUT, "groups_sha256")
