"""Quality classifier: averaged word and character n-gram vectors, softmax output, trained by gradient descent."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, small_batches

BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 17, 16, 3, 5
#: Weights are kept as whole numbers of this fraction.
FIXED = 1 << 24
#: Training rows of each class at most; the fit is the one thing here that doesn't cover all data.
ROWS_PER_CLASS = 1000
EPOCHS, STEP = 6, 25.0
_CHARS = 1 << 18
_GAP = re.compile(r"[ \n]")
_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])
_KEYS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_PLACES = np.random.default_rng(17).integers(0, 2**31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint32(15)) ^ np.uint32(kind * 0x3C6EF3)) * np.uint32(0x2C1B3C6D)
    return (mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS)


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(text number, part) of all texts in groups of about _CHARS characters; long texts are cut at spaces."""
    group, held = [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            gap = _GAP.search(text, at + _CHARS) if len(text) - at > _CHARS else None
            end = gap.start() if gap else len(text)
            group.append((k, text[at:end]))
            held += end - at
            at = end
            if held >= _CHARS:
                yield group
                group, held = [], 0
            if not gap:
                break
    if group:
        yield group


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, text numbers, side) of all features of all texts, kind by kind; text numbers don't fall.

    Side 0 are character n-grams of SHORTEST to LONGEST within a word and the spaces around it. Side 1 are word
    n-grams: words, pairs of words, and the pattern of every three words, which says which of them are equal.
    """
    carry, of = np.zeros(0, np.uint32), -1
    for group in _pieces(texts):
        joined = np.frombuffer((" " + "  ".join(t for _, t in group) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        space = _SPACES[np.minimum(joined, 0x3001)]
        chars = np.where(space, np.uint32(32), joined)
        text_of = np.repeat(np.array([k for k, _ in group], np.int32), [len(t) + 2 for _, t in group])
        whole = np.ones(len(chars) - 1, bool)
        hashes = chars * _KEYS[0]
        for n in range(2, LONGEST + 1):
            if len(hashes) < 2:
                break
            hashes = hashes[:-1] + chars[n - 1 :] * _KEYS[n - 1]
            if n >= SHORTEST:
                whole = whole[: len(hashes)] & ~space[n - 2 : n - 2 + len(hashes)]
                at = np.flatnonzero(whole)
                yield _buckets(hashes[at], n), text_of[at], 0
        inside = np.flatnonzero(~space)
        if not len(inside):
            continue
        first = np.ones(len(inside), bool)
        first[1:] = np.diff(inside) > 1
        at = np.flatnonzero(first)
        lengths = np.diff(np.append(at, len(inside)))
        place = np.arange(len(inside)) - np.repeat(at, lengths)
        words = np.add.reduceat(chars[inside] * _PLACES[place & 1023], at, dtype=np.uint32) + lengths.astype(np.uint32)
        texts_of = text_of[inside[at]]
        yield _buckets(words, 1), texts_of, 1
        # The last two words of a text that goes on in the next piece stand before it.
        before = carry if of == texts_of[0] else carry[:0]
        words, texts_of = np.concatenate((before, words)), np.concatenate((np.full(len(before), texts_of[0], np.int32), texts_of))
        same = texts_of[1:] == texts_of[:-1]
        pair = same.copy()
        if len(before) == 2:
            pair[0] = False
        two = np.flatnonzero(pair)
        yield _buckets(words[two] * np.uint32(0x9E3779B1) + words[two + 1], 7), texts_of[two], 1
        three = np.flatnonzero(same[1:] & same[:-1])
        a, b, c = words[three], words[three + 1], words[three + 2]
        yield _buckets((a == b) + 2 * (b == c) + np.uint32(4) * (a == c), 9), texts_of[three], 1
        last = texts_of == texts_of[-1]
        carry, of = words[last][-2:], texts_of[-1]


def log_odds(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Half the mean weight of each text's character n-grams and half that of its word n-grams, 0 without any.

    Whole-number weights make equal texts exactly equal.
    """
    total, count = np.zeros((2, len(texts)), np.int64), np.zeros((2, len(texts)), np.int64)
    for buckets, text, side in features(texts):
        cut = np.flatnonzero(np.diff(text, prepend=-1))
        if len(cut):
            total[side, text[cut]] += np.add.reduceat(weights[buckets], cut)
            count[side, text[cut]] += np.diff(np.append(cut, len(text)))
    return (total / np.maximum(count, 1)).sum(axis=0) / 2 / FIXED


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], prior: float, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, step: float = STEP, seed: int = 7) -> tuple[np.ndarray, float]:
    """The weight of each bucket and the bias, from samples (label, bucket numbers, shares of the document's average).

    Embeddings and the softmax layer are learned by stochastic gradient descent on the cross-entropy, a sample at a
    time, with a falling step; the softmax layer's is `step` / 100. As a document is the mean of its vectors, its
    log-odds are the mean of one number per bucket: those are returned.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    output, bias = random.normal(0, 0.1, (width, 2)).astype(np.float32), np.zeros(2, np.float32)
    total, done = epochs * max(1, len(samples)), 0
    for _ in range(epochs):
        for k in random.permutation(len(samples)):
            label, at, share = samples[k]
            rate = np.float32(step * (1 - done / total))
            done += 1
            hidden = share @ vectors[at]
            logits = hidden @ output + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = output @ error
            output -= rate / 100 * np.outer(hidden, error)
            bias -= rate / 100 * error
            vectors[at] -= np.outer(rate * share, back)
    weights = vectors @ (output[:, 1] - output[:, 0])
    return np.round(weights.astype(np.float64) * FIXED).astype(np.int64), float(bias[1] - bias[0]) + prior


def sample_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label, text of at most rows_per_class documents of each class, those of the smallest hash of doc_id, and the classes' sizes."""
    one = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    there = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    chosen = [one.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for c in (0, 1)]
    # At most 2 * rows_per_class rows are broadcast. Of rows that repeat a doc_id one text is learned from.
    rows = id_and_text(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), there


def shares_of(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text its buckets and the weight of each in the document's average."""
    at, shares = [], []
    for k in range(0, len(texts), 16):
        table = np.zeros((2, min(16, len(texts) - k), BUCKETS), np.float32)
        for buckets, text, side in features(texts[k : k + 16]):
            np.add.at(table[side], (text, buckets), 1)
        share = (table / np.maximum(table.sum(axis=2, keepdims=True), 1) / 2).sum(axis=0)
        at += [np.flatnonzero(row).astype(np.int32) for row in share]
        shares += [row[a] for row, a in zip(share, at[k:], strict=True)]
    return at, shares


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, float]:
    """Weights and bias learned from labels(doc_id, quality) of rows that aren't held out.

    Features are computed on the executors, so the driver gets 2 * rows_per_class sparse vectors at most. The bias
    is set back to the true class shares. Null labels don't count; of repeated labels of a document the smallest
    does. With fewer than two classes the score is the share of the label 1 (one half without any).
    """
    sample, there = sample_rows(docs, labels, rows_per_class)
    if len(there) < 2:
        return np.zeros(BUCKETS, np.int64), {(): 0.0, (0,): -5.0, (1,): 5.0}[tuple(there)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", _CHARS):
            at, shares = shares_of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["doc_id", "label", "at", "shares"])

    sample = sample.mapInArrow(run, "doc_id long, label int, at array<int>, shares array<float>").toArrow()
    sample = sample.sort_by([("doc_id", "ascending")])
    rows = [(label, np.asarray(at.values), np.asarray(share.values)) for label, at, share in zip(sample["label"].to_pylist(), _lists(sample["at"]), _lists(sample["shares"]), strict=True)]
    seen = np.bincount([r[0] for r in rows], minlength=2) + 1
    prior = np.log((there[1] + 1) / seen[1]) - np.log((there[0] + 1) / seen[0])
    return train(rows, float(prior))


def _lists(column: pa.ChunkedArray) -> list[pa.ListScalar]:
    return [x for chunk in column.chunks for x in chunk]


def scorer(docs: DataFrame, weights: np.ndarray, bias: float):
    """A function of a text column: its score, the softmax share of the label 1, over the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def score(series: pd.Series) -> pd.Series:
        weights, bias = sent.value

        odds, group, held = [], [], 0
        for text in series:
            group.append(text or "")
            held += len(group[-1])
            if held >= _CHARS:
                odds.append(log_odds(group, weights))
                group, held = [], 0
        odds.append(log_odds(group, weights) if group else np.zeros(0))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(odds) + bias, -500, 500))))

    return F.pandas_udf(score, "double")


def quality_scores(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    The score depends on the text alone: equal texts get equal scores, empty and null texts the bias alone.
    Rows with a null doc_id are scored and not held out; repeated rows are scored each; other columns are ignored.
    An empty table gives an empty result; without labels all scores are one half.
    """
    score = scorer(docs, *fit(docs, labels, rows_per_class))
    rows = id_and_text(docs).select("doc_id", score("text").alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least one half.

    Null and empty texts have the bias as their score, and all of them stay or go with it; rows with a null doc_id
    and repeated rows are judged each, clashing columns pass through, and an empty table stays empty.
    """
    score = scorer(docs, *fit(docs, labels, rows_per_class))
    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) >= 0.5)
