"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Labelled documents, a bounded sample of each class, are the examples. Their terms are words and beginnings of words;
those that go with the label are kept, weighted by their rarity in all documents, and indexed by term, in blocks of
examples with the largest weight of each term and block. A document visits blocks by falling bounds until none can
hold one of its nearest examples. The votes of these, weighted by similarity, are calibrated to a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, saved, small_batches
from .quality import held_out
from .terms import counted, term_lists

#: Examples of each label at most (those of the smallest hash of doc_id), and terms of the index at most; the fit is the one thing here that doesn't cover all data.
TOXIC_ROWS, CLEAN_ROWS, TERMS = 3000, 6000, 1 << 16
#: Nearest examples that vote, and examples of a block.
NEAREST, BLOCK = 31, 64
#: Beginnings of words in bytes, and in how many examples a term must occur.
SHORTEST, LONGEST, LEAST = 4, 9, 3
#: A term is kept if its share of toxic examples surely (lower bound at 1.96 standard errors) lies above this.
SHARE = 0.5
PREDICTED = 0.7
#: Terms whose examples are counted before a task passes them on.
_HELD = 200_000
_START = b"\x00"


def document_terms(counts: Counter) -> Counter:
    """Terms of a document from its words' counts: the words, and after a mark their beginnings."""
    out = Counter(counts)
    for word, n in counts.items():
        for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
            out[_START + word[:k]] += n
    return out


class Terms:
    """The chosen terms, and what a document has of them."""

    def __init__(self, terms: list[bytes]) -> None:
        self.index = {t: k for k, t in enumerate(terms)}
        self.words = frozenset(t for t in terms if t[:1] != _START)
        self.starts = {t[1:]: k for t, k in self.index.items() if t[:1] == _START}
        #: By these a word that begins no term is told at once.
        self.first = frozenset(t[:SHORTEST] for t in self.starts)

    def of(self, text: str | None) -> dict[int, int]:
        """{number of a term: its occurrences in the whole text}."""
        out: dict[int, int] = {}
        for part in term_lists(text):
            counts = Counter(part)
            for word in self.words & counts.keys():
                out[self.index[word]] = out.get(self.index[word], 0) + counts[word]
            for word, n in counts.items():
                if word[:SHORTEST] in self.first:
                    for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
                        at = self.starts.get(word[:k])
                        if at is not None:
                            out[at] = out.get(at, 0) + n
        return dict(sorted(out.items()))


class BlockMax:
    """An inverted index over examples: for each term the blocks that hold it, with its largest weight there, and its postings by block."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK) -> None:
        """rows: for each example its terms and their weights (a vector of length 1)."""
        self.block, self.examples = block, len(rows)
        sizes = [len(r[0]) for r in rows]
        term = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
        example = np.repeat(np.arange(len(rows)), sizes)
        order = np.lexsort((example, term))
        term, self.weight, self.example = term[order], weight[order], example[order]
        key = term * (-(-len(rows) // block) or 1) + self.example // block
        first = np.flatnonzero(np.diff(key, prepend=-1))
        #: Of each pair of a term and a block that has it: the block, the largest weight, and where its postings begin.
        self.blocks, self.begin = self.example[first] // block, np.append(first, len(key))
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.of_term = np.searchsorted(term[first], np.arange(terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """The k examples of largest cosine above 0 with a vector of length 1 (ties to the smaller number; `without` is left out), their cosines, and how many blocks were scored."""
        spans = [np.arange(self.of_term[t], self.of_term[t + 1]) for t in terms.tolist()]
        entries = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        if not len(entries):
            return np.zeros(0, np.int64), np.zeros(0), 0
        ours = np.repeat(weights, [len(s) for s in spans])
        bounds = np.zeros(-(-self.examples // self.block))
        np.add.at(bounds, self.blocks[entries], ours * self.most[entries])
        # Entries in the order of their blocks' bounds; within a block in the order of terms, so equal vectors add up alike.
        by_bound = np.argsort(-bounds, kind="stable")
        by_bound = by_bound[bounds[by_bound] > 0]
        rank = np.empty(len(bounds), np.int64)
        rank[by_bound] = np.arange(len(by_bound))
        sort = np.argsort(rank[self.blocks[entries]], kind="stable")
        entries, ours = entries[sort], ours[sort]
        cuts = np.searchsorted(rank[self.blocks[entries]], np.arange(len(by_bound) + 1))
        found, scores, visited = np.zeros(0, np.int64), np.zeros(0), 0
        at, take = 0, max(1, -(-k // self.block))
        while at < len(by_bound):
            # A bound and a cosine are sums in different order: what they round off must not part them.
            if len(scores) == k and bounds[by_bound[at]] * (1 + 1e-9) < scores[-1]:
                break
            upto = min(len(by_bound), at + take)
            part = entries[cuts[at] : cuts[upto]]
            many = self.begin[part + 1] - self.begin[part]
            ends = np.cumsum(many)
            place = np.arange(ends[-1]) - np.repeat(ends - many, many) + np.repeat(self.begin[part], many)
            some, back = np.unique(self.example[place], return_inverse=True)
            # bincount adds in the order of what it gets: term by term for each example.
            new = np.bincount(back, np.repeat(ours[cuts[at] : cuts[upto]], many) * self.weight[place], len(some))
            keep = some != without
            found, scores = np.concatenate((found, some[keep])), np.concatenate((scores, new[keep]))
            best = np.lexsort((found, -scores))[:k]
            found, scores, visited = found[best], scores[best], visited + upto - at
            at, take = upto, 2 * take
        return found, scores, visited


class Model:
    """Terms, their weights, the examples' index with labels, and the calibration."""

    def __init__(self, terms: list[bytes], rarity: np.ndarray, rows: list[tuple[int, int, dict[int, int]]], mass: tuple[float, float], nearest: int = NEAREST, block: int = BLOCK) -> None:
        """rows: (doc_id, label, {term: occurrences}) of the examples; mass: how many labelled rows an example of each label stands for."""
        self.terms, self.rarity, self.k, self.mass = terms, rarity, nearest, mass
        vectors = [(i, y, *self.vector(counts)) for i, y, counts in rows]
        # Examples of one kind lie together, so that blocks are told apart by their largest weights.
        some = sorted((v for v in vectors if v[4]), key=lambda v: (int(v[2][np.argmax(v[3])]), v[1], v[0]))
        self.ids, self.labels = [v[0] for v in some], np.array([v[1] for v in some], np.int64)
        self.index = BlockMax([(v[2], v[3]) for v in some], len(terms), block)
        self._calibrate(some, [v[1] for v in vectors if not v[4]])

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Terms, weights of length 1, and the length before."""
        at = np.array(list(counts), np.int64)
        weights = (1 + np.log(np.array(list(counts.values()), np.float64))) * self.rarity[at]
        length = float(np.sqrt((weights * weights).sum()))
        return at, weights / length if length else weights, length

    def votes(self, at: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The log-odds of the nearest examples' votes, each by the square of its cosine and by what it stands for, these examples, and their cosines."""
        found, cosines, _ = self.index.nearest(at, weights, self.k, without)
        share = cosines**2 * np.array(self.mass)[self.labels[found]]
        bad = float((share * self.labels[found]).sum())
        good = float(share.sum()) - bad
        room = 0.02 * (bad + good) + 1e-9
        return float(np.log(bad + room) - np.log(good + room)), found, cosines

    def _calibrate(self, some: list[tuple], others: list[int]) -> None:
        """Fits score = logistic(a * votes + b * log(1 + length) + c) to the examples, each judged without itself."""
        x = np.array([(self.votes(v[2], v[3], k)[0], np.log1p(v[4]), 1.0) for k, v in enumerate(some)]).reshape(-1, 3)
        y, weight = self.labels.astype(np.float64), np.array(self.mass)[self.labels]
        self.line = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ self.line, -30, 30)))
            slope = x.T @ (weight * (p - y)) + 1e-3 * self.line
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
            self.line = self.line - np.linalg.solve(curve, slope)
        toxic = self.mass[1] * sum(others)
        #: The score of documents that hold no term: the share among the examples without one.
        self.rest = float((toxic + 1) / (toxic + self.mass[0] * (len(others) - sum(others)) + 2))
        self.known = (len(some) + len(others)) > 0

    def score(self, counts: dict[int, int]) -> tuple[float, list[int], list[float]]:
        """The score, and as evidence the doc_ids of the nearest examples that are toxic, with their cosines."""
        at, weights, length = self.vector(counts)
        if not length or not self.ids:
            return (self.rest if self.known else 0.5), [], []
        votes, found, cosines = self.votes(at, weights)
        score = 1 / (1 + np.exp(-np.clip(self.line @ [votes, np.log1p(length), 1.0], -30, 30)))
        toxic = [(self.ids[e], round(float(c), 6)) for e, c in zip(found.tolist(), cosines, strict=True) if self.labels[e]][:5]
        return float(score), [i for i, _ in toxic], [c for _, c in toxic]


def examples_of(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label, text of at most so many examples of each label, and how many labelled rows there are of each."""
    one = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").cast("int").alias("label"))
    there = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    chosen = [one.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((0, clean_rows), (1, toxic_rows))]
    # At most toxic_rows + clean_rows rows are broadcast. Of rows that repeat a doc_id one text is learned from.
    rows = id_and_text(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return saved(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "examples"), there


def choose_terms(examples: DataFrame, mass: tuple[float, float], most: int) -> list[bytes]:
    """The terms of enough examples whose share of toxic ones surely lies above SHARE; if they are too many, the surest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            terms = sorted(held[0].keys() | held[1].keys())
            columns = [pa.array([c[t] for t in terms], pa.int64()) for c in held]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *columns], ["term", "clean", "toxic"])

        for batch in small_batches(batches, "text", 1 << 20):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                held[label].update(document_terms(counted(text)[1]).keys())
                if len(held[0]) + len(held[1]) > _HELD:
                    yield out()
        yield out()

    counts = examples.mapInArrow(run, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    z = 1.96
    n, p = F.col("clean") + F.col("toxic"), F.col("toxic") * mass[1] / (F.col("toxic") * mass[1] + F.col("clean") * mass[0])
    surely = (p + z * z / 2 / n - z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)
    kept = counts.where(F.col("toxic") >= LEAST).withColumn("surely", surely).where(F.col("surely") > SHARE)
    return sorted(bytes(r["term"]) for r in kept.orderBy(F.desc("surely"), "term").limit(most).select("term").collect())


def term_rarity(docs: DataFrame, terms: list[bytes]) -> np.ndarray:
    """ln((N + 1) / (df + 1/2)) of each term over all rows of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(sent.value)
        held, rows = np.zeros(len(sent.value), np.int64), 0
        for batch in small_batches(batches, "text", 1 << 20):
            for text in batch.column("text").to_pylist():
                held[list(known.of(text))] += 1
                rows += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(held[some], rows), pa.int64())], ["term", "n"])

    counts = dict(id_and_text(docs).select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    rows = counts.pop(-1, 0)
    df = np.zeros(len(terms))
    df[list(counts)] = list(counts.values())
    return np.log((rows + 1) / (df + 0.5))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, most_terms: int = TERMS, nearest: int = NEAREST, block: int = BLOCK) -> Model:
    """The model of labels(doc_id, toxic) of rows that aren't held out.

    Texts stay on the executors; the driver gets the chosen terms, and the examples' occurrences of them. Null labels
    don't count; of repeated labels of a document the smallest does.
    """
    examples, there = examples_of(docs, labels, toxic_rows, clean_rows)
    size = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    mass = tuple(there.get(c, 0) / max(1, size.get(c, 0)) or 1.0 for c in (0, 1))
    terms = choose_terms(examples, mass, most_terms)
    rarity = term_rarity(docs, terms)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(sent.value)
        for batch in small_batches(batches, "text", 1 << 20):
            found = [known.of(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *columns], ["doc_id", "label", "at", "n"])

    found = examples.mapInArrow(run, "doc_id long, label int, at array<int>, n array<long>").toArrow().sort_by([("doc_id", "ascending")])
    rows = [(i, y, dict(zip(at, n, strict=True))) for i, y, at, n in zip(*[found[c].to_pylist() for c in ("doc_id", "label", "at", "n")], strict=True)]
    return Model(terms, rarity, rows, mass, nearest, block)


def toxicity_scores(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row of docs.

    evidence lists up to five of the nearest examples that are toxic, with their cosines. The score depends on the
    text alone: equal texts get equal scores. Null and empty texts, and all others without a term of the index, get
    the share of toxic ones among the examples without one. Rows with a null doc_id are scored and not held out;
    repeated rows are scored each; an empty table gives an empty result; without labels all scores are one half;
    other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, toxic_rows, clean_rows))
    kind = "struct<score: double, evidence: array<struct<doc_id: long, cosine: double>>>"

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        known = Terms(model.terms)
        for texts in batches:
            scored = [model.score(known.of(t)) for t in texts]
            evidence = [[{"doc_id": i, "cosine": c} for i, c in zip(ids, cosines, strict=True)] for _, ids, cosines in scored]
            yield pd.DataFrame({"score": [s for s, _, _ in scored], "evidence": evidence})

    rows = id_and_text(docs).select("doc_id", F.pandas_udf(judge, kind)("text").alias("j"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "j.score", (F.col("j.score") >= PREDICTED).cast("int").alias("predicted"), "j.evidence")
