"""Ranked search, alignment of tokenizers and toxicity against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import alignment, lexical_search, queries, terms, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "rank", "number", "row", "piece", "label", "term", "at", "n", "part", "item_id"]


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def words(n, seed=0, vocabulary=300):
    random = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in random.zipf(1.3, n) % vocabulary)


def edge_texts():
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "w1 w2 W3, w1"), (4, "w1 w2 W3, w1"), (None, "w5 w6 é w7"), (5, "É é W1-w2_w3"), (6, "日本語 text ½ w9"), (7, words(40_000, 3)), (8, "a▁b w1"), (9, "</s> <|endoftext|> w2 <unk>"), (10, "x  y   z\n\n w4 "), (11, "w1" * 400)]


# --- ranked search


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(items, docs, k=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found)[:k])]
    return out


def by_row(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("number", F.lit("x"))


@pytest.mark.parametrize("sizes", [{}, {"round_bytes": 60, "round_items": 2}])
def test_search_equals_plain_version(spark, sizes):
    docs = edge_texts() + [(100 + k, words(60 + k, k)) for k in range(60)] + [(200, words(70, 5)), (105, words(65, 5))]
    items = [(1, "w1 w2 w3"), (2, words(30, 77)), (3, None), (4, ""), (5, "absent"), (None, "é 日本語 W9"), (6, "w1 w2 w3"), (1, "w4 w5"), (7, words(5000, 1))]
    got = lexical_search.ranked_search(items_frame(spark, items), documents(spark, docs), **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert by_row(map(tuple, got.collect())) == by_row(plain_search(items, docs))


def test_search_of_empty_tables(spark):
    docs, items = documents(spark, [(1, "w1")]), items_frame(spark, [(1, "w1")])
    assert lexical_search.ranked_search(items, docs.limit(0)).count() == 0
    assert lexical_search.ranked_search(items.limit(0), docs).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.ranked_search(items, docs).collect()] == [(1, 1, 1)]


def test_rounds_are_bounded(spark):
    items = lexical_search.items_with_terms(items_frame(spark, [(k, words(20, k)) for k in range(50)] + [(99, words(3000, 8, 3000))]))
    placed, rounds = lexical_search.in_rounds(items, 400, 8)
    each = placed.groupBy("round").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect()
    assert sum(r["rows"] for r in each) == 51 and len(rounds) > 6
    assert all(r["rows"] == 1 or (r["rows"] <= 16 and r["size"] <= 800) for r in each)


def test_long_texts_are_split_between_terms(monkeypatch):
    text = words(5000, 4) + "É" * 50
    whole = [t for part in terms.term_lists(text) for t in part]
    monkeypatch.setattr(terms, "_PIECE", 100)
    assert [t for part in terms.term_lists(text) for t in part] == whole == [t.encode() for t in plain_terms(text)]
    n, counts = terms.counted(text, frozenset([b"w1", b"none"]))
    assert n == len(whole) and counts == {b"w1": whole.count(b"w1")}


def test_search_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.op11_ranked_lexical_search(spark, small).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["op11_ranked_lexical_search"]).fetchall())


# --- alignment


def plain_alignment(docs):
    both = alignment.Tokenizers(alignment.tokenizer_path(), alignment.piece_path())
    rows, linked = [], Counter()
    for doc, text in docs:
        a = both.a.encode_ordinary(" " + text) if text else []
        b = both.b.encode(text, out_type=int) if text else []
        if text and (b"".join(both.a_bytes[k] for k in a) != (" " + text).encode() or b"".join(both.b_bytes[k] for k in b) != (" " + text).encode()):
            a, b = [], []
        spans = []
        for ids, table in ((a, both.a_bytes), (b, both.b_bytes)):
            at, own = 0, []
            for k in ids:
                own.append((at, at + len(table[k]), k))
                at += len(table[k])
            spans.append(own)
        # Every pair of tokens whose bytes overlap, by walking both lists.
        links, i, j = [], 0, 0
        while i < len(spans[0]) and j < len(spans[1]):
            x, y = spans[0][i], spans[1][j]
            if max(x[0], y[0]) < min(x[1], y[1]):
                links.append((x[2], y[2]))
            i, j = i + (x[1] <= y[1]), j + (y[1] <= x[1])
        common = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups = [([], [])]
        for side in (0, 1):
            g = 0
            for _, e, k in spans[side]:
                groups[g][side].append(str(k))
                if e in common:
                    g += 1
                    if len(groups) <= g:
                        groups.append(([], []))
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups if x or y)
        rows.append((doc, len(a), len(b), len(common), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
        linked.update(set(links))
    best = {}
    for (x, _), n in linked.items():
        best[x] = max(best.get(x, 0), n)
    return [(d, na, nb, g, len(ls), sum(linked[p] == best[p[0]] for p in ls), sum(linked[p] for p in ls), h) for d, na, nb, g, ls, h in rows]


@pytest.mark.parametrize("step, pairs", [(16384, 4 << 20), (7, 50), (64, 4 << 20)])
def test_alignment_equals_plain_version(spark, small, step, pairs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(40 if step == 7 else 150).collect()]
    rows += [(i, t[:3000] if t and step == 7 else t) for i, t in edge_texts()]
    got = alignment.aligned_tokens(documents(spark, rows), step, pairs).collect()
    assert by_row(map(tuple, got)) == by_row(plain_alignment(rows))


def test_alignment_of_an_empty_table(spark):
    assert alignment.aligned_tokens(documents(spark, [(1, "x")]).limit(0)).count() == 0


def test_long_texts_are_encoded_as_a_whole(monkeypatch):
    both = alignment.Tokenizers(alignment.tokenizer_path(), alignment.piece_path())
    assert both.cuts
    text = words(3000, 6) + " it's  two\n\n lines\t's 'll 12 345 ½ é ▂ " + words(50, 2)
    whole = [x.tolist() for x in both.encode(text)]
    monkeypatch.setattr(alignment, "_CHARS", 20)
    assert [x.tolist() for x in both.encode(text)] == whole == [both.a.encode_ordinary(" " + text), both.b.encode(text, out_type=int)]


@pytest.mark.parametrize("seed", range(6))
def test_merge_path_cuts_equal_work_and_no_common_end(seed):
    random = np.random.default_rng(seed)
    a, b = (np.unique(random.integers(1, 400, random.integers(0, 200))) for _ in range(2))
    for step in (1, 2, 5, 64, 1000):
        cuts = alignment.merge_path(a, b, step)
        assert cuts[0] == (0, 0) and cuts[-1] == (len(a), len(b))
        for (i, j), (m, n) in zip(cuts, cuts[1:], strict=False):
            assert 0 <= m - i and 0 <= n - j and m - i + n - j <= step + 1
        for i, j in cuts[1:-1]:
            done, left = np.concatenate((a[:i], b[:j])), np.concatenate((a[i:], b[j:]))
            assert done.max() < left.min()


def test_pieces_of_a_long_text_lie_in_rows_of_their_own(spark):
    pieces = alignment.pieces_of(documents(spark, [(1, words(40_000, 3)), (2, "w1")]), 1000)
    sizes = [(len(r.a) + len(r.b)) // 2 for r in pieces.where("doc_id = 1").collect()]
    assert len(sizes) > 50 and max(sizes) <= 1001


# --- toxicity


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("label", F.lit("clash"))


BAD = ["nasty", "vile", "rotten", "foulness", "hateful"]


def toxic_corpus(n=600):
    random = np.random.default_rng(11)
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = words(int(random.integers(20, 80)), 1000 + i).split()
        for b in random.permutation(BAD)[: random.integers(2, 5)] if bad else random.permutation(BAD)[: int(i % 30 == 1)]:
            w.insert(int(random.integers(0, len(w))), str(b))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_finds_toxic_documents_and_leaves_clean_ones(spark):
    docs, labels = toxic_corpus()
    got = {r.doc_id: r for r in toxicity.toxicity_scores(documents(spark, docs), labelled(spark, labels)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert np.mean([got[i].predicted for i in held if i % 6 == 0]) > 0.9
    assert np.mean([got[i].predicted for i in held if i % 6]) < 0.03
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    # Evidence are toxic examples, none of them held out.
    assert all(e.doc_id % 6 == 0 and e.doc_id not in set(held) and 0 < e.cosine <= 1.000001 for r in got.values() for e in r.evidence)
    assert any(r.evidence for r in got.values())


def test_scores_equal_dense_cosines(spark):
    docs, labels = toxic_corpus(300)
    frame = documents(spark, docs)
    model = toxicity.fit(frame, labelled(spark, labels), block=8, nearest=7)
    terms_of = [toxicity.document_terms(Counter(t.encode() for t in plain_terms(text))) for _, text in docs]
    x = np.zeros((len(docs), len(model.terms)))
    for r, counts in enumerate(terms_of):
        for k, t in enumerate(model.terms):
            if counts[t]:
                x[r, k] = 1 + math.log(counts[t])
    df = (x > 0).sum(axis=0)
    x *= np.log((len(docs) + 1) / (df + 0.5))
    size = np.sqrt((x * x).sum(axis=1))
    unit = x / np.maximum(size, 1e-12)[:, None]
    examples = unit[model.ids]
    known = toxicity.Terms(model.terms)
    visited = possible = 0
    for r, (_, text) in enumerate(docs):
        at, weights, _ = model.vector(known.of(text))
        found, cosines, blocks = model.index.nearest(at, weights, 7)
        visited, possible = visited + blocks, possible + bool(len(at)) * -(-len(model.ids) // 8)
        dense = examples @ unit[r]
        want = np.sort(dense[dense > 1e-9])[::-1][:7]
        assert np.allclose(cosines, want) and np.allclose(dense[found], cosines)
    assert visited < possible


def test_block_max_equals_all_examples_with_ties():
    random = np.random.default_rng(3)
    rows = []
    for _ in range(500):
        at = np.sort(random.choice(30, random.integers(1, 6), replace=False))
        w = random.integers(1, 4, len(at)).astype(float)
        rows.append((at, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMax(rows, 30, 16)
    dense = np.zeros((500, 30))
    for r, (at, w) in enumerate(rows):
        dense[r, at] = w
    for r, (at, w) in enumerate(rows[:80]):
        for without in (-1, r):
            found, cosines, _ = index.nearest(at, w, 9, without)
            scores = dense @ dense[r]
            order = [e for e in np.lexsort((np.arange(500), -np.round(scores, 12))) if e != without and scores[e] > 0][:9]
            assert np.allclose(scores[order], cosines)
            # Within what is equal but for rounding, any order; never a worse one.
            assert set(np.round(scores[found], 12)) == set(np.round(scores[order], 12))


def test_toxicity_of_edge_cases(spark):
    docs, labels = toxic_corpus(200)
    extra = [(9001, None), (9002, ""), (None, "nasty vile rotten"), (9003, "nasty vile rotten"), (9003, "nasty vile rotten"), (9004, words(30_000, 2) + " é"), (9005, "日本語")]
    marks = labels + [(None, 1, 1), (9003, None, None), (0, 1, 1), (99999, 1, 1)]
    got = toxicity.toxicity_scores(documents(spark, docs + extra), labelled(spark, marks)).collect()
    assert len(got) == len(docs) + len(extra)
    same = {r.score for r in got if r.doc_id in (None, 9003)}
    assert len(same) == 1 and same.pop() > 0.7
    assert len({r.score for r in got if r.doc_id in (9001, 9002, 9005)}) == 1
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in toxicity.toxicity_scores(documents(spark, docs), labelled(spark, labels).limit(0)).collect()} == {0.5}
    assert toxicity.toxicity_scores(documents(spark, docs).limit(0), labelled(spark, labels)).count() == 0
