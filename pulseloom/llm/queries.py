"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_topk, html_text, lexical_search, license_scan, media_columns, mixing, near_dedup, packing, quality, toxicity, url_filter, warc
from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_columns(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_order(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_tokens(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_warc": op3_warc,
    "op4_html_extraction": op4_html_extraction,
    "op5_media_columns": op5_media_columns,
    "op6_mixing": op6_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_license_scan": op10_license_scan,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_toxicity": op13_toxicity,
}


def _level(name: str, groups: str, key: str, parent: str, above: str) -> str:
    """SQL of one level of host reputation: {name}(key, parent, n, bad, alpha, beta, mean)."""
    return f"""{name}_j AS (SELECT g.{key}, g.{parent}, g.n, g.bad, a.mean AS m FROM {groups} g JOIN {above} a ON g.{parent} = a.{parent}),
 {name}_m AS (SELECT sum((bad / n - m) * (bad / n - m) * n) FILTER (n > 1) AS b, sum(m * (1 - m)) FILTER (n > 1) AS w, sum(m * (1 - m) * (n - 1)) FILTER (n > 1) AS x FROM {name}_j),
 {name}_r AS (SELECT x, greatest(1e-3, least(0.5, (b - w) / x)) AS rho FROM {name}_m), {name}_s AS (SELECT least(1000.0, greatest(1.0, coalesce(CASE WHEN x > 0 THEN (1 - rho) / rho END, 1000.0))) AS s FROM {name}_r),
 {name} AS (SELECT {key}, {parent}, n, bad, bad + m * s AS alpha, n - bad + (1 - m) * s AS beta, (bad + m * s) / (n + s) AS mean FROM {name}_j, {name}_s)"""


def _tail(n: int) -> str:
    return f"array_to_string(l[-{n}:], '.')"


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{s}'" for s in names)


_SHARED = " ".join(f"WHEN {_tail(n)} IN ({_quoted([s for s in url_filter.SHARED if s.count('.') + 1 == n])}) THEN {_tail(n)}" for n in sorted({s.count(".") + 1 for s in url_filter.SHARED}, reverse=True))
_SUFFIX = f"CASE WHEN regexp_matches(b, '^[0-9.]+\\z|^\\[') OR b = '' THEN b {_SHARED} WHEN len(l) > 1 AND length(l[-1]) = 2 AND l[-2] IN ({_quoted(url_filter.SECOND_LABELS)}) THEN {_tail(2)} ELSE l[-1] END"
_DOMAIN = "CASE WHEN len(l) <= len(string_split(suffix, '.')) OR suffix = b THEN b ELSE array_to_string(l[-1 - len(string_split(suffix, '.')):], '.') END"
#: The series of the incomplete beta function: the chance of a bad-page rate of at most the allowed one.
_BELOW = f"list_sum(list_transform(range(0, 4000), lambda i: exp(alpha * ln({url_filter.ALLOWED_RATE}) + beta * ln(1 - {url_filter.ALLOWED_RATE}) + lgamma(alpha + beta + i) - lgamma(alpha + 1 + i) - lgamma(beta) + i * ln({url_filter.ALLOWED_RATE}))))"
_FITS = "CASE " + " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN {{'rule': '{r}', 'verdict': '{v}'}}" for r, v in sorted(url_filter.RULES, key=lambda r: -len(r[0]))) + " END"

ORACLES: dict[str, str] = {
    "op1_url_filters": f"""WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
 h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 k AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY 1),
 c0 AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?\\z', '') AS b, count(*) AS pages, count(quality) AS n, coalesce(sum(1 - quality), 0) AS bad FROM h LEFT JOIN k ON page_id = doc_id GROUP BY host),
 c1 AS (SELECT *, string_split(b, '.') AS l FROM c0), c2 AS (SELECT *, {_SUFFIX} AS suffix FROM c1), c AS (SELECT host, n, bad, suffix, {_DOMAIN} AS domain, '' AS everything FROM c2),
 top AS (SELECT '' AS everything, (sum(bad) + 1) / (sum(n) + 2) AS mean FROM c), gs AS (SELECT suffix, '' AS everything, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY 1), gd AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY ALL),
 {_level("bs", "gs", "suffix", "everything", "top")}, {_level("bd", "gd", "domain", "suffix", "bs")}, {_level("bh", "c", "host", "domain", "bd")},
 v AS (SELECT host, 1 - {_BELOW} >= {url_filter.CHANCE} AS bad FROM bh), f AS (SELECT page_id, host, path, {_FITS} AS r FROM h)
 SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN v.bad THEN 'block' ELSE 'allow' END) AS verdict FROM f JOIN v USING (host)""",
    "op6_mixing": """WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), z AS (SELECT sum(sqrt(n)) AS z FROM c),
 w AS (SELECT source, greatest(1, CAST(floor(1000 * sqrt(n) / z + 0.5) AS BIGINT)) AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS o FROM c, z),
 p AS (SELECT CAST(sum(w) AS BIGINT) AS period, list(w ORDER BY o) AS ws FROM w),
 s AS (SELECT CAST(-1 AS BIGINT) AS slot, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS STRUCT(d BIGINT, w BIGINT, o BIGINT, k BIGINT, r BIGINT)) AS pick FROM p
  UNION ALL SELECT slot + 1, list_transform(done, lambda x, j: CASE WHEN j = pick.o THEN x + 1 ELSE x END), pick FROM (SELECT slot, done, list_min(list_filter(list_transform(range(1, len(ws) + 1),
   lambda i: CASE WHEN done[i] < ws[i] AND done[i] * period // ws[i] <= slot + 1 THEN {'d': -((-(done[i] + 1) * period) // ws[i]) + CASE WHEN ((done[i] + 1) * period) % ws[i] <> 0 THEN 1 ELSE 0 END, 'w': -ws[i], 'o': i, 'k': done[i], 'r': done[i] * period // ws[i]} END), lambda x: x IS NOT NULL)) AS pick, period FROM s, p WHERE slot + 1 < period)),
 t AS (SELECT w.source, w.w, pick.k AS k, pick.r AS r, pick.d AS d, slot FROM s JOIN w ON w.o = pick.o WHERE slot >= 0),
 x AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id) - 1 AS block FROM documents),
 n AS (SELECT max((c.n + w.w - 1) // w.w) AS turns FROM c JOIN w ON c.source IS NOT DISTINCT FROM w.source),
 y AS (SELECT doc_id, x.source, w.w, unnest(range(0, (w.w * (SELECT turns FROM n) - block - 1) // c.n + 1)) AS epoch, block, c.n FROM x JOIN w ON x.source IS NOT DISTINCT FROM w.source JOIN c ON x.source IS NOT DISTINCT FROM c.source),
 z2 AS (SELECT doc_id, source, w, epoch, block + epoch * n AS block FROM y)
 SELECT z2.doc_id, z2.source, epoch, block, r + block // z2.w * period AS release, d + block // z2.w * period AS deadline, slot + block // z2.w * period AS slot, 0 AS place FROM z2 JOIN t ON z2.source IS NOT DISTINCT FROM t.source AND block % z2.w = k, p""",
    "op3_warc": """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
 m AS (SELECT *, payload_bytes >= 1000 AND row_number() OVER (PARTITION BY payload_bytes, payload_digest ORDER BY page_id DESC NULLS LAST, url NULLS FIRST) > 1 AS again, max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS last FROM d)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to, url FROM m""",
    "op8_minhash_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE [] END AS s FROM w),
 n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * same >= 75 * (p.n + q.n - same)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a), k AS (SELECT doc_id, min(reached) AS m FROM r GROUP BY 1)
 SELECT doc_id, n AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM n LEFT JOIN k USING (doc_id)""",
    "op9_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(r.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
        k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op11_ranked_lexical_search": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
 n AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
 tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM n) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
 b AS (SELECT row_number() OVER () AS number, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
 w AS (SELECT number, item_id, q.t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT number, item_id, unnest(ts) AS t FROM b) q JOIN df USING (t), s),
 m AS (SELECT r, doc_id, 10 + (90 * n * docs) // length AS m FROM n, s),
 x AS (SELECT number, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM w JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL),
 k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}
