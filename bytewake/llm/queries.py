"""The operators over their whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bytewake import session
from bytewake.llm import (
    decontamination, line_dedup, lm_scoring, near_dedup, ngram_join, quality_classifier, quality_rules, ranked_search, secret_scan,
    sentencepiece_fst, source_divergence, token_records, tokenizer_files, warc,
)
from bytewake.llm.common import table
from bytewake.staging import stage_in

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), stage_in(spark, "op1"))


@query
def op2_warc_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), session.work_dir(spark, "warc"), stage_in(spark, "op2"))
    return warc.read(archives, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*quality_classifier.COLUMNS)
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels"), stage=stage_in(spark, "op3")))


@query
def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", *[f.name for f in quality_rules.FIELDS])


@query
def op5_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = tokenizer_files.content("piece_bpe_32k.model")
    return sentencepiece_fst.encode(docs, model).select("doc_id", *[f.name for f in sentencepiece_fst.FIELDS])


@query
def op6_window_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


@query
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), stage_in(spark, "op8"))


@query
def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = tokenizer_files.content("byte_bpe_50k.json").decode()
    folder = session.work_dir(spark, "records")
    manifest = token_records.write(table(spark, sf_dir, "documents"), folder, spec, stage_in(spark, "op9"))
    return token_records.read(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_site_relative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, host="source", stage=stage_in(spark, "op10")).drop("source")


@query
def op11_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), stage_in(spark, "op11"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"), stage_in(spark, "op12"))


@query
def op13_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), stage_in(spark, "op13"))


FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op2_warc_byte_ranges"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    (CAST('0x' || substr(h, 1 + 10 * (j // 8), 10) AS UBIGINT) >> CAST(35 - 5 * (j % 8) AS UBIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g"""

ORACLES["op7_winnowing"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM
  (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)"""

ORACLES["op10_site_relative_lines"] = rf"""
WITH lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS pages FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source),
often AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT text) AS held_by FROM lines
    WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*') GROUP BY source, line) h JOIN totals t USING (source)
  WHERE held_by >= {line_dedup.MIN_PAGES}
    AND 1000 * held_by > pages * CASE WHEN length(line) <= 20 THEN 100 WHEN length(line) <= 200 THEN 20 ELSE 5 END),
marked AS (SELECT lines.*, often.line IS NOT NULL AS gone FROM lines LEFT JOIN often USING (source, line)),
left_over AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, o.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN left_over o USING (doc_id)"""


P = "CAST(1 + (1000000000 * CAST({count} + 1 AS HUGEINT)) // ({total} + v) AS BIGINT)"
F = "((CAST({p} AS HUGEINT) - {q}) * ({p} - {q})) // {q}"
RANKED = "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank"

ORACLES["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {FOLDED} AS body FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
held AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT g.lang, g.source, coalesce(sum(h.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, {P.format(count="coalesce(h.n, 0)", total="g.total")} AS p,
    {P.format(count="k.n", total="l.total")} AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum({F.format(p="a.p", q="b.p")}) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST({F.format(p="p", q="q")} AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, {RANKED} FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, {RANKED} FROM terms) t WHERE rank <= 200"""

ORACLES["op13_geometric_blocks"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT q, item_id, unnest(w) AS term FROM b),
size AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) u WHERE term IN (SELECT term FROM t) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, size GROUP BY term, docs),
m AS (SELECT k, doc_id, 100 - 90 + (90 * len(w) * docs) // words AS m FROM d, size),
scores AS (SELECT q, item_id, k, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM t JOIN weights USING (term) JOIN p USING (term) JOIN m USING (k) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""
