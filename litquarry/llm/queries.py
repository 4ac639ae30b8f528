"""The queries registered for the operators, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from litquarry.llm import (conversation_repair, decontamination, language_id, line_cleaning, maxscore, mixing, packing, quality, records, simhash, toxicity,
                           url_filter, whitening)
from litquarry.llm.common import register
from litquarry.sources.tables import table

URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _sql(text: str) -> str:
    """A pattern as an SQL string."""
    return text.replace("'", "''")


SQL_MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS place FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, sum(cap) OVER (ORDER BY cap / w, r) AS caps, sum(w) OVER (ORDER BY cap / w, r) AS ws,
             coalesce(lead(cap / w) OVER (ORDER BY cap / w, r), 1e300) AS next FROM w),
b AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(w) AS weight, min(cap / w) AS first FROM w),
cuts AS (SELECT 0.0 AS caps, 0.0 AS ws, first AS next FROM b UNION ALL SELECT caps, ws, next FROM o),
pick AS (SELECT caps, ws FROM cuts, b WHERE weight > ws AND (budget - caps) / (weight - ws) <= next ORDER BY ws LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (budget - caps) * w / (weight - ws) > cap THEN cap ELSE (budget - caps) * w / (weight - ws) END AS target FROM w, b, pick),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
q AS (SELECT *, floor(target - whole * source_size) AS rest FROM p),
c AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY place) AS upto, sum(size) OVER (PARTITION BY d.source, place) AS tied
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN whole >= 2 THEN 0 WHEN upto <= rest THEN 1
                                 WHEN upto - tied <= rest AND tied - (rest - (upto - tied)) < rest - (upto - tied) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


@register("op5_mixing_to_weights", SQL_MIXING)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


SQL_LINES = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, len(w) AS n_words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             list_transform(generate_series(1, len(w) - 7), lambda i: w[i:i+7]) AS win FROM w),
f AS (SELECT *, list_transform(lines, lambda x: len(regexp_extract_all(x, '[\x20\x09-\x0D]+'))) AS gaps FROM l),
k AS (SELECT *, list_filter(lines, lambda x, i: NOT (
        len(regexp_extract_all(x, '{_sql(line_cleaning.NOISY)}')) * 5 > gaps[i]
        OR regexp_matches(x, '{_sql(line_cleaning.NAVIGATION)}')
        OR (regexp_matches(x, '{_sql(line_cleaning.BOILERPLATE)}') AND length(x) <= 300)
        OR (gaps[i] >= {line_cleaning.LONG_LINE} AND NOT regexp_matches(x, '{line_cleaning.SENTENCE_END}')))) AS good FROM f),
-- window places of texts in which a window comes twice
p AS (SELECT row_number() OVER () AS rid, * FROM k),
u AS (SELECT rid, unnest(win) AS x, generate_subscripts(win, 1) AS i FROM p WHERE len(list_distinct(win)) < len(win)),
g AS (SELECT rid, i FROM u QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
r AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM g) GROUP BY rid),
e AS (SELECT doc_id, n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '{line_cleaning.SYMBOLS}', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             n_words - len(regexp_extract_all(array_to_string(good, chr(10)), '[^\x20\x09-\x0D]+')) AS lost
      FROM p LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= {line_cleaning.MAX_LOST_PERCENT} * n_words AS kept
FROM e
"""


@register("op7_line_cleaning", SQL_LINES)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_cleaning.clean_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language_id.identify(docs, language_id.fit(docs))


def _address(url: str) -> str:
    return (rf"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}')"
            rf" || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)")


def _rule(host: str, path: str, what: int) -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, a)[what]}'" for a, h, p in ordered) + " END"


SQL_URLS = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN {_address('url')} END AS address,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
link AS (
  SELECT address AS a, host, path, unnest(list_concat(
    list_transform(regexp_extract_all(html, '{_sql(url_filter.CANONICAL)}'), lambda t: regexp_extract(t, '{_sql(url_filter.HREF)}', 1)),
    list_transform(regexp_extract_all(html, '{_sql(url_filter.REFRESH)}'), lambda t: regexp_extract(t, '{_sql(url_filter.REFRESH_URL)}', 1)))) AS raw
  FROM p WHERE address IS NOT NULL),
aim AS (
  SELECT a, CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN 'x:' || x WHEN starts_with(x, '/') THEN 'x://' || host || x
                 ELSE 'x://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || x END AS y
  FROM (SELECT *, replace(raw, '&amp;', '&') AS x FROM link WHERE raw <> '')),
e AS (SELECT a AS u, b AS v FROM (SELECT a, {_address('y')} AS b FROM aim) WHERE a <> b),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (
  SELECT u AS a, u AS b FROM both_ways UNION SELECT r.a, w.v FROM reach r JOIN both_ways w ON r.b = w.u),
bad AS (SELECT DISTINCT a FROM (SELECT a, 'x://' || b AS y FROM reach)
        WHERE {_rule("regexp_extract(y, '(?s)^x://([^/?#]*)', 1)", "regexp_extract(y, '(?s)^x://[^/?#]*([^?#]*)', 1)", 1)} = 'block')
SELECT page_id, host, path, {_rule('host', 'path', 0)} AS rule,
       coalesce({_rule('host', 'path', 1)}, CASE WHEN address IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""


@register("op10_url_filter", SQL_URLS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url", "html"), URL_RULES)


@register("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_into_pieces(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json")))


@register("op3_token_records")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = records.write_dataset(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "path", "position")


@register("op1_quality_machine")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@register("op9_toxicity_chain")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register("op4_simhash_links")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2])) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@register("op6_maxscore_top_k", SQL_TOP_K)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@register("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whole_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return whitening.whiten(rows, whitening.fit(rows))


SQL_DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{decontamination.UPPER}', '{decontamination.LOWER}'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{decontamination.UPPER}', '{decontamination.LOWER}'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[i:i + {decontamination.WINDOW - 1}] AS x
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {decontamination.WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT rid, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT len(x) AS n FROM win)),
hits AS (SELECT rid, i, n, item_id FROM (SELECT rid, n, i, w[i:i + n - 1] AS x FROM places) JOIN win USING (x)),
per_word AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
per_item AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_word USING (rid) LEFT JOIN per_item USING (rid)
"""


@register("op12_benchmark_decontamination", SQL_DECONTAMINATION)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@register("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
