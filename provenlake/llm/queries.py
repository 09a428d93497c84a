"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, license_scan, line_dedup, lm_score, mixing, near_dup, ranked_search, topk_search, toxicity, url_filter, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive_records(warc.responses_from_pages(_table(spark, sf_dir, "pages")))
    return records.select(
        "page_id", "record_type", "new_id", "refers_to", "concurrent_to", "target_uri", "content_length", "block_digest", "payload_digest", "source_digest",
        F.sha2("warc_header", 256).alias("header_sha256"),
    )


#: host, path, verdict
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_score.score_documents(_table(spark, sf_dir, "documents"), good)


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return topk_search.top_k(docs, docs.filter("doc_id % 50 = 0"))


#: Target weights of the mix; sources not named share that of 'other' equally.
SOURCE_WEIGHTS = {"src0": 6, "src1": 4, "src2": 3, "src3": 2, "other": 9}


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs, mixing.shared_weights(docs, SOURCE_WEIGHTS))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.product_codes(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_near_dup, op2_warc_derive, op3_url_filter, op4_line_dedup, op5_license_scan, op6_lm_score, op7_toxicity, op8_topk_search, op9_mix_sources, op10_decontaminate,
    op11_byte_bpe, op12_vector_codes, op13_ranked_search,
)}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_TEMPLATE_ROWS = ", ".join(f"('{label}', '{text}')" for label, text in license_scan.TEMPLATES.items())
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_text(html: str) -> str:
    """The steps of warc.html_text as one DuckDB expression."""
    text = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for name in warc.SILENT:
        text = f"regexp_replace({text}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '(?i)</?(?:{warc.BREAKS})\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, char in warc.ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, entity.replace("'", "''"), char.replace("'", "''"))
    for pattern, code in ((warc.DECIMAL, "regexp_extract(x, '[1-9][0-9]*')::BIGINT"), (warc.HEXADECIMAL, "('0x' || regexp_extract(x, '[xX]0*([0-9A-Fa-f]+)', 1))::BIGINT")):
        found = f"list_distinct(regexp_extract_all({text}, '{pattern}'))"
        one = f"CASE WHEN {code} < 55296 OR {code} BETWEEN 57344 AND 1114111 THEN replace(acc, x, chr(({code})::INT)) ELSE acc END"
        text = f"list_reduce(list_prepend({text}, {found}), lambda acc, x: {one})"
    text = f"replace({text}, '&amp;', '&')"
    text = f"regexp_replace({text}, '[ \\t\\r\\x0B\\f]+', ' ', 'g')"
    return f"trim(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


def _sql_uuid(*parts: str) -> str:
    return "'<urn:uuid:' || regexp_replace(md5(concat_ws(chr(10), {})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'".format(", ".join(parts))


def _sql_nearest(turn: int) -> str:
    """Each part's entry in the turn's codebook, and the one's squared distance; ties to the lower entry."""
    return f"""
near{turn} AS MATERIALIZED (
  SELECT r, p, min(far * 64 + e) % 64 AS e, min(far * 64 + e) // 64 AS far FROM (
    SELECT r, p, e, list_sum(list_transform(list_zip(x.s, y.s), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS far
    FROM parts x JOIN book{turn} y USING (p)) GROUP BY r, p)"""


def _sql_means(turn: int) -> str:
    """The codebook after the turn's."""
    return f"""
book{turn + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(any_value(m.s), any_value(b.s)) AS s
  FROM book{turn} b LEFT JOIN (
    SELECT p, e, list(mean ORDER BY pos) AS s FROM (
      SELECT p, e, pos, floor(sum(c) / count(*))::BIGINT AS mean
      FROM (SELECT r, p, unnest(s) AS c, generate_subscripts(s, 1) AS pos FROM parts) JOIN near{turn} USING (r, p) GROUP BY p, e, pos)
    GROUP BY p, e) m USING (p, e) GROUP BY p, e)"""


_WORDS = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

#: All links by an equi-join of sets on shared shingles; components by iterated minima.
ORACLES = {
    "op1_near_dup": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
  WHERE 100 * c >= 85 * (sx.n + sy.n - c)),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
""",
    "op4_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS most FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, coalesce(doc_id < most, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op3_url_filter": f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULE_ROWS}),
parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
fits AS (
  SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS r_verdict
  FROM named JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM named LEFT JOIN fits USING (page_id)
""",
    "op5_license_scan": f"""
WITH words AS (
  SELECT doc_id, line_no, unnest(regexp_extract_all({_LOWER.format("line")}, {_WORDS})) AS w,
         generate_subscripts(regexp_extract_all({_LOWER.format("line")}, {_WORDS}), 1) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)),
placed AS (
  SELECT *, row_number() OVER o - 1 AS spot, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY line_no, k)),
base AS (
  SELECT doc_id, spot, CASE WHEN w = 'cc' AND w1 = 'by' THEN 'cc-by'
    WHEN w = 'general' AND w1 = 'public' AND w2 = 'license' THEN 'gpl'
    WHEN w = 'all' AND w1 = 'rights' AND w2 = 'reserved' THEN 'reserved' END AS label
  FROM placed),
templates(label, t) AS (VALUES {_TEMPLATE_ROWS}),
wanted AS (SELECT DISTINCT label, unnest(regexp_extract_all(lower(t), {_WORDS})) AS w FROM templates),
stride AS (SELECT max(len(regexp_extract_all(lower(t), {_WORDS}))) AS h FROM templates),
blocks AS (
  SELECT DISTINCT doc_id, block, w FROM (SELECT doc_id, w, unnest([spot // h, spot // h - 1]) AS block FROM placed, stride) WHERE block >= 0),
shares AS (
  SELECT doc_id, block, label, count(*) / any_value(n) AS share, count(*) AS c, any_value(n) AS n, list(w) AS ws
  FROM blocks JOIN wanted USING (w) JOIN (SELECT label, count(*) AS n FROM wanted GROUP BY label) USING (label) GROUP BY ALL),
enough AS (SELECT * FROM shares WHERE 100 * c >= 80 * n),
met AS (SELECT doc_id, label, share FROM enough e WHERE NOT EXISTS (
    SELECT 1 FROM enough o WHERE o.doc_id = e.doc_id AND o.block = e.block AND o.c > e.c AND o.share >= e.share AND list_has_all(o.ws, e.ws))
  UNION ALL SELECT doc_id, label, 1.0 FROM base WHERE label IS NOT NULL),
found AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM met GROUP BY doc_id),
counted AS (
  SELECT doc_id, count(*) AS n_words, count(label) AS n_base, min(spot) FILTER (label IS NOT NULL) AS first_word,
         max(spot) FILTER (label IS NOT NULL) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM base GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op10_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS w FROM benchmark),
d_words AS (SELECT doc_id, unnest(w) AS g, unnest(range(0, len(w))) AS at FROM d),
b_words AS (SELECT item_id, least(20, len(w)) AS n, unnest(w) AS g, unnest(range(0, len(w))) AS p FROM b WHERE len(w) >= 5),
lines AS (
  SELECT doc_id, item_id, at - p AS shift FROM d_words JOIN b_words USING (g)
  GROUP BY ALL HAVING 100 * count(*) >= 80 * any_value(n)),
agree AS (
  SELECT doc_id, item_id, shift, b.w AS i_w, unnest(range(0, len(b.w))) AS p, d.w AS d_w
  FROM lines JOIN d USING (doc_id) JOIN b USING (item_id)),
runs AS (
  SELECT doc_id, item_id, p, least(20, len(i_w)) AS n, len(i_w) AS size,
         sum(CASE WHEN p + shift BETWEEN 0 AND len(d_w) - 1 AND d_w[p + shift + 1] = i_w[p + 1] THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS m
  FROM agree)
SELECT doc_id, item_id, any_value(n)::BIGINT AS window_tokens, max(m)::BIGINT AS matched
FROM runs WHERE p <= size - n GROUP BY doc_id, item_id HAVING 100 * max(m) >= 80 * any_value(n)
""",
    "op2_warc_derive": f"""
WITH crlf AS (SELECT chr(13) || chr(10) AS e),
responses AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS payload, e,
         {_sql_uuid("'response'", "coalesce(page_id::VARCHAR, '')", "coalesce(url, '')", "md5(coalesce(html, ''))")} AS refers_to,
         'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))::VARCHAR || e AS fields
  FROM pages, crlf),
facts AS (
  SELECT *, 'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256('HTTP/1.1 200 OK' || e || fields || e || payload) AS source_digest,
         {_sql_uuid("'metadata'", "refers_to")} AS metadata_id, {_sql_uuid("'conversion'", "refers_to")} AS conversion_id,
         {_sql_text("payload")} AS text, {_sql_text("regexp_extract(payload, '(?is)<title" + chr(92) + "b[^>]*>(.*?)</title', 1)")} AS title,
         regexp_extract(payload, '(?i)<html\\b[^>]*\\blang=["'']?([A-Za-z-]+)', 1) AS language
  FROM responses),
made AS (
  SELECT page_id, 'metadata' AS record_type, metadata_id AS new_id, refers_to, conversion_id AS concurrent_to, uri AS target_uri, payload_digest, source_digest, e,
         'application/warc-fields' AS content_type,
         'title: ' || replace(title, chr(10), ' ') || e || 'language: ' || language || e || 'source-payload-digest: ' || payload_digest || e
           || 'source-block-digest: ' || source_digest || e || 'http-HTTP/1.1 200 OK' || e || 'http-' || replace(rtrim(fields, e), e, e || 'http-') || e AS block
  FROM facts
  UNION ALL
  SELECT page_id, 'conversion', conversion_id, refers_to, metadata_id, uri, payload_digest, source_digest, e, 'text/plain; charset=utf-8', text FROM facts),
sized AS (SELECT *, octet_length(encode(block))::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest FROM made)
SELECT page_id, record_type, new_id, refers_to, concurrent_to, target_uri, content_length, block_digest, payload_digest, source_digest,
       sha256('WARC/1.1' || e || 'WARC-Type: ' || record_type || e || 'WARC-Record-ID: ' || new_id || e || 'WARC-Date: 2026-01-01T00:00:00Z' || e
         || 'WARC-Target-URI: ' || target_uri || e || 'WARC-Refers-To: ' || refers_to || e || 'WARC-Refers-To-Target-URI: ' || target_uri || e
         || 'WARC-Refers-To-Date: 2026-01-01T00:00:00Z' || e || 'WARC-Concurrent-To: ' || concurrent_to || e || 'WARC-Payload-Digest: ' || payload_digest || e
         || 'WARC-Block-Digest: ' || block_digest || e || 'Content-Type: ' || content_type || e || 'Content-Length: ' || content_length::VARCHAR || e) AS header_sha256
FROM sized
""",
    "op8_topk_search": f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS})) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL),
df AS (SELECT w, count(*) AS docs FROM tf GROUP BY w),
sizes AS (SELECT doc_id, sum(n) AS dl FROM tf GROUP BY doc_id),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM words) / (SELECT count(*) FROM documents) AS mean_length),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(q.n * ln(1 + (n_docs - docs + 0.5) / (docs + 0.5)) * d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * dl / mean_length))), 6) AS score
  FROM tf q JOIN tf d USING (w) JOIN df USING (w) JOIN sizes ON sizes.doc_id = d.doc_id, corpus
  WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
""",
    "op12_vector_codes": f"""
WITH vectors AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS s FROM vectors, range(16) t(p)),
book0 AS (SELECT p, r - 1 AS e, s FROM parts WHERE r <= 64),{_sql_nearest(0)},{_sql_means(0)},{_sql_nearest(1)},{_sql_means(1)},{_sql_nearest(2)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM near2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM vectors JOIN coded USING (r)
""",
    "op13_ranked_search": f"""
WITH d_words AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS})) AS w FROM documents),
i_words AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS})) AS w FROM benchmark)),
tf AS (SELECT doc_id, w, count(*) AS tf FROM d_words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*)::HUGEINT AS n_docs, sum(n)::HUGEINT AS n_words FROM sizes),
weights AS (SELECT w, floor(1000 * ln((2 * any_value(n_docs)::DOUBLE + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, corpus WHERE w IN (SELECT w FROM i_words) GROUP BY w),
scored AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))::BIGINT))::BIGINT AS score
  FROM i_words JOIN weights USING (w) JOIN tf USING (w) JOIN sizes USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
""",
}
