"""Claims and evidence worded from relational rows, as SQL that any engine reads the same way.

The text tables hold invented words, in which governed wording is rare; these sentences reach every
rule.  Each order is one claim of its customer's bundle and one excerpt of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import scanned

_N, _Y, _M = "CAST(o_orderkey % 4 + 2 AS STRING)", "CAST(2019 + o_orderkey % 5 AS STRING)", "CAST(o_orderkey % 9 + 1 AS STRING)"

CLAIMS = f"""
SELECT o_custkey AS bundle_id, 'claim-' || CAST(o_orderkey AS STRING) AS claim_id,
  CASE o_orderkey % 13
    WHEN 0 THEN 'The service will always ship orders within ' || {_N} || ' days.'
    WHEN 1 THEN 'Every workflow across all regions was audited in ' || {_Y} || '.'
    WHEN 2 THEN 'The outage count fell from 9 to ' || {_N} || ' because of the new router.'
    WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'The new pipeline is faster than the manual process by ' || {_N} || '%.' ELSE 'The new pipeline is faster than the manual process.' END
    WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'The operator is a certified technician with broad field experience.' ELSE 'The operator is a certified technician.' END
    WHEN 5 THEN 'The parser can detect duplicate invoices in the queue.'
    WHEN 6 THEN 'The store processed ' || {_N} || ' orders on ' || {_Y} || '-0' || {_M} || '-15.'
    WHEN 7 THEN 'The report is clear and useful for the support team.'
    WHEN 8 THEN 'Blue shelves stand near the green doors.'
    WHEN 9 THEN 'The deadline for supplier onboarding could move.'
    WHEN 10 THEN 'The public repository is available and supports exports.'
    WHEN 11 THEN 'The router clearly eliminates outages due to heat.'
    ELSE 'The tool guarantees that invoices will never be lost.'
  END AS claim_text
FROM orders
"""

EXCERPTS = f"""
SELECT o_custkey AS bundle_id, 'src-' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 5 AS STRING) AS source_id,
  'exc-' || CAST(o_orderkey AS STRING) AS excerpt_id,
  CASE o_orderkey % 13
    WHEN 0 THEN 'The service ships orders within ' || {_N} || ' days; always is a known limitation.'
    WHEN 1 THEN 'Every workflow across all regions was audited in ' || {_Y} || ', two were not tested.'
    WHEN 2 THEN 'The outage count fell from 9 to ' || {_N} || ' after the new router.'
    WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'The new pipeline is faster than the manual process by 3%.' ELSE 'The new pipeline ran in ' || {_N} || '% of cases.' END
    WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'The operator is a certified technician with field experience.' ELSE 'The operator has broad field experience.' END
    WHEN 5 THEN 'The parser can detect duplicate invoices in the queue.'
    WHEN 6 THEN 'The store processed ' || {_N} || ' orders on ' || {_Y} || '-0' || {_M} || '-15.'
    WHEN 7 THEN 'The report is useful for the support team.'
    WHEN 8 THEN 'Green doors and blue shelves.'
    WHEN 9 THEN 'The deadline for supplier onboarding may slip.'
    WHEN 10 THEN 'The public repository is available and supports exports.'
    WHEN 11 THEN 'The router clearly eliminates outages due to heat, causal in a controlled trial.'
    ELSE 'The tool keeps invoices; misses are incomplete.'
  END AS excerpt_text,
  CASE WHEN o_orderkey % 4 = 1 THEN 'paragraph_index=' || {_N} END AS notes,
  CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'unknown' ELSE 'low' END AS reliability,
  CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderdate AS DATE) END AS source_date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://example.org/' || CAST(o_orderkey AS STRING) END AS url
FROM orders
"""

LINKS = """
SELECT o_custkey AS bundle_id, 'claim-' || CAST(o_orderkey AS STRING) AS claim_id, 'exc-' || CAST(o_orderkey AS STRING) AS excerpt_id,
  CASE WHEN o_orderkey % 4 = 3 THEN 'counter' ELSE 'support' END AS role
FROM orders
"""

#: Entailment results: three or four a claim, with features of both sides.
SIGNALS = """
SELECT DISTINCT o_orderkey AS claim_id, 'p-' || CAST(l_linenumber AS STRING) || '-' || CAST(o_orderkey % 7 AS STRING) AS passage_id, l_linenumber AS ordinal,
  CASE (l_orderkey * 7 + l_linenumber * 3) % 5 WHEN 0 THEN 'entail' WHEN 1 THEN 'contradict' WHEN 2 THEN 'neutral' WHEN 3 THEN 'entail' ELSE 'contradict' END AS label,
  CAST((l_orderkey * 13 + l_linenumber * 29) % 101 AS DOUBLE) / CAST(128 AS DOUBLE) AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

PASSAGES = """
SELECT DISTINCT passage_id,
  CASE (n + 2 * k) % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'primary' WHEN 3 THEN 'background' END AS trust_level,
  (n + k) % 3 = 0 AS p_negation,
  CASE (n * 3 + k) % 4 WHEN 0 THEN 'weak' WHEN 1 THEN 'strong' END AS p_scope,
  CAST(n * 10 + k AS DOUBLE) AS p_value,
  CASE WHEN k % 2 = 0 THEN 'ship' ELSE 'order' END AS p_lemma
FROM (SELECT 'p-' || CAST(l_linenumber AS STRING) || '-' || CAST(o_orderkey % 7 AS STRING) AS passage_id, l_linenumber AS n, o_orderkey % 7 AS k
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x
"""

CLAIM_FEATURES = """
SELECT o_orderkey AS claim_id,
  CASE o_orderkey % 23 WHEN 0 THEN 'opinion' WHEN 1 THEN 'question' ELSE 'declarative' END AS sentence_type,
  CAST(3 + o_orderkey % 19 AS INT) AS token_count, o_orderkey % 6 = 0 AS negated, o_orderkey % 29 > 0 AS any_retrieved,
  o_orderkey % 5 = 1 AS claim_strong, o_orderkey % 7 = 2 AS hedges, o_orderkey % 8 = 3 AS approximate,
  CAST(o_orderkey % 10 * 10 + o_orderkey % 7 AS DOUBLE) AS c_value, o_orderkey % 3 > 0 AS c_has_value, CASE WHEN o_orderkey % 4 = 0 THEN 'ship' ELSE 'order' END AS c_lemma
FROM orders
"""

#: Labels of both sides and flags of claims, with two grouping columns.
PAIRS = """
SELECT o_orderkey AS claim_id, CASE o_orderkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'scaffold' ELSE 'mixed' END AS condition, 'm' || CAST(o_custkey % 4 AS STRING) AS model,
  CASE o_orderkey % 7 WHEN 0 THEN 'supported' WHEN 1 THEN 'supported' WHEN 2 THEN 'partially_supported' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'contradicted' WHEN 5 THEN 'not_checkable' ELSE 'reasonable_inference' END AS raw_gold,
  CASE o_orderkey % 11 WHEN 0 THEN 'supported' WHEN 1 THEN 'partially_supported' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'contradicted' WHEN 4 THEN 'not_checkable'
    ELSE CASE o_orderkey % 7 WHEN 2 THEN 'partially_supported' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'contradicted' WHEN 5 THEN 'not_checkable' ELSE 'supported' END END AS cal,
  CASE o_orderkey % 5 WHEN 0 THEN 'overconfident' WHEN 1 THEN 'missing_needed' WHEN 2 THEN 'false_caution' WHEN 3 THEN 'source_scope_error' ELSE '' END AS raw_flag,
  CASE o_orderkey % 6 WHEN 0 THEN 'overstated' WHEN 1 THEN 'inferred' WHEN 2 THEN 'false_caution' WHEN 3 THEN 'source_scope_error' ELSE '' END AS cal_flag,
  o_orderkey % 9 = 4 AS starved
FROM orders
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Rows of lineitem, or orders that they belong to, that one task has where tables are dealt out by order.
ROWS_A_TASK = 200_000
ORDER_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def run_sql(spark: SparkSession, sf_dir: str, sql: str, by_order: bool = False) -> DataFrame:
    """A sample's rows.  The tables are views of this call only.

    by_order deals orders and lineitem out by order, in as many parts as lineitem's rows ask for: what
    joins or groups by order then holds a bounded number of rows a task, where parts put together by
    their bytes hold ever more, as keys shrink well.
    """
    used = {t: scanned(spark, f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql}
    if by_order and used.keys() & ORDER_KEYS.keys():
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        parts = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
        used |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(parts, key) for t, key in ORDER_KEYS.items() if t in used}
    text = sql
    for name in used:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **used)
