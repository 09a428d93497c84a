"""Queries of review panels, of runs side by side and of bundle records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import adapt, diff, panel
from ..tables import settled
from . import samples

CODERS, SEED, PACKET, FLOORS = 3, "seed-7", "packet-1", [0.2, 0.4, 0.6]

ATOMS = "SELECT o_orderkey - o_orderkey % 2 AS parent_id, o_orderkey AS atom_id FROM orders"
PARENTS = "SELECT DISTINCT o_orderkey - o_orderkey % 2 AS parent_id FROM orders"
VOTES = """
SELECT DISTINCT o_orderkey AS atom_id, 'coder-' || CAST(l_linenumber AS STRING) AS coder,
  CASE CASE WHEN o_orderkey % 9 < 6 THEN (o_orderkey - o_orderkey % 2) % 3 ELSE (o_orderkey + l_linenumber) % 4 END
    WHEN 0 THEN 'supports' WHEN 1 THEN 'supports' WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'insufficient' ELSE 'refutes' END ELSE 'retrieval_gap' END AS label,
  CASE WHEN (o_orderkey + 3 * l_linenumber) % 23 = 0 THEN 'unsure' ELSE 'sure' END AS confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 3
"""
SELECTIONS = """
SELECT DISTINCT o_orderkey AS atom_id, 'coder-' || CAST(l_linenumber AS STRING) AS coder, 'c-' || CAST(CASE WHEN o_orderkey % 4 = 0 THEN l_linenumber ELSE 1 END AS STRING) AS candidate_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 3 AND o_orderkey % 10 > 0
UNION ALL
SELECT DISTINCT o_orderkey, 'coder-' || CAST(l_linenumber AS STRING), 'd-' || CAST(l_linenumber % 2 AS STRING)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 3 AND o_orderkey % 3 = 0
"""
DECOMPOSITIONS = """
SELECT DISTINCT o_orderkey - o_orderkey % 2 + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS parent_id, 'coder-' || CAST(r_regionkey AS STRING) AS coder,
  CASE WHEN (o_custkey + r_regionkey) % 17 = 0 AND o_orderkey % 2 = 0 THEN 'needs_revision' ELSE 'approved' END AS status
FROM orders JOIN region ON r_regionkey BETWEEN 1 AND 3 WHERE o_orderkey % 2 = 0 AND (o_orderkey * r_regionkey) % 11 > 0
"""
CANDIDATES = """
SELECT DISTINCT o_orderkey AS atom_id, 'c-' || CAST(l_linenumber AS STRING) AS candidate_id, 's-' || CAST(o_orderkey % 5 AS STRING) AS source_id,
  'p-' || CAST(l_linenumber AS STRING) AS passage_id, md5('c-' || CAST(l_linenumber AS STRING)) AS passage_hash
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
CHOSEN = """
SELECT DISTINCT o_orderkey AS atom_id, CASE WHEN o_orderkey % 19 = 0 THEN 'c-9' ELSE 'c-1' END AS candidate_id, 's-' || CAST(o_orderkey % 5 AS STRING) AS source_id,
  'p-1' AS passage_id, CASE WHEN o_orderkey % 17 = 0 THEN md5('other') ELSE md5('c-1') END AS passage_hash
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1
"""
_PASSAGE = """
SELECT DISTINCT o_orderkey AS claim_id, 's-' || CAST(o_orderkey % 5 AS STRING) AS source_id, 'p-' || CAST(l_linenumber AS STRING) AS passage_id,
  md5(CAST(l_linenumber AS STRING)) AS passage_hash, {text} AS passage_text
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber {which}
"""
SUPPORT = _PASSAGE.format(text="'text ' || CAST(l_linenumber AS STRING)", which="<= 3")
COUNTER = _PASSAGE.format(text="'text ' || CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE l_linenumber END AS STRING)", which=">= 3")
SOURCES = "SELECT 's-' || CAST(r_regionkey AS STRING) AS source_id, r_name AS source_title FROM region WHERE r_regionkey > 0"

GOLD = "SELECT o_orderkey AS claim_id, CASE o_orderkey % 7 WHEN 2 THEN 'partially_supported' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'contradicted' WHEN 5 THEN 'not_checkable' ELSE 'supported' END AS gold FROM orders"
_TRACES = """
SELECT claim_id, CASE v WHEN 0 THEN 'supported' WHEN 1 THEN 'partially_supported' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'contradicted' ELSE 'not_checkable' END AS verdict,
  CASE v WHEN 2 THEN 'weak' WHEN 4 THEN 'no_entail_signal' END AS reason, CASE v WHEN 0 THEN 'entail' WHEN 1 THEN 'entail' WHEN 3 THEN 'contradict' ELSE 'neutral' END AS signal
FROM (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % {m} < 3 THEN o_orderkey % {m} + 1 ELSE CASE o_orderkey % 7 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE 0 END END AS v FROM orders) x
"""
BASELINE, CANDIDATE = _TRACES.format(m=11), _TRACES.format(m=5)
SIMILAR = """
SELECT DISTINCT o_orderkey AS claim_id, 'p-' || CAST(l_linenumber AS STRING) || '-' || CAST(o_orderkey % 7 AS STRING) AS passage_id,
  CAST((l_orderkey * 5 + l_linenumber * 11) % 101 AS DOUBLE) / CAST(128 AS DOUBLE) AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
CLAIM_IDS = "SELECT o_orderkey AS claim_id, o_orderkey % 6 = 0 OR o_orderkey % 7 = 5 AS negated FROM orders"
TEXTS = f"""
SELECT c.claim_id AS passage_id, c.claim_text || ' ' || CASE WHEN length(c.claim_id) % 2 = 0 THEN '12 34! ' ELSE '' END || e.excerpt_text AS text
FROM ({samples.CLAIMS}) c JOIN ({samples.EXCERPTS}) e ON substring(c.claim_id, 7) = substring(e.excerpt_id, 5)
"""
RECORDS = """
SELECT 'ref-' || CAST(o_orderkey AS STRING) AS ref, CASE o_orderkey % 7 WHEN 0 THEN 'supported' WHEN 2 THEN 'partially_supported' WHEN 3 THEN 'unsupported' ELSE 'reasonable_inference' END AS raw_gold,
  CASE WHEN o_orderkey % 3 = 0 THEN 'overconfident' WHEN o_orderkey % 3 = 1 THEN 'missing_needed' END AS flag, CASE o_orderkey % 4 WHEN 0 THEN ' missing_needed ' WHEN 1 THEN 'present' END AS citation
FROM orders WHERE o_orderkey % 31 > 0
"""
BLINDING = """
SELECT 'ref-' || CAST(o_orderkey AS STRING) AS ref, o_orderkey AS claim_id, 'c' || CAST(o_orderkey % 3 AS STRING) AS condition, 'm' || CAST(o_custkey % 4 AS STRING) AS model, CAST(o_orderkey % 5 AS DOUBLE) AS confidence
FROM orders WHERE o_orderkey % 37 > 0
"""
PROFILES = """
SELECT s_nationkey AS bundle_id, 's-' || CAST(s_suppkey AS STRING) AS source_id,
  CASE s_suppkey % 7 WHEN 0 THEN 'journal_article' WHEN 1 THEN 'regulatory_guidance' WHEN 2 THEN 'preprint' WHEN 3 THEN 'web_page' WHEN 4 THEN 'book' WHEN 5 THEN 'other' ELSE 'film' END AS source_type,
  CASE s_suppkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'background' END AS trust_level,
  CASE WHEN s_suppkey % 3 > 0 THEN 'https://example.org/' || CAST(s_suppkey AS STRING) END AS url,
  CASE s_suppkey % 5 WHEN 0 THEN 'undated' WHEN 1 THEN NULL ELSE '20' || CAST(10 + s_suppkey % 10 AS STRING) || '-03-0' || CAST(1 + s_suppkey % 9 AS STRING) || 'T00:00:00Z' END AS publication_date
FROM supplier
"""
BUNDLE_PASSAGES = """
SELECT DISTINCT s_nationkey AS bundle_id, 's-' || CAST(s_suppkey AS STRING) AS source_id, 'p-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS passage_id,
  'passage ' || CAST(l_orderkey AS STRING) AS passage_text, CASE l_linenumber WHEN 1 THEN 'Results' WHEN 2 THEN '' END AS section, CAST(l_linenumber AS INT) AS paragraph_index,
  CAST(l_orderkey % 50 AS INT) AS char_start, CAST(l_orderkey % 50 + l_linenumber * 10 - 10 AS INT) AS char_end, 'manual' AS extraction_method, md5(CAST(l_orderkey AS STRING)) AS passage_hash,
  md5(CAST(s_suppkey AS STRING)) AS source_content_hash, 'run-1' AS scaffold_run_id, 'v2' AS evidence_builder_version, l_orderkey * 10 + l_linenumber AS load_order
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
"""
LOCATED = """
SELECT o_custkey AS bundle_id, o_orderkey AS claim_id, 'condition' || CAST(o_orderkey % 3 AS STRING) AS workflow_condition, 'task-' || CAST(o_orderkey % 9 AS STRING) AS task_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'sourced' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'unsupported' ELSE 'inferred' END AS scaffold_support_status,
  CAST(o_orderkey % 8 AS DOUBLE) / CAST(8 AS DOUBLE) AS scaffold_claim_strength, CAST(o_orderkey % 4 AS DOUBLE) / CAST(4 AS DOUBLE) AS scaffold_extraction_fidelity,
  o_orderkey % 2 = 0 AS scaffold_counterevidence_found, o_orderkey % 5 = 0 AS scaffold_downgraded
FROM orders
"""


def _rows(spark: SparkSession, sf_dir: str, *sqls: str) -> list[DataFrame]:
    return [samples.run_sql(spark, sf_dir, sql, by_order=True) for sql in sqls]


def claim_sample(spark, sf_dir):
    (atoms,) = _rows(spark, sf_dir, ATOMS)
    return panel.hash_sample(atoms.select("atom_id"), "atom_id", SEED, 100)


def candidate_shuffle(spark, sf_dir):
    return panel.hash_shuffle(_rows(spark, sf_dir, CANDIDATES)[0], SEED)


def candidate_union(spark, sf_dir):
    return panel.candidate_union(*_rows(spark, sf_dir, SUPPORT, COUNTER, SOURCES))


def candidate_drift(spark, sf_dir):
    return panel.candidate_drift(*_rows(spark, sf_dir, SUPPORT, COUNTER))


def _first_coder(spark, sf_dir):
    votes, decompositions = _rows(spark, sf_dir, VOTES, DECOMPOSITIONS)
    return votes.filter("coder = 'coder-1'").drop("coder"), decompositions.filter("coder = 'coder-1'").drop("coder")


def export_faults(spark, sf_dir):
    decisions, decompositions = _first_coder(spark, sf_dir)
    parents, atoms, candidates, chosen = _rows(spark, sf_dir, PARENTS, ATOMS, CANDIDATES, CHOSEN)
    return panel.export_faults(parents, atoms, candidates, decompositions, decisions, chosen)


def parent_results(spark, sf_dir):
    decisions, decompositions = _first_coder(spark, sf_dir)
    return panel.parent_results(_rows(spark, sf_dir, ATOMS)[0], decompositions, decisions)


def _dispositions(spark, sf_dir):
    atoms, votes, selections = _rows(spark, sf_dir, ATOMS, VOTES, SELECTIONS)
    return panel.dispositions(atoms, votes, selections, CODERS)


def atom_dispositions(spark, sf_dir):
    return _dispositions(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("shared", "all_chosen")})


def silver_parents(spark, sf_dir):
    return panel.silver_parents(_dispositions(spark, sf_dir))


def _audited(spark, sf_dir):
    # read several times
    found = settled(_dispositions(spark, sf_dir).select("parent_id", "atom_id", "disposition", "label"))
    silver = panel.silver_parents(found)
    return found, silver, panel.audit_sample(silver, _rows(spark, sf_dir, PARENTS)[0].count(), PACKET)


def audit_sample(spark, sf_dir):
    return _audited(spark, sf_dir)[2]


def human_queue(spark, sf_dir):
    found, _, sample = _audited(spark, sf_dir)
    return panel.human_queue(found, sample)


def panel_counts(spark, sf_dir):
    return panel.panel_counts(*_audited(spark, sf_dir))


def majority_triage(spark, sf_dir):
    return panel.majority_triage(*_rows(spark, sf_dir, ATOMS, VOTES, SELECTIONS)).withColumn("backed", F.array_join("backed", ","))


#: A request an order, and its lines as receipts of several attempts, sound and faulty.
REQUESTS = "SELECT o_orderkey AS request_id, CONCAT('h-', CAST(o_orderkey AS STRING)) AS request_hash, CONCAT('m', CAST(o_custkey % 3 AS STRING)) AS model, CONCAT('a-', CAST(o_orderkey % 500 AS STRING)) AS atom_id FROM orders"
RECEIPTS = """
SELECT l_orderkey AS request_id, l_linenumber AS attempt, CASE WHEN (l_orderkey + l_linenumber) % 17 > 0 THEN l_partkey % 40 END AS called_at, CASE WHEN l_orderkey % 41 = 3 THEN 'receipt-0' ELSE 'receipt-1' END AS form,
  CASE WHEN l_suppkey % 5 = 1 THEN 'h-0' ELSE CONCAT('h-', CAST(l_orderkey AS STRING)) END AS r_hash, CASE WHEN l_partkey % 3 = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason,
  CONCAT('m', CAST(CASE WHEN l_partkey % 7 = 0 THEN 9 ELSE o_custkey % 3 END AS STRING)) AS r_model, CASE WHEN l_quantity > 45 THEN 2 ELSE 1 END AS texts,
  CASE WHEN l_orderkey % 4 = 0 THEN 'refutes' ELSE 'supports' END AS output
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def settled_receipts(spark, sf_dir):
    return panel.settled_receipts(*_rows(spark, sf_dir, REQUESTS, RECEIPTS))


def receipt_triage(spark, sf_dir):
    """Majorities of the votes that receipts hold; unavailable ones are no votes."""
    requests, receipts = _rows(spark, sf_dir, REQUESTS, RECEIPTS)
    votes = panel.settled_receipts(requests, receipts).join(requests, "request_id").filter("output is not null").select("atom_id", F.col("request_id").alias("coder"), F.col("output").alias("label"))
    none = votes.select("atom_id", "coder", F.lit("").alias("candidate_id")).limit(0)
    return panel.majority_triage(requests.select("atom_id").distinct(), votes, none).drop("backed")


def pairwise_agreement(spark, sf_dir):
    return panel.pairwise_agreement(*_rows(spark, sf_dir, ATOMS, DECOMPOSITIONS, VOTES))


def _diff(spark, sf_dir):
    gold, baseline, candidate, signals = _rows(spark, sf_dir, GOLD, BASELINE, CANDIDATE, samples.SIGNALS)
    return diff.diff_rows(gold, baseline, signals.filter("score >= 0.4"), candidate, signals.filter("score >= 0.25"))


def diff_rows(spark, sf_dir):
    return _diff(spark, sf_dir)


def diff_summary(spark, sf_dir):
    return diff.diff_summary(_diff(spark, sf_dir))


def floor_sweep(spark, sf_dir):
    return diff.floor_sweep(*_rows(spark, sf_dir, SIMILAR, samples.SIGNALS, CLAIM_IDS), FLOORS)


def sentence_windows(spark, sf_dir):
    return diff.sentence_windows(_rows(spark, sf_dir, TEXTS)[0])


def _targets(spark, sf_dir):
    baseline, signals = _rows(spark, sf_dir, BASELINE, samples.SIGNALS)
    return diff.fallback_targets(baseline, signals.filter("score >= 0.4"))


def fallback_targets(spark, sf_dir):
    return _targets(spark, sf_dir).select("claim_id")


def variant_summary(spark, sf_dir):
    return diff.variant_summary(_diff(spark, sf_dir), _targets(spark, sf_dir))


def absence_route(spark, sf_dir):
    return diff.absence_route(*_rows(spark, sf_dir, BASELINE, CLAIM_IDS, samples.SIGNALS, samples.PASSAGES))


def joined_gold(spark, sf_dir):
    records, key = _rows(spark, sf_dir, RECORDS, BLINDING)
    flags = F.when(F.col("flag").isNotNull(), F.array("flag"))
    return diff.join_gold(records.withColumn("flags", flags), key).withColumn("flags", F.array_join("flags", ","))


def bundle_excerpts(spark, sf_dir):
    return adapt.excerpts(*_rows(spark, sf_dir, PROFILES, BUNDLE_PASSAGES)).withColumn("source_date", F.col("source_date").cast("string"))


def passage_faults(spark, sf_dir):
    return adapt.bad_offsets(_rows(spark, sf_dir, BUNDLE_PASSAGES)[0])


def claim_locations(spark, sf_dir):
    return _rows(spark, sf_dir, LOCATED)[0].select("claim_id", adapt.claim_location().alias("location"))


def request_passages(spark, sf_dir):
    claims = _rows(spark, sf_dir, "SELECT o_custkey AS bundle_id, o_orderkey AS claim_id, 'x' AS claim_text, 'extracted_claim' AS claim_type FROM orders")[0]
    return adapt.requests(claims, _rows(spark, sf_dir, BUNDLE_PASSAGES)[0])[1].withColumn("ordinal", F.col("ordinal").cast("long"))


def scope_links(spark, sf_dir):
    """Claims with their passages as arrays, flattened again."""
    rows = samples.run_sql(spark, sf_dir, samples.SIGNALS)
    pair = F.struct(F.lit("s").alias("source_id"), F.col("passage_id").alias("passage_id"))
    claims = rows.groupBy(F.lit("b").alias("bundle_id"), "claim_id").agg(
        F.collect_list(F.when(F.col("label") != "contradict", pair)).alias("evidence"), F.collect_list(F.when(F.col("label") == "contradict", pair)).alias("counterevidence")
    )
    kind = F.when(F.col("claim_id") % 8 == 0, "method_note").otherwise("extracted_claim")
    return adapt.scope_links(claims.withColumn("claim_type", kind))


QUERIES = {
    f.__name__: f
    for f in (
        claim_sample, candidate_shuffle, candidate_union, candidate_drift, export_faults, parent_results, atom_dispositions, silver_parents, audit_sample, human_queue, panel_counts,
        majority_triage, settled_receipts, receipt_triage, pairwise_agreement, diff_rows, diff_summary, floor_sweep, sentence_windows, fallback_targets, variant_summary, absence_route, joined_gold,
        bundle_excerpts, passage_faults, claim_locations, request_passages, scope_links,
    )
}


def _mapping(col: str, names: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " ELSE 'unknown' END"


_SETTLED = f"""
requests AS ({REQUESTS}),
receipts AS ({RECEIPTS}),
told AS (SELECT q.request_id, r.attempt, r.called_at, r.output, r.attempt IS NOT NULL AS there,
    CASE WHEN r.attempt IS NULL THEN 'no receipt' WHEN form <> 'receipt-1' THEN 'unsupported form' WHEN r_hash <> request_hash THEN 'request hash differs' WHEN stop_reason <> 'end_turn' THEN 'answer did not end'
      WHEN r_model <> model THEN 'model differs' WHEN texts <> 1 THEN 'not one text' WHEN called_at IS NULL THEN 'no time of the call' END AS f
  FROM requests q LEFT JOIN receipts r USING (request_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY f IS NULL DESC, called_at DESC NULLS LAST, attempt DESC NULLS LAST, f DESC) AS k, count(*) FILTER (there) OVER (PARTITION BY request_id) AS attempts FROM told),
settled AS (SELECT request_id, attempts, CASE WHEN f IS NULL THEN attempt END AS attempt, CASE WHEN f IS NULL THEN output END AS output, f AS fault FROM ranked WHERE k = 1)"""

_FOUND = f"""
votes AS ({VOTES}), selections AS ({SELECTIONS}), atoms AS ({ATOMS}),
chosen AS (SELECT atom_id, candidate_id, count(DISTINCT coder) AS n FROM selections GROUP BY ALL),
lists AS (SELECT atom_id, string_agg(candidate_id, ',' ORDER BY candidate_id) AS u, coalesce(string_agg(candidate_id, ',' ORDER BY candidate_id) FILTER (n = {CODERS}), '') AS b FROM chosen GROUP BY atom_id),
tally AS (SELECT atom_id, count(DISTINCT coder) AS c, count(DISTINCT label) AS labels, max(label) AS l, bool_or(confidence = 'unsure') AS unsure FROM votes GROUP BY atom_id),
kinds AS (
  SELECT parent_id, atom_id, l, coalesce(u, '') AS u, coalesce(b, '') AS b,
    CASE WHEN coalesce(c, 0) < {CODERS} THEN 'missing_vote_queue' WHEN labels > 1 THEN 'label_disagreement_queue' WHEN unsure THEN 'uncertainty_queue' WHEN l = 'retrieval_gap' THEN 'retrieval_gap_queue'
      WHEN l IN ('supports', 'refutes') AND coalesce(b, '') = '' THEN 'rationale_disagreement_queue' ELSE 'silver_candidate' END AS d
  FROM atoms LEFT JOIN tally USING (atom_id) LEFT JOIN lists USING (atom_id)),
silver AS (
  SELECT parent_id, CASE WHEN bool_or(l = 'refutes') THEN 'contradicted' WHEN bool_and(l = 'supports') THEN 'supported' WHEN bool_and(l = 'insufficient') THEN 'not_checkable' ELSE 'partially_supported' END AS verdict
  FROM kinds GROUP BY parent_id HAVING bool_and(d = 'silver_candidate')),
audited AS (
  SELECT parent_id FROM silver ORDER BY sha256('{PACKET}:audit:' || parent_id::VARCHAR), parent_id
  LIMIT (SELECT greatest(2, round(count(DISTINCT parent_id) * 0.2))::BIGINT FROM atoms)),
queued AS (SELECT parent_id, atom_id::VARCHAR || ': ' || d AS reason FROM kinds WHERE d <> 'silver_candidate' UNION ALL SELECT parent_id, 'deterministic unanimous-item audit' FROM audited)
"""
_DIFF = f"""
gold AS ({GOLD}), b AS ({BASELINE}), c AS ({CANDIDATE}), s AS ({samples.SIGNALS}),
per AS (
  SELECT claim_id, count(*) FILTER (score >= 0.4) AS nb, count(*) FILTER (score >= 0.25) AS nc,
    coalesce(string_agg(passage_id, ';' ORDER BY passage_id) FILTER (score >= 0.25 AND score < 0.4), '') AS fresh FROM s GROUP BY claim_id),
d AS (
  SELECT claim_id, gold, b.verdict AS baseline_verdict, c.verdict AS candidate_verdict,
    CASE WHEN b.verdict <> gold AND c.verdict = gold THEN 'recovered' WHEN b.verdict = gold AND c.verdict <> gold THEN 'regressed' WHEN b.verdict <> gold AND b.verdict <> c.verdict THEN 'changed_but_still_miss'
      WHEN c.verdict = gold THEN 'unchanged_match' ELSE 'unchanged_miss' END AS classification,
    coalesce(b.reason, '') AS baseline_reason, coalesce(c.reason, '') AS candidate_reason, b.signal AS baseline_signal, c.signal AS candidate_signal,
    coalesce(nb, 0)::BIGINT AS baseline_entailments, coalesce(nc, 0)::BIGINT AS candidate_entailments, coalesce(fresh, '') AS newly_admitted,
    gold = 'supported' AND b.verdict <> 'contradicted' AND c.verdict = 'contradicted' AS new_false_contradiction
  FROM gold JOIN b USING (claim_id) JOIN c USING (claim_id) LEFT JOIN per USING (claim_id)),
targets AS (SELECT claim_id FROM b JOIN per USING (claim_id) WHERE b.signal = 'neutral' AND b.verdict = 'not_checkable' AND b.reason = 'no_entail_signal' AND nb > 0)
"""
_CODER = f"""
votes AS (SELECT atom_id, label, confidence FROM ({VOTES}) WHERE coder = 'coder-1'), decompositions AS (SELECT parent_id, status FROM ({DECOMPOSITIONS}) WHERE coder = 'coder-1'), atoms AS ({ATOMS})
"""

ORACLES = {
    "claim_sample": f"SELECT o_orderkey AS atom_id FROM orders ORDER BY sha256('{SEED}:' || o_orderkey::VARCHAR), o_orderkey LIMIT 100",
    "candidate_shuffle": f"""
SELECT atom_id, candidate_id, row_number() OVER (PARTITION BY atom_id ORDER BY sha256('{SEED}:' || atom_id::VARCHAR || ':' || candidate_id), candidate_id) AS place FROM ({CANDIDATES})""",
    "candidate_union": f"""
WITH u AS ({SUPPORT} UNION {COUNTER}),
kept AS (SELECT claim_id, source_id, passage_id, passage_hash, min(passage_text) AS passage_text FROM u GROUP BY ALL)
SELECT kept.*, source_id || '/' || passage_id AS candidate_id, source_title FROM kept LEFT JOIN ({SOURCES}) USING (source_id)""",
    "candidate_drift": f"SELECT claim_id, source_id, passage_id, count(*) AS versions FROM ({SUPPORT} UNION {COUNTER}) GROUP BY ALL HAVING count(*) > 1",
    "export_faults": f"""
WITH {_CODER}, candidates AS ({CANDIDATES}), chosen AS ({CHOSEN}), parents AS ({PARENTS})
SELECT DISTINCT * FROM (
  SELECT 'unknown_parent' AS kind, parent_id::VARCHAR AS id FROM decompositions WHERE parent_id NOT IN (SELECT parent_id FROM parents)
  UNION ALL SELECT 'unknown_atom', atom_id::VARCHAR FROM votes WHERE atom_id NOT IN (SELECT atom_id FROM atoms)
  UNION ALL SELECT 'decision_without_approval', atom_id::VARCHAR FROM votes JOIN atoms USING (atom_id) LEFT JOIN decompositions USING (parent_id) WHERE status IS DISTINCT FROM 'approved'
  UNION ALL SELECT 'candidate_not_available', h.atom_id::VARCHAR || ':' || h.candidate_id FROM chosen h LEFT JOIN candidates c USING (atom_id, candidate_id) WHERE c.source_id IS NULL
  UNION ALL SELECT 'provenance_drift', h.atom_id::VARCHAR || ':' || h.candidate_id FROM chosen h JOIN candidates c USING (atom_id, candidate_id)
    WHERE (h.source_id, h.passage_id, h.passage_hash) IS DISTINCT FROM (c.source_id, c.passage_id, c.passage_hash)
  UNION ALL SELECT 'missing_decomposition', parent_id::VARCHAR FROM parents WHERE parent_id NOT IN (SELECT parent_id FROM decompositions)
  UNION ALL SELECT 'needs_revision', parent_id::VARCHAR FROM decompositions WHERE status <> 'approved'
  UNION ALL SELECT 'missing_decision', atom_id::VARCHAR FROM atoms WHERE atom_id NOT IN (SELECT atom_id FROM votes))""",
    "parent_results": f"""
WITH {_CODER},
one AS (
  SELECT parent_id, max(status) AS s, bool_or(label IS NULL) AS missing, bool_or(confidence = 'unsure') AS unsure, list(label) AS ls
  FROM atoms LEFT JOIN decompositions USING (parent_id) LEFT JOIN votes USING (atom_id) GROUP BY parent_id),
told AS (
  SELECT parent_id, unsure, CASE WHEN s IS NULL THEN 'decomposition not reviewed' WHEN s <> 'approved' THEN 'decomposition needs revision' WHEN missing THEN 'one or more atom decisions are missing'
    WHEN list_contains(ls, 'retrieval_gap') THEN 'one or more atoms have a retrieval gap; no parent verdict derived' WHEN list_contains(ls, 'refutes') THEN 'at least one material atom is refuted'
    WHEN list_distinct(ls) = ['supports'] THEN 'all material atoms are supported' WHEN list_distinct(ls) = ['insufficient'] THEN 'all material atoms are insufficient in the bounded packet'
    ELSE 'at least one atom is supported and at least one is insufficient' END AS reason FROM one),
named AS (SELECT *, CASE WHEN reason LIKE 'at least one material%' THEN 'contradicted' WHEN reason LIKE 'all material atoms are s%' THEN 'supported' WHEN reason LIKE 'all material%' THEN 'not_checkable'
  WHEN reason LIKE 'at least one atom%' THEN 'partially_supported' ELSE 'pending' END AS verdict FROM told)
SELECT parent_id, verdict, verdict = 'pending' OR coalesce(unsure, false) AS second_review, reason FROM named""",
    "atom_dispositions": f"""
WITH {_FOUND}
SELECT parent_id, atom_id, d AS disposition, CASE WHEN d NOT IN ('missing_vote_queue', 'label_disagreement_queue') THEN l END AS label,
  CASE WHEN d IN ('missing_vote_queue', 'label_disagreement_queue', 'retrieval_gap_queue') THEN '' ELSE b END AS shared,
  CASE WHEN d IN ('missing_vote_queue', 'label_disagreement_queue', 'retrieval_gap_queue') THEN '' ELSE u END AS all_chosen FROM kinds""",
    "silver_parents": f"WITH {_FOUND} SELECT * FROM silver",
    "audit_sample": f"WITH {_FOUND} SELECT * FROM audited",
    "human_queue": f"WITH {_FOUND} SELECT * FROM queued",
    "panel_counts": f"""
WITH {_FOUND}
SELECT count(*) AS atoms, count(DISTINCT parent_id) AS parents, count(*) FILTER (d = 'silver_candidate') AS silver_atoms, (SELECT count(*) FROM silver) AS silver_parents,
  (SELECT count(DISTINCT parent_id) FROM queued) AS queued_parents, (SELECT count(*) FROM audited) AS audited_parents FROM kinds""",
    "majority_triage": f"""
WITH votes AS ({VOTES}), selections AS ({SELECTIONS}), atoms AS ({ATOMS}),
n AS (SELECT atom_id, label, count(*) AS n FROM votes GROUP BY ALL),
tops AS (SELECT atom_id, sum(n)::BIGINT AS total, max(n) AS top, arg_max(label, n) AS label, count(*) FILTER (n = m) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY atom_id) AS m FROM n) GROUP BY atom_id),
tiers AS (SELECT *, CASE WHEN ties = 1 AND total >= 3 AND top >= 3 THEN CASE WHEN 4 * top >= 3 * total THEN 'strong_majority_suggestion' ELSE 'unresolved' END
  WHEN ties = 1 AND total >= 2 AND top = total THEN 'weak_available_unanimity' ELSE 'unresolved' END AS tier FROM tops),
backs AS (SELECT atom_id, candidate_id FROM tiers JOIN votes USING (atom_id, label) JOIN selections USING (atom_id, coder) WHERE tier <> 'unresolved' GROUP BY ALL HAVING count(*) >= 2)
SELECT atom_id, coalesce(tier, 'unresolved') AS tier, CASE WHEN tier <> 'unresolved' THEN label END AS label, coalesce(total, 0) AS votes,
  coalesce((SELECT string_agg(candidate_id, ',' ORDER BY candidate_id) FROM backs WHERE backs.atom_id = atoms.atom_id), '') AS backed
FROM atoms LEFT JOIN tiers USING (atom_id)""",
    "settled_receipts": f"WITH {_SETTLED} SELECT request_id, attempts, attempt, output, fault FROM settled",
    "receipt_triage": f"""
WITH {_SETTLED}, votes AS (SELECT atom_id, output AS label FROM settled JOIN requests USING (request_id) WHERE output IS NOT NULL),
n AS (SELECT atom_id, label, count(*) AS n FROM votes GROUP BY ALL),
tops AS (SELECT atom_id, sum(n)::BIGINT AS total, max(n) AS top, arg_max(label, n) AS label, count(*) FILTER (n = m) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY atom_id) AS m FROM n) GROUP BY atom_id),
tiers AS (SELECT *, CASE WHEN ties = 1 AND total >= 3 AND top >= 3 THEN CASE WHEN 4 * top >= 3 * total THEN 'strong_majority_suggestion' ELSE 'unresolved' END
  WHEN ties = 1 AND total >= 2 AND top = total THEN 'weak_available_unanimity' ELSE 'unresolved' END AS tier FROM tops)
SELECT atom_id, coalesce(tier, 'unresolved') AS tier, CASE WHEN tier <> 'unresolved' THEN label END AS label, coalesce(total, 0) AS votes FROM (SELECT DISTINCT atom_id FROM requests) LEFT JOIN tiers USING (atom_id)""",
    "pairwise_agreement": f"""
WITH m AS (SELECT atom_id, coder, label FROM ({VOTES}) JOIN ({ATOMS}) USING (atom_id) JOIN ({DECOMPOSITIONS}) USING (parent_id, coder) WHERE status = 'approved')
SELECT a.coder AS coder_a, b.coder AS coder_b, count(*) AS comparable, count(*) FILTER (a.label = b.label) AS exact, round_even(count(*) FILTER (a.label = b.label) / count(*), 4) AS rate
FROM m a JOIN m b ON a.atom_id = b.atom_id AND a.coder < b.coder GROUP BY ALL""",
    "diff_rows": f"WITH {_DIFF} SELECT * FROM d",
    "diff_summary": f"""
WITH {_DIFF}
SELECT count(*) AS claims, {", ".join(f"count(*) FILTER (classification = '{c}') AS {c}" for c in diff.CLASSES)},
  count(*) FILTER (baseline_verdict <> candidate_verdict) AS verdict_changed, count(*) FILTER (new_false_contradiction) AS new_false_contradictions FROM d""",
    "floor_sweep": f"""
WITH floors(floor) AS (VALUES {", ".join(f"({f}::DOUBLE)" for f in FLOORS)}), r AS ({SIMILAR}), s AS ({samples.SIGNALS}), claims AS (SELECT o_orderkey AS claim_id FROM orders),
met AS (SELECT floor, s.* FROM floors JOIN r ON r.score >= floor JOIN s USING (claim_id, passage_id)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY floor, claim_id) AS n, row_number() OVER (PARTITION BY floor, claim_id ORDER BY label = 'neutral', score DESC, ordinal) AS k FROM met)
SELECT floor, claim_id, coalesce(n, 0) AS n_admitted, coalesce(label, 'neutral') AS label, coalesce(score, 0) AS score, passage_id
FROM floors CROSS JOIN claims LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (floor, claim_id)""",
    "sentence_windows": f"""
WITH t AS ({TEXTS}),
cut AS (SELECT passage_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM t),
kept AS (SELECT passage_id, s, list_filter(range(1, len(s) + 1), lambda i: regexp_matches(s[i], '\\p{{L}}')) AS k FROM cut),
w AS (SELECT passage_id, s, k, unnest(range(1, len(k) + 1)) AS i, 1 AS size FROM kept UNION ALL SELECT passage_id, s, k, unnest(range(1, len(k))) AS i, 2 AS size FROM kept),
bounds AS (SELECT *, k[i]::INT AS first, k[i + size - 1]::INT AS last FROM w)
SELECT passage_id, passage_id || '#s' || lpad(first::VARCHAR, 4, '0') || '-' || lpad(last::VARCHAR, 4, '0') AS fragment_id, first, last, size::INT AS size, array_to_string(s[first:last], ' ') AS text FROM bounds""",
    "fallback_targets": f"WITH {_DIFF} SELECT * FROM targets",
    "variant_summary": f"""
WITH {_DIFF}, m AS (SELECT *, claim_id IN (SELECT claim_id FROM targets) AS t FROM d)
SELECT count(*) FILTER (t) AS targets, count(*) FILTER (t AND classification = 'recovered') AS targets_recovered, count(*) FILTER (classification = 'regressed') AS regressed,
  count(*) FILTER (NOT t AND baseline_verdict <> candidate_verdict) AS changed_beside, count(*) FILTER (baseline_verdict = gold) AS exact_before, count(*) FILTER (candidate_verdict = gold) AS exact_after FROM m""",
    "absence_route": f"""
WITH b AS ({BASELINE}), c AS ({CLAIM_IDS}),
against AS (SELECT DISTINCT claim_id FROM ({samples.SIGNALS}) JOIN ({samples.PASSAGES}) USING (passage_id) WHERE label = 'contradict' AND trust_level = 'primary' AND NOT p_negation),
r AS (SELECT b.*, negated AND verdict = 'not_checkable' AND reason IS NOT DISTINCT FROM 'no_entail_signal' AND claim_id NOT IN (SELECT claim_id FROM against) AS route FROM b JOIN c USING (claim_id))
SELECT *, CASE WHEN route THEN 'supported' ELSE verdict END AS final FROM r""",
    "joined_gold": f"""
SELECT ref, claim_id, condition, model, raw_gold,
  CASE WHEN trim(coalesce(citation, '')) = 'missing_needed' AND flag IS DISTINCT FROM 'missing_needed' THEN concat_ws(',', flag, 'missing_needed') ELSE coalesce(flag, '') END AS flags,
  confidence = 0 AND CASE WHEN raw_gold = 'reasonable_inference' THEN 'supported' ELSE raw_gold END = 'supported' AS starved
FROM ({RECORDS}) FULL JOIN ({BLINDING}) USING (ref)""",
    "bundle_excerpts": f"""
SELECT bundle_id, source_id, source_id || '/' || passage_id AS excerpt_id, passage_text AS excerpt_text,
  'c_b_passage_id=' || passage_id || '; section=' || coalesce(nullif(section, ''), 'not recorded') || '; paragraph_index=' || paragraph_index || '; char_range=' || char_start || '-' || char_end
    || '; extraction_method=manual; passage_hash=' || passage_hash || '; source_content_hash=' || source_content_hash || '; scaffold_run_id=run-1; evidence_builder_version=v2' AS notes,
  {_mapping("source_type", K.SOURCE_TYPES)} AS source_type, {_mapping("trust_level", K.RELIABILITY)} AS reliability, url, try_cast(left(publication_date, 10) AS DATE)::VARCHAR AS source_date
FROM ({BUNDLE_PASSAGES}) JOIN ({PROFILES}) USING (bundle_id, source_id)""",
    "passage_faults": f"""
WITH p AS ({BUNDLE_PASSAGES})
SELECT bundle_id, source_id, passage_id, 'char_end must be greater than char_start' AS fault FROM p WHERE char_end <= char_start
UNION ALL SELECT bundle_id, source_id, passage_id, 'duplicate passage id' FROM p GROUP BY ALL HAVING count(*) > 1""",
    "claim_locations": f"""
SELECT claim_id, 'C-B bundle ' || bundle_id || '; workflow_condition=' || workflow_condition || '; task_id=' || task_id || '; scaffold_support_status=' || scaffold_support_status
  || '; scaffold_claim_strength=' || format('{{:.2f}}', scaffold_claim_strength) || '; scaffold_extraction_fidelity=' || format('{{:.2f}}', scaffold_extraction_fidelity)
  || '; scaffold_counterevidence_found=' || CASE WHEN scaffold_counterevidence_found THEN 'True' ELSE 'False' END || '; scaffold_downgraded=' || CASE WHEN scaffold_downgraded THEN 'True' ELSE 'False' END AS location
FROM ({LOCATED})""",
    "request_passages": f"""
SELECT bundle_id, source_id || '/' || passage_id AS passage_id, passage_text, row_number() OVER (PARTITION BY bundle_id ORDER BY source_id, load_order) AS ordinal FROM ({BUNDLE_PASSAGES})""",
    "scope_links": f"""
SELECT DISTINCT 'b' AS bundle_id, claim_id, 's/' || passage_id AS excerpt_id, CASE WHEN label = 'contradict' THEN 'counter' ELSE 'support' END AS role
FROM ({samples.SIGNALS}) WHERE claim_id % 8 > 0""",
}
