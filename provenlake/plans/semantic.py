"""Queries of the retrieve-entail verdicts and of calibration, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import canonical
from ..operators import calibrate, verdict
from . import samples
from .duck import array

#: Vectors of one bundle.
BUNDLE_VECTORS = 50


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.run_sql(spark, sf_dir, samples.CLAIM_FEATURES)
    one = F.array(F.struct(F.col("c_value").alias("value"), F.lit(None).cast("string").alias("unit")))
    return rows.withColumns({"c_quantities": F.when(F.col("c_has_value"), one).otherwise(F.slice(one, 1, 0)), "c_lemmas": F.array("c_lemma")})


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.run_sql(spark, sf_dir, samples.PASSAGES)
    one = F.array(F.struct(F.col("p_value").alias("value"), F.lit(None).cast("string").alias("unit")))
    return rows.withColumns({"p_quantities": one, "p_lemmas": F.array("p_lemma")}).select("passage_id", *verdict.PASSAGE_FEATURES)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir).select("claim_id", *verdict.CLAIM_FEATURES)
    return verdict.verdicts(claims, samples.run_sql(spark, sf_dir, samples.SIGNALS), _passages(spark, sf_dir))


def verdicts(spark, sf_dir):
    """One verdict a claim, with the suppressions that came before it."""
    found = _verdicts(spark, sf_dir)
    return found.select(
        "claim_id", "verdict", "reason", "confidence", F.array_join("audit_flags", ",").alias("flags"), F.array_join("rules", ",").alias("rules"), "label", "score", "passage_id",
        verdict.contract_verdict(F.col("verdict"), F.col("audit_flags")).alias("contract_verdict"),
    )


def audit_notes(spark, sf_dir):
    c = F.col
    notes = verdict.audit_notes(c("claim_id").cast("string"), c("verdict"), c("reason"), c("audit_flags"), c("label"), c("score"), c("confidence"))
    return _verdicts(spark, sf_dir).select("claim_id", notes.alias("notes"))


def entail_signal(spark, sf_dir):
    """The strongest result of each claim, unguarded."""
    return verdict.aggregate_signal(samples.run_sql(spark, sf_dir, samples.SIGNALS), samples.run_sql(spark, sf_dir, samples.CLAIM_FEATURES))


def rule_fires(spark, sf_dir):
    return calibrate.rule_fires(_verdicts(spark, sf_dir))


def retrieval(spark, sf_dir):
    """Each vector as a claim against its bundle's vectors: the five of the highest cosine."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("bundle_id", F.floor(F.col("vec_id") / BUNDLE_VECTORS))
    passages = vectors.select("bundle_id", F.col("vec_id").alias("passage_id"), F.col("vec_id").alias("ordinal"), "embedding")
    found = verdict.retrieve(vectors.select("bundle_id", F.col("vec_id").alias("claim_id"), "embedding"), passages)
    return found.select("claim_id", "passage_id", "score", F.col("rank").cast("long").alias("rank"), (F.col("score") >= K.RETRIEVAL_FLOOR).alias("admitted"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.run_sql(spark, sf_dir, samples.PAIRS)
    given = F.when(F.col("raw_flag") == "", F.array().cast("array<string>")).otherwise(F.array("raw_flag"))
    gold, gold_flags, citation = calibrate.crosswalk_gold(F.col("raw_gold"), given)
    cal_flags = F.when(F.col("cal_flag") == "", F.array().cast("array<string>")).otherwise(F.array("cal_flag"))
    return rows.withColumns({"gold": gold, "gold_flags": gold_flags, "citation": citation, "cal_flags": cal_flags})


def crosswalk(spark, sf_dir):
    return _pairs(spark, sf_dir).select("claim_id", "gold", F.array_join("gold_flags", ",").alias("gold_flags"), "citation")


def agreement(spark, sf_dir):
    return calibrate.exact_agreement(_pairs(spark, sf_dir))


def confusion(spark, sf_dir):
    return calibrate.confusion(_pairs(spark, sf_dir))


def kappa(spark, sf_dir):
    return calibrate.kappa(_pairs(spark, sf_dir)).select("n", *[F.round(c, 6).alias(c) for c in ("po", "pe", "kappa", "ci_low", "ci_high")])


def weighted_agreement(spark, sf_dir):
    return calibrate.weighted_agreement(_pairs(spark, sf_dir)).select("n", *[F.round(c, 6).alias(c) for c in ("weighted_kappa", "ac2")])


def adverse_by_group(spark, sf_dir):
    return calibrate.adverse_by_group(_pairs(spark, sf_dir))


def recall_floor(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return calibrate.recall_floor(pairs, pairs.filter("starved"))


def flag_tallies(spark, sf_dir):
    return calibrate.flag_tallies(_pairs(spark, sf_dir))


def alignment(spark, sf_dir):
    """Orders as labels against customers' numbers as traces: what stands on one side only."""
    gold = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("claim_id"))
    traces = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("claim_id"))
    starved = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("claim_id"))
    return calibrate.check_alignment(gold, traces, starved)


def canonical_orders(spark, sf_dir):
    """Each order with its lines as canonical JSON, and its hash; the fields are given in no order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.struct(F.col("l_linenumber").alias("number"), F.struct(F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount")).alias("rates"), F.col("l_returnflag").alias("flag"), (F.col("l_quantity") * 1e9).alias("large"))
    lines = lines.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"), F.concat_ws('"\n\\é', "o_orderstatus", "o_orderpriority").alias("note"), F.to_date("o_orderdate").alias("date"),
        F.create_map(F.lit("z"), F.col("o_custkey"), F.lit("A"), F.lit(None).cast("long")).alias("Map"), (F.col("o_orderkey") % 2 == 0).alias("even"),
    )
    found = canonical.with_canonical(orders.join(lines, "key", "left"), ["note", "total", "Map", "key", "lines", "even", "date"])
    return found.select("key", F.char_length("canonical").cast("long").alias("n_chars"), F.col("canonical_hash").alias("hash"))


def canonical_documents(spark, sf_dir):
    """The hash of each document's row as canonical JSON."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return canonical.with_canonical(docs, docs.columns).select("doc_id", F.col("canonical_hash").alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_orders, canonical_documents, verdicts, audit_notes, entail_signal, rule_fires, retrieval, crosswalk, agreement, confusion, kappa, weighted_agreement, adverse_by_group, recall_floor, flag_tallies, alignment,
    )
}

# --- SQL ----------------------------------------------------------------------

_PLACE = "row_number() OVER (PARTITION BY claim_id ORDER BY label = 'neutral', score DESC, ordinal)"
VERDICTS = f"""
signals AS ({samples.SIGNALS}), passages AS ({samples.PASSAGES}), features AS ({samples.CLAIM_FEATURES}),
ranked AS (
  SELECT f.*, s.passage_id, s.ordinal, s.label, s.score, p.* EXCLUDE (passage_id)
  FROM signals s JOIN features f USING (claim_id) LEFT JOIN passages p ON p.passage_id = s.passage_id WHERE s.label <> 'neutral'
  UNION ALL BY NAME SELECT *, 'neutral' AS label, 0::DOUBLE AS score FROM features),
gated AS (
  SELECT *, CASE WHEN sentence_type IN ('opinion', 'question', 'imperative') OR token_count < {K.LEAST_TOKENS} THEN 'A1_scope'
      WHEN NOT any_retrieved THEN 'A2_retrieval_empty' WHEN negated AND label = 'entail' AND NOT coalesce(p_negation, false) THEN 'A3_negation_backstop'
      WHEN label = 'contradict' AND score >= {K.CONTRADICTED} THEN 'A4_hard_contradiction' END AS gate,
    CASE WHEN label = 'entail' AND score >= {K.SUPPORTED} THEN 'supported' WHEN label = 'entail' THEN 'partially_supported' WHEN label = 'contradict' THEN 'unsupported' END AS provisional
  FROM ranked),
tested AS (
  SELECT *, coalesce(gate IS NULL AND provisional IS NOT NULL, false) AS plain,
    c_has_value AND p_value IS NOT NULL AND abs(c_value - p_value) > CASE WHEN approximate THEN {max(K.TOLERANCE, K.APPROX_TOLERANCE)} ELSE {K.TOLERANCE} END * greatest(abs(c_value), abs(p_value), 1) AS unmatched
  FROM gated),
fired AS (
  SELECT *, plain AND unmatched AS numeric_fired, plain AND claim_strong AND coalesce(p_scope = 'weak', false) AND provisional <> 'unsupported' AS over,
    plain AND provisional = 'supported' AND NOT coalesce(c_lemma = p_lemma, false) AND NOT claim_strong AS inferred,
    plain AND coalesce(trust_level = 'background', false) AS background, plain AND provisional = 'supported' AND hedges AS cautious
  FROM tested),
settled AS (
  SELECT *, CASE WHEN gate IN ('A1_scope', 'A2_retrieval_empty') THEN 'not_checkable' WHEN gate IS NOT NULL THEN 'contradicted' WHEN provisional IS NULL THEN 'not_checkable'
      WHEN numeric_fired THEN 'contradicted' WHEN over AND provisional = 'supported' THEN 'partially_supported' ELSE provisional END AS verdict,
    CASE WHEN gate = 'A1_scope' THEN 'out_of_scope' WHEN gate = 'A2_retrieval_empty' THEN 'no_evidence' WHEN gate IS NULL AND provisional IS NULL THEN 'no_entail_signal' END AS reason,
    CASE WHEN gate IS NOT NULL THEN 'high' WHEN provisional IS NULL THEN 'low' ELSE 'medium' END AS confidence
  FROM fired),
judged AS (
  SELECT *, {_PLACE} AS place,
    list_filter([CASE WHEN over THEN 'overstated' END, CASE WHEN inferred AND verdict NOT IN ('unsupported', 'contradicted') THEN 'inferred' END,
      CASE WHEN background THEN 'source_scope_error' END, CASE WHEN cautious AND verdict NOT IN ('unsupported', 'contradicted') THEN 'false_caution' END], lambda x: x IS NOT NULL) AS audit_flags,
    list_filter([coalesce(gate, 'B5_degree'), CASE WHEN numeric_fired THEN 'C6a_numeric' END, CASE WHEN over THEN 'C6b_strength_scope' END, CASE WHEN inferred THEN 'C6c_inferred' END,
      CASE WHEN background THEN 'C6d_source_scope' END, CASE WHEN cautious THEN 'C6f_false_caution' END], lambda x: x IS NOT NULL) AS own_rules,
    CASE WHEN verdict IN ('unsupported', 'contradicted') AND passage_id IS NOT NULL THEN
      CASE WHEN trust_level <> 'primary' THEN 'P1_eligibility_suppressed' WHEN negated AND label = 'contradict' AND coalesce(p_negation, false) THEN 'P2_absence_mirror_suppressed' END END AS suppressed
  FROM settled),
decided AS (SELECT claim_id, min(place) FILTER (suppressed IS NULL) AS first_place FROM judged GROUP BY claim_id),
lost AS (SELECT claim_id, list(suppressed ORDER BY place) AS names FROM judged JOIN decided USING (claim_id) WHERE place < first_place GROUP BY claim_id),
final AS (
  SELECT j.*, list_concat(coalesce(names, []), own_rules) AS rules FROM judged j JOIN decided d ON d.claim_id = j.claim_id AND d.first_place = j.place LEFT JOIN lost l ON l.claim_id = j.claim_id)
"""

PAIRS = f"""
raw AS ({samples.PAIRS}),
pairs AS (
  SELECT *, CASE WHEN raw_gold = 'reasonable_inference' THEN 'supported' ELSE raw_gold END AS gold,
    list_concat(CASE WHEN raw_gold = 'reasonable_inference' THEN ['inferred'] ELSE [] END,
      CASE raw_flag WHEN 'overconfident' THEN ['overstated'] WHEN 'source_scope_error' THEN ['source_scope_error'] WHEN 'false_caution' THEN ['false_caution'] ELSE [] END) AS gold_flags,
    CASE WHEN raw_flag = 'missing_needed' THEN 'missing_needed' ELSE 'not_applicable' END AS citation
  FROM raw)
"""
_ADVERSE = ", ".join(
    f"count(*) FILTER ({s} IN ('unsupported', 'contradicted')) AS {s}_adverse, count(*) FILTER ({s} <> 'not_checkable') AS {s}_checkable" for s in ("cal", "gold")
)
_SCALE = "(VALUES " + ", ".join(f"('{v}', {n})" for v, n in K.ORDINAL.items()) + ")"

ORACLES = {
    "verdicts": f"""WITH {VERDICTS} SELECT claim_id, verdict, reason, confidence, array_to_string(audit_flags, ',') AS flags, array_to_string(rules, ',') AS rules, label, score, passage_id,
      CASE WHEN verdict IN ('supported', 'partially_supported') AND list_contains(audit_flags, 'overstated') THEN 'overstated' WHEN verdict = 'contradicted' THEN 'unsupported' ELSE verdict END AS contract_verdict FROM final""",
    "audit_notes": f"""WITH {VERDICTS} SELECT claim_id, '{K.AUDITOR} retrieve-entail: ' || verdict || coalesce(' (' || reason || ')', '') || '; flags=' || coalesce(nullif(array_to_string(audit_flags, ','), ''), 'none')
      || '; citation_status=not_applicable; entail_signal=' || label || '@' || printf('%.4f', score) || '; audit_confidence=' || confidence || '. Full trace: claims/' || claim_id || '.audit-trace.json' AS notes FROM final""",
    "entail_signal": f"""WITH s AS ({samples.SIGNALS}), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY label = 'neutral', score DESC, ordinal) = 1)
      SELECT claim_id, coalesce(label, 'neutral') AS label, coalesce(score, 0)::DOUBLE AS score, passage_id FROM ({samples.CLAIM_FEATURES}) LEFT JOIN best USING (claim_id)""",
    "rule_fires": f"WITH {VERDICTS} SELECT rule_id, count(DISTINCT claim_id) AS fired FROM (SELECT claim_id, unnest(rules) AS rule_id FROM final) GROUP BY rule_id",
    "canonical_orders": """WITH lines AS (
      SELECT l_orderkey AS key, list({'flag': l_returnflag, 'large': l_quantity * 1e9, 'number': l_linenumber, 'rates': {'discount': l_discount, 'tax': l_tax}} ORDER BY l_linenumber, l_tax, l_discount, l_returnflag, l_quantity) AS lines FROM lineitem GROUP BY 1),
      texts AS (SELECT o_orderkey AS key, to_json({'Map': {'A': NULL, 'z': o_custkey}, 'date': o_orderdate::DATE::VARCHAR, 'even': o_orderkey % 2 = 0, 'key': o_orderkey, 'lines': lines,
        'note': o_orderstatus || '"' || chr(10) || '\\é' || o_orderpriority, 'total': o_totalprice})::VARCHAR AS t FROM orders LEFT JOIN lines ON key = o_orderkey)
      SELECT key, length(t)::BIGINT AS n_chars, 'sha256:' || sha256(t) AS hash FROM texts""",
    "canonical_documents": "SELECT doc_id, 'sha256:' || sha256(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})::VARCHAR) AS hash FROM documents",
    "retrieval": f"""WITH v AS (SELECT vec_id, vec_id // {BUNDLE_VECTORS} AS bundle, embedding::DOUBLE[] AS e FROM embeddings),
      pairs AS (SELECT a.vec_id AS claim_id, b.vec_id AS passage_id, floor(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) * 1000000 + 0.5) / 1000000 AS score
        FROM v a JOIN v b USING (bundle))
      SELECT *, score >= {K.RETRIEVAL_FLOOR} AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, passage_id) AS rank FROM pairs) WHERE rank <= {K.RETRIEVAL_TOP_K}""",
    "crosswalk": f"WITH {PAIRS} SELECT claim_id, gold, array_to_string(gold_flags, ',') AS gold_flags, citation FROM pairs",
    "agreement": f"WITH {PAIRS} SELECT count(*) FILTER (gold = cal) AS agree, count(*) AS total FROM pairs",
    "confusion": f"""WITH {PAIRS}, v AS (SELECT unnest({array(K.VERDICTS)}) AS x)
      SELECT a.x AS gold, b.x AS cal, (SELECT count(*) FROM pairs WHERE gold = a.x AND cal = b.x) AS n FROM v a, v b""",
    "kappa": f"""WITH {PAIRS}, v AS (SELECT unnest({array(K.VERDICTS)}) AS x),
      t AS (SELECT count(*) AS n, count(*) FILTER (gold = cal) / count(*) AS po FROM pairs),
      e AS (SELECT sum((SELECT count(*) FROM pairs WHERE gold = x) / n * (SELECT count(*) FROM pairs WHERE cal = x) / n) AS pe FROM v, t),
      k AS (SELECT n, po, pe, (po - pe) / (1 - pe) AS kappa, {K.Z_95} * sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe))) AS half FROM t, e)
      SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round(kappa, 6) AS kappa, round(greatest(-1, kappa - half), 6) AS ci_low, round(least(1, kappa + half), 6) AS ci_high FROM k""",
    "weighted_agreement": f"""WITH {PAIRS}, s(v, k) AS {_SCALE}, o AS (SELECT a.k AS x, b.k AS y FROM pairs JOIN s a ON a.v = gold JOIN s b ON b.v = cal),
      t AS (SELECT count(*) AS n, avg(1 - ((x - y) / 4) ** 2) AS pa FROM o),
      m AS (SELECT k, (SELECT count(*) FROM o WHERE x = k) / n AS g, (SELECT count(*) FROM o WHERE y = k) / n AS c FROM s, t),
      e AS (SELECT sum((1 - ((a.k - b.k) / 4) ** 2) * a.g * b.c) AS pe, sum(1 - ((a.k - b.k) / 4) ** 2) AS total FROM m a, m b),
      q AS (SELECT sum((g + c) / 2 * (1 - (g + c) / 2)) AS spread, count(*) AS k FROM m)
      SELECT n, round((pa - pe) / (1 - pe), 6) AS weighted_kappa, round((pa - total / (k * (k - 1)) * spread) / (1 - total / (k * (k - 1)) * spread), 6) AS ac2 FROM t, e, q""",
    "adverse_by_group": f"""WITH {PAIRS} SELECT 'overall' AS kind, 'overall' AS name, {_ADVERSE} FROM pairs
      UNION ALL SELECT 'condition', condition, {_ADVERSE} FROM pairs GROUP BY condition UNION ALL SELECT 'model', model, {_ADVERSE} FROM pairs GROUP BY model""",
    "recall_floor": f"""WITH {PAIRS} SELECT count(*) AS starved_total, count(*) FILTER (cal = 'supported') AS supported, count(*) FILTER (cal = 'partially_supported') AS partially_supported,
      count(*) FILTER (cal IN ('unsupported', 'contradicted')) AS adverse, count(*) FILTER (cal = 'not_checkable') AS not_checkable FROM pairs WHERE starved""",
    "flag_tallies": f"""WITH {PAIRS} SELECT f AS flag, (SELECT count(*) FROM pairs WHERE list_contains(gold_flags, f)) AS gold_count, (SELECT count(*) FROM pairs WHERE cal_flag = f) AS cal_count
      FROM (SELECT unnest({array(K.AUDIT_FLAGS)}) AS f)""",
    "alignment": """SELECT 'gold_without_trace' AS problem, o_orderkey AS claim_id FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT 'trace_without_gold', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders)
      UNION ALL SELECT 'starved_without_gold', p_partkey FROM part WHERE p_partkey NOT IN (SELECT o_orderkey FROM orders)""",
}
