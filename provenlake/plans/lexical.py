"""Queries of the lexical audit and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import extract, match, pairs, report, rules
from ..tables import once_a_text, scanned, settled, with_texts
from . import samples
from .duck import (
    DOC_TEXT, any_of, array, bigrams, count_shared, dates, flag_case, norm, numbers, overlap, q, sentences_sql, sorted_numbers, term_list, term_set, tok, words,
)

def _ascii() -> Column:
    return F.regexp_replace("text", r"[^\x00-\x7F]", "z")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = samples.run_sql(spark, sf_dir, samples.CLAIMS)
    return with_texts(claims, once_a_text(claims, "claim_text", lambda texts: texts.withColumn("claim_type", extract.claim_type(F.col("claim_text")))), "claim_text")


def _excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.run_sql(spark, sf_dir, samples.EXCERPTS)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.run_sql(spark, sf_dir, samples.LINKS)


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the native audit (support) and linked counterevidence, as rule contexts, settled."""
    return _contexts(spark, sf_dir, _claims(spark, sf_dir))


def _contexts(spark: SparkSession, sf_dir: str, claims: DataFrame) -> DataFrame:
    excerpts = _excerpts(spark, sf_dir)
    best = match.best_candidates(match.score_candidates(claims, excerpts, features=False)).withColumn("role", F.lit("support"))
    counter = match.scoped_candidates(claims, excerpts, _links(spark, sf_dir).filter("role = 'counter'"))
    cols = ["bundle_id", "claim_id", "claim_text", "claim_type", "role", "rank", "source_id", "excerpt_id", "score", "excerpt_text", "notes", "reliability", "source_date", "url"]
    return settled(best.select(*cols).unionByName(counter.select(*cols)))


REFERENCE_DATE = "1999-06-30"


def _audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assessments, and the contexts that they rest on."""
    claims = _claims(spark, sf_dir)
    found = _contexts(spark, sf_dir, claims)
    return rules.assess_claims(claims, found, _excerpts(spark, sf_dir), REFERENCE_DATE), found


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir)[0]


# --- text -------------------------------------------------------------------


def tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.sha2(T.normalized(F.col("text")), 256).alias("norm_sha256"))


def stems(spark, sf_dir):
    terms = T.terms(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.size(F.array_distinct(terms)).cast("long").alias("n_distinct"), F.sha2(F.array_join(terms, " "), 256).alias("terms_sha256"))


def number_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.sorted_numbers(T.numbers(_ascii())), ",").alias("numbers"))


def date_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(T.dates(_ascii())), ",").alias("dates"))


def names_and_anchors(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat_ws(" / ", "p_name", "p_brand", "p_type")
    return parts.select("p_partkey", T.safe_name(name).alias("file_name"), T.anchor(name, "claim").alias("anchor"), T.text_hash(name).alias("hash"), report.escaped(F.concat(name, F.lit(" | `x`\n"))).alias("escaped"))


# --- extraction --------------------------------------------------------------


def claim_sentences(spark, sf_dir):
    return extract.claim_sentences(_docs(spark, sf_dir)).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("sentence").cast("long").alias("sentence"), "text")


def claim_types(spark, sf_dir):
    kinds = extract.claim_sentences(_docs(spark, sf_dir)).select(extract.claim_type(F.col("text")).alias("claim_type"))
    return kinds.unionAll(_claims(spark, sf_dir).select("claim_type")).groupBy("claim_type").agg(F.count("*").alias("n"))


def near_dup_claims(spark, sf_dir):
    """Near-duplicate pairs of claims within a bundle."""
    c = settled(_claims(spark, sf_dir).select("bundle_id", "claim_id", T.term_set(F.col("claim_text")).alias("terms")).withColumn("row", F.monotonically_increasing_id()))
    found = pairs.near_duplicate_pairs(c, "bundle_id")
    ids = c.select(F.col("row").alias("a"), F.col("claim_id").alias("one"))
    found = found.join(ids, "a").join(ids.withColumnsRenamed({"a": "b", "one": "other"}), "b")
    return found.select("bundle_id", F.least("one", "other").alias("claim_id"), F.greatest("one", "other").alias("other_id"))


def claims_deduped(spark, sf_dir):
    """Claims of drafts that a customer's order sentences make, near-duplicates folded away."""
    order = F.regexp_extract("claim_id", "[0-9]+", 0).cast("long")
    drafts = _claims(spark, sf_dir).withColumn("paragraph", F.row_number().over(Window.partitionBy("bundle_id").orderBy(order)))
    drafts = drafts.select(F.col("bundle_id").alias("doc_id"), "paragraph", F.lit(1).alias("sentence"), F.col("claim_text").alias("text"), "claim_type")
    return extract.dedupe_claims(drafts.filter("claim_type <> 'unclassified'"))


# --- matching -----------------------------------------------------------------


def pair_scores(spark, sf_dir):
    return match.score_bundle_pairs(_claims(spark, sf_dir), _excerpts(spark, sf_dir)).select("bundle_id", "claim_id", "source_id", "excerpt_id", "score")


def topk_candidates(spark, sf_dir):
    best = match.best_candidates(match.score_candidates(_claims(spark, sf_dir), _excerpts(spark, sf_dir)))
    return best.select("bundle_id", "claim_id", "source_id", "excerpt_id", "score", F.col("rank").cast("long").alias("rank"), match.rationale(F.col("reliability")).alias("rationale"))


def scoped_matches(spark, sf_dir):
    found = match.scoped_candidates(_claims(spark, sf_dir), _excerpts(spark, sf_dir), _links(spark, sf_dir))
    return found.select("bundle_id", "claim_id", "role", "source_id", "excerpt_id", "score", F.col("rank").cast("long").alias("rank"))


#: Threshold of blocked_pairs: low, as the texts share little scored wording.
BLOCKED_LEAST = 0.02


def blocked_pairs(spark, sf_dir):
    """Sentences of all benchmark items against all conversation turns, through shared keys."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    claims = extract.claim_sentences(items, "item_id").select(F.lit(0).alias("bundle_id"), F.format_string("c-%d-%d-%d", "item_id", "paragraph", "sentence").alias("claim_id"), F.col("text").alias("claim_text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = turns.select(F.lit(0).alias("bundle_id"), F.col("conv_id").cast("string").alias("source_id"), F.format_string("%d-%d", "conv_id", "turn").alias("excerpt_id"), F.col("text").alias("excerpt_text"))
    return match.score_blocked_pairs(claims, turns, BLOCKED_LEAST, features=False).select("claim_id", "source_id", "excerpt_id", "score")


# --- rules --------------------------------------------------------------------


def direct_support(spark, sf_dir):
    found = rules.with_support(contexts(spark, sf_dir))
    return found.select("bundle_id", "claim_id", "role", "excerpt_id", "numeric_direct", "date_direct", "text_direct", "direct", "adverse")


def flag_query(code: str):
    def run(spark, sf_dir):
        # an inner explode would infer a filter on flags and work the whole expression out again
        one = _assessed(spark, sf_dir).select("bundle_id", "claim_id", F.explode_outer("flags").alias("f")).filter(F.col("f.code") == code)
        return one.select("bundle_id", "claim_id", F.col("f.id").alias("flag_id"), F.col("f.risk").alias("risk"), F.col("f.message").alias("message"))

    return run


def support_labels(spark, sf_dir):
    return _assessed(spark, sf_dir).select("bundle_id", "claim_id", "claim_type", "support_signal", "support_label", "risk_label", F.array_join("codes", ",").alias("codes"), "explanation", F.array_join("limitations", " ").alias("limitations"))


def guidance(spark, sf_dir):
    return _assessed(spark, sf_dir).select("bundle_id", "claim_id", F.array_join("rewrite_guidance", " ").alias("guidance"))


def audit_summary(spark, sf_dir):
    return rules.audit_summary(_assessed(spark, sf_dir))


def deviations(spark, sf_dir):
    """Scaffold status against verdict: false caution, material deviation, notes."""
    rows = _assessed(spark, sf_dir).withColumn("n", F.regexp_extract("claim_id", "[0-9]+", 0).cast("long") % 4)
    rows = rows.withColumn("scaffold", F.element_at(F.array(*[F.lit(s) for s in ("sourced", "uncertain", "unsupported", "inferred")]), (F.col("n") + 1).cast("int")))
    cautious = rules.false_caution(F.col("scaffold"), F.col("support_label"), F.col("support_signal"))
    return rows.select("bundle_id", "claim_id", "scaffold", cautious.alias("false_caution"), rules.material_deviation(F.col("scaffold"), F.col("support_label")).alias("deviation"), rules.deviation_notes(F.col("scaffold"), F.col("support_label"), cautious).alias("notes"))


def evidence_links(spark, sf_dir):
    return report.evidence_links(contexts(spark, sf_dir)).withColumns({"claim_ids": F.array_join("claim_ids", ","), "source_date": F.col("source_date").cast("string")})


def claim_register(spark, sf_dir):
    return report.claim_register(*_audited(spark, sf_dir))


def quality_notes(spark, sf_dir):
    return report.quality_notes(*_audited(spark, sf_dir)).withColumn("notes", F.array_join("notes", " "))


QUERIES = {
    f.__name__: f
    for f in (
        tokens, stems, number_tokens, date_tokens, names_and_anchors, claim_sentences, claim_types, near_dup_claims, claims_deduped, pair_scores, topk_candidates,
        scoped_matches, blocked_pairs, direct_support, support_labels, guidance, audit_summary, deviations, evidence_links, claim_register, quality_notes,
    )
} | {f"flag_{code}": flag_query(code) for code in K.FLAGS}

# --- SQL ----------------------------------------------------------------------

_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(cn, '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{t}'" for t, ps in K.CLAIM_TYPES.items()) + " ELSE 'unclassified' END"

BASE = f"""
claims0 AS ({samples.CLAIMS}),
claims AS (SELECT *, {_TYPE} AS claim_type FROM (SELECT *, {norm("claim_text")} AS cn, {term_set("claim_text")} AS ct, {term_list("claim_text")} AS cl, {numbers("claim_text")} AS cnum, {dates("claim_text")} AS cdat FROM claims0)),
excerpts AS (SELECT *, {term_set("excerpt_text")} AS et, {term_list("excerpt_text")} AS el, {numbers("excerpt_text")} AS enum, {dates("excerpt_text")} AS edat FROM ({samples.EXCERPTS})),
links AS ({samples.LINKS})
"""

_LIM = f"""CASE WHEN {count_shared("ct", "et")} > 0 AND {overlap("et", words(K.LIMITATION_WORDS))} AND ({overlap("ct", words(K.SCOPE_WORDS))} OR {overlap("ct", words(K.PREDICTION_WORDS))})
  THEN 0.18::DOUBLE + CASE WHEN {overlap("ct", words(K.PREDICTION_WORDS))} AND list_contains(et, 'miss') THEN 0.12::DOUBLE ELSE 0 END
       + CASE WHEN {overlap("ct", words(K.SCOPE_WORDS))} AND list_contains(et, 'test') THEN 0.08::DOUBLE ELSE 0 END ELSE 0::DOUBLE END"""


def scored(source: str) -> str:
    """Pairs of `source` with their score."""
    return f"""
SELECT *, floor(least(greatest(CASE WHEN len(cnum) > 0 AND n_num = 0 AND n_terms > 0 THEN least(total, 0.69::DOUBLE) ELSE total END, 0), 1) * 10000 + 0.5) / 10000 AS score
FROM (SELECT *, CASE WHEN n_terms > 0 THEN 0.35::DOUBLE * (n_terms / len(ct)) + 0.1::DOUBLE * (n_terms / len(list_distinct(list_concat(ct, et)))) ELSE 0::DOUBLE END
    + least(0.12::DOUBLE, n_phrases * 0.04::DOUBLE)
    + CASE WHEN n_num > 0 THEN 0.46::DOUBLE + 0.12::DOUBLE * (n_num / len(cnum)) ELSE 0::DOUBLE END
    + CASE WHEN {overlap("cdat", "edat")} THEN 0.08::DOUBLE ELSE 0::DOUBLE END + lim
    + CASE WHEN n_terms > 0 AND {overlap("ct", words(K.COMPARISON_WORDS))} AND {overlap("et", words(K.COMPARISON_WORDS))} THEN 0.12::DOUBLE ELSE 0::DOUBLE END AS total
  FROM (SELECT *, {count_shared("ct", "et")} AS n_terms, {count_shared("cnum", "enum")} AS n_num, {count_shared(bigrams("cl"), bigrams("el"))} AS n_phrases, {_LIM} AS lim FROM ({source})))"""


_BUNDLE_PAIRS = "SELECT c.*, e.* EXCLUDE (bundle_id) FROM claims c JOIN excerpts e USING (bundle_id)"
CONTEXTS = f"""
{BASE},
pairs AS ({scored(_BUNDLE_PAIRS)}),
best AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, claim_id ORDER BY score DESC, source_id, excerpt_id) AS rank FROM pairs WHERE score >= 0.4 QUALIFY rank <= 3),
scoped AS (
  SELECT *, row_number() OVER (PARTITION BY bundle_id, claim_id, role ORDER BY score DESC, source_id, excerpt_id) AS rank
  FROM pairs JOIN links USING (bundle_id, claim_id, excerpt_id) WHERE role = 'counter' OR score >= 0.4 QUALIFY rank <= 3),
contexts AS (
  SELECT *, 'support' AS role FROM best
  UNION ALL BY NAME SELECT * FROM scoped WHERE role = 'counter'),
evidence AS (SELECT *, trim(excerpt_text || ' ' || coalesce(notes, '')) AS ev FROM contexts),
facts AS (
  SELECT *, {norm("ev")} AS en, {term_set("ev")} AS evt, {numbers("ev")} AS evnum, {dates("ev")} AS evdat,
         len(cdat) > 0 OR {overlap("ct", words(K.DEADLINE_WORDS))} AS deadline, list_filter(ct, lambda x: NOT list_contains({words(K.TRIGGER_WORDS, True)}, x)) AS core
  FROM evidence),
judged AS (
  SELECT *, {any_of("en", K.ADVERSE_LIMITATIONS)} AS adverse,
         score >= 0.7 AND len(cnum) > 0 AND list_has_all(evnum, cnum) AS numeric_direct,
         score >= 0.35 AND len(cdat) > 0 AND list_has_all(evdat, cdat) AS date_direct
  FROM facts),
texted AS (SELECT *, score >= 0.35 AND NOT adverse AND len(core) > 0 AND {count_shared("core", "evt")} / greatest(len(core), 1) >= 0.5 AS text_direct FROM judged),
supported AS (
  SELECT *, role = 'support' AND CASE WHEN len(cnum) > 0 THEN numeric_direct WHEN deadline THEN date_direct ELSE text_direct END AS direct,
         source_date IS NOT NULL AND date_diff('day', source_date, DATE '{REFERENCE_DATE}') > 365 AS stale
  FROM texted)
"""

_SUBSTR = " OR ".join(f"contains(en, '{p}')" for p in K.STRONG_CAUSAL)
_TRIGGERS = list(dict.fromkeys([*K.OVERCONFIDENT, *K.FUTURE_CERTAINTY]))


def _first(patterns: dict[str, str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(cn, '{p}') AND (n_counter > 0 OR NOT ex_{_TRIGGERS.index(t)}) THEN '{t}' END" for t, p in patterns.items()) + ")"


_FIRES = {
    "numeric_mismatch": ("len(cnum) > 0 AND NOT any_numeric", f"array_to_string({sorted_numbers('cnum')}, ',')"),
    "causal_overreach": ("claim_type = 'causal' AND n_direct > 0 AND NOT strong_causal", "CASE " + " ".join(f"WHEN contains(cn, '{t}') THEN '{t}'" for t in K.CAUSAL_TRIGGERS) + " ELSE 'causal' END"),
    "comparison_missing": ("claim_type = 'comparative' AND NOT any_comparison", "'comparative'"),
    "credential_missing_source": ("claim_type = 'credential' AND n_direct = 0", "'credential'"),
    "public_link_missing_source": (f"{overlap('ct', words(K.LINK_WORDS))} AND NOT any_url", "'public_link'"),
    "overconfident_wording": (f"{_first(K.OVERCONFIDENT)} IS NOT NULL", _first(K.OVERCONFIDENT)),
    "low_reliability_only": ("n_direct > 0 AND n_weak = n_direct", "direct_sources"),
    "stale_source": ("n_direct > 0 AND n_stale = n_direct", "stale_sources"),
    "date_missing_support": (f"(len(cdat) > 0 OR {overlap('ct', words(K.DEADLINE_WORDS))}) AND NOT any_date", "'date'"),
    "future_certainty": (f"{_first(K.FUTURE_CERTAINTY)} IS NOT NULL", _first(K.FUTURE_CERTAINTY)),
    "scope_overreach": ("claim_type = 'scope' AND (n_direct = 0 OR any_adverse)", "CASE " + " ".join(f"WHEN regexp_matches(cn, '{p}') THEN '{t}'" for t, p in K.SCOPE_TRIGGERS.items()) + " ELSE 'scope' END"),
    "counterevidence_present": ("n_counter > 0", "counter_ids"),
}

ASSESSED = f"""
{CONTEXTS},
summed AS (
  SELECT bundle_id, claim_id, count(*) FILTER (role = 'support') AS n_support, count(*) FILTER (role = 'counter') AS n_counter, count(*) FILTER (direct) AS n_direct,
    count(*) FILTER (direct AND reliability IN ('low', 'unknown')) AS n_weak, count(*) FILTER (direct AND stale) AS n_stale,
    max(score) FILTER (role = 'support') AS best_support, max(score) FILTER (role = 'counter') AS best_counter,
    bool_or(role = 'support' AND numeric_direct) AS any_numeric, bool_or(role = 'support' AND date_direct) AS any_date, bool_or(role = 'support' AND adverse) AS any_adverse,
    bool_or(direct AND ({_SUBSTR})) AS strong_causal, bool_or(role = 'support' AND {overlap("evt", words(K.COMPARISON_WORDS))}) AS any_comparison, bool_or(role = 'support' AND coalesce(url, '') <> '') AS any_url,
    string_agg(source_id, ',' ORDER BY source_id) FILTER (direct) AS direct_sources,
    string_agg(source_id || ':' || source_date::VARCHAR, ',' ORDER BY source_id || ':' || source_date::VARCHAR) FILTER (direct AND stale) AS stale_sources,
    string_agg(source_id || ':' || excerpt_id, ',' ORDER BY source_id || ':' || excerpt_id) FILTER (role = 'counter') AS counter_ids,
    {", ".join(f"bool_or(direct AND contains(en, '{t}')) AS ex_{k}" for k, t in enumerate(_TRIGGERS))}
  FROM supported GROUP BY bundle_id, claim_id),
full_facts AS (
  SELECT c.*, coalesce(n_support, 0) AS n_support, coalesce(n_counter, 0) AS n_counter, coalesce(n_direct, 0) AS n_direct, coalesce(n_weak, 0) AS n_weak, coalesce(n_stale, 0) AS n_stale,
    coalesce(best_support, 0)::DOUBLE AS best_support, coalesce(best_counter, 0)::DOUBLE AS best_counter, direct_sources, stale_sources, counter_ids,
    {", ".join(f"coalesce({b}, false) AS {b}" for b in ["any_numeric", "any_date", "any_adverse", "strong_causal", "any_comparison", "any_url", *[f"ex_{k}" for k in range(len(_TRIGGERS))]])}
  FROM claims c LEFT JOIN summed USING (bundle_id, claim_id)),
flagged AS (
  SELECT *, list_sort(list_filter([{", ".join(flag_case(code, when, trigger) for code, (when, trigger) in _FIRES.items())}], lambda x: x IS NOT NULL)) AS all_flags,
    floor(least(greatest(best_support - 0.3::DOUBLE * best_counter, 0), 1) * 10000 + 0.5) / 10000 AS signal
  FROM full_facts),
coded AS (
  SELECT * EXCLUDE (all_flags, signal), CASE WHEN claim_type = 'unclassified' THEN [] ELSE all_flags END AS flags, CASE WHEN claim_type = 'unclassified' THEN 0::DOUBLE ELSE signal END AS support_signal,
    list_transform(CASE WHEN claim_type = 'unclassified' THEN [] ELSE all_flags END, lambda f: f.code) AS codes
  FROM flagged),
labelled AS (
  SELECT *, CASE WHEN claim_type = 'unclassified' THEN 'not_checkable'
    WHEN {overlap("codes", array(K.NEEDS_SOURCE_CODES))} THEN 'needs_source'
    WHEN list_contains(codes, 'comparison_missing') AND n_support = 0 THEN 'needs_source'
    WHEN {overlap("codes", array(K.OVERSTATED_CODES))} THEN 'overstated'
    WHEN support_signal < 0.55 THEN 'unsupported' WHEN support_signal < 0.8 OR n_counter > 0 OR len(codes) > 0 THEN 'partially_supported' ELSE 'supported' END AS support_label
  FROM coded),
assessed AS (
  SELECT *, CASE WHEN claim_type = 'unclassified' THEN 'low' WHEN len(list_filter(flags, lambda f: f.risk = 'high')) > 0 THEN 'high'
    WHEN len(flags) > 0 OR support_label IN ('partially_supported', 'unsupported', 'needs_source') THEN 'medium' ELSE 'low' END AS risk_label
  FROM labelled)
"""

_EXPLAIN = f"""CASE support_label WHEN 'not_checkable' THEN {q(K.EXPLANATIONS["not_checkable"])} {" ".join(f"WHEN '{n}' THEN {q(K.EXPLANATIONS[n])}" for n in ("supported", "needs_source", "unsupported", "overstated"))}
  ELSE CASE WHEN n_direct > 0 THEN {q(K.EXPLANATIONS["direct"])} WHEN len(flags) > 0 THEN {q(K.EXPLANATIONS["flags"])} ELSE {q(K.EXPLANATIONS["related"])} END END"""
_GUIDE = "[" + ", ".join(f"CASE WHEN list_contains(codes, '{c}') THEN {q(g)} END" for c, (_, _, g) in K.FLAGS.items()) + "]"
_LABEL_GUIDE = "CASE support_label " + " ".join(f"WHEN '{n}' THEN {q(g)}" for n, g in K.LABEL_GUIDANCE.items()) + " ELSE '' END"
_SCAFFOLD = "CASE CAST(regexp_extract(claim_id, '[0-9]+') AS BIGINT) % 4 WHEN 0 THEN 'sourced' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'unsupported' ELSE 'inferred' END"
_NAME = "concat_ws(' / ', p_name, p_brand, p_type)"

ORACLES = {
    "tokens": f"SELECT doc_id, len({tok('text')})::BIGINT AS n_tokens, sha256({norm('text')}) AS norm_sha256 FROM documents",
    "stems": f"SELECT doc_id, len(t)::BIGINT AS n_terms, len(list_distinct(t))::BIGINT AS n_distinct, sha256(array_to_string(t, ' ')) AS terms_sha256 FROM (SELECT doc_id, {term_list('text')} AS t FROM documents)",
    "number_tokens": f"SELECT doc_id, array_to_string({sorted_numbers(numbers(DOC_TEXT))}, ',') AS numbers FROM documents",
    "date_tokens": f"SELECT doc_id, array_to_string(list_sort({dates(DOC_TEXT)}), ',') AS dates FROM documents",
    "names_and_anchors": f"""SELECT p_partkey, regexp_replace({_NAME}, '[^\\p{{L}}\\p{{N}}._-]', '-', 'g') AS file_name,
      coalesce(nullif(trim(regexp_replace(regexp_replace(lower({_NAME}), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '-'), ''), 'claim') AS anchor, 'sha256:' || sha256({_NAME}) AS hash,
      replace(trim(replace({_NAME} || ' | `x`' || chr(10), chr(10), ' ')), '|', '\\|') AS escaped FROM part""",
    "claim_sentences": f"SELECT doc_id, paragraph, sentence, text FROM ({sentences_sql('documents', 'doc_id')}) WHERE NOT ends_with(text, '?') AND len({tok('text')}) >= 4",
    "claim_types": f"""WITH {BASE}, all_types AS (
      SELECT {_TYPE} AS claim_type FROM (SELECT {norm('text')} AS cn FROM ({sentences_sql('documents', 'doc_id')}) WHERE NOT ends_with(text, '?') AND len({tok('text')}) >= 4)
      UNION ALL SELECT claim_type FROM claims) SELECT claim_type, count(*) AS n FROM all_types GROUP BY claim_type""",
    "near_dup_claims": f"""WITH {BASE} SELECT bundle_id, a.claim_id, b.claim_id AS other_id FROM claims a JOIN claims b USING (bundle_id) WHERE a.claim_id < b.claim_id AND len(a.ct) > 0 AND len(b.ct) > 0
      AND ({count_shared('a.ct', 'b.ct')} >= 0.8 * len(list_distinct(list_concat(a.ct, b.ct)))
        OR ({count_shared('a.ct', 'b.ct')} >= 0.9 * least(len(a.ct), len(b.ct)) AND abs(len(a.ct) - len(b.ct)) <= 2))""",
    "claims_deduped": f"""WITH RECURSIVE {BASE},
      placed AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY regexp_extract(claim_id, '[0-9]+')::BIGINT) AS paragraph FROM claims),
      checkable AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY paragraph) AS k FROM placed WHERE claim_type <> 'unclassified'),
      rivals AS (
        SELECT a.bundle_id, a.k, list(b.k) FILTER (b.k IS NOT NULL) AS earlier FROM checkable a LEFT JOIN checkable b ON a.bundle_id = b.bundle_id AND b.k < a.k AND (a.cn = b.cn OR (len(a.ct) > 0 AND len(b.ct) > 0
          AND ({count_shared('a.ct', 'b.ct')} >= 0.8 * len(list_distinct(list_concat(a.ct, b.ct)))
            OR ({count_shared('a.ct', 'b.ct')} >= 0.9 * least(len(a.ct), len(b.ct)) AND abs(len(a.ct) - len(b.ct)) <= 2)))) GROUP BY ALL),
      folded AS (
        SELECT bundle_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM checkable GROUP BY bundle_id
        UNION ALL
        SELECT f.bundle_id, r.k, CASE WHEN list_has_any(kept, coalesce(earlier, [])) THEN kept ELSE list_append(kept, r.k) END FROM folded f JOIN rivals r ON r.bundle_id = f.bundle_id AND r.k = f.k + 1),
      stayed AS (SELECT bundle_id, unnest(arg_max(kept, k)) AS k FROM folded GROUP BY bundle_id)
      SELECT bundle_id AS doc_id, 'claim-' || left(sha256(bundle_id || ':' || cn), 12) AS claim_id, claim_text AS text, claim_type, 'paragraph:' || paragraph || ':sentence:1' AS location
      FROM checkable JOIN stayed USING (bundle_id, k)""",
    "pair_scores": f"WITH {BASE} SELECT bundle_id, claim_id, source_id, excerpt_id, score FROM ({scored(_BUNDLE_PAIRS)})",
    "topk_candidates": f"""WITH {CONTEXTS} SELECT bundle_id, claim_id, source_id, excerpt_id, score, rank, concat_ws('; ',
      CASE WHEN n_num > 0 THEN 'matched numbers: ' || array_to_string({sorted_numbers("list_filter(cnum, lambda x: list_contains(enum, x))")}, ', ') END,
      CASE WHEN n_terms > 0 AND n_num < len(cnum) THEN 'claim numbers not found in excerpt: ' || array_to_string({sorted_numbers("list_filter(cnum, lambda x: NOT list_contains(enum, x))")}, ', ') END,
      CASE WHEN {overlap("cdat", "edat")} THEN 'matched dates: ' || array_to_string(list_sort(list_filter(cdat, lambda x: list_contains(edat, x))), ', ') END,
      CASE WHEN n_terms > 0 THEN 'overlapping terms: ' || array_to_string(list_sort(list_filter(ct, lambda x: list_contains(et, x)))[1:6], ', ') END,
      CASE WHEN lim > 0 THEN 'limitation wording overlaps with broad or future-facing claim' END, 'source reliability: ' || reliability) AS rationale FROM best""",
    "scoped_matches": f"WITH {CONTEXTS} SELECT bundle_id, claim_id, role, source_id, excerpt_id, score, rank FROM scoped",
    "blocked_pairs": f"""WITH claims AS (SELECT 'c-' || item_id || '-' || paragraph || '-' || sentence AS claim_id, {term_set('text')} AS ct, {term_list('text')} AS cl, {numbers('text')} AS cnum, {dates('text')} AS cdat
        FROM ({sentences_sql('benchmark', 'item_id')}) WHERE NOT ends_with(text, '?') AND len({tok('text')}) >= 4),
      excerpts AS (SELECT conv_id::VARCHAR AS source_id, conv_id || '-' || turn AS excerpt_id, {term_set('text')} AS et, {term_list('text')} AS el, {numbers('text')} AS enum, {dates('text')} AS edat FROM conversations)
      SELECT claim_id, source_id, excerpt_id, score FROM ({scored("SELECT * FROM claims, excerpts")}) WHERE score >= {BLOCKED_LEAST}""",
    "direct_support": f"WITH {CONTEXTS} SELECT bundle_id, claim_id, role, excerpt_id, numeric_direct, date_direct, text_direct, direct, adverse FROM supported",
    "support_labels": f"""WITH {ASSESSED} SELECT bundle_id, claim_id, claim_type, support_signal, support_label, risk_label, array_to_string(codes, ',') AS codes, {_EXPLAIN} AS explanation,
      CASE WHEN claim_type = 'unclassified' THEN {q(K.LIMITATIONS["not_checkable"])} WHEN len(flags) > 0 THEN {q(K.LIMITATIONS["flags"])} ELSE '' END AS limitations FROM assessed""",
    "guidance": f"WITH {ASSESSED} SELECT bundle_id, claim_id, CASE WHEN claim_type = 'unclassified' THEN '' WHEN len(codes) > 0 THEN array_to_string(list_filter({_GUIDE}, lambda x: x IS NOT NULL), ' ') ELSE {_LABEL_GUIDE} END AS guidance FROM assessed",
    "audit_summary": f"WITH {ASSESSED} SELECT count(*) AS total_claims, {', '.join(f'''count(*) FILTER (support_label = '{n}') AS {n}''' for n in K.SUPPORT_LABELS)}, count(*) FILTER (risk_label = 'high') AS high_risk FROM assessed",
    "deviations": f"""WITH {ASSESSED}, s AS (SELECT *, {_SCAFFOLD} AS scaffold FROM assessed),
      d AS (SELECT *, scaffold IN ('uncertain', 'unsupported') AND support_label IN ('supported', 'partially_supported') AND support_signal >= 0.85 AS false_caution,
        (scaffold, support_label) IN ({", ".join(f"('{a}', '{b}')" for a, b in K.MATERIAL_DEVIATIONS)}) AS deviation FROM s)
      SELECT bundle_id, claim_id, scaffold, false_caution, deviation,
        CASE WHEN false_caution THEN 'Material disagreement: scaffold_support_status=' || scaffold || '; audit_support_verdict=' || support_label || '; false_caution_flag=true because the scaffold was cautious and {K.AUDITOR} found supplied-evidence support.'
        WHEN deviation THEN 'Material disagreement: scaffold_support_status=' || scaffold || '; audit_support_verdict=' || support_label || '.'
        ELSE 'No material disagreement between scaffold support status and {K.AUDITOR} verdict: scaffold_support_status=' || scaffold || '; audit_support_verdict=' || support_label || '.' END AS notes FROM d""",
    "evidence_links": f"""WITH {CONTEXTS} SELECT bundle_id, source_id, excerpt_id, role, max(score) AS best_score, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids,
      first(reliability ORDER BY score DESC, claim_id) AS reliability, first(source_date ORDER BY score DESC, claim_id)::VARCHAR AS source_date, first(url ORDER BY score DESC, claim_id) AS url
      FROM contexts GROUP BY bundle_id, source_id, excerpt_id, role""",
    "claim_register": f"""WITH {ASSESSED}, first AS (SELECT bundle_id, claim_id, source_id || ' / ' || excerpt_id AS e FROM best WHERE rank = 1)
      SELECT bundle_id, claim_id, support_label, risk_label, coalesce(e, 'none linked') AS strongest,
        CASE WHEN len(flags) > 0 THEN array_to_string(list_transform(flags, lambda f: f.message), '; ') ELSE {_EXPLAIN} END AS main_issue FROM assessed LEFT JOIN first USING (bundle_id, claim_id)""",
    "quality_notes": f"""WITH {ASSESSED}, c AS (SELECT bundle_id, claim_id, count(*) AS n, bool_or(reliability IN ('low', 'unknown')) AS weak, count(DISTINCT reliability) AS n_rel, count(DISTINCT coalesce(source_date::VARCHAR, '')) AS n_dates FROM best GROUP BY ALL)
      SELECT bundle_id, claim_id, array_to_string(list_filter([
        CASE WHEN weak THEN {q(report.NOTES["weak"])} END, CASE WHEN list_contains(codes, 'low_reliability_only') THEN {q(report.NOTES["low"])} END, CASE WHEN list_contains(codes, 'stale_source') THEN {q(report.NOTES["stale"])} END,
        CASE WHEN n_rel > 1 OR n_dates > 1 THEN {q(report.NOTES["mixed"])} END, CASE WHEN coalesce(n, 0) > 0 AND support_label IN ('unsupported', 'needs_source', 'not_checkable') THEN {q(report.NOTES["negative"])} END], lambda x: x IS NOT NULL), ' ') AS notes
      FROM assessed LEFT JOIN c USING (bundle_id, claim_id)""",
} | {
    f"flag_{code}": f"WITH {ASSESSED} SELECT bundle_id, claim_id, f.id AS flag_id, f.risk AS risk, f.message AS message FROM (SELECT bundle_id, claim_id, unnest(flags) AS f FROM assessed) WHERE f.code = '{code}'"
    for code in K.FLAGS
}
