"""Queries of the surface features of claims and passages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import features
from . import samples
from .duck import any_of, array, norm, term_set, tok

#: Sentences that meet every feature, over the claims' own: each order makes one.
SENTENCES = f"""
SELECT o_orderkey AS text_id,
  CASE o_orderkey % 17
    WHEN 0 THEN 'Suppliers must label ' || CAST(o_orderkey % 90 AS STRING) || '% of crates.'
    WHEN 1 THEN 'The gel is oil-free and does not stain.'
    WHEN 2 THEN 'I think the new layout works well for most clerks.'
    WHEN 3 THEN 'Did the crates arrive within ' || CAST(o_orderkey % 9 + 1 AS STRING) || '.5 days?'
    WHEN 4 THEN 'There is no lead in the paint, and none was found before.'
    WHEN 5 THEN 'Packing should often take about ' || CAST(o_orderkey % 50 AS STRING) || ' minutes.'
    WHEN 6 THEN 'Clerks couldn''t open the crates ~3 times out of 10.'
    WHEN 7 THEN 'The paint is free of lead; to meet demand it may be thinned.'
    WHEN 8 THEN 'To me the mixture seems too thin.'
    WHEN 9 THEN 'Every crate shall carry each label, never two.'
    WHEN 10 THEN 'It is recommended that some crates stay closed without labels.'
    WHEN 11 THEN ''
    WHEN 12 THEN NULL
    ELSE c.claim_text
  END AS text
FROM ({samples.CLAIMS}) c JOIN orders ON c.claim_id = 'claim-' || CAST(o_orderkey AS STRING)
"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.run_sql(spark, sf_dir, SENTENCES)


def _told(quantities):
    """Quantities as one text, which engines write alike."""
    return F.array_join(F.transform(quantities, lambda x: F.concat((x["value"] * 100).cast("long").cast("string"), F.coalesce(F.concat(F.lit(" "), x["unit"]), F.lit("")))), ",")


def claim_surface(spark, sf_dir):
    """What a claim's wording says by itself, in the columns that the verdicts take.  A null text is
    declarative and asserts; its other columns are null, and it does not hedge."""
    text = F.col("text")
    named = features.claim_features(text)
    named |= {"c_quantities": _told(named["c_quantities"]), "c_lemmas": F.array_join(F.array_sort(named["c_lemmas"]), " "), "token_count": named["token_count"].cast("long")}
    return _sentences(spark, sf_dir).select("text_id", *[c.alias(n) for n, c in named.items()], features.modal_strength(text).alias("modal"), features.deontic_strength(text).alias("deontic"))


def passage_surface(spark, sf_dir):
    """What a passage's wording says by itself, in the columns that the verdicts take."""
    named = features.passage_features(F.col("text"))
    named |= {"p_quantities": _told(named["p_quantities"]), "p_lemmas": F.array_join(F.array_sort(named["p_lemmas"]), " ")}
    return _sentences(spark, sf_dir).select("text_id", *[c.alias(n) for n, c in named.items()])


def _any(words: list[str]) -> str:
    return f"list_has_any({tok('text')}, {array(words)})"


_NEGATED = f"regexp_matches({norm('text')}, '\\b(?:not|cannot|[a-z]+n''t|never)\\b')"
_QUANTITIES = """array_to_string(list_transform(regexp_extract_all(lower(text), '[0-9]+(?:\\.[0-9]+)?%?'),
  lambda x: ((rtrim(x, '%')::DOUBLE * 100)::BIGINT)::VARCHAR || CASE WHEN ends_with(x, '%') THEN ' percentage' ELSE '' END), ',')"""
_LEMMAS = f"array_to_string(list_sort({term_set('text')}), ' ')"
_OPINION = any_of(norm("text"), [rf"\b{m}\b" for m in K.OPINIONS])

QUERIES = {f.__name__: f for f in (claim_surface, passage_surface)}
ORACLES = {
    "claim_surface": f"""
SELECT text_id, CASE WHEN {_OPINION} THEN 'opinion' WHEN ends_with(rtrim(text), '?') THEN 'question' ELSE 'declarative' END AS sentence_type, len({tok('text')}) AS token_count,
  {_NEGATED} AS negated, {_any(K.STRONG_DEONTIC)} OR {_any(K.UNIVERSAL)} AS claim_strong, coalesce({_any(K.HEDGES)} AND NOT {_any(K.PRESCRIBES)}, false) AS hedges,
  {_any([w for w in K.APPROXIMATE if w != "~"])} OR contains(text, '~') AS approximate, {_QUANTITIES} AS c_quantities, {_LEMMAS} AS c_lemmas,
  CASE WHEN {_any(K.PRESCRIBES)} THEN 'prescribes' WHEN {_any(K.HEDGES)} THEN 'hedges' ELSE 'asserts' END AS modal,
  CASE WHEN {_any(K.STRONG_DEONTIC)} THEN 'strong' WHEN {_any(K.WEAK_DEONTIC)} THEN 'weak' END AS deontic FROM ({SENTENCES})""",
    "passage_surface": f"""
SELECT text_id, {_NEGATED} OR {_any(K.ABSENCE)} OR regexp_matches(lower(text), '\\w-free\\b') OR regexp_matches({norm('text')}, '\\bfree (?:of|from)\\b|\\bno [a-z]') AS p_negation,
  CASE WHEN {_any(K.STRONG_DEONTIC)} OR {_any(K.UNIVERSAL)} THEN 'strong' WHEN {_any(K.WEAK_DEONTIC)} OR {_any(K.HEDGES)} OR {_any(K.PARTIAL_SCOPE)} THEN 'weak' END AS p_scope,
  {_QUANTITIES} AS p_quantities, {_LEMMAS} AS p_lemmas FROM ({SENTENCES})""",
}
