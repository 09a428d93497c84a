"""Surface features of claims and passages: the native provider.

Parses are not available in Spark; these look at words only.  Columns of a parsing provider may take
their place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import text as T


def _has(text: Column, words: list[str]) -> Column:
    return F.arrays_overlap(T.tokens(text), F.array(*[F.lit(w) for w in words]))


def modal_strength(text: Column) -> Column:
    return F.when(_has(text, K.PRESCRIBES), "prescribes").when(_has(text, K.HEDGES), "hedges").otherwise("asserts")


def deontic_strength(text: Column) -> Column:
    return F.when(_has(text, K.STRONG_DEONTIC), "strong").when(_has(text, K.WEAK_DEONTIC), "weak")


def scope_strength(text: Column) -> Column:
    strong = _has(text, K.STRONG_DEONTIC) | _has(text, K.UNIVERSAL)
    return F.when(strong, "strong").when(_has(text, K.WEAK_DEONTIC) | _has(text, K.HEDGES) | _has(text, K.PARTIAL_SCOPE), "weak")


def approximate(text: Column) -> Column:
    return _has(text, [w for w in K.APPROXIMATE if w != "~"]) | text.contains("~")


def negated(text: Column) -> Column:
    return T.normalized(text).rlike(r"\b(?:not|cannot|[a-z]+n't|never)\b")


def expresses_negation(text: Column) -> Column:
    absent = _has(text, K.ABSENCE) | F.lower(text).rlike(r"\w-free\b") | T.normalized(text).rlike(r"\bfree (?:of|from)\b|\bno [a-z]")
    return negated(text) | absent


def quantities(text: Column) -> Column:
    """Numbers of a text with per cent as their unit, or none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.rtrim(x, F.lit("%")).cast("double").alias("value"), F.when(F.endswith(x, F.lit("%")), "percentage").alias("unit")))


def opinion(text: Column) -> Column:
    return T.any_pattern(T.normalized(text), [rf"\b{m}\b" for m in K.OPINIONS])


def sentence_type(text: Column) -> Column:
    return F.when(opinion(text), "opinion").when(F.endswith(F.rtrim(text), F.lit("?")), "question").otherwise("declarative")


def claim_features(text: Column) -> dict[str, Column]:
    """Columns of verdict.CLAIM_FEATURES but any_retrieved."""
    return {
        "sentence_type": sentence_type(text),
        "token_count": F.size(T.tokens(text)),
        "negated": negated(text),
        "claim_strong": F.coalesce(deontic_strength(text) == "strong", F.lit(False)) | _has(text, K.UNIVERSAL),
        "hedges": modal_strength(text) == "hedges",
        "approximate": approximate(text),
        "c_quantities": quantities(text),
        "c_lemmas": T.term_set(text),
    }


def passage_features(text: Column) -> dict[str, Column]:
    """Columns of verdict.PASSAGE_FEATURES but trust_level."""
    return {"p_negation": expresses_negation(text), "p_scope": scope_strength(text), "p_quantities": quantities(text), "p_lemmas": T.term_set(text)}
