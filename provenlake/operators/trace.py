"""Traces: what a claim's verdict rests on, from retrieval to rules, as one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import features as S
from . import verdict

#: What stands in every trace of this engine.
CITATION_STATUS = "not_applicable"


def entailed(admitted: DataFrame, logits: DataFrame) -> DataFrame:
    """(claim_id, passage_id, ordinal, label, score, raw_logits): admitted retrieval results(claim_id,
    passage_id, rank) with the label of the largest of their logits(claim_id, passage_id, raw_logits) and
    its probability.  A result without logits fails the query; further logits are not used."""
    met = admitted.join(logits, ["claim_id", "passage_id"], "left")
    told = F.when(F.col("raw_logits").isNull(), F.raise_error(F.concat(F.lit("no entailment of "), F.col("claim_id").cast("string"), F.lit(" by "), F.col("passage_id").cast("string")))).otherwise(F.col("raw_logits"))
    met = met.withColumn("raw_logits", told)
    return met.select("claim_id", "passage_id", F.col("rank").alias("ordinal"), verdict.entail_label(F.col("raw_logits")).alias("label"), F.array_max(verdict.softmax(F.col("raw_logits"))).alias("score"), "raw_logits")


def judged(claims: DataFrame, retrieval: DataFrame, entailment: DataFrame, passages: DataFrame) -> DataFrame:
    """Verdicts of claims(claim_id, claim_text) under operators.verdict: passages(passage_id, passage_text,
    trust_level); retrieval and entailment as in assembled()."""
    any_ = retrieval.filter(F.col("score") >= K.RETRIEVAL_FLOOR).select("claim_id").distinct().withColumn("found", F.lit(True))
    known = claims.select("claim_id", *[c.alias(n) for n, c in S.claim_features(F.col("claim_text")).items()]).join(any_, "claim_id", "left")
    known = known.withColumn("any_retrieved", F.coalesce("found", F.lit(False))).select("claim_id", *verdict.CLAIM_FEATURES)
    texts = passages.select("passage_id", "trust_level", *[c.alias(n) for n, c in S.passage_features(F.col("passage_text")).items()]).select("passage_id", *verdict.PASSAGE_FEATURES)
    return verdict.verdicts(known, entailment, texts)


def assembled(claims: DataFrame, retrieval: DataFrame, entailment: DataFrame, passages: DataFrame, settings_hash: str, version: str) -> DataFrame:
    """Traces in the form of sources.traces, one a claim.

    claims has claim_id and claim_text, once each; retrieval has claim_id, passage_id, score and rank;
    entailment has claim_id, passage_id, ordinal, label, score and raw_logits.  Results stand in the
    order of their rank, rules in the order in which they fired, suppressions first.  A claim without
    results has empty lists and a neutral signal at 0.  Whether a claim is compound is not known here,
    and null.
    """
    lists = retrieval.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage_id", "score"))).alias("r"))
    entries = entailment.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "passage_id", "label", "score", "raw_logits"))).alias("e"))
    found = judged(claims, retrieval, entailment, passages).withColumnsRenamed({"score": "signal", "passage_id": "from"})
    rows = claims.select("claim_id", "claim_text").join(lists, "claim_id", "left").join(entries, "claim_id", "left").join(found, "claim_id")
    text, told = F.col("claim_text"), S.claim_features(F.col("claim_text"))
    # a quantity's own wording is its number, with the sign where it has one
    amount = F.transform(told["c_quantities"], lambda q: F.struct(q["value"].alias("value"), q["unit"].alias("unit"), F.concat(q["value"].cast("string"), F.when(q["unit"] == "percentage", "%").otherwise("")).alias("surface_text")))
    features = F.struct(
        amount.alias("numerical_values"), told["negated"].alias("has_explicit_negation"), S._has(text, K.UNIVERSAL).alias("has_universal_quantifier"), S.modal_strength(text).alias("modal_strength"),
        told["token_count"].cast("int").alias("claim_token_count"), F.lit(None).cast("boolean").alias("compound_claim"), told["sentence_type"].alias("sentence_type"),
    )
    none = F.array().cast
    return rows.select(
        "claim_id", "claim_text",
        F.coalesce(F.transform("r", lambda x: F.struct(x["passage_id"].alias("passage_id"), x["score"].alias("score"))), none("array<struct<passage_id:string,score:double>>")).alias("retrieval"),
        F.coalesce(F.transform("e", lambda x: F.struct(*[x[n].alias(n) for n in ("passage_id", "label", "score", "raw_logits")])), none("array<struct<passage_id:string,label:string,score:double,raw_logits:array<double>>>")).alias("entailment"),
        features.alias("features"), F.struct(F.col("label"), F.col("signal").alias("max_entailment_score"), F.col("from").alias("contributing_passage_id")).alias("support_signal"),
        F.transform("rules", lambda r: F.struct(r.alias("rule_id"), F.lit(None).cast("string").alias("reason"))).alias("rules_fired"),
        F.struct(F.col("verdict").alias("support_verdict"), F.col("reason").alias("support_verdict_reason"), F.col("audit_flags"), F.lit(CITATION_STATUS).alias("citation_status"), F.col("confidence").alias("audit_confidence")).alias("verdict"),
        F.lit(settings_hash).alias("audit_config_hash"), F.lit(version).alias("library_version"),
    )


def variant(traces: DataFrame, claims: DataFrame, more: DataFrame, passages: DataFrame, settings_hash: str, version: str) -> DataFrame:
    """Traces after further entailment results(claim_id, passage_id, label, score, raw_logits) have joined:
    those of their claims are judged again on old and new results, the others stay as they are.  New
    results stand after the old ones; passages holds the passages of both."""
    touched = more.select("claim_id").distinct()
    old = traces.join(touched, "claim_id", "left_semi")
    again = old.select("claim_id", F.posexplode("entailment").alias("ordinal", "x")).select("claim_id", "x.passage_id", (F.col("ordinal") + 1).alias("ordinal"), "x.label", "x.score", "x.raw_logits")
    last = again.groupBy("claim_id").agg(F.max("ordinal").alias("last"))
    order = F.row_number().over(verdict.Window.partitionBy("claim_id").orderBy("passage_id"))
    new = more.withColumn("nth", order).join(last, "claim_id", "left").select("claim_id", "passage_id", (F.coalesce("last", F.lit(0)) + F.col("nth")).alias("ordinal"), "label", "score", "raw_logits")
    retrieval = old.select("claim_id", F.posexplode("retrieval").alias("rank", "x")).select("claim_id", "x.passage_id", "x.score", (F.col("rank") + 1).alias("rank"))
    redone = assembled(claims.join(touched, "claim_id", "left_semi"), retrieval, again.unionByName(new), passages, settings_hash, version)
    return traces.join(touched, "claim_id", "left_anti").unionByName(redone)
