"""Lexical rules: direct support, flags, labels, risk, guidance.

contexts has one row for each candidate: bundle_id, claim_id, claim_text, claim_type, role (support or
counter), rank, source_id, excerpt_id, score, excerpt_text, notes, reliability, source_date, url.
Every rule is an expression on such a row or on one aggregate of them by claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..tables import once_a_text, parts_for, settled, with_texts

CLAIM = ["bundle_id", "claim_id"]


def evidence_text() -> Column:
    return F.btrim(F.concat(F.coalesce("excerpt_text", F.lit("")), F.lit(" "), F.coalesce("notes", F.lit(""))))


#: Wording that direct evidence excuses.
TRIGGERS = list(dict.fromkeys([*K.OVERCONFIDENT, *K.FUTURE_CERTAINTY]))


def claim_facts(claims: DataFrame) -> DataFrame:
    """What support and flags need of each distinct claim_text."""
    c, norm = F.col("claim_text"), F.col("c_norm")

    def told(texts: DataFrame) -> DataFrame:
        rows = texts.withColumns({"c_norm": T.normalized(c), "c_set": T.term_set(c), "c_numbers": T.numbers(c), "c_dates": T.dates(c)})
        return rows.select(
            "claim_text", "c_numbers", "c_dates", is_deadline(c).alias("deadline"),
            F.array_except("c_set", T.word_set(K.TRIGGER_WORDS, stopwords=True)).alias("core"),
            F.array_join(T.sorted_numbers(F.col("c_numbers")), ",").alias("c_figures"),
            F.arrays_overlap("c_set", T.word_set(K.LINK_WORDS)).alias("linked"),
            F.coalesce(*[F.when(norm.contains(t), F.lit(t)) for t in K.CAUSAL_TRIGGERS], F.lit("causal")).alias("causal"),
            F.coalesce(*[F.when(norm.rlike(p), F.lit(t)) for t, p in K.SCOPE_TRIGGERS.items()], F.lit("scope")).alias("scope"),
            _wording(norm, K.OVERCONFIDENT).alias("confident_words"),
            _wording(norm, K.FUTURE_CERTAINTY).alias("certain_words"),
        )

    return once_a_text(claims, "claim_text", told)


def evidence_wording(contexts: DataFrame) -> DataFrame:
    """What support and flags need of each distinct evidence text of contexts."""
    e, norm = F.col("evidence"), F.col("norm")

    def told(texts: DataFrame) -> DataFrame:
        rows = texts.withColumns({"norm": T.normalized(e), "e_set": T.term_set(e)})
        return rows.select(
            "evidence", "norm", "e_set", T.numbers(e).alias("e_numbers"), T.dates(e).alias("e_dates"), T.any_pattern(norm, K.ADVERSE_LIMITATIONS).alias("adverse"),
            T.any_substring(norm, K.STRONG_CAUSAL).alias("strong"),
            F.arrays_overlap("e_set", T.word_set(K.COMPARISON_WORDS)).alias("compared"),
            F.array_compact(F.array(*[F.when(F.contains("norm", F.lit(t)), F.lit(t)) for t in TRIGGERS])).alias("triggers"),
        )

    return once_a_text(contexts, "evidence", told)


def with_support(contexts: DataFrame) -> DataFrame:
    """contexts with numeric_direct, date_direct, text_direct, direct and what flags need of a row.
    contexts is read several times: settle it first."""
    rows = contexts.withColumn("evidence", evidence_text())
    told = evidence_wording(rows)
    rows = with_texts(with_texts(rows, claim_facts(contexts), "claim_text"), told, "evidence")
    coverage = F.when(F.size("core") > 0, F.size(F.array_intersect("core", "e_set")) / F.size("core")).otherwise(0.0)
    there = F.col("excerpt_text").isNotNull()
    rows = rows.withColumns(
        {
            "numeric_direct": there & (F.col("score") >= K.DIRECT_NUMERIC) & (F.size("c_numbers") > 0) & (F.size(F.array_except("c_numbers", "e_numbers")) == 0),
            "date_direct": there & (F.col("score") >= K.DIRECT_DATE) & (F.size("c_dates") > 0) & (F.size(F.array_except("c_dates", "e_dates")) == 0),
        }
    )
    text_direct = there & (F.col("score") >= K.DIRECT_TEXT) & ~F.col("adverse") & (coverage >= K.DIRECT_COVERAGE)
    direct = F.when(F.size("c_numbers") > 0, F.col("numeric_direct")).when(F.col("deadline"), F.col("date_direct")).otherwise(F.col("text_direct"))
    return rows.withColumn("text_direct", text_direct).withColumn("direct", direct & (F.col("role") == "support"))


def is_deadline(text: Column) -> Column:
    return (F.size(T.dates(text)) > 0) | F.arrays_overlap(T.term_set(text), T.word_set(K.DEADLINE_WORDS))


def _of(role: str, condition: Column) -> Column:
    return F.coalesce(F.max((F.col("role") == role) & condition), F.lit(False))


def evidence_rows(supported: DataFrame, reference_date: str | Column | None = None, freshness_days: int = K.FRESHNESS_DAYS) -> DataFrame:
    """What evidence_facts() takes of each context, without its texts and links: these rows are shuffled."""
    direct, row = F.col("direct"), F.col("role") == "support"
    stale = F.lit(False) if reference_date is None else F.coalesce(F.datediff((F.lit(reference_date) if isinstance(reference_date, str) else reference_date).cast("date"), "source_date") > freshness_days, F.lit(False))
    return supported.select(
        *CLAIM, "role", "score", "numeric_direct", "date_direct", "direct", "adverse", "compared",
        (direct & F.col("strong")).alias("strong_direct"),
        (F.coalesce(F.col("url"), F.lit("")) != "").alias("has_url"),
        (direct & F.col("reliability").isin("low", "unknown")).alias("weak_direct"),
        (direct & stale).alias("stale_direct"),
        F.when(direct, F.col("source_id")).alias("direct_source"),
        F.when(direct & stale, F.concat("source_id", F.lit(":"), F.col("source_date").cast("string"))).alias("stale_source"),
        F.when(~row, F.concat("source_id", F.lit(":"), "excerpt_id")).alias("counter_id"),
        F.when(direct & (F.size("triggers") > 0), F.col("triggers")).alias("excuses"),
    )


def evidence_facts(rows: DataFrame) -> DataFrame:
    """One row a claim with what all its contexts, as evidence_rows() has them, say together."""
    direct, row = F.col("direct"), F.col("role") == "support"

    def listed(name: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(name)), ",")

    return rows.groupBy(*CLAIM).agg(
        F.count_if(row).alias("n_support"),
        F.count_if(~row).alias("n_counter"),
        F.count_if(direct).alias("n_direct"),
        F.coalesce(F.max(F.when(row, F.col("score"))), F.lit(0.0)).alias("best_support"),
        F.coalesce(F.max(F.when(~row, F.col("score"))), F.lit(0.0)).alias("best_counter"),
        _of("support", F.col("numeric_direct")).alias("any_numeric"),
        _of("support", F.col("date_direct")).alias("any_date"),
        _of("support", F.col("adverse")).alias("any_adverse"),
        _of("support", F.col("strong_direct")).alias("strong_causal"),
        _of("support", F.col("compared")).alias("any_comparison"),
        _of("support", F.col("has_url")).alias("any_url"),
        (F.count_if("weak_direct") == F.count_if(direct)).alias("all_weak"),
        (F.count_if("stale_direct") == F.count_if(direct)).alias("all_stale"),
        listed("direct_source").alias("direct_sources"),
        listed("stale_source").alias("stale_sources"),
        listed("counter_id").alias("counter_ids"),
        F.array_distinct(F.flatten(F.collect_list("excuses"))).alias("excused"),
    )


def _wording(norm: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(norm.rlike(p), F.lit(t)) for t, p in patterns.items()]))


def _first_trigger(wording: str) -> Column:
    """The first trigger of the claim's wording that no direct evidence shares; with counterevidence
    none is excused."""
    return F.get(F.filter(wording, lambda t: (F.col("n_counter") > 0) | ~F.array_contains("excused", t)), F.lit(0))


def flags(needs_source: bool = True, overstated: bool = True) -> Column:
    """array<struct<code, id, message, risk>> of a claim joined with its facts and those of its text, by
    code and id."""
    kind = F.col("claim_type")
    none_direct = F.col("n_direct") == 0
    source, strong = F.lit(needs_source), F.lit(overstated)
    fires = {
        "numeric_mismatch": ((F.size("c_numbers") > 0) & ~F.col("any_numeric"), F.col("c_figures")),
        "causal_overreach": ((kind == "causal") & ~none_direct & ~F.col("strong_causal"), F.col("causal")),
        "comparison_missing": (source & (kind == "comparative") & ~F.col("any_comparison"), F.lit("comparative")),
        "credential_missing_source": (source & (kind == "credential") & none_direct, F.lit("credential")),
        "public_link_missing_source": (source & F.col("linked") & ~F.col("any_url"), F.lit("public_link")),
        "overconfident_wording": (strong & F.col("confident").isNotNull(), F.col("confident")),
        "low_reliability_only": (~none_direct & F.col("all_weak"), F.col("direct_sources")),
        "stale_source": (~none_direct & F.col("all_stale"), F.col("stale_sources")),
        "date_missing_support": (source & F.col("deadline") & ~F.col("any_date"), F.lit("date")),
        "future_certainty": (strong & F.col("certain").isNotNull(), F.col("certain")),
        "scope_overreach": (strong & (kind == "scope") & (none_direct | F.col("any_adverse")), F.col("scope")),
        "counterevidence_present": (F.col("n_counter") > 0, F.col("counter_ids")),
    }
    made = []
    for code, (when, trigger) in fires.items():
        risk, message, _ = K.FLAGS[code]
        flag_id = T.short_id("flag", F.col("claim_id"), F.lit(code), T.normalized(trigger))
        made.append(F.when(when, F.struct(F.lit(code).alias("code"), flag_id.alias("id"), F.lit(message).alias("message"), F.lit(risk).alias("risk"))))
    return F.array_sort(F.array_compact(F.array(*made)))


def support_signal() -> Column:
    return T.rounded(T.clamped(F.col("best_support") - F.lit(K.COUNTER_WEIGHT) * F.col("best_counter")))


def support_label(codes: Column, needs_source: bool = True, overstated: bool = True) -> Column:
    def any_of(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names]))

    rest = (
        F.when(F.col("support_signal") < K.PARTIAL, "unsupported")
        .when(F.col("support_signal") < K.SOURCED, "partially_supported")
        .when((F.col("n_counter") > 0) | (F.size(codes) > 0), "partially_supported")
        .otherwise("supported")
    )
    return (
        F.when(F.col("claim_type") == "unclassified", "not_checkable")
        .when(~F.col("has_sources"), "needs_source" if needs_source else "unsupported")
        .when(F.lit(needs_source) & any_of(K.NEEDS_SOURCE_CODES), "needs_source")
        .when(F.lit(needs_source) & any_of(("comparison_missing",)) & (F.col("n_support") == 0), "needs_source")
        .when(F.lit(overstated) & any_of(K.OVERSTATED_CODES), "overstated")
        .otherwise(rest)
    )


def risk_label() -> Column:
    usual = (
        F.when(F.exists("flags", lambda f: f["risk"] == "high"), "high")
        .when((F.size("flags") > 0) | F.col("support_label").isin("partially_supported", "unsupported", "needs_source"), "medium")
        .otherwise("low")
    )
    return F.when(F.col("claim_type") == "unclassified", "low").when(~F.col("has_sources"), "medium").otherwise(usual)


def explanation() -> Column:
    label = F.col("support_label")
    usual = F.coalesce(*[F.when(label == name, F.lit(K.EXPLANATIONS[name])) for name in ("supported", "needs_source", "unsupported", "overstated")])
    partial = F.when(F.col("n_direct") > 0, K.EXPLANATIONS["direct"]).when(F.size("flags") > 0, K.EXPLANATIONS["flags"]).otherwise(K.EXPLANATIONS["related"])
    return F.when(F.col("claim_type") == "unclassified", K.EXPLANATIONS["not_checkable"]).when(~F.col("has_sources"), K.EXPLANATIONS["no_sources"]).otherwise(F.coalesce(usual, partial))


def limitations() -> Column:
    none = F.array().cast("array<string>")
    return (
        F.when(F.col("claim_type") == "unclassified", F.array(F.lit(K.LIMITATIONS["not_checkable"])))
        .when(~F.col("has_sources"), F.array(F.lit(K.LIMITATIONS["no_sources"])))
        .otherwise(F.when(F.size("flags") > 0, F.array(F.lit(K.LIMITATIONS["flags"]))).otherwise(none))
    )


def guidance(codes: Column) -> Column:
    """Rewrite guidance in fixed order; that of the label only where no flag gives any."""
    by_code = F.array_compact(F.array(*[F.when(F.array_contains(codes, code), F.lit(text)) for code, (_, _, text) in K.FLAGS.items()]))
    by_label = F.array_compact(F.array(*[F.when(F.col("support_label") == label, F.lit(text)) for label, text in K.LABEL_GUIDANCE.items()]))
    none = F.array().cast("array<string>")
    return F.when(F.col("claim_type") == "unclassified", none).when(F.size(by_code) > 0, by_code).otherwise(by_label)


def with_sources(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claims with has_sources: whether their bundle has a row in sources.  The bundles without any are
    looked for first: they are few as a rule, and then go to every task instead of a shuffle of all claims."""
    named = claims.filter("bundle_id is not null").select("bundle_id").distinct()
    bare = settled(named.join(sources.select("bundle_id").distinct(), "bundle_id", "left_anti")).withColumn("bare", F.lit(True))
    return claims.join(bare, "bundle_id", "left").withColumn("has_sources", F.col("bundle_id").isNotNull() & F.col("bare").isNull()).drop("bare")


def assess_claims(claims: DataFrame, contexts: DataFrame, sources: DataFrame, reference_date: str | Column | None = None, freshness_days: int = K.FRESHNESS_DAYS) -> DataFrame:
    """One assessment a claim of claims(bundle_id, claim_id, claim_text, claim_type): support_signal,
    flags, support_label, risk_label, explanation, rewrite_guidance, limitations and the evidence counts.

    Claims without contexts are assessed on none.  Unclassified claims and claims of bundles without a
    row in sources(bundle_id) leave before any rule, in this order, without flags and with signal 0.
    contexts and claims are read several times: settle contexts first.
    """
    # lists are gathered by sorting a task's rows, whose number must not grow with the table
    parts = parts_for(claims.sparkSession, max(contexts.count(), claims.count()))
    facts = evidence_facts(evidence_rows(with_support(contexts), reference_date, freshness_days).repartition(parts, *CLAIM))
    joined = with_sources(claims, sources).repartition(parts, *CLAIM).join(facts, CLAIM, "left")
    filled = joined.na.fill(0, ["n_support", "n_counter", "n_direct", "best_support", "best_counter"]).na.fill(
        False, ["any_numeric", "any_date", "any_adverse", "strong_causal", "any_comparison", "any_url", "all_weak", "all_stale"]
    )
    rows = with_texts(filled, claim_facts(claims), "claim_text").withColumn("excused", F.coalesce("excused", F.array().cast("array<string>")))
    rows = rows.withColumns({"confident": _first_trigger("confident_words"), "certain": _first_trigger("certain_words")})
    skipped = (F.col("claim_type") == "unclassified") | ~F.col("has_sources")
    found = flags()
    rows = rows.withColumn("flags", F.when(skipped, F.slice(found, 1, 0)).otherwise(found))
    rows = rows.withColumn("support_signal", F.when(skipped, 0.0).otherwise(support_signal())).withColumn("codes", F.transform("flags", lambda f: f["code"]))
    rows = rows.withColumn("support_label", support_label(F.col("codes")))
    rows = rows.withColumn("risk_label", risk_label())
    return rows.select(
        *CLAIM, "claim_text", "claim_type", "n_support", "n_counter", "n_direct", "support_signal", "flags", "codes", "support_label", "risk_label",
        explanation().alias("explanation"), guidance(F.col("codes")).alias("rewrite_guidance"), limitations().alias("limitations"),
    )


def audit_summary(assessments: DataFrame) -> DataFrame:
    """Number of claims, of each label and of high risks, in one row."""
    counts = [F.count_if(F.col("support_label") == label).alias(label) for label in K.SUPPORT_LABELS]
    return assessments.agg(F.count("*").alias("total_claims"), *counts, F.count_if(F.col("risk_label") == "high").alias("high_risk"))


def false_caution(scaffold: Column, verdict: Column, signal: Column, threshold: float = K.FALSE_CAUTION) -> Column:
    return scaffold.isin("uncertain", "unsupported") & verdict.isin("supported", "partially_supported") & (signal >= threshold)


def material_deviation(scaffold: Column, verdict: Column) -> Column:
    return F.concat_ws(":", scaffold, verdict).isin([f"{a}:{b}" for a, b in K.MATERIAL_DEVIATIONS])


def deviation_notes(scaffold: Column, verdict: Column, cautious: Column) -> Column:
    context = F.concat(F.lit("scaffold_support_status="), scaffold, F.lit("; audit_support_verdict="), verdict)
    return (
        F.when(cautious, F.concat(F.lit("Material disagreement: "), context, F.lit(f"; false_caution_flag=true because the scaffold was cautious and {K.AUDITOR} found supplied-evidence support.")))
        .when(material_deviation(scaffold, verdict), F.concat(F.lit("Material disagreement: "), context, F.lit(".")))
        .otherwise(F.concat(F.lit(f"No material disagreement between scaffold support status and {K.AUDITOR} verdict: "), context, F.lit(".")))
    )


#: field of a bundle's audit configuration: the only value accepted
POLICY = {
    "scoring.support_threshold_sourced": K.SOURCED,
    "scoring.support_threshold_partial": K.PARTIAL,
    "scoring.counterevidence_weight": K.COUNTER_WEIGHT,
    "rule_policies.require_passage_level_match": True,
    "rule_policies.flag_unsupported_threshold": K.ADMISSION,
    "rule_policies.false_caution_detection": True,
    "rule_policies.false_caution_threshold": K.FALSE_CAUTION,
    "rule_policies.overstated_detection": True,
    "rule_policies.needs_source_detection": True,
}


def policy_faults(config: Column, config_id: str | None = None) -> Column:
    """Array of the differences of a configuration, a JSON text, from the frozen policy; the
    configuration's own id is compared only where one is given."""

    def fault(path: str, expected: str | bool | float) -> Column:
        value = F.get_json_object(config, f"$.{path}")
        same = value.try_cast("double") == expected if isinstance(expected, float) else value == str(expected).lower() if isinstance(expected, bool) else value == expected
        text = F.concat(F.lit(f"{path}: expected {expected}, got "), F.coalesce(value, F.lit("nothing")))
        return F.when(~F.coalesce(same, F.lit(False)), text)

    wanted = POLICY if config_id is None else POLICY | {"config_id": config_id}
    return F.array_compact(F.array(*[fault(path, expected) for path, expected in wanted.items()]))
