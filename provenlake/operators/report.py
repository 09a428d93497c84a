"""Relations of the audit report, and their Markdown and JSON forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

#: The notes.
NOTES = {
    "weak": "Linked candidate evidence includes low or unknown source reliability metadata.",
    "low": "Direct support is flagged for weak source reliability.",
    "stale": "Direct support is flagged as stale under the configured freshness policy.",
    "mixed": "Candidate evidence mixes reliability or date metadata; review the table.",
    "negative": "Candidate evidence is linked, but direct supplied-evidence support is not recorded.",
}
CLAIM = ["bundle_id", "claim_id"]


def escaped(text: Column) -> Column:
    """A table cell: line ends become spaces, pipes are escaped."""
    return F.replace(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), F.lit("|"), F.lit("\\|"))


def inline(text: Column) -> Column:
    return F.replace(text, F.lit("`"), F.lit("\\`"))


def evidence_links(contexts: DataFrame) -> DataFrame:
    """One row for each (bundle, source, excerpt, role) that claims refer to: best score, the metadata
    of the best candidate (of the first claim id among equals) and the claims' ids in order."""
    best = F.min_by(F.struct("reliability", "source_date", "url"), F.struct(-F.col("score"), "claim_id"))
    grouped = contexts.groupBy("bundle_id", "source_id", "excerpt_id", "role").agg(F.max("score").alias("best_score"), best.alias("b"), F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))
    return grouped.select("bundle_id", "source_id", "excerpt_id", "role", "best_score", "claim_ids", "b.*")


def claim_register(assessments: DataFrame, contexts: DataFrame) -> DataFrame:
    """One line a claim: strongest evidence and main issue."""
    first = contexts.filter((F.col("role") == "support") & (F.col("rank") == 1)).select(*CLAIM, F.concat_ws(" / ", "source_id", "excerpt_id").alias("e"))
    issue = F.when(F.size("flags") > 0, F.array_join(F.transform("flags", lambda f: f["message"]), "; ")).otherwise(F.col("explanation"))
    return assessments.join(first, CLAIM, "left").select(*CLAIM, "support_label", "risk_label", F.coalesce("e", F.lit("none linked")).alias("strongest"), issue.alias("main_issue"))


def quality_notes(assessments: DataFrame, contexts: DataFrame) -> DataFrame:
    """Notes on the quality of a claim's support, as an array."""
    facts = contexts.filter("role = 'support'").groupBy(*CLAIM).agg(
        F.count("*").alias("n"),
        F.max(F.col("reliability").isin("low", "unknown")).alias("weak"),
        ((F.count_distinct("reliability") > 1) | (F.count_distinct(F.coalesce(F.col("source_date").cast("string"), F.lit(""))) > 1)).alias("mixed"),
    )
    rows = assessments.join(facts, CLAIM, "left")
    negative = (F.coalesce("n", F.lit(0)) > 0) & F.col("support_label").isin("unsupported", "needs_source", "not_checkable")
    when = {"weak": F.col("weak"), "low": F.array_contains("codes", "low_reliability_only"), "stale": F.array_contains("codes", "stale_source"), "mixed": F.col("mixed"), "negative": negative}
    return rows.select(*CLAIM, F.array_compact(F.array(*[F.when(when[k], F.lit(text)) for k, text in NOTES.items()])).alias("notes"))


def nested_json(assessments: DataFrame, contexts: DataFrame) -> DataFrame:
    """(bundle_id, report): the bundle's claims with their candidates as one JSON text; null fields are left out."""
    candidate = F.struct("rank", "source_id", "excerpt_id", "score", "reliability", "source_date", "url")
    lists = contexts.groupBy(*CLAIM).agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "support", candidate))).alias("candidate_evidence"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "counter", candidate))).alias("counterevidence"),
    )
    rows = assessments.join(lists, CLAIM, "left")
    claim = F.struct("claim_id", "claim_text", "claim_type", "support_label", "risk_label", "support_signal", "candidate_evidence", "counterevidence", "flags", "explanation", "rewrite_guidance", "limitations")
    return rows.groupBy("bundle_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(claim)).alias("claims"))).alias("report"))
