"""Whole audits, from files to assessments: drafts with evidence files, and sealed bundles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .operators import adapt, extract, match, rules
from .sources import records
from .sources.bundles import bundle_files
from .sources.drafts import read_drafts
from .sources.evidence import scan_evidence
from .sources.files import checked
from .tables import settled

CONTEXT = ["bundle_id", "claim_id", "claim_text", "claim_type", "role", "rank", "source_id", "excerpt_id", "score", "excerpt_text", "notes", "reliability", "source_date", "url", "rationale"]


@dataclass(frozen=True)
class Audit:
    """claims(bundle_id, claim_id, claim_text, claim_type, location), contexts (their candidates, in the
    form that operators.rules and operators.report take), assessments, one row a claim, and
    faults(bundle_id, file, fault) of bundles that were left out (null for drafts, whose faults fail),
    and for drafts bundles(bundle_id, n_sources)."""

    claims: DataFrame
    contexts: DataFrame
    assessments: DataFrame
    faults: DataFrame | None = None
    bundles: DataFrame | None = None


def audit_drafts(
    spark: SparkSession, drafts: str | list[str], evidence: str | list[str], one_file: bool = False, reference_date: str | None = None,
    threshold: float = K.ADMISSION, k: int = K.TOP_CANDIDATES, keep_unclassified: bool = False,
) -> Audit:
    """Claims of the drafts against supplied evidence.

    A draft meets the evidence file of its own name, or with one_file the only file of evidence,
    whatever its name.  Claims of drafts without evidence are assessed on none.  A draft or evidence
    file that cannot be read fails the query.  bundle_id is the draft's document_id.
    """
    texts = read_drafts(spark, drafts)
    found = extract.extract_claims(texts, "document_id", "content", keep_unclassified)
    claims = found.select(F.col("document_id").alias("bundle_id"), "claim_id", F.col("text").alias("claim_text"), "claim_type", "location")
    rows = checked(scan_evidence(spark, evidence)).filter("source_id is not null").drop("path")
    excerpts = rows.filter("excerpt_id is not null")
    if one_file:
        # every claim may meet every excerpt: only those with a common key can reach the threshold
        scored = match.score_blocked_pairs(claims, excerpts, threshold)
        sources = claims.select("bundle_id").filter(F.lit(not rows.isEmpty()))
    else:
        scored, sources = match.score_candidates(claims, excerpts, threshold), rows
    best = match.best_candidates(scored, threshold, k).withColumn("role", F.lit("support"))
    contexts = settled(best.withColumn("rationale", match.rationale(F.col("reliability"))).select(*CONTEXT))
    told = rules.assess_claims(claims, contexts, sources, reference_date).join(claims.select("bundle_id", "claim_id", "location"), ["bundle_id", "claim_id"])
    counts = rows.select("source_id").distinct().agg(F.count("*").alias("n_sources")) if one_file else rows.groupBy("bundle_id").agg(F.count_distinct("source_id").alias("n_sources"))
    ids = texts.select(F.col("document_id").alias("bundle_id"))
    bundles = ids.join(counts) if one_file else ids.join(counts, "bundle_id", "left").na.fill(0, ["n_sources"])
    return Audit(claims, contexts, told, None, bundles)


def audit_bundles(spark: SparkSession, root: str, versions: tuple[str, ...] = ("1.0.0",), config_id: str | None = None) -> Audit:
    """The extracted claims of the sealed bundles below root, each against the passages that it names.

    A bundle with any fault (sources.records.record_faults) is left out whole and its faults told.
    Threshold, number of candidates and reference date are the bundle's own.
    """
    files = bundle_files(spark, root)
    faults = records.record_faults(files, versions, config_id)
    bad = faults.select("bundle_id").distinct()
    found = records.records(files).join(bad, "bundle_id", "left_anti")
    own = records.manifests(found).join(records.configs(found), "bundle_id")
    own = own.select("bundle_id", "threshold", F.greatest("total_evidence_passages", F.lit(1)).alias("most"), "reference_date")

    raw = records.claims(found)
    kept = raw.filter("claim_type = 'extracted_claim'")
    claims = kept.select("bundle_id", "claim_id", "claim_text", extract.claim_type(F.col("claim_text")).alias("claim_type"), adapt.claim_location("recorded_bundle").alias("location"), "scaffold_support_status")
    excerpts = adapt.excerpts(records.sources(found), records.passages(found))
    # a bundle's own limits ride on its claims
    scored = match.scoped_candidates(claims.join(own, "bundle_id"), excerpts, adapt.scope_links(raw), F.col("threshold"), F.col("most"))
    contexts = settled(scored.withColumn("rationale", match.rationale(F.col("reliability"))).select(*CONTEXT, "reference_date"))
    assessed = rules.assess_claims(claims, contexts, excerpts, F.col("reference_date"))
    told = assessed.join(claims.select("bundle_id", "claim_id", F.col("scaffold_support_status").alias("s")), ["bundle_id", "claim_id"])
    cautious = rules.false_caution(F.col("s"), F.col("support_label"), F.col("support_signal"))
    told = told.withColumns({"false_caution_flag": cautious, "deviation_flag": rules.material_deviation(F.col("s"), F.col("support_label")), "deviation_notes": rules.deviation_notes(F.col("s"), F.col("support_label"), cautious)})
    told = told.join(claims.select("bundle_id", "claim_id", "location"), ["bundle_id", "claim_id"])
    return Audit(claims.drop("scaffold_support_status"), contexts.drop("reference_date"), told.drop("s"), faults)
