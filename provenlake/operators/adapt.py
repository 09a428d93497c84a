"""Bundle records as the audit's tables: sources, excerpts, locations, scope links and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def excerpt_id(source_id: Column, passage_id: Column) -> Column:
    return F.concat(source_id, F.lit("/"), passage_id)


def _mapped(value: Column, names: dict[str, str]) -> Column:
    out = F.lit("unknown")
    for name, put in names.items():
        out = F.when(value == name, put).otherwise(out)
    return out


def source_type(value: Column) -> Column:
    return _mapped(value, K.SOURCE_TYPES)


def reliability(trust_level: Column) -> Column:
    return _mapped(trust_level, K.RELIABILITY)


def claim_location(bundle: str = "bundle_id") -> Column:
    """Where a claim of a bundle stands and what the scaffold made of it, as one text."""
    c = F.col
    truth = lambda name: F.when(c(name), "True").otherwise("False")
    return F.concat(
        F.lit("C-B bundle "), c(bundle).cast("string"), F.lit("; workflow_condition="), c("workflow_condition"), F.lit("; task_id="), c("task_id"),
        F.lit("; scaffold_support_status="), c("scaffold_support_status"), F.lit("; scaffold_claim_strength="), F.format_string("%.2f", F.bround("scaffold_claim_strength", 2)),
        F.lit("; scaffold_extraction_fidelity="), F.format_string("%.2f", F.bround("scaffold_extraction_fidelity", 2)),
        F.lit("; scaffold_counterevidence_found="), truth("scaffold_counterevidence_found"), F.lit("; scaffold_downgraded="), truth("scaffold_downgraded"),
    )


def passage_notes() -> Column:
    """A passage's place and origin, as one text."""
    c = F.col
    parts = [("c_b_passage_id", c("passage_id")), ("section", F.coalesce(F.nullif("section", F.lit("")), F.lit("not recorded"))), ("paragraph_index", c("paragraph_index"))]
    parts += [("char_range", F.concat_ws("-", "char_start", "char_end")), *[(name, c(name)) for name in ("extraction_method", "passage_hash", "source_content_hash", "scaffold_run_id", "evidence_builder_version")]]
    return F.concat_ws("; ", *[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in parts])


def excerpts(sources: DataFrame, passages: DataFrame) -> DataFrame:
    """(bundle_id, source_id, excerpt_id, excerpt_text, notes, source_type, reliability, url,
    source_date) of the passages of each source."""
    rows = passages.withColumn("notes", passage_notes()).select("bundle_id", "source_id", excerpt_id(F.col("source_id"), F.col("passage_id")).alias("excerpt_id"), F.col("passage_text").alias("excerpt_text"), "notes")
    told = sources.select("bundle_id", "source_id", source_type(F.col("source_type")).alias("source_type"), reliability(F.col("trust_level")).alias("reliability"), "url", F.try_to_timestamp(F.left("publication_date", F.lit(10)), F.lit("yyyy-MM-dd")).cast("date").alias("source_date"))
    return rows.join(told, ["bundle_id", "source_id"])


def scope_links(claims: DataFrame) -> DataFrame:
    """(bundle_id, claim_id, excerpt_id, role) of extracted claims, from their arrays evidence and
    counterevidence of (source_id, passage_id); a claim without any has no row."""

    def links(col: str, role: str) -> Column:
        given = F.coalesce(col, F.array().cast("array<struct<source_id:string,passage_id:string>>"))
        return F.transform(given, lambda x: F.struct(F.lit(role).alias("role"), x["source_id"].alias("s"), x["passage_id"].alias("p")))

    both = F.concat(links("evidence", "support"), links("counterevidence", "counter"))
    rows = claims.filter("claim_type = 'extracted_claim'").select("bundle_id", "claim_id", F.explode(both).alias("x"))
    return rows.select("bundle_id", "claim_id", excerpt_id(F.col("x.s"), F.col("x.p")).alias("excerpt_id"), F.col("x.role").alias("role")).distinct()


def dangling_links(links: DataFrame, excerpt_rows: DataFrame) -> DataFrame:
    """Links to an excerpt that the bundle does not hold."""
    return links.join(excerpt_rows.select("bundle_id", "excerpt_id"), ["bundle_id", "excerpt_id"], "left_anti")


def bad_offsets(passages: DataFrame) -> DataFrame:
    """Passages that end before they begin, and ids that stand twice in a source."""
    ids = ["bundle_id", "source_id", "passage_id"]
    turned = passages.filter("char_end <= char_start").select(*ids, F.lit("char_end must be greater than char_start").alias("fault"))
    twice = passages.groupBy(*ids).count().filter("count > 1").select(*ids, F.lit("duplicate passage id").alias("fault"))
    return turned.unionByName(twice)


def requests(claims: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted claims, and each bundle's passages with their ordinal: by source, then in load order."""
    order = Window.partitionBy("bundle_id").orderBy("source_id", "load_order")
    numbered = passages.select("bundle_id", excerpt_id(F.col("source_id"), F.col("passage_id")).alias("passage_id"), "passage_text", F.row_number().over(order).alias("ordinal"))
    return claims.filter("claim_type = 'extracted_claim'").select("bundle_id", "claim_id", "claim_text"), numbered


def summary_line(n_sources: Column | None = None) -> Column:
    """The one-line text of an audit_summary row."""
    words = (("total_claims", "claims assessed"), ("high_risk", "high-risk"), ("supported", "supported by supplied evidence"), ("partially_supported", "partially supported"), ("unsupported", "unsupported"), ("overstated", "overstated"), ("needs_source", "needing supplied source"), ("not_checkable", "not checkable"))
    parts = [F.concat_ws(" ", F.col(name).cast("string"), F.lit(text)) for name, text in words]
    warned = [] if n_sources is None else [F.when(n_sources == 0, "1 evidence bundle warnings")]
    return F.concat(F.concat_ws("; ", *parts, *warned), F.lit("."))
