"""Trace files: one JSON file a claim, which tells how its verdict came about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import checked, whole_files

#: The fields of a trace.
TRACE = """claim_id string, claim_text string, retrieval array<struct<passage_id string, score double>>,
  entailment array<struct<passage_id string, label string, score double, raw_logits array<double>>>,
  features struct<numerical_values array<struct<value double, unit string, surface_text string>>, has_explicit_negation boolean, has_universal_quantifier boolean,
    modal_strength string, claim_token_count int, compound_claim boolean, sentence_type string>,
  support_signal struct<label string, max_entailment_score double, contributing_passage_id string>, rules_fired array<struct<rule_id string, reason string>>,
  verdict struct<support_verdict string, support_verdict_reason string, audit_flags array<string>, citation_status string, audit_confidence string>,
  audit_config_hash string, library_version string"""
FIELDS = ("claim_id", "claim_text", "retrieval", "entailment", "features", "support_signal", "rules_fired", "verdict", "audit_config_hash", "library_version")
SUFFIX = ".audit-trace"


def scan_traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row a trace file under path: its fields, path and error, which says why it is refused: not
    UTF-8, not a JSON object, a field too many or too few, a name other than its claim's id (with or
    without .audit-trace), or an id that stands twice."""
    files = whole_files(spark, path, (".json",))
    keys = F.json_object_keys("text")
    extra, gone = F.array_except(keys, F.array(*map(F.lit, FIELDS))), F.array_except(F.array(*map(F.lit, FIELDS)), keys)
    shape = (
        F.when(F.try_parse_json("text").isNull(), F.lit("Could not parse the file."))
        .when(keys.isNull(), F.lit("not a mapping"))
        .when(F.size(extra) > 0, F.concat(F.lit("unknown field "), extra[0]))
        .when(F.size(gone) > 0, F.concat(F.lit("lacks "), gone[0]))
    )
    # from_json gives null for a value of another type; the verdict is what no reader can do without
    rows = files.select("path", "stem", F.coalesce("error", shape).alias("error"), F.from_json("text", TRACE).alias("t")).select("path", "stem", "error", "t.*")
    name = F.when(F.endswith("stem", F.lit(SUFFIX)), F.expr(f"left(stem, char_length(stem) - {len(SUFFIX)})")).otherwise(F.col("stem"))
    wrong = F.when(F.col("verdict.support_verdict").isNull(), F.lit("no verdict")).when(~F.col("claim_id").eqNullSafe(name), F.lit("file name and claim_id differ"))
    rows = rows.withColumn("error", F.coalesce("error", wrong)).drop("stem")
    twice = rows.filter("claim_id is not null").groupBy("claim_id").count().filter("count > 1").select("claim_id", F.lit("Duplicate claim_id").alias("twice"))
    return rows.join(twice, "claim_id", "left").withColumn("error", F.coalesce("error", "twice")).drop("twice")


def read_traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The traces of scan_traces; the query fails at a file that it faults."""
    return checked(scan_traces(spark, path)).drop("path")


def unbound(traces: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, fault) of claims(claim_id, claim_text) and traces that do not go together."""
    both = claims.select("claim_id", F.col("claim_text").alias("a"), F.lit(True).alias("in_claims")).join(traces.select("claim_id", F.col("claim_text").alias("b"), F.lit(True).alias("in_traces")), "claim_id", "full_outer")
    fault = F.when(F.col("in_traces").isNull(), F.lit("claim without trace")).when(F.col("in_claims").isNull(), F.lit("trace without claim")).when(~F.col("a").eqNullSafe(F.col("b")), F.lit("texts differ"))
    return both.select("claim_id", fault.alias("fault")).filter("fault is not null")


def verdict_rows(traces: DataFrame) -> DataFrame:
    """(claim_id, cal, cal_flags, rules, library_version): what calibration takes from a trace."""
    return traces.select(
        "claim_id", F.col("verdict.support_verdict").alias("cal"), F.coalesce("verdict.audit_flags", F.array().cast("array<string>")).alias("cal_flags"),
        F.coalesce(F.transform("rules_fired", lambda r: r["rule_id"]), F.array().cast("array<string>")).alias("rules"), "library_version",
    )
