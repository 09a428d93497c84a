"""The records of sealed bundles as tables: claims, sources, passages and headers, and what is wrong with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import adapt, rules
from .bundles import SUMS, bundle_files, pending_digest, seal_faults, tree_hashes
from .evidence import yaml_as_json
from .files import stripped

__all__ = ["bundle_files", "claims", "configs", "manifests", "passages", "record_faults", "records", "sources"]

VERSION = "CONTRACT_VERSION"
#: Where each kind of record lies in a bundle, and the fields that it must hold.
PLACES = {
    "claim": r"^claims/[^/]+\.yaml$",
    "source": r"^evidence/[^/]+/source_profile\.yaml$",
    "passage": r"^evidence/[^/]+/passages/[^/]+\.yaml$",
    "manifest": r"^bundle_manifest\.yaml$",
    "config": r"^audit_config\.yaml$",
}
REQUIRED = {
    "claim": ("claim_id", "bundle_id", "claim_text", "claim_type", "workflow_condition", "task_id", "scaffold_support_status", "scaffold_claim_strength", "scaffold_extraction_fidelity", "scaffold_counterevidence_found", "scaffold_downgraded"),
    "source": ("source_id", "bibliographic.source_type", "bibliographic.title", "trust_level", "content_hash"),
    "passage": ("passage_id", "source_id", "passage_text", "paragraph_index", "char_start", "char_end", "passage_hash", "extraction_method", "provenance.source_content_hash", "provenance.scaffold_run_id", "provenance.evidence_builder_version"),
    "manifest": ("bundle_id", "generated_at_utc", "bundle.claims_included", "bundle.total_evidence_passages", "bundle.bundle_hash", "audit_config_hash"),
    "config": ("config_id", "config_hash", "rule_policies.flag_unsupported_threshold"),
}
PLACE = "array<struct<source_id string, passage_id string>>"
CLAIM = (
    "claim_id string, bundle_id string, claim_text string, claim_type string, workflow_condition string, task_id string, scaffold_support_status string, scaffold_claim_strength double, "
    f"scaffold_extraction_fidelity double, scaffold_counterevidence_found boolean, scaffold_downgraded boolean, evidence_passages {PLACE}, counterevidence_passages {PLACE}"
)
SOURCE = "source_id string, bibliographic struct<source_type string, title string, url string, publication_date string>, trust_level string, content_hash string"
PASSAGE = (
    "passage_id string, passage_text string, section string, paragraph_index int, char_start int, char_end int, passage_hash string, extraction_method string, "
    "provenance struct<source_content_hash string, scaffold_run_id string, evidence_builder_version string>"
)
MANIFEST = "bundle_id string, generated_at_utc string, audit_config_hash string, bundle struct<claims_included long, total_evidence_passages long, bundle_hash string>"
CONFIG = "config_id string, config_hash string, rule_policies struct<flag_unsupported_threshold double>"


def records(files: DataFrame) -> DataFrame:
    """(bundle_id, file, kind, doc) of the records among bundle_files; doc is their JSON form, null
    for what is not YAML.  Other files of a bundle are no records."""
    kind = F.coalesce(*[F.when(F.col("file").rlike(place), F.lit(name)) for name, place in PLACES.items()])
    found = files.select("bundle_id", "file", kind.alias("kind"), F.col("content").cast("string").alias("text")).filter("kind is not null")
    return found.select("bundle_id", "file", "kind", yaml_as_json("text").alias("doc"))


def _table(found: DataFrame, kind: str, schema: str) -> DataFrame:
    return found.filter(F.col("kind") == kind).select("bundle_id", "file", F.from_json("doc", schema).alias("r"))


def claims(found: DataFrame) -> DataFrame:
    """A row a claim of records; its arrays evidence and counterevidence hold (source_id, passage_id),
    and recorded_bundle is the bundle that the claim itself names."""
    r = F.col("r")
    rows = _table(found, "claim", CLAIM).withColumn("r", r.withField("recorded_bundle", r["bundle_id"]).dropFields("bundle_id")).select("bundle_id", "r.*")
    return rows.withColumnsRenamed({"evidence_passages": "evidence", "counterevidence_passages": "counterevidence"})


def sources(found: DataFrame) -> DataFrame:
    """A row a source; its id is the name of its folder, recorded_id the one that its file names."""
    rows = _table(found, "source", SOURCE)
    return rows.select("bundle_id", F.split("file", "/")[1].alias("source_id"), F.col("r.source_id").alias("recorded_id"), "r.bibliographic.*", "r.trust_level", "r.content_hash")


def passages(found: DataFrame) -> DataFrame:
    """A row a passage; its source is the folder that it lies in, load_order its file's name."""
    rows = _table(found, "passage", PASSAGE).select("bundle_id", F.split("file", "/")[1].alias("source_id"), F.element_at(F.split("file", "/"), -1).alias("load_order"), "r.*")
    return rows.select("*", "provenance.*").drop("provenance")


def manifests(found: DataFrame) -> DataFrame:
    rows = _table(found, "manifest", MANIFEST)
    return rows.select("bundle_id", F.col("r.bundle_id").alias("recorded_bundle"), F.try_to_date(F.left("r.generated_at_utc", F.lit(10)), "yyyy-MM-dd").alias("reference_date"), "r.audit_config_hash", "r.bundle.*")


def configs(found: DataFrame) -> DataFrame:
    return _table(found, "config", CONFIG).select("bundle_id", "r.config_id", "r.config_hash", F.col("r.rule_policies.flag_unsupported_threshold").alias("threshold"))


def _lacking(kind: str) -> Column:
    """The first required field of a record that is absent or null."""
    gone = [F.when(F.get_json_object("doc", f"$.{name}").isNull(), F.lit(f"lacks {name}")) for name in REQUIRED[kind]]
    return F.when(F.json_object_keys("doc").isNull(), F.lit("not a mapping")).otherwise(F.coalesce(*gone))


def record_faults(files: DataFrame, versions: tuple[str, ...] = ("1.0.0",), config_id: str | None = None) -> DataFrame:
    """(bundle_id, file, fault) of every fault of the bundles; a bundle without a row can be audited.

    Beside seal_faults: a header that is missing, a contract version that is not among versions, a
    record that is no YAML mapping or lacks a field, a configuration that departs from the policy
    (rules.policy_faults) or from its own or the manifest's hash, a tree hash or counts other than the
    manifest's, a folder of another name than its source, a passage without a source, ids that stand twice, ends before beginnings,
    and claims that refer to a passage the bundle does not hold.
    """
    found = records(files)
    names = files.select("bundle_id").distinct()
    wanted = names.select("bundle_id", F.explode(F.array(*map(F.lit, (VERSION, "bundle_manifest.yaml", "audit_config.yaml")))).alias("file"))
    missing = wanted.join(files.select("bundle_id", "file"), ["bundle_id", "file"], "left_anti").withColumn("fault", F.lit("missing file"))
    version = stripped(F.col("content").cast("string"))
    other = files.filter((F.col("file") == VERSION) & ~version.isin(*versions)).select("bundle_id", "file", F.lit("contract version is not supported").alias("fault"))

    lacking = F.coalesce(*[F.when(F.col("kind") == kind, _lacking(kind)) for kind in REQUIRED])
    unread = found.select("bundle_id", "file", F.when(F.col("doc").isNull(), F.lit("not YAML")).otherwise(lacking).alias("fault")).filter("fault is not null")

    c, s, p, m = claims(found), sources(found), passages(found), manifests(found)
    told = m.select("bundle_id", "claims_included", "total_evidence_passages", "audit_config_hash", "bundle_hash")
    n_claims = c.groupBy("bundle_id").agg(F.count("*").alias("n_claims"))
    n_passages = p.groupBy("bundle_id").agg(F.count("*").alias("n_passages"))
    own = files.filter("file = 'audit_config.yaml'").select("bundle_id", F.concat(F.lit("sha256:"), pending_digest("file", "content")).alias("own"))
    both = told.join(n_claims, "bundle_id", "left").join(n_passages, "bundle_id", "left").join(tree_hashes(files), "bundle_id", "left").join(own.join(configs(found), "bundle_id"), "bundle_id", "left")
    checks = {
        "count of claims differs": F.coalesce("n_claims", F.lit(0)) != F.col("claims_included"),
        "count of passages differs": F.coalesce("n_passages", F.lit(0)) != F.col("total_evidence_passages"),
        "tree hash differs": ~F.col("tree_hash").eqNullSafe(F.col("bundle_hash")),
        "configuration's hash is not its own": ~F.col("own").eqNullSafe(F.col("config_hash")),
        "configuration's hash is not the manifest's": ~F.col("config_hash").eqNullSafe(F.col("audit_config_hash")),
    }
    whole = both.select("bundle_id", F.lit("bundle_manifest.yaml").alias("file"), F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks.items()]))).alias("fault"))

    policy = found.filter("kind = 'config'").select("bundle_id", "file", F.explode(rules.policy_faults(F.col("doc"), config_id)).alias("fault"))
    folder = F.concat(F.lit("evidence/"), F.col("source_id"))
    named = s.filter("recorded_id <> source_id").select("bundle_id", folder.alias("file"), F.lit("folder and source differ").alias("fault"))
    # what the joins to sources would drop in silence
    orphans = p.join(s.select("bundle_id", "source_id"), ["bundle_id", "source_id"], "left_anti").select("bundle_id", F.concat(folder, F.lit("/"), "passage_id").alias("file"), F.lit("no such source").alias("fault"))
    twice = c.groupBy("bundle_id", "claim_id").count().filter("count > 1").select("bundle_id", F.concat(F.lit("claims/"), "claim_id").alias("file"), F.lit("duplicate claim id").alias("fault"))
    turned = adapt.bad_offsets(p).select("bundle_id", F.concat(folder, F.lit("/"), "passage_id").alias("file"), "fault")
    held = p.join(s.select("bundle_id", "source_id"), ["bundle_id", "source_id"], "left_semi").select("bundle_id", adapt.excerpt_id(F.col("source_id"), F.col("passage_id")).alias("excerpt_id"))
    dangling = adapt.dangling_links(adapt.scope_links(c), held).select("bundle_id", F.concat(F.lit("claims/"), "claim_id").alias("file"), F.concat(F.lit("no such passage: "), "excerpt_id").alias("fault"))
    # the seal does not cover its own list
    sealed = seal_faults(files).filter((F.col("file") != SUMS) | (F.col("fault") == "no list"))
    return reduce(DataFrame.unionByName, [missing, other, unread, whole, policy, named, orphans, twice, turned, dangling], sealed)
