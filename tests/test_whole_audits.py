"""Whole audits from files: drafts with evidence, and sealed bundles, sound and faulty."""

import hashlib
import json
import shutil

import pytest
import yaml
from pyspark.sql import functions as F

from provenlake import audit
from provenlake.operators import rules
from provenlake.sources import records
from provenlake.sources.bundles import DUMP, PENDING, bundle_files

#: A published draft, its evidence and what becomes of its claims.
DRAFT = """# AI research note

The intervention clearly eliminates unsupported claims in multi-step AI research workflows.

The test set included 52 workflow outputs. Unsupported claims fell from 18 outputs to 11 outputs after the provenance checklist was added.

The checklist will always prevent researchers from relying on weak evidence.
"""
EVIDENCE = {
    "sources": [
        {
            "id": "source-001", "title": "Fictional provenance checklist evaluation", "source_type": "report", "date": "2026-04-01", "reliability": "medium",
            "excerpts": [
                {"id": "excerpt-001", "text": "The intervention reduced unsupported claims in the test set from 18 to 11.", "notes": "Fictional demo evidence. Supports reduction, not elimination."},
                {"id": "excerpt-002", "text": "The test set included 52 workflow outputs reviewed against the same claim-audit rubric.", "notes": "Fictional demo evidence for sample size."},
            ],
        }
    ]
}
PUBLISHED = [
    ("claim-1e17db4b2188", "causal", 0.7242, "partially_supported"),
    ("claim-61e15c02b15c", "numeric", 1.0, "supported"),
    ("claim-637e39806c48", "prediction", 0.0, "overstated"),
    ("claim-a1968235acf3", "scope", 0.0, "overstated"),
]


@pytest.mark.parametrize("one_file", [False, True])
def test_drafts(spark, tmp_path, one_file):
    for name in ("drafts", "evidence"):
        (tmp_path / name).mkdir()
    (tmp_path / "drafts" / "ai-research-note.md").write_text(DRAFT)
    (tmp_path / "drafts" / "alone.txt").write_text("The parser can detect duplicate invoices in the queue.")
    (tmp_path / "evidence" / ("any.json" if one_file else "ai-research-note.json")).write_text(json.dumps(EVIDENCE))
    done = audit.audit_drafts(spark, str(tmp_path / "drafts"), str(tmp_path / "evidence"), one_file)
    rows = done.assessments.collect()
    assert sorted((r.claim_id, r.claim_type, r.support_signal, r.support_label) for r in rows if r.bundle_id == "ai-research-note") == PUBLISHED
    (alone,) = [r for r in rows if r.bundle_id == "alone"]
    assert alone.support_signal == 0 and alone.support_label == ("unsupported" if one_file else "needs_source")
    assert sorted((r.claim_id, r.excerpt_id, r.rank) for r in done.contexts.collect()) == [("claim-1e17db4b2188", "excerpt-001", 1), ("claim-61e15c02b15c", "excerpt-002", 1)]


@pytest.mark.parametrize(("score", "label"), [(0.40, "unsupported"), (0.5499, "unsupported"), (0.55, "partially_supported"), (0.7999, "partially_supported"), (0.80, "supported")])
def test_published_bounds(spark, score, label):
    text = "The parser can detect duplicate invoices in the queue."
    claims = spark.createDataFrame([("b", "c", text, "capability")], "bundle_id string, claim_id string, claim_text string, claim_type string")
    context = claims.select("*", F.lit("support").alias("role"), F.lit(1).alias("rank"), F.lit("s").alias("source_id"), F.lit("e").alias("excerpt_id"), F.lit(score).alias("score"), F.lit(text).alias("excerpt_text"), F.lit(None).cast("string").alias("notes"), F.lit("high").alias("reliability"), F.lit(None).cast("date").alias("source_date"), F.lit(None).cast("string").alias("url"))
    assert [r.support_label for r in rules.assess_claims(claims, context, claims).collect()] == [label]


CLAIM = {
    "claim_id": "c1", "bundle_id": "u-1", "claim_text": "The tool can export invoices in 30 days.", "claim_type": "extracted_claim", "workflow_condition": "full", "task_id": "t1", "scaffold_support_status": "unsupported",
    "scaffold_claim_strength": 0.86, "scaffold_extraction_fidelity": 0.9, "scaffold_counterevidence_found": False, "scaffold_downgraded": False,
    "evidence_passages": [{"passage_id": "p1", "source_id": "s1"}], "counterevidence_passages": [],
}
SOURCE = {"source_id": "s1", "bibliographic": {"source_type": "regulatory_guidance", "title": "T", "publication_date": "2026-05-08", "url": None}, "trust_level": "primary", "content_hash": "sha256:0"}
PASSAGE = {
    "passage_id": "p1", "source_id": "s1", "passage_text": "The tool can export invoices in 30 days.", "section": "One", "paragraph_index": 2, "char_start": 1, "char_end": 9, "passage_hash": "sha256:1",
    "extraction_method": "manual", "provenance": {"source_content_hash": "sha256:0", "scaffold_run_id": "r", "evidence_builder_version": "1"},
}
CONFIG = {
    "config_id": "rules", "config_hash": PENDING, "scoring": {"support_threshold_sourced": 0.8, "support_threshold_partial": 0.55, "counterevidence_weight": 0.3},
    "rule_policies": {"require_passage_level_match": True, "flag_unsupported_threshold": 0.4, "false_caution_detection": True, "false_caution_threshold": 0.85, "overstated_detection": True, "needs_source_detection": True},
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bundle(root, claims=(CLAIM,), source=SOURCE, passages=(PASSAGE,), config=CONFIG, version="1.0.0\n", counts=None, policy=None):
    """A sealed bundle of these records."""
    config = config | {"rule_policies": config["rule_policies"] | (policy or {})}
    config = config | {"config_hash": "sha256:" + sha(yaml.safe_dump(config, **DUMP))}
    held = {"claims_included": len(claims), "total_evidence_passages": len(passages)} | (counts or {})
    manifest = {"bundle_id": "u-1", "generated_at_utc": "2026-05-10T16:35:22Z", "audit_config_hash": config["config_hash"], "bundle": held | {"bundle_hash": PENDING}}
    texts = {"CONTRACT_VERSION": version, "audit_config.yaml": config, "bundle_manifest.yaml": manifest, "evidence/s1/source_profile.yaml": source}
    texts |= {f"claims/{i}.yaml": c for i, c in enumerate(claims)} | {f"evidence/s1/passages/{i}.yaml": p for i, p in enumerate(passages)}
    texts = {f: t if isinstance(t, str) else yaml.safe_dump(t, **DUMP) for f, t in texts.items()}
    # the tree is hashed with both self-hashed files pending
    pending = {"audit_config.yaml": yaml.safe_dump(config | {"config_hash": PENDING}, **DUMP)}
    tree = "".join(f"{f}\0{sha(pending.get(f, texts[f]))}\n" for f in sorted(texts, key=lambda f: f.split("/")))
    manifest["bundle"]["bundle_hash"] = "sha256:" + sha(tree)
    texts["bundle_manifest.yaml"] = yaml.safe_dump(manifest, **DUMP)
    for file, text in texts.items():
        (root / file).parent.mkdir(parents=True, exist_ok=True)
        (root / file).write_text(text)
    (root / "SHA256SUMS").write_text("".join(f"{sha(t)}  {f}\n" for f, t in texts.items()))


def test_bundles(spark, tmp_path):
    bundle(tmp_path / "good", claims=(CLAIM, CLAIM | {"claim_id": "c2", "claim_type": "retrieval_seed"}, CLAIM | {"claim_id": "c3", "evidence_passages": [], "counterevidence_passages": [{"passage_id": "p1", "source_id": "s1"}]}))
    bundle(tmp_path / "bad", claims=(CLAIM | {"evidence_passages": [{"passage_id": "p9", "source_id": "s1"}]},))
    done = audit.audit_bundles(spark, str(tmp_path), config_id="rules")
    assert [tuple(r) for r in done.faults.collect()] == [("bad", "claims/c1", "no such passage: s1/p9")]
    rows = {r.claim_id: r for r in done.assessments.collect()}
    assert set(rows) == {"c1", "c3"}
    assert (rows["c1"].support_label, rows["c1"].false_caution_flag, rows["c1"].deviation_flag) == ("supported", True, True)
    assert (rows["c3"].n_support, rows["c3"].n_counter, rows["c3"].false_caution_flag) == (0, 1, False)
    (claim,) = done.claims.filter("claim_id = 'c1'").collect()
    assert claim.location.startswith("C-B bundle u-1; workflow_condition=full") and "scaffold_claim_strength=0.86" in claim.location
    assert {(r.claim_id, r.role, r.excerpt_id, r.reliability, str(r.source_date)) for r in done.contexts.collect()} == {("c1", "support", "s1/p1", "high", "2026-05-08"), ("c3", "counter", "s1/p1", "high", "2026-05-08")}


def test_bundle_faults(spark, tmp_path):
    """Each bundle has one fault, but that an unread record also changes a count."""
    bundle(tmp_path / "version", version="2.0.0")
    bundle(tmp_path / "counts", counts={"claims_included": 2})
    bundle(tmp_path / "folder", source=SOURCE | {"source_id": "s2"})
    bundle(tmp_path / "twice", claims=(CLAIM, CLAIM))
    bundle(tmp_path / "offsets", passages=(PASSAGE | {"char_end": 1},))
    bundle(tmp_path / "policy", policy={"flag_unsupported_threshold": 0.3, "overstated_detection": False})
    bundle(tmp_path / "lacks", claims=({k: v for k, v in CLAIM.items() if k != "task_id"},))
    bundle(tmp_path / "list", claims=("- 1\n",))
    bundle(tmp_path / "yaml", claims=("a: [1",))
    bundle(tmp_path / "altered")
    (tmp_path / "altered" / "claims" / "0.yaml").write_text(yaml.safe_dump(CLAIM | {"task_id": "t2"}, **DUMP))
    bundle(tmp_path / "headless")
    (tmp_path / "headless" / "audit_config.yaml").unlink()
    bundle(tmp_path / "orphan")
    (tmp_path / "orphan" / "evidence" / "s1" / "source_profile.yaml").unlink()
    found = {}
    for r in records.record_faults(bundle_files(spark, str(tmp_path))).collect():
        found.setdefault(r.bundle_id, set()).add(r.fault)
    assert found.pop("orphan") >= {"missing file", "tree hash differs", "no such source"}
    assert found.pop("headless") >= {"missing file", "tree hash differs"}
    assert found == {
        "version": {"contract version is not supported"},
        "counts": {"count of claims differs"},
        "folder": {"folder and source differ"},
        "twice": {"duplicate claim id"},
        "offsets": {"char_end must be greater than char_start"},
        "policy": {"rule_policies.flag_unsupported_threshold: expected 0.4, got 0.3", "rule_policies.overstated_detection: expected True, got false"},
        "lacks": {"lacks task_id"},
        "list": {"not a mapping"},
        "yaml": {"not YAML"},
        "altered": {"digest differs", "tree hash differs"},
    }
    shutil.rmtree(tmp_path / "version")
    empty = records.record_faults(bundle_files(spark, str(tmp_path)).limit(0))
    assert empty.count() == 0
