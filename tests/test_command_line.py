"""The command line, labels and settings."""

import dataclasses
import hashlib
import json

import pytest
import yaml
from pyspark.sql import functions as F

from provenlake.__main__ import main
from provenlake.sources import deviations, gold, settings, traces
from provenlake.sources.files import SourceError

from .test_whole_audits import CLAIM, DRAFT, EVIDENCE, bundle
from .test_writeback import TRACE, held


def test_audit_command(spark, tmp_path, capsys):
    (tmp_path / "ai-research-note.md").write_text(DRAFT)
    (tmp_path / "other.md").write_text("# Only a heading\n")
    (tmp_path / "evidence.json").write_text(json.dumps(EVIDENCE))
    run = ["audit", str(tmp_path / "ai-research-note.md"), str(tmp_path / "other.md"), "--evidence", str(tmp_path / "evidence.json"), "--one-file", "--out", str(tmp_path / "md"), "--json-out", str(tmp_path / "json")]
    assert main(run, spark) == 0
    said = capsys.readouterr().out
    assert "4 claims assessed" in said and "1 supported by supplied evidence" in said
    texts = held(tmp_path / "md")
    assert set(texts) == {"ai-research-note.md", "other.md"} and set(held(tmp_path / "json")) == {"ai-research-note.json"}
    lines = texts["ai-research-note.md"].decode().splitlines()
    assert lines[0] == '<a id="report-ai-research-note"></a>' and "4 claims extracted. Findings: 1 supported, 1 partially supported, 0 unsupported, 2 overstated, 0 needs-source, 0 not-checkable. High-risk claims: 2." in lines
    wanted = [
        "| `source-001` | `excerpt-001` | 0.7242 | medium | 2026-04-01 | not supplied | matched numbers: 11, 18; overlapping terms: claim, reduc, set, test, unsupport; source reliability: medium |",
        '| <a id="evidence-source-001-excerpt-002"></a> `source-001` | `excerpt-002` | support | `claim-61e15c02b15c` | 1.0000 | medium | 2026-04-01 | not supplied |',
    ]
    assert wanted[1] in lines and sum(x.startswith("| `source-001` | `excerpt-001` | 0.7242 | medium | 2026-04-01 | not supplied | matched numbers: 11, 18") for x in lines) == 1
    # claims stand in the order of the draft, and nothing follows the last line
    assert [x.split("`")[1] for x in lines if x.startswith("### ")][:4] == ["claim-a1968235acf3", "claim-61e15c02b15c", "claim-1e17db4b2188", "claim-637e39806c48"]
    assert "No claims were extracted from the draft." in texts["other.md"].decode() and texts["ai-research-note.md"].endswith(b".\n")
    # a second run is identical; a draft that is gone is told
    assert main(run, spark) == 0 and held(tmp_path / "md") == texts
    assert main(["audit", str(tmp_path / "gone.md"), "--evidence", str(tmp_path / "evidence.json"), "--out", str(tmp_path / "md")], spark) == 1
    assert "gone.md" in capsys.readouterr().err


def test_bundle_command(spark, tmp_path, capsys):
    bundle(tmp_path / "in" / "one", claims=(CLAIM | {"claim_id": "0"},))
    bundle(tmp_path / "in" / "bad", version="2.0.0")
    run = ["audit-bundle", str(tmp_path / "in"), "--audit-run-id", "r1", "--audited-at", "2026-05-11T00:00:00Z"]
    assert main([*run, "--out", str(tmp_path / "in" / "x")], spark) == 1 and "inside" in capsys.readouterr().err
    assert main([*run, "--out", str(tmp_path / "out"), "--reports", str(tmp_path / "md"), "--faults", str(tmp_path / "faults"), "--deviations", str(tmp_path / "dev")], spark) == 0
    told = "bad:vocabulary_drift:CONTRACT_VERSION: contract version is not supported"
    (record,) = held(tmp_path / "dev").items()
    assert record[0] == "intake-bad.yaml" and yaml.safe_load(record[1]) == {
        "deviation_id": "dev-" + hashlib.sha256(told.encode()).hexdigest()[:12], "deviation_type": "vocabulary_drift", "artifact_id": "bad", "detected_at_utc": "2026-05-11T00:00:00Z", "detected_by": "provenlake",
        "description": "CONTRACT_VERSION: contract version is not supported", "impact_assessment": "Cannot proceed; bundle intake halted.", "resolution": "pending", "capa_notes": "",
    }
    assert "left out for their faults: 1" in capsys.readouterr().out
    assert yaml.safe_load((tmp_path / "out" / "one" / "claims" / "0.yaml").read_text())["audit"]["audit_run_id"] == "r1"
    assert set(held(tmp_path / "md")) == {"one.md"} and b"contract version" in b"".join(held(tmp_path / "faults").values())


GOLD = {"gold_version": "g1", "starved_claim_ids": ["c1"], "claims": [
    {"claim_id": "c0", "condition": "full", "model": "m1", "gold_verdict": "supported", "gold_flags": ["overconfident"]},
    {"claim_id": "c1", "condition": "full", "model": "m2", "gold_verdict": "reasonable_inference"},
    {"claim_id": "c2", "condition": "bare", "model": "m1", "gold_verdict": "contradicted", "gold_flags": []},
    {"claim_id": "c3", "condition": "bare", "model": "m1", "gold_verdict": "not_checkable"},
]}


def trace(claim_id, verdict, rules=("B5_supported",)):
    return TRACE | {"claim_id": claim_id, "verdict": TRACE["verdict"] | {"support_verdict": verdict}, "rules_fired": [{"rule_id": r, "reason": None} for r in rules]}


def test_calibrate_command(spark, tmp_path, capsys):
    (tmp_path / "traces").mkdir()
    for k, verdict in enumerate(("supported", "partially_supported", "unsupported", "not_checkable")):
        (tmp_path / "traces" / f"c{k}.json").write_text(json.dumps(trace(f"c{k}", verdict, ("A1", "B5") if k < 2 else ("A1",))))
    (tmp_path / "gold.yaml").write_text(yaml.safe_dump(GOLD))
    run = ["calibrate", "--traces", str(tmp_path / "traces"), "--gold", str(tmp_path / "gold.yaml"), "--out", str(tmp_path / "out"), "--traces-out", str(tmp_path / "again"), "--pinned-at", "2026-07-01T00:00:00Z"]
    assert main(run, spark) == 0
    lines = held(tmp_path / "out")["calibration.md"].decode().splitlines()
    rules, sha = settings.load_rules()
    assert lines[:2] == ["# Calibration report", "Generated: 2026-07-01T00:00:00Z"] and f"Rules: {rules['rules_version']} (sha: {sha})" in lines
    at = lines.index("## 1. Recall floor on starved claims")
    assert lines[at - 2 : at + 5] == ["Claims scored: 4", "", "## 1. Recall floor on starved claims", "- supported: 0/1", "- partially_supported: 1/1", "- adverse (unsupported + contradicted): 0/1", "- not_checkable: 0/1"]
    assert "- Exact agreement: 2/4 (50.0%)" in lines
    at = lines.index("## 3. Support-verdict confusion (gold rows x CAL columns)")
    assert lines[at + 3 : at + 8] == ["| supported | 1 | 1 | 0 | 0 | 0 |", "| partially_supported | 0 | 0 | 0 | 0 | 0 |", "| unsupported | 0 | 0 | 0 | 0 | 0 |", "| contradicted | 0 | 0 | 1 | 0 | 0 |", "| not_checkable | 0 | 0 | 0 | 0 | 1 |"]
    assert "| overstated | 1 | 4 |" in lines and "| bare | 1/1 | 1/1 |" in lines and "| m2 | 0/1 | 0/1 |" in lines and "| B5 | 2/4 (50.0%) |" in lines
    assert [x for x in lines if x.startswith("## ")] == sorted((x for x in lines if x.startswith("## ")), key=lambda x: (x == "## Trace metadata", x)) and lines[-1] == "- Overall adverse (CAL): 1/3; (gold): 1/3"
    assert {f: json.loads(x) for f, x in held(tmp_path / "again").items()} == {f: json.loads(x) for f, x in held(tmp_path / "traces").items()}
    assert main(run, spark) == 0
    (tmp_path / "traces" / "c9.json").write_text(json.dumps(trace("c9", "supported")))
    assert main(run, spark) == 1 and "trace_without_gold: c9" in capsys.readouterr().err


@pytest.mark.parametrize(("change", "fault"), [
    ({"extra": 1}, "unknown field extra"), ({"claims": None}, "lacks claims"), ({"claims": [GOLD["claims"][0]] * 2}, "duplicate claim_id: c0"), ({"claims": [GOLD["claims"][0] | {"gold_verdict": "maybe"}]}, "c0: unknown gold_verdict"),
    ({"claims": [GOLD["claims"][0] | {"gold_flags": ["odd"]}]}, "c0: unknown gold_flags"), ({"claims": [GOLD["claims"][0] | {"note": "x"}]}, "c0: unknown field note"), ({"claims": [{"claim_id": "c0"}]}, "c0: lacks condition"),
])
def test_refused_gold(spark, tmp_path, change, fault):
    (tmp_path / "gold.yaml").write_text(yaml.safe_dump(GOLD | change))
    with pytest.raises(SourceError, match=fault):
        gold.read_gold(spark, str(tmp_path / "gold.yaml"))


def test_gold_labels(spark, tmp_path):
    (tmp_path / "gold.yaml").write_text(yaml.safe_dump(GOLD))
    found = gold.read_gold(spark, str(tmp_path / "gold.yaml"))
    assert [(r.claim_id, r.gold, r.gold_flags) for r in found.claims.orderBy("claim_id").collect()] == [("c0", "supported", ["overstated"]), ("c1", "supported", ["inferred"]), ("c2", "contradicted", []), ("c3", "not_checkable", [])]
    assert [r.claim_id for r in found.starved.collect()] == ["c1"] and found.version == "g1"
    (tmp_path / "gold.yaml").write_text("a: [1")
    with pytest.raises(SourceError, match="not YAML"):
        gold.read_gold(spark, str(tmp_path / "gold.yaml"))
    assert traces.verdict_rows(spark.createDataFrame([], traces.TRACE)).filter(F.lit(True)).count() == 0


def test_deviations_take_the_first_fault(spark):
    faults = [("a", "x", "tree hash differs"), ("a", "z", "lacks task_id"), ("a", "y", "lacks task_id"), ("b", "l", "digest differs"), ("b", "c", "duplicate claim id"), ("c", "c", "scoring.x: expected 1, got 2"), (None, "q", "no list")]
    found = deviations.deviation_records(spark.createDataFrame(faults, "bundle_id string, file string, fault string"), "t").collect()
    assert {(r.artifact_id, r.deviation_type, r.description) for r in found} == {
        ("a", "schema_validation_failure", "y: lacks task_id"), ("b", "intake_hash_mismatch", "l: digest differs"), ("c", "vocabulary_drift", "c: scoring.x: expected 1, got 2"), (None, "intake_hash_mismatch", "q: no list"),
    }


def test_settings(tmp_path):
    found = settings.load_settings()
    assert (found.top_k, found.retrieval_floor, found.supported_threshold) == (5, 0.4, 0.7) and settings.settings_hash(found).startswith("sha256:")
    own = {"top_k": 7, "retriever": settings.DEFAULTS["retriever"], "entailer": {"hf_revision_sha": "s", "model_id": "m"}, "supported_threshold": 0.1}
    path = tmp_path / "run.yaml"
    path.write_text(yaml.safe_dump(own))
    other = settings.load_settings(path)
    assert other.top_k == 7 and other.supported_threshold == 0.7 and settings.settings_hash(other) != settings.settings_hash(found)
    path.write_text(yaml.safe_dump(dict(reversed(own.items())), sort_keys=False))
    assert settings.settings_hash(settings.load_settings(path)) == settings.settings_hash(other)
    for wrong in ("- 1", "a: [1", "top_k: 0", yaml.safe_dump(own | {"more": 1}), yaml.safe_dump(own | {"retriever": {"model_id": "m"}}), yaml.safe_dump(own | {"aggregation": "mean"})):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            settings.load_settings(path)
    for changed in (dataclasses.replace(found, rules_file_sha="0"), dataclasses.replace(found, numeric_tolerance=0.1)):
        with pytest.raises(settings.RulesConsistencyError):
            settings.verify_rules(changed)
    rules = tmp_path / "rules.yaml"
    rules.write_text(yaml.safe_dump(settings.load_rules()[0] | {"supported_threshold": 1.5}))
    with pytest.raises(ValueError, match="supported_threshold"):
        settings.load_settings(rules_path=rules)
