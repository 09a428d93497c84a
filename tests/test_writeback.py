"""Named files and audited copies of sealed bundles."""

import hashlib
import json
from pathlib import Path

import pytest
import yaml
from pyspark.sql import functions as F

from provenlake import audit
from provenlake.sources import named_files, records, traces, writeback
from provenlake.sources.bundles import DUMP, bundle_files, tree_hashes

from .test_whole_audits import CLAIM, bundle

FILES = "file string, piece long, content binary"


def held(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_named_files(spark, tmp_path):
    out = tmp_path / "out"
    rows = [(f"a/{k}.txt", 0, f"text {k}".encode()) for k in range(40)] + [("long", k, b"%d," % k) for k in range(500)] + [("empty", 0, None)]
    want = {f: b"".join((c or b"") for g, _, c in rows if f == g) for f, _, _ in rows}
    files = spark.createDataFrame(rows, FILES).repartition(7)
    named_files.write_named(files, str(out))
    assert held(out) == want and sorted(x.name for x in tmp_path.iterdir()) == ["out"]
    # the same again changes nothing; further files join
    named_files.write_named(files.unionByName(spark.createDataFrame([("b/new", 0, b"n")], FILES)), str(out))
    assert held(out) == want | {"b/new": b"n"}
    # one file of other bytes refuses all
    other = spark.createDataFrame([("a/3.txt", 0, b"text 4"), ("c/more", 0, b"m")], FILES)
    with pytest.raises(Exception, match="refusing to overwrite"):
        named_files.write_named(other, str(out))
    assert held(out) == want | {"b/new": b"n"} and sorted(x.name for x in tmp_path.iterdir()) == ["out"]
    # made afresh, only the new files are there
    named_files.write_named(other.drop("piece"), str(out), fresh=True)
    assert held(out) == {"a/3.txt": b"text 4", "c/more": b"m"} and sorted(x.name for x in tmp_path.iterdir()) == ["out"]
    named_files.write_named(other.limit(0), str(out), fresh=True)
    assert held(out) == {} and out.is_dir()


@pytest.mark.parametrize("rows", [[("x", 0, b"1"), ("x", 0, b"1")], [("../x", 0, b"1")], [("/x", 0, b"1")], [("a//b", 0, b"1")], [(None, 0, b"1")]])
def test_refused_names_leave_nothing(spark, tmp_path, rows):
    with pytest.raises(Exception, match="twice|not a path|without a name"):
        named_files.write_named(spark.createDataFrame([("good", 0, b"g"), *rows], FILES), str(tmp_path / "out"))
    assert not list(tmp_path.iterdir())


def test_failed_jobs_leave_the_folder_alone(spark, tmp_path):
    named_files.write_named(spark.createDataFrame([("x", 0, b"1")], FILES), str(tmp_path / "out"), fresh=True)
    broken = spark.range(50).select(F.concat(F.lit("f"), "id").alias("file"), F.when(F.col("id") == 49, F.raise_error(F.lit("broken"))).otherwise("c").cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken"):
        named_files.write_named(broken, str(tmp_path / "out"), fresh=True)
    assert held(tmp_path / "out") == {"x": b"1"} and len(list(tmp_path.iterdir())) == 1


def test_audited_bundles(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    claims = (CLAIM | {"claim_id": "0", "audit": {"kept": "ü", "audit_notes": "old"}}, CLAIM | {"claim_id": "1", "claim_type": "retrieval_seed"}, CLAIM | {"claim_id": "2", "evidence_passages": []})
    for name in ("one", "two"):
        bundle(root / name, claims=claims)
    bundle(root / "bad", counts={"claims_included": 7})
    (root / "one" / "deviations").mkdir()
    (root / "one" / "deviations" / "x.yaml").write_text("a: 1\n")
    before = held(root)
    done = audit.audit_bundles(spark, str(root))
    results = writeback.lexical_results(done.assessments)
    writeback.write_audited(spark, str(root), str(out), results, "run-1", "2026-05-11T00:00:00Z")
    assert held(root) == before
    assert {p.name for p in out.iterdir()} == {"one", "two"}
    new = held(out)
    assert set(new) == {f for f in before if not f.startswith("bad/")}
    changed = {f for f in new if new[f] != before[f]}
    assert changed == {f"{b}/{f}" for b in ("one", "two") for f in ("claims/0.yaml", "claims/2.yaml", "bundle_manifest.yaml", "SHA256SUMS")}
    block = yaml.safe_load(new["one/claims/0.yaml"])["audit"]
    assert block == {
        "kept": "ü", "audit_run_id": "run-1", "audited_at_utc": "2026-05-11T00:00:00Z", "audit_support_verdict": "supported", "audit_confidence": 1.0, "audit_notes": "The supplied evidence directly supports the claim.",
        "false_caution_flag": True, "deviation_flag": True, "deviation_notes": block["deviation_notes"],
    }
    assert "false_caution_flag=true" in block["deviation_notes"]
    lines = new["one/SHA256SUMS"].decode().splitlines()
    listed = [line.split("  ", 1)[1] for line in lines]
    assert listed == sorted(listed, key=lambda f: f.split("/")) and "deviations/x.yaml" not in listed
    assert all(line == f"{hashlib.sha256(new['one/' + f]).hexdigest()}  {f}" for line, f in zip(lines, listed))
    # the copies are sealed bundles, audited alike, and a second run writes the same bytes
    assert records.record_faults(bundle_files(spark, str(out))).count() == 0
    again = audit.audit_bundles(spark, str(out))
    assert sorted(map(tuple, writeback.lexical_results(again.assessments).collect())) == sorted(map(tuple, results.collect()))
    writeback.write_audited(spark, str(root), str(out), results, "run-1", "2026-05-11T00:00:00Z")
    assert held(out) == new

    for place in (root, root / "copy", f"{root}/../in/x"):
        with pytest.raises(ValueError, match="inside"):
            writeback.write_audited(spark, str(root), str(place), results, "r", "t")
    with pytest.raises(ValueError, match="audited_at_utc"):
        writeback.write_audited(spark, str(root), str(out), results, "r", "  ")
    with pytest.raises(FileNotFoundError, match="claims/9.yaml"):
        writeback.write_audited(spark, str(root), str(out), results.withColumn("claim_id", F.lit("9")), "r", "t")
    assert held(out) == new and held(root) == before


TRACE = {
    "claim_id": "0", "claim_text": CLAIM["claim_text"], "retrieval": [{"passage_id": "p1", "score": 0.91}], "entailment": [{"passage_id": "p1", "label": "entail", "score": 0.95, "raw_logits": [0.5, 1.25, -2.0]}],
    "features": {"numerical_values": [{"value": 30.0, "unit": "day", "surface_text": "30 days"}], "has_explicit_negation": False, "has_universal_quantifier": False, "modal_strength": "weak", "claim_token_count": 8, "compound_claim": False, "sentence_type": "declarative"},
    "support_signal": {"label": "entail", "max_entailment_score": 0.95, "contributing_passage_id": "p1"}, "rules_fired": [{"rule_id": "B5_supported", "reason": "größer"}],
    "verdict": {"support_verdict": "supported", "support_verdict_reason": None, "audit_flags": ["overstated"], "citation_status": "not_applicable", "audit_confidence": "high"}, "audit_config_hash": "sha256:0", "library_version": "1",
}


def test_traces_go_with_their_claims(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    bundle(root / "one", claims=(CLAIM | {"claim_id": "0"}, CLAIM | {"claim_id": "1"}))
    (tmp_path / "traces").mkdir()
    (tmp_path / "traces" / "0.json").write_text(json.dumps(TRACE))
    read = traces.read_traces(spark, str(tmp_path / "traces"))
    # dumped under exact names, byte for byte in the published form; a changed one is refused
    dumped = writeback.trace_files(read, F.concat("claim_id", F.lit(".json")))
    named_files.write_named(dumped, str(tmp_path / "dump"))
    assert held(tmp_path / "dump") == {"0.json": (json.dumps(TRACE, indent=2, ensure_ascii=False) + "\n").encode()}
    named_files.write_named(dumped, str(tmp_path / "dump"))
    assert traces.read_traces(spark, str(tmp_path / "dump")).collect() == read.collect()

    own = read.withColumn("bundle_id", F.lit("one"))
    claims = records.claims(records.records(bundle_files(spark, str(root))))
    new = writeback.trace_files(own, F.concat(F.lit("claims/"), "claim_id", F.lit(".audit-trace.json")))
    writeback.write_audited(spark, str(root), str(out), writeback.trace_results(own, claims), "run", "now", new)
    files = held(out)
    assert json.loads(files["one/claims/0.audit-trace.json"]) == TRACE
    block = yaml.safe_load(files["one/claims/0.yaml"])["audit"]
    assert (block["audit_support_verdict"], block["audit_confidence"], block["false_caution_flag"], block["deviation_flag"]) == ("overstated", 0.95, False, False)
    assert "audit" not in yaml.safe_load(files["one/claims/1.yaml"]) and "flags=overstated" in block["audit_notes"]
    assert records.record_faults(bundle_files(spark, str(out))).count() == 0


def test_tree_hash_of_many_files(spark):
    """The digest streams over the files in the order of their paths' parts, whatever their order here."""
    names = [f"d{k % 7}/{'x' * (k % 3)}-{k}" for k in range(3000)] + ["d1-a/z", "d1/z", "d1.b"]
    files = spark.createDataFrame([("b", f, hashlib.sha256(f.encode()).hexdigest(), f.encode()) for f in names], "bundle_id string, file string, digest string, content binary").repartition(5)
    want = hashlib.sha256("".join(f"{f}\0{hashlib.sha256(f.encode()).hexdigest()}\n" for f in sorted(names, key=lambda f: f.split("/"))).encode()).hexdigest()
    assert [tuple(r) for r in tree_hashes(files).collect()] == [("b", f"sha256:{want}")]
    assert DUMP["sort_keys"] is False
