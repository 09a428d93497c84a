"""Trace files, and calibration from them on the published set of twelve."""

import json

import pytest

from provenlake.operators import calibrate
from provenlake.sources import traces

#: Claim, condition, model, human label, its flag, predicted label.
TWELVE = """
syn-01 A x supported            overconfident      supported
syn-02 A y contradicted         -                  contradicted
syn-03 A x unsupported          -                  contradicted
syn-04 B y supported            -                  supported
syn-05 B x not_checkable        -                  not_checkable
syn-06 B y not_checkable        missing_needed     not_checkable
syn-07 C x reasonable_inference -                  supported
syn-08 C y contradicted         source_scope_error contradicted
syn-09 C x contradicted         -                  contradicted
syn-10 D y partially_supported  false_caution      not_checkable
syn-11 D x supported            -                  supported
syn-12 D y contradicted         -                  contradicted
"""


def trace(claim_id, verdict="supported", **other):
    whole = dict.fromkeys(traces.FIELDS) | {"claim_id": claim_id, "claim_text": f"text of {claim_id}", "library_version": "1", "rules_fired": [{"rule_id": "B5_degree", "reason": "r"}, {"rule_id": "B5_degree", "reason": "s"}]}
    return whole | {"verdict": {"support_verdict": verdict, "audit_flags": ["overstated"]}} | other


def test_calibration(spark, tmp_path):
    rows = [line.split() for line in TWELVE.strip().splitlines()]
    for claim, *_, cal in rows:
        (tmp_path / f"{claim}.json").write_text(json.dumps(trace(claim, cal)))
    found = traces.verdict_rows(traces.read_traces(spark, str(tmp_path)))
    assert calibrate.single_version(found) == "1"
    gold = spark.createDataFrame([(c, cond, m, g, [] if f == "-" else [f]) for c, cond, m, g, f, _ in rows], "claim_id string, condition string, model string, raw string, flags array<string>")
    verdict, flags, _ = calibrate.crosswalk_gold(gold["raw"], gold["flags"])
    pairs = gold.select("claim_id", "condition", "model", verdict.alias("gold"), flags.alias("gold_flags")).join(found, "claim_id")
    starved = spark.createDataFrame([("syn-01",), ("syn-04",), ("syn-09",)], "claim_id string")
    assert calibrate.check_alignment(gold, found, starved).count() == 0
    tables = calibrate.calibration(pairs, starved, found)
    assert tuple(tables["agreement"].first()) == (10, 12)
    assert tables["kappa"].first().kappa == pytest.approx(13 / 17)
    overall = tables["adverse"].filter("kind = 'overall'").first()
    assert (overall.cal_adverse, overall.cal_checkable, overall.gold_adverse, overall.gold_checkable) == (5, 9, 5, 10)
    floor = tables["recall_floor"].first()
    assert (floor.starved_total, floor.supported, floor.adverse) == (3, 2, 1)
    counts = {r.flag: (r.gold_count, r.cal_count) for r in tables["flags"].collect()}
    assert counts["overstated"] == (1, 12) and counts["inferred"] == (1, 0) and counts["false_caution"] == (1, 0)
    assert [tuple(r) for r in tables["rules"].collect()] == [("B5_degree", 12)]
    with pytest.raises(ValueError, match="inconsistent"):
        calibrate.single_version(found.unionByName(found.selectExpr("claim_id", "cal", "cal_flags", "rules", "'2' AS library_version")))


def test_faults(spark, tmp_path):
    put = {
        "a.json": trace("a"), "b.audit-trace.json": trace("b"), "c.json": trace("other"), "d.json": trace("d", more=1), "e.json": {k: v for k, v in trace("e").items() if k != "features"},
        "f.json": [1], "g.json": trace("g", verdict=None), "two/h.json": trace("h"), "h.json": trace("h"),
    }
    (tmp_path / "two").mkdir()
    for name, content in put.items():
        (tmp_path / name).write_text(json.dumps(content))
    (tmp_path / "i.json").write_text("{")
    found = traces.scan_traces(spark, [str(tmp_path), str(tmp_path / "two")])
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in found.collect()}
    assert errors == {
        "a.json": None, "b.audit-trace.json": None, "c.json": "file name and claim_id differ", "d.json": "unknown field more", "e.json": "lacks features", "f.json": "not a mapping", "g.json": "no verdict",
        "h.json": "Duplicate claim_id", "i.json": "Could not parse the file.",
    }
    claims = spark.createDataFrame([("a", "text of a"), ("b", "another"), ("z", "z")], "claim_id string, claim_text string")
    assert {tuple(r) for r in traces.unbound(found.filter("error is null"), claims).collect()} == {("b", "texts differ"), ("z", "claim without trace")}
    with pytest.raises(Exception, match="no verdict"):
        traces.read_traces(spark, str(tmp_path / "g.json")).collect()
