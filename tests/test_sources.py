"""Readers of drafts, evidence and sealed bundles, and the report files, on files made here."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from provenlake.plans import lexical
from provenlake.sources import bundles, drafts, evidence, files, reports


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_drafts(spark, tmp_path):
    put(tmp_path / "one.note.md", "\n intro\r\n # A title \n# Other\n")
    put(tmp_path / "two.txt", "# no heading here")
    put(tmp_path / "three.MD", "#\n## sub\ntext")
    put(tmp_path / "bad.txt", b"\xff\xfe")
    put(tmp_path / "blank.md", " \n\t")
    put(tmp_path / "other.pdf", "x")
    found = {r.document_id: r for r in drafts.scan_drafts(spark, str(tmp_path)).collect()}
    assert found["one.note"].title == "A title" and found["one.note"].content.startswith("intro")
    assert (found["two"].title, found["three"].title) == (None, None)
    assert {k for k, r in found.items() if r.error} == {"bad", "blank", "other"}
    assert all((r.content is None) == bool(r.error) for r in found.values())
    with pytest.raises(Exception, match="is blank"):
        drafts.read_drafts(spark, str(tmp_path / "blank.md")).collect()
    with pytest.raises(files.SourceError):
        drafts.read_drafts(spark, str(tmp_path / "absent.md"))


SOURCE = {"id": "s1", "title": "T", "reliability": "high", "date": "2024-05-01", "excerpts": [{"id": "e1", "text": " some text "}, {"id": "e2", "text": "more", "notes": "n"}]}


def test_evidence(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps({"sources": [SOURCE, {"id": "s2", "title": "U"}]}))
    put(tmp_path / "b.yaml", "sources:\n- id: s1\n  title: T\n  date: 2024-05-01\n  excerpts:\n  - id: e1\n    text: 'é ü'\n")
    put(tmp_path / "empty.json", "{}")
    rows = evidence.read_evidence(spark, [str(tmp_path / n) for n in ("a.json", "b.yaml", "empty.json")]).collect()
    assert sorted((r.bundle_id, r.excerpt_id, r.excerpt_text, str(r.source_date), r.reliability) for r in rows) == [
        ("a", "e1", "some text", "2024-05-01", "high"), ("a", "e2", "more", "2024-05-01", "high"), ("b", "e1", "é ü", "2024-05-01", "unknown"),
    ]


@pytest.mark.parametrize(
    ("name", "content", "why"),
    [
        ("x.json", "{not json", "parse"),
        ("x.yml", "a: [1", "parse"),
        ("x.json", "[1]", "mapping"),
        ("x.json", json.dumps({"sources": [], "more": 1}), "beside"),
        ("x.json", json.dumps({"sources": {"id": 1}}), "list"),
        ("x.json", json.dumps({"sources": [SOURCE | {"colour": "red"}]}), "unknown field colour"),
        ("x.json", json.dumps({"sources": [SOURCE | {"title": " "}]}), "title"),
        ("x.json", json.dumps({"sources": [SOURCE | {"reliability": "good"}]}), "reliability"),
        ("x.json", json.dumps({"sources": [SOURCE | {"date": "soon"}]}), "date"),
        ("x.json", json.dumps({"sources": [SOURCE, SOURCE]}), "Duplicate"),
        ("x.json", json.dumps({"sources": [SOURCE, {"id": "s3", "title": "T", "excerpts": [{"id": "e1", "text": "t"}]}]}), "Duplicate excerpt"),
        ("x.csv", "a,b", "Unsupported"),
    ],
)
def test_evidence_faults(spark, tmp_path, name, content, why):
    put(tmp_path / name, content)
    errors = [r.error for r in evidence.scan_evidence(spark, str(tmp_path / name)).collect()]
    assert errors and all(e and why in e for e in errors)


def test_seals(spark, tmp_path):
    def seal(name, contents, sums=None):
        for file, content in contents.items():
            put(tmp_path / name / file, content)
        lines = [f"{hashlib.sha256(c.encode()).hexdigest()}  {f}" for f, c in contents.items()]
        put(tmp_path / name / "SHA256SUMS", "\n".join(lines if sums is None else sums) + "\n")

    contents = {"a/z.txt": "1", "a.txt": "2", "a-b/c.txt": "3"}
    seal("good", contents)
    put(tmp_path / "good" / "deviations" / "d.yaml", "x: 1")
    seal("bad", {"a.txt": "1", "b.txt": "2"}, [f"{'0' * 64}  a.txt", f"{'0' * 64}  gone.txt", f"{'0' * 64}  ../out", "nonsense"])
    put(tmp_path / "bare" / "a.txt", "1")
    found = bundles.bundle_files(spark, str(tmp_path))
    faults = {(r.bundle_id, r.file): r.fault for r in bundles.seal_faults(found).collect()}
    assert faults == {
        ("bad", "a.txt"): "digest differs", ("bad", "b.txt"): "not listed", ("bad", "gone.txt"): "missing file", ("bad", "../out"): "path escapes", ("bad", "nonsense"): "malformed line", ("bare", "SHA256SUMS"): "no list",
    }
    # by parts of the path: a/z before a-b/c, though '-' comes before '/'
    text = "".join(f"{f}\0{hashlib.sha256(contents[f].encode()).hexdigest()}\n" for f in ("a/z.txt", "a-b/c.txt", "a.txt"))
    hashes = {r.bundle_id: r.tree_hash for r in bundles.tree_hashes(found).collect()}
    assert hashes["good"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_own_hash_does_not_count(spark, tmp_path):
    for name, own in (("one", "sha256:1"), ("two", "sha256:2")):
        put(tmp_path / name / "bundle_manifest.yaml", f"bundle:\n  bundle_hash: {own}\n  id: b\n")
    put(tmp_path / "three" / "bundle_manifest.yaml", "id: b\n")
    hashes = {r.bundle_id: r.tree_hash for r in bundles.tree_hashes(bundles.bundle_files(spark, str(tmp_path))).collect()}
    assert hashes["one"] == hashes["two"] is not None and hashes["three"] is None


def test_report_files(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    assessed = lexical._assessed(spark, data).filter("bundle_id < 5")
    contexts = lexical.contexts(spark, data).filter("bundle_id < 5")
    reports.write_markdown(assessed, contexts, str(tmp_path / "md"))
    reports.write_json(assessed, contexts, str(tmp_path / "json"))
    n = assessed.groupBy("bundle_id").count().collect()
    assert n
    for bundle, claims in n:
        text = (tmp_path / "md" / f"{bundle}.md").read_text()
        assert f"- Total claims: {claims}\n" in text and text.count("\n### `claim-") >= claims
        assert len(json.loads((tmp_path / "json" / f"{bundle}.json").read_text())["claims"]) == claims
    reports.write_markdown(assessed, contexts, str(tmp_path / "md"))
    with pytest.raises(Exception, match="refusing to overwrite"):
        reports.write_markdown(assessed.withColumn("risk_label", F.lit("low")), contexts, str(tmp_path / "md"))
