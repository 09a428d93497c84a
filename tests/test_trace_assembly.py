"""Traces made, written and read again, and judged anew where results join."""

import random

import pytest
from pyspark.sql import functions as F

from provenlake.operators import trace, verdict
from provenlake.sources import named_files, settings, traces, writeback


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(9)
    words = "the tool exports all invoices within 30 days and 12% of orders must never fail some files may".split()
    text = lambda n: " ".join(rng.choices(words, k=n)) + "."
    vector = lambda: [rng.uniform(-1, 1) + 0.8 for _ in range(6)]
    claims = spark.createDataFrame([("b", f"c{k}", text(rng.randint(3, 12)), vector()) for k in range(30)] + [("none", "alone", "A claim without any passage here.", vector())], "bundle_id string, claim_id string, claim_text string, embedding array<double>")
    passages = spark.createDataFrame([("b", f"p{k}", k, text(10), rng.choice(["primary", "secondary", "background"]), vector()) for k in range(9)], "bundle_id string, passage_id string, ordinal int, passage_text string, trust_level string, embedding array<double>")
    logits = [(f"c{k}", f"p{j}", [rng.gauss(0, 2) for _ in range(3)]) for k in range(30) for j in range(9)]
    logits = spark.createDataFrame(logits, "claim_id string, passage_id string, raw_logits array<double>")
    retrieval = verdict.retrieve(claims, passages).select("claim_id", "passage_id", "score", F.col("rank")).cache()
    return claims, passages, logits, retrieval


def test_traces_round_trip(spark, tmp_path, inputs):
    claims, passages, logits, retrieval = inputs
    entailment = trace.entailed(verdict.admitted(retrieval), logits).cache()
    made = trace.assembled(claims, retrieval, entailment, passages, settings.settings_hash(settings.load_settings()), "1.0")
    named_files.write_named(writeback.trace_files(made, F.concat("claim_id", F.lit(".json"))), str(tmp_path / "out"))
    back = {r.claim_id: r for r in traces.read_traces(spark, str(tmp_path / "out")).collect()}
    rows = {r.claim_id: r for r in made.collect()}
    assert len(rows) == 31 and {k: r.asDict(True) for k, r in rows.items()} == {k: r.asDict(True) for k, r in back.items()}
    known = {(r.claim_id, r.passage_id): r for r in entailment.collect()}
    alone = rows.pop("alone")
    assert (alone.retrieval, alone.entailment, alone.verdict.support_verdict, alone.support_signal.label) == ([], [], "not_checkable", "neutral")
    assert len({r.verdict.support_verdict for r in rows.values()}) > 1
    for k, r in rows.items():
        assert len(r.retrieval) == 5 and [x.score for x in r.retrieval] == sorted((x.score for x in r.retrieval), reverse=True)
        assert [x.passage_id for x in r.entailment] == [x.passage_id for x in r.retrieval if x.score >= 0.4]
        for x in r.entailment:
            assert x.label == ["entail", "neutral", "contradict"][x.raw_logits.index(max(x.raw_logits))] and 1 / 3 <= x.score <= 1 and known[k, x.passage_id].score == x.score
        assert r.support_signal.contributing_passage_id is None or r.support_signal.max_entailment_score == known[k, r.support_signal.contributing_passage_id].score
    with pytest.raises(Exception, match="no entailment of"):
        trace.entailed(verdict.admitted(retrieval), logits.filter("passage_id <> 'p1'")).collect()


def test_variant_equals_a_full_run(spark, inputs):
    """Only claims with further results are judged again, and as a run over all results judges them."""
    claims, passages, logits, retrieval = inputs
    entailment = trace.entailed(verdict.admitted(retrieval), logits)
    less = entailment.filter("ordinal < 3")
    more = entailment.filter("ordinal >= 3 and claim_id < 'c2'").withColumn("passage_id", F.concat(F.lit("z"), "ordinal", "passage_id"))
    named = passages.unionByName(passages.join(more.select("passage_id").distinct().withColumn("new", F.col("passage_id")).withColumn("passage_id", F.substring("new", 3, 9)), "passage_id").drop("passage_id").withColumnRenamed("new", "passage_id"))
    before = trace.assembled(claims, retrieval, less, named, "h", "1").cache()
    after = {r.claim_id: r for r in trace.variant(before, claims, more.drop("ordinal"), named, "h", "1").collect()}
    whole = {r.claim_id: r for r in trace.assembled(claims, retrieval, less.unionByName(more), named, "h", "1").collect()}
    assert after == whole and any(after[r.claim_id] != r for r in before.collect())
