"""Pair joins, first-wins dedupe and score bounds against all pairs."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provenlake import tables
from provenlake.operators import extract, match, pairs, rules
from provenlake.plans import lexical
from provenlake.tables import once_a_text, with_texts

SENTENCES = "doc_id long, paragraph int, sentence int, text string, claim_type string"


def sentence(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def near(a, b):
    both, least = len(a & b), min(len(a), len(b))
    return least > 0 and (both >= 0.8 * len(a | b) or (both >= 0.9 * least and abs(len(a) - len(b)) <= 2))


def test_grid_join(spark, monkeypatch):
    """Frequent keys meet on a grid, the others as they are; every pair comes once."""
    rng = random.Random(1)
    left = [(rng.choice("aaaabc"), k) for k in range(90)] + [("only left", 1000)]
    right = [(rng.choice("aabbbd"), k) for k in range(70)] + [("only right", 1000)]
    a, b = spark.createDataFrame(left, "key string, x int"), spark.createDataFrame(right, "key string, y int")
    found = pairs.grid_join(a, b, ["key"], F.col("x") != F.col("y"), key_rows=7)
    assert found.columns == ["key", "x", "y"]
    assert Counter(tuple(r) for r in found.collect()) == Counter((k, x, y) for k, x in left for o, y in right if k == o and x != y)
    assert pairs.grid_join(a.limit(0), b, ["key"]).count() == 0


@pytest.mark.parametrize("key_rows", [3, 2048])
def test_near_duplicate_pairs(spark, monkeypatch, key_rows):
    monkeypatch.setattr(pairs.grid_join, "__defaults__", (None, key_rows))
    rng = random.Random(2)
    words = [f"t{k}" for k in range(14)]
    sets = [(rng.choice([1, 1, 2, None]), k, sorted(set(rng.choices(words[: rng.choice([4, 9, 14])], k=rng.randint(0, 13))))) for k in range(160)]
    found = pairs.near_duplicate_pairs(spark.createDataFrame(sets, "bundle_id long, row long, terms array<string>"), "bundle_id").collect()
    want = {(g, a, b) for g, a, s in sets for h, b, t in sets if g is not None and g == h and a < b and near(set(s), set(t))}
    assert len(found) == len(want) > 100 and {tuple(r) for r in found} == want


def folded(rows, terms):
    """The rows that stay, document by document, each against those that stayed."""
    out, by_doc = [], {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
    for doc in by_doc.values():
        stayed = []
        for r in sorted(doc, key=lambda r: r[1:]):
            norm, own = terms[r[3]]
            if not any(norm == n or near(own, t) for n, t in stayed):
                stayed.append((norm, own))
                out.append(r)
    return Counter((r[0], r[3], r[4], f"paragraph:{r[1]}:sentence:{r[2]}") for r in out)


def test_first_claims_stay(spark):
    """Nearness is not passed on: a claim that went keeps no later one away."""
    rng = random.Random(3)
    words = [f"word{chr(97 + k)}" for k in range(12)] + ["the", "of", "Ties"]
    texts = [sentence(rng, words, rng.randint(1, 9)) for _ in range(60)] + ["the of", "The of.", ""]
    chain = [" ".join(f"link{k + x}x" for x in range(10)) for k in range(14)]  # each near the next two at most
    rows = [(rng.choice([1, 2, 3, None]), p, rng.randint(1, 3), rng.choice(texts), "scope") for p in range(150)]
    rows += [(9, p, 1, text, "causal") for p, text in enumerate(chain)] + [rows[0], rows[7], (2, 1, 1, "another text here", "scope")]
    df = spark.createDataFrame(rows, SENTENCES).repartition(5)
    made = df.select("text", extract.T.normalized(F.col("text")).alias("n"), extract.T.term_set(F.col("text")).alias("t")).distinct().collect()
    want = folded(rows, {r.text: (r.n, set(r.t)) for r in made})
    found = extract.dedupe_claims(df.withColumns({"row": F.lit(1), "terms": F.lit(2)})).collect()
    assert Counter((r.doc_id, r.text, r.claim_type, r.location) for r in found) == want
    assert 1 < sum(r.doc_id == 9 for r in found) < len(chain)
    assert extract.dedupe_claims(df.limit(0)).count() == 0


WORDS = "the service ships orders always never all every across any will should tested known limitation miss incomplete faster slower than more public audit 2019 2020-01-15 2019.5 2019.7 7 8 8% and of report report".split()


def claims_and_excerpts(spark, seed, n):
    rng = random.Random(seed)
    words = WORDS + [f"plain{k}" for k in range(12)]
    side = lambda: sentence(rng, words, rng.choice([0, 2, 5, 8, 12, 20]))
    claims = [(rng.choice([1, 1, 1, 2, None]), f"c{k}", side()) for k in range(n)]
    excerpts = [(rng.choice([1, 1, 2, 3, None]), f"s{k % 3}", f"e{k}", side()) for k in range(n)]
    claims += [claims[0], (1, None, claims[1][2])]
    excerpts += [excerpts[0], (1, None, None, claims[2][2])] + [(1, "s", f"same{k}", c[2]) for k, c in enumerate(claims[:20])]
    return spark.createDataFrame(claims, "bundle_id int, claim_id string, claim_text string"), spark.createDataFrame(excerpts, "bundle_id int, source_id string, excerpt_id string, excerpt_text string")


@pytest.mark.parametrize("threshold", [0.4, 0.05, 0.2, 0.6, 0.0])
def test_no_candidate_is_lost(spark, threshold):
    """Bounded pairs give the rows that scoring every pair gives, repeated and nameless ones too."""
    claims, excerpts = claims_and_excerpts(spark, 4, 120)
    cols = ["bundle_id", "claim_id", "source_id", "excerpt_id", "score"]
    every = match.score_bundle_pairs(claims, excerpts).select(*cols).collect()
    want = Counter(tuple(r) for r in every if r.score >= threshold)
    found = match.score_candidates(claims, excerpts, threshold)
    assert Counter(tuple(r) for r in found.select(*cols).collect()) == want
    assert 0 < want.total() and (threshold == 0 or want.total() < len(every))


def test_blocked_pairs_of_any_bundle(spark):
    claims, excerpts = claims_and_excerpts(spark, 5, 60)
    every = match.score_bundle_pairs(claims.withColumns({"own": F.col("bundle_id"), "bundle_id": F.lit(1)}), excerpts.withColumn("bundle_id", F.lit(1)))
    want = Counter(tuple(r) for r in every.select("own", "claim_id", "excerpt_id", "score").collect() if r.score >= 0.3)
    found = match.score_blocked_pairs(claims, excerpts, 0.3).select("bundle_id", "claim_id", "excerpt_id", "score")
    assert Counter(tuple(r) for r in found.collect()) == want and want
    with pytest.raises(ValueError):
        match.score_blocked_pairs(claims, excerpts, 0)


def test_candidates_are_few(spark):
    """Of a bundle's pairs only a small part is scored at all."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    claims = spark.createDataFrame([(1, f"c{k}", sentence(rng, words, 12)) for k in range(200)], "bundle_id int, claim_id string, claim_text string")
    excerpts = spark.createDataFrame([(1, "s", f"e{k}", sentence(rng, words, 12)) for k in range(200)], "bundle_id int, source_id string, excerpt_id string, excerpt_text string")
    c = match.featured(claims, "claim_text", "c").withColumn("c_row", F.col("claim_id"))
    e = match.featured(excerpts, "excerpt_text", "e").withColumn("e_row", F.col("excerpt_id"))
    every = match.score_bundle_pairs(claims, excerpts).filter("score >= 0.4").count()
    assert every <= match.candidate_pairs(c, e, 0.4).count() < 40_000 * 0.65


@pytest.mark.parametrize("rows", [0, 40])
def test_large_bundles_lose_no_candidate(spark, monkeypatch, rows):
    """Bundles on either side of the bound give what scoring every pair gives."""
    monkeypatch.setattr(match, "BUNDLE_ROWS", rows)
    claims, excerpts = claims_and_excerpts(spark, 7, 90)
    cols = ["bundle_id", "claim_id", "source_id", "excerpt_id", "score"]
    want = Counter(tuple(r) for r in match.score_bundle_pairs(claims, excerpts).filter("score >= 0.4").select(*cols).collect())
    found = match.score_candidates(claims, excerpts)
    assert Counter(tuple(r) for r in found.select(*cols).collect()) == want and want
    assert not set(match.MARKED) & set(found.columns)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


@pytest.mark.parametrize("rows", [40, 1000])
def test_equal_texts_are_scored_once(spark, monkeypatch, rows):
    """Few texts of many rows: each two of them are scored once and looked up, null and large bundles too."""
    monkeypatch.setattr(match, "BUNDLE_ROWS", rows)
    rng = random.Random(10)
    texts = [sentence(rng, WORDS, n) for n in (3, 8, 8, 12, 20)] + ["", None]
    claims = spark.createDataFrame([(rng.choice([1, 1, 2, 3, None]), f"c{k}", rng.choice(texts)) for k in range(100)], "bundle_id int, claim_id string, claim_text string")
    excerpts = spark.createDataFrame([(rng.choice([1, 1, 2, 4, None]), "s", f"e{k}", rng.choice(texts)) for k in range(90)], "bundle_id int, source_id string, excerpt_id string, excerpt_text string")
    cols = ["bundle_id", "claim_id", "excerpt_id", "score", "n_terms", "n_numbers", "n_phrases"]
    every = match.score_bundle_pairs(claims, excerpts).filter("score >= 0.4")
    want = Counter(tuple(r) for r in every.select(*cols).collect())
    found = match.score_candidates(claims, excerpts)
    assert set(found.columns) == set(every.columns) and Counter(tuple(r) for r in found.select(*cols).collect()) == want and want
    least = match.score_candidates(claims, excerpts, features=False)
    assert Counter(tuple(r) for r in least.select(*cols).collect()) == want
    if rows == 1000:
        assert not {"c_phrases", "e_phrases"} & set(least.columns)
        assert "array_intersect" not in match.best_candidates(found).select("claim_id", "rank")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "sent"), [("SENT_TEXTS", 1000), ("SENT_TEXTS", 3), ("SENT_KEYS", 20)])
def test_pairs_of_large_bundles_move_without_features(spark, monkeypatch, name, sent):
    """Pairs of a large bundle are scored where the longer side's texts lie, and settled narrow; in rounds
    of the shorter side, too, whichever it is, and rows of equal texts come back each."""
    monkeypatch.setattr(match, name, sent)
    monkeypatch.setattr(match, "BUNDLE_ROWS", 5)
    monkeypatch.setattr(match, "TEXT_PAIRS", 0)
    kept, own = [], match.settled
    monkeypatch.setattr(match, "settled", lambda df: kept.append(df) or own(df))
    claims, excerpts = claims_and_excerpts(spark, 13, 40)
    cols = ["bundle_id", "claim_id", "source_id", "excerpt_id", "score", "n_terms"]
    for c, e in ((claims.limit(15), excerpts), (claims, excerpts.limit(15))):
        want = Counter(tuple(r) for r in match.score_bundle_pairs(c, e).filter("score >= 0.2").select(*cols).collect())
        kept.clear()
        found = match.score_candidates(c, e, 0.2, features=False)
        assert Counter(tuple(r) for r in found.select(*cols).collect()) == want and want
        pairs = [df for df in kept if {"c_row", "e_row", "score"} <= set(df.columns)]
        assert len(pairs) == 1 if sent == 1000 else len(pairs) > 1
        for df in pairs:
            assert set(df.columns) == {"c_row", "e_row", "n_terms", "n_numbers", "n_phrases", "score"}
            dealt = re.findall(r"hashpartitioning\((.*?), \d+\), (\w+)", df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
            assert not any("c_row" in by and "e_row" in by for by, _ in dealt)


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """Assessments deal claims and contexts out by their number, not by their bytes."""
    run = lambda: lexical.QUERIES["guidance"](spark, "/root/testdata/sf0.001")
    want = Counter(tuple(r) for r in run().collect())
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    found = run()
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(bundle_id#\d+L?, claim_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and min(dealt) >= want.total() // 100
    assert Counter(tuple(r) for r in found.collect()) == want


def dealt_out(df):
    """(dealt by row count, dealt otherwise): how many parts each shuffle by keys of df's plan makes."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    found = re.findall(r"hashpartitioning\(.*?, (\d+)\), (\w+)", plan)
    return [int(n) for n, why in found if why == "REPARTITION_BY_NUM"], [int(n) for n, why in found if why != "REPARTITION_BY_NUM"]


def test_linked_pairs_are_dealt_by_count(spark, monkeypatch):
    """No join or rank of linked pairs takes parts put together by their bytes; rows are those of all pairs."""
    claims, excerpts = claims_and_excerpts(spark, 11, 80)
    rng = random.Random(12)
    links = [(rng.choice([1, 1, 2, None]), f"c{rng.randrange(80)}", f"e{rng.randrange(80)}", rng.choice(["support", "counter"])) for _ in range(900)]
    links = spark.createDataFrame(links, "bundle_id int, claim_id string, excerpt_id string, role string").distinct()
    cols = ["bundle_id", "claim_id", "excerpt_id", "role", "score"]
    every = match.score_bundle_pairs(claims, excerpts).join(links, ["bundle_id", "claim_id", "excerpt_id"])
    want = Counter(tuple(r) for r in every.filter("role = 'counter' or score >= 0.4").select(*cols).collect())
    monkeypatch.setattr(tables, "ROWS_A_TASK", 10)
    found = match.scoped_candidates(claims, excerpts, links.localCheckpoint(), k=1000)
    by_count, otherwise = dealt_out(found)
    assert len(by_count) == 5 and min(by_count) >= 8 and not otherwise
    assert Counter(tuple(r) for r in found.select(*cols).collect()) == want and want


def test_audits_shuffle_claims_once(spark):
    """Assessments shuffle claims once and contexts once, without texts or links of the evidence."""
    found = lexical.QUERIES["guidance"](spark, "/root/testdata/sf0.001")
    by_count, otherwise = dealt_out(found)
    assert len(by_count) == 2 and not otherwise
    plan = found._jdf.queryExecution().optimizedPlan()
    nodes = [node for node in map(plan.p, range(200)) if node is not None]
    dealt = [str(node.output().mkString(",")) for node in nodes if node.nodeName() == "RepartitionByExpression"]
    names = [name for columns in dealt for name in re.findall(r"(\w+)#", columns)]
    assert len(dealt) == 2 and "direct_source" in names
    assert not set(names) & {"excerpt_text", "evidence", "notes", "url", "reliability", "triggers", "source_date"}


def test_bundles_without_sources(spark):
    """Claims of bundles that no source has, and of none, are told apart, repeated sources and nulls too."""
    claims = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e"), (3, "e")], "bundle_id int, claim_id string")
    sources = spark.createDataFrame([(1,), (1,), (None,), (4,)], "bundle_id int")
    want = Counter([(1, "a", True), (1, "b", True), (2, "c", False), (None, "d", False), (3, "e", False), (3, "e", False)])
    found = lambda s: Counter(tuple(r) for r in rules.with_sources(claims, s).select("bundle_id", "claim_id", "has_sources").collect())
    assert found(sources) == want
    assert found(sources.limit(0)) == Counter({(b, c, False): n for (b, c, _), n in want.items()})


def test_pairs_are_not_shuffled(spark):
    """Claims and excerpts are dealt out by bundle once; their pairs stay where they meet."""
    claims, excerpts = claims_and_excerpts(spark, 8, 30)
    best = match.best_candidates(match.score_candidates(claims, excerpts))
    assert shuffles(best.select("bundle_id", "claim_id", "excerpt_id", "rank")) == 2


def test_contexts_are_worked_out_once(spark):
    """What an audit says of claims is read from settled contexts: no pair is ranked again."""
    data = "/root/testdata/sf0.001"
    for query in ("claim_register", "quality_notes"):
        plan = lexical.QUERIES[query](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan


def test_facts_of_texts(spark):
    """Every distinct text is read once, null too; columns of the same name are replaced."""
    df = spark.createDataFrame([(1, "a", 0), (2, None, 0), (3, "a", 0), (4, "", 0)], "k int, t string, n int")
    told = once_a_text(df, "t", lambda texts: texts.withColumn("n", F.coalesce(F.length("t"), F.lit(-1))))
    assert told.count() == 3
    assert sorted(tuple(r) for r in with_texts(df, told, "t").select("k", "n").collect()) == [(1, 1), (2, -1), (3, 1), (4, 0)]
