"""Operators on documents against their plain versions, and their edge cases."""

import random
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenlake.llm import components, decontaminate, license_scan, line_dedup, lm_score, mixing, near_dup, queries, topk_search, toxicity

from . import brute

ODD = "doc_id long, text string"


def table(spark, rows, extra=()):
    """Rows as a table, with further columns of clashing names."""
    df = spark.createDataFrame(rows, ODD).repartition(5)
    return df.withColumns({c: F.lit(7) for c in extra})


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rows = brute.corpus(seed=k)
    found = near_dup.near_duplicates(table(spark, rows, ["id", "n", "rep", "key", "bands", "component"]), shingle_words=k, percent=percent, block_docs=3, block_shingles=64)
    want = [(i, n, c, c == i) for i, (n, c) in brute.components(rows, k, percent).items()]
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (3, "A B C D"), (3, "A B C D"), (9, None)]
    found = got(near_dup.near_duplicates(table(spark, rows), shingle_words=3), "doc_id", "component_id", "kept")
    assert found == sorted([(None, None, True), (None, None, True), (5, 3, False), (3, 3, True), (3, 3, True), (9, 9, True)], key=repr)
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 7), (7, 100), (5, 5), (None, 3), (201, 200)] + [(300, k) for k in range(301, 360)]
    found = dict(got(components.connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert found == {k: 1 for k in [*range(1, 41), 100]} | {200: 200, 201: 200} | {k: 300 for k in range(300, 360)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_line_dedup(spark, partitions):
    rows = brute.corpus(seed=9, n=90) + [(k, "A line that very many documents hold\nown %d" % k) for k in range(3000, 3200)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = got(line_dedup.drop_lines(table(spark, rows, ["id", "print", "n_lines", "others"])), "doc_id", "n_lines", "n_dropped", "text")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found == sorted([(i, *v) for i, v in brute.without_lines(rows).items()], key=repr)


def test_line_dedup_odd_rows(spark):
    line = "this line is quite long enough"
    rows = [(None, line), (None, line), (1, line), (2, line), (2, line), (2, f"x\n{line}\n{line}"), (4, None)]
    found = got(line_dedup.drop_lines(table(spark, rows)), "doc_id", "n_lines", "n_dropped", "text")
    want = [(None, 1, 1, "")] * 2 + [(1, 1, 1, "")] + [(2, 1, 0, line)] * 2 + [(2, 3, 0, f"x\n{line}\n{line}"), (4, 1, 0, "")]
    assert found == sorted(want, key=repr)
    assert line_dedup.drop_lines(table(spark, [])).count() == 0
    bits = line_dedup.line_keep_bitmaps(table(spark, [(1, line + "\nz"), (2, line), (3, line)])).filter("id = 1").first()
    assert np.unpackbits(np.frombuffer(zlib.decompress(bits.keep_bitmap), np.uint8), count=2).tolist() == [0, 1]


def test_licenses(spark):
    rng = random.Random(3)
    parts = [*license_scan.TEMPLATES.values(), *license_scan.PHRASES, "ALL rights, reserved", "plain words", "license the mit", "cc", "by"]
    rows = [(k, rng.choice(["\n", " "]).join(rng.choices(parts, k=rng.randint(0, 5)))) for k in range(150)] + [(900, None), (901, "")]
    want = []
    for i, text in rows:
        words = brute.symbol_words(text)
        starts = [(at, label) for phrase, label in license_scan.PHRASES.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        shares, h = {}, max(len(brute.symbol_words(t)) for t in license_scan.TEMPLATES.values())
        for at in range(0, len(words), h):
            met = []
            for label, template in license_scan.TEMPLATES.items():
                need = set(brute.symbol_words(template))
                held = need & set(words[at : at + 2 * h])
                if 100 * len(held) >= 80 * len(need):
                    met.append((label, len(held) / len(need), held))
            for label, share, held in met:
                if not any(held < more and share <= other for _, other, more in met):
                    shares[label] = max(shares.get(label, 0), share)
        base = sorted({label for _, label in starts})
        places = [at for at, _ in starts]
        want.append((i, len(words), len(starts), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *shares})), max([1.0 if base else 0.0, *shares.values()])))
    found = license_scan.scan_licenses(table(spark, rows, ["n_words", "labels"]))
    assert got(found, *found.columns) == sorted(want, key=repr)
    assert license_scan.scan_licenses(table(spark, [])).count() == 0


def test_lm_scores(spark):
    rows = [r for r in brute.corpus(seed=5, n=60) if r[0] != 2005]
    target = {r[0] for r in rows[::3]}
    ids = spark.createDataFrame([(i,) for i in [*target, None, 99999, rows[0][0]]], "doc_id long")
    found = lm_score.score_documents(table(spark, rows, ["id", "target"]), ids)
    want = brute.lm_scores(rows, target)
    assert found.count() == len(rows)
    for r in found.collect():
        n, score = want[r.doc_id]
        assert r.n_words == n and r.score == pytest.approx(score, abs=1e-4)
        assert (r.loss_target is None) == (n == 0)
    assert lm_score.score_documents(table(spark, []), ids).count() == 0


def test_lm_score_tells_no_membership(spark):
    """Texts of one distribution score alike whether they were drawn for the target or not."""
    rng = random.Random(44)
    rows = [(k, " ".join(f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(60))) for k in range(600)]
    target = {k for k in range(600) if rng.random() < 0.5}
    scored = {r.doc_id: r.score for r in lm_score.score_documents(table(spark, rows), spark.createDataFrame([(k,) for k in target], "doc_id long")).collect()}
    inside, outside = np.array([scored[k] for k in target]), np.array([scored[k] for k in scored if k not in target])
    auc = (inside[:, None] > outside).mean() + (inside[:, None] == outside).mean() / 2
    assert 0.45 < auc < 0.55
    likely = [(k, " ".join(f"w{max(rng.randrange(300), rng.randrange(300))}" for _ in range(60)) if k in target else t) for k, t in rows]
    scored = {r.doc_id: r.score for r in lm_score.score_documents(table(spark, likely), spark.createDataFrame([(k,) for k in target], "doc_id long")).collect()}
    inside, outside = np.array([scored[k] for k in target]), np.array([scored[k] for k in scored if k not in target])
    assert (inside[:, None] > outside).mean() > 0.98


def test_lm_losses_are_of_distributions(spark):
    """Words of the vocabulary, as one-word texts, have probabilities that sum to 1 under each model."""
    rows = [(0, "a b a c"), (1, "b d e")] + [(10 + k, w) for k, w in enumerate("abcde")]
    for left_out in (0, 1):
        # a text of one word outside both training texts does not change their counts but for itself
        found = {r.doc_id: r for r in lm_score.score_documents(table(spark, rows), spark.createDataFrame([(left_out,)], "doc_id long")).collect()}
        assert sum(np.exp(-found[10 + k].loss_target) for k in range(5)) == pytest.approx(1)


def test_top_k(spark, monkeypatch):
    rows = brute.corpus(seed=8, n=150)
    rows += [(5000 + k, rows[k][1]) for k in range(20)]
    queries = [r for r in rows if r[0] % 10 == 0]
    for name, value in (("BLOCK", 100), ("SHARD", 12), ("SENT_WORDS", 150)):
        monkeypatch.setattr(topk_search, name, value)
    docs = table(spark, [*rows, (None, "w1 w2 w3")], ["id", "score"])
    found = got(topk_search.top_k(docs, table(spark, [*queries, (None, "w1")])), "query_id", "rank", "doc_id", "score")
    want = brute.bm25([*rows, (None, "w1 w2 w3")], queries)
    assert [r[:3] for r in found] == [r[:3] for r in sorted(want, key=repr)]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in sorted(want, key=repr)], abs=2e-6)
    assert topk_search.top_k(table(spark, []), table(spark, [])).count() == 0


def test_equal_queries_are_searched_once(spark, monkeypatch):
    """Queries of the same words, in any order and many times over, get the same results from one search."""
    rows = brute.corpus(seed=6, n=60)
    rng = random.Random(3)
    queries = [(9000 + k, "w1 w2 w2 w5") for k in range(30)] + [(9100, "w2 w5 w1 w2"), (9101, "w1 w2 w5"), (9102, "W5 w2! w1 w2")] + [(9200 + k, text) for k, (_, text) in enumerate(rows[:5])]
    rng.shuffle(queries)
    seen, own = [], topk_search.Queries.of
    monkeypatch.setattr(topk_search.Queries, "of", lambda part: seen.append(set(part["query"].to_pylist())) or own(part))
    found = got(topk_search.top_k(table(spark, rows), table(spark, queries)), "query_id", "rank", "doc_id", "score")
    want = sorted(brute.bm25(rows, queries), key=repr)
    assert [r[:3] for r in found] == [r[:3] for r in want] and len(want) > 100
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want], abs=2e-6)
    assert 2 <= len(set().union(*seen)) <= 7


@pytest.mark.parametrize("rounds", [10**6, 1500])
def test_decontamination(spark, rounds):
    rows = brute.corpus(seed=2, n=50, vocabulary=200, lo=30)
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices([f"b{x}" for x in range(90)], k=n))) for k, n in enumerate([3, 5, 6, 7, 9, 20, 30, 45])] + [(50, None), (51, "")]
    for k, (item, text) in enumerate(items * 6):
        words = (text or "").split()
        for _ in range(k // len(items)):
            if words:
                words[rng.randrange(len(words))] = "changed"
        rows.append((6000 + k, f"{rows[k][1]} {' '.join(words)}! {rows[k + 1][1]}"))
    found = decontaminate.contaminated_pairs(table(spark, rows, ["item", "id", "words"]), spark.createDataFrame(items, "item_id long, text string"), sent_seeds=rounds)
    want = [(*k, *v) for k, v in brute.overlaps(rows, items).items()]
    assert got(found, "doc_id", "item_id", "window_tokens", "matched") == sorted(want, key=repr) and len(want) > 20
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated_pairs(table(spark, rows), none).count() == 0
    assert decontaminate.drop_contaminated(table(spark, rows), none).count() == len(rows)


def test_decontamination_misses_no_substitution(spark):
    """Every set of substitutions that the threshold allows, in items of 5 to 20 tokens and beyond."""
    items, rows = [], []
    for n in [*range(5, 16), 20, 33]:
        words = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        run = min(n, 20)
        for gone in combinations(range(run), run - -(-run * 80 // 100)):
            if n < 16 or hash(gone) % 40 == 0:
                rows.append((n * 100_000 + len(rows), "before " + " ".join("other" if k in gone else w for k, w in enumerate(words)) + " after"))
        rows += [(n * 100_000 + 90_000, " ".join(words[-(-n * 4 // 5) * -1 :])), (n * 100_000 + 90_001, " ".join(words[: -(-n * 4 // 5)]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(table(spark, rows), benchmark).collect()}
    assert found == {(i, i // 100_000) for i, _ in rows}
    assert got(decontaminate.contaminated_pairs(table(spark, rows), benchmark), "doc_id", "item_id", "window_tokens", "matched") == sorted([(*k, *v) for k, v in brute.overlaps(rows, items).items()], key=repr)


def test_decontamination_of_odd_rows(spark):
    long = [f"l{k}" for k in range(3000)]
    rows = [(None, "one two three four five six"), (None, "nothing"), (7, "one two x four five six"), (7, "one two three four five six"), (8, " ".join(long)), (9, None), (10, "")]
    items = [(None, "one two three four five six"), (2, " ".join(long[500:1500])), (2, "one two three four five six"), (3, None)]
    found = decontaminate.contaminated_pairs(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert got(found, "doc_id", "item_id", "window_tokens", "matched") == sorted([(None, None, 6, 6), (None, 2, 6, 6), (7, None, 6, 6), (7, 2, 6, 6), (8, 2, 20, 20)], key=repr)


def test_decontamination_sends_equal_items_once_and_rounds_apart(spark, monkeypatch):
    """Copies of an item add no round, and a round's seeds are gone when the next one begins."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"b{x}" for x in range(60)], k=20)) for _ in range(4)]
    items = [(100 * copy + k, text) for copy in range(30) for k, text in enumerate(texts)] + [(0, texts[1])]
    rows = [(k, f"before {texts[k % 3]} after {k % 5}") for k in range(40)] + [(None, texts[2])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    made, own = [], decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, name: made.append(name) or own(df, name))
    want = sorted([(*k, *v) for k, v in brute.overlaps(rows, items).items()], key=repr)
    for sent, most in ((4 * 20 * 5, 1), (20 * 5, 4)):
        made.clear()
        found = decontaminate.contaminated_pairs(table(spark, rows), benchmark, sent_seeds=sent)
        assert got(found, "doc_id", "item_id", "window_tokens", "matched") == want
        assert 1 <= made.count("overlaps") <= most
        assert "i_at" not in found._jdf.queryExecution().toString()
    left = decontaminate.drop_contaminated(table(spark, [*rows, (900, "clean")]), benchmark, sent_seeds=20 * 5)
    assert got(left, "doc_id") == [(900,)]


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Rows that share an id count once, and the features' bytes are bounded too."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior, steps: seen.append((len(p), len(u), sum(x.nbytes for x in p + u))))
    rows = [(k % 90, f"t{k} t{k % 7} t{k % 11} t{k % 13}") for k in range(4000)]
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(60)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic")
    toxicity.fit(table(spark, rows), labels, train_rows=20)
    toxicity.fit(table(spark, rows), labels, train_rows=20, train_bytes=200)
    assert seen[0][0] <= 20 and 20 <= seen[0][1] <= 40 and seen[1][2] <= 2 * 200 and seen[1][1] < seen[0][1]


def test_toxicity_training_takes_little_memory():
    """Only features that three positives hold are laid out in doubles, not the whole range of features."""
    rng = np.random.default_rng(5)
    draw = lambda: np.unique(rng.integers(0, 1 << toxicity.BITS, 40)).astype(np.int32)
    positives = [np.unique(np.append(draw(), [7, 11])).astype(np.int32) for _ in range(40)]
    tracemalloc.start()
    try:
        model = toxicity.train(positives, [draw() for _ in range(400)], 0.1, steps=20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.features.tolist() == [7, 11] and peak < 24 << 20


def test_toxicity_on_held_out_labels(spark):
    """Most toxic documents that were never learnt from are caught, and few clean ones taken for such."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter("toxic is not null")
    found = queries.op7_toxicity(spark, sf_dir).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in found}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * (n[0, 0] + n.get((0, 1), 0))


def test_toxicity(spark):
    rng = random.Random(6)
    plain, bad = [f"p{k}" for k in range(500)], [f"bad{k}" for k in range(12)]
    rows, truth = [], {}
    for i in range(1500):
        truth[i] = int(rng.random() < 0.12)
        w = rng.choices(plain, k=rng.randint(10, 60))
        for _ in range(rng.randint(3, 6) if truth[i] else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
    docs = table(spark, [*rows, (None, "bad1 bad2 bad3 bad4"), (9000, None), (9001, "")], ["score", "positive"])
    labels = spark.createDataFrame([*truth.items(), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, train_rows=900)
    out = toxicity.score(docs, model)
    assert out.columns.count("score") == 1 and out.count() == len(rows) + 3
    kept = out.select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    held = [(truth[r.doc_id], r.score >= 0.7) for r in kept if r.h and r.doc_id in truth]
    assert len(held) > 300 and all(0 <= r.score <= 1 for r in kept)
    assert np.mean([t == p for t, p in held]) > 0.95
    empty = [r.score for r in kept if r.doc_id in (9000, 9001)]
    assert empty[0] == empty[1] < 0.5
    flat = toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 0"))).select("score").distinct().collect()
    assert len(flat) == 1 and flat[0][0] < 0.5
    assert toxicity.score(table(spark, []), model).count() == 0


def test_mixing(spark):
    rng = random.Random(7)
    names = ["src0"] * 5 + ["src1"] * 2 + ["z", None, "other"]
    rows = [(k, rng.choice(names)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("mix_row", F.lit(1)).repartition(5)
    weights = {"src0": 5, "src1": 2, "other": 3}
    out = mixing.mix_sources(docs, weights, block_rows=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    assert len({(r.mix_slot, r.mix_row) for r in out}) == 3000
    blocks = {}
    for r in out:
        blocks.setdefault(r.mix_slot, set()).add(r.source if r.source in ("src0", "src1") else "other")
    assert sorted(blocks) == list(range(len(blocks))) and all(len(b) == 1 for b in blocks.values())
    order = [b.pop() for _, b in sorted(blocks.items())]
    counts = dict.fromkeys(weights, 0)
    first_end = min(max(t for t, s in enumerate(order) if s == name) for name in weights)
    for t, name in enumerate(order[:first_end], 1):
        counts[name] += 1
        assert all(abs(counts[s] - t * w / 10) < 1 for s, w in weights.items())
    assert mixing.mix_sources(docs.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": 0})
