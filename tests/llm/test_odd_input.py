"""Clashing names, texts over a mebibyte, several Arrow batches, repeated rows and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenlake.llm import license_scan, line_dedup, lm_score, mixing, near_dup, shared, topk_search, toxicity, url_filter, warc

from . import brute
from .test_documents import got, table


@pytest.mark.parametrize("batch_rows", [1, 2, 3])
def test_line_dedup_across_batches(spark, monkeypatch, batch_rows):
    """Lines that end with a batch, at the edge of a partition, are counted too."""
    monkeypatch.setattr(shared, "ARROW_ROWS", batch_rows)
    rows = [(k, "\n".join(f"a long line, number {x} of a few" for x in range(k % 4 + 1))) for k in range(24)]
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = got(line_dedup.drop_lines(table(spark, rows)), "doc_id", "n_lines", "n_dropped", "text")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found == sorted([(i, *v) for i, v in brute.without_lines(rows).items()], key=repr)


def test_long_texts_and_many_batches(spark, monkeypatch):
    monkeypatch.setattr(shared, "ARROW_ROWS", 7)
    rows = [r for r in brute.corpus(seed=21, n=40) if r[0] != 2005]
    rng = random.Random(22)
    long = " ".join(f"n{rng.randrange(9000)}" for _ in range(220_000))
    rows += [(7000, long), (7001, long + " all rights reserved"), (7002, long[: len(long) // 2])]
    assert len(long) > 1 << 20
    docs = table(spark, rows)
    want = brute.components(rows, 3, 85)
    assert dict(got(near_dup.near_duplicates(docs, shingle_words=3, percent=85).select("doc_id", F.struct("n_shingles", "component_id").alias("v")), "doc_id", "v")) == want
    scanned = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert scanned[7000].n_words == 220_000 and scanned[7001].base_labels == "reserved" and scanned[7001].first_word == 220_000
    target = {7000, *[r[0] for r in rows[::4]]}
    losses = lm_score.score_documents(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    plain = brute.lm_scores(rows, target)
    assert all(r.score == pytest.approx(plain[r.doc_id][1], abs=1e-6) for r in losses) and len(losses) == len(rows)
    asked = [(7002, long[:60_000]), rows[3]]
    found = got(topk_search.top_k(docs, table(spark, asked)), "query_id", "rank", "doc_id", "score")
    best = brute.bm25(rows, asked)
    assert [r[:3] for r in found] == [r[:3] for r in sorted(best, key=repr)]
    model = toxicity.Model(np.arange(1 << toxicity.BITS), np.full(1 << toxicity.BITS, 0.001), 0.0)
    z = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    words = len({toxicity._features(np.array([h], np.uint64))[0] for h in _hashes(long)})
    assert z[7000] == pytest.approx(1 / (1 + np.exp(-0.001 * words)))


def _hashes(text):
    import pyarrow as pa

    from provenlake.llm.textops import SYMBOLS, pieces

    return np.concatenate([w.hashes for _, _, w in pieces(pa.array([text]), SYMBOLS)]).tolist()


def test_pairs_at_the_threshold(spark):
    """17 of 20 shingles shared is exactly 85 %; 16 of 20 is not enough."""
    base = [f"t{k}" for k in range(20)]
    rows = [(1, " ".join(base[:19])), (2, " ".join([*base[1:19], "z"]))]  # 17 shingles each, 16 shared of 18
    rows += [(3, " ".join(f"u{k}" for k in range(19))), (4, " ".join(f"u{k}" for k in range(22)))]  # 17 of 20
    found = dict(got(near_dup.near_duplicates(table(spark, rows), shingle_words=3, percent=85), "doc_id", "component_id"))
    assert found == {i: c for i, (_, c) in brute.components(rows, 3, 85).items()} and found[4] == 3


def test_url_names(spark):
    rules = spark.createDataFrame([("com", "/a", "block")], "host string, path string, verdict string")
    urls = ["http://x.com/a/1", None, "", "http://x.com/b", "nothing"] + ["http://hot.com/a"] * 300
    pages = spark.createDataFrame([(k, u, k % 5) for k, u in enumerate(urls)], "page_id long, url string, won long")
    pages = pages.withColumns({c: F.lit("own") for c in ("won_url", "h", "p", "salt", "row", "short", "full", "digest", "r_host", "rule", "host")})
    out = url_filter.judge_urls(pages, rules)
    assert sorted(out.columns) == sorted([*[c for c in pages.columns if c not in ("rule", "host")], "host", "path", "rule", "verdict"])
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.won) for r in out.collect()}
    assert len(found) == len(urls) and found[0] == ("x.com", "/a/1", "com/a", "block", 0)
    assert found[1] == ("", "", None, "allow", 1) and found[3][3] == "allow" and all(found[k][3] == "block" for k in range(5, 305))
    sent, url_filter.SENT_RULES = url_filter.SENT_RULES, 0
    try:  # rules too many to be sent meet by a shuffle
        assert sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    finally:
        url_filter.SENT_RULES = sent


def test_mix_names_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED_ROWS", 50)
    rows = [(k, ["a", "b", None][k % 3]) for k in range(300)] + [(999, "a")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    docs = docs.withColumns({c: F.lit(1) for c in ("first", "total", "slots", "p_queue", "queue", "order", "lot", "rank", "block", "row", "pile", "n", "before")})
    out = mixing.mix_sources(docs, {"a": 3, "b": 1}, block_rows=8)
    assert set(out.columns) == {*docs.columns, "mix_slot", "mix_row"}
    out = out.collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows) and len({(r.mix_slot, r.mix_row) for r in out}) == 700
    assert all(r.first == 1 and r.queue == 1 for r in out)
    by_slot = {}
    for r in out:
        by_slot.setdefault(r.mix_slot, []).append(r)
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len({r.source for r in b}) == 1 for b in by_slot.values())
    assert all(sorted(r.mix_row for r in b) == list(range(len(b))) for b in by_slot.values())


def plain_schedule(weights, blocks):
    """Earliest deadline first, slot by slot; begun anew with the sources left when one runs out."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        total, had, t = sum(weights[s] for s in left), dict.fromkeys(left, 0), 0
        while min(left.values()):
            ready = [s for s in left if had[s] * total // weights[s] <= t]
            s = min(ready, key=lambda s: (-(-(had[s] + 1) * total // weights[s]), s))
            out.append(s)
            had[s] += 1
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_schedule_with_sources_running_out():
    rng = random.Random(31)
    for _ in range(60):
        weights = {f"s{k}": rng.randint(1, 9) for k in range(rng.randint(1, 6))}
        blocks = {s: rng.randint(0, 40) for s in weights}
        want, order = plain_schedule(weights, blocks), [None] * sum(blocks.values())
        for s, first, stop, base, total, slots in mixing.phases(weights, blocks):
            for k in range(first, stop):
                nth = k - first
                order[base + nth // len(slots) * total + slots[nth % len(slots)]] = s
        assert order == want


def test_risk_slopes():
    """The slopes against differences of the plain risk, on both sides of zero."""
    rng = np.random.default_rng(5)
    positive = np.arange(30) < 10

    def parts(x, prior):
        s = 1 / (1 + np.exp(-x))
        up, down = -np.log(s), -np.log(1 - s)
        return prior * up[positive].mean(), down[~positive].mean() - prior * down[positive].mean()

    signs = set()
    for prior in (0.1, 0.9):
        for shift in (-3, 3):
            x = rng.normal(size=30) + np.where(positive, shift, -shift)
            rest, slope = toxicity.risk_slopes(x, positive, prior)
            assert rest == pytest.approx(parts(x, prior)[1])
            signs.add(rest >= 0)
            for k in (0, 9, 10, 29):
                e = np.zeros(30)
                e[k] = 1e-6
                hi, lo = parts(x + e, prior), parts(x - e, prior)
                risk = (sum(hi) - sum(lo)) if rest >= 0 else -(hi[1] - lo[1])
                assert slope[k] == pytest.approx(risk / 2e-6, abs=1e-6)
    assert signs == {True, False}


def test_toxicity_from_unlabelled_texts(spark):
    """Documents without a label are learnt from too; the labels' zeros only give the prior."""
    rng = random.Random(41)
    rows, truth = [], {}
    for i in range(1600):
        truth[i] = int(rng.random() < 0.15)
        w = [f"p{rng.randrange(400)}" for _ in range(30)]
        if truth[i]:
            w[:4] = rng.choices([f"bad{k}" for k in range(8)], k=4)
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, t) for i, t in truth.items() if i % 2], "doc_id long, toxic int")
    docs = table(spark, rows, ["kind", "positive"])
    kept = toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert np.mean([truth[r.doc_id] == (r.score >= 0.7) for r in kept if r.h]) > 0.95


def test_warc_round_trip(spark, tmp_path):
    html = "<html lang='fr'><title>T</title><p>it&#8217;s caf&eacute; &mdash; x &#x41;&amp;lt; &#55296;</p></html>"
    responses = spark.createDataFrame([("<urn:a>", "http://u/1", "2026-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n", html, 7)], "record_id string, target_uri string, date string, http_header string, payload string, text int")
    block = F.concat("http_header", F.lit("\r\n"), "payload")
    header = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), "record_id", F.lit("\r\nWARC-Date: "), "date", F.lit("\r\nWARC-Target-URI: "), "target_uri", F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n"))
    warc.write_warc(responses.select(header.alias("warc_header"), block.alias("block")), str(tmp_path / "in"))
    read = warc.responses_from_warc(warc.read_warc(spark, str(tmp_path / "in")))
    same = ["record_id", "target_uri", "date", "http_header", "payload"]
    assert got(read, *same) == got(responses, *same)
    derived = warc.derive_records(responses.withColumns({c: F.lit(1) for c in ("title", "language", "others", "new", "metadata_id", "e")}))
    assert derived.columns.count("text") == 1 and derived.count() == 2 and derived.filter("text = 7 and title = 1").count() == 2
    text = derived.filter("record_type = 'conversion'").first().block
    assert text.endswith("it\u2019s caf\u00e9 \u2014 x A&lt; &#55296;")
    warc.write_warc(derived, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out"))
    assert got(back, "record_type", "record_id", "block", "refers_to") == sorted([(r.record_type, r.new_id, r.block, "<urn:a>") for r in derived.collect()], key=repr)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.warc").write_bytes(b"")
    (tmp_path / "none" / "b.warc").write_bytes(b"no record at all")
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), ("r", "u", "d", "", "<p>" + "long text " * 200_000)], "record_id string, target_uri string, date string, http_header string, payload string")
    assert warc.derive_records(odd).count() == 4 and warc.derive_records(odd.limit(0)).count() == 0
