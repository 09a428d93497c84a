"""URL rules, WARC records and the pipeline against plain versions."""

import random
from collections import Counter

import corpus_pipeline
from provenlake.llm import decontaminate, queries, toxicity, url_filter, warc

from . import brute


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate(brute.AZ), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_rules_of_the_contract(spark, tmp_path):
    """Rules and verdicts as the contract words them, written out here."""
    urls = {
        "http://a.com/en/": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://x.net/de/8": ("net/de/", "allow"),
        "http://www.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://o.org/es/?q": ("org/es/", "block"), "http://o.org/en/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: (r.rule, r.verdict) for r in queries.op3_url_filter(spark, str(tmp_path)).collect()}
    assert found == dict(enumerate(urls.values()))


def test_url_rules(spark):
    rng = random.Random(1)
    hosts = ["example.com", "a.example.com", "WWW.Example.NET", "notexample.com", "x.org", "com", "", "example.com."]
    tails = ["", "/", "/en/", "/en/7", "/en/70?q=/de/", "/de/8#x", "?/en/", "/es", "/es/\nmore", "/EN/7"]
    urls = [rng.choice(["http://", "https://", "//", "x://y://"]) + rng.choice(hosts) + rng.choice(tails) for _ in range(300)] + [None, "", "://", "plain"]
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as rule", "2 as verdict")
    found = url_filter.judge_urls(pages, rules)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in found.collect():
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, queries.URL_RULES)
    assert found.count() == len(urls)
    assert url_filter.judge_urls(pages, rules.limit(0)).filter("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_warc_round_trip(spark, tmp_path):
    page = "<html lang='de'><head><title>A &amp; B</title><script>no()</script></head><body><p>One</p><p>zwei ü</p><!-- gone --></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (3, "http://c/", ""), (1, "http://a/", page)], "page_id long, url string, html string").repartition(3)
    responses = warc.responses_from_pages(pages)
    records = warc.derive_records(responses).cache()
    assert records.count() == 8
    text = records.filter("record_type = 'conversion' and page_id = 1").first()
    assert text.block == "A & B\nOne\nzwei ü" and text.content_length == len(text.block.encode())
    assert text.block_digest == "sha256:" + brute.sha(text.block) and text.payload_digest == "sha256:" + brute.sha(page)
    about = records.filter("record_type = 'metadata' and page_id = 1").first()
    assert about.refers_to == text.refers_to and about.concurrent_to == text.new_id and "title: A & B\r\nlanguage: de" in about.block
    warc.write_warc(records, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out"))
    cols = ["record_type", "refers_to", "content_length", "block"]
    assert Counter(map(tuple, back.select(cols).collect())) == Counter(map(tuple, records.select(cols).collect()))
    assert warc.derive_records(responses.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choices([f"b{x}" for x in range(300)], k=25))) for k in range(6)]
    rows, toxic = [], {}
    for i, text in brute.corpus(seed=3, n=150, lo=20):
        toxic[i] = int(rng.random() < 0.15)
        w = (text or "").split(" ")
        for _ in range(6 if toxic[i] else 0):
            w[rng.randrange(len(w))] = f"bad{rng.randrange(4)}"
        if rng.random() < 0.1:
            w += rng.choice(items)[1].split(" ")
        text = None if text is None else " ".join(w)
        rows.append((i, text, "en", rng.choice(["src0", "src1", "src9", None]), len(text or "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    left = [(i, t) for i, t, *_ in rows if scores[i] < corpus_pipeline.TOXIC_SCORE]
    assert 20 < len(rows) - len(left) < 50
    left = [(i, t) for i, (_, _, t) in brute.without_lines(left).items()]
    left = [(i, t) for i, t in left if brute.components(left, 5, 80)[i][1] == i]
    bad = {d for d, _ in brute.overlaps(left, items)}
    assert bad
    want = [(i, t, len(t)) for i, t in left if i not in bad]

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out) == sorted(want)
    assert len({(r.mix_slot, r.mix_row) for r in out}) == len(out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
