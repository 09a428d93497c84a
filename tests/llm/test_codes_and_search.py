"""Token ids, vector codes and ranked search against plain versions, and their edge cases."""

import base64
import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from provenlake.llm import byte_bpe, queries, ranked_search, topk_search, vector_codes

from . import brute
from .test_documents import got, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    rng = random.Random(41)
    letters = "abc ABC'sdtrevml  \n\t é日本語🙂١²0123!?՘\U0001e6c0\x00\x1c\x85"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(n)]
    texts += ["a" * 5000, "ab" * 9000, " " * 9000, "!" * 7000 + "x", "".join(rng.choices("etaoinshrdlu", k=20_000)), "<|endoftext|>", "'re're 'll we'll'd", None, ""]
    return texts + ["word " * 60_000]


def test_token_ids(spark, plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN_PIECES", 500)
    monkeypatch.setattr(byte_bpe, "TEXT_BYTES", 4000)
    rows = list(enumerate(odd_texts(1500))) + [(None, "a null id"), (3, "a repeated id"), (3, "a repeated id")]
    docs = table(spark, rows, ["id", "n_tokens", "ids", "decoded"])
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    found = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out.collect())
    want = Counter()
    for i, text in rows:
        ids = plain.encode_ordinary(text or "")
        want[(i, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode())] += 1
    assert found == want
    assert byte_bpe.encode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.token_ids(pa.array([np.array([5, 50255], "<u4").tobytes(), None])).to_pylist() == [[5, 50255], []]


def test_query_of_token_ids(spark, plain, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in queries.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = plain.encode_ordinary(text or "")
        r = found.pop(doc_id)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert not found


def test_pieces_of_all_code_points():
    """Code points that later versions made letters or numbers, all white space below U+3001, and every 29th
    other code point fall into the class that they have in the library."""
    tails = ("aa", "11", "!!", "\n\n")
    ranks = {bytes([x]): x for x in range(256)}
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 29 == 0 or byte_bpe._LATER.match(chr(c)) or c < 0x3001 and chr(c).isspace())]
    for c in points:
        for tail in tails:
            ranks.setdefault((tail + c).encode(), len(ranks))
    library = tiktoken.Encoding("points", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cut = regex.compile(public_tokenizers.PATTERN)
    for tail in tails:
        whole = [len(ids) == 1 for ids in library.encode_ordinary_batch([tail + c for c in points])]
        assert whole == [len(byte_bpe.split_pieces(cut, tail + c)) == 1 for c in points]


def test_vocabulary_faults(tmp_path, monkeypatch):
    few = tmp_path / "few"
    few.write_bytes(b"".join(base64.b64encode(bytes([x])) + b" %d\n" % x for x in range(255)))
    with pytest.raises(ValueError, match="255"):
        byte_bpe.load_vocabulary(str(few))
    few.write_bytes(few.read_bytes() + base64.b64encode(b"\xff") + b" 255\n")
    only_bytes = byte_bpe.load_vocabulary(str(few))
    assert [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.merged(only_bytes, [b"ab", b"", b"a" * 5000])] == [[97, 98], [], [97] * 5000]
    monkeypatch.setattr(byte_bpe, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="at most"):
        byte_bpe.load_vocabulary(str(few))


def plain_codes(rows):
    """{row number: (code, error, label error)} and the codebooks, by trying every entry."""
    kept = [(i, label, [math.floor(256 * Fraction(x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][2]) // 16
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][2]))[:64]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(kept[k][2], p) for k in order] for p in range(16)]
    near = lambda p, s: min((sum((a - b) ** 2 for a, b in zip(s, e)), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        for p in range(16):
            held = {}
            for _, _, v in kept:
                held.setdefault(near(p, cut(v, p))[1], []).append(cut(v, p))
            for k, parts in held.items():
                books[p][k] = [sum(x) // len(parts) for x in zip(*parts)]
    coded = []
    for i, label, v in kept:
        found = [near(p, cut(v, p)) for p in range(16)]
        coded.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = Counter()
    for _, label, _, error in coded:
        total[label] += error
    return Counter((i, code, error, total[label]) for i, label, code, error in coded), books


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("n", "spread"), [(300, 0.02), (40, 1.0), (1, 1.0), (200, 0.0)])
def test_vector_codes(spark, n, spread):
    """Few distinct components make many equal distances, of which the lower entry wins."""
    rng = random.Random(n)
    f32 = lambda x: float(np.float32(x))
    rows = [(k, [f32(rng.gauss(0, spread)) for _ in range(32)], rng.choice([None, 1, 2, 2, 2, 2])) for k in range(n)]
    rows += [rows[0], (None, rows[0][1], 1), (n + 1, None, 1), (n + 2, [None, *rows[0][1][1:]], 1), (n + 3, [math.nan, *rows[0][1][1:]], 2), (n + 4, [*rows[0][1][1:], math.inf], 2)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit(7) for c in ("id", "parts", "code", "error", "_rows")})
    found, books = vector_codes.product_codes(df)
    want, plain_books = plain_codes(rows)
    assert books.tolist() == plain_books
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in found.collect()) == want


def test_vector_codes_of_odd_tables(spark):
    found, books = vector_codes.product_codes(spark.createDataFrame([], VECTORS))
    assert found.count() == 0 and books.size == 0 and found.columns == ["vec_id", "label", "code", "error", "label_error"]
    found, books = vector_codes.product_codes(spark.createDataFrame([(None, [1.0] * 16, 1), (4, None, 1)], VECTORS))
    assert found.count() == 0 and books.size == 0
    mixed = [(2, [0.5] * 16, 1), (1, [0.5] * 5, 1), (3, [0.25] * 32, None), (4, [], 1)]
    found, _ = vector_codes.product_codes(spark.createDataFrame(mixed, VECTORS))
    assert got(found, "vec_id", "code", "error", "label_error") == [(1, None, None, 0), (2, "00" * 16, 0, 0), (3, None, None, None), (4, None, None, 0)]
    with pytest.raises(Exception, match="a vector has a component"):
        vector_codes.product_codes(spark.createDataFrame([(1, [1e9] * 16, 1)], VECTORS))


def test_nearest_of_many_points():
    rng = np.random.default_rng(3)
    for width in (1, 2, 5):
        book, points = rng.integers(-6, 6, (64, width)), rng.integers(-8, 8, (9000, width))
        number, far = vector_codes.nearest(vector_codes.Node.of(book, np.arange(64)), points)
        all_far = ((points[:, None] - book) ** 2).sum(2)
        assert (number == all_far.argmin(1)).all() and (far == all_far.min(1)).all()


def plain_ranking(rows, items, k, repeats=False):
    docs = [(i, Counter(brute.symbol_words(t))) for i, t in rows]
    some = [c for _, c in docs if c]
    n_docs, n_words = len(some), sum(c.total() for c in some)
    df = Counter(w for c in some for w in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(brute.symbol_words(text))
    out = []
    for item, words in asked.items():
        scores = []
        for i, held in docs:
            score = 0
            for w, times in words.items():
                if held[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    m = 100 - 50 + 50 * held.total() * n_docs // n_words
                    score += (times if repeats else 1) * weight * (10**9 * held[w] // (1000 * held[w] + 20 * m))
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("repeats", [False, True])
def test_ranked_search(spark, monkeypatch, repeats):
    monkeypatch.setattr(ranked_search, "ITEM_TERMS", 60)
    monkeypatch.setattr(ranked_search, "HELD_ROWS", 30)
    monkeypatch.setattr(topk_search, "SHARD", 12)
    rows = brute.corpus(seed=31, n=120)
    rows += [(5000 + k, rows[k][1]) for k in range(40)] + [(None, rows[0][1]), (6000, None), (6001, ""), (6002, "!?"), rows[5]]
    rows += [(7000, " ".join(["zz", "Zz"] * 40_000))]
    items = [(k, rows[3 * k][1]) for k in range(25)] + [(2, "further words of item 2 W1 w1"), (None, "w1 w2"), (90, None), (91, "nowhereatall"), (92, "zz zz zz")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("id", "query", "rank")})
    found = ranked_search.rank_documents(table(spark, rows, ["id", "score", "item", "block"]), asked, k=10, repeats=repeats)
    assert got(found, "item_id", "rank", "doc_id", "score") == sorted(plain_ranking(rows, items, 10, repeats), key=repr)


def test_ranked_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.rank_documents(table(spark, []), items).count() == 0
    assert ranked_search.rank_documents(table(spark, [(1, None), (2, " ")]), items).count() == 0
    assert ranked_search.rank_documents(table(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert got(ranked_search.rank_documents(table(spark, [(1, "a"), (2, "c")]), items), "item_id", "rank", "doc_id") == [(1, 1, 1)]
