"""Whole jobs where a shortcut would lose something."""

import random

import pytest

from provenlake.llm import lm_score, near_dup, queries

from . import brute
from .test_documents import table


def test_lm_scores_of_many_words(spark, monkeypatch):
    """Tens of thousands of words keep counts of their own, and ranges are many."""
    monkeypatch.setattr(lm_score, "RANGE_KEYS", 10_000, raising=False)
    rng = random.Random(11)
    rows = [(k, " ".join(f"v{rng.randrange(60_000)}" for _ in range(200))) for k in range(300)] + [(900, "")]
    target = {k for k in range(0, 300, 3)}
    found = lm_score.score_documents(table(spark, [*rows, rows[-1]]), spark.createDataFrame([(k,) for k in target], "doc_id long")).collect()
    want = brute.lm_scores(rows, target)
    assert len(found) == 302
    assert all(r.n_words == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-9) for r in found)


def test_near_duplicates_of_repeated_rows(spark):
    """A table joined with itself has the links that it has once; rows of one id belong together."""
    rng = random.Random(12)
    rows = []
    for k in range(0, 200, 2):
        words = [f"p{rng.randrange(5000)}" for _ in range(60)]
        rows += [(k, " ".join(words)), (k + 1, " ".join([*words[:-1], "changed"]))]
    twice = near_dup.near_duplicates(table(spark, rows * 2), shingle_words=3, percent=85).collect()
    assert len(twice) == 400 and all(r.component_id == r.doc_id // 2 * 2 and r.kept == (r.doc_id % 2 == 0) for r in twice)
    mixed = [(1, "a b c d"), (3, "A b c d"), (3, "e f g h"), (7, "e f g h"), (7, None), (9, "q r s t")]
    found = near_dup.near_duplicates(table(spark, mixed), shingle_words=3).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (3, 1), (3, 1), (7, 1), (7, 1), (9, 9)]


def test_every_source_is_mixed(spark, tmp_path):
    """Sources without a target of their own keep to equal shares, less than one block apart."""
    names = [f"src{k}" for k in range(12)] + [None]
    rows = [(k, names[k % 13]) for k in range(13 * 64 * 8)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op9_mix_sources(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    blocks = {}
    for r in out:
        blocks.setdefault(r.mix_slot, set()).add(r.source)
    assert sorted(blocks) == list(range(len(blocks))) and all(len(b) == 1 for b in blocks.values())
    order = [next(iter(b)) for _, b in sorted(blocks.items())]
    weights = {s: queries.SOURCE_WEIGHTS.get(s, 1) for s in names}
    first_end = min(max(t for t, s in enumerate(order) if s == name) for name in names)
    assert sum(weights.values()) == 24 and first_end > 24
    for t in range(1, first_end + 1):
        assert all(abs(order[:t].count(s) - t * w / 24) < 1 for s, w in weights.items())
