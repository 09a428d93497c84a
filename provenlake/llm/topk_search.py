"""Exact BM25 top-k with block-max WAND, per shard, merged under global statistics.

The corpus is tokenised once, into a written index of shards: postings by word over some thousand
documents, which stand in the order of their length.  Document counts, the number of documents and
their mean length come from all shards.  Queries go to the tasks in rounds of bounded size.

For a query the words of a shard are split as WAND's pivot does: frequent words whose bounds together
stay under a part of the threshold are put aside, and only the postings of the others are opened.  A
block of documents is then left out where what its documents have so far, and the largest that the
words put aside reach in that block, stays under the threshold; the documents that are left are
scored in full.  The threshold is the k-th best score so far.  Shards are searched in three steps, each from
the thresholds of those before, so that no task begins with none and few scores leave a task that the
merge does not need.  The merge of the tasks' lists is exact.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_hot, small_batches, written
from .textops import SYMBOLS, pieces

K1, B = 1.2, 0.75
#: Words of a block, about; documents and words after which a shard is closed.
BLOCK, SHARD, SHARD_WORDS = 4096, 8192, 1 << 23
#: Words that one document in so many holds have block maxima.
FREQUENT = 64
#: Words of queries sent at once, digits of a score.
SENT_WORDS, DIGITS = 1 << 20, 6
#: Rounds whose jobs run side by side; the driver holds the queries of so many.
ROUNDS_AT_ONCE = 2
#: Shares of the shards that are searched by the end of the first steps; the last step takes the rest,
#: and each starts from the thresholds of those before.
STEPS = (1 / 64, 1 / 6)
#: Share of the threshold that words put aside may reach together.
ASIDE = 0.5
SLACK = 10.0**-DIGITS
#: Covers what sums in single precision may lose.
ROUNDED_UP = 1 + 1e-4

_INDEX = "docs long, words long, ids binary, lengths binary, named binary, terms binary, held binary, doc binary, times binary"
_HITS = "query long, id long, score double"


def _bytes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in one, two, four or eight bytes each, as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.zeros(0, np.uint8)


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo .. hi-1, one after the other."""
    width = hi - lo
    return np.arange(width.sum()) + np.repeat(lo - (np.cumsum(width) - width), width)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, named, hashes, lengths = [], [], [], []

    def close() -> pa.RecordBatch:
        size = np.concatenate(lengths)
        order = np.argsort(size, kind="stable")
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(size))
        terms, number = np.unique(np.concatenate(hashes), return_inverse=True)
        key, times = np.unique(number * len(size) + np.repeat(place, size), return_counts=True)
        term, doc = np.divmod(key, len(size))
        row = [[len(size)], [int(size.sum())], [np.concatenate(ids)[order].tobytes()], [_bytes(size[order])], [np.concatenate(named)[order].tobytes()]]
        row += [[terms.tobytes()], [_bytes(np.bincount(term, minlength=len(terms)))], [_bytes(doc)], [_bytes(times)]]
        for x in (ids, named, hashes, lengths):
            x.clear()
        kinds = {"long": pa.int64(), "binary": pa.binary()}
        fields = [f.split() for f in _INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for v, (_, kind) in zip(row, fields)], names=[name for name, _ in fields])

    for batch in batches:
        own = batch.column("id")
        flags, own = own.is_valid().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy()
        for lo, hi, words in pieces(batch.column("text"), SYMBOLS):
            ids.append(own[lo:hi])
            named.append(flags[lo:hi])
            hashes.append(words.hashes)
            lengths.append(np.diff(words.offsets))
            if sum(map(len, ids)) >= SHARD or sum(map(len, hashes)) >= SHARD_WORDS:
                yield close()
    if ids:
        yield close()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each shard hold each word."""
    for batch in batches:
        for terms, held in zip(batch.column("terms").to_pylist(), batch.column("held").to_pylist()):
            words = np.frombuffer(terms, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(_numbers(held, len(words)).astype(np.int64))], names=["word", "docs"])


def _query_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        id_list = batch.column("id").to_numpy()
        for lo, hi, words in pieces(batch.column("text"), SYMBOLS):
            terms, number = np.unique(words.hashes, return_inverse=True)
            owner = np.repeat(np.arange(hi - lo), np.diff(words.offsets))
            key, times = np.unique(owner * len(terms) + number, return_counts=True)
            owner, number = np.divmod(key, max(1, len(terms)))
            yield pa.RecordBatch.from_arrays([pa.array(id_list[lo + owner]), pa.array(terms[number].view(np.int64)), pa.array(times.astype(np.int64))], names=["query", "word", "times"])


@dataclass
class Queries:
    """A round of queries: distinct word hashes, each query's word numbers and weights from `first`
    on, and the score under which nothing of it counts."""

    hashes: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    number: np.ndarray
    weight: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Queries:
        hashes, number = np.unique(rows["word"].to_numpy().view(np.uint64), return_inverse=True)
        owner = rows["query"].to_numpy()
        order = np.lexsort((number, owner))
        ids, first = np.unique(owner[order], return_index=True)
        return cls(hashes, ids, np.append(first, len(order)), number[order].astype(np.int32), rows["weight"].to_numpy()[order], np.zeros(len(ids)))


class Shard:
    """Postings of a shard by word and by document, and the block maxima of its frequent words."""

    def __init__(self, row: dict, mean_length: float):
        n = row["docs"]
        self.ids, self.named = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.held = _numbers(row["held"], len(self.terms)).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.held)])
        doc, times = (_numbers(row[c], self.begin[-1]) for c in ("doc", "times"))
        self.doc = doc.astype(np.int64)
        norm = K1 * (1 - B + B * _numbers(row["lengths"], n) / mean_length)
        self.part = times * (K1 + 1) / (times + norm[self.doc])
        self.most = np.maximum.reduceat(self.part, self.begin[:-1]) if len(self.terms) else np.zeros(0)
        # by document, words in the order of their hashes: equal documents add up alike in any shard
        order = np.argsort(doc, kind="stable")
        self.doc_term = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.held)[order]
        self.doc_part = self.part[order]
        self.doc_begin = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])
        # documents stand in the order of their length: short ones share a block, a long one has its own
        _, self.block = np.unique(np.cumsum(_numbers(row["lengths"], n), dtype=np.int64) // BLOCK, return_inverse=True)
        blocks = int(self.block[-1]) + 1
        frequent = np.flatnonzero(self.held * FREQUENT >= n)
        spots = _spread(self.begin[frequent], self.begin[frequent + 1])
        cell = np.repeat(np.arange(len(frequent)) * blocks, self.held[frequent]) + self.block[self.doc[spots]]
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        peaks = np.zeros(len(frequent) * blocks, np.float32)
        if len(starts):
            peaks[cell[starts]] = np.maximum.reduceat(self.part[spots], starts) * ROUNDED_UP
        self.peaks = peaks.reshape(len(frequent), blocks)
        self.peak_row = np.full(len(self.terms), -1)
        self.peak_row[frequent] = np.arange(len(frequent))
        self.weights = np.zeros(len(self.terms))

    def locate(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash among the shard's words, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search(self, at: np.ndarray, weight: np.ndarray, k: int, floor: float, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of floor or more among `best` and this shard; at and weight are
        the query's words that the shard holds."""
        least = max(floor, best[0][-1]) if len(best[0]) == k else floor
        bound = weight * self.most[at]
        if bound.sum() < least - SLACK:
            return best
        rows = self.peak_row[at]
        ranked = np.flatnonzero(rows >= 0)
        ranked = ranked[np.argsort(bound[ranked] / self.held[at[ranked]])]
        aside = ranked[: np.searchsorted(np.cumsum(bound[ranked]), ASIDE * least)]
        opened = np.ones(len(at), bool)
        opened[aside] = False
        lo, hi = self.begin[at[opened]], self.begin[at[opened] + 1]
        spots = _spread(lo, hi)
        reach = np.bincount(self.doc[spots], np.repeat(weight[opened], hi - lo) * self.part[spots], minlength=len(self.ids))
        if len(aside):
            reach += (weight[aside].astype(np.float32) @ self.peaks[rows[aside]])[self.block]
        found = np.flatnonzero((reach >= max(least - SLACK, SLACK / 2)) & self.named)
        found = found[np.argsort(-reach[found], kind="stable")] if len(found) > 4 * k else found
        self.weights[at] = weight
        while len(found):
            # the likeliest documents first: they raise the threshold for the others
            some, found = found[: 4 * k], found[4 * k :]
            if len(best[0]) == k:
                some = some[reach[some] >= best[0][-1] - SLACK]
                if not len(some):
                    break
            best = self._better(some, k, floor, best)
            if len(best[0]) == k:
                found = found[reach[found] >= best[0][-1] - SLACK]
                best = self._better(found, k, floor, best) if len(found) else best
                break
        self.weights[at] = 0
        return best

    def _better(self, docs: np.ndarray, k: int, floor: float, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        total = np.empty(len(docs))
        for x, (lo, hi) in enumerate(zip(self.doc_begin[docs].tolist(), self.doc_begin[docs + 1].tolist())):
            total[x] = (self.weights[self.doc_term[lo:hi]] * self.doc_part[lo:hi]).sum()
        total = np.round(total, DIGITS)
        hit = np.flatnonzero(total >= max(floor, SLACK))
        score, ids = np.concatenate([best[0], total[hit]]), np.concatenate([best[1], self.ids[docs[hit]]])
        first = np.lexsort((ids, -score))[:k]
        return score[first], ids[first]


def _searched(queries: Queries, mean_length: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries.ids)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, mean_length)
                at = shard.locate(queries.hashes)[queries.number]
                known = at >= 0
                first = np.concatenate([[0], np.cumsum(known)])[queries.first].tolist()
                at, weight = at[known], queries.weight[known]
                for q, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
                    if lo < hi:
                        best[q] = shard.search(at[lo:hi], weight[lo:hi], k, queries.floor[q], best[q])
        n = [len(s) for s, _ in best]
        score, ids = (np.concatenate([np.zeros(0), *x]) for x in zip(*best)) if best else (np.zeros(0), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries.ids, n)), pa.array(ids.astype(np.int64)), pa.array(score)], names=["query", "id", "score"])

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "doc_id", query_text_col: str = "text") -> DataFrame:
    """(query_id, rank, id_col, score): for each query the k documents of the highest BM25 scores.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased, and compared by 64-bit
    hashes.  A query's word weighs its count there times ln(1 + (N - n + 0.5) / (n + 0.5)); k1 is 1.2
    and b 0.75.  Scores are rounded to six digits; among equal ones the smaller id comes first.  Fewer
    than k rows come back where fewer documents share a word with the query.

    Null and empty texts count as documents of no words and match nothing; queries of that kind have
    no rows.  Rows with a null id count in the statistics but are neither results nor queries.
    Documents that share an id are separate results with that id; queries that share one are taken as
    one query, and queries of equal words are searched once.  Empty tables give an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # a shard is a row, and its hash says in which step it is searched
    index = written(texts.mapInArrow(_indexed, _INDEX).withColumn("shard", F.xxhash64("ids", "lengths") / 2.0**64), "index")
    corpus = index.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    counted = index.select("terms", "held").mapInArrow(_held, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    asked = queries.select(F.col(query_id_col).cast("long").alias("id"), F.col(query_text_col).alias("text")).filter("id is not null")
    asked = written(asked.mapInArrow(_query_words, "query long, word long, times long").groupBy("query", "word").agg(F.sum("times").alias("times")), "asked")
    # of queries with equal words, each as often, one is searched for all
    prints = asked.groupBy("query").agg(F.bit_xor(F.xxhash64("word", "times")).alias("x1"), F.bit_xor(F.xxhash64("word", "times", F.lit(1))).alias("x2"), F.count("*").alias("n"))
    prints = written(prints, "prints")
    alike = written(prints.groupBy("x1", "x2", "n").agg(F.min("query").alias("first"), F.count("*").alias("rows")), "alike")
    idf = F.log1p((F.lit(corpus.docs) - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    weighed = asked.join(alike.select(F.col("first").alias("query")), "query").join(counted, "word")
    weighed = written(weighed.select("query", "word", (F.col("times") * idf).alias("weight")), "queries")
    mean_length = max(corpus.words, 1) / max(corpus.docs, 1)
    rounds = max(1, math.ceil(weighed.count() / SENT_WORDS))

    steps = index.agg(F.percentile_approx("shard", list(STEPS))).first()[0] or []
    steps = sorted(set(steps))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    def searched(turn: int) -> DataFrame:
        sent, had = Queries.of(weighed.filter(F.pmod(F.xxhash64("query"), F.lit(rounds)) == turn).toArrow()), None
        for above, upto in zip([None, *steps], [*steps, None]):
            part = index if above is None else index.filter(F.col("shard") > above)
            part = part if upto is None else part.filter(F.col("shard") <= upto)
            hits = written(part.mapInArrow(_searched(sent, mean_length, k), _HITS), "hits")
            had = hits if had is None else had.unionByName(hits)
            if upto is not None:
                kth = had.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
                floors = {r["query"]: r["score"] for r in kth.select("query", "score").collect()}
                sent.floor = np.array([floors.get(q, 0.0) for q in sent.ids.tolist()])
        return had

    # a round's first step has few shards: the next round's jobs take the cores that it leaves
    with ThreadPoolExecutor(ROUNDS_AT_ONCE) as pool:
        found = functools.reduce(DataFrame.unionByName, pool.map(searched, range(rounds)))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    lists = ranked.groupBy(F.col("query").alias("first")).agg(F.collect_list(F.struct("rank", "id", "score")).alias("best"))
    total = prints.count()
    named = join_hot(prints, alike, ["x1", "x2", "n"], "rows", total).select("query", "first")
    full = join_hot(named, lists.join(alike.select("first", "rows"), "first"), ["first"], "rows", total).select("query", F.inline("best"))
    return full.select(F.col("query").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias(id_col), "score")
