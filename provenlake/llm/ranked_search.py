"""Ranked lexical search as a product of sparse integer matrices, in blocks.

One matrix has the multiplicity of each term in each item, times the term's weight; the other one the
impact of each term in each document.  The documents are tokenised once, into a written index: a row is a
block of the second matrix, some thousand documents with their postings by term.  Blocks of the first
matrix are rows too, of bounded size, made by a grouping; terms' counts over all documents give the
weights.  Every pair of blocks is multiplied in a task: an item's row is the merge of its terms' posting
rows, Gustavson's way, into one row of 64-bit sums, of which the k best are kept.  Tasks keep the best of
the blocks they see; the rest is a ranking of those rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_hot, small_batches, written
from .topk_search import _INDEX, _held, _indexed, _numbers, _query_words, _spread

#: Entries of a block of items, about, and result rows that a task holds before it gives them away.
ITEM_TERMS, HELD_ROWS = 1 << 17, 1 << 20

_ITEMS = "block long, item array<long>, word array<long>, weight array<long>"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each block have a term, and all their terms."""
    for batch in batches:
        some = [int((_numbers(x, n) > 0).sum()) for x, n in zip(batch.column("lengths").to_pylist(), batch.column("docs").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), batch.column("words")], names=["docs", "words"])


class Best:
    """The k best (score, id) of each item so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.held = k, {}, 0

    def add(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        had = self.rows.get(item)
        if had is not None:
            self.held -= len(had[0])
            score, ids = np.concatenate([had[0], score]), np.concatenate([had[1], ids])
        first = np.lexsort((ids, -score))[: self.k]
        self.rows[item] = score[first], ids[first]
        self.held += len(first)

    def taken(self) -> pa.RecordBatch:
        items = np.repeat(np.fromiter(self.rows, np.int64, len(self.rows)), [len(s) for s, _ in self.rows.values()])
        score, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.rows.values()))
        self.rows, self.held = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(items.astype(np.int64)), pa.array(ids), pa.array(score)], names=["item", "id", "score"])


def _multiplied(n_docs: int, n_words: int, k: int):
    def block_product(row: dict, best: Best) -> None:
        ids, named = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool)
        terms = np.frombuffer(row["terms"], np.uint64)
        if not len(terms):
            return
        begin = np.concatenate([[0], np.cumsum(_numbers(row["held"], len(terms)).astype(np.int64))])
        doc, times = (_numbers(row[c], begin[-1]) for c in ("doc", "times"))
        word = np.array(row["word"], np.int64).view(np.uint64)
        at = np.minimum(np.searchsorted(terms, word), len(terms) - 1)
        known = terms[at] == word
        # the rows of the second matrix that the items ask for, one after the other
        asked, place = np.unique(at[known], return_inverse=True)
        spots = _spread(begin[asked], begin[asked + 1])
        lo = np.concatenate([[0], np.cumsum(begin[asked + 1] - begin[asked])])
        doc, tf = doc[spots].astype(np.int64), times[spots].astype(np.int64)
        size, which = np.unique(_numbers(row["lengths"], row["docs"]), return_inverse=True)
        spread = np.array([100 - 50 + 50 * n * n_docs // n_words for n in size.tolist()], np.int64)[which]
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * spread[doc])
        item, weight = np.array(row["item"], np.int64)[known], np.array(row["weight"], np.int64)[known]
        total = np.zeros(len(ids), np.int64)
        cuts = [*np.flatnonzero(np.diff(item, prepend=item[:1] - 1)).tolist(), len(item)]
        start, end = lo[place].tolist(), lo[place + 1].tolist()
        for first, last in zip(cuts[:-1], cuts[1:]):
            total[:] = 0
            for x in range(first, last):
                total[doc[start[x] : end[x]]] += weight[x] * impact[start[x] : end[x]]
            hit = np.flatnonzero((total > 0) & named)
            if len(hit) > k:
                score = total[hit]
                hit = hit[score >= np.partition(score, len(hit) - k)[len(hit) - k]]
            if len(hit):
                best.add(int(item[first]), total[hit], ids[hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for row in batch.to_pylist():
                block_product(row, best)
                if best.held > HELD_ROWS:
                    yield best.taken()
        if best.rows:
            yield best.taken()

    return run


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, repeats: bool = False,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_col, rank, id_col, score): each item's k documents of the highest scores above 0.

    Terms are the runs of letters and digits of ASCII and of all other characters, A-Z lower-cased, and
    are compared by 64-bit hashes.  With N the documents that have a term, L all their terms, n one
    document's, df the documents that hold a term and tf its occurrences, a term weighs
    floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is 50 + (50 * n * N) div L, and a score sums
    weight * ((10^9 * tf) div (1000 * tf + 20 * m)) over the item's terms: once each, or with `repeats`
    as often as the item has them.  Equal scores stand by ascending id.

    Null and empty texts have no terms: such documents are no results and such items have none.
    Documents with a null id count in the statistics but are no results; items with a null id are left
    out.  Documents that share an id are results of their own; items that share one are one item with
    the terms of all.  Empty tables give an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    index = written(texts.mapInArrow(_indexed, _INDEX), "lexical")
    corpus = index.select("docs", "words", "lengths").mapInArrow(_sizes, "docs long, words long").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n_docs, n_words = corpus.docs or 0, corpus.words or 0

    asked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).filter("id is not null")
    asked = asked.mapInArrow(_query_words, "query long, word long, times long").groupBy("query", "word").agg((F.sum("times") if repeats else F.lit(1).cast("long")).alias("times"))
    asked = written(asked, "items")
    in_items = asked.groupBy("word").agg(F.count("*").alias("rows"))
    held = index.select("terms", "held").mapInArrow(_held, "word long, docs long").join(in_items, "word", "left_semi").groupBy("word").agg(F.sum("docs").alias("docs"))
    weight = F.floor(1000 * F.log((F.lit(float(2 * n_docs + 2)) / (2 * F.col("docs") + 1))))
    weights = in_items.join(held, "word").select("word", "rows", weight.alias("weight"))
    entries = asked.count()
    blocks = max(1, math.ceil(entries / ITEM_TERMS))
    left = join_hot(asked, weights, ["word"], "rows", entries).select("query", "word", (F.col("times") * F.col("weight")).alias("weight"))
    row = F.sort_array(F.collect_list(F.struct("query", "word", "weight")))
    left = left.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(row.alias("row"))
    left = left.select("block", F.col("row.query").alias("item"), F.col("row.word").alias("word"), F.col("row.weight").alias("weight"))
    left = written(left, "item_blocks")

    # every block of items meets every block of documents, which is the product; no row of texts does
    found = index.crossJoin(left).mapInArrow(_multiplied(n_docs, n_words, k), "item long, id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
