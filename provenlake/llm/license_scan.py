"""Exact set-similarity join of text blocks with license templates, and base phrases.

A block is a window of consecutive words, across line ends: twice as many words as the longest template
has, one beginning every as many, so that every notice lies whole in one.  Its set is its distinct
words.  A block meets a template when it holds at least `percent` of the template's words, unless it
meets another one by as large a share whose words there are these and more.  Words of no template cannot add to an overlap, so sets are cut
to the templates' words, ordered by how many documents of the whole corpus hold each, rarest first.
A block and a template can only meet if the block holds a word of the template's prefix
(all but the overlap still needed), has enough words (length filter), and enough are left on both
sides from the first shared word on (positional filter); the rest is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textops import SYMBOLS, Words, pieces

#: Phrases of the base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices in common use, one label each.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "all-rights-reserved": "All rights reserved",
}


def _hashes(text: str) -> list[int]:
    return [int(h) for _, _, words in pieces(pa.array([text]), SYMBOLS) for h in words.hashes]


class Vocabulary:
    """The words of templates and phrases: sorted hashes, and each template's and phrase's numbers."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.hashes = np.unique(np.array([h for t in [*templates, *phrases] for h in _hashes(templates.get(t, t))], np.uint64))
        number = {int(h): k for k, h in enumerate(self.hashes)}
        self.stride = max([len(_hashes(t)) for t in templates.values()], default=1)
        self.templates = {label: sorted({number[h] for h in _hashes(text)}) for label, text in templates.items()}
        self.phrases = {tuple(number[h] for h in _hashes(p)): label for p, label in phrases.items()}

    def numbers(self, words: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hashes, at, -1)


def _document_counts(vocabulary: Vocabulary):
    size = len(vocabulary.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, words in pieces(batch.column("text"), SYMBOLS):
                numbers = vocabulary.numbers(words)
                hit = np.flatnonzero(numbers >= 0)
                owner = np.searchsorted(words.offsets, hit, "right") - 1
                held += np.bincount(np.unique(owner * size + numbers[hit]) % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(held)], names=["word", "docs"])

    return run


class Index:
    """Inverted index of template prefixes under the corpus' order of words."""

    def __init__(self, vocabulary: Vocabulary, docs: np.ndarray, percent: int):
        self.rank = np.empty(len(docs), np.int64)
        self.rank[np.lexsort((np.arange(len(docs)), docs))] = np.arange(len(docs))
        self.sets, self.needed, self.prefix = [], [], {}
        for label, members in vocabulary.templates.items():
            ranked = sorted(self.rank[members].tolist())
            need = max(1, math.ceil(percent * len(ranked) / 100))
            for i, r in enumerate(ranked[: len(ranked) - need + 1]):
                self.prefix.setdefault(r, []).append((len(self.sets), i))
            self.sets.append((label, ranked, frozenset(ranked)))
            self.needed.append(need)
        self.rare = np.zeros(len(docs), bool)
        self.rare[list(self.prefix)] = True

    def meets(self, block: list[int]) -> Iterator[tuple[str, float]]:
        """Templates that the block, distinct ranks in order, meets; with the share it holds."""
        met = self._tried(block)
        for label, share, words in met:
            if not any(words < more and share <= other for _, other, more in met):
                yield label, share

    def _tried(self, block: list[int]) -> list[tuple[str, float, frozenset]]:
        tried, met = set(), []
        for j, r in enumerate(block):
            for t, i in self.prefix.get(r, ()):
                if t in tried:
                    continue
                tried.add(t)
                label, ranked, members = self.sets[t]
                need = self.needed[t]
                if len(block) < need or min(len(ranked) - i, len(block) - j) < need:
                    continue
                shared = members.intersection(block)
                if len(shared) >= need:
                    met.append((label, len(shared) / len(ranked), shared))
        return met


def _scanned(vocabulary: Vocabulary, index: Index, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_base, first, last, base, found, best = [], [], [], [], [], [], []
            for _, _, words in pieces(batch.column("text"), SYMBOLS):
                size = len(words.offsets) - 1
                numbers = vocabulary.numbers(words)
                starts = [[] for _ in range(size)]
                labels: list[set] = [set() for _ in range(size)]
                more: list[dict] = [{} for _ in range(size)]
                for phrase, label in vocabulary.phrases.items():
                    n = max(0, len(numbers) - len(phrase) + 1)
                    at = np.flatnonzero(np.logical_and.reduce([numbers[k : k + n] == w for k, w in enumerate(phrase)]))
                    owner = np.searchsorted(words.offsets, at, "right") - 1
                    inside = at + len(phrase) <= words.offsets[owner + 1]
                    for doc, where in zip(owner[inside].tolist(), at[inside].tolist()):
                        starts[doc].append(where - int(words.offsets[doc]))
                        labels[doc].add(label)
                hit = np.flatnonzero(numbers >= 0)
                ranks = index.rank[numbers[hit]]
                doc_of = np.searchsorted(words.offsets, hit, "right") - 1
                # a word stands in the block that begins in its stretch and in the one before
                stretch = (hit - words.offsets[doc_of]) // vocabulary.stride
                early = np.flatnonzero(stretch > 0)
                block_of = np.concatenate([stretch, stretch[early] - 1])
                doc_of, ranks = np.concatenate([doc_of, doc_of[early]]), np.concatenate([ranks, ranks[early]])
                order = np.lexsort((block_of, doc_of))
                doc_of, block_of, ranks = doc_of[order], block_of[order], ranks[order]
                changed = (doc_of[1:] != doc_of[:-1]) | (block_of[1:] != block_of[:-1])
                cuts = np.concatenate([[0], np.flatnonzero(changed) + 1]) if len(hit) else np.zeros(0, np.int64)
                rare = np.add.reduceat(index.rare[ranks].astype(int), cuts) if len(hit) else cuts
                stops = np.append(cuts[1:], len(ranks))
                for k in np.flatnonzero(rare).tolist():
                    block = np.unique(ranks[cuts[k] : stops[k]]).tolist()
                    kept = more[int(doc_of[cuts[k]])]
                    for label, share in index.meets(block):
                        kept[label] = max(share, kept.get(label, 0.0))
                n_words += np.diff(words.offsets).tolist()
                n_base += [len(s) for s in starts]
                first += [min(s, default=None) for s in starts]
                last += [max(s, default=None) for s in starts]
                base += [",".join(sorted(x)) for x in labels]
                found += [",".join(sorted(x | set(m))) for x, m in zip(labels, more)]
                best += [max([1.0 if s else 0.0, *m.values()]) for s, m in zip(starts, more)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col)] + [pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)] + [pa.array(x, pa.string()) for x in (base, found)] + [pa.array(best, pa.float64())],
                names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, percent: int = 80
) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased.  n_base counts the places
    where a phrase's words stand one after the other; first_word and last_word are the smallest and
    largest start of one, null without any.  labels adds those of templates whose words a block holds
    by percent or more.  score is the largest share of a template that a block holds, of those that
    meet it, or 1 where a base phrase stands; else 0.

    A null text is empty: no words, empty labels, score 0.  Null and repeated ids come back as they
    are, one row for each.  Nothing is shuffled but the templates' words and their counts, whose number
    the templates bound.  An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    vocabulary = Vocabulary(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    held = np.zeros(len(vocabulary.hashes), np.int64)
    for word, count in texts.select("text").mapInArrow(_document_counts(vocabulary), "word long, docs long").groupBy("word").agg(F.sum("docs")).collect():
        held[word] = count
    index = Index(vocabulary, held, percent)
    kind = texts.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return texts.mapInArrow(_scanned(vocabulary, index, id_col), shape)
