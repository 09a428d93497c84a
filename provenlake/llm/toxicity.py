"""Toxicity by non-negative positive-unlabelled learning.

The classifier is logistic on hashed word presence.  It is trained from confirmed toxic texts and
unlabelled ones with the class-prior-corrected risk
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),
whose gradient is turned round while the second part is negative.  Training reads a bounded sample;
every document is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written
from .textops import SYMBOLS, pieces

#: Bits of a word's feature number.
BITS = 20
#: Beside the labels 0 and 1.
UNLABELLED = 2


@dataclass
class Model:
    """Weights of the features that are used, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(1 << BITS)
        dense[self.features] = self.weights
        out = []
        for _, _, words in pieces(texts, SYMBOLS):
            w = dense[_features(words.hashes)]
            total = np.concatenate([[0.0], np.cumsum(_first_of_each(words) * w)])
            out.append(self.bias + total[words.offsets[1:]] - total[words.offsets[:-1]])
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _first_of_each(words) -> np.ndarray:
    """1 where a word's feature stands in its text for the first time."""
    owner = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    first = np.zeros(len(words.hashes))
    first[np.unique(owner << BITS | _features(words.hashes), return_index=True)[1]] = 1
    return first


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 on division by 3.  A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, _, words in pieces(batch.column("text"), SYMBOLS):
            found += [np.unique(_features(words.of(k))).astype(np.int32).tobytes() for k in range(len(words.offsets) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), pa.array(found, pa.binary())], names=["id", "kind", "features"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 10_000, steps: int = 1500, train_bytes: int = 256 << 20) -> Model:
    """Trains on at most train_rows labelled rows and as many unlabelled ones, of each those with the
    smallest xxhash64(id), and in that order only as long as the words' features take train_bytes
    together: the bounds of what the driver gathers.  Of rows that share an id one counts, that of the
    smallest features as bytes.  Labelled rows of label 1 are the positives; the unlabelled texts are all sampled ones, those that labels does not name and, whatever
    their label, those that it does.  The class prior is the share of label 1 in the labelled
    sample.  Equal texts count once.

    Held-out rows and rows with a null id or label are not used.  A label repeated for an id counts
    once, as 1 if any row says so.  Without a single positive, or without unlabelled rows, the model
    gives every text the same score, below one half.
    """
    small_batches(docs.sparkSession)
    order = [F.xxhash64("id"), F.col("id")]
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("kind")).orderBy(*order).limit(train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = labels.select(F.col(id_col).alias("id")).filter("id is not null")
    open_ids = texts.select("id").filter(F.col("id").isNotNull() & ~held_out(F.col("id"))).join(named, "id", "left_anti").distinct()
    unlabelled = open_ids.withColumn("kind", F.lit(UNLABELLED)).orderBy(*order).limit(train_rows)
    # the bounded samples are sent to where the texts are
    sample = texts.join(F.broadcast(chosen.unionByName(unlabelled)), "id").select("id", "kind", "text")
    kind = texts.schema["id"].dataType.simpleString()
    sets = sample.mapInArrow(_sets, f"id {kind}, kind int, features binary")
    sets = written(sets.groupBy("id").agg(F.min("kind").alias("kind"), F.min("features").alias("features")), "sample")
    sizes = sets.select(F.xxhash64("id").alias("place"), F.length("features").alias("size")).collect()
    upto, total = None, 0
    for r in sorted(sizes):
        total += r.size
        if total > train_bytes:
            break
        upto = r.place
    # copies of one text would make all its words look telling; the driver takes one part at a time
    found: dict[int, set[bytes]] = {0: set(), 1: set(), UNLABELLED: set()}
    if upto is not None:
        for r in sets.filter(F.xxhash64("id") <= upto).select("kind", "features").toLocalIterator():
            found[r.kind].add(bytes(r.features))
    by_kind = {kind: sorted(found.pop(kind)) for kind in (0, 1, UNLABELLED)}
    labelled = by_kind[0] + by_kind[1]
    prior = len(by_kind[1]) / max(1, len(labelled))
    sets = [[np.frombuffer(x, np.int32) for x in part] for part in (by_kind[1], by_kind[UNLABELLED] + labelled)]
    return train(*sets, prior, steps)


def risk_slopes(scores: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The negative part of the risk, and the descent's slope at each score: that of the whole risk, or,
    while the negative part is below zero, that of its opposite.  Rows that are not positive are
    unlabelled.  Losses are logistic: loss(+) = -log s, loss(-) = -log(1 - s)."""
    p, u = positive.sum(), (~positive).sum()
    s = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    negative = -np.log1p(-np.minimum(s, 1 - 1e-12))
    rest = negative[~positive].mean() - prior * negative[positive].mean()
    d_rest = np.where(positive, -prior * s / p, s / u)
    d_up = np.where(positive, prior * (s - 1) / p, 0.0)
    return float(rest), d_up + d_rest if rest >= 0 else -d_rest


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 1500, rate: float = 0.1, decay: float = 1e-7) -> Model:
    """Full-batch training on feature sets.  Features enter when positives hold them more often than
    unlabelled texts do at five standard errors, in three positives or more: rare words that one
    class happens to hold say nothing."""
    p, u = len(positives), len(unlabelled)
    if not p or not u or not 0 < prior < 1:
        return Model(np.zeros(0, np.int64), np.zeros(0), -2.0)
    sets, n = [*positives, *unlabelled], p + u
    positive = np.arange(n) < p
    in_p, in_u = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for part, held in ((positives, in_p), (unlabelled, in_u)):
        for one in part:  # a text's features are distinct
            held[one] += 1
    # only few features are held by three positives: the rest is not laid out in doubles
    may = np.flatnonzero(in_p >= 3)
    in_p, in_u = in_p[may].astype(np.int64), in_u[may].astype(np.int64)
    # one text more of each feature: what no sampled text holds is not held for impossible
    share = (in_u + 1) / (u + 2)
    z = (in_p / p - share) / np.sqrt(share * (1 - share) / p)
    used = may[(z > 5) & (in_p / p > 2 * share)]
    where = np.full(1 << BITS, -1, np.int32)
    where[used] = np.arange(len(used))
    # only the features that are used are laid out together
    kept = [c[c >= 0] for c in (where[one] for one in sets)]
    column, row = np.concatenate(kept).astype(np.int64), np.repeat(np.arange(n), [len(c) for c in kept])
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        _, slope = risk_slopes(b + np.bincount(row, w[column], minlength=n), positive, prior)
        g = np.append(np.bincount(column, slope[row], minlength=len(used)) + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(used, w, float(b))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column score, from 0 to 1: the higher, the likelier toxic.  A null or empty text
    gets the score of no words at all.  A column of docs called score is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score") if "score" not in (id_col, text_col) else docs
    shape = docs.withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("score", pa.array(model.scores(batch.column(text_col)), pa.float64()))

    return docs.mapInArrow(run, shape.schema)
