"""MinHash near-duplicates with sequential Bayesian verification.

Documents become sets of word shingles, compared by 64-bit hashes; equal sets collapse into one class,
so exact copies cost one node.  Banded MinHash keys propose candidates.  In blocks of one bucket's members, candidates are
compared batch after batch of signature bytes; after each batch a pair is dropped once the
posterior probability that its similarity reaches the threshold is below the chosen miss
probability.  Survivors are gathered into candidate clusters, and every pair of a cluster is then
verified on the full sets, in blocks of bounded size.  Only spanning links leave a task, never the
pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import groups, join_hot, merge_sets, small_batches, written
from .textops import BLANK, mix, pieces, shingle_sets

#: Signature values compared between two looks at the posterior.
BATCH = 32


def plan_bands(threshold: float, miss: float) -> tuple[int, int, int]:
    """(rows of a band, bands, signature length): a pair at the threshold shares no band with
    probability below miss."""
    rows = max(2, round(math.log(0.42) / math.log(threshold)))
    bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
    return rows, bands, -(-max(128, rows * bands) // BATCH) * BATCH


def fewest_matches(length: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on) after each batch.  With a uniform prior, m matches
    of n leave the similarity at or above t with probability P(Bin(n + 1, t) <= m)."""
    t = threshold + (1 - threshold) / 256  # signatures keep one byte of each minimum
    looks = []
    for n in range(BATCH, length + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        looks.append((n, m))
    return looks


def _hash_family(length: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(2 * length, dtype=np.uint64))
    return seeds[:length, None] | np.uint64(1), seeds[length:, None]


def _features(k: int, rows: int, bands: int, length: int):
    schema = pa.schema(
        [("id", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, shift = _hash_family(length)
        lane = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            sizes, prints, keys, sigs = [], [], [], []
            for _, _, words in pieces(batch.column("text"), BLANK):
                for found in shingle_sets(words, k):
                    sizes.append(len(found))
                    prints.append((np.bitwise_xor.reduce(mix(found)), np.add.reduce(mix(found ^ np.uint64(rows)))) if len(found) else (0, 0))
                    if not len(found):
                        keys.append([])
                        sigs.append(b"")
                        continue
                    least = np.full(length, ~np.uint64(0))
                    for at in range(0, len(found), 1024):
                        np.minimum(least, ((found[at : at + 1024] * scale + shift) >> np.uint64(32)).min(axis=1), out=least)
                    rolled = lane.copy()
                    for r in range(rows):
                        rolled = mix(rolled ^ least[r : rows * bands : rows])
                    keys.append(rolled.view(np.int64))
                    sigs.append(mix(least).astype(np.uint8).tobytes())
            prints = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text").cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                schema=schema,
            )

    return run


def _candidates(looks: list[tuple[int, int]], top: int, bottom: int):
    """Spanning links among the pairs of a block that pass every look and the length filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "i", "j"]):
            ids, n = group["rep"].to_numpy(), group["n"].to_numpy()
            order = np.argsort(ids)
            ids, n = ids[order], n[order]
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            left, right = [], []
            for x in range(len(ids) - 1):
                y = np.arange(x + 1, len(ids))
                y = y[bottom * np.minimum(n[x], n[y]) >= top * np.maximum(n[x], n[y])]
                matches, done = np.zeros(len(y), np.int64), 0
                for upto, least in looks:
                    if not len(y):
                        break
                    matches = matches + (sig[y, done:upto] == sig[x, done:upto]).sum(axis=1)
                    stay = matches >= least
                    y, matches, done = y[stay], matches[stay], upto
                left += [x] * len(y)
                right += y.tolist()
            yield _links(ids, np.array(left, np.int64), np.array(right, np.int64))

    return run


def _links(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    root = merge_sets(len(ids), left, right)
    own = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[root[own]]), pa.array(ids[own])], names=["a", "b"])


def _verified(k: int, top: int, bottom: int):
    """Spanning links among the pairs of a block whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["cluster", "i", "j"]):
            ids = group["rep"].to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            sets = [s for _, _, words in pieces(group["text"], BLANK) for s in shingle_sets(words, k)]
            sets = [sets[x] for x in order]
            if len(sets) == 2:
                both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                hit = bottom * both >= top * (len(sets[0]) + len(sets[1]) - both)
                yield _links(ids, np.zeros(int(hit), np.int64), np.ones(int(hit), np.int64))
                continue
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            _, token = np.unique(np.concatenate(sets), return_inverse=True)
            by_token = np.argsort(token, kind="stable")
            bound = np.concatenate([[0], np.cumsum(np.bincount(token))])
            posted = owner[by_token]
            left, right = [], []
            at = np.concatenate([[0], np.cumsum(sizes)])
            for x in range(len(sets) - 1):
                mine = token[at[x] : at[x + 1]]
                lo, hi = bound[mine], bound[mine + 1]
                width = hi - lo
                spots = np.arange(width.sum()) + np.repeat(lo - (np.cumsum(width) - width), width)
                both = np.bincount(posted[spots], minlength=len(sets))
                y = np.flatnonzero(bottom * both >= top * (sizes[x] + sizes - both))
                y = y[y > x]
                left += [x] * len(y)
                right += y.tolist()
            yield _links(ids, np.array(left, np.int64), np.array(right, np.int64))

    return run


def _blocks(df: DataFrame, group: str, parts, batch_rows_by: str = "rep") -> DataFrame:
    """Each row once for every pair of its group's parts that its own part is in."""
    return (
        df.withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64(batch_rows_by), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .drop("parts", "part", "other")
        .repartition(group, "i", "j")
        .sortWithinPartitions(group, "i", "j")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    miss: float = 1e-6,
    block_docs: int = 512,
    block_shingles: int = 1 << 18,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of shingles of
    words [^\\x20\\x09-\\x0D]+, A-Z lower-cased.  component_id is the least id that can be reached;
    kept marks the row's id as that one.

    Null or blank texts have no shingles: n_shingles 0, linked with nothing, their own component.
    Rows with a null id take no part: component_id null, kept true.  Rows that share an id are one
    document and share a component.  An empty table gives an empty result; other columns are ignored.

    Links are missed with at most about 2 * miss each, by the banding and by the posterior bound; no
    pair is reported that the full sets do not confirm.  A group's near copies are compared in blocks
    of at most 2 * block_docs signatures, and candidate clusters are verified in blocks of about
    2 * block_shingles shingles, so neither a bucket nor a cluster has to fit in one task.
    """
    small_batches(docs.sparkSession)
    threshold = percent / 100
    rows, bands, length = plan_bands(threshold, miss)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = written(
        source.mapInArrow(_features(shingle_words, rows, bands, length), "id long, text string, n long, f1 long, f2 long, bands array<long>, sig binary").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "features",
    )
    sets = features.filter("n > 0 and id is not null")
    # a class is known by one of its rows, so that repeated rows and ids count once
    classes = written(sets.groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "row")).alias("o"), F.count("*").alias("rows")).select("f1", "f2", "n", F.col("o.id").alias("least"), F.col("o.row").alias("rep"), "rows"), "classes")
    total = features.count()
    holders = written(join_hot(sets.select("id", "n", "f1", "f2"), classes.select("f1", "f2", "n", "rep", "rows"), ["f1", "f2", "n"], "rows", total).select("id", "n", "rep"), "holders")
    reps = sets.select("row", "n", "bands", "sig").join(classes.select(F.col("rep").alias("row")), "row").withColumnRenamed("row", "rep")

    keys = reps.select("rep", "n", F.explode("bands").alias("key"))
    buckets = (
        keys.groupBy("key")
        .agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2"))
        .filter("c > 1")
        .groupBy("c", "x1", "x2")  # bands that propose the same members are compared once
        .agg(F.min("key").alias("key"))
        .select("key", "c")
    )
    members = keys.join(buckets, "key").join(reps.select("rep", "sig"), "rep")
    proposed = _blocks(members, "key", F.ceil(F.col("c") / block_docs)).select("key", "i", "j", "rep", "n", "sig")
    coarse = connected_components(proposed.mapInArrow(_candidates(fewest_matches(length, threshold, miss), percent, 100), "a long, b long"))

    coarse = coarse.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    sized = coarse.join(classes.select("rep", "n"), "rep")
    parts = sized.groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    parts = join_hot(sized, parts, ["cluster"], "members", total).select("rep", "cluster", F.ceil(F.col("total") / block_shingles).alias("pieces"))
    texts = features.select(F.col("row").alias("rep"), "text").join(written(parts, "clusters"), "rep")
    exact = _blocks(texts, "cluster", F.col("pieces")).select("cluster", "i", "j", "rep", "text")
    alike = exact.mapInArrow(_verified(shingle_words, percent, 100), "a long, b long")
    # the classes of one id belong together, whatever their sets
    several = holders.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("id", "a")
    links = connected_components(alike.unionByName(holders.join(several, "id").select("a", F.col("rep").alias("b"))))

    joined = classes.join(links.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "least", "rows", F.coalesce("component", "rep").alias("node"))
    least = joined.groupBy("node").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    found = written(join_hot(joined, least, ["node"], "members", total).select("rep", "rows", "component"), "components")
    full = join_hot(holders, found, ["rep"], "rows", total).select("id", "n", "component")
    blank = features.filter("n = 0 and id is not null").select("id", "n")
    theirs = holders.join(blank.select("id").distinct(), "id", "left_semi").join(found, "rep").groupBy("id").agg(F.min("component").alias("component"))
    rest = blank.join(theirs, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    unnamed = features.filter("id is null").select("id", "n", F.lit(None).cast("long").alias("component"))
    return full.unionByName(rest).unionByName(unnamed).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
    )
