"""Cross-entropy difference between a target and a background bigram model over one vocabulary.

Words and word pairs are counted one by one, under 64-bit keys, over every document: the target over
the chosen ones, the background over all others.  The two are matched: the background's counts are
scaled by target words / background words, so that smoothing weighs the same in both, and no document
is left out for it.  A document is scored without itself: its own counts are taken out of the model
that has them, so that a score tells what a text is like and not where it was counted.  With c a model's
counts then, N its words and V the distinct words of all documents,
    P(w)     = (c(w) + 1) / (N + V)
    P(w | h) = (least(c(h, w), c(h)) + PULL * P(w)) / (c(h) + PULL)
and the first word of a text has P(w); what the words after h leave of 1 is the text's end.  A document's
score is its mean loss per word under the background less that under the target.

Documents stand in chunks.  A chunk asks for each of its distinct keys once, with its own counts; the
keys are dealt out by ranges whose number follows the corpus, a range's counts are summed, and the sums
go back to the chunks that asked.  No task holds more than a chunk or a range, and a frequent word
weighs no more than one key of each chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups, small_batches, written
from .textops import BASE, BLANK, mix, pieces

#: How many words' weight the unigram model has in the bigram one.
PULL = 5.0
#: Bytes of text in a chunk, about, and keys that the chunks together ask of one range, about.
CHUNK_BYTES, RANGE_KEYS = 4 << 20, 1 << 20
#: zstd level of what is written and shuffled.
SQUEEZE = 6
_CHUNKS = "chunk long, n_words long, n_target long, body binary"
_ASKED = "bucket long, chunk long, keys binary, target binary, background binary"
_TOLD = "chunk long, bucket long, body binary, background binary"


def _batch(schema: str, *columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, all first bytes first, compressed."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(numbers).to_bytes(8, "little") + pa.Codec("zstd", SQUEEZE).compress(planes, asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.Codec("zstd").decompress(data[9:], width * n, asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _texts(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words and then of the pairs that end at each word but a text's first, which words
    are such first ones, and where each text's words begin."""
    hashes, bounds, n = [], [np.zeros(1, np.int64)], 0
    for _, _, words in pieces(texts, BLANK):
        hashes.append(words.hashes)
        bounds.append(words.offsets[1:] + n)
        n += len(words.hashes)
    h, bounds = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate(bounds)
    begins = np.zeros(n + 1, bool)
    begins[bounds] = True
    begins = begins[:-1]
    at = np.flatnonzero(~begins)
    return np.concatenate([h, mix(h[at - 1] * np.uint64(BASE) + h[at])]), begins, bounds


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
            part = batch.slice(lo, hi - lo)
            _, _, bounds = _tokens(part.column("text"))
            n = np.diff(bounds)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", SQUEEZE))) as writer:
                writer.write_batch(part)
            chosen = part.column("target").to_numpy(zero_copy_only=False)
            yield _batch(_CHUNKS, [task + made], [int(n.sum())], [int(n[chosen].sum())], [sink.getvalue().to_pybytes()])
            lo, made = hi, made + 1


def _edges(buckets: int) -> np.ndarray:
    """The first key of each range."""
    return np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)


def _asked(buckets: int):
    """What each chunk asks: its distinct keys in order, range by range, and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                texts = _texts(body.as_py())
                tokens, begins, bounds = _tokens(texts.column("text"))
                keys, which, times = np.unique(tokens, return_inverse=True, return_counts=True)
                chosen = np.repeat(texts.column("target").to_numpy(zero_copy_only=False), np.diff(bounds))
                of_target = np.bincount(which[np.concatenate([chosen, chosen[~begins]])], minlength=len(keys))
                cuts = [*np.searchsorted(keys, edges).tolist(), len(keys)]
                full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                spans = [slice(cuts[k], cuts[k + 1]) for k in full]
                steps = [_packed(np.diff(keys[s], prepend=edges[k])) for k, s in zip(full, spans)]
                yield _batch(_ASKED, full, [chunk] * len(full), steps, [_packed(of_target[s]) for s in spans], [_packed((times - of_target)[s].astype(np.uint64)) for s in spans])

    return run


def _told(buckets: int):
    """The sums over all chunks, for each chunk's keys in the order it asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for group in groups(batches, ["bucket"]):
            bucket = group["bucket"][0].as_py()
            keys = [np.cumsum(_unpacked(x.as_py()), dtype=np.uint64) + edges[bucket] for x in group["keys"]]
            ends = np.cumsum([len(k) for k in keys])[:-1]
            _, which = np.unique(np.concatenate(keys), return_inverse=True)
            told = []
            for name in ("target", "background"):
                times = np.concatenate([_unpacked(x.as_py()) for x in group[name]])
                sums = np.bincount(which, weights=times).astype(np.uint64)  # exact up to 2^53
                told.append([_packed(x) for x in np.split(sums[which], ends)])
            yield _batch(_TOLD, group["chunk"].to_pylist(), [bucket] * len(keys), *told)

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct words."""
    for batch in batches:
        for body in batch.column("body"):
            found = [words.hashes for _, _, words in pieces(_texts(body.as_py()).column("text"), BLANK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([*found, np.zeros(0, np.uint64)])).view(np.int64))], names=["word"])


def _losses(counts: np.ndarray, begins: np.ndarray, size: np.ndarray, scale: np.ndarray, vocabulary: int) -> np.ndarray:
    """-log P of each word under one model: the scaled counts of the words and then of the pairs, and for
    each word how many words the model has seen, with their scale."""
    n = len(begins)
    p = (counts[:n] + 1.0) / (size * scale + vocabulary)
    at = np.flatnonzero(~begins)
    before = counts[at - 1]
    p[at] = (np.minimum(counts[n:], before) + PULL * p[at]) / (before + PULL)
    return -np.log(p)


def _scored(sizes: list[float], vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["chunk"]):
            # the chunk's texts stand before what its ranges told
            texts = _texts(group["body"][0].as_py())
            tokens, begins, bounds = _tokens(texts.column("text"))
            _, which = np.unique(tokens, return_inverse=True)
            n, means = np.diff(bounds), []
            chosen = texts.column("target").to_numpy(zero_copy_only=False)
            # how often a word's or pair's own document has it
            text = np.repeat(np.arange(len(n)), n)
            text = np.concatenate([text, text[~begins]])
            _, spot, times = np.unique(text * (int(which.max(initial=0)) + 1) + which, return_inverse=True, return_counts=True)
            own = times[spot]
            without = [sizes[0] - np.where(chosen, n, 0), sizes[1] - np.where(chosen, 0, n)]
            both = (without[0] > 0) & (without[1] > 0)
            scales = [np.ones(len(n)), np.where(both, without[0] / np.where(both, without[1], 1), 1.0)]
            for name, mine, size, scale in zip(("body", "background"), (chosen, ~chosen), without, scales):
                told = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(x.as_py()) for x in group[name][1:])])
                counts = (told.astype(np.float64)[which] - np.where(mine[text], own, 0)) * scale[text]
                of_word = text[: len(begins)]
                total = np.concatenate([[0.0], np.cumsum(_losses(counts, begins, size[of_word], scale[of_word], vocabulary))])
                with np.errstate(invalid="ignore"):
                    means.append((total[bounds[1:]] - total[bounds[:-1]]) / n)
            target, background = (pa.array(m, from_pandas=True) for m in means)
            score = pa.array(np.nan_to_num(means[1] - means[0]))
            yield pa.RecordBatch.from_arrays([texts.column("id"), pa.array(n, pa.int64()), target, background, score], names=["id", "n_words", "loss_target", "loss_background", "score"])

    return run


def score_documents(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, loss_target, loss_background, score) for every row of docs.

    target_ids holds, in its column id_col, the documents of the target; all others are the
    background.  Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased.  A higher score is nearer to the
    target.

    Null and blank texts have no words: losses null, score 0.  Null ids are never of the target;
    repeated rows are counted and scored each, every one without itself alone; repeated or unknown target
    ids change nothing.  A model without documents is uniform, and the other one then keeps its own counts.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    chosen = target_ids.select(F.col(id_col).alias("t_id")).filter("t_id is not null").distinct().withColumn("target", F.lit(True))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the target's ids have no size bound: they are never sent whole, at no size
    marked = texts.join(chosen.hint("merge"), F.col("id") == F.col("t_id"), "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    chunks = written(marked.mapInArrow(_chunked, _CHUNKS), "chunks")
    seen = chunks.agg(F.coalesce(F.sum("n_target"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    buckets = max(1, math.ceil(2 * seen[1] / RANGE_KEYS))

    vocabulary = chunks.select("body").mapInArrow(_words, "word long").distinct().count()
    bodies = chunks.select("chunk", F.lit(-1).cast("long").alias("bucket"), "body", F.lit(None).cast("binary").alias("background"))
    asked = chunks.select("chunk", "body").mapInArrow(_asked(buckets), _ASKED).repartition("bucket").sortWithinPartitions("bucket")
    told = asked.mapInArrow(_told(buckets), _TOLD)
    met = bodies.unionByName(told).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    kind = texts.schema["id"].dataType.simpleString()
    scored = met.mapInArrow(_scored([float(seen[0]), float(seen[1] - seen[0])], vocabulary), f"id {kind}, n_words long, loss_target double, loss_background double, score double")
    return scored.withColumnRenamed("id", id_col)
