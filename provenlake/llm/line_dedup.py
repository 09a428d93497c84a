"""Line deduplication over range-partitioned hashes, as compressed per-document keep bitmaps.

Line hashes are range-partitioned with their document, so that a hot line spreads over as many
partitions as it fills, and sorted within by hash, document (largest first) and position.  Each
partition streams its rows and holds no more than one document's rows of one line.  A line that
crosses a partition's edge is settled afterwards from two small counts a partition.  Bitmaps are made
without texts in a shuffle: decisions come back as (document, position).  Rebuilding the texts
(drop_lines) shuffles them once, to their bitmaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

STRIPPED = " \t\n\x0b\x0c\r"
#: Stands for a null id in tasks, below every other one.
NO_ID = -(1 << 63)
DROPPED, OPEN, COUNT = 0, 1, 2
FOUND = "kind byte, h1 long, h2 long, id long, print long, pos long, docs long"
_FOUND = pa.schema([("kind", pa.int8())] + [(c, pa.int64()) for c in ("h1", "h2", "id", "print", "pos", "docs")])


def _hashed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, rows, pos = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for at, line in enumerate((text or "").split("\n")):
                    key = line.strip(STRIPPED)
                    if len(key) >= min_chars:
                        h = xxhash.xxh3_128_intdigest(key.encode().lower())
                        h1.append((h >> 64) - (1 << 63))
                        h2.append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                        rows.append(row)
                        pos.append(at)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), batch.column("id").take(rows), batch.column("print").take(rows), pa.array(pos, pa.int64())],
                names=["h1", "h2", "id", "print", "pos"],
            )

    return run


def _streamed(min_docs: int):
    """Rows of one partition, sorted.  Emits dropped rows; open rows of lines at the partition's
    edges that the rest of the line decides; and those lines' counts of documents."""

    def emit(kind: int, c: dict[str, np.ndarray], rows: np.ndarray) -> pa.RecordBatch:
        n = len(c["pos"][rows])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8))] + [pa.array(c[k][rows]) for k in ("h1", "h2", "id", "print", "pos")] + [pa.array(np.zeros(n, np.int64))],
            schema=_FOUND,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = None  # the partition's first line, and its documents here
        key, docs, last, most = None, 0, None, None
        held: list[pa.RecordBatch] = []  # rows of the current line that fall if it has enough documents
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            new_key = np.ones(batch.num_rows, bool)
            new_key[1:] = (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1])
            goes_on = key == (c["h1"][0], c["h2"][0])
            new_key[0] = not goes_on
            new_doc = new_key.copy()
            new_doc[1:] |= c["id"][1:] != c["id"][:-1]
            new_doc[0] |= c["id"][0] != last
            line = np.cumsum(new_key) - int(new_key[0])
            begin = np.concatenate([[0], np.flatnonzero(new_key[1:]) + 1])
            seen = np.cumsum(new_doc)
            base = seen[begin] - new_doc[begin]
            base[0] -= docs if goes_on else 0
            rank = seen - base[line]
            stop = np.append(begin[1:], batch.num_rows) - 1
            total = rank[stop]
            if edge is None:
                edge = (c["h1"][0], c["h2"][0])
                at_edge = True
            else:
                if key == edge and not goes_on:
                    yield _count(edge, docs, most)  # the first line ended with the last batch
                at_edge = goes_on and key == edge
            ends = len(begin) > 1
            if goes_on and total[0] >= min_docs:
                yield from held
            if not goes_on or ends or total[0] >= min_docs:
                held = []
            drop = (rank > 1) & (total[line] >= min_docs)
            if at_edge:
                drop &= line > 0
                yield emit(OPEN, c, line == 0)
                if ends:
                    yield _count(edge, total[0], c["id"][0] if not goes_on else most)
            yield emit(DROPPED, c, drop)
            if not (at_edge and not ends) and total[-1] < min_docs:
                held.append(emit(DROPPED, c, (rank > 1) & (line == len(begin) - 1)))
            most = c["id"][begin[-1]] if ends or not goes_on else most
            key, docs, last = (c["h1"][-1], c["h2"][-1]), int(total[-1]), c["id"][-1]
        if edge is not None:
            for rows in held:
                yield rows.set_column(0, _FOUND.field(0), pa.array(np.full(rows.num_rows, OPEN, np.int8)))
            yield _count(key, docs, most)

    return run


def _count(key: tuple, docs: int, most: int) -> pa.RecordBatch:
    values = [COUNT, *key, most, 0, 0, docs]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _FOUND)], schema=_FOUND)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bitmaps, counts = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist()):
            keep = np.ones(n, bool)
            keep[gone or []] = False
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes()))
            counts.append(len(gone or []))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("print"), batch.column("n_lines"), pa.array(counts, pa.int64()), pa.array(bitmaps, pa.binary())],
            names=["id", "print", "n_lines", "n_dropped", "keep_bitmap"],
        )


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("print", F.xxhash64("text"))


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, print, n_lines, n_dropped, keep_bitmap) for each document; see drop_lines for the rule.

    keep_bitmap is the zlib-compressed bits, first line first, of which lines stay.  print is
    xxhash64(text), which tells apart rows that share an id; equal rows have one bitmap.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 at least")
    small_batches(docs.sparkSession)
    source = _named(docs, id_col, text_col)
    lines = written(source.mapInArrow(_hashed(min_chars), "h1 long, h2 long, id long, print long, pos long"), "lines")
    dealt = lines.repartitionByRange("h1", "h2", F.desc("id")).sortWithinPartitions("h1", "h2", F.desc("id"), "print", "pos")
    found = written(dealt.mapInArrow(_streamed(min_docs), FOUND), "found")
    # two counts a range partition at most: small enough to send to every task
    counts = found.filter(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.max("id").alias("most"))
    settled = found.filter(F.col("kind") == OPEN).join(F.broadcast(counts), ["h1", "h2"]).filter((F.col("total") >= min_docs) & (F.col("id") < F.col("most")))
    gone = found.filter(F.col("kind") == DROPPED).select("id", "print", "pos").unionByName(settled.select("id", "print", "pos"))
    # equal rows hash the same lines twice
    gone = gone.groupBy("id", "print").agg(F.collect_set("pos").alias("gone"))
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = source.select("id", "print", n_lines.cast("long").alias("n_lines")).distinct()
    return rows.join(gone, ["id", "print"], "left").mapInArrow(_packed, "id long, print long, n_lines long, n_dropped long, keep_bitmap binary")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, bits in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist()):
            lines = text.split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
            texts.append("\n".join(line for line, k in zip(lines, keep.tolist()) if k))
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns(["keep_bitmap"])


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with their other columns, text_col without repeated lines, and n_lines and n_dropped.

    A text splits at \\n.  A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z
    lower-cased.  Keys of min_chars code points or more that stand in min_docs documents or more lose
    all their lines except in the largest id that holds them.

    A null text is empty and comes back as ''; an empty text is one empty line.  A null id counts as
    one id below all others.  Rows that share an id are one document: all of them keep what the
    largest id keeps.  Equal rows are all returned.  An empty table gives an empty result.  Columns
    of docs called n_lines or n_dropped are replaced.
    """
    rows = docs.drop(*{"n_lines", "n_dropped"} - {id_col, text_col})
    bitmaps = line_keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    others = [c for c in rows.columns if c != text_col]
    keyed = rows.select(F.struct(*others).alias("others"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    joined = keyed.join(bitmaps, ["id", "print"]).select("others", "text", "n_lines", "n_dropped", "keep_bitmap")
    shape = joined.drop("keep_bitmap").schema
    out = joined.mapInArrow(_rebuilt, shape)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("others")[c].alias(c) for c in rows.columns], "n_lines", "n_dropped")
