"""Product codes of vectors: one small codebook for each part of a vector, by rounds of nearest entries.

Components are integers, so that sums and distances are the same in any order of the rows.  Each round
broadcasts a kd-tree for every codebook; their size follows from the codebooks alone.  A task finds the
nearest entry of each part by branch and bound, for all its vectors at once: a node is left out only where
its box lies farther than the best entry so far, so that equal ones are still met and the lower index
wins.  It sums the parts of each entry; the integer sums of all tasks are added by a grouping and make
the next entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, small_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf, and vectors that descend together.
LEAF, TOGETHER = 4, 4096
#: Integer components are smaller than this, so that no sum of squares leaves 64 bits.
LARGEST = 1 << 26


@dataclass
class Node:
    """A box around some entries: its bounds, and either its two halves or the entries themselves,
    whose numbers rise."""

    low: np.ndarray
    high: np.ndarray
    numbers: np.ndarray
    entries: np.ndarray
    halves: tuple[Node, Node] | None

    @classmethod
    def of(cls, book: np.ndarray, numbers: np.ndarray) -> Node:
        entries = book[numbers]
        low, high = entries.min(0), entries.max(0)
        axis = int(np.argmax(high - low))
        if len(numbers) <= LEAF or low[axis] == high[axis]:
            return cls(low, high, numbers, entries, None)
        order = np.argsort(entries[:, axis], kind="stable")
        cut = len(order) // 2
        return cls(low, high, numbers, entries, (cls.of(book, np.sort(numbers[order[:cut]])), cls.of(book, np.sort(numbers[order[cut:]]))))

    def bound(self, points: np.ndarray) -> np.ndarray:
        """The squared distance of each point to the box."""
        off = np.maximum(np.maximum(self.low - points, points - self.high), 0)
        return (off * off).sum(1)

    def visit(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, number: np.ndarray) -> None:
        """Betters `best` and `number` of the points in `rows` by this node's entries."""
        if not len(rows):
            return
        some = points[rows]
        if self.halves is None:
            off = some[:, None, :] - self.entries
            distance = (off * off).sum(2)
            first = distance.argmin(1)
            least, at = distance[np.arange(len(rows)), first], self.numbers[first]
            better = (least < best[rows]) | ((least == best[rows]) & (at < number[rows]))
            best[rows[better]], number[rows[better]] = least[better], at[better]
            return
        one, two = self.halves
        to_one, to_two = one.bound(some), two.bound(some)
        near = to_one <= to_two
        one.visit(points, rows[near], best, number)
        two.visit(points, rows[~near], best, number)
        # equal bounds are visited: an entry as near as the best may have a lower number
        two.visit(points, rows[near & (to_two <= best[rows])], best, number)
        one.visit(points, rows[~near & (to_one <= best[rows])], best, number)


def nearest(tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each point's nearest entry; of equal ones the lower number."""
    best, number = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(points) and np.iinfo(np.int64).max)
    for lo in range(0, len(points), TOGETHER):
        tree.visit(points, np.arange(lo, min(lo + TOGETHER, len(points))), best, number)
    return number, best


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector has no null and no component that is not finite, as integers."""
    for batch in batches:
        lists = batch.column("vector")
        lists = lists.filter(lists.is_valid()) if lists.null_count else lists
        rest = pa.RecordBatch.from_arrays([c.filter(batch.column("vector").is_valid()) for c in batch.columns], names=batch.schema.names)
        flat, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
        broken = np.bincount(np.repeat(np.arange(len(size)), size), ~np.isfinite(values), minlength=len(size)) > 0
        values = np.floor(np.where(np.repeat(broken, size), 0.0, values) * SCALE)
        if len(values) and np.abs(values).max() >= LARGEST:
            raise ValueError(f"a vector has a component of {LARGEST // SCALE} or more")
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values.astype(np.int32)))
        columns = [rest.column(c) for c in rest.schema.names if c != "vector"]
        names = [c for c in rest.schema.names if c != "vector"]
        yield pa.RecordBatch.from_arrays([*columns, parts], names=[*names, "parts"]).filter(pa.array(~broken))


def _points(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have vectors of the length, their parts: vector, part, component)."""
    lists = batch.column("parts")
    fits = lists.value_lengths().to_numpy(zero_copy_only=False) == length
    flat = lists.filter(pa.array(fits)).flatten().to_numpy().astype(np.int64)
    return fits, flat.reshape(-1, PARTS, length // PARTS)


def _sums(shared, length: int, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = length // PARTS
        total, used = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            _, points = _points(batch, length)
            for part, tree in enumerate(shared.value):
                number, _ = nearest(tree, points[:, part])
                np.add.at(total[part], number, points[:, part])
                used[part] += np.bincount(number, minlength=entries)
        part, entry, at = np.nonzero(np.broadcast_to(used[:, :, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[part, entry, at]), pa.array(used[part, entry])],
            names=["part", "entry", "at", "total", "used"],
        )

    return run


def _codes(shared, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, points = _points(batch, length)
            numbers, error = np.zeros((len(points), PARTS), np.uint8), np.zeros(len(points), np.int64)
            for part, tree in enumerate(shared.value):
                number, far = nearest(tree, points[:, part])
                numbers[:, part] = number
                error += far
            digits = numbers.tobytes().hex()
            code, errors = np.full(len(fits), None, object), np.full(len(fits), None, object)
            code[fits] = [digits[k : k + 2 * PARTS] for k in range(0, len(digits), 2 * PARTS)]
            errors[fits] = error.tolist()
            names = [c for c in batch.schema.names if c != "parts"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(code, pa.string()), pa.array(errors, pa.int64())], names=[*names, "code", "error"])

    return run


def _label_key(column: str) -> list[Column]:
    """A label as two columns without nulls, so that rows without one meet."""
    return [F.col(column).isNull().alias("_none"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_label")]


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((id_col, label_col, code, error, label_error), codebooks): each vector's code, and the codebooks
    as an array of part, entry and component, which is empty where no vector is left.

    Rows whose vector is null or holds a null or non-finite component are left out.  A component x
    becomes floor(256 * x); vectors are cut into 16 parts.  The first entries are those of the 64 rows of
    the smallest ids (of equal ids, the smaller vectors); fewer rows make fewer entries, and rows
    without an id are coded but make none, unless no row has an id: then there are no entries and the
    result is empty.  Two rounds replace each entry by the floor of the mean of the parts nearest to
    it; an unused one stays.  Repeated rows count as often as they stand there.

    The code has two hex digits a part, `error` is the squared distance summed over the parts, and
    `label_error` the errors summed over the rows of a label; rows without a label are together.  All
    vectors are expected to be as long as that of the smallest id which is a multiple of 16; longer and
    shorter ones get a null code and error.  A component of 2^18 or more raises ValueError.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    kept = written(rows.mapInArrow(_whole, f"{kinds}, parts array<int>"), "vectors")
    usable = kept.filter(f"id is not null and size(parts) > 0 and size(parts) % {PARTS} = 0")
    first = usable.orderBy("id", "parts").limit(1).collect()
    length = len(first[0].parts) if first else PARTS
    start = [r.parts for r in usable.filter(F.size("parts") == length).orderBy("id", "parts").limit(ENTRIES).collect()]
    books = np.array(start, np.int64).reshape(len(start), PARTS, length // PARTS).transpose(1, 0, 2).copy()
    named = [F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"]
    if not len(start):
        empty = kept.limit(0).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"))
        return empty.select(*named), books

    def trees():
        return spark.sparkContext.broadcast([Node.of(book, np.arange(len(book))) for book in books])

    for _ in range(ROUNDS):
        sums = kept.select("parts").mapInArrow(_sums(trees(), length, len(start)), "part int, entry int, at int, total long, used long")
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("used").alias("used")).collect():
            books[r.part, r.entry, r.at] = r.total // r.used
    coded = written(kept.mapInArrow(_codes(trees(), length), f"{kinds}, code string, error long"), "codes").select("*", *_label_key("label"))
    errors = coded.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows"))
    return join_hot(coded, errors, ["_none", "_label"], "_rows", coded.count()).select(*named), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
