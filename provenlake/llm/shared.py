"""What the operators of this subpackage share: written tables and grouped streaming in tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of one Arrow batch sent to a Python task; long texts make row counts a poor bound.
ARROW_BYTES, ARROW_ROWS = 16 << 20, 4000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where a local session names none.  On a
    cluster a machine's own folder would be seen by no other one, so that raises ValueError."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = tempfile.mkdtemp(prefix="provenlake-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts the lineage, so that a
    lost executor never replays the work before it, and lets later readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, by bytes and by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


#: Keys that count as hot: those with more rows than this, and never more of them than HOT_KEYS.
HOT_ROWS, HOT_KEYS = 1024, 50_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """left joined with right, which has one row a key and in the column `rows` how many of left's
    `total` rows have it.  Hot keys, whose number that total bounds, are joined by sending their rows of
    right to where left's lie, the others by a shuffle: no task gathers a hot key's rows."""
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = right.filter(F.col(rows) > most)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.filter(F.col(rows) <= most), on)
    return left.join(F.broadcast(hot), on).unionByName(rest).drop(rows)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them.  The caller bounds a
    group's size; a group may span batches."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cuts = _cuts(held, keys)
        for lo, hi in zip(cuts[:-2], cuts[1:-1]):
            yield held.slice(lo, hi - lo)
        held = held.slice(cuts[-2])
    if held is not None and held.num_rows:
        yield held


def _cuts(table: pa.Table, keys: list[str]) -> list[int]:
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for key in keys:
        column = table[key].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return [*np.flatnonzero(changed).tolist(), table.num_rows]


def merge_sets(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each one's set after all links left[i]-right[i], for 0 .. size-1."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.fromiter((find(x) for x in range(size)), np.int64, size)
