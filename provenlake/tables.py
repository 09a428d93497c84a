"""Tables that a job settles before it goes on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; one of fewer file parts than the session has cores is dealt out over them, a
    larger one stays as it lies."""
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def _shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="provenlake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet to the folder of spark.checkpoint.dir and read back: what
    follows reads the columns it needs as often as it likes, and a lost executor replays nothing before
    them.  The files go when the session's JVM ends.

    Only a local session that names no folder gets a temporary one; on a cluster that raises ValueError.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task may have where a job deals rows out by its own count of them: parts put together by
#: their bytes hold ever more rows, as equal texts shrink well.  A task sorts them in some 100 to 200 MB.
ROWS_A_TASK = 100_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """In how many parts so many rows are dealt out; no fewer than the session's shuffles make, or a join
    would deal them out anew."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def once_a_text(df: DataFrame, text_col: str, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(text_col, ...): what found() tells of the distinct texts of df, settled, so that a text that many
    rows have is read once.  df itself is read, too: settle it first where that is dear."""
    return settled(found(df.select(text_col).distinct()))


def with_texts(df: DataFrame, told: DataFrame, text_col: str) -> DataFrame:
    """df with what once_a_text() told of its texts; null is a text like others.  Columns of df that are
    called like told's are replaced.  Few texts go to every task, many are joined by a shuffle."""
    own = told.withColumnRenamed(text_col, "_text")
    kept = df.drop(*[c for c in told.columns if c != text_col])
    return kept.join(own, F.col(text_col).eqNullSafe(F.col("_text")), "left").drop("_text")
