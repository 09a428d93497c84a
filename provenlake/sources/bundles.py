"""Sealed bundles: folders of files whose digests are listed and folded into one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .files import whole_files

SUMS, SET_ASIDE = "SHA256SUMS", "deviations"
#: Files that hold their own hash, and where: it counts as PENDING when they are hashed.
PENDING = "sha256:pending"
SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"
#: The form in which such a file is written again.
DUMP = {"allow_unicode": True, "default_flow_style": False, "indent": 2, "sort_keys": False}
SELF_HASHED = {"audit_config.yaml": ("config_hash",), "bundle_manifest.yaml": ("bundle", "bundle_hash")}


@pandas_udf(StringType())
def pending_digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """SHA-256 of a self-hashed YAML file, written again in a fixed form with its own hash pending;
    null where the file has no such field."""
    import yaml

    def digest(name: str, content: bytes) -> str | None:
        try:
            data = yaml.safe_load(content.decode())
        except (yaml.YAMLError, UnicodeDecodeError):
            return None
        *way, last = SELF_HASHED[name]
        holder = data
        for step in way:
            holder = holder.get(step) if isinstance(holder, dict) else None
        if not isinstance(holder, dict):
            return None
        holder[last] = PENDING
        text = yaml.safe_dump(data, **DUMP)
        return hashlib.sha256(text.encode()).hexdigest()

    for names, contents in batches:
        yield pd.Series([digest(n, c) for n, c in zip(names, contents)], dtype=object)


def bundle_files(spark: SparkSession, root: str) -> DataFrame:
    """(bundle_id, file, digest, content) of every file below root, which holds one folder a bundle.

    bundle_id is the folder's name, file the path inside it, digest the SHA-256 of the bytes in hex.
    Files lying in root itself belong to no bundle and are left out.
    """
    rows = whole_files(spark, root, recursive=True)
    # the scan's paths may carry a scheme and a host that root does not
    bare = re.sub(SCHEME, "", root).rstrip("/") + "/"
    inside = F.get(F.split(F.regexp_replace("path", SCHEME, ""), re.escape(bare), 2), F.lit(1))
    rows = rows.select(F.split(inside, "/", 2).alias("p"), "content").filter(F.size("p") == 2)
    return rows.select(F.col("p")[0].alias("bundle_id"), F.col("p")[1].alias("file"), F.sha2("content", 256).alias("digest"), "content")


def sealed(file: Column) -> Column:
    """Whether a file counts for the seal: not the list of digests, nothing set aside."""
    parts = F.split(file, "/")
    return (F.element_at(parts, -1) != SUMS) & ~F.array_contains(parts, SET_ASIDE)


def folded_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bundle_id, tree_hash, bad) of rows sorted by bundle and path: a digest's state streams over a
    bundle's rows; bad counts files without a digest."""
    bundle, state, bad, begun = None, hashlib.sha256(), 0, False

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([f"sha256:{state.hexdigest()}"]), pa.array([bad], pa.int64())], names=["bundle_id", "h", "bad"])

    for batch in batches:
        for b, file, digest in zip(*(batch.column(c).to_pylist() for c in ("bundle_id", "file", "digest"))):
            if begun and b != bundle:
                yield told()
                state, bad = hashlib.sha256(), 0
            bundle, begun = b, True
            bad += digest is None
            state.update(f"{file}\0{digest}\n".encode())
    if begun:
        yield told()


def tree_hashes(files: DataFrame) -> DataFrame:
    """(bundle_id, tree_hash) over bundle_files; null where a self-hashed file cannot be read."""
    own = F.when(F.col("file").isin(*SELF_HASHED), F.lit(True)).otherwise(F.lit(False))
    rows = files.filter(sealed(F.col("file"))).withColumn("own", own)
    # only the few self-hashed files go to Python
    plain = rows.filter(~F.col("own")).select("bundle_id", "file", "digest")
    again = rows.filter("own").select("bundle_id", "file", pending_digest("file", "content").alias("digest"))
    rows = plain.unionByName(again).withColumn("parts", F.split("file", "/")).repartition("bundle_id").sortWithinPartitions("bundle_id", "parts").drop("parts")
    # a digest is a chain, so one bundle is one task's; it holds no more than the digest's state
    whole = rows.mapInArrow(folded_lines, "bundle_id string, h string, bad long")
    return whole.select("bundle_id", F.when(F.col("bad") == 0, F.col("h")).alias("tree_hash"))


def listed_digests(files: DataFrame) -> DataFrame:
    """(bundle_id, file, listed) of the lines of each bundle's list of digests; blank lines are left
    out, and a line of another form has a null listed."""
    lines = files.filter(F.col("file") == SUMS).select("bundle_id", F.explode(F.split(F.col("content").cast("string"), "\r?\n")).alias("line"))
    form = r"^([0-9a-f]{64})\s+\*?(.+)$"
    named = F.when(F.col("line").rlike(form), F.regexp_extract("line", form, 2)).otherwise(F.col("line"))
    return lines.filter(F.trim("line") != "").select("bundle_id", named.alias("file"), F.when(F.col("line").rlike(form), F.regexp_extract("line", form, 1)).alias("listed"))


def seal_faults(files: DataFrame) -> DataFrame:
    """(bundle_id, file, fault) for each file whose listing does not hold.

    fault is 'no list' (a bundle without one), 'malformed line', 'path escapes', 'listed twice',
    'missing file', 'not listed' or 'digest differs'; the first that fits.
    """
    present = files.filter(sealed(F.col("file"))).select("bundle_id", "file", "digest")
    listed = listed_digests(files).groupBy("bundle_id", "file").agg(F.max("listed").alias("listed"), F.count("*").alias("n"))
    both = listed.withColumn("in_list", F.lit(True)).join(present, ["bundle_id", "file"], "full_outer")
    escapes = F.startswith("file", F.lit("/")) | F.array_contains(F.split("file", "/"), "..")
    fault = (
        F.when(F.col("in_list").isNull(), F.lit("not listed"))
        .when(F.col("listed").isNull(), F.lit("malformed line"))
        .when(escapes, F.lit("path escapes"))
        .when(F.col("n") > 1, F.lit("listed twice"))
        .when(F.col("digest").isNull(), F.lit("missing file"))
        .when(F.col("digest") != F.col("listed"), F.lit("digest differs"))
    )
    with_list = files.filter(F.col("file") == SUMS).select("bundle_id").distinct()
    none = files.select("bundle_id").distinct().join(with_list, "bundle_id", "left_anti").select("bundle_id", F.lit(SUMS).alias("file"), F.lit("no list").alias("fault"))
    found = both.join(with_list, "bundle_id", "left_semi").select("bundle_id", "file", fault.alias("fault")).filter("fault is not null")
    return found.unionByName(none)
