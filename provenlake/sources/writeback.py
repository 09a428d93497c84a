"""Audited bundles: copies of sealed ones with the results in their claims, sealed again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..operators.verdict import audit_notes, contract_verdict
from ..tables import settled
from .bundles import DUMP, SUMS, bundle_files, sealed, tree_hashes
from .named_files import overlaps, write_named

#: The fields of a claim's audit block, in order.
BLOCK = ("audit_run_id", "audited_at_utc", "audit_support_verdict", "audit_confidence", "audit_notes", "false_caution_flag", "deviation_flag", "deviation_notes")
MANIFEST = "bundle_manifest.yaml"
#: Rows of a list of digests that make one piece of its file.
LIST_ROWS = 4096


@pandas_udf(StringType())
def _with_fields(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A YAML mapping written again with fields (a JSON object) put into the mapping under a name."""
    import json

    import yaml

    def put(text: str, under: str, fields: str) -> str:
        data = yaml.safe_load(text)
        data.setdefault(under, {})
        data[under].update(json.loads(fields))
        return yaml.safe_dump(data, **DUMP)

    for texts, names, fields in batches:
        yield pd.Series([put(*row) for row in zip(texts, names, fields)], dtype=object)


@pandas_udf(StringType())
def _indented(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON texts with an indent of two, non-ASCII characters as they are, and a line end."""
    import json

    for texts in batches:
        yield pd.Series([json.dumps(json.loads(t), indent=2, ensure_ascii=False) + "\n" for t in texts], dtype=object)


def trace_files(traces: DataFrame, name: Column) -> DataFrame:
    """traces(claim_id, ..., nested as in sources.traces) with `file`, of the given name, and `content`,
    the trace's JSON file; nulls are written."""
    fields = [c for c in traces.columns if c != "bundle_id"]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return traces.select("*", name.alias("file"), _indented(text).alias("content"))


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines 'digest  file' of each bundle, some thousand to a piece, from rows sorted by bundle and
    path: no list is held whole."""
    bundle, lines, piece = None, [], 0

    def flush() -> pa.RecordBatch:
        text = "".join(lines).encode()
        return pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([SUMS]), pa.array([piece], pa.int64()), pa.array([text], pa.binary())], names=["bundle_id", "file", "piece", "content"])

    for batch in batches:
        for b, file, digest in zip(*(batch.column(c).to_pylist() for c in ("bundle_id", "file", "digest"))):
            if lines and (b != bundle or len(lines) >= LIST_ROWS):
                yield flush()
                piece = piece + 1 if b == bundle else 0
                lines = []
            bundle = b
            lines.append(f"{digest}  {file}\n")
    if lines:
        yield flush()


def resealed(files: DataFrame) -> DataFrame:
    """(bundle_id, file, piece, content): files(bundle_id, file, content) of bundles with the manifest's
    bundle hash and the list of digests made anew.  A configuration's own hash stays as it is."""
    held = settled(files.select("bundle_id", "file", F.sha2("content", 256).alias("digest"), "content").filter(F.col("file") != SUMS))
    own = tree_hashes(held)
    manifest = held.filter(F.col("file") == MANIFEST).join(own, "bundle_id")
    fields = F.to_json(F.struct(F.col("tree_hash").alias("bundle_hash")))
    manifest = manifest.select("bundle_id", "file", _with_fields(F.col("content").cast("string"), F.lit("bundle"), fields).cast("binary").alias("content"))
    whole = held.filter(F.col("file") != MANIFEST).select("bundle_id", "file", "content").unionByName(manifest)
    listed = whole.filter(sealed(F.col("file"))).select("bundle_id", "file", F.sha2("content", 256).alias("digest"), F.split("file", "/").alias("parts"))
    listed = listed.repartition("bundle_id").sortWithinPartitions("bundle_id", "parts").drop("parts")
    lists = listed.mapInArrow(_digest_lists, "bundle_id string, file string, piece long, content binary")
    return whole.withColumn("piece", F.lit(0).cast("long")).unionByName(lists)


def audited_files(files: DataFrame, results: DataFrame, audit_run_id: str, audited_at_utc: str, traces: DataFrame | None = None) -> DataFrame:
    """The files of the bundles of results, with each claim's audit block filled, sealed again.

    results has bundle_id, claim_id and the block's fields from audit_support_verdict on; a claim that
    is not in it keeps its file byte for byte.  traces(bundle_id, file, content) are further files.  A
    run id or time of blanks raises ValueError, a result without a file claims/<claim_id>.yaml
    FileNotFoundError.
    """
    for name, value in (("audit_run_id", audit_run_id), ("audited_at_utc", audited_at_utc)):
        if not value.strip():
            raise ValueError(f"{name} must be non-blank")
    fields = [F.lit(audit_run_id).alias(BLOCK[0]), F.lit(audited_at_utc).alias(BLOCK[1]), *BLOCK[2:]]
    block = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    file = F.concat(F.lit("claims/"), "claim_id", F.lit(".yaml"))
    blocks = settled(results.select("bundle_id", file.alias("file"), block.alias("block")))
    lost = blocks.join(files, ["bundle_id", "file"], "left_anti").select("bundle_id", "file").limit(1).collect()
    if lost:
        raise FileNotFoundError(f"{lost[0].bundle_id} has no {lost[0].file}")
    wanted = files.join(blocks.select("bundle_id").distinct(), "bundle_id", "left_semi").join(blocks, ["bundle_id", "file"], "left")
    kept = wanted.filter("block is null").select("bundle_id", "file", "content")
    filled = wanted.filter("block is not null").select("bundle_id", "file", _with_fields(F.col("content").cast("string"), F.lit("audit"), F.col("block")).cast("binary").alias("content"))
    out = kept.unionByName(filled)
    if traces is not None:
        new = traces.select("bundle_id", "file", F.col("content").cast("binary").alias("content"))
        out = out.join(new, ["bundle_id", "file"], "left_anti").unionByName(new)
    return resealed(out)


def write_audited(spark: SparkSession, root: str, out: str, results: DataFrame, audit_run_id: str, audited_at_utc: str, traces: DataFrame | None = None) -> None:
    """Copies the bundles of results from below root to folders below out, audited and sealed again.

    out is made afresh, and holds nothing where there is no result; it may not be root or lie in it
    (ValueError).  The bundles below root stay as they are, and a job that fails leaves out as it was.
    """
    if overlaps(out, root):
        raise ValueError("the output must not be the source or inside it")
    files = audited_files(bundle_files(spark, root), results, audit_run_id, audited_at_utc, traces)
    write_named(files.withColumn("file", F.concat_ws("/", "bundle_id", "file")), out, fresh=True)


def lexical_results(assessments: DataFrame) -> DataFrame:
    """Assessments of audit.audit_bundles in the form of write_audited."""
    notes = F.when(F.trim("explanation") != "", F.col("explanation")).otherwise("No explanation recorded.")
    return assessments.select(
        "bundle_id", "claim_id", F.col("support_label").alias("audit_support_verdict"), F.col("support_signal").alias("audit_confidence"), notes.alias("audit_notes"),
        "false_caution_flag", "deviation_flag", "deviation_notes",
    )


def trace_results(traces: DataFrame, claims: DataFrame) -> DataFrame:
    """Traces(bundle_id, ..., as sources.traces reads them) and their claims(bundle_id, claim_id,
    scaffold_support_status) in the form of write_audited."""
    from ..operators.rules import deviation_notes, material_deviation

    v = F.col("verdict")
    flags = F.coalesce(v["audit_flags"], F.array().cast("array<string>"))
    cb = contract_verdict(v["support_verdict"], flags)
    rows = traces.join(claims.select("bundle_id", "claim_id", F.col("scaffold_support_status").alias("s")), ["bundle_id", "claim_id"])
    notes = audit_notes(F.col("claim_id"), v["support_verdict"], v["support_verdict_reason"], flags, F.col("support_signal.label"), F.col("support_signal.max_entailment_score"), v["audit_confidence"])
    return rows.select(
        "bundle_id", "claim_id", cb.alias("audit_support_verdict"), F.col("support_signal.max_entailment_score").alias("audit_confidence"), notes.alias("audit_notes"),
        F.array_contains(flags, "false_caution").alias("false_caution_flag"), material_deviation(F.col("s"), cb).alias("deviation_flag"), deviation_notes(F.col("s"), cb, F.lit(False)).alias("deviation_notes"),
    )
