"""Deviation records: the first fault of each bundle that was left out, as a file of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .. import constants as K
from ..functions.text import safe_name
from .bundles import DUMP
from .named_files import write_named

#: Kinds of deviation by what a fault says, in the order in which intake meets them.
KINDS = (
    ("missing file", "missing_required_field"), ("contract version is not supported", "vocabulary_drift"), ("not YAML|not a mapping|lacks .*", "schema_validation_failure"),
    ("configuration's hash is not .*", "intake_hash_mismatch"), (r"\S+: expected .*", "vocabulary_drift"), ("no list|malformed line|path escapes|listed twice|not listed|digest differs", "intake_hash_mismatch"),
    ("tree hash differs", "intake_hash_mismatch"), ("count of .*", "schema_validation_failure"), (".*", "schema_validation_failure"),
)
IMPACT, RESOLUTION = "Cannot proceed; bundle intake halted.", "pending"
FIELDS = ("deviation_id", "deviation_type", "artifact_id", "detected_at_utc", "detected_by", "description", "impact_assessment", "resolution", "capa_notes")


def _told(values: Column, of: int) -> Column:
    """What KINDS holds for a fault: its place (0) or its kind (1)."""
    cases = [F.when(values.rlike(f"^(?:{pattern})$"), F.lit((place, kind)[of])) for place, (pattern, kind) in enumerate(KINDS)]
    return F.coalesce(*cases)


def deviation_records(faults: DataFrame, detected_at_utc: str) -> DataFrame:
    """faults(bundle_id, file, fault) as one record a bundle: its first fault in intake's order, then by
    file and text.  The id is dev- and twelve hex digits of the SHA-256 of 'artifact:type:description',
    so the same fault has the same id at any time."""
    place = F.struct(_told(F.col("fault"), 0).alias("order"), "file", "fault")
    first = faults.groupBy("bundle_id").agg(F.min(place).alias("f"))
    rows = first.select(F.col("bundle_id").alias("artifact_id"), _told(F.col("f.fault"), 1).alias("deviation_type"), F.concat_ws(": ", "f.file", "f.fault").alias("description"))
    digest = F.sha2(F.concat_ws(":", "artifact_id", "deviation_type", "description"), 256)
    rows = rows.withColumns({
        "deviation_id": F.concat(F.lit("dev-"), F.left(digest, F.lit(12))), "detected_at_utc": F.lit(detected_at_utc), "detected_by": F.lit(K.AUDITOR), "impact_assessment": F.lit(IMPACT),
        "resolution": F.lit(RESOLUTION), "capa_notes": F.lit(""),
    })
    return rows.select(*FIELDS)


@pandas_udf(StringType())
def _yaml(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON objects as YAML mappings in the form that bundles have."""
    import json

    import yaml

    for texts in batches:
        yield pd.Series([yaml.safe_dump(json.loads(t), **DUMP) for t in texts], dtype=object)


def write_deviations(records: DataFrame, path: str) -> None:
    """One file a record below path, intake-<artifact>.yaml; those of another time refuse to be written over."""
    name = F.concat(F.lit("intake-"), F.when(F.col("artifact_id") == "", "unknown").otherwise(safe_name(F.col("artifact_id"))), F.lit(".yaml"))
    write_named(records.select(name.alias("file"), _yaml(F.to_json(F.struct(*FIELDS))).cast("binary").alias("content")), path)
