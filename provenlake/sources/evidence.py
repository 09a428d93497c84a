"""Evidence files in YAML or JSON: a list of sources with their excerpts, laid out one row an excerpt."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .files import checked, stripped, whole_files

YAML, JSON = (".yml", ".yaml"), (".json",)
#: Fields and the kinds of source and of reliability.
SOURCE_FIELDS = ("id", "title", "source_type", "reliability", "excerpts", "url", "date")
EXCERPT_FIELDS = ("id", "text", "notes")
SOURCE_TYPES = ("report", "article", "documentation", "test_output", "local_note", "public_profile", "unknown")
RELIABILITIES = ("low", "medium", "high", "unknown")


@pandas_udf(StringType())
def yaml_as_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The JSON form of YAML texts; null for what is not YAML."""
    import yaml

    def turned(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(yaml.safe_load(text), default=str, ensure_ascii=False)
        except yaml.YAMLError:
            return None

    for part in texts:
        yield part.map(turned)


def _field(raw: str, name: str) -> Column:
    return stripped(F.get_json_object(raw, f"$.{name}"))


def _unknown(raw: str, fields: tuple[str, ...], what: str) -> Column:
    """Why raw is not an object of these fields."""
    keys = F.json_object_keys(raw)
    extra = F.array_except(keys, F.array(*map(F.lit, fields)))
    return F.when(keys.isNull(), F.lit(f"{what}: not a mapping")).when(F.size(extra) > 0, F.concat(F.lit(f"{what}: unknown field "), extra[0]))


def _missing(what: str, *names: str, optional: tuple[str, ...] = ()) -> Column:
    """Why one of the columns is null or blank; the optional ones may be null."""
    found = [F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(f"{what}: {n} is missing or blank")) for n in names]
    return F.coalesce(*found, *[F.when(F.col(n) == "", F.lit(f"{what}: {n} is blank")) for n in optional], F.lit(None).cast("string"))


def scan_evidence(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(bundle_id, source_id, title, source_type, reliability, url, source_date, excerpt_id,
    excerpt_text, notes, path, error) of every file under path; bundle_id is the file's name without
    its suffix.

    A file gives a row an excerpt, and one with null excerpt columns for a source without excerpts or
    a file without sources.  error says why a row is refused: not UTF-8, not YAML or JSON, an unknown
    field or kind, a missing or blank one, or a source or excerpt id that the file holds twice.
    Numbers and dates that stand for texts are taken as texts.
    """
    files = whole_files(spark, path, YAML + JSON)
    # JSON stays in the JVM
    doc = F.when(F.col("suffix").isin(*YAML), yaml_as_json("text")).otherwise(F.col("text"))
    files = files.select("path", F.col("stem").alias("bundle_id"), "error", doc.alias("doc"))
    keys = F.json_object_keys("doc")
    listed = F.get_json_object("doc", "$.sources")
    list_of = F.from_json(listed, "array<string>")
    parse = F.when(F.try_parse_json("doc").isNull(), F.lit("Could not parse the file."))
    shape = F.when(keys.isNull(), F.lit("not a mapping")).when(F.size(F.array_except(keys, F.array(F.lit("sources")))) > 0, F.lit("unknown field beside sources")).when(listed.isNotNull() & ~F.startswith(F.ltrim(listed), F.lit("[")), F.lit("sources: not a list"))
    files = files.withColumn("error", F.coalesce("error", parse, shape))
    files = files.withColumn("raw", F.explode_outer(F.when(F.col("error").isNull(), list_of)))

    sources = files.select(
        "path", "bundle_id", "raw", "error", _field("raw", "id").alias("source_id"), _field("raw", "title").alias("title"),
        F.coalesce(_field("raw", "source_type"), F.lit("unknown")).alias("source_type"), F.coalesce(_field("raw", "reliability"), F.lit("unknown")).alias("reliability"),
        _field("raw", "url").alias("url"), _field("raw", "date").alias("day"), F.from_json(F.get_json_object("raw", "$.excerpts"), "array<string>").alias("excerpts"),
    )
    faults = F.coalesce(
        _unknown("raw", SOURCE_FIELDS, "source"),
        _missing("source", "source_id", "title", optional=("url",)),
        F.when(~F.col("source_type").isin(*SOURCE_TYPES), F.lit("source: unknown source_type")),
        F.when(~F.col("reliability").isin(*RELIABILITIES), F.lit("source: unknown reliability")),
        F.when(F.col("day").isNotNull() & F.try_to_date("day", "yyyy-MM-dd").isNull(), F.lit("source: date is not a day")),
    )
    sources = sources.withColumn("error", F.coalesce("error", F.when(F.col("raw").isNotNull(), faults)))
    rows = sources.withColumn("piece", F.explode_outer("excerpts"))
    rows = rows.withColumns({"excerpt_id": _field("piece", "id"), "excerpt_text": _field("piece", "text"), "notes": _field("piece", "notes")})
    faults = F.coalesce(_unknown("piece", EXCERPT_FIELDS, "excerpt"), _missing("excerpt", "excerpt_id", "excerpt_text", optional=("notes",)))
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("piece").isNotNull(), faults)))

    named = rows.filter("source_id is not null")
    again = files.filter("raw is not null").select("path", _field("raw", "id").alias("id")).groupBy("path", "id").count().filter("count > 1")
    twice = named.filter("excerpt_id is not null").groupBy("path", F.col("excerpt_id").alias("id")).count().filter("count > 1")
    repeated = again.select("path", F.concat(F.lit("Duplicate source id: "), "id").alias("repeated")).unionByName(twice.select("path", F.concat(F.lit("Duplicate excerpt id: "), "id").alias("repeated")))
    repeated = repeated.groupBy("path").agg(F.max("repeated").alias("repeated"))
    rows = rows.join(repeated, "path", "left").withColumn("error", F.coalesce("error", "repeated"))
    return rows.select("bundle_id", "source_id", "title", "source_type", "reliability", "url", F.try_to_date("day", "yyyy-MM-dd").alias("source_date"), "excerpt_id", "excerpt_text", "notes", "path", "error")


def read_evidence(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The excerpts of scan_evidence; the query fails on a row that it faults."""
    return checked(scan_evidence(spark, path)).filter("excerpt_id is not null").drop("path")
