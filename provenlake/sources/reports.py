"""Report files: one of an exact name for each bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..operators.report import nested_json
from ..operators.report_text import markdown_lines
from .named_files import write_named
from .writeback import _indented


def _named(suffix: str) -> Column:
    return F.concat(safe_name(F.col("bundle_id").cast("string")), F.lit(suffix))


def markdown_files(assessments: DataFrame, contexts: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """(file, piece, content): <bundle_id>.md of each bundle, a line a piece.  Empty lines at a report's
    end are left out."""
    lines = markdown_lines(assessments, contexts, bundles)
    order = Window.partitionBy("bundle_id").orderBy("part", "place", "step")
    numbered = lines.withColumn("piece", F.row_number().over(order).cast("long"))
    # the last line that is not empty, without holding a bundle's lines
    last = numbered.filter("line <> ''").groupBy("bundle_id").agg(F.max("piece").alias("last"))
    return numbered.join(last, "bundle_id").filter("piece <= last").select(_named(".md").alias("file"), "piece", F.concat("line", F.lit("\n")).cast("binary").alias("content"))


def write_markdown(assessments: DataFrame, contexts: DataFrame, path: str, bundles: DataFrame | None = None) -> None:
    """One Markdown file a bundle below path; files that are there already must be identical."""
    write_named(markdown_files(assessments, contexts, bundles), path)


def write_json(assessments: DataFrame, contexts: DataFrame, path: str) -> None:
    """One JSON file a bundle below path, <bundle_id>.json; null fields are left out."""
    write_named(nested_json(assessments, contexts).select(_named(".json").alias("file"), _indented("report").cast("binary").alias("content")), path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Flat rows, such as a comparison of two audits, as CSV files with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)
