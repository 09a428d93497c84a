"""Drafts: Markdown and plain text files, one document each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import LINE_END, checked, stripped, whole_files

MARKDOWN, PLAIN = (".md", ".markdown"), (".txt",)


def markdown_title(text: Column) -> Column:
    """The first line that begins with '# ', without that; null without one."""
    lines = F.transform(F.split(text, LINE_END), stripped)
    return stripped(F.substring(F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("# "))), F.lit(0)), 3, 2**31 - 1))


def scan_drafts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(document_id, title, content, path, error) of every file under path.

    The id is the file's name without its suffix, the title a Markdown file's first heading.  Files
    of another kind, not in UTF-8, or blank come back with null content and the reason in error.
    """
    rows = whole_files(spark, path, MARKDOWN + PLAIN)
    content = stripped(F.col("text"))
    blank = F.when(content == "", F.lit("Validation failed for draft: content is blank."))
    return rows.select(
        F.col("stem").alias("document_id"),
        F.when(F.col("suffix").isin(*MARKDOWN), markdown_title(F.col("text"))).alias("title"),
        F.when(content != "", content).alias("content"),
        "path",
        F.coalesce("error", blank).alias("error"),
    )


def read_drafts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(document_id, title, content, path); the query fails on a file that scan_drafts faults."""
    return checked(scan_drafts(spark, path))
