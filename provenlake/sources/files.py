"""Whole files as rows, and the error that names a path."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space at the ends of a text, and what ends a line.
BLANK = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


class SourceError(ValueError):
    """An input that cannot be read as what it should be."""

    def __init__(self, path: str, message: str) -> None:
        super().__init__(f"{path}: {message}")
        self.path, self.message = path, message


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{BLANK}+|{BLANK}+$", "")


def whole_files(spark: SparkSession, path: str | list[str], suffixes: tuple[str, ...] = (), recursive: bool = False) -> DataFrame:
    """(path, suffix, stem, content, text, error) of every file under path; a folder, a file or a pattern.

    text is null and error says why where the bytes are not UTF-8; so it is for a suffix that is not
    among the expected ones.  A path that does not exist is a SourceError.  Files are split over
    tasks; a single file is read whole, of at most 2 GB.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    try:
        files = reader.load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise SourceError(str(path), "File does not exist.") from missing
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1))
    text = F.col("content").cast("string")
    rows = files.select("path", suffix.alias("suffix"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"), "content")
    error = F.when(~F.is_valid_utf8(text), F.lit("Could not read UTF-8 text."))
    if suffixes:
        error = F.when(~F.col("suffix").isin(*suffixes), F.concat(F.lit("Unsupported file type. Expected "), F.lit(", ".join(suffixes)), F.lit("."))).otherwise(error)
    rows = rows.withColumn("error", error)
    return rows.withColumn("text", F.when(F.col("error").isNull(), text))


def checked(rows: DataFrame) -> DataFrame:
    """rows without their column error; the query fails at the first row that has one."""
    failed = F.raise_error(F.concat_ws(": ", "path", "error")).cast("boolean")
    return rows.filter(F.when(F.col("error").isNotNull(), failed).otherwise(F.lit(True))).drop("error")
