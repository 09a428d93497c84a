"""Claims of documents: paragraphs, sentences, classes, near-duplicates, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..tables import settled
from . import pairs

#: Every line end that Python's splitlines knows.
LINE_END = r"\R|[\x1c-\x1e]"


def claim_type(text: Column) -> Column:
    """The first class, in order of priority, of which a pattern fits the normalised text."""

    def first(norm: Column) -> Column:
        out = None
        for name, patterns in K.CLAIM_TYPES.items():
            fits = T.any_pattern(norm, patterns)
            out = F.when(fits, name) if out is None else out.when(fits, name)
        return out.otherwise("unclassified")

    # as the one member of an array the normalised text is worked out once, not in each branch
    return F.get(F.transform(F.array(T.normalized(text)), first), F.lit(0))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, paragraph, sentence, text): paragraphs are split at blank lines, heading and blank
    lines go, empty paragraphs take no number; sentences end at whitespace after . ! or ?, and all
    are returned.  Null texts have none."""
    paragraph = F.posexplode(F.filter(F.transform(F.split(text_col, r"\n\s*\n"), _joined_lines), lambda p: p != "")).alias("p", "body")
    split = docs.select(id_col, paragraph)
    sentence = F.posexplode(F.filter(F.transform(F.split("body", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")).alias("s", "text")
    return split.select(id_col, (F.col("p") + 1).alias("paragraph"), sentence).select(id_col, "paragraph", (F.col("s") + 1).alias("sentence"), "text")


def _joined_lines(paragraph: Column) -> Column:
    lines = F.transform(F.split(paragraph, LINE_END), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^#{1,6}\s")), " ")


def claim_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences that can be claims: no question, four tokens or more."""
    return sentences(docs, id_col, text_col).filter(~F.endswith("text", F.lit("?")) & (F.size(T.tokens(F.col("text"))) >= 4))


def first_wins(found: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The rows of found(row, ...) that stay when they are taken in the order of `row` and one goes where
    it conflicts with an earlier one that stayed; conflicts(a, b) has a < b.

    In each round the rows without an open earlier conflict stay, those that conflict with one of these
    go, and conflicts with either are closed.  Rounds go on until no conflict is open: as many as the
    longest run of rows that each conflict with the next.
    """
    open_, gone = settled(conflicts.select("a", "b")), None
    while not open_.isEmpty():
        stays = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        goes = settled(open_.join(stays, "a", "left_semi").select("b").distinct())
        gone = goes if gone is None else gone.unionByName(goes)
        left = open_.join(goes, "b", "left_anti").join(goes.select(F.col("b").alias("a")), "a", "left_anti")
        open_ = settled(left.select("a", "b"))
    return found if gone is None else found.join(gone.select(F.col("b").alias("row")), "row", "left_anti")


def dedupe_claims(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Claims(id_col, paragraph, sentence, text, claim_type) of which, in each document, the first of
    equal or nearly equal ones stays: (id_col, claim_id, text, claim_type, location).

    A claim goes when its normalised text equals, or its terms nearly repeat, those of an earlier one of
    the document that stayed; nearness is not passed on by one that went.  Documents that share an id,
    and rows without one, are one document; at the same place the smaller text is the earlier.
    """
    place = F.struct("paragraph", "sentence", "text", "claim_type")
    doc = F.struct(F.col(id_col)).alias("doc")  # equal where the id is null, too
    # equal texts, and equal terms, have the same conflicts: of each kind only the first can stay
    first = found.groupBy(doc, T.normalized(F.col("text")).alias("norm")).agg(F.min(place).alias("place"))
    terms = F.array_sort(T.term_set(F.col("norm")))
    kind = F.when(F.size(terms) > 0, F.to_json(terms)).otherwise(F.concat(F.lit("="), "norm"))
    first = first.groupBy("doc", kind.alias("kind")).agg(F.min(F.struct("place", "norm")).alias("at"))
    first = first.select("doc", "at.place", "at.norm", T.term_set(F.col("at.norm")).alias("terms"))
    # rows are numbered in the documents' own order; the sort is by range, over all tasks
    numbered = settled(first.orderBy("doc", "place").withColumn("row", F.monotonically_increasing_id()))
    kept = first_wins(numbered, pairs.near_duplicate_pairs(numbered, "doc"))
    return kept.select(
        F.col(f"doc.{id_col}").alias(id_col),
        T.short_id("claim", F.col(f"doc.{id_col}").cast("string"), F.col("norm")).alias("claim_id"),
        F.col("place.text").alias("text"),
        F.col("place.claim_type").alias("claim_type"),
        F.format_string("paragraph:%d:sentence:%d", "place.paragraph", "place.sentence").alias("location"),
    )


def extract_claims(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_unclassified: bool = False) -> DataFrame:
    """(id_col, claim_id, text, claim_type, location) of each document, first of near-duplicates only
    (dedupe_claims)."""
    found = claim_sentences(docs, id_col, text_col).withColumn("claim_type", claim_type(F.col("text")))
    if not keep_unclassified:
        found = found.filter("claim_type <> 'unclassified'")
    return dedupe_claims(found, id_col)
