"""Joins whose output is pairs: frequent keys are laid out on a grid, and sets are probed by their rare members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task may have of a side.
KEY_ROWS = 2048


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], within: Column | None = None, key_rows: int = KEY_ROWS) -> DataFrame:
    """left and right joined on keys (and on the condition `within`), a frequent key's rows on a grid.

    A key with more than key_rows rows on a side is cut there into parts of about that many; each part
    of the left meets each part of the right under a key of its own.  The other keys are joined as they
    are.  Only frequent keys' counts are kept, one row each.  Columns other than keys must not clash.
    """
    counted = left.groupBy(*keys).agg(F.count("*").alias("_l")).withColumn("_r", F.lit(0).cast("long"))
    counted = counted.unionByName(right.groupBy(*keys).agg(F.count("*").alias("_r")).withColumn("_l", F.lit(0).cast("long")))
    often = counted.filter(f"_l > {key_rows} or _r > {key_rows}").groupBy(*keys).agg(*[F.ceil(F.max(c) / key_rows).alias(c) for c in ("_l", "_r")])

    def laid_out(df: DataFrame, own: str, other: str) -> DataFrame:
        mine, theirs = F.coalesce(own, F.lit(1)), F.greatest(F.coalesce(other, F.lit(1)), F.lit(1))
        # by content and not by chance: a task that runs again deals out alike
        cell = F.when(mine > 1, F.pmod(F.xxhash64(*df.columns), mine)).otherwise(F.lit(0)).cast("long")
        return df.join(often, keys, "left").withColumn(f"{own}_cell", cell).withColumn(f"{other}_cell", F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1))).drop("_l", "_r")

    both = laid_out(left, "_l", "_r").join(laid_out(right, "_r", "_l"), [*keys, "_l_cell", "_r_cell"]).drop("_l_cell", "_r_cell")
    return both if within is None else both.filter(within)


def by_rarity(entries: DataFrame, held: DataFrame, keys: list[str], row: str) -> DataFrame:
    """entries(row, *keys), the members of sets, each with its place: 1 for the member that the fewest
    rows of held(*keys, rows) have; members that none has come first.  Ties are in the order of the keys."""
    counted = entries.join(held, keys, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(row).orderBy("rows", *keys)))


def near_duplicate(a: Column, b: Column) -> Column:
    """Whether two term sets are near-duplicates: Jaccard 0.8 or more, or 0.9 of the smaller one
    shared at a difference of two terms at most; empty sets never."""
    return near_sizes(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def near_sizes(both: Column, a: Column, b: Column) -> Column:
    """near_duplicate() by the sizes of two sets and of what they share."""
    least = F.least(a, b)
    near = (both >= 0.8 * (a + b - both)) | ((both >= 0.9 * least) & (F.abs(a - b) <= 2))
    return (least > 0) & near


def near_duplicate_pairs(sets: DataFrame, group: str, row: str = "row", terms: str = "terms") -> DataFrame:
    """(group, a, b) with a < b: rows of a group, by their unique number `row`, whose term sets are
    near-duplicates.

    Either condition of near_duplicate() asks n terms of a set for so many shared ones, say m, that
    two near sets share one of their n - m + 1 rarest terms; only rows that do are compared, where their
    sizes agree too.  Rows without a group are in none.
    """
    entries = sets.filter(f"{group} is not null").select(group, row, F.size(terms).alias("n"), F.explode(terms).alias("term"))
    held = entries.groupBy(group, "term").agg(F.count("*").alias("rows"))
    n = F.col("n")
    # 1e-9 outweighs what a product such as 0.9 * 10 may be too large
    shared = F.greatest(F.lit(1), F.least(F.ceil(0.8 * n - 1e-9), F.ceil(0.9 * (n - 2) - 1e-9)))
    rare = by_rarity(entries, held.filter("rows > 1"), [group, "term"], row).filter((F.col("rows") > 1) & (F.col("place") <= n - shared + 1))
    one, other = rare.select(group, "term", F.col(row).alias("a"), F.col("n").alias("na")), rare.select(group, "term", F.col(row).alias("b"), F.col("n").alias("nb"))
    # sizes alone rule out what no overlap could make near
    fits = (F.col("a") < F.col("b")) & near_sizes(F.least("na", "nb"), F.col("na"), F.col("nb"))
    met = grid_join(one, other, [group, "term"], fits).select(group, "a", "b").distinct()
    texts = sets.select(F.col(row).alias("_row"), F.col(terms).alias("_terms"))
    met = met.join(texts.withColumnsRenamed({"_row": "a", "_terms": "ta"}), "a").join(texts.withColumnsRenamed({"_row": "b", "_terms": "tb"}), "b")
    return met.filter(near_duplicate(F.col("ta"), F.col("tb"))).select(group, "a", "b")
