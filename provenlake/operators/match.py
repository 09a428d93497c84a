"""Evidence candidates: scored claim-excerpt pairs, admission and the best few of each claim."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..tables import once_a_text, parts_for, settled, with_texts
from .pairs import by_rarity, grid_join

#: What a text's terms say by themselves, by the word list that they meet.
FACTS = {"scope": K.SCOPE_WORDS, "future": K.PREDICTION_WORDS, "limits": K.LIMITATION_WORDS, "compares": K.COMPARISON_WORDS}


def featured(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """df with the token features and facts of a text, worked out once a row and not once a pair."""
    terms = F.col(f"{prefix}_terms")
    df = df.withColumn(f"{prefix}_list", T.terms(F.col(text_col))).withColumn(f"{prefix}_terms", F.array_distinct(f"{prefix}_list"))
    return df.select(
        *[c for c in df.columns if c != f"{prefix}_list"],
        T.numbers(F.col(text_col)).alias(f"{prefix}_numbers"),
        T.dates(F.col(text_col)).alias(f"{prefix}_dates"),
        T.phrases(F.col(f"{prefix}_list")).alias(f"{prefix}_phrases"),
        *[F.arrays_overlap(terms, T.word_set(words)).alias(f"{prefix}_{name}") for name, words in FACTS.items()],
        F.array_contains(terms, "miss").alias(f"{prefix}_miss"),
        F.array_contains(terms, "test").alias(f"{prefix}_test"),
    )


def shared(name: str) -> Column:
    return F.array_intersect(f"c_{name}", f"e_{name}")


def limitation_score() -> Column:
    applies = (F.col("n_terms") > 0) & F.col("e_limits") & (F.col("c_scope") | F.col("c_future"))
    more = F.when(F.col("c_future") & F.col("e_miss"), 0.12).otherwise(0.0)
    tested = F.when(F.col("c_scope") & F.col("e_test"), 0.08).otherwise(0.0)
    return F.when(applies, F.lit(0.18) + more + tested).otherwise(0.0)


def counted(pairs: DataFrame) -> DataFrame:
    """Pairs with n_terms, n_numbers and n_phrases, how many of each both sides share: counted once,
    as columns, since the score names them often."""
    counts = F.struct(*[F.size(shared(name)).alias(f"n_{name}") for name in ("terms", "numbers", "phrases")])
    # the one member of an array: a filter on the score would take plain columns in and count anew for each use
    return pairs.select("*", F.explode_outer(F.array(counts)).alias("_n")).select("*", "_n.*").drop("_n")


def pair_score() -> Column:
    """The score of a counted pair with features c_* and e_*."""
    both, numbers = F.col("n_terms"), F.col("n_numbers")
    coverage = both / F.size("c_terms")
    jaccard = both / (F.size("c_terms") + F.size("e_terms") - both)
    term = F.when(both > 0, F.lit(0.35) * coverage + F.lit(0.1) * jaccard).otherwise(0.0)
    phrase = F.least(F.lit(0.12), F.col("n_phrases") * F.lit(0.04))
    number = F.when(numbers > 0, F.lit(0.46) + F.lit(0.12) * (numbers / F.size("c_numbers"))).otherwise(0.0)
    date = F.when(F.arrays_overlap("c_dates", "e_dates"), 0.08).otherwise(0.0)
    compared = F.when((both > 0) & F.col("c_compares") & F.col("e_compares"), 0.12).otherwise(0.0)
    total = term + phrase + number + date + limitation_score() + compared
    capped = F.when((F.size("c_numbers") > 0) & (numbers == 0) & (both > 0), F.least(total, F.lit(K.UNMATCHED_NUMBER_CAP))).otherwise(total)
    return T.rounded(T.clamped(capped))


def rationale(reliability: Column) -> Column:
    """What the score of a pair rests on, in fixed order."""
    missing = F.array_except("c_numbers", "e_numbers")

    def listed(title: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(title), F.array_join(values, ", ")))

    terms = F.array_sort(shared("terms"))
    return F.concat_ws(
        "; ",
        listed("matched numbers: ", T.sorted_numbers(shared("numbers"))),
        F.when((F.size("c_numbers") > 0) & (F.size(terms) > 0), listed("claim numbers not found in excerpt: ", T.sorted_numbers(missing))),
        listed("matched dates: ", F.array_sort(shared("dates"))),
        listed("overlapping terms: ", F.slice(terms, 1, 6)),
        F.when(limitation_score() > 0, "limitation wording overlaps with broad or future-facing claim"),
        F.concat(F.lit("source reliability: "), reliability),
    )


def score_bundle_pairs(claims: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Every claim with every excerpt of its bundle: claims(bundle_id, claim_id, claim_text), excerpts
    (bundle_id, source_id, excerpt_id, excerpt_text, ...), and the pair's score."""
    pairs = featured(claims, "claim_text", "c").join(featured(excerpts, "excerpt_text", "e"), "bundle_id")
    return counted(pairs).withColumn("score", pair_score())


#: The most that terms, phrases and comparison wording give, and what rounding adds.
ALL_TERMS, ALL_PHRASES, COMPARED, DATED, ROUNDED_UP = 0.45, 0.12, 0.12, 0.08, 0.00005
#: What an excerpt's wording is for the bounds: whether it names limits, whether it compares.
KINDS = {0: (False, False), 1: (False, True), 2: (True, False), 3: (True, True)}


def least_shared(threshold: float | Column, kind: int) -> Column:
    """How many terms at least a claim shares with any excerpt of that kind that reaches the threshold
    without a number or date in common.

    Shared terms give 0.45 of their part in the claim's terms at most, whatever the excerpt's length;
    phrases, limits and comparisons give what the formula caps them at, and need one shared term.
    """
    limits, compares = KINDS[kind]
    more = F.lit(ALL_PHRASES + ROUNDED_UP)
    if limits:
        future, scope = F.col("c_future"), F.col("c_scope")
        more = more + F.when(future | scope, F.lit(0.18) + F.when(future, 0.12).otherwise(0.0) + F.when(scope, 0.08).otherwise(0.0)).otherwise(0.0)
    if compares:
        more = more + F.when(F.col("c_compares"), COMPARED).otherwise(0.0)
    lacking = (threshold if isinstance(threshold, Column) else F.lit(threshold)) - more
    return F.greatest(F.lit(1), F.ceil(lacking / ALL_TERMS * F.size("c_terms") - 1e-9))


#: Columns of 64 bits each in which a text's terms leave a mark.
MARKS = 3


def figures(prefix: str) -> Column:
    """Numbers and dates of a featured text; a date is tagged, as some are no numbers."""
    return F.concat(f"{prefix}_numbers", F.transform(f"{prefix}_dates", lambda x: F.concat(F.lit("d:"), x)))


def excerpt_kind() -> Column:
    return F.col("e_limits").cast("int") * 2 + F.col("e_compares").cast("int")


def marked_features(df: DataFrame, text_col: str, prefix: str, threshold: float) -> DataFrame:
    """featured() of the distinct texts of df, numbered, with marks: a bit for each term and for each
    figure; of claims also how many marks an excerpt of each kind must share, of excerpts the kind."""

    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def marks(values: Column, columns: int) -> list[Column]:
        places = F.transform(values, lambda x: F.pmod(F.xxhash64(x), F.lit(64 * columns)))

        def column(k: int) -> Column:
            bit = lambda p: F.when(F.floor(p / 64) == k, F.call_function("shiftleft", one, (p % 64).cast("int"))).otherwise(none)
            return F.aggregate(places, none, lambda bits, p: bits.bitwiseOR(bit(p)))

        return [column(k) for k in range(columns)]

    def told(texts: DataFrame) -> DataFrame:
        rows = featured(texts, text_col, prefix).withColumn(f"{prefix}_text", F.monotonically_increasing_id())
        rows = rows.withColumns({f"{prefix}_marks_{k}": m for k, m in enumerate(marks(F.col(f"{prefix}_terms"), MARKS))} | {f"{prefix}_figures": marks(figures(prefix), 1)[0]})
        if prefix == "e":
            return rows.withColumn("e_kind", excerpt_kind())
        # terms that fall on one mark are counted as shared where that mark is
        twice = F.size("c_terms") - functools.reduce(Column.__add__, [F.bit_count(f"c_marks_{k}") for k in range(MARKS)])
        return rows.withColumns({f"c_needs_{kind}": least_shared(threshold, kind) - twice for kind in KINDS})

    return once_a_text(df, text_col, told)


def may_reach() -> Column:
    """Whether a pair of marked texts can reach the threshold: by a figure in common, or by as many terms
    as least_shared() asks for."""
    met = functools.reduce(Column.__add__, [F.bit_count(F.col(f"c_marks_{k}").bitwiseAND(F.col(f"e_marks_{k}"))) for k in range(MARKS)])
    needs = F.coalesce(*[F.when(F.col("e_kind") == kind, F.col(f"c_needs_{kind}")) for kind in KINDS])
    return (F.col("c_figures").bitwiseAND(F.col("e_figures")) != 0) | (met >= needs)


MARKED = ["e_kind", *[f"c_needs_{kind}" for kind in KINDS], *[f"{side}_{name}" for side in "ce" for name in ("figures", *[f"marks_{k}" for k in range(MARKS)])]]


def candidate_keys(c: DataFrame, e: DataFrame, threshold: float | Column) -> tuple[DataFrame, DataFrame]:
    """(bundle_id, c_row, kind, key) and (bundle_id, e_row, kind, key): featured rows of a bundle that can
    reach the threshold have a key in common, and others may.

    Claims and excerpts meet by shared numbers and dates, and by terms: a claim that must share m of its
    n terms shares one of the n - m + 1 that the fewest excerpts of the bundle have, so it looks for these
    alone, further into its terms where an excerpt's kind of wording adds to the score.
    """
    # a number and a term never look alike
    held = e.select("bundle_id", "e_row", excerpt_kind().alias("kind"), F.explode("e_terms").alias("key"))
    postings = held.unionByName(e.select("bundle_id", "e_row", F.lit(-1).alias("kind"), F.explode(figures("e")).alias("key")))

    often = held.groupBy("bundle_id", "key").agg(F.count("*").alias("rows"))
    wanted = c.select("bundle_id", "c_row", F.explode("c_terms").alias("key"), *[(F.size("c_terms") - least_shared(threshold, k) + 1).alias(f"within_{k}") for k in KINDS])
    wanted = by_rarity(wanted, often, ["bundle_id", "key"], "c_row").filter("rows > 0")
    probes = F.filter(F.array(*[F.when(F.col("place") <= F.col(f"within_{k}"), k) for k in KINDS]), lambda k: k.isNotNull())
    probes = wanted.select("bundle_id", "c_row", F.explode(probes).alias("kind"), "key")
    return probes.unionByName(c.select("bundle_id", "c_row", F.lit(-1).alias("kind"), F.explode(figures("c")).alias("key"))), postings


def candidate_pairs(c: DataFrame, e: DataFrame, threshold: float | Column) -> DataFrame:
    """(c_row, e_row): the pairs of featured rows of a bundle that can reach the threshold, and others, by
    their keys (see candidate_keys)."""
    probes, postings = candidate_keys(c, e, threshold)
    return grid_join(probes, postings, ["bundle_id", "kind", "key"]).select("c_row", "e_row").distinct()


def scored_large(c: DataFrame, e: DataFrame, told: dict[str, DataFrame], threshold: float) -> DataFrame:
    """Pairs of the rows of large bundles, (bundle_id, ..., c_text) and (bundle_id, ..., e_text), that reach
    the threshold, without their texts' features; c and e are read several times.

    A bundle's distinct texts are paired and scored, then the rows that have them are put in.  The side
    of fewer texts goes to every task, in rounds of about SENT_TEXTS and SENT_KEYS at most; of the other side each text lies
    in one task with all its keys, so no pair is shuffled with what it is scored by.
    """
    spark = c.sparkSession
    rows, texts = {}, {}
    for side, df in (("c", c), ("e", e)):
        own = settled(df.select("bundle_id", f"{side}_text").distinct().withColumn(f"{side}_row", F.monotonically_increasing_id()))
        rows[side] = settled(df.join(own, ["bundle_id", f"{side}_text"]))
        texts[side] = settled(own.join(told[side].drop("claim_text", "excerpt_text"), f"{side}_text"))
    counts = {side: df.count() for side, df in texts.items()}
    few, many = sorted("ce", key=lambda side: counts[side])
    # a claim's term may be a key of every kind
    sent_keys = texts[few].agg(F.coalesce(F.sum(F.size(f"{few}_terms")), F.lit(0))).first()[0] * (len(KINDS) if few == "c" else 1)
    rounds = max(1, -(-counts[few] // SENT_TEXTS), -(-sent_keys // SENT_KEYS))
    # one pair in 64 at least may be scored
    parts = parts_for(spark, max(counts[many], counts["c"] * counts["e"] // (64 * rounds)))
    found = None
    for turn in range(rounds):
        sent = texts[few].filter(F.pmod(F.xxhash64(f"{few}_row"), F.lit(rounds)) == turn)
        keys = dict(zip("ce", candidate_keys(*[sent if side == few else texts[side].repartition(parts, f"{side}_row") for side in "ce"], threshold)))
        met = keys[many].join(F.broadcast(keys[few]), ["bundle_id", "kind", "key"]).select("c_row", "e_row").distinct()
        pairs = met.join(texts[many].repartition(parts, f"{many}_row"), f"{many}_row").join(F.broadcast(sent.drop("bundle_id")), f"{few}_row")
        best = settled(scored_from(pairs, threshold).select("c_row", "e_row", "n_terms", "n_numbers", "n_phrases", "score"))
        found = best if found is None else found.unionByName(best)
    # the longer table first: its rows meet pairs that are still narrow
    placed = grid_join(found, rows[many].drop("bundle_id"), [f"{many}_row"])
    if rows[few].count() <= SENT_TEXTS:
        return placed.join(F.broadcast(rows[few]), f"{few}_row").drop("c_row", "e_row")
    return grid_join(placed, rows[few], [f"{few}_row"]).drop("c_row", "e_row")


#: Most claims or excerpts of a bundle all of whose pairs are looked at.
BUNDLE_ROWS = 256
#: Most pairs of distinct texts that are scored by themselves; their scores go to every task.
TEXT_PAIRS = 1 << 18
#: Most texts, or rows, of the shorter side of large bundles that go to every task at once.
SENT_TEXTS = 20_000
#: Most of their keys, about.
SENT_KEYS = 1_000_000


def score_candidates(claims: DataFrame, excerpts: DataFrame, threshold: float = K.ADMISSION, features: bool = True) -> DataFrame:
    """Every pair of a bundle whose score is the threshold or more, as score_bundle_pairs() has it, without
    the texts' features where none are asked for.  At a threshold of 0 or less no pair can be left out, and
    all are scored.  Rows without a bundle meet none.

    Where the distinct texts make at most TEXT_PAIRS pairs, and no more than there are rows, each of
    these is scored once, and a bundle's pairs look their score up.  Otherwise each pair of rows is scored
    where may_reach() holds.  A bundle of BUNDLE_ROWS claims and excerpts at most is one group of a
    join; of larger bundles only candidate_pairs() meet.  claims and excerpts are read several times.
    """
    if threshold <= 0:
        return score_bundle_pairs(claims, excerpts).filter(F.col("score") >= threshold)
    claims, excerpts = claims.filter("bundle_id is not null"), excerpts.filter("bundle_id is not null")
    told = {"c": marked_features(claims, "claim_text", "c", threshold), "e": marked_features(excerpts, "excerpt_text", "e", threshold)}
    sizes = [settled(df.groupBy("bundle_id").agg(F.count("*").alias("n"))) for df in (claims, excerpts)]
    large = settled(sizes[0].union(sizes[1]).filter(F.col("n") > BUNDLE_ROWS).select("bundle_id").distinct())
    some = not large.isEmpty()
    rows = max(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in sizes)
    parts = parts_for(claims.sparkSession, rows)
    by_text = told["c"].count() * told["e"].count() <= min(rows, TEXT_PAIRS)
    if by_text:
        scores = scored_texts(told["c"], told["e"], threshold)

    def dealt(how: str) -> tuple[DataFrame, DataFrame]:
        # dealt out by bundle before the features come, which are wider than the texts; a large bundle is no task's
        kept = [df.join(large, "bundle_id", how) if some else df for df in (claims, excerpts)]
        return tuple(df if how == "left_semi" else df.repartition(parts, "bundle_id") for df in kept)

    def numbered(how: str) -> tuple[DataFrame, DataFrame]:
        c, e = dealt(how)
        return with_texts(c, told["c"].select("claim_text", "c_text"), "claim_text"), with_texts(e, told["e"].select("excerpt_text", "e_text"), "excerpt_text")

    def with_features(pairs: DataFrame) -> DataFrame:
        return pairs.join(told["c"].drop("claim_text"), "c_text").join(told["e"].drop("excerpt_text"), "e_text")

    if by_text:
        c, e = numbered("left_anti")
        scored = c.join(e, "bundle_id").join(F.broadcast(scores), ["c_text", "e_text"])
        scored = with_features(scored) if features else scored
    else:
        c, e = dealt("left_anti")
        c, e = with_texts(c, told["c"], "claim_text"), with_texts(e, told["e"], "excerpt_text")
        scored = scored_from(c.join(e, "bundle_id").filter(may_reach()), threshold)
    if some:
        more = scored_large(*[settled(df) for df in numbered("left_semi")], told, threshold)
        more = with_features(more) if features else more
        scored = scored.unionByName(more) if features else scored.select(*more.columns).unionByName(more)
    return scored.drop("c_text", "e_text", *MARKED)


def scored_texts(c: DataFrame, e: DataFrame, threshold: float) -> DataFrame:
    """(c_text, e_text, n_terms, n_numbers, n_phrases, score) of the pairs of marked texts, by their numbers
    c_text and e_text, whose score is the threshold or more."""
    cores = c.sparkSession.sparkContext.defaultParallelism
    pairs = c.repartition(cores, "c_text").crossJoin(e).filter(may_reach())
    return settled(scored_from(pairs, threshold).select("c_text", "e_text", "n_terms", "n_numbers", "n_phrases", "score"))


def scored_from(pairs: DataFrame, threshold: float) -> DataFrame:
    return counted(pairs).withColumn("score", pair_score()).filter(F.col("score") >= threshold)


def score_blocked_pairs(claims: DataFrame, excerpts: DataFrame, threshold: float = K.ADMISSION, features: bool = True) -> DataFrame:
    """Pairs of any bundle at or above a positive threshold, in the claims' bundles."""
    if threshold <= 0:
        raise ValueError("pairs without a common key can only be left out above a threshold of 0")
    own = claims.withColumnRenamed("bundle_id", "_bundle").withColumn("bundle_id", F.lit(0))
    found = score_candidates(own, excerpts.withColumn("bundle_id", F.lit(0)), threshold, features)
    return found.withColumn("bundle_id", F.col("_bundle")).drop("_bundle")


def best_candidates(scored: DataFrame, threshold: float = K.ADMISSION, k: int = K.TOP_CANDIDATES) -> DataFrame:
    """Pairs at the threshold or above, the best k of each claim, with their rank."""
    order = Window.partitionBy("bundle_id", "claim_id").orderBy(F.desc("score"), "source_id", "excerpt_id")
    return scored.filter(F.col("score") >= threshold).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scoped_candidates(claims: DataFrame, excerpts: DataFrame, links: DataFrame, threshold: float | Column = K.ADMISSION, k: int | Column = K.TOP_CANDIDATES) -> DataFrame:
    """Candidates among declared links(bundle_id, claim_id, excerpt_id, role) only: support links at
    the threshold or above, counter links whatever their score; the best k of each claim and role.
    Threshold and k may be columns of claims."""
    # joins and ranks sort a task's rows, whose number must not grow with the table
    parts = parts_for(claims.sparkSession, max(df.count() for df in (claims, links, excerpts)))
    by_claim, by_excerpt = ["bundle_id", "claim_id"], ["bundle_id", "excerpt_id"]
    pairs = claims.repartition(parts, *by_claim).join(links.repartition(parts, *by_claim), by_claim)
    pairs = pairs.repartition(parts, *by_excerpt).join(excerpts.repartition(parts, *by_excerpt), by_excerpt)
    for df, text_col, side in ((claims, "claim_text", "c"), (excerpts, "excerpt_text", "e")):
        pairs = with_texts(pairs, once_a_text(df, text_col, functools.partial(featured, text_col=text_col, prefix=side)), text_col)
    scored = counted(pairs).withColumn("score", pair_score()).filter((F.col("role") == "counter") | (F.col("score") >= threshold))
    order = Window.partitionBy("bundle_id", "claim_id", "role").orderBy(F.desc("score"), "source_id", "excerpt_id")
    return scored.repartition(parts, *by_claim, "role").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
