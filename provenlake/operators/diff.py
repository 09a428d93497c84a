"""Two runs of the verdicts against human labels, thresholds side by side, and shorter premises.

A run is traces(claim_id, verdict, reason, signal) and entailed(claim_id, passage_id, ordinal, label,
score), the results that the floor admitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import calibrate, verdict
from .extract import sentences


def diff_class(gold: Column, baseline: Column, candidate: Column) -> Column:
    was, now = baseline == gold, candidate == gold
    return (
        F.when(~was & now, "recovered").when(was & ~now, "regressed").when(~was & ~now & (baseline != candidate), "changed_but_still_miss").when(now, "unchanged_match").otherwise("unchanged_miss")
    )


def _run(traces: DataFrame, entailed: DataFrame, side: str) -> DataFrame:
    passages = entailed.groupBy("claim_id").agg(F.collect_set("passage_id").alias(f"{side}_passages"), F.count("*").alias(f"{side}_entailments"))
    named = traces.select("claim_id", *[F.col(c).alias(f"{side}_{c}") for c in ("verdict", "reason", "signal")])
    return named.join(passages, "claim_id", "left")


def diff_rows(gold: DataFrame, baseline: DataFrame, baseline_entailed: DataFrame, candidate: DataFrame, candidate_entailed: DataFrame) -> DataFrame:
    """One row for each claim of gold(claim_id, gold): both runs' verdicts, reasons, signals and numbers of
    results, the class of the change, the passages that only the candidate run admitted, and whether a
    claim that gold supports is contradicted now and was not before.  check_alignment tells which
    claims one side lacks; those have no row."""
    merged = gold.select("claim_id", "gold").join(_run(baseline, baseline_entailed, "baseline"), "claim_id").join(_run(candidate, candidate_entailed, "candidate"), "claim_id")
    none = F.array().cast("array<string>")
    fresh = F.array_except(F.coalesce("candidate_passages", none), F.coalesce("baseline_passages", none))
    return merged.select(
        "claim_id", "gold", "baseline_verdict", "candidate_verdict",
        diff_class(F.col("gold"), F.col("baseline_verdict"), F.col("candidate_verdict")).alias("classification"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("baseline_reason", "candidate_reason")],
        "baseline_signal", "candidate_signal",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("baseline_entailments", "candidate_entailments")],
        F.array_join(F.array_sort(fresh), ";").alias("newly_admitted"),
        ((F.col("gold") == "supported") & (F.col("baseline_verdict") != "contradicted") & (F.col("candidate_verdict") == "contradicted")).alias("new_false_contradiction"),
    )


CLASSES = ("recovered", "regressed", "changed_but_still_miss", "unchanged_match", "unchanged_miss")


def diff_summary(rows: DataFrame) -> DataFrame:
    """Numbers of claims, of each class, of changed verdicts and of new false contradictions."""
    return rows.agg(
        F.count("*").alias("claims"),
        *[F.count_if(F.col("classification") == c).alias(c) for c in CLASSES],
        F.count_if(F.col("baseline_verdict") != F.col("candidate_verdict")).alias("verdict_changed"),
        F.count_if("new_false_contradiction").alias("new_false_contradictions"),
    )


def floor_sweep(retrieved: DataFrame, entailment: DataFrame, claims: DataFrame, floors: list[float]) -> DataFrame:
    """(floor, claim_id, n_admitted, label, score, passage_id): every claim's signal at each floor, all
    floors in one job.  A retrieved passage goes to each floor that admits it; what is above none goes
    nowhere."""
    steps = F.array(*[F.lit(float(x)) for x in sorted(floors)])
    admitted = retrieved.withColumnRenamed("score", "similarity").withColumn("floor", F.explode(F.filter(steps, lambda f: F.col("similarity") >= f)))
    results = admitted.select("claim_id", "passage_id", "floor").join(entailment, ["claim_id", "passage_id"])
    keyed = results.withColumn("key", F.struct("claim_id", "floor"))
    all_keys = claims.select(F.explode(F.transform(steps, lambda f: F.struct(F.col("claim_id"), f.alias("floor")))).alias("key"))
    found = verdict.aggregate_signal(keyed, all_keys, "key")
    counted = keyed.groupBy("key").agg(F.count("*").alias("n_admitted"))
    return found.join(counted, "key", "left").select("key.floor", "key.claim_id", F.coalesce("n_admitted", F.lit(0)).alias("n_admitted"), "label", "score", "passage_id")


def sentence_windows(passages: DataFrame, sizes: tuple[int, ...] = (1, 2), id_col: str = "passage_id", text_col: str = "text") -> DataFrame:
    """(id_col, fragment_id, first, last, size, text): windows of adjacent sentences of each passage.
    Sentences are numbered from 1; those without a letter begin and end no window and count in none,
    but keep their number and stand in the text of a window around them."""
    if not sizes or len(set(sizes)) < len(sizes) or min(sizes) < 1:
        raise ValueError("sizes must be distinct and positive")
    split = sentences(passages.select(id_col, text_col), id_col, text_col)
    one = split.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("paragraph", "sentence", "text"))).alias("s"))
    one = one.withColumn("s", F.transform("s", lambda x, i: F.struct((i + 1).alias("at"), x["text"].alias("text"))))
    one = one.withColumn("kept", F.transform(F.filter("s", lambda x: x["text"].rlike(r"\p{L}")), lambda x: x["at"]))
    parts = []
    for size in sizes:
        starts = F.when(F.size("kept") >= size, F.sequence(F.lit(1), F.size("kept") - (size - 1))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, _window(size)))
    out = one.select(id_col, "s", F.explode(F.concat(*parts)).alias("w")).select(id_col, "s", "w.*")
    inside = F.filter("s", lambda x: x["at"].between(F.col("first"), F.col("last")))
    name = F.concat(F.col(id_col).cast("string"), F.format_string("#s%04d-%04d", "first", "last"))
    return out.select(id_col, name.alias("fragment_id"), "first", "last", "size", F.array_join(F.transform(inside, lambda x: x["text"]), " ").alias("text"))


def _window(size: int):
    return lambda i: F.struct(F.element_at("kept", i).alias("first"), F.element_at("kept", i + (size - 1)).alias("last"), F.lit(size).alias("size"))


def fallback_targets(traces: DataFrame, entailed: DataFrame) -> DataFrame:
    """Traces that have results, none of them telling: where shorter premises may help."""
    flat = traces.filter("signal = 'neutral' and verdict = 'not_checkable' and reason = 'no_entail_signal'")
    return flat.join(entailed.select("claim_id").distinct(), "claim_id", "left_semi")


def variant_entailment(entailed: DataFrame, fragments: DataFrame, targets: DataFrame) -> DataFrame:
    """The results of a variant run: a target's own ones and those of its fragments, which come after."""
    longest = entailed.groupBy("claim_id").agg(F.max("ordinal").alias("most"))
    later = fragments.join(targets.select("claim_id"), "claim_id", "left_semi").join(longest, "claim_id").withColumn("ordinal", F.col("ordinal") + F.col("most") + 1).drop("most")
    return entailed.unionByName(later.select(*entailed.columns))


def variant_summary(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Diff rows of a variant run in one row: targets, how many recovered and regressed, what changed
    beside them, and the exact agreement before and after."""
    marked = rows.join(targets.select("claim_id", F.lit(True).alias("target")), "claim_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    changed = F.col("baseline_verdict") != F.col("candidate_verdict")
    return marked.agg(
        F.count_if("target").alias("targets"),
        F.count_if(F.col("target") & (F.col("classification") == "recovered")).alias("targets_recovered"),
        F.count_if(F.col("classification") == "regressed").alias("regressed"),
        F.count_if(~F.col("target") & changed).alias("changed_beside"),
        F.count_if(F.col("baseline_verdict") == F.col("gold")).alias("exact_before"),
        F.count_if(F.col("candidate_verdict") == F.col("gold")).alias("exact_after"),
    )


def absence_route(traces: DataFrame, claims: DataFrame, entailed: DataFrame, passages: DataFrame) -> DataFrame:
    """traces with route and final verdict: a negated claim without any signal counts as supported when
    no primary passage that itself is not negated contradicts it.  Off in the rules as shipped."""
    asserting = entailed.filter("label = 'contradict'").join(passages.filter("trust_level = 'primary' and not p_negation").select("passage_id"), "passage_id", "left_semi")
    against = asserting.select("claim_id", F.lit(True).alias("against")).distinct()
    rows = traces.join(claims.select("claim_id", "negated"), "claim_id").join(against, "claim_id", "left")
    applies = F.col("negated") & (F.col("verdict") == "not_checkable") & F.col("reason").eqNullSafe(F.lit("no_entail_signal")) & F.col("against").isNull()
    return rows.select(*traces.columns, applies.alias("route"), F.when(applies, "supported").otherwise(F.col("verdict")).alias("final"))


def join_gold(records: DataFrame, key: DataFrame) -> DataFrame:
    """Blinded records(ref, raw_gold, flags, citation) under their claims: key(ref, claim_id, condition,
    model, confidence).  A citation missing_needed becomes a flag; starved are claims of confidence 0
    that people found supported.  Refs of one side only have a null claim_id or raw_gold."""
    merged = records.join(key, "ref", "full_outer")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    needed = F.trim(F.coalesce("citation", F.lit(""))) == "missing_needed"
    gold, _, _ = calibrate.crosswalk_gold(F.col("raw_gold"), flags)
    bridged = F.when(needed & ~F.array_contains(flags, "missing_needed"), F.concat(flags, F.array(F.lit("missing_needed")))).otherwise(flags)
    return merged.select("ref", "claim_id", "condition", "model", "raw_gold", bridged.alias("flags"), ((F.col("confidence") == 0.0) & (gold == "supported")).alias("starved"))
