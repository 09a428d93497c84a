"""Retrieve-entail-aggregate verdicts over provider columns.

Features, embeddings and entailment results are input columns that any provider may fill; everything
here is a ranking or an expression.  The suppression of ineligible evidence is a ranked scan: every
non-neutral result of a claim is judged on its own, and the first one that may stand decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T


def normalized_vector(vector: Column) -> Column:
    """Unit vector in double; zero vectors stay."""
    wide = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(F.transform(wide, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return F.transform(wide, lambda x: F.when(length > 0, x / length).otherwise(x))


#: Rows of a bundle that make one block of vectors.
BLOCK_ROWS = 2048


def _blocks(rows: DataFrame, keys: list[str], own: list[str], side: str, cells: DataFrame) -> DataFrame:
    """Blocks of rows(keys, own, vec) of about BLOCK_ROWS: a row a block, its columns arrays, beside each
    of the other side's blocks of the bundle."""
    other = "p" if side == "c" else "c"
    placed = rows.join(cells, keys).withColumn(f"{side}_cell", F.pmod(F.xxhash64(*own), f"{side}_cells"))
    packed = placed.groupBy(*keys, f"{side}_cell", f"{other}_cells").agg(F.collect_list(F.struct(*own, "vec")).alias("rows"))
    columns = [F.col(f"rows.{c}").alias(f"{side}_{c}") for c in own] + [F.flatten("rows.vec").alias(f"{side}_vec")]
    return packed.withColumn(f"{other}_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_cells") - 1))).select(*keys, "c_cell", "p_cell", *columns)


def _best_of_blocks(keys: list[str], k: int):
    """The k best passages of a block for each claim of another: one matrix product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = {name: batch.column(name)[at].values for name in ("c_claim_id", "c_vec", "p_passage_id", "p_ordinal", "p_vec")}
                n, m = len(one["c_claim_id"]), len(one["p_passage_id"])
                score = one["c_vec"].to_numpy().reshape(n, -1) @ one["p_vec"].to_numpy().reshape(m, -1).T
                # half-up rounding by floor, as functions.text.rounded has it; passages stand by ordinal
                score = np.floor(score * 1e6 + 0.5) / 1e6
                rank = np.argsort(one["p_ordinal"].to_numpy(zero_copy_only=False), kind="stable")
                best = rank[np.argsort(-score[:, rank], axis=1, kind="stable")[:, :k]]
                claim, hit = np.repeat(np.arange(n), best.shape[1]), best.ravel()
                columns = [pa.array([batch.column(c)[at].as_py()] * len(hit), batch.schema.field(c).type) for c in keys]
                columns += [one["c_claim_id"].take(pa.array(claim)), one["p_passage_id"].take(pa.array(hit)), one["p_ordinal"].take(pa.array(hit)), pa.array(score[claim, hit])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "claim_id", "passage_id", "ordinal", "score"])

    return run


def retrieve(claims: DataFrame, passages: DataFrame, k: int = K.RETRIEVAL_TOP_K, keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """For claims(keys, claim_id, embedding) the k passages(keys, passage_id, ordinal, embedding) of
    the same bundle of the highest cosine, earlier ones first among equals; no floor is applied.
    Scores are rounded to six digits before they are ranked.

    A bundle's vectors lie in blocks of about BLOCK_ROWS, and every block of claims meets every block
    of passages in a matrix product of its own, which gives k rows a claim: a large bundle is many
    tasks' work, and no row of a pair is made beside these.  Rows without a vector, or of a bundle
    without the other side, have no result; vectors of a bundle are of one length.
    """
    on = list(keys)
    c = claims.select(*on, "claim_id", normalized_vector(F.col("embedding")).alias("vec")).filter("vec is not null")
    p = passages.select(*on, "passage_id", "ordinal", normalized_vector(F.col("embedding")).alias("vec")).filter("vec is not null")
    counts = c.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("c_cells")).join(p.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("p_cells")), on)
    met = _blocks(c, on, ["claim_id"], "c", counts).join(_blocks(p, on, ["passage_id", "ordinal"], "p", counts), [*on, "c_cell", "p_cell"])
    kinds = {f.name: f.dataType.simpleString() for f in [*c.schema, *p.schema]}
    schema = ", ".join([*(f"{x} {kinds[x]}" for x in [*on, "claim_id", "passage_id", "ordinal"]), "score double"])
    scored = met.mapInArrow(_best_of_blocks(on, k), schema)
    order = Window.partitionBy(*on, "claim_id").orderBy(F.desc("score"), "ordinal")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def admitted(retrieval: DataFrame, floor: float = K.RETRIEVAL_FLOOR) -> DataFrame:
    return retrieval.filter(F.col("score") >= floor)


LABELS = ("entail", "neutral", "contradict")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    parts = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def entail_label(logits: Column) -> Column:
    """Label of the largest logit, the first among equals."""
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position(logits, F.array_max(logits)).cast("int"))


def aggregate_signal(entailment: DataFrame, claims: DataFrame, key: str = "claim_id") -> DataFrame:
    """The strongest non-neutral result of each claim, else the strongest neutral one, the earlier
    among equals; a claim without results is neutral at 0."""
    best = F.max_by(F.struct("label", "score", "passage_id"), F.struct(F.col("label") != "neutral", "score", -F.col("ordinal")))
    found = entailment.groupBy(key).agg(best.alias("s"))
    return claims.select(key).join(found, key, "left").select(
        key, F.coalesce("s.label", F.lit("neutral")).alias("label"), F.coalesce("s.score", F.lit(0.0)).alias("score"), F.col("s.passage_id").alias("passage_id")
    )


def year_like(quantity: Column) -> Column:
    value = quantity["value"]
    return quantity["unit"].isNull() & (value == F.floor(value)) & (value >= K.FIRST_YEAR) & (value <= K.LAST_YEAR)


def within(a: Column, b: Column, tolerance: Column) -> Column:
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.when(tolerance == 0.0, a == b).otherwise(F.abs(a - b) <= tolerance * scale)


def unmatched_quantities(claim: Column, passage: Column, tolerance: Column) -> Column:
    """Claim quantities with comparable passage quantities of which none is within tolerance.
    Quantities are structs of value and unit; comparable are equal units and equal year-likeness."""

    def bad(q: Column) -> Column:
        rivals = F.filter(passage, lambda p: q["unit"].eqNullSafe(p["unit"]) & (year_like(q) == year_like(p)))
        return (F.size(rivals) > 0) & ~F.exists(rivals, lambda p: within(q["value"], p["value"], tolerance))

    return F.filter(claim, bad)


def numeric_outcome(claim: Column, passage: Column, approximate: Column, tolerance: float = K.TOLERANCE) -> Column:
    """Verdict that the numeric rule proposes, or null: contradicted when the claim's only quantity is
    unmatched, partially_supported when one of several is."""
    wide = F.when(approximate, F.greatest(F.lit(tolerance), F.lit(K.APPROX_TOLERANCE))).otherwise(F.lit(tolerance))
    bad = F.size(unmatched_quantities(claim, passage, wide))
    return F.when((bad > 0) & (F.size(claim) == 1), "contradicted").when(bad > 0, "partially_supported")


def severity(verdict: Column) -> Column:
    return F.coalesce(*[F.when(verdict == v, F.lit(n)) for v, n in K.SEVERITY.items()])


def classify(rows: DataFrame, false_caution_at: float = K.SUPPORTED) -> DataFrame:
    """rows with verdict, reason, confidence, audit_flags and rules, each row judged by itself.

    A row is a claim with one signal: label, score; of the claim: sentence_type, token_count, negated,
    any_retrieved, claim_strong, hedges, approximate, c_quantities, c_lemmas; of the contributing
    passage (null without one): trust_level, p_negation, p_scope, p_quantities, p_lemmas.
    """
    label, score = F.col("label"), F.col("score")
    p_negation = F.coalesce("p_negation", F.lit(False))
    out = (F.col("sentence_type").isin("opinion", "question", "imperative")) | (F.col("token_count") < K.LEAST_TOKENS)
    gate = (
        F.when(out, "A1_scope")
        .when(~F.col("any_retrieved"), "A2_retrieval_empty")
        .when(F.col("negated") & (label == "entail") & ~p_negation, "A3_negation_backstop")
        .when((label == "contradict") & (score >= K.CONTRADICTED), "A4_hard_contradiction")
    )
    provisional = (
        F.when((label == "entail") & (score >= K.SUPPORTED), "supported").when(label == "entail", "partially_supported").when(label == "contradict", "unsupported")
    )
    rows = rows.withColumns({"gate": gate, "provisional": provisional})
    plain = F.col("gate").isNull() & F.col("provisional").isNotNull()
    none = F.array().cast("array<struct<value:double,unit:string>>")
    numeric = numeric_outcome(F.coalesce("c_quantities", none), F.coalesce("p_quantities", none), F.col("approximate"))
    over = plain & F.col("claim_strong") & F.coalesce(F.col("p_scope") == "weak", F.lit(False)) & F.col("provisional").isin("supported", "partially_supported")
    verbatim = (F.size("c_lemmas") > 0) & (F.size(F.array_except("c_lemmas", F.coalesce("p_lemmas", F.array().cast("array<string>")))) == 0)
    rows = rows.withColumns(
        {
            "numeric": F.when(plain, numeric),
            "over": over,
            "inferred": plain & (F.col("provisional") == "supported") & ~verbatim & ~F.col("claim_strong"),
            "background": plain & F.coalesce(F.col("trust_level") == "background", F.lit(False)),
            "cautious": plain & (F.col("provisional") == "supported") & F.col("hedges") & (score >= false_caution_at),
        }
    )
    worst = F.greatest(severity(F.col("provisional")), F.coalesce(severity(F.col("numeric")), F.lit(0)), F.when(F.col("over") & (F.col("provisional") == "supported"), 1).otherwise(0))
    final = F.element_at(F.array(*[F.lit(v) for v in ("supported", "partially_supported", "unsupported", "contradicted")]), worst + 1)
    verdict = (
        F.when(F.col("gate").isin("A1_scope", "A2_retrieval_empty"), "not_checkable")
        .when(F.col("gate").isNotNull(), "contradicted")
        .when(F.col("provisional").isNull(), "not_checkable")
        .otherwise(final)
    )
    reason = F.when(F.col("gate") == "A1_scope", "out_of_scope").when(F.col("gate") == "A2_retrieval_empty", "no_evidence").when(F.col("gate").isNull() & F.col("provisional").isNull(), "no_entail_signal")
    rows = rows.withColumns({"verdict": verdict, "reason": reason})
    adverse = F.col("verdict").isin("unsupported", "contradicted")
    found = F.array_compact(
        F.array(
            F.when(F.col("over"), F.lit("overstated")),
            F.when(F.col("inferred") & ~adverse, F.lit("inferred")),
            F.when(F.col("background"), F.lit("source_scope_error")),
            F.when(F.col("cautious") & ~adverse, F.lit("false_caution")),
        )
    )
    rules = F.array_compact(
        F.array(
            F.coalesce("gate", F.lit("B5_degree")),
            F.when(F.col("numeric").isNotNull(), F.lit("C6a_numeric")),
            F.when(F.col("over"), F.lit("C6b_strength_scope")),
            F.when(F.col("inferred"), F.lit("C6c_inferred")),
            F.when(F.col("background"), F.lit("C6d_source_scope")),
            F.when(F.col("cautious"), F.lit("C6f_false_caution")),
        )
    )
    confidence = F.when(F.col("gate").isNotNull(), "high").when(F.col("provisional").isNull(), "low").otherwise("medium")
    return rows.withColumns({"audit_flags": found, "rules": rules, "confidence": confidence}).drop("gate", "provisional", "numeric", "over", "inferred", "background", "cautious")


def suppression(rows: DataFrame) -> Column:
    """Rule that keeps a row's adverse verdict from standing, or null: a source that is not primary,
    or a negated claim that the contradicting passage itself agrees with."""
    adverse = F.col("verdict").isin("unsupported", "contradicted") & F.col("passage_id").isNotNull()
    mirror = F.col("negated") & (F.col("label") == "contradict") & F.coalesce("p_negation", F.lit(False))
    return F.when(adverse & (F.col("trust_level") != "primary"), "P1_eligibility_suppressed").when(adverse & mirror, "P2_absence_mirror_suppressed")


CLAIM_FEATURES = ["sentence_type", "token_count", "negated", "any_retrieved", "claim_strong", "hedges", "approximate", "c_quantities", "c_lemmas"]
PASSAGE_FEATURES = ["trust_level", "p_negation", "p_scope", "p_quantities", "p_lemmas"]


def verdicts(claims: DataFrame, entailment: DataFrame, passages: DataFrame, key: str = "claim_id") -> DataFrame:
    """One verdict a claim: verdict, reason, confidence, audit_flags, rules (suppressions first), the
    deciding label, score and passage_id.

    claims has key and CLAIM_FEATURES; entailment has key, passage_id, ordinal, label, score; passages
    has passage_id and PASSAGE_FEATURES.  Non-neutral results are ranked by score, then order; the
    first that no guard suppresses decides.  Where none is left the signal is neutral at 0.
    """
    ranked = entailment.filter("label <> 'neutral'").join(passages, "passage_id", "left").join(claims, key)
    judged = classify(ranked)
    judged = judged.withColumn("suppressed", suppression(judged))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "ordinal")
    judged = judged.withColumn("place", F.row_number().over(order))
    out = ["verdict", "reason", "confidence", "audit_flags", "rules", "label", "score", "passage_id"]
    decided = judged.groupBy(key).agg(
        F.min_by(F.when(F.col("suppressed").isNull(), F.struct("place", *out)), F.when(F.col("suppressed").isNull(), F.col("place"))).alias("d"),
        F.array_sort(F.collect_list(F.when(F.col("suppressed").isNotNull(), F.struct("place", "suppressed")))).alias("lost"),
    )
    blank = {"label": F.lit("neutral"), "score": F.lit(0.0), "passage_id": F.lit(None).cast("string"), "trust_level": F.lit(None).cast("string"), "p_negation": F.lit(None).cast("boolean"), "p_scope": F.lit(None).cast("string"), "p_quantities": F.lit(None).cast("array<struct<value:double,unit:string>>"), "p_lemmas": F.lit(None).cast("array<string>")}
    neutral = classify(claims.withColumns(blank)).select(key, F.struct(F.lit(0).alias("place"), *out).alias("n"))
    merged = neutral.join(decided, key, "left").withColumn("f", F.coalesce("d", "n"))
    before = F.when(F.col("d").isNotNull(), F.filter("lost", lambda x: x["place"] < F.col("d.place"))).otherwise(F.col("lost"))
    names = F.coalesce(F.transform(before, lambda x: x["suppressed"]), F.array().cast("array<string>"))
    return merged.select(key, *[F.concat(names, "f.rules").alias("rules") if c == "rules" else F.col(f"f.{c}").alias(c) for c in out])


def contract_verdict(verdict: Column, flags: Column) -> Column:
    """The contract's flat verdict of a verdict and its flags."""
    over = verdict.isin("supported", "partially_supported") & F.array_contains(flags, "overstated")
    return F.when(over, "overstated").when(verdict == "contradicted", "unsupported").otherwise(verdict)


def audit_notes(claim_id: Column, verdict: Column, reason: Column, flags: Column, label: Column, score: Column, confidence: Column) -> Column:
    return F.concat(
        F.lit(f"{K.AUDITOR} retrieve-entail: "), verdict, F.coalesce(F.concat(F.lit(" ("), reason, F.lit(")")), F.lit("")),
        F.lit("; flags="), F.when(F.size(flags) > 0, F.array_join(flags, ",")).otherwise("none"),
        F.lit("; citation_status=not_applicable; entail_signal="), label, F.lit("@"), F.format_string("%.4f", F.bround(score, 4)),
        F.lit("; audit_confidence="), confidence, F.lit(". Full trace: claims/"), claim_id, F.lit(".audit-trace.json"),
    )
