"""Review panels: samples, candidates, checks of reviews, votes of coders and what follows from them.

Tables: parents(parent_id), atoms(parent_id, atom_id), candidates(atom_id, candidate_id, source_id,
passage_id, passage_hash), decompositions(parent_id, [coder,] status), decisions(atom_id, [coder,]
label, confidence), selections(atom_id, [coder,] candidate_id, source_id, passage_id, passage_hash).
Labels are supports, refutes, insufficient and retrieval_gap; confidences sure and unsure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import settled


def draw(*parts: Column) -> Column:
    """Hex SHA-256 of the parts joined by colons: an order that a seed fixes."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def hash_sample(df: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """The n rows of the lowest draw of seed and id.  ValueError where there are fewer."""
    if (had := df.count()) < n:
        raise ValueError(f"a sample of {n} exceeds {had} rows")
    return df.orderBy(draw(F.lit(seed), F.col(id_col)), id_col).limit(n)


def hash_shuffle(candidates: DataFrame, seed: str) -> DataFrame:
    """candidates(atom_id, candidate_id) with place, from 1, in the order of the draw of seed, atom and
    candidate."""
    order = Window.partitionBy("atom_id").orderBy(draw(F.lit(seed), F.col("atom_id"), F.col("candidate_id")), "candidate_id")
    return candidates.select("atom_id", "candidate_id", F.row_number().over(order).cast("long").alias("place"))


CANDIDATE = ("claim_id", "source_id", "passage_id")


def candidate_drift(support: DataFrame, counter: DataFrame) -> DataFrame:
    """Candidates that stand with different hashes or texts."""
    both = support.unionByName(counter)
    return both.groupBy(*CANDIDATE).agg(F.count_distinct(F.struct("passage_hash", "passage_text")).alias("versions")).filter("versions > 1")


def candidate_union(support: DataFrame, counter: DataFrame, sources: DataFrame) -> DataFrame:
    """Support and counter passages of each claim, each once, with candidate_id and the source's title.
    A passage without a source profile has a null title; candidate_drift tells which have two versions,
    of which the least one is given."""
    both = support.unionByName(counter).groupBy(*CANDIDATE).agg(F.min(F.struct("passage_hash", "passage_text")).alias("p"))
    named = both.select(*CANDIDATE, F.concat_ws("/", "source_id", "passage_id").alias("candidate_id"), "p.*")
    return named.join(sources.select("source_id", "source_title"), "source_id", "left")


def export_faults(parents: DataFrame, atoms: DataFrame, candidates: DataFrame, decompositions: DataFrame, decisions: DataFrame, selections: DataFrame) -> DataFrame:
    """(kind, id) of what a complete review may not hold; empty for a good one."""
    approved = decompositions.filter("status = 'approved'").select("parent_id")

    def fault(kind: str, df: DataFrame, col: str = "id") -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("id"))

    decided = decisions.join(atoms, "atom_id")
    chosen = selections.join(candidates.withColumnsRenamed({c: f"e_{c}" for c in ("source_id", "passage_id", "passage_hash")}), ["atom_id", "candidate_id"], "left")
    drifted = F.lit(False)
    for c in ("source_id", "passage_id", "passage_hash"):
        drifted = drifted | ~F.col(c).eqNullSafe(F.col(f"e_{c}"))
    chosen = chosen.withColumn("id", F.concat_ws(":", "atom_id", "candidate_id"))
    known = chosen.join(candidates.select("atom_id", "candidate_id"), ["atom_id", "candidate_id"], "left_semi")
    parts = [
        fault("unknown_parent", decompositions.join(parents, "parent_id", "left_anti"), "parent_id"),
        fault("unknown_atom", decisions.join(atoms, "atom_id", "left_anti"), "atom_id"),
        fault("decision_without_approval", decided.join(approved, "parent_id", "left_anti"), "atom_id"),
        fault("candidate_not_available", chosen.join(candidates, ["atom_id", "candidate_id"], "left_anti")),
        fault("provenance_drift", known.filter(drifted)),
        fault("missing_decomposition", parents.join(decompositions, "parent_id", "left_anti"), "parent_id"),
        fault("needs_revision", decompositions.filter("status <> 'approved'"), "parent_id"),
        fault("missing_decision", atoms.join(decisions, "atom_id", "left_anti"), "atom_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def parent_results(atoms: DataFrame, decompositions: DataFrame, decisions: DataFrame) -> DataFrame:
    """(parent_id, verdict, second_review, reason) of each parent from one coder's decisions."""
    merged = atoms.join(decompositions, "parent_id", "left").join(decisions, "atom_id", "left")
    one = merged.groupBy("parent_id").agg(
        F.max("status").alias("status"),
        F.bool_or(F.col("label").isNull()).alias("open"),
        F.bool_or(F.col("confidence") == "unsure").alias("unsure"),
        *[F.coalesce(F.bool_or(F.col("label") == x), F.lit(False)).alias(x) for x in ("retrieval_gap", "refutes")],
        *[F.coalesce(F.bool_and(F.col("label") == x), F.lit(False)).alias(f"all_{x}") for x in ("supports", "insufficient")],
    )
    cases = [
        (F.col("status").isNull(), "pending", "decomposition not reviewed"),
        (F.col("status") != "approved", "pending", "decomposition needs revision"),
        (F.col("open"), "pending", "one or more atom decisions are missing"),
        (F.col("retrieval_gap"), "pending", "one or more atoms have a retrieval gap; no parent verdict derived"),
        (F.col("refutes"), "contradicted", "at least one material atom is refuted"),
        (F.col("all_supports"), "supported", "all material atoms are supported"),
        (F.col("all_insufficient"), "not_checkable", "all material atoms are insufficient in the bounded packet"),
        (F.lit(True), "partially_supported", "at least one atom is supported and at least one is insufficient"),
    ]
    case = F.coalesce(*[F.when(when, F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("reason"))) for when, v, r in cases])
    return one.select("parent_id", "unsure", case.alias("c")).select(
        "parent_id", "c.verdict", ((F.col("c.verdict") == "pending") | F.coalesce("unsure", F.lit(False))).alias("second_review"), "c.reason"
    )


def _shared(atoms: DataFrame, selections: DataFrame, coders: int) -> DataFrame:
    """Candidates that each atom's votes chose: all, and those that every coder chose."""
    counted = selections.groupBy("atom_id", "candidate_id").agg(F.count_distinct("coder").alias("chose"))
    return counted.groupBy("atom_id").agg(
        F.array_sort(F.collect_list("candidate_id")).alias("union"), F.array_sort(F.collect_list(F.when(F.col("chose") == coders, F.col("candidate_id")))).alias("both")
    )


def dispositions(atoms: DataFrame, votes: DataFrame, selections: DataFrame, coders: int) -> DataFrame:
    """(parent_id, atom_id, disposition, label, shared, all_chosen): which queue an atom goes to, or
    silver_candidate; votes(atom_id, coder, label, confidence) of `coders` coders."""
    counted = votes.groupBy("atom_id").agg(
        F.count_distinct("coder").alias("voted"), F.count_distinct("label").alias("labels"), F.max("label").alias("l"), F.bool_or(F.col("confidence") == "unsure").alias("unsure")
    )
    none = F.array().cast("array<string>")
    rows = atoms.join(counted, "atom_id", "left").join(_shared(atoms, selections, coders), "atom_id", "left")
    rows = rows.withColumns({"union": F.coalesce("union", none), "both": F.coalesce("both", none)})
    kind = (
        F.when(F.coalesce("voted", F.lit(0)) < coders, "missing_vote_queue")
        .when(F.col("labels") > 1, "label_disagreement_queue")
        .when(F.col("unsure"), "uncertainty_queue")
        .when(F.col("l") == "retrieval_gap", "retrieval_gap_queue")
        .when(F.col("l").isin("supports", "refutes") & (F.size("both") == 0), "rationale_disagreement_queue")
        .otherwise("silver_candidate")
    )
    rows = rows.withColumn("disposition", kind)
    agreed = ~F.col("disposition").isin("missing_vote_queue", "label_disagreement_queue")
    listed = agreed & (F.col("disposition") != "retrieval_gap_queue")
    return rows.select(
        "parent_id", "atom_id", "disposition", F.when(agreed, F.col("l")).alias("label"), F.when(listed, F.col("both")).otherwise(none).alias("shared"), F.when(listed, F.col("union")).otherwise(none).alias("all_chosen")
    )


def silver_parents(found: DataFrame) -> DataFrame:
    """(parent_id, verdict) of parents whose atoms are all silver candidates."""
    silver = found.groupBy("parent_id").agg(F.bool_and(F.col("disposition") == "silver_candidate").alias("all")).filter("all")
    clean = found.join(silver.select("parent_id"), "parent_id", "left_semi")
    approved = silver.select("parent_id", F.lit("approved").alias("status"))
    sure = clean.select("atom_id", "label", F.lit("sure").alias("confidence"))
    return parent_results(clean.select("parent_id", "atom_id"), approved, sure).select("parent_id", "verdict")


#: Hex digits of a draw by which an audit sample is counted out.
DIGITS = 4


def audit_sample(silver: DataFrame, parents: int, packet_hash: str) -> DataFrame:
    """Silver parents that are looked at all the same: a fifth of all parents, two at least, of the lowest
    draws.

    Draws are counted by their first digits, 65,536 counts at most: groups below the bound are in whole,
    and only the one that the bound cuts is ranked.
    """
    most = max(2, round(parents * 0.2))
    drawn = silver.select("parent_id", draw(F.lit(packet_hash), F.lit("audit"), F.col("parent_id")).alias("draw"))
    drawn = settled(drawn.withColumn("first", F.left("draw", F.lit(DIGITS))))
    counts = drawn.groupBy("first").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("first"))
    counts = counts.select("first", (upto - F.col("n")).alias("before"), upto.alias("upto")).filter(F.col("before") < most)
    met = drawn.join(F.broadcast(counts), "first")
    cut = met.filter(F.col("upto") > most).withColumn("place", F.row_number().over(Window.partitionBy("first").orderBy("draw", "parent_id")))
    return met.filter(F.col("upto") <= most).select("parent_id").unionByName(cut.filter(F.col("before") + F.col("place") <= most).select("parent_id"))


def human_queue(found: DataFrame, sample: DataFrame) -> DataFrame:
    """(parent_id, reason): one row for each atom that is no silver candidate and each audited parent."""
    queued = found.filter("disposition <> 'silver_candidate'").select("parent_id", F.concat(F.col("atom_id").cast("string"), F.lit(": "), "disposition").alias("reason"))
    return queued.unionByName(sample.select("parent_id", F.lit("deterministic unanimous-item audit").alias("reason")))


def panel_counts(found: DataFrame, silver: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: atoms, parents, silver atoms and parents, queued parents, audited parents."""
    one = found.agg(F.count("*").alias("atoms"), F.count_distinct("parent_id").alias("parents"), F.count_if(F.col("disposition") == "silver_candidate").alias("silver_atoms"))
    counts = {"silver_parents": silver, "queued_parents": human_queue(found, sample).select("parent_id").distinct(), "audited_parents": sample}
    for name, df in counts.items():
        one = one.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return one


def majority_triage(atoms: DataFrame, votes: DataFrame, selections: DataFrame) -> DataFrame:
    """(atom_id, tier, label, votes, backed): strong_majority_suggestion for a label of three votes or
    more, alone at the top, with three quarters of all; weak_available_unanimity for two votes or more
    of one label; else unresolved.  backed lists candidates that two or more of its votes chose."""
    counts = votes.groupBy("atom_id", "label").agg(F.count("*").alias("n"))
    order = Window.partitionBy("atom_id").orderBy(F.desc("n"), "label")
    ranked = counts.withColumns({"place": F.row_number().over(order), "next": F.lead("n").over(order), "all": F.sum("n").over(Window.partitionBy("atom_id"))})
    top = ranked.filter("place = 1").withColumn("alone", F.coalesce(F.col("n") > F.col("next"), F.lit(True)))
    strong = F.col("alone") & (F.col("all") >= 3) & (F.col("n") >= 3)
    tier = F.when(strong, F.when(F.col("n") / F.col("all") >= 0.75, "strong_majority_suggestion")).when(F.col("alone") & (F.col("all") >= 2) & (F.col("n") == F.col("all")), "weak_available_unanimity")
    top = top.select("atom_id", "all", "label", tier.alias("tier")).withColumn("label", F.when(F.col("tier").isNotNull(), F.col("label")))
    agreed = votes.join(top.filter("tier is not null").select("atom_id", "label"), ["atom_id", "label"], "left_semi")
    chosen = selections.join(agreed.select("atom_id", "coder"), ["atom_id", "coder"], "left_semi").groupBy("atom_id", "candidate_id").agg(F.count("*").alias("n")).filter("n >= 2")
    backed = chosen.groupBy("atom_id").agg(F.array_sort(F.collect_list("candidate_id")).alias("backed"))
    rows = atoms.select("atom_id").join(top, "atom_id", "left").join(backed, "atom_id", "left")
    return rows.select(
        "atom_id", F.coalesce("tier", F.lit("unresolved")).alias("tier"), "label", F.coalesce("all", F.lit(0)).alias("votes"), F.coalesce("backed", F.array().cast("array<string>")).alias("backed")
    )


def pairwise_agreement(atoms: DataFrame, decompositions: DataFrame, votes: DataFrame) -> DataFrame:
    """(coder_a, coder_b, comparable, exact, rate) for each pair of coders that decided an atom whose
    decomposition both approved."""
    approved = decompositions.filter("status = 'approved'").select("parent_id", "coder")
    mine = votes.join(atoms, "atom_id").join(approved, ["parent_id", "coder"], "left_semi").select("atom_id", "coder", "label")
    other = mine.select("atom_id", F.col("coder").alias("coder_b"), F.col("label").alias("label_b"))
    pairs = mine.withColumnRenamed("coder", "coder_a").join(other, "atom_id").filter("coder_a < coder_b")
    counted = pairs.groupBy("coder_a", "coder_b").agg(F.count("*").alias("comparable"), F.count_if(F.col("label") == F.col("label_b")).alias("exact"))
    return counted.withColumn("rate", F.bround(F.col("exact") / F.col("comparable"), 4))


#: The form of receipts that is read, and how a whole answer ends.
RECEIPT_FORM, WHOLE = "receipt-1", "end_turn"


def receipt_fault(asked: Column, model: Column) -> Column:
    """What is wrong with a receipt of the columns form, r_hash, stop_reason, r_model, texts and called_at,
    the first that fits; asked is the hash of the prepared request and model the one it names."""
    return (
        F.when(~F.col("form").eqNullSafe(F.lit(RECEIPT_FORM)), F.lit("unsupported form"))
        .when(~F.col("r_hash").eqNullSafe(asked), F.lit("request hash differs"))
        .when(~F.col("stop_reason").eqNullSafe(F.lit(WHOLE)), F.lit("answer did not end"))
        .when(~F.col("r_model").eqNullSafe(model), F.lit("model differs"))
        .when(~F.col("texts").eqNullSafe(F.lit(1)), F.lit("not one text"))
        .when(F.col("called_at").isNull(), F.lit("no time of the call"))
    )


def settled_receipts(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """(request_id, attempts, attempt, output, fault): a row a request(request_id, request_hash, model).

    Of its receipts(request_id, attempt, called_at, form, r_hash, stop_reason, r_model, texts, output)
    the latest sound one counts, by time of the call, then by attempt and output.  A request without a sound one
    stays, as an unavailable vote: no output, and the fault of its latest attempt, or 'no receipt'.
    Receipts of unknown requests count for nothing.  The fold is an aggregate, part by part.
    """
    met = requests.join(receipts, "request_id", "left")
    there = F.col("attempt").isNotNull()
    met = met.withColumn("fault", F.when(there, receipt_fault(F.col("request_hash"), F.col("model"))).otherwise(F.lit("no receipt")))
    sound = F.when(F.col("fault").isNull(), F.struct("called_at", "attempt", "output"))
    faulty = F.when(F.col("fault").isNotNull(), F.struct("called_at", "attempt", "fault"))
    folded = met.groupBy("request_id").agg(F.count_if(there).alias("attempts"), F.max(sound).alias("best"), F.max(faulty).alias("last"))
    return folded.select("request_id", "attempts", "best.attempt", "best.output", F.when(F.col("best").isNull(), F.col("last.fault")).alias("fault"))
