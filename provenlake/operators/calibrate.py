"""Agreement of verdicts with human labels: pairs(claim_id, condition, model, gold, cal, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def crosswalk_gold(verdict: Column, flags: Column) -> tuple[Column, Column, Column]:
    """(verdict, audit flags, citation status) of a raw human label and its flags."""
    names = {"overconfident": "overstated", "source_scope_error": "source_scope_error", "false_caution": "false_caution"}
    mapped = F.array_compact(F.transform(flags, lambda f: F.coalesce(*[F.when(f == a, F.lit(b)) for a, b in names.items()])))
    inferred = F.when(verdict == "reasonable_inference", F.array(F.lit("inferred"))).otherwise(F.array().cast("array<string>"))
    citation = F.when(F.array_contains(flags, "missing_needed"), "missing_needed").otherwise("not_applicable")
    return F.when(verdict == "reasonable_inference", "supported").otherwise(verdict), F.array_distinct(F.concat(inferred, mapped)), citation


def check_alignment(gold: DataFrame, traces: DataFrame, starved: DataFrame | None = None, key: str = "claim_id") -> DataFrame:
    """(problem, key) of claims in one table only, and of starved ids without a label; empty if aligned."""
    found = gold.select(key).join(traces.select(key), key, "left_anti").select(F.lit("gold_without_trace").alias("problem"), key)
    found = found.unionByName(traces.select(key).join(gold.select(key), key, "left_anti").select(F.lit("trace_without_gold").alias("problem"), key))
    if starved is not None:
        found = found.unionByName(starved.select(key).join(gold.select(key), key, "left_anti").select(F.lit("starved_without_gold").alias("problem"), key))
    return found


def exact_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(F.col("gold") == F.col("cal")).alias("agree"), F.count("*").alias("total"))


def confusion(pairs: DataFrame) -> DataFrame:
    """All 25 cells, zeros included."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(g, c) for g in K.VERDICTS for c in K.VERDICTS], "gold string, cal string")
    counted = pairs.groupBy("gold", "cal").agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counted, ["gold", "cal"], "left").select("gold", "cal", F.coalesce("n", F.lit(0)).alias("n"))


def _chance_corrected(observed: Column, expected: Column, n: Column) -> Column:
    rest = 1.0 - expected
    flat = F.when(F.abs(1.0 - observed) < 1e-12, 1.0).otherwise(0.0)
    return F.when(n == 0, 0.0).when(F.abs(rest) < 1e-12, flat).otherwise((observed - expected) / F.when(F.abs(rest) < 1e-12, 1.0).otherwise(rest))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa over the five verdicts with its Wald interval, in one row and one pass: the
    marginals are counts by verdict."""
    aggs = [F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("cal")).alias("agree")]
    for v in K.VERDICTS:
        aggs += [F.count_if(F.col("gold") == v).alias(f"g_{v}"), F.count_if(F.col("cal") == v).alias(f"c_{v}")]
    row = pairs.agg(*aggs)
    n = F.col("n")
    pe = F.lit(0.0)
    for v in K.VERDICTS:
        pe = pe + _ratio(F.col(f"g_{v}"), n) * _ratio(F.col(f"c_{v}"), n)
    row = row.select("n", _ratio(F.col("agree"), n).alias("po"), pe.alias("pe"))
    row = row.withColumn("kappa", _chance_corrected(F.col("po"), F.col("pe"), n))
    rest = 1.0 - F.col("pe")
    se = F.sqrt(_ratio(F.greatest(F.col("po") * (1.0 - F.col("po")), F.lit(0.0)), n * rest * rest))
    point = (n == 0) | (F.abs(rest) < 1e-12)
    return row.select(
        "n", "po", "pe", "kappa",
        F.when(point, F.col("kappa")).otherwise(F.greatest(F.lit(-1.0), F.col("kappa") - K.Z_95 * se)).alias("ci_low"),
        F.when(point, F.col("kappa")).otherwise(F.least(F.lit(1.0), F.col("kappa") + K.Z_95 * se)).alias("ci_high"),
    )


def weight(a: str, b: str) -> float:
    return 1.0 - ((K.ORDINAL[a] - K.ORDINAL[b]) / 4.0) ** 2


def weighted_agreement(pairs: DataFrame) -> DataFrame:
    """Quadratically weighted kappa and Gwet's AC2 over pairs with both verdicts on the scale."""
    scale = list(K.ORDINAL)
    on = pairs.filter(F.col("gold").isin(scale) & F.col("cal").isin(scale))
    cells = {(g, c): F.count_if((F.col("gold") == g) & (F.col("cal") == c)).alias(f"{g}__{c}") for g in scale for c in scale}
    row = on.agg(F.count("*").alias("n"), *cells.values())
    n = F.col("n")
    share = {k: _ratio(F.col(f"{k[0]}__{k[1]}"), n) for k in cells}
    gold = {k: sum((share[k, c] for c in scale), F.lit(0.0)) for k in scale}
    cal = {k: sum((share[g, k] for g in scale), F.lit(0.0)) for k in scale}
    pa = sum((weight(g, c) * share[g, c] for g in scale for c in scale), F.lit(0.0))
    pe = sum((weight(g, c) * gold[g] * cal[c] for g in scale for c in scale), F.lit(0.0))
    spread = sum(((gold[k] + cal[k]) / 2.0 * (1.0 - (gold[k] + cal[k]) / 2.0) for k in scale), F.lit(0.0))
    total = sum(weight(a, b) for a in scale for b in scale)
    row = row.select("n", pa.alias("pa"), pe.alias("pe"), (F.lit(total / (len(scale) * (len(scale) - 1))) * spread).alias("pe_ac2"))
    return row.select("n", _chance_corrected(F.col("pa"), F.col("pe"), n).alias("weighted_kappa"), _chance_corrected(F.col("pa"), F.col("pe_ac2"), n).alias("ac2"))


def adverse_by_group(pairs: DataFrame) -> DataFrame:
    """Adverse and checkable verdicts of both sides, overall, by condition and by model, in one pass."""

    def counts(side: str) -> list[Column]:
        return [
            F.count_if(F.col(side).isin("unsupported", "contradicted")).alias(f"{side}_adverse"),
            F.count_if(F.col(side) != "not_checkable").alias(f"{side}_checkable"),
        ]

    sets = pairs.groupingSets([[], ["condition"], ["model"]], "condition", "model")
    rows = sets.agg(F.grouping_id().alias("g"), *counts("cal"), *counts("gold"))
    kind = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "condition").otherwise("model")
    name = F.when(F.col("g") == 3, F.lit("overall")).otherwise(F.coalesce("condition", "model"))
    return rows.select(kind.alias("kind"), name.alias("name"), "cal_adverse", "cal_checkable", "gold_adverse", "gold_checkable")


def recall_floor(pairs: DataFrame, starved: DataFrame, key: str = "claim_id") -> DataFrame:
    cal = pairs.join(starved.select(key).distinct(), key, "left_semi")
    return cal.agg(
        F.count("*").alias("starved_total"),
        F.count_if(F.col("cal") == "supported").alias("supported"),
        F.count_if(F.col("cal") == "partially_supported").alias("partially_supported"),
        F.count_if(F.col("cal").isin("unsupported", "contradicted")).alias("adverse"),
        F.count_if(F.col("cal") == "not_checkable").alias("not_checkable"),
    )


def flag_tallies(pairs: DataFrame) -> DataFrame:
    """Claims with each flag on either side, zeros included; gold_flags and cal_flags are arrays."""
    each = [F.struct(F.lit(f).alias("flag"), F.count_if(F.array_contains("gold_flags", f)).alias("gold_count"), F.count_if(F.array_contains("cal_flags", f)).alias("cal_count")) for f in K.AUDIT_FLAGS]
    return pairs.agg(F.array(*each).alias("all")).select(F.inline("all"))


def rule_fires(traces: DataFrame, key: str = "claim_id") -> DataFrame:
    """Claims on which each rule fired, once a claim."""
    return traces.select(key, F.explode(F.array_distinct("rules")).alias("rule_id")).groupBy("rule_id").agg(F.count_distinct(key).alias("fired"))


def single_version(traces: DataFrame, col: str = "library_version") -> str:
    found = [r[0] for r in traces.select(col).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError("inconsistent library_version across traces")
    return found[0] if found else "unknown"


def calibration(pairs: DataFrame, starved: DataFrame, traces: DataFrame) -> dict[str, DataFrame]:
    """Every metric table by name; pairs has gold, cal, gold_flags, cal_flags, condition and model."""
    return {
        "agreement": exact_agreement(pairs), "confusion": confusion(pairs), "kappa": kappa(pairs), "weighted": weighted_agreement(pairs),
        "adverse": adverse_by_group(pairs), "recall_floor": recall_floor(pairs, starved), "flags": flag_tallies(pairs), "rules": rule_fires(traces),
    }
