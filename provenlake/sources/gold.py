"""Human labels of a calibration, and the calibration report as a file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import calibrate
from ..tables import settled
from .evidence import yaml_as_json
from .files import SourceError, whole_files
from .named_files import write_named
from .settings import Settings, load_rules, settings_hash
from .traces import verdict_rows

#: The labels and flags that coders give.
LABELS = ("supported", "partially_supported", "reasonable_inference", "unsupported", "contradicted", "not_checkable")
FLAGS = ("source_scope_error", "overconfident", "missing_needed", "false_caution")
TOP, CLAIM = ("gold_version", "starved_claim_ids", "claims"), ("claim_id", "condition", "model", "gold_verdict", "gold_flags")
NEEDED = CLAIM[:4]


@dataclass(frozen=True)
class Gold:
    """claims(claim_id, condition, model, gold, gold_flags, citation), the labels mapped to verdicts and
    audit flags; starved(claim_id); and the version."""

    claims: DataFrame
    starved: DataFrame
    version: str


def _other(keys: Column, known: tuple[str, ...]) -> Column:
    return F.array_except(keys, F.array(*map(F.lit, known)))


def gold_faults(texts: DataFrame) -> DataFrame:
    """(fault) of a gold file's JSON form `doc`: what is no mapping, fields too many or too few, labels
    or flags that are not known, and claims that stand twice."""
    keys = F.json_object_keys("doc")
    top = F.when(F.col("doc").isNull(), "not YAML").when(keys.isNull(), "not a mapping").when(F.size(_other(keys, TOP)) > 0, F.concat(F.lit("unknown field "), _other(keys, TOP)[0]))
    lacks = [F.when(F.get_json_object("doc", f"$.{name}").isNull(), F.lit(f"lacks {name}")) for name in ("gold_version", "claims")]
    faults = texts.select(F.coalesce(top, *lacks).alias("fault"))
    one = texts.select(F.explode(F.from_json(F.get_json_object("doc", "$.claims"), "array<string>")).alias("c"))
    own = F.json_object_keys("c")
    name = F.coalesce(F.get_json_object("c", "$.claim_id"), F.lit("?"))
    gone = [F.when(F.get_json_object("c", f"$.{n}").isNull(), F.lit(f"lacks {n}")) for n in NEEDED]
    flags = F.from_json(F.coalesce(F.get_json_object("c", "$.gold_flags"), F.lit("[]")), "array<string>")
    wrong = F.coalesce(
        F.when(own.isNull(), F.lit("not a mapping")), F.when(F.size(_other(own, CLAIM)) > 0, F.concat(F.lit("unknown field "), _other(own, CLAIM)[0])), *gone,
        F.when(~F.get_json_object("c", "$.gold_verdict").isin(*LABELS), F.lit("unknown gold_verdict")), F.when(F.size(_other(flags, FLAGS)) > 0, F.lit("unknown gold_flags")),
    )
    faults = faults.unionByName(one.select(F.concat_ws(": ", name, wrong).alias("fault")).filter(wrong.isNotNull()))
    twice = one.select(name.alias("n")).groupBy("n").count().filter("count > 1").select(F.concat(F.lit("duplicate claim_id: "), "n").alias("fault"))
    return faults.unionByName(twice).filter("fault is not null")


def read_gold(spark: SparkSession, path: str) -> Gold:
    """The labels of one YAML file; any of gold_faults is a SourceError."""
    found = whole_files(spark, path)
    texts = settled(found.select("error", yaml_as_json(F.coalesce("text", F.lit(""))).alias("doc")))
    fault = texts.filter("error is not null").select(F.col("error").alias("fault")).unionByName(gold_faults(texts)).orderBy("fault").limit(1).collect()
    if fault:
        raise SourceError(path, fault[0].fault)
    kind = "gold_version string, starved_claim_ids array<string>, claims array<struct<claim_id string, condition string, model string, gold_verdict string, gold_flags array<string>>>"
    rows = texts.select(F.from_json("doc", kind).alias("g")).select("g.*")
    claims = rows.select(F.inline("claims"))
    label, flags, citation = calibrate.crosswalk_gold(F.col("gold_verdict"), F.coalesce("gold_flags", F.array().cast("array<string>")))
    claims = claims.select("claim_id", "condition", "model", label.alias("gold"), flags.alias("gold_flags"), citation.alias("citation"))
    return Gold(claims, rows.select(F.explode("starved_claim_ids").alias("claim_id")), rows.first().gold_version)


def paired(gold: Gold, traces: DataFrame) -> DataFrame:
    """Labels beside the traces' verdicts, a row a claim; claims on one side only raise ValueError."""
    cal = verdict_rows(traces)
    apart = calibrate.check_alignment(gold.claims, cal, gold.starved).orderBy("problem", "claim_id").limit(5).collect()
    if apart:
        raise ValueError("; ".join(f"{r.problem}: {r.claim_id}" for r in apart))
    return gold.claims.join(cal, "claim_id")


def calibration_lines(pairs: DataFrame, starved: DataFrame, traces: DataFrame, settings: Settings, pinned_at: str) -> DataFrame:
    """(part, place, line): the calibration report in the order of part and place.  Its only time is
    pinned_at, so equal inputs give equal bytes."""
    spark = pairs.sparkSession
    tables, version = calibrate.calibration(pairs, starved, traces), calibrate.single_version(traces)
    rules, sha = load_rules()
    c, text = F.col, lambda x: F.col(x).cast("string")
    share = lambda a, b: F.concat_ws("/", text(a), text(b))
    percent = lambda a, b: F.format_string("%.1f%%", F.when(c(b) > 0, c(a) * 100.0 / c(b)).otherwise(0.0))
    overall = tables["adverse"].filter("kind = 'overall'")
    n = pairs.agg(F.count("*").alias("n_claims"))

    def fixed(part: int, *lines: str) -> DataFrame:
        return spark.createDataFrame([(part, f"{k:04d}", line) for k, line in enumerate(lines)], "part int, place string, line string")

    def spread(rows: DataFrame, part: int, *lines: Column) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), F.posexplode(F.array(*lines)).alias("k", "line")).select("part", F.format_string("%04d", "k").alias("place"), "line")

    floor, agree = tables["recall_floor"], tables["agreement"].crossJoin(tables["kappa"].drop("n")).crossJoin(tables["weighted"])
    of = F.concat(F.lit("/"), text("starved_total"))
    matrix = tables["confusion"].groupBy("gold").agg(*[F.sum(F.when(c("cal") == v, c("n"))).alias(v) for v in K.VERDICTS])
    place = F.array_position(F.array(*map(F.lit, K.VERDICTS)), c("gold")).cast("string")
    adverse = F.concat(F.lit("| "), "name", F.lit(" | "), share("cal_adverse", "cal_checkable"), F.lit(" | "), share("gold_adverse", "gold_checkable"), F.lit(" |"))
    flag_place = F.format_string("%04d", F.array_position(F.array(*map(F.lit, K.AUDIT_FLAGS)), c("flag")))
    model = lambda m: f"{m['model_id']}@{m['hf_revision_sha']}"
    four = lambda x: F.format_string("%.4f", x)
    title = lambda x: f"| {x} | CAL adverse/checkable | gold adverse/checkable |"
    fired = tables["rules"].crossJoin(n)
    plain = lambda rows, part, place, line: rows.select(F.lit(part).alias("part"), place.alias("place"), line.alias("line"))
    parts = [
        fixed(0, "# Calibration report", f"Generated: {pinned_at}", f"Library: {K.AUDITOR} {version}", f"Rules: {rules['rules_version']} (sha: {sha})", f"audit_config_hash: {settings_hash(settings)}"),
        spread(n, 1, F.concat(F.lit("Claims scored: "), text("n_claims")), F.lit(""), F.lit("## 1. Recall floor on starved claims")),
        spread(floor, 2, *[F.concat(F.lit(f"- {said}: "), text(name), of) for name, said in (("supported", "supported"), ("partially_supported", "partially_supported"), ("adverse", "adverse (unsupported + contradicted)"), ("not_checkable", "not_checkable"))]),
        fixed(3, "", "## 2. Agreement and reliability"),
        spread(
            agree, 4, F.concat(F.lit("- Exact agreement: "), share("agree", "total"), F.lit(" ("), percent("agree", "total"), F.lit(")")), F.concat(F.lit("- Cohen's kappa: "), four("kappa")),
            F.concat(F.lit("- 95% CI (asymptotic Wald): ["), four("ci_low"), F.lit(", "), four("ci_high"), F.lit("]")),
            F.concat(F.lit("- Gwet AC2 (quadratic, on-scale n="), text("n"), F.lit("): "), four("ac2")), F.concat(F.lit("- Weighted kappa (quadratic, on-scale): "), four("weighted_kappa")),
        ),
        fixed(5, "", "## 3. Support-verdict confusion (gold rows x CAL columns)", "| gold \\ CAL | " + " | ".join(K.VERDICTS) + " |", "|" + "---|" * (len(K.VERDICTS) + 1)),
        plain(matrix, 6, place, F.concat(F.lit("| "), F.concat_ws(" | ", "gold", *map(text, K.VERDICTS)), F.lit(" |"))),
        fixed(7, "", "## 4. Flags axis (gold vs CAL counts)", "| flag | gold | CAL |", "|---|---|---|"),
        plain(tables["flags"], 8, flag_place, F.concat(F.lit("| "), F.concat_ws(" | ", "flag", text("gold_count"), text("cal_count")), F.lit(" |"))),
        fixed(9, "", "## 5. Per-condition adverse rate", title("condition"), "|---|---|---|"), plain(tables["adverse"].filter("kind = 'condition'"), 10, c("name"), adverse),
        fixed(11, "", "## 6. Per-model adverse rate", title("model"), "|---|---|---|"), plain(tables["adverse"].filter("kind = 'model'"), 12, c("name"), adverse),
        fixed(13, "", "## 7. Rule fire rates", "| rule_id | claims fired |", "|---|---|"),
        plain(fired, 14, c("rule_id"), F.concat(F.lit("| "), c("rule_id"), F.lit(" | "), share("fired", "n_claims"), F.lit(" ("), percent("fired", "n_claims"), F.lit(") |"))),
        fixed(15, "", "## Trace metadata", f"- Retriever: {model(settings.retriever)}", f"- Entailer: {model(settings.entailer)}", "- Determinism: report timestamp pinned via --pinned-at"),
        spread(overall, 16, F.concat(F.lit("- Overall adverse (CAL): "), share("cal_adverse", "cal_checkable"), F.lit("; (gold): "), share("gold_adverse", "gold_checkable"))),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def write_calibration(lines: DataFrame, folder: str, name: str) -> None:
    """The report's lines as the file `name` below folder; one that is there must be identical."""
    # a place is a text, so lines are put in order by a range sort and numbered by it
    pieces = lines.orderBy("part", "place").withColumn("piece", F.monotonically_increasing_id())
    write_named(pieces.select(F.lit(name).alias("file"), "piece", F.concat("line", F.lit("\n")).cast("binary").alias("content")), folder)
