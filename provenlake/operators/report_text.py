"""The Markdown report of each bundle as ordered lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..tables import settled
from .report import CLAIM, claim_register, escaped, evidence_links, inline, quality_notes

#: The report's texts.
HEADER = f"*Generated by {K.AUDITOR} using deterministic supplied-evidence rules.*"
METADATA = (
    "- Audit boundary: supplied-evidence support only; no outside-world assessment.",
    "- External source lookup: not used.",
    "- Match scores and support signals are deterministic supplied-evidence measures; they are not truth probabilities.",
)
LIMITATIONS = (
    "Match scores and support signals are deterministic supplied-evidence measures, not truth probabilities.",
    "This report only audits support from the supplied evidence bundle; it does not assess the outside world.",
)
WARNING = "No evidence sources were supplied; extracted claims are marked needs_source."
COUNTS = {
    "supported": ("Supported", "supported"), "partially_supported": ("Partially supported", "partially supported"), "unsupported": ("Unsupported", "unsupported"),
    "overstated": ("Overstated", "overstated"), "needs_source": ("Needs source", "needs-source"), "not_checkable": ("Not checkable", "not-checkable"),
}
REGISTER = ("| Claim ID | Claim text | Type | Support | Signal | Risk | Strongest evidence | Main issue |", "| --- | --- | --- | --- | --- | --- | --- | --- |")
CANDIDATES = ("| Source | Excerpt | Match score | Reliability | Date | URL | Rationale |", "| --- | --- | --- | --- | --- | --- | --- |")
LINKS_NOTE = "Evidence links come from claim-scoped matches already present in the structured audit report. Counterevidence is never eligible as support."
LINKS = ("| Source | Excerpt | Role | Referenced by claims | Best match score | Reliability | Date | URL |", "| --- | --- | --- | --- | --- | --- | --- | --- |")
NO_CLAIMS, NO_SUPPORT, NO_COUNTER, NO_FLAGS = "No claims were extracted from the draft.", "No support evidence met the admission threshold.", "No counterevidence was linked to this claim.", "No rule flags."
NO_LINKS, NO_GUIDANCE = "No evidence links were found.", "No rewrite guidance was generated for this report."


def plain(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))


def code(text: Column, escape: Callable[[Column], Column] = inline) -> Column:
    return F.concat(F.lit("`"), escape(text), F.lit("`"))


def mark(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit('<a id="'), T.anchor(F.concat_ws("-", F.lit(prefix), *parts), prefix), F.lit('"></a>'))


def four(value: Column) -> Column:
    return F.format_string("%.4f", value)


def row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def lines(*items: str | Column) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in items])


def bullets(items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit("- "), plain(x)))


def titled(title: str, body: Column, otherwise: str | None = None) -> Column:
    """A part with a bold title; without a body, what stands there instead, or nothing at all."""
    head = lines("", f"**{title}**", "")
    return F.when(F.size(body) > 0, F.concat(head, body)).otherwise(F.array().cast("array<string>") if otherwise is None else F.concat(head, lines(otherwise)))


def dated(date: Column) -> Column:
    return F.coalesce(date.cast("string"), F.lit("not dated"))


def _candidates(contexts: DataFrame) -> DataFrame:
    """(bundle_id, claim_id, support, counter): table rows of a claim's candidates, of which there are few, by rank."""
    c = F.col
    cells = row(code(c("source_id"), escaped), code(c("excerpt_id"), escaped), four(c("score")), escaped(c("reliability")), escaped(dated(c("source_date"))), escaped(F.coalesce("url", F.lit("not supplied"))), escaped(F.coalesce("rationale", F.lit("No rationale recorded."))))
    told = contexts.select(*CLAIM, "role", F.struct("rank", "source_id", "excerpt_id", cells.alias("line")).alias("x"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("x")))), lambda x: x["line"]).alias(role) for role in ("support", "counter")]
    return told.groupBy(*CLAIM).agg(*lists)


def _placed(rows: DataFrame, part: int, body: Column, place: Column | None = None) -> DataFrame:
    """Lines of rows: an array a row, in the order of the part, the row's place and the array."""
    place = F.lit(None).cast("struct<a:int,b:int,c:string>") if place is None else place
    return rows.select("bundle_id", F.lit(part).alias("part"), place.alias("place"), F.posexplode(body).alias("step", "line"))


def markdown_lines(assessments: DataFrame, contexts: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """(bundle_id, part, place, step, line): each bundle's report, its lines in the order of part, place
    and step.

    assessments may have `location`: claims then stand by paragraph and sentence, else by id.  contexts
    may have `rationale`.  bundles(bundle_id, n_sources) names bundles that have no claim, and those
    without sources, which get a warning.
    """
    assessments = assessments if "location" in assessments.columns else assessments.withColumn("location", F.lit(None).cast("string"))
    contexts = contexts if "rationale" in contexts.columns else contexts.withColumn("rationale", F.lit(None).cast("string"))
    # each part reads them again
    assessments, contexts = settled(assessments), settled(contexts)
    number = lambda k: F.regexp_extract(F.coalesce("location", F.lit("")), r"^paragraph:(\d+):sentence:(\d+)$", k).try_cast("int")
    placed = F.struct(number(1).alias("a"), number(2).alias("b"), F.col("claim_id").alias("c"))
    rows = assessments.withColumn("place", placed)

    named = rows.select("bundle_id").distinct() if bundles is None else bundles.groupBy("bundle_id").agg(F.max("n_sources").alias("n_sources"))
    named = named if bundles is not None else named.withColumn("n_sources", F.lit(1))
    counts = [F.count_if(F.col("support_label") == n).alias(n) for n in COUNTS]
    heads = named.join(rows.groupBy("bundle_id").agg(F.count("*").alias("total"), *counts, F.count_if(F.col("risk_label") == "high").alias("high")), "bundle_id", "left").na.fill(0)
    told = {n: F.col(n).cast("string") for n in ("total", *COUNTS, "high")}
    sentence = F.concat(told["total"], F.lit(" claims extracted. Findings: "), F.concat_ws(", ", *[F.concat_ws(" ", told[n], F.lit(short)) for n, (_, short) in COUNTS.items()]), F.lit(". High-risk claims: "), told["high"], F.lit("."))
    figures = [("Total claims", told["total"]), *((title, told[n]) for n, (title, _) in COUNTS.items()), ("High-risk claims", told["high"])]
    bundle = F.col("bundle_id").cast("string")
    head = lines(
        mark("report", bundle), "", F.concat(F.lit(f"# {K.AUDITOR} report: "), code(bundle)), "", HEADER, "", "## Metadata", "", F.concat(F.lit("- Document ID: "), code(bundle)), *METADATA, "",
        "## Executive summary", "", sentence, "", *[F.concat(F.lit(f"- {title}: "), value) for title, value in figures], "", "## Limitations", "", *[f"- {x}" for x in LIMITATIONS],
    )
    warning = F.when(F.col("n_sources") == 0, lines("", "## Evidence bundle warnings", "", f"- {WARNING}")).otherwise(F.array().cast("array<string>"))
    none = F.when(F.col("total") == 0, lines("", NO_CLAIMS)).otherwise(F.array().cast("array<string>"))

    register = claim_register(assessments, contexts).select(*CLAIM, "strongest", "main_issue").join(rows, CLAIM)
    signal = F.coalesce(four(F.col("support_signal")), F.lit("not calculated"))
    issue = F.when(F.col("main_issue") == "", "No rule issue recorded.").otherwise(F.col("main_issue"))
    cells = row(code(F.col("claim_id"), escaped), escaped(F.col("claim_text")), F.col("claim_type"), F.col("support_label"), signal, F.col("risk_label"), escaped(F.col("strongest")), escaped(issue))

    full = rows.join(_candidates(contexts), CLAIM, "left").join(quality_notes(assessments, contexts), CLAIM, "left")
    table = lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.concat(lines(*CANDIDATES), F.col(c))).otherwise(F.array().cast("array<string>"))
    flags = F.transform("flags", lambda f: F.concat(F.lit("- "), mark("rule", f["id"]), F.lit(" "), code(f["id"]), F.lit(" / "), code(f["code"]), F.lit(" ("), f["risk"], F.lit(" risk): "), plain(f["message"])))
    said = F.when(F.coalesce("explanation", F.lit("")) == "", "No additional explanation recorded.").otherwise(plain(F.col("explanation")))
    detail = F.concat(
        lines(
            mark("claim", F.col("claim_id")), "", F.concat(F.lit("### "), code(F.col("claim_id")), F.lit(" ("), F.col("support_label"), F.lit(")")), "", F.concat(F.lit("> "), plain(F.col("claim_text"))), "",
            F.concat(F.lit("- Type: "), code(F.col("claim_type"))), F.concat(F.lit("- Support: "), code(F.col("support_label"))), F.concat(F.lit("- Deterministic support signal: "), signal),
            F.concat(F.lit("- Risk: "), code(F.col("risk_label"))), F.concat(F.lit("- Location: "), plain(F.coalesce("location", F.lit("not recorded")))),
        ),
        titled("Linked support evidence", table("support"), NO_SUPPORT), titled("Linked counterevidence", table("counter"), NO_COUNTER), titled("Rule flags", flags, NO_FLAGS),
        titled("Support quality notes", bullets(F.col("notes"))), titled("Explanation", lines(said)), titled("Rewrite guidance", bullets(F.col("rewrite_guidance"))),
        titled("Claim limitations", bullets(F.col("limitations"))), lines(""),
    )

    links = evidence_links(contexts)
    role = F.when(F.col("role") == "counter", "counterevidence").otherwise(F.col("role"))
    # claims are named in the order of the report
    at = contexts.select(*CLAIM, "source_id", "excerpt_id", "role").distinct().join(rows.select(*CLAIM, "place"), CLAIM)
    own = ["bundle_id", "source_id", "excerpt_id", "role"]
    refs = at.groupBy(*own).agg(F.array_sort(F.collect_list("place")).alias("places"))
    links = links.join(refs, own)
    used = F.array_join(F.transform("places", lambda p: F.concat(F.lit("`"), p["c"], F.lit("`"))), ", ")
    link = row(
        F.concat(mark("evidence", F.col("source_id"), F.col("excerpt_id")), F.lit(" "), code(F.col("source_id"), escaped)), code(F.col("excerpt_id"), escaped), role, escaped(used), four(F.col("best_score")),
        escaped(F.col("reliability")), escaped(dated(F.col("source_date"))), escaped(F.coalesce("url", F.lit("not supplied"))),
    )
    # sources, excerpts and roles in their own order: ranked, since a place holds numbers and one text
    order = F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.concat_ws("\x00", "source_id", "excerpt_id", role).alias("c"))
    linked = heads.join(links.select("bundle_id").distinct().withColumn("linked", F.lit(True)), "bundle_id", "left")
    link_head = F.concat(lines("", "## Evidence links", "", LINKS_NOTE, ""), F.when(F.col("linked"), lines(*LINKS)).otherwise(lines(NO_LINKS)))
    guided = rows.filter(F.size("rewrite_guidance") > 0)
    any_guide = heads.join(guided.select("bundle_id").distinct().withColumn("guided", F.lit(True)), "bundle_id", "left")
    guide_head = F.concat(lines("", "## Rewrite guidance", ""), F.when(F.col("guided"), F.array().cast("array<string>")).otherwise(lines(NO_GUIDANCE)))
    guide = F.concat(lines(F.concat(F.lit("### "), code(F.col("claim_id"))), ""), bullets(F.col("rewrite_guidance")), lines(""))

    parts = [
        _placed(heads, 0, F.concat(head, warning, lines("", "## Claim register", "", *REGISTER))), _placed(register, 1, lines(cells), F.col("place")), _placed(heads, 2, F.concat(none, lines("", "## Claim details", ""))),
        _placed(full, 3, detail, F.col("place")), _placed(linked, 4, link_head), _placed(links, 5, lines(link), order), _placed(any_guide, 6, guide_head), _placed(guided, 7, guide, F.col("place")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
