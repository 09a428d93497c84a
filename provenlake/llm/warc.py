"""WARC derivatives: metadata and plain-text conversion records from response records.

Everything is a projection of DataFrame functions: no record meets another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Elements without text of their own, elements that end a line, and entities.
SILENT = ("script", "style", "noscript", "template")
BREAKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
    ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&hellip;", "\u2026"), ("&middot;", "\u00b7"),
    ("&bull;", "\u2022"), ("&copy;", "\u00a9"), ("&reg;", "\u00ae"), ("&trade;", "\u2122"), ("&deg;", "\u00b0"), ("&euro;", "\u20ac"), ("&pound;", "\u00a3"), ("&times;", "\u00d7"),
    ("&agrave;", "\u00e0"), ("&aacute;", "\u00e1"), ("&acirc;", "\u00e2"), ("&auml;", "\u00e4"), ("&ccedil;", "\u00e7"), ("&egrave;", "\u00e8"), ("&eacute;", "\u00e9"), ("&ecirc;", "\u00ea"),
    ("&iacute;", "\u00ed"), ("&ntilde;", "\u00f1"), ("&oacute;", "\u00f3"), ("&ouml;", "\u00f6"), ("&uacute;", "\u00fa"), ("&uuml;", "\u00fc"), ("&szlig;", "\u00df"),
)
#: Numeric entities: decimal and hexadecimal.
DECIMAL, HEXADECIMAL = r"&#0*([1-9][0-9]{0,6});", r"&#[xX]0*([1-9A-Fa-f][0-9A-Fa-f]{0,5});"


def html_text(html: Column) -> Column:
    """Plain text of HTML: comments and silent elements go, block elements end a line, other tags
    vanish, numeric and common named entities are decoded; runs of blanks become one, empty lines go."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for name in SILENT:
        text = F.regexp_replace(text, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = _bound(text, lambda t: F.when(F.contains(t, F.lit("&")), _decoded(t)).otherwise(t))
    text = F.regexp_replace(text, r"[ \t\r\x0B\f]+", " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _decoded(text: Column) -> Column:
    """Named entities, then numeric ones, then &amp; last, so that nothing is decoded twice.  Numbers that are no
    character stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES for x in pair])

    def named(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit("&[A-Za-z]+;"), F.lit(0)))
        return F.aggregate(found, t, lambda acc, e: F.coalesce(F.replace(acc, e, F.try_element_at(names, e)), acc))

    def numbered(pattern: str, base: int):
        def decode(t: Column) -> Column:
            found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
            return F.aggregate(F.transform(found, _code_point(pattern, base)), t, _put)

        return lambda t: F.when(F.contains(t, F.lit("&#")), decode(t)).otherwise(t)

    text = _bound(_bound(_bound(text, named), numbered(DECIMAL, 10)), numbered(HEXADECIMAL, 16))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _code_point(pattern: str, base: int):
    return lambda entity: F.struct(entity.alias("entity"), F.conv(F.regexp_extract(entity, pattern, 1), base, 10).cast("long").alias("code"))


def _put(text: Column, found: Column) -> Column:
    code = found["code"]
    fine = (code < 0xD800) | code.between(0xE000, 0x10FFFF)
    return F.when(fine, F.replace(text, found["entity"], F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise(text)


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid that the parts fix, so that a rerun makes the same records."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("\n", *parts)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def responses_from_pages(pages: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Response records (record_id, target_uri, date, http_header, payload) of pages(page_id, url,
    html), with page_id kept.  Null urls and pages are empty; equal rows make equal records."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF))
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.md5(html)).alias("record_id"),
        url.alias("target_uri"), F.lit(date).alias("date"), header.alias("http_header"), html.alias("payload"),
    )


def derive_records(responses: DataFrame) -> DataFrame:
    """For each response a metadata and a conversion record, linked to it and to one another.

    responses has record_id, target_uri, date, http_header (status line and fields, each ended by
    CRLF) and payload (HTML); its other columns are carried along, unless one has the name of a new
    column: those are replaced.  New columns: record_type, new_id, refers_to (the response's id),
    concurrent_to (the sibling's id), content_type, content_length (bytes), block_digest,
    payload_digest and source_digest (of the response's payload and of its whole block), warc_header
    and block.  The metadata block lists title, language, the response's digests and its HTTP fields;
    the conversion block is the payload's plain text.

    Null fields of a response are taken as empty; a null record_id gives null links.  Repeated
    responses give repeated records with equal ids.  An empty table gives an empty result.
    """
    given = ("record_id", "target_uri", "date", "http_header", "payload")
    made = ("record_type", "new_id", "refers_to", "concurrent_to", "content_type", "content_length", "block_digest", "payload_digest", "source_digest", "warc_header", "block")
    carried = [c for c in responses.columns if c not in given + made]
    others = F.struct(*carried) if carried else F.struct(F.lit(0).alias("none"))
    filled = responses.select(others.alias("others"), "record_id", *[F.coalesce(c, F.lit("")).alias(c) for c in given[1:]])
    title = F.regexp_extract("payload", r"(?is)<title\b[^>]*>(.*?)</title", 1)
    facts = filled.select(
        "others", *given,
        html_text(F.col("payload")).alias("text"),
        html_text(title).alias("title"),
        F.regexp_extract("payload", r"""(?i)<html\b[^>]*\blang=["']?([A-Za-z-]+)""", 1).alias("language"),
        digest(F.col("payload")).alias("payload_digest"),
        digest(F.concat("http_header", F.lit(CRLF), "payload")).alias("source_digest"),
        record_id(F.lit("metadata"), F.col("record_id")).alias("metadata_id"),
        record_id(F.lit("conversion"), F.col("record_id")).alias("conversion_id"),
    )
    about = F.concat(
        F.lit("title: "), F.replace("title", F.lit("\n"), F.lit(" ")), F.lit(CRLF + "language: "), "language", F.lit(CRLF + "source-payload-digest: "), "payload_digest",
        F.lit(CRLF + "source-block-digest: "), "source_digest", F.lit(CRLF),
        F.when(F.col("http_header") == "", "").otherwise(F.concat(F.lit("http-"), F.replace(F.btrim("http_header", F.lit(CRLF)), F.lit(CRLF), F.lit(CRLF + "http-")), F.lit(CRLF))),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col("metadata_id").alias("new_id"), F.col("conversion_id").alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("new_id"), F.col("metadata_id").alias("concurrent_to"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    both = facts.select("others", *given[:3], "payload_digest", "source_digest", F.explode(kinds).alias("new")).select(
        "others", *given[:3], "payload_digest", "source_digest", "new.*"
    )
    both = both.withColumn("content_length", F.octet_length("block").cast("long")).withColumn("block_digest", digest(F.col("block"))).withColumn("refers_to", F.col("record_id"))
    header = F.concat_ws(
        CRLF, F.lit("WARC/1.1"),
        *[F.concat(F.lit(name + ": "), F.col(c).cast("string")) for name, c in (
            ("WARC-Type", "record_type"), ("WARC-Record-ID", "new_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"),
            ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Concurrent-To", "concurrent_to"),
            ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
        )],
    )
    return both.withColumn("warc_header", F.concat(header, F.lit(CRLF))).select(*[F.col("others")[c].alias(c) for c in carried], "target_uri", "date", *made)


def write_warc(records: DataFrame, path: str) -> None:
    """Records of derive_records as gzip-compressed WARC files, one a partition."""
    lines = records.select(F.concat("warc_header", F.lit(CRLF), "block").alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, target_uri, date, refers_to, content_length, block) of WARC files.

    Files are cut at the line that begins a record, as a stream; no file is held whole.  A block that
    itself contains an empty line followed by WARC/1.x is cut there; content_length then tells.
    """
    raw = spark.read.option("lineSep", CRLF * 2 + "WARC/1.").text(path)
    head = F.substring_index("value", CRLF * 2, 1)
    parts = raw.select(head.alias("head"), F.expr("substring(value, length(substring_index(value, '\r\n\r\n', 1)) + 5)").alias("rest"))

    def field(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
        return F.when(found != "", found)

    # the last record of a file still has the line ends that close it
    size = field("Content-Length").cast("long")
    block = F.when(F.octet_length("rest") == size + 4, F.expr("left(rest, length(rest) - 4)")).otherwise(F.col("rest"))
    return parts.select(
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"),
        field("WARC-Refers-To").alias("refers_to"), size.alias("content_length"), block.alias("block"),
    ).filter("record_type is not null")


def responses_from_warc(records: DataFrame) -> DataFrame:
    """Response records as derive_records takes them, of what read_warc gives: the block of each
    response is cut at the first empty line into http_header (its lines, each ended by CRLF) and
    payload.  A block without an empty line is all header; a null block gives both empty.  Records of
    other types go; further columns are carried."""
    block = F.coalesce("block", F.lit(""))
    head = F.substring_index(block, CRLF * 2, 1)
    made = ("http_header", "payload")
    cut = records.filter(F.lower("record_type") == "response").withColumns({
        "http_header": F.when(head == "", "").otherwise(F.concat(F.rtrim(head, F.lit(CRLF)), F.lit(CRLF))),
        "payload": F.substring(block, F.char_length(head) + 5, F.char_length(block)),
    })
    return cut.select(*[c for c in records.columns if c not in (*made, "block", "record_type", "content_length", "refers_to")], *made)
