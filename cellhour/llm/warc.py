"""Derivative WARC records: metadata and plain-text conversions of archived responses.

Every response record gives two records that refer to it by its identifier: a
metadata record about it, and a conversion record with its plain text. Both keep
the source's headers and payload digest; each has its own block digest and
length. Identifiers are made from content, so a rerun makes the same ones. Only
DataFrame functions are used, and each page is handled by itself.

Defined results: a null url is an empty target, a null body an empty body;
control characters of a url are percent-encoded; rows
that repeat give repeated records, told apart by nothing but their place; an
empty table gives no records; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
# Fixed values of the format.
VERSION = "WARC/1.1"
DROPPED = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
BREAKS = r"(?i)<(br|/p|/h[1-6]|/li|/div|/article|/tr|/title)\b[^>]*>"
TAGS = r"(?s)<[^>]*>"
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
#: Names of the signs from U+00A0 to U+00FF in order, and of some others.
LATIN = """nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro para
middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc
Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig
agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml eth ntilde ograve oacute ocirc
otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml""".split()
NAMED = {**{name: chr(160 + i) for i, name in enumerate(LATIN)}, "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&",
         "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d",
         "bull": "\u2022", "hellip": "\u2026", "euro": "\u20ac", "trade": "\u2122", "OElig": "\u0152", "oelig": "\u0153"}


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(*parts: Column) -> Column:
    """A urn whose uuid is made of the parts' hash."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"),
                    cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def character(code: Column) -> Column:
    """The sign of a code point; null for what is none."""
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def without_entities(html: Column) -> Column:
    """Named and numeric entities as the signs they stand for, each once; unknown ones stay. A no-break space is a space."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def named(text: Column, place: Column) -> Column:
        return F.struct(text.alias("text"), place.alias("place"), F.regexp_extract(text, ENTITY, 1).alias("name"))

    def signed(piece: Column) -> Column:
        name = piece["name"]
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8))
        sign = F.when(name != "", F.coalesce(F.try_element_at(names, name), character(code.cast("long"))))
        return F.struct(piece["text"].alias("text"), piece["place"].alias("place"), name.alias("name"), sign.alias("sign"))

    def joined(piece: Column) -> Column:
        rest = F.substring(piece["text"], F.length(piece["name"]) + 2, F.length(piece["text"]))
        return (F.when(piece["place"] == 0, piece["text"]).when(piece["sign"].isNull(), F.concat(F.lit("&"), piece["text"]))
                .otherwise(F.concat(F.when(piece["sign"] == "\u00a0", " ").otherwise(piece["sign"]), rest)))

    # The html is cut at every ampersand once; an entity opens all pieces but the first.
    pieces = F.transform(F.transform(F.split(html, "&"), named), signed)
    return F.array_join(F.transform(pieces, joined), "")


def plain_text(html: Column) -> Column:
    """Text without comments, scripts, styles and tags. What is opened and never closed reaches to the end."""
    html = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROPPED, " "), BREAKS, "\n"), TAGS, " ")
    html = without_entities(html)
    html = F.regexp_replace(F.regexp_replace(html, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(html, r"^[ \n]+|[ \n]+$", "")


def one_line(url: Column) -> Column:
    """The url with its control characters percent-encoded, so that it cannot end its header line."""
    signs = F.transform(F.split(url, ""), lambda c: F.when(
        c.rlike(r"^[\x00-\x1F\x7F]$"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), F.array_join(signs, "")).otherwise(url)


def responses(pages: DataFrame, date: str) -> DataFrame:
    """(page_id, url, record_id, http_headers, body, payload_digest, date) of pages seen as responses."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = one_line(F.coalesce(F.col("url").cast("string"), F.lit("")))
    held = pages.select("page_id", url.alias("url"), body.alias("body"))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                       F.octet_length("body").cast("string"), F.lit(CRLF))
    return held.select(
        "page_id", "url", record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("url"), F.sha2("body", 256))
        .alias("record_id"), headers.alias("http_headers"), "body", digest(F.col("body")).alias("payload_digest"),
        F.lit(date).alias("date"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for each response: type, identifiers, headers' values, digests and the block."""
    fields = F.concat(F.lit("sourceDigest: "), F.col("payload_digest"), F.lit(CRLF + "sourceLength: "),
                      F.octet_length("body").cast("string"), F.lit(CRLF), F.col("http_headers"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("body")).alias("block")))
    made = source.select("page_id", "url", "record_id", "http_headers", "payload_digest", "date", F.explode(kinds).alias("made"))
    return made.select(
        "page_id", F.col("made.type").alias("warc_type"),
        record_id(F.col("made.type"), F.col("record_id"), F.sha2("made.block", 256)).alias("warc_record_id"),
        F.col("record_id").alias("warc_refers_to"), F.col("url").alias("target_uri"), "date",
        F.col("made.content_type").alias("content_type"), F.col("http_headers").alias("source_headers"),
        F.col("payload_digest").alias("source_digest"), digest(F.col("made.block")).alias("block_digest"),
        F.octet_length("made.block").cast("long").alias("content_length"), F.col("made.block").alias("block"))


def serialised(records: DataFrame) -> DataFrame:
    """One column, `value`: each record without the two line ends that close it."""
    head = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "warc_record_id"), ("WARC-Date", "date"),
            ("WARC-Refers-To", "warc_refers_to"), ("WARC-Target-URI", "target_uri"),
            ("WARC-Source-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"),
            ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in head]
    return records.select(F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines), F.lit(CRLF * 2), F.col("block")).alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files in a folder: every record ends with two line ends, which is the writer's line separator."""
    serialised(records).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)
