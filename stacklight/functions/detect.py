"""Scalar accessors of archive entries as Catalyst expressions: types, namespaces, identifiers, hex views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MIME types by file extension (fixed values).
MIME_BY_EXTENSION = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript", "json": "application/json",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml",
    "xml": "application/xml", "pdf": "application/pdf", "txt": "text/plain",
}
#: MIME prefixes whose content is worth compressing (fixed values).
COMPRESSIBLE = (
    "text/", "application/xml", "application/json", "application/javascript", "application/x-javascript",
    "image/svg+xml", "application/xhtml+xml", "application/atom+xml", "application/rss+xml",
)
#: What the namespaces hold (fixed values).
NAMESPACES = {
    "C": "content (new scheme)", "A": "article (old scheme)", "I": "image (old scheme)", "J": "script (old scheme)",
    "-": "layout (old scheme)", "M": "metadata", "X": "index", "W": "listing/redirect",
}
COMPRESSIONS = {1: "none", 4: "lzma/xz", 5: "zstd"}
EXTERNAL = r"^(https?://|mailto:|tel:|javascript:|data:|//|#)"


def mime_by_name(name: Column) -> Column:
    """The MIME type by what follows the last dot, or by the whole name without one."""
    ext = F.lower(F.substring_index(name, ".", -1))
    out = F.lit("application/octet-stream")
    for mime in dict.fromkeys(MIME_BY_EXTENSION.values()):
        out = F.when(ext.isin(*[e for e, m in MIME_BY_EXTENSION.items() if m == mime]), mime).otherwise(out)
    return out


def content_type(data: Column) -> Column:
    """A tag by the leading bytes of binary content; '' under four bytes."""
    at = lambda n: F.hex(F.substring(data, 1, n))
    first = at(4)
    html = (at(9) == F.hex(F.lit("<!DOCTYPE"))) | ((F.octet_length(data) >= 5) & at(2).isin("3C68", "3C48"))
    return (
        F.when(F.octet_length(data) < 4, "")
        .when(first == "89504E47", "[PNG]")
        .when(first.startswith("FFD8"), "[JPEG]")
        .when(first.startswith("474946"), "[GIF]")
        .when(html, "[HTML]")
        .when(first.startswith("1F8B"), "[gzip]")
        .when(first == "28B52FFD", "[zstd]")
        .otherwise(F.concat(F.lit("["), spaced_hex(F.substring(data, 1, 4)), F.lit("]")))
    )


def is_compressible(mime: Column) -> Column:
    out = F.lit(False)
    for p in COMPRESSIBLE:
        out = out | mime.startswith(p)
    return out


def is_external_url(url: Column) -> Column:
    return url.rlike(EXTERNAL)


def describe_namespace(ns: Column) -> Column:
    code = F.ascii(ns)
    out = F.when((code >= 65) & (code <= 90), F.concat(F.lit("namespace "), ns)).otherwise(F.concat(F.lit("unknown (0x"), F.lpad(F.hex(code), 2, "0"), F.lit(")")))
    for k, v in NAMESPACES.items():
        out = F.when(ns == k, v).otherwise(out)
    return out


def describe_compression(code: Column) -> Column:
    out = F.concat(F.lit("unknown("), code.cast("string"), F.lit(")"))
    for k, v in COMPRESSIONS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def is_user_content(ns: Column) -> Column:
    return ns.isin("C", "A", "I", "J", "-")


def spaced_hex(data: Column) -> Column:
    """Two upper-case digits for each byte, blanks between."""
    return F.rtrim(F.regexp_replace(F.hex(data), "(..)", "$1 "))


def short_string(text: Column, most: int) -> Column:
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def parse_uuid(text: Column) -> Column:
    """The 8-4-4-4-12 form; hyphens are free, '' is the zero identifier, anything else than 32 hex digits is null."""
    plain = F.lower(F.regexp_replace(text, "-", ""))
    digits = F.when(plain == "", "0" * 32).when(plain.rlike("^[0-9a-f]{32}$"), plain)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(digits.isNotNull(), F.concat_ws("-", *[F.substring(digits, a, n) for a, n in cut]))


def little_endian(data: Column) -> Column:
    """The unsigned number of up to 7 bytes, lowest first."""
    big = F.array_join(F.reverse(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))), "")
    return F.conv(big, 16, 10).cast("long")


def compression_of(info: Column) -> Column:
    return info.bitwiseAND(F.lit(15))


def is_extended(info: Column) -> Column:
    return info.bitwiseAND(F.lit(16)) != 0
