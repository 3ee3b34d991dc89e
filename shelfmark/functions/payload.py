"""Payloads: types by header and by leading bytes, routing, validation, budget buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS, strip

# Fragments of a content type and the extension each gives, in order.
TYPE_EXTENSIONS = [
    ("application/pdf", ".pdf"), ("application/x-pdf", ".pdf"), ("application/epub+zip", ".epub"), ("image/jpeg", ".jpg"),
    ("image/jpg", ".jpg"), ("image/png", ".png"), ("image/jp2", ".jp2"), ("image/jpx", ".jp2"), ("image/jpeg2000", ".jp2"),
    ("image/tiff", ".tif"), ("image/tif", ".tif"), ("application/zip", ".zip"), ("text/plain", ".txt"), ("text/html", ".html"),
    ("application/json", ".json"), ("application/xml", ".xml"), ("text/xml", ".xml"),
]
# Content types that name no format.
GENERIC_TYPES = [
    "application/octet-stream", "binary/octet-stream", "application/binary", "application/download",
    "application/force-download", "application/x-download", "application/unknown",
]
# Media types of extensions.
MEDIA_TYPES = {
    ".pdf": "application/pdf", ".epub": "application/epub+zip", ".zip": "application/zip", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".png": "image/png", ".jp2": "image/jp2", ".tif": "image/tiff", ".tiff": "image/tiff", ".txt": "text/plain", ".html": "text/html",
    ".json": "application/json", ".xml": "application/xml",
}
# Leading bytes (hexadecimal) of formats, in order.
SIGNATURES = [
    ("255044462D", ".pdf"), ("89504E470D0A1A0A", ".png"), ("FFD8FF", ".jpg"), ("0000000C6A5020200D0A870A", ".jp2"),
    ("FF4FFF51", ".jp2"), ("49492A00", ".tif"), ("4D4D002A", ".tif"), ("49492B00", ".tif"), ("4D4D002B", ".tif"),
]
ZIP = "504B0304"
#: Bytes in which an EPUB names itself.
EPUB_WINDOW = 128
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".jp2", ".tif", ".tiff", ".webp", ".bmp", ".gif"]


def content_length(header: Column) -> Column:
    """The declared length; null where absent, malformed or negative."""
    n = header.try_cast("long")
    return F.when(n >= 0, n)


def extension_of_type(content_type: Column) -> Column:
    """The extension of a Content-Type header; empty for generic and unknown types."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    out = F.when(strip(F.substring_index(low, ";", 1)).isin(GENERIC_TYPES), "")
    for fragment, extension in TYPE_EXTENSIONS:
        out = out.when(F.contains(low, F.lit(fragment)), extension)
    return out.otherwise("")


def media_type(extension: Column) -> Column:
    low, out = F.lower(extension), None
    for ext, kind in MEDIA_TYPES.items():
        out = F.when(low == ext, kind) if out is None else out.when(low == ext, kind)
    return out


def sniff_extension(head: Column) -> Column:
    """The extension that a payload's leading bytes imply; empty where none does."""
    digits = F.hex(F.substring(head, 1, EPUB_WINDOW))
    out = None
    for magic, extension in SIGNATURES:
        hit = F.startswith(digits, F.lit(magic))
        out = F.when(hit, extension) if out is None else out.when(hit, extension)
    zipped = F.startswith(digits, F.lit(ZIP))
    named = F.contains(F.decode(F.substring(head, 1, EPUB_WINDOW), "ISO-8859-1"), F.lit("application/epub+zip"))
    return out.when(zipped & named, ".epub").when(zipped, ".zip").otherwise("")


def budget_bucket(extension: Column) -> Column:
    return F.when(extension.isin(".pdf", ".epub", ".zip"), "pdfs").when(extension.isin(".json", ".xml", ".html", ".txt"), "metadata").otherwise("images")


def rejects_html(content_type: Column, url: Column, length: Column) -> Column:
    """Is an HTML response to be refused, as the URL promises a document or the page is a known error page?"""
    low = F.lower(url)
    path = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    document = F.contains(path, F.lit(".pdf")) | F.contains(path, F.lit(".epub")) | low.rlike("output=pdf|output=epub|download")
    error_page = F.contains(low, F.lit("annas-archive")) & (length > 170_000) & (length < 185_000)
    return F.coalesce(F.contains(F.lower(content_type), F.lit("text/html")) & (document | F.coalesce(error_page, F.lit(False))), F.lit(False))


def target_folder(extension: Column, allowed: list[str], keep_others: bool = True) -> Column:
    """``objects`` for allowed extensions (an empty list allows all), else ``metadata`` or null."""
    if not allowed:
        return F.lit("objects")
    return F.when(extension.isin(allowed), "objects").otherwise("metadata" if keep_others else None)


def magic_problem(head: Column, extension: Column) -> Column:
    """Why a PDF or EPUB payload is not one; null where it is, or for other extensions."""
    digits = F.hex(F.substring(head, 1, 8))
    text = F.decode(F.substring(head, 1, 512), "ISO-8859-1")
    html = F.contains(text, F.lit("<!DOCTYPE")) | F.contains(F.lower(text), F.lit("<html"))
    out = None
    for ext, magic, name in ((".pdf", "255044462D", "PDF"), (".epub", ZIP, "EPUB")):
        bad = (extension == ext) & ~F.startswith(digits, F.lit(magic))
        reason = F.when(html, f"{name} contains HTML").otherwise(f"{name} has wrong leading bytes")
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out


def disposition_filename(header: Column) -> Column:
    """The file name of a Content-Disposition header; an extended value is decoded."""

    def bound(value: Column, f) -> Column:
        # computed once, however often f reads it
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def named(key: str) -> Column:
        # the last parameter of that name, found from the end without taking the header apart
        own = F.regexp_extract(header, f"(?is)^.*;([{BLANKS}]*+{re.escape(key)}[{BLANKS}]*+(?:=[^;]*+)?+)(?:;|\\z)", 1)
        if key.endswith("*"):
            # most headers have no star, which is sooner seen
            own = F.when(F.contains(header, F.lit("*")), own)
        return bound(F.trim(strip(F.regexp_replace(own, "^[^=]*=", "")), F.lit('"')), lambda v: F.nullif(v, F.lit("")))

    def decoded(found: Column) -> Column:
        plain = F.replace(found, F.lit("+"), F.lit("%2B"))
        return F.when(F.contains(found, F.lit("''")), F.try_url_decode(F.regexp_replace(plain, "^.*?''", ""))).otherwise(found)

    return bound(F.coalesce(named("filename*"), named("filename")), decoded)


def placeholder_image(content: Column, digests: list[str] | None = None) -> Column:
    """Is an image a stand-in, by its size or its digest?"""
    size = F.length(content)
    small = (size < 10_000) | (size == 9103)
    return small | F.md5(content).isin(digests) if digests else small


def megabytes(value: Column) -> Column:
    """Bytes of a limit in MB; null (no limit) where it is not positive or not a number."""
    n = value.try_cast("double")
    return F.when(n > 0, (n * 1024 * 1024).cast("long"))


def gigabytes(value: Column) -> Column:
    n = value.try_cast("double")
    return F.when(n > 0, (n * 1024 * 1024 * 1024).cast("long"))
