"""File names, paths, addresses and media types as column expressions."""

from __future__ import annotations

from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import SPACE, nfc

FONT_EXTENSIONS = ["otf", "ttf", "woff", "woff2"]
IMAGE_EXTENSIONS = ["bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp"]
FONT_TYPES = ["application/font-woff", "application/font-woff2", "application/vnd.ms-opentype", "application/x-font-ttf", "font/otf", "font/ttf", "font/woff", "font/woff2"]
NCX_TYPE = "application/x-dtbncx+xml"
JUNK_FILES = [".DS_Store", "._.DS_Store", "Thumbs.db", "desktop.ini"]
JUNK_FOLDERS = [".git", ".svn", "__MACOSX"]


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Folder of a path without the last slash, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, '' if there is none; a leading dot begins no extension."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*\.([^.]*)$|^[^.]\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def sanitize(name: Column) -> Column:
    """A name that file systems accept: marks replaced, controls dropped, blanks and dashes collapsed."""
    out = F.translate(name, '/\\|"', "---'")
    out = F.replace(out, F.lit(":"), F.lit(" -"))
    out = F.translate(out, "*?<>", "")
    out = nfc(F.regexp_replace(out, r"\p{Cc}", ""))
    return trim(F.regexp_replace(F.regexp_replace(out, SPACE + "+", " "), "-+", "-"))


def filename(title: Column, author: Column) -> Column:
    """``author - title.epub`` of what is there; 200 characters of it at most."""
    title, author = (trim(F.coalesce(x, F.lit(""))) for x in (title, author))
    name = F.when((title != "") & (author != ""), F.concat_ws(" - ", author, title)).when(title != "", title).when(author != "", author).otherwise("optimized")
    cut = F.substring(sanitize(name), 1, 200)
    return F.concat(F.regexp_replace(cut, f"{SPACE}+$", ""), F.lit(".epub"))


def slug(name: Column) -> Column:
    ascii_lower = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(ascii_lower, "[^a-z0-9]+", "-"), "^-|-$", "")


@F.pandas_udf(T.StringType())
def percent_decode(s: pd.Series) -> pd.Series:
    """Malformed escapes and ``+`` stay; bytes that are not UTF-8 become U+FFFD."""
    return s.map(lambda v: None if v is None else unquote(v, errors="replace"))


@F.pandas_udf(T.StringType())
def percent_encode(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else quote(v, safe="!$&'()*+,/:;=@[]\\^|~-._"))


def escape_text(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def escape_attribute(x: Column) -> Column:
    return F.replace(escape_text(x), F.lit('"'), F.lit("&quot;"))


def is_font(path: Column) -> Column:
    return extension(path).isin(FONT_EXTENSIONS)


def is_image(path: Column) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def is_junk(path: Column) -> Column:
    return basename(path).isin(JUNK_FILES) | F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in JUNK_FOLDERS]))


def content_kind(media_type: Column, href: Column) -> Column:
    kind = F.lower(F.coalesce(media_type, F.lit("")))
    return (
        F.when(kind.isin("application/xhtml+xml", "text/html"), "xhtml")
        .when(kind == "text/css", "css")
        .when(kind == NCX_TYPE, "ncx")
        .when(kind.startswith("image/"), "image")
        .when(kind.isin(FONT_TYPES) | is_font(F.coalesce(href, F.lit(""))), "font")
        .otherwise("other")
    )


@F.pandas_udf(T.StringType())
def one_decimal(x: pd.Series) -> pd.Series:
    """With one decimal, halves of the exact value to the even digit; the JVM's formatter rounds them up."""
    return x.map(lambda v: None if v is None or v != v else f"{v:.1f}")


def format_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal."""
    x = n.cast("double")
    out = None
    for k, unit in enumerate(["B", "KB", "MB", "GB"]):
        text = F.concat(one_decimal(x / 1024**k), F.lit(f" {unit}"))
        out = F.when(x < 1024 ** (k + 1), text) if out is None else out.when(x < 1024 ** (k + 1), text)
    return out.otherwise(F.concat(one_decimal(x / 1024**4), F.lit(" TB")))
