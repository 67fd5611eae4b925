"""Scalar column functions over titles, paths, URLs and sizes."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lookups import BLANK, IMAGE_LAYOUTS, PIXELS_PER_UNIT, SPACE, SPACE_CHARACTERS, lookup


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def unified_lines(text: Column) -> Column:
    """Text whose lines all end in a line feed alone."""
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARACTERS))


def unify_newlines(text: Column) -> Column:
    """One line terminator, whichever of the Unicode line breaks the source used."""
    # Most texts have none but line feeds; to look for each of the others is faster than to run the pattern.
    others = reduce(Column.__or__, [text.contains(c) for c in "\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029"])
    return F.when(others, F.regexp_replace(text, r"\r\n|[\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n")).otherwise(text)


# --- slugs ---------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _unaccented(text: pd.Series) -> pd.Series:
    def plain(t):
        if t is None or t.isascii():
            return t
        return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")

    return text.map(plain)


def _hyphenated(text: Column, disallowed: str) -> Column:
    return F.regexp_replace(F.regexp_replace(text, disallowed, ""), f"[{SPACE}]+", "-")


def slug_identifier(title: Column) -> Column:
    """Anchor that drops every letter outside a-z."""
    return _hyphenated(F.lower(strip(title)), f"[^{SPACE}a-z0-9_-]")


def slug_ascii(title: Column) -> Column:
    """Anchor that replaces accented letters by their base letters."""
    return _hyphenated(F.lower(_unaccented(strip(title))), f"[^{SPACE}a-z0-9_-]")


def slug_unicode(title: Column) -> Column:
    """Anchor that keeps every letter and digit of any script."""
    return _hyphenated(F.lower(_composed(strip(title))), rf"[^{SPACE}\p{{L}}\p{{N}}_-]")


_EXPLICIT_ID = rf"[{SPACE}]*\{{#([^{{}}]+)\}}\z"


def heading_clean(title: Column) -> Column:
    return F.regexp_replace(title, _EXPLICIT_ID, "")


def heading_id(title: Column) -> Column:
    """Explicit identifier ``{#id}`` at the end of a heading, else its slug."""
    return F.coalesce(F.nullif(F.regexp_extract(title, _EXPLICIT_ID, 1), F.lit("")), slug_unicode(heading_clean(title)))


# --- URLs ----------------------------------------------------------------------------------


def encode_title(title: Column) -> Column:
    """Title as it appears in a page URL."""
    safe = F.regexp_replace(title, r"[^A-Za-z0-9._~()'!*:@,;+?-]+", " ")
    joined = F.url_encode(strip(F.regexp_replace(safe, rf"[{SPACE}][{SPACE}]+", " ")))
    return F.replace(F.replace(joined, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def is_absolute_url(url: Column) -> Column:
    return url.rlike(r"\A([A-Za-z][A-Za-z0-9+.-]*:|//[^/?#])")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"\A([^;?#]*)", 1)


def url_fragment(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"#(.*)\z", 1), F.lit(""))


def page_url(site: str, space: Column, page_id: Column, title: Column, fragment: Column, base: str = "/wiki/", webui: bool = False) -> Column:
    """Address of a page on the target site."""
    if webui:
        path = F.concat(F.lit(f"https://{site}{base}pages/viewpage.action?pageId="), page_id)
    else:
        path = F.concat(F.lit(f"https://{site}{base}spaces/"), space, F.lit("/pages/"), page_id, F.lit("/"), encode_title(title))
    return F.concat(path, F.coalesce(F.concat(F.lit("#"), fragment), F.lit("")))


def content_uuid(text: Column) -> Column:
    """Identifier from the first 16 bytes of the SHA-1 of the content."""
    return F.regexp_replace(F.substring(F.sha1(text), 1, 32), r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")


# --- paths ---------------------------------------------------------------------------------


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def suffix(name: Column) -> Column:
    """Lower-cased suffix without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)\z", 1))


def ancestor_dirs(directory: Column) -> Column:
    """The directory and all directories above it, nearest last, the root (empty) first."""
    parts = F.split(directory, "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), chain))


def resolve_path(directory: Column, target: Column) -> Column:
    """Normalised path of ``target``; a leading slash is relative to the corpus root.

    What climbs above the root keeps its leading ``..`` parts.
    """
    joined = F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", directory, target))

    def step(done: Column, part: Column) -> Column:
        climbs = (F.size(done) == 0) | (F.element_at(done, -1) == "..")
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & ~climbs, F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step, lambda done: F.array_join(done, "/"))


def relative_path(directory: Column, target: Column) -> Column:
    """Path of ``target`` as seen from ``directory``."""
    here, there = F.split(directory, "/"), F.split(target, "/")
    shared = F.size(F.filter(
        F.sequence(F.lit(1), F.least(F.size(here), F.size(there))),
        lambda n: F.slice(here, F.lit(1), n) == F.slice(there, F.lit(1), n),
    ))
    ups = F.array_repeat(F.lit(".."), F.size(here) - shared)
    rest = F.slice(there, shared + 1, F.size(there) - shared)
    nested = F.array_join(F.concat(ups, rest), "/")
    return F.when(directory == "", target).otherwise(nested)


def attachment_name(path: Column) -> Column:
    """Safe attachment name of a relative path; NULL for an absolute path, which is an error."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    named = F.transform(parts, lambda p: F.when(p == "..", F.lit("PAR")).otherwise(F.regexp_replace(p, r"[^\-0-9A-Za-z_.]", "_")))
    return F.when(~path.startswith("/"), F.array_join(named, "_"))


def path_digest(path: Column) -> Column:
    """MD5 of a path in hexadecimal, without the leading zero of each byte."""
    # Each match is one byte: a pair that starts with zero keeps its second digit only.
    return F.regexp_replace(F.md5(path), "0([0-9a-f])|([0-9a-f]{2})", "$1$2")


# --- sizes ---------------------------------------------------------------------------------


def display_width(width: Column, max_width: int | None) -> Column:
    """The maximum where the natural width exceeds it, else NULL."""
    return F.when(width > F.lit(max_width).cast("int"), F.lit(max_width))


def svg_length_px(length: Column) -> Column:
    """Length with unit in pixels, rounded half to even; NULL for percentages and malformed values."""
    pattern = rf"(?i)\A[{BLANK}]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))(%|px|pt|em|ex|in|cm|mm|pc)?[{BLANK}]*\z"
    factor = lookup(F.lower(F.regexp_extract(length, pattern, 2)), PIXELS_PER_UNIT)
    number = F.nullif(F.regexp_extract(length, pattern, 1), F.lit("")).cast("double")
    return F.rint(number * factor).cast("int")


def image_layout(context: Column, width: Column, height: Column, alignment: Column, max_width: int | None) -> Column:
    """Layout attributes of an image: block images are aligned and scaled, inline ones keep their size."""
    block = context == "block"
    return F.struct(
        F.when(block, alignment).alias("align"),
        F.when(block, lookup(alignment, IMAGE_LAYOUTS)).alias("layout"),
        F.when(block, width).alias("original_width"),
        F.when(block, height).alias("original_height"),
        F.when(block, F.coalesce(display_width(width, max_width), width)).otherwise(width).alias("width"),
        F.when(~block, height).alias("height"),
    )
