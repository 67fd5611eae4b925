"""Document metadata: inline directives, front-matter and the titles derived from them.

Everything here is a projection: one row in, one row out, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import FALSE_WORDS, TRUE_WORDS, front_tree
from ..functions.lookups import SPACE
from ..functions.markup import let
from ..functions.text import path_digest, stem, strip, unified_lines
from ..session import computed, lazily

FRONT = r"(?sm)\A---\n(.+?)^---(?:\n|\z)"
FRONT_COMMENT = r"(?sm)\A<!--\n(.+?)^-->(?:\n|\z)"

# A line with a key at the left margin.
_ENTRY = r"""(?m)^(?:[A-Za-z_][\w-]*|"(?:[^"\\\n]|\\.)*+"|'[^'\n]*+')[ \t]*:(?:[ \t]|$)"""


def directive_pattern(name: str, value: str, prefix: str) -> str:
    """Pattern of a comment directive; words of its name may be joined by ``-`` or ``_``."""
    words = "[-_]".join(([prefix] if prefix else []) + name.split("-"))
    return rf"<!--[{SPACE}]+{words}:[{SPACE}]*({value})[{SPACE}]+-->"


def _take_first(text: Column, pattern: str, possible: Column) -> Column:
    """``(value, rest)``: value of the first match and the text without that match; texts without one are searched once, where a match is possible."""

    def cut(match: Column) -> Column:
        # the leftmost match is also the first occurrence of its text, as no pattern looks behind
        found, before = match != "", F.call_function("substring_index", text, match, F.lit(1))
        rest = F.concat(before, F.substr(text, F.length(before) + F.length(match) + 1))
        return F.struct(F.when(found, F.regexp_extract(match, pattern, 1)).alias("value"), F.when(found, rest).otherwise(text).alias("rest"))

    return let(F.when(possible, F.regexp_extract(text, pattern, 0)), cut)


def directives(documents: DataFrame, prefix: str = "") -> DataFrame:
    """Capture and remove the first page-id, space-key and generated-by directive.

    ``prefix`` is the tool name that precedes the first two (``prefix-page-id``).
    """
    steps = (
        ("d_page_id", directive_pattern("page-id", r"\d+", prefix)),
        ("d_space_key", directive_pattern("space-key", rf"[^{SPACE}]+", prefix)),
        ("d_generated_by", directive_pattern("generated-by", r"[^\n]*", "")),
    )
    out = documents.withColumn("rest", F.col("text"))
    for name, pattern in steps:
        kept = [c for c in out.columns if c not in (name, "rest")]
        taken = _take_first(F.col("rest"), pattern, F.col("rest").contains("<!--"))
        out = out.select(*kept, F.inline(F.array(taken)).alias(name, "rest"))
    return out


def _is_dictionary(block: Column) -> Column:
    braces = strip(block).startswith("{")
    return F.when(braces, F.get_json_object(block, "$").isNotNull()).otherwise(block.rlike(_ENTRY))


def frontmatter(scanned: DataFrame) -> DataFrame:
    """Split off the leading front-matter block.

    A block that is not a dictionary is removed but yields no properties, and
    the comment form is then tried on what remains.
    """
    kept = [c for c in scanned.columns if c not in ("block", "body")]
    dashed = _take_first(F.col("rest"), FRONT, F.col("rest").startswith("---\n"))
    out = scanned.select(*kept, F.inline(F.array(dashed)).alias("_block1", "_rest1"))
    out = computed(out, {"_good1": F.coalesce(_is_dictionary(F.col("_block1")), F.lit(False))})
    commented = _take_first(F.col("_rest1"), FRONT_COMMENT, ~F.col("_good1") & F.col("_rest1").startswith("<!--\n"))
    out = out.select("*", F.inline(F.array(commented)).alias("_block2", "body"))
    good2 = F.coalesce(_is_dictionary(F.col("_block2")), F.lit(False))
    out = computed(out, {"block": F.when(F.col("_good1"), F.col("_block1")).when(good2, F.col("_block2"))})
    return out.withColumn("inner_lines", F.regexp_count("block", F.lit("\n"))).drop("_block1", "_rest1", "_good1", "_block2", "rest")


def start_line(inner_lines: Column) -> Column:
    """Number of the first body line: after the block and its two delimiters, or 1."""
    return F.coalesce(inner_lines + 3, F.lit(1))


def frontmatter_entries(block: Column) -> Column:
    """``ARRAY<STRUCT<key, value, kind>>`` of a front-matter block: lists repeat their key, nested dictionaries use dotted keys."""
    return front_tree(block)["entries"]


def scan(documents: DataFrame, prefix: str = "") -> DataFrame:
    """Directives and front-matter of every document; ``body`` is the text that remains.

    Lines may end in CR LF or CR.  ``front_error`` tells what of the front-matter was not understood; it then has no ``entries``.
    """
    unified = documents.withColumn("text", unified_lines(F.col("text"))) if "text" in documents.columns else documents
    located = frontmatter(directives(unified, prefix)).withColumn("start_line", start_line(F.col("inner_lines")))
    parsed = lazily(located, {"_front": front_tree(F.col("block"))})
    columns = [c for c in parsed.columns if c != "_front"]

    def part(name: str) -> Column:
        # through a lambda: a plain field would be pushed into the column, and the block be folded once per field
        return let(F.col("_front"), lambda front: front[name])

    return parsed.select(*columns, part("entries").alias("entries"), part("json").alias("front_json"), part("error").alias("front_error"))


def frontmatter_kv(scanned: DataFrame) -> DataFrame:
    """One row per front-matter value: ``(path, key, idx, value)``."""
    rows = scanned.where(F.size("entries") > 0).select("path", F.posexplode("entries").alias("idx", "e"))
    return rows.select("path", F.col("e.key").alias("key"), "idx", F.col("e.value").alias("value"))


def _values(key: str) -> Column:
    return F.expr(f"transform(filter(entries, e -> e.key = '{key}'), e -> e.value)")


def _value(key: str) -> Column:
    """The last value wins, as in a dictionary; a null or an empty text is no value."""
    return F.expr(f"nullif(try_element_at(transform(filter(entries, e -> e.key = '{key}'), e -> e.value), -1), '')")


def _truth(value: Column) -> Column:
    return F.when(F.lower(value).isin(*TRUE_WORDS), True).when(F.lower(value).isin(*FALSE_WORDS), False)


def properties(scanned: DataFrame, prefix: str = "") -> DataFrame:
    """Typed document properties: directives first, then prefixed keys, then plain ones.

    ``tags`` is null without that key and empty for an empty list.  Values below ``properties`` that are no
    texts are JSON texts in the map ``properties``; ``properties_json`` holds all of them.
    What no later step reads is not computed; ``keyed`` before joins.
    """
    alias = prefix + "_" if prefix else "alias_"
    tags = F.filter(_values("tags"), lambda t: t.isNotNull())
    no_tags = F.exists("entries", lambda e: (e["key"] == "tags") & (e["kind"] == "empty list"))
    own = F.get_json_object("front_json", "$.properties")
    return lazily(scanned, {
        "page_id": F.coalesce("d_page_id", _value(alias + "page_id"), _value("page_id")),
        "space_key": F.coalesce("d_space_key", _value(alias + "space_key"), _value("space_key")),
        "generated_by": F.coalesce("d_generated_by", _value("generated_by")),
        "fm_title": _value("title"),
        "tags": F.when((F.size(tags) > 0) | no_tags, tags),
        "synchronized": _truth(_value("synchronized")),
        "properties": F.from_json(own, "map<string,string>"),
        "properties_json": F.when(own.startswith("{"), own),
        "layout_alignment": _value("layout.alignment"),
        "layout_image_alignment": _value("layout.image.alignment"),
        "layout_max_width": _value("layout.image.max_width").try_cast("int"),
        "layout_table_width": _value("layout.table.width").try_cast("int"),
        "layout_table_display_mode": _value("layout.table.display_mode"),
    })


def keyed(props: DataFrame) -> DataFrame:
    """Properties whose identifiers are settled, so that plans of joins do not spell out how they are found."""
    return computed(props, {name: F.col(name) for name in ("page_id", "space_key", "fm_title")})


def document_properties(scanned: DataFrame, prefix: str = "") -> DataFrame:
    return properties(scanned, prefix).select("path", "page_id", "space_key", "generated_by", "fm_title", "synchronized", "start_line")


def tags_explode(props: DataFrame) -> DataFrame:
    return props.select("path", F.posexplode("tags").alias("idx", "tag"))


def title_fallback(path: Column, name: Column) -> Column:
    """Automatic title: the stem of the file and the digest of its path."""
    return F.concat(stem(name), F.lit(" ["), path_digest(path), F.lit("]"))


def title_prefix(title: Column, prefix: str | None) -> Column:
    return title if prefix is None else F.concat(F.lit(prefix + " "), title)


def banner(generated_by: Column, template: str | None, path: Column, directory: Column, name: Column) -> Column:
    """Text of the generated-by banner; switched off altogether when no template is given."""
    if template is None:
        return F.lit(None).cast("string")
    text = F.coalesce(F.nullif(generated_by, F.lit("")), F.lit(template))
    for variable, value in (("filepath", path), ("filename", name), ("filedir", directory), ("filestem", stem(name))):
        text = F.replace(text, F.lit("%{" + variable + "}"), value)
    return text


def layout(props: DataFrame, defaults: dict) -> DataFrame:
    """Document layout over the global defaults, field by field; images fall back to the block alignment, then centre."""
    def field(name: str, kind: str = "string") -> Column:
        return F.coalesce(F.col("layout_" + name), F.lit(defaults.get(name)).cast(kind))

    alignment = field("alignment")
    return props.select(
        "path",
        alignment.alias("alignment"),
        F.coalesce(field("image_alignment"), alignment, F.lit("center")).alias("image_alignment"),
        field("max_width", "int").alias("max_width"),
        field("table_width", "int").alias("table_width"),
        F.coalesce(field("table_display_mode"), F.lit("responsive")).alias("table_display_mode"),
    )
