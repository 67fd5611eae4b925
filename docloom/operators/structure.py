"""Structural relations of a document: one row in, many rows out.

A document is one row and stays one row until its parts are extracted: the
patterns below walk the text once, inside the scan stage, so that text never
crosses a shuffle.  Patterns use possessive quantifiers, which the regex engine
runs without recursion, however long a block is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.lookups import BLANK, lookup
from ..functions.markup import html_text, let
from ..functions.text import content_uuid, is_absolute_url, rstrip, strip, unify_newlines, url_fragment, url_path
from ..session import computed, lazily
from .metadata import frontmatter_entries

# A fenced block from its opening line to the line with the same marker (same
# indentation, same length), or to the end of the document.  The patterns below test once
# per character, ahead of all their branches, that a line begins there.
_FENCE = "|".join(
    rf"([{BLANK}]*+{c}{{3,}}+)[^\n]*+(?:(?s:.*?)\n\{n}(?!{c})[^\n]*+|(?s:.*+))" for n, c in ((1, "`"), (2, "~"))
)
FENCE = rf"(?md)^(?:{_FENCE})"
_FENCE_START = rf"\A[{BLANK}]*(?:`{{3,}}|~{{3,}})"

# Lines, with a fenced block as one token.
_LINE = rf"(?md)^(?:{_FENCE})\n?+|[^\n]*+\n|[^\n]++\z"

# Fenced blocks, headings that start with number signs, and any line followed by
# an underline.  Scanning left to right, an underline that itself serves as
# the text of the next one, or closes a heading, is consumed with it.
_HEADING = (
    rf"(?md)^(?:{_FENCE}"
    rf"|#{{1,6}}(?:[{BLANK}][^\n]*+|(?=\n))"
    rf"|[^\n]*+\n(?:=++|-++)[{BLANK}]*+$)"
)

# The whole text in parts: fenced blocks, headings and other lines, each with its line break.
_PART = rf"{_HEADING}".replace("(?md)", "(?md)(?:", 1) + r")\n?+|(?md)[^\n]*+\n|[^\n]++\z"

IMAGE = r'!\[([^\[\]]*)\]\(([^()\s]+)(?:\s+"([^"]*)")?\)'
HTML_IMAGE = r"<img\s[^>]*>"
LINK = r'\[([^\[\]]*)\]\(([^()\s]+)(?:\s+"[^"]*")?\)'
STATUS = r"!\[([^\[\]]*)\]\[STATUS-([A-Z]+)\]"
HTML_LINK = r'(?i)(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def body_of(documents: DataFrame, *keep: str) -> DataFrame:
    """Select path and body with one kind of line break."""
    return documents.select("path", *keep, unify_newlines(F.col("body")).alias("body"))


def prose_of(documents: DataFrame) -> DataFrame:
    """Body without fenced blocks and inline code."""
    bare = F.regexp_replace("body", FENCE, "")
    return computed(body_of(documents), {"prose": F.regexp_replace(bare, r"`[^`\n]*`", "")}).select("path", "prose")


def _rows(documents: DataFrame, items: Column, *keep: str) -> DataFrame:
    """Explode an array of structs into rows with a one-based position."""
    exploded = documents.select("path", *keep, F.posexplode(items).alias("_pos", "_item"))
    return exploded.select("path", *keep, (F.col("_pos") + 1).alias("pos"), "_item.*")


def _all(text: str | Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# --- lines and fences ----------------------------------------------------------------------


def lines(documents: DataFrame, *keep: str) -> DataFrame:
    """``(path, line_no, line, block)``; ``block`` numbers the fenced block a line belongs to, else NULL."""

    def expand(token: Column, n: Column) -> Column:
        text = F.regexp_replace(token, r"\n\z", "")
        fenced = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), n.alias("block")))
        plain = F.array(F.struct(text.alias("line"), F.lit(None).cast("int").alias("block")))
        return F.when(token.rlike(_FENCE_START), fenced).otherwise(plain)

    rows = _rows(body_of(documents, *keep), F.flatten(F.transform(_all("body", _LINE), expand)), *keep)
    return rows.withColumnRenamed("pos", "line_no")


def line_numbers(scanned: DataFrame) -> DataFrame:
    """Body lines in coordinates of the original file; ``markable`` lines may carry a marker."""
    text = F.col("line")
    plain = ~(
        text.startswith("!!! ") | text.startswith("===") | text.startswith("---") | text.endswith("#")
        | (text.startswith("$$") & text.endswith("$$"))
        | text.startswith("|") | text.endswith("|") | text.startswith("<") | text.endswith(">"))
    table_row = text.rlike(r"\A\|\s*([^\s:-]+.*?)\s*\|\z")
    markable = F.col("block").isNull() & (text != "") & (plain | table_row)
    numbered = lines(scanned, "start_line")
    return numbered.select("path", (F.col("line_no") + F.col("start_line") - 1).alias("line_no"), "line", markable.alias("markable"))


def fence_intervals(documents: DataFrame) -> DataFrame:
    """First and last line of every fenced block, with marker, language and whether it was closed."""
    fenced = lines(documents).where("block IS NOT NULL")
    spans = fenced.groupBy("path", "block").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"),
        F.min_by("line", "line_no").alias("first"), F.max_by("line", "line_no").alias("last"))
    marker = rf"\A([{BLANK}]*(?:`{{3,}}|~{{3,}}))"
    closed = (F.col("end_line") > F.col("start_line")) & (F.regexp_extract("last", marker, 1) == F.regexp_extract("first", marker, 1))
    return spans.select(
        "path", "start_line", "end_line", F.regexp_extract("first", marker, 1).alias("marker"),
        F.regexp_extract("first", _INFO, 1).alias("lang"), closed.alias("closed"))


_INFO = rf"\A[{BLANK}]*(?:`{{3,}}|~{{3,}})[{BLANK}]*([^\s`{{}}]*)"


# --- headings ------------------------------------------------------------------------------


def heading_array(body: Column) -> Column:
    """``ARRAY<STRUCT<level, text>>`` of the headings outside fenced blocks, in order."""

    def heading(token: Column) -> Column:
        first = F.substring_index(token, "\n", 1)
        numbered = token.startswith("#") & ~token.contains("\n")
        text = rstrip(F.regexp_replace(rstrip(F.regexp_replace(token, rf"\A#{{1,6}}[{BLANK}]*", "")), r"(?<!#)#++\z", ""))
        level = F.length(F.regexp_extract(token, r"\A(#{1,6})", 1))
        under = F.when(F.substring_index(token, "\n", -1).startswith("="), 1).otherwise(2)
        return F.struct(
            F.when(numbered, level).otherwise(under).cast("int").alias("level"),
            F.when(numbered, text).otherwise(rstrip(first)).alias("text"))

    tokens = F.filter(_all(body, _HEADING), lambda t: ~t.rlike(_FENCE_START))
    return F.transform(tokens, heading)


def headings(documents: DataFrame) -> DataFrame:
    return _rows(body_of(documents), heading_array(F.col("body")))


def heading_tree(heads: DataFrame) -> DataFrame:
    """Parent of a heading: the last one before it with a smaller level."""
    before = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    last_below = {k: F.max(F.when(F.col("level") < k, F.col("pos"))).over(before) for k in range(2, 7)}
    parent = F.lit(None).cast("int")
    for k, position in last_below.items():
        parent = F.when(F.col("level") == k, position).otherwise(parent)
    return heads.select("path", "pos", "level", "text", parent.alias("parent_pos"))


def unique_title_of(heads: Column) -> Column:
    """Text of the only root of the heading tree, else NULL.

    A heading is a root when no earlier one has a smaller level.
    """
    start = F.struct(F.lit(7).alias("low"), F.lit(0).alias("roots"), F.lit(None).cast("string").alias("text"))

    def step(acc: Column, h: Column) -> Column:
        root = h["level"] <= acc["low"]
        return F.struct(
            F.least(acc["low"], h["level"]).alias("low"),
            (acc["roots"] + root.cast("int")).alias("roots"),
            F.coalesce(acc["text"], h["text"]).alias("text"))

    return F.aggregate(heads, start, step, lambda acc: F.when(acc["roots"] == 1, acc["text"]))


def unique_title(documents: DataFrame) -> DataFrame:
    return body_of(documents).select("path", unique_title_of(heading_array(F.col("body"))).alias("title"))


def toc(heads: DataFrame) -> DataFrame:
    """Table of contents: outline depth and number (``1.2.1``) of every heading.

    A row carries the last heading of each level before it.  Its ancestors are
    those of a smaller level that no heading of a still smaller level follows.
    """
    ranked = heading_tree(heads).withColumn("rank", F.row_number().over(W.partitionBy("path", "parent_pos").orderBy("pos")))
    before = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    node = F.struct("pos", "level", "rank")
    last = [F.max(F.when(F.col("level") == k, node)).over(before) for k in range(1, 6)]
    rows = ranked.withColumn("last", F.array_compact(F.array(*last)))
    ancestors = F.expr("filter(last, a -> a.level < level AND NOT exists(last, b -> b.level < a.level AND b.pos > a.pos))")
    chain = F.array_append(F.transform(ancestors, lambda a: a["rank"]), F.col("rank"))
    return rows.select(
        "path", "pos", "level", "text", "parent_pos", (F.size(ancestors) + 1).alias("depth"), F.array_join(chain, ".").alias("outline"))


def titles(props: DataFrame) -> DataFrame:
    """Front-matter title, else the unique top-level heading, else NULL."""
    heading = unique_title_of(heading_array(unify_newlines(F.col("body"))))
    return lazily(props, {"title": F.coalesce(F.nullif("fm_title", F.lit("")), heading)})


def strip_title(props: DataFrame) -> DataFrame:
    """Body without its first heading where that heading supplied the title."""
    body = unify_newlines(F.col("body"))
    untitled = F.nullif("fm_title", F.lit("")).isNull()
    inferred = untitled & unique_title_of(heading_array(F.col("body"))).isNotNull()
    checked = computed(computed(props.select("path", "fm_title", "body"), {"body": body}), {"stripped": inferred})
    parts = computed(checked, {"parts": F.when(F.col("stripped"), _all("body", _PART))})

    def is_heading(part: Column) -> Column:
        text = F.regexp_replace(part, r"\n\z", "")
        numbered = part.rlike(rf"\A#{{1,6}}(?:[{BLANK}]|\n)")
        return ~part.rlike(_FENCE_START) & (numbered | text.contains("\n"))

    at = computed(parts, {"at": F.array_position(F.transform("parts", is_heading), F.lit(True)).cast("int")})
    rest = F.concat(F.slice("parts", F.lit(1), F.col("at") - 1), F.slice("parts", F.col("at") + 1, F.size("parts")))
    return at.select("path", "stripped", F.when(F.col("stripped"), F.array_join(rest, "")).otherwise(F.col("body")).alias("body"))


def html_headings(pages: DataFrame) -> DataFrame:
    """``h1`` to ``h6`` elements of ``(path, html)`` with their text."""
    found = _all("html", r"(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>")
    level = F.regexp_extract("m", r"(?i)\A<h([1-6])", 1).cast("int")
    rows = _rows(pages, F.transform(found, lambda m: F.struct(m.alias("m"))))
    return rows.select("path", "pos", level.alias("level"), html_text(F.col("m")).alias("text"))


# --- fenced blocks -------------------------------------------------------------------------


def fenced_blocks(documents: DataFrame) -> DataFrame:
    """Closed fenced blocks with language and content."""
    rows = _rows(body_of(documents), F.transform(_all("body", FENCE), lambda m: F.struct(m.alias("m"))))
    marker = rf"\A([{BLANK}]*(?:`{{3,}}|~{{3,}}))"
    first, last = F.substring_index("m", "\n", 1), F.substring_index("m", "\n", -1)
    closed = F.col("m").contains("\n") & (F.regexp_extract(first, marker, 1) == F.regexp_extract(last, marker, 1))
    inner = F.regexp_replace(F.regexp_replace("m", r"\A[^\n]*+\n?+", ""), r"\n?+[^\n]*+\z", "")
    return rows.where(closed).select("path", "pos", F.regexp_extract(first, _INFO, 1).alias("lang"), rstrip(inner).alias("content"))


def code_blocks(documents: DataFrame, strict: bool = False) -> DataFrame:
    """Fenced blocks with the target's language id; unknown languages are kept, or ``none`` when strict."""
    known = lookup(F.col("lang"), L.LANGUAGES)
    language = known if strict else F.coalesce(known, F.nullif("lang", F.lit("")))
    return fenced_blocks(documents).withColumn("language", F.coalesce(language, F.lit("none")))


def diagram_blocks(documents: DataFrame) -> DataFrame:
    """Diagrams in fenced blocks, named after their content, and diagrams referenced as images."""
    fences = fenced_blocks(documents).where(F.col("lang").isin("mermaid", "plantuml"))
    ending = F.when(F.col("lang") == "mermaid", "mmd").otherwise("puml")
    embedded = fences.select("path", "pos", F.col("lang").alias("kind"), F.concat(F.lit("embedded_"), F.md5("content"), F.lit("."), ending).alias("artefact"))
    kind = (
        F.when(F.col("url").rlike(r"\.(mmd|mermaid)\z"), "mermaid")
        .when(F.col("url").rlike(r"\.(puml|plantuml)\z"), "plantuml")
        .when(F.col("url").rlike(r"\.drawio(\.png|\.svg|\.xml)?\z"), "drawio"))
    linked = images(documents).select("path", "pos", kind.alias("kind"), F.col("url").alias("artefact")).where("kind IS NOT NULL")
    return embedded.unionByName(linked)


def diagram_config(documents: DataFrame) -> DataFrame:
    """Title and scale from the front-matter inside a diagram; a malformed scale is an error row."""
    blocks = fenced_blocks(documents).where(F.col("lang").isin("mermaid", "plantuml"))
    block = F.nullif(F.regexp_extract("content", r"(?sm)\A---\n(.+?)^---(?:\n|\z)", 1), F.lit(""))
    keyed = blocks.withColumn("entries", frontmatter_entries(block))

    def value(key: str) -> Column:
        return F.try_element_at(F.filter("entries", lambda e: e["key"] == key), F.lit(-1))["value"]

    scale = value("config.scale")
    return keyed.where("entries IS NOT NULL").select(
        "path", "pos", F.col("lang").alias("kind"), value("title").alias("title"), scale.try_cast("double").alias("scale"),
        F.when(scale.isNotNull() & scale.try_cast("double").isNull(), F.lit("malformed scale")).alias("error"))


def passthrough_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of verbatim target markup, which must hold a single element, and of formulas."""
    single = F.col("content").rlike(r"(?s)\A\s*<([\w:-]+)(?:\s[^>]*)?(?:/>|>.*</\1>)\s*\z")
    blocks = fenced_blocks(documents).where(F.col("lang").isin("csf", "math"))
    return blocks.withColumn("error", F.when((F.col("lang") == "csf") & ~single, F.lit("expected a single element")))


# --- links, images, mentions ---------------------------------------------------------------


def links(documents: DataFrame) -> DataFrame:
    """Inline links with their kind: mention, absolute, anchor, page or attachment."""
    bare = F.regexp_replace("prose", IMAGE, "")
    rows = _rows(prose_of(documents), F.transform(_all(bare, LINK), lambda m: F.struct(m.alias("m"))))
    out = rows.select("path", "pos", F.regexp_extract("m", LINK, 1).alias("text"), F.regexp_extract("m", LINK, 2).alias("url"))
    return classify_links(out)


def classify_links(out: DataFrame) -> DataFrame:
    url = F.col("url")
    kind = (
        F.when(url.startswith("mailto:"), "mention")
        .when(is_absolute_url(url), "absolute")
        .when(url.startswith("#") | (url == ""), "anchor")
        .when(url_path(url).endswith(".md"), "page")
        .otherwise("attachment"))
    return out.withColumns({"kind": kind, "fragment": url_fragment(url)})


def html_links(pages: DataFrame) -> DataFrame:
    """Links of HTML pages, classified like Markdown links."""
    rows = _rows(pages, F.transform(_all("html", HTML_LINK), lambda m: F.struct(m.alias("m"))))
    return classify_links(rows.select(
        "path", "pos", html_text(F.regexp_extract("m", HTML_LINK, 2)).alias("text"), F.regexp_extract("m", HTML_LINK, 1).alias("url")))


def mentions(documents: DataFrame, column: str = "body") -> DataFrame:
    """Distinct ``(path, email, name)`` of links to e-mail addresses with a non-empty name."""
    pattern = r"\[([^\[\]]+)\]\(mailto:([^()]+)\)"
    pairs = F.array_distinct(F.arrays_zip(_all(column, pattern, 2).alias("email"), _all(column, pattern, 1).alias("name")))
    return documents.select("path", F.inline(pairs).alias("email", "name"))


def paragraph_lines(text: Column) -> Column:
    """``ARRAY<STRUCT<line, alone>>``: ``alone`` lines form a paragraph of their own."""
    none = F.array(F.lit(""))

    def blank(line: Column) -> Column:
        return F.coalesce(~line.rlike(rf"[^{BLANK}]"), F.lit(True))

    def judged(split: Column) -> Column:
        with_previous = F.zip_with(split, F.concat(none, split), lambda line, p: F.struct(line.alias("line"), blank(p).alias("lead")))
        full = F.zip_with(with_previous, F.slice(split, F.lit(2), F.size(split)), lambda x, n: F.struct(
            x["line"].alias("line"), (x["lead"] & blank(n)).alias("alone")))
        return F.filter(full, lambda x: x["line"].isNotNull())

    # the text is cut once
    return let(F.split(text, "\n"), judged)


def card_links(documents: DataFrame) -> DataFrame:
    """Absolute links that fill a paragraph."""
    pattern = rf"\A[{BLANK}]*\[([^\[\]]*)\]\((https?://[^()\s]*)\)[{BLANK}]*\z"
    found = F.filter(paragraph_lines(F.col("prose")), lambda x: x["alone"] & x["line"].rlike(pattern))
    rows = _rows(prose_of(documents), found)
    return rows.select("path", "pos", F.regexp_extract("line", pattern, 1).alias("text"), F.regexp_extract("line", pattern, 2).alias("url"))


def _attribute(tag: str, name: str) -> Column:
    found = F.col(tag).rlike(rf'\s{name}="')
    return F.when(found, F.regexp_extract(tag, rf'\s{name}="([^"]*)"', 1))


def images(documents: DataFrame) -> DataFrame:
    """Image references with alternate text, title, size, context and kind."""
    both = rf"{IMAGE}|{HTML_IMAGE}"
    lines_with = F.filter(paragraph_lines(F.col("prose")), lambda x: x["line"].contains("![") | x["line"].contains("<img"))
    found = F.flatten(F.transform(lines_with, lambda x: F.transform(
        F.regexp_extract_all(x["line"], F.lit(both), F.lit(0)),
        lambda m: F.struct(m.alias("m"), (x["alone"] & (F.trim(x["line"]) == m)).alias("block")))))
    rows = _rows(prose_of(documents), found)
    html = F.col("m").startswith("<")

    def digits(name: str) -> Column:
        value = _attribute("m", name)
        return F.when(html & value.rlike(r"\A[0-9]+\z"), value.try_cast("int"))

    url = F.when(html, _attribute("m", "src")).otherwise(F.regexp_extract("m", IMAGE, 2))
    out = rows.select(
        "path", "pos",
        F.when(html, _attribute("m", "alt")).otherwise(F.regexp_extract("m", IMAGE, 1)).alias("alt"),
        url.alias("url"),
        F.when(html, _attribute("m", "title")).otherwise(F.nullif(F.regexp_extract("m", IMAGE, 3), F.lit(""))).alias("title"),
        digits("width").alias("width"), digits("height").alias("height"),
        F.when(F.col("block"), "block").otherwise("inline").alias("context"))
    return out.withColumn("kind", F.when(is_absolute_url(F.col("url")), "external").otherwise("local"))


def image_caption(found: DataFrame) -> DataFrame:
    """Caption of block images: the title, else the alternate text."""
    caption = F.when(F.col("context") == "block", F.coalesce(F.nullif("title", F.lit("")), F.nullif("alt", F.lit(""))))
    return found.withColumn("caption", caption)


def status_labels(documents: DataFrame) -> DataFrame:
    """Inline status labels; gray has no colour parameter, an unknown colour is an error row."""
    rows = _rows(prose_of(documents), F.transform(_all("prose", STATUS), lambda m: F.struct(m.alias("m"))))
    color = F.lower(F.regexp_extract("m", STATUS, 2))
    known = color.isin(*L.STATUS_COLORS)
    return rows.select(
        "path", "pos", F.regexp_extract("m", STATUS, 1).alias("caption"), color.alias("color"),
        F.when(known & (color != "gray"), F.initcap(color)).alias("parameter"),
        F.when(~known, F.lit("unknown status color")).alias("error"))


def status_images() -> dict[str, str]:
    """Colour -> drawing that stands for a status label in rendered text."""
    return {
        color: f'<svg height="10" width="10" xmlns="http://www.w3.org/2000/svg"><circle r="5" cx="5" cy="5" fill="{color}" /></svg>'
        for color in L.STATUS_COLORS
    }


def status_uuid(color: Column) -> Column:
    return content_uuid(lookup(color, status_images()))


# --- panels --------------------------------------------------------------------------------


def alerts(documents: DataFrame) -> DataFrame:
    """Block-quote alerts of both dialects with their panel class; unknown names are error rows."""
    quotes = _all("prose", r"(?md)^ {0,3}>[^\n]*+(?:\n {0,3}>[^\n]*+)*+")
    text = F.transform(quotes, lambda q: F.struct(F.regexp_extract(q, r"\A {0,3}> ?([^\n]*)", 1).alias("head")))
    rows = _rows(prose_of(documents), text)
    bracket = F.col("head").startswith("[!")
    colon = F.col("head").rlike(r"\A(FLAG|NOTE|WARNING|DISCLAIMER):")
    name = F.when(bracket, F.nullif(F.regexp_extract("head", r"\A\[!([A-Z]+)\]", 1), F.lit(""))).otherwise(F.regexp_extract("head", r"\A([A-Z]+):", 1))
    out = rows.where(bracket | colon).select("path", "pos", F.when(bracket, "bracket").otherwise("colon").alias("flavor"), name.alias("name"))
    panel = F.when(F.col("flavor") == "bracket", lookup(F.col("name"), L.BRACKET_ALERT_CLASSES)).otherwise(lookup(F.col("name"), L.COLON_ALERT_CLASSES))
    return out.withColumn("class", panel).withColumn("error", F.when(F.col("class").isNull(), F.lit("unsupported alert")))


def admonitions(documents: DataFrame) -> DataFrame:
    """``!!! type "title"`` blocks with panel class and panel style; unknown types are error rows."""
    pattern = rf'(?md)^!!! ?([\w-]+)(?: +"([^\n]*)")?[{BLANK}]*+((?:\n(?: {{4}}|\t)[^\n]*+)*+)'
    rows = _rows(prose_of(documents), F.transform(_all("prose", pattern), lambda m: F.struct(m.alias("m"))))
    kind = F.lower(F.regexp_extract("m", pattern, 1))
    title = F.when(F.substring_index("m", "\n", 1).contains('"'), F.regexp_extract("m", pattern, 2))
    out = rows.select("path", "pos", kind.alias("type"), title.alias("title"),
                      F.regexp_replace(F.regexp_extract("m", pattern, 3), r"\n(?: {4}|\t)", "\n").alias("body"))
    out = out.withColumn("body", strip(F.col("body")))
    return out.withColumns({
        "class": lookup(F.col("type"), L.ADMONITION_CLASSES),
        "icon": lookup(F.col("type"), L.PANEL_ICONS),
        "background": lookup(F.col("type"), L.PANEL_COLORS),
        "error": F.when(lookup(F.col("type"), L.ADMONITION_CLASSES).isNull(), F.lit("unsupported admonition")),
    })


def collapsed_sections(documents: DataFrame) -> DataFrame:
    """Collapsible sections: summary and body; malformed ones are error rows."""
    pattern = r"(?s)<details([^>]*)>(.*?)</details>"
    rows = _rows(prose_of(documents), F.transform(_all("prose", pattern), lambda m: F.struct(m.alias("m"))))
    content = F.regexp_extract("m", pattern, 2)
    lead = r"(?s)\A\s*<summary>(.*?)</summary>"
    has_summary = content.rlike(lead)
    parsed = F.regexp_extract("m", pattern, 1).rlike(r'markdown="1"')
    return rows.select(
        "path", "pos", F.when(has_summary, html_text(F.regexp_extract(content, lead, 1))).alias("summary"),
        F.when(has_summary, strip(F.regexp_replace(content, lead, ""))).otherwise(strip(content)).alias("body"),
        F.when(~has_summary, F.lit("summary must come first")).when(~parsed, F.lit("markdown attribute missing")).alias("error"))


def placeholders(documents: DataFrame) -> DataFrame:
    """Paragraphs that stand for a table of contents or a list of child pages."""
    pattern = rf"\A[{BLANK}]*\[\[_(TOC|LISTING)_\]\][{BLANK}]*\z"
    found = F.filter(paragraph_lines(F.col("prose")), lambda x: x["alone"] & x["line"].rlike(pattern))
    return _rows(prose_of(documents), found).select("path", "pos", F.lower(F.regexp_extract("line", pattern, 1)).alias("kind"))


def date_widgets(documents: DataFrame) -> DataFrame:
    pattern = r'<input type="date" value="([^"]*)"'
    rows = _rows(prose_of(documents), F.transform(_all("prose", pattern, 1), lambda m: F.struct(m.alias("value"))))
    return rows.select("path", "pos", "value", F.expr("try_to_date(value, 'yyyy-MM-dd')").alias("day"))


# --- lists, footnotes, formulas, tables ----------------------------------------------------


def tasks(documents: DataFrame) -> DataFrame:
    """Task lists: a list counts only if every item starts with a check box."""
    found = _all("prose", r"(?md)^[-*+][ \t][^\n]*+(?:\n(?:[-*+][ \t]|[ \t]++\S)[^\n]*+)*+")
    lists = F.transform(found, lambda t: F.struct(F.regexp_extract_all(t, F.lit(r"(?md)^[-*+][ \t]+([^\n]*)"), F.lit(1)).alias("items")))
    rows = _rows(prose_of(documents), lists).where(F.forall("items", lambda i: i.rlike(r"\A\[[ xX]\]")))
    items = rows.select("path", F.col("pos").alias("list_id"), F.posexplode("items").alias("n", "item"))
    return items.select(
        "path", "list_id", (F.col("n") + 1).alias("task_id"),
        F.when(F.col("item").startswith("[ ]"), "incomplete").otherwise("complete").alias("status"),
        F.trim(F.substring("item", 4, 1 << 30)).alias("body"))


_NOTE_DEF = r"(?md)^\[\^([^\]\n]+)\]:[ \t]*([^\n]*)"
_NOTE_REF = r"\[\^([^\]\n]+)\]"


def footnote_refs(documents: DataFrame) -> DataFrame:
    """References to defined footnotes, numbered per name: ``NAME``, ``NAME-2``, ``NAME-3`` ..."""
    text = F.regexp_replace("prose", r"(?md)^\[\^[^\]\n]+\]:", "")
    arrays = computed(prose_of(documents), {"refs": _all(text, _NOTE_REF, 1), "defs": F.array_distinct(_all("prose", _NOTE_DEF, 1))})
    # Joined within the row, before the explode, so that no row carries a list.
    defined = F.expr("filter(transform(refs, (r, n) -> struct(n, r AS name)), x -> array_contains(defs, x.name))")
    rows = arrays.select("path", F.inline(defined).alias("n", "name"))
    nth = F.row_number().over(W.partitionBy("path", "name").orderBy("n"))
    out = rows.select("path", (F.col("n") + 1).alias("pos"), "name", nth.alias("nth"))
    return out.withColumn("anchor", F.when(F.col("nth") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", "nth")))


def footnote_defs(documents: DataFrame) -> DataFrame:
    """Definitions with one back-link per reference; several back-links carry superscript numbers."""
    text = F.regexp_replace("prose", r"(?md)^\[\^[^\]\n]+\]:", "")
    defs = F.arrays_zip(_all("prose", _NOTE_DEF, 1).alias("name"), _all("prose", _NOTE_DEF, 2).alias("note"))
    arrays = computed(prose_of(documents), {"refs": _all(text, _NOTE_REF, 1), "defs": defs})
    totals = F.expr("transform(defs, d -> struct(d.name, d.note, size(filter(refs, r -> r = d.name)) AS total))")
    counted = arrays.select("path", F.inline(totals).alias("name", "note", "total")).where("total > 0")
    rows = counted.select("path", "name", "note", "total", F.explode(F.sequence(F.lit(1), F.col("total"))).alias("nth"))
    label = F.when(F.col("total") == 1, F.lit("↩")).otherwise(
        F.concat(F.lit("↩"), F.translate(F.col("nth").cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")))
    anchor = F.when(F.col("nth") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", "nth"))
    return rows.select("path", "name", "note", "nth", anchor.alias("anchor"), label.alias("label"))


_BLOCK_MATH = r"\$\$([^$\n]++(?:\n[^$\n]++)*+)\$\$"
_INLINE_MATH = r"\$([^$\s](?:[^$\n]*[^$\s])?)\$"
_PAREN_MATH = r"\\\(([^\n]+?)\\\)"


def math_formulas(documents: DataFrame) -> DataFrame:
    """Formulas in text, blocks before inline ones at the same place, and in fenced blocks."""
    pattern = f"{_BLOCK_MATH}|{_INLINE_MATH}|{_PAREN_MATH}"
    rows = _rows(prose_of(documents), F.transform(_all("prose", pattern), lambda m: F.struct(m.alias("m"))))
    text = F.regexp_replace("m", r"\A(?:\$\$|\$|\\\()|(?:\$\$|\$|\\\))\z", "")
    inline = rows.select("path", "pos", F.when(F.col("m").startswith("$$"), "block").otherwise("inline").alias("kind"), text.alias("formula"))
    fenced = fenced_blocks(documents).where("lang = 'math'").select("path", "pos", F.lit("fence").alias("kind"), F.col("content").alias("formula"))
    return inline.unionByName(fenced)


def emoji(documents: DataFrame) -> DataFrame:
    """Short names with the emoticon they map to."""
    pattern = r":([a-z0-9_+-]+):"
    rows = _rows(prose_of(documents), F.transform(_all("prose", pattern, 1), lambda m: F.struct(m.alias("shortname"))))
    return rows.withColumn("emoticon", F.coalesce(lookup(F.col("shortname"), L.EMOTICONS), F.lit(L.DEFAULT_EMOTICON)))


def table_cells(documents: DataFrame) -> DataFrame:
    """Cells of pipe tables.

    A header row without text is dropped.  If the second column is blank in every
    row, the first column becomes a header and the separator column is removed.
    """
    pattern = rf"(?md)^\|[^\n]*\|[{BLANK}]*+\n\|(?:[{BLANK}]*+:?+-++:?+[{BLANK}]*+\|)++[{BLANK}]*+(?:\n\|[^\n]*+)*+"
    separator = rf"\A\|(?:[{BLANK}]*+:?+-++:?+[{BLANK}]*+\|)++[{BLANK}]*+\z"
    rows = _rows(prose_of(documents), F.transform(_all("prose", pattern), lambda m: F.struct(m.alias("m"))))

    def cells(line: Column) -> Column:
        inner = F.regexp_replace(line, rf"\A\||\|[{BLANK}]*\z", "")
        return F.transform(F.split(inner, r"\|"), strip)

    text_lines = F.transform(F.split("m", "\n"), lambda line, n: F.struct(line.alias("line"), n.alias("n")))
    kept = F.filter(text_lines, lambda x: (x["n"] != 1) | ~x["line"].rlike(separator))
    grid = F.transform(kept, lambda x: F.struct((x["n"] == 0).alias("head"), cells(x["line"]).alias("cells")))
    tables = rows.select("path", F.col("pos").alias("table_id"), grid.alias("grid"))
    return grid_cells(tables)


def grid_cells(tables: DataFrame) -> DataFrame:
    """Cells of ``(path, table_id, grid)``: headers without text go, a blank second column makes the first one a header."""
    filled = F.filter("grid", lambda r: ~r["head"] | F.exists(r["cells"], lambda c: c != ""))
    tables = tables.withColumn("grid", filled).where(F.size("grid") > 0)
    by_column = F.forall("grid", lambda r: (F.size(r["cells"]) > 1) & (F.try_element_at(r["cells"], F.lit(2)) == ""))
    # Decided per table before its rows are exploded, so that no row carries the whole grid.
    tables = computed(tables, {"by_column": by_column})
    tables = tables.select("path", "table_id", "by_column", F.posexplode("grid").alias("r", "row"))
    values = F.when(F.col("by_column"), F.concat(F.slice("row.cells", 1, 1), F.slice(F.col("row.cells"), F.lit(3), F.size("row.cells")))).otherwise(F.col("row.cells"))
    flat = tables.select("path", "table_id", "by_column", (F.col("r") + 1).alias("row"), F.col("row.head").alias("head"), F.posexplode(values).alias("c", "text"))
    header = F.col("head") | (F.col("by_column") & (F.col("c") == 0))
    return flat.select("path", "table_id", "row", (F.col("c") + 1).alias("col"), "text", header.alias("is_header"))
