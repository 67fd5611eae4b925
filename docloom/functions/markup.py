"""Scalar column functions over HTML and storage markup."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookups import COMMENT_MARKER, ORDERLESS_ELEMENT, SPACE, VOLATILE_ATTRIBUTES, VOLATILE_ELEMENT, lookup
from .text import strip

# Entity name -> character, as HTML 4 and XML define them.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

_QUOTED = """(?:"[^"]*+"|'[^']*+')"""
_TAG = rf"""<[^"'>]*+(?:{_QUOTED}[^"'>]*+)*+>"""


def unwrap(markup: Column, tag: str = COMMENT_MARKER) -> Column:
    """Remove a wrapper element but keep its content."""
    return F.regexp_replace(markup, rf"</?{tag}(?:\s[^>]*)?>", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decoded(text: Column) -> Column:
    """Text with its named and numeric entities replaced, once; unknown ones stay."""

    def piece(p: Column) -> Column:
        number = F.when(p.rlike(r"\A&#[0-9]"), F.substring(p, F.lit(3), F.length(p) - 3).cast("long")).when(
            p.rlike(r"\A&#[xX]"), F.conv(F.substring(p, F.lit(4), F.length(p) - 4), 16, 10).cast("long"))
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        name = F.substring(p, F.lit(2), F.length(p) - 2)
        return F.when(~p.startswith("&"), p).when(p.startswith("&#"), F.when(valid, character).otherwise(p)).otherwise(F.coalesce(lookup(name, ENTITIES), p))

    pieces = F.regexp_extract_all(text, F.lit(rf"{_ENTITY}|[^&]+|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def html_text(markup: Column) -> Column:
    """Concatenated and trimmed text of all elements."""
    return strip(decoded(F.regexp_replace(markup, "<[^>]*>", "")))


def markup_pieces(markup: Column) -> Column:
    """Tags, CDATA sections, comments, declarations and the text between them, in order."""
    return F.regexp_extract_all(markup, F.lit(rf"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|{_TAG}|[^<]+|<"), F.lit(0))


def _is_tag(p: Column, name: str) -> Column:
    return p.rlike(rf"\A</?{name}[\s/>]")


def tree_digest(markup: Column) -> Column:
    """Digest of the element tree: equal for two versions of a page that differ in no content.

    The pieces are folded with a stack of open elements.  An element's digest is
    made of its name, attributes, leading text and children; a child's includes the text that follows it.
    Children count in their order, but those of orderless elements as a sorted list.  Order of attributes, kind of quotes, entities for
    characters, white space around texts, comments, comment markers, volatile attributes and the content of
    volatile elements do not matter; CDATA sections are text as it stands.  Elements left open, or closed
    without being open, enter the digest as they are.
    """
    element = "struct<tag:string,attrs:string,text:string,pending:string,last:string,folded:string,kids:array<string>>"

    def attributes(p: Column) -> Column:
        pairs = F.regexp_extract_all(p, F.lit(rf"\s([^\s=>/]+\s*=\s*{_QUOTED})"), F.lit(1))
        named = F.transform(pairs, lambda a: F.struct(
            F.regexp_extract(a, r"\A[^\s=]+", 0).alias("name"), decoded(F.regexp_extract(a, r"(?s)=\s*.(.*).\z", 1)).alias("value")))
        kept = F.filter(named, lambda a: ~a["name"].isin(*VOLATILE_ATTRIBUTES))
        return F.array_join(F.transform(F.array_sort(kept), lambda a: F.concat_ws("=", a["name"], F.md5(a["value"]))), " ")

    def typed(p: Column) -> Column:
        cdata = p.startswith("<![CDATA[")
        kind = F.when(cdata | ~p.rlike(r"(?s)\A<.+>\z"), "text").when(p.startswith("</"), "close").when(p.endswith("/>"), "empty").otherwise("open")
        text = F.when(cdata, F.substring(p, F.lit(10), F.length(p) - 12)).otherwise(decoded(p))
        return let(kind, lambda k: F.struct(
            k.alias("kind"), F.when(k != "text", F.regexp_extract(p, r"\A</?([^\s/>]+)", 1)).alias("tag"),
            F.when(k.isin("open", "empty"), attributes(p)).alias("attrs"), F.when(k == "text", text).alias("text")))

    def made(tag: Column, attrs: Column, text, pending, last, folded, kids) -> Column:
        none = F.lit(None).cast("string")
        values = (tag, attrs, text, pending, last, folded, kids)
        return F.struct(*[(none if v is None else v).alias(n) for n, v in zip(("tag", "attrs", "text", "pending", "last", "folded", "kids"), values, strict=True)]).cast(element)

    def opened(p: Column) -> Column:
        return made(p["tag"], p["attrs"], None, F.lit(""), None, F.lit(""), F.array().cast("array<string>"))

    def orderless(e: Column) -> Column:
        return e["tag"].isin(ORDERLESS_ELEMENT)

    def settled(e: Column) -> Column:
        """The text read last becomes the element's own, or that after its last child, which then is complete."""
        first = e["last"].isNull()

        def fold(text: Column) -> Column:
            child = F.md5(F.concat(e["last"], F.lit("|"), text))
            return made(
                e["tag"], e["attrs"], F.when(first, text).otherwise(e["text"]), F.lit(""), None,
                F.when(first | orderless(e), e["folded"]).otherwise(F.md5(F.concat(e["folded"], child))),
                F.when(~first & orderless(e), F.array_append(e["kids"], child)).otherwise(e["kids"]))

        return let(strip(e["pending"]), fold)

    def digest(e: Column) -> Column:
        children = F.when(orderless(e), F.array_join(F.array_sort(e["kids"]), "")).otherwise(e["folded"])
        whole = F.concat_ws("|", e["tag"], F.md5(e["attrs"]), F.md5(e["text"]), children)
        return F.md5(F.when(e["tag"] == VOLATILE_ELEMENT, e["tag"]).otherwise(whole))

    def state(stack: Column, top: Column) -> Column:
        return F.struct(stack.alias("stack"), top.alias("top"))

    def with_text(e: Column, text: Column) -> Column:
        return made(e["tag"], e["attrs"], e["text"], F.concat(e["pending"], text), e["last"], e["folded"], e["kids"])

    def with_child(e: Column, child: Column) -> Column:
        return made(e["tag"], e["attrs"], e["text"], F.lit(""), child, e["folded"], e["kids"])

    def step(s: Column, p: Column) -> Column:
        stack, top, depth = s["stack"], s["top"], F.size(s["stack"])
        closed = F.when(depth == 0, state(stack, with_text(top, F.concat(F.lit("</"), p["tag"], F.lit(">"))))).otherwise(
            state(F.slice(stack, F.lit(1), depth - 1), with_child(F.element_at(stack, -1), let(settled(top), digest))))
        return (
            F.when(p["kind"] == "text", state(stack, with_text(top, p["text"])))
            .when(p["kind"] == "open", state(F.array_append(stack, settled(top)), opened(p)))
            .when(p["kind"] == "empty", let(settled(top), lambda e: state(stack, with_child(e, let(settled(opened(p)), digest)))))
            .otherwise(closed))

    def finish(s: Column) -> Column:
        rest = F.when(F.size(s["stack"]) > 0, F.to_json(s["stack"])).otherwise("")
        return F.md5(F.concat(let(settled(s["top"]), digest), rest))

    relevant = F.filter(markup_pieces(markup), lambda p: ~(p.startswith("<!--") | p.startswith("<?") | (p.startswith("<!") & ~p.startswith("<![CDATA[")) | _is_tag(p, COMMENT_MARKER)))
    root = made(F.lit(""), F.lit(""), None, F.lit(""), None, F.lit(""), F.array().cast("array<string>"))
    return F.aggregate(F.transform(relevant, typed), state(F.array().cast(f"array<{element}>"), root), step, finish)


def canonical_markup(markup: Column) -> Column:
    """One-line form in which two versions of a page read the same when only volatile parts differ; see ``tree_digest`` for equality.

    Attributes are brought into alphabetical order tag by tag, volatile attributes
    and the text of task identifiers are dropped, and white space around
    text is trimmed.  CDATA sections and comments stay as they are, elements in their order.
    """
    volatile = rf"\A(?:{'|'.join(VOLATILE_ATTRIBUTES)})\s*="
    pieces = F.filter(markup_pieces(markup), lambda p: ~_is_tag(p, COMMENT_MARKER))
    # text right after the opening tag of a volatile element is dropped
    pieces = F.transform(pieces, lambda p, i: F.when((i > 0) & ~p.startswith("<") & F.get(pieces, i - 1).rlike(rf"\A<{VOLATILE_ELEMENT}[\s>]"), "").otherwise(p))

    def piece(p: Column) -> Column:
        attributes = F.regexp_extract_all(p, F.lit(rf"\s([^\s=>/]+\s*=\s*{_QUOTED})"), F.lit(1))
        kept = F.filter(attributes, lambda a: ~a.rlike(volatile))
        attributes = F.transform(kept, lambda a: F.regexp_replace(a, r"""\A([^\s=]+)\s*=\s*'([^"']*)'\z""", '$1="$2"'))
        name = F.regexp_extract(p, r"\A<(/?[^\s/>]+)", 1)
        closing = F.when(p.rlike(r"/>\z"), F.lit("/>")).otherwise(F.lit(">"))
        tag = F.concat(F.lit("<"), F.concat_ws(" ", name, F.array_sort(attributes)), closing)
        return F.when(p.startswith("<!"), p).when(p.startswith("<"), tag).otherwise(strip(p))

    return F.array_join(F.transform(pieces, piece), "")


def space_collapsed(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")
