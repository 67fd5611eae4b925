"""Links and images of every form, with definitions looked up inside the document.

The prose is cut into tokens: brackets, what follows a closing bracket, tags,
addresses and the text between.  A fold keeps a stack of the brackets that are open, so texts may hold brackets, images and
links of any depth; what a closing bracket points to is a target in
parentheses, a label, or its own text as a label.  Labels are looked up among the document's
definitions, whatever their case and white space; the last definition of a label counts.

``structure.links`` and ``images`` see the plain inline form and tags only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import decoded, html_text, let
from ..functions.text import is_absolute_url, strip
from ..session import computed
from .structure import classify_links, prose_of

_TITLE = r"""(?:"[^"\n]*"|'[^'\n]*')"""
_TARGET = r"<[^<>\n]*>|[^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*"
_INLINE = rf"\]\([ \t]*(?:{_TARGET})(?:\s+{_TITLE})?[ \t]*\)"
_LABELLED = r"\](?: ?)\[[^\[\]\n]*\]"
_ANCHOR = r"(?is:<a\s[^>]*>.*?</a>)"
_IMG = r"(?i:<img\s[^>]*>)"
_AUTO = r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>"
_BARE = r"""(?<![\w"'(=<\[/])(?:https?|ftp)://[^\s<>()\[\]"'`]*[^\s<>()\[\]"'`.,;:!?]"""
# Text is one token up to the next character that may begin something else.
_SAID = r"(?:[^\\!\[\]<hf]++|!(?!\[)|h(?!ttps?://)|f(?!tp://))++"
_TOKEN = rf"\\.|!\[|\[|{_INLINE}|{_LABELLED}|\]|{_ANCHOR}|{_IMG}|{_AUTO}|{_BARE}|{_SAID}|."
_DEFINITION = rf"(?m)^ {{0,3}}\[(?!\^)([^\[\]\n]+)\]:[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]+({_TITLE}|\([^()\n]*\)))?[ \t]*$"

_FOUND = "array<struct<start:int,image:boolean,form:string,text:string,target:string,title:string>>"
_STACK = "array<struct<image:boolean,start:int,text:string>>"


def _label(text: Column) -> Column:
    return F.lower(F.regexp_replace(strip(text), r"\s+", " "))


def _bare(target: Column) -> Column:
    return F.regexp_replace(strip(target), r"(?s)\A<(.*)>\z", "$1")


def _untitled(title: Column) -> Column:
    return F.nullif(F.regexp_replace(title, r"(?s)\A.(.*).\z", "$1"), F.lit(""))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.when(value != "", decoded(F.regexp_replace(value, r"(?s)\A.(.*).\z", "$1")))


def definitions(documents: DataFrame) -> DataFrame:
    """``(path, label, url, title)`` of the reference definitions of each document."""
    rows = prose_of(documents).select("path", F.posexplode(F.regexp_extract_all("prose", F.lit(_DEFINITION), F.lit(0))).alias("n", "m"))
    parts = rows.select("path", "n", _label(F.regexp_extract("m", _DEFINITION, 1)).alias("label"), _bare(F.regexp_extract("m", _DEFINITION, 2)).alias("url"), _untitled(F.regexp_extract("m", _DEFINITION, 3)).alias("title"))
    last = F.max_by(F.struct("url", "title"), "n").alias("last")
    return parts.groupBy("path", "label").agg(last).select("path", "label", "last.url", "last.title")


def _scan(tokens: Column, defined: Column) -> Column:
    """What the brackets, tags and addresses of a text point to; ``defined`` maps labels to targets."""
    none = F.lit(None).cast("string")

    def state(stack: Column, found: Column, at: Column) -> Column:
        # not cast: that would copy both arrays at every token
        return F.struct(stack.alias("stack"), found.alias("found"), at.alias("at"))

    def hit(start: Column, image: Column, form: Column | str, text: Column, target: Column, title: Column) -> Column:
        return F.struct(start.alias("start"), image.alias("image"), (F.lit(form) if isinstance(form, str) else form).alias("form"), text.alias("text"), target.alias("target"), title.alias("title"))

    def said(stack: Column, text: Column) -> Column:
        """Text inside the bracket that was opened last."""
        top = F.element_at(stack, -1)
        return F.when(F.size(stack) == 0, stack).otherwise(F.array_append(
            F.slice(stack, F.lit(1), F.size(stack) - 1), F.struct(top["image"].alias("image"), top["start"].alias("start"), F.concat(top["text"], text).alias("text")).cast("struct<image:boolean,start:int,text:string>")))

    def step(s: Column, token: Column) -> Column:
        stack, found, at = s["stack"], s["found"], s["at"] + 1
        opening = token.isin("[", "![")
        pushed = state(F.array_append(stack, F.struct((token == "![").alias("image"), at.alias("start"), F.lit("").alias("text")).cast("struct<image:boolean,start:int,text:string>")), found, at)

        def closing(top: Column) -> Column:
            below = F.slice(stack, F.lit(1), F.size(stack) - 1)
            inline, labelled = token.startswith("]("), token.rlike(r"\A\] ?\[")
            own = F.regexp_extract(token, r"\A\] ?\[(.*)\]\z", 1)
            label = _label(F.when(labelled & (own != ""), own).otherwise(top["text"]))
            known = F.when(~top["text"].startswith("^"), F.coalesce(F.try_element_at(defined, label), F.try_element_at(defined, _label(top["text"]))))
            exact = F.try_element_at(defined, label).isNotNull()
            target = F.when(inline, _bare(F.regexp_extract(token, rf"(?s)\A\]\([ \t]*({_TARGET})", 1))).otherwise(known["url"])
            title = F.when(inline, _untitled(F.regexp_extract(token, rf"(?s)\s({_TITLE})[ \t]*\)\z", 1))).otherwise(known["title"])
            # a label that is not defined is text behind a shortcut
            form = F.when(inline, "inline").when(labelled & (own != "") & exact, "reference").when(labelled & (own == ""), "collapsed").otherwise("shortcut")
            # an image leaves its text to the link around it, an unknown label all it says
            linked = let(target, lambda t: F.when(t.isNotNull(), state(
                said(below, F.when(top["image"], "").otherwise(top["text"])), F.concat(found, F.array(hit(top["start"], top["image"], form, top["text"], t, title))), at)).otherwise(
                state(said(below, F.concat(F.lit("["), top["text"], F.when(token == "]", "]").otherwise(token))), found, at)))
            return linked

        tag = token.startswith("<") & (F.length(token) > 1)
        anchor, img = token.rlike(r"(?i)\A<a\s"), token.rlike(r"(?i)\A<img\s")
        address = F.regexp_replace(token, r"\A<|>\z", "")
        mail = address.contains("@") & ~address.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:")
        tagged = (
            F.when(anchor, F.when(_attribute(token, "href").isNotNull(), state(stack, F.concat(found, F.array(hit(at, F.lit(False), "tag", html_text(token), _attribute(token, "href"), _attribute(token, "title")))), at)).otherwise(state(said(stack, html_text(token)), found, at)))
            .when(img, F.when(_attribute(token, "src").isNotNull(), state(stack, F.concat(found, F.array(hit(at, F.lit(True), "tag", F.coalesce(_attribute(token, "alt"), F.lit("")), _attribute(token, "src"), _attribute(token, "title")))), at)).otherwise(state(stack, found, at)))
            .otherwise(state(stack, F.concat(found, F.array(hit(at, F.lit(False), "address", address, F.when(mail, F.concat(F.lit("mailto:"), address)).otherwise(address), none))), at)))
        bare = token.rlike(r"\A(?:https?|ftp)://.") & (F.size(stack) == 0)
        plain = F.when(token.startswith("\\"), F.substring(token, F.lit(2), F.lit(2))).otherwise(token)
        return (
            F.when(opening, pushed)
            .when(token.startswith("]") & (F.size(stack) > 0), let(F.element_at(stack, -1), closing))
            .when(tag, tagged)
            .when(bare, state(stack, F.concat(found, F.array(hit(at, F.lit(False), "bare", token, token, none))), at))
            .otherwise(state(said(stack, plain), found, at)))

    return F.aggregate(tokens, state(F.array().cast(_STACK), F.array().cast(_FOUND), F.lit(0)), step, lambda s: F.sort_array(s["found"]))


def references(documents: DataFrame) -> DataFrame:
    """Every link and image in order: ``(path, pos, image, form, text, url, title)``.

    ``form`` is inline, reference, collapsed, shortcut, address, bare or tag.  Definitions are found in the same pass
    over the row, so nothing is joined or shuffled.
    """
    found = F.regexp_extract_all("prose", F.lit(_DEFINITION), F.lit(0))
    entries = F.transform(found, lambda m: F.struct(
        _label(F.regexp_extract(m, _DEFINITION, 1)).alias("label"), F.struct(_bare(F.regexp_extract(m, _DEFINITION, 2)).alias("url"), _untitled(F.regexp_extract(m, _DEFINITION, 3)).alias("title")).alias("target")))
    rows = computed(prose_of(documents), {"entries": entries, "text": F.regexp_replace("prose", _DEFINITION, "")})
    # the last definition of a label counts
    last = F.filter("entries", lambda e, n: ~F.exists(F.slice("entries", n + 2, F.size("entries")), lambda o: o["label"] == e["label"]))
    rows = computed(rows, {"defined": F.map_from_entries(last), "tokens": F.regexp_extract_all("text", F.lit(rf"(?s){_TOKEN}"), F.lit(0))})
    rows = computed(rows, {"found": _scan(F.col("tokens"), F.col("defined"))})
    out = rows.select("path", F.posexplode("found").alias("n", "f"))
    return out.select("path", (F.col("n") + 1).alias("pos"), "f.image", "f.form", "f.text", F.col("f.target").alias("url"), "f.title")


def all_links(documents: DataFrame) -> DataFrame:
    """Links of every form with their kind; ``pos`` counts links and images together."""
    return classify_links(references(documents).where("NOT image").drop("image"))


def all_images(documents: DataFrame) -> DataFrame:
    """Images of every form; ``kind`` tells external from local ones."""
    rows = references(documents).where("image").drop("image").withColumnRenamed("text", "alt")
    return rows.withColumn("kind", F.when(is_absolute_url(F.col("url")), "external").otherwise("local"))


def card_references(documents: DataFrame) -> DataFrame:
    """Links to addresses that fill a paragraph, whatever their form."""
    paragraphs = F.filter(F.split("prose", r"\n[ \t]*\n"), lambda p: strip(p) != "")
    rows = prose_of(documents).select(F.col("path").alias("_path"), "prose", F.regexp_extract_all("prose", F.lit(_DEFINITION), F.lit(0)).alias("_defs"), F.posexplode(paragraphs).alias("n", "p"))
    alone = strip(F.col("p")).rlike(rf"\A(?:\[[^\n]*\]\([^\n]*\)|\[[^\n]*\] ?\[[^\n]*\]|\[[^\n]*\]|{_AUTO}|{_BARE})\z")
    rows = rows.where(alone & ~strip(F.col("p")).startswith("[^") & ~F.col("p").rlike(_DEFINITION))
    parts = rows.select(F.concat_ws("\n", "_path", F.col("n").cast("string")).alias("path"), F.concat(strip(F.col("p")), F.lit("\n\n"), F.array_join("_defs", "\n")).alias("body"), F.length(strip(F.col("p"))).alias("size"))
    found = references(parts)
    single = found.groupBy("path").agg(F.count(F.lit(1)).alias("links"), F.first("text").alias("text"), F.first("url").alias("url"), F.first("image").alias("image"))
    cards = single.where((F.col("links") == 1) & ~F.col("image") & F.col("url").rlike(r"\Ahttps?://"))
    n = F.substring_index("path", "\n", -1).cast("int")
    return cards.select(F.regexp_replace("path", r"\n[0-9]+\z", "").alias("path"), (n + 1).alias("paragraph"), "text", "url")
