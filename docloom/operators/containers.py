"""Lists, quotes, notes and tables as containers: loose and nested ones too.

The text is cut into top-level blocks by one pattern per kind: a block goes on over blank lines as long as what
follows belongs to it.  The lines of a list are then folded with a stack of the
lists that are open; four columns of indentation are one level.  Text right below a
paragraph belongs to it, whatever it starts with.

``structure.tasks``, ``alerts``, ``footnote_defs`` and ``table_cells`` see each tight block by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.lookups import lookup
from ..functions.markup import let
from ..functions.text import strip
from ..session import computed
from .structure import FENCE, body_of, grid_cells

_BLANK = r"[ \t]*+(?:\n|\z)"
_MARK = r"(?:[-*+]|\d{1,9}\.)[ \t]"
# A fence stands as one line in the plane of private characters.
_FENCED = "\ue000"
_LIST = (
    rf"^ {{0,3}}{_MARK}[^\n]*+"
    rf"(?:\n(?:[ \t]*+\n)*+(?:(?: {{4}}|\t)[ \t]*+[^\s{_FENCED}]| {{0,3}}{_MARK})[^\n]*+|\n(?!{_BLANK})(?!#| {{0,3}}>|[ \t]*+{_FENCED})[^\n]++)*+")
_QUOTE = rf"^ {{0,3}}>[^\n]*+(?:\n(?:[ \t]*+\n)*+ {{0,3}}>[^\n]*+|\n(?!{_BLANK})(?!#|{_FENCED})[^\n]++)*+"
_NOTE_HEAD = r" {0,3}\[\^([^\]\n]+)\]:"
_NOTE_LINE = rf"\n(?!{_BLANK})(?! {{0,3}}\[\^[^\]\n]+\]:)[^\n]++"
_NOTE = rf"^{_NOTE_HEAD}[ \t]*+[^\n]*+(?:{_NOTE_LINE})*+(?:\n(?:[ \t]*+\n)++(?: {{4}}|\t)[^\n]++(?:{_NOTE_LINE})*+)*+"
_HEADING = r"^#{1,6}[^\n]*+"
_PARAGRAPH = rf"^(?!{_BLANK})[^\n]++(?:\n(?!{_BLANK})(?!#|{_FENCED})[^\n]++)*+"
_BLOCK = rf"(?md)(?:{_LIST}|{_QUOTE}|{_NOTE}|{_HEADING}|^[ \t]*+{_FENCED}[^\n]*+|{_PARAGRAPH})"

_ITEMS = "array<struct<list:int,number:int,level:int,ordered:boolean,text:string>>"
_RULE = r"\A {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\z"
_PIPE = "\ue001"


def blocks(documents: DataFrame) -> DataFrame:
    """``(path, blocks)``: the top-level blocks of each body in order; a fenced block is a single mark."""
    text = F.regexp_replace("body", FENCE, _FENCED)
    return computed(body_of(documents), {"blocks": F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0))}).select("path", "blocks")


def _of_kind(pattern: str) -> Column:
    return F.filter("blocks", lambda b: b.rlike(rf"\A(?:{pattern})"))


def _list_items(block: Column) -> Column:
    """Items of a list and the lists in it, in order; ``list`` numbers the lists from 0."""
    state_type = f"struct<stack:array<struct<list:int,ordered:boolean,count:int>>,next:int,items:{_ITEMS},blank:boolean>"

    def state(stack: Column, following: Column, items: Column, blank: Column) -> Column:
        # not cast: that would copy the items at every line
        return F.struct(stack.alias("stack"), following.alias("next"), items.alias("items"), blank.alias("blank"))

    def typed(line: Column) -> Column:
        lead = F.replace(F.regexp_extract(line, r"\A([ \t]*)", 1), F.lit("\t"), F.lit("    "))
        marked = line.rlike(rf"\A[ \t]*{_MARK}")
        return F.struct(
            F.floor(F.length(lead) / 4).cast("int").alias("level"), marked.alias("marked"), line.rlike(r"\A[ \t]*\d").alias("ordered"), (~line.rlike(r"\S")).alias("blank"),
            F.when(marked, F.regexp_replace(line, rf"\A[ \t]*{_MARK}[ \t]*", "")).otherwise(strip(line)).alias("text"))

    def step(s: Column, line: Column) -> Column:
        depth = F.size(s["stack"])
        above = F.get(s["stack"], line["level"])
        other = (line["level"] < depth) & (above["ordered"] != line["ordered"])

        def item(kept: Column) -> Column:
            same = (line["level"] < depth) & ~other
            number, count = F.when(same, above["list"]).otherwise(s["next"]), F.when(same, above["count"] + 1).otherwise(1)
            stack = F.array_append(kept, F.struct(number.alias("list"), line["ordered"].alias("ordered"), count.alias("count")))
            new = F.struct(number.alias("list"), count.alias("number"), line["level"].alias("level"), line["ordered"].alias("ordered"), line["text"].alias("text"))
            return state(stack, F.when(same, s["next"]).otherwise(s["next"] + 1), F.array_append(s["items"], new), F.lit(False))

        def longer(last: Column) -> Column:
            text = F.concat(last["text"], F.when(s["blank"], "\n\n").otherwise("\n"), line["text"])
            new = F.struct(last["list"].alias("list"), last["number"].alias("number"), last["level"].alias("level"), last["ordered"].alias("ordered"), text.alias("text"))
            stack = F.when(s["blank"], F.slice(s["stack"], F.lit(1), F.least(depth, F.greatest(line["level"], F.lit(1))))).otherwise(s["stack"])
            return state(stack, s["next"], F.array_append(F.slice(s["items"], F.lit(1), F.size(s["items"]) - 1), new), F.lit(False))

        starts = line["marked"] & (line["level"] <= depth) & (~F.coalesce(other, F.lit(False)) | s["blank"])
        return (
            F.when(line["blank"], state(s["stack"], s["next"], s["items"], F.lit(True)))
            .when(starts, let(F.slice(s["stack"], F.lit(1), line["level"]), item))
            .otherwise(let(F.element_at(s["items"], -1), longer)))

    none = F.struct(F.array().alias("stack"), F.lit(0).alias("next"), F.array().alias("items"), F.lit(False).alias("blank")).cast(state_type)
    return F.aggregate(F.transform(F.split(block, "\n"), typed), none, step, lambda s: s["items"])


def list_items(documents: DataFrame) -> DataFrame:
    """Every item of every list: ``(path, list_id, item_id, level, ordered, text)``; a list in an item is a list of its own."""
    found = F.flatten(F.transform(_of_kind(rf" {{0,3}}{_MARK}"), lambda b, n: F.transform(_list_items(b), lambda i: F.struct(
        n.alias("block"), i["list"].alias("list"), i["number"].alias("item_id"), i["level"].alias("level"), i["ordered"].alias("ordered"), i["text"].alias("text")))))
    rows = computed(blocks(documents), {"items": found})
    rows = computed(rows, {"lists": F.array_distinct(F.transform("items", lambda i: F.struct(i["block"], i["list"])))})
    numbered = F.transform("items", lambda i: F.struct(
        F.array_position("lists", F.struct(i["block"], i["list"])).cast("int"), i["item_id"], i["level"], i["ordered"], i["text"]))
    return rows.select("path", F.inline(numbered).alias("list_id", "item_id", "level", "ordered", "text"))


def task_items(documents: DataFrame) -> DataFrame:
    """Items of task lists: bullet lists, loose and nested ones too, whose every item starts with a check box."""
    box = F.col("text").rlike(r"\A\[[ xX]\]")
    items = list_items(documents)
    others = items.where(F.col("ordered") | ~box).select("path", "list_id").distinct()
    return items.join(others, ["path", "list_id"], "left_anti").select(
        "path", "list_id", F.col("item_id").alias("task_id"), "level", F.when(F.col("text").startswith("[ ]"), "incomplete").otherwise("complete").alias("status"),
        strip(F.substring("text", F.lit(4), F.length("text"))).alias("body"))


def quotes(documents: DataFrame) -> DataFrame:
    """``(path, pos, text)`` of block quotes; quotes with only blank lines between them are one."""
    found = F.transform(_of_kind(r" {0,3}>"), lambda q: F.regexp_replace(q, r"(?m)^ {0,3}> ?", ""))
    return blocks(documents).select("path", F.posexplode(found).alias("n", "text")).select("path", (F.col("n") + 1).alias("pos"), "text")


def quote_alerts(documents: DataFrame) -> DataFrame:
    """Alerts of both dialects with their panel: class, id and name of the icon, and colour; unknown names are error rows."""
    head = F.substring_index("text", "\n", 1)
    rows = quotes(documents).withColumns({"bracket": head.startswith("[!"), "colon": head.rlike(r"\A(FLAG|NOTE|WARNING|DISCLAIMER):")}).where("bracket OR colon")
    name = F.when(F.col("bracket"), F.nullif(F.regexp_extract(head, r"\A\[!([A-Z]+)\]", 1), F.lit(""))).otherwise(F.regexp_extract(head, r"\A([A-Z]+):", 1))
    body = strip(F.regexp_replace("text", r"\A(?:\[![A-Z]*\]|[A-Z]+:)", ""))
    out = rows.select("path", "pos", F.when(F.col("bracket"), "bracket").otherwise("colon").alias("flavor"), name.alias("name"), body.alias("body"))
    panel = F.when(F.col("flavor") == "bracket", lookup(F.col("name"), L.BRACKET_ALERT_CLASSES)).otherwise(lookup(F.col("name"), L.COLON_ALERT_CLASSES))
    known = panel.isNotNull()
    return out.withColumns({
        "class": panel, "icon_id": F.when(known, lookup(F.lower("name"), L.PANEL_ICON_IDS)), "icon": F.when(known, lookup(F.lower("name"), L.PANEL_ICONS)), "background": F.when(known, lookup(F.lower("name"), L.PANEL_COLORS)),
        "error": F.when(~known, F.lit("unsupported alert"))})


def note_bodies(documents: DataFrame) -> DataFrame:
    """``(path, name, note)`` of footnotes with all their paragraphs; of equal names the last counts."""
    found = F.flatten(F.transform(_of_kind(_NOTE_HEAD), lambda b: F.regexp_extract_all(b, F.lit(rf"(?md){_NOTE}"), F.lit(0))))
    text = F.regexp_replace(F.regexp_replace("m", rf"\A{_NOTE_HEAD}[ \t]*", ""), r"(?m)^(?: {4}|\t)", "")
    rows = blocks(documents).select("path", F.posexplode(found).alias("n", "m")).select("path", "n", F.regexp_extract("m", rf"\A{_NOTE_HEAD}", 1).alias("name"), strip(text).alias("note"))
    return rows.groupBy("path", "name").agg(F.max_by("note", "n").alias("note"))


def pipe_tables(documents: DataFrame) -> DataFrame:
    """Cells of tables with or without outer pipes; pipes behind a backslash or in code do not part cells, rows are as wide as the header."""

    def cells(line: Column) -> Column:
        pieces = F.regexp_extract_all(F.replace(line, F.lit("\\|"), F.lit(_PIPE)), F.lit("`[^`]*`|[^`]+|`"), F.lit(0))
        masked = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("`"), F.replace(p, F.lit("|"), F.lit(_PIPE))).otherwise(p)), "")
        inner = F.regexp_replace(strip(masked), r"\A\||\|\z", "")
        return F.transform(F.split(inner, r"\|"), lambda c: F.replace(strip(c), F.lit(_PIPE), F.lit("|")))

    def fitted(row: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), width - 1), lambda n: F.coalesce(F.get(row, n), F.lit("")))

    parted = F.transform("blocks", lambda b: F.split(b, "\n"))
    ruled = F.filter(parted, lambda x: (F.size(x) > 1) & F.get(x, F.lit(1)).rlike(_RULE) & x[0].contains("|") & (F.size(cells(x[0])) == F.size(cells(F.get(x, F.lit(1))))))
    grids = F.transform(ruled, lambda x: let(cells(x[0]), lambda head: F.transform(
        F.filter(x, lambda line, n: n != 1), lambda line, n: F.struct((n == 0).alias("head"), fitted(cells(line), F.size(head)).alias("cells")))))
    rows = blocks(documents).select("path", F.posexplode(grids).alias("n", "grid"))
    return grid_cells(rows.select("path", (F.col("n") + 1).alias("table_id"), "grid"))
