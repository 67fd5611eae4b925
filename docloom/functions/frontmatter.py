"""Front-matter blocks as nested dictionaries.

A block is a JSON object, or lines of the part of YAML that documents use: nested mappings and lists
by indentation, quoted keys and values, comments, lists and mappings in brackets on
one line, literal and folded blocks, plain values that go on in the next line.  The
lines are folded once with a stack of the containers that are open.  Anything else
(anchors, tags, tabs as indentation, brackets over several lines ...) is an error that
names the line; nothing of such a block is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import let
from .text import strip

ENTRIES = "array<struct<key:string,value:string,kind:string>>"
_STACK = "array<struct<indent:int,kind:string,path:string,count:int>>"
_LINES = "array<struct<indent:int,kind:string,key:string,value:string,raw:string>>"

_DOUBLE = r'"(?:[^"\\]|\\.)*+"'
_SINGLE = r"'(?:[^']|'')*+'"
_COMMENT = r"(?:[ \t]+#.*)?"
_KEY = rf"\A({_DOUBLE}|{_SINGLE}|[^\s\"'\[\]{{}}#&*!|<>%@`,?:-][^:\"'#]*?)[ \t]*:(?:[ \t]+(.*))?\z"
_FLOW_ITEM = rf"\s*({_DOUBLE}|{_SINGLE}|[^,\[\]{{}}\"'\s][^,\[\]{{}}]*)\s*(?:,|\z)"
_FLOW_FIELD = rf"\s*((?:{_DOUBLE}|{_SINGLE}|[^,\[\]{{}}:\"'\s][^,\[\]{{}}:\"']*)\s*:(?:\s+(?:{_DOUBLE}|{_SINGLE}|[^,\[\]{{}}\"'\s][^,\[\]{{}}]*)?)?)\s*(?:,|\z)"
_FLOW_PAIR = rf"\A({_DOUBLE}|{_SINGLE}|[^:\"']+?)\s*:\s*(.*)\z"
_BLOCK = rf"\A[|>][+-]?[1-9]?[+-]?{_COMMENT}[ \t]*\z"
#: Plain words that are no text.
_NULLS = ("", "~", "null", "Null", "NULL")
TRUE_WORDS = ("true", "yes", "on")
FALSE_WORDS = ("false", "no", "off")


def json_text(value: Column) -> Column:
    """A string as a JSON literal."""
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _unquoted(text: Column) -> Column:
    """The value of a quoted or plain word."""
    single = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("''"), F.lit("'"))
    double = F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(text.startswith('"'), double).when(text.startswith("'"), single).otherwise(text)


def _scalar(text: Column) -> Column:
    """``(value, kind)`` of a word: kind is plain, quoted, null, or bad if it is not understood."""
    quoted = text.rlike(rf"\A(?:{_DOUBLE}|{_SINGLE})\z")
    plain = ~text.rlike(r"\A[\"'\[\]{}&*!|>%@`,]|:(?:[ \t]|\z)")
    kind = F.when(text.isin(*_NULLS), "null").when(quoted, "quoted").when(plain, "plain").otherwise("bad")
    return F.struct(F.when(~text.isin(*_NULLS), _unquoted(text)).alias("value"), F.when(quoted & _unquoted(text).isNull(), "bad").otherwise(kind).alias("kind"))


def _uncommented(text: Column) -> Column:
    """A value without the comment behind it."""
    quoted = F.regexp_extract(text, rf"\A({_DOUBLE}|{_SINGLE}){_COMMENT}[ \t]*\z", 1)
    plain = F.regexp_replace(F.regexp_replace(text, r"\A#.*|[ \t]+#.*\z", ""), r"[ \t]+\z", "")
    return F.when(quoted != "", quoted).otherwise(plain)


def _json_of(value: Column, kind: Column) -> Column:
    """A scalar as JSON: plain words may be truth values and numbers."""
    word = F.lower(value)
    number = value.rlike(r"\A-?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]+)?\z")
    typed = F.when(word.isin(*TRUE_WORDS), "true").when(word.isin(*FALSE_WORDS), "false").when(number, value).otherwise(json_text(value))
    return F.when(kind == "null", "null").when(kind == "plain", typed).otherwise(json_text(value))


def _inline(path: Column, text: Column) -> Column:
    """``(entries, json)`` of a value on one line; ``entries`` is null where it is not understood."""
    inner = strip(F.substring(text, F.lit(2), F.length(text) - 2))
    words = F.transform(F.regexp_extract_all(inner, F.lit(_FLOW_ITEM), F.lit(1)), strip)
    fields = F.transform(F.regexp_extract_all(inner, F.lit(_FLOW_FIELD), F.lit(1)), strip)
    items = F.transform(words, lambda w: _scalar(w))
    pairs = F.transform(fields, lambda w: let(_scalar(strip(F.regexp_extract(w, _FLOW_PAIR, 2))), lambda s: F.struct(
        _unquoted(F.regexp_extract(w, _FLOW_PAIR, 1)).alias("key"), s["value"].alias("value"), F.when(w.rlike(_FLOW_PAIR), s["kind"]).otherwise("bad").alias("kind"))))

    def entry(key: Column, value: Column, kind: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"), kind.alias("kind"))

    def made(entries: Column, json: Column) -> Column:
        return F.struct(entries.cast(ENTRIES).alias("entries"), json.alias("json"))

    none = F.lit(None)
    bad = made(none, none.cast("string"))
    flow_list = let(items, lambda x: F.when(~inner.rlike(rf"\A(?:{_FLOW_ITEM})*+\z") | F.exists(x, lambda s: s["kind"] == "bad"), bad).when(
        F.size(x) == 0, made(F.array(entry(path, none.cast("string"), F.lit("empty list"))), F.lit("[]"))).otherwise(made(
            F.transform(x, lambda s: entry(path, s["value"], F.concat(F.lit("item "), s["kind"]))),
            F.concat(F.lit("["), F.array_join(F.transform(x, lambda s: _json_of(s["value"], s["kind"])), ","), F.lit("]")))))
    flow_map = let(pairs, lambda x: F.when(~inner.rlike(rf"\A(?:{_FLOW_FIELD})*+\z") | F.exists(x, lambda s: s["kind"] == "bad"), bad).when(
        F.size(x) == 0, made(F.array(entry(path, none.cast("string"), F.lit("empty dictionary"))), F.lit("{}"))).otherwise(made(
            F.transform(x, lambda s: entry(F.concat(path, F.lit("."), s["key"]), s["value"], s["kind"])),
            F.concat(F.lit("{"), F.array_join(F.transform(x, lambda s: F.concat(json_text(s["key"]), F.lit(":"), _json_of(s["value"], s["kind"]))), ","), F.lit("}")))))
    word = let(_scalar(text), lambda s: F.when(s["kind"] == "bad", bad).otherwise(made(F.array(entry(path, s["value"], s["kind"])), _json_of(s["value"], s["kind"]))))
    return F.when(text.rlike(r"\A\[.*\]\z"), flow_list).when(text.rlike(r"\A\{.*\}\z"), flow_map).otherwise(word)


def _lines(block: Column) -> Column:
    """Lines as ``(indent, kind, key, value, raw)``; an item that starts a mapping is two of them."""

    def line(indent: Column, kind: Column, key: Column, value: Column, raw: Column) -> Column:
        return F.struct(indent.cast("int").alias("indent"), kind.alias("kind"), key.alias("key"), value.alias("value"), raw.alias("raw"))

    def keyed(indent: Column, body: Column, raw: Column) -> Column:
        return line(indent, F.lit("key"), _unquoted(F.regexp_extract(body, _KEY, 1)), _uncommented(F.regexp_extract(body, _KEY, 2)), raw)

    def typed(raw: Column) -> Column:
        indent = F.length(F.regexp_extract(raw, r"\A( *)", 1))
        body = F.substring(raw, indent + 1, F.length(raw))
        content = F.regexp_extract(body, r"\A-[ \t]*(.*)\z", 1)
        none = F.lit(None).cast("string")
        offset = indent + F.length(body) - F.length(content)
        item = F.when(content.rlike(r"\A(?:#.*)?\z"), F.array(line(indent, F.lit("dash"), none, none, raw))).when(
            content.rlike(_KEY), F.array(line(indent, F.lit("dash"), none, none, raw), keyed(offset, content, raw))).when(
            content.rlike(r"\A-(?:[ \t]|\z)"), F.array(line(indent, F.lit("bad"), none, none, raw))).otherwise(
            F.array(line(indent, F.lit("item"), none, _uncommented(content), raw)))
        return (
            F.when(body.rlike(r"\A[ \t]*(?:#.*)?\z"), F.array(line(indent, F.lit("blank"), none, none, raw)))
            .when(body.rlike(r"\A\t"), F.array(line(indent, F.lit("bad"), none, none, raw)))
            .when(body.rlike(r"\A-(?:[ \t]|\z)"), item)
            .when(body.rlike(_KEY), F.array(keyed(indent, body, raw)))
            .otherwise(F.array(line(indent, F.lit("text"), none, _uncommented(body), raw))))

    return F.flatten(F.transform(F.split(F.regexp_replace(block, r"\n\z", ""), "\n"), typed)).cast(_LINES)


def _block_text(held: Column) -> Column:
    """The value of a literal or folded block."""
    lines, style = held["lines"], held["style"]
    filled = F.filter(lines, lambda x: x.rlike(r"\S"))
    explicit = F.regexp_extract(style, r"([1-9])", 1).try_cast("int")
    margin = F.coalesce(held["indent"] + explicit, F.length(F.regexp_extract(F.get(filled, F.lit(0)), r"\A( *)", 1)), F.lit(0))

    def cut(width: Column) -> Column:
        joined = F.concat(F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"\S"), F.substring(x, width + 1, F.length(x))).otherwise("")), "\n"), F.lit("\n"))
        body = F.regexp_replace(joined, r"\n*\z", "")
        ending = F.regexp_extract(joined, r"(\n*)\z", 1)
        folded = F.regexp_replace(F.regexp_replace(body, r"(?<!\n)\n(?![\n ])", " "), r"\n(\n+)", "$1")
        text = F.when(style.startswith(">"), folded).otherwise(body)
        return F.when(style.contains("-"), text).when(style.contains("+"), F.concat(text, ending)).otherwise(F.when(body != "", F.concat(text, F.lit("\n"))).otherwise(""))

    return let(margin, cut)


def _fold(lines: Column) -> Column:
    """``(entries, json, error)`` of the lines of a block."""
    held_type = "struct<style:string,indent:int,path:string,kind:string,lines:array<string>>"
    none = F.lit(None)

    def state(stack, entries, json, held, error) -> Column:
        return F.struct(stack.cast(_STACK).alias("stack"), entries.cast(ENTRIES).alias("entries"), json.cast("array<string>").alias("json"), held.cast(held_type).alias("held"), error.cast("string").alias("error"))

    def container(indent: Column, kind: str | Column, path: Column, count: Column) -> Column:
        return F.struct(indent.cast("int").alias("indent"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), path.alias("path"), count.cast("int").alias("count"))

    def failed(s: Column, line: Column) -> Column:
        return state(s["stack"], s["entries"], s["json"], none, F.concat(F.lit("not understood: "), strip(line["raw"])))

    def released(s: Column) -> Column:
        """A block that was collected becomes a value."""
        def done(text: Column) -> Column:
            entry = F.struct(s["held"]["path"].alias("key"), text.alias("value"), s["held"]["kind"].alias("kind"))
            return state(s["stack"], F.array_append(s["entries"], entry), F.array_append(s["json"], json_text(text)), none, s["error"])

        return F.when(s["held"].isNull(), s).otherwise(let(_block_text(s["held"]), done))

    def closers(closed: Column) -> Column:
        return F.transform(F.reverse(closed), lambda e: F.when(e["kind"] == "map", "}").when(e["kind"] == "list", "]").otherwise("null"))

    def closed(s: Column, stays) -> Column:
        """Containers that do not go on are closed, keys without a value are null."""
        kept, gone = F.filter(s["stack"], stays), F.filter(s["stack"], lambda e: ~stays(e))
        empty = F.transform(F.filter(gone, lambda e: e["kind"].isin("open", "dash")), lambda e: F.struct(e["path"].alias("key"), none.cast("string").alias("value"), F.lit("null").alias("kind")))
        return state(kept, F.concat(s["entries"], empty.cast(ENTRIES)), F.concat(s["json"], closers(gone)), none, s["error"])

    def valued(s: Column, line: Column, stack: Column, opening: Column, path: Column, item: bool) -> Column:
        """Put a line's value behind what opens it."""
        text = line["value"]
        kind = F.lit("item quoted" if item else "quoted")
        block = F.struct(F.regexp_replace(text, r"[ \t#].*\z", "").alias("style"), line["indent"].alias("indent"), path.alias("path"), kind.alias("kind"), F.array().cast("array<string>").alias("lines"))
        later = state(stack, s["entries"], F.array_append(s["json"], opening), block, none)

        def now(v: Column) -> Column:
            entries = F.transform(v["entries"], lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.concat(F.lit("item "), e["kind"]).alias("kind"))) if item else v["entries"]
            return F.when(v["entries"].isNull(), failed(s, line)).otherwise(state(
                stack, F.concat(s["entries"], entries.cast(ENTRIES)), F.concat(s["json"], F.array(opening, v["json"])), none, none))

        return F.when(text.rlike(_BLOCK), later).otherwise(let(_inline(path, text), now))

    def replaced(stack: Column, top: Column) -> Column:
        return F.array_append(F.slice(stack, F.lit(1), F.size(stack) - 1), top)

    def key_line(s: Column, line: Column) -> Column:
        def inside(top: Column) -> Column:
            child = (top["kind"].isin("open", "dash")) & (line["indent"] > top["indent"])
            same = (top["kind"] == "map") & (top["indent"] == line["indent"])
            count = F.when(same, top["count"]).otherwise(0)
            path = F.when(top["path"] == "", line["key"]).otherwise(F.concat(top["path"], F.lit("."), line["key"]))
            stack = replaced(s["stack"], container(line["indent"], "map", top["path"], count + 1))
            opening = F.concat(F.when(child, "{").when(count > 0, ",").otherwise(""), json_text(line["key"]), F.lit(":"))
            pending = state(F.array_append(stack, container(line["indent"], "open", path, F.lit(0))), s["entries"], F.array_append(s["json"], opening), none, none)
            return F.when(~(child | same) | line["key"].isNull(), failed(s, line)).when(line["value"] == "", pending).otherwise(valued(s, line, stack, opening, path, False))

        return let(F.element_at(s["stack"], -1), inside)

    def item_line(s: Column, line: Column) -> Column:
        def inside(top: Column) -> Column:
            first = ((top["kind"] == "open") & (line["indent"] >= top["indent"])) | ((top["kind"] == "dash") & (line["indent"] > top["indent"]))
            next_ = (top["kind"] == "list") & (top["indent"] == line["indent"])
            count = F.when(next_, top["count"]).otherwise(0)
            stack = replaced(s["stack"], container(line["indent"], "list", top["path"], count + 1))
            opening = F.when(first, "[").when(count > 0, ",").otherwise("")
            path = F.concat(top["path"], F.lit("."), count.cast("string"))
            pending = state(F.array_append(stack, container(line["indent"], "dash", path, F.lit(0))), s["entries"], F.array_append(s["json"], opening), none, none)
            return F.when(~(first | next_), failed(s, line)).when(line["kind"] == "dash", pending).otherwise(valued(s, line, stack, opening, top["path"], True))

        return let(F.element_at(s["stack"], -1), inside)

    def more_text(s: Column, line: Column) -> Column:
        """A plain value that goes on."""
        def longer(last: Column) -> Column:
            text = F.concat_ws(" ", last["value"], line["value"])
            entries = F.array_append(F.slice(s["entries"], F.lit(1), F.size(s["entries"]) - 1), F.struct(last["key"].alias("key"), text.alias("value"), last["kind"].alias("kind")))
            json = F.array_append(F.slice(s["json"], F.lit(1), F.size(s["json"]) - 1), json_text(text))
            fits = last["kind"].endswith("plain") & (line["indent"] > F.element_at(s["stack"], -1)["indent"]) & F.element_at(s["stack"], -1)["kind"].isin("map", "list")
            return F.when(F.coalesce(fits, F.lit(False)), state(s["stack"], entries, json, none, none)).otherwise(failed(s, line))

        return let(F.try_element_at(s["entries"], F.lit(-1)), longer)

    def step(s: Column, line: Column) -> Column:
        blank = line["kind"] == "blank"
        dash = line["kind"].isin("dash", "item")
        collects = s["held"].isNotNull() & (~line["raw"].rlike(r"\S") | (F.length(F.regexp_extract(line["raw"], r"\A( *)", 1)) > s["held"]["indent"]))
        held = s["held"]
        longer = F.struct(held["style"].alias("style"), held["indent"].alias("indent"), held["path"].alias("path"), held["kind"].alias("kind"), F.array_append(held["lines"], line["raw"]).alias("lines"))

        def stays(e: Column) -> Column:
            below = e["indent"] < line["indent"]
            at = e["indent"] == line["indent"]
            return below | (at & F.when(e["kind"] == "map", True).when(e["kind"].isin("list", "open"), dash).otherwise(False))

        structural = let(closed(released(s), stays), lambda c: F.when(line["kind"] == "key", key_line(c, line)).when(dash, item_line(c, line)).otherwise(failed(c, line)))
        return (
            F.when(s["error"].isNotNull(), s)
            .when(collects, state(s["stack"], s["entries"], s["json"], longer, none))
            .when(blank, released(s))
            .when(line["kind"] == "text", let(released(s), lambda c: more_text(c, line)))
            .otherwise(structural))

    def finish(s: Column) -> Column:
        end = let(closed(released(s), lambda e: F.lit(False)), lambda c: F.struct(
            c["entries"].alias("entries"), F.concat(F.lit("{"), F.array_join(c["json"], "")).alias("json"), none.cast("string").alias("error")))
        bad = F.struct(F.array().cast(ENTRIES).alias("entries"), none.cast("string").alias("json"), s["error"].alias("error"))
        return F.when(s["error"].isNotNull(), bad).otherwise(end)

    first = F.get(F.filter(lines, lambda x: x["kind"] != "blank"), F.lit(0))
    root = F.array(container(F.coalesce(first["indent"], F.lit(0)), "map", F.lit(""), F.lit(0)))
    return F.aggregate(lines, state(root, F.array(), F.array(), none, none), step, finish)


def json_entries(block: Column) -> Column:
    """Values of a JSON object of any depth: ``(key, value, kind)`` with dotted keys; list items repeat their key."""
    slot = "struct<key:string,value:variant,item:boolean>"

    def kind_of(v: Column) -> Column:
        return F.schema_of_variant(v)

    def opened(x: Column) -> Column:
        fields = F.try_variant_get(x["value"], "$", "map<string,variant>")
        items = F.try_variant_get(x["value"], "$", "array<variant>")
        inside = lambda key: F.when(x["key"] == "", key).otherwise(F.concat(x["key"], F.lit("."), key))
        of_map = F.transform(F.map_entries(fields), lambda e: F.struct(inside(e["key"]).alias("key"), e["value"].alias("value"), F.lit(False).alias("item")))
        of_list = F.transform(items, lambda v, i: F.struct(F.when(kind_of(v).rlike(r"\A(?:OBJECT|ARRAY)"), F.concat(x["key"], F.lit("."), i.cast("string"))).otherwise(x["key"]).alias("key"), v.alias("value"), F.lit(True).alias("item")))
        shape = kind_of(x["value"])
        return (
            F.when(shape.startswith("OBJECT<") & (F.size(fields) > 0), of_map.cast(f"array<{slot}>"))
            .when(shape.startswith("ARRAY<") & (F.size(items) > 0), of_list.cast(f"array<{slot}>"))
            .otherwise(F.array(x)))

    def leaf(x: Column) -> Column:
        shape = kind_of(x["value"])
        text = F.when(shape.rlike(r"\A(?:OBJECT|ARRAY)"), None).otherwise(F.try_variant_get(x["value"], "$", "string"))
        kind = F.when(shape.startswith("OBJECT"), "empty dictionary").when(shape.startswith("ARRAY"), "empty list").when(F.is_variant_null(x["value"]), "null").when(shape == "STRING", "quoted").otherwise("plain")
        return F.struct(x["key"].alias("key"), text.alias("value"), F.when(x["item"], F.concat(F.lit("item "), kind)).otherwise(kind).alias("kind"))

    start = F.array(F.struct(F.lit("").alias("key"), F.try_parse_json(block).alias("value"), F.lit(False).alias("item")).cast(slot))
    levels = F.sequence(F.lit(0), F.coalesce(F.regexp_count(block, F.lit(r"[\[{]")), F.lit(0)))
    leaves = F.aggregate(levels, start, lambda slots, _: F.flatten(F.transform(slots, opened)))
    return F.transform(leaves, leaf).cast(ENTRIES)


def front_tree(block: Column) -> Column:
    """``(entries, json, error)`` of a block, which may be null.

    ``entries`` are the values in order as ``(key, value, kind)`` with dotted keys, and list items
    repeat their key; ``json`` is the whole dictionary with plain words typed.
    """
    json = F.try_parse_json(block)
    of_json = F.struct(F.when(json.isNull(), F.array().cast(ENTRIES)).otherwise(json_entries(block)).alias("entries"), F.to_json(json).alias("json"), F.when(json.isNull(), "not understood: malformed JSON").alias("error"))
    return F.when(strip(block).startswith("{"), of_json).when(block.isNotNull(), let(_lines(block), _fold))
