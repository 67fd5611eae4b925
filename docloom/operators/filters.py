"""Which entries take part: hidden files, extensions, ignore rules, states and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import OPEN_COMMENT_STATES, SPACE, WRITABLE_PAGE_STATES
from ..functions.markup import let
from ..functions.text import ancestor_dirs
from ..session import computed, salted_join

SKIP_START = rf"<!--[{SPACE}]*skip-start[{SPACE}]*-->"
SKIP_END = rf"<!--[{SPACE}]*skip-end[{SPACE}]*-->"


SEGMENT = "struct<kind:string,text:string>"
_RULE = f"struct<line:int,negated:boolean,dir_only:boolean,segments:array<{SEGMENT}>,k:int>"
_VERDICT = "struct<line:int,negated:boolean>"
_SPECIAL = r"([\\.+*?^$(){}|\[\]])"


def filter_hidden(entries: DataFrame) -> DataFrame:
    """Drop entries whose name, or the name of a directory above, starts with a dot."""
    return entries.where(~F.col("path").rlike(r"(\A|/)\."))


def filter_extension(entries: DataFrame, extension: str | None) -> DataFrame:
    """Keep directories and files with the extension, given with or without its dot."""
    if extension is None:
        return entries
    wanted = F.col("name").endswith("." + extension.removeprefix("."))
    return entries.where(wanted | F.col("is_dir") if "is_dir" in entries.columns else wanted)


def _segment_regex(segment: Column) -> Column:
    """A name pattern as a regular expression; a lone star matches no empty name."""
    def token(t: Column) -> Column:
        literal = F.regexp_replace(F.regexp_replace(t, r"\A\\(.)\z", "$1"), _SPECIAL, r"\\$1")
        return (
            F.when(t.startswith("*"), F.when(segment.rlike(r"\A\*+\z"), "[^/]+").otherwise("[^/]*")).when(t == "?", "[^/]")
            .when(t.rlike(r"\A\[.+\]\z"), F.regexp_replace(F.regexp_replace(t, r"\A\[!", "[^"), r"\\", r"\\\\")).otherwise(literal))

    return F.array_join(F.transform(F.regexp_extract_all(segment, F.lit(r"\\.|\[!?\]?[^\]]*\]|\*+|\?|[^\\*?\[]+|."), F.lit(0)), token), "")


def _segment(segment: Column) -> Column:
    """What a name has to be: any name at any depth (deep), any, a literal, a literal start or end, or a regular expression."""
    plain = r"[^\\*?\[]"
    kind = (
        F.when(segment == "**", "deep").when(segment.rlike(r"\A\*+\z"), "any").when(segment.rlike(rf"\A{plain}+\z"), "literal")
        .when(segment.rlike(rf"\A\*+{plain}+\z"), "end").when(segment.rlike(rf"\A{plain}+\*+\z"), "start").otherwise("regex"))
    bare = F.regexp_replace(segment, r"\*", "")
    return F.struct(kind.alias("kind"), F.when(kind.isin("literal", "end", "start"), bare).when(kind == "regex", F.concat(F.lit(r"\A(?:"), _segment_regex(segment), F.lit(r")\z"))).alias("text"))


def _fits(segment: Column, name: Column) -> Column:
    kind, text = segment["kind"], segment["text"]
    return (
        F.when(kind == "literal", name == text).when(kind == "end", name.endswith(text)).when(kind == "start", name.startswith(text))
        .when(kind == "regex", F.regexp_like(name, text)).otherwise(True))


def parsed_rules(rules: DataFrame) -> DataFrame:
    """Ignore-rule lines as ``(base_dir, line_no, negated, dir_only, parts)``; a rule for any depth starts with ``**``."""
    line = F.regexp_replace("pattern", r"(?<!\\) +\z", "")
    kept = rules.withColumn("p", line).where((F.col("p") != "") & ~F.col("p").startswith("#"))
    kept = kept.withColumn("negated", F.col("p").startswith("!"))
    kept = kept.withColumn("p", F.regexp_replace(F.regexp_replace("p", r"\A!", ""), r"\A\\([#!])", "$1"))
    kept = kept.withColumn("dir_only", F.col("p").endswith("/"))
    kept = kept.withColumn("p", F.regexp_replace("p", r"/\z", "")).where(F.col("p") != "")
    anywhere = ~F.col("p").contains("/") & (F.col("p") != "**")
    parts = F.split(F.regexp_replace(F.regexp_replace("p", r"\A/", ""), r"(?:(?<=/)|\A)(?:\*\*/)+", "**/"), "/")
    return kept.select("base_dir", "line_no", "negated", "dir_only", F.when(anywhere, F.concat(F.array(F.lit("**")), parts)).otherwise(parts).alias("parts"))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Ignore-rule lines as ``(base_dir, line_no, negated, dir_only, regex)``.

    Patterns with an inner or leading slash are anchored to their directory,
    bare ones match at any depth; a match covers everything below it.
    """
    last = F.size("parts") - 1

    def piece(part: Column, i: Column) -> Column:
        return F.when((part == "**") & (i == last), ".*").when(part == "**", "(?:.+/)?").otherwise(F.concat(_segment_regex(part), F.when(i < last, "/").otherwise("")))

    end = F.when(F.col("dir_only"), F.lit("/.*$")).otherwise(F.lit("(?:/.*)?$"))
    body = F.array_join(F.transform("parts", piece), "")
    return parsed_rules(rules).select("base_dir", "line_no", "negated", "dir_only", F.concat(F.lit("^"), body, end).alias("regex"))


def directory_verdicts(directories: DataFrame, rules: DataFrame) -> DataFrame:
    """What rule lists say about each of the distinct directories ``dir``: ``(dir, excluded, lists)``.

    A directory meets the lists of the directories above it.  Walking down from a list, the
    rules that fit the names so far are carried along, so that each name is compared with the segments that come next.
    ``lists`` holds, per list, the last line that covers the directory (``cover``) and
    the segments that a name in it may complete (``last``).
    """
    segments = F.transform("parts", _segment)
    rule = F.struct(F.col("line_no").cast("int").alias("line"), "negated", "dir_only", segments.alias("segments"), F.lit(0).alias("k")).cast(_RULE)
    lists = parsed_rules(rules).groupBy("base_dir").agg(F.collect_list(rule).alias("rules"))
    exploded = directories.select("dir", F.explode(ancestor_dirs(F.col("dir"))).alias("base_dir"))
    met = salted_join(exploded, lists, ["base_dir"], F.col("dir"), "inner")
    below = F.when(F.col("base_dir") == "", F.col("dir")).otherwise(F.substring("dir", F.length("base_dir") + 2, F.length("dir")))
    names = F.when(below == "", F.array().cast("array<string>")).otherwise(F.split(below, "/"))

    def at(r: Column) -> Column:
        return F.get(r["segments"], r["k"])

    def advanced(r: Column) -> Column:
        return F.struct(r["line"].alias("line"), r["negated"].alias("negated"), r["dir_only"].alias("dir_only"), r["segments"].alias("segments"), (r["k"] + 1).cast("int").alias("k"))

    def is_last(r: Column) -> Column:
        return r["k"] == F.size(r["segments"]) - 1

    def skipping(rules_: Column) -> Column:
        """``**`` may stand for no name."""
        return F.flatten(F.transform(rules_, lambda r: F.when((at(r)["kind"] == "deep") & ~is_last(r), F.array(r, advanced(r))).otherwise(F.array(r))))

    def down(state: Column, name: Column) -> Column:
        none = F.array().cast(f"array<{_RULE}>")
        moved = F.flatten(F.transform(state["rules"], lambda r: F.when((at(r)["kind"] == "deep") & ~is_last(r), F.array(r)).when(_fits(at(r), name), F.array(advanced(r))).otherwise(none)))

        def walked(moved: Column) -> Column:
            full = F.filter(moved, lambda r: (r["k"] == F.size(r["segments"])) | (is_last(r) & (at(r)["kind"] == "deep")))
            found = F.transform(full, lambda r: F.struct(r["line"].alias("line"), r["negated"].alias("negated")))
            cover = F.array_max(F.concat(found, F.array(state["cover"]).cast(f"array<{_VERDICT}>")))
            return F.struct(
                skipping(F.filter(moved, lambda r: r["k"] < F.size(r["segments"]))).cast(f"array<{_RULE}>").alias("rules"), cover.cast(_VERDICT).alias("cover"),
                (state["excluded"] | F.coalesce(~cover["negated"], F.lit(False))).alias("excluded"))

        return let(moved, walked)

    start = F.struct(skipping(F.col("rules")).cast(f"array<{_RULE}>").alias("rules"), F.lit(None).cast(_VERDICT).alias("cover"), F.lit(False).alias("excluded"))
    walked = computed(met.select("dir", names.alias("_names"), "rules"), {"_end": F.aggregate("_names", start, down)})
    last = F.transform(
        F.filter("_end.rules", lambda r: is_last(r) & ~r["dir_only"]),
        lambda r: F.struct(r["line"].alias("line"), r["negated"].alias("negated"), at(r).alias("segment")))
    return walked.groupBy("dir").agg(
        F.bool_or("_end.excluded").alias("excluded"), F.collect_list(F.struct(F.col("_end.cover").alias("cover"), last.alias("last"))).alias("lists"))


def judged(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries with a flag ``ignored``: some rule list excludes them, directly or through a directory above.

    Rules are decided for distinct directories; an entry joins the verdict on
    its directory, and its name meets the segments that are left.  Within a list the last matching line decides.
    """
    is_dir = F.col("is_dir") if "is_dir" in entries.columns else F.lit(False)
    placed = entries.withColumn("_dir", F.when(is_dir, F.col("path")).otherwise(F.col("dir")))
    verdicts = directory_verdicts(placed.select(F.col("_dir").alias("dir")).distinct(), rules)
    verdicts = verdicts.select(F.col("dir").alias("_dir"), F.col("excluded").alias("_excluded"), F.col("lists").alias("_lists"))

    def excludes(x: Column) -> Column:
        fitting = F.transform(F.filter(x["last"], lambda r: _fits(r["segment"], F.col("name"))), lambda r: F.struct(r["line"].alias("line"), r["negated"].alias("negated")))
        return F.coalesce(~F.array_max(F.concat(fitting, F.array(x["cover"])))["negated"], F.lit(False))

    joined = salted_join(placed, verdicts, ["_dir"], F.col("path"))
    ignored = F.coalesce("_excluded", F.lit(False)) | (~is_dir & F.coalesce(F.exists("_lists", excludes), F.lit(False)))
    return joined.withColumn("ignored", ignored).drop("_dir", "_excluded", "_lists")


def ignored_entries(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths of the entries that some rule list excludes."""
    return judged(entries, rules).where("ignored").select("path").distinct()


def filter_ignored(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries that no rule list excludes."""
    return judged(entries, rules).where("NOT ignored").select(*entries.columns)


def filter_synchronized(props: DataFrame) -> DataFrame:
    return props.where(F.coalesce("synchronized", F.lit(True)))


def check_status(matched: DataFrame) -> DataFrame:
    """Pages matched by title must be writable; explicit ids are not checked."""
    bad = (F.col("matched_by") == "title") & ~F.col("status").isin(*WRITABLE_PAGE_STATES)
    return matched.withColumn("status_error", F.when(bad, F.concat(F.lit("unable to update page with status "), F.col("status"))))


def pages_with_open_comments(comments: DataFrame) -> DataFrame:
    return comments.where(F.col("resolution_status").isin(*OPEN_COMMENT_STATES)).select("page_id").distinct()


def block_open_comments(plan: DataFrame, comments: DataFrame) -> DataFrame:
    """Pages of the plan that open inline comments keep from being updated."""
    return plan.join(pages_with_open_comments(comments), "page_id", "left_semi")


def within_root(resolved: DataFrame, root: str, column: str = "resolved") -> DataFrame:
    """Flag resolved paths inside the root directory."""
    inside = ~F.col(column).rlike(r"\A\.\.(/|\z)") if root == "" else (F.col(column) == root) | F.col(column).startswith(root + "/")
    return resolved.withColumn("inside", inside)


def strip_skipped(documents: DataFrame, column: str = "body") -> DataFrame:
    """Remove marked sections; a document with unequal marker counts is reported and left as it is."""
    starts = F.regexp_count(column, F.lit(SKIP_START))
    ends = F.regexp_count(column, F.lit(SKIP_END))
    kept = F.regexp_replace(column, rf"(?s){SKIP_START}.*?{SKIP_END}", "")
    return documents.withColumns({"ok": starts == ends, "kept": F.when(starts == ends, kept).otherwise(F.col(column))})
