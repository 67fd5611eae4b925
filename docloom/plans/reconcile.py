"""Plans that bring a published snapshot in line with the source corpus."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.markup import tree_digest
from ..functions.nested import json_coalesce
from ..functions.text import suffix
from ..operators.filters import check_status, pages_with_open_comments
from ..operators.resolve import match_pages
from ..session import salted_join


def duplicate_titles(nodes: DataFrame) -> DataFrame:
    """Documents whose title occurs more than once.

    Titles are counted with map-side aggregation and only the repeated ones
    are joined back, so that a title shared by many documents stays spread out.
    """
    titled = nodes.where("title IS NOT NULL").select("path", "title")
    repeated = titled.groupBy("title").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return salted_join(titled, repeated, ["title"], F.col("path"), "inner").select("path", "title", "copies")


def corpus_counts(nodes: DataFrame) -> DataFrame:
    """Documents per directory, and in all."""
    return nodes.rollup("dir").agg(F.count(F.lit(1)).alias("documents"))


def source_digest(text: Column, options: str) -> Column:
    """MD5 of the options and the source text."""
    return F.md5(F.concat(F.lit(options + "\n"), text))


def title_plan(matched: DataFrame, pages: DataFrame) -> DataFrame:
    """New title of matched pages: kept when the document has none or another page of the space holds it.

    ``matched(path, space_id, title, page_title, ...)`` where ``title`` carries the prefix; its columns are kept.
    """
    taken = pages.select("space_id", F.col("title").alias("_wanted")).distinct().withColumn("_taken", F.lit(True))
    joined = salted_join(matched.withColumn("_wanted", F.nullif("title", F.lit(""))), taken, ["space_id", "_wanted"], F.col("path"))
    changed = F.col("title") != F.col("page_title")
    taken_by_other = changed & F.coalesce("_taken", F.lit(False))
    title = F.when(F.col("_wanted").isNotNull() & ~taken_by_other, F.col("_wanted")).otherwise(F.col("page_title"))
    return joined.withColumns({"new_title": title, "title_taken": taken_by_other}).drop("_wanted", "_taken")


def content_key(content: Column) -> Column:
    """Digest of the element tree, taken where the text is scanned: only the digest is shuffled."""
    return tree_digest(content)


def detect_changes(matched: DataFrame, state: DataFrame) -> DataFrame:
    """First rule that fires: new title, same digest and version, same content, else changed.

    ``matched(page_id, new_title, page_title, version, digest, content_key, page_key, ...)``; its columns are kept.
    """
    tags = state.select("page_id", "page_version", "source_digest")
    joined = salted_join(matched, tags, ["page_id"], F.col("path"), salts=1)
    current = (F.col("source_digest") == F.col("digest")) & (F.col("page_version") == F.col("version"))
    rule = (
        F.when(F.col("new_title") != F.col("page_title"), "title").when(current, "checksum")
        .when(F.col("content_key") == F.col("page_key"), "content").otherwise("changed"))
    return joined.withColumn("rule", rule).withColumn("changed", F.col("rule").isin("title", "changed"))


def conflicts(changes: DataFrame) -> DataFrame:
    """Changed pages that were edited since they were last synchronised."""
    return changes.where("changed AND page_version IS NOT NULL AND version <> page_version")


def sync_plan(docs: DataFrame, pages: DataFrame, state: DataFrame, comments: DataFrame, overwrite: bool = False, check_comments: bool = True) -> DataFrame:
    """One action per document: create, update, unchanged, or skipped for a conflict, comments or an error.

    ``docs(path, page_id, space_id, title, full_title, digest, content, synchronized)``.
    Documents pass once through a chain of lookups; contents are reduced to digests first.
    """
    rows = docs.select(
        "path", "page_id", "space_id", F.coalesce("title", F.lit("")).alias("title"), "full_title", "digest", "synchronized",
        content_key(F.col("content")).alias("content_key"))
    target = pages.select("id", "space_id", "title", "status", "version", content_key(F.col("body")).alias("page_key"))
    matched = check_status(match_pages(rows, target, carry=("page_key",)))
    checked = detect_changes(title_plan(matched, pages), state)
    blocked = pages_with_open_comments(comments).withColumn("open_comments", F.lit(True))
    plan = salted_join(checked, blocked, ["page_id"], F.col("path"), salts=1)
    edited = F.col("page_version").isNotNull() & (F.col("version") != F.col("page_version"))
    action = (
        F.when(F.col("error").isNotNull() | F.col("status_error").isNotNull(), "error")
        .when(F.col("matched_by") == "none", "create")
        .when(~F.col("synchronized"), "index-only")
        .when(~F.col("changed"), "unchanged")
        .when(edited & F.lit(not overwrite), "conflict-skip")
        .when(F.coalesce("open_comments", F.lit(False)) & F.lit(check_comments), "comment-skip")
        .otherwise("update"))
    out = plan.withColumn("action", action)
    compared = ~F.col("action").isin("error", "create", "index-only")
    return out.select(
        "path", "page_id", "action", F.when(compared, F.col("rule")).alias("rule"),
        F.when(F.col("action") == "update", F.col("new_title")).alias("new_title"),
        F.when(F.col("action") == "update", F.col("version") + 1).when(F.col("action") == "create", 1).alias("new_version"),
        F.coalesce("error", "status_error").alias("error"))


# --- labels, properties, attachments -------------------------------------------------------


def label_diff(desired: DataFrame, current: DataFrame, keep_existing: bool = False) -> DataFrame:
    """Labels to add and remove.

    ``desired(page_id, tags)``: a NULL list leaves the page alone, an empty one clears it.
    """
    managed = desired.where("tags IS NOT NULL").select("page_id", F.array_distinct("tags").alias("tags"))
    new = managed.select("page_id", F.explode("tags").alias("name"), F.lit("global").alias("prefix")).withColumn("new", F.lit(True))
    old = current.join(managed.select("page_id"), "page_id", "left_semi").select("page_id", "name", "prefix").distinct().withColumn("old", F.lit(True))
    both = new.join(old, ["page_id", "name", "prefix"], "full_outer")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull() & F.lit(not keep_existing), "remove")
    return both.select("page_id", "name", "prefix", action.alias("action")).where("action IS NOT NULL")


def property_diff(desired: DataFrame, current: DataFrame, keep_existing: bool = False) -> DataFrame:
    """Properties to add, remove or update with the next version.

    A column ``keep`` on both sides, where present, decides per page whether strange properties stay.
    """
    keep = F.col("keep") if "keep" in current.columns else F.lit(keep_existing)
    old = current.select("page_id", "key", F.col("value").alias("old_value"), "version", F.lit(True).alias("old"), keep.alias("keep"))
    new = desired.select("page_id", "key", "value", F.lit(True).alias("new"))
    both = new.join(old, ["page_id", "key"], "full_outer")
    action = (
        F.when(F.col("old").isNull(), "add")
        .when(F.col("new").isNull(), F.when(~F.col("keep"), "remove"))
        .when(~F.col("value").eqNullSafe(F.col("old_value")), "update"))
    version = F.when(F.col("action") == "update", F.col("version") + 1).when(F.col("action") == "add", 1)
    planned = both.withColumn("action", action).where("action IS NOT NULL")
    return planned.select("page_id", "key", "action", F.when(F.col("new"), F.col("value")).alias("value"), version.alias("new_version"))


def merge_global_properties(docs: DataFrame, global_properties: dict) -> DataFrame:
    """Document properties over global ones, dictionaries merged at every level; NULL when there are neither.

    Values that are no texts are JSON texts in ``merged``.
    """
    if not global_properties:
        return docs.withColumn("merged", F.col("properties"))
    merged = json_coalesce(F.coalesce(F.col("properties_json"), F.lit("{}")), F.lit(json.dumps(global_properties)))
    return docs.withColumn("merged", F.from_json(merged, "map<string,string>"))


def property_scope(docs: DataFrame, current: DataFrame, state: DataFrame, tag_key: str) -> DataFrame:
    """Property plan of whole pages, the sync tag included.

    ``docs(page_id, merged, version, digest)``.  With properties, all of them
    are aligned and strange ones removed.  Without, only the tag is written, and
    only when it changed.
    """
    tag = F.to_json(F.struct(F.col("version").alias("page_version"), F.col("digest").alias("source_digest")))
    stored = state.select("page_id", F.col("page_version").alias("_v"), F.col("source_digest").alias("_d"))
    tagged = docs.select("page_id", "merged", tag.alias("tag"), "version", "digest").join(stored, "page_id", "left")
    scoped = F.col("merged").isNull()
    stale = ~(F.col("_v").eqNullSafe(F.col("version")) & F.col("_d").eqNullSafe(F.col("digest")))
    active = tagged.withColumn("keep", scoped).where(~scoped | stale)
    tag_entry = F.create_map(F.lit(tag_key), F.col("tag"))
    desired = active.select("page_id", F.explode(F.when(F.col("keep"), tag_entry).otherwise(F.map_concat(tag_entry, "merged"))).alias("key", "value"))
    managed = current.select("page_id", "key", "value", "version").join(active.select("page_id", "keep"), "page_id")
    return property_diff(desired, managed)


def dedupe_attachments(attachments: DataFrame) -> DataFrame:
    """One attachment per page and name, the last one written.

    ``attachments(page_id, name, seq, checksum, size)``.
    """
    last = F.max_by(F.struct("checksum", "size"), "seq").alias("last")
    return attachments.groupBy("page_id", "name").agg(last).select("page_id", "name", "last.checksum", "last.size")


def attachment_diff(desired: DataFrame, current: DataFrame, by: str = "checksum") -> DataFrame:
    """Attachments to upload, skip or delete, by checksum or, where there is none, by size."""
    old = current.select("page_id", "name", F.col(by).alias("old_mark"), F.lit(True).alias("old"))
    new = desired.select("page_id", "name", F.col(by).alias("new_mark"), F.lit(True).alias("new"))
    both = new.join(old, ["page_id", "name"], "full_outer")
    same = F.coalesce(F.col("old_mark") == F.col("new_mark"), F.lit(False))
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old") & same, "skip").otherwise("upload")
    return both.select("page_id", "name", action.alias("action"))


def media_type(name: Column) -> Column:
    return F.coalesce(L.lookup(suffix(name), L.MEDIA_TYPES), F.lit(L.DEFAULT_MEDIA_TYPE))
