"""Where documents go in the published page tree, and what is to be done with each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import check_status, pages_with_open_comments
from ..operators.resolve import single_titles
from ..session import durable, salted_join
from .hierarchy import inherited, traceable
from .reconcile import content_key, detect_changes, title_plan

NOT_TRACEABLE = "not below the root page or a page with an explicit id"


def place_pages(docs: DataFrame, pages: DataFrame, root_id: str, root_space: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Match documents with pages along the document tree; the documents' columns are kept.

    ``docs(path, parent, page_id, full_title, ...)`` with the document above in ``parent``;
    ``pages(id, parent_id, space_id, title, status, version, ...)``; ``carry`` names further page columns to bring along.

    A document with an explicit page id has that page.  Any other is looked up by its title in the space of
    its parent page, which is the space of the nearest document above with an explicit page, or else of the root page; if there is no
    page of that title, or several, a new one is to be made below the parent page.  A page found by title must trace back to the root page
    or a page with an explicit id, wherever in the tree that document is: a stranger of equal title is an error.
    ``parent_id`` is null where the parent page is still to be made.  Columns of both inputs should be narrow: digests, no texts.
    """
    fields = ["space_id", "status", "page_title", "version", *carry]
    # both sides are read several times: their narrow rows are computed once
    pages = durable(pages.select("id", "parent_id", "space_id", "title", "status", "version", *carry))
    target = pages.withColumn("page_title", F.col("title"))
    by_id = target.select(F.col("id").alias("page_id"), F.struct(*fields).alias("_by_id"))
    others = [c for c in docs.columns if c not in ("page_id", "space_id")]
    named = durable(salted_join(docs.select(*others, "page_id"), by_id, ["page_id"], F.col("path"), salts=1))
    spaces = inherited(named.select("path", "parent", F.col("_by_id.space_id").alias("_space")), "_space", "_space")
    rows = named.join(spaces, "path").withColumn("space_id", F.coalesce("_space", F.lit(root_space)))
    rows = rows.withColumn("_title", F.when(F.col("page_id").isNull(), F.col("full_title")))
    by_title = single_titles(target.select("space_id", "title", "id", F.struct(*fields).alias("_by_title")))
    by_title = by_title.withColumnRenamed("full_title", "_title").withColumnRenamed("id", "_id")
    rows = salted_join(rows, by_title, ["space_id", "_title"], F.col("path"))
    explicit = F.col("page_id").isNotNull()
    rows = rows.select(
        *others, "space_id", F.coalesce("page_id", "_id").alias("page_id"),
        *[F.coalesce(F.col(f"_by_id.{f}"), F.col(f"_by_title.{f}")).alias(f) for f in fields if f != "space_id"],
        F.when(explicit, "id").when(F.col("_id").isNotNull(), "title").otherwise("none").alias("matched_by"),
        F.when(explicit & F.col("_by_id").isNull(), "no such page").alias("missing"))
    rows = durable(rows)
    above = rows.where("missing IS NULL").select(F.col("path").alias("parent"), F.col("page_id").alias("_parent_id"))
    rows = salted_join(rows, above, ["parent"], F.col("path"))
    roots = pages.agg(F.count(F.lit(1))).select(F.lit(root_id).alias("page_id"))
    known = rows.where("matched_by = 'id' AND missing IS NULL").select("page_id").unionByName(roots)
    trust = traceable(pages.select(F.col("id").alias("child_id"), "parent_id"), known)
    rows = salted_join(rows, trust, ["page_id"], F.col("path"), salts=1)
    stranger = (F.col("matched_by") == "title") & ~F.coalesce("traceable", F.lit(False))
    parent_id = F.when(F.col("parent").isNull(), F.lit(root_id)).otherwise(F.col("_parent_id"))
    return rows.select(
        *others, "page_id", "space_id", parent_id.alias("parent_id"), *[f for f in fields if f != "space_id"], "matched_by",
        F.coalesce("missing", F.when(stranger, NOT_TRACEABLE)).alias("error"))


def publish_plan(docs: DataFrame, pages: DataFrame, state: DataFrame, comments: DataFrame, root_id: str, root_space: str, overwrite: bool = True, check_comments: bool = False) -> DataFrame:
    """One action per document: create, update, unchanged, index-only, or skipped for a conflict, comments or an error.

    ``docs(path, parent, page_id, title, full_title, digest, content, synchronized)``.  New pages come with the
    space and the parent page, or the parent document where that page is new as well.  By default, edits of pages are overwritten and open comments ignored.
    """
    rows = docs.select(
        "path", "parent", "page_id", F.coalesce("title", F.lit("")).alias("title"), "full_title", "digest", "synchronized",
        content_key(F.col("content")).alias("content_key"))
    target = pages.select("id", "parent_id", "space_id", "title", "status", "version", content_key(F.col("body")).alias("page_key"))
    placed = check_status(place_pages(rows, target, root_id, root_space, ("page_key",)))
    checked = detect_changes(title_plan(placed, pages), state)
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
    made = F.col("action") == "create"
    return out.select(
        "path", "page_id", "action", F.when(~F.col("action").isin("error", "create", "index-only"), F.col("rule")).alias("rule"),
        F.when(made, F.col("full_title")).when(F.col("action") == "update", F.col("new_title")).alias("new_title"),
        F.when(F.col("action") == "update", F.col("version") + 1).when(made, 1).alias("new_version"),
        F.when(made, F.col("space_id")).alias("space_id"), F.when(made, F.col("parent_id")).alias("parent_id"),
        F.when(made & F.col("parent_id").isNull(), F.col("parent")).alias("parent_path"), F.coalesce("status_error", "error").alias("error"))
