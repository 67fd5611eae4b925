"""Cross-references: the page index and the joins that resolve links, anchors, images and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lookups import BLANK
from ..session import salted_join
from .filters import within_root


def page_index(nodes: DataFrame, site_space: str | None = None) -> DataFrame:
    """``(path, page_id, space_key, title, synchronized)`` of every document."""
    return nodes.select(
        "path",
        F.coalesce("page_id", T.path_digest(F.col("path"))).alias("page_id"),
        F.coalesce("space_key", F.lit(site_space).cast("string"), F.lit("HOME")).alias("space_key"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("synchronized", F.lit(True)).alias("synchronized"))


def _resolved(links: DataFrame) -> DataFrame:
    return links.withColumn("resolved", T.resolve_path(T.parent_dir(F.col("path")), T.url_path(F.col("url"))))


def resolve_links(links: DataFrame, index: DataFrame, root: str, site: str) -> DataFrame:
    """Relative page links with the id, space, title and address of their target, NULL when there is none."""
    pages = within_root(_resolved(links.where("kind = 'page'")), root).where("inside")
    target = index.select(F.col("path").alias("resolved"), F.col("page_id"), F.col("space_key"), F.col("title").alias("target_title"))
    joined = salted_join(pages, target, ["resolved"], F.xxhash64("path", "pos"))
    address = T.page_url(site, F.col("space_key"), F.col("page_id"), F.col("target_title"), F.col("fragment"))
    return joined.select("path", "pos", "text", "url", "resolved", "page_id", "space_key", "target_title", address.alias("address"))


def broken_links(links: DataFrame, index: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Relative links that lead outside the root, to no page or to no file.

    Pages and files form one relation of targets, so links are read and joined once.
    """
    relative = within_root(_resolved(links.where(F.col("kind").isin("page", "attachment"))), root)
    targets = index.select(F.lit("page").alias("kind"), F.col("path").alias("resolved")).unionByName(
        files.select(F.lit("attachment").alias("kind"), F.col("path").alias("resolved"))).withColumn("known", F.lit(True))
    joined = salted_join(relative, targets, ["kind", "resolved"], F.xxhash64("path", "pos"))
    reason = (
        F.when(~F.col("inside"), "outside root")
        .when(F.col("known").isNull(), F.when(F.col("kind") == "page", "no such page").otherwise("no such file")))
    return joined.select("path", "pos", "url", "resolved", reason.alias("reason")).where("reason IS NOT NULL")


def resolve_attachment_links(links: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Links to existing files with the attachment name they get."""
    inside = within_root(_resolved(links.where("kind = 'attachment'")), root).where("inside")
    found = salted_join(inside, files.select(F.col("path").alias("resolved")), ["resolved"], F.xxhash64("path", "pos"), "left_semi")
    name = T.attachment_name(T.relative_path(T.parent_dir(F.col("path")), F.col("resolved")))
    return found.select("path", "pos", "url", "resolved", name.alias("attachment"))


def heading_anchors(heads: DataFrame) -> DataFrame:
    """``(path, anchor)`` that headings publish."""
    return heads.select("path", "pos", "text", T.heading_id(F.col("text")).alias("anchor"))


def resolve_anchors(links: DataFrame, heads: DataFrame) -> DataFrame:
    """Fragments of same-page and cross-page links, and whether a heading publishes them."""
    with_fragment = links.where(F.col("kind").isin("anchor", "page") & F.col("fragment").isNotNull())
    target = F.when(F.col("kind") == "anchor", F.col("path")).otherwise(
        T.resolve_path(T.parent_dir(F.col("path")), T.url_path(F.col("url"))))
    wanted = with_fragment.select("path", "pos", "url", target.alias("target"), F.regexp_replace("fragment", "^#+", "").alias("anchor"))
    published = heading_anchors(heads).select(F.col("path").alias("target"), "anchor", F.lit(True).alias("found")).distinct()
    joined = salted_join(wanted, published, ["target", "anchor"], F.xxhash64("path", "pos"))
    return joined.select("path", "pos", "url", "target", "anchor", F.col("found").isNull().alias("dangling"))


def _local_images(found: DataFrame) -> DataFrame:
    path = T.resolve_path(T.parent_dir(F.col("path")), F.col("url"))
    return found.where("kind = 'local'").withColumn("resolved", path)


def missing_images(found: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Local images whose file does not exist or lies outside the root."""
    local = within_root(_local_images(found), root)
    known = files.select(F.col("path").alias("resolved"), F.lit(True).alias("exists"))
    joined = salted_join(local, known, ["resolved"], F.xxhash64("path", "pos"))
    reason = F.when(F.col("exists").isNull(), "no such file").when(~F.col("inside"), "outside root")
    return joined.select("path", "pos", "url", "resolved", reason.alias("reason")).where("reason IS NOT NULL")


def prefer_raster(found: DataFrame, files: DataFrame) -> DataFrame:
    """Vector images with a raster sibling are replaced by it."""
    local = _local_images(found)
    local = local.withColumn("raster", F.when(F.col("resolved").endswith(".svg"), F.regexp_replace("resolved", r"\.svg\z", ".png")))
    known = files.select(F.col("path").alias("raster"), F.lit(True).alias("exists"))
    joined = salted_join(local, known, ["raster"], F.xxhash64("path", "pos"))
    return joined.select("path", "pos", "url", F.when(F.col("exists"), F.col("raster")).otherwise(F.col("resolved")).alias("chosen"))


def file_dimensions(files: DataFrame) -> DataFrame:
    """Width and height from the header of PNG files and the root element of SVG files.

    Reads ``(path, content)`` and drops the content, so that bytes stay in the scan.
    """
    content = F.col("content")
    png = F.hex(F.substring(content, 1, 16)) == "89504E470D0A1A0A0000000D49484452"

    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")

    root = F.regexp_extract(F.try_validate_utf8(content.cast("string")), r"(?s)<(?:\w+:)?svg(?:\s[^>]*)?>", 0)

    def attribute(name: str) -> Column:
        return T.svg_length_px(F.nullif(F.regexp_extract(root, rf'\s{name}="([^"]*)"', 1), F.lit("")))

    box = F.split(F.regexp_replace(F.regexp_extract(root, r'\sviewBox="([^"]*)"', 1), rf"\A[{BLANK}]+|[{BLANK}]+\z", ""), rf"[{BLANK}]*,[{BLANK}]*|[{BLANK}]+")
    box_width = F.when(F.size(box) == 4, F.rint(F.try_element_at(box, F.lit(3)).try_cast("double")).cast("int"))
    box_height = F.when(F.size(box) == 4, F.rint(F.try_element_at(box, F.lit(4)).try_cast("double")).cast("int"))
    svg = files.select(
        "path", png.alias("png"), number(17).alias("pw"), number(21).alias("ph"),
        attribute("width").alias("w"), attribute("height").alias("h"), box_width.alias("bw"), box_height.alias("bh"))
    boxed = F.col("bw").isNotNull() & F.col("bh").isNotNull()
    width = F.coalesce("w", F.when(boxed & F.col("h").isNotNull(), F.floor(F.col("h") * F.col("bw") / F.col("bh")).cast("int")).when(boxed, F.col("bw")))
    height = F.coalesce("h", F.when(boxed & F.col("w").isNotNull(), F.floor(F.col("w") * F.col("bh") / F.col("bw")).cast("int")).when(boxed, F.col("bh")))
    whole = width.isNotNull() & height.isNotNull()
    is_svg = F.col("path").endswith(".svg")
    return svg.select(
        "path",
        F.when(F.col("png"), F.col("pw")).when(is_svg & whole, width).alias("width"),
        F.when(F.col("png"), F.col("ph")).when(is_svg & whole, height).alias("height"))


def image_dimensions(found: DataFrame, files: DataFrame) -> DataFrame:
    """Size of local images: explicit attributes, else what the file says."""
    sizes = file_dimensions(files).select(F.col("path").alias("resolved"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    joined = salted_join(_local_images(found), sizes, ["resolved"], F.xxhash64("path", "pos"))
    unset = F.col("width").isNull() & F.col("height").isNull()
    return joined.select(
        "path", "pos", "resolved",
        F.when(unset, F.col("_w")).otherwise(F.col("width")).alias("width"),
        F.when(unset, F.col("_h")).otherwise(F.col("height")).alias("height"))


def distinct_users(mentions: DataFrame) -> DataFrame:
    return mentions.select("email", "name").distinct()


def resolve_users(mentions: DataFrame, users: DataFrame) -> DataFrame:
    """One account per mentioned address: same address, and a display name that contains the mentioned name."""
    wanted = distinct_users(mentions)
    joined = wanted.join(users, "email").where(F.contains(F.lower("display_name"), F.lower("name")))
    return joined.groupBy("email").agg(F.max("account_id").alias("account_id"))


def space_lookup(rows: DataFrame, spaces: DataFrame) -> DataFrame:
    """Adds the id of the space with the row's key; a key that is missing or not unique is an error."""
    unique = spaces.groupBy("space_key").agg(F.count(F.lit(1)).alias("_n"), F.min("space_id").alias("space_id"))
    joined = salted_join(rows, unique, ["space_key"], F.col("path"))
    good = F.col("_n") == 1
    error = F.when(F.col("_n").isNull(), "no such space").when(~good, "space key is not unique")
    return joined.withColumns({"space_id": F.when(good, F.col("space_id")), "error": error}).drop("_n")


def coalesce_space(rows: DataFrame, spaces: DataFrame, site_space: str | None) -> DataFrame:
    """Space id from the given id, else the given key, else the site default; both at once is an error."""
    both = F.col("space_id").isNotNull() & F.col("space_key").isNotNull()
    keyed = rows.withColumns({"_given": F.col("space_id"), "_both": both}).drop("space_id")
    keyed = keyed.withColumn("_key", F.when(F.col("_given").isNull(), F.coalesce("space_key", F.lit(site_space).cast("string"))))
    ids = spaces.groupBy(F.col("space_key").alias("_key")).agg(F.min("space_id").alias("_id"))
    joined = salted_join(keyed, ids, ["_key"], F.col("path"))
    return joined.select(
        "path", F.when(~F.col("_both"), F.coalesce("_given", "_id")).alias("space_id"),
        F.when(F.col("_both"), F.lit("either id or key is expected")).alias("error"))


def match_by_page_id(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with an explicit page id; a missing page is an error row."""
    explicit = docs.where("page_id IS NOT NULL").select("path", "page_id")
    target = pages.select(F.col("id").alias("page_id"), "status", F.col("title").alias("page_title"), "version")
    joined = explicit.join(target, "page_id", "left")
    return joined.select("path", "page_id", "status", "page_title", "version", F.lit("id").alias("matched_by"),
                         F.when(F.col("version").isNull(), F.lit("no such page")).alias("error"))


def single_titles(pages: DataFrame) -> DataFrame:
    """Pages whose title occurs once in their space, counted before any join so that copies never multiply."""
    others = [c for c in pages.columns if c not in ("space_id", "title")]
    counted = pages.groupBy("space_id", F.col("title").alias("full_title")).agg(
        F.count(F.lit(1)).alias("hits"), *[F.min(c).alias(c) for c in others])
    return counted.where("hits = 1").drop("hits")


def match_by_title(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents without an id: the page with the same space and title when there is exactly one, else a new page."""
    unnamed = docs.where("page_id IS NULL").select("path", "space_id", "full_title")
    single = single_titles(pages.select("space_id", "title", F.col("id").alias("page_id"), "status", "version"))
    joined = salted_join(unnamed, single, ["space_id", "full_title"], F.col("path"))
    found = F.col("page_id").isNotNull()
    return joined.select("path", "page_id", "status", F.when(found, F.col("full_title")).alias("page_title"), "version",
                         F.when(found, "title").otherwise("none").alias("matched_by"))


def match_pages(docs: DataFrame, pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Both matches in one pass over the documents, whose columns are kept.

    ``carry`` names further page columns to bring along.
    """
    fields = ["status", "page_title", "version", *carry]
    target = pages.withColumn("page_title", F.col("title"))
    by_id = target.select(F.col("id").alias("page_id"), F.struct(*fields).alias("_by_id"))
    single = single_titles(target.select("space_id", "title", "id", F.struct(*fields).alias("_by_title"))).withColumnRenamed("id", "_id")
    named = F.col("page_id").isNotNull()
    rows = docs.withColumn("_title", F.when(~named, F.col("full_title")))
    rows = salted_join(rows, by_id, ["page_id"], F.col("path"), salts=1)
    rows = salted_join(rows, single.withColumnRenamed("full_title", "_title"), ["space_id", "_title"], F.col("path"))
    kept = [c for c in docs.columns if c != "page_id"]
    return rows.select(
        *kept, F.coalesce("page_id", "_id").alias("page_id"),
        *[F.coalesce(F.col(f"_by_id.{f}"), F.col(f"_by_title.{f}")).alias(f) for f in fields],
        F.when(named, "id").when(F.col("_id").isNotNull(), "title").otherwise("none").alias("matched_by"),
        F.when(named & F.col("_by_id").isNull(), F.lit("no such page")).alias("error"))
