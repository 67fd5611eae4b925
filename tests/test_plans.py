"""Hierarchy, resolution, ordering and reconciliation."""

import random
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import filters as FL
from docloom.operators import resolve as R
from docloom.operators import structure as S
from docloom.plans import hierarchy as HI
from docloom.plans import reconcile as RC
from docloom.plans import reorder as RO
from docloom.plans.ranking import positions
from docloom.sources import corpus as SC


def located(spark, *paths):
    return SC.with_location(spark.createDataFrame([(p,) for p in paths], "path string"))


def test_nearest_parent_with_synthesized_pages(spark, rows):
    docs = located(spark, "index.md", "doc1.md", "doc2.md", "parent/nested/index.md", "parent/nested/doc3.md", "parent/nested/deep/index.md")
    missing = HI.synthesize_parents(docs)
    assert rows(missing, "path") == {("parent/index.md",)}
    tree = HI.page_tree(docs.unionByName(missing.select("path", "dir", "name")))
    assert rows(HI.sibling_position(tree), "path", "parent", "position") == {
        ("index.md", None, 0), ("doc1.md", "index.md", 0), ("doc2.md", "index.md", 1), ("parent/index.md", "index.md", 2),
        ("parent/nested/index.md", "parent/index.md", 0), ("parent/nested/doc3.md", "parent/nested/index.md", 0),
        ("parent/nested/deep/index.md", "parent/nested/index.md", 1)}
    assert rows(HI.descendant_count(tree), "path", "descendants") >= {("index.md", 6), ("parent/nested/index.md", 2), ("doc1.md", 0)}


def test_nearest_parent_without_top_page(spark, rows):
    docs = located(spark, "a/index.md", "a/doc.md", "b/skip/nested/index.md", "b/skip/nested/doc.md", "doc.md")
    tree = HI.page_tree(docs)
    assert rows(HI.sibling_position(tree), "path", "parent", "position") == {
        ("doc.md", None, 0), ("a/index.md", None, 1), ("b/skip/nested/index.md", None, 2), ("a/doc.md", "a/index.md", 0),
        ("b/skip/nested/doc.md", "b/skip/nested/index.md", 0)}


def test_parent_election(spark, rows):
    docs = located(spark, "a/README.md", "a/index.md", "b/README.md", "b/b.md", "c/c.md", "d/x.md")
    assert rows(HI.dir_parents(docs)) == {("a", "a/index.md"), ("b", "b/README.md"), ("c", "c/c.md")}


def test_listing_order(spark):
    names = ["0.md", "9.md", "A.md", "a.md", "Z.md", "z.md"]
    entries = [("", n, False) for n in reversed(names)] + [("", d, True) for d in "zZaA90"]
    placed = HI.listing_order(spark.createDataFrame(entries, "dir string, name string, is_dir boolean"))
    assert [r.name for r in placed.orderBy("position").collect()] == list("09AaZz") + names


def test_positions_of_a_hot_group(spark):
    """Positions equal those of a plain sort, also when one group spans many partitions."""
    random.seed(3)
    data = [("hot" if random.random() < 0.9 else random.choice(["a", "b", None]), random.random(), n) for n in range(5000)]
    placed = positions(spark.createDataFrame(data, "g string, v double, n int").repartition(16), ["g"], [F.col("v")])
    groups = {}
    for g, v, n in data:
        groups.setdefault(g, []).append((v, n))
    expected = {(g, n, i) for g, members in groups.items() for i, (_, n) in enumerate(sorted(members))}
    assert {(r.g, r.n, r.position) for r in placed.collect()} == expected


def test_ignore_rules_cascade(spark, rows):
    entries = located(spark, "source/skip.md", "excluded.md", "source/excluded.md", "error.log", "source/error.log", "source/local.md", "source/temp.bak",
                      "important.log", "source/important.log", "local.md", "temp.bak", "source/keep.bak", "source/keep.md")
    rules = [("", n, p) for n, p in enumerate(["source/skip.md", "excluded.md", "*.log", "!important.log"])]
    rules += [("source", n, p) for n, p in enumerate(["local.md", "*.bak", "!keep.bak"])]
    kept = FL.filter_ignored(entries, spark.createDataFrame(rules, "base_dir string, line_no int, pattern string"))
    assert rows(kept, "path") == {("important.log",), ("source/important.log",), ("local.md",), ("temp.bak",), ("source/keep.bak",), ("source/keep.md",)}


@pytest.mark.parametrize("pattern, path, excluded", [
    ("source/emoji.md", "source/emoji.md", True), ("source/emoji.md", "emoji.md", False), ("# note", "# note", False),
    ("build/", "x/build/a/b.md", True), ("build/", "build", False), ("docs/temp/", "docs/temp/a.md", True), ("docs/temp/", "x/docs/temp/a.md", False),
    ("up-*.md", "a/up-1.md", True), ("a?c.md", "abc.md", True), ("a?c.md", "a/c.md", False), ("**/x.md", "p/q/x.md", True), ("a/**/z.md", "a/z.md", True),
    ("a/**/z.md", "a/b/c/z.md", True), ("a/**", "a/b", True), ("/top.md", "top.md", True), ("/top.md", "d/top.md", False), ("[ab].md", "b.md", True),
    ("[!ab].md", "b.md", False), ("a+b.md", "a+b.md", True), ("a.md", "aXmd", False), (r"\#x", "#x", True)])
def test_ignore_patterns(spark, pattern, path, excluded):
    rules = spark.createDataFrame([("", 0, pattern)], "base_dir string, line_no int, pattern string")
    assert (FL.filter_ignored(located(spark, path), rules).count() == 0) is excluded


def test_broken_links(spark, rows):
    body = "[a](missing.md) [b](../../out.md) [c](dir/) [d](paper.pdf) [e](good.md) [f](gone.pdf)"
    links = S.links(spark.createDataFrame([("docs/a.md", body)], "path string, body string"))
    index = spark.createDataFrame([("docs/good.md",)], "path string")
    files = spark.createDataFrame([("docs/paper.pdf",)], "path string")
    assert rows(R.broken_links(links, index, files, "docs"), "url", "reason") == {
        ("missing.md", "no such page"), ("../../out.md", "outside root"), ("dir/", "no such file"), ("gone.pdf", "no such file")}


def children(spark, keys):
    return spark.createDataFrame([("p", f"i{n:04d}", n, k) for n, k in enumerate(keys)], "parent string, item string, current int, desired int")


def longest(ranks):
    tails = []
    for r in ranks:
        at = bisect_left(tails, r)
        tails[at:at + 1] = [r]
    return len(tails)


def replay(items, plan):
    """Carry out the moves one by one on a plain list."""
    order = list(items)
    for move in sorted(plan, key=lambda m: m.seq):
        order.remove(move.item)
        at = order.index(move.ref)
        order.insert(at if move.position == "before" else at + 1, move.item)
    return order


@pytest.mark.parametrize("keys, moves", [([3, 1, 2, 4], 1), ([2, 1, 2, 0], 2), ([1, 2, 3], 0), ([3, 2, 1], 2), ([0], 0)])
def test_reorder_counts(spark, keys, moves):
    plan = RO.reorder_plan(children(spark, keys)).collect()
    assert len(plan) == moves
    order = replay([f"i{n:04d}" for n in range(len(keys))], plan)
    assert order == [f"i{n:04d}" for n in sorted(range(len(keys)), key=keys.__getitem__)]


def test_reorder_shuffled(spark, rows):
    random.seed(5)
    keys = list(range(1000))
    random.shuffle(keys)
    table = children(spark, keys)
    plan = RO.reorder_plan(table)
    moves = plan.collect()
    assert len(moves) == 1000 - longest(keys)
    items = [f"i{n:04d}" for n in range(1000)]
    assert replay(items, moves) == [items[keys.index(k)] for k in range(1000)]
    after = RO.apply_moves(table.select("parent", "item", "current"), plan)
    assert rows(after, "item", "position") == {(items[n], k) for n, k in enumerate(keys)}


def test_reorder_near_sorted_blocks(spark):
    """Search sees blocks: a long sorted page with few strays gives few rows."""
    keys = list(range(500))
    for at in (400, 250, 30):
        keys.insert((at * 7) % 480, keys.pop(at))
    plan = RO.reorder_plan(children(spark, keys)).collect()
    assert 0 < len(plan) == 500 - longest(keys) <= 3


def test_heaviest_increasing_against_brute_force():
    random.seed(11)
    for _ in range(300):
        keys = list(range(random.randint(1, 30)))
        random.shuffle(keys)
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] + 1]
        ends = [*(s - 1 for s in starts[1:]), len(keys) - 1]
        first, last = np.array([keys[s] for s in starts]), np.array([keys[e] for e in ends])
        kept = RO.heaviest_increasing(first, last)
        assert int((last - first + 1)[kept].sum()) == longest(keys)
        assert all(np.diff(first[kept]) > 0)


def test_append_moves(spark, rows):
    current = spark.createDataFrame([("home", "C", 0), ("home", "A", 1), ("home", "B", 2), ("home", "Parent", 3), ("Parent", "Child", 0)], "parent string, item string, current int")
    moves = spark.createDataFrame([("B", "Parent")], "item string, new_parent string")
    assert rows(RO.append_moves(current, moves)) == {("home", "C", 0), ("home", "A", 1), ("home", "Parent", 2), ("Parent", "Child", 0), ("Parent", "B", 1)}


def test_traceable(spark, rows):
    chain = [(f"n{n}", f"n{n - 1}" if n else "root") for n in range(70)]
    edges = spark.createDataFrame(chain + [("x", "y"), ("y", "x"), ("o", None), ("q", "nowhere"), ("z", "z")], "child_id string, parent_id string")
    known = spark.createDataFrame([("root",)], "page_id string")
    got = rows(HI.traceable(edges, known))
    assert got == {(f"n{n}", True) for n in range(70)} | {(c, False) for c in "xyoqz"}


def test_attachment_diff(spark, rows):
    desired = spark.createDataFrame([("1", "flip", "b", 1), ("1", "new", "c", 1), ("1", "bare", "d", 1), ("1", "same", "e", 1)], "page_id string, name string, checksum string, size int")
    current = spark.createDataFrame([("1", "flip", "a", 1), ("1", "bare", None, 1), ("1", "same", "e", 2), ("1", "old", "f", 1)], "page_id string, name string, checksum string, size int")
    assert rows(RC.attachment_diff(desired, current), "name", "action") == {("flip", "upload"), ("new", "upload"), ("bare", "upload"), ("same", "skip"), ("old", "delete")}
    assert rows(RC.attachment_diff(desired, current, by="size"), "name", "action") == {("flip", "skip"), ("new", "upload"), ("bare", "skip"), ("same", "upload"), ("old", "delete")}


def test_label_diff_null_and_empty(spark, rows):
    desired = spark.createDataFrame([("1", ["a", "b"]), ("2", []), ("3", None)], "page_id string, tags array<string>")
    current = spark.createDataFrame([(p, n, "global") for p in "123" for n in ("a", "x")], "page_id string, name string, prefix string")
    assert rows(RC.label_diff(desired, current), "page_id", "name", "action") == {("1", "b", "add"), ("1", "x", "remove"), ("2", "a", "remove"), ("2", "x", "remove")}
    assert rows(RC.label_diff(desired, current, keep_existing=True), "page_id", "name", "action") == {("1", "b", "add")}


def test_resolve_users(spark, rows):
    mentions = spark.createDataFrame([("d", "a@x", "Ann"), ("e", "a@x", "Ann"), ("d", "b@x", "Bob")], "path string, email string, name string")
    users = spark.createDataFrame([("1", "a@x", "Ann Smith"), ("2", "a@x", "Other"), ("3", "a@x", "Mary ann")], "account_id string, email string, display_name string")
    assert rows(R.resolve_users(mentions, users)) == {("a@x", "3")}


def test_sync_plan_is_idempotent(spark):
    """Storing what the plan says and planning again leaves nothing to do."""
    docs = spark.createDataFrame([(f"d{n}.md", str(n), "S", f"T{n}", f"T{n}", f"h{n}", f"<p>{n}</p>", True) for n in range(6)],
                                 "path string, page_id string, space_id string, title string, full_title string, digest string, content string, synchronized boolean")
    pages = spark.createDataFrame([(str(n), "S", f"T{n}" if n != 4 else "Old", "current", 1, "<p>0</p>") for n in range(6)], "id string, space_id string, title string, status string, version int, body string")
    state = spark.createDataFrame([("1", 1, "h1"), ("2", 9, "h2")], "page_id string, page_version int, source_digest string")
    comments = spark.createDataFrame([("3", "open"), ("5", "resolved")], "page_id string, resolution_status string")
    plan = {r.path: r for r in RC.sync_plan(docs, pages, state, comments).collect()}
    assert {p: r.action for p, r in plan.items()} == {"d0.md": "unchanged", "d1.md": "unchanged", "d2.md": "conflict-skip", "d3.md": "comment-skip", "d4.md": "update", "d5.md": "update"}
    assert plan["d4.md"].new_title == "T4" and plan["d4.md"].new_version == 2
    synced = docs.select(F.col("page_id").alias("id"), "space_id", "title", F.lit("current").alias("status"), F.lit(2).alias("version"), F.col("content").alias("body"))
    tags = docs.select("page_id", F.lit(2).alias("page_version"), F.col("digest").alias("source_digest"))
    again = RC.sync_plan(docs, synced, tags, comments)
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_image_dimensions(spark, rows):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    svgs = {
        "explicit.svg": b'<svg width="100" height="50px">', "unit.svg": b'<?xml version="1.0"?><svg:svg width="1in" height="72pt"/>',
        "box.svg": b'<svg viewBox="0 0 300 200">', "fill.svg": b'<svg width="100" viewBox="0,0,200,101">', "percent.svg": b'<svg width="100%" height="100%"/>'}
    files = spark.createDataFrame([("a.png", bytearray(png))] + [(n, bytearray(c)) for n, c in svgs.items()], "path string, content binary")
    assert rows(R.file_dimensions(files)) == {
        ("a.png", 640, 480), ("explicit.svg", 100, 50), ("unit.svg", 96, 96), ("box.svg", 300, 200), ("fill.svg", 100, 50), ("percent.svg", None, None)}


def test_property_scope(spark, rows):
    docs = spark.createDataFrame([("1", {"a": "1"}, 2, "h"), ("2", None, 2, "h"), ("3", None, 2, "h")], "page_id string, merged map<string,string>, version int, digest string")
    current = spark.createDataFrame([("1", "a", "0", 4), ("1", "x", "0", 1), ("2", "x", "0", 1), ("3", "x", "0", 1)], "page_id string, key string, value string, version int")
    state = spark.createDataFrame([("3", 2, "h")], "page_id string, page_version int, source_digest string")
    assert rows(RC.property_scope(docs, current, state, "tag"), "page_id", "key", "action", "new_version") == {
        ("1", "a", "update", 5), ("1", "x", "remove", None), ("1", "tag", "add", 1), ("2", "tag", "add", 1)}
