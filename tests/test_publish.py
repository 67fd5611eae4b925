"""Spaces, parents and trust along the page tree."""

import pytest
from pyspark.sql import functions as F

from docloom.plans import hierarchy as HI
from docloom.plans import publish as PU


@pytest.fixture
def pages(spark):
    rows = [
        ("1", "root", "S1", "Top", "current", 3), ("2", "1", "S1", "Below", "current", 1), ("3", None, "S1", "Stranger", "current", 1), ("4", "9", "S1", "Lost", "current", 1),
        ("5", "root", "S2", "Below", "current", 1), ("6", "1", "S1", "Old", "archived", 1), ("7", "1", "S1", "Twice", "current", 1), ("8", "1", "S1", "Twice", "current", 1)]
    return spark.createDataFrame(rows, "id string, parent_id string, space_id string, title string, status string, version int").withColumn("body", F.lit("<p/>"))


def placed(spark, pages, rows):
    docs = spark.createDataFrame(rows, "path string, parent string, page_id string, full_title string, space_id string")
    return {r["path"]: (r["page_id"], r["matched_by"], r["space_id"], r["parent_id"], r["error"]) for r in PU.place_pages(docs, pages, "root", "S2").collect()}


def test_places(spark, pages):
    got = placed(spark, pages, [
        ("index", None, None, "Home", "X"), ("top", "index", "1", "any", "X"), ("below", "top", None, "Below", "X"), ("deep", "below", None, "New", "X"), ("deeper", "deep", None, "Newer", "X"),
        ("stranger", "top", None, "Stranger", "X"), ("lost", "top", None, "Lost", "X"), ("other", "index", None, "Below", "X"), ("gone", "top", "77", "any", "X"), ("heir", "gone", None, "Heir", "X"),
        ("twice", "top", None, "Twice", "X"), ("none", "top", None, None, "X")])
    assert got == {
        "index": (None, "none", "S2", "root", None), "top": ("1", "id", "S1", None, None), "below": ("2", "title", "S1", "1", None), "deep": (None, "none", "S1", "2", None),
        "deeper": (None, "none", "S1", None, None), "stranger": ("3", "title", "S1", "1", PU.NOT_TRACEABLE), "lost": ("4", "title", "S1", "1", PU.NOT_TRACEABLE),
        "other": ("5", "title", "S2", None, None), "gone": ("77", "id", "S1", "1", "no such page"), "heir": (None, "none", "S1", None, None), "twice": (None, "none", "S1", "1", None),
        "none": (None, "none", "S1", "1", None)}


def test_an_explicit_page_is_a_root_of_trust(spark, pages):
    assert placed(spark, pages, [("a", None, "9", "x", "")])["a"][4] == "no such page"
    more = pages.unionByName(spark.createDataFrame([("9", None, "S1", "Island", "current", 1, "")], pages.schema))
    got = placed(spark, more, [("a", None, "9", "x", ""), ("b", "a", None, "Lost", "")])
    assert got["b"] == ("4", "title", "S1", "9", None)


def test_plan(spark, pages):
    docs = spark.createDataFrame([
        ("top", None, "1", "Top", "Top", "h1", "<p/>", True), ("new", "top", None, "New", "New", "h2", "<p>n</p>", True), ("newer", "new", None, None, "Newer", "h3", "", True),
        ("below", "top", None, "Below", "Below", "h4", "<p>changed</p>", True), ("stranger", "top", None, "Stranger", "Stranger", "h5", "<p>x</p>", True), ("old", "top", None, "Old", "Old", "h6", "", True)],
        "path string, parent string, page_id string, title string, full_title string, digest string, content string, synchronized boolean")
    state = spark.createDataFrame([("2", 5, "x")], "page_id string, page_version int, source_digest string")
    comments = spark.createDataFrame([("2", "open")], "page_id string, resolution_status string")
    plan = {r["path"]: r for r in PU.publish_plan(docs, pages, state, comments, "root", "S2").collect()}
    assert {p: r["action"] for p, r in plan.items()} == {"top": "unchanged", "new": "create", "newer": "create", "below": "update", "stranger": "error", "old": "error"}
    assert (plan["new"]["space_id"], plan["new"]["parent_id"], plan["new"]["parent_path"]) == ("S1", "1", None)
    assert (plan["newer"]["space_id"], plan["newer"]["parent_id"], plan["newer"]["parent_path"], plan["newer"]["new_title"]) == ("S1", None, "new", "Newer")
    assert plan["old"]["error"].endswith("archived") and plan["stranger"]["error"] == PU.NOT_TRACEABLE
    kept = {r["path"]: r["action"] for r in PU.publish_plan(docs, pages, state, comments, "root", "S2", overwrite=False).collect()}
    assert kept["below"] == "conflict-skip"
    asked = {r["path"]: r["action"] for r in PU.publish_plan(docs, pages, state.limit(0), comments, "root", "S2", check_comments=True).collect()}
    assert asked["below"] == "comment-skip"


def test_inherited_along_a_chain(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, "top" if i == 0 else "mid" if i == 40 else None) for i in range(70)]
    nodes = spark.createDataFrame(chain + [("x", "y", None), ("y", "x", None), ("z", "z", None), ("o", "nowhere", None)], "path string, parent string, v string")
    got = {r["path"]: r["w"] for r in HI.inherited(nodes, "v", "w").collect()}
    assert got == {f"n{i}": "mid" if i >= 40 else "top" for i in range(70)} | dict.fromkeys("xyzo")
