"""Front-matter of any depth: values, typed JSON, and errors."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions.frontmatter import front_tree
from docloom.operators import metadata as MD
from docloom.plans import reconcile as RC
from docloom.sources import corpus as SC


@pytest.fixture(scope="module")
def value(spark):
    def evaluate(column):
        return spark.range(1).select(column.alias("v")).first().v

    return evaluate


GOOD = [
    ("title: Foo # comment\ntags: []\nsynchronized: off\n", {"title": "Foo", "tags": [], "synchronized": False}),
    ("a:\n  b:\n    c: 1\n    d: 'it''s'\n  e: \"x, \\\"y\\\"\"\nf:\n- one\n- two # c\n", {"a": {"b": {"c": 1, "d": "it's"}, "e": 'x, "y"'}, "f": ["one", "two"]}),
    ("a:\n  b:\n    c:\n      d:\n        e: deep\n      f: up\ng: 2\n", {"a": {"b": {"c": {"d": {"e": "deep"}, "f": "up"}}}, "g": 2}),
    ("t: {w: 10, m: 'a, b', \"q\": x}\nempty: {}\n", {"t": {"w": 10, "m": "a, b", "q": "x"}, "empty": {}}),
    ("text: >\n  folded\n  lines\n\n  next\nlit: |-\n  a\n   b\n\nkeep: |+\n  c\n\nz: 1\n", {"text": "folded lines\nnext\n", "lit": "a\n b", "keep": "c\n\n", "z": 1}),
    ("list:\n  - name: x\n    v: 1\n  - name: y\n  -\n    name: z\n  - plain\n  -\n", {"list": [{"name": "x", "v": 1}, {"name": "y"}, {"name": "z"}, "plain", None]}),
    ("l:\n- a:\n  - 1\n  - b: 2\n- c\n", {"l": [{"a": [1, {"b": 2}]}, "c"]}),
    ("plain: this goes\n  on here\nk: ~\nempty:\nlast: end\n", {"plain": "this goes on here", "k": None, "empty": None, "last": "end"}),
    ("\"quoted: key\": [\"a, b\", 'c', d e, -1, 1.5, yes]\n", {"quoted: key": ["a, b", "c", "d e", -1, 1.5, True]}),
    ("# note\n\nurl: https://x.y/z#frag\nhash: a#b\nid: \"007\"\nzero: 007\n", {"url": "https://x.y/z#frag", "hash": "a#b", "id": "007", "zero": "007"}),
    ("  a: 1\n  b:\n    c: 2\n", {"a": 1, "b": {"c": 2}}),
    ("text: |\n  # no comment\n  key: value\nnext: 1", {"text": "# no comment\nkey: value\n", "next": 1}),
    ('{"a": {"b": {"c": [1, {"d": null}]}}, "t": [], "s": "x"}', {"a": {"b": {"c": [1, {"d": None}]}}, "t": [], "s": "x"}),
]


BAD = [
    "a: &x 1\n", "a: *x\n", "a: !!str 1\n", "a: [1,\n 2]\n", "a: [1, [2]]\n", "a:\n\tb: 1\n", "a: 1\n  b: 2\n", "a: 1\n- b\n", "- a\n- b\n", "a: \"open\n", "a: x: y\n", "a:\n    b: 1\n  c: 2\n", "- - a\n",
    "<<: x\n  y\n", "a: 'b' c\n", "{\"a\": }"]


@pytest.fixture(scope="module")
def found_trees(spark):
    """All blocks in one job."""
    blocks = spark.createDataFrame([(block,) for block, _ in GOOD] + [(block,) for block in BAD], "block string")
    return {r["block"]: r["tree"] for r in blocks.select("block", front_tree(F.col("block")).alias("tree")).collect()}


@pytest.mark.parametrize("block, tree", GOOD)
def test_trees(found_trees, block, tree):
    found = found_trees[block]
    assert found["error"] is None and json.loads(found["json"]) == tree


@pytest.mark.parametrize("block", BAD)
def test_errors(found_trees, block):
    found = found_trees[block]
    assert found["error"].startswith("not understood") and found["json"] is None and not found["entries"]


def test_entries(value):
    entries = value(front_tree(F.lit("a:\n  b: [x, 'y']\n  c: null\n  d: []\nl:\n- k: v\n")))["entries"]
    assert [tuple(e) for e in entries] == [
        ("a.b", "x", "item plain"), ("a.b", "y", "item quoted"), ("a.c", None, "null"), ("a.d", None, "empty list"), ("l.0.k", "v", "plain")]
    entries = value(front_tree(F.lit('{"b": {"x": [1, {"y": []}], "z": {}}}')))["entries"]
    assert [tuple(e) for e in entries] == [("b.x", "1", "item plain"), ("b.x.1.y", None, "empty list"), ("b.z", None, "empty dictionary")]
    assert value(front_tree(F.lit(None).cast("string"))) is None


def scanned(spark, text):
    return MD.properties(MD.scan(spark.createDataFrame([("p", text)], "path string, text string"))).first()


def test_documents(spark):
    row = scanned(spark, "---\r\ntitle: Foo # c\r\ntags: []\r\nsynchronized: no\r\n---\r\nbody\r\nmore")
    assert (row["fm_title"], row["tags"], row["synchronized"], row["start_line"], row["body"]) == ("Foo", [], False, 6, "body\nmore")
    row = scanned(spark, "---\ntitle: a: b\n---\nbody")
    assert row["fm_title"] is None and row["front_error"] == "not understood: title: a: b" and row["body"] == "body"
    row = scanned(spark, "---\nproperties:\n  a:\n    b: [1]\n  c: text\n---\n")
    assert row["properties"] == {"a": '{"b":[1]}', "c": "text"} and row["tags"] is None
    assert scanned(spark, "no front-matter")["properties"] is None


def test_layout(spark):
    docs = MD.properties(MD.scan(spark.createDataFrame([("p", "---\nlayout:\n  image:\n    max_width: 5\n  table:\n    width: 7\n---\n"), ("q", "")], "path string, text string")))
    rows = {r[0]: tuple(r)[1:] for r in MD.layout(docs, {"alignment": "left", "max_width": 9, "table_display_mode": "fixed"}).collect()}
    assert rows == {"p": ("left", "left", 5, 7, "fixed"), "q": ("left", "left", 9, None, "fixed")}


def test_global_properties(spark, tmp_path):
    file = tmp_path / "p.yaml"
    file.write_text("theme:\r\n  color: red # c\r\n  size: 3\r\nowner: docs\r\n")
    loaded = SC.load_properties(spark, str(file))
    assert loaded == {"theme": {"color": "red", "size": 3}, "owner": "docs"}
    docs = MD.properties(MD.scan(spark.createDataFrame([("p", "---\nproperties:\n  theme:\n    color: blue\n---\n"), ("q", "")], "path string, text string")))
    merged = {r["path"]: r["merged"] for r in RC.merge_global_properties(docs, loaded).collect()}
    assert merged == {"p": {"theme": '{"color":"blue","size":3}', "owner": "docs"}, "q": {"theme": '{"color":"red","size":3}', "owner": "docs"}}
    file.write_text("- a\n")
    with pytest.raises(ValueError, match="dictionary"):
        SC.load_properties(spark, str(file))
