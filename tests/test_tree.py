"""Document trees: any names, pruning while listing, files written once."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.sources import corpus as SC
from docloom.sources import tree as ST


def grown(top, files):
    for name, text in files.items():
        file = top / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text.encode())
    return str(top)


def test_names(spark, rows, tmp_path):
    root = grown(tmp_path, {"_intro.md": "a\r\nb\rc", "_x/_y.md": "y", "a b/ü#%20.md": "ü", ".hid.md": "", ".git/x.md": "", "a/.ignore": "*.tmp\r\n!x.tmp", "a/pic.png": "12", "e.md": ""})
    assert rows(SC.scan_corpus(spark, root)) == {
        ("_intro.md", "", "_intro.md", "a\nb\nc"), ("_x/_y.md", "_x", "_y.md", "y"), ("a b/ü#%20.md", "a b", "ü#%20.md", "ü"), ("e.md", "", "e.md", "")}
    assert rows(SC.scan_rules(spark, root, ".ignore")) == {("a", 0, "*.tmp"), ("a", 1, "!x.tmp")}
    assert rows(SC.scan_files(spark, root)) >= {("a/pic.png", 2), (".git/x.md", 0)}
    assert rows(SC.scan_single(spark, root + "/_intro.md")) == {("_intro.md", "", "_intro.md", "a\nb\nc")}
    assert rows(SC.scan_corpus(spark, "file://" + root + "/"), "path") == rows(SC.scan_corpus(spark, root), "path")


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_pruned(spark, rows, tmp_path, tasks):
    files = {f"d{i}/e{j}/f{k}.md": "x" for i in range(4) for j in range(3) for k in range(2)}
    root = grown(tmp_path, files | {".ignore": "d0/\ne1/*\n!d2/e2\n", "d2/.ignore": "e2\n", "d3/.ignore": "f0.md\n!e0/f0.md"})
    shut = tmp_path / "d0" / "e0"
    os.chmod(shut, 0)  # an excluded subtree is not opened
    try:
        found = rows(ST.list_tree(spark, root, "*.md", ".ignore", tasks=tasks), "path")
    finally:
        os.chmod(shut, 0o755)
    want = {p for p in files if not p.startswith("d0/") and not p.startswith("d2/e2/")}
    assert found == {(p,) for p in want if not (p.startswith("d3/") and p.endswith("f0.md") and "/e0/" not in p)}


def test_open_directories(tmp_path, monkeypatch):
    """The excluded directory is not listed at all."""
    root = grown(tmp_path, {"a/x.md": "", "b/c/y.md": "", ".ignore": "b/\n"})
    seen, opened = [], ST.Walk.opened
    monkeypatch.setattr(ST.Walk, "opened", lambda self, files, top, directory, lists: seen.append(directory) or opened(self, files, top, directory, lists))
    reader = ST.TreeReader(ST.Walk(root, "*.md", ".ignore"), 8)
    assert [path for part in reader.partitions() for path, *_ in reader.read(part)] == ["a/x.md"] and set(seen) == {"", "a"}


def test_written_once(spark, rows, tmp_path):
    out = str(tmp_path / "out")
    docs = spark.range(300).select(F.format_string("d%d/_n%d.csf", F.col("id") % 7, "id").alias("path"), F.when(F.col("id") > 0, F.concat(F.lit("tëxt\n"), "id")).alias("content"))
    ST.write_documents(docs, out)
    ST.write_documents(docs, out)  # once more, as after a failed job
    assert rows(ST.read_contents(ST.list_tree(spark, out, "*.csf"), out).select("path", F.decode("content", "UTF-8"))) == {(r["path"], r["content"] or "") for r in docs.collect()}
    assert (tmp_path / "out" / "_SUCCESS").read_text() == "300\n" and not list((tmp_path / "out").rglob(".part-*"))


def test_failing_task(spark, rows, tmp_path):
    out = tmp_path / "out"
    docs = spark.createDataFrame([("a/b.md", "1"), ("../up.md", "2")], "path string, content string").coalesce(1)
    with pytest.raises(Exception, match="inside the tree"):
        ST.write_documents(docs, str(out))
    assert not (out / "_SUCCESS").exists() and not list(out.rglob(".part-*")) and not (tmp_path / "up.md").exists()
    ST.write_documents(docs.where("content = '1'"), str(out))
    assert rows(SC.scan_corpus(spark, str(out))) == {("a/b.md", "a", "b.md", "1")}
    with pytest.raises(ValueError, match="several documents"):
        ST.write_documents(docs.union(docs), str(out))


def test_nothing(spark, tmp_path):
    assert ST.list_tree(spark, grown(tmp_path, {"a/.x": ""}), "*.md").count() == 0
    ST.write_documents(spark.createDataFrame([], "path string, content string"), str(tmp_path / "o"))
    assert (tmp_path / "o" / "_SUCCESS").exists()
