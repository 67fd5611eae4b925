"""Files in, files out, and the incremental job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.sources import corpus as SC
from docloom.sources import snapshot as SN
from docloom.streaming import incremental as INC


@pytest.fixture
def tree(tmp_path):
    for name, text in {"index.md": "# Top", "a/doc.md": "# Döc", "a/ignore.txt": "*.tmp\n!x.tmp", "a/pic.png": "x"}.items():
        file = tmp_path / "src" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text, encoding="utf-8")
    return tmp_path / "src"


def test_scan(spark, rows, tree):
    assert rows(SC.scan_corpus(spark, str(tree))) == {("index.md", "", "index.md", "# Top"), ("a/doc.md", "a", "doc.md", "# Döc")}
    assert rows(SC.scan_single(spark, str(tree / "a" / "doc.md"))) == {("doc.md", "", "doc.md", "# Döc")}
    assert rows(SC.scan_rules(spark, str(tree), "ignore.txt")) == {("a", 0, "*.tmp"), ("a", 1, "!x.tmp")}
    assert rows(SC.scan_files(spark, str(tree)), "path") >= {("a/pic.png",)}


def test_write(spark, rows, tree, tmp_path):
    SC.write_corpus(SC.scan_corpus(spark, str(tree)).withColumn("content", F.upper("text")), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "out_path", "content") == {("index.csf", "# TOP"), ("a/doc.csf", "# DÖC")}


def test_properties_file(spark, tmp_path):
    good, bad = tmp_path / "p.json", tmp_path / "b.json"
    good.write_text('{"editor": "v2", "n": 1}')
    bad.write_text("[1, 2]")
    assert SC.load_properties(spark, str(good)) == {"editor": "v2", "n": "1"}
    with pytest.raises(ValueError):
        SC.load_properties(spark, str(bad))


def test_inject_ids(spark):
    texts = {"plain": "body", "front": "---\ntitle: T\n---\nbody", "comment": "<!--\ntitle: T\n-->\nbody", "open": "---\nnever closed"}
    docs = spark.createDataFrame(list(texts.items()), "path string, text string")
    index = spark.createDataFrame([(p, "7", "S", True, True) for p in texts], "path string, page_id string, space_key string, newly boolean, synchronized boolean")
    got = {r.path: (r.new_text, r.unclosed) for r in SC.inject_ids(docs, index).collect()}
    ids = "<!-- page-id: 7 -->\n<!-- space-key: S -->\n"
    assert got == {
        "plain": (ids + "body", False), "front": ("---\ntitle: T\n---\n" + ids + "\nbody", False),
        "comment": ("<!--\ntitle: T\n-->\n" + ids + "\nbody", False), "open": ("---\nnever closed", True)}


def test_snapshot_ignores_extra_fields(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.json").write_text('{"page_id": "1", "name": "x", "prefix": "global", "id": "9", "extra": true}\n')
    assert SN.load_snapshot(spark, str(tmp_path), "labels", "json").collect()[0].asDict() == {"page_id": "1", "name": "x", "prefix": "global", "id": "9"}


def test_incremental_sync(spark, rows, tmp_path):
    source, state, plans, check = (str(tmp_path / n) for n in ("in", "state", "plans", "check"))

    def arrive(*docs):
        data = [(p, t, dt.datetime(2024, 1, day)) for p, t, day in docs]
        spark.createDataFrame(data, INC.DOCUMENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(INC.DOCUMENT_SCHEMA).parquet(source)
        INC.incremental_sync(stream, state, plans, check).awaitTermination()

    arrive(("a", "1", 1), ("a", "2", 2), ("b", "1", 1))
    run()
    assert rows(spark.read.parquet(plans + "/batch=0"), "path", "action", "page_version") == {("a", "create", 1), ("b", "create", 1)}
    arrive(("a", "2", 3), ("b", "9", 4), ("c", "1", 1))
    run()
    assert rows(spark.read.parquet(plans + "/batch=1"), "path", "action", "page_version") == {("a", "unchanged", 1), ("b", "update", 2), ("c", "create", 1)}
    arrive(("b", "0", 2))
    run()
    assert rows(spark.read.parquet(plans + "/batch=2"), "path", "action") == {("b", "stale")}
    assert rows(INC.read_state(spark, state, 3), "path", "page_version") == {("a", 1), ("b", 2), ("c", 1)}
    # A batch that runs again gives the same plan and state.
    batch = spark.createDataFrame([("b", "0", dt.datetime(2024, 1, 2))], INC.DOCUMENT_SCHEMA)
    replayed = INC.plan_batch(batch, INC.read_state(spark, state, 2))
    assert rows(INC.advance_state(INC.read_state(spark, state, 2), replayed)) == rows(INC.read_state(spark, state, 3))
