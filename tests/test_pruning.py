"""Columns that nobody reads are not computed; texts are cut into few tokens and searched once."""

import re

from pyspark.sql import functions as F

from docloom.functions import lookups as L
from docloom.functions import text as T
from docloom.operators import metadata as MD
from docloom.operators import references as RF
from docloom.operators import structure as S
from docloom.session import lazily
from docloom.sources import derived

TEXT = "---\ntitle: A\ntags: [x, y]\n---\n<!-- page-id: 7 -->\n# One\n\nsome text <!-- page-id: 8 -->\n"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, text=TEXT):
    return spark.createDataFrame([(1, "docs/a.md", "docs", "a.md", text)], "doc_id long, path string, dir string, name string, text string")


def test_headings_do_not_parse_front_matter(spark, rows):
    heads = S.headings(MD.scan(documents(spark)))
    assert "dash" not in plan_of(heads)
    assert rows(heads) == {("docs/a.md", 1, 1, "One")}


def test_texts_do_not_infer_titles(spark):
    props = S.titles(MD.properties(MD.scan(documents(spark))))
    assert "dash" not in plan_of(props.select("path", "body"))
    assert props.select("title", "page_id", "tags").first() == ("A", "7", ["x", "y"])


def test_keyed_properties_join(spark):
    props = MD.keyed(MD.properties(MD.scan(documents(spark))))
    pages = spark.createDataFrame([("7", "p")], "page_id string, page string")
    assert props.join(pages, "page_id").select("path", "page", "fm_title").collect() == [("docs/a.md", "p", "A")]


def test_lazy_column_is_evaluated_once(spark):
    df = lazily(spark.range(100), {"r": F.rand()}).withColumn("same", F.col("r") == F.col("r"))
    assert df.where("r > 0.5 AND r <= 0.5").count() == 0
    assert df.where("same").count() == 100


def test_first_directive_only(spark):
    out = MD.directives(documents(spark)).select("d_page_id", "rest").first()
    assert out["d_page_id"] == "7"
    assert out["rest"] == TEXT.replace("<!-- page-id: 7 -->", "")


def test_text_is_one_token(spark):
    text = "which of the fish has half a hoof! [a](b.md) https://x.org/ xhttp://y ftp:// end"
    tokens = spark.range(1).select(F.regexp_extract_all(F.lit(text), F.lit(rf"(?s){RF._TOKEN}"), F.lit(0)).alias("t")).first()["t"]
    assert "".join(tokens) == text
    assert tokens[:4] == ["which of the fish has half a hoof! ", "[", "a", "](b.md)"]
    assert "https://x.org/" in tokens and len(tokens) < 14


def test_trim_and_line_breaks(spark):
    assert all(re.fullmatch(r"\s", c) for c in L.SPACE_CHARACTERS)
    texts = [None, "", " ", L.SPACE_CHARACTERS, *[f"{c}a{c}b{c}" for c in L.SPACE_CHARACTERS + "​"]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = rf"\A[{L.SPACE}]+|[{L.SPACE}]+\z"
    got = df.select(T.strip(F.col("t")), F.regexp_replace("t", pattern, ""), T.rstrip(F.col("t")), F.regexp_replace("t", rf"[{L.SPACE}]+\z", "")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)
    breaks = ["a\r\nb", *[f"a{c}b" for c in "\r\x0b\f\x1c\x1d\x1e\x85  "]]
    lines = spark.createDataFrame([(t,) for t in breaks], "t string")
    assert {r[0] for r in lines.select(T.unify_newlines(F.col("t"))).collect()} == {"a\nb"}


def test_lines_are_cut_once(spark):
    df = spark.createDataFrame([("a\n\n![x](y.png)\n\nb",)], "t string")
    lines = df.select(S.paragraph_lines(F.col("t")).alias("x"))
    assert plan_of(lines).count("split(") == 1
    assert [tuple(r) for r in lines.first()["x"]] == [("a", True), ("", False), ("![x](y.png)", True), ("", False), ("b", True)]


def written(spark, folder, rows, parts):
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 3).alias("source"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text"))
    docs.repartition(parts).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_texts_of_the_corpus_are_not_shuffled(spark, tmp_path):
    folder = written(spark, tmp_path, 3200, 32)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.openCostInBytes": "16m", "spark.sql.files.maxPartitionBytes": "4m"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        docs = derived.corpus(spark, folder)
        plan = docs._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert docs.count() == 3200
    assert docs.where("name IN ('index.md', 'README.md') OR doc_id % 3 = 2").count() > 1000


def test_splits_without_rows_do_not_count_as_parts(spark, tmp_path):
    folder = written(spark, tmp_path, 4000, 1)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        table = derived.read_table(spark, folder, "documents")
        parts = table.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(parts) == spark.sparkContext.defaultParallelism and sum(n for _, n in parts) == 4000


def test_directives_do_not_split_the_text(spark):
    taken = MD.directives(documents(spark, "é <!-- space-key: S --> x <!-- page-id: 7 -->\n<!-- page-id: 7 --> y"))
    assert "split(" not in plan_of(taken)
    assert taken.select("d_page_id", "d_space_key", "rest").first() == ("7", "S", "é  x \n<!-- page-id: 7 --> y")
