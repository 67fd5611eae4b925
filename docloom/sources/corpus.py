"""Reading and writing document trees."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frontmatter import front_tree
from ..functions.text import unified_lines
from .tree import list_tree, read_contents, with_location


def scan_corpus(spark: SparkSession, root: str, glob: str = "*.md", ignore_file: str = "") -> DataFrame:
    """``(path, dir, name, text)`` of every file below ``root``; paths are relative to it, lines end in a line feed.

    Names may start with an underscore; those that start with a dot are passed over, and so is what the lists named ``ignore_file`` exclude.
    """
    contents = read_contents(list_tree(spark, root, glob, ignore_file), root)
    return with_location(contents.select("path", unified_lines(F.decode("content", "UTF-8")).alias("text")))


def scan_single(spark: SparkSession, file: str) -> DataFrame:
    """One document; its own directory is the root."""
    root, _, name = file.rpartition("/")
    one = spark.createDataFrame([(name,)], "path string")
    return with_location(read_contents(one, root or "/").select("path", unified_lines(F.decode("content", "UTF-8")).alias("text")))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size)`` of all files, hidden ones included; the content is not read."""
    return list_tree(spark, root, hidden=True).select("path", "size")


def scan_rules(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """``(base_dir, line_no, pattern)`` of the ignore lists in a tree; their name may start with a dot."""
    lists = with_location(read_contents(list_tree(spark, root, file_name), root))
    lines = F.split(unified_lines(F.decode("content", "UTF-8")), "\n")
    return lists.select(F.col("dir").alias("base_dir"), F.posexplode(lines).alias("line_no", "pattern"))


def load_properties(spark: SparkSession, file: str) -> dict:
    """Global properties: a small dictionary in JSON or YAML, given to operators as literals; single values are texts, nested ones keep their types."""
    rows = spark.read.text(file, wholetext=True).select(front_tree(unified_lines(F.col("value"))).alias("tree")).select("tree.json", "tree.error").take(1)
    if not rows or rows[0]["error"] is not None or not (rows[0]["json"] or "").startswith("{"):
        raise ValueError("expected: a dictionary of properties" + (f" ({rows[0]['error']})" if rows and rows[0]["error"] else ""))
    return {key: value if isinstance(value, (dict, list, str)) or value is None else json.dumps(value) for key, value in json.loads(rows[0]["json"]).items()}


def output_path(path: Column, ending: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", ""), F.lit(ending))


def write_corpus(documents: DataFrame, out: str, ending: str = ".csf") -> None:
    """Write ``(path, dir, content)`` with the source's directories as partitions and the suffix replaced.

    Rows of one directory may be most of the data, so files are cut by row
    count and not gathered by directory.
    """
    rows = documents.select("dir", output_path(F.col("path"), ending).alias("out_path"), "content")
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy("dir").parquet(out)


def inject_ids(documents: DataFrame, index: DataFrame, prefix: str = "") -> DataFrame:
    """Text with page-id and space-key directives, at the top or just after the front-matter.

    Applies to documents that got their page in this run (``newly``) and are
    synchronised.  A front-matter block that is never closed is left alone and flagged.
    """
    lead = prefix + "-" if prefix else ""
    comments = F.concat(
        F.lit(f"<!-- {lead}page-id: "), F.col("page_id"), F.lit(f" -->\n<!-- {lead}space-key: "), F.col("space_key"), F.lit(" -->"))
    text = F.col("text")
    dashed, commented = text.startswith("---\n"), text.startswith("<!--\n")
    # Where the closing delimiter of the front-matter starts, 0 if nowhere.
    close = F.when(dashed, F.locate("\n---\n", text, 5)).when(commented, F.locate("\n-->\n", text, 6))
    cut = F.when(close > 0, close + 3)
    fronted = F.concat_ws("\n", F.substring(text, F.lit(1), cut), comments, F.substring(text, cut + 1, F.length(text)))
    new_text = F.when(~dashed & ~commented, F.concat_ws("\n", comments, text)).when(close > 0, fronted).otherwise(text)
    chosen = index.where("newly AND synchronized").select("path", "page_id", "space_key")
    joined = documents.select("path", "text").join(chosen, "path")
    return joined.select("path", new_text.alias("new_text"), (close == 0).alias("unclosed")).fillna(False, ["unclosed"])
