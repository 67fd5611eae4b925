"""User-defined handlers of fenced blocks and images, and a sample handler."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .structure import fenced_blocks


@dataclass(frozen=True)
class Handler:
    """``match`` tells whether a row is the handler's, ``transform`` gives its output.

    Both take the block's or image's columns by name and may use a Pandas UDF.
    """

    name: str
    match: Callable[[], Column]
    transform: Callable[[], Column]


def apply_handlers(rows: DataFrame, handlers: Sequence[Handler]) -> DataFrame:
    """The first handler that matches transforms the row; rows without one keep NULL."""
    name, output = F.lit(None).cast("string"), F.lit(None).cast("string")
    for handler in reversed(handlers):
        name = F.when(handler.match(), F.lit(handler.name)).otherwise(name)
        output = F.when(handler.match(), handler.transform()).otherwise(output)
    return rows.withColumns({"handler": name, "output": output})


def class_edges(documents: DataFrame) -> DataFrame:
    """Inheritance edges ``(path, pos, seq, parent, child)`` of class diagrams."""
    pattern = r"(?m)^[ \t]*(\w+)[ \t]*<\|--[ \t]*(\w+)[ \t]*$"
    body = F.regexp_replace("content", r"(?sm)\A---\n(.+?)^---(?:\n|\z)", "")
    diagrams = fenced_blocks(documents).withColumn("diagram", body).where((F.col("lang") == "mermaid") & F.col("diagram").startswith("classDiagram"))
    pairs = F.arrays_zip(
        F.regexp_extract_all("diagram", F.lit(pattern), F.lit(1)).alias("parent"),
        F.regexp_extract_all("diagram", F.lit(pattern), F.lit(2)).alias("child"))
    return diagrams.select("path", "pos", F.posexplode(pairs).alias("seq", "e")).select("path", "pos", "seq", "e.parent", "e.child")


def class_tree(edges: DataFrame) -> DataFrame:
    """Nodes of each diagram with depth and the chain of names from the root.

    Each round appends one generation and is made durable; a diagram is one block
    of one document, so rounds are few.  A class never appears below itself.
    """
    keys = ["path", "pos"]
    edges = durable(edges)
    roots = edges.select(*keys, F.col("parent").alias("node")).distinct().join(
        edges.select(*keys, F.col("child").alias("node")), [*keys, "node"], "left_anti")
    level = durable(roots.select(*keys, "node", F.array("node").alias("chain")))
    generations = [level]
    while True:
        below = level.withColumnRenamed("node", "parent").join(edges, [*keys, "parent"]).where(~F.array_contains("chain", F.col("child")))
        level = durable(below.select(*keys, F.col("child").alias("node"), F.array_append("chain", F.col("child")).alias("chain")))
        if level.isEmpty():
            break
        generations.append(level)
    tree = reduce(DataFrame.unionByName, generations)
    return tree.select(*keys, "node", (F.size("chain") - 1).alias("depth"), F.array_join("chain", "/").alias("chain"))
