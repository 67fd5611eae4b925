"""Exact duplicates by deterministic block naming, with DataFrame operations only.

White space is deleted and the rest cut into blocks of fixed size.  The distinct
blocks are sorted and numbered, so that a block has one integer name.  Adjacent
names of a document are paired, distinct pairs are sorted and named again, until
one name is left.  Equal names mean equal texts: names stand for contents, not
for hashes, so there are no collisions.

Documents whose length and 64-bit hash nobody shares are distinct from all
others before any block is named; only the rest is cut into blocks.  Names and
groups are counted with partial aggregation; a hot block or group is one row of
the lookup side and joins under skew handling.

Defined results: null text counts as empty, and empty texts are equal; rows with
a null id come after all ids; of rows that agree in everything one stays;
``doc_id`` ties cannot otherwise occur.  Columns of the input named as the
results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import stored

BLOCK = 2048
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
LAST = (1 << 63) - 1


def normalised(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "")


def named(distinct: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Number distinct keys in sorted order."""
    return distinct.repartitionByRange(*order).sortWithinPartitions(*keys).withColumn("_name", F.monotonically_increasing_id())


def identities(cut: DataFrame, block: int) -> DataFrame:
    """``_row, _level, _name`` for rows ``_row, _text``: equal level and name exactly where texts are equal."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("_text") / block), F.lit(1)).cast("int") - 1), lambda i: F.substring(F.col("_text"), i * block + 1, F.lit(block)))
    parts = cut.select("_row", F.posexplode(pieces).alias("_at", "_block"))
    names = named(parts.select("_block").distinct(), ["_block"], [F.substring("_block", 1, 32)])
    level = parts.join(names, "_block").select("_row", "_at", "_name")
    sizes = cut.select("_row", F.greatest(F.ceil(F.length("_text") / block), F.lit(1)).cast("int").alias("_count"))
    level = durable(level.join(sizes, "_row"))
    done, depth = level.where("_count = 1").select("_row", F.lit(0).alias("_level"), "_name"), 0
    level = level.where("_count > 1")
    while not level.isEmpty():
        depth += 1
        side = lambda k: F.max(F.when(F.col("_at") % 2 == k, F.col("_name")))
        pairs = level.groupBy("_row", (F.col("_at") / 2).cast("int").alias("_half"), ((F.col("_count") + 1) / 2).cast("int").alias("_halves"))
        pairs = pairs.agg(side(0).alias("_left"), F.coalesce(side(1), F.lit(-1)).alias("_right"))
        names = named(pairs.select("_left", "_right").distinct(), ["_left", "_right"], [F.col("_left"), F.col("_right")])
        level = durable(pairs.join(names, ["_left", "_right"]).select("_row", F.col("_half").alias("_at"), F.col("_halves").alias("_count"), "_name"))
        done = done.union(level.where("_count = 1").select("_row", F.lit(depth).alias("_level"), "_name"))
        level = level.where("_count > 1")
    return done


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Add ``keep_id, group_size, kept, text_sha256`` to every row.

    Of equal texts the row with the most code points before normalisation stays,
    then the one with the smallest id.
    """
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in RESULTS]).alias("_in"))
    rows = rows.withColumn("_text", normalised(f"_in.{text}")).withColumn("_size", F.length("_text")).withColumn("_hash", F.xxhash64("_text"))
    shared = durable(rows.groupBy("_size", "_hash").count().where("count > 1").select("_size", "_hash"))
    digest = F.sha2("_text", 256).alias("text_sha256")
    alone = rows.join(shared, ["_size", "_hash"], "left_anti").select(
        "_in.*", F.col(f"_in.{doc_id}").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    some = stored(rows.join(shared, ["_size", "_hash"], "left_semi").withColumn("_row", F.monotonically_increasing_id()), "block-rows")
    known = identities(some.select("_row", "_text"), block)
    best = F.struct((-F.length(F.coalesce(f"_in.{text}", F.lit("")))).alias("size"), F.coalesce(F.col(f"_in.{doc_id}").cast("long"), F.lit(LAST)).alias("id"), F.col("_row").alias("row"))
    grouped = durable(some.select("_row", best.alias("_best")).join(known, "_row"))
    groups = grouped.groupBy("_level", "_name").agg(F.min("_best").alias("_first"), F.count("*").alias("group_size"))
    decided = grouped.join(groups, ["_level", "_name"]).select("_row", F.expr(f"nullif(_first.id, {LAST}L)").alias("keep_id"), "group_size", (F.col("_first.row") == F.col("_row")).alias("kept"))
    return alone.unionByName(some.join(decided, "_row").select("_in.*", "keep_id", "group_size", "kept", digest))
