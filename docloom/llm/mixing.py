"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source has a target in words.  Its documents lie in blocks: hash groups of
about equal size, and one block for each document that is larger than such a
group.  The quota of a source is the set of blocks that fills its target: whole
copies of all blocks first, then blocks in permuted order as they fit; of one
last block only some documents are drawn, the largest that fit first.

The drawn blocks of all sources are dealt out to output shards of equal size by
a tree: a node holds one quota per source, and the quotas of its left half are a
draw from the multivariate hypergeometric distribution, so that every leaf is a
random mixture and all leaves add up to the quotas.  A node also carries how many
permuted blocks of each source lie before it, so leaves own disjoint stretches of
the permutations.  Inside a shard, documents are ordered by a hash.

Sizes: a task holds one row per source (targets, root of the tree), or one
row per block of a source: ``blocks`` of them, and more only where a block would
exceed ``block_words``, or the documents of one block.  No text is shuffled
before the mix itself is written.

Targets: sources in order of code points, null last, weigh ``weights`` in
turn and share all words; a target stops at ``most`` times the size of its source and
the excess goes to the others by weight.

Defined results: the size of a text is its number of words, null and empty texts have
0; a source without words has the target 0; rows with equal id and text share a
block; equal hashes order ties; null ids are ids like others; an empty table
gives an empty table.  The results depend on the rows alone, not on their order.
Columns of the input that the operator does not read are left out of ``placements``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import salted_join
from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS = 1024
BLOCK_WORDS = 16 << 20
SHARD_BLOCKS = 64
SUBTREES = 64


class Plan(NamedTuple):
    """Targets per source, the drawn copies of whole blocks with their shards, and the blocks that are drawn in part."""

    sources: DataFrame
    drawn: DataFrame
    cut: DataFrame


def water_levels(sizes: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Shares of all words by weight, none above ``most`` times its size."""
    caps, free = most * sizes.astype(float), np.ones(len(sizes), bool)
    out = caps.copy()
    while free.any():
        level = (sizes.sum() - caps[~free].sum()) / weights[free].sum()
        over = free & (weights * level > caps)
        if not over.any():
            out[free] = weights[free] * level
            break
        free &= ~over
    return out


def targets(sized: DataFrame, weights: tuple[int, ...], most: int, blocks: int, block_words: int) -> DataFrame:
    """One row per source: its rank, size, target, whole copies, words left for a last copy, and how it is cut into blocks."""

    def share(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank").reset_index(drop=True)
        sizes = frame["source_size"].to_numpy(np.int64)
        target = water_levels(sizes, np.resize(np.array(weights, float), len(frame)), most)
        copies = np.minimum(most, np.floor(target / np.maximum(1, sizes))).astype(np.int64)
        frame["target"], frame["copies"], frame["rest"] = target, copies, np.where(copies < most, target - copies * sizes, 0.0)
        frame["blocks"] = np.maximum(blocks, -(-sizes // block_words))
        frame["heavy"] = sizes // frame["blocks"]
        return frame

    ranked = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    # byte order of UTF-8 is the order of code points; a task sorts one short row per source
    listed = ranked.agg(F.array_sort(F.collect_list(F.struct("none", "source", "source_size"))).alias("rows"))
    ranked = listed.select(F.posexplode("rows").alias("rank", "row")).select("rank", "row.source", "row.source_size")
    schema = "rank int, source string, source_size long, target double, copies long, rest double, blocks long, heavy long"
    return ranked.groupBy().applyInPandas(share, schema)


def chosen_blocks(rank: int, block: np.ndarray, words: np.ndarray, copies: int, rest: float, seed: int) -> pd.DataFrame:
    """The drawn blocks of a source in permuted order: ``block, copy, part`` where ``part`` is the words to draw of a block that is cut."""
    order = np.argsort(block, kind="stable")
    rng = np.random.default_rng([seed, rank])
    order = order[rng.permutation(len(order))]
    taken, skipped, left = [], [], rest
    for i in order if rest > 0 else ():
        if words[i] <= left:
            taken.append(i)
            left -= words[i]
        else:
            skipped.append(i)
    part = [np.nan] * len(taken)
    if left > 0 and skipped:
        groups = [i for i in skipped if block[i] >= 0]
        nearest = min(skipped, key=lambda i: words[i])
        if groups:
            taken, part = [*taken, groups[0]], [*part, left]
        elif words[nearest] < 2 * left:
            taken, part = [*taken, nearest], [*part, np.nan]
    whole = np.repeat(np.arange(copies), len(order))
    out = pd.DataFrame({
        "rank": rank, "block": block[np.concatenate([np.tile(order, copies), np.array(taken, np.int64)]).astype(np.int64)],
        "copy": np.concatenate([whole, np.full(len(taken), copies)]).astype(np.int32), "part": np.concatenate([np.full(len(whole), np.nan), np.array(part, float)])})
    return out.assign(place=rng.permutation(len(out)).astype(np.int64))


def split(quotas: np.ndarray, before: np.ndarray, first: int, shards: int, size, seed: int, stop: int):
    """Halve a node's shards until at most ``stop`` are left: ``(first shard, shards, quotas, blocks before)``.

    ``size(a, b)`` is the number of blocks in the shards a to b.
    """
    todo = [(quotas, before, first, shards)]
    while todo:
        quotas, before, first, shards = todo.pop()
        if shards <= stop:
            yield first, shards, quotas, before
            continue
        half, have = shards // 2, np.flatnonzero(quotas)
        left = np.zeros_like(quotas)
        rng = np.random.default_rng([seed, first, shards])
        left[have] = rng.multivariate_hypergeometric(quotas[have], size(first, first + half), method="marginals")
        todo += [(quotas - left, before + left, first + half, shards - half), (left, before, first, half)]


def dealt(drawn: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """The drawn blocks with their ``shard``."""
    quotas = drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("quota"))
    everything = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    shards = max(1, -(-everything // shard_blocks))
    size = lambda a, b: b * everything // shards - a * everything // shards

    def rows(frame: pd.DataFrame, first: int, count: int, stop: int) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        ranks, out = frame["rank"].to_numpy(), []
        for at, n, quota, before in split(frame["quota"].to_numpy(np.int64), frame["before"].to_numpy(np.int64), first, count, size, seed, stop):
            have = np.flatnonzero(quota)
            out.append(pd.DataFrame({"first": at, "shards": n, "rank": ranks[have], "quota": quota[have], "before": before[have]}))
        return pd.concat(out)

    schema = "first long, shards long, rank int, quota long, before long"
    root = quotas.withColumn("before", F.lit(0).cast("long"))
    nodes = root.groupBy().applyInPandas(lambda frame: rows(frame, 0, shards, -(-shards // SUBTREES)), schema)
    leaves = nodes.groupBy("first", "shards").applyInPandas(lambda frame: rows(frame, int(frame["first"].iloc[0]), int(frame["shards"].iloc[0]), 1), schema)
    places = leaves.select("rank", F.explode(F.expr("sequence(before, before + quota - 1)")).alias("place"), F.col("first").alias("shard"))
    return drawn.join(places, ["rank", "place"])


def measured(docs: DataFrame, doc_id: str, text: str, source: str, *more) -> DataFrame:
    """Source, size and a hash of each document."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), F.xxhash64(doc_id, text).alias("key"), *more)


def in_blocks(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the rank of their source and their block: a hash group, or a number below 0 for a heavy document."""
    none = F.col("source").isNull()
    left = sized.withColumns({"_name": F.coalesce("source", F.lit("")), "_none": none})
    right = sources.select(F.coalesce("source", F.lit("")).alias("_name"), none.alias("_none"), "rank", "source_size", "target", "copies", "rest", "blocks", "heavy")
    alone = F.when(F.col("key") < 0, F.col("key")).otherwise(-F.col("key") - 1)
    block = F.when(F.col("size") > F.col("heavy"), alone).otherwise(F.pmod("key", "blocks"))
    return salted_join(left, right, ["_name", "_none"], F.col("key"), "inner").withColumn("block", block).drop("_name", "_none", "blocks", "heavy")


def plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, blocks: int = BLOCKS, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11) -> Plan:
    """What to draw of each source, and where to."""
    sources = stored(targets(sized, weights, most, blocks, block_words), "mix-sources")
    table = in_blocks(sized, sources).groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("copies").alias("copies"), F.first("rest").alias("rest"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        return chosen_blocks(int(frame["rank"].iloc[0]), frame["block"].to_numpy(np.int64), frame["words"].to_numpy(np.int64), int(frame["copies"].iloc[0]), float(frame["rest"].iloc[0]), seed)

    drawn = stored(table.groupBy("rank").applyInPandas(choose, "rank int, block long, copy int, part double, place long"), "mix-drawn")
    drawn = stored(dealt(drawn, shard_blocks, seed), "mix-shards")
    part = F.when(~F.isnan("part"), F.col("part"))
    whole = drawn.where(part.isNull()).groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("draws"))
    return Plan(sources, stored(whole, "mix-blocks"), drawn.where(part.isNotNull()).select("rank", "block", part.alias("part"), F.struct("copy", "shard").alias("more")))


def placed(sized: DataFrame, made: Plan) -> DataFrame:
    """Add ``source_size, target, draws``: one entry ``(copy, shard)`` per time that a document is drawn."""
    found = in_blocks(sized, made.sources).drop("copies", "rest")
    found = found.join(made.drawn, ["rank", "block"], "left").join(made.cut, ["rank", "block"], "left")
    draws = F.coalesce("draws", F.array().cast("array<struct<copy:int,shard:long>>"))
    found = found.withColumn("draws", draws)
    columns = [c for c in found.columns if c not in ("part", "more")]

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        left, last, chosen = float(frame["part"].iloc[0]), None, []
        for i, size in enumerate(frame["size"]):
            if size <= left:
                chosen.append(i)
                left -= size
            else:
                last = i
        if last is not None and frame["size"][last] < 2 * left:
            chosen.append(last)
        frame["drawn"] = np.isin(np.arange(len(frame)), chosen)
        return frame

    parts = found.where("part IS NOT NULL")
    schema = parts.withColumn("drawn", F.lit(True)).schema
    filled = parts.groupBy("rank", "block").applyInPandas(fill, schema)
    extra = F.when(F.col("drawn"), F.concat("draws", F.array("more"))).otherwise(F.col("draws"))
    return found.where("part IS NULL").select(*columns).unionByName(filled.withColumn("draws", extra).select(*columns))


def placements(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, draws``; ``draws`` lists copies and their shards."""
    sized = stored(measured(docs, doc_id, text, source), "mix-sizes")
    return placed(sized, plan(sized, **options)).select("doc_id", "source", "size", "source_size", "target", "draws")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, **options) -> DataFrame:
    """The mix itself: ``shard, copy`` and the whole row as ``document``, shards together and shuffled inside."""
    sized = stored(measured(docs, doc_id, text, source), "mix-sizes")
    rows = placed(measured(docs, doc_id, text, source, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")), plan(sized, seed=seed, **options))
    drawn = rows.select("document", "key", F.inline("draws"))
    local = F.xxhash64("key", "copy", F.lit(seed))
    return drawn.repartition("shard").sortWithinPartitions("shard", local, "key", "copy").select("shard", "copy", "document")
