"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of (term, weight).  Candidates are cut into blocks, each
with one postings list per term; queries are cut into blocks too.  For a pair of
blocks, each query takes its terms one at a time and scatters its weight times
the posted weights into a dense array of scores, one cell per candidate.  The
best k of the array are selected by partition, and the blocks' winners merge.

Every pair of blocks is a row of its own, spread over tasks; a task holds one
block of candidates, one of queries and one score array, whatever the table
holds.  Queries are joined by block number, not broadcast or collected.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; vectors of unequal length share the terms that both have; empty
vectors score 0; a query is not its own candidate, a repeated id is none of its
namesakes' candidates either; ties go to the smaller id; identical rows appear
once.  Rows with a null id take no part.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CANDIDATES = 8192
QUERIES = 1024


def quantised(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def packed(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Blocks of up to ``size`` rows of (id, weights): ids, lengths of the rows, and all weights as bytes."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = [], []
        for frame in frames:
            for key, vector in zip(frame["id"], frame["weights"], strict=True):
                ids.append(key)
                vectors.append(np.asarray(vector, np.int64))
                if len(ids) == size:
                    yield one(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield one(ids, vectors)

    def one(ids, vectors):
        columns = (np.array(ids, np.int64), np.array([len(v) for v in vectors], np.int32), np.concatenate(vectors))
        return pd.DataFrame({f"{prefix}_{name}": [value.tobytes()] for name, value in zip(("ids", "lengths", "weights"), columns, strict=True)})

    return rows.mapInPandas(pack, f"{prefix}_ids binary, {prefix}_lengths binary, {prefix}_weights binary")


def postings(lengths: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term the rows that have it with a weight other than 0, and those weights."""
    starts = np.concatenate(([0], np.cumsum(lengths[:-1], dtype=np.int64))) if len(lengths) else np.zeros(0, np.int64)
    out = []
    for term in range(int(lengths.max(initial=0))):
        have = np.flatnonzero(lengths > term)
        value = weights[starts[have] + term]
        have, value = have[value != 0], value[value != 0]
        out.append((slice(None) if len(have) == len(lengths) else have, value))
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, skip: int, k: int, copies: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids, found by partition; equal pairs of id and score count once.

    No id may occur more than ``copies`` times: k pairs then lie among the k * copies best.
    """
    rest, wide = np.flatnonzero(ids != skip), k * copies
    if len(rest) > wide:
        least = np.partition(scores[rest], len(rest) - wide)[len(rest) - wide]
        rest = rest[scores[rest] >= least]
    rest = rest[np.lexsort((ids[rest], -scores[rest]))]
    if copies > 1 and len(rest):
        rest = rest[np.concatenate(([True], (ids[rest[1:]] != ids[rest[:-1]]) | (scores[rest[1:]] != scores[rest[:-1]])))]
    return ids[rest[:k]], scores[rest[:k]]


def accumulated(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Score each pair of blocks, one row at a time."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            ids = np.frombuffer(row.c_ids, np.int64)
            copies = int(np.unique(ids, return_counts=True)[1].max(initial=1))
            lists = postings(np.frombuffer(row.c_lengths, np.int32), np.frombuffer(row.c_weights, np.int64))
            queries, lengths = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_lengths, np.int32)
            weights, at, out = np.frombuffer(row.q_weights, np.int64), 0, []
            scores, term_scores = np.zeros(len(ids), np.int64), np.empty(len(ids), np.int64)
            for query, length in zip(queries, lengths, strict=True):
                scores[:] = 0
                for term in np.flatnonzero(weights[at : at + length]):
                    if term < len(lists):
                        have, posted = lists[term]
                        if isinstance(have, slice):
                            np.multiply(posted, weights[at + term], out=term_scores)
                            scores += term_scores
                        else:
                            scores[have] += posted * weights[at + term]
                at += length
                found, value = best_of(scores, ids, query, k, copies)
                out.append((np.full(len(found), query), found, value))
            yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERIES, candidate_block: int = CANDIDATES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for two tables of ``id`` (long) and ``weights`` (array of long)."""
    spark = candidates.sparkSession
    count = queries.count()
    blocks = max(1, -(-count // query_block))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    salts = -(-tasks // blocks)
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # one block of queries per number and sub-block, repeated once per salt: a small multiple of the tasks
    parts = numbered.repartition(blocks, "block").sortWithinPartitions("block", "id").select("id", "weights")
    left = packed(parts, query_block, "q").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = packed(candidates.select("id", "weights"), candidate_block, "c")
    right = right.withColumn("_block", F.pmod(F.xxhash64("c_ids"), F.lit(salts)).cast("int"))
    pairs = right.join(left, "_block").drop("_block")
    won = pairs.mapInPandas(lambda frames: accumulated(frames, k), "query_id long, vec_id long, score long").distinct()
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return won.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def vector_rows(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Quantised rows of a table of vectors."""
    return vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(embedding), scale).alias("weights"))
