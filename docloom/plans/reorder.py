"""Minimum moves that bring the children of each page into source order."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import salted_join
from .ranking import positions

_MOVE_SCHEMA = "parent string, first_rank int, last_rank int, position string, ref_rank int, per_item boolean"


def current_and_target(children: DataFrame) -> DataFrame:
    """Dense current position and target rank of ``(parent, item, current, desired)`` rows.

    Items without a desired place take no part; equal ones keep their current order.
    """
    shared = children.where("desired IS NOT NULL")
    placed = positions(shared, ["parent"], [F.col("current"), F.col("item")], "pos")
    return positions(placed, ["parent"], [F.col("desired"), F.col("pos")], "rank")


def reorder_plan(children: DataFrame) -> DataFrame:
    """``(parent, item, position, ref, seq)``: one move per child that cannot stay.

    A longest increasing run of ranks stays in place.  Children that follow one
    another both now and in the target form a block that stays or moves as a
    whole, so the search sees blocks, not children: its input grows with the
    disorder of a page, not with the number of its children.
    """
    ranked = current_and_target(children)
    before = ranked.select("parent", (F.col("pos") + 1).alias("pos"), (F.col("rank") + 1).alias("rank"))
    after = ranked.select("parent", (F.col("pos") - 1).alias("pos"), (F.col("rank") - 1).alias("rank"))
    place = ranked.select("parent", "pos", "rank")
    keys = ["parent", "pos", "rank"]
    starts = place.join(before, keys, "left_anti").withColumn("is_start", F.lit(True))
    ends = place.join(after, keys, "left_anti").withColumn("is_start", F.lit(False))
    edges = starts.unionByName(ends)
    # A page in order is a single block that starts at 0 both ways and has nothing to move.
    disordered = edges.where("is_start AND pos <> rank").select("parent").distinct()
    blocks = edges.join(disordered, "parent", "left_semi")
    moves = blocks.groupBy("parent").applyInPandas(_moves_of_page, _MOVE_SCHEMA)
    moved = moves.withColumn("rank", F.explode(F.sequence("first_rank", "last_rank")))
    moved = moved.withColumn("ref_rank", F.when(F.col("per_item"), F.col("rank") - 1).otherwise(F.col("ref_rank")))
    items = ranked.select("parent", "rank", "item")
    refs = items.select("parent", F.col("rank").alias("ref_rank"), F.col("item").alias("ref"))
    plan = salted_join(moved.join(items, ["parent", "rank"]), refs, ["parent", "ref_rank"], F.col("item"), "inner")
    return plan.select("parent", "item", "position", "ref", F.col("rank").alias("seq"))


def _moves_of_page(edges: pd.DataFrame) -> pd.DataFrame:
    """Which blocks of one page move, and next to what."""
    edges = edges.sort_values(["pos", "is_start"], ascending=[True, False])
    first = edges.loc[edges.is_start, "rank"].to_numpy()
    last = edges.loc[~edges.is_start, "rank"].to_numpy()
    kept = heaviest_increasing(first, last)
    by_rank = np.argsort(first)
    rows, anchor = [], None
    for b in by_rank[::-1]:
        if kept[b]:
            anchor = first[b]
        elif anchor is not None:
            rows.append((first[b], last[b], "before", anchor, False))
        else:
            rows.append((first[b], last[b], "after", -1, True))
    out = pd.DataFrame(rows, columns=["first_rank", "last_rank", "position", "ref_rank", "per_item"])
    out.insert(0, "parent", edges["parent"].iloc[0])
    return out


def heaviest_increasing(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of blocks, in current order, whose ranks increase and that hold the most children.

    ``frontier`` maps a last rank to the heaviest chain that ends there, keeping
    only chains that no chain with smaller last rank outweighs: ranks and weights
    both increase, so the best predecessor of a block is found by bisection.
    """
    ranks: list[int] = []
    weights: list[int] = []
    ends: list[int] = []
    previous = np.full(len(first), -1, dtype=np.int64)
    for b, (low, high) in enumerate(zip(first.tolist(), last.tolist())):
        at = bisect_left(ranks, low)
        weight = high - low + 1
        if at:
            previous[b] = ends[at - 1]
            weight += weights[at - 1]
        at = bisect_left(ranks, high)
        stop = bisect_right(weights, weight, lo=at)
        if at == 0 or weights[at - 1] < weight:
            ranks[at:stop], weights[at:stop], ends[at:stop] = [high], [weight], [b]
    kept = np.zeros(len(first), dtype=bool)
    b = ends[-1] if ends else -1
    while b >= 0:
        kept[b] = True
        b = previous[b]
    return kept


def apply_moves(current: DataFrame, plan: DataFrame) -> DataFrame:
    """Positions after a plan: ``current(parent, item, current)`` with moves relative to siblings.

    Each move names its neighbour in the final order.  Moved items are placed by
    following their references to an item that stays: ``before`` moves keep
    their sequence in front of it, ``after`` moves trail behind it.
    """
    moves = plan.select("parent", "item", "position", "ref", "seq")
    stay = current.join(moves.select("parent", "item"), ["parent", "item"], "left_anti")
    fixed = stay.select("parent", "item", F.col("current").alias("anchor"), F.lit(0).alias("side"), F.lit(0).alias("seq"))
    at = stay.select("parent", F.col("item").alias("ref"), F.col("current").alias("anchor"))
    ahead = salted_join(moves.where("position = 'before'"), at, ["parent", "ref"], F.col("item"), "inner").select("parent", "item", "anchor", F.lit(-1).alias("side"), "seq")
    # Everything moved "after" follows the last kept item of its page, one behind the other.
    tail = stay.groupBy("parent").agg(F.max("current").alias("anchor"))
    behind = salted_join(moves.where("position = 'after'"), tail, ["parent"], F.col("item"), "inner").select("parent", "item", "anchor", F.lit(1).alias("side"), "seq")
    placed = fixed.unionByName(ahead).unionByName(behind)
    return positions(placed, ["parent"], [F.col("anchor"), F.col("side"), F.col("seq"), F.col("item")]).select("parent", "item", "position")


def append_moves(current: DataFrame, moves: DataFrame) -> DataFrame:
    """Positions after children move to the end of another page: ``moves(item, new_parent)``."""
    joined = current.join(moves, "item", "left")
    placed = joined.select(
        F.coalesce("new_parent", "parent").alias("parent"), "item",
        F.col("new_parent").isNotNull().alias("appended"), "current")
    return positions(placed, ["parent"], [F.col("appended"), F.col("current"), F.col("item")]).select("parent", "item", "position")
