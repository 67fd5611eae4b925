"""Near duplicates by a T-occurrence search over word shingles.

Two documents are linked when the Jaccard similarity of their sets of word
shingles reaches the threshold.  A document with n shingles can only be linked
to one that shares at least T = ceil(threshold * n) of them.  The T - k longest
inverted lists of its shingles may therefore be left out of the merge: a partner
must occur in k of the n - T + k shorter ones.  Lists are ordered by a sketch of
how many documents have a shingle, then by hash; any fixed order is exact, a good
one keeps the merged lists short.

Across tasks, the shingles of these short lists are the keys that documents meet
by.  Inside a task, a query meets its candidates by DivideSkip: the longest lists
are set aside, the short ones are merged with a heap, and documents that occur
often enough are looked up in the long ones by binary search.

No group of similar documents is expanded into its pairs.  Equal sets are one
vertex.  In each round every list elects a leader among its documents, the
others are compared with it, and links found merge components.  What is left in
lists that still hold several components meets across components, so that no link
between different components is missed.  Documents carry the parities of hash
buckets of their elements: buckets in which two sets differ are at least as many
elements in one set only, which rules out most unlinked pairs where they meet.

Hot shingles are not collected in one task: rows of keys whose sketch bucket is
hot go through Spark's aggregation and skew-aware joins instead.

Defined results: texts without words have an empty set and no links; with fewer
words than a shingle the whole sequence is the one element; rows with a null id
have their number of shingles, no component and no links; rows that share an id
share a component; repeated rows appear each.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import BLOB, SKETCH_BITS, add_counts, blobs, blocks, count_rows, hot_buckets, joined, levels, mixed, prefix_polynomial, runs, slices, small_batches, smallest_labels, span_hashes, stored, summed_counts, unpacked, utf8

WORDS = 5
PERCENT = 75
MOST_MET = 16
#: Rounds in which the lists' leaders are compared, before the exhaustive one: so many at least and at most,
#: in between as long as one in ``WORTH`` of a round's comparisons is a link.
ROUNDS = 2
MOST_ROUNDS = 8
WORTH = 5
#: Longs of bucket parities (64 buckets each) of a set.
PARITIES = 4
#: Documents that one leader is compared with in one block, and elements of them that are held at once.
COMPARED = 256
HELD = 400_000
#: Up to so many ids (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
STEP = np.uint64(0xD6E8FEB86659FD93)
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts: first and last row, and rows (counted from the first) with their distinct shingles, sorted."""
    for start, end in blocks(texts):
        data, begins = joined(texts[start:end], b"\n")
        first, last = runs(WORD[data])
        word = mixed(span_hashes(prefix_polynomial(FOLDED[data]), first, last))
        sizes = np.diff(np.searchsorted(first, begins))
        row = np.repeat(np.arange(end - start), sizes)
        count = max(0, len(word) - words + 1)
        value = word[:count].copy()
        for j in range(1, words):
            value = value * STEP + word[j : j + count]
        inside = row[:count] == row[words - 1 : words - 1 + count]
        value, owner = mixed(value[inside]), row[:count][inside]
        few, at = np.flatnonzero((sizes > 0) & (sizes < words)), np.cumsum(sizes) - sizes
        if len(few):
            whole = []
            for r in few:
                h = np.full(1, sizes[r], np.uint64)
                for w in word[at[r] : at[r] + sizes[r]]:
                    h = h * STEP + w
                whole.append(mixed(h))
            order = np.argsort(np.concatenate([owner, few]), kind="stable")
            value, owner = np.concatenate([value, *whole])[order], np.concatenate([owner, few])[order]
        cuts = np.searchsorted(owner, np.arange(end - start + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                value[a:b].sort()
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        yield start, end, owner[new], value[new]


def set_marks(owner: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets and two sums that stand for their contents."""
    sizes, marks = np.bincount(owner, minlength=rows), np.zeros((2, rows), np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else []
    if len(starts):
        for k in (0, 1):
            marks[k, owner[starts]] = np.add.reduceat(mixed(value + np.uint64(k * 0x51ED2701 + 1)), starts)
    return sizes, marks[0], marks[1]


def set_parities(owner: np.ndarray, value: np.ndarray, rows: int, step: int = 1024) -> pa.Array:
    """For each set, whether the number of its elements in each hash bucket is odd, as ``PARITIES`` longs."""
    buckets, parts = 64 * PARITIES, [np.zeros((0, PARITIES), np.int64)]
    cuts = np.searchsorted(owner, np.arange(0, rows + step, step))
    for k, start in enumerate(range(0, rows, step)):
        here, size = slice(cuts[k], cuts[k + 1]), min(step, rows - start)
        at = (owner[here] - start) * buckets + (value[here] % np.uint64(buckets)).astype(np.int64)
        odd = (np.bincount(at, minlength=size * buckets) & 1).astype(np.uint8)
        parts.append(np.packbits(odd.reshape(size, buckets), axis=1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * PARITIES, pa.int32()), pa.array(np.concatenate(parts).ravel()))


def set_profiles(docs: DataFrame) -> DataFrame:
    """``_id, n, mark1, mark2, odd`` of each row of ``_id, _text``, and rows ``slice, counts`` of how many documents have a shingle."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches):
            for start, end, owner, value in shingle_sets(utf8(batch.column("_text"))):
                n, one, two = set_marks(owner, value, end - start)
                add_counts(counts, value)
                none = pa.nulls(end - start, pa.int32()), pa.nulls(end - start, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(start, end - start), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), set_parities(owner, value, end - start), *none], names)
        numbers, parts = count_rows(counts)
        none = [*[pa.nulls(len(numbers), pa.int64())] * 4, pa.nulls(len(numbers), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], names)

    names = ["_id", "n", "mark1", "mark2", "odd", "slice", "counts"]
    return docs.mapInArrow(profile, "_id long, n long, mark1 long, mark2 long, odd array<long>, slice int, counts binary")


def least_met(size: np.ndarray, percent: int) -> np.ndarray:
    """In how many of its short lists a partner must occur (k)."""
    return np.clip(-(-percent * size // 100) // 8, 1, MOST_MET)


def short_lists(owner: np.ndarray, value: np.ndarray, rows: int, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of the n - T + k shortest lists of each row: rows, shingles, places in the order, set sizes."""
    # values are sorted within rows: a stable sort by row and level is all that is missing
    order = np.argsort((owner << 5) | level[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    owner, value = owner[order], value[order]
    n = np.bincount(owner, minlength=rows)
    place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    kept = place < n[owner] - -(-percent * n[owner] // 100) + least_met(n[owner], percent)
    return owner[kept], value[kept], place[kept], n[owner[kept]]


MEMBERS = "token long, _id long, n int, mark long, place int"
ENTRY = ("token", "_id", "n", "mark", "place", "alone")


def members(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Documents of the short lists with more than one set: one row per list and set, the smallest id for it.

    Rows of hot shingles are spread over all partitions as they come and are grouped by Spark's aggregation.
    """
    level, hot = levels(counts), hot_buckets(counts) > 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, ids, parts = utf8(batch.column("_text")), batch.column("_id").to_numpy(), []
            for start, end, owner, value in shingle_sets(texts):
                mark = set_marks(owner, value, end - start)[1]
                row, token, place, n = short_lists(owner, value, end - start, level, percent)
                parts.append((token, mark[row], ids[start + row], (n.astype(np.int64) << 32) | place))
            if parts:
                token, mark, owner, extra = map(np.concatenate, zip(*parts, strict=True))
                is_hot = hot[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                bucket = np.where(is_hot, mixed(owner.astype(np.uint64)), token >> np.uint64(16)) % np.uint64(buckets)
                yield blobs(token, mark, owner, extra, bucket.astype(np.int64))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, mark, ids, extra = unpacked(batches)
        if len(token):
            begins = np.concatenate(([True], token[1:] != token[:-1]))
            starts = np.flatnonzero(begins)
            several = np.minimum.reduceat(mark, starts) != np.maximum.reduceat(mark, starts)
            some = several[np.cumsum(begins) - 1] | hot[(token >> np.uint64(48 - SKETCH_BITS)).astype(np.int64)]
            arrays = [pa.array(token[some].view(np.int64)), pa.array(ids[some]), pa.array((extra[some] >> 32).astype(np.int32)), pa.array(mark[some].view(np.int64)), pa.array((extra[some] & 0xFFFFFFFF).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["token", "_id", "n", "mark", "place"])

    dealt = docs.mapInArrow(deal, BLOB).repartition(partitions, "bucket").mapInArrow(shared, MEMBERS)
    return dealt.groupBy("token", "n", "mark").agg(F.min("_id").alias("_id"), F.min("place").alias("place"))


def divide_skip(query: np.ndarray, docs: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """How many of the query's elements each document has, or 0 where fewer than ``least``."""
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    elements = np.concatenate(docs) if docs else np.zeros(0, query.dtype)
    at = np.searchsorted(query, elements)
    hit = (at < len(query)) & (query[np.minimum(at, len(query) - 1)] == elements)
    owner, at = owner[hit], at[hit]
    order = np.lexsort((owner, at))
    lists = np.split(owner[order], np.cumsum(np.bincount(at, minlength=len(query)))[:-1])
    lists = sorted((x for x in lists if len(x)), key=len)
    total = np.zeros(len(docs), np.int64)
    if not lists:
        return total
    needed = int(least.min())
    skipped = min(needed - 1, len(lists), int(needed / (0.0085 * np.log2(max(2, len(lists[-1]))) + 1)))
    merged, probed = lists[: len(lists) - skipped], lists[len(lists) - skipped :]
    for doc, occurrences in groupby(heapq.merge(*[x.tolist() for x in merged])):
        total[doc] = sum(1 for _ in occurrences)
    near = np.flatnonzero((total > 0) & (total >= least - skipped))
    found = total[near]
    for long_list in probed:
        place = np.searchsorted(long_list, near)
        found += long_list[np.minimum(place, len(long_list) - 1)] == near
    total[:] = 0
    total[near] = np.where(found >= least[near], found, 0)
    return total


def least_overlap(one: int, other: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which 100 * intersection >= percent * union."""
    return np.maximum(1, -(-percent * (one + other) // (100 + percent)))


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are linked: leaders ``a`` with blocks of their documents ``b``.

    Whole texts of the documents in question move; a task turns them into sets again.
    """
    wanted = durable(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct())
    texts = stored(docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "_id", "left_semi").select("_id", "_text").distinct(), "compared")
    parts = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / COMPARED).cast("int").alias("_parts"))
    theirs = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "_parts").cast("int").alias("_part"), "b")
    theirs = theirs.join(texts.withColumnRenamed("_id", "b"), "b").select("a", "_part", F.lit(1).alias("_side"), "b", "_text")
    own = parts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    own = own.join(texts.withColumnRenamed("_id", "a"), "a").select("a", "_part", F.lit(0).alias("_side"), F.col("a").alias("b"), "_text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, ids, sets, held = None, [], [], [], 0

        def links():
            linked = []
            for query in queries if sets else []:
                sizes = np.array([len(d) for d in sets])
                overlap = divide_skip(query, sets, least_overlap(len(query), sizes, percent))
                linked += [ids[i] for i in np.flatnonzero(overlap)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(linked), pa.int64()), pa.array(linked, pa.int64())], ["a", "b"])

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("a", "_part", "_side", "b")]
            for start, end, owner, value in shingle_sets(utf8(batch.column("_text"))):
                cuts = np.searchsorted(owner, np.arange(end - start + 1))
                for r in range(start, end):
                    a, part, side, b = (c[r] for c in columns)
                    if (a, part) != key:
                        if key:
                            yield links()
                        key, queries, ids, sets, held = (a, part), [], [], [], 0
                    elements = value[cuts[r - start] : cuts[r - start + 1]]
                    if side == 0:
                        queries.append(elements)
                    else:
                        ids.append(b)
                        sets.append(elements)
                        held += len(elements)
                    if len(sets) >= 2 * COMPARED or held >= HELD:
                        yield links()
                        ids, sets, held = [], [], 0
        if key:
            yield links()

    sorted_ = own.union(theirs).repartition("a", "_part").sortWithinPartitions("a", "_part", "_side", "b")
    return sorted_.mapInArrow(compare, "a long, b long").distinct()


def linked_components(docs: DataFrame, profiles: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """``v, label`` for every vertex (smallest id of a set) that has a link."""
    spark = docs.sparkSession
    found = stored(members(docs, counts, percent), "short-lists")
    needed = lambda n: F.greatest(F.lit(1), F.least(F.lit(MOST_MET), F.floor(F.ceil(n * percent / 100) / 8)))
    length = lambda n: n - F.ceil(n * percent / 100) + needed(n)
    # elements of a set's short lists that no other set has in its own short lists; it may have them further on
    alone = found.groupBy("_id", "n", "mark").agg(F.first(length(F.col("n"))).alias("length"), F.count("*").alias("met"))
    # a partner has at least percent of the elements, and both meet in as many lists as the smaller one needs
    alone = alone.where(F.col("met") >= needed(F.ceil(F.col("n") * percent / 100)))
    alone = alone.select("_id", "n", "mark", F.greatest(F.col("length") - F.col("met"), F.lit(0)).cast("int").alias("alone"))
    # marks in lists have their upper 48 bits
    parities = profiles.select("_id", F.col("n").cast("int").alias("n"), F.shiftrightunsigned("mark1", 16).alias("mark"), "odd").distinct()
    vertices = stored(alone.join(parities, ["_id", "n", "mark"]), "vertices")
    lists = stored(found.join(vertices.drop("odd"), ["_id", "n", "mark"]).select(*ENTRY), "lists")
    edges = tried = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "v long, label long")

    # whether two sets can have the least overlap, if this is one of their first k meeting places
    def by_place(one: str, other: str, k):
        n, place, own = (F.col(one + c) for c in ("n", "place", "alone"))
        n2, place2, own2 = (F.col(other + c) for c in ("n", "place", "alone"))
        enough = (100 + percent) * (F.least(n - place, n2 - place2) + k - 1) >= percent * (n + n2)
        # with o common elements, at most n - o lone ones are in this set only; if the other has one of them behind its
        # short lists, all these come before it: at most n2 - o are not met here, and the others are not alone
        lone = lambda x, x2, y: (100 + percent) * (F.greatest(x, x2 + length(x) - length(x2)) - y) >= percent * (x + x2)
        return enough & lone(n, n2, own) & lone(n2, n, own2)

    # whether the parities of two sets differ in few enough buckets
    def by_parity(one: str, other: str):
        odd, odd2 = F.col(one + "odd"), F.col(other + "odd")
        differing = reduce(add, [F.bit_count(odd[i].bitwiseXOR(odd2[i])) for i in range(PARITIES)])
        return (100 + percent) * differing <= (100 - percent) * (F.col(one + "n") + F.col(other + "n"))

    def parities_of(side: str) -> DataFrame:
        return vertices.select(F.col("_id").alias(side), F.col("n").alias(f"{side}_n"), F.col("odd").alias(f"{side}_odd"))

    turn, last = 0, ROUNDS == 0
    while True:
        # components only grow: lists that lie in one of them stay out of all later rounds
        near = F.broadcast(labels) if turn and labels.count() <= BROADCAST_IDS else labels
        now = lists.join(near, lists["_id"] == near["v"], "left").select(*ENTRY, F.coalesce("label", "_id").alias("part")) if turn else lists.withColumn("part", F.col("_id"))
        open_ = now.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct(F.xxhash64("_id", F.lit(turn)).alias("h"), "_id", "n", "place", "alone", "part")).alias("lead")).where("low <> high")
        lists = stored(now.join(open_.select("token", "lead"), "token"), "open-lists")
        if not last:  # each list's leader against the rest
            met = lists.where(F.col("part") != F.col("lead.part")).where(by_place("", "lead.", F.lit(1)))
            met = met.groupBy(F.col("lead._id").alias("a"), F.col("_id").alias("b")).count()
            met = met.join(parities_of("a"), "a").join(parities_of("b"), "b").where(by_parity("a_", "b_"))
            # each document is compared with the leader of most of its lists
            met = met.groupBy("b").agg(F.max(F.struct("count", "a"))["a"].alias("a")).select("a", "b")
        else:  # whatever still lies in different components
            left = lists.drop("lead").join(vertices.select("_id", "n", "mark", "odd"), ["_id", "n", "mark"])
            right = left.select("token", *[F.col(c).alias(f"other_{c}") for c in ("_id", "n", "place", "alone", "odd", "part")])
            met = left.join(right, "token").where("part < other_part").withColumn("k", F.least(needed(F.col("n")), needed(F.col("other_n"))))
            met = met.where(by_place("", "other_", F.col("k")) & by_parity("", "other_")).groupBy(F.col("_id").alias("a"), F.col("other__id").alias("b"), "k").count().where("count >= k").select("a", "b").distinct()
        pairs = durable(met.join(tried, ["a", "b"], "left_anti"))
        linked = durable(verified(pairs, docs, percent))
        edges, tried = edges.union(linked), tried.union(pairs)
        merged = linked.count()
        if merged:
            labels = smallest_labels(spark, edges)
        if last:
            return labels
        turn += 1
        last = turn >= ROUNDS and (turn >= MOST_ROUNDS or merged * WORTH < pairs.count())
        lists = lists.select(*ENTRY)


def near_components(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    profiled = stored(set_profiles(plain), "set-profiles")
    counts = summed_counts(profiled.where("slice IS NOT NULL").select("slice", "counts"))
    profiles = profiled.where("slice IS NULL").select("_id", "n", "mark1", "mark2", "odd")
    labels = linked_components(plain.where("_id IS NOT NULL"), profiles.where("n > 0 AND _id IS NOT NULL"), counts, percent)
    classes = profiles.where("n > 0 AND _id IS NOT NULL").groupBy("n", "mark1", "mark2").agg(F.min("_id").alias("v"))
    named = classes.join(labels, "v", "left").select("n", "mark1", "mark2", F.least("v", F.coalesce("label", "v")).alias("component"))
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id")).alias("component_id")
    return profiles.join(named, ["n", "mark1", "mark2"], "left").select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), component)
