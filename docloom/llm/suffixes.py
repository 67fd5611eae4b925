"""Repeated passages by a hash-compared suffix sort.

A byte is removed if it lies in a string of ``length`` bytes that also starts in
a document with a smaller id.

Suffixes are compared by the longest common extension: prefix polynomials give
the hash of any span in two lookups, a binary search over lengths finds the
extension, and the byte behind it decides.  Each comparison takes a logarithmic
number of hash tests; a merge sort orders the suffixes of a group, all groups and
all elements of a level at once.  Neighbours with an extension of ``length`` begin
with the same string, which is verified byte by byte.

Suffixes meet by anchors.  The anchor of a window of ``length`` bytes is the
smallest hash of its 16-byte grams, so equal windows have equal anchors wherever
they lie.  Consecutive windows with one anchor form a run; its stretch of text
holds all those windows.  Anchors that only one document has are dropped.  If an
anchor always comes with the same stretch, the stretch is repeated as a whole;
only where stretches differ are suffixes sorted, and of equal stretches only
those of the first document.

Anchors whose sketch bucket is hot are spread over groups of a few thousand
documents; windows that are first in their group meet once more by content, at
most one row per group and text.

Defined results: null text counts as empty; texts shorter than ``length`` lose
nothing; rows that share an id do not remove each other's bytes; rows with a null
id come after all ids; repeated rows appear each.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BLOB, SKETCH_BITS, blobs, blocks, bucket_counts, byte_codes, from_planes, hot_buckets, joined, long, mixed, powers, prefix_polynomial, runs, short, slices, small_batches, span_hashes, steps, unpacked, utf8

LENGTH = 50
GRAM = 16
LAST = (1 << 63) - 1
#: Bytes of stretches that one sort takes at once; larger groups make a block of their own.
SORT_BYTES = 1 << 22


# --- suffix sort ---------------------------------------------------------------------------


def common_extension(sums: np.ndarray, inverse: np.ndarray, one: np.ndarray, other: np.ndarray, limit: int) -> np.ndarray:
    """Lengths, up to the limit, over which the suffixes at two arrays of positions agree by hash."""
    length = np.zeros(len(one), np.int64)
    for step in (1 << b for b in range(int(limit).bit_length() - 1, -1, -1)):
        tried = length + step
        fits = tried <= limit
        tried = np.where(fits, tried, length)
        same = (sums[one + tried] - sums[one]) * inverse[one] == (sums[other + tried] - sums[other]) * inverse[other]
        length = np.where(fits & same, tried, length)
    return length


def sorted_suffixes(data: np.ndarray, sums: np.ndarray, at: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """The order of suffixes within their groups by the first ``limit`` bytes: a merge sort of all groups at once.

    Two suffixes are first compared by the hash of all ``limit`` bytes and by
    their first eight bytes; the search for the common extension is left to
    those that neither decides.
    """
    order = np.argsort(group, kind="stable")
    group = group[order]
    new = changes(group)
    starts, number = np.flatnonzero(new), np.cumsum(new) - 1
    base, size = starts[number], np.diff(np.append(starts, len(at)))[number]
    inverse = powers(len(sums), pow(BASE, -1, 1 << 64))
    whole, head = span_hashes(sums, at, at + limit), np.zeros(len(at), np.uint64)
    for k in range(min(limit, 8)):
        head = (head << np.uint64(8)) | data[at + k]
    local, width = np.arange(len(at)) - base, 1
    while width < size.max(initial=0):
        run = local // width
        other = (run ^ 1) * width
        busy = np.flatnonzero(other < size)
        first = other[busy]
        low, high, left, mine = first.copy(), np.minimum(first + width, size[busy]), run[busy] % 2 == 0, order[busy]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            theirs, own = order[base[busy[open_]] + middle], mine[open_]
            before = head[theirs] < head[own]
            equal = whole[theirs] == whole[own]
            before[equal] = ~left[open_][equal]
            hard = np.flatnonzero(~equal & (head[theirs] == head[own]))
            if len(hard):
                one, two = at[theirs[hard]], at[own[hard]]
                agree = np.minimum(common_extension(sums, inverse, one, two, limit), limit - 1)
                before[hard] = data[one + agree] < data[two + agree]
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        local[busy] = np.minimum(run[busy] * width, first) + local[busy] - run[busy] * width + low - first
        moved = np.empty_like(order)
        moved[base + local] = order
        order, local = moved, np.arange(len(at)) - base
        width *= 2
    return order


def equal_starts(data: np.ndarray, sums: np.ndarray, at: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Class numbers: suffixes of one group that begin with the same ``limit`` bytes have the same number."""
    if not len(at):
        return np.zeros(0, np.int64)
    order = sorted_suffixes(data, sums, at, group, limit)
    sorted_at, sorted_group = at[order], group[order]
    inverse = powers(len(sums), pow(BASE, -1, 1 << 64))
    same = (sorted_group[1:] == sorted_group[:-1]) & (common_extension(sums, inverse, sorted_at[1:], sorted_at[:-1], limit) == limit)
    for k in range(limit):  # verification against collisions
        if np.any(same & (data[sorted_at[1:] + k] != data[sorted_at[:-1] + k])):
            whole = np.ascontiguousarray(data[at[:, None] + np.arange(limit)]).view(f"V{limit}").ravel()
            return np.unique(np.rec.fromarrays([group, whole]), return_inverse=True)[1]
    out = np.empty(len(at), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(~same)))
    return out


# --- anchors -------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams, by doubling their length."""
    value, size, factor = byte_codes()[data], 1, BASE
    while size < GRAM:
        value = value[:-size] * np.uint64(factor) + value[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    return mixed(value)


def least_in_windows(value: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        value, size = np.minimum(value[:-size], value[size:]), size * 2
    rest = width - size
    return np.minimum(value[:-rest], value[rest:]) if rest else value


def anchored_runs(texts: list[bytes], length: int) -> Iterator[tuple]:
    """Blocks of texts: first row, data, where rows begin, and runs of windows: rows, starts (in data), windows, anchors, stretch hashes."""
    for start, end in blocks(texts):
        data, begins = joined(texts[start:end], b"\0")
        if len(data) < length:
            continue
        anchor = least_in_windows(gram_hashes(data), length - GRAM + 1)
        change = np.zeros(len(data) + 1, np.int64)
        sizes = np.diff(begins) - 1
        some = np.flatnonzero(sizes >= length)
        change[begins[some]] += 1
        change[begins[some] + sizes[some] - length + 1] -= 1
        valid = np.cumsum(change)[: len(anchor)] > 0
        edge = np.ones(len(anchor), bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        edge[begins[some]] = True
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(anchor))
        first, last = first[valid[first]], last[valid[first]]
        row = np.searchsorted(begins, first, side="right") - 1
        sums = prefix_polynomial(data)
        yield start, end, data, begins, row, first, last - first, anchor[first] >> np.uint64(16), mixed(span_hashes(sums, first, last + length - 1)) >> np.uint64(16)


def hot_anchors(hot: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """What is known of the buckets of anchors; they are minima, so they are mixed before their upper bits name a bucket."""
    return hot[(mixed(anchor) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def shared_anchors(docs: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """``_ord, anchor, many``: anchors of a document that others have too.

    ``many`` tells that they come with different stretches; the rest is listed only for documents after the first.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, parts = batch.column("_ord").to_numpy(), []
            for start, _, _, _, row, _, _, anchor, stretch in anchored_runs(utf8(batch.column("_text")), length):
                cold = ~hot_anchors(hot, anchor)
                row, anchor, stretch = row[cold], anchor[cold], stretch[cold]
                order = np.lexsort((stretch, anchor, row))
                row, anchor, stretch = row[order], anchor[order], stretch[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])
                parts.append((anchor[new], stretch[new], ids[start + row[new]]))
            if parts:
                anchor, stretch, owner = map(np.concatenate, zip(*parts, strict=True))
                yield blobs(anchor << np.uint64(16), stretch << np.uint64(16), owner, np.zeros(len(owner), np.int64), (anchor % np.uint64(buckets)).astype(np.int64))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, stretch, owner, _ = unpacked(batches)
        if not len(anchor):
            return
        begins = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        starts, number = np.flatnonzero(begins), np.cumsum(begins) - 1
        first, last = owner[starts], owner[np.append(starts[1:], len(owner)) - 1]
        many = np.minimum.reduceat(stretch, starts) != np.maximum.reduceat(stretch, starts)
        kept = (first != last)[number] & (many[number] | (owner > first[number]))
        yield pa.RecordBatch.from_arrays([pa.array(owner[kept]), pa.array(anchor[kept].astype(np.int64)), pa.array(many[number][kept])], ["_ord", "anchor", "many"])

    return docs.mapInArrow(dealt, BLOB).repartition(buckets // 4, "bucket").mapInArrow(met, "_ord long, anchor long, many boolean")


DEALT = "bucket int, fields binary, bodies binary, _ord long, _version int"
#: Anchor, stretch, salt, id, version, start and windows of a stretch, column after column.
FIELD_BYTES = (6, 6, 8, 8, 8, 8, 8)


def stretches(listed: DataFrame, groups: np.ndarray, buckets: int, length: int) -> DataFrame:
    """From documents with their shared anchors: windows that are surely repeated (one row per document), and stretches to compare (packed by bucket)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, versions = batch.column("_ord").to_numpy(), batch.column("_version").to_numpy()
            lists = [[np.array(x if x is not None else (), np.uint64) for x in batch.column(c).to_pylist()] for c in ("one", "many")]
            parts, bodies = [], []
            for start, end, data, begins, row, first, windows, anchor, stretch in anchored_runs(utf8(batch.column("_text")), length):
                own = (anchor << np.uint64(16)) | row.astype(np.uint64)
                in_list = []
                for some in lists:
                    flat = [(a << np.uint64(16)) | np.uint64(r) for r, a in enumerate(some[start:end])]
                    in_list.append(np.isin(own, np.concatenate(flat)) if flat else np.zeros(len(own), bool))
                among, who = hot_anchors(groups, anchor), ids[start + row]
                is_hot = among > 0
                sure, compared = in_list[0], in_list[1] | is_hot
                # of equal stretches in this block only the first document's go on
                order = np.flatnonzero(compared)
                order = order[np.lexsort((who[order], stretch[order], anchor[order]))]
                new = changes(stretch[order], anchor[order])
                later = who[order] > who[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                sure[order[later]] = True
                compared[order[later]] = False
                low, k = first - begins[row], np.flatnonzero(sure)
                if len(k):
                    yield spans(start + row[k], low[k], low[k] + windows[k], ids, versions, buckets)
                k = np.flatnonzero(compared)
                salt = np.where(is_hot[k], mixed(who[k].astype(np.uint64)) % np.maximum(among[k], 1).astype(np.uint64), np.uint64(0))
                parts.append((anchor[k], stretch[k], salt, who[k], versions[start + row[k]], low[k], windows[k]))
                raw = data.tobytes()
                bodies += [raw[a : a + n + length - 1] for a, n in zip(first[k], windows[k], strict=True)]
            if bodies:
                fields = [np.concatenate(x) for x in zip(*parts, strict=True)]
                bucket = (mixed(fields[0] + (fields[2] << np.uint64(48))) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(changes(bucket[order]))
                packs = np.split(order, edges[1:])
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[order[edges]], pa.int32()), pa.array([packed(*[x[g] for x in fields]) for g in packs], pa.binary()),
                    pa.array([b"".join([bodies[i] for i in g]) for g in packs], pa.binary()), pa.nulls(len(packs), pa.int64()), pa.nulls(len(packs), pa.int32())],
                    ["bucket", "fields", "bodies", "_ord", "_version"])

    return listed.mapInArrow(find, DEALT)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where one of several sorted columns has a new value."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def packed(anchor, stretch, *rest) -> bytes:
    return b"".join((short(anchor << np.uint64(16)), short(stretch << np.uint64(16)), *[steps(x.astype(np.int64)) for x in rest]))


def split_fields(raw: bytes) -> list[np.ndarray]:
    n, at, out = len(raw) // sum(FIELD_BYTES), 0, []
    for size in FIELD_BYTES:
        part = raw[at : at + size * n]
        out.append(long(part) if size == 6 else np.cumsum(from_planes(part)))
        at += size * n
    return out


def spans(row: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, versions: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per document with its ranges of windows; ranges that touch become one."""
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (low[1:] != high[:-1]))))
    row, low, high = row[heads], low[heads], np.maximum.reduceat(high, heads)
    pairs = np.stack([low, high], 1).astype(np.int32)
    edges = np.flatnonzero(changes(row))
    who = ids[row[edges]]
    return pa.RecordBatch.from_arrays([
        pa.array((mixed(who.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)), pa.array([p.tobytes() for p in np.split(pairs, edges[1:])], pa.binary()),
        pa.nulls(len(edges), pa.binary()), pa.array(who, pa.int64()), pa.array(versions[row[edges]], pa.int32())], ["bucket", "fields", "bodies", "_ord", "_version"])


COVERED = "bucket long, _ord long, _version int, ranges binary, low int, content binary"


def covered_windows(found: DataFrame, hot: np.ndarray, partitions: int, buckets: int, length: int) -> DataFrame:
    """Ranges of repeated windows of a document, and windows of hot anchors that are first in their group (``low, content``)."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bodies = [], []
        for batch in batches:
            certain = batch.filter(pc.is_null(batch.column("bodies")))
            if certain.num_rows:
                yield rows(certain.column("_ord"), certain.column("_version"), certain.column("fields"), None, None)
            rest = batch.filter(pc.is_valid(batch.column("bodies")))
            for fields, body in zip(rest.column("fields").to_pylist(), rest.column("bodies").to_pylist(), strict=True):
                parts.append(split_fields(fields))
                bodies.append(body)
        if not parts:
            return
        fields = [np.concatenate(x) for x in zip(*parts, strict=True)]
        body, sizes = b"".join(bodies), fields[6].astype(np.int64) + length - 1
        begins, bodies = np.cumsum(sizes) - sizes, []
        order = np.lexsort((fields[3], fields[1], fields[2], fields[0]))
        group = np.cumsum(changes(fields[0][order], fields[2][order]))
        block = np.cumsum(sizes[order]) // SORT_BYTES
        block = block[np.searchsorted(group, group)]  # a group goes with its first row
        for part in np.split(order, np.flatnonzero(np.diff(block)) + 1):
            yield from compare([x[part] for x in fields], [body[a : a + n] for a, n in zip(begins[part], sizes[part], strict=True)])

    def compare(fields: list[np.ndarray], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        anchor, stretch, salt, who, *rest = fields
        version, low, windows = (x.astype(np.int32) for x in rest)
        group, new = np.cumsum(changes(anchor, salt)), changes(anchor, salt, stretch)
        later = who > who[np.flatnonzero(new)][np.cumsum(new) - 1]
        repeated_low, repeated_high, repeated_row = [low[later]], [low[later] + windows[later]], [np.flatnonzero(later)]
        first = np.flatnonzero(~later)
        data, begins = joined([texts[i] for i in first], b"")
        sums, owner = prefix_polynomial(data), np.repeat(np.arange(len(first)), windows[first])
        offset = np.arange(len(owner)) - (np.cumsum(windows[first]) - windows[first])[owner]
        at, owner = begins[owner] + offset, first[owner]
        key = mixed(span_hashes(sums, at, at + length)) ^ mixed(group.astype(np.uint64))[owner]
        by_key = np.argsort(key)
        same, again = key[by_key][1:] == key[by_key][:-1], np.zeros(len(key), bool)
        again[by_key[1:]] |= same
        again[by_key[:-1]] |= same
        some, leads = np.flatnonzero(again), ~again
        if len(some):  # windows that may recur are sorted as suffixes
            number = equal_starts(data, sums, at[some], group[owner[some]], length)
            least = np.full(number.max() + 1, LAST)
            np.minimum.at(least, number, who[owner[some]])
            hit = some[who[owner[some]] > least[number]]
            leads[some] = True
            leads[hit] = False
            repeated_low.append(low[owner[hit]] + offset[hit])
            repeated_high.append(low[owner[hit]] + offset[hit] + 1)
            repeated_row.append(owner[hit])
        row = np.concatenate(repeated_row)
        if len(row):
            # rows of one document and version go together
            pair = np.unique(np.stack([who, version.astype(np.int64)], 1), axis=0, return_inverse=True)
            ids, versions = pair[0][:, 0], pair[0][:, 1].astype(np.int32)
            batch = spans(pair[1].ravel()[row], np.concatenate(repeated_low), np.concatenate(repeated_high), ids, versions, 1)
            yield rows(batch.column("_ord"), batch.column("_version"), batch.column("fields"), None, None)
        pending = np.flatnonzero(leads & hot_anchors(hot, anchor)[owner])
        if len(pending):
            raw, o = data.tobytes(), owner[pending]
            yield rows(pa.array(who[o]), pa.array(version[o]), None, pa.array((low[o] + offset[pending]).astype(np.int32)), pa.array([raw[a : a + length] for a in at[pending]], pa.binary()))

    def rows(who, version, ranges, low, content) -> pa.RecordBatch:
        none = lambda x, kind: pa.nulls(len(who), kind) if x is None else x
        keys = who.to_numpy(zero_copy_only=False) if content is None else np.array([zlib.crc32(x) for x in content.to_pylist()])
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), who, version, none(ranges, pa.binary()), none(low, pa.int32()), none(content, pa.binary())], ["bucket", "_ord", "_version", "ranges", "low", "content"])

    return found.repartition(partitions, "bucket").mapInArrow(settle, COVERED)


def after_first(covered: DataFrame, partitions: int) -> DataFrame:
    """Ranges as they are, and of the windows that are first in their group those whose content an earlier document has.

    A window comes at most once per group and text, so equal contents meet in a few rows.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for batch in batches:
            yield batch.filter(pc.is_null(batch.column("content"))).select(names)
            waiting.append(batch.filter(pc.is_valid(batch.column("content"))))
        if waiting and sum(b.num_rows for b in waiting):
            table = pa.Table.from_batches(waiting)
            least = table.group_by("content").aggregate([("_ord", "min")])
            first = dict(zip(least.column("content").to_pylist(), least.column("_ord_min").to_pylist(), strict=True))
            later = [who > first[content] for who, content in zip(table.column("_ord").to_pylist(), table.column("content").to_pylist(), strict=True)]
            yield from table.filter(pa.array(later)).select(names).to_batches()

    names = ["_ord", "_version", "ranges", "low"]
    return covered.repartition(partitions, "bucket").mapInArrow(meet, "_ord long, _version int, ranges binary, low int")


def repeated_windows(rows: DataFrame, length: int) -> DataFrame:
    """``_ord, _spans``: for each id the ``version`` of the text and ``ranges``, or a single place ``low``, of windows that an earlier document has."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = lambda texts: (mixed(np.unique((anchor << np.uint64(16)) | row.astype(np.uint64)) >> np.uint64(16)) for _, _, _, _, row, _, _, anchor, _ in anchored_runs(texts, length))
    counts = bucket_counts(rows, keys)
    groups = hot_buckets(counts)
    hot = groups > 0
    anchors = shared_anchors(rows, hot, length).groupBy("_ord").agg(
        F.collect_list(F.when(~F.col("many"), F.col("anchor"))).alias("one"), F.collect_list(F.when(F.col("many"), F.col("anchor"))).alias("many"))
    listed = rows.join(anchors, "_ord", "left" if hot.any() else "inner")
    covered = covered_windows(stretches(listed, groups, 4 * partitions, length), hot, partitions, 4 * partitions, length)
    found = after_first(covered, partitions) if hot.any() else covered
    return found.groupBy("_ord").agg(F.collect_list(F.struct(F.col("_version").alias("version"), "ranges", "low")).alias("_spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", contents: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row, and ``kept`` (bytes) unless ``contents`` is off.

    ``spans`` are the maximal removed runs as (start, end) in bytes.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("_ord"), F.hash(body).alias("_version"), body.alias("_text"))
    known = rows.join(repeated_windows(rows, length), "_ord", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for who, version, raw, spans in zip(batch.column("_ord").to_pylist(), batch.column("_version").to_pylist(), utf8(batch.column("_text")), batch.column("_spans").to_pylist(), strict=True):
                change = np.zeros(len(raw) + 1, np.int32)
                own = [s for s in spans or () if s["version"] == version]
                ranges = np.frombuffer(b"".join([s["ranges"] for s in own if s["ranges"]]), np.int32).reshape(-1, 2)
                single = np.array([s["low"] for s in own if s["low"] is not None], np.int64)
                for low, high in ((ranges[:, 0], ranges[:, 1]), (single, single + 1)):
                    np.add.at(change, low, 1)
                    np.add.at(change, high + length - 1, -1)
                removed = np.cumsum(change[:-1]) > 0
                start, end = runs(removed)
                kept = np.frombuffer(raw, np.uint8)[~removed].tobytes()
                row = {"doc_id": None if who == LAST else who, "n_bytes": len(raw), "n_removed": int(removed.sum()), "n_spans": len(start), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                row["spans"] = [{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)]
                out.append(row | {"kept": kept} if contents else row)
            yield pa.RecordBatch.from_pylist(out, schema)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", spans)]
    schema = pa.schema([*fields, ("kept", pa.binary())] if contents else fields)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start long, end long>>"
    return known.mapInArrow(cut, ddl + ", kept binary" * contents)
