"""Helpers of the operators: stored intermediate tables, shared keys, and hashing of text as byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Bytes of text that a worker hashes at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

#: An odd multiplier and its inverse modulo 2**64, for prefix polynomials.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and read it again: lineage ends in files that all executors share."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark) -> None:
    """Hand texts to Python in Arrow batches of at most 8 MB, unless the session asks for less: long texts then take little memory."""
    key, size = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    now = spark.conf.get(key)
    if now.rstrip("bB").lstrip("-").isdigit() and not 0 < int(now.rstrip("bB")) <= size:
        spark.conf.set(key, str(size))


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that no model learns from; rows without an id do."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def by_hash(ids: DataFrame, column: str, rows: int, seed: int) -> DataFrame:
    """The ``rows`` ids that come first in a pseudo-random order: a bounded sample, the same in every run."""
    return ids.orderBy(F.xxhash64(column, F.lit(seed)), column).limit(rows)


def smallest_labels(spark, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: each vertex ``v`` with the smallest vertex it reaches, ``label``.

    Labels pass to neighbours, then each label is replaced by its own label, so
    that long chains halve in every round; rounds end when nothing changes.
    """
    from ..session import durable

    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    both = durable(both)
    labels = durable(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("v").alias("to"), F.col("label").alias("far"))
        moved = durable(stepped.join(jump, "to", "left").select("v", "old", F.least("to", F.coalesce("far", "to")).alias("label")))
        labels = moved.select("v", "label")
        if moved.where("old <> label").isEmpty():
            return labels


# --- text as bytes -------------------------------------------------------------------------


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``limit`` bytes, so that a worker's memory does not follow the size of batches."""
    for batch in batches:
        step = max(1, min(rows, int(limit * batch.num_rows / max(1, batch.nbytes)))) if batch.num_rows else 1
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, counting some for each row."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 32
    if start < len(texts):
        yield start, len(texts)


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64.  A worker keeps one array per base, of at most 32 MB."""
    if n > len(_POWERS.get(base, ())):
        out = np.full(1 << max(10, int(n).bit_length()), base, np.uint64)
        out[0] = 1
        out = np.cumprod(out, dtype=np.uint64)
        if len(out) > 1 << 22:
            return out[:n]
        _POWERS[base] = out
    return _POWERS[base][:n]


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread polynomial values over all 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_polynomial(data: np.ndarray) -> np.ndarray:
    """Running sums of byte codes times powers: the hash of any span is a difference of two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes()[data] * powers(len(data), BASE), dtype=np.uint64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal bytes give equal hashes wherever they lie."""
    return (sums[ends] - sums[starts]) * powers(len(sums), INVERSE)[starts]


def joined(texts: list[bytes], separator: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with a separator after each, and where each begins (and the last ends)."""
    data = np.frombuffer(separator.join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(separator) for t in texts], out=starts[1:])
    return data, starts


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


# --- keys that several documents share -----------------------------------------------------

SKETCH_BITS = 18
SLICES = 64
#: Buckets of the sketch with this many times the mean count, and so many documents at least, hold hot keys.
HOT = 16
GROUP = 5_000


def add_counts(counts: np.ndarray, keys: np.ndarray) -> None:
    """Count keys into 2**18 hash buckets."""
    counts += np.bincount((keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))


def count_rows(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A task's counters as numbered slices."""
    return list(range(SLICES)), [part.astype(np.uint32).tobytes() for part in counts.reshape(SLICES, -1)]


def summed_counts(rows: DataFrame) -> np.ndarray:
    """The sums of all tasks' counters (``slice int, counts binary``): 2**18 numbers, whatever the table holds."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(x, np.uint32 if len(x) * SLICES == 4 << SKETCH_BITS else np.int64)
                sums[k] = sums.get(k, 0) + part.astype(np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    total = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    for row in rows.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect():
        total[row["slice"]] += np.frombuffer(row["counts"], np.int64)
    return total.ravel()


def bucket_counts(docs: DataFrame, keys_of) -> np.ndarray:
    """Documents per hash bucket of their keys.

    ``keys_of`` maps a list of texts to arrays of keys, each key once per document.
    Tasks add up their counters before anything moves.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches):
            for keys in keys_of(utf8(batch.column("_text"))):
                add_counts(counts, keys)
        numbers, parts = count_rows(counts)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(numbers, pa.int32()), "counts": pa.array(parts, pa.binary())})

    return summed_counts(docs.mapInArrow(count, "slice int, counts binary"))


def hot_buckets(counts: np.ndarray) -> np.ndarray:
    """In how many groups the keys of each bucket are to be split: 0 for ordinary ones."""
    hot = counts >= max(GROUP, HOT * counts.mean())
    return np.where(hot, -(-counts // GROUP), 0)


def levels(counts: np.ndarray) -> np.ndarray:
    """How far a bucket lies above the mean, in quarters of a power of two (0: less than half a power)."""
    ratio = counts / max(1.0, counts.mean())
    return np.clip(np.floor(4 * np.log2(np.maximum(ratio, 1.0))) - 1, 0, 31).astype(np.uint8)


def short(values: np.ndarray) -> bytes:
    """The upper 48 bits of each value."""
    return np.ascontiguousarray((values >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def planes(values: np.ndarray) -> bytes:
    """Integers byte by byte of equal weight: planes of zeros shrink to nothing in a compressed shuffle."""
    return np.ascontiguousarray(np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def steps(values: np.ndarray) -> bytes:
    """Integers as planes of their differences."""
    return planes(np.diff(values, prepend=0))


BLOB = "bucket int, keys binary, marks binary, ids binary, extra binary"


def blobs(keys: np.ndarray, marks: np.ndarray, ids: np.ndarray, extra: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Rows (key, mark, id, extra) packed by bucket: few rows move instead of one per key."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, marks, ids, extra = bucket[order], keys[order], marks[order], ids[order], extra[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(bucket))
    cut = lambda pack: pa.array([pack(a, b) for a, b in zip(starts, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(bucket[starts], pa.int32()), "keys": cut(lambda a, b: short(keys[a:b])), "marks": cut(lambda a, b: short(marks[a:b])),
        "ids": cut(lambda a, b: steps(ids[a:b])), "extra": cut(lambda a, b: planes(extra[a:b])),
    })


def unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All rows of a partition, sorted by key and id."""
    columns = {"keys": [], "marks": [], "ids": [], "extra": []}
    for batch in batches:
        for name, parts in columns.items():
            parts += batch.column(name).to_pylist()
    keys, marks = long(b"".join(columns["keys"])), long(b"".join(columns["marks"]))
    none = [np.zeros(0, np.int64)]
    ids = np.concatenate(none + [np.cumsum(from_planes(x)) for x in columns["ids"]])
    extra = np.concatenate(none + [from_planes(x) for x in columns["extra"]])
    order = np.lexsort((ids, keys))
    return keys[order], marks[order], ids[order], extra[order]
