"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens: its documents in stored order.  A window of
several sequences is filled by one round over the queues: a queue's deficit
grows by its target share of the window, it gives the whole part of its deficit,
and the tokens still missing go one each to the queues with the largest deficit
left.  What a queue gave too much or too little stays in its deficit for the next
window.

The round is run on two levels with the same routine.  On the driver it deals
out whole spans of windows (numbers of tokens per source only); inside a span it
deals out windows.  A span starts from the deficits that the first level carried
to it, and spans can be worked on independently.  A document's place in its
queue fixes its pieces, so token ids are written once and never shuffled.

Targets are shares per source; a source without a target gets its share of all
tokens.  When a queue runs dry, the others share its part.

Defined results: null text is empty (its only id is the end id), null source is
a queue of its own; documents are cut freely and every id lies in exactly one
piece; all sequences but the last are full; repeated rows are packed each; an
empty table has no pieces.  Columns of the input that the operator does not read
are left out.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SEQUENCE = 2048
WINDOW = 64 * SEQUENCE
SPAN = 512 * WINDOW
END_ID = 1
COMPARED_TEXTS = 8
NO_SOURCE = "\0"

# Fixed value: how byte-level vocabularies split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ids of texts as the tokenizers library gives them, without special treatment but for the file's added tokens.

    If the file is a byte-level BPE whose ids follow its merges, tiktoken gives the
    same ids from the same table several times faster; it is used for texts in
    Latin-1, where both libraries' character classes agree beyond doubt, and the
    first texts of each task are compared.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.fast, self.compared = self.ranked(json.loads(Path(path).read_text())), 0

    def ranked(self, file: dict):
        """The same vocabulary as ranks, or None if its ids are not in the order of its merges."""
        model, splitter = file["model"], file.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space") and not file.get("normalizer")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        if not plain or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            latin = self.fast is not None and not any(token in text for token in self.added)
            try:
                latin = latin and text.encode("latin-1") is not None
            except UnicodeEncodeError:
                latin = False
            ids = self.fast.encode_ordinary(text) if latin else None
            if ids is None or self.compared < COMPARED_TEXTS:
                known = self.library.encode(text, add_special_tokens=False).ids
                if ids is not None and ids != known:
                    raise ValueError(f"ids differ from the library's for a text that begins with {text[:80]!r}")
                ids, self.compared = known, self.compared + 1
            out.append(np.array(ids, np.uint16).tobytes())
        return out


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str, source: str) -> DataFrame:
    """Write ``doc_id, source, part, before, n, ids``: ids of each document and its place among its source's in one task."""

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        words, served, part = Vocabulary(tokenizer), {}, TaskContext.get().partitionId()
        end = np.uint16(end_id).tobytes()
        for frame in frames:
            for i in range(0, len(frame), 256):
                some = frame.iloc[i : i + 256]
                ids = [x + end for x in words.encode(["" if t is None else t for t in some["text"]])]
                before = []
                for name, x in zip(some["source"], ids, strict=True):
                    before.append(served.get(name, 0))
                    served[name] = before[-1] + len(x) // 2
                yield pd.DataFrame({"doc_id": some["doc_id"].array, "source": some["source"].array, "part": part, "before": before, "n": [len(x) // 2 for x in ids], "ids": ids})

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source"))
    return stored(chosen.mapInPandas(tokens, "doc_id long, source string, part int, before long, n long, ids binary"), "packing-ids")


def round_robin(totals: np.ndarray, capacity: int, shares: np.ndarray) -> np.ndarray:
    """Tokens served by each queue before each window (rows: windows and the end), when windows of ``capacity`` are filled from queues of ``totals``."""
    windows = -(-int(totals.sum()) // capacity)
    served = np.zeros((windows + 1, len(totals)), np.int64)
    deficit = np.zeros(len(totals))
    for w in range(windows):
        left = totals - served[w]
        wanted = min(capacity, int(left.sum()))
        given = np.zeros(len(totals), np.int64)
        while wanted > given.sum():
            open_ = left > given
            share = np.where(open_, shares, 0.0)
            if share.sum() <= 0:
                share = np.where(open_, left - given, 0).astype(float)
            missing = wanted - int(given.sum())
            deficit += share / share.sum() * missing
            give = np.clip(np.floor(deficit + 1e-9).astype(np.int64), 0, left - given)
            extra = int(give.sum()) - missing
            if extra > 0:  # carried deficits ask for more than there is room for: the smallest wait
                for s in np.argsort(deficit - give, kind="stable"):
                    back = min(extra, int(give[s]))
                    give[s] -= back
                    extra -= back
            elif extra < 0:
                ready = np.flatnonzero(left - given - give > 0)
                for s in ready[np.argsort(-(deficit - give)[ready], kind="stable")][:-extra]:
                    give[s] += 1
            deficit -= give
            given += give
        served[w + 1] = served[w] + given
        deficit[served[w + 1] >= totals] = 0.0
    return served


class Mixture:
    """Where a stretch of a source's queue lies in the sequences."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None, sequence: int, window: int, span: int):
        self.sources = {s: i for i, s in enumerate(sorted(totals))}
        amounts = np.array([totals[s] for s in sorted(totals)], np.int64)
        natural = amounts / max(1, amounts.sum())
        self.shares = np.array([(targets or {}).get(s, natural[i]) for s, i in self.sources.items()], float)
        self.sequence, self.window, self.span = sequence, window, span
        self.spans = round_robin(amounts, span, self.shares) if len(amounts) else np.zeros((1, 0), np.int64)
        self.inner: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of span k: queue positions before each window, and where each queue's run begins in a window."""
        if k not in self.inner:
            amounts = self.spans[k + 1] - self.spans[k]
            served = round_robin(amounts, self.window, amounts / max(1, amounts.sum()))
            run = np.cumsum(np.diff(served, axis=0), axis=1) - np.diff(served, axis=0)
            if len(self.inner) >= 64:
                self.inner.clear()
            self.inner[k] = (served + self.spans[k], run)
        return self.inner[k]

    def pieces(self, source: str, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the stretch, length, sequence, offset) of the pieces of a stretch of a queue."""
        s, at, end = self.sources[source], start, start + length
        while at < end:
            k = int(np.searchsorted(self.spans[:, s], at, side="right")) - 1
            served, run = self.windows(k)
            w = int(np.searchsorted(served[:, s], at, side="right")) - 1
            place = int(run[w, s]) + at - int(served[w, s])
            stop = min(end, int(served[w + 1, s]), at + self.sequence - place % self.sequence)
            position = k * (self.span // self.sequence) + w * (self.window // self.sequence) + place // self.sequence
            yield at - start, stop - at, position, place % self.sequence
            at = stop


def pack_mixture(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW, span: int = SPAN, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece: ``doc_id, source, start, length, token_ids, doc_tokens, sequence_id, offset``.

    The driver holds one number per source and span of 67 million tokens.
    """
    if window % sequence or span % window:
        raise ValueError("a window holds whole sequences, a span whole windows")
    ids = tokenised(docs, tokenizer, end_id, doc_id, text, source)
    parts = ids.groupBy("source", "part").agg(F.sum("n").alias("total"))
    order = W.partitionBy("source").orderBy("part")
    bases = parts.select("source", "part", (F.sum("total").over(order) - F.col("total")).alias("base"))
    mixture = Mixture({r["source"]: r["total"] for r in parts.groupBy("source").agg(F.sum("total").alias("total")).collect()}, targets, sequence, window, span)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 512):
                rows = []
                for row in frame.iloc[i : i + 512].itertuples(index=False):
                    for start, length, number, offset in mixture.pieces(row.source, row.base + row.before, row.n):
                        rows.append((row.doc_id, row.source, start, length, row.ids[2 * start : 2 * (start + length)], row.n, number, offset))
                yield pd.DataFrame(rows, columns=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    return ids.join(bases, ["source", "part"]).mapInPandas(cut, T.StructType.fromDDL("doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"))


def packed_pieces(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Pieces with their ids as arrays."""

    @F.pandas_udf("array<int>")
    def unpacked(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: np.frombuffer(x, np.uint16).astype(np.int32))

    return pack_mixture(docs, tokenizer, **options).withColumn("token_ids", unpacked("ids")).withColumn("source", F.expr(f"nullif(source, '{NO_SOURCE}')")).drop("ids")


def piece_rows(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Pieces with the CRC-32 of their ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def crc(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: zlib.crc32(np.frombuffer(x, np.uint16).astype("<u4").tobytes()))

    return pack_mixture(docs, tokenizer, **options).select("doc_id", "start", "length", crc("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
