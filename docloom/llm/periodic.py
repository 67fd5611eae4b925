"""Periodic run detection over a Re-Pair grammar of word ids.

Each document's words become ids, and Re-Pair turns them into a grammar: pairs of
neighbours that occur more than once in the document become nonterminals, the more frequent
of two overlapping pairs first, until no pair repeats.  All documents of a block
are rewritten in common rounds (their ids differ, so no pair spans two
documents): a round replaces every pair that outranks the pairs it overlaps,
alternate ones in a stretch of equal words.  What is left of a document is
folded into halves, so that every node of the derivation has two parts.

A run lies across the boundary of the smallest node that contains it.  So the
runs that cross a boundary are computed once per nonterminal, at its first occurrence:
for each period q, how far the words around the boundary equal the words q further on, or q before, by binary
search over polynomial hashes.  A boundary is passed over when no window of six words
at it recurs in the document, as a run always repeats that many words there.  Runs are then moved to
all positions at which their nonterminal was made; those that a neighbouring word extends
are part of a run of a larger node and fall away, and of equal stretches the smallest period stays.

Words are compared by ids, not by hashes; every run found by hashes is compared word by word, and a
document in which one fails is searched period by period instead.

A worker holds one block of documents, or one long document: some arrays of one
number per word and its distinct words.  Nothing is shuffled.

Defined results: null and empty texts have no words and no runs; rows are handled each, so
repeated rows and null or shared ids do not matter; an empty table gives an empty table.
Columns of the input that the operator does not read are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import computed
from .common import mixed, powers, slices, utf8

WORD = r"[^\x20\x09-\x0D]+"
LEAST = 12
#: Words in a block, and candidates that are compared at once.
BLOCK = 1 << 17
CANDIDATES = 1 << 20
SLICE = 1 << 20
#: Moduli and bases of the hashes; a sum over 2**32 words still fits into a long.
PRIMES = ((2147483647, 1103515245), (2147483629, 69069069))
SPACE = re.compile(rb"[\x20\x09-\x0D]")

RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of a text's words in order of first use, and the distinct words."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        end = len(text)
        if at + SLICE < end and (space := SPACE.search(text, at + SLICE)):
            end = space.end()
        parts.append(np.array([known.setdefault(w, len(known)) for w in text[at:end].split()], np.int64))
        at = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), list(known)


# --- the grammar ---------------------------------------------------------------------------


class Grammar(NamedTuple):
    """Nonterminals as (first position, length of the left part, length), where each occurs, and the symbols that are left."""

    first: np.ndarray
    left: np.ndarray
    length: np.ndarray
    made: np.ndarray
    made_at: np.ndarray
    rest_at: np.ndarray
    rest_end: np.ndarray


def counted(codes: np.ndarray) -> np.ndarray:
    """How often each element's value occurs."""
    if not len(codes):
        return np.zeros(0, np.int64)
    order = np.argsort(codes)
    edges = np.flatnonzero(np.concatenate(([True], codes[order[1:]] != codes[order[:-1]], [True])))
    out = np.empty(len(codes), np.int64)
    out[order] = np.repeat(np.diff(edges), np.diff(edges))
    return out


def outranking(rank: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Pairs that rank above those they overlap, alternate ones in a stretch of one rank.

    Pair i covers symbols i and i + 1; ``joined`` tells whether pair i overlaps pair i + 1, rank 0 is no pair.
    """
    same = joined & (rank[1:] == rank[:-1])
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    ends = np.append(starts[1:], len(rank))
    before = np.where((starts > 0) & joined[starts - 1], rank[starts - 1], 0)
    after = np.where((ends < len(rank)) & np.append(joined, False)[ends - 1], np.append(rank, 0)[ends], 0)
    top = (rank[starts] > before) & (rank[starts] > after)
    place = np.arange(len(rank)) - np.repeat(starts, ends - starts)
    return np.flatnonzero(np.repeat(top, ends - starts) & (place % 2 == 0))


def re_pair(ids: np.ndarray) -> Grammar:
    """The grammar of a block of words; words of different documents have different ids."""
    n = len(ids)
    words = int(ids.max(initial=-1)) + 1
    wide = words + n + 1
    length = np.ones(wide, np.int64)
    first, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    known, symbols, used = np.zeros(0, np.int64), np.zeros(0, np.int64), words
    made, made_at, rest_at, rest_end = [], [], [], []
    symbol, at = ids.copy(), np.arange(n)
    while len(symbol):
        next_to = at[:-1] + length[symbol[:-1]] == at[1:]
        code = np.where(next_to, symbol[:-1] * wide + symbol[1:], -1 - np.arange(len(symbol) - 1))
        often = counted(code)
        pair = often > 1
        live = np.concatenate((pair, [False])) | np.concatenate(([False], pair))
        if not live.all():  # a symbol without a repeated pair keeps none however its neighbours are rewritten
            done = ~live
            rest_at.append(at[done])
            rest_end.append(at[done] + length[symbol[done]])
        if not pair.any():
            break
        rank = np.where(pair, (np.minimum(often, (1 << 30) - 1).astype(np.uint64) << np.uint64(33)) | (mixed(code.astype(np.uint64)) >> np.uint64(31)) | np.uint64(1), np.uint64(0))
        chosen = outranking(rank, np.ones(len(rank) - 1, bool))
        chosen = chosen[pair[chosen]]
        codes, index, inverse = np.unique(code[chosen], return_index=True, return_inverse=True)
        place = np.searchsorted(known, codes)
        old = place < len(known)
        old[old] = known[place[old]] == codes[old]
        number = np.empty(len(codes), np.int64)
        number[old] = symbols[place[old]]
        fresh = np.flatnonzero(~old)
        number[fresh] = used + np.arange(len(fresh))
        where = chosen[index[fresh]]
        first[number[fresh] - words] = at[where]
        left[number[fresh] - words] = length[symbol[where]]
        length[number[fresh]] = length[symbol[where]] + length[symbol[where + 1]]
        used += len(fresh)
        known, symbols = np.concatenate((known, codes[fresh])), np.concatenate((symbols, number[fresh]))
        order = np.argsort(known)
        known, symbols = known[order], symbols[order]
        made.append(number[inverse] - words)
        made_at.append(at[chosen])
        symbol[chosen] = number[inverse]
        live[chosen + 1] = False
        symbol, at = symbol[live], at[live]
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    rest_at, rest_end = join(rest_at), join(rest_end)
    order = np.argsort(rest_at)
    rules = used - words
    return Grammar(first[:rules], left[:rules], length[words:used], join(made), join(made_at), rest_at[order], rest_end[order])


def folded(low: np.ndarray, high: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halve sequences [low, high) of symbols down to single ones: (start, boundary, end) of all nodes."""
    nodes = []
    while len(low):
        wide = high - low > 1
        low, high = low[wide], high[wide]
        middle = (low + high) // 2
        nodes.append((starts[low], starts[middle], ends[high - 1]))
        low, high = np.concatenate((low, middle)), np.concatenate((middle, high))
    return tuple(np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*nodes, strict=True)) if nodes else (np.zeros(0, np.int64),) * 3


# --- runs ----------------------------------------------------------------------------------


def residue_powers(n: int, base: int, prime: int) -> np.ndarray:
    """base**0, base**1, ... modulo a prime below 2**31, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate((out, out * pow(base, len(out), prime) % prime))
    return out[:n]


class Words:
    """A block of ids with the hashes that comparisons need.

    Sums of codes times powers are taken modulo two primes: modulo 2**64 some regular texts would collide whatever the base.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        codes = mixed(ids.astype(np.uint64) + np.uint64(1))
        self.hashes = []
        for prime, base in PRIMES:
            power = residue_powers(n + 1, base, prime)
            sums = np.zeros(n + 1, np.int64)
            np.cumsum((codes % np.uint64(prime)).astype(np.int64) * power[:-1] % prime, out=sums[1:])
            self.hashes.append((prime, power, sums))
        lone = mixed(np.arange(n + 16, dtype=np.uint64) + np.uint64(1 << 40))
        self.threes = self.windows(codes, 3, lone)
        again = counted(self.windows(codes, 6, lone[: n + 8])) > 1
        self.repeated = np.concatenate(([0], np.cumsum(again)))

    @staticmethod
    def windows(codes: np.ndarray, width: int, lone: np.ndarray) -> np.ndarray:
        """Hashes of the windows of some words, from three places before the first word on; windows beyond the ends are like no other."""
        out, n = lone.copy(), len(codes) - width + 1
        if n > 0:
            out[3 : 3 + n] = sum(codes[k : k + n] * powers(16, 0xD6E8FEB86659FD93)[k + 1] for k in range(width))
        return out

    def near_repeats(self, boundary: np.ndarray) -> np.ndarray:
        """Whether one of the windows of six words at or just before a boundary recurs."""
        return self.repeated[boundary + 4] > self.repeated[np.maximum(boundary - 3, 0)]

    def common(self, a: np.ndarray, shift: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How many words from a on (or before a, if ``back``), at most ``limit``, equal those ``shift`` further."""
        low, high = np.zeros(len(a), np.int64), limit.copy()
        factors = [power[shift] for _, power, _ in self.hashes]
        while (low < high).any():
            middle = (low + high + 1) // 2
            start, end = (a - middle, a) if back else (a, a + middle)
            same = np.ones(len(a), bool)
            for (prime, _, sums), factor in zip(self.hashes, factors, strict=True):
                same &= (sums[end] - sums[start]) % prime * factor % prime == (sums[end + shift] - sums[start + shift]) % prime
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def crossing(words: Words, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs across the boundaries of nodes, inside the nodes: (node, start, end, period), with multiples of periods."""
    live = np.flatnonzero((high - low >= LEAST) & words.near_repeats(middle))
    found = []
    for back in (False, True):
        # q words right of the boundary lie in the run, or q words left of it
        widths = np.minimum(np.where(back, middle - low, high - middle), (high - low) // 2)[live]
        sums = np.concatenate(([0], np.cumsum(widths)))
        for start in range(0, int(sums[-1]), CANDIDATES):
            end = min(int(sums[-1]), start + CANDIDATES)
            a, b = int(np.searchsorted(sums, start, side="right")) - 1, int(np.searchsorted(sums, end, side="left"))
            counts = np.minimum(sums[a + 1 : b + 1], end) - np.maximum(sums[a:b], start)
            node = np.repeat(np.arange(a, b), counts)
            q = np.arange(start, end) - sums[node] + 1
            at = middle[live[node]] - (q if back else 0)
            maybe = (words.threes[at + 3] == words.threes[at + q + 3]) | ((at >= 3) & (words.threes[np.maximum(at, 3)] == words.threes[np.maximum(at + q, 3)]))
            node, q, at = live[node[maybe]], q[maybe], at[maybe]
            forward = words.common(at, q, high[node] - at - q, False)
            backward = words.common(at, q, at - low[node], True)
            size = forward + backward + q
            good = size >= np.maximum(2 * q, LEAST)
            found.append((node[good], (at - backward)[good], (at + q + forward)[good], q[good]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def smallest_periods(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows (..., period) that agree in all else, those of the smallest period."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for c in columns[:-1]:
        changed[1:] |= c[1:] != c[:-1]
    return tuple(c[changed] for c in columns)


def block_runs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[int]]:
    """All maximal runs (start, end, period) of a block by start and period, and the documents to be searched plainly.

    ``starts`` are the documents' first words, and the number of words.
    """
    words, grammar = Words(ids), re_pair(ids)
    cuts = np.searchsorted(grammar.rest_at, starts)
    low, middle, high = folded(cuts[:-1], cuts[1:], grammar.rest_at, grammar.rest_end)
    low = np.concatenate((grammar.first, low))
    middle = np.concatenate((grammar.first + grammar.left, middle))
    high = np.concatenate((grammar.first + grammar.length, high))
    node, start, end, period = smallest_periods(*crossing(words, low, middle, high))
    failed = set()
    for s, e, q in set(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)):
        if not np.array_equal(ids[s : e - q], ids[s + q : e]):
            failed.add(int(np.searchsorted(starts, s, side="right")) - 1)
    # to all positions of each nonterminal; nodes of the folded rest have one
    rules = len(grammar.first)
    inner = node < rules
    some = np.unique(node[inner])
    use = np.isin(grammar.made, some)
    made, made_at = grammar.made[use], grammar.made_at[use]
    order = np.argsort(made, kind="stable")
    made, made_at = made[order], made_at[order]
    a, b = np.searchsorted(made, node[inner]), np.searchsorted(made, node[inner], side="right")
    row = np.repeat(np.arange(len(a)), b - a)
    moved = made_at[np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[row]] - grammar.first[node[inner][row]]
    start = np.concatenate((start[~inner], start[inner][row] + moved))
    end = np.concatenate((end[~inner], end[inner][row] + moved))
    period = np.concatenate((period[~inner], period[inner][row]))
    # ids of other documents differ, so a run ends with its document
    extended = (start > 0) & (ids[start - 1] == ids[start - 1 + period])
    last = end < len(ids)
    extended[last] |= ids[end[last]] == ids[end[last] - period[last]]
    start, end, period = smallest_periods(start[~extended], end[~extended], period[~extended])
    order = np.lexsort((period, start))
    return start[order], end[order], period[order], failed


def plain_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of one document, period by period."""
    found = []
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate(([False], ids[q:] == ids[:-q], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2], edges[1::2] + q, strict=True):
            if e - s >= max(2 * q, LEAST):
                found.append((s, e, q))
    rows = np.array(found, np.int64).reshape(-1, 3)
    start, end, period = smallest_periods(*rows.T)
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def found_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: ids, distinct words, and the runs' starts, ends and periods."""

    def flush(held):
        sizes = [len(ids) for ids, _ in held]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        offsets = np.concatenate(([0], np.cumsum([len(words) for _, words in held])))
        block = np.concatenate([ids + o for (ids, _), o in zip(held, offsets, strict=False)])
        s, e, q, failed = block_runs(block, starts) if len(block) else (np.zeros(0, np.int64),) * 3 + (set(),)
        cuts = np.searchsorted(s, starts)
        for i, (ids, words) in enumerate(held):
            a, b = cuts[i], cuts[i + 1]
            yield ids, words, *(plain_runs(ids) if i in failed else (s[a:b] - starts[i], e[a:b] - starts[i], q[a:b]))

    held, size = [], 0
    for text in texts:
        ids, words = word_ids(text)
        if held and size + len(ids) > BLOCK:
            yield from flush(held)
            held, size = [], 0
        held.append((ids, words))
        size += len(ids)
    if held:
        yield from flush(held)


def collapsed(ids: np.ndarray, words: list[bytes], start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run repeats, joined by spaces."""
    if len(start):
        depth = np.zeros(len(ids) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, end, -1)
        ids = ids[np.cumsum(depth[:-1]) == 0]
    return b" ".join([words[i] for i in ids.tolist()])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``; ``runs`` are (start, length, period) by start and period."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, runs, texts = [], [], []
            for ids, words, start, end, period in found_runs(utf8(batch.column("text"))):
                counts.append(len(ids))
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True)])
                texts.append(collapsed(ids, words, start, end, period))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "runs": pa.array(runs, kind), "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, schema)


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run of each document, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("negative"), r["start"], r["period"])))
    length = -F.col("best.negative")
    return computed(found, {"best": best}).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_repeats(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``doc_id, text``: of about a tenth of the documents, picked by a hash of the id, the last part repeats one stretch of words.

    Documents with a null id stay as they are.
    """
    rows = computed(docs.select(doc_id.alias("doc_id"), text.alias("text")), {"h": F.crc32(F.col("doc_id").cast("string"))})
    picked = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    rows = computed(rows, {"words": F.when(picked, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))})
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = computed(rows, {"a": F.when(picked & (n > 0), g % n), "g": g})
    rows = computed(rows, {"p": 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))})
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
