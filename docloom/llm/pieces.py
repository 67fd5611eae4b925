"""SentencePiece encoding and decoding with merge-type vocabularies.

Adjacent symbols whose concatenation is a piece wait in an agenda ordered by
score, then position.  The best pair merges, its neighbours enter the agenda,
and entries whose symbols have meanwhile changed are passed over.  Symbols that
are no piece at the end fall back to byte pieces, or to the unknown id.
New segments of a batch share one agenda, an array with the piece that each pair of
neighbours makes; in every round the best pair of each segment merges.  Only long
segments have a heap of their own.

The text is cut where no piece of the vocabulary can cross: before white space
after other characters, and between alphanumeric and other characters if no
piece mixes them.  Segments recur, so their ids are kept in a bounded cache.
Every Arrow batch is checked against the sentencepiece library; a difference
raises an error.

Defined results: a null or empty text has the begin and end ids only and decodes
to the empty text; extra columns stay as they are, except columns named as the
results, which are replaced; repeated rows are encoded each; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments whose ids a worker remembers from task to task: at most 64 characters each.
CACHE_ENTRIES = 800_000
#: Characters up to which segments share an agenda, and may be remembered.
SHORT = 64
#: Characters of text whose segments are looked up together.
TOGETHER = 1 << 20
#: Numbers of no symbol: the end of a segment, and one that has merged into its neighbour.
END, GONE = 1 << 30, -1


class Agenda:
    """Encoder of one merge-type model."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        count = self.library.get_piece_size()
        self.unknown = self.library.unk_id()
        special = {i for i in range(count) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)}
        self.ids = {self.library.id_to_piece(i): i for i in range(count) if i not in special}
        self.scores = {piece: self.library.get_score(i) for piece, i in self.ids.items()}
        names = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = names if all(self.library.is_byte(i) for i in names) else None
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            self.cut = None
        elif any(re.search(r"[^\W_][\W_]|[\W_][^\W_]", piece.lstrip(SPACE)) for piece in self.ids):
            self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.cut = re.compile(rf"{SPACE}*(?:[^\W_]+|(?:_|[^\w{SPACE}])+)|{SPACE}+")
        self.cache: dict[str, tuple[int, ...]] = {}
        # symbols are numbered: pieces first, then the characters that are none by their code
        numbers = {piece: n for n, piece in enumerate(self.ids)}
        self.symbol_ids = list(self.ids.values())
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + len(numbers)
        for piece, n in numbers.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = n
        symbol = lambda part: int(self.symbol_of[ord(part)]) if len(part) == 1 else numbers.get(part)
        pairs = {}
        for piece, n in numbers.items():
            for i in range(1, len(piece)):
                left, right = symbol(piece[:i]), symbol(piece[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = n
        self.pairs = np.array([*sorted(pairs), np.iinfo(np.int64).max])
        # no pair makes the piece -1, whose score is the lowest
        self.makes = np.array([*(pairs[k] for k in sorted(pairs)), -1])
        self.score_of = np.array([*self.scores.values(), -np.inf])

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols make, -1 for none."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.makes[at], -1)

    def merged_together(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Ids of short segments of similar length: each round merges the best pair, the leftmost of equals, of every segment."""
        sizes = np.array([len(s) for s in segments])
        width = int(sizes.max()) + 1  # with an end mark, which makes no piece with any symbol
        symbols = np.full((len(segments), width), GONE)
        symbols[np.arange(width) < sizes[:, None]] = self.symbol_of[np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")]
        symbols[:, -1] = END
        place = np.arange(symbols.size).reshape(symbols.shape)
        end = place[:, -1:]
        after, before = np.where(np.arange(1, width + 1) < sizes[:, None], place + 1, end).ravel(), np.where(np.arange(width) > 0, place - 1, end).ravel()
        pair = np.full(symbols.shape, -1)
        pair[:, :-1] = self.made(symbols[:, :-1], symbols[:, 1:])
        scores = self.score_of[pair]
        symbols, pair, score, rows = symbols.ravel(), pair.ravel(), scores.reshape(-1), np.arange(len(segments))
        while len(rows):
            first = rows * width + scores[rows].argmax(1)
            rows, first = rows[pair[first] >= 0], first[pair[first] >= 0]
            second, previous = after[first], before[first]
            then = after[second]
            symbols[first], symbols[second] = pair[first], GONE
            after[first], before[then] = then, first
            pair[second], score[second] = -1, -np.inf
            for left, right in ((first, then), (previous, first)):
                pair[left] = made = self.made(symbols[left], symbols[right])
                score[left] = self.score_of[made]
        kept = (symbols != GONE) & (symbols != END)
        ends = np.cumsum(kept.reshape(len(segments), width).sum(1)).tolist()
        known, ids = len(self.symbol_ids), symbols[kept].tolist()
        if max(ids) < known:
            ids = [self.symbol_ids[n] for n in ids]
            return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        fallback = lambda n: [self.bytes[b] for b in chr(n - known).encode()] if self.bytes else [self.unknown]
        each = [[self.symbol_ids[n]] if n < known else fallback(n) for n in ids]
        return [tuple(chain.from_iterable(each[a:b])) for a, b in zip([0, *ends], ends, strict=False)]

    def merged(self, text: str) -> list[int]:
        """Ids of one segment."""
        whole = self.ids.get(text)
        symbols, scores = list(text), self.scores
        if whole is not None and len(symbols) == 1:
            return [whole]
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        agenda = []
        for i in range(len(symbols) - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((-scores[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or len(symbols[left]) + len(symbols[right]) != len(pair) or after[left] != right:
                continue
            symbols[left], symbols[right] = pair, None
            then = after[left] = after[right]
            if then < len(symbols):
                before[then] = left
                pair = symbols[left] + symbols[then]
                if pair in scores:
                    heapq.heappush(agenda, (-scores[pair], left, then, pair))
            first = before[left]
            if first >= 0:
                pair = symbols[first] + symbols[left]
                if pair in scores:
                    heapq.heappush(agenda, (-scores[pair], first, left, pair))
        out = []
        for symbol in symbols:
            if symbol is not None:
                known = self.ids.get(symbol)
                if known is not None:
                    out.append(known)
                elif self.bytes:
                    out += [self.bytes[b] for b in symbol.encode()]
                else:
                    out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; segments that are not remembered are merged together."""
        find, get = self.cut.findall if self.cut else lambda text: [text], self.cache.get
        rows, new = [], {}
        for text in texts:
            segments = find(SPACE + text.replace(" ", SPACE)) if text else []
            ids = list(map(get, segments))
            unknown = [s for s, x in zip(segments, ids, strict=True) if x is None] if None in ids else []
            new.update(dict.fromkeys(unknown))
            rows.append((ids, unknown) if unknown else list(chain.from_iterable(ids)))
        least = 0
        for most in (SHORT // 8, SHORT // 4, SHORT // 2, SHORT):
            some = [s for s in new if least < len(s) <= most]
            new.update(zip(some, self.merged_together(some) if some else [], strict=True))
            least = most
        new.update([(s, self.merged(s)) for s, x in new.items() if x is None])
        for i, row in enumerate(rows):
            if isinstance(row, tuple):
                found = map(new.__getitem__, row[1])
                rows[i] = list(chain.from_iterable([next(found) if x is None else x for x in row[0]]))
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
        self.cache.update((s, x) for s, x in new.items() if len(s) <= SHORT)
        return rows

    def together(self, texts: list[str]) -> Iterator[list[str]]:
        """Texts in runs of about ``TOGETHER`` characters."""
        run, size = [], 0
        for text in texts:
            if run and size + len(text) > TOGETHER:
                yield run
                run, size = [], 0
            run.append(text)
            size += len(text)
        if run:
            yield run

    def batch(self, texts: list[str]) -> list[list[int]]:
        """Ids with begin and end, checked against the library."""
        begin, end = self.library.bos_id(), self.library.eos_id()
        ours = [[begin, *ids, end] for run in self.together(texts) for ids in self.encode_all(run)]
        for text, got in zip(texts, ours, strict=True):
            if got != self.library.encode(text, add_bos=True, add_eos=True):
                raise ValueError(f"ids differ from the library's for a text that begins with {text[:80]!r}")
        return ours


@lru_cache(maxsize=1)
def agenda_of(model: str) -> Agenda:
    """One encoder per worker process: later tasks find the model loaded and common segments known."""
    return Agenda(model)


def encode_and_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Add ``piece_ids`` (array of int, with begin and end) and ``decoded`` (the text those ids stand for)."""

    @F.pandas_udf("piece_ids array<int>, decoded string")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        agenda = agenda_of(model)
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            ids = [x for i in range(0, len(texts), 64) for x in agenda.batch(texts[i : i + 64])]
            yield pd.DataFrame({"piece_ids": [np.array(x, np.int32) for x in ids], "decoded": [agenda.library.decode(x) for x in ids]})

    others = [c for c in docs.columns if c not in ("piece_ids", "decoded")]
    return docs.withColumn("_pieces", pieces(F.col(text))).select(*others, "_pieces.piece_ids", "_pieces.decoded")


def piece_digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document, without moving ids out of the workers."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        agenda = agenda_of(model)
        for batch in batches:
            rows = []
            texts = ["" if t is None else t for t in batch]
            for i in range(0, len(texts), 64):
                some = agenda.batch(texts[i : i + 64])
                for ids, text_ in zip(some, agenda.library.decode(some), strict=True):
                    rows.append((len(ids), hashlib.sha256(np.fromiter(ids, "<u4", len(ids)).tobytes()).hexdigest(), hashlib.sha256(text_.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.col(text)).alias("_pieces")).select("doc_id", "_pieces.*")
