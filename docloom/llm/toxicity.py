"""Toxicity by a factorization machine over hashed terms.

    g(x) = b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

Terms are words and word beginnings, hashed; the factors v learn which terms
matter together (an insult next to the mention of a group), which no sum of
single weights can express.  x_i is 1 if the term occurs.  The pair sum is taken
as half of (sum v)^2 - sum v^2, so that its cost is linear in the terms.

Of the hashed terms only those go into the model that differ between toxic and
other texts of the learning fold beyond chance (log-likelihood ratio); all other
terms are ignored when scoring.

Bounds: the model is fitted on at most ``positives`` toxic and ``negatives``
other labelled rows, the first in a pseudo-random order of ids, and has at most
``terms`` terms.  Scores correct for the sample's share of toxic rows and cover
whole texts of all rows.

Defined results: null and empty texts score as texts without terms; without rows
of both labels every score is the share of toxic rows (0 without labels); rows
with a null id are held out; repeated rows are scored each; columns of the input
named as the results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_hash, held_out, joined, mixed, prefix_polynomial, runs, span_hashes

POSITIVES = 6_000
NEGATIVES = 12_000
TERMS = 4_096
FACTORS = 6
BITS = 20
BEGINNINGS = (4, 5, 6, 8)
RESULTS = ("held_out", "score", "predicted")

#: Letters of all scripts go on a word; case of A-Z is folded.
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def hashed_terms(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Blocks of texts: row numbers and hashed terms of their words and word beginnings, and the number of rows."""
    raw = [(t or "").encode() for t in texts]
    for start, end in blocks(raw):
        data, begins = joined(raw[start:end], b"\n")
        data = FOLDED[data]
        first, last = runs(LETTER[data])
        sums, row = prefix_polynomial(data), np.searchsorted(begins, first, side="right") - 1
        rows, terms = [row], [mixed(span_hashes(sums, first, last))]
        for k, size in enumerate(BEGINNINGS):
            long = last - first >= size
            rows.append(row[long])
            terms.append(mixed(span_hashes(sums, first[long], first[long] + size) + np.uint64(k + 1)))
        yield np.concatenate(rows), (np.concatenate(terms) >> np.uint64(64 - BITS)).astype(np.int64), end - start


def distinct_terms(texts: list[str | None], slot: np.ndarray | None = None) -> list[np.ndarray]:
    """Distinct terms of each text; with ``slot``, the numbers that known terms have in the model."""
    out = []
    for rows, terms, count in hashed_terms(texts):
        if slot is not None:
            terms = slot[terms]
            rows, terms = rows[terms >= 0], terms[terms >= 0]
        pairs = np.unique((rows.astype(np.int64) << BITS) | terms)
        cuts = np.searchsorted(pairs >> BITS, np.arange(1, count))
        out += np.split(pairs & ((1 << BITS) - 1), cuts)
    return out


def telling_terms(docs: list[np.ndarray], toxic: np.ndarray, limit: int, least: float = 14.0) -> np.ndarray:
    """Terms whose frequencies in the two classes differ beyond chance, the most telling first."""
    size, counts = 1 << BITS, []
    for flag in (True, False):
        some = [d for d, t in zip(docs, toxic, strict=True) if t == flag]
        counts.append(np.bincount(np.concatenate(some), minlength=size).astype(float))
    total = np.array([toxic.sum(), (~toxic).sum()], float)
    both, ratio = counts[0] + counts[1], np.zeros(size)
    for have, n in zip(counts, total, strict=True):
        for seen, share in ((have, both / total.sum()), (n - have, 1 - both / total.sum())):
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio += np.where((seen > 0) & (share > 0), 2 * seen * np.log(seen / (n * share)), 0.0)
    best = np.argsort(-ratio, kind="stable")[:limit]
    return best[ratio[best] > least]


class Machine:
    """Slots of known terms, weights, factors and bias."""

    def __init__(self, docs: list[np.ndarray], toxic: np.ndarray, share: float, terms: int, rounds: int = 30, rate: float = 0.08, penalty: float = 1e-4, seed: int = 11):
        known = telling_terms(docs, toxic, terms)
        self.slot = np.full(1 << BITS, -1, np.int32)
        self.slot[known] = np.arange(len(known))
        rng = np.random.default_rng(seed)
        self.weight, self.factor, self.bias = np.zeros(len(known)), rng.normal(0, 0.01, (len(known), FACTORS)), 0.0
        rows = [self.slot[d][self.slot[d] >= 0] for d in docs]
        sums = np.full(len(known), 1e-6), np.full((len(known), FACTORS), 1e-6)
        bias_sum = 1e-6
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for part in np.array_split(order, max(1, len(order) // 128)):
                flat, owner = self.flat([rows[i] for i in part])
                value, pooled = self.raw(flat, owner, len(part))
                slope = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - toxic[part]) / len(part)
                steps = slope[owner]
                grad_w = np.bincount(flat, steps, len(known)) + penalty * self.weight * 0.1
                grad_v = np.zeros_like(self.factor)
                np.add.at(grad_v, flat, steps[:, None] * (pooled[owner] - self.factor[flat]))
                grad_v += penalty * self.factor
                sums[0][:] += grad_w**2
                sums[1][:] += grad_v**2
                bias_sum += slope.sum() ** 2
                self.weight -= rate * grad_w / np.sqrt(sums[0])
                self.factor -= 0.25 * rate * grad_v / np.sqrt(sums[1])
                self.bias -= rate * slope.sum() / np.sqrt(bias_sum)
        sampled = toxic.mean()
        self.bias += np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)) if 0 < share < 1 else 0.0

    @staticmethod
    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def raw(self, flat: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of rows given as terms and their owners, and the sums of the factors."""
        pooled = np.stack([np.bincount(owner, self.factor[flat, f], count) for f in range(FACTORS)], 1)
        squares = np.bincount(owner, (self.factor[flat] ** 2).sum(1), count)
        return self.bias + np.bincount(owner, self.weight[flat], count) + 0.5 * ((pooled**2).sum(1) - squares), pooled

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows = distinct_terms(texts, self.slot)
        flat, owner = self.flat(rows)
        return 1 / (1 + np.exp(-np.clip(self.raw(flat, owner, len(rows))[0], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", positives: int = POSITIVES, negatives: int = NEGATIVES, terms: int = TERMS) -> Machine | float:
    """The machine, or a constant score if one of the classes is missing."""
    known = labels.where(~held_out(F.col(doc_id)) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label"))
    share = known.agg(F.avg((F.col("_label") == 1).cast("double"))).first()[0] or 0.0
    chosen = by_hash(known.where("_label = 1"), "_id", positives, 3).union(by_hash(known.where("_label = 0"), "_id", negatives, 4))

    @F.pandas_udf("binary")
    def terms_of(batch: pd.Series) -> pd.Series:
        return pd.Series([t.astype(np.int32).tobytes() for t in distinct_terms(list(batch))], dtype=object)

    # at most ``positives + negatives`` ids are broadcast, and as many lists of terms collected
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.select("_id", "_label", terms_of("_text").alias("x")).toPandas().sort_values(["_id", "x"])
    toxic = (rows["_label"] == 1).to_numpy()
    if not toxic.any() or toxic.all():
        return float(share)
    return Machine([np.frombuffer(x, np.int32) for x in rows["x"]], toxic, share, terms)


def score_column(machine: Machine | float, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.full(len(batch), machine) if isinstance(machine, float) else machine.score(list(batch)))

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Add ``held_out, score, predicted`` to every row."""
    machine = fit(docs, labels, doc_id=doc_id, text=text, **options)
    others = [c for c in docs.columns if c not in RESULTS]
    scored = docs.select(*others, held_out(F.col(doc_id)).alias("held_out"), score_column(machine, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
