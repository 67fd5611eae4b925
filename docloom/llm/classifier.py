"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; unlabelled web text is everything,
good and bad mixed.  A linear scorer minimises the non-negative unbiased risk

    prior * E_P[loss(g, +1)] + max(0, E_U[loss(g, -1)] - prior * E_P[loss(g, -1)])

with the logistic loss; while the second term is negative, its gradient is
reversed, which keeps the scorer from pushing the risk below zero.  No negative
label enters the risk.  The class prior is estimated over all labelled rows of
the learning fold as the share of good ones.

Features are taken from whole texts: hashed byte trigrams of the text with case
folded, byte-class trigrams (shape), and statistics of repetition, case and
marks.  Labels, language, source and ids are not features.

Bounds: the model is fitted on at most ``positives`` trusted and ``unlabelled``
other rows, the first in a pseudo-random order of ids; the prior and the scores
cover all rows.

Defined results: null and empty texts score as texts without any feature; if no
trusted positive exists, every score is the prior (0.5 without labels); rows with
a null id are held out; repeated rows are scored each; columns of the input named
as the results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_hash, held_out, mixed, prefix_polynomial, runs, span_hashes, stored

POSITIVES = 8_000
UNLABELLED = 16_000
TRIGRAMS = 512
SHAPES = 512
STATISTICS = 14
WIDTH = TRIGRAMS + SHAPES + STATISTICS
RESULTS = ("held_out", "score", "predicted")

#: Byte classes: lower, upper, digit, space, newline, mark, and bytes of other scripts.
CLASSES = np.array([3 if b in (32, 9) else 4 if b in (10, 13) else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 6 if b >= 128 else 5 for b in range(256)], np.uint8)
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def features(text: str | None) -> np.ndarray:
    """The feature vector of one text."""
    out = np.zeros(WIDTH, np.float32)
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return out
    kinds, n = CLASSES[data], len(data)
    for folded, at, size, base in ((FOLDED[data], 0, TRIGRAMS, 256), (kinds, TRIGRAMS, SHAPES, 7)):
        if n >= 3:
            wide = folded.astype(np.uint64)
            code = (wide[:-2] * np.uint64(base) + wide[1:-1]) * np.uint64(base) + wide[2:]
            slot = (code if base == 7 else mixed(code)) % np.uint64(size)
            count = np.bincount(slot.astype(np.int64), minlength=size)
            out[at : at + size] = np.sqrt(count / (n - 2))
    words, ends = runs((kinds != 3) & (kinds != 4))
    if len(words):
        hashes = span_hashes(prefix_polynomial(FOLDED[data]), words, ends)
        same, last = np.mean(hashes[1:] == hashes[:-1]) if len(hashes) > 1 else 0.0, kinds[ends - 1]
        shapes = (
            same, len(np.unique(hashes)) / len(hashes), np.mean(ends - words) / 16, np.std(ends - words) / 16,
            np.mean(last == 5), np.mean(kinds[words] == 1), np.log(len(words)) / 10, np.mean(ends - words == 1),
        )
        out[TRIGRAMS + SHAPES : TRIGRAMS + SHAPES + 8] = shapes
    letters = max(1, int(np.sum((kinds <= 1) | (kinds == 6))))
    lines = np.bincount(kinds, minlength=7) / n
    out[TRIGRAMS + SHAPES + 8 :] = (np.sum(kinds == 1) / letters, lines[5], lines[2], lines[4] * 10, np.mean(kinds[1:] == kinds[:-1]) if n > 1 else 0.0, min(1.0, n / 200))
    return out


def nonnegative_risk(good: np.ndarray, mixture: np.ndarray, prior: float, rounds: int = 60, rate: float = 0.05, penalty: float = 1e-5, batch: int = 1024, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the risk by Adam over mini-batches of both samples."""
    rng, width = np.random.default_rng(seed), good.shape[1]
    weight = np.zeros(width + 1)
    first, second, step = np.zeros_like(weight), np.zeros_like(weight), 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    parts = max(1, len(mixture) // batch)
    for r in range(rounds):
        p_order, u_order = rng.permutation(len(good)), rng.permutation(len(mixture))
        for p_part, u_part in zip(np.array_split(p_order, parts), np.array_split(u_order, parts), strict=True):
            xp, xu = good[p_part if len(p_part) else p_order], mixture[u_part]
            gp, gu = xp @ weight[:-1] + weight[-1], xu @ weight[:-1] + weight[-1]
            negative = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
            up, uu = prior * (sigmoid(gp) - 1) / len(xp), np.zeros(len(xu))
            if negative >= 0:
                up, uu = up - prior * sigmoid(gp) / len(xp), sigmoid(gu) / len(xu)
            else:
                up, uu = prior * sigmoid(gp) / len(xp), -sigmoid(gu) / len(xu)
            slope = np.append(up @ xp + uu @ xu, up.sum() + uu.sum())
            slope[:-1] += penalty * weight[:-1]
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            weight -= rate * (1 - r / rounds) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weight[:-1], float(weight[-1])


class Model:
    """Standardisation, weights and bias."""

    def __init__(self, good: np.ndarray, mixture: np.ndarray, prior: float):
        """Fit on two matrices, which are standardised in place."""
        parts = [slice(i, i + 1024) for i in range(0, len(mixture), 1024)]
        self.mean = mixture.mean(0)
        self.scale = np.sqrt(sum(((mixture[part] - self.mean) ** 2).sum(0, dtype=float) for part in parts) / len(mixture)).astype(np.float32) + np.float32(1e-3)
        self.weight, self.bias = nonnegative_risk(self.ready(good, good), self.ready(mixture, mixture), prior)

    def ready(self, x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        out = np.subtract(x, self.mean, out=out)
        out /= self.scale
        return np.clip(out, -8, 8, out=out)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.ready(x) @ self.weight + self.bias, -30, 30)))


def vectors(rows: DataFrame) -> np.ndarray:
    """The stored vectors in order of ids, in one array; the fetched table goes as soon as it is copied."""
    table = rows.select("_id", "x").toArrow().sort_by("_id")
    out, at = np.empty((table.num_rows, WIDTH), np.float32), 0
    for batch in table.to_batches(max_chunksize=1024):
        for x in batch.column("x"):
            out[at] = np.frombuffer(x.as_buffer(), np.float16)
            at += 1
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | float:
    """The model, or a constant score if there is nothing to learn from."""
    known = labels.where(~held_out(F.col(doc_id)) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_label"))
    share = known.agg(F.avg((F.col("_label") == 1).cast("double"))).first()[0]
    prior = min(0.95, max(0.05, share)) if share is not None else 0.5
    good = by_hash(known.where("_label = 1").select("_id"), "_id", positives, 1).select("_id", F.lit(True).alias("_good"))
    web = by_hash(docs.select(F.col(doc_id).alias("_id")).where("_id is not null"), "_id", unlabelled, 2).select("_id", F.lit(False).alias("_good"))

    @F.pandas_udf("binary")
    def vector(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: features(t).astype(np.float16).tobytes())

    # at most ``positives + unlabelled`` ids are broadcast, and as many vectors of 2 kB collected
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(good.union(web)), "_id")
    rows = stored(chosen.select("_id", "_good", vector("_text").alias("x")), "quality-sample")
    p, u = vectors(rows.where("_good")), vectors(rows.where("NOT _good"))
    return Model(p, u, prior) if len(p) and len(u) else prior


def score_column(model: Model | float, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if isinstance(model, float):
                yield pd.Series(np.full(len(batch), model))
            else:
                values = [model.score(np.array([features(t) for t in batch[i : i + 128]])) for i in range(0, len(batch), 128)]
                yield pd.Series(np.concatenate(values) if values else np.zeros(0))

    return score(text)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Add ``held_out, score, predicted`` to every row."""
    model = fit(docs, labels, doc_id=doc_id, text=text, **options)
    others = [c for c in docs.columns if c not in RESULTS]
    scored = docs.select(*others, held_out(F.col(doc_id)).alias("held_out"), score_column(model, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
