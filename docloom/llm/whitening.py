"""Embedding whitening by an exact characteristic polynomial.

Components are quantised to integers y = floor(scale * c); a constant offset of all
components would cancel in every result and is not added.  The fit list holds each distinct vector
once, n of them with sums S.  Tasks add up the products of their vectors exactly, and

    A = n * sum(y y') - S S'  =  n**2 * covariance

is an integer matrix without any rounding.  Its characteristic polynomial is
found modulo many primes, one task row each, by reduction to Hessenberg form, and put
together by the Chinese remainder theorem; the number of primes follows from a
bound on the coefficients, and one prime more checks the result.

All roots are real, so the sign changes of the polynomial shifted by t count the
roots above t, with multiplicity (Budan and Fourier).  Bisection with that count
isolates the largest roots of the square-free part; Newton steps inside the
brackets refine them until their gaps are known to at least 100 bits.  Inverse iteration on A - root * I in
decimal arithmetic of matching precision gives the components, one task row per root; a multiple
root gives as many orthonormal vectors.

The driver holds numbers of the dimension's size: A, the coefficients modulo the primes,
the roots and the components.  Vectors are read where they lie; the fit list is
the only shuffle.

Defined results: vectors that are null or hold null or non-finite entries take no
part, nor do empty ones; of several lengths, the one that most rows have counts (of equals, the longest)
and other vectors take no part.  Null and repeated ids are kept, with a result for each row.
Only roots above 0 have components: fewer vectors, or constant dimensions, give fewer than asked, one distinct vector gives
none, and an empty table gives an empty table.  Each component's largest entry, the first of equals, is
positive.  ``deviation`` is null where it exceeds a long.  Other columns are not read.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .topk import quantised, usable

SCALE = 64
COMPONENTS = 16
LIMB = 40
GAP_BITS = 100

RESULT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- exact sums ----------------------------------------------------------------------------


def largest(y: np.ndarray) -> int:
    return max(int(y.max(initial=0)), -int(y.min(initial=0)))


def products(y: np.ndarray) -> np.ndarray:
    """y'y without rounding, as Python integers."""
    most = largest(y) ** 2 * len(y)
    if most < 1 << 53:
        y = y.astype(float)
        return (y.T @ y).astype(np.int64).astype(object)
    y = y if most < 1 << 63 else y.astype(object)
    return (y.T @ y).astype(object)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def limbs(total: np.ndarray) -> pa.RecordBatch:
    """The upper triangle in signed pieces of 40 bits, whose sums over many tasks fit into a long."""
    out: list[tuple[int, int, int, int]] = []
    for i in range(len(total)):
        for j in range(i, len(total)):
            value, sign, k = abs(int(total[i, j])), 1 if total[i, j] >= 0 else -1, 0
            while value:
                out.append((i, j, k, sign * (value & ((1 << LIMB) - 1))))
                value, k = value >> LIMB, k + 1
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "k", "part"])


def scatter(fit: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, S and sum(y y') of a table of ``y``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), object)
        for batch in batches:
            y = matrix_of(batch.column("y"), width)
            total = total + products(np.concatenate([y, np.ones((len(y), 1), np.int64)], axis=1))
        yield limbs(total)

    out = np.zeros((width + 1, width + 1), object)
    for row in fit.mapInArrow(add, "i int, j int, k int, part long").groupBy("i", "j", "k").agg(F.sum("part").alias("part")).collect():
        out[row["i"], row["j"]] += row["part"] << LIMB * row["k"]
    out = out + np.triu(out, 1).T
    return int(out[-1, -1]), out[-1, :-1], out[:-1, :-1]


# --- the characteristic polynomial ---------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 2**32."""
    if n % 2 == 0:
        return n == 2
    shift = ((n - 1) & -(n - 1)).bit_length() - 1
    odd = (n - 1) >> shift
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x not in (0, 1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(shift - 1)):
            return False
    return n > 1


def primes(count: int) -> list[int]:
    """The largest primes below 2**31."""
    out, n = [], (1 << 31) - 1
    while len(out) < count:
        if is_prime(n):
            out.append(n)
        n -= 2
    return out


def hessenberg_polynomial(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo p, highest power first."""
    h = (matrix % p).astype(np.int64)
    n = len(h)
    for m in range(1, n - 1):
        have = np.flatnonzero(h[m:, m - 1])
        if not len(have):
            continue
        i = m + int(have[0])
        if i != m:
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(1)) % p
    # rows: polynomials of the leading blocks, lowest power first
    rows = np.zeros((n + 1, n + 1), np.int64)
    rows[0, 0] = 1
    for k in range(1, n + 1):
        rows[k, 1:] = rows[k - 1, :-1]
        chain, factors = 1, np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            factors[i] = chain * int(h[i, k - 1]) % p
            chain = chain * int(h[i, i - 1]) % p if i else 0
            if not chain:
                break
        rows[k] = (rows[k] - (factors[:, None] * rows[:k] % p).sum(0)) % p
    return rows[n, ::-1].tolist()


def combined(residues: dict[int, list[int]]) -> list[int]:
    """Integers of least absolute value with the given residues."""
    values, modulus = [0] * len(next(iter(residues.values()))), 1
    for p, row in residues.items():
        inverse = pow(modulus, -1, p)
        values = [v + modulus * ((r - v) * inverse % p) for v, r in zip(values, row, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


def characteristic_polynomial(spark, matrix: np.ndarray) -> tuple[list[int], dict[int, list[int]]]:
    """The exact polynomial of a positive semidefinite integer matrix, and its residues.

    The coefficients' absolute values add up to the product of 1 + root, at most (1 + trace / d) ** d.
    """
    width, trace = len(matrix), int(np.trace(matrix))
    bits = width * (trace // width + 2).bit_length() + 2
    moduli = primes(bits // 30 + 2)

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"p": frame["p"], "row": [hessenberg_polynomial(matrix, int(p)) for p in frame["p"]]})

    tasks = min(len(moduli), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(tasks).mapInPandas(reduce, "p long, row array<long>").collect()
    residues = {r["p"]: list(r["row"]) for r in sorted(rows, key=lambda r: -r["p"])}
    check = moduli[-1]
    found = combined({p: row for p, row in residues.items() if p != check})
    if [c % check for c in found] != residues[check]:
        raise ArithmeticError("the characteristic polynomial disagrees with a further prime")
    return found, residues


# --- roots ---------------------------------------------------------------------------------


def derivative(f: list[int]) -> list[int]:
    return [c * (len(f) - 1 - i) for i, c in enumerate(f[:-1])]


def common_divisor(f: list[int], p: int) -> list[int]:
    """The monic greatest common divisor of f and its derivative modulo p."""
    a, b = [c % p for c in f], [c % p for c in derivative(f)]
    while True:
        while b and not b[0]:
            b = b[1:]
        if not b:
            return [c * pow(a[0], -1, p) % p for c in a]
        inverse, a = pow(b[0], -1, p), a[:]
        while len(a) >= len(b):
            q = a[0] * inverse % p
            a = [(x - q * y) % p for x, y in zip(a, b + [0] * (len(a) - len(b)), strict=True)][1:]
        a, b = b, a


def quotient(f: list[int], g: list[int]) -> list[int] | None:
    """f / g for a monic g, or None if it leaves a remainder."""
    f, out = f[:], []
    while len(f) >= len(g):
        out.append(f[0])
        f = [x - f[0] * y for x, y in zip(f, g + [0] * (len(f) - len(g)), strict=True)][1:]
    return None if any(f) else out


def square_free(f: list[int], moduli: list[int]) -> list[int]:
    """The monic polynomial with the same roots as f, each once."""
    found: dict[int, list[int]] = {}
    for p in moduli:
        g = common_divisor(f, p)
        if len(g) == 1:  # coprime modulo a prime, so coprime
            return f
        if found and len(g) < len(next(iter(found.values()))):
            found = {}
        if not found or len(g) == len(next(iter(found.values()))):
            found[p] = g
            g = combined(found)
            rest = quotient(f, g)
            if rest is not None and quotient(derivative(f), g) is not None:
                return rest
    raise ArithmeticError("no common divisor of the polynomial and its derivative was found")


def above(f: list[int], t: int, scale: int) -> int:
    """How many roots, with multiplicity, lie above t / 2**scale; all roots must be real."""
    f = [c << scale * i for i, c in enumerate(f)]
    for stop in range(len(f) - 1, 0, -1):
        for i in range(1, stop + 1):
            f[i] += t * f[i - 1]
    signs = [c > 0 for c in f if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolated(f: list[int], whole: list[int], top: int, count: int) -> list[tuple[Fraction, Fraction, int]]:
    """Brackets (low, high] of the largest positive roots, with multiplicities that add up to ``count`` and one root more.

    ``f`` is the square-free part of ``whole``; no root exceeds ``top``.
    """
    out, found = [], 0
    todo = [(0, top, 0, above(f, 0, 0), 0)]
    while todo:
        low, high, scale, more, less = todo.pop()
        if more == less:
            continue
        if more - less == 1:
            many = above(whole, low, scale) - above(whole, high, scale)
            out.append((Fraction(low, 1 << scale), Fraction(high, 1 << scale), many))
            if found >= count:
                return out
            found += many
            continue
        if high - low == 1:
            low, high, scale = low << 32, high << 32, scale + 32
        middle = (low + high) // 2
        at = above(f, middle, scale)
        todo += [(low, middle, scale, more, at), (middle, high, scale, at, less)]
    return out


def refined(f: list[int], low: Fraction, high: Fraction, scale: int) -> int:
    """The only root in (low, high], in units of 2**-scale, off by less than two of them."""
    f = [c << scale * i for i, c in enumerate(f)]
    slope = derivative(f)

    def value(g: list[int], t: int) -> int:
        out = 0
        for c in g:
            out = out * t + c
        return out

    a, b = math.floor(low * (1 << scale)), math.ceil(high * (1 << scale))
    rising = value(f, b) > 0
    if value(f, b) == 0:
        return b
    t = (a + b) // 2
    while b - a > 1:
        here = value(f, t)
        if here == 0:
            return t
        a, b = (a, t) if (here > 0) == rising else (t, b)
        steep = value(slope, t)
        step = t - here // steep if steep else a
        if a < step < b:
            # Newton lands next to the root: a bracket of a few units around it, if it holds the root
            left, right = max(a, step - 1), min(b, step + 1)
            if (value(f, left) > 0) != rising and (value(f, right) > 0) == rising:
                a, b = left, right
            t = step if step != t else (a + b) // 2
        else:
            t = (a + b) // 2
        if not a < t < b:
            t = (a + b) // 2
    return b


def roots(f: list[int], whole: list[int], top: int, count: int) -> tuple[list[tuple[int, int]], int]:
    """``(root in units of 2**-scale, multiplicity)`` falling, and the scale; gaps have at least 100 bits."""
    brackets = isolated(f, whole, top, count)
    scale = 64
    while True:
        found = [refined(f, low, high, scale) for low, high, _ in brackets]
        gaps = [a - b for a, b in zip(found, [*found[1:], 0], strict=True)]
        if min(gaps, default=1 << GAP_BITS) >= 1 << GAP_BITS:
            out, total = [], 0
            for root, (_, _, many) in zip(found, brackets, strict=True):
                if total < count:
                    out.append((root, many))
                total += many
            return out, scale
        scale += 64


# --- components ----------------------------------------------------------------------------


def null_vectors(matrix: np.ndarray, root: int, scale: int, many: int) -> list[list[float]]:
    """Orthonormal vectors of the null space of matrix - root / 2**scale, by inverse iteration in decimals."""
    n = len(matrix)
    digits = int((int(np.trace(matrix)).bit_length() + 2 * scale) * 0.302) + 40
    with decimal.localcontext(decimal.Context(prec=digits, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        one = decimal.Decimal(1)
        unit = one / (1 << scale)
        a = np.array([[decimal.Decimal(int(x)) for x in row] for row in matrix], object)
        a[np.diag_indices(n)] -= decimal.Decimal(root) * unit
        order = np.arange(n)
        for k in range(n):
            best = k + max(range(n - k), key=lambda i: abs(a[k + i, k]))
            a[[k, best]], order[[k, best]] = a[[best, k]], order[[best, k]]
            if abs(a[k, k]) < unit * unit:
                a[k, k] = unit * unit
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.multiply.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solved(b: np.ndarray) -> np.ndarray:
            x = b[order]
            for k in range(n):
                x[k + 1 :] -= a[k + 1 :, k] * x[k]
            for k in range(n - 1, -1, -1):
                x[k] /= a[k, k]
                x[:k] -= a[:k, k] * x[k]
            return x

        rng, found = np.random.default_rng(n), []
        starts = rng.integers(1, 1 << 30, (many, n))
        block = [np.array([decimal.Decimal(int(x)) for x in row], object) for row in starts]
        for _ in range(3):
            found = []
            for x in block:
                x = solved(x)
                for _again in range(2):
                    for other in found:
                        x = x - other * (other * x).sum()
                    x = x / (x * x).sum().sqrt()
                found.append(x)
            block = found
        out = []
        for x in found:
            first = max(range(n), key=lambda i: (abs(float(x[i])), -i))
            out.append([float(v if x[first] > 0 else -v) for v in x])
        return out


class Whitening(NamedTuple):
    """What turns a vector into its whitened form."""

    n: int
    sums: list[int]
    rows: np.ndarray
    explained: list[float]


def components(spark, n: int, sums: np.ndarray, matrix: np.ndarray, count: int) -> Whitening:
    trace = int(np.trace(matrix))
    if not trace:
        return Whitening(n, [int(s) for s in sums], np.zeros((0, len(matrix))), [])
    whole, residues = characteristic_polynomial(spark, matrix)
    found, scale = roots(square_free(whole, list(residues)), whole, trace, count)

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rank, root, many in frame.itertuples(index=False):
                rows = null_vectors(matrix, int(root), scale, int(many))
                yield pd.DataFrame({"rank": rank, "sub": range(len(rows)), "entries": rows})

    listed = spark.createDataFrame([(i, str(root), many) for i, (root, many) in enumerate(found)], "rank int, root string, many int")
    got = listed.repartition(len(found), "rank").mapInPandas(vectors, "rank int, sub int, entries array<double>").collect()
    rows, explained = [], []
    for r in sorted(got, key=lambda r: (r["rank"], r["sub"]))[:count]:
        root = Fraction(found[r["rank"]][0], 1 << scale)
        rows.append(np.array(r["entries"]) / math.sqrt(root))
        explained.append(float(root / trace))
    return Whitening(n, [int(s) for s in sums], np.array(rows), explained)


def centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    """n * y - S as whole numbers: longs, or Python integers where those do not suffice."""
    most = largest(y) * model.n + max(map(abs, model.sums))
    return y * model.n - np.array(model.sums, np.int64) if most < 1 << 62 else y.astype(object) * model.n - np.array(model.sums, object)


def squares(z: np.ndarray) -> list[int | None]:
    """Sums of squares by row."""
    if z.dtype == object or largest(z) ** 2 * z.shape[1] >= 1 << 63:
        return [None if (s := sum(int(x) ** 2 for x in row)) >= 1 << 63 else s for row in z]
    return (z * z).sum(1).tolist()


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    width, k = len(model.sums), len(model.rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            z = centred(matrix_of(batch.column("y"), width), model).astype(float) @ model.rows.T
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            total += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "value": total.ravel()})

    total = np.zeros((k + 1, k + 1))
    for row in fit.mapInArrow(add, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        total[row["i"], row["j"]] = row["value"]
    mean = total[-1, :-1] / model.n
    return float(np.abs(total[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, count: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(embedding))).select(F.col(vec_id).alias("vec_id"), quantised(F.col(embedding), scale).alias("y")).where(F.size("y") > 0)
    length = rows.groupBy(F.size("y").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    none = spark.createDataFrame([], RESULT.format(id=vectors.schema[vec_id].dataType.simpleString()))
    if length is None:
        return none
    width = length["width"]
    rows = rows.where(F.size("y") == width)
    fit = stored(rows.select("y").distinct(), "whitening-fit")
    n, sums, products_ = scatter(fit, width)
    model = components(spark, n, sums, n * products_ - np.multiply.outer(sums, sums), count)
    if not model.explained:
        return none
    error = identity_error(fit, model)

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(batch: pd.Series) -> pd.DataFrame:
        z = centred(np.stack(batch.to_list()) if len(batch) else np.zeros((0, width), np.int64), model)
        return pd.DataFrame({"deviation": pd.array(squares(z), "Int64"), "whitened": list(z.astype(float) @ model.rows.T)})

    done = rows.select("vec_id", project("y").alias("made")).select("vec_id", "made.deviation", F.posexplode("made.whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(x) for x in model.explained]), F.col("at") + 1)
    return done.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"))
