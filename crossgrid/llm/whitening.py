"""Whitening of integer vectors by the exact characteristic polynomial of their scatter.

Rows give sums, and, centred at the whole part of the mean, products: both are sums of integers, so the scatter
A = n^2 * covariance is an exact integer matrix. Its characteristic polynomial is found modulo many primes, a task for some
primes (Hessenberg form by similarity, then the recurrence over leading minors), and put together by Chinese remaindering;
the number of primes follows from a bound on the coefficients. All roots of the polynomial are real and none is negative,
so sign variations after a shift count the roots above a point exactly (Descartes): bisection isolates them, sign changes
narrow each one to far below double precision. Null vectors of A - root * I come from inverse iteration in integers of
fixed point; the vectors of a root of several components are made orthogonal there. What passes through the driver is
bounded by the number of dimensions (the matrix, the polynomial, the components), never by rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossgrid.llm import vectors
from crossgrid.llm.common import arrow_rows
from crossgrid.session import attach_params

#: Components of integer vectors are held within +- LIMIT; bits after the point of roots and of null vectors.
LIMIT, ROOT_BITS, GUARD = 1 << 31, 96, 96
_HALF = 1 << 40  # sums are passed as high * 2^40 + low


# -- the integer matrix -------------------------------------------------------------------------------------------------

def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, and for each dimension the rows that have it and their sum; dimension -1 counts rows."""
    n, met, total = 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        column = batch.column(0)
        d = max(len(met), int(column.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)))
        met, total = (np.pad(y, (0, d - len(y))) for y in (met, total))
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        n += len(sizes)
        met += (sizes[:, None] > np.arange(d)).sum(axis=0)
        total += vectors.matrix(column, d).sum(axis=0)
    yield pa.RecordBatch.from_pydict({"dim": range(-1, len(met)), "met": [n, *met.tolist()], "total": [0, *total.tolist()]}, _SUMS)


_SUMS = pa.schema([("dim", pa.int32()), ("met", pa.int64()), ("total", pa.int64())])
_CELLS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])


def matrix_of(column: pa.Array, d: int, offset: int) -> np.ndarray:
    """Integer vectors; what a short one lacks is ``offset``, the value of a zero."""
    out = vectors.matrix(column, d)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes < d).any():
        out = np.where(np.arange(d) < sizes[:, None], out, offset)
    return out


def _products(d: int, offset: int, middle: list[int]):
    """Sums over a task's rows of the products of centred components, upper triangle."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(d)
        total = np.zeros(len(i), dtype=object)
        for batch in batches:
            y = matrix_of(batch.column(0), d, offset) - np.array(middle)
            most = max(1.0, vectors.largest(y))
            step = int(min(max((1 << 53) // (most * most), 1), 1 << 14))
            for at in range(0, len(y), step):
                part = y[at : at + step]
                if most * most * len(part) <= 1 << 53:
                    part = part.astype(float)
                    total += (part.T @ part)[i, j].astype(np.int64).astype(object)
                else:
                    part = part.astype(object)
                    total += (part.T @ part)[i, j]
        high = total // _HALF
        yield arrow_rows({"i": i, "j": j, "high": high.tolist(), "low": (total - high * _HALF).tolist()}, _CELLS)

    return products


def scatter(rows: DataFrame, offset: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums per dimension and n^2 times the covariance of the vectors ``_x``, all exact."""
    sums = rows.select("_x").mapInArrow(_sums, "dim int, met long, total long").groupBy("dim").agg(
        F.sum("met").alias("met"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r.dim: (r.met, int(r.total)) for r in sums.collect()}
    n, d = found.get(-1, (0, 0))[0], max(found, default=-1) + 1
    total = [found[k][1] + (n - found[k][0]) * offset for k in range(d)]
    if not n or not d:
        return n, total, []
    middle = [t // n for t in total]
    cells = rows.select("_x").mapInArrow(_products(d, offset, middle), "i int, j int, high long, low long").groupBy("i", "j").agg(
        *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    rest = [t - n * m for t, m in zip(total, middle, strict=True)]
    out = [[0] * d for _ in range(d)]
    for r in cells.collect():
        out[r.i][r.j] = out[r.j][r.i] = n * (int(r.high) * _HALF + int(r.low)) - rest[r.i] * rest[r.j]
    return n, total, out


# -- the characteristic polynomial --------------------------------------------------------------------------------------

def is_prime(p: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 2^32."""
    if p < 2 or p % 2 == 0:
        return p == 2
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, p)
        if base % p and x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits."""
    out, p, have = [], (1 << 31) + 1, 0.0
    while have <= bits:
        p -= 2
        if is_prime(p):
            out.append(p)
            have += math.log2(p)
    return out


def polynomial_mod(a: list[list[int]], p: int) -> list[int]:
    """Coefficients modulo ``p`` of det(x I - a), lowest first."""
    d = len(a)
    h = np.array([[v % p for v in row] for row in a], dtype=np.int64).reshape(d, d)
    for k in range(d - 2):
        pivots = np.flatnonzero(h[k + 1 :, k])
        if not len(pivots):
            continue
        if r := int(pivots[0]):
            h[[k + 1, k + 1 + r]] = h[[k + 1 + r, k + 1]]
            h[:, [k + 1, k + 1 + r]] = h[:, [k + 1 + r, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), dtype=np.int64)
    minors[0, 0] = 1
    for k in range(d):
        lead = minors[k]
        out = (np.roll(lead, 1) - h[k, k] * lead % p) % p
        weight, below = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            weight[i] = int(h[i, k]) * below % p
        minors[k + 1] = (out - (weight[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d].tolist()


def remaindered(residues: list[tuple[int, int]]) -> int:
    """The integer of least magnitude with the given (prime, residue) pairs."""
    value, modulus = 0, 1
    for p, r in sorted(residues):
        value += modulus * ((r - value) * pow(modulus, -1, p) % p)
        modulus *= p
    return value - modulus if 2 * value > modulus else value


def characteristic(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - a), lowest first, for a positive semidefinite integer matrix."""
    d, trace = len(a), sum(a[k][k] for k in range(len(a)))
    mean = math.log2(trace) - math.log2(d) if trace else 0.0  # Maclaurin: the k-th coefficient is at most C(d, k) mean^k
    bits = max((math.log2(math.comb(d, k)) + k * max(mean, 0.0) for k in range(d + 1)), default=0.0)
    primes = primes_for(math.ceil(bits * 1.0001) + 8)

    def residues(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["p"].tolist():
                yield pd.DataFrame({"p": p, "k": range(d + 1), "r": polynomial_mod(a, p)})

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(frame["p"].tolist(), frame["r"].tolist(), strict=True))
        return pd.DataFrame({"k": frame["k"].iloc[:1], "c": [str(remaindered(pairs))]})

    asked = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    found = asked.mapInPandas(residues, "p long, k int, r long").groupBy("k").applyInPandas(joined, "k int, c string").collect()
    return [int(r.c) for r in sorted(found)]


# -- roots ----------------------------------------------------------------------------------------------------------------

def scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times those of ``poly``."""
    return [c << bits * (len(poly) - 1 - k) for k, c in enumerate(poly)]


def above(poly: list[int], point: int) -> int:
    """Number of roots above a point, for a polynomial without complex roots: sign variations of the shifted one."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += point * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def isolated(poly: list[int], most: int, limit: int) -> list[tuple[int, int, int, int]]:
    """(low, high, bits, roots) from the top until ``most`` roots are covered: so many roots lie in (low, high] / 2^bits.

    Several roots stay together only where they are nearer than 2^-ROOT_BITS. All roots lie in [0, limit]; 0 isn't given."""
    out: list[tuple[int, int, int, int]] = []
    todo = [(0, limit, 0, above(poly, 0), 0)]
    forms = {0: poly}
    while todo and sum(x[3] for x in out) < most:
        low, high, bits, at_low, at_high = todo.pop()
        if at_low == at_high:
            continue
        if at_low - at_high == 1 or high - low == 1 and bits >= ROOT_BITS:
            out.append((low, high, bits, at_low - at_high))
        elif high - low == 1:
            todo.append((low << 16, high << 16, bits + 16, at_low, at_high))
        else:
            if bits not in forms:
                forms[bits] = scaled(poly, bits)
            mid = (low + high) // 2
            at_mid = above(forms[bits], mid)
            todo += [(low, mid, bits, at_low, at_mid), (mid, high, bits, at_mid, at_high)]
    return out


def value(poly: list[int], point: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * point + c
    return out


def narrowed(poly: list[int], low: int, high: int, bits: int) -> int:
    """2^ROOT_BITS times the one simple root in (low, high] / 2^bits, rounded up."""
    more = max(0, ROOT_BITS - bits)
    form, low, high = scaled(poly, bits + more), low << more, high << more
    sign = value(form, high)
    while sign and high - low > 1:
        mid = (low + high) // 2
        at = value(form, mid)
        if at == 0:
            high = mid
            break
        low, high = (low, mid) if (at > 0) == (sign > 0) else (mid, high)
    return high


# -- null vectors ---------------------------------------------------------------------------------------------------------

def null_vectors(a: list[list[int]], root: int, m: int, rounds: int = 3) -> np.ndarray:
    """``m`` unit vectors at right angles that ``a - root / 2^ROOT_BITS`` turns to nothing, by inverse iteration."""
    d = len(a)
    bits = ROOT_BITS + GUARD + max(1, max(abs(v) for row in a for v in row)).bit_length()
    one = 1 << bits
    lu = np.array([[v << bits for v in row] for row in a], dtype=object).reshape(d, d)
    for k in range(d):
        lu[k, k] -= root << (bits - ROOT_BITS)
    order = list(range(d))
    for k in range(d):
        r = k + max(range(d - k), key=lambda i: abs(lu[k + i, k]))
        if r != k:
            lu[[k, r]] = lu[[r, k]]
            order[k], order[r] = order[r], order[k]
        if not lu[k, k]:
            lu[k, k] = 1  # the least there is
        if k + 1 < d:
            u = (lu[k + 1 :, k] << bits) // lu[k, k]
            lu[k + 1 :, k + 1 :] -= (u[:, None] * lu[k, k + 1 :]) >> bits
            lu[k + 1 :, k] = u

    def solved(b: np.ndarray) -> np.ndarray:
        z = b[order].copy()
        for k in range(d):
            z[k + 1 :] -= (lu[k + 1 :, k] * z[k]) >> bits
        for k in range(d - 1, -1, -1):
            z[k] = (z[k] << bits) // lu[k, k]
            z[:k] -= (lu[:k, k] * z[k]) >> bits
        return z

    def unit(z: np.ndarray) -> np.ndarray:
        length = math.isqrt(int((z * z).sum()))
        return (z << bits) // max(1, length)

    start = np.random.default_rng(13).integers(1, 1 << 20, (m, d))
    space = [unit(np.array([int(v) << (bits - 20) for v in row], dtype=object)) for row in start]
    for _ in range(rounds):
        turned: list[np.ndarray] = []
        for z in space:
            z = unit(solved(z))
            for _ in range(2):
                z = reduce(lambda x, y: x - ((y * ((x * y).sum() >> bits)) >> bits), turned, z)
            turned.append(unit(z))
        space = turned
    out = np.array([[int(v) / one for v in z] for z in space])
    lead = np.abs(out).argmax(axis=1)
    return out * np.sign(out[np.arange(m), lead])[:, None]


_PARTS = "first int, root string, vector array<double>"


def components(spark: SparkSession, a: list[list[int]], most: int) -> list[tuple[int, int, list[float]]]:
    """(number from 1, 2^ROOT_BITS times the eigenvalue, unit eigenvector) of the ``most`` largest eigenvalues above 0."""
    poly = characteristic(spark, a)
    trace = sum(a[k][k] for k in range(len(a)))
    found, first = [], 1
    for low, high, bits, m in isolated(poly, most, trace):
        found.append((first, m, bits, str(low), str(high)))
        first += m
    if not found:
        return []

    def turned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, m, bits, low, high in frame.itertuples(index=False):
                root = narrowed(poly, int(low), int(high), bits) if m == 1 else int(high)
                yield pd.DataFrame({"first": first, "root": str(root), "vector": null_vectors(a, root, m).tolist()})

    asked = spark.createDataFrame(found, "first int, m int, bits int, low string, high string").repartition(len(found))
    rows = sorted(asked.mapInPandas(turned, _PARTS).collect(), key=lambda r: r.first)
    return [(k, int(r.root), r.vector) for k, r in enumerate(rows, 1)][:most]


# -- whitened rows ----------------------------------------------------------------------------------------------------------

_OUT = pa.schema([("_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64())])
_SHARED = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])


class Whitener:
    """Centres integer vectors and projects them on scaled components."""

    def __init__(self, n: int, total: list[int], offset: int, axes: list[list[float]], spread: list[float]):
        self.n, self.d, self.offset = n, len(total), offset
        self.middle = np.array([t // n for t in total])
        self.rest = np.array([t - n * (t // n) for t in total])
        self.axes = np.array(axes).T / np.array(spread)

    def centred(self, column: pa.Array) -> np.ndarray:
        """Vectors less their whole middle."""
        return matrix_of(column, self.d, self.offset) - self.middle

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y - self.rest / self.n) @ self.axes

    def deviation(self, y: np.ndarray) -> np.ndarray:
        """Sums of squares of n x - S, held below 2^63."""
        most = self.n * vectors.largest(y) + float(self.rest.max(initial=0))
        if most * most * max(1, self.d) < 1 << 62:
            return ((self.n * y - self.rest) ** 2).sum(axis=1)
        z = self.n * y.astype(object) - self.rest.astype(object)
        return np.array([min(int(v), (1 << 63) - 1) for v in (z * z).sum(axis=1)], dtype=np.int64)


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    step = max(1, vectors.VALUES // max(1, d))
    for batch in batches:
        yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def whiten(
    rows: DataFrame, scale: float, offset: int, most: int = 32, *, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and each of ``most`` components.

    A component c of a vector becomes x = floor(scale * c) + offset, floor(scale * c) held within +- LIMIT. Covariances are
    over all usable rows with divisor n. Components are numbered from 1 by falling eigenvalue; the entry of largest magnitude
    of an eigenvector is positive. Components without variance aren't given, so a table of equal vectors, one row or none has
    no result. Components of one eigenvalue are some orthogonal ones, the same for all rows. Rows whose vector is null or
    holds null or non-finite components take no part; a null id stays one, repeated rows count each time. A vector shorter
    than the longest ends in zeros. ``deviation`` is held below 2^63. Other columns of ``rows`` are not read."""
    spark = rows.sparkSession
    x = F.transform(F.col(vector_col), lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c.cast("double") * scale))) + F.lit(offset).cast("long"))
    used = rows.filter(vectors.finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("_id"), x.alias("_x"))
    n, total, a = scatter(used, offset)
    trace = sum(a[k][k] for k in range(len(a)))
    common = math.gcd(*(v for row in a for v in row)) if trace else 1
    found = components(spark, [[v // common for v in row] for row in a], most) if trace else []
    names = [F.col("_id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened"]
    if not found:
        empty = spark.createDataFrame([], "_id long, component int, deviation long, whitened double, explained double, identity_error double")
        return empty.select(*names, "explained", "identity_error")
    values = [root * common for _, root, _ in found]  # 2^ROOT_BITS n^2 times the variances
    spread = [math.sqrt(v / (n * n << ROOT_BITS)) for v in values]
    turn = Whitener(n, total, offset, [v for _, _, v in found], spread)
    k = len(found)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, max(turn.d, k)):
            y = turn.centred(part.column(1))
            yield arrow_rows({
                "_id": part.column(0).take(pa.array(np.repeat(np.arange(len(y)), k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(y)),
                "deviation": np.repeat(turn.deviation(y), k), "whitened": turn.whitened(y).ravel()}, _OUT)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, k))
        for part in _parts(batches, turn.d):
            w = turn.whitened(turn.centred(part.column(1)))
            out += w.T @ w
        i, j = (y.ravel() for y in np.indices((k, k)))
        yield arrow_rows({"i": i, "j": j, "v": out.ravel()}, _SHARED)

    off = F.abs(F.col("v") / n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    error = used.mapInArrow(shared, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).agg(F.max(off).alias("identity_error"))
    share: Column = F.element_at(F.array(*(F.lit(v / (trace << ROOT_BITS)) for v in values)), F.col("component"))
    out = used.mapInArrow(project, "_id long, component int, deviation long, whitened double").select(*names, share.alias("explained"))
    return attach_params(out, error)
