"""Vector operators of crossgrid.llm against brute force, and the cases that their docstrings define."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from crossgrid.llm import hard_negatives, queries, top_k, vectors, whitening

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<double>, label int, _id string, _x string, _label double, score string, rank string"


def table(spark, rows):
    """Vectors with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, x, y, "a", "b", 0.5, "c", "d") for i, x, y in rows], ROWS)


INF, NAN = float("inf"), float("nan")
EDGES = [
    (0, [1.0, 2.0, -1.0], 1), (100, [0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5], 1), (200, [], 2), (300, [3.0], 2), (1, [1.0, 2.0, -1.0], 1),
    (2, [1.0, 2.0, -1.0], 1), (3, None, 1), (4, [1.0, None, 2.0], 1), (5, [1.0, INF, 0.0], 2), (6, [NAN, 0.0, 0.0], 2), (None, [1.0, 1.0, 1.0], 1),
    (7, [0.0, 0.0, 0.0], 2), (8, [2.0, -2.0, 0.25], None), (9, [-1.0, 0.1, 0.7], 2), (9, [-1.0, 0.1, 0.7], 2), (400, [1e300, -1e300, 1e30], 2), (10, [1e25, 1.0, 1.0], 1)]


def whole(x, scale, low=-(1 << 63), high=(1 << 63) - 1):
    return [min(max(math.floor(scale * c), low), high) if abs(c) < 1e290 else (high if c > 0 else low) for c in x]


def usable(rows, scale, labelled=False):
    return [
        (i, whole(x, scale), y) for i, x, y in rows
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x) and not (labelled and y is None)]


def dot(x, y):
    return min(max(sum(a * b for a, b in zip(x, y, strict=False)), -(1 << 63)), (1 << 63) - 1)


def plain_top_k(rows, k, scale):
    rows, out = usable(rows, scale), []
    asked = {(i, tuple(x)) for i, x, _ in rows if i % 100 == 0}
    for i, q in asked:
        best = sorted((-dot(q, x), j) for j, x, _ in rows if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def plain_negatives(rows, scale, k=5):
    rows, out = usable(rows, scale, True), []
    for i, q, y in {(i, tuple(x), y) for i, x, y in rows if i % 100 == 0}:
        scored = sorted((-dot(q, x), j, z) for j, x, z in rows if j != i)
        for p, pid, _ in [s for s in scored if s[2] == y][:k]:
            fit = [s for s in scored if s[2] != y and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, pid, r, j, -p, -s) for r, (s, j, _) in enumerate(fit, 1)]
    return sorted(out)


def random_rows(seed, n, d=12, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, d)).astype(float) if ties else rng.normal(size=(n, d)) * rng.choice([0.1, 1.0, 20.0], (n, 1))
    return [(int(i) * 20, v.tolist(), int(y)) for i, v, y in zip(rng.permutation(n), x, rng.integers(0, 4, n), strict=True)]


# -- top k ----------------------------------------------------------------------------------------------------------------

def found_top_k(spark, rows, k, scale, **sizes):
    out = top_k.top_k(table(spark, rows), F.col("vec_id") % 100 == 0, k, scale, **sizes)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("seed", "ties", "k"), [(1, False, 10), (2, True, 10), (3, True, 1), (4, False, 1000)])
def test_top_k_is_exact(spark, seed, ties, k):
    rows = random_rows(seed, 300, ties=ties)
    assert found_top_k(spark, rows, k, 16, tile=7, values=12 * 40) == plain_top_k(rows, k, 16)


def test_top_k_edges(spark):
    assert found_top_k(spark, EDGES, 3, 1024, tile=2, values=6) == plain_top_k(EDGES, 3, 1024)
    assert found_top_k(spark, [], 3, 1024) == []
    assert found_top_k(spark, [(100, [1.0], 1)], 3, 1024) == []
    assert found_top_k(spark, [(1, [1.0], 1), (2, [1.0], 1)], 3, 1024) == []


def test_a_third_of_the_rows_is_one_vector(spark):
    rows = [*random_rows(5, 200), *[(1, [9.0] * 12, 1)] * 100]
    assert found_top_k(spark, rows, 5, 16, values=12 * 16) == plain_top_k(rows, 5, 16)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 9), st.integers(1, 12), st.booleans())
def test_candidates_hold_the_best(seed, n, d, k, bounded):
    rng = np.random.default_rng(seed)
    x = rng.integers(-5, 6, (n, d)) * int(rng.choice([1, 1000, 1 << 40]))
    q = rng.integers(-5, 6, d)
    scores = vectors.inner(q, x)
    least = float(np.sort(scores)[::-1][min(k, n) - 1]) if bounded else -math.inf
    rows, share = top_k.candidates(top_k.Lists(np.arange(n), x), q, k, least)
    best = np.lexsort((np.arange(n), ~scores))[:k]
    wanted = {int(r) for r in best if scores[r] >= least}
    assert wanted <= set(rows.tolist()) and 0 <= share <= 1


def test_lists_are_not_read_to_the_end():
    rng = np.random.default_rng(6)
    x = np.floor(1024 * rng.normal(size=(2048, 8))).astype(np.int64)
    lists = top_k.Lists(np.arange(2048), x)
    rows, share = top_k.candidates(lists, x[0], 10, float(np.sort(x @ x[0])[-10]))
    assert share < 0.7 and 10 <= len(rows) < 300


# -- hard negatives -------------------------------------------------------------------------------------------------------

def found_negatives(spark, rows, scale, **sizes):
    out = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, F.col("label"), scale, **sizes)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("seed", "ties", "levels"), [(1, False, 4), (2, True, 1), (3, True, 3)])
def test_hard_negatives_are_exact(spark, seed, ties, levels):
    rows = random_rows(seed, 300, d=70 if seed == 1 else 12, ties=ties)
    want = plain_negatives(rows, 16)
    assert want and found_negatives(spark, rows, 16, tile=7, values=12 * 40, levels=levels) == want


def test_hard_negatives_edges(spark):
    assert found_negatives(spark, EDGES, 256, tile=2, values=6) == plain_negatives(EDGES, 256)
    assert found_negatives(spark, [], 256) == []
    assert found_negatives(spark, [(100, [1.0], 1), (1, [1.0], 2)], 256) == []  # no positive
    assert found_negatives(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [-1.0], 2)], 256) == []  # no negative that fits


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 150), st.integers(1, 5))
def test_intervals_hold_the_score(seed, d, levels):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(40, d)) * rng.choice([0, 1, 100, 1e6], (40, 1))).astype(np.int64)
    q = np.floor(rng.normal(size=d) * 50).astype(np.int64)
    x[0] = q
    codes, align, rest, norm = hard_negatives.coded(x, levels)
    block = hard_negatives.Block.__new__(hard_negatives.Block)
    block.codes, block.align, block.rest, block.norm = codes.transpose(1, 2, 0), align.T, rest.T, norm
    anchor, known, rows, width = hard_negatives.Anchor(q), np.zeros(40), np.arange(40), []
    for level in range(levels):
        known, lower, upper = anchor.intervals(block, rows, level, known)
        assert (lower <= x @ q).all() and (x @ q <= upper).all()
        width.append((upper - lower).sum())
    assert width == sorted(width, reverse=True) or d < 3


def test_popcounts_give_the_inner_product():
    rng = np.random.default_rng(8)
    q = rng.integers(-90, 90, 100)
    anchor = hard_negatives.Anchor(q)
    signs = rng.random((5, 100)) < 0.5
    held = anchor.low + anchor.step * np.rint((hard_negatives.rotation(100) @ q - anchor.low) / anchor.step)
    got = anchor.along(hard_negatives._packed(signs).T)
    assert np.allclose(got, np.where(signs, 1, -1) @ held / 10)


def test_queries_agree_with_plain_search(spark):
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op12(spark, SF).select("query_id", "rank", "vec_id", "score").collect()) == plain_top_k(rows, 10, 1024)
    moved = [(i, x, (y + 1) % 10 if i % 7 == 0 else y) for i, x, y in rows]
    assert sorted(tuple(r) for r in queries.op11(spark, SF).collect()) == plain_negatives(moved, 256)


# -- whitening --------------------------------------------------------------------------------------------------------------

def exact_scatter(x):
    n, d = len(x), len(x[0]) if x else 0
    s = [sum(r[k] for r in x) for k in range(d)]
    return s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def plain_polynomial(a):
    """Faddeev and LeVerrier, in fractions."""
    d = len(a)
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)) / k)
    return [int(v) for v in reversed(c)]


def semidefinite(seed, d, rank=None, low=-9, high=10):
    b = np.random.default_rng(seed).integers(low, high, (rank or d, d)).astype(object)
    return [[int(v) for v in row] for row in b.T @ b]


@pytest.mark.parametrize("a", [
    semidefinite(1, 6), semidefinite(2, 9, 4), [[0, 0], [0, 0]], [[5]], [[2, 0, 0], [0, 2, 0], [0, 0, 7]], semidefinite(3, 5, low=-(10**12), high=10**12)])
def test_characteristic_polynomial(spark, a):
    want = plain_polynomial(a)
    assert whitening.characteristic(spark, a) == want
    p = whitening.primes_for(10)[0]
    assert p == (1 << 31) - 1 and whitening.polynomial_mod(a, p) == [c % p for c in want]


def test_primes_and_remainders():
    sieve = [p for p in range(2000) if p > 1 and all(p % k for k in range(2, math.isqrt(p) + 1))]
    assert [p for p in range(2000) if whitening.is_prime(p)] == sieve
    for v in (0, 1, -1, 10**25, -(10**26) - 7):
        primes = whitening.primes_for(100)
        assert whitening.remaindered([(p, v % p) for p in primes]) == v


def test_roots_are_counted_isolated_and_narrowed():
    roots = [0, 0, 3, 7, 7, 7, 1000, 10**9]
    poly = [1]
    for r in roots:
        poly = [x - r * y for x, y in zip([0, *poly], [*poly, 0], strict=True)]
    for point in (0, 2, 3, 6, 7, 999, 1000, 10**9):
        assert whitening.above(poly, point) == sum(r > point for r in roots)
    found = whitening.isolated(poly, 8, 2 * 10**9)
    assert [(m, low < r * 2**bits <= high) for (low, high, bits, m), r in zip(found, (10**9, 1000, 7, 3), strict=True)] == [(1, True), (1, True), (3, True), (1, True)]
    assert found[2][1] - found[2][0] == 1 and found[2][2] >= whitening.ROOT_BITS
    assert [whitening.narrowed(poly, *x[:3]) >> whitening.ROOT_BITS for x in found if x[3] == 1] == [10**9, 1000, 3]
    root = whitening.narrowed([-2, 0, 1], 0, 2, 0)  # the root of two
    assert 0 <= root**2 - (2 << 2 * whitening.ROOT_BITS) <= 3 * root


def rank(a):
    a, out = [[Fraction(c) for c in row] for row in a], 0
    for k in range(len(a)):
        if pivot := next((row for row in a[out:] if row[k]), None):
            a.remove(pivot)
            a.insert(out, pivot)
            out += 1
            for i in range(out, len(a)):
                a[i] = [x - a[i][k] / pivot[k] * y for x, y in zip(a[i], pivot, strict=True)]
    return out


def check_whitening(spark, rows, scale, offset, most=32):
    """The result against exact sums and numpy's eigendecomposition."""
    used = [(i, whole(x, scale, -whitening.LIMIT, whitening.LIMIT)) for i, x, _ in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    d = max((len(x) for _, x in used), default=0)
    x = [[c + offset for c in v] + [offset] * (d - len(v)) for _, v in used]
    got = whitening.whiten(table(spark, rows), scale, offset, most)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    s, a = exact_scatter(x)
    n = len(x)
    v = np.array([[float(Fraction(c, n * n)) for c in row] for row in a]).reshape(d, d) if n else np.zeros((0, 0))
    e = np.linalg.eigvalsh(v)[::-1]
    k = min(most, rank(a))
    assert len(got) == n * k
    if not k:
        return got
    assert {r.n for r in got} == {n}
    assert all(abs(r.explained - e[r.component - 1] / v.trace()) < max(1e-9 * r.explained, 1e-14) for r in got)
    (error,) = {r.identity_error for r in got}
    assert error < 1e-8
    deviation = sorted((-1 if i is None else i, min((1 << 63) - 1, sum((n * c - t) ** 2 for c, t in zip(y, s, strict=True)))) for (i, _), y in zip(used, x, strict=True))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.deviation) for r in got if r.component == 1) == deviation
    return got


@pytest.mark.parametrize(("seed", "n", "d", "most"), [(1, 60, 5, 32), (2, 4, 6, 32), (3, 50, 40, 32), (4, 30, 3, 2)])
def test_whitening_of_random_rows(spark, seed, n, d, most):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = check_whitening(spark, rows, 64, 1_000_000, most)
    k = max(r.component for r in got)
    w = np.zeros((n, k))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    y = np.floor(64 * x)
    y = y - y.mean(axis=0)
    e, u = np.linalg.eigh(y.T @ y / n)
    want = (y @ u[:, ::-1][:, :k]) / np.sqrt(e[::-1][:k])
    signs = np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want * signs, atol=1e-7)
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-9)


def test_whitening_of_equal_and_near_eigenvalues(spark):
    square = [(k, [s * (k == j) for j in range(4) for s in [sign]], 1) for k in range(4) for sign in (1.0, -1.0)]
    got = check_whitening(spark, square, 1, 7)  # one eigenvalue, four components
    assert {round(r.explained, 12) for r in got} == {0.25}
    near = [(1, [1000.0, 0.0], 1), (2, [-1000.0, 0.0], 1), (3, [0.0, 1000.0], 1), (4, [0.0, -1000.0], 1), (5, [1.0, 0.0], 1), (6, [-1.0, 0.0], 1)]
    got = check_whitening(spark, near, 1, 0)
    assert all((abs(r.whitened) < 1e-12) == (r.vec_id in (3, 4)) for r in got if r.component == 1)


def test_whitening_edges(spark):
    check_whitening(spark, [r for r in EDGES if r[0] not in (400, 10)], 64, 1_000_000)
    check_whitening(spark, EDGES, 64, 1_000_000)
    for rows in ([], [(1, None, 1)], [(1, [], 1)], [(1, [0.5, 0.25], 1)], [(1, [0.5, 0.25], 1)] * 5):
        assert check_whitening(spark, rows, 64, 1_000_000) == []


def test_whitening_query(spark):
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op13(spark, SF).collect()
    assert len(got) == 32 * len(rows) and max(r.identity_error for r in got) < 1e-9
    x = np.floor(64 * np.array([x for _, x, _ in rows]))
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert all(abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 for r in got)
