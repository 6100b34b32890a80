"""Exact top-k search by inner product: aggregation of sorted lists without random access.

A block of rows holds one list per dimension, sorted by component. The score of a row is the sum of its contributions
q[d] * x[d], so a query reads each list in order, from the end where its contributions are highest. Lists are read a stretch
at a time, first the stretches that lower the bounds most. For a row the contributions met so far are known; one not yet
met in list d is at most the frontier of d (the last one read) and at least the floor of d (the far end of the list). Known
ones plus frontiers bound a score from above, known ones plus floors from below. A row is out once its upper bound is below
the k-th best (lower bound, or score of an earlier block of the unit). While the sum of all frontiers reaches the k-th best,
rows never met may still qualify and nothing is out; afterwards only rows that were met can remain. Reading stops when the
rows still in are so few that to resolve their final scores takes less than to read on, or at the end of the lists. Scores
are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from crossgrid.llm import vectors
from crossgrid.llm.common import arrow_rows
from crossgrid.llm.vectors import Best

#: Stretches of a list, rounds in which all stretches are read at most.
STRETCHES, ROUNDS = 16, 10

FOUND = "_q long, vec_id long, score long"
_FOUND = pa.schema([("_q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Lists:
    """The sorted lists of a block: places and components of each dimension, first from the low end, then from the high end.

    Components are held as shares of the largest one in single precision; what that rounds away is allowed for."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        n, d = x.shape
        self.ids, self.x, self.most = ids, x, max(1.0, vectors.largest(x))
        low = np.argsort(x, axis=0, kind="stable").T
        values = (np.take_along_axis(x.T, low, axis=1) / self.most).astype(np.float32)
        low = low + n * np.arange(d)[:, None]  # places in a matrix [dimension, row]
        fill = ((0, 0), (0, -n % STRETCHES))  # the last entry again up to whole stretches
        cut = (2 * d, STRETCHES, -(-n // STRETCHES))
        self.places = np.concatenate([np.pad(y, fill, "edge") for y in (low, low[:, ::-1])]).reshape(cut)
        self.values = np.concatenate([np.pad(y, fill, "edge") for y in (values, values[:, ::-1])]).reshape(cut)
        self.first, self.last = self.values[:, 0, 0], self.values[:, :, -1]
        self.met, self.bound = np.empty((d, n), dtype=np.float32), np.empty((d, n), dtype=np.float32)


def candidates(lists: Lists, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, float]:
    """Rows that may be among the ``k`` best with a score of at least ``least``, and the share of the lists that was read."""
    n, d = lists.x.shape
    if not n or not d:
        return np.arange(n), 0.0
    unit = max(1.0, vectors.largest(q))
    weight = (q / unit).astype(np.float32)
    whole = unit * lists.most
    least = (least if least > -(1 << 63) else -np.inf) / whole  # scores are held within the range of a long
    read = np.arange(d) + d * (weight >= 0)  # the lists to read
    slack = (d + 4) * 2.0**-23 * (float(np.abs(weight).sum()) + (abs(least) if least > -np.inf else 0.0))
    met, bound = lists.met, lists.bound
    met.fill(-np.inf)  # contributions not yet met
    after = weight[:, None] * lists.last[read]  # frontiers after each stretch
    frontier, floor = weight * lists.first[read], after[:, -1]

    def at_least(unmet: np.ndarray) -> np.ndarray:
        """Scores, with ``unmet`` in the place of what was not met: it is no higher than what was."""
        return np.maximum(met, unmet[:, None], out=bound).sum(axis=0)

    # a stretch lowers the bounds of all rows not met before it
    gain = (np.concatenate([frontier[:, None], after[:, :-1]], axis=1) - after) * np.arange(STRETCHES, 0, -1)
    order = np.argsort(-np.minimum.accumulate(gain, axis=1), axis=None, kind="stable")  # a list's stretches in their order
    inside, bar = np.arange(n), least
    step = -(-len(order) // ROUNDS)
    for at in range(0, len(order), step):
        if len(inside) <= -(-n // ROUNDS):
            return inside, at / len(order)
        dim, stretch = np.divmod(order[at : at + step], STRETCHES)
        met.reshape(-1)[lists.places[read[dim], stretch]] = weight[dim][:, None] * lists.values[read[dim], stretch]
        np.minimum.at(frontier, dim, after[dim, stretch])
        if least > -np.inf and frontier.sum() + slack >= least:
            continue  # a row never met may still qualify
        if least == -np.inf:
            bar = min(vectors.kth_highest(at_least(floor), k) - slack, float(1 << 63) / whole)
        inside = np.flatnonzero(at_least(frontier) + slack >= bar)
    return inside, 1.0


def _unit(k: int, d: int):
    def unit(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for number, best in zip(numbers, bests, strict=True):
                if len(best.id):
                    yield arrow_rows({"_q": np.full(len(best.id), number), "vec_id": best.id, "score": best.score}, _FOUND)

        numbers, bests = [], []
        for group in groups:
            ids, x = group["_id"].to_numpy(), vectors.matrix(group["_x"], d)
            if group["_block"][0].as_py() < 0:
                yield from found()
                numbers, query_ids, queries = group["_q"].to_pylist(), ids.tolist(), x
                bests = [Best(k) for _ in numbers]
                continue
            lists = Lists(ids, x)
            for own, q, best in zip(query_ids, queries, bests, strict=True):
                repeats = int((ids == own).sum())  # the query's own rows are met like others, so so many more are asked for
                rows, _ = candidates(lists, q, k + repeats, best.least)
                rows = rows[ids[rows] != own]
                best.add(vectors.inner(q, x[rows]), ids[rows])
        yield from found()

    return unit


def top_k(rows: DataFrame, is_query: Column, k: int, scale: float, *, id_col: str = "vec_id", vector_col: str = "embedding",
          tile: int = vectors.TILE, values: int = vectors.VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest inner product with each query (all, if fewer).

    ``is_query`` is a condition on the columns of ``rows``. Ties go to the smaller id, ranks count from 1. Candidates are
    all rows of another id. Rows with a null id or a vector that is null or holds null or non-finite components take no
    part. A vector shorter than the longest ends in zeros, an empty one has score 0 with all. A repeated row is a candidate
    each time; repeated equal queries are answered once, different ones of one id each. Components and scores are held
    within the range of a long. No queries or no rows: no result. Other columns of ``rows`` are not read."""
    all_rows = vectors.usable(rows, scale, id_col, vector_col)
    queries = vectors.numbered(vectors.usable(rows.filter(is_query), scale, id_col, vector_col), "queries")
    (n, d), m = vectors.size_of(all_rows), queries.count()
    found = vectors.run_units(queries, all_rows, m, n, d, FOUND, _unit(k, d), tile=tile, values=values)
    best = Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(queries.select("_q", F.col("_id").alias("query_id")), "_q").select("query_id", "rank", "vec_id", "score")
