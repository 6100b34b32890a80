"""Integer vectors, and the units in which a stated query set meets all rows.

Usable rows have an id and a vector without null or non-finite components. A component x becomes floor(scale * x), x as
double, held within the range of a long. A vector shorter than the longest counts as ending in zeros.

A query set meets all rows in units. Queries are dealt to tiles of a fixed number, rows to blocks of a fixed number of
values and blocks to lanes; a unit (tile, lane) holds one tile, one block at a time and what it has found so far. The
number of blocks of a lane grows with the root of their number, so that neither the tasks nor the rows which a query gets
back grow with all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crossgrid.llm.common import sorted_groups
from crossgrid.session import materialize

#: Queries of a tile, values of a block, least number of blocks of a lane, partitions that units are dealt to at most.
TILE, VALUES, LANE, PARTITIONS = 512, 1 << 17, 4, 20_000
_LONG = (-(1 << 63), (1 << 63) - 1)


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def integers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(rows: DataFrame, scale: float, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """(_id, _x, further columns) of the rows that take part."""
    kept = rows.filter(F.col(id_col).isNotNull() & finite(F.col(vector_col)))
    return kept.select(F.col(id_col).cast("long").alias("_id"), integers(F.col(vector_col), scale).alias("_x"), *more)


def size_of(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and the length of the longest vector."""
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("_x"))).first()
    return n, d or 0


def matrix(column: pa.ChunkedArray | pa.Array, d: int, dtype=np.int64) -> np.ndarray:
    """A column of lists as a matrix of ``d`` columns, filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) * d == len(values):
        return values.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), dtype=dtype)
    out[np.arange(d) < sizes[:, None]] = values
    return out


def largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(float)).max(initial=0))


def held(score):
    """Bounds of scores that are themselves held within the range of a long."""
    return np.clip(score, *map(float, _LONG))


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of a vector with the rows of a matrix, held within the range of a long."""
    if largest(q) * largest(x) * max(1, len(q)) < 1 << 53:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    at = x.astype(object) @ q.astype(object)
    return np.array([min(max(int(v), _LONG[0]), _LONG[1]) for v in at], dtype=np.int64)


class Best:
    """The ``k`` highest (score, id) met so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def least(self) -> float:
        """What a row must reach to be among them."""
        return float(self.score[-1]) if self.k and len(self.score) == self.k else -math.inf

    def add(self, score: np.ndarray, ident: np.ndarray) -> None:
        score, ident = np.concatenate([self.score, score]), np.concatenate([self.id, ident])
        order = np.lexsort((ident, ~score))[: self.k]  # ~score falls where score rises, at the ends of the range too
        self.score, self.id = score[order], ident[order]


def kth_highest(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, len(x) - k)[len(x) - k]) if 0 < k <= len(x) else -math.inf


def numbered(queries: DataFrame, label: str) -> DataFrame:
    """Each distinct query with a number, written once."""
    return materialize(queries.distinct().withColumn("_q", F.monotonically_increasing_id()), label)


def _up_to(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def run_units(
    queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, d: int, schema: str,
    unit: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], *, tile: int = TILE, values: int = VALUES,
) -> DataFrame:
    """``unit`` is given, for one tile after the other, the table of its queries (``_block`` -1) and then blocks of rows."""
    tiles = max(1, math.ceil(n_queries / tile))
    blocks = max(1, math.ceil(n_rows / max(1, values // max(1, d))))
    lanes = math.ceil(blocks / max(LANE, math.isqrt(blocks)))
    place = F.monotonically_increasing_id()
    q = queries.withColumn("_tile", F.pmod(F.col("_q"), F.lit(tiles))).withColumn("_lane", F.explode(_up_to(lanes)))
    q = q.withColumn("_block", F.lit(-1).cast("long"))
    r = rows.withColumn("_block", F.pmod(place, F.lit(blocks))).withColumn("_lane", F.pmod(F.col("_block"), F.lit(lanes)))
    r = r.withColumn("_tile", F.explode(_up_to(tiles)))
    at = ((F.col("_tile") * lanes + F.col("_lane")) % PARTITIONS).cast("int")
    met = q.unionByName(r, allowMissingColumns=True).repartitionById(min(tiles * lanes, PARTITIONS), at).sortWithinPartitions("_tile", "_lane", "_block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from unit(sorted_groups(batches, ["_tile", "_lane", "_block"]))

    return met.mapInArrow(work, schema)
