"""Bootstrap intervals of R2 per cell with many replicates.

All replicates of a row are drawn at once as a vector, and only sums per (task, cell, replicate) leave a task. A draw never
depends on how the rows are dealt to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from crossgrid.functions import hashing as H
from crossgrid.session import materialize

#: Rows of a piece of a cell, on average at most; rows whose weights are held at once.
PIECE, CHUNK = 512, 128
_SUMS = "_cell long, rep int, sw double, sz double, szz double, se double, lo double, hi double"
# Distribution function of the Poisson distribution with mean 1 at 0, 1, 2, ...: as far as 32 bits tell it from 1.
POISSON_CDF = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))
#: Constants of a 32-bit mixer, fixed values.
MIX = (0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35)


class Sums:
    """Weighted sums of one cell for all replicates."""

    def __init__(self, n_boot: int):
        self.s = np.zeros((4, n_boot))
        self.lo, self.hi = np.full(n_boot, np.inf), np.full(n_boot, -np.inf)
        self.varies = False  # whether the labels drawn differ in every replicate: no more is asked of lo and hi

    def add(self, weight: np.ndarray, y: np.ndarray, f: np.ndarray, mean: float) -> None:
        """``weight``: [row, replicate]."""
        z = y - mean
        self.s += np.stack([np.ones_like(z), z, z * z, (y - f) ** 2]) @ weight
        if not self.varies:
            drawn = weight > 0
            self.lo = np.minimum(self.lo, np.where(drawn, y[:, None], np.inf).min(axis=0))
            self.hi = np.maximum(self.hi, np.where(drawn, y[:, None], -np.inf).max(axis=0))
            self.varies = bool((self.lo < self.hi).all())

    def frame(self, cell: int) -> pd.DataFrame:
        sw, sz, szz, se = self.s
        return pd.DataFrame({"_cell": cell, "rep": np.arange(1, len(sw) + 1), "sw": sw, "sz": sz, "szz": szz, "se": se, "lo": self.lo, "hi": self.hi})


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Parts of equal integer keys, in the order of rows that are sorted by them; a key may come in several parts."""
    for frame in frames:
        if len(frame):
            at = frame[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield tuple(at[a].tolist()), frame.iloc[a:b]


def _rows(preds: DataFrame, cell: list[str], label: str, pred: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with a cell number, cells with number, size, mean): cells are counted first."""
    both = preds.filter(F.col(label).isNotNull() & F.col(pred).isNotNull())
    rows = both.select(*cell, F.col(label).cast("double").alias("_y"), F.col(pred).cast("double").alias("_f"), *more)
    cells = materialize(
        rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_m")).withColumn("_cell", F.monotonically_increasing_id()), "cells")
    return rows.join(cells, cell), cells


def _summary(sums: DataFrame, cells: DataFrame, cell: list[str], ci: float) -> DataFrame:
    """Mean, spread and percentile interval per cell; ``percentile`` buffers one number per replicate."""
    total = sums.groupBy("_cell", "rep").agg(*[F.sum(c).alias(c) for c in ("sw", "sz", "szz", "se")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    r2 = F.when(F.col("hi") > F.col("lo"), 1 - F.try_divide(F.col("se"), F.col("szz") - F.try_divide(F.col("sz") * F.col("sz"), F.col("sw"))))
    tail = (1 - ci) / 2
    out = total.withColumn("r2", r2).groupBy("_cell").agg(
        F.avg("r2").alias("r2_boot_mean"), F.coalesce(F.stddev_samp("r2"), F.lit(0.0)).alias("r2_boot_std"),
        F.percentile("r2", tail).alias("ci_lower"), F.percentile("r2", 1 - tail).alias("ci_upper"), F.count("r2").alias("n_boot")).filter("n_boot > 0")
    return cells.join(out, "_cell").select(*cell, "r2_boot_mean", "r2_boot_std", "ci_lower", "ci_upper", "n_boot")


# -- exact resampling -----------------------------------------------------------------------------------------------------

def _generator(seed: int, cell_hash: int, level: int, prefix: int, leaf: bool) -> np.random.Generator:
    words = [seed, cell_hash & (1 << 64) - 1, level, prefix, int(leaf)]
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence(words)))


def piece_counts(path: list, piece: int, n_boot: int, seed: int, cell_hash: int) -> np.ndarray:
    """How many of the n draws of each replicate fall into a piece.

    A cell's pieces are the leaves of a binary tree over hash prefixes. ``path`` holds, from the root down, the rows of a
    node and those of its left child; a binomial draw splits a node's draws, the same for every piece below it."""
    level = len(path)
    counts = np.full(n_boot, path[0][0] if path else 0, dtype=np.int64)
    for k, (rows, left) in enumerate(path):
        prefix = piece >> (level - k)
        to_left = _generator(seed, cell_hash, k, prefix, False).binomial(counts, left / rows)
        counts = counts - to_left if piece >> (level - k - 1) & 1 else to_left
    return counts


def draw(counts: np.ndarray, rows: int, rng: np.random.Generator) -> np.ndarray:
    """Draws with replacement among ``rows`` rows as weights [row, replicate]."""
    n_boot = len(counts)
    row = rng.integers(0, rows, int(counts.sum()))
    return np.bincount(row * n_boot + np.repeat(np.arange(n_boot), counts), minlength=rows * n_boot).reshape(rows, n_boot).astype(float)


def _resampled(n_boot: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def finish() -> None:
            rows = pd.concat(parts, ignore_index=True)
            head, body = rows.iloc[0], rows.iloc[1:]
            path = list(zip(map(int, head["_rows"]), map(int, head["_left"]), strict=True))
            counts = piece_counts(path, int(head["_piece"]), n_boot, seed, int(head["_hash"])) if path else np.full(n_boot, len(body))
            rng = _generator(seed, int(head["_hash"]), len(path), int(head["_piece"]), True)
            sums.add(draw(counts, len(body), rng), body["_y"].to_numpy(), body["_f"].to_numpy(), float(head["_m"]))

        key, parts, sums = None, [], None
        for now, part in _runs(frames, ["_cell", "_piece"]):
            if now != key:
                if parts:
                    finish()
                if key is None or now[0] != key[0]:
                    if sums is not None:
                        yield sums.frame(key[0])
                    sums = Sums(n_boot)
                key, parts = now, []
            parts.append(part)
        if parts:
            finish()
            yield sums.frame(key[0])

    return run


def bootstrap_r2(preds: DataFrame, cell: list[str], row_key: list[str], label: str, pred: str, n_boot: int, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of R2 per cell from exact resampling with replacement: the draws of a replicate add up to the
    cell's rows.

    ``row_key`` tells rows apart. Rows are dealt to pieces of a cell by a hash of it; draws are split over the pieces by
    binomial numbers and within a piece drawn row by row. Rows are shuffled once, draws never."""
    rows, cells = _rows(preds, cell, label, pred, F.xxhash64(*row_key).alias("_h"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / PIECE))).cast("int")
    piece = F.when(bits > 0, F.call_function("shiftrightunsigned", F.col("_h"), 64 - bits)).otherwise(F.lit(0).cast("long"))
    dealt = materialize(rows.select("_cell", piece.alias("_piece"), bits.alias("_bits"), "_h", "_y", "_f"), "dealt")
    pieces = dealt.groupBy("_cell", "_piece", "_bits").agg(F.count(F.lit(1)).alias("n"))
    level = pieces.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_bits"))))
    level = level.withColumn("_prefix", F.call_function("shiftright", F.col("_piece"), F.col("_bits") - F.col("_level")))
    nodes = materialize(level.groupBy("_cell", "_level", "_prefix").agg(F.sum("n").alias("rows")), "nodes")
    left = nodes.filter("_level > 0 and _prefix % 2 = 0").select(
        "_cell", (F.col("_level") - 1).alias("_level"), F.call_function("shiftright", F.col("_prefix"), F.lit(1)).alias("_prefix"), F.col("rows").alias("left"))
    split = nodes.join(left, ["_cell", "_level", "_prefix"], "left").fillna(0, ["left"])
    path = level.filter("_level < _bits").join(split, ["_cell", "_level", "_prefix"]).groupBy("_cell", "_piece").agg(
        F.array_sort(F.collect_list(F.struct("_level", "rows", "left"))).alias("_path"))  # one a level
    heads = pieces.join(path, ["_cell", "_piece"], "left").join(cells.select("_cell", "_m", F.xxhash64(*[F.col(c).cast("string") for c in cell]).alias("_hash")), "_cell")
    none, no = F.array().cast("array<long>"), F.lit(0).cast("long")
    heads = heads.select(
        "_cell", "_piece", F.lit(0).alias("_role"), no.alias("_h"), F.lit(0.0).alias("_y"), F.lit(0.0).alias("_f"), "_m", "_hash",
        F.coalesce(F.col("_path.rows"), none).alias("_rows"), F.coalesce(F.col("_path.left"), none).alias("_left"))
    body = dealt.select("_cell", "_piece", F.lit(1).alias("_role"), "_h", "_y", "_f", F.lit(0.0).alias("_m"), no.alias("_hash"), none.alias("_rows"), none.alias("_left"))
    met = heads.union(body)
    # a cell's pieces are spread, and those of one task follow each other
    met = met.repartition("_cell", "_piece").sortWithinPartitions("_cell", "_piece", "_role", "_h", "_y", "_f")
    return _summary(met.mapInPandas(_resampled(n_boot, seed), _SUMS), cells, cell, ci)


# -- Poisson weights ------------------------------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX[1])
    x = (x ^ (x >> np.uint32(13))) * np.uint32(MIX[2])
    return x ^ (x >> np.uint32(16))


def poisson_weights(first: np.ndarray, second: np.ndarray, n_boot: int) -> np.ndarray:
    """Poisson(1) weights [row, replicate] from two 32-bit hashes of each row."""
    rep = np.arange(1, n_boot + 1, dtype=np.uint32) * np.uint32(MIX[0])
    u = _mixed(_mixed(first.astype(np.uint32)[:, None] + rep) ^ second.astype(np.uint32)[:, None])
    out = np.zeros(u.shape, dtype=np.uint8)
    for c in POISSON_CDF:
        out += u >= min(math.ceil(c * 2**32), 2**32 - 1)
    return out.astype(float)


def _weighted(n_boot: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, sums = None, None
        for (now,), part in _runs(frames, ["_cell"]):
            if now != cell:
                if sums is not None:
                    yield sums.frame(cell)
                cell, sums = now, Sums(n_boot)
            for at in range(0, len(part), CHUNK):
                some = part.iloc[at : at + CHUNK]
                weight = poisson_weights(some["_h1"].to_numpy(), some["_h2"].to_numpy(), n_boot)
                sums.add(weight, some["_y"].to_numpy(), some["_f"].to_numpy(), float(some["_m"].iloc[0]))
        if sums is not None:
            yield sums.frame(cell)

    return run


def bootstrap_r2_poisson(preds: DataFrame, cell: list[str], row_key: list[str], label: str, pred: str, n_boot: int, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """The same interval with Poisson(1) weights, which need no total: rows stay where they are."""
    digest = H.hash_order(F.lit(seed), *row_key)
    word = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(2)]
    rows, cells = _rows(preds, cell, label, pred, *word)
    near = rows.select("_cell", "_m", "_y", "_f", "_h1", "_h2").sortWithinPartitions("_cell")
    return _summary(near.mapInPandas(_weighted(n_boot), _SUMS), cells, cell, ci)
