"""Hard-negative mining with rotated one-bit codes.

Every vector x is rotated by a fixed random rotation and coded by signs: the code b holds the signs of x, a = <b, x> its
alignment with x (b as a unit vector), and what is left, r = x - a b, stands at a right angle to b. Further codes of the
same kind describe r. Stored are the codes, their alignments, the norm of what each level leaves, and the integer vector.

An anchor q is rotated and held as 8-bit integers, so that <b, q> comes from popcounts of b with the bit planes of q. With
L levels, <x, q> = a1 <b1, q> + ... + aL <bL, q> + <r, q>, and by Cauchy-Schwarz the last term is at most
|r| * sqrt(|q|^2 - <bL, q>^2), because r is at a right angle to bL. The rounding of q adds at most |x| times its norm. This
interval holds the score without exception. A row whose interval cannot matter is out; the next level is looked at only
for rows still in, and the rows that survive all levels are scored as integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from crossgrid.llm import vectors
from crossgrid.llm.common import arrow_rows
from crossgrid.llm.vectors import Best
from crossgrid.session import materialize

#: Codes of a vector, bits of an anchor's component, relative allowance for rounding of doubles.
LEVELS, BITS, SLACK = 4, 8, 1e-9

INDEX = "_id long, _label long, _x array<long>, _code binary, _align array<double>, _rest array<double>, _norm double"
_INDEX = pa.schema([
    ("_id", pa.int64()), ("_label", pa.int64()), ("_x", pa.list_(pa.int64())), ("_code", pa.binary()),
    ("_align", pa.list_(pa.float64())), ("_rest", pa.list_(pa.float64())), ("_norm", pa.float64())])
FOUND = "_q long, _limit long, vec_id long, score long"
_FOUND = pa.schema([("_q", pa.int64()), ("_limit", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


@lru_cache(maxsize=2)
def rotation(d: int) -> np.ndarray:
    """The same rotation on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(20).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    n, d = bits.shape
    words = np.zeros((n, -(-d // 64) * 8), dtype=np.uint8)
    words[:, : -(-d // 8)] = np.packbits(bits, axis=1)
    return words.view(np.uint64)


def coded(x: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes [row, level, word], alignments and norms of the rest [row, level], norms [row]."""
    n, d = x.shape
    rest = x.astype(float) @ rotation(d).T
    norm = np.linalg.norm(rest, axis=1)
    codes, align, left = [], [], []
    for _ in range(levels):
        signs = rest >= 0
        unit = np.where(signs, 1.0, -1.0) / np.sqrt(max(1, d))
        a = (unit * rest).sum(axis=1)
        rest = rest - a[:, None] * unit
        codes.append(_packed(signs))
        align.append(a)
        left.append(np.linalg.norm(rest, axis=1))
    return np.stack(codes, axis=1), np.stack(align, axis=1), np.stack(left, axis=1), norm


def _index(d: int, levels: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, vectors.VALUES // max(1, d))
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                codes, align, left, norm = coded(vectors.matrix(part["_x"], d), levels)
                yield arrow_rows({
                    "_id": part["_id"], "_label": part["_label"], "_x": part["_x"], "_code": [c.tobytes() for c in codes],
                    "_align": align.tolist(), "_rest": left.tolist(), "_norm": norm}, _INDEX)

    return index


class Block:
    """Rows of the index."""

    def __init__(self, group: pa.Table, d: int, levels: int):
        self.ids, self.labels = group["_id"].to_numpy(), group["_label"].to_numpy()
        self.x = vectors.matrix(group["_x"], d)
        words = np.frombuffer(b"".join(group["_code"].to_pylist()), dtype=np.uint64).reshape(len(self.ids), levels, -1)
        self.codes = np.ascontiguousarray(words.transpose(1, 2, 0))  # [level, word, row]
        self.align = np.ascontiguousarray(vectors.matrix(group["_align"], levels, float).T)
        self.rest = np.ascontiguousarray(vectors.matrix(group["_rest"], levels, float).T)
        self.norm = group["_norm"].to_numpy()
        self.levels = levels


class Anchor:
    """A rotated anchor as bit planes."""

    def __init__(self, q: np.ndarray):
        self.q = q
        d = len(q)
        turned = rotation(d) @ q.astype(float)
        self.low = float(turned.min(initial=0))
        self.step = (float(turned.max(initial=0)) - self.low) / ((1 << BITS) - 1) or 1.0
        whole = np.rint((turned - self.low) / self.step).astype(np.int64)
        held = self.low + self.step * whole
        self.planes = _packed((whole[None, :] >> np.arange(BITS)[:, None] & 1).astype(bool))
        self.norm, self.rounded = float(np.linalg.norm(held)), float(np.linalg.norm(turned - held))
        self.total, self.root = int(whole.sum()), np.sqrt(max(1, d))
        self.d = d

    def along(self, code: np.ndarray) -> np.ndarray:
        """The inner products with codes [word, row], from popcounts."""
        ones = np.bitwise_count(code).sum(axis=0, dtype=np.int64)
        weighed = np.zeros(code.shape[1], dtype=np.int64)
        for j, plane in enumerate(self.planes):
            for word, part in zip(code, plane, strict=True):
                weighed += np.bitwise_count(word & part).astype(np.int64) << j
        return (self.low * (2 * ones - self.d) + self.step * (2 * weighed - self.total)) / self.root

    def intervals(self, block: Block, rows: np.ndarray, level: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the levels so far, and the least and the highest score possible."""
        along = self.along(block.codes[level][:, rows])
        known = known + block.align[level, rows] * along
        norm = block.norm[rows]
        error = block.rest[level, rows] * np.sqrt(np.maximum(0.0, self.norm**2 - along**2)) + norm * self.rounded
        error += SLACK * (1.0 + norm * (self.norm + self.rounded))
        return known, vectors.held(known - error), vectors.held(known + error)


def nearest_same(block: Block, anchor: Anchor, rows: np.ndarray, best: Best) -> None:
    """Add the rows of highest score among ``rows`` to ``best``."""
    known = np.zeros(len(rows))
    for level in range(block.levels):
        known, lower, upper = anchor.intervals(block, rows, level, known)
        kept = upper >= max(best.least, vectors.kth_highest(lower, best.k))
        rows, known = rows[kept], known[kept]
    best.add(vectors.inner(anchor.q, block.x[rows]), block.ids[rows])


def nearest_below(block: Block, anchor: Anchor, rows: np.ndarray, share: tuple[int, int], bests: dict[int, Best]) -> None:
    """Add to the ``Best`` of each limit the rows of highest score among ``rows`` between ``share`` of the limit and the limit."""
    known = np.zeros(len(rows))
    for level in range(block.levels):
        known, lower, upper = anchor.intervals(block, rows, level, known)
        kept = np.zeros(len(rows), dtype=bool)
        for limit, best in bests.items():
            bar = max(limit * share[0] / share[1], best.least, vectors.kth_highest(lower[upper <= limit], best.k))
            kept |= (upper >= bar) & (lower <= limit)
        rows, known = rows[kept], known[kept]
    score = vectors.inner(anchor.q, block.x[rows])
    for limit, best in bests.items():
        fits = score <= limit
        if -(1 << 53) < limit * share[0] < 1 << 53 and (np.abs(score) < (1 << 53) // share[1]).all():
            fits &= score * share[1] >= limit * share[0]
        else:
            fits &= np.array([int(s) * share[1] >= limit * share[0] for s in score], dtype=bool)
        best.add(score[fits], block.ids[rows[fits]])


def _unit(d: int, levels: int, k: int, share: tuple[int, int] | None):
    """Positives (``share`` None) or negatives below the limits of each anchor."""

    def unit(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for number, _, _, _, bests in anchors:
                for limit, best in bests.items():
                    if m := len(best.id):
                        yield arrow_rows({"_q": [number] * m, "_limit": [limit] * m, "vec_id": best.id, "score": best.score}, _FOUND)

        anchors: list = []
        for group in groups:
            if group["_block"][0].as_py() < 0:
                yield from found()
                limits = group["_limits"].to_pylist()
                anchors = [
                    (number, own, label, Anchor(q), {limit: Best(k) for limit in (some or [])} if share else {0: Best(k)})
                    for number, own, label, q, some in zip(
                        group["_q"].to_pylist(), group["_id"].to_pylist(), group["_label"].to_pylist(), vectors.matrix(group["_x"], d), limits, strict=True)]
                continue
            block = Block(group, d, levels)
            rows_of = {label: (np.flatnonzero(block.labels == label), np.flatnonzero(block.labels != label)) for label in {a[2] for a in anchors}}
            for _, own, label, anchor, bests in anchors:
                same, other = rows_of[label]
                if share is None:
                    nearest_same(block, anchor, same[block.ids[same] != own], bests[0])
                elif bests:
                    nearest_below(block, anchor, other[block.ids[other] != own], share, bests)
        yield from found()

    return unit


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column, scale: float, *, positives: int = 5, negatives: int = 5, least_share: tuple[int, int] = (80, 100),
    id_col: str = "vec_id", vector_col: str = "embedding", levels: int = LEVELS, tile: int = vectors.TILE, values: int = vectors.VALUES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and each of its positives.

    ``is_anchor`` and ``label`` are expressions over the columns of ``rows``. An anchor's positives are the ``positives`` other
    rows of its label with the highest score, its negatives for a positive the first ``negatives`` rows of another label whose
    score lies between ``least_share`` of the positive's score and that score (none, if that score is below 0). Higher scores
    come first, ties by smaller id. Rows with a null id, a null label or a vector that is null or holds null or non-finite
    components take no part. A vector shorter than the longest ends in zeros. Rows of the anchor's own id are neither positives
    nor negatives. A repeated row is met each time; repeated equal anchors are answered once, different ones of one id each.
    Components and scores are held within the range of a long. Other columns of ``rows`` are not read."""
    share = least_share

    def part(some: DataFrame) -> DataFrame:
        return vectors.usable(some, scale, id_col, vector_col, label.cast("long").alias("_label")).filter("_label is not null")

    all_rows = part(rows)
    n, d = vectors.size_of(all_rows)
    index = materialize(all_rows.mapInArrow(_index(d, levels), INDEX), "codes")
    anchors = vectors.numbered(part(rows.filter(is_anchor)), "anchors")
    m = anchors.count()

    def search(asked: DataFrame, k: int, bound: tuple[int, int] | None) -> DataFrame:
        found = vectors.run_units(asked, index, m, n, d, FOUND, _unit(d, levels, k, bound), tile=tile, values=values)
        best = Window.partitionBy("_q", "_limit").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    none = F.lit(None).cast("array<long>")
    near = materialize(search(anchors.withColumn("_limits", none), positives, None).drop("_limit", "rank"), "positives")
    limits = near.groupBy("_q").agg(F.sort_array(F.collect_set("score")).alias("_limits"))  # as many as ``positives`` at most
    far = search(anchors.join(limits, "_q"), negatives, share)
    pairs = near.select("_q", F.col("vec_id").alias("positive_id"), F.col("score").alias("_limit"))
    return (
        far.join(pairs, ["_q", "_limit"]).join(anchors.select("_q", F.col("_id").alias("anchor_id")), "_q")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("_limit").alias("positive_score"), F.col("score").alias("negative_score")))
