"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its words, word pairs and pairs with one word between, each present or not, in
2**``BITS`` places. The learner keeps a rate for each coordinate; its L1 term leaves most weights at exactly zero, so
the model is a short list of places and weights, bounded by 2**``BITS``, which is broadcast.

It learns from at most ``MAX_TRAIN_ROWS`` labelled rows (those with the lowest hash of their id), in one task; scores
cover every row and whole text. Null and empty texts have no features and score the bias. Rows with a null label or id
are not learned from; an id with several labels counts toxic if any of them is. Without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crossgrid.llm.common import ALNUM, arrow_rows, chain, kept, one_text, small_batches, text_word_hashes, utf8

BITS = 20
MAX_TRAIN_ROWS = 30_000
EPOCHS = 3
_SKIP = np.uint64(0xA0761D6478BD642F)


def features(texts: list[str | None], bits: int = BITS) -> Iterator[np.ndarray]:
    """For each text the places, repeated ones too, of its words, pairs and skip pairs."""
    for h in text_word_hashes([utf8(t).translate(ALNUM) for t in texts]):
        parts = [h]
        if len(h) > 1:
            parts.append(chain(h[:-1], h[1:]))
        if len(h) > 2:
            parts.append(chain(h[:-2] ^ _SKIP, h[2:]))
        yield (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates (McMahan et al. 2013); features are 0 or 1, one more is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        """``at``: distinct places, the bias (the last place) among them."""
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_TRAIN_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and bias. ``labels`` holds the rows to learn from; its sample of ``max_rows`` is broadcast."""
    sample = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
        .withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(max_rows)
    )
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
        .repartition(1).sortWithinPartitions("_order", "_id", F.xxhash64("_text")).select("_text", "_label")
    )
    made = pa.schema([("place", pa.int32()), ("weight", pa.float64())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, model = [], Ftrl(bits)
        for batch in small_batches(batches, "_text"):
            for f, label in zip(features(batch.column(0).to_pylist(), bits), batch.column(1).to_pylist(), strict=True):
                at = np.append(np.unique(f), 1 << bits)
                seen.append((at.astype(np.int32), int(label > 0)))
        for _ in range(epochs):
            for at, label in seen:
                model.learn(at, label)
        every = model.weights(slice(None))
        at = np.flatnonzero(every)
        yield arrow_rows({"place": at, "weight": every[at]}, made)

    got = rows.mapInArrow(fit, "place int, weight double").toPandas()
    place, weight = got["place"].to_numpy(dtype=np.int64), got["weight"].to_numpy(dtype=float)
    bias = float(weight[place == 1 << bits].sum())
    own = place < 1 << bits
    return place[own], weight[own], bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", bits: int = BITS, out: str = "score") -> DataFrame:
    """``docs`` with the score of each row as its last column; a column of that name is replaced."""
    place, weight, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((place.astype(np.int32), weight.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        table = np.zeros(1 << bits, dtype=np.float32)
        table[sent.value[0]] = sent.value[1]
        for batch in small_batches(batches, text):
            at = batch.schema.get_field_index(text)
            scores = np.empty(batch.num_rows)
            for i, f in enumerate(features(batch.column(at).to_pylist(), bits)):
                f = np.unique(f[table[f] != 0])
                scores[i] = 1.0 / (1.0 + np.exp(-np.clip(table[f].astype(float).sum() + bias, -35, 35)))
            own = [batch.schema.get_field_index(c) for c in carried]
            yield pa.RecordBatch.from_arrays(
                [batch.column(j) for j in own] + [pa.array(scores)],
                schema=pa.schema([batch.schema.field(j) for j in own] + [pa.field(out, pa.float64())]))

    rows, text, carried = one_text(docs, [c for c in docs.columns if c != out], text_col)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, f"{fields}, `{out}` double")
