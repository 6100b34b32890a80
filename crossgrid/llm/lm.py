"""Language-model scores from an Elias-Fano n-gram trie, learned from and applied to a whole corpus.

Counts, model and queries are sharded, so the model grows with the corpus and no task or driver ever holds it whole:

1. Texts become blocks of word numbers, with the sorted word hashes of each block; both are written.
2. Blocks send their word counts to shards by word; the shards answer with global counts and word ids.
3. Blocks send their distinct (context, word) pairs with training counts to shards by context. A context that is frequent
   in training is dealt to several shards by word: its total is known from step 2, so no shard needs all its successors.
   Each shard builds its part of the trie and answers every pair that was sent, seen in training or not.
4. Blocks add up the answers for each text.

The trie has two levels. Contexts are a sorted level with monotone pointers into the successors of all contexts, which are
one non-decreasing sequence too (context number times vocabulary, plus word); both are Elias-Fano coded. A successor is
sought within the range its context's pointers give, relative to the context. Log probabilities are quantised to 16 bits.
The arrays of a level lie in files that are memory-mapped and unlinked at once.

Smoothing: the unigrams are add-0.1 over the V training words and one unknown; pairs are smoothed towards them with a
Dirichlet prior of weight ``PRIOR``: p(w|h) = (c(hw) + PRIOR * p(w)) / (c(h) + PRIOR), which adds up to 1 over the words.
The context of a text's first word is the end token of the text before it.

Words are told apart by 64-bit hashes. Null and empty texts are one end token. Rows may repeat and ids may be null; extra
columns are ignored. Without training rows N = V = 0 and every probability is that of the unknown word.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crossgrid.llm.common import LOWER, MESSAGE, arrow_rows, by_shard, delivered, messages, mix64, received, small_batches, squeeze, text_word_hashes, unsqueeze, utf8
from crossgrid.session import materialize

#: Weight of the unigrams in the smoothing of pairs, in tokens.
PRIOR = 50.0
BLOCK_TOKENS = 3_000_000
SHARD_TOKENS = 500_000
#: Stands for the end token; a word has this hash by a chance of 2^-64 only.
_END = np.uint64(0x2D06800538D394C2)


def _low_words(values: np.ndarray, bits: int) -> np.ndarray:
    """Fields of ``bits`` bits, packed into 64-bit words (one spare word at the end)."""
    words = np.zeros(len(values) * bits // 64 + 2, dtype=np.uint64)
    if bits:
        at = np.arange(len(values), dtype=np.int64) * bits
        shift = (at & 63).astype(np.uint64)
        v = values.astype(np.uint64)
        np.bitwise_or.at(words, at >> 6, v << shift)
        over = np.flatnonzero(shift + np.uint64(bits) > 64)
        np.bitwise_or.at(words, (at[over] >> 6) + 1, v[over] >> (np.uint64(64) - shift[over]))
    return words


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary in a bitmap with a directory of counts."""

    def __init__(self, values: np.ndarray, universe: int, keep=lambda name, array: array):
        n = len(values)
        self.n = n
        self.bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        self.low = keep("low", _low_words(v & np.uint64((1 << self.bits) - 1), self.bits))
        high = (v >> np.uint64(self.bits)).astype(np.int64)
        self.tops = int(universe >> self.bits) + 1
        size = (n + self.tops) // 64 + 1
        bitmap = np.zeros(size, dtype=np.uint64)
        at = high + np.arange(n)
        np.bitwise_or.at(bitmap, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        self.bitmap = keep("high", bitmap)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bitmap).astype(np.int64))])
        self.ones = keep("rank", ones.astype(np.uint32 if n < 1 << 32 else np.int64))

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros of the bitmap."""
        before = np.asarray(self.ones, dtype=np.int64)
        if not bit:
            before = np.arange(len(before)) * 64 - before
        word = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[word]).astype(np.uint64)
        w = self.bitmap[word]
        if not bit:
            w = ~w
        at = np.zeros(len(k), dtype=np.uint64)
        for half in (32, 16, 8, 4, 2, 1):  # the half of the word that holds it, again and again
            half = np.uint64(half)
            low = np.bitwise_count(w & ((np.uint64(1) << half) - np.uint64(1))).astype(np.uint64)
            up = rest >= low
            rest = np.where(up, rest - low, rest)
            w = np.where(up, w >> half, w)
            at += np.where(up, half, np.uint64(0))
        return word * 64 + at.astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.bits
        shift = (at & 63).astype(np.uint64)
        first, second = self.low[at >> 6] >> shift, self.low[(at >> 6) + 1]
        second = np.where(shift > 0, second << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        if not len(i):
            return np.zeros(0, dtype=np.int64)
        return ((self._select(i, 1) - i) << self.bits) | self._low(i).astype(np.int64)

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Successor search in lo..hi: the place of the first value >= x there if it equals x, else -1."""
        top = x >> self.bits
        # values whose high part is t stand between the t-1st and the t-th zero
        start = np.where(top > 0, self._select(np.maximum(top - 1, 0), 0) - np.maximum(top - 1, 0), 0)
        end = self._select(top, 0) - top
        start, end = np.maximum(start, lo), np.minimum(end, hi)
        want = (x & ((1 << self.bits) - 1)).astype(np.uint64)
        last = end.copy()
        live = np.flatnonzero(start < end)
        while len(live):  # binary search among the values of that high part
            middle = (start[live] + end[live]) >> 1
            less = self._low(middle) < want[live]
            start[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
            live = live[start[live] < end[live]]
        there = np.flatnonzero(start < last)
        out = np.full(len(x), -1, dtype=np.int64)
        hit = there[self._low(start[there]) == want[there]]
        out[hit] = start[hit]
        return out


class Mapped:
    """Arrays in memory-mapped files; the names are gone at once, the space when the arrays are."""

    def __call__(self, name: str, array: np.ndarray) -> np.ndarray:
        if not array.nbytes:
            return array
        handle, path = tempfile.mkstemp(prefix=f"trie-{name}-")
        try:
            with os.fdopen(handle, "wb") as f:
                array.tofile(f)
            return np.memmap(path, dtype=array.dtype, mode="r", shape=array.shape)
        finally:
            os.unlink(path)


class Trie:
    """Contexts and their successors with quantised log10 probabilities."""

    def __init__(self, context: np.ndarray, word: np.ndarray, log_p: np.ndarray, universe: int, keep=None):
        """Distinct pairs sorted by context and word; ``universe`` is above every context and word number."""
        keep = keep or Mapped()
        names, first = np.unique(context, return_index=True)
        self.universe = universe
        self.contexts = EliasFano(names, universe, keep)
        self.pointers = EliasFano(np.concatenate([first, [len(word)]]), len(word) + 1, keep)
        order = np.repeat(np.arange(len(names)), np.diff(np.concatenate([first, [len(word)]])))
        self.successors = EliasFano(order * universe + word, max(1, len(names)) * universe, keep)
        self.floor = float(log_p.min()) if len(log_p) else 0.0
        self.step = max((float(log_p.max()) - self.floor) / 65535, 1e-12) if len(log_p) else 1.0
        self.codes = keep("codes", np.rint((log_p - self.floor) / self.step).astype(np.uint16))

    def log_p(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """NaN for pairs that the trie does not hold."""
        names, which = np.unique(context, return_inverse=True)
        everywhere = np.zeros(len(names), dtype=np.int64)
        node = self.contexts.find(names, everywhere, everywhere + self.contexts.n)
        known = np.maximum(node, 0)
        lo, hi = self.pointers.get(known), self.pointers.get(np.minimum(known + 1, self.contexts.n))
        out = np.full(len(context), np.nan)
        live = np.flatnonzero(node[which] >= 0)
        k = which[live]
        place = self.successors.find(node[k] * self.universe + word[live], lo[k], hi[k])
        ok = place >= 0
        out[live[ok]] = self.floor + self.codes[place[ok]].astype(np.float64) * self.step
        return out


def word_shard(names: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the scrambled hashes, so sorted names are in the order of their shards."""
    return ((names >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def unigram(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return (c + 0.1) / (n + 0.1 * (v + 1))


def planes(numbers: np.ndarray) -> np.ndarray:
    """The bytes of the numbers, all lowest ones first: they compress better apart."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)


def unplanes(data: bytes, kind: str = "i8") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def write_blocks(docs: DataFrame, id_col: str, text_col: str, train: str, block_tokens: int) -> DataFrame:
    """_block, n_tokens, _stream (ids, null flags, training flags, token counts, word numbers, that of the end token) and
    _words (scrambled hashes, sorted, and training counts of the words, which are numbered in this order)."""
    made = pa.schema([("n_tokens", pa.int64()), ("_stream", pa.binary()), ("_words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, parts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            tokens = mix64(np.concatenate(parts))
            counts = np.array([len(p) for p in parts], dtype=np.int64)
            learned = np.repeat(np.array(flags, dtype=bool), counts)
            names, number = np.unique(tokens, return_inverse=True)
            seen = np.bincount(number[learned], minlength=len(names)).astype(np.int32)
            # frequent words get short numbers in the stream
            by_count = np.argsort(-np.bincount(number, minlength=len(names)), kind="stable").astype(np.int32)
            rank = np.empty(len(names), dtype=np.int32)
            rank[by_count] = np.arange(len(names), dtype=np.int32)
            missing = np.array([i is None for i in ids], dtype=np.uint8)
            stream = squeeze(np.array([i or 0 for i in ids], dtype=np.int64), missing, np.array(flags, dtype=np.uint8), counts, planes(by_count), planes(rank[number]),
                             np.array([np.searchsorted(names, mix64(np.array([_END]))[0])], dtype=np.int64))
            return arrow_rows({"n_tokens": [held], "_stream": [stream], "_words": [squeeze(names, planes(seen))]}, made)

        for batch in small_batches(batches, "_text"):
            hashes = text_word_hashes([utf8(t).translate(LOWER) for t in batch.column(2).to_pylist()])
            for i, learn, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hashes, strict=True):
                ids.append(i)
                flags.append(bool(learn))
                parts.append(np.append(own, _END))
                held += len(parts[-1])
                if held >= block_tokens:
                    yield block()
                    ids, flags, parts, held = [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.expr(train).alias("_train"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(run, "n_tokens long, _stream binary, _words binary")
    return materialize(out.withColumn("_block", F.monotonically_increasing_id()), "token-blocks")


def send_words(block: int, data: bytes, shards: int) -> list[tuple[int, int, int, bytes]]:
    names, seen = unsqueeze(data)
    names, seen = np.frombuffer(names, dtype=np.uint64), unplanes(seen, "i4")
    return [(s, block, 0, squeeze(names[at], planes(seen[at]))) for s, at in by_shard(word_shard(names, shards))]


def answer_words(shard: int, shards: int, got: list[tuple[int, int, bytes]]) -> tuple[list[tuple[int, int, int, bytes]], int, int]:
    """To each block: count and id of each word it sent (id: rank in the shard, times the shards, plus the shard). And the
    shard's share of N and V."""
    names, seen = [], []
    for _, _, data in got:
        k, c = unsqueeze(data)
        names.append(np.frombuffer(k, dtype=np.uint64))
        seen.append(unplanes(c, "i4"))
    _, inverse = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(seen)).astype(np.int64)
    out, at = [], 0
    for (block, _, _), k in zip(got, names, strict=True):
        own = inverse[at : at + len(k)]
        out += [(block, shard, 1, squeeze(planes(total[own]))), (block, shard, 3, squeeze(planes(own * shards + shard)))]
        at += len(k)
    return out, int(total.sum()), int((total > 0).sum())


class Tokens:
    """A block's tokens with the global counts and ids of its words, and its distinct pairs."""

    def __init__(self, stream: bytes, counted: list[tuple[int, bytes]], named: list[bytes]):
        """``counted``: counts by the word shards in their order, which is that of the words; ``named``: their ids, if wanted."""
        ids, missing, train, counts, by_count, stream_, end = unsqueeze(stream)
        self.ids, self.missing = np.frombuffer(ids, dtype=np.int64), np.frombuffer(missing, dtype=np.uint8)
        self.train, self.counts = np.frombuffer(train, dtype=np.uint8) > 0, np.frombuffer(counts, dtype=np.int64)
        self.number = unplanes(by_count, "i4")[unplanes(stream_, "i4")]
        counts_ = [unplanes(unsqueeze(a)[0]) for _, a in counted]
        self.count = np.concatenate(counts_)
        self.home = np.repeat(np.array([s for s, _ in counted]), [len(c) for c in counts_])  # each word's shard
        self.word = np.concatenate([unplanes(unsqueeze(a)[0]) for a in named]) if named else None
        self.end, size = int(np.frombuffer(end, dtype=np.int64)[0]), len(self.count)
        starts = np.cumsum(self.counts) - self.counts
        self.context = np.empty(len(self.number), dtype=np.int32)
        self.context[1:] = self.number[:-1]
        self.context[starts] = self.end
        # pairs of words that both occur in training; the others need no trie
        known = (self.count[self.context] > 0) & (self.count[self.number] > 0)
        self.asked = np.flatnonzero(known)
        code = self.context[self.asked].astype(np.int64) * size + self.number[self.asked]
        pairs, pair = np.unique(code, return_inverse=True)
        self.pair = pair.astype(np.int32)
        del code, pair, known
        self.left, self.right = pairs // size, pairs % size
        learned = np.repeat(self.train, self.counts)[self.asked]
        self.seen = np.bincount(self.pair[learned], minlength=len(pairs)).astype(np.int32)

    def shard(self, n: int, shards: int) -> np.ndarray:
        """By context; a context with more than a shard's share of the training tokens is dealt out by word."""
        deals = np.maximum(1, -(-self.count[self.left] * shards // max(1, n)))
        return (self.home[self.left] + self.home[self.right] % deals) % shards

    def send(self, block: int, n: int, shards: int) -> list[tuple[int, int, int, bytes]]:
        out = []
        for s, at in by_shard(self.shard(n, shards)):
            left = self.left[at]  # sorted by block number of the context
            turn = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
            b, w = left[turn], self.right[at]
            out.append((s, block, 0, squeeze(
                *map(planes, (self.word[b], self.count[b], np.diff(np.concatenate([turn, [len(at)]])).astype(np.int32), self.word[w], self.count[w], self.seen[at])))))
        return out


def answer_pairs(shard: int, got: list[tuple[int, int, bytes]], n: int, v: int, prior: float) -> list[tuple[int, int, int, bytes]]:
    """Builds the shard's trie from all training counts, and answers each block with quantised log10 probabilities."""
    parts = [[] for _ in range(5)]
    for _, _, data in got:
        b, cb, size, w, cw, seen = (unplanes(x, d) for x, d in zip(unsqueeze(data), ("i8", "i8", "i4", "i8", "i8", "i4"), strict=True))
        for p, x in zip(parts, (np.repeat(b, size), np.repeat(cb, size), w, cw, seen), strict=True):
            p.append(x)
    sizes = [len(x) for x in parts[0]]
    left, c_left, right, c_right, seen = map(np.concatenate, parts)
    p1 = unigram(c_right, n, v)
    order = np.lexsort((right, left))
    l, r = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], (l[1:] != l[:-1]) | (r[1:] != r[:-1])]))
    count = np.add.reduceat(seen[order].astype(np.int64), first)
    held = count > 0
    at = order[first][held]
    universe = int(max(left.max(), right.max())) + 1
    trie = Trie(left[at], right[at], np.log10((count[held] + prior * p1[at]) / (c_left[at] + prior)), universe)
    # each distinct pair is looked up once, whoever sent it
    every = order[first]
    log_p = trie.log_p(left[every], right[every])
    unseen = np.isnan(log_p)
    log_p[unseen] = np.log10(prior * p1[every][unseen] / (c_left[every][unseen] + prior))
    floor = float(log_p.min())
    step = max((float(log_p.max()) - floor) / 65535, 1e-12)
    codes = np.empty(len(left), dtype=np.uint16)
    codes[order] = np.repeat(np.rint((log_p - floor) / step).astype(np.uint16), np.diff(np.concatenate([first, [len(left)]])))
    out, done = [], 0
    for (block, _, _), size in zip(got, sizes, strict=True):
        out.append((block, shard, 2, squeeze(np.array([floor, step]), codes[done : done + size])))
        done += size
    return out


def scores(t: Tokens, answers: list[tuple[int, bytes]], n: int, v: int, prior: float, shards: int) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score of each text."""
    p1 = unigram(t.count, n, v)
    base = np.log10(p1)[t.number]
    log_p = np.log10(prior * p1[t.number] / (t.count[t.context] + prior)) if prior else base.copy()
    log_p[t.count[t.context] == 0] = base[t.count[t.context] == 0]
    pair = np.zeros(len(t.left))
    where = dict(by_shard(t.shard(n, shards)))
    for shard, data in answers:
        head, codes = unsqueeze(data)
        floor, step = np.frombuffer(head, dtype=np.float64)
        pair[where[shard]] = floor + np.frombuffer(codes, dtype=np.uint16) * step
    log_p[t.asked] = pair[t.pair]
    starts = np.cumsum(t.counts) - t.counts
    known = (t.count > 0)[t.number].astype(np.int64)
    return t.counts, np.add.reduceat(known, starts), np.add.reduceat(base, starts), np.add.reduceat(log_p, starts)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: str = "true", prior: float = PRIOR,
                block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per row: id, trained boolean, n_tokens, n_known, train_tokens long, base_score, score double.

    ``train``: SQL condition on ``docs`` that tells the texts to learn from (null: not)."""
    base = write_blocks(docs, id_col, text_col, f"coalesce({train}, false)", block_tokens)
    shards = max(1, -(-(base.agg(F.sum("n_tokens")).first()[0] or 0) // shard_tokens))
    words = base.select("_block", "_words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from messages(send_words(block, data.as_py(), shards))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, got in received(batches):
            out, n, v = answer_words(shard, shards, got)
            yield from messages([*out, (-1, shard, 9, np.array([n, v], dtype=np.int64).tobytes())])

    told = materialize(delivered(words.mapInArrow(count, MESSAGE)).mapInArrow(total, MESSAGE), "word-counts")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = v = 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                a, b = np.frombuffer(data, dtype=np.int64).tolist()
                n, v = n + a, v + b
        yield arrow_rows({"n": [n], "v": [v]}, pa.schema([("n", pa.int64()), ("v", pa.int64())]))

    # two numbers for each task, two in all
    row = told.filter("_to = -1").select("_data").mapInArrow(sums, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n, v = int(row[0] or 0), int(row[1] or 0)
    stream = base.select(
        F.col("_block").alias("_to"), F.lit(0).cast("long").alias("_from"), F.lit(0).alias("_role"), F.col("_stream").alias("_data")).union(told.filter("_to >= 0"))

    def block_of(got: list[tuple[int, int, bytes]]) -> Tokens:
        return Tokens(got[0][2], [(s, d) for s, r, d in got if r == 1], [d for _, r, d in got if r == 3])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in received(batches):
            yield from messages(block_of(got).send(block, n, shards))

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, got in received(batches):
            yield from messages(answer_pairs(shard, got, n, v, prior))

    made = pa.schema([("_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in received(batches):
            t = block_of(got)
            tokens, known, low, high = scores(t, [(s, d) for s, r, d in got if r == 2], n, v, prior, shards)
            yield arrow_rows({"_id": pa.array(t.ids, mask=t.missing > 0), "trained": t.train, "n_tokens": tokens, "n_known": known,
                              "train_tokens": np.full(len(tokens), n), "base_score": low, "score": high}, made)

    answers = delivered(delivered(stream).mapInArrow(ask, MESSAGE)).mapInArrow(model, MESSAGE)
    out = delivered(stream.filter("_role <> 3").union(answers)).mapInArrow(
        add, "_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("_id", id_col)
