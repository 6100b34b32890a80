"""Substring deduplication by relative Lempel-Ziv parsing of documents against indexed reference blocks.

A window is ``WINDOW`` consecutive words of one document; its anchor is the least of the hashes of its three-word runs.
Equal windows have equal anchors, so a stretch of text (the windows in a row that share one anchor, and their words) has
to meet only the reference block of its anchor's shard: every other block holds none of its windows.

1. Documents are written in blocks, as words.
2. Blocks send the anchors they hold to shards, which answer which of them stand in several documents.
3. Blocks send the stretches of those anchors, each distinct one once. A shard joins them in the order of their first
   document to its reference block and looks every window of every stretch up in it by hash: a factor is a run of windows
   with one smallest document. Nothing is matched word by word and factors are not the longest ones, so this is a join of
   window hashes laid out as a parse. A shard answers with the smallest document of each window.
4. Blocks remove, from every document, the words of windows whose smallest document is below it.

No document meets all others, a frequent passage is sent once by each block, and nothing is collected. A null id is
above all others; equal ids are no smaller than each other. Null and empty texts have no words. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crossgrid.llm.common import (
    MESSAGE, arrow_rows, by_shard, chain, delivered, messages, mix64, received, small_batches, squeeze, unsqueeze, utf8, word_hashes,
)
from crossgrid.session import materialize

WINDOW = 13
#: Words of the runs whose hashes are anchors.
RUN = 3
BLOCK_BYTES = 6 << 20
#: Bytes of text for each shard.
SHARD_BYTES = 4 << 20
_NO_ID = np.iinfo(np.int64).max


def write_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """_block, n_bytes, _data: ids, null flags, word counts and words of about ``block_bytes`` of text, or one document."""
    made = pa.schema([("_seq", pa.int64()), ("n_bytes", pa.int64()), ("_data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, counts, words, held = 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            missing = np.array([i is None for i in ids], dtype=np.uint8)
            data = squeeze(np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64), missing, np.array(counts, dtype=np.int64), b" ".join(words))
            return arrow_rows({"_seq": [seq], "n_bytes": [held], "_data": [data]}, made)

        for batch in small_batches(batches, "_text"):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = utf8(text).split()
                ids.append(i)
                counts.append(len(own))
                if own:
                    words.append(b" ".join(own))
                    held += len(words[-1])
                if held >= block_bytes:
                    yield block()
                    seq, ids, counts, words, held = seq + 1, [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "_seq long, n_bytes long, _data binary")
    return materialize(rows.withColumn("_block", F.monotonically_increasing_id()), "word-blocks")


class Block:
    """Words of a block in one row, and the stretches of its anchors."""

    def __init__(self, data: bytes):
        ids, missing, counts, words = unsqueeze(data)
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.missing = np.frombuffer(missing, dtype=np.uint8)
        self.counts = np.frombuffer(counts, dtype=np.int64)
        self._text = words

    @cached_property
    def words(self) -> list[bytes]:
        return self._text.split()

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows, anchor (48 bits), and document of each."""
        h = word_hashes(self._text)
        n = len(h) - WINDOW + 1
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        if n <= 0:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none.astype(np.uint64), none
        run = h[: len(h) - RUN + 1]
        for j in range(1, RUN):
            run = chain(run, h[j : len(h) - RUN + 1 + j])
        low = np.uint64(0xFFFF)
        held = (run & ~low) | (np.arange(len(run), dtype=np.uint64) & low)  # the place rides in the low bits
        span = WINDOW - RUN + 1
        least, width = held, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[span - width : span - width + n])
        inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
        if not len(inside):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none.astype(np.uint64), none
        key = least[inside]
        new = np.flatnonzero((key[1:] != key[:-1]) | (np.diff(inside) != 1) | (doc[inside[1:]] != doc[inside[:-1]])) + 1
        first = np.concatenate([[0], new])
        size = np.diff(np.concatenate([first, [len(inside)]]))
        return inside[first], size, key[first] >> np.uint64(16), doc[inside[first]]


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(anchor) % np.uint64(shards)).astype(np.int64)


def send_anchors(block: int, b: Block, shards: int) -> list[tuple[int, int, int, bytes]]:
    """Distinct anchors (sorted) and whether several documents of the block have them."""
    _, _, anchor, doc = b.stretches()
    each = np.unique(np.stack([anchor, doc.astype(np.uint64)], axis=1), axis=0)[:, 0] if len(anchor) else anchor
    keys, n = np.unique(each, return_counts=True)
    return [(s, block, 0, squeeze(keys[at], np.packbits(n[at] > 1))) for s, at in by_shard(_shard(keys, shards))]


def answer_anchors(shard: int, got: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """To each block: a bit for each anchor it sent, set if several documents have it."""
    keys, flags = [], []
    for _, _, data in got:
        k, f = unsqueeze(data)
        keys.append(np.frombuffer(k, dtype=np.uint64))
        flags.append(np.unpackbits(np.frombuffer(f, dtype=np.uint8), count=len(keys[-1])))
    _, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    several = n > 1
    several[inverse[np.concatenate(flags) > 0]] = True
    out, at = [], 0
    for (block, _, _), k in zip(got, keys, strict=True):
        out.append((block, shard, 1, squeeze(np.packbits(several[inverse[at : at + len(k)]]))))
        at += len(k)
    return out


class Distinct:
    """The distinct stretches that a block sends: of anchors that several documents have."""

    def __init__(self, b: Block, answers: list[tuple[int, bytes]], shards: int):
        start, size, anchor, doc = b.stretches()
        keys = np.unique(anchor)
        where = dict(by_shard(_shard(keys, shards)))
        wanted = np.zeros(len(keys), dtype=bool)
        for shard, data in answers:
            at = where[shard]
            wanted[at] = np.unpackbits(np.frombuffer(unsqueeze(data)[0], dtype=np.uint8), count=len(at)) > 0
        pick = np.flatnonzero(wanted[np.searchsorted(keys, anchor)]) if len(keys) else np.zeros(0, dtype=np.int64)
        self.start, self.size, self.doc = start[pick], size[pick], doc[pick]
        ids = b.ids[self.doc]
        known: dict[tuple[int, bytes], int] = {}
        self.which = np.empty(len(pick), dtype=np.int64)
        self.text: list[bytes] = []
        least: list[int] = []
        words = b.words
        for k, (a, n, h, i) in enumerate(zip(self.start.tolist(), self.size.tolist(), anchor[pick].tolist(), ids.tolist(), strict=True)):
            text = b" ".join(words[a : a + n + WINDOW - 1])
            at = known.setdefault((h, text), len(self.text))
            if at == len(self.text):
                self.text.append(text)
                least.append(i)
            elif i < least[at]:
                least[at] = i
            self.which[k] = at
        self.least = np.array(least, dtype=np.int64)
        self.shard = _shard(np.array([h for h, _ in known], dtype=np.uint64), shards)

    def send(self, block: int) -> list[tuple[int, int, int, bytes]]:
        return [(s, block, 0, squeeze(self.least[at], b"\n".join([self.text[k] for k in at]))) for s, at in by_shard(self.shard)]


def parse(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """RLZ parse of the stretches of a reference block against it.

    ``words``: word hashes of the block; a stretch has words starts..ends and a first document. Stretches stand in the
    order of their documents. Returns, for every window (at its first word; others 0): the factor it lies in, and its
    smallest document. A factor is a maximal run of windows whose sources in the block follow each other word by word."""
    n = max(0, len(words) - WINDOW + 1)
    code = words[:n].copy()
    for j in range(1, WINDOW):
        code = chain(code, words[j : n + j])
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :]) if n else np.zeros(0, dtype=np.int64)
    # index: the first place of each window in the block, which is one of its smallest document
    _, first, inverse = np.unique(code[inside], return_index=True, return_inverse=True)
    source = inside[first][inverse]
    least = np.zeros(len(words), dtype=np.int64)
    least[inside] = docs[owner[source]]
    # the source of a factor runs on by one word; where it does not, a new factor begins and its windows are looked up anew
    breaks = np.ones(len(inside), dtype=bool)
    breaks[1:] = (np.diff(inside) != 1) | (np.diff(source) != 1) | (np.diff(owner[inside]) != 0)
    factor = np.zeros(len(words), dtype=np.int64)
    factor[inside] = np.cumsum(breaks)
    return factor, least


def answer_stretches(shard: int, got: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """To each block: for the factors of each stretch it sent, in order, their windows and smallest document."""
    docs, texts = [], []
    for _, _, data in got:
        d, t = unsqueeze(data)
        docs.append(np.frombuffer(d, dtype=np.int64))
        texts += t.split(b"\n")
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")  # the reference block: stretches by their first document
    counts = np.array([t.count(b" ") + 1 for t in texts], dtype=np.int64)[order]
    words = word_hashes(b" ".join([texts[k] for k in order]))
    ends = np.cumsum(counts)
    factor, least = parse(words, ends - counts, ends, doc[order])
    # windows of each stretch, back in the order of sending
    windows = counts - WINDOW + 1
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    out, at = [], 0
    for (block, _, _), d in zip(got, docs, strict=True):
        own = place[at : at + len(d)]
        at += len(d)
        n = windows[own]
        total = np.cumsum(n)
        w = np.repeat((ends - counts)[own] - total + n, n) + np.arange(total[-1] if len(n) else 0)
        f, low = factor[w], least[w]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (f[1:] != f[:-1]) | (low[1:] != low[:-1])
        cut = np.flatnonzero(new)
        runs = np.diff(np.concatenate([cut, [len(w)]]))
        out.append((block, shard, 2, squeeze(n.astype(np.uint8), runs.astype(np.uint8), low[cut])))
    return out


def removed_words(b: Block, sent: Distinct, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """A flag for each word of the block."""
    where = dict(by_shard(sent.shard)) if len(sent.text) else {}
    first = np.zeros(len(sent.text), dtype=np.int64)  # place of a distinct stretch's windows in ``low``
    parts, at = [], 0
    for shard, data in answers:
        n, runs, low = unsqueeze(data)
        n = np.frombuffer(n, dtype=np.uint8).astype(np.int64)
        parts.append(np.repeat(np.frombuffer(low, dtype=np.int64), np.frombuffer(runs, dtype=np.uint8)))
        first[where[shard]] = at + np.cumsum(n) - n
        at += len(parts[-1])
    low = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    total = np.cumsum(sent.size)
    inner = np.arange(total[-1] if len(total) else 0) - np.repeat(total - sent.size, sent.size)
    bad = low[np.repeat(first[sent.which], sent.size) + inner] < np.repeat(b.ids[sent.doc], sent.size)
    window = (np.repeat(sent.start, sent.size) + inner)[bad]
    edge = np.zeros(len(b.words) + 1, dtype=np.int64)
    np.add.at(edge, window, 1)
    np.add.at(edge, window + WINDOW, -1)
    return np.cumsum(edge)[:-1] > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the words that stay, joined by a space), removed_spans array<struct<start, end>>
    (word numbers, end exclusive)."""
    base = write_blocks(docs, id_col, text_col, block_bytes)
    shards = max(1, -(-(base.agg(F.sum("n_bytes")).first()[0] or 0) // shard_bytes))
    own = base.select(F.col("_block").alias("_to"), F.lit(0).cast("long").alias("_from"), F.lit(0).alias("_role"), "_data")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                yield from messages(send_anchors(block, Block(data.as_py()), shards))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, got in received(batches):
            yield from messages(answer_anchors(shard, got))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in received(batches):
            yield from messages(Distinct(Block(got[0][2]), [(s, d) for s, _, d in got[1:]], shards).send(block))

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, got in received(batches):
            yield from messages(answer_stretches(shard, got))

    made = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()),
                      ("removed_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in received(batches):
            b = Block(got[0][2])
            sent = Distinct(b, [(s, d) for s, role, d in got if role == 1], shards)
            gone = removed_words(b, sent, [(s, d) for s, role, d in got if role == 2])
            rows = {f.name: [] for f in made}
            ends = np.cumsum(b.counts)
            for k, (z, n) in enumerate(zip(ends.tolist(), b.counts.tolist(), strict=True)):
                own_gone = gone[z - n : z]
                words = b.words[z - n : z]
                if own_gone.any():
                    words = [w for w, g in zip(words, own_gone.tolist(), strict=True) if not g]
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], own_gone.astype(np.int8), [0]])))
                else:
                    turn = np.zeros(0, dtype=np.int64)
                kept = b" ".join(words)
                rows["_id"].append(None if b.missing[k] else int(b.ids[k]))
                rows["n_words"].append(n)
                rows["n_removed"].append(int(own_gone.sum()))
                rows["kept"].append(kept.decode("utf-8", "replace"))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                rows["removed_spans"].append([{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()])
            yield arrow_rows(rows, made)

    repeated = materialize(delivered(own.mapInArrow(anchors, MESSAGE)).mapInArrow(tell, MESSAGE), "anchors")
    asked = delivered(own.union(repeated)).mapInArrow(ask, MESSAGE)
    found = delivered(asked).mapInArrow(factors, MESSAGE)
    out = delivered(own.union(repeated).union(found)).mapInArrow(
        cut, "_id long, n_words long, n_removed long, kept string, kept_sha256 string, removed_spans array<struct<start: long, end: long>>")
    return out.withColumnRenamed("_id", id_col)
