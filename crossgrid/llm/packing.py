"""Token ids packed into rows of fixed length by best-fit decreasing, with a segment tree over free capacities.

Documents are tokenised with a public byte-level vocabulary and end with an end-of-text id. A document longer than a row
is cut into full rows and a rest, so nothing is lost. The pieces of a batch of documents are sorted by falling length;
each goes to the open row with the least free room that still holds it. The tree stores, for every capacity, the number
of open rows with that room, and finds the smallest fitting capacity in log2(row length) steps.

Batches hold about ``BATCH_TOKENS`` tokens whatever the size of the corpus, so a task's memory is bounded and packing
needs no shuffle; the rows left open at the end of a batch are all the room that is lost to the cut.

Null and empty texts are one end-of-text id. Ids may be null or repeat; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crossgrid.llm.common import small_batches

ROW_TOKENS = 2048
BATCH_TOKENS = 4_000_000
#: Text pieces whose ids a Python worker remembers.
CACHE = 600_000
_CODERS: dict[str, Tokens] = {}


class FreeRoom:
    """Open rows by free capacity: a segment tree of counts over 0..size, leaves at the bottom."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The (room, row) with the least room of at least ``need``, removed; None if no row has it."""
        count, at = self.count, self.leaves + need
        if not count[at]:
            # climb until a right neighbour holds rows, then go down to its leftmost
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each row, in the order they were put in. Ties go by position."""
    tree, rows = FreeRoom(capacity), []
    for k in np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable").tolist():
        got = tree.take(sizes[k])
        room, row = got if got else (capacity, len(rows))
        if got is None:
            rows.append([])
        rows[row].append(k)
        tree.put(room - sizes[k], row)
    return rows


class Tokens:
    """Ids of texts by a byte-level vocabulary. A space before a non-space always begins a new pre-token, so a text can be
    cut there; the ids of equal cuts are remembered."""

    def __init__(self, vocabulary: str, pattern: str, cache: int = CACHE):
        """``vocabulary``: lines of a base64 token and its rank."""
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end, self.cache = len(ranks), cache
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """With the end-of-text id."""
        known, out = self.known, []
        if text:
            if len(known) > self.cache:
                known.clear()
            first, *rest = text.split(" ")
            encode = self.encoding.encode_ordinary
            if "" in rest or any(p[:1].isspace() for p in rest):  # runs of white space stay whole
                return [*encode(text), self.end]
            out += encode(first)
            for part in rest:
                ids = known.get(part)
                if ids is None:
                    ids = known[part] = encode(" " + part)
                out += ids
        out.append(self.end)
        return out


def pack(ids: list[np.ndarray], capacity: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(ids, cumulative segment lengths, positions that begin at 0 in each segment, (document, first token) of each segment)."""
    pieces = [(k, at, min(capacity, len(x) - at)) for k, x in enumerate(ids) for at in range(0, len(x), capacity)]
    for row in best_fit_decreasing([n for _, _, n in pieces], capacity):
        segments = [pieces[p] for p in row]
        flat = np.concatenate([ids[k][at : at + n] for k, at, n in segments])
        ends = np.cumsum([0] + [n for _, _, n in segments])
        yield flat, ends, np.arange(len(flat)) - np.repeat(ends[:-1], np.diff(ends)), [(k, at) for k, at, _ in segments]


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = ROW_TOKENS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Packed rows: n_tokens, input_ids (int32 little-endian), cu_seqlens array<int>, position_ids (uint16 or uint32
    little-endian), doc_ids and doc_offsets (first token of the segment in its document) of the segments.

    ``vocabulary`` is the text of a rank file, ``pattern`` its pre-token pattern; both are small and sent to the tasks."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern))
    name = uuid.uuid4().hex
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    made = pa.schema([
        ("n_tokens", pa.int64()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())),
    ])

    def packed(ids: list[np.ndarray], names: list) -> Iterator[pa.RecordBatch]:
        out = {f.name: [] for f in made}
        for flat, ends, places, segments in pack(ids, capacity):
            out["n_tokens"].append(len(flat))
            out["input_ids"].append(flat.astype("<i4").tobytes())
            out["cu_seqlens"].append(ends.astype(np.int32))
            out["position_ids"].append(places.astype("<u2" if capacity <= 1 << 16 else "<u4").tobytes())
            out["doc_ids"].append([names[k] for k, _ in segments])
            out["doc_offsets"].append([at for _, at in segments])
        for at in range(0, len(out["n_tokens"]), 256):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name][at : at + 256], type=f.type) for f in made], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _CODERS:
            _CODERS.clear()
            _CODERS[name] = Tokens(*sent.value)
        coder, ids, names, held = _CODERS[name], [], [], 0
        for batch in small_batches(batches, "_text"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(np.array(coder.encode(text), dtype=np.int32))
                names.append(doc)
                held += len(ids[-1])
                if held >= batch_tokens:
                    yield from packed(ids, names)
                    ids, names, held = [], [], 0
        if ids:
            yield from packed(ids, names)

    return rows.mapInArrow(run, "n_tokens long, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, doc_offsets array<long>")
