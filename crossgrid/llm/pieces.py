"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A text gets one leading space, spaces become the marker U+2581, and the best-scoring division into pieces is found.
A character without a piece becomes the byte pieces of its UTF-8 form. No piece has a marker after another character,
so units (markers and the characters up to the next marker) can be solved one by one; equal units are solved once for
each batch and remembered in a bounded cache. Short units are solved side by side with numpy, long ones one by one.

Null and empty texts have no ids. A marker that stands in the text itself decodes to a space, as in the public library.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crossgrid.llm.common import give_back, kept, one_text, small_batches

MARK = "▁"
#: Units of more UTF-8 bytes are solved one by one; others so many at once.
SHORT, SIDE = 48, 8192
#: Bytes of units that a Python worker remembers, from one task to the next; a unit counts UNIT bytes and its own.
CACHE, UNIT = 48 << 20, 200
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")
_LEAD = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)


class Vocabulary:
    """Pieces, scores and kinds; a double-array trie over the UTF-8 bytes of the normal pieces."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """kinds: "normal", "byte", "unknown" or "control" for each piece."""
        self.scores = np.array(scores, dtype=np.float64)
        self.byte_ids = np.full(256, kinds.index("unknown") if "unknown" in kinds else 0)
        self.surface: list[bytes] = []
        keys = []
        for k, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == "normal":
                keys.append((piece.encode(), k))
                self.surface.append(piece.replace(MARK, " ").encode())
            elif kind == "byte":
                self.byte_ids[int(piece[3:5], 16)] = k
                self.surface.append(bytes([int(piece[3:5], 16)]))
            else:
                self.surface.append("⁇".encode() if kind == "unknown" else b"")
        normal = [k for _, k in keys]
        self.unknown = (self.scores[normal].min() if normal else 0.0) - 10.0
        self._build(sorted(keys))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file; ``path`` is a parameter, the file is only read."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        kind = ["byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) or m.is_unused(i) else "normal" for i in n]
        return cls([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], kind)

    def _build(self, keys: list[tuple[bytes, int]]) -> None:
        """A child of node s by byte c stands at base[s] + c + 1, where check holds s; node 0 is the root."""
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        todo, free, tail = [(0, 0, len(keys), 0)], 258, 258  # no label is above 256
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[lo][0]) == depth:
                value[node] = keys[lo][1]
                lo += 1
            groups, at = [], lo
            while at < hi:
                c, end = keys[at][0][depth], at
                while end < hi and keys[end][0][depth] == c:
                    end += 1
                groups.append((c, at, end))
                at = end
            if not groups:
                continue
            labels = np.array([c for c, _, _ in groups]) + 1
            while check[free] >= 0:
                free += 1
            # only children fill the holes; several children are tried from a mark that moves on after many misses
            start, tries = (free if len(labels) == 1 else tail) - int(labels[0]), 0
            while True:
                if start + 300 >= len(check):
                    base, check, value = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                if (check[start + labels] < 0).all():
                    break
                start, tries = start + 1, tries + 1
            if tries > 64 and len(labels) > 1:
                tail = start + int(labels[0])
            base[node] = start
            check[start + labels] = node
            todo += [(start + c + 1, a, b, depth + 1) for c, a, b in groups]
        self.base, self.check, self.value = (np.concatenate([x, np.full(300, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))

    def solve_one(self, unit: bytes) -> list[int]:
        """Viterbi over one unit, with byte fallback."""
        n = len(unit)
        lists = getattr(self, "_lists", None)
        if lists is None:
            lists = self._lists = (self.base.tolist(), self.check.tolist(), self.value.tolist(), self.scores.tolist())
        base, check, value, scores = lists
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        s = 0
        while s < n:
            lead = unit[s]
            wide = min(n - s, 1 if lead < 192 else 2 if lead < 224 else 3 if lead < 240 else 4)
            here, node, t, single = best[s], 0, s, False
            while t < n:
                to = base[node] + unit[t] + 1
                if check[to] != node:
                    break
                node, t = to, t + 1
                if (v := value[node]) >= 0:
                    if (c := here + scores[v]) > best[t]:
                        best[t], back[t] = c, (s, v)
                    single |= t == s + wide
            if not single and here + self.unknown > best[s + wide]:
                best[s + wide], back[s + wide] = here + self.unknown, (s, -1)
            s += wide
        out, t = [], n
        while t:
            s, v = back[t]
            out += [v] if v >= 0 else [int(self.byte_ids[b]) for b in reversed(unit[s:t])]
            t = s
        return out[::-1]

    def solve(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of each unit."""
        out: list = [None] * len(units)
        size = np.array([len(u) for u in units], dtype=np.int64)
        rows = np.flatnonzero(size <= SHORT)
        for k in np.flatnonzero(size > SHORT):
            out[k] = np.array(self.solve_one(units[k]), dtype=np.int32)
        if not len(rows):
            return out
        rows = rows[np.argsort(size[rows], kind="stable")]
        for at in range(0, len(rows), SIDE):
            self._solve_side(units, rows[at : at + SIDE], size, out)
        return out

    def _solve_side(self, units: list[bytes], rows: np.ndarray, size: np.ndarray, out: list) -> None:
        """Short units of about one length, side by side."""
        width = int(size[rows[-1]])
        joined = np.frombuffer(b"".join(units[k] for k in rows), dtype=np.uint8)
        text = np.zeros((len(rows), width + 1), dtype=np.uint8)
        n = size[rows]
        text[np.arange(width + 1) < n[:, None]] = joined
        best = np.full((len(rows), width + 5), -np.inf)
        best[:, 0] = 0.0
        came, piece = (np.zeros((len(rows), width + 5), dtype=np.int32) for _ in range(2))
        for s in range(width):
            live = np.flatnonzero((best[:, s] > -np.inf) & (n > s))
            wide = np.minimum(_LEAD[text[live, s]], n[live] - s)
            single = np.zeros(len(rows), dtype=bool)
            at, w, node, t = live, wide, np.zeros(len(live), dtype=np.int32), s
            while len(at):
                to = self.base[node] + text[at, t] + 1
                ok = self.check[to] == node
                at, w, node, t = at[ok], w[ok], to[ok], t + 1
                v = self.value[node]
                has = v >= 0
                a, v = at[has], v[has]
                c = best[a, s] + self.scores[v]
                better = c > best[a, t]
                a, v = a[better], v[better]
                best[a, t], came[a, t], piece[a, t] = c[better], s, v
                single[at[has & (w == t - s)]] = True
                more = n[at] > t
                at, w, node = at[more], w[more], node[more]
            lone = ~single[live]
            a, e = live[lone], s + wide[lone]
            better = best[a, s] + self.unknown > best[a, e]
            a, e = a[better], e[better]
            best[a, e], came[a, e], piece[a, e] = best[a, s] + self.unknown, s, -1
        found, steps, t, at = np.zeros((len(rows), width + 1), dtype=np.int32), np.zeros(len(rows), dtype=np.int64), n.copy(), np.flatnonzero(n)
        odd = np.zeros(len(rows), dtype=bool)
        while len(at):
            p = piece[at, t[at]]
            odd[at[p < 0]] = True
            found[at, width - steps[at]] = p
            steps[at] += 1
            t[at] = came[at, t[at]]
            at = at[t[at] > 0]
        for i, k in enumerate(rows):
            out[k] = np.array(self.solve_one(units[k]), dtype=np.int32) if odd[i] else found[i, width + 1 - steps[i] :]


class Encoder:
    """Encodes batches of texts; remembers units and their ids up to ``cache`` bytes, and those of one batch."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.v, self.cache = vocabulary, cache
        self._fresh()

    def _fresh(self) -> None:
        self.known: dict[str, int] = {}
        self.held = self.units_held = 0
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def units(text: str) -> list[str]:
        """A marker before the text and for each space; no unit but the last ends inside a run of markers."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return _UNIT.findall(MARK + text.replace(" ", MARK))
        return text.split(" ")  # the marker before each is added in _learn

    def _learn(self, new: list[str]) -> None:
        got = self.v.solve([(u if u[:1] == MARK else MARK + u).encode("utf-8", "surrogatepass") for u in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.held += sum(UNIT + 4 * len(u) + g.nbytes for u, g in zip(new, got, strict=True))
        ends = self.start[self.units_held] + np.cumsum([len(g) for g in got])
        self.flat = self._room(self.flat, int(ends[-1]))
        self.flat[self.start[self.units_held] : ends[-1]] = np.concatenate(got)
        self.start = self._room(self.start, self.units_held + len(got) + 1)
        self.start[self.units_held + 1 : self.units_held + len(got) + 1] = ends
        self.units_held += len(got)

    @staticmethod
    def _room(x: np.ndarray, size: int) -> np.ndarray:
        """``x`` with room for ``size`` entries; it grows by half at least."""
        if size <= len(x):
            return x
        out = np.zeros(max(size, len(x) * 3 // 2), dtype=x.dtype)
        out[: len(x)] = x
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one more entry at the end)."""
        if self.held > self.cache:
            self._fresh()
            give_back()
        units = [self.units(t) if t else [] for t in texts]
        every = [u for us in units for u in us]
        get = self.known.get
        at = [get(u, -1) for u in every]
        if -1 in at:
            self._learn(list(dict.fromkeys(u for u, k in zip(every, at, strict=True) if k < 0)))
            at = [get(u) for u in every]
        at = np.array(at, dtype=np.int64)
        size = self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(us) for us in units])]).astype(np.int64)]
        return ids, cut

    def decode(self, ids: list[int]) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD. The space put before the text is taken off."""
        surface = self.v.surface
        got = b"".join([surface[i] for i in ids])
        return (got[1:] if got[:1] == b" " else got).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", cache: int = CACHE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with piece_ids array<int>, n_pieces long, n_byte_pieces long, decoded string and round_trip boolean
    (decoded equals the text, null read as empty); columns of these names are replaced. ``keep`` names the columns of
    ``docs`` to carry on (all of them by default)."""
    vocabulary = Vocabulary.load(model_path)  # its size is that of a vocabulary, not of the data
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    name = uuid.uuid4().hex
    made = pa.schema([("piece_ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("decoded", pa.string()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = kept("pieces")
        if name not in coders:
            coders.clear()
            coders[name] = Encoder(sent.value, cache)
        coder = coders[name]
        is_byte = np.zeros(len(coder.v.surface), dtype=bool)
        is_byte[coder.v.byte_ids] = True
        for batch in small_batches(batches, text, 1 << 20):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids, cut = coder.encode(texts)
            as_list = ids.tolist()
            decoded = [coder.decode(as_list[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            seen = np.concatenate([[0], np.cumsum(is_byte[ids])])
            columns = [
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(cut)),
                pa.array(seen[cut[1:]] - seen[cut[:-1]]), pa.array(decoded), pa.array([(t or "") == d for t, d in zip(texts, decoded, strict=True)]),
            ]
            own = [batch.schema.get_field_index(c) for c in carried]
            yield pa.RecordBatch.from_arrays([batch.column(j) for j in own] + columns, schema=pa.schema([batch.schema.field(j) for j in own] + list(made)))

    rows, text, carried = one_text(docs, [c for c in docs.columns if c not in made.names and (keep is None or c in keep)], text_col)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    fields = f"{fields}, " if fields else ""
    return rows.mapInArrow(run, f"{fields}piece_ids array<int>, n_pieces long, n_byte_pieces long, decoded string, round_trip boolean")
