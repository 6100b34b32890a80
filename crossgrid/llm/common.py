"""Shared helpers: word rules on UTF-8 bytes, row numbers, Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A-Z to lower case, every byte else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to lower case; 0-9, a-z and bytes of non-ASCII characters stay; the rest becomes a space.
ALNUM = bytes(LOWER[b] if 48 <= LOWER[b] <= 57 or 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256))
#: The separators of `[^\x20\x09-\x0D]+` are the ones bytes.split() knows.
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def utf8(text: str | None) -> bytes:
    """Null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fingerprint of a sequence from that of its head and that of its last item."""
    return mix64(left * _GOLD + right)


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: bytes, chunk: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word of ``text`` (runs of bytes other than white space), in order.

    A word's hash is the scrambled sum of one pseudo-random value for each byte and its place in the word, so all words
    are hashed side by side."""
    return _word_hashes(text, chunk)[0]


def text_word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words."""
    hashes, starts = _word_hashes(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(hashes, np.searchsorted(starts, ends[:-1])) if texts else []


def _word_hashes(text: bytes, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words."""
    data = np.frombuffer(text, dtype=np.uint8)
    out, begin, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0
    while at < len(data):
        end = min(len(data), at + chunk)
        if end < len(data):  # cut at white space
            free = np.flatnonzero(_IS_SPACE[data[end : end + chunk]])
            while not len(free) and end < len(data):
                end = min(len(data), end + chunk)
                free = np.flatnonzero(_IS_SPACE[data[end : end + chunk]])
            end += int(free[0]) if len(free) else 0
        part = data[at:end]
        space = _IS_SPACE[part]
        first = ~space
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        if len(starts):
            place = np.arange(len(part), dtype=np.int64)
            place -= np.maximum.accumulate(np.where(first, place, 0))
            value = mix64((place.astype(np.uint64) << np.uint64(8)) + part + _GOLD)
            value[space] = 0
            out.append(mix64(np.add.reduceat(value, starts)))
            begin.append(starts + at)
        at = end
    return np.concatenate(out), np.concatenate(begin)


def with_row(docs: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row; stable only once the result has been written."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``most_bytes`` of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rows = max(1, int(n * most_bytes / max(1, batch.column(batch.schema.get_field_index(text)).nbytes)))
        for at in range(0, n, rows):
            yield batch.slice(at, rows)


def arrow_rows(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal integer ``keys`` from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(at[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def squeeze(*parts: bytes | np.ndarray) -> bytes:
    """Byte strings or arrays as one compressed message."""
    import zstandard

    raw = [p.tobytes() if isinstance(p, np.ndarray) else p for p in parts]
    head = np.array([len(raw), *map(len, raw)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def unsqueeze(message: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(message)
    n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
    at = 8 * (n + 1)
    out = []
    for size in np.frombuffer(data, dtype="<i8", count=n, offset=8).tolist():
        out.append(data[at : at + size])
        at += size
    return out


#: What operators keep in a Python worker from one task to the next, by operator.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """The store of ``operator`` in this Python worker; those of others, left by earlier stages, are given back."""
    if left := [name for name in _KEPT if name != operator]:
        for name in left:
            del _KEPT[name]
        give_back()
    return _KEPT.setdefault(operator, {})


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def one_text(docs: DataFrame, columns: list[str], text_col: str) -> tuple[DataFrame, str, list[str]]:
    """``columns`` of ``docs`` and the text, which is sent once: the rows, the text's name there, the columns to carry on."""
    if text_col in columns:
        return docs.select(*columns), text_col, columns
    return docs.select(*columns, F.col(text_col).alias("_text")), "_text", columns


#: Rows that blocks of documents and shards of keys send each other.
MESSAGE = "_to long, _from long, _role int, _data binary"
MESSAGE_ARROW = pa.schema([("_to", pa.int64()), ("_from", pa.int64()), ("_role", pa.int32()), ("_data", pa.binary())])


def messages(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of messages of some ten MB each."""
    at, size = 0, 0
    for k, row in enumerate(rows):
        size += len(row[3])
        if size > 16 << 20 or k + 1 == len(rows):
            yield arrow_rows({n: [r[j] for r in rows[at : k + 1]] for j, n in enumerate(MESSAGE_ARROW.names)}, MESSAGE_ARROW)
            at, size = k + 1, 0


def delivered(rows: DataFrame) -> DataFrame:
    """Messages by receiver, those of lower role and sender first."""
    return rows.select("_to", "_from", "_role", "_data").repartition("_to").sortWithinPartitions("_to", "_role", "_from")


def received(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(receiver, [(sender, role, data)]) from delivered messages."""
    for group in sorted_groups(batches, ["_to"]):
        yield group["_to"][0].as_py(), list(zip(group["_from"].to_pylist(), group["_role"].to_pylist(), group["_data"].to_pylist(), strict=True))


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, with the places of its entries in their given order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part
