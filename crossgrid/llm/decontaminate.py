"""Benchmark decontamination with an Aho-Corasick automaton over normalised windows of the test items.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z became lower case. An item's windows are its runs of
``WINDOW`` words; a shorter item is one window of all its words. Texts are joined by single spaces, so a window is a
string that begins and ends with a space, and one scan of a text finds all of them, overlapping ones too.

The items reach the tasks in blocks of bounded text, one automaton for each block; a task keeps few automata at a time.
Null texts have no words. Items without words have no window. Items without an id still contaminate, under the id "null".
Repeated items count once; documents are never joined, so repeated ids and clashing column names do no harm.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crossgrid.llm.common import ALNUM, arrow_rows, kept, one_text, small_batches, utf8

WINDOW = 13
#: Bytes of normalised item text in one automaton: about 13 times as many nodes, some 100 MB.
BLOCK_BYTES = 128 << 10
#: Automata that a Python worker keeps; with more blocks than that it builds them again for each batch.
KEPT = 4
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM).split()


def window_strings(words: list[bytes], window: int = WINDOW) -> list[str]:
    """Latin-1 strings of the UTF-8 bytes: one code point a byte."""
    cut = [words[i : i + window] for i in range(max(1, len(words) - window + 1))] if words else []
    return [(b" " + b" ".join(w) + b" ").decode("latin-1") for w in cut]


def item_blocks(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list:
    """Broadcasts of (item ids, texts); each holds about ``block_bytes``, whatever the number of items."""
    blocks, ids, texts, held = [], [], [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    for row in rows.toLocalIterator():
        ids.append("null" if row.i is None else row.i)
        texts.append(row.t)
        held += len(row.t or "")
        if held >= block_bytes:
            blocks.append(spark.sparkContext.broadcast((ids, texts)))
            ids, texts, held = [], [], 0
    if ids:
        blocks.append(spark.sparkContext.broadcast((ids, texts)))
    return blocks


def build(ids: list[str], texts: list[str | None], window: int = WINDOW):
    """Automaton of all windows; a match tells the window's words and the items that have it. None without windows."""
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for i, t in zip(ids, texts, strict=True):
        for w in window_strings(words_of(t), window):
            owners.setdefault(w, set()).add(i)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for w, own in owners.items():
        automaton.add_word(w, (len(w), w.count(" ") - 1, tuple(own)))
    automaton.make_automaton()
    return automaton


def _automaton(key: tuple[str, int], block, window: int):
    """``key`` names the block among all that this Python worker ever sees."""
    automata = kept("decontaminate")
    if key not in automata:
        while len(automata) >= KEPT:
            automata.pop(next(iter(automata)))
        automata[key] = build(*block.value, window)
    return automata[key]


def scan(text: str | None, automata: list) -> tuple[int, np.ndarray, set[str]]:
    """Words of a text, the numbers of the hit ones, and the items found."""
    words = words_of(text)
    items: set[str] = set()
    norm = (b" " + b" ".join(words) + b" ") if words else b""
    found = [m for a in automata if a is not None and words for m in a.iter(norm.decode("latin-1"))]
    if not found:
        return len(words), np.zeros(0, dtype=np.int64), items
    spaces = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    ends = np.array([e for e, _ in found])
    first = np.searchsorted(spaces, ends - np.array([m[0] for _, m in found]) + 1)
    count = np.array([m[1] for _, m in found])
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count, -1)
    for _, m in found:
        items.update(m[2])
    return len(words), np.flatnonzero(np.cumsum(edge)[:-1] > 0), items


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code point offsets of the text as it was given."""
    places = [m.span() for m in _WORD.finditer(text)]
    cut = np.flatnonzero(np.diff(hit) > 1) + 1
    return [{"start": places[run[0]][0], "end": places[run[-1]][1]} for run in np.split(hit, cut) if len(run)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, carry: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, item_ids (sorted as strings), hit_spans (offsets of the original text),
    contaminated (a hit, and a twentieth of the words or more). ``carry`` puts these columns after those of ``docs``."""
    blocks = item_blocks(docs.sparkSession, benchmark, item_col, item_text, block_bytes)
    name = uuid.uuid4().hex
    made = pa.schema([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("item_ids", pa.list_(pa.string())),
        ("hit_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("contaminated", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, sent, 64 << 20):
            texts = batch.column(batch.schema.get_field_index(sent)).to_pylist()
            found = [(0, np.zeros(0, dtype=np.int64), set()) for _ in texts]
            for k, block in enumerate(blocks or [None]):
                automaton = None if block is None else _automaton((name, k), block, window)
                for at, text in enumerate(texts):
                    n, hit, items = scan(text, [automaton])
                    _, before, had = found[at]
                    found[at] = (n, np.union1d(before, hit) if len(before) else hit, had | items)
            rows = {f.name: [] for f in made}
            for text, (n, hit, items) in zip(texts, found, strict=True):
                rows["n_words"].append(n)
                rows["n_hit"].append(len(hit))
                rows["n_items"].append(len(items))
                rows["item_ids"].append(sorted(items))
                rows["hit_spans"].append(original_spans(text, hit) if len(hit) else [])
                rows["contaminated"].append(len(hit) > 0 and 20 * len(hit) >= n)
            own = [batch.schema.get_field_index(c) for c in carried]
            new = arrow_rows(rows, made)
            yield pa.RecordBatch.from_arrays([batch.column(j) for j in own] + new.columns, schema=pa.schema([batch.schema.field(j) for j in own] + list(made)))

    names = [f.name for f in made]
    keep = [c for c in docs.columns if c not in names] if carry else [id_col]
    rows, sent, carried = one_text(docs, keep, text_col)
    out = "n_words long, n_hit long, n_items long, item_ids array<string>, hit_spans array<struct<start: long, end: long>>, contaminated boolean"
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, f"{fields}, {out}")


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
