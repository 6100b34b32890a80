"""Near-duplicate components by a multi-index Hamming join of MinHash signatures, confirmed on the full shingle sets.

A signature has ``SYMBOLS`` symbols of 16 bits of one minimum each, so two sets of similarity s differ in a share
1 - s of the symbols on average. Pairs that differ in at most ``DISTANCE`` symbols are all found: cut into ``CHUNKS``
chunks, some chunk has at most DISTANCE // CHUNKS errors (pigeonhole), so each chunk is entered under every choice of
that many symbols left out. At s = 0.8 a pair is beyond 31 of 64 with a probability near 1e-7.

Stages, each on what the one before left:
1. equal sets become one class (an aggregate; copies are never paired),
2. every bucket has a leader; each class is held against the nearest leader of its buckets, then against the other
   leaders that the first links did not join it with,
3. components of the confirmed links,
4. buckets that still hold several components: all pairs of different components, in tiles of bounded size, first by
   signature, then by set; a pair counts in the first bucket only that holds both, a tile skips what its own links have
   joined and returns links only,
5. components again.
No bucket is capped or sampled. Texts travel only for classes that have a candidate, found again by a Bloom filter.

Null and empty texts have no shingles and stay alone. Rows with a null id rank above all others. A row that repeats
another's id and text is a copy of it. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crossgrid.llm.common import LOWER, arrow_rows, chain, mix64, small_batches, sorted_groups, text_word_hashes, utf8, with_row
from crossgrid.llm.components import components
from crossgrid.llm.exact_dedup import mark_listed
from crossgrid.session import materialize

SHINGLE = 5
SIMILARITY = 80  # per cent
SYMBOLS = 64
CHUNKS = 16
DISTANCE = 31
#: Classes in one side of a tile.
TILE = 500
#: A tile numbers the shingles of its sets if it holds no more of them; longer sets are compared pair by pair.
NUMBERED = 1 << 23
#: Symbols kept of a chunk, one choice for each bucket of the chunk.
_CHOICES = list(combinations(range(SYMBOLS // CHUNKS), SYMBOLS // CHUNKS - DISTANCE // CHUNKS))
#: The upper bits of a bucket's key are its number, from 0 to 63.
_NUMBER_AT = 57

_rng = np.random.default_rng(20240229)
_ADD = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The shingle set of each text: sorted distinct 64-bit fingerprints."""
    for h in text_word_hashes([utf8(t).translate(LOWER) for t in texts]):
        yield _shingles(h, size)


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the runs of ``size`` words; of the whole text if it has fewer."""
    if not len(h):
        return h
    k = min(size, len(h))
    x = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        x = chain(x, h[j : len(h) - k + 1 + j])
    return np.unique(x)


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, as uint16."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, ((s[at : at + 4096, None] ^ _ADD) * _MUL).min(axis=0))
    return (mix64(low) >> np.uint64(48)).astype(np.uint16)


def bucket_keys(sigs: np.ndarray) -> np.ndarray:
    """One column for each chunk and choice of symbols left out; keys of a column begin with its number."""
    parts = sigs.reshape(len(sigs), CHUNKS, SYMBOLS // CHUNKS).astype(np.uint64)
    out = []
    for c in range(CHUNKS):
        for j, kept in enumerate(_CHOICES):
            x = np.full(len(sigs), c * 256 + j, dtype=np.uint64)
            for k in kept:
                x = chain(x, parts[:, c, k])
            out.append((x >> np.uint64(64 - _NUMBER_AT)) | np.uint64(len(out) << _NUMBER_AT))
    return np.stack(out, axis=1)


def first_met(differ: np.ndarray, number: int) -> np.ndarray:
    """Of pairs, given by the symbols in which they differ, those that share no bucket of a lower number."""
    chunk, choice = divmod(number, len(_CHOICES))
    parts = differ.reshape(len(differ), CHUNKS, SYMBOLS // CHUNKS)
    met = (parts[:, :chunk].sum(axis=2, dtype=np.uint8) <= DISTANCE // CHUNKS).any(axis=1)
    for kept in _CHOICES[:choice]:
        met |= ~parts[:, chunk, kept].any(axis=1)
    return ~met


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def similar_among(sets: list[np.ndarray], percent: int = SIMILARITY) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function that returns those of the places ``ys`` whose set is similar to the one at ``x``; no set is empty.

    Short sets are numbered once, so that one is counted against many in a few array operations."""
    size = np.array([len(s) for s in sets])
    if size.sum() > NUMBERED:
        return lambda x, ys: np.array([y for y in ys.tolist() if similar(sets[x], sets[y], percent)], dtype=np.int64)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(size)[:-1])
    held = np.zeros(len(names), dtype=np.uint8)

    def among(x: int, ys: np.ndarray) -> np.ndarray:
        ys = ys[np.minimum(size[ys], size[x]) * 100 >= percent * np.maximum(size[ys], size[x])]
        if not len(ys):
            return ys
        held[ids[x]] = 1
        both = np.add.reduceat(held[np.concatenate([ids[y] for y in ys.tolist()])], np.cumsum(size[ys]) - size[ys], dtype=np.int64)
        held[ids[x]] = 0
        return ys[100 * both >= percent * (size[x] + size[ys] - both)]

    return among


def _symbols(column, kind=np.uint8) -> np.ndarray:
    """Signatures of a binary column as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, SYMBOLS)


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_k1``, ``_k2``: 128 bits of a row's id and text, by which its text is found again in a later pass."""
    i, t = F.col(id_col), F.col(text_col)
    return docs.select(i.alias("_id"), t.alias("_text"), F.xxhash64(i, t).alias("_k1"), F.xxhash64(t, F.lit(7), i).alias("_k2"))


def sign(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """_row, _id, _k1, _k2, n_shingles, _s1, _s2 (128 bits of the set), _sig of every row; written once."""
    made = pa.schema([("n_shingles", pa.int64()), ("_s1", pa.int64()), ("_s2", pa.int64()), ("_sig", pa.binary()), ("_low", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches, "_text"):
            at = batch.schema.get_field_index("_text")
            rows = {f.name: [] for f in made}
            for s in shingle_sets(batch.column(at).to_pylist(), shingle):
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                rows["n_shingles"].append(len(s))
                rows["_s1"].append(d[0])
                rows["_s2"].append(d[1])
                sig = signature(s)
                rows["_sig"].append(sig.tobytes())
                rows["_low"].append(sig.astype(np.uint8).tobytes())
            kept = [j for j in range(batch.num_columns) if j != at]
            new = arrow_rows(rows, made)
            yield pa.RecordBatch.from_arrays([batch.column(j) for j in kept] + new.columns,
                                             schema=pa.schema([batch.schema.field(j) for j in kept] + list(made)))

    rows = _identified(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.select("_id", "_k1", "_k2", "_text").mapInArrow(
        run, f"_id {kind}, _k1 long, _k2 long, n_shingles long, _s1 long, _s2 long, _sig binary, _low binary")
    return materialize(with_row(out), "signatures")


def classes_of(signed: DataFrame) -> DataFrame:
    """One row for each distinct set: _cls (its smallest row number), _k1, _k2 (of that row), _s1, _s2, _sig, and
    _low, the low byte of each symbol: no pair is farther by it than by _sig."""
    one = F.min(F.struct("_row", "_k1", "_k2", "_sig", "_low"))
    return materialize(
        signed.filter("n_shingles > 0").groupBy("_s1", "_s2").agg(one.alias("o"))
        .select(F.col("o._row").alias("_cls"), "_s1", "_s2", "o._k1", "o._k2", "o._sig", "o._low"), "set-classes")


def bucket_members(classes: DataFrame) -> DataFrame:
    """_key, _cls, _first of every bucket with several classes; _first marks its leader, one of them by hash. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bucket_keys(_symbols(batch.column(1), np.uint16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["_key", "_cls"])

    keys = classes.select("_cls", "_sig").mapInArrow(run, "_key long, _cls long").withColumn("_h", F.xxhash64("_cls", "_key"))
    shared = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("_low_h")).filter("n > 1").drop("n")
    return materialize(keys.join(shared, "_key").select("_key", "_cls", (F.col("_h") == F.col("_low_h")).alias("_first")), "buckets")


def leader_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """_leader, _cls, _far of all pairs of a class and a leader of one of its buckets within the distance; at most one for
    each member of a bucket. Written once."""
    leaders = members.filter("_first").select("_key", F.col("_cls").alias("_leader"))
    sigs = classes.select("_cls", "_low")
    pairs = members.filter("not _first").select("_key", "_cls").join(leaders, "_key").select("_leader", "_cls").distinct()
    pairs = pairs.join(sigs, "_cls").join(sigs.select(F.col("_cls").alias("_leader"), F.col("_low").alias("_low2")), "_leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = (_symbols(batch.column(2)) != _symbols(batch.column(3))).sum(axis=1)
                ok = far <= DISTANCE
                yield arrow_rows({"_leader": batch.column(0).to_numpy()[ok], "_cls": batch.column(1).to_numpy()[ok], "_far": far[ok]},
                                 pa.schema([("_leader", pa.int64()), ("_cls", pa.int64()), ("_far", pa.int32())]))

    return materialize(pairs.select("_leader", "_cls", "_low", "_low2").mapInArrow(run, "_leader long, _cls long, _far int"), "leader-pairs")


def _distinct_groups(rows: DataFrame) -> DataFrame:
    """Of the keys that have the same classes, the one of the lowest bucket number: there a pair of them meets first."""
    group = rows.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("_cls")).alias("x1"), F.bit_xor(F.xxhash64("_cls", F.lit(1))).alias("x2"))
    return group.groupBy("_n", "x1", "x2").agg(F.min("_key").alias("_key")).select("_key")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """_cls, _set for the classes in ``wanted`` (_cls, _k1, _k2). Only rows that pass a Bloom filter of fixed size move."""
    rows = mark_listed(_identified(docs, id_col, text_col), wanted, "_k1").filter("_maybe").select("_k1", "_k2", "_text")
    found = rows.join(wanted, ["_k1", "_k2"]).select("_cls", "_text")
    made = pa.schema([("_cls", pa.int64()), ("_set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            yield arrow_rows({"_cls": batch.column(0), "_set": [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), shingle)]}, made)

    return found.mapInArrow(run, "_cls long, _set binary")


def confirm_leaders(pairs: DataFrame, sets, percent: int) -> DataFrame:
    """Links (a, b) among (_leader, _cls) pairs. A leader with many classes meets them in groups of bounded size."""
    size = pairs.groupBy("_leader").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("_parts"))
    own = pairs.join(size, "_leader").select(
        F.col("_leader").alias("_g"), F.pmod(F.xxhash64("_cls"), F.col("_parts")).alias("_p"), F.lit(1).alias("_role"), "_cls")
    lead = size.select(F.col("_leader").alias("_g"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_p"),
                       F.lit(0).alias("_role"), F.col("_leader").alias("_cls"))
    rows = own.union(lead)
    rows = rows.join(sets(rows.select("_cls").distinct()), "_cls").repartition("_g", "_p").sortWithinPartitions("_g", "_p", "_role", "_cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["_g", "_p"]):
            every, cls = _sets(group["_set"]), group["_cls"].to_pylist()
            role = group["_role"].to_pylist()
            if role[0] == 0:
                got = [c for c, s, r in zip(cls, every, role, strict=True) if r == 1 and similar(every[0], s, percent)]
                yield arrow_rows({"a": [cls[0]] * len(got), "b": got}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return rows.select("_g", "_p", "_role", "_cls", "_set").mapInArrow(run, "a long, b long")


def _tiles(rows: DataFrame) -> DataFrame:
    """Deal the members (_key, _cls, _comp, _sig) of buckets with several components to tiles (_key, _i, _j) in roles.

    Only pairs of different components count, so every pair has a side outside the bucket's most frequent component: those
    members stand on the left (_role 0), in parts of ``TILE``; all members stand on the right (_role 1), in parts of twice
    that. Each left part meets each right part in one tile."""
    each = rows.groupBy("_key", "_comp").agg(F.count(F.lit(1)).alias("n"))
    size = each.groupBy("_key").agg(F.sum("n").alias("_n"), F.max(F.struct("n", "_comp")).alias("m")).filter("_n > m.n").select(
        "_key", F.col("m._comp").alias("_major"), F.ceil((F.col("_n") - F.col("m.n")) / TILE).alias("_left"), F.ceil(F.col("_n") / (2 * TILE)).alias("_right"))
    dealt = rows.join(size, "_key")
    own = lambda parts: F.pmod(F.xxhash64("_cls", F.lit(3)), F.col(parts)).cast("long")
    all_ = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts).cast("long") - 1))
    left = dealt.filter("_comp <> _major").select("_key", own("_left").alias("_i"), all_("_right").alias("_j"), F.lit(0).alias("_role"), "_cls", "_comp", "_sig")
    right = dealt.select("_key", all_("_left").alias("_i"), own("_right").alias("_j"), F.lit(1).alias("_role"), "_cls", "_comp", "_sig")
    return left.union(right)


def _close_pairs(group: pa.Table, comp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each left row with the right rows that are within the distance, meet it in no earlier bucket and are in other
    components; ``comp`` may change meanwhile."""
    sig, role = _symbols(group["_sig"], np.uint16), group["_role"].to_numpy()
    number = group["_key"][0].as_py() >> _NUMBER_AT
    right = np.flatnonzero(role == 1)
    for x in np.flatnonzero(role == 0):
        ok = right[comp[right] != comp[x]]
        if len(ok):
            differ = sig[ok] != sig[x]
            near = np.flatnonzero(differ.sum(axis=1) <= DISTANCE)
            ok = ok[near][first_met(differ[near], number)]
        if len(ok):
            yield int(x), ok


def cross_links(members: DataFrame, classes: DataFrame, comps: DataFrame, sets, percent: int) -> DataFrame:
    """Links (a, b) between classes of one bucket that are in different components so far."""
    rows = members.join(comps.select(F.col("node").alias("_cls"), "comp"), "_cls", "left").select("_key", "_cls", F.coalesce("comp", "_cls").alias("_comp"))
    several = rows.groupBy("_key").agg(F.min("_comp").alias("lo"), F.max("_comp").alias("hi")).filter("lo < hi").select("_key")
    rows = materialize(rows.join(several, "_key"), "open-buckets")
    rows = rows.join(_distinct_groups(rows), "_key").join(classes.select("_cls", "_sig"), "_cls").select("_key", "_cls", "_comp", "_sig")
    order = ["_key", "_i", "_j"]
    kept = pa.schema([("_key", pa.int64()), ("_cls", pa.int64()), ("_comp", pa.int64()), ("_sig", pa.binary())])

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, order):
            hit = sorted({k for x, ok in _close_pairs(group, group["_comp"].to_numpy()) for k in (x, *ok.tolist())})
            if hit:
                g = group.take(pa.array(hit))
                yield arrow_rows({n: g[n].to_pylist() for n in kept.names}, kept)

    tiled = _tiles(rows).repartition(*order).sortWithinPartitions(*order, "_role", "_cls")
    left = tiled.mapInArrow(survivors, "_key long, _cls long, _comp long, _sig binary").dropDuplicates(["_key", "_cls"])
    left = materialize(left, "open-buckets")
    again = _tiles(left).join(sets(left.select("_cls").distinct()), "_cls").repartition(*order).sortWithinPartitions(*order, "_role", "_cls")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, order):
            cls, comp = group["_cls"].to_numpy(), group["_comp"].to_numpy().copy()
            among = similar_among(_sets(group["_set"]), percent)
            a, b = [], []
            for x, ok in _close_pairs(group, comp):
                for y in among(x, ok).tolist():
                    if comp[x] != comp[y]:
                        a.append(cls[x])
                        b.append(cls[y])
                        low, high = sorted((comp[x], comp[y]))
                        comp[comp == high] = low
            if a:
                yield arrow_rows({"a": a, "b": b}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return again.select(*order, "_role", "_cls", "_comp", "_sig", "_set").mapInArrow(confirm, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id of its component), kept (the first row with that id),
    and _k1, _k2 by which the row is found again."""
    signed = sign(docs, id_col, text_col, shingle)
    classes = classes_of(signed)
    members = bucket_members(classes)

    def sets(wanted: DataFrame) -> DataFrame:
        return sets_of(docs, materialize(classes.join(wanted, "_cls").select("_cls", "_k1", "_k2"), "wanted"), id_col, text_col, shingle)

    pairs = leader_pairs(members, classes)
    nearest = pairs.groupBy("_cls").agg(F.min(F.struct("_far", "_leader"))["_leader"].alias("_leader"))
    links = materialize(confirm_leaders(nearest, sets, percent), "links")
    # pairs whose sides are not under one leader by these links
    under = links.groupBy(F.col("b").alias("_cls")).agg(F.min("a").alias("_up"))
    side = lambda name: F.coalesce(F.col(name + "_up"), F.col(name))
    rest = pairs.join(under.withColumnRenamed("_up", "_cls_up"), "_cls", "left").join(under.select(F.col("_cls").alias("_leader"), F.col("_up").alias("_leader_up")), "_leader", "left")
    rest = materialize(rest.filter(side("_cls") != side("_leader")).select("_leader", "_cls"), "leader-pairs")
    links = links.union(materialize(confirm_leaders(rest, sets, percent), "links"))
    comps = materialize(components(links), "components")
    more = materialize(cross_links(members, classes, comps, sets, percent), "links")
    comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    known = classes.join(comps.withColumnRenamed("node", "_cls"), "_cls", "left").select("_s1", "_s2", F.coalesce("comp", "_cls").alias("_comp"))
    alone = signed.filter("n_shingles = 0").withColumn("_comp", F.col("_row"))
    rows = signed.filter("n_shingles > 0").join(known, ["_s1", "_s2"]).select(*alone.columns).union(alone)
    rows = materialize(rows.select("_id", "_row", "_k1", "_k2", "n_shingles", "_comp"), "near-rows")
    low = rows.groupBy("_comp").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("o"))
    return rows.join(low, "_comp").select(
        F.col("_id").alias(id_col), "n_shingles", F.col("o._id").alias("component_id"), (F.col("_row") == F.col("o._row")).alias("kept"), "_k1", "_k2")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """One row of each component, with the columns of ``docs``. Rows that surely stay are not shuffled."""
    report = near_dedup(docs, id_col, text_col, shingle, percent)
    gone = materialize(report.filter("not kept").select("_k1", "_k2").distinct(), "near-copies")
    stay = materialize(report.filter("kept").select("_k1", "_k2").distinct(), "near-kept")
    i, t = F.col(id_col), F.col(text_col)
    keyed = docs.withColumn("_k1", F.xxhash64(i, t)).withColumn("_k2", F.xxhash64(t, F.lit(7), i))
    marked = mark_listed(keyed, gone, "_k1")
    maybe = marked.filter("_maybe").drop("_maybe")
    # a row that stays may share id and text with rows that go: one of them is taken
    twins = gone.join(stay, ["_k1", "_k2"], "left_semi")
    single = maybe.join(gone, ["_k1", "_k2"], "left_anti")
    row = F.struct(*docs.columns)
    taken = maybe.join(twins, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.max_by(row, F.xxhash64(*docs.columns)).alias("o")).select("o.*")
    return marked.filter("not _maybe").select(*docs.columns).unionByName(single.select(*docs.columns)).unionByName(taken)
