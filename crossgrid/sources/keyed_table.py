"""A table to which rows are added once per key, with a persistent key index.

Layout below ``path``: ``data/<commit>`` rows by key bucket, ``index/<commit>`` key filters, ``commits/commit=<n>`` one row for
each commit, written last. Only what a commit row names counts, so a run that dies earlier leaves nothing that is read; the
same batch offered again is added then. There is one writer at a time: a second one fails on its commit row.

The index holds blocked Bloom filters: a key sets BITS bits of one 64-bit word, and 64 words of a bucket are a row. A filter
is made for a number of keys; once it holds them, it stays as it is and the next one, twice as large, takes over. A batch
reads the rows of the index, whose number doesn't grow with the batches, and of the table only the buckets in which a key
of the batch may be, according to the index.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossgrid.session import materialize

#: Bits that a key sets, keys for which 64 words of a filter are made (20 bits a key).
BITS, ROW_KEYS = 4, 64 * 64 // 20
BUCKET, HASH = "_bucket", "_key_hash"
_COMMIT = "commit long, data string, n long, filters array<struct<size: long, keys: long, folder: string>>"


@dataclass
class Appended:
    """Rows offered (one a key), rows whose key the index may hold, rows added."""

    offered: int
    maybe: int
    added: int


def _place(size: int) -> list[Column]:
    """Row and word of a key in a filter of ``size`` rows a bucket, and the bits it sets."""
    h = F.xxhash64(F.lit(1), HASH)  # apart from the bits that choose the bucket
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", h, F.lit(6 * k)).bitwiseAND(63).cast("int")))
    other = F.xxhash64(F.lit(2), HASH)
    return [F.pmod(other, F.lit(size)).alias("_row"), F.call_function("shiftrightunsigned", other, F.lit(58)).cast("int").alias("_word"), mask.alias("_mask")]


class KeyedTable:
    """Rows of unique ``key``; every use of one table names the same key and number of buckets."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def commits(self) -> list:
        """The commit rows in order."""
        try:
            rows = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(rows, key=lambda r: r.commit)

    def read(self) -> DataFrame | None:
        """All rows that were committed; None before the first commit."""
        rows = self._rows(self.commits())
        return None if rows is None else rows.drop(BUCKET, HASH)

    def _rows(self, commits: list) -> DataFrame | None:
        folders = [f"{self.path}/data/{c.data}" for c in commits]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*folders).drop("commit") if folders else None

    def _held(self, filters: list) -> DataFrame | None:
        """Rows of the index: (size, bucket, row, words)."""
        parts = [self.spark.read.parquet(f"{self.path}/index/{f.folder}").filter(F.col("size") == f.size) for f in filters]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def append(self, fresh: DataFrame) -> Appended:
        """Add the rows whose key the table does not hold, one for each key."""
        commits = self.commits()
        last = commits[-1] if commits else None
        filters = list(last.filters) if last else []
        hashed = fresh.dropDuplicates(self.key).withColumn(HASH, F.xxhash64(*self.key))
        rows = materialize(hashed.withColumn(BUCKET, F.pmod(HASH, F.lit(self.buckets)).cast("int")), "offered")
        offered, maybe = rows.count(), 0
        added = rows
        if filters and offered:
            marked = materialize(self._marked(rows, filters), "marked")
            seen = marked.filter("_maybe").drop("_maybe")
            touched = [r[0] for r in seen.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
            maybe = seen.count() if touched else 0
            added = marked.filter("not _maybe").drop("_maybe")
            if touched:
                there = self._rows(commits).filter(F.col(BUCKET).isin(touched)).select(*self.key)
                same = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in self.key]
                added = added.unionByName(seen.alias("s").join(there.alias("t"), same, "left_anti"))
            added = materialize(added, "added")
        n = added.count()
        number, folder = (last.commit + 1 if last else 0), f"commit={uuid.uuid4().hex}"
        if not n:
            return Appended(offered, maybe, 0)
        added.repartition(BUCKET).sortWithinPartitions(BUCKET, HASH).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        filters = self._write_index(added, n, filters, folder)
        self._commit(number, folder, n, filters)
        return Appended(offered, maybe, n)

    def _commit(self, number: int, folder: str, n: int, filters: list[tuple]) -> None:
        row = self.spark.createDataFrame([(number, folder, n, filters)], _COMMIT).drop("commit")
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/commit={number}")

    def _marked(self, rows: DataFrame, filters: list) -> DataFrame:
        """The rows with ``_maybe``: some filter holds all bits of the key."""
        held = self._held(filters)
        out = rows.withColumn("_maybe", F.lit(False))
        for f in filters:
            place = _place(f.size)
            words = held.filter(F.col("size") == f.size).select(BUCKET, F.col("row").alias("_row"), "words")
            out = out.select("*", *place).join(words, [BUCKET, "_row"], "left")
            hit = F.coalesce(F.get("words", "_word").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
            out = out.withColumn("_maybe", F.col("_maybe") | hit).drop("_row", "_word", "_mask", "words")
        return out.select(*rows.columns, "_maybe")

    def _write_index(self, added: DataFrame, n: int, filters: list, folder: str) -> list[tuple]:
        """Put the keys into the newest filter, or into a new one if that is full."""
        done = [(f.size, f.keys, f.folder) for f in filters]
        size, keys, at = done[-1] if done else (0, 0, "")
        room = size * self.buckets * ROW_KEYS
        if keys + n > room:
            least = -(-4 * n // (self.buckets * ROW_KEYS))  # as large a batch fits three times more
            size, keys, at = max(2 * size, least, 1), 0, ""
            done.append((size, 0, ""))
        bits = added.select(BUCKET, *_place(size)).groupBy(BUCKET, "_row", "_word").agg(F.bit_or("_mask").alias("_mask"))
        pairs = bits.groupBy(BUCKET, "_row").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_mask"))).alias("_m"))  # 64 at most
        words = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long")))
        out = pairs.select(F.lit(size).cast("long").alias("size"), F.col(BUCKET), F.col("_row").alias("row"), words.alias("words"))
        if at:
            old = self.spark.read.parquet(f"{self.path}/index/{at}").filter(F.col("size") == size)
            both = old.select("size", BUCKET, "row", F.col("words").alias("_old")).join(out, ["size", BUCKET, "row"], "full")
            merged = F.when(F.col("_old").isNull(), F.col("words")).when(F.col("words").isNull(), F.col("_old")).otherwise(
                F.zip_with("_old", "words", lambda a, b: a.bitwiseOR(b)))
            out = both.select("size", BUCKET, "row", merged.alias("words"))
        out.write.parquet(f"{self.path}/index/{folder}")
        done[-1] = (size, keys + n, folder)
        return done
