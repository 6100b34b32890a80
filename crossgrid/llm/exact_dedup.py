"""Exact deduplication in two passes with a Bloom filter, on built-in functions only.

Pass 1 counts short signatures of the text hashes (a word of the filter and three bits in it) and sets, in a filter of
fixed size, the bits of every signature counted twice or more. Pass 2 tests each row against that filter. A row whose
bits are not all set has no equal and goes straight through; only the others are shuffled and compared by SHA-256.
A false positive of the filter costs a shuffled row and never changes a result.

Null text counts as empty. Null ids rank below all others. Rows that share text and id are told apart by an internal
row number, so exactly one row of a group stays. Empty tables give empty results; other columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crossgrid.llm.common import with_row
from crossgrid.session import materialize

#: 64-bit words of the filter. The broadcast side has at most this many rows of two longs: 16 MB.
FILTER_WORDS = 1 << 20


def _word(h: Column, filter_words: int) -> Column:
    return F.pmod(h, F.lit(filter_words)).cast("int")


def _mask(h: Column) -> Column:
    bit = [F.expr("1L").cast("long")] * 3
    parts = [F.call_function("shiftleft", b, F.pmod(F.shiftrightunsigned(h, s), F.lit(64)).cast("int")) for b, s in zip(bit, (24, 34, 44), strict=True)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def repeat_filter(hashed: DataFrame, hash_col: str, filter_words: int = FILTER_WORDS) -> DataFrame:
    """Pass 1: ``_word``, ``_bits`` of the filter that holds every hash which may occur twice; at most ``filter_words`` rows."""
    h = F.col(hash_col)
    return (
        hashed.groupBy(_word(h, filter_words).alias("_word"), _mask(h).alias("_mask")).count()
        .filter("count > 1").groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    )


def mark_repeats(rows: DataFrame, repeats: DataFrame, hash_col: str, filter_words: int = FILTER_WORDS) -> DataFrame:
    """Pass 2: add ``_maybe``, false where the hash surely occurs once. No shuffle: the filter's size is bounded."""
    h = F.col(hash_col)
    return (
        rows.withColumn("_word", _word(h, filter_words)).join(F.broadcast(repeats), "_word", "left")
        .withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(_mask(h)) == _mask(h), F.lit(False)))
        .drop("_word", "_bits")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_words: int = FILTER_WORDS) -> DataFrame:
    """Report for every row: ``id_col``, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays.

    The texts are read once; hashes and ids are written to the shared folder and both passes read those."""
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    hashed = materialize(
        with_row(docs.select(F.col(id_col).alias("_id"), sha.alias("text_sha256"))).withColumn("_hash", F.xxhash64("text_sha256")),
        "text-hashes",
    )
    marked = mark_repeats(hashed, repeat_filter(hashed, "_hash", filter_words), "_hash", filter_words)
    once = marked.filter(~F.col("_maybe")).select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    maybe = marked.filter("_maybe").select("_id", "_row", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(
        F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size")
    )
    # one row a group, written apart: the join below then has exchanges of its own, and adaptive execution can split the
    # rows of a hot group among tasks
    groups = materialize(groups.filter("group_size > 1"), "text-groups")
    compared = maybe.join(groups, "text_sha256", "left").select(
        F.col("_id").alias(id_col), F.when(F.col("_keep").isNull(), F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("_keep").isNull() | (F.col("_row") == F.col("_keep._row"))).alias("kept"), "text_sha256",
    )
    return once.unionByName(compared)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_words: int = FILTER_WORDS) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; rows without a possible equal are never shuffled."""
    columns = docs.columns
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    rows = docs.withColumn("_sha", sha).withColumn("_hash", F.xxhash64("_sha"))
    marked = mark_repeats(rows, repeat_filter(rows.select("_hash"), "_hash", filter_words), "_hash", filter_words)
    once = marked.filter(~F.col("_maybe")).select(*columns)
    row = F.struct(*columns)
    best = (
        marked.filter("_maybe").groupBy("_sha")
        .agg(F.max_by(row, F.struct(F.col(id_col), F.xxhash64(*columns))).alias("_row")).select("_row.*")
    )
    return once.unionByName(best)


def mark_listed(rows: DataFrame, listed: DataFrame, hash_col: str, filter_words: int = FILTER_WORDS) -> DataFrame:
    """Add ``_maybe``: false where ``hash_col`` is surely not in ``listed`` (same column); the filter has a fixed size."""
    h = F.col(hash_col)
    bits = listed.groupBy(_word(h, filter_words).alias("_word")).agg(F.bit_or(_mask(h)).alias("_bits"))
    return mark_repeats(rows, bits, hash_col, filter_words)
