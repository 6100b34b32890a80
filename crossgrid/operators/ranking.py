"""Ranks, samples and keep-one-per-key operators that hold up under hot keys.

A window over one hot key would sort all its rows in one task. Here the rows of a key are
split by the leading hex digits of a hash (which is also the sort key), ranked inside each
piece, and shifted by the number of rows in the earlier pieces. The result is exactly
``row_number() over (partition by key order by hash)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crossgrid.session import attach_params


def hashed_rank(df: DataFrame, group: list[str], order: str, name: str, prefix: int = 3) -> DataFrame:
    """1-based rank of each row by hex text ``order`` within ``group``.

    ``order`` must be unique within a group. Each window partition holds about
    1 / 16**prefix of a group.
    """
    pieces = df.withColumn("_piece", F.substring(F.col(order), 1, prefix))
    keys = [*group, "_piece"]
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    local = pieces.withColumn("_local", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    joined = local.join(offsets, keys)
    return joined.withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop(
        "_piece", "_local", "_before"
    )


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep the row with the smallest ``order`` per key (a map-side combined aggregate)."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*key, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep the row with the largest ``order`` per key: the last writer wins."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*key, "_row.*").select(*df.columns)


def sample_per_group(df: DataFrame, group: list[str], order: str, n: int, prefix: int = 3) -> DataFrame:
    """At most ``n`` rows per group, the first ones by hex text ``order``.

    Two steps: the first ``n`` of every hash piece, then the first ``n`` of what is left
    (at most ``n * 16**prefix`` rows per group).
    """
    pieces = df.withColumn("_piece", F.substring(F.col(order), 1, prefix))
    w1 = W.partitionBy(*group, "_piece").orderBy(order)
    w2 = W.partitionBy(*group).orderBy(order)
    return (
        pieces.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= n)
        .drop("_r", "_piece")
    )


def worst_n(df: DataFrame, value: str, tiebreak: list[str], n: int | None) -> DataFrame:
    """The ``n`` rows with the lowest value, or all rows in that order."""
    ordered = df.orderBy(F.col(value).asc_nulls_last(), *tiebreak)
    return ordered if n is None else ordered.limit(n)


def shortest_root(df: DataFrame, name: str) -> DataFrame:
    """The shortest name, if every other name extends it by ``_``; NULL otherwise."""
    root = df.agg(F.min_by(F.col(name), F.struct(F.length(name), F.col(name))).alias("root"))
    extends = (F.col(name) == F.col("root")) | F.col(name).startswith(F.concat("root", F.lit("_")))
    return (
        attach_params(df, root)
        .agg(F.first("root").alias("root"), F.bool_and(extends).alias("consistent"),
             F.count(F.lit(1)).alias("n_names"))
        .select(F.when(F.col("consistent"), F.col("root")).alias("root"), "consistent", "n_names")
    )


def latest_version(df: DataFrame, key: list[str], name: str, pattern: str) -> DataFrame:
    """Highest parsed number and its name per key, and the lowest unused number from 1."""
    parsed = df.withColumn("_v", F.regexp_extract(name, pattern, 1).try_cast("int")).filter(
        F.col("_v").isNotNull()
    )
    versions = parsed.groupBy(*key, "_v").agg(F.max(name).alias("_name"))
    # lead of the distinct versions: a version whose successor is missing opens a gap
    latest = versions.groupBy(*key).agg(
        F.max("_v").alias("latest"),
        F.max_by("_name", "_v").alias("latest_name"),
        F.min("_v").alias("_first"),
    )
    ends = (
        versions.join(
            versions.select(*key, (F.col("_v") - 1).alias("_v")), [*key, "_v"], "left_anti"
        )
        .filter(F.col("_v") >= 1)
        .groupBy(*key).agg(F.min("_v").alias("_end"))
    )
    has_one = versions.filter(F.col("_v") == 1).select(*key, F.lit(True).alias("_one"))
    return (
        latest.join(ends, key, "left").join(has_one, key, "left")
        .select(
            *key, "latest", "latest_name",
            F.when(F.col("_one"), F.col("_end") + 1).otherwise(F.lit(1)).alias("next_free"),
        )
    )
