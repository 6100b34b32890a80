"""Feature importance of a scorer over evaluation cells.

A scorer is any function from {feature: Column} to a Column: a built-in expression, or a
pandas UDF for a real model.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crossgrid.functions import hashing as H, metrics as M
from crossgrid.operators.resample import permute_units, summarize_null
from crossgrid.session import small_side

Scorer = Callable[[dict[str, Column]], Column]

# Quarters of the growing season where the caller names none.
GROWING_QUARTERS = (2, 3)


def _metric_structs(method: str, label: str, base: str, sets: dict[str, tuple], preds: dict[str, str]) -> Column:
    """Array of one struct per feature set: base and perturbed metrics of an aggregate."""
    entries = []
    for name, cols in sets.items():
        p = preds[name]
        entries.append(F.struct(
            F.lit(method if len(cols) == 1 or method == "mean_ablation" else f"group_{method}").alias("method"),
            F.lit("band" if len(cols) == 1 else "group").alias("unit"), F.lit(name).alias("feature"),
            M.r2(label, base).alias("r2_base"), M.r2(label, p).alias("r2_pert"),
            M.mae(label, base).alias("mae_base"), M.mae(label, p).alias("mae_pert"),
            M.pearson(label, base).alias("r_base"), M.pearson(label, p).alias("r_pert"),
            F.count(F.lit(1)).alias("n_test")))
    return F.array(*entries)


def _deltas(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.explode("_m").alias("_m")).select(*keys, "_m.*").withColumns({
        "delta_r2": F.col("r2_base") - F.col("r2_pert"), "delta_mae": F.col("mae_pert") - F.col("mae_base")})


#: Rows of a cell that are sorted together.
PIECE = 65536


def _resolves(df: DataFrame, column: Column) -> bool:
    try:
        df.select(column)
    except AnalysisException:
        return False
    return True


def _cut(df: DataFrame, order: Column) -> DataFrame:
    """``_hi``, ``_lo``: the first 76 bits of hex text ``order``; ``_piece``: which of a cell's ``_b`` pieces of that order a row is in."""
    hi = F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")
    piece = F.least(F.floor(F.col("_hi") / F.lit(float(1 << 60)) * F.col("_b")), F.col("_b") - 1)
    return df.withColumn("_h", order).withColumns({"_hi": hi, "_lo": F.conv(F.substring("_h", 16, 4), 16, 10).cast("int")}).withColumn("_piece", piece)


def _stretches(counts: DataFrame, group: list[str]) -> DataFrame:
    """Places ``_low`` to ``_high`` of each piece of a group, one row per block of ``PIECE`` places that they touch."""
    high = F.sum("_n").over(W.partitionBy(*group).orderBy("_piece"))
    placed = counts.withColumn("_high", high).withColumn("_low", F.col("_high") - F.col("_n"))
    return placed.select(*group, "_piece", "_low", "_high", F.explode(F.sequence(F.floor(F.col("_low") / PIECE), F.floor((F.col("_high") - 1) / PIECE))).alias("_block"))


def _in_order(rows: pa.Table) -> pa.Array:
    return pa.array(np.lexsort((rows["_lo"].to_numpy(), rows["_hi"].to_numpy())))


def _packed(columns: list[str]):
    """A piece as one row: its columns in hash order as lists."""
    def pack(rows: pa.Table) -> pa.Table:
        n, order = len(rows), _in_order(rows)
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(rows[c].take(order).chunks)) for c in columns]
        return pa.table([rows["_c"].slice(0, 1), rows["_piece"].slice(0, 1), *lists], names=["_c", "_piece", *columns])

    return pack


def _received(kept: list[str], moved: list[str]):
    """The rows of a piece in their order, beside what was sent to their places."""
    def receive(rows: pa.Table, sent: pa.Table) -> pa.Table:
        mine = rows.take(_in_order(rows))
        by_place = sent.take(pa.array(np.argsort(sent["_at"].to_numpy())))
        return pa.table([mine[c] for c in ["_c", "repeat", *kept]] + [pc.list_flatten(by_place[c]) for c in moved],
                        names=["_c", "repeat", *kept, *[f"_p_{c}" for c in moved]])

    return receive


def permutation_importance(df: DataFrame, cell: list[str], row_key: list[str], label: str, features: list[str],
                           sets: dict[str, tuple], scorer: Scorer, n_repeats: int = 5, seed: int = 0) -> DataFrame:
    """Drop in accuracy when a feature (or a group, moved together) is shuffled within its cell.

    The row at place r of the repeat's hash order receives the features of the row at place r of a fixed hash order. A cell
    is cut into pieces of about ``PIECE`` rows by the leading part of the hash. The fixed order is sorted once, and each piece
    of a repeat is sent the stretches of it that stand at its places, so the rows of a repeat move once. Only features that
    the scorer reads move at all. Cells with a null take no part.
    """
    real = {f: F.col(f) for f in features}
    used = [f for f in features if not _resolves(df.drop(f), scorer(real))]
    moved = [f for f in used if any(f in cols for cols in sets.values())]
    rows = df.select(*cell, *used, label, *row_key)
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).dropna(subset=cell)
    # one row a cell
    cells = small_side(cells.select(*cell, F.ceil(F.col("_n") / PIECE).alias("_b"), F.row_number().over(W.orderBy(*cell)).alias("_c")), "cells")
    # the text of a row's key is made once; null if all of it is null, so that it is left out of the hash
    text = F.when(F.coalesce(*[F.col(k).cast("string") for k in row_key]).isNotNull(), F.concat_ws(":", *[F.col(k).cast("string") for k in row_key]))
    numbered = rows.join(cells, cell).select("_c", "_b", label, *used, text.alias("_text"))
    kinds = {f: rows.schema[f].dataType.simpleString() for f in [*used, label]}

    def fanned(first: int) -> DataFrame:
        """Repeats from ``first``; -1 is the fixed order."""
        repeats = numbered.withColumn("repeat", F.explode(F.sequence(F.lit(first), F.lit(n_repeats - 1))))
        return _cut(repeats, F.md5(F.concat_ws(":", F.when(F.col("repeat") < 0, "src").otherwise(F.concat(F.lit(f"{seed}:"), "repeat")), "_text")))

    counts = small_side(fanned(-1).groupBy("_c", "repeat", "_piece").agg(F.count(F.lit(1)).alias("_n")), "pieces")
    source = _cut(numbered, H.hash_order(F.lit("src"), "_text")).select("_c", "_piece", "_hi", "_lo", *moved)
    packed = source.groupBy("_c", "_piece").applyInArrow(_packed(moved), ", ".join(["_c int", "_piece long", *[f"`{f}` array<{kinds[f]}>" for f in moved]]))
    placed = fanned(0).select("_c", "repeat", "_piece", "_hi", "_lo", label, *used)
    asked = _stretches(counts.filter("repeat >= 0"), ["_c", "repeat"]).alias("a").join(_stretches(counts.filter("repeat < 0"), ["_c"]).alias("s"), ["_c", "_block"])
    low, high = F.greatest("a._low", "s._low"), F.least("a._high", "s._high")
    # two stretches may share several blocks: the first counts
    met = asked.filter((low < high) & (F.floor(low / PIECE) == F.col("_block"))).select(
        "_c", "repeat", F.col("a._piece").alias("_to"), F.col("s._piece").alias("_piece"), low.alias("_at"), (low - F.col("s._low")).alias("_skip"), (high - low).alias("_len"))
    sent = packed.join(small_side(met, "stretches"), ["_c", "_piece"]).select(
        "_c", "repeat", F.col("_to").alias("_piece"), "_at", *[F.slice(f, (F.col("_skip") + 1).cast("int"), F.col("_len").cast("int")).alias(f) for f in moved])
    keys = ["_c", "repeat", "_piece"]
    shown = ["_c int", "repeat int", *[f"`{f}` {kinds[f]}" for f in [label, *used]], *[f"`_p_{f}` {kinds[f]}" for f in moved]]
    joined = placed.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_received([label, *used], moved), ", ".join(shown))
    # a set that the scorer doesn't read changes no prediction
    preds = {name: scorer({**real, **{c: F.col(f"_p_{c}") for c in cols if c in moved}}) for name, cols in sets.items() if set(cols) & set(moved)}
    scored = joined.select("_c", "repeat", label, scorer(real).alias("_base"), *[p.alias(f"_s{i}") for i, p in enumerate(preds.values())])
    names = dict.fromkeys(sets, "_base") | {name: f"_s{i}" for i, name in enumerate(preds)}
    agg = scored.groupBy("_c", "repeat").agg(_metric_structs("permutation", label, "_base", sets, names).alias("_m"))
    return _deltas(agg.join(cells, "_c"), [*cell, "repeat"])


def mean_ablation(df: DataFrame, cell: list[str], label: str, features: list[str], sets: dict[str, tuple], scorer: Scorer) -> DataFrame:
    """Drop in accuracy when a feature takes its cell mean. Means are aggregated and joined back."""
    means = df.groupBy(*cell).agg(*[F.avg(f).alias(f"_p_{f}") for f in features])
    joined = df.select(*cell, *features, label).join(means, cell)
    real = {f: F.col(f) for f in features}
    preds = {name: scorer({**real, **{c: F.col(f"_p_{c}") for c in cols}}) for name, cols in sets.items()}
    scored = joined.select(*cell, label, scorer(real).alias("_base"), *[p.alias(f"_s{i}") for i, p in enumerate(preds.values())])
    names = {name: f"_s{i}" for i, name in enumerate(preds)}
    agg = scored.groupBy(*cell).agg(_metric_structs("mean_ablation", label, "_base", sets, names).alias("_m"))
    return _deltas(agg.withColumn("repeat", F.lit(0)), [*cell, "repeat"])


def importance_summary(panel: DataFrame, cell: list[str]) -> DataFrame:
    """Mean and sample std over repeats, and the share of the positive total within a cell."""
    keys = [*cell, "method", "unit", "feature"]
    out = panel.groupBy(*keys).agg(
        F.avg("delta_r2").alias("delta_r2_mean"), F.stddev_samp("delta_r2").alias("delta_r2_std"),
        F.avg("delta_mae").alias("delta_mae_mean"), F.stddev_samp("delta_mae").alias("delta_mae_std"),
        F.min("r2_base").alias("r2_base"), F.min("mae_base").alias("mae_base"), F.min("r_base").alias("r_base"),
        F.min("n_test").alias("n_test"), F.count_distinct("repeat").alias("n_repeats"))
    # a window over the features of one cell
    positive = F.sum(F.greatest("delta_r2_mean", F.lit(0.0))).over(W.partitionBy(*cell, "method", "unit"))
    return out.withColumn("normalized_importance", F.when(positive > 0, F.col("delta_r2_mean") / positive))


def growing_gap(panel: DataFrame, value: str, growing=GROWING_QUARTERS, n_perms: int = 999, seed: int = 0) -> DataFrame:
    """Mean importance in growing-season cells minus the rest, per feature, with a permutation p.

    Season labels are permuted over the (year, quarter) cells.
    """
    units = panel.select("year", "quarter").distinct().withColumn("growing", F.col("quarter").isin(*growing).cast("int"))
    perms = permute_units(units, ["year", "quarter"], "growing", n_perms, seed)
    # features x periods x permutations rows
    per_cell = panel.groupBy("feature", "year", "quarter").agg(F.avg(value).alias("_v"))
    joined = per_cell.join(perms, ["year", "quarter"])
    stat = joined.groupBy("feature", "perm").agg((
        F.avg(F.when(F.col("growing") == 1, F.col("_v"))) - F.avg(F.when(F.col("growing") == 0, F.col("_v")))).alias("gap"))
    return summarize_null(stat, "gap", ["feature"])
