"""Permutation tests.

A permutation reorders *units* (periods, models), never rows: units x permutations is small
and known in advance. Order ``i`` of a unit is ``md5("seed:i:unit")``, so every engine and
every retry sees the same permutation. Permutation 0 is the identity and gives the observed
statistic in the same pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from crossgrid.functions import hashing as H, metrics as M
from crossgrid.operators.accuracy import CELL_KEY
from crossgrid.operators.regress import moment_rows, unpack
from crossgrid.session import attach_params, materialize, small_side


def permute_units(units: DataFrame, key: list[str], value: str, n_perms: int, seed: int = 0,
                  within: list[str] | None = None) -> DataFrame:
    """(perm, within..., key..., value): the values dealt out anew to the units of each stratum.

    The units are written when this is called, so Spark knows their size and chooses the join.
    """
    within = list(within or [])
    own = [k for k in key if k not in within]
    base = materialize(units.select(
        *within, *own, value,
        F.row_number().over(W.partitionBy(*within).orderBy(*key)).alias("_natural")), "units")
    fanned = base.drop(value).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perms))))
    drawn = W.partitionBy("perm", *within).orderBy(H.hash_order(F.lit(seed), "perm", *key))
    place = F.when(F.col("perm") == 0, F.col("_natural")).otherwise(F.row_number().over(drawn))
    dealt = base.select(*within, F.col("_natural").alias("_place"), value)
    return fanned.withColumn("_place", place).join(dealt, [*within, "_place"]).select("perm", *within, *own, value)


def summarize_null(stats: DataFrame, value: str, by: list[str] | None = None, two_sided: bool = False,
                   plus_one: bool = True, digits: int = 10) -> DataFrame:
    """Observed value (perm 0) against the null values (perm > 0).

    The list that is compared holds one number per permutation. Rounding to ``digits`` keeps
    ties between equal statistics ties in any summation order.
    """
    v = F.round(F.col(value), digits)
    null = F.when(F.col("perm") > 0, v)
    packed = stats.groupBy(*(by or [])).agg(
        F.max(F.when(F.col("perm") == 0, v)).alias("observed"),
        F.collect_list(null).alias("_null"),
        F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_std"),
        F.percentile(null, 0.95).alias("null_95pct"), F.count(null).cast("int").alias("n_perms"),
    )
    if two_sided:
        hits = F.size(F.filter("_null", lambda x: F.abs(x) >= F.abs(F.col("observed"))))
    else:
        hits = F.size(F.filter("_null", lambda x: x >= F.col("observed")))
    one = 1 if plus_one else 0
    p = F.when(F.col("observed").isNotNull(), F.try_divide(
        (hits + one).cast("double"), (F.col("n_perms") + one).cast("double")))
    return packed.withColumn("p_value", p).drop("_null")


def _side(perms: DataFrame, prefix: str, value: str, extra: list[str] | None = None) -> DataFrame:
    return perms.select("perm", *(extra or []), F.col("year").alias(f"{prefix}_year"),
                        F.col("quarter").alias(f"{prefix}_quarter"), F.col(value).alias(f"_{prefix}"))


def _fan_out(df: DataFrame, n_perms: int) -> DataFrame:
    return df.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perms))))


def cell_units(cells: DataFrame) -> DataFrame:
    """Every (year, quarter) that occurs on either side of a cell."""
    return cells.select(F.explode(F.array(
        F.struct(F.col("model_year").alias("year"), F.col("model_quarter").alias("quarter")),
        F.struct(F.col("eval_year").alias("year"), F.col("eval_quarter").alias("quarter")),
    )).alias("_u")).select("_u.*").distinct()


def season_gap_test(cells: DataFrame, value: str, n_perms: int = 999, seed: int = 0) -> DataFrame:
    """Same season, other year minus other season, same year; season labels are shuffled."""
    units = cell_units(cells).withColumn("season", F.col("quarter"))
    perms = permute_units(units, ["year", "quarter"], "season", n_perms, seed)
    fanned = _fan_out(cells.select(*CELL_KEY, value), n_perms)
    for prefix in ("model", "eval"):
        fanned = fanned.join(_side(perms, prefix, "season"), ["perm", f"{prefix}_year", f"{prefix}_quarter"])
    same_season = F.col("_model") == F.col("_eval")
    same_year = F.col("model_year") == F.col("eval_year")
    gaps = fanned.groupBy("perm").agg((
        F.avg(F.when(same_season & ~same_year, F.col(value)))
        - F.avg(F.when(~same_season & same_year, F.col(value)))
    ).alias("gap"))
    out = summarize_null(gaps, "gap", two_sided=True)
    return out.withColumnRenamed("observed", "observed_gap")


def two_var_r2(y: str, a: str, b: str):
    """R2 of y ~ 1 + a + b from centred moments, as one aggregate expression."""
    return F.expr(f"""try_divide(
        covar_pop({a}, {y}) * covar_pop({a}, {y}) * var_pop({b})
          - 2 * covar_pop({a}, {y}) * covar_pop({b}, {y}) * covar_pop({a}, {b})
          + covar_pop({b}, {y}) * covar_pop({b}, {y}) * var_pop({a}),
        (var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) * covar_pop({a}, {b})) * var_pop({y}))""")


def gap_r2_test(cells: DataFrame, period_metrics: DataFrame, value: str, n_perms: int = 999,
                seed: int = 0, min_cells: int = 6) -> DataFrame:
    """R2 of value ~ diff + abs diff per metric, when metric values move between periods.

    ``period_metrics`` is long: (metric, year, quarter, mean).
    """
    known = period_metrics.filter(F.col("mean").isNotNull())
    perms = permute_units(known, ["year", "quarter"], "mean", n_perms, seed, within=["metric"])
    model = _side(perms, "model", "mean", ["metric"])
    ev = _side(perms, "eval", "mean", ["metric"])
    fanned = (
        _fan_out(cells.filter(F.col(value).isNotNull()).select(*CELL_KEY, value), n_perms)
        .join(model, ["perm", "model_year", "model_quarter"])
        .join(ev, ["perm", "metric", "eval_year", "eval_quarter"])
        .withColumn("_d", F.col("_eval") - F.col("_model")).withColumn("_a", F.abs("_d"))
    )
    stats = fanned.groupBy("metric", "perm").agg(
        two_var_r2(value, "_d", "_a").alias("r2"), F.count(F.lit(1)).alias("n"))
    n_units = known.groupBy("metric").agg(F.count(F.lit(1)).cast("int").alias("n_quarters_permuted"))
    n_obs = stats.filter("perm = 0").select("metric", F.col("n").alias("n_obs"))
    return (
        summarize_null(stats, "r2", ["metric"]).withColumnsRenamed(
            {"observed": "observed_r2", "null_mean": "null_r2_mean", "null_95pct": "null_r2_95pct"})
        .join(n_obs, "metric").join(n_units, "metric").filter(F.col("n_obs") >= min_cells)
        .drop("null_std")
    )


def sequential_test(gaps: DataFrame, periods: DataFrame, value: str, quality: list[str], dummies: str,
                    metric: str, n_perms: int = 999, seed: int = 0) -> DataFrame:
    """R2 that a metric's gaps add to value ~ quality + dummies, when years are dealt anew per quarter.

    ``gaps`` is a written cell table, ``periods`` has one row per (year, quarter). The controls
    do not depend on the permutation: they are cleared of the dummies and made orthonormal once,
    so a permutation only needs sums of its own two columns against them.
    """
    k = len(quality)
    clean = gaps.dropna(subset=[value, *quality, dummies])
    fitted = moment_rows(clean, value, quality, within=dummies)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                s = unpack(row.cross, k + 1)
                # columns q of the controls become orthonormal columns q @ basis
                values, vectors = np.linalg.eigh(s[1:, 1:])
                good = values > 1e-12 * max(values.max(), 1e-300)
                basis = np.where(good, vectors / np.sqrt(np.where(good, values, 1.0)), 0.0)
                b = basis @ (basis.T @ s[1:, 0])
                out.append((basis.T.ravel().tolist(), b.tolist(), float(row.sst), int(row.n)))
            yield pd.DataFrame(out, columns=["_w", "_b", "_sst", "n_obs"])

    fit = fitted.mapInPandas(solve, "_w ARRAY<DOUBLE>, _b ARRAY<DOUBLE>, _sst DOUBLE, n_obs BIGINT")
    means = clean.groupBy(dummies).agg(*[F.avg(c).alias(f"_m_{c}") for c in (value, *quality)])
    level = attach_params(clean.join(small_side(means, "levels"), dummies), fit)
    left = f"({value} - _m_{value})" + "".join(f" - _b[{i}] * ({c} - _m_{c})" for i, c in enumerate(quality))
    controls = [
        " + ".join(f"_w[{j * k + i}] * ({c} - _m_{c})" for i, c in enumerate(quality)) + f" AS _q{j}" for j in range(k)
    ]
    base = level.selectExpr(*CELL_KEY, dummies, f"{left} AS _y", *controls)

    units = periods.select("year", "quarter", F.col(metric).alias("_val")).filter(F.col("_val").isNotNull())
    perms = permute_units(units, ["year", "quarter"], "_val", n_perms, seed, within=["quarter"])
    fanned = _fan_out(base, n_perms)
    for prefix in ("model", "eval"):
        fanned = fanned.join(_side(perms, prefix, "_val"), ["perm", f"{prefix}_year", f"{prefix}_quarter"])
    fanned = fanned.withColumn("_d", F.col("_eval") - F.col("_model")).withColumn("_a", F.abs("_d"))
    # _y and _q have mean 0 in every level, so only the squares of _d and _a need centring
    sums = [f"sum({u} * {v}) AS {u[1:]}{v[1:]}" for u in ("_d", "_a") for v in ("_y", *[f"_q{j}" for j in range(k)])]
    per_level = fanned.groupBy("perm", dummies).agg(*[F.expr(e) for e in (
        *sums, "count(1) * var_pop(_d) AS dd", "count(1) * var_pop(_a) AS aa", "count(1) * covar_pop(_d, _a) AS da")])
    names = [f"{u}{v}" for u in "da" for v in ("y", *[f"q{j}" for j in range(k)])] + ["dd", "aa", "da"]
    total = per_level.groupBy("perm").agg(*[F.sum(n).alias(n) for n in names])

    def cleared(u: str, v: str) -> str:
        return f"({u}{v} - (" + " + ".join(f"{u}q{j} * {v}q{j}" for j in range(k)) + "))"

    s11, s22, s12 = cleared("d", "d"), cleared("a", "a"), cleared("d", "a")
    explained = f"try_divide(dy * dy * {s22} - 2 * dy * ay * {s12} + ay * ay * {s11}, {s11} * {s22} - {s12} * {s12})"
    scored = attach_params(total, fit.select("_sst", "n_obs")).selectExpr("perm", f"try_divide({explained}, _sst) AS added")
    out = attach_params(summarize_null(scored, "added"), fit.select("n_obs"))
    return out.select(F.col("observed").alias("observed_r2_added"), "null_mean", "null_95pct", "p_value", "n_obs", "n_perms")


def label_gap_test(pairs: DataFrame, units: DataFrame, unit: list[str], label: str, value: str,
                   n_perms: int = 999, seed: int = 0, plus_one: bool = True) -> DataFrame:
    """Mean similarity of pairs that share a label minus that of pairs that do not.

    ``pairs`` has ``a_<unit>`` and ``b_<unit>`` columns. Labels are permuted over the units.
    """
    label_col = "_label"
    perms = permute_units(units.withColumn(label_col, F.col(label)).select(*unit, label_col),
                          unit, label_col, n_perms, seed)
    fanned = _fan_out(pairs, n_perms)
    for side in ("a", "b"):
        m = perms.select("perm", *[F.col(u).alias(f"{side}_{u}") for u in unit],
                         F.col(label_col).alias(f"_{side}"))
        fanned = fanned.join(m, ["perm", *[f"{side}_{u}" for u in unit]])
    same = F.when(F.col("_a") == F.col("_b"), F.col(value))
    other = F.when(F.col("_a") != F.col("_b"), F.col(value))
    stats = fanned.groupBy("perm").agg(
        (F.avg(same) - F.avg(other)).alias("gap"), F.avg(same).alias("within"), F.avg(other).alias("between"),
        F.var_samp(same).alias("_vs"), F.var_samp(other).alias("_vo"), F.min(value).alias("min_pairwise"),
    )
    null = summarize_null(stats, "gap", plus_one=plus_one).withColumnRenamed("observed", "observed_gap")
    pooled = F.sqrt((F.col("_vs") + F.col("_vo")) / 2)
    first = stats.filter("perm = 0").select(
        "within", "between", "min_pairwise",
        F.when(pooled > 1e-6, F.col("gap") / pooled).alias("effect_size"),
        (F.col("within").isNull() | F.col("between").isNull()).alias("insufficient_data"),
        F.lit(1).alias("_one"),
    )
    # both sides are a single row
    return null.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one").drop("_one")


def label_gap_tests(pairs: DataFrame, units: DataFrame, unit: list[str], label: str, value: str, by: list[str],
                    n_perms: int = 999, seed: int = 0) -> DataFrame:
    """``label_gap_test`` for every group of ``by`` at once: (by..., observed_gap, null_mean, null_95pct, p_value, n_perms).

    Labels are permuted over all units, once for all groups; a group's pairs meet each permutation of their two labels."""
    perms = permute_units(units.withColumn("_label", F.col(label)).select(*unit, "_label"), unit, "_label", n_perms, seed)
    ends = [f"{side}_{u}" for side in "ab" for u in unit]
    fanned = _fan_out(pairs.select(*ends).distinct(), n_perms)
    for side in "ab":
        named = perms.select("perm", *[F.col(u).alias(f"{side}_{u}") for u in unit], F.col("_label").alias(f"_{side}"))
        fanned = fanned.join(named, ["perm", *[f"{side}_{u}" for u in unit]])
    same = small_side(fanned.select("perm", *ends, (F.col("_a") == F.col("_b")).alias("_same")), "same-label")
    met = pairs.select(*by, *ends, value).join(same, ends)
    gap = F.avg(F.when(F.col("_same"), F.col(value))) - F.avg(F.when(~F.col("_same"), F.col(value)))
    return summarize_null(met.groupBy(*by, "perm").agg(gap.alias("gap")), "gap", by).withColumnRenamed("observed", "observed_gap")


def partial_corr(pairs: DataFrame, x: str, y: str, z1: str, z2: str):
    """Partial correlation of x and y given two controls, from one set of moments."""
    s = pairs.agg(*[
        F.expr(f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))").alias(f"s_{i}{j}")
        for i, a in zip("xyuv", (x, y, z1, z2)) for j, b in zip("xyuv", (x, y, z1, z2))
    ], F.count(F.lit(1)).alias("n_pairs"))
    det = "(s_uu * s_vv - s_uv * s_uv)"

    def left(a: str, b: str) -> str:
        return (f"(s_{a}{b} - try_divide(s_{a}u * (s_vv * s_{b}u - s_uv * s_{b}v)"
                f" + s_{a}v * (s_uu * s_{b}v - s_uv * s_{b}u), {det}))")

    return s.select(
        F.expr(f"try_divide({left('x', 'y')}, sqrt({left('x', 'x')}) * sqrt({left('y', 'y')}))").alias("pearson_r"),
        "n_pairs")


def transfer_correlations(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """r of similarity and transfer: overall, within and across seasons, and partial."""
    sub = pairs.filter(F.col(y).isNotNull())
    plain = sub.select(
        F.explode(F.array(
            F.lit("overall"),
            F.when(F.col("same_season") == 1, "same_season").otherwise("different_season"),
        )).alias("group"), x, y,
    ).groupBy("group").agg(M.pearson(x, y).alias("pearson_r"), F.count(F.lit(1)).alias("n_pairs")).filter("n_pairs >= 4")
    part = partial_corr(sub, x, y, "same_season", "same_year").filter("n_pairs >= 6").select(
        F.lit("partial_controlling_for_season_and_year").alias("group"), "pearson_r", "n_pairs")
    out = plain.unionByName(part)
    return out.withColumn("t", M.pearson_t("pearson_r", "n_pairs"))
