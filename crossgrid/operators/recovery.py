"""Layer-swap recovery tables: controls, condition pivots, summaries, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crossgrid.functions import metrics as M

# Conditions of a swap experiment.
CONDITIONS = (
    "baseline", "intervention", "same_season_control", "late_layers_complement",
    "donor_own_diagonal_context",
)
PAIR_KEY = ["recipient_year", "recipient_quarter", "donor_year", "donor_quarter"]


def same_season_control(pairs: DataFrame, available: DataFrame) -> DataFrame:
    """Closest other available year of the recipient's quarter, not the donor; NULL if none.

    The candidates of a pair are the years of one quarter; the smallest distance wins by an
    aggregate, the earlier year on a tie.
    """
    options = available.select(F.col("year").alias("_y"), F.col("quarter").alias("recipient_quarter")).distinct()
    is_self = F.col("_y") == F.col("recipient_year")
    is_donor = (F.col("_y") == F.col("donor_year")) & (F.col("recipient_quarter") == F.col("donor_quarter"))
    candidates = pairs.select(*PAIR_KEY).join(options, "recipient_quarter", "left")
    fits = F.when(~is_self & ~is_donor, F.col("_y"))
    return candidates.groupBy(*PAIR_KEY).agg(
        F.min_by(fits, F.when(fits.isNotNull(), F.struct(F.abs(F.col("_y") - F.col("recipient_year")), F.col("_y"))))
        .alias("control_year"))


def condition_pivot(rows: DataFrame) -> DataFrame:
    """One row per pair with a column per condition and the three recoveries."""
    wide = rows.groupBy(*PAIR_KEY).pivot("condition", list(CONDITIONS)).agg(F.first("r2"))
    donor = "donor_own_diagonal_context"
    return wide.withColumns({
        "intervention_recovery": M.recovery("baseline", "intervention", donor),
        "same_season_recovery": M.recovery("baseline", "same_season_control", donor),
        "late_layers_recovery": M.recovery("baseline", "late_layers_complement", donor),
    })


def recovery_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median, min, max without NULLs, and how many were excluded.

    One row per directed pair of periods goes in, so the exact ``percentile`` is bounded.
    """
    return df.groupBy(*(by or [])).agg(
        F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("n_excluded"))


def gradient_check(df: DataFrame, order: str, coef: str, by: list[str] | None = None) -> DataFrame:
    """Does the magnitude grow with distance, with one sign throughout? (a few distances per group)"""
    w = W.partitionBy(*(by or [])).orderBy(order)
    steps = df.withColumn("_up", F.abs(coef) >= F.lag(F.abs(coef)).over(w)).withColumn("_pos", F.col(coef) > 0)
    return steps.groupBy(*(by or [])).agg(
        F.coalesce(F.bool_and("_up"), F.lit(True)).alias("increasing_magnitude"),
        (F.bool_and("_pos") | F.bool_and(~F.col("_pos"))).alias("same_sign"),
        F.min_by("_pos", F.col(order)).alias("first_positive"),
    ).withColumn("gradient", F.col("increasing_magnitude") & F.col("same_sign") & F.col("first_positive"))


def layer_verdict(df: DataFrame, layer: str, p: str, early: tuple, late: tuple, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """early / late / both / neither from the per-layer p-values."""
    def any_of(groups) -> Column:
        hit = F.col(layer).isin(*groups) & (F.col(p) < alpha)
        return F.coalesce(F.bool_or(hit), F.lit(False))

    flags = df.groupBy(*(by or [])).agg(any_of(early).alias("early"), any_of(late).alias("late"))
    verdict = (F.when(F.col("early") & F.col("late"), "both").when(F.col("early"), "early")
               .when(F.col("late"), "late").otherwise("neither"))
    return flags.withColumn("verdict", verdict)


def clustering_table(df: DataFrame) -> DataFrame:
    """Season and year gaps side by side per (state, layer group)."""
    return df.groupBy("state", "layer_group").agg(*[
        F.max(F.when(F.col("clustering_by") == k, F.col(c))).alias(f"{k}_{n}")
        for k in ("season", "year") for c, n in (("observed_gap", "gap"), ("p_value", "p_value"))])


def complete_states(df: DataFrame, layers: tuple, layer: str = "layer_group") -> tuple[DataFrame, DataFrame]:
    """Rows of the states that have every layer, and the others as (state, missing layers)."""
    held = df.groupBy("state").agg(F.collect_set(layer).alias("_held"))  # a few layers
    lacking = held.select("state", F.array_except(F.array(*[F.lit(x) for x in layers]), "_held").alias("missing"))
    return df.join(lacking.filter(F.size("missing") == 0), "state", "left_semi"), lacking.filter(F.size("missing") > 0)


def block_table(df: DataFrame, blocks: list[str]) -> DataFrame:
    """R2 per nested block side by side; states with an incomplete set of blocks are dropped."""
    wide = df.groupBy("state").agg(
        *[F.max(F.when(F.col("block") == b, F.col("r_squared"))).alias(f"r2_{i}") for i, b in enumerate(blocks)],
        F.count_distinct("block").alias("_k"), F.max("n_obs").alias("n_obs"))
    added = {f"added_{i}": F.col(f"r2_{i}") - F.col(f"r2_{i - 1}") for i in range(1, len(blocks))}
    return wide.filter(F.col("_k") == len(blocks)).withColumns(added).drop("_k")
