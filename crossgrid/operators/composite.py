"""Correlation-weighted composite indices.

Two aggregations fit everything, for all indices and all periods at once: non-null counts
(which features are usable), then income correlations, means, standard deviations and
covariances over complete rows. The mean and spread of the raw score follow from the
covariances, so no third pass over the rows is needed. Fitted tables have one row per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crossgrid.functions import metrics as M
from crossgrid.session import attach_params, small_side

# The features of each index.
INDEX_FEATURES = {
    "wealth_index": (
        "log_home_value", "owner_pct", "crowded_pct", "severely_crowded_pct", "log_gross_rent",
        "median_rooms", "single_family_pct", "median_year_built"),
    "wealth_index_sat": (
        "log_home_value", "log_gross_rent", "median_rooms", "single_family_pct",
        "median_year_built", "mobile_home_pct"),
    "wealth_index_housing_core": (
        "log_home_value", "owner_pct", "crowded_pct", "severely_crowded_pct"),
    "wealth_index_transport": ("pct_no_vehicle", "pct_2plus_vehicles"),
    "wealth_index_financial": (
        "poverty_rate", "unemployment_rate", "rent_burdened_30plus_pct",
        "owner_burdened_30plus_pct"),
    "wealth_index_utilities": ("broadband_pct", "gas_heat_pct", "poor_heat_pct"),
}


def attach_fit(df: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """Add fitted columns to rows: one fitted row in all, or one per group of ``by``."""
    return df.join(fit, by) if by else attach_params(df, fit)


def fit_indices(
    df: DataFrame, definitions: dict[str, tuple], income: str, by: list[str] | None = None,
    min_non_null: int = 1000,
) -> DataFrame:
    """Weights, scaler and score parameters of every index, one row per ``by`` group.

    Columns are ``<index>__<w|mu|sd|n>__<feature>``, ``<index>__mean`` and ``<index>__std``.
    A feature with no more than ``min_non_null`` values is left out of its index (NULL).
    """
    by = list(by or [])
    features = sorted({f for fs in definitions.values() for f in fs})
    counts = df.groupBy(*by).agg(*[F.count(f).alias(f"_n_{f}") for f in features])
    if by:
        counts = small_side(counts, "counts")
    rows = attach_fit(df.select(*by, income, *features), counts, by)

    # SQL text: a definition of k features needs k(k+1)/2 covariances, one parse does for all
    masked, aggs, solved, out = [], [], [], list(by)
    for name, fs in definitions.items():
        complete = " AND ".join(f"(_n_{f} <= {min_non_null} OR {f} IS NOT NULL)" for f in fs)
        some = " OR ".join(f"_n_{f} > {min_non_null}" for f in fs)
        ok = f"({complete}) AND ({some})"
        pairs = [(a, b) for i, a in enumerate(fs) for b in fs[: i + 1]]
        masked += [f"CASE WHEN {ok} THEN CAST({f} AS DOUBLE) END AS _x_{name}__{f}" for f in fs]
        masked += [f"CASE WHEN {ok} THEN CAST({income} AS DOUBLE) END AS _y_{name}",
                   f"({ok}) AS _ok_{name}"]
        aggs += [f"count_if(_ok_{name}) AS {name}__rows", f"var_pop(_y_{name}) AS _{name}__vy"]
        for f in fs:
            x = f"_x_{name}__{f}"
            aggs += [
                f"max(_n_{f}) AS {name}__n__{f}", f"avg({x}) AS {name}__mu__{f}",
                f"covar_pop({x}, _y_{name}) AS _{name}__cy__{f}",
                f"var_pop(CASE WHEN _y_{name} IS NOT NULL THEN {x} END) AS _{name}__vy__{f}",
            ]
            solved += [
                f"try_divide(_{name}__cy__{f}, sqrt(_{name}__vy) * sqrt(_{name}__vy__{f})) AS {name}__w__{f}",
                f"CASE WHEN _{name}__c__{f}__{f} = 0 THEN 1 ELSE sqrt(_{name}__c__{f}__{f}) END AS {name}__sd__{f}",
            ]
        aggs += [f"covar_pop(_x_{name}__{a}, _x_{name}__{b}) AS _{name}__c__{a}__{b}" for a, b in pairs]
        # a pair with an unusable feature adds nothing; an undefined weight makes the sum NULL
        variance = " + ".join(
            f"CASE WHEN {name}__n__{a} <= {min_non_null} OR {name}__n__{b} <= {min_non_null} THEN 0 ELSE "
            f"{1 if a == b else 2} * {name}__w__{a} / {name}__sd__{a} * {name}__w__{b} / {name}__sd__{b}"
            f" * _{name}__c__{a}__{b} END" for a, b in pairs
        )
        out += [f"{name}__{k}__{f}" for f in fs for k in ("n", "w", "mu", "sd")]
        out += [
            f"{name}__rows",
            # every feature is centred on the same complete rows, so the mean raw score is 0
            f"CASE WHEN {name}__rows > 0 THEN CAST(0 AS DOUBLE) END AS {name}__mean",
            f"sqrt(try_divide(({variance}) * {name}__rows, {name}__rows - 1)) AS {name}__std",
            f"{min_non_null} AS {name}__gate",
        ]
    fitted = rows.selectExpr("*", *masked).groupBy(*by).agg(*[F.expr(a) for a in aggs])
    fit = fitted.selectExpr("*", *solved).selectExpr(*out)
    # every user of the fit reads this table: it is written once
    return small_side(fit, "fit")


def raw_score(name: str, features, weight_prefix: str | None = None) -> Column:
    """Weighted sum of z-scores; NULL for rows that lack a usable feature."""
    wp = weight_prefix or name
    return F.expr(" + ".join(
        f"CASE WHEN {name}__n__{f} <= {name}__gate THEN 0 ELSE "
        f"{wp}__w__{f} * ({f} - {name}__mu__{f}) / {name}__sd__{f} END" for f in features
    ))


def apply_indices(df: DataFrame, fit: DataFrame, definitions: dict[str, tuple], by: list[str] | None = None) -> DataFrame:
    """Add one standardised score column per index: 0 is the fitted population's average."""
    by = list(by or [])
    scored = attach_fit(df, fit, by).withColumns({
        name: F.try_divide(raw_score(name, fs) - F.col(f"{name}__mean"), F.col(f"{name}__std"))
        for name, fs in definitions.items()
    })
    return scored.select(*df.columns, *definitions)


def weights_long(fit: DataFrame, definitions: dict[str, tuple], by: list[str] | None = None) -> DataFrame:
    """Long (by, index_name, feature, n_non_null, weight, mean, std)."""
    by = list(by or [])
    entries = ", ".join(
        f"named_struct('index_name', '{name}', 'feature', '{f}', 'n_non_null', {name}__n__{f}, "
        f"'weight', {name}__w__{f}, 'mean', {name}__mu__{f}, 'std', {name}__sd__{f}, "
        f"'usable', {name}__n__{f} > {name}__gate)"
        for name, fs in definitions.items() for f in fs
    )
    return fit.selectExpr(*by, f"inline(array({entries}))")


def score_params(fit: DataFrame, definitions: dict[str, tuple], by: list[str] | None = None) -> DataFrame:
    """Long (by, index_name, n_rows, score_mean, score_std)."""
    by = list(by or [])
    entries = [
        F.struct(F.lit(name).alias("index_name"), F.col(f"{name}__rows").alias("n_rows"),
                 F.col(f"{name}__mean").alias("score_mean"), F.col(f"{name}__std").alias("score_std"))
        for name in definitions
    ]
    return fit.select(*by, F.explode(F.array(*entries)).alias("_e")).select(*by, "_e.*")


def validate_index(scored: DataFrame, index: str, income: str, poverty: str, heldout: str,
                   by: list[str] | None = None) -> DataFrame:
    """Correlation with income, poverty and a held-out income, and the acceptance flags."""
    s = F.when(F.col(income).isNotNull() & F.col(poverty).isNotNull(), F.col(index))
    n_out = F.count(F.when(F.col(index).isNotNull() & F.col(heldout).isNotNull(), 1))
    out = scored.groupBy(*(by or [])).agg(
        M.pearson(s, income).alias("income_r"), M.pearson(s, poverty).alias("poverty_r"),
        F.when(n_out > 10, M.pearson(index, heldout)).alias("heldout_r"),
    )
    return out.withColumns({
        "income_flag": F.when(F.col("income_r") > 0.70, "PASS").otherwise("FAIL"),
        "poverty_flag": F.when(F.col("poverty_r") < -0.70, "PASS").otherwise("FAIL"),
        "passed": F.coalesce((F.col("income_r") > 0.70) & (F.col("poverty_r") < -0.70), F.lit(False)),
    })


def cross_period_scores(df: DataFrame, fit: DataFrame, name: str, features, period: str) -> DataFrame:
    """Own-period z-scores with every other period's weights.

    The fitted table has one row per period, so the pairing of periods is bounded.
    """
    own = attach_fit(df, fit, [period])
    others = fit.select(
        F.col(period).alias("weight_period"),
        *[F.col(f"{name}__w__{f}").alias(f"other__w__{f}") for f in features],
    ).agg(F.collect_list(F.struct("*")).alias("_others"))
    crossed = attach_params(own, others).withColumn("_o", F.explode("_others")).drop("_others").select("*", "_o.*")
    return crossed.filter(F.col("weight_period") != F.col(period)).withColumn(
        "cross_score", raw_score(name, features, "other")
    ).select(*df.columns, "weight_period", "cross_score")
