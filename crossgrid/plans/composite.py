"""Composite index queries on the tract table."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrid.functions import metrics as M
from crossgrid.operators import composite as CI, features as FE
from crossgrid.operators.quantile import QUINTILE_LABELS, quantile_columns, quintile_label
from crossgrid.plans import fixtures as X
from crossgrid.plans.registry import query, r
from crossgrid.session import materialize, rounded, small_side

# the six index definitions on the stand-in features: 8, 6, 4, 2, 4 and 3 of them
INDICES = {
    "wealth_index": tuple(X.TRACT_FEATURES),
    "wealth_index_sat": tuple(X.TRACT_FEATURES[:6]),
    "wealth_index_housing_core": tuple(X.TRACT_FEATURES[:4]),
    "wealth_index_transport": ("n_orders", "lines_per_order"),
    "wealth_index_financial": ("urgent_pct", "finished_pct", "avg_discount", "avg_tax"),
    "wealth_index_utilities": ("log_price", "avg_quantity", "avg_tax"),
}
MAIN = {"wealth_index": INDICES["wealth_index"]}
PERIOD = ["period"]
GATE = 50


def _tracts(t):
    """The tract table, written once: counting, fitting and scoring all read it."""
    return materialize(X.tracts(t), "tracts")


def _fit(t, definitions=MAIN):
    return CI.fit_indices(_tracts(t), definitions, "income", PERIOD, min_non_null=GATE)


def _scored(t, definitions=MAIN):
    tr = _tracts(t)
    fit = CI.fit_indices(tr, definitions, "income", PERIOD, min_non_null=GATE)
    return CI.apply_indices(tr, fit, definitions, PERIOD)


def _index_sql(name: str, features, prefix: str) -> str:
    """CTEs <prefix>d (flags), <prefix>s (fit) and <prefix>v (score) of one index over ``tr``."""
    complete = " AND ".join(f"{f} IS NOT NULL" for f in features)
    fit = ", ".join(
        f"covar_pop({f}, income) FILTER (WHERE income IS NOT NULL) / nullif(sqrt(var_pop({f}) FILTER (WHERE income IS NOT NULL)"
        f" * var_pop(income)), 0) AS w_{f}, avg({f}) AS mu_{f},"
        f" coalesce(nullif(stddev_pop({f}), 0), 1) AS sd_{f}" for f in features)
    raw = " + ".join(f"w_{f} * ({f} - mu_{f}) / sd_{f}" for f in features)
    return f"""{prefix}s AS (SELECT period, {fit} FROM tr WHERE {complete} GROUP BY period),
    {prefix}r AS (SELECT tr.*, {raw} AS raw FROM tr JOIN {prefix}s USING (period)),
    {prefix}p AS (SELECT period, count(raw) AS n_rows, avg(raw) AS m, stddev_samp(raw) AS s FROM {prefix}r GROUP BY period),
    {prefix}v AS (SELECT {prefix}r.*, (raw - m) / s AS {name} FROM {prefix}r JOIN {prefix}p USING (period))"""


_TR = f"WITH tr AS ({X.TRACTS_SQL}), "
_MAIN_SQL = _TR + _index_sql("wealth_index", MAIN["wealth_index"], "w")


@query("index_weights", _MAIN_SQL + " " + " UNION ALL ".join(
    f"SELECT period, '{f}' AS feature, {r(f'w_{f}')} AS weight FROM ws" for f in MAIN["wealth_index"]))
def index_weights(t):
    """Income correlation of every feature over complete rows, per period."""
    return CI.weights_long(_fit(t), MAIN, PERIOD).select("period", "feature", rounded("weight").alias("weight"))


@query("weight_rank", _MAIN_SQL + ", w AS (" + " UNION ALL ".join(
    f"SELECT period, '{f}' AS feature, w_{f} AS weight FROM ws" for f in MAIN["wealth_index"]) + f""")
    SELECT period, feature, {r("weight")} AS weight,
           rank() OVER (PARTITION BY period ORDER BY abs(weight) DESC)::INTEGER AS rank FROM w""")
def weight_rank(t):
    """Features by falling absolute weight (a few rows per period)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("period").orderBy(F.abs("weight").desc())
    return CI.weights_long(_fit(t), MAIN, PERIOD).select(
        "period", "feature", rounded("weight").alias("weight"), F.rank().over(w).alias("rank"))


@query("index_scaler", _MAIN_SQL + " " + " UNION ALL ".join(
    f"SELECT period, '{f}' AS feature, {r(f'mu_{f}')} AS mean, {r(f'sd_{f}')} AS std FROM ws"
    for f in MAIN["wealth_index"]))
def index_scaler(t):
    """Mean and population std of every feature over complete rows."""
    return CI.weights_long(_fit(t), MAIN, PERIOD).select(
        "period", "feature", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query("index_params", _MAIN_SQL + f" SELECT period, n_rows, {r('m')} AS score_mean, {r('s')} AS score_std FROM wp")
def index_params(t):
    """Mean and sample std of the raw score, from the covariances alone."""
    return CI.score_params(_fit(t), MAIN, PERIOD).select(
        "period", "n_rows", rounded("score_mean").alias("score_mean"), rounded("score_std").alias("score_std"))


@query("wealth_index", _MAIN_SQL + f" SELECT tract, period, {r('wealth_index')} AS wealth_index FROM wv")
def wealth_index(t):
    """Standardised composite score of every tract; NULL for incomplete rows."""
    return _scored(t).select("tract", "period", rounded("wealth_index").alias("wealth_index"))


@query("wealth_index_multi", _TR + ", ".join(
    _index_sql(n, fs, f"i{k}_") for k, (n, fs) in enumerate(INDICES.items())) + " SELECT tract, period, "
    + ", ".join(f"{r(n)} AS {n}" for n in INDICES) + " FROM tr "
    + " ".join(f"LEFT JOIN (SELECT tract, period, {n} FROM i{k}_v) USING (tract, period)" for k, n in enumerate(INDICES)))
def wealth_index_multi(t):
    """Six indices x two periods: fitted in two aggregations, applied in one projection."""
    return _scored(t, INDICES).select("tract", "period", *[rounded(n).alias(n) for n in INDICES])


_PAIR = "covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0)"


def _corr(a: str, b: str, also: str = "TRUE") -> str:
    ok = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {also})"
    return f"covar_pop({a}, {b}) {ok} / nullif(sqrt(var_pop({a}) {ok} * var_pop({b}) {ok}), 0)"


@query("index_validation", _MAIN_SQL + f""", g AS (SELECT period, {_corr("wealth_index", "income", "poverty IS NOT NULL")} AS ir,
           {_corr("wealth_index", "poverty", "income IS NOT NULL")} AS pr, {_corr("wealth_index", "per_capita")} AS hr FROM wv GROUP BY period)
    SELECT period, {r("ir")} AS income_r, {r("pr")} AS poverty_r, {r("hr")} AS heldout_r,
           CASE WHEN ir > 0.70 THEN 'PASS' ELSE 'FAIL' END AS income_flag,
           CASE WHEN pr < -0.70 THEN 'PASS' ELSE 'FAIL' END AS poverty_flag,
           coalesce(ir > 0.70 AND pr < -0.70, FALSE) AS passed FROM g""")
def index_validation(t):
    """Correlation of the index with income, poverty and a held-out income, with flags."""
    out = CI.validate_index(_scored(t), "wealth_index", "income", "poverty", "per_capita", PERIOD)
    return out.withColumns({c: rounded(c) for c in ("income_r", "poverty_r", "heldout_r")})


_FEATS = MAIN["wealth_index"]


@query("weight_stability", _MAIN_SQL + f""", o AS (SELECT period AS weight_period, {", ".join(f"w_{f} AS o_{f}" for f in _FEATS)} FROM ws),
    c AS (SELECT tr.period, weight_period, income, poverty,
                 {" + ".join(f"o_{f} * ({f} - mu_{f}) / sd_{f}" for f in _FEATS)} AS s
          FROM tr JOIN ws USING (period), o WHERE weight_period <> tr.period)
    SELECT period, weight_period, {r(_corr("s", "income"))} AS income_r, {r(_corr("s", "poverty"))} AS poverty_r
    FROM c GROUP BY ALL""")
def weight_stability(t):
    """Own-period z-scores with the other period's weights against income and poverty."""
    tr = _tracts(t)
    fit = CI.fit_indices(tr, MAIN, "income", PERIOD, min_non_null=GATE)
    crossed = CI.cross_period_scores(tr, fit, "wealth_index", _FEATS, "period")
    return crossed.groupBy("period", "weight_period").agg(
        rounded(M.pearson("cross_score", "income")).alias("income_r"),
        rounded(M.pearson("cross_score", "poverty")).alias("poverty_r"))


@query("index_corr", _TR + ", ".join(
    _index_sql(n, INDICES[n], f"i{k}_") for k, n in enumerate(("wealth_index", "wealth_index_sat"))) + f"""
    SELECT period, {r("avg(wealth_index)")} AS mean_wealth_index, {r("avg(wealth_index_sat)")} AS mean_sat,
           {r(_corr("wealth_index", "wealth_index_sat"))} AS r,
           count(*) FILTER (WHERE wealth_index IS NOT NULL AND wealth_index_sat IS NOT NULL) AS n
    FROM (SELECT tract, period, wealth_index FROM i0_v) FULL JOIN (SELECT tract, period, wealth_index_sat FROM i1_v) USING (tract, period)
    GROUP BY period""")
def index_corr(t):
    """Mean scores and the correlation of two indices."""
    two = {n: INDICES[n] for n in ("wealth_index", "wealth_index_sat")}
    both = F.col("wealth_index").isNotNull() & F.col("wealth_index_sat").isNotNull()
    return _scored(t, two).groupBy("period").agg(
        rounded(F.avg("wealth_index")).alias("mean_wealth_index"), rounded(F.avg("wealth_index_sat")).alias("mean_sat"),
        rounded(M.pearson("wealth_index", "wealth_index_sat")).alias("r"), F.count_if(both).alias("n"))


def _labels_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= q[1] THEN '{QUINTILE_LABELS[0]}' WHEN {x} <= q[2] THEN '{QUINTILE_LABELS[1]}' "
            f"WHEN {x} <= q[3] THEN '{QUINTILE_LABELS[2]}' WHEN {x} <= q[4] THEN '{QUINTILE_LABELS[3]}' ELSE '{QUINTILE_LABELS[4]}' END")


@query("quintiles", f"""
    WITH s AS (SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, o_totalprice AS score FROM orders),
    q AS (SELECT year, quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM s GROUP BY year)
    SELECT o_orderkey, {_labels_sql("score")} AS quintile FROM s JOIN q USING (year)""")
def quintiles(t):
    """Quintile labels within a scope (here the order year) at interpolated edges."""
    s = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("score"))
    edges = {"p20": 0.2, "p40": 0.4, "p60": 0.6, "p80": 0.8}
    q = small_side(quantile_columns(s, "score", edges, ["year"]), "edges")
    return s.join(q, "year").select("o_orderkey", quintile_label("score", *edges).alias("quintile"))


@query("index_quintiles", _MAIN_SQL + f""", q AS (SELECT period, quantile_cont(round(wealth_index, 9), [0.2, 0.4, 0.6, 0.8]) AS q FROM wv GROUP BY period)
    SELECT tract, period, {_labels_sql("round(wealth_index, 9)")} AS quintile FROM wv LEFT JOIN q USING (period)""")
def index_quintiles(t):
    """Quintile labels of the composite score per period."""
    s = materialize(_scored(t).select("tract", "period", F.round("wealth_index", 9).alias("score")), "scores")
    edges = {"p20": 0.2, "p40": 0.4, "p60": 0.6, "p80": 0.8}
    q = small_side(quantile_columns(s, "score", edges, PERIOD), "edges")
    return s.join(q, "period", "left").select(
        "tract", "period", quintile_label("score", *edges).alias("quintile"))


@query("five_number", f"""
    SELECT l_returnflag, {", ".join(f"{r(f'quantile_cont(l_extendedprice, {p})', 4)} AS {n}" for n, p in
                                    (("min", 0.0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("max", 1.0)))}
    FROM lineitem GROUP BY l_returnflag""")
def five_number(t):
    """Minimum, quartiles and maximum per group, exact."""
    names = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0}
    out = quantile_columns(t.lineitem, "l_extendedprice", names, ["l_returnflag"])
    return out.select("l_returnflag", *[rounded(n, 4).alias(n) for n in names])


# --- derived features ------------------------------------------------------------------

_COUNT_INPUTS = sorted({
    c for nums, den in FE.PERCENTAGES.values() for c in (*nums, den)} | set(FE.VEHICLE_COUNTS) | {"total_bedrooms"})
_TOTALS = {den for _, den in FE.PERCENTAGES.values()}


def _input_sql(c: str) -> str:
    if c in _TOTALS:
        return f"count(*) FILTER (WHERE l_quantity > {len(c) % 5})::DOUBLE AS {c}"
    return f"count(*) FILTER (WHERE l_linenumber = {len(c) % 7 + 1})::DOUBLE AS {c}"


_ACS_SQL = f"""
    SELECT l_partkey AS geoid, CASE WHEN l_returnflag = 'A' THEN '2010-2014' ELSE '2015-2019' END AS period,
           avg(l_extendedprice) - 30000 AS median_home_value, avg(CASE WHEN l_tax > 0.01 THEN l_quantity END) AS median_gross_rent,
           {", ".join(_input_sql(c) for c in _COUNT_INPUTS)}
    FROM lineitem GROUP BY 1, 2"""


def _acs(t):
    def count_of(c):
        hit = F.col("l_quantity") > len(c) % 5 if c in _TOTALS else F.col("l_linenumber") == len(c) % 7 + 1
        return F.count_if(hit).cast("double").alias(c)

    period = F.when(F.col("l_returnflag") == "A", "2010-2014").otherwise("2015-2019")
    return t.lineitem.groupBy(F.col("l_partkey").alias("geoid"), period.alias("period")).agg(
        (F.avg("l_extendedprice") - 30000).alias("median_home_value"),
        F.avg(F.when(F.col("l_tax") > 0.01, F.col("l_quantity"))).alias("median_gross_rent"),
        *[count_of(c) for c in _COUNT_INPUTS])


def _pct_sql(nums, den) -> str:
    return r(f"({' + '.join(nums)}) / nullif({den}, 0) * 100", 5)


_DERIVED_SQL = ", ".join(f"{_pct_sql(*v)} AS {k}" for k, v in FE.PERCENTAGES.items())


@query("derive_features", f"""
    SELECT geoid, period, {r("ln(1 + greatest(median_home_value, 0))")} AS log_home_value,
           CASE WHEN median_gross_rent IS NOT NULL THEN {r("ln(1 + greatest(median_gross_rent, 0))")} END AS log_gross_rent,
           {_DERIVED_SQL}, {r(f"(vehicles_total_households - ({' + '.join(FE.VEHICLE_COUNTS)})) / nullif(vehicles_total_households, 0) * 100", 5)} AS pct_no_vehicle,
           {r("total_bedrooms / nullif(total_housing_units, 0)", 5)} AS avg_bedrooms_per_unit
    FROM ({_ACS_SQL})""")
def derive_features(t):
    """All derived tract features in one projection."""
    out = FE.derive_features(_acs(t))
    pct = [*FE.PERCENTAGES, "pct_no_vehicle", "avg_bedrooms_per_unit"]
    return out.select("geoid", "period", *[rounded(c).alias(c) for c in FE.LOGS], *[rounded(c, 5).alias(c) for c in pct])


@query("period_null_cols", f"""
    SELECT geoid, period, {", ".join(f"CASE WHEN period <> '2010-2014' THEN {c} END AS {c}" for c in FE.NOT_IN_OLDER_PERIOD)}
    FROM ({_ACS_SQL})""")
def period_null_cols(t):
    """Columns that the older period did not release are NULL there."""
    out = FE.null_unreleased(_acs(t), "period", "2010-2014")
    return out.select("geoid", "period", *FE.NOT_IN_OLDER_PERIOD)
