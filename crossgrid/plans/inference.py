"""Permutation, bootstrap and regression queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from crossgrid.functions import metrics as M
from crossgrid.operators import accuracy as A, bootstrap as B, cells as C, regress as G, resample as S, vectors as V
from crossgrid.operators.raster import reference_class
from crossgrid.plans import fixtures as X
from crossgrid.plans.registry import query, r
from crossgrid.session import materialize, rounded
from crossgrid.sources.readers import REQUIRED_CELLS

N_PERMS = 999
N_BOOT = 1000
OFF = "model_year <> eval_year OR model_quarter <> eval_quarter"


def perm_sql(units: str, n: int = N_PERMS, within: str = "", key: str = "year || ':' || quarter",
             order: str = "year, quarter", cols: str = "year, quarter") -> str:
    """CTEs ending in ``m`` (i, within, unit, val): values dealt out anew in every replicate."""
    part = f"PARTITION BY {within}" if within else ""
    w = f"{within}, " if within else ""
    return f"""u AS ({units}),
    k1 AS MATERIALIZED (SELECT *, row_number() OVER ({part} ORDER BY {order}) AS k FROM u),
    pm AS (SELECT i, {w}{cols}, row_number() OVER (PARTITION BY i{', ' + within if within else ''} ORDER BY md5('0:' || i || ':' || {key})) AS k
           FROM k1, range(1, {n} + 1) t(i)
           UNION ALL SELECT 0, {w}{cols}, k FROM k1),
    m AS MATERIALIZED (SELECT pm.i, {', '.join('pm.' + c.strip() for c in (w + cols).split(','))}, k1.val
          FROM pm JOIN k1 ON pm.k = k1.k {f'AND pm.{within} IS NOT DISTINCT FROM k1.{within}' if within else ''})"""


def null_sql(two_sided: bool = False, plus_one: int = 1, by: str = "") -> str:
    """Summary of statistics ``g`` (i, v): names as in the operators."""
    a = "abs" if two_sided else ""
    b = f"{by}, " if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    return f"""q AS (SELECT {b}i, round(v, 10) AS v FROM g), o AS (SELECT {b}v AS obs FROM q WHERE i = 0),
    z AS (SELECT {b}any_value(obs) AS obs, avg(v) AS null_mean, stddev_pop(v) AS null_std, quantile_cont(v, 0.95) AS null_95pct,
                 (count(*) FILTER (WHERE {a}(v) >= {a}(obs)) + {plus_one})::DOUBLE / (count(v) + {plus_one}) AS p_value,
                 count(v)::INTEGER AS n_perms
          FROM q JOIN o {join} WHERE i > 0 {f'GROUP BY {by}' if by else ''})"""


_UNITS = f"SELECT DISTINCT year, quarter, quarter AS val FROM ({X.PRED_SQL})"


def _cells(t):
    """The cell table, written once: permutations fan out from it."""
    return materialize(X.cells(t), "cells")


@query("season_gap_perm", f"""
    WITH c AS MATERIALIZED ({X.CELLS_SQL}), {perm_sql(_UNITS)},
    g AS (SELECT a.i, avg(CASE WHEN a.val = b.val AND model_year <> eval_year THEN r2 END)
                      - avg(CASE WHEN a.val <> b.val AND model_year = eval_year THEN r2 END) AS v
          FROM c JOIN m a ON a.year = model_year AND a.quarter = model_quarter
                 JOIN m b ON b.i = a.i AND b.year = eval_year AND b.quarter = eval_quarter GROUP BY a.i),
    {null_sql(two_sided=True)}
    SELECT {r("obs")} AS observed_gap, {r("null_mean")} AS null_mean, {r("null_std")} AS null_std,
           {r("p_value")} AS p_value, n_perms FROM z""")
def season_gap_perm(t):
    """Is accuracy lost across seasons or across years? Two-sided permutation test."""
    out = S.season_gap_test(_cells(t), "r2", N_PERMS)
    return out.select(*[rounded(c).alias(c) for c in ("observed_gap", "null_mean", "null_std", "p_value")], "n_perms")


_R2_TWO = """(power(covar_pop({a}, {y}), 2) * var_pop({b}) - 2 * covar_pop({a}, {y}) * covar_pop({b}, {y}) * covar_pop({a}, {b})
             + power(covar_pop({b}, {y}), 2) * var_pop({a})) / nullif((var_pop({a}) * var_pop({b}) - power(covar_pop({a}, {b}), 2)) * var_pop({y}), 0)"""

_METRIC_UNITS = f"""SELECT year, quarter, metric, val FROM (UNPIVOT ({X.PERIODS_SQL})
    ON cloud_frac, ndvi, valid_obs_frac INTO NAME metric VALUE val)"""


@query("rs_gap_perm", f"""
    WITH c AS MATERIALIZED (SELECT * FROM ({X.CELLS_SQL}) WHERE {OFF}), {perm_sql(_METRIC_UNITS, within="metric")},
    d AS (SELECT a.i, a.metric, r2, b.val - a.val AS d
          FROM c JOIN m a ON a.year = model_year AND a.quarter = model_quarter
                 JOIN m b ON b.i = a.i AND b.metric = a.metric AND b.year = eval_year AND b.quarter = eval_quarter),
    g AS (SELECT i, metric, {_R2_TWO.format(a="d", b="abs(d)", y="r2")} AS v FROM d GROUP BY i, metric),
    {null_sql(by="metric")}
    SELECT metric, {r("obs")} AS observed_r2, {r("null_mean")} AS null_r2_mean, {r("null_95pct")} AS null_r2_95pct,
           {r("p_value")} AS p_value, n_perms, (SELECT count(*) FROM c) AS n_obs,
           (SELECT count(*) FROM ({_UNITS}))::INTEGER AS n_quarters_permuted FROM z""")
def rs_gap_perm(t):
    """Does a metric's gap between two periods explain accuracy? Quarter-level permutation."""
    means = C.period_means(X.summary_rows(t), X.METRICS)
    out = S.gap_r2_test(materialize(C.off_diagonal(X.cells(t)), "cells"), materialize(means, "means"), "r2", N_PERMS)
    return out.select("metric", *[rounded(c).alias(c) for c in ("observed_r2", "null_r2_mean", "null_r2_95pct", "p_value")],
                      "n_perms", "n_obs", "n_quarters_permuted")


# --- parameter vectors of the quarter models ----------------------------------------------

_QVEC_SQL = f"""
    SELECT f.year, f.quarter, f.layer, f.idx, f.v - b.v AS delta
    FROM (SELECT year(l_shipdate)::INTEGER AS year, quarter(l_shipdate)::INTEGER AS quarter, l_returnflag AS layer,
                 l_linenumber AS idx, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) f
    JOIN (SELECT l_returnflag AS layer, l_linenumber AS idx, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) b
      ON b.layer = f.layer AND b.idx = f.idx"""

_PAIRS_SQL = f"""
    SELECT a.year AS a_year, a.quarter AS a_quarter, b.year AS b_year, b.quarter AS b_quarter,
           sum(a.delta * b.delta) / nullif(sqrt(sum(a.delta * a.delta)) * sqrt(sum(b.delta * b.delta)), 0) AS sim
    FROM qv a JOIN qv b ON a.layer = b.layer AND a.idx = b.idx AND (a.year, a.quarter) < (b.year, b.quarter)
    GROUP BY ALL"""


def quarter_params(t):
    """Long parameters of one model per ship quarter: (year, quarter, layer, idx, value)."""
    return t.lineitem.groupBy(
        F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"),
        F.col("l_returnflag").alias("layer"), F.col("l_linenumber").alias("idx"),
    ).agg(F.avg("l_extendedprice").alias("value"))


def base_params(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("layer"), F.col("l_linenumber").alias("idx")).agg(
        F.avg("l_extendedprice").alias("value"))


def quarter_deltas(t):
    return V.vector_delta(quarter_params(t), base_params(t), ["layer", "idx"], ["year", "quarter"])


def quarter_pairs(t):
    """Cosine similarity of every unordered pair of quarter models."""
    deltas = materialize(quarter_deltas(t), "deltas")
    return V.cosine_pairs(deltas, ["year", "quarter"], ["layer", "idx"], "delta")


@query("vector_delta", f"""SELECT year, quarter, layer, idx, {r("delta", 4)} AS delta FROM ({_QVEC_SQL})""")
def vector_delta(t):
    """Fine-tuned minus base parameters; a key missing on either side is an error."""
    return quarter_deltas(t).select("year", "quarter", "layer", "idx", rounded("delta", 4).alias("delta"))


@query("cosine_pairs", f"""
    WITH qv AS MATERIALIZED ({_QVEC_SQL}), p AS ({_PAIRS_SQL})
    SELECT a_year, a_quarter, b_year, b_quarter, {r("coalesce(sim, 0)")} AS similarity,
           (a_quarter = b_quarter)::INTEGER AS same_season, (a_year = b_year)::INTEGER AS same_year FROM p""")
def cosine_pairs(t):
    """All-pairs cosine of model deltas from one Gram aggregate, with season and year flags."""
    out = V.pair_flags(quarter_pairs(t))
    return out.withColumn("similarity", rounded("similarity"))


_QUNITS = "SELECT DISTINCT year, quarter, {label} AS val FROM qv"


def _label_gap_sql(label: str, plus_one: int) -> str:
    return f"""
    WITH qv AS MATERIALIZED ({_QVEC_SQL}), p AS MATERIALIZED ({_PAIRS_SQL}), {perm_sql(_QUNITS.format(label=label))},
    j AS (SELECT a.i, sim, a.val = b.val AS same FROM p
          JOIN m a ON a.year = a_year AND a.quarter = a_quarter
          JOIN m b ON b.i = a.i AND b.year = b_year AND b.quarter = b_quarter),
    g AS (SELECT i, avg(sim) FILTER (WHERE same) - avg(sim) FILTER (WHERE NOT same) AS v FROM j GROUP BY i),
    e AS (SELECT avg(sim) FILTER (WHERE same) AS within, avg(sim) FILTER (WHERE NOT same) AS between, min(sim) AS lowest,
                 sqrt((var_samp(sim) FILTER (WHERE same) + var_samp(sim) FILTER (WHERE NOT same)) / 2) AS sd FROM j WHERE i = 0),
    {null_sql(plus_one=plus_one)}"""


@query("cluster_gap_perm", _label_gap_sql("quarter", 1) + f"""
    SELECT {r("obs")} AS observed_gap, {r("null_mean")} AS null_mean, {r("null_95pct")} AS null_95pct, {r("p_value")} AS p_value, n_perms,
           'season' AS clustering_by FROM z""")
def cluster_gap_perm(t):
    """Are models of the same season more alike? Label permutation over models."""
    pairs = materialize(quarter_pairs(t), "pairs")
    units = V.pair_units(pairs, ["year", "quarter"])
    out = S.label_gap_test(pairs, units, ["year", "quarter"], "quarter", "similarity", N_PERMS)
    return out.select(*[rounded(c).alias(c) for c in ("observed_gap", "null_mean", "null_95pct", "p_value")], "n_perms",
                      F.lit("season").alias("clustering_by"))


@query("mantel_gap", _label_gap_sql("year", 0) + f"""
    SELECT {r("obs")} AS observed_gap, {r("within")} AS mean_within, {r("between")} AS mean_between,
           {r("CASE WHEN sd > 0.000001 THEN (within - between) / sd END")} AS effect_size, {r("lowest")} AS min_pairwise,
           {r("p_value")} AS p_value, n_perms, within IS NULL OR between IS NULL AS insufficient_data FROM z, e""")
def mantel_gap(t):
    """Group similarity test with effect size; p without the +1."""
    pairs = materialize(quarter_pairs(t), "pairs")
    units = V.pair_units(pairs, ["year", "quarter"])
    out = S.label_gap_test(pairs, units, ["year", "quarter"], "year", "similarity", N_PERMS, plus_one=False)
    return out.select(
        rounded("observed_gap").alias("observed_gap"), rounded("within").alias("mean_within"),
        rounded("between").alias("mean_between"), rounded("effect_size").alias("effect_size"),
        rounded("min_pairwise").alias("min_pairwise"), rounded("p_value").alias("p_value"), "n_perms", "insufficient_data")


@query("effect_label", _label_gap_sql("year", 0) + f"""
    SELECT CASE WHEN p_value IS NULL OR sd IS NULL OR sd <= 0.000001 THEN 'insufficient_data' WHEN p_value >= 0.05 THEN 'not_significant'
                WHEN abs((within - between) / sd) >= 0.8 THEN 'large' WHEN abs((within - between) / sd) >= 0.5 THEN 'medium'
                WHEN abs((within - between) / sd) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect,
           lowest >= 0.95 AS near_ceiling FROM z, e""")
def effect_label(t):
    """Label of the effect size, and a flag for similarities near their ceiling."""
    pairs = materialize(quarter_pairs(t), "pairs")
    units = V.pair_units(pairs, ["year", "quarter"])
    out = S.label_gap_test(pairs, units, ["year", "quarter"], "year", "similarity", N_PERMS, plus_one=False)
    return out.select(M.effect_label("p_value", "effect_size").alias("effect"),
                      (F.col("min_pairwise") >= 0.95).alias("near_ceiling"))


# pairs with transfer accuracy
_PT_SQL = f"""
    WITH qv AS MATERIALIZED ({_QVEC_SQL}), p AS MATERIALIZED ({_PAIRS_SQL}), c AS MATERIALIZED ({X.CELLS_SQL}),
    pt AS MATERIALIZED (SELECT p.*, (a_quarter = b_quarter)::INTEGER AS same_season, (a_year = b_year)::INTEGER AS same_year,
                  (x.r2 + y.r2) / 2 AS transfer FROM p
           JOIN c x ON x.model_year = a_year AND x.model_quarter = a_quarter AND x.eval_year = b_year AND x.eval_quarter = b_quarter
           JOIN c y ON y.model_year = b_year AND y.model_quarter = b_quarter AND y.eval_year = a_year AND y.eval_quarter = a_quarter)"""


def _corr_sql(where: str = "TRUE", x: str = "sim", y: str = "transfer", src: str = "pt") -> str:
    return f"SELECT covar_pop({x}, {y}) / nullif(sqrt(var_pop({x}) * var_pop({y})), 0) AS rr, count(*) AS n_pairs FROM {src} WHERE {where}"


def _resid_sql(y: str) -> str:
    """Residuals of y on two 0/1 controls: the second control is first cleared of the first."""
    return f"""SELECT *, {y} - avg({y}) OVER () - b1 * (same_season - avg(same_season) OVER ()) - b2 * w AS {y}_r FROM (
        SELECT *, covar_pop({y}, same_season) OVER () / var_pop(same_season) OVER () AS b1, covar_pop({y}, w) OVER () / var_pop(w) OVER () AS b2 FROM cw)"""


@query("partial_corr", _PT_SQL + f""",
    cw AS MATERIALIZED (SELECT *, same_year - avg(same_year) OVER () - covar_pop(same_year, same_season) OVER () / var_pop(same_season) OVER ()
                     * (same_season - avg(same_season) OVER ()) AS w FROM pt),
    rs AS (SELECT s.sim_r, t.transfer_r FROM ({_resid_sql("sim")}) s JOIN ({_resid_sql("transfer")}) t USING (a_year, a_quarter, b_year, b_quarter)),
    al AS (SELECT 'overall' AS "group", * FROM ({_corr_sql()})
           UNION ALL SELECT 'same_season', * FROM ({_corr_sql("same_season = 1")})
           UNION ALL SELECT 'different_season', * FROM ({_corr_sql("same_season = 0")})
           UNION ALL SELECT 'partial_controlling_for_season_and_year', * FROM ({_corr_sql(x="sim_r", y="transfer_r", src="rs")}))
    SELECT "group", {r("rr")} AS pearson_r, n_pairs, {r("rr * sqrt(n_pairs - 2) / sqrt(1 - rr * rr)", 5)} AS t FROM al""")
def partial_corr(t):
    """Does similarity predict transfer beyond season and year? Plain, grouped and partial r."""
    pairs = V.pair_flags(quarter_pairs(t)).withColumnsRenamed(
        {f"{s}_{u}": f"model_{s}_{u}" for s in "ab" for u in ("year", "quarter")})
    sym = C.symmetrize_pairs(pairs, X.cells(t), "r2")
    out = S.transfer_correlations(materialize(sym, "pairs"), "similarity", "pair_transfer_r2")
    return out.select("group", rounded("pearson_r").alias("pearson_r"), "n_pairs", rounded("t", 5).alias("t"))


# --- bootstrap -----------------------------------------------------------------------------

_CELL_ROWS = f"SELECT year, quarter, l_orderkey, l_linenumber, l_partkey, l_suppkey, label AS y, pred AS f FROM ({X.PRED_SQL})"


@query("bootstrap_r2")
def bootstrap_r2(t):
    """Bootstrap interval of R2 per period: exact draws with replacement; tested against brute force on a fixture."""
    out = B.bootstrap_r2(X.predictions(t), ["year", "quarter"], X.LINE_KEY, "label", "pred", N_BOOT)
    return out.select("year", "quarter", *[rounded(c).alias(c) for c in ("r2_boot_mean", "r2_boot_std", "ci_lower", "ci_upper")], "n_boot")


_LIMITS = [min(math.ceil(c * 2**32), 2**32 - 1) for c in B.POISSON_CDF]
_POISSON = "CASE " + " ".join(f"WHEN u < {c} THEN {k}" for k, c in enumerate(_LIMITS)) + f" ELSE {len(_LIMITS)} END"


def _mix_sql(src: str, x: str) -> str:
    """``src`` with u = the scrambled 32-bit number ``x``, as in ``bootstrap.poisson_weights``."""
    one = f"SELECT * REPLACE (xor(u, u >> 16) * {B.MIX[1]}::UBIGINT % 4294967296 AS u) FROM (SELECT *, ({x})::UBIGINT AS u FROM {src})"
    two = f"SELECT * REPLACE (xor(u, u >> 13) * {B.MIX[2]}::UBIGINT % 4294967296 AS u) FROM ({one})"
    return f"SELECT * REPLACE (xor(u, u >> 16) AS u) FROM ({two})"


@query("bootstrap_r2_poisson", f"""
    WITH h AS MATERIALIZED (SELECT year, quarter, y, f, y - avg(y) OVER (PARTITION BY year, quarter) AS z,
               ('0x' || substr(d, 1, 8))::UBIGINT AS h1, ('0x' || substr(d, 9, 8))::UBIGINT AS h2
          FROM (SELECT *, md5('0:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey) AS d FROM ({_CELL_ROWS}))),
    a AS ({_mix_sql(f"h, range(1, {N_BOOT} + 1) t(rep)", f"(h1 + rep * {B.MIX[0]}) % 4294967296")}),
    b AS ({_mix_sql("(SELECT * EXCLUDE (u), u AS u1 FROM a)", "xor(u1, h2)")}),
    s AS (SELECT year, quarter, rep, 1 - sum(w * (y - f) * (y - f)) / nullif(sum(w * z * z) - power(sum(w * z), 2) / sum(w), 0) AS r2
          FROM (SELECT *, {_POISSON} AS w FROM b) WHERE w > 0 GROUP BY ALL)
    SELECT year, quarter, {r("avg(r2)")} AS r2_boot_mean, {r("coalesce(stddev_samp(r2), 0)")} AS r2_boot_std,
           {r("quantile_cont(r2, 0.025)")} AS ci_lower, {r("quantile_cont(r2, 0.975)")} AS ci_upper, count(r2) AS n_boot FROM s GROUP BY ALL""")
def bootstrap_r2_poisson(t):
    """The same interval with Poisson weights: rows are not shuffled."""
    out = B.bootstrap_r2_poisson(X.predictions(t), ["year", "quarter"], X.LINE_KEY, "label", "pred", N_BOOT)
    return out.select("year", "quarter", *[rounded(c).alias(c) for c in ("r2_boot_mean", "r2_boot_std", "ci_lower", "ci_upper")], "n_boot")


# --- regressions on cells ------------------------------------------------------------------


def _gap_rows(t):
    return materialize(C.gap_table(C.off_diagonal(X.cells(t)), X.periods(t), X.METRICS), "gaps")


_GAPS = f"WITH gp AS MATERIALIZED (SELECT * FROM ({X.GAP_SQL}) WHERE {OFF})"


@query("ols_two_var", _GAPS + f""",
    s AS (SELECT count(*) AS n, avg(r2) AS my, avg(diff_ndvi) AS m1, avg(abs_diff_ndvi) AS m2,
                 count(*) * var_pop(r2) AS syy, count(*) * var_pop(diff_ndvi) AS s11, count(*) * var_pop(abs_diff_ndvi) AS s22,
                 count(*) * covar_pop(diff_ndvi, abs_diff_ndvi) AS s12, count(*) * covar_pop(diff_ndvi, r2) AS s1y,
                 count(*) * covar_pop(abs_diff_ndvi, r2) AS s2y FROM gp),
    b AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM s),
    c AS (SELECT *, (s22 * s1y - s12 * s2y) / det AS b1, (s11 * s2y - s12 * s1y) / det AS b2 FROM b),
    e AS (SELECT *, syy - b1 * s1y - b2 * s2y AS ssr, my - b1 * m1 - b2 * m2 AS b0 FROM c),
    f AS (SELECT *, ssr / (n - 3) AS s2, 1 - ssr / syy AS rr, -n / 2.0::DOUBLE * (ln(2 * pi()) + ln(ssr / n) + 1) AS llf FROM e),
    w AS (SELECT 'const' AS term, b0 AS coef, sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS se, * FROM f
          UNION ALL SELECT 'diff_ndvi', b1, sqrt(s2 * s22 / det), * FROM f
          UNION ALL SELECT 'abs_diff_ndvi', b2, sqrt(s2 * s11 / det), * FROM f)
    SELECT term, {r("coef")} AS coef, {r("se")} AS std_err, {r("coef / se", 4)} AS t, {r("rr")} AS r_squared,
           {r("1 - (1 - rr) * (n - 1) / (n - 3)")} AS adj_r_squared, {r("6 - 2 * llf", 3)} AS aic, {r("3 * ln(n) - 2 * llf", 3)} AS bic, n AS n_obs FROM w""")
def ols_two_var(t):
    """Cell accuracy on a metric's gap and absolute gap."""
    out = G.ols(_gap_rows(t), "r2", ["diff_ndvi", "abs_diff_ndvi"])
    return out.select("term", rounded("coef").alias("coef"), rounded("std_err").alias("std_err"), rounded("t", 4).alias("t"),
                      rounded("r_squared").alias("r_squared"), rounded("adj_r_squared").alias("adj_r_squared"),
                      rounded("aic", 3).alias("aic"), rounded("bic", 3).alias("bic"), "n_obs")


@query("season_pair_r2", _GAPS + f""",
    k AS (SELECT season_pair, count(*) AS k, avg(r2) AS m FROM gp GROUP BY 1),
    s AS (SELECT count(*) AS n, sum((r2 - m) * (r2 - m)) AS ssw, count(*) * var_pop(r2) AS sst, (SELECT count(*) FROM k) AS levels
          FROM gp JOIN k USING (season_pair))
    SELECT levels, n AS n_obs, {r("1 - ssw / sst")} AS r_squared, {r("1 - ssw / sst * (n - 1) / (n - levels)")} AS adj_r_squared FROM s""")
def season_pair_r2(t):
    """Accuracy explained by season-pair dummies alone: group means, no solve."""
    g = X.cells(t)
    return _dummy_fit(C.gap_flags(C.off_diagonal(g)), "r2", "season_pair").select(
        "levels", "n_obs", rounded("r_squared").alias("r_squared"), rounded("adj_r_squared").alias("adj_r_squared"))


def _dummy_fit(df, y, factor):
    level = df.groupBy(factor).agg(F.count(y).alias("k"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    total = level.agg(
        F.count(F.lit(1)).alias("levels"), F.sum("k").alias("n_obs"), F.sum(F.col("k") * F.col("v")).alias("ssw"),
        F.expr("sum(k * v) + sum(k * m * m) - sum(k * m) * sum(k * m) / sum(k)").alias("sst"))
    left = F.try_divide(F.col("ssw"), F.col("sst"))
    return total.select("levels", "n_obs", (1 - left).alias("r_squared"),
                        (1 - left * (F.col("n_obs") - 1) / (F.col("n_obs") - F.col("levels"))).alias("adj_r_squared"))


def _r2_two(a, b):
    return _R2_TWO.format(a=a, b=b, y="r2")


@query("best_model", _GAPS + f""",
    f AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, 'rs_gap' AS model, {_r2_two(f'diff_{m}', f'abs_diff_{m}')} AS rr, 3 AS k, count(*) AS n FROM gp" for m in X.METRICS)}
          UNION ALL SELECT metric, 'season_year_dummies', {_r2_two("same_season", "same_year")}, 3, count(*) FROM gp, (SELECT unnest({X.METRICS}) AS metric) GROUP BY metric
          UNION ALL SELECT metric, 'season_pair_dummies', 1 - sum((r2 - m) * (r2 - m)) / (count(*) * var_pop(r2)), count(DISTINCT season_pair), count(*)
                    FROM gp JOIN (SELECT season_pair, avg(r2) AS m FROM gp GROUP BY 1) USING (season_pair), (SELECT unnest({X.METRICS}) AS metric) GROUP BY metric),
    a AS (SELECT metric, model, 1 - (1 - rr) * (n - 1) / (n - k) AS adj FROM f)
    SELECT metric, arg_max(model, adj) AS best, {r("max(adj)")} AS adj_r_squared FROM a GROUP BY metric""")
def best_model(t):
    """Best of three rival models per metric by adjusted R2, all on the same rows."""
    g = _gap_rows(t).withColumns({c: F.col(c).cast("double") for c in ("same_season", "same_year")})
    fits = None
    for m in X.METRICS:
        rows = g.dropna(subset=[f"diff_{m}", f"abs_diff_{m}", "r2"])
        for label, part in (
            ("rs_gap", G.ols(rows, "r2", [f"diff_{m}", f"abs_diff_{m}"]).select("adj_r_squared").distinct()),
            ("season_year_dummies", G.ols(rows, "r2", ["same_season", "same_year"]).select("adj_r_squared").distinct()),
            ("season_pair_dummies", _dummy_fit(rows, "r2", "season_pair").select("adj_r_squared")),
        ):
            part = part.select(F.lit(m).alias("metric"), F.lit(label).alias("model"), "adj_r_squared")
            fits = part if fits is None else fits.unionByName(part)
    return fits.groupBy("metric").agg(F.max_by("model", "adj_r_squared").alias("best"),
                                      rounded(F.max("adj_r_squared")).alias("adj_r_squared"))


_ALL_GAPS = [f"{p}_{m}" for m in X.METRICS for p in ("diff", "abs_diff")]


@query("ols_joint")
def ols_joint(t):
    """All metrics in one model (coefficients with p-values)."""
    return G.ols(_gap_rows(t), "r2", _ALL_GAPS)


def sweep_sql(src: str, y: str, xs: list[str], group: str = "") -> tuple[str, str]:
    """CTEs that clear y and later columns of each x in turn; the last one holds ``y_<k>``."""
    over = f"OVER ({f'PARTITION BY {group}' if group else ''})"
    keep = f", {group}" if group else ""
    ctes, names = [], [y, *xs]
    ctes.append(f"w0 AS MATERIALIZED (SELECT {', '.join(f'{c} - avg({c}) {over} AS c{i}' for i, c in enumerate(names))}, r2 AS raw{keep} FROM {src})")
    for k in range(1, len(names)):
        rest = [0, *range(k + 1, len(names))]
        ctes.append(f"w{k} AS MATERIALIZED (SELECT {', '.join(f'c{i} - c{k} * (sum(c{i} * c{k}) OVER () / sum(c{k} * c{k}) OVER ()) AS c{i}' for i in rest)}, raw FROM w{k - 1})")
    return ", ".join(ctes), f"w{len(names) - 1}"


@query("ols_joint_r2", _GAPS + ", " + sweep_sql("gp", "r2", _ALL_GAPS)[0] + f"""
    SELECT {r(f"1 - sum(c0 * c0) / (count(*) * var_pop(raw))")} AS r_squared, count(*) AS n_obs FROM w{len(_ALL_GAPS)}""")
def ols_joint_r2(t):
    """R2 of the joint model of all metrics."""
    out = G.ols(_gap_rows(t), "r2", _ALL_GAPS)
    return out.filter("term = 'const'").select(rounded("r_squared").alias("r_squared"), "n_obs")


def _joint_sql() -> str:
    """One coefficient at a time: the other columns are cleared from it and from the label, the rest is a line."""
    parts = []
    for x in _ALL_GAPS:
        ctes, last = sweep_sql("gp", "r2", [*[o for o in _ALL_GAPS if o != x], x])
        k = len(_ALL_GAPS)
        parts.append(f"""SELECT '{x}' AS term, * FROM (WITH {ctes}
            SELECT sum(a.c0 * a.c{k}) / sum(a.c{k} * a.c{k}) AS b, (sum(a.c0 * a.c0) - power(sum(a.c0 * a.c{k}), 2) / sum(a.c{k} * a.c{k})) / (count(*) - {k + 1}) AS s2,
                   sum(a.c{k} * a.c{k}) AS sxx, count(*) AS n FROM w{k - 1} a)""")
    return _GAPS + f", f AS ({' UNION ALL '.join(parts)})"


@query("ols_joint_coefs", _joint_sql() + f"""
    SELECT term, {r("b")} AS coef, {r("sqrt(s2 / sxx)")} AS std_err, {r("b / sqrt(s2 / sxx)", 4)} AS t, n AS n_obs FROM f""")
def ols_joint_coefs(t):
    """Coefficients and errors of the joint model of all metrics."""
    out = G.ols(_gap_rows(t), "r2", _ALL_GAPS).filter("term <> 'const'")
    return out.select("term", rounded("coef").alias("coef"), rounded("std_err").alias("std_err"), rounded("t", 4).alias("t"), "n_obs")


_BLOCKS = [("quality", [f"{p}_{m}" for m in ("cloud_frac", "valid_obs_frac") for p in ("diff", "abs_diff")]),
           ("quality+season_pair", []), ("quality+season_pair+ndvi", ["diff_ndvi", "abs_diff_ndvi"])]


def _nested_sql() -> str:
    q, l = _BLOCKS[0][1], _BLOCKS[2][1]
    def part(no, name, xs, group):
        ctes, last = sweep_sql("gp", "r2", xs, group)
        return (f"SELECT {no} AS block_no, '{name}' AS block, * FROM (WITH {ctes} "
                f"SELECT 1 - sum(c0 * c0) / (count(*) * var_pop(raw)) AS rr, count(*) AS n FROM {last})")
    return _GAPS + f""", f AS ({part(0, _BLOCKS[0][0], q, '')} UNION ALL {part(1, _BLOCKS[1][0], q, 'season_pair')}
        UNION ALL {part(2, _BLOCKS[2][0], q + l, 'season_pair')})
    SELECT block, {r("rr")} AS r_squared, {r("rr - coalesce(lag(rr) OVER (ORDER BY block_no), 0)")} AS r_squared_added, n AS n_obs FROM f"""


@query("ols_sequential", _nested_sql())
def ols_sequential(t):
    """Quality gaps, then season pairs, then the landscape gap: R2 and what each block adds."""
    out = G.nested_r2(_gap_rows(t), "r2", _BLOCKS, "season_pair", dummies_after=1)
    return out.select("block", rounded("r_squared").alias("r_squared"), rounded("r_squared_added").alias("r_squared_added"), "n_obs")


def _sequential_sql() -> str:
    q = _BLOCKS[0][1]
    names = ["r2", *q]
    steps = [f"w0 AS MATERIALIZED (SELECT {X.CELL_KEY}, season_pair, r2 AS raw, "
             + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY season_pair) AS c{i}" for i, c in enumerate(names)) + " FROM gp)"]
    for k in range(1, len(names)):
        done, rest = list(range(1, k + 1)), [0, *range(k + 1, len(names))]
        steps.append(
            f"w{k} AS MATERIALIZED (SELECT {X.CELL_KEY}, season_pair, raw, " + ", ".join(f"c{i}" for i in done) + ", "
            + ", ".join(f"c{i} - c{k} * (sum(c{i} * c{k}) OVER () / sum(c{k} * c{k}) OVER ()) AS c{i}" for i in rest) + f" FROM w{k - 1})")
    n = len(q)
    ctl = range(1, n + 1)
    cleared = {f"{u}{v}": f"(sum({u}c * {v}c) - (" + " + ".join(f"sum({u}c * c{j}) * sum({v}c * c{j}) / sum(c{j} * c{j})" for j in ctl) + "))"
               for u, v in ("dd", "aa", "da")}
    units = f"SELECT year, quarter, ndvi AS val FROM ({X.PERIODS_SQL})"
    return _GAPS + f""", {", ".join(steps)}, {perm_sql(units, within="quarter", cols="year")},
    f AS (SELECT a.i, w.*, b.val - a.val AS d, abs(b.val - a.val) AS a FROM w{n} w
          JOIN m a ON a.year = model_year AND a.quarter = model_quarter JOIN m b ON b.i = a.i AND b.year = eval_year AND b.quarter = eval_quarter),
    h AS (SELECT *, d - avg(d) OVER (PARTITION BY i, season_pair) AS dc, a - avg(a) OVER (PARTITION BY i, season_pair) AS ac FROM f),
    t AS (SELECT i, sum(dc * c0) AS dy, sum(ac * c0) AS ay, {cleared['dd']} AS dd, {cleared['aa']} AS aa, {cleared['da']} AS da, count(*) * var_pop(raw) AS sst FROM h GROUP BY i),
    g AS (SELECT i, (dy * dy * aa - 2 * dy * ay * da + ay * ay * dd) / (dd * aa - da * da) / sst AS v FROM t),
    {null_sql()}
    SELECT {r("obs")} AS observed_r2_added, {r("null_mean")} AS null_mean, {r("null_95pct")} AS null_95pct, {r("p_value")} AS p_value,
           (SELECT count(*) FROM gp) AS n_obs, n_perms FROM z"""


@query("sequential_perm", _sequential_sql())
def sequential_perm(t):
    """Landscape values permuted over years within each quarter; R2 added by the last block."""
    out = S.sequential_test(_gap_rows(t), materialize(X.periods(t), "periods"), "r2", _BLOCKS[0][1], "season_pair", "ndvi", N_PERMS)
    return out.select(*[rounded(c).alias(c) for c in ("observed_r2_added", "null_mean", "null_95pct", "p_value")], "n_obs", "n_perms")


# --- penalty regression --------------------------------------------------------------------

_ERR_SQL = f"""
    WITH ln AS (SELECT quarter AS train_quarter, avg(label) - covar_pop(quantity, label) / var_pop(quantity) * avg(quantity) AS a,
                       covar_pop(quantity, label) / var_pop(quantity) AS b FROM ({X.PRED_SQL}) GROUP BY 1),
    er AS MATERIALIZED (SELECT l_partkey AS key, year(l_shipdate)::INTEGER AS year, train_quarter, quarter(l_shipdate)::INTEGER AS eval_quarter,
                  avg(abs(l_extendedprice - a - b * l_quantity)) AS error
           FROM lineitem, ln WHERE (train_quarter, quarter(l_shipdate)) IN ((1,1),(1,2),(1,3),(1,4),(2,2),(3,3),(4,4),(3,1)) GROUP BY ALL),
    pn AS MATERIALIZED (SELECT key, year, max(error) FILTER (WHERE train_quarter = 1) - max(error) FILTER (WHERE train_quarter = 3) AS penalty
           FROM er WHERE eval_quarter = 3 GROUP BY ALL HAVING penalty IS NOT NULL),
    ft AS MATERIALIZED (SELECT l_partkey AS key, avg((l_tax < 0.03)::INTEGER) AS tree_cover FROM lineitem GROUP BY 1)"""


def errors(t):
    """Mean absolute error per (part, year, train quarter, eval quarter) on the required cells."""
    p = t.lineitem.select(F.col("l_partkey").alias("key"), F.year("l_shipdate").alias("year"),
                          F.quarter("l_shipdate").alias("eval_quarter"), "l_extendedprice", "l_quantity")
    lines = A.line_moments(X.predictions(t), ["quarter"], "quantity", "label").select(
        F.col("quarter").alias("train_quarter"), F.try_divide("cxy", "vx").alias("b"), "mx", "my")
    cells = t.spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("train_quarter"), F.lit(b).alias("eval_quarter")) for a, b in REQUIRED_CELLS])).alias("c")).select("c.*")
    fitted = cells.join(lines, "train_quarter")
    err = F.abs(F.col("l_extendedprice") - F.col("my") - F.col("b") * (F.col("l_quantity") - F.col("mx")))
    # eight lines, one per required cell
    return p.join(F.broadcast(fitted), "eval_quarter").groupBy("key", "year", "train_quarter", "eval_quarter").agg(
        F.avg(err).alias("error"))


CLASSES = ["tree_cover", "cropland", "grassland", "built_up"]


def land_cover(t):
    def share(cond):
        return F.avg(cond.cast("int"))

    x = F.col("l_tax")
    return t.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(
        share(x < 0.03).alias("tree_cover"), share((x >= 0.03) & (x < 0.045)).alias("cropland"),
        share((x >= 0.045) & (x < 0.065)).alias("grassland"), share(x >= 0.065).alias("built_up"))


@query("cluster_ols", _ERR_SQL + f""",
    d AS MATERIALIZED (SELECT key, year, penalty - avg(penalty) OVER (PARTITION BY year) AS y, tree_cover - avg(tree_cover) OVER (PARTITION BY year) AS x,
                 penalty, tree_cover FROM pn JOIN ft USING (key)),
    b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT key) AS g, count(DISTINCT year) + 1 AS k,
                 stddev_samp(tree_cover) / stddev_samp(penalty) AS ratio, count(*) * var_pop(penalty) AS sst FROM d),
    s AS (SELECT key, sum(x * (y - b * x)) AS s, sum((y - b * x) * (y - b * x)) AS ssr FROM d, b GROUP BY key),
    m AS (SELECT sum(s * s) AS meat, sum(ssr) AS ssr FROM s)
    SELECT 'tree_cover' AS term, {r("b", 4)} AS coef, {r("sqrt(meat / sxx / sxx * g / (g - 1) * (n - 1) / (n - k))", 4)} AS se,
           {r("b * ratio")} AS standardized, n, g AS n_clusters, k::INTEGER AS n_params, {r("1 - ssr / sst")} AS r2, g < 30 AS low_cluster_count FROM b, m""")
def cluster_ols(t):
    """Penalty on one land-cover share and year dummies, errors clustered by key."""
    pen = G.transfer_penalty(errors(t), 1, 3).join(land_cover(t).select("key", "tree_cover"), "key")
    out = G.cluster_ols(pen, "penalty", ["tree_cover"], "year", "key")
    return out.select("term", rounded("coef", 4).alias("coef"), rounded("se", 4).alias("se"), rounded("standardized").alias("standardized"),
                      "n", "n_clusters", "n_params", rounded("r2").alias("r2"), "low_cluster_count")


@query("penalty_suite")
def penalty_suite(t):
    """Dose-response, main, urban, reverse and amplitude penalty regressions with all controls."""
    err = materialize(errors(t), "errors")
    feats = materialize(land_cover(t), "landcover")
    reference = reference_class(feats, CLASSES, exclude=["tree_cover", "built_up"]).first()["reference_class"]
    v, q = F.col("l_quantity") / 50, F.quarter("l_shipdate")
    amplitude = t.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(
        (F.avg(F.when(q == 3, v)) - F.avg(F.when(q == 1, v))).alias("amplitude"))
    return G.penalty_suite(err, feats, "tree_cover", CLASSES, reference, urban="built_up", urban_threshold=0.3,
                           amplitude=materialize(amplitude, "amplitude"))


def _dose_sql(ev: int) -> str:
    """Year means, then the controls, are cleared from penalty and primary; the rest is a line."""
    names = ["penalty", "cropland", "built_up", "tree_cover"]
    return f"""SELECT {ev} AS ev, * FROM (
        WITH d AS (SELECT key, year, penalty, tree_cover, cropland, built_up FROM (
                 SELECT key, year, max(error) FILTER (WHERE train_quarter = 1) - max(error) FILTER (WHERE train_quarter = {ev}) AS penalty
                 FROM er WHERE eval_quarter = {ev} GROUP BY ALL HAVING penalty IS NOT NULL) JOIN fc USING (key)),
        w0 AS MATERIALIZED (SELECT key, year, {", ".join(f"{c} - avg({c}) OVER (PARTITION BY year) AS c{i}" for i, c in enumerate(names))} FROM d),
        w1 AS MATERIALIZED (SELECT key, year, {", ".join(f"c{i} - c1 * (sum(c{i} * c1) OVER () / sum(c1 * c1) OVER ()) AS c{i}" for i in (0, 2, 3))} FROM w0),
        w2 AS MATERIALIZED (SELECT key, year, {", ".join(f"c{i} - c2 * (sum(c{i} * c2) OVER () / sum(c2 * c2) OVER ()) AS c{i}" for i in (0, 3))} FROM w1),
        b AS (SELECT sum(c3 * c0) / sum(c3 * c3) AS b, sum(c3 * c3) AS sxx, count(*) AS n, count(DISTINCT key) AS g, count(DISTINCT year) + 3 AS k FROM w2),
        s AS (SELECT key, sum(c3 * (c0 - b * c3)) AS s FROM w2, b GROUP BY key)
        SELECT any_value(b) AS coef, sqrt(sum(s * s)) / any_value(sxx) * sqrt(any_value(g) / (any_value(g) - 1) * (any_value(n) - 1) / (any_value(n) - any_value(k))) AS se,
               any_value(n) AS n FROM s, b)"""


@query("dose_response", _ERR_SQL + f""",
    fc AS MATERIALIZED (SELECT l_partkey AS key, avg((l_tax < 0.03)::INTEGER) AS tree_cover, avg((l_tax >= 0.03 AND l_tax < 0.045)::INTEGER) AS cropland,
                               avg((l_tax >= 0.065)::INTEGER) AS built_up FROM lineitem GROUP BY 1),
    r AS ({" UNION ALL ".join(_dose_sql(ev) for ev in (2, 3, 4))})
    SELECT 'Q1->Q' || ev AS transfer, (ev - 1)::INTEGER AS distance_quarters, {r("coef", 3)} AS coef, {r("se", 3)} AS se,
           {r("coef - 1.959963984540054 * se", 3)} AS ci_lower, {r("coef + 1.959963984540054 * se", 3)} AS ci_upper, n,
           abs(coef) > 1.959963984540054 * se AS significant FROM r""")
def dose_response(t):
    """Coefficient of the primary share by transfer distance, all controls, clustered interval."""
    out = G.dose_response(materialize(errors(t), "errors"), materialize(land_cover(t), "landcover"), "tree_cover", CLASSES, "grassland")
    return out.select("transfer", "distance_quarters", *[rounded(c, 3).alias(c) for c in ("coef", "se", "ci_lower", "ci_upper")],
                      "n", "significant")


@query("direction_note", _ERR_SQL + f""",
    d AS MATERIALIZED (SELECT key, year, penalty - avg(penalty) OVER (PARTITION BY year) AS y, tree_cover - avg(tree_cover) OVER (PARTITION BY year) AS x
          FROM pn JOIN ft USING (key)),
    b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT key) AS g, count(DISTINCT year) + 1 AS k FROM d),
    s AS (SELECT key, sum(x * (y - b * x)) AS s FROM d, b GROUP BY key),
    z AS (SELECT any_value(b) AS coef, any_value(b) / sqrt(sum(s * s) / any_value(sxx) / any_value(sxx) * any_value(g) / (any_value(g) - 1)
                 * (any_value(n) - 1) / (any_value(n) - any_value(k))) AS z FROM s, b)
    SELECT 'tree_cover' AS term, CASE WHEN abs(z) < 1.959963984540054 THEN 'no support' WHEN coef > 0 THEN 'consistent' ELSE 'opposite' END AS note FROM z""")
def direction_note(t):
    """Sign-aware reading of the penalty coefficient."""
    pen = G.transfer_penalty(errors(t), 1, 3).join(land_cover(t).select("key", "tree_cover"), "key")
    out = G.cluster_ols(pen, "penalty", ["tree_cover"], "year", "key")
    return out.select("term", M.direction_note("coef", "p").alias("note"))


@query("svd_share")
def svd_share(t):
    """Share of the squared Frobenius norm in each singular component of the centred matrix."""
    return V.svd_share(_cells(t), "r2")


def power_sql(rows: str, steps: int) -> str:
    """CTEs ending in ``z`` (share): the largest eigenvalue of the Gram matrix of ``rows`` (k, x: list) over its trace,
    by power iteration."""
    return f"""x AS MATERIALIZED ({rows}),
    g AS MATERIALIZED (SELECT list(v ORDER BY i) AS m, sum(v[i]) AS trace FROM (
        SELECT a.k AS i, list(list_dot_product(a.x, b.x) ORDER BY b.k) AS v FROM x a, x b GROUP BY a.k)),
    w(n, v, size) AS (SELECT 0, list_transform(range(1, len(m) + 1), lambda i: 1.0::DOUBLE + sin(i)), 1.0::DOUBLE FROM g
        UNION ALL SELECT n + 1, list_transform(u, lambda e: e / sqrt(list_dot_product(u, u))), sqrt(list_dot_product(u, u))
        FROM (SELECT n, list_transform(m, lambda row: list_dot_product(row, v)) AS u FROM w, g WHERE n < {steps})),
    z AS (SELECT size / trace AS share FROM w, g WHERE n = {steps})"""


@query("svd_first_share", f"""
    WITH RECURSIVE c AS ({X.CELLS_SQL}), {power_sql("SELECT row_number() OVER (ORDER BY model_year, model_quarter) AS k, list(r2 - (SELECT avg(r2) FROM c) ORDER BY eval_year, eval_quarter) AS x FROM c GROUP BY model_year, model_quarter", 2000)}
    SELECT {r("share")} AS share FROM z""")
def svd_first_share(t):
    """Share of the first singular component."""
    return V.svd_share(_cells(t), "r2").filter("component = 1").select(rounded("share").alias("share"))
