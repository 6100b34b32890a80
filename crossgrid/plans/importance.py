"""Feature importance, swap recovery and summary-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrid.functions import ids
from crossgrid.operators import accuracy as A, importance as I, recovery as RC, regress as G, resample as S, vectors as V
from crossgrid.plans import fixtures as X, inference as N
from crossgrid.plans.registry import query, r
from crossgrid.session import materialize, rounded

CELL = ["year", "quarter"]
SETS = {"quantity": ("quantity",), "discount": ("discount",), "tax": ("tax",), "terms": ("quantity", "discount")}
REPEATS = 5


def _score(c):
    return 1500.0 * c["quantity"] * (1.0 - c["discount"])


def _panel(t):
    return I.permutation_importance(X.predictions(t), CELL, X.LINE_KEY, "label", ["quantity", "discount", "tax"], SETS, _score, REPEATS)


_KEY = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"


def _metrics_sql(f: str, s: str) -> str:
    return (f"1 - avg((label - {f}) * (label - {f})) / nullif(var_pop(label), 0) AS r2_{s}, avg(abs(label - {f})) AS mae_{s}, "
            f"covar_pop(label, {f}) / nullif(sqrt(var_pop(label) * var_pop({f})), 0) AS r_{s}")


def _sets_sql(method: str, src: str, extra: str) -> str:
    parts = []
    for name, cols in SETS.items():
        q = "pq" if "quantity" in cols else "quantity"
        d = "pd" if "discount" in cols else "discount"
        kind = method if len(cols) == 1 or method == "mean_ablation" else f"group_{method}"
        parts.append(f"SELECT year, quarter, {extra} '{kind}' AS method, '{'band' if len(cols) == 1 else 'group'}' AS unit, '{name}' AS feature, "
                     f"count(*) AS n_test, {_metrics_sql('pred', 'base')}, "
                     f"{_metrics_sql(f'(1500.0::DOUBLE * {q} * (1.0::DOUBLE - {d}))', 'pert')} FROM {src} GROUP BY ALL")
    return " UNION ALL ".join(parts)


_PANEL_SQL = f"""
    p AS MATERIALIZED ({X.PRED_SQL}),
    src AS (SELECT year, quarter, quantity AS pq, discount AS pd, row_number() OVER (PARTITION BY year, quarter ORDER BY md5('src:' || {_KEY})) AS place FROM p),
    dst AS (SELECT p.*, repeat::INTEGER AS repeat, row_number() OVER (PARTITION BY year, quarter, repeat ORDER BY md5('0:' || repeat || ':' || {_KEY})) AS place
            FROM p, range(0, {REPEATS}) t(repeat)),
    jn AS MATERIALIZED (SELECT * FROM dst JOIN src USING (year, quarter, place)),
    panel AS MATERIALIZED (SELECT *, r2_base - r2_pert AS delta_r2, mae_pert - mae_base AS delta_mae FROM ({_sets_sql("permutation", "jn", "repeat,")}))"""

_OUT = ["r2_base", "r2_pert", "delta_r2", "r_base", "r_pert"]
_OUT4 = ["mae_base", "mae_pert", "delta_mae"]
_COLS = ", ".join([f"{r(c)} AS {c}" for c in _OUT] + [f"{r(c, 4)} AS {c}" for c in _OUT4])


def _shown(df):
    return df.withColumns({**{c: rounded(c) for c in _OUT}, **{c: rounded(c, 4) for c in _OUT4}})


@query("permutation_importance", f"""
    WITH {_PANEL_SQL} SELECT year, quarter, repeat, method, unit, feature, n_test, {_COLS} FROM panel""")
def permutation_importance(t):
    """Drop in accuracy per feature and feature group when shuffled within its cell."""
    return _shown(_panel(t))


@query("mean_ablation", f"""
    WITH p AS MATERIALIZED ({X.PRED_SQL}), jn AS MATERIALIZED (SELECT p.*, pq, pd FROM p JOIN
        (SELECT year, quarter, avg(quantity) AS pq, avg(discount) AS pd FROM p GROUP BY 1, 2) USING (year, quarter))
    SELECT year, quarter, 0::INTEGER AS repeat, method, unit, feature, n_test, {_COLS}
    FROM (SELECT *, r2_base - r2_pert AS delta_r2, mae_pert - mae_base AS delta_mae FROM ({_sets_sql("mean_ablation", "jn", "")}))""")
def mean_ablation(t):
    """Drop in accuracy when a feature takes its cell mean."""
    out = I.mean_ablation(X.predictions(t), CELL, "label", ["quantity", "discount", "tax"], SETS, _score)
    return _shown(out)


_SUM_SQL = """
    su AS MATERIALIZED (SELECT year, quarter, method, unit, feature, avg(delta_r2) AS delta_r2_mean, stddev_samp(delta_r2) AS delta_r2_std,
                  avg(delta_mae) AS delta_mae_mean, min(r2_base) AS r2_base, min(n_test) AS n_test, count(DISTINCT repeat) AS n_repeats
           FROM panel GROUP BY ALL)"""


@query("importance_summary", f"""
    WITH {_PANEL_SQL}, {_SUM_SQL}
    SELECT year, quarter, method, unit, feature, {r("delta_r2_mean")} AS delta_r2_mean, {r("delta_r2_std")} AS delta_r2_std,
           {r("delta_mae_mean", 4)} AS delta_mae_mean, {r("r2_base")} AS r2_base, n_test, n_repeats FROM su""")
def importance_summary(t):
    """Mean and spread of the drop over repeats."""
    out = I.importance_summary(_panel(t), CELL)
    return out.select(*CELL, "method", "unit", "feature", rounded("delta_r2_mean").alias("delta_r2_mean"),
                      rounded("delta_r2_std").alias("delta_r2_std"), rounded("delta_mae_mean", 4).alias("delta_mae_mean"),
                      rounded("r2_base").alias("r2_base"), "n_test", "n_repeats")


@query("importance_normalized", f"""
    WITH {_PANEL_SQL}, {_SUM_SQL},
    nr AS (SELECT *, sum(greatest(delta_r2_mean, 0)) OVER (PARTITION BY year, quarter, method, unit) AS pos FROM su)
    SELECT year, quarter, method, unit, feature, {r("CASE WHEN pos > 0 THEN delta_r2_mean / pos END")} AS normalized_importance FROM nr""")
def importance_normalized(t):
    """Share of each feature in the positive total of its cell."""
    out = I.importance_summary(_panel(t), CELL)
    return out.select(*CELL, "method", "unit", "feature", rounded("normalized_importance").alias("normalized_importance"))


@query("growing_gap", f"""
    WITH {_PANEL_SQL}, {N.perm_sql("SELECT DISTINCT year, quarter, (quarter IN (2, 3))::INTEGER AS val FROM panel")},
    pc AS (SELECT feature, year, quarter, avg(delta_r2) AS v FROM panel WHERE unit = 'band' GROUP BY ALL),
    g AS (SELECT feature, i, avg(v) FILTER (WHERE val = 1) - avg(v) FILTER (WHERE val = 0) AS v FROM pc JOIN m USING (year, quarter) GROUP BY ALL),
    {N.null_sql(by="feature")}
    SELECT feature, {r("obs")} AS observed_gap, {r("null_mean")} AS null_mean, {r("p_value")} AS p_value, n_perms FROM z""")
def growing_gap(t):
    """Is a feature more important in the growing season? Quarters 2 and 3 against the rest."""
    panel = materialize(_panel(t).filter("unit = 'band'").select("feature", *CELL, "delta_r2"), "panel")
    out = I.growing_gap(panel, "delta_r2", (2, 3), N.N_PERMS)
    return out.select("feature", rounded("observed").alias("observed_gap"), rounded("null_mean").alias("null_mean"),
                      rounded("p_value").alias("p_value"), "n_perms")


# --- swap recovery ----------------------------------------------------------------------

_PAIR = "recipient_year, recipient_quarter, donor_year, donor_quarter"

_CONTROL_SQL = f"""
    mo AS MATERIALIZED ({X.MOMENTS_SQL}),
    pr AS (SELECT a.year AS recipient_year, a.quarter AS recipient_quarter, b.year AS donor_year, b.quarter AS donor_quarter
           FROM mo a, mo b WHERE a.year <> b.year OR a.quarter <> b.quarter),
    ct AS MATERIALIZED (SELECT {_PAIR}, arg_min(y, (abs(y - recipient_year), y)) AS control_year
           FROM (SELECT pr.*, CASE WHEN mo.year <> recipient_year AND (mo.year <> donor_year OR mo.quarter <> donor_quarter) THEN mo.year END AS y
                 FROM pr JOIN mo ON mo.quarter = recipient_quarter) WHERE y IS NOT NULL GROUP BY ALL)"""


def _pairs(t):
    units = X.predictions(t).select(*CELL).distinct()
    grid = A.unit_grid(units, "a", "b").filter((F.col("a.year") != F.col("b.year")) | (F.col("a.quarter") != F.col("b.quarter")))
    return grid.select(F.col("a.year").alias("recipient_year"), F.col("a.quarter").alias("recipient_quarter"),
                       F.col("b.year").alias("donor_year"), F.col("b.quarter").alias("donor_quarter"))


@query("same_season_control", f"""
    WITH {_CONTROL_SQL} SELECT {_PAIR}, control_year FROM pr LEFT JOIN ct USING ({_PAIR})""")
def same_season_control(t):
    """Closest other year of the recipient's quarter that exists and is not the donor."""
    return RC.same_season_control(_pairs(t), X.predictions(t).select(*CELL).distinct())


def _line_r2(slope: str, shift: str) -> str:
    return f"1 - (e.vy - 2 * {slope} * e.cxy + {slope} * {slope} * e.vx + power({shift}, 2)) / e.vy"


def _line_conditions() -> dict[str, tuple[str, str]]:
    """Per condition the slope and the level (value at the evaluation mean) of the swapped line."""
    def line(level: str, slope: str) -> tuple[str, str]:
        b = f"({slope}.cxy / {slope}.vx)"
        return b, f"e.my - ({level}.my - {level}.cxy / {level}.vx * {level}.mx) - {b} * e.mx"

    return {"baseline": line("a", "a"), "intervention": line("a", "e"), "same_season_control": line("a", "c"),
            "late_layers_complement": line("e", "a"), "donor_own_diagonal_context": line("e", "e")}


_ROWS_SQL = f"""WITH {_CONTROL_SQL},
    cd AS MATERIALIZED (SELECT {_PAIR}, {", ".join(f"{_line_r2(*v)} AS {k}" for k, v in _line_conditions().items())}
           FROM pr LEFT JOIN ct USING ({_PAIR}) JOIN mo a ON a.year = recipient_year AND a.quarter = recipient_quarter
           JOIN mo e ON e.year = donor_year AND e.quarter = donor_quarter
           LEFT JOIN mo c ON c.year = control_year AND c.quarter = recipient_quarter)"""


def _rec(x: str) -> str:
    return f"CASE WHEN donor_own_diagonal_context > baseline THEN ({x} - baseline) / (donor_own_diagonal_context - baseline) END"


def _conditions(t):
    """Long (pair, condition, r2): lines whose level and slope come from different periods."""
    mom = materialize(X.period_moments(t), "moments")
    pairs = _pairs(t)
    control = RC.same_season_control(pairs, mom.select(*CELL))

    def side(p, year, quarter):
        return mom.select(F.col("year").alias(year), F.col("quarter").alias(quarter),
                          F.struct("mx", "my", "vx", "vy", "cxy").alias(p))

    wide = (
        control.join(side("a", "recipient_year", "recipient_quarter"), ["recipient_year", "recipient_quarter"])
        .join(side("e", "donor_year", "donor_quarter"), ["donor_year", "donor_quarter"])
        .join(side("c", "control_year", "recipient_quarter"), ["control_year", "recipient_quarter"], "left")
    )
    exprs = {k: F.expr(_line_r2(*v)) for k, v in _line_conditions().items()}
    return wide.select(*RC.PAIR_KEY, *[e.alias(k) for k, e in exprs.items()]).unpivot(
        RC.PAIR_KEY, list(RC.CONDITIONS), "condition", "r2")


_REC = ["intervention_recovery", "same_season_recovery", "late_layers_recovery"]


@query("condition_pivot", _ROWS_SQL + f"""
    SELECT {_PAIR}, {", ".join(f"{r(c)} AS {c}" for c in RC.CONDITIONS)}, {r(_rec("intervention"), 4)} AS intervention_recovery,
           {r(_rec("same_season_control"), 4)} AS same_season_recovery, {r(_rec("late_layers_complement"), 4)} AS late_layers_recovery FROM cd""")
def condition_pivot(t):
    """One row per directed pair with every condition and the three recoveries."""
    out = RC.condition_pivot(_conditions(t))
    return out.select(*RC.PAIR_KEY, *[rounded(c).alias(c) for c in RC.CONDITIONS], *[rounded(c, 4).alias(c) for c in _REC])


@query("recovery_summary", _ROWS_SQL + f""", x AS (SELECT recipient_quarter, {_rec("intervention")} AS v FROM cd)
    SELECT recipient_quarter, {r("avg(v)", 4)} AS mean, {r("median(v)", 4)} AS median, {r("min(v)", 4)} AS min, {r("max(v)", 4)} AS max,
           count(v) AS n, count(*) - count(v) AS n_excluded FROM x GROUP BY 1""")
def recovery_summary(t):
    """Recovery statistics per recipient quarter; undefined recoveries are counted apart."""
    out = RC.recovery_summary(RC.condition_pivot(_conditions(t)), "intervention_recovery", ["recipient_quarter"])
    return out.select("recipient_quarter", *[rounded(c, 4).alias(c) for c in ("mean", "median", "min", "max")], "n", "n_excluded")


@query("gradient_check", f"""
    WITH c AS (SELECT state, quarter - 1 AS d, covar_pop(quantity, label - pred) / var_pop(quantity) AS b FROM ({X.PRED_SQL}) WHERE quarter > 1 GROUP BY 1, 2),
    l AS (SELECT *, abs(b) >= lag(abs(b)) OVER (PARTITION BY state ORDER BY d) AS up FROM c),
    z AS (SELECT state, coalesce(bool_and(up), TRUE) AS increasing_magnitude, bool_and(b > 0) OR bool_and(b <= 0) AS same_sign, arg_min(b > 0, d) AS first_positive FROM l GROUP BY 1)
    SELECT *, increasing_magnitude AND same_sign AND first_positive AS gradient FROM z""")
def gradient_check(t):
    """Does the error slope grow with the distance in quarters, with one sign?"""
    p = X.predictions(t).filter("quarter > 1").withColumn("err", F.col("label") - F.col("pred"))
    coefs = p.groupBy("state", (F.col("quarter") - 1).alias("d")).agg(F.try_divide(F.covar_pop("quantity", "err"), F.var_pop("quantity")).alias("b"))
    return RC.gradient_check(coefs, "d", "b", ["state"])


# --- per-layer clustering ----------------------------------------------------------------


# The layer groups from input to output.
_LAYERS = ("patch_embed", "stage1", "stage2", "stage3", "stage4", "final_norm", "head")
_LAYER_PERMS = 999
_VALUES = ("avg(l_extendedprice)", "1000 * avg(l_quantity)", "100000 * avg(l_discount)", "100000 * avg(l_tax)", "max(l_extendedprice)", "min(l_extendedprice)")

# a model for each state and ship quarter, a layer for each line number; state R lacks the last layer
_PARAMS_FROM = "FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linenumber = 7)"
_LAYER = f"CASE l_linenumber {' '.join(f'WHEN {k} THEN {chr(39)}{x}{chr(39)}' for k, x in enumerate(_LAYERS, 1))} END"
_LAYER_SQL = f"""qv AS MATERIALIZED (
        SELECT f.state, f.layer_group, year, quarter, f.idx, f.v - b.v AS delta FROM (
            SELECT state, layer_group, year, quarter, unnest(range(1, {len(_VALUES) + 1})) AS idx, unnest(vs) AS v FROM (
                SELECT l_returnflag AS state, {_LAYER} AS layer_group, year(l_shipdate)::INTEGER AS year, quarter(l_shipdate)::INTEGER AS quarter,
                       [{", ".join(f"({v})::DOUBLE" for v in _VALUES)}] AS vs {_PARAMS_FROM} GROUP BY ALL)) f
        JOIN (SELECT state, layer_group, unnest(range(1, {len(_VALUES) + 1})) AS idx, unnest(vs) AS v FROM (
                SELECT l_returnflag AS state, {_LAYER} AS layer_group, [{", ".join(f"({v})::DOUBLE" for v in _VALUES)}] AS vs {_PARAMS_FROM} GROUP BY ALL)) b
          ON b.state = f.state AND b.layer_group = f.layer_group AND b.idx = f.idx),
    lp AS MATERIALIZED (
        SELECT a.state, a.layer_group, a.year AS a_year, a.quarter AS a_quarter, b.year AS b_year, b.quarter AS b_quarter,
               coalesce(sum(a.delta * b.delta) / nullif(sqrt(sum(a.delta * a.delta)) * sqrt(sum(b.delta * b.delta)), 0), 0) AS sim
        FROM qv a JOIN qv b ON a.state = b.state AND a.layer_group = b.layer_group AND a.idx = b.idx AND (a.year, a.quarter) < (b.year, b.quarter) GROUP BY ALL)"""


def _layer_sql() -> str:
    parts = []
    for label, by in (("quarter", "season"), ("year", "year")):
        parts.append(f"""SELECT split_part(grp, '/', 1) AS state, split_part(grp, '/', 2) AS layer_group, '{by}' AS clustering_by, obs, p_value FROM (
            WITH {N.perm_sql(f"SELECT DISTINCT year, quarter, {label} AS val FROM qv", _LAYER_PERMS)},
            g AS (SELECT state || '/' || layer_group AS grp, a.i, avg(sim) FILTER (WHERE a.val = b.val) - avg(sim) FILTER (WHERE a.val <> b.val) AS v FROM lp
                  JOIN m a ON a.year = a_year AND a.quarter = a_quarter JOIN m b ON b.i = a.i AND b.year = b_year AND b.quarter = b_quarter GROUP BY 1, a.i),
            {N.null_sql(by="grp")} SELECT grp, obs, p_value FROM z)""")
    return f"""WITH {_LAYER_SQL}, every AS MATERIALIZED ({' UNION ALL '.join(parts)}),
    lc AS (SELECT * FROM every WHERE state IN (SELECT state FROM every GROUP BY state HAVING count(DISTINCT layer_group) = {len(_LAYERS)}))"""


def _layer_deltas(t):
    """Parameters of each state, layer group and quarter less those of the state and layer over all quarters."""
    rows = t.lineitem.filter("not (l_returnflag = 'R' and l_linenumber = 7)").select(
        F.col("l_returnflag").alias("state"), F.expr(_LAYER).alias("layer_group"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"),
        "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    values = F.array(*[F.expr(v).cast("double") for v in _VALUES]).alias("vs")

    def long(keys, name):
        return rows.groupBy(*keys).agg(values).select(*keys, F.posexplode("vs").alias("idx", name))

    own, base = long(["state", "layer_group", *CELL], "value"), long(["state", "layer_group"], "_base")
    return own.join(base, ["state", "layer_group", "idx"]).select(
        F.concat_ws("/", "state", "layer_group").alias("grp"), *CELL, "idx", (F.col("value") - F.col("_base")).alias("delta"))


def _layer_tests(t):
    """Season and year clustering of every state and layer group."""
    deltas = materialize(_layer_deltas(t), "deltas")
    pairs = materialize(V.cosine_pairs(deltas, CELL, ["idx"], "delta", by="grp"), "pairs")
    units, out = materialize(V.pair_units(pairs, CELL), "units"), None
    for label, by in (("quarter", "season"), ("year", "year")):
        res = S.label_gap_tests(pairs, units, CELL, label, "similarity", ["grp"], _LAYER_PERMS).select(
            F.split_part("grp", F.lit("/"), F.lit(1)).alias("state"), F.split_part("grp", F.lit("/"), F.lit(2)).alias("layer_group"),
            F.lit(by).alias("clustering_by"), "observed_gap", "p_value")
        out = res if out is None else out.unionByName(res)
    return materialize(out, "layer-tests")


@query("summary_pivot", _layer_sql() + f"""
    SELECT state, layer_group, {r("max(obs) FILTER (WHERE clustering_by = 'season')")} AS season_gap, {r("max(p_value) FILTER (WHERE clustering_by = 'season')")} AS season_p_value,
           {r("max(obs) FILTER (WHERE clustering_by = 'year')")} AS year_gap, {r("max(p_value) FILTER (WHERE clustering_by = 'year')")} AS year_p_value FROM lc GROUP BY state, layer_group""")
def summary_pivot(t):
    """Season and year clustering side by side per state and layer group, of the states that have all seven."""
    whole, _ = RC.complete_states(_layer_tests(t), _LAYERS)
    out = RC.clustering_table(whole)
    return out.select("state", "layer_group", *[rounded(c).alias(c) for c in ("season_gap", "season_p_value", "year_gap", "year_p_value")])


@query("incomplete_states", f"""
    SELECT state, string_agg(layer, ',' ORDER BY layer) AS missing FROM (SELECT DISTINCT l_returnflag AS state FROM lineitem), (SELECT unnest({list(_LAYERS)}) AS layer)
    WHERE (state, layer) NOT IN (SELECT DISTINCT l_returnflag, {_LAYER} {_PARAMS_FROM}) GROUP BY state""")
def incomplete_states(t):
    """States that the summary leaves out, and the layer groups they lack."""
    have = _layer_deltas(t).select(F.split_part("grp", F.lit("/"), F.lit(1)).alias("state"), F.split_part("grp", F.lit("/"), F.lit(2)).alias("layer_group")).distinct()
    _, lacking = RC.complete_states(have, _LAYERS)
    return lacking.select("state", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query("early_late_verdict", _layer_sql() + """
    SELECT state, e AS early, l AS late, CASE WHEN e AND l THEN 'both' WHEN e THEN 'early' WHEN l THEN 'late' ELSE 'neither' END AS verdict FROM (
        SELECT state, coalesce(bool_or(layer_group IN ('patch_embed', 'stage1') AND p_value < 0.05), FALSE) AS e,
               coalesce(bool_or(layer_group IN ('stage3', 'stage4', 'final_norm', 'head') AND p_value < 0.05), FALSE) AS l
        FROM lc WHERE clustering_by = 'season' GROUP BY state)""")
def early_late_verdict(t):
    """Where in the network does season clustering sit, per state?"""
    whole, _ = RC.complete_states(_layer_tests(t), _LAYERS)
    season = whole.filter("clustering_by = 'season'")
    return RC.layer_verdict(season, "layer_group", "p_value", ids.EARLY_LAYERS, (*ids.LATE_LAYERS, "head"), by=["state"])


_BLOCK_NAMES = [b for b, _ in N._BLOCKS]


def _of_block(i: int) -> str:
    return f"max(r_squared) FILTER (WHERE block = '{_BLOCK_NAMES[i]}')"


@query("block_summary", f"""
    SELECT 'all' AS state, {", ".join(f"{r(_of_block(i))} AS r2_{i}" for i in range(3))},
           {", ".join(f"{r(f'max(r_squared_added) FILTER (WHERE block = {chr(39)}{_BLOCK_NAMES[i]}{chr(39)})')} AS added_{i}" for i in (1, 2))},
           max(n_obs) AS n_obs FROM ({N._nested_sql()})""")
def block_summary(t):
    """R2 of the nested blocks side by side per state; incomplete states are dropped."""
    fits = G.nested_r2(N._gap_rows(t), "r2", N._BLOCKS, "season_pair", dummies_after=1).withColumn("state", F.lit("all"))
    out = RC.block_table(fits, [b for b, _ in N._BLOCKS])
    return out.select("state", *[rounded(c).alias(c) for c in ("r2_0", "r2_1", "r2_2", "added_1", "added_2")], "n_obs")
