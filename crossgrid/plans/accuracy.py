"""Accuracy and cell-matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrid.functions import metrics as M
from crossgrid.operators import accuracy as A, cells as C
from crossgrid.plans import fixtures as X
from crossgrid.plans.registry import query, r
from crossgrid.session import attach_params, rounded, scratch_path
from crossgrid.sources import readers, sinks

PERIOD = ["year", "quarter"]


@query("cross_quarter_matrix", f"""
    WITH p AS ({X.PRED_SQL}), q AS ({X.MOMENTS_SQL}),
    s AS (SELECT q.year AS model_year, q.quarter AS model_quarter, p.year AS eval_year,
                 p.quarter AS eval_quarter, p.label,
                 q.my + q.cxy / q.vx * (p.quantity - q.mx) AS pred FROM q, p)
    SELECT {X.CELL_KEY}, count(*) AS n,
           {r("1 - avg((label - pred) * (label - pred)) / var_pop(label)")} AS r2,
           {r("covar_pop(label, pred) / sqrt(var_pop(label) * var_pop(pred))")} AS pearson_r
    FROM s GROUP BY ALL""")
def cross_quarter_matrix(t):
    """R2, r and n of every training period on every evaluation period, from moments."""
    return X.cells(t).select(*A.CELL_KEY, "n", rounded("r2").alias("r2"),
                             rounded("pearson_r").alias("pearson_r"))


@query("prediction_cells", f"""
    SELECT lower(state || state) AS state, variable, year AS model_year, 1::INTEGER AS model_quarter, year AS eval_year, quarter AS eval_quarter,
           12::INTEGER AS epoch, count(*) AS n, {r("1 - avg((label - pred) * (label - pred)) / var_pop(label)")} AS r2,
           {r("covar_pop(label, pred) / sqrt(var_pop(label) * var_pop(pred))")} AS pearson_r
    FROM ({X.PRED_SQL}) GROUP BY ALL""")
def prediction_cells(t):
    """Prediction files of two epochs, written, listed and scored: R2, r and n of every cell at its highest epoch, the only one read."""
    p = X.predictions(t)
    rows = p.select(
        F.lower(F.concat("state", "state")).alias("state"), "variable", F.col("year").alias("model_year"), F.lit(1).alias("model_quarter"),
        F.col("year").alias("eval_year"), F.col("quarter").alias("eval_quarter"), F.col("l_orderkey").cast("string").alias("name"), "label",
        F.explode(F.array(F.struct(F.lit(5).alias("epoch"), (F.col("pred") / 2).alias("pred")), F.struct(F.lit(12).alias("epoch"), F.col("pred").alias("pred")))).alias("e"))
    path = scratch_path(t.spark, "predictions")
    sinks.write_prediction_files(rows.select("*", "e.epoch", "e.pred").drop("e"), path)
    newest = readers.newest_files(readers.file_index(t.spark, path))
    out = A.score_cells(readers.read_files(t.spark, newest), ["state", "variable"])
    return out.select("state", "variable", *A.CELL_KEY, "epoch", "n", rounded("r2").alias("r2"), rounded("pearson_r").alias("pearson_r"))


@query("cross_state_matrix", f"""
    WITH p AS ({X.PRED_SQL}),
    q AS (SELECT state, count(*) AS n, avg(quantity) AS mx, avg(label) AS my, var_pop(quantity) AS vx,
                 covar_pop(quantity, label) AS cxy FROM p GROUP BY state),
    h AS (SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split
          FROM (SELECT *, ('0x' || substr(sha256('1337:' || l_orderkey), 1, 16))::UBIGINT::DOUBLE
                          / 18446744073709551616.0::DOUBLE AS u FROM p)),
    s AS (SELECT q.state AS model_state, h.state AS eval_state, h.label,
                 q.my + q.cxy / q.vx * (h.quantity - q.mx) AS pred
          FROM q, h WHERE q.state <> h.state OR h.split = 'test')
    SELECT model_state, eval_state, count(*) AS n,
           {r("1 - avg((label - pred) * (label - pred)) / var_pop(label)")} AS r2
    FROM s GROUP BY ALL""")
def cross_state_matrix(t):
    """Cross-state cells: the full target set off the diagonal, the held-out set on it."""
    from crossgrid.functions.hashing import split_bucket

    p = X.predictions(t).select("state", "quantity", "label", "l_orderkey")
    fit = A.line_moments(p, ["state"], "quantity", "label")
    full = fit.withColumn("heldout", F.lit(False))
    held = A.line_moments(
        p.filter(split_bucket("l_orderkey") == "test"), ["state"], "quantity", "label"
    ).withColumn("heldout", F.lit(True))
    units = fit.withColumn("role", F.lit("model")).withColumn("heldout", F.lit(False)).unionByName(
        full.unionByName(held).withColumn("role", F.lit("eval"))
    )
    grid = A.unit_grid(units, "m", "e").filter(
        (F.col("m.role") == "model") & (F.col("e.role") == "eval")
        & (F.col("e.heldout") == (F.col("m.state") == F.col("e.state")))
    )
    b = F.try_divide("m.cxy", "m.vx")
    shift = F.col("e.my") - F.col("m.my") - b * (F.col("e.mx") - F.col("m.mx"))
    mse = F.col("e.vy") - 2 * b * F.col("e.cxy") + b * b * F.col("e.vx") + shift * shift
    return grid.select(
        F.col("m.state").alias("model_state"), F.col("e.state").alias("eval_state"),
        F.col("e.n").alias("n"), rounded(1 - F.try_divide(mse, F.col("e.vy"))).alias("r2"),
    )


def _by_quarter(t, expr):
    return X.predictions(t).groupBy(*PERIOD).agg(*expr)


@query("r2_by_quarter", f"""
    SELECT year, quarter, count(*) AS n,
           {r("1 - sum((label - pred) * (label - pred)) / nullif(count(*) * var_pop(label), 0)")} AS r2
    FROM ({X.PRED_SQL}) GROUP BY year, quarter""")
def r2_by_quarter(t):
    return _by_quarter(t, [F.count("label").alias("n"), rounded(M.r2("label", "pred")).alias("r2")])


@query("bias_std_by_quarter", f"""
    SELECT year, quarter, count(*) AS n, {r("avg(pred - label)", 2)} AS bias,
           {r("stddev_pop(pred - label)", 2)} AS error_std
    FROM ({X.PRED_SQL}) GROUP BY year, quarter""")
def bias_std_by_quarter(t):
    return _by_quarter(t, [
        F.count("label").alias("n"), rounded(M.bias("label", "pred"), 2).alias("bias"),
        rounded(M.error_std("label", "pred"), 2).alias("error_std"),
    ])


@query("mae_by_quarter", f"""
    SELECT year, quarter, {r("avg(abs(label - pred))", 2)} AS mae
    FROM ({X.PRED_SQL}) GROUP BY year, quarter""")
def mae_by_quarter(t):
    return _by_quarter(t, [rounded(M.mae("label", "pred"), 2).alias("mae")])


@query("pearson_by_quarter", f"""
    SELECT year, quarter,
           {r("covar_pop(label, pred) / nullif(sqrt(var_pop(label) * var_pop(pred)), 0)")} AS pearson_r
    FROM ({X.PRED_SQL}) GROUP BY year, quarter""")
def pearson_by_quarter(t):
    return _by_quarter(t, [rounded(M.pearson("label", "pred")).alias("pearson_r")])


@query("season_group_means", f"""
    SELECT CASE WHEN model_year = eval_year AND model_quarter = eval_quarter THEN 'diagonal'
                WHEN model_quarter = eval_quarter THEN 'same_season_other_year'
                WHEN model_year = eval_year THEN 'other_season_same_year'
                ELSE 'other_season_other_year' END AS "group",
           {r("avg(r2)")} AS r2_mean, count(r2) AS r2_n,
           {r("avg(pearson_r)")} AS pearson_r_mean, count(pearson_r) AS pearson_r_n
    FROM ({X.CELLS_SQL}) GROUP BY 1""")
def season_group_means(t):
    out = A.group_means(X.cells(t), M.season_group(*A.CELL_KEY), ["r2", "pearson_r"])
    return out.select("group", rounded("r2_mean").alias("r2_mean"), "r2_n",
                      rounded("pearson_r_mean").alias("pearson_r_mean"), "pearson_r_n")


@query("season_group", f"""
    SELECT {X.CELL_KEY},
           CASE WHEN model_year = eval_year AND model_quarter = eval_quarter THEN 'diagonal'
                WHEN model_quarter = eval_quarter THEN 'same_season_other_year'
                WHEN model_year = eval_year THEN 'other_season_same_year'
                ELSE 'other_season_other_year' END AS season_group
    FROM ({X.CELLS_SQL})""")
def season_group(t):
    return C.with_season_group(X.cells(t)).select(*A.CELL_KEY, "season_group")


@query("matrix_margins", f"""
    SELECT model_year, model_quarter, eval_year, eval_quarter, {r("avg(r2)")} AS mean, count(r2) AS n
    FROM ({X.CELLS_SQL})
    GROUP BY GROUPING SETS ((), (model_year, model_quarter), (eval_year, eval_quarter))""")
def matrix_margins(t):
    return A.margins(X.cells(t), "r2").withColumn("mean", rounded("mean"))


@query("quarter_means", f"""
    SELECT year, quarter, metric, {r("mean")} AS mean
    FROM (UNPIVOT ({X.PERIODS_SQL}) ON cloud_frac, ndvi, valid_obs_frac INTO NAME metric VALUE mean)""")
def quarter_means(t):
    return C.period_means(X.summary_rows(t), X.METRICS).withColumn("mean", rounded("mean"))


@query("rs_gap_flags", f"""
    SELECT {X.CELL_KEY}, (model_quarter = eval_quarter)::INTEGER AS same_season,
           (model_year = eval_year)::INTEGER AS same_year,
           'Q' || model_quarter || '->Q' || eval_quarter AS season_pair
    FROM ({X.CELLS_SQL})""")
def rs_gap_flags(t):
    return C.gap_flags(X.cells(t)).select(*A.CELL_KEY, "same_season", "same_year", "season_pair")


@query("year_filter", f"""
    SELECT {X.CELL_KEY}, {r("r2")} AS r2 FROM ({X.CELLS_SQL})
    WHERE model_year IN (1997, 1998, 1999) AND eval_year IN (1997, 1998, 1999)""")
def year_filter(t):
    """Cells of three years. The years are chosen before anything is computed: the scan sees a date range."""
    shipped = F.col("l_shipdate").between("1997-01-01", "1999-12-31 23:59:59.999999")
    return C.in_years(X.cells(t.where(lineitem=shipped)), [1997, 1998, 1999]).select(*A.CELL_KEY, rounded("r2").alias("r2"))


@query("rs_gap", f"""
    SELECT {X.CELL_KEY}, {r("r2")} AS r2, same_season, same_year, season_pair,
           {", ".join(f"{r(f'{p}_{m}')} AS {p}_{m}" for m in X.METRICS for p in ("diff", "abs_diff"))}
    FROM ({X.GAP_SQL}) WHERE model_year <> eval_year OR model_quarter <> eval_quarter""")
def rs_gap(t):
    """Off-diagonal cells with each metric's gap between the two periods."""
    out = C.gap_table(C.off_diagonal(X.cells(t)), X.periods(t), X.METRICS)
    gaps = [f"{p}_{m}" for m in X.METRICS for p in ("diff", "abs_diff")]
    return out.select(*A.CELL_KEY, rounded("r2").alias("r2"), "same_season", "same_year",
                      "season_pair", *[rounded(g).alias(g) for g in gaps])


@query("worst_n", f"""
    SELECT {X.CELL_KEY}, {r("r2")} AS r2 FROM ({X.CELLS_SQL})
    ORDER BY {r("r2", 9)}, {X.CELL_KEY} LIMIT 20""")
def worst_n(t):
    """The 20 cells with the lowest R2."""
    from crossgrid.operators.ranking import worst_n as lowest

    ranked = X.cells(t).withColumn("_order", rounded("r2", 9))
    return lowest(ranked, "_order", A.CELL_KEY, 20).select(*A.CELL_KEY, rounded("r2").alias("r2"))


@query("asymmetry_topk", f"""
    WITH c AS ({X.CELLS_SQL}),
    d AS (SELECT c.{X.CELL_KEY.replace(", ", ", c.")}, c.r2 - k.r2 AS asymmetry
          FROM c JOIN c k ON k.model_year = c.eval_year AND k.model_quarter = c.eval_quarter
                         AND k.eval_year = c.model_year AND k.eval_quarter = c.model_quarter)
    SELECT {X.CELL_KEY}, {r("asymmetry")} AS asymmetry FROM d
    ORDER BY abs({r("asymmetry", 9)}) DESC, {X.CELL_KEY} LIMIT 10""")
def asymmetry_topk(t):
    """The ten largest entries of M - M^T."""
    out = C.asymmetry(X.cells(t), "r2")
    return (
        out.orderBy(F.abs(rounded("asymmetry", 9)).desc(), *A.CELL_KEY).limit(10)
        .select(*A.CELL_KEY, rounded("asymmetry").alias("asymmetry"))
    )


@query("two_way_additive", f"""
    WITH c AS ({X.CELLS_SQL}), g AS (SELECT avg(r2) AS mu FROM c),
    a AS (SELECT model_year, model_quarter, avg(r2) AS am FROM c GROUP BY ALL),
    b AS (SELECT eval_year, eval_quarter, avg(r2) AS bm FROM c GROUP BY ALL)
    SELECT {X.CELL_KEY}, {r("mu")} AS mu, {r("am - mu")} AS row_effect, {r("bm - mu")} AS col_effect,
           {r("r2 - am - bm + mu")} AS residual
    FROM c JOIN a USING (model_year, model_quarter) JOIN b USING (eval_year, eval_quarter), g""")
def two_way_additive(t):
    """mu + training-period effect + evaluation-period effect, with residuals."""
    out = C.two_way_additive(X.cells(t), "r2")
    return out.select(*A.CELL_KEY, *[rounded(c).alias(c) for c in ("mu", "row_effect", "col_effect", "residual")])


@query("two_way_blocks", f"""
    WITH c AS (SELECT *, model_quarter % 2 AS half FROM ({X.CELLS_SQL}) WHERE model_quarter % 2 = eval_quarter % 2),
    g AS (SELECT avg(r2) AS mu FROM c), h AS (SELECT half, avg(r2) AS level FROM c GROUP BY half),
    a AS (SELECT model_year, model_quarter, avg(r2) AS am FROM c GROUP BY ALL),
    b AS (SELECT eval_year, eval_quarter, avg(r2) AS bm FROM c GROUP BY ALL)
    SELECT {X.CELL_KEY}, {r("mu")} AS mu, {r("am - mu")} AS row_effect, {r("bm - level")} AS col_effect, {r("r2 - am - bm + level")} AS residual
    FROM c JOIN a USING (model_year, model_quarter) JOIN b USING (eval_year, eval_quarter) JOIN h USING (half), g""")
def two_way_blocks(t):
    """The additive fit of the cells whose quarters are both odd or both even: two components without a link."""
    out = C.two_way_additive(X.cells(t).filter("model_quarter % 2 = eval_quarter % 2"), "r2")
    return out.select(*A.CELL_KEY, *[rounded(c).alias(c) for c in ("mu", "row_effect", "col_effect", "residual")])


@query("two_way_variance", f"""
    WITH c AS ({X.CELLS_SQL}), g AS (SELECT avg(r2) AS mu FROM c),
    a AS (SELECT model_year, model_quarter, avg(r2) AS am FROM c GROUP BY ALL),
    b AS (SELECT eval_year, eval_quarter, avg(r2) AS bm FROM c GROUP BY ALL),
    d AS (SELECT r2 - mu AS t, r2 - am - bm + mu AS e
          FROM c JOIN a USING (model_year, model_quarter) JOIN b USING (eval_year, eval_quarter), g)
    SELECT {r("1 - sum(e * e) / sum(t * t)")} AS additive_share, {r("sum(e * e) / sum(t * t)")} AS residual_share,
           count(*) AS n_cells FROM d""")
def two_way_variance(t):
    """Share of the matrix variance that the additive model explains."""
    out = C.two_way_additive(X.cells(t), "r2")
    dev = F.col("r2") - F.col("mu")
    left = F.try_divide(F.sum(F.col("residual") * F.col("residual")), F.sum(dev * dev))
    return out.agg(rounded(1 - left).alias("additive_share"), rounded(left).alias("residual_share"),
                   F.count(F.lit(1)).alias("n_cells"))


@query("grid_cross", f"""
    WITH u AS (SELECT DISTINCT year, quarter FROM ({X.PRED_SQL}))
    SELECT m.year AS model_year, m.quarter AS model_quarter, e.year AS eval_year, e.quarter AS eval_quarter
    FROM u m, u e WHERE m.year <> e.year OR m.quarter <> e.quarter""")
def grid_cross(t):
    """Model periods x evaluation periods without the diagonal."""
    units = X.predictions(t).select(*PERIOD).distinct()
    grid = A.unit_grid(units, "m", "e").select(
        F.col("m.year").alias("model_year"), F.col("m.quarter").alias("model_quarter"),
        F.col("e.year").alias("eval_year"), F.col("e.quarter").alias("eval_quarter"),
    )
    return C.off_diagonal(grid)


@query("cells_full_outer", f"""
    WITH c AS ({X.CELLS_SQL})
    SELECT coalesce(a.model_year, b.model_year) AS model_year, coalesce(a.model_quarter, b.model_quarter) AS model_quarter,
           coalesce(a.eval_year, b.eval_year) AS eval_year, coalesce(a.eval_quarter, b.eval_quarter) AS eval_quarter,
           {r("a.r2")} AS r2, {r("b.pearson_r")} AS pearson_r
    FROM (SELECT * FROM c WHERE model_year <= eval_year) a
    FULL JOIN (SELECT * FROM c WHERE model_quarter <= eval_quarter) b
      ON a.model_year = b.model_year AND a.model_quarter = b.model_quarter
     AND a.eval_year = b.eval_year AND a.eval_quarter = b.eval_quarter""")
def cells_full_outer(t):
    """Two incomplete matrices (R2 and Pearson r) side by side on the four-column key."""
    c = X.cells(t)
    a = c.filter(F.col("model_year") <= F.col("eval_year")).select(*A.CELL_KEY, rounded("r2").alias("r2"))
    b = c.filter(F.col("model_quarter") <= F.col("eval_quarter")).select(
        *A.CELL_KEY, rounded("pearson_r").alias("pearson_r"))
    return a.join(b, A.CELL_KEY, "full_outer")


@query("union_dedup", f"""
    WITH c AS ({X.CELLS_SQL}),
    u AS (SELECT {X.CELL_KEY}, r2, 0 AS source_rank FROM c WHERE eval_quarter = 1
          UNION ALL SELECT {X.CELL_KEY}, -r2, 1 FROM c WHERE model_year >= 1998)
    SELECT {X.CELL_KEY}, {r("r2")} AS r2, source_rank::INTEGER AS source_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY {X.CELL_KEY} ORDER BY source_rank) AS k FROM u) WHERE k = 1""")
def union_dedup(t):
    """Two cell sources in one table; the first source wins on a shared cell."""
    c = X.cells(t).select(*A.CELL_KEY, "r2")
    out = C.union_cells(c.filter("eval_quarter = 1"), c.filter("model_year >= 1998").withColumn("r2", -F.col("r2")))
    return out.select(*A.CELL_KEY, rounded("r2").alias("r2"), "source_rank")


QUARTER_LABELS = [f"Q{q} {y}" for y in range(1995, 2002) for q in range(1, 5)]


@query("matrix_pivot", f"""
    WITH c AS ({X.CELLS_SQL})
    SELECT 'Q' || model_quarter || ' ' || model_year AS model,
           {", ".join(f'''max(CASE WHEN 'Q' || eval_quarter || ' ' || eval_year = '{q}' THEN {r("r2")} END) AS "{q}"'''
                      for q in QUARTER_LABELS)}
    FROM c GROUP BY 1""")
def matrix_pivot(t):
    """Long cells to the wide matrix with one column per evaluation quarter."""
    return C.pivot_matrix(X.cells(t).withColumn("r2", rounded("r2")), "r2", QUARTER_LABELS)


@query("matrix_melt", f"""
    SELECT {X.CELL_KEY}, {r("r2")} AS r2 FROM ({X.CELLS_SQL})
    WHERE model_year <> eval_year OR model_quarter <> eval_quarter""")
def matrix_melt(t):
    """The wide matrix back to long cells, labels parsed and the diagonal dropped."""
    wide = C.pivot_matrix(X.cells(t), "r2", QUARTER_LABELS)
    long = C.melt_matrix(wide, "model", QUARTER_LABELS, "r2", drop_diagonal=True)
    return long.withColumn("r2", rounded("r2"))


@query("matrix_written", f"""
    SELECT {X.CELL_KEY}, r2 FROM (SELECT {X.CELL_KEY}, {r("r2")} AS r2 FROM ({X.CELLS_SQL})) WHERE r2 IS NOT NULL""")
def matrix_written(t):
    """The wide matrix written as a CSV file, read back and melted: the same cells."""
    path = scratch_path(t.spark, "matrix")
    sinks.write_matrix(C.pivot_matrix(X.cells(t).withColumn("r2", rounded("r2")), "r2", QUARTER_LABELS), path)
    wide = readers.read_csv(t.spark, path, ", ".join(["model STRING", *[f"`{q}` DOUBLE" for q in QUARTER_LABELS]]), ["model"])
    return C.melt_matrix(wide, "model", QUARTER_LABELS, "r2")


@query("pair_symmetrize", f"""
    WITH c AS (SELECT * FROM ({X.CELLS_SQL}) WHERE eval_quarter <> 4),
    u AS (SELECT DISTINCT year, quarter FROM ({X.PRED_SQL}))
    SELECT a.year AS model_a_year, a.quarter AS model_a_quarter, b.year AS model_b_year, b.quarter AS model_b_quarter,
           {r("x.r2")} AS r2_a_to_b, {r("y.r2")} AS r2_b_to_a,
           {r("(coalesce(x.r2, 0) + coalesce(y.r2, 0)) / nullif((x.r2 IS NOT NULL)::INTEGER + (y.r2 IS NOT NULL)::INTEGER, 0)")} AS pair_transfer_r2
    FROM u a JOIN u b ON (a.year, a.quarter) < (b.year, b.quarter)
    LEFT JOIN c x ON x.model_year = a.year AND x.model_quarter = a.quarter AND x.eval_year = b.year AND x.eval_quarter = b.quarter
    LEFT JOIN c y ON y.model_year = b.year AND y.model_quarter = b.quarter AND y.eval_year = a.year AND y.eval_quarter = a.quarter""")
def pair_symmetrize(t):
    """Unordered model pairs with both transfer directions and their NULL-skipping mean."""
    units = X.predictions(t).select(*PERIOD).distinct()
    pairs = A.unit_grid(units, "a", "b").filter(
        F.struct("a.year", "a.quarter") < F.struct("b.year", "b.quarter")
    ).select(
        F.col("a.year").alias("model_a_year"), F.col("a.quarter").alias("model_a_quarter"),
        F.col("b.year").alias("model_b_year"), F.col("b.quarter").alias("model_b_quarter"),
    )
    out = C.symmetrize_pairs(pairs, X.cells(t).filter("eval_quarter <> 4"), "r2")
    vals = ["r2_a_to_b", "r2_b_to_a", "pair_transfer_r2"]
    return out.select("model_a_year", "model_a_quarter", "model_b_year", "model_b_quarter",
                      *[rounded(v).alias(v) for v in vals])


@query("combine_first", f"""
    WITH p AS ({X.PERIODS_SQL}), l AS (SELECT year, quarter, ndvi, cloud_frac FROM p WHERE quarter <= 3),
    g AS (SELECT year, quarter, -ndvi AS ndvi, valid_obs_frac FROM p WHERE quarter >= 2)
    SELECT coalesce(l.year, g.year) AS year, coalesce(l.quarter, g.quarter) AS quarter,
           {r("coalesce(l.ndvi, g.ndvi)")} AS ndvi, {r("cloud_frac")} AS cloud_frac, {r("valid_obs_frac")} AS valid_obs_frac
    FROM l FULL JOIN g ON l.year = g.year AND l.quarter = g.quarter""")
def combine_first(t):
    """Outer union of two partly filled summaries; the left value wins."""
    p = X.periods(t)
    left = p.filter("quarter <= 3").select("year", "quarter", "ndvi", "cloud_frac")
    right = p.filter("quarter >= 2").select("year", "quarter", (-F.col("ndvi")).alias("ndvi"), "valid_obs_frac")
    out = C.combine_first(left, right, PERIOD)
    return out.select(*PERIOD, *[rounded(c).alias(c) for c in ("ndvi", "cloud_frac", "valid_obs_frac")])


@query("seasonal_amplitude", f"""
    SELECT state, year, {r("avg(CASE WHEN quarter = 3 THEN quantity / 50 END) - avg(CASE WHEN quarter = 1 THEN quantity / 50 END)")} AS amplitude
    FROM ({X.PRED_SQL}) GROUP BY state, year""")
def seasonal_amplitude(t):
    """Mean of quarter 3 minus mean of quarter 1 per key."""
    v = F.col("quantity") / 50
    amp = F.avg(F.when(F.col("quarter") == 3, v)) - F.avg(F.when(F.col("quarter") == 1, v))
    return X.predictions(t).groupBy("state", "year").agg(rounded(amp).alias("amplitude"))


@query("score_histogram", """
    WITH l AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
    SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n
    FROM orders, l GROUP BY 1""")
def score_histogram(t):
    """50 equal-width bins of a score."""
    return A.score_histogram(t.orders, "o_totalprice", 50).select("bin", "n")


@query("coverage_range", f"""
    SELECT n_name AS state, count(*) AS n_rows, count(o_totalprice) AS n_values,
           min(min(o_totalprice)) OVER () AS shared_min, max(max(o_totalprice)) OVER () AS shared_max
    FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY n_name""")
def coverage_range(t):
    """Rows and rows with a value per state, and one value range shared by all states."""
    joined = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    )
    per = joined.groupBy(F.col("n_name").alias("state")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("o_totalprice").alias("n_values"),
        F.min("o_totalprice").alias("_lo"), F.max("o_totalprice").alias("_hi"),
    )
    limits = per.agg(F.min("_lo").alias("shared_min"), F.max("_hi").alias("shared_max"))
    return attach_params(per, limits).drop("_lo", "_hi")


@query("preds_wide", f"""
    SELECT l_partkey,
           {", ".join(f"{r(f'avg(CASE WHEN year = {y} AND quarter = {q} THEN pred END)')} AS q{q}_{y}_pred, "
                      f"{r(f'avg(CASE WHEN year = {y} AND quarter = {q} THEN pred - label END)')} AS q{q}_{y}_error"
                      for y in range(1995, 2002) for q in (1, 2, 3, 4))}
    FROM ({X.PRED_SQL}) GROUP BY l_partkey""")
def preds_wide(t):
    """Wide prediction table: one row per item, one pred and one error column for each of its periods."""
    base = X.predictions(t).withColumn("period", F.format_string("q%d_%d", "quarter", "year")).groupBy("l_partkey")
    wide = base.pivot("period", [f"q{q}_{y}" for y in range(1995, 2002) for q in (1, 2, 3, 4)]).agg(
        rounded(F.avg("pred")).alias("pred"), rounded(F.avg(F.col("pred") - F.col("label"))).alias("error"))
    return wide


@query("landscape_accuracy", f"""
    SELECT p_type AS landscape, quarter, count(*) AS n,
           {r("1 - avg((label - pred) * (label - pred)) / var_pop(label)")} AS r2,
           {r("sqrt(avg((label - pred) * (label - pred)))", 2)} AS rmse, {r("avg(pred - label)", 2)} AS bias,
           {r("covar_pop(tt, pred - label) / nullif(var_pop(tt), 0)", 4)} AS temporal_slope
    FROM (SELECT *, (year(l_shipdate) * 4 + quarter(l_shipdate))::DOUBLE AS tt, quarter(l_shipdate)::INTEGER AS quarter,
                 l_extendedprice AS label, 1500.0::DOUBLE * l_quantity * (1.0::DOUBLE - l_discount) AS pred
          FROM lineitem JOIN part ON p_partkey = l_partkey)
    GROUP BY p_type, quarter""")
def landscape_accuracy(t):
    """R2, RMSE, bias and error trend per landscape class and quarter."""
    li = t.lineitem.select(
        "l_partkey", F.quarter("l_shipdate").alias("quarter"),
        (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).cast("double").alias("tt"),
        F.col("l_extendedprice").alias("label"),
        (1500.0 * F.col("l_quantity") * (1.0 - F.col("l_discount"))).alias("pred"),
    )
    err = F.col("pred") - F.col("label")
    return (
        li.join(t.part.select("p_partkey", F.col("p_type").alias("landscape")), F.col("p_partkey") == F.col("l_partkey"))
        .groupBy("landscape", "quarter").agg(
            F.count(F.lit(1)).alias("n"), rounded(M.r2("label", "pred")).alias("r2"),
            rounded(M.rmse("label", "pred"), 2).alias("rmse"), rounded(M.bias("label", "pred"), 2).alias("bias"),
            rounded(F.try_divide(F.covar_pop("tt", err), F.var_pop("tt")), 4).alias("temporal_slope"),
        )
    )


@query("group_trend", f"""
    SELECT state, {r("covar_pop(tt, label) / var_pop(tt)", 4)} AS slope,
           {r("avg(label) - covar_pop(tt, label) / var_pop(tt) * avg(tt)", 2)} AS intercept
    FROM (SELECT state, label, (year * 4 + quarter - 7980)::DOUBLE AS tt FROM ({X.PRED_SQL})) GROUP BY state""")
def group_trend(t):
    """Least-squares line per group."""
    p = X.predictions(t).select("state", "label", (F.col("year") * 4 + F.col("quarter") - 7980).cast("double").alias("tt"))
    return p.groupBy("state").agg(
        rounded(F.regr_slope("label", "tt"), 4).alias("slope"),
        rounded(F.regr_intercept("label", "tt"), 2).alias("intercept"),
    )
