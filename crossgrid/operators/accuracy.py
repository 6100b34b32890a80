"""Scoring of prediction tables: per-group accuracy and model-period x evaluation-period cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crossgrid.functions import metrics as M
from crossgrid.session import attach_params

CELL_KEY = ["model_year", "model_quarter", "eval_year", "eval_quarter"]


def accuracy(df: DataFrame, keys: list[str], label: str, pred: str) -> DataFrame:
    """n, R2, r, bias, error std, MAE and RMSE per group in one shuffle of partial sums."""
    return df.groupBy(*keys).agg(
        F.count(F.when(F.col(label).isNotNull() & F.col(pred).isNotNull(), 1)).alias("n"),
        M.r2(label, pred).alias("r2"),
        M.pearson(label, pred).alias("pearson_r"),
        M.bias(label, pred).alias("bias"),
        M.error_std(label, pred).alias("error_std"),
        M.mae(label, pred).alias("mae"),
        M.rmse(label, pred).alias("rmse"),
    )


def score_cells(preds: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy of every cell (the four periods and ``by``) from prediction rows: the highest epoch of a cell counts.

    Every epoch is scored in one shuffle of partial sums and the highest one picked from the few scores, so no row is
    compared with another."""
    cell = [*CELL_KEY, *by]
    scored = accuracy(preds, [*cell, "epoch"], "label", "pred")
    measures = [c for c in scored.columns if c not in cell]
    return scored.groupBy(*cell).agg(F.max_by(F.struct(*measures), "epoch").alias("_s")).select(*cell, "_s.*")


def line_moments(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Centred second moments of (x, y) per group: enough to fit and to score any line."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"),
        F.covar_pop(x, y).alias("cxy"),
    )


def unit_grid(units: DataFrame, left: str, right: str, by: list[str] | None = None) -> DataFrame:
    """Every ordered pair of units as two struct columns.

    ``units`` is an aggregated table with one row per unit (periods, models), so the array
    that is exploded twice is bounded by the number of units, not by the data. The first explode
    is dealt out by unit, so no single task makes all the pairs.
    """
    keys = list(by or [])
    cols = [c for c in units.columns if c not in keys]
    packed = units.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("_u"))
    first = packed.select(*keys, F.explode("_u").alias(left), "_u").repartition(*keys, left)
    return first.select(*keys, left, F.explode("_u").alias(right))


def transfer_cells(moments: DataFrame, year: str = "year", quarter: str = "quarter",
                   by: list[str] | None = None) -> DataFrame:
    """R2, r and n of every period's line applied to every period, from moments alone.

    With the evaluation period's centred moments the mean squared error of a line a + b x is
    var_y - 2 b cov_xy + b^2 var_x + (mean_y - a - b mean_x)^2, so rows never meet.
    """
    keys = list(by or [])
    grid = unit_grid(moments, "m", "e", keys)
    b = F.try_divide("m.cxy", "m.vx")
    shift = F.col("e.my") - F.col("m.my") - b * (F.col("e.mx") - F.col("m.mx"))
    mse = F.col("e.vy") - 2 * b * F.col("e.cxy") + b * b * F.col("e.vx") + shift * shift
    r = F.signum(b) * F.try_divide(F.col("e.cxy"), F.sqrt("e.vx") * F.sqrt("e.vy"))
    return grid.select(
        *keys,
        F.col(f"m.{year}").alias("model_year"), F.col(f"m.{quarter}").alias("model_quarter"),
        F.col(f"e.{year}").alias("eval_year"), F.col(f"e.{quarter}").alias("eval_quarter"),
        F.col("e.n").alias("n"),
        (1 - F.try_divide(mse, F.col("e.vy"))).alias("r2"),
        F.when(b != 0, r).alias("pearson_r"),
    )


def margins(cells: DataFrame, value: str) -> DataFrame:
    """Grand, row and column means of a cell table by grouping sets."""
    return (
        cells.withColumn("model", F.struct("model_year", "model_quarter"))
        .withColumn("eval", F.struct("eval_year", "eval_quarter"))
        .groupingSets(
            [[], [F.col("model")], [F.col("eval")]], F.col("model"), F.col("eval")
        )
        .agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
        .select("model.model_year", "model.model_quarter", "eval.eval_year", "eval.eval_quarter",
                "mean", "n")
    )


def group_means(cells: DataFrame, group, values: list[str]) -> DataFrame:
    """Mean and non-null count of each measure per group."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.count(v).alias(f"{v}_n")]
    return cells.groupBy(group.alias("group")).agg(*aggs)


def score_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width counts over [min, max]; the last edge belongs to the last bin."""
    limits = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    # a constant column has one bin
    idx = F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), width), F.lit(0.0))), F.lit(bins - 1))
    return (
        attach_params(df.filter(F.col(value).isNotNull()), limits)
        .groupBy(idx.cast("int").alias("bin")).agg(
            F.first("_lo").alias("lo"), F.first("_hi").alias("hi"), F.count(F.lit(1)).alias("n")
        )
        .select(
            "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("left"),
            "n",
        )
    )
