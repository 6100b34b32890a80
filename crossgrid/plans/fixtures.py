"""How the test tables stand in for predictions, tracts, pixels, coordinates and vectors.

Each function derives a table from the given ones and has an SQL text of the same meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crossgrid.functions import hashing as H
from crossgrid.operators.accuracy import line_moments, transfer_cells
from crossgrid.operators.cells import metric_table, period_means
from crossgrid.session import Tables

# --- predictions -----------------------------------------------------------------------

PRED_SQL = """
    SELECT l_returnflag AS state, l_linestatus AS variable, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           year(l_shipdate)::INTEGER AS year, quarter(l_shipdate)::INTEGER AS quarter,
           l_extendedprice AS label, 1500.0::DOUBLE * l_quantity * (1.0::DOUBLE - l_discount) AS pred,
           l_quantity AS quantity, l_discount AS discount, l_tax AS tax
    FROM lineitem"""


# the columns that tell one line item from another
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def predictions(t: Tables) -> DataFrame:
    """One prediction per line item: the label is its price, the prediction a unit price rule."""
    return t.lineitem.select(
        F.col("l_returnflag").alias("state"), F.col("l_linestatus").alias("variable"),
        *LINE_KEY,
        F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"),
        F.col("l_extendedprice").alias("label"),
        (1500.0 * F.col("l_quantity") * (1.0 - F.col("l_discount"))).alias("pred"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


# --- cells -----------------------------------------------------------------------------

MOMENTS_SQL = f"""
    SELECT year, quarter, count(*) AS n, avg(quantity) AS mx, avg(label) AS my,
           var_pop(quantity) AS vx, var_pop(label) AS vy, covar_pop(quantity, label) AS cxy
    FROM ({PRED_SQL}) GROUP BY year, quarter"""

CELLS_SQL = f"""
    SELECT model_year, model_quarter, eval_year, eval_quarter, n, 1 - mse / vy AS r2, r AS pearson_r
    FROM (SELECT m.year AS model_year, m.quarter AS model_quarter,
                 e.year AS eval_year, e.quarter AS eval_quarter, e.n, e.vy,
                 e.vy - 2 * m.cxy / m.vx * e.cxy + (m.cxy / m.vx) * (m.cxy / m.vx) * e.vx
                   + power(e.my - m.my - m.cxy / m.vx * (e.mx - m.mx), 2) AS mse,
                 sign(m.cxy) * e.cxy / sqrt(e.vx * e.vy) AS r
          FROM ({MOMENTS_SQL}) m, ({MOMENTS_SQL}) e)"""

CELL_KEY = "model_year, model_quarter, eval_year, eval_quarter"


def period_moments(t: Tables) -> DataFrame:
    return line_moments(predictions(t), ["year", "quarter"], "quantity", "label")


def cells(t: Tables) -> DataFrame:
    """The accuracy matrix: every ship quarter's price line applied to every ship quarter."""
    return transfer_cells(period_moments(t))


# --- period metrics --------------------------------------------------------------------

METRICS = ["cloud_frac", "ndvi", "valid_obs_frac"]

PERIODS_SQL = f"""
    SELECT year, quarter, avg(discount * 10) AS cloud_frac, avg(quantity / 50) AS ndvi,
           avg(1 - tax * 10) AS valid_obs_frac
    FROM ({PRED_SQL}) GROUP BY year, quarter"""


def summary_rows(t: Tables) -> DataFrame:
    return predictions(t).select(
        "year", "quarter", (F.col("discount") * 10).alias("cloud_frac"),
        (F.col("quantity") / 50).alias("ndvi"), (1 - F.col("tax") * 10).alias("valid_obs_frac"),
    )


def periods(t: Tables) -> DataFrame:
    """Mean of each quality and landscape metric per ship quarter."""
    return metric_table(period_means(summary_rows(t), METRICS), METRICS)


GAP_SQL = f"""
    SELECT c.*, (c.model_quarter = c.eval_quarter)::INTEGER AS same_season,
           (c.model_year = c.eval_year)::INTEGER AS same_year,
           'Q' || c.model_quarter || '->Q' || c.eval_quarter AS season_pair,
           {", ".join(f"e.{m} - m.{m} AS diff_{m}, abs(e.{m} - m.{m}) AS abs_diff_{m}" for m in METRICS)}
    FROM ({CELLS_SQL}) c
    LEFT JOIN ({PERIODS_SQL}) m ON m.year = c.model_year AND m.quarter = c.model_quarter
    LEFT JOIN ({PERIODS_SQL}) e ON e.year = c.eval_year AND e.quarter = c.eval_quarter"""

# --- tracts ----------------------------------------------------------------------------

TRACT_FEATURES = [
    "n_orders", "log_price", "urgent_pct", "finished_pct", "avg_quantity", "avg_discount",
    "avg_tax", "lines_per_order",
]

TRACTS_SQL = """
    SELECT o_custkey AS tract, CASE WHEN year(o_orderdate) <= 1998 THEN '1995-1998' ELSE '1999-2001' END AS period,
           count(*)::DOUBLE AS n_orders, ln(1 + avg(o_totalprice)) AS log_price,
           100.0::DOUBLE * avg((o_orderpriority = '1-URGENT')::INTEGER) AS urgent_pct,
           100.0::DOUBLE * avg((o_orderstatus = 'F')::INTEGER) AS finished_pct,
           sum(q) / sum(lines) AS avg_quantity, sum(d) / sum(lines) AS avg_discount,
           sum(x) / sum(lines) AS avg_tax, sum(lines) / count(*) AS lines_per_order,
           avg(o_totalprice) AS income, 100.0::DOUBLE * avg((o_totalprice < 100000)::INTEGER) AS poverty,
           max(o_totalprice) AS per_capita
    FROM orders LEFT JOIN (
        SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS q, sum(l_discount) AS d, sum(l_tax) AS x
        FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    GROUP BY 1, 2"""


def tracts(t: Tables) -> DataFrame:
    """Customer x order period as a tract: features, income, poverty and a held-out income."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("q"),
        F.sum("l_discount").alias("d"), F.sum("l_tax").alias("x"),
    )
    period = F.when(F.year("o_orderdate") <= 1998, "1995-1998").otherwise("1999-2001")

    def share(cond):
        return 100.0 * F.avg(cond.cast("int"))

    return (
        t.orders.join(per_order, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .groupBy(F.col("o_custkey").alias("tract"), period.alias("period"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_orders"),
            F.log1p(F.avg("o_totalprice")).alias("log_price"),
            share(F.col("o_orderpriority") == "1-URGENT").alias("urgent_pct"),
            share(F.col("o_orderstatus") == "F").alias("finished_pct"),
            F.try_divide(F.sum("q"), F.sum("lines")).alias("avg_quantity"),
            F.try_divide(F.sum("d"), F.sum("lines")).alias("avg_discount"),
            F.try_divide(F.sum("x"), F.sum("lines")).alias("avg_tax"),
            F.try_divide(F.sum("lines"), F.count(F.lit(1))).alias("lines_per_order"),
            F.avg("o_totalprice").alias("income"),
            share(F.col("o_totalprice") < 100000).alias("poverty"),
            F.max("o_totalprice").alias("per_capita"),
        )
    )


# --- coordinates -----------------------------------------------------------------------

COORDS_SQL = """
    SELECT c_custkey AS id, c_acctbal AS value,
           -125.0 + 55.0 * (('0x' || substr(md5('lon:' || c_custkey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE) AS lon,
           25.0 + 24.0 * (('0x' || substr(md5('lat:' || c_custkey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE) AS lat
    FROM customer"""


def coords(t: Tables) -> DataFrame:
    """One point per customer, placed by a hash of its key."""
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"),
        (-125.0 + 55.0 * H.hash_unit(F.lit("lon"), "c_custkey")).alias("lon"),
        (25.0 + 24.0 * H.hash_unit(F.lit("lat"), "c_custkey")).alias("lat"),
    )


# --- pixels ----------------------------------------------------------------------------

PIXELS_SQL = """
    SELECT vec_id AS chip_id, label AS state, (vec_id % 4 + 1)::INTEGER AS quarter, px,
           list_transform(range(1, 13), lambda b: greatest(0.0::DOUBLE, round(embedding[px * 12 + b]::DOUBLE * 100000))) AS bands
    FROM embeddings, (SELECT unnest(range(0, 6)) AS px)"""


def pixels(t: Tables) -> DataFrame:
    """Six 12-band pixels per embedding, the last one filled up with nodata; values at or below zero are nodata (0)."""
    return t.embeddings.select(
        F.col("vec_id").alias("chip_id"), F.col("label").alias("state"),
        (F.col("vec_id") % 4 + 1).cast("int").alias("quarter"),
        F.explode(F.sequence(F.lit(0), F.lit(5))).alias("px"), "embedding",
    ).select(
        "chip_id", "state", "quarter", "px",
        F.transform(
            F.sequence(F.lit(0), F.lit(11)),
            lambda b: F.greatest(F.lit(0.0), F.round(F.get("embedding", F.col("px") * 12 + b).cast("double") * 100000)),
        ).alias("bands"),
    )


# --- parameter vectors -----------------------------------------------------------------

PARAMS_SQL = """
    SELECT label AS model, idx::INTEGER AS idx, avg(embedding[idx]::DOUBLE) AS value
    FROM embeddings, (SELECT unnest(range(1, 65)) AS idx) GROUP BY label, idx"""


def params(t: Tables) -> DataFrame:
    """Long parameter table: the mean embedding of each label is one model's vector."""
    return (
        t.embeddings.select("label", F.posexplode("embedding"))
        .groupBy(F.col("label").alias("model"), (F.col("pos") + 1).alias("idx"))
        .agg(F.avg(F.col("col").cast("double")).alias("value"))
    )
