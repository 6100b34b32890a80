"""Cell tables: gap features, two-sided lookups, additive decomposition, asymmetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from crossgrid.functions import metrics as M
from crossgrid.functions.ids import parse_quarter_label, quarter_label
from crossgrid.operators.accuracy import CELL_KEY
from crossgrid.operators.ranking import first_per_key
from crossgrid.session import attach_params, materialize


def gap_flags(cells: DataFrame) -> DataFrame:
    """same_season, same_year and the directional season pair of every cell."""
    return cells.withColumns({
        "same_season": (F.col("model_quarter") == F.col("eval_quarter")).cast("int"),
        "same_year": (F.col("model_year") == F.col("eval_year")).cast("int"),
        "season_pair": F.concat(
            F.lit("Q"), F.col("model_quarter").cast("string"), F.lit("->Q"),
            F.col("eval_quarter").cast("string"),
        ),
    })


def with_season_group(cells: DataFrame) -> DataFrame:
    return cells.withColumn("season_group", M.season_group(*CELL_KEY))


def off_diagonal(cells: DataFrame) -> DataFrame:
    return cells.filter(
        (F.col("model_year") != F.col("eval_year")) | (F.col("model_quarter") != F.col("eval_quarter"))
    )


def in_years(cells: DataFrame, years: list[int]) -> DataFrame:
    return cells.filter(F.col("model_year").isin(years) & F.col("eval_year").isin(years))


def period_means(wide: DataFrame, metrics: list[str], year: str = "year", quarter: str = "quarter") -> DataFrame:
    """Long (year, quarter, metric, mean), NULLs skipped."""
    long = wide.unpivot([year, quarter], metrics, "metric", "value")
    return long.groupBy(year, quarter, "metric").agg(F.avg("value").alias("mean"))


def metric_table(means: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per period with a column per metric (a period dimension)."""
    return means.groupBy("year", "quarter").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("mean"))).alias(m) for m in metrics
    ])


def gap_table(cells: DataFrame, periods: DataFrame, metrics: list[str]) -> DataFrame:
    """diff (eval - model) and abs diff of each metric; a missing period gives NULL."""

    def side(prefix: str) -> DataFrame:
        return periods.select(
            F.col("year").alias(f"{prefix}_year"), F.col("quarter").alias(f"{prefix}_quarter"),
            *[F.col(m).alias(f"_{prefix}_{m}") for m in metrics],
        )

    out = gap_flags(cells)
    for prefix in ("model", "eval"):
        out = out.join(side(prefix), [f"{prefix}_year", f"{prefix}_quarter"], "left")
    for m in metrics:
        out = out.withColumn(f"diff_{m}", F.col(f"_eval_{m}") - F.col(f"_model_{m}"))
        out = out.withColumn(f"abs_diff_{m}", F.abs(f"diff_{m}"))
    return out.drop(*[f"_{p}_{m}" for p in ("model", "eval") for m in metrics])


def union_cells(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """Union of two cell sources; the preferred one wins on a shared key."""
    both = preferred.withColumn("source_rank", F.lit(0)).unionByName(
        other.withColumn("source_rank", F.lit(1)), allowMissingColumns=True
    )
    return first_per_key(both, CELL_KEY, [F.col("source_rank")])


def symmetrize_pairs(pairs: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Both directed values of an unordered pair and their mean, skipping a missing one."""

    def directed(a: str, b: str, name: str) -> DataFrame:
        return cells.select(
            F.col("model_year").alias(f"model_{a}_year"), F.col("model_quarter").alias(f"model_{a}_quarter"),
            F.col("eval_year").alias(f"model_{b}_year"), F.col("eval_quarter").alias(f"model_{b}_quarter"),
            F.col(value).alias(name),
        )

    key = ["model_a_year", "model_a_quarter", "model_b_year", "model_b_quarter"]
    out = pairs.join(directed("a", "b", "r2_a_to_b"), key, "left").join(
        directed("b", "a", "r2_b_to_a"), key, "left"
    )
    known = F.col("r2_a_to_b").isNotNull().cast("int") + F.col("r2_b_to_a").isNotNull().cast("int")
    total = F.coalesce("r2_a_to_b", F.lit(0.0)) + F.coalesce("r2_b_to_a", F.lit(0.0))
    return out.withColumn("pair_transfer_r2", F.try_divide(total, known))


#: Conjugate gradients stop when what is left of the normal equations is this share of them.
CONVERGED = 1e-13


def _connected(links: DataFrame) -> DataFrame:
    """(a, component): the least node that each one reaches; names are halved by jumps, so rounds are logarithmic."""
    label = materialize(links.select("a").distinct().withColumn("component", F.col("a")), "labels")
    while True:
        near = links.join(label.select(F.col("a").alias("b"), F.col("component").alias("_near")), "b").groupBy("a").agg(F.min("_near").alias("_near"))
        low = label.join(near, "a").select("a", F.col("component").alias("_was"), F.least("component", "_near").alias("component"))
        jump = label.select(F.col("a").alias("component"), F.col("component").alias("_to"))
        label = materialize(low.join(jump, "component").select("a", "_was", F.least("component", "_to").alias("component")), "labels")
        if label.filter("component <> _was").isEmpty():
            return label.drop("_was")


def two_way_additive(cells: DataFrame, value: str) -> DataFrame:
    """mu + row + column effects by least squares, with residuals and the component of a cell.

    A sweep over row and column means solves a complete matrix. With cells missing, conjugate gradients on the normal
    equations of rows and columns go on until they are solved; every step sums over the cells once. Rows and columns that
    no chain of cells connects form components of their own; only there do effects compare. In each component the column
    effects average to zero over the cells, so the row effects hold its level."""
    present = materialize(cells.filter(F.col(value).isNotNull()).withColumns({
        "_u": F.concat_ws(":", F.lit("r"), "model_year", "model_quarter"), "_v": F.concat_ws(":", F.lit("c"), "eval_year", "eval_quarter")}), "present")
    total = present.agg(F.avg(value).alias("mu"), F.count(F.lit(1)).alias("n"), F.count_distinct("_u").alias("rows"), F.count_distinct("_v").alias("cols")).first()
    if not total.n:
        return present.drop("_u", "_v").withColumns({c: F.lit(None).cast("double") for c in ("mu", "row_effect", "col_effect", "residual")} | {"component": F.lit(None).cast("string")})
    y = (F.col(value) - total.mu).alias("y")
    links = materialize(present.select(F.col("_u").alias("a"), F.col("_v").alias("b"), y).union(present.select("_v", "_u", y)), "links")
    is_row = F.col("a").startswith("r")
    by_row = links.filter(is_row).groupBy("a").agg(F.avg("y").alias("x"))
    met = links.filter(~is_row).join(by_row.select(F.col("a").alias("b"), "x"), "b")
    x = by_row.union(met.groupBy("a").agg(F.avg(F.col("y") - F.col("x")).alias("x")))
    around = links.join(x.select(F.col("a").alias("b"), F.col("x").alias("_x")), "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("deg"), F.sum("y").alias("s"), F.sum("_x").alias("_x"))
    left = F.col("s") - F.col("deg") * F.col("x") - F.col("_x")
    nodes = materialize(around.join(x, "a").select("a", "deg", "s", "x", left.alias("r"), F.lit(0.0).alias("p")), "effects")
    complete = total.n == total.rows * total.cols
    if not complete:
        nodes = _conjugate(links, nodes, total.rows + total.cols)
        part = _connected(links)
    else:
        part = nodes.select("a", F.lit("c").alias("component"))
    placed = materialize(nodes.select("a", "deg", "x").join(part, "a"), "effects")
    level = placed.filter(~is_row).groupBy("component").agg((F.sum(F.col("deg") * F.col("x")) / F.sum("deg")).alias("_m"))
    effects = placed.join(level, "component").select("a", "component", (F.col("x") + F.when(is_row, F.col("_m")).otherwise(-F.col("_m"))).alias("x"))
    rows = effects.select(F.col("a").alias("_u"), F.col("x").alias("row_effect"), "component")
    cols = effects.select(F.col("a").alias("_v"), F.col("x").alias("col_effect"))
    out = present.join(rows, "_u").join(cols, "_v").withColumn("mu", F.lit(total.mu))
    return out.withColumn("residual", F.col(value) - F.col("mu") - F.col("row_effect") - F.col("col_effect")).select(
        *cells.columns, "mu", "row_effect", "col_effect", "residual", "component")


def _conjugate(links: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Solve deg * x + (sum of x over neighbours) = s from the start in ``nodes``, scaled by the degrees.

    A step writes one small table of nodes and takes three sums to the driver."""
    first = nodes.agg(F.sum(F.col("s") ** 2 / F.col("deg")), F.sum(F.col("r") ** 2 / F.col("deg"))).first()
    goal, rz, beta = CONVERGED**2 * (first[0] or 0.0), first[1], 0.0
    for _ in range(2 * most):
        if rz <= goal:
            break
        aimed = nodes.withColumn("p", F.col("r") / F.col("deg") + beta * F.col("p"))
        near = links.join(aimed.select(F.col("a").alias("b"), F.col("p").alias("_p")), "b").groupBy("a").agg(F.sum("_p").alias("_p"))
        step = materialize(aimed.join(near, "a").withColumn("q", F.col("deg") * F.col("p") + F.col("_p")).drop("_p"), "effects")
        pq = step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        alpha = rz / pq if pq else 0.0
        nodes = step.select("a", "deg", "s", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        now = nodes.agg(F.sum(F.col("r") ** 2 / F.col("deg"))).first()[0]
        beta, rz = now / rz, now
        if not alpha:
            break
    return nodes


def asymmetry(cells: DataFrame, value: str) -> DataFrame:
    """M - M^T for every cell whose mirror exists."""
    mirror = cells.select(
        F.col("eval_year").alias("model_year"), F.col("eval_quarter").alias("model_quarter"),
        F.col("model_year").alias("eval_year"), F.col("model_quarter").alias("eval_quarter"),
        F.col(value).alias("_mirror"),
    )
    return cells.join(mirror, CELL_KEY).withColumn("asymmetry", F.col(value) - F.col("_mirror")).drop("_mirror")


def combine_first(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Outer union of rows and columns by key; the left value wins where both exist."""
    values = [c for c in left.columns if c not in key]
    extra = [c for c in right.columns if c not in key and c not in values]
    shared = [c for c in values if c in right.columns]
    renamed = right.select(*key, *[F.col(c).alias(f"_r_{c}") for c in shared], *extra)
    joined = left.join(renamed, key, "full_outer")
    return joined.select(
        *key,
        *[F.coalesce(c, f"_r_{c}").alias(c) if c in shared else F.col(c) for c in values],
        *extra,
    )


def melt_matrix(wide: DataFrame, label: str, columns: list[str], value: str, drop_diagonal: bool = False) -> DataFrame:
    """Wide matrix with ``Q<q> <yyyy>`` labels to a long cell table; blank cells go."""
    long = wide.unpivot([label], columns, "_eval", value).filter(F.col(value).isNotNull())
    mq, my = parse_quarter_label(label)
    eq, ey = parse_quarter_label("_eval")
    out = long.select(
        my.alias("model_year"), mq.alias("model_quarter"), ey.alias("eval_year"),
        eq.alias("eval_quarter"), F.col(value),
    )
    return off_diagonal(out) if drop_diagonal else out


def pivot_matrix(cells: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """Long cells to a wide matrix; the label list is given, so no extra pass finds it."""
    return (
        cells.select(
            quarter_label("model_quarter", "model_year").alias("model"),
            quarter_label("eval_quarter", "eval_year").alias("_eval"), value,
        )
        .groupBy("model").pivot("_eval", labels).agg(F.first(value))
    )
