"""Linear regression from moments.

One aggregation makes a (k+1) x (k+1) matrix of centred cross products per model; its size
does not depend on the rows. Solving it is a k x k problem on an aggregated row, done in a
small numpy step on the executors. Cluster-robust errors take a second aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from crossgrid.functions.metrics import normal_two_sided, student_t_two_sided
from crossgrid.session import attach_params, materialize, small_side

Z_975 = 1.959963984540054


def moment_rows(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None,
                within: str | None = None) -> DataFrame:
    """One row per ``by`` group: n, means and upper-triangle cross products of (y, xs).

    Rows with a NULL among them are left out. With ``within`` the cross products are taken
    around the means of each level of that column (its dummies are partialled out), ``levels``
    counts the levels and ``sst`` is the total sum of squares of y.
    """
    by = list(by or [])
    cols = [y, *xs]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    clean = df.dropna(subset=[*cols, *([within] if within else [])]).select(
        *by, *([within] if within else []), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    means = "array(" + ", ".join(f"avg(_c{i})" for i in range(len(cols))) + ")"
    cross = "array(" + ", ".join(f"count(1) * covar_pop(_c{i}, _c{j})" for i, j in pairs) + ")"
    if within is None:
        return clean.groupBy(*by).agg(
            F.expr("count(1)").alias("n"), F.expr(means).alias("means"), F.expr(cross).alias("cross"),
            F.expr("CAST(1 AS BIGINT)").alias("levels"), F.expr("count(1) * var_pop(_c0)").alias("sst"))
    # by level first: partial sums of the same matrix, then around each level's own mean
    level = clean.groupBy(*by, within).agg(
        F.expr("count(1)").alias("_n"), F.expr(cross).alias("_x"), F.expr("avg(_c0)").alias("_m"))
    added = "array(" + ", ".join(f"sum(_x[{k}])" for k in range(len(pairs))) + ")"
    return level.groupBy(*by).agg(
        F.expr("sum(_n)").alias("n"), F.expr("CAST(NULL AS ARRAY<DOUBLE>)").alias("means"),
        F.expr(added).alias("cross"), F.expr("count(1)").alias("levels"),
        # within + between sum of squares
        F.expr("sum(_x[0]) + sum(_n * _m * _m) - sum(_n * _m) * sum(_n * _m) / sum(_n)").alias("sst"))


def unpack(cross, k: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    s = np.zeros((k, k))
    s[np.triu_indices(k)] = cross
    return s + s.T - np.diag(np.diag(s))


def _coef_rows(row, terms: list[str], min_rows: int):
    k = len(terms)
    if pd.isna(row.n) or row.n < k + min_rows:
        return
    n = int(row.n)
    s = unpack(row.cross, k + 1)
    inv = np.linalg.pinv(s[1:, 1:])
    b = inv @ s[1:, 0]
    ssr = max(0.0, s[0, 0] - b @ s[1:, 0])  # rounding may take a perfect fit below zero
    if ssr <= 1e-13 * s[0, 0]:
        ssr = 0.0
    has_means = row.means is not None
    params = k + (1 if has_means else int(row.levels))
    dof = n - params
    if dof <= 0:
        return
    sigma2 = ssr / dof
    names, coef, var = list(terms), list(b), list(np.diag(inv) * sigma2)
    if has_means:
        m = np.asarray(row.means, dtype=float)
        names.insert(0, "const")
        coef.insert(0, m[0] - b @ m[1:])
        var.insert(0, sigma2 * (1.0 / n + m[1:] @ inv @ m[1:]))
    # a constant label has no R2, a perfect fit no likelihood
    r2 = 1 - ssr / row.sst if row.sst > 1e-13 * n else None
    adjusted = None if r2 is None else 1 - (1 - r2) * (n - 1) / dof
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) if ssr > 0 else None
    fit = (r2, adjusted, *((None, None) if llf is None else (2 * params - 2 * llf, math.log(n) * params - 2 * llf)), n)
    for name, c, v in zip(names, coef, var):
        se = math.sqrt(max(0.0, v))
        t = c / se if se > 0 else float("nan")
        yield (name, float(c), se, t, student_t_two_sided(t, dof), *fit)


COEF_SCHEMA = (
    "term STRING, coef DOUBLE, std_err DOUBLE, t DOUBLE, p_value DOUBLE, r_squared DOUBLE, "
    "adj_r_squared DOUBLE, aic DOUBLE, bic DOUBLE, n_obs BIGINT"
)


def solve_ols(moments: DataFrame, terms: list[str], by: list[str] | None = None, min_rows: int = 3) -> DataFrame:
    """Coefficient rows with the fit statistics of each moment row; too few rows give none."""
    by = list(by or [])
    names = [f.strip().split(" ")[0] for f in COEF_SCHEMA.split(",")]
    types = {f.name: f.dataType.simpleString() for f in moments.schema.fields}

    def solve(batches):
        for pdf in batches:
            out = [
                (*[getattr(row, c) for c in by], *coef)
                for row in pdf.itertuples(index=False) for coef in _coef_rows(row, terms, min_rows)
            ]
            yield pd.DataFrame(out, columns=[*by, *names])

    schema = ", ".join([*[f"{c} {types[c]}" for c in by], COEF_SCHEMA])
    return moments.mapInPandas(solve, schema)


def ols(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    return solve_ols(moment_rows(df, y, xs, by), xs, by)


def nested_r2(df: DataFrame, y: str, blocks: list[tuple[str, list[str]]], dummies: str, dummies_after: int) -> DataFrame:
    """R2 of nested models on the same rows: (block, r_squared, r_squared_added, n_obs).

    Blocks add columns in order; the dummies of a column join after block ``dummies_after``.
    """
    every = [c for _, cols in blocks for c in cols]
    clean = df.dropna(subset=[y, *every, dummies])
    plain = moment_rows(clean, y, every).select(F.lit(0).alias("kind"), "n", "cross", "levels", "sst")
    inside = moment_rows(clean, y, every, within=dummies).select(F.lit(1).alias("kind"), "n", "cross", "levels", "sst")

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                s = unpack(row.cross, len(every) + 1)
                used = 0
                for i, (name, cols) in enumerate(blocks):
                    used += len(cols)
                    in_dummies = i >= dummies_after
                    if cols or in_dummies:
                        if bool(row.kind) == in_dummies:
                            idx = list(range(1, used + 1))
                            b = np.linalg.pinv(s[np.ix_(idx, idx)]) @ s[idx, 0] if idx else np.zeros(0)
                            ssr = s[0, 0] - (b @ s[idx, 0] if idx else 0.0)
                            out.append((i, name, float(1 - ssr / row.sst), int(row.n)))
            yield pd.DataFrame(out, columns=["block_no", "block", "r_squared", "n_obs"])

    fits = plain.unionByName(inside).mapInPandas(solve, "block_no INT, block STRING, r_squared DOUBLE, n_obs BIGINT")
    # a handful of blocks, whatever the data
    previous = F.lag("r_squared", 1, 0.0).over(W.partitionBy("n_obs").orderBy("block_no"))
    return fits.withColumn("r_squared_added", F.col("r_squared") - previous)


CLUSTER_SCHEMA = (
    "term STRING, coef DOUBLE, se DOUBLE, p DOUBLE, standardized DOUBLE, ci_lower DOUBLE, "
    "ci_upper DOUBLE, n BIGINT, n_clusters BIGINT, n_params INT, r2 DOUBLE, low_cluster_count BOOLEAN"
)


def _attach(df: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """Parameters of each model (one row per ``by`` group) to its rows."""
    return df.join(params, by) if by else attach_params(df, params)


def cluster_ols(df: DataFrame, y: str, xs: list[str], factor: str, cluster: str, by: list[str] | None = None,
                min_std: float = 1e-8, min_clusters: int = 30) -> DataFrame:
    """y ~ xs + C(factor) with cluster-robust errors and normal p-values, one model per ``by`` group.

    The factor is partialled out by its level means (one row per level). Pass 1 gives the
    coefficients, pass 2 sums the scores per cluster; both are map-side combined aggregates that
    serve all models at once, so a cluster that holds a large share of the rows is no
    bottleneck. Near-constant controls (all but the first term) are dropped per model.
    """
    by = list(by or [])
    # the passes below read a written table, not the joins it came from
    clean = materialize(df.dropna(subset=[y, *xs, factor, cluster]).select(
        *by, F.col(factor).alias("_f"), F.col(cluster).alias("_g"),
        *[F.col(c).cast("double").alias(c) for c in (y, *xs)]), "regression")
    types = {f.name: f.dataType.simpleString() for f in clean.schema.fields}
    by_schema = [f"{c} {types[c]}" for c in by]
    spread = clean.groupBy(*by).agg(F.expr(
        "array(" + ", ".join(f"coalesce(stddev_samp({c}), 0)" for c in (y, *xs)) + ")").alias("sds"))
    solved = small_side(_attach(moment_rows(clean, y, xs, by, within="_f"), spread, by), "moments")
    k = len(xs)

    def keep(row):
        return [0] + [i for i in range(1, k) if row.sds[i + 1] >= min_std]

    def coefficients(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                b = np.zeros(k)
                if not pd.isna(row.n) and row.n >= 2:
                    s = unpack(row.cross, k + 1)
                    idx = [i + 1 for i in keep(row)]
                    b[[i - 1 for i in idx]] = np.linalg.pinv(s[np.ix_(idx, idx)]) @ s[idx, 0]
                out.append((*[getattr(row, c) for c in by], b.tolist()))
            yield pd.DataFrame(out, columns=[*by, "_b"])

    beta = small_side(solved.mapInPandas(coefficients, ", ".join([*by_schema, "_b ARRAY<DOUBLE>"])), "beta")
    means = small_side(clean.groupBy(*by, "_f").agg(*[F.avg(c).alias(f"_m_{c}") for c in (y, *xs)]), "levels")
    centred = clean.join(means, [*by, "_f"])
    residual = f"({y} - _m_{y})" + "".join(f" - _b[{i}] * ({c} - _m_{c})" for i, c in enumerate(xs))
    scored = _attach(centred, beta, by).withColumn("_u", F.expr(residual))
    scores = scored.groupBy(*by, "_g").agg(
        *[F.expr(f"sum(({c} - _m_{c}) * _u)").alias(f"_s{i}") for i, c in enumerate(xs)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    meat = scores.groupBy(*by).agg(
        F.expr("array(" + ", ".join(f"sum(_s{i} * _s{j})" for i, j in pairs) + ")").alias("meat"),
        F.count(F.lit(1)).alias("clusters"))
    final = _attach(solved, meat, by)
    names = [f.strip().split(" ")[0] for f in CLUSTER_SCHEMA.split(",")]

    def sandwich(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if pd.isna(row.n) or row.clusters < 2:
                    continue
                s, meat_m = unpack(row.cross, k + 1), unpack(row.meat, k)
                kept = keep(row)
                idx = [i + 1 for i in kept]
                bread = np.linalg.pinv(s[np.ix_(idx, idx)])
                b = bread @ s[idx, 0]
                n, g = int(row.n), int(row.clusters)
                params = len(kept) + int(row.levels)
                if n <= params:
                    continue
                v = bread @ meat_m[np.ix_(kept, kept)] @ bread * (g / (g - 1)) * ((n - 1) / (n - params))
                r2 = 1 - (s[0, 0] - b @ s[idx, 0]) / row.sst
                for p, i in enumerate(kept):
                    se = math.sqrt(v[p, p])
                    std = b[p] * row.sds[i + 1] / row.sds[0] if row.sds[0] > 0 else None
                    out.append((*[getattr(row, c) for c in by], xs[i], float(b[p]), se,
                                normal_two_sided(b[p] / se) if se > 0 else None, std,
                                b[p] - Z_975 * se, b[p] + Z_975 * se, n, g, params, float(r2), g < min_clusters))
            yield pd.DataFrame(out, columns=[*by, *names])

    return final.mapInPandas(sandwich, ", ".join([*by_schema, CLUSTER_SCHEMA]))


def _labelled(errors: DataFrame, runs: list[tuple[str, int, int]]) -> DataFrame:
    """Penalties of several (label, train, eval) transfers as one long table."""
    parts = [transfer_penalty(errors, a, b).withColumn("regression", F.lit(label)) for label, a, b in runs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def penalty_suite(errors: DataFrame, features: DataFrame, primary: str, classes: list[str], reference: str,
                  urban: str, urban_threshold: float = 0.5, min_urban: int = 30,
                  amplitude: DataFrame | None = None) -> DataFrame:
    """Main, dose-response, urban, reverse and amplitude regressions of the transfer penalty.

    ``errors`` is long (key, year, train_quarter, eval_quarter, error) and small next to the rows
    it came from; callers hand over a written table. All regressions on the same terms run as
    one grouped fit. ``amplitude`` is (key, amplitude): keys without one drop out of that
    regression only.
    """
    def terms(first: str) -> list[str]:
        return [first, *[c for c in classes if c not in (first, reference)]]

    runs = [("Q1->Q2", 1, 2), ("Q1->Q3", 1, 3), ("Q1->Q4", 1, 4), ("Q1->Q3 urban", 1, 3), ("Q3->Q1 reverse", 3, 1)]
    rows = _labelled(errors, runs).join(features, "key").filter(
        (F.col("regression") != "Q1->Q3 urban") | (F.col(urban) > urban_threshold))
    out = cluster_ols(rows, "penalty", terms(primary), "year", "key", ["regression"]).filter(
        (F.col("regression") != "Q1->Q3 urban") | (F.col("n_clusters") >= min_urban))
    if amplitude is not None:
        rows = _labelled(errors, [("Q1->Q3 amplitude", 1, 3)]).join(features.join(amplitude, "key", "left"), "key")
        out = out.unionByName(cluster_ols(rows, "penalty", terms("amplitude"), "year", "key", ["regression"]))
    return out.withColumns({"reference_class": F.lit(reference), "n_tracts": F.col("n_clusters")})


def dose_response(errors: DataFrame, features: DataFrame, primary: str, classes: list[str], reference: str,
                  train: int = 1, targets: tuple = (2, 3, 4)) -> DataFrame:
    """Primary coefficient with its interval per transfer distance, from one grouped fit."""
    xs = [primary, *[c for c in classes if c not in (primary, reference)]]
    rows = _labelled(errors, [(str(ev), train, ev) for ev in targets]).join(features, "key")
    fit = cluster_ols(rows, "penalty", xs, "year", "key", ["regression"]).filter(F.col("term") == primary)
    ev = F.col("regression").cast("int")
    return fit.select(
        F.concat(F.lit(f"Q{train}->Q"), F.col("regression")).alias("transfer"), (ev - train).alias("distance_quarters"),
        "coef", "se", "ci_lower", "ci_upper", "n",
        ((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)).alias("significant"))


def transfer_penalty(errors: DataFrame, train: int, ev: int) -> DataFrame:
    """error(train -> eval) minus error(eval -> eval) per (key, year), in one pass."""
    moved = F.max(F.when((F.col("train_quarter") == train) & (F.col("eval_quarter") == ev), F.col("error")))
    home = F.max(F.when((F.col("train_quarter") == ev) & (F.col("eval_quarter") == ev), F.col("error")))
    wide = errors.filter(F.col("eval_quarter") == ev).groupBy("key", "year").agg(moved.alias("_x"), home.alias("_m"))
    return wide.filter("_x IS NOT NULL AND _m IS NOT NULL").select("key", "year", (F.col("_x") - F.col("_m")).alias("penalty"))
