"""Operators against brute force, goldens and metamorphic relations on small fixtures."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossgrid.functions import hashing as H
from crossgrid.operators import (
    accuracy as A, bootstrap as B, cells as C, composite as CI, importance as I, quantile as Q, ranking as R, raster as RA,
    recovery as RC, regress as G, resample as S, spatial as SP, vectors as V,
)
from crossgrid.session import materialize, scratch_path
from crossgrid.sources import readers, sinks


@pytest.fixture(scope="module")
def skewed(spark):
    """Three groups; the first holds most rows, and one value repeats a lot."""
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(np.arange(n) < 2000, "hot", np.where(np.arange(n) < 2900, "mid", "few"))
    v = np.where(rng.random(n) < 0.3, 7.0, np.exp(3 * rng.normal(size=n)))
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v})


def test_hashed_rank_is_row_number(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("h", H.hash_order("id"))
    got = R.hashed_rank(df, ["g"], "h", "k", prefix=2).toPandas()
    got["want"] = got.groupby("g")["h"].rank(method="first").astype(int)
    assert (got["k"] == got["want"]).all()


@pytest.mark.parametrize("bins, levels", [(8, 1), (8, 3), (65536, 1)])
def test_exact_quantiles(spark, skewed, bins, levels):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame(skewed)
    got = {(r.g, r.prob): r.value for r in Q.exact_quantiles(df, "v", probs, ["g"], bins=bins, levels=levels).collect()}
    for g, part in skewed.groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(part["v"], p), rel=1e-12)
    overall = {r.prob: r.value for r in Q.exact_quantiles(df, "v", probs, bins=bins, levels=levels).collect()}
    for p in probs:
        assert overall[p] == pytest.approx(np.quantile(skewed["v"], p), rel=1e-12)


def test_quantiles_of_one_row_and_constants(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 2.0), ("b", 2.0), ("c", None)], "g string, v double")
    got = {(r.g, r.prob): r.value for r in Q.exact_quantiles(df, "v", [0.2, 0.5], ["g"]).collect()}
    assert got == {("a", 0.2): 5.0, ("a", 0.5): 5.0, ("b", 0.2): 2.0, ("b", 0.5): 2.0}


def test_sample_per_group_and_dedup(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("h", H.hash_order("id"))
    got = R.sample_per_group(df, ["g"], "h", 150).toPandas()
    full = df.toPandas()
    for g, part in full.groupby("g"):
        want = set(part.sort_values("h").head(150)["id"])
        assert set(got[got["g"] == g]["id"]) == want
    first = R.first_per_key(df, ["g"], [F.col("id")]).toPandas().set_index("g")["id"].to_dict()
    assert first == {"hot": 0, "mid": 2000, "few": 2900}
    last = R.last_per_key(df, ["g"], [F.col("id")]).toPandas().set_index("g")["id"].to_dict()
    assert last == {"hot": 1999, "mid": 2899, "few": 2999}


def test_latest_version(spark):
    names = [("a", "/x/v1"), ("a", "/x/v2"), ("a", "/x/v10"), ("b", "/x/v3"), ("b", "/x/readme")]
    got = {r.k: (r.latest, r.latest_name, r.next_free) for r in R.latest_version(
        spark.createDataFrame(names, ["k", "name"]), ["k"], "name", r"/v(\d+)$").collect()}
    assert got == {"a": (10, "/x/v10", 3), "b": (3, "/x/v3", 1)}


def test_root_prefix(spark):
    ok = R.shortest_root(spark.createDataFrame([("oh",), ("oh_q1",), ("oh_q2",)], ["n"]), "n").first()
    assert (ok.root, ok.consistent) == ("oh", True)
    bad = R.shortest_root(spark.createDataFrame([("oh",), ("ohio",)], ["n"]), "n").first()
    assert (bad.root, bad.consistent) == (None, False)


def test_transfer_cells_equal_row_scoring(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"year": rng.integers(2016, 2018, 400), "quarter": rng.integers(1, 5, 400), "x": rng.normal(size=400) + 50})
    pdf["y"] = 3 * pdf["x"] + pdf["quarter"] * rng.normal(size=400) + pdf["year"]
    got = A.transfer_cells(A.line_moments(spark.createDataFrame(pdf), ["year", "quarter"], "x", "y")).toPandas()
    assert len(got) == 64
    groups = dict(list(pdf.groupby(["year", "quarter"])))
    for row in got.itertuples():
        train, ev = groups[(row.model_year, row.model_quarter)], groups[(row.eval_year, row.eval_quarter)]
        b, a = np.polyfit(train["x"], train["y"], 1)
        f = a + b * ev["x"]
        assert row.n == len(ev)
        assert row.r2 == pytest.approx(1 - ((ev["y"] - f) ** 2).sum() / ((ev["y"] - ev["y"].mean()) ** 2).sum(), abs=1e-8)
        assert row.pearson_r == pytest.approx(np.corrcoef(ev["y"], f)[0, 1], abs=1e-8)


def test_accuracy_on_prediction_rows(spark):
    """Rows in the shape of a prediction file: negative R2 and r of opposite sign."""
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 2.0), ("a", 3.0, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)], ["k", "y", "f"])
    got = {r.k: r for r in A.accuracy(df, ["k"], "y", "f").collect()}
    assert (got["a"].n, got["a"].r2, got["a"].pearson_r, got["a"].bias) == (3, pytest.approx(-3.0), pytest.approx(-1.0), pytest.approx(0.0))
    assert got["b"].r2 is None and got["b"].pearson_r is None and got["b"].mae == 0.5


def _additive(spark, cells):
    """The fit as a frame, and plain least squares on indicator columns."""
    got = C.two_way_additive(spark.createDataFrame([(1, int(i), 1, int(j), float(v)) for i, j, v in cells], [*A.CELL_KEY, "r2"]), "r2").toPandas()
    rows, cols = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    x = np.zeros((len(cells), len(rows) + len(cols)))
    for k, (i, j, _) in enumerate(cells):
        x[k, rows.index(i)] = x[k, len(rows) + cols.index(j)] = 1
    y = np.array([c[2] for c in cells])
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return got.sort_values(["model_quarter", "eval_quarter"]), {(i, j): v - f for (i, j, v), f in zip(cells, fitted, strict=True)}


def test_additive_fit_of_incomplete_matrices(spark):
    """A narrow band, random holes and two unconnected blocks: the residuals of least squares, effects centred by component."""
    rng = np.random.default_rng(2)
    noise = lambda i, j: 0.1 * i - 0.03 * j * j + rng.normal()
    cases = [
        ([(i, j, noise(i, j)) for i in range(14) for j in range(14) if abs(i - j) <= 2], 1),
        ([(i, j, noise(i, j)) for i in range(9) for j in range(7) if rng.random() < 0.6 or i == 0 or j == 0], 1),
        ([(i, j, noise(i, j) + 5 * (i < 4)) for i in range(8) for j in range(9) if (i < 4) == (j < 3) and (i, j) != (0, 1)], 2),
        ([(i, j, noise(i, j)) for i in range(5) for j in range(6)], 1),
    ]
    for cells, parts in cases:
        got, want = _additive(spark, cells)
        assert np.allclose(got["residual"], [want[i, j] for i, j in zip(got["model_quarter"], got["eval_quarter"], strict=True)], atol=1e-8)
        assert got["component"].nunique() == parts
        assert np.allclose(got["mu"] + got["row_effect"] + got["col_effect"] + got["residual"], got["r2"])
        assert np.allclose(got.groupby("component")["col_effect"].mean(), 0, atol=1e-10)
    empty = C.two_way_additive(spark.createDataFrame([(1, 1, 1, 1, None)], "model_year int, model_quarter int, eval_year int, eval_quarter int, r2 double"), "r2")
    assert empty.count() == 0 and empty.columns[-1] == "component"


def test_additive_plan_does_not_stack_windows(spark, capsys):
    cells = spark.createDataFrame([(1, i, 1, j, float(i * j)) for i in range(4) for j in range(4) if i != j], [*A.CELL_KEY, "r2"])
    C.two_way_additive(cells, "r2").explain()
    assert "Window" not in capsys.readouterr().out


def test_matrix_round_trip(spark):
    labels = ["Q1 2016", "Q2 2016"]
    df = spark.createDataFrame([(2016, 1, 2016, 1, 0.5), (2016, 1, 2016, 2, 0.4), (2016, 2, 2016, 2, None)], "model_year int, model_quarter int, eval_year int, eval_quarter int, r2 double")
    wide = C.pivot_matrix(df, "r2", labels)
    assert wide.columns == ["model", *labels]
    long = C.melt_matrix(wide, "model", labels, "r2")
    assert sorted(tuple(r) for r in long.collect()) == [(2016, 1, 2016, 1, 0.5), (2016, 1, 2016, 2, 0.4)]
    assert [tuple(r) for r in C.melt_matrix(wide, "model", labels, "r2", True).collect()] == [(2016, 1, 2016, 2, 0.4)]


def test_union_cells_prefers_first(spark):
    a = spark.createDataFrame([(1, 1, 1, 1, 0.9)], [*A.CELL_KEY, "r2"])
    b = spark.createDataFrame([(1, 1, 1, 1, 0.1), (1, 1, 1, 2, 0.2)], [*A.CELL_KEY, "r2"])
    assert sorted(r.r2 for r in C.union_cells(a, b).collect()) == [0.2, 0.9]


# --- composite index ---------------------------------------------------------------------


def test_index_matches_pandas_and_gate(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.normal(size=n), "income": rng.normal(size=n)})
    pdf["income"] += pdf["a"] - 0.5 * pdf["b"]
    pdf.loc[rng.random(n) < 0.1, "b"] = None
    pdf.loc[rng.random(n) < 0.05, "income"] = None
    pdf.loc[30:, "c"] = None  # below the gate: left out
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in pdf.columns])  # NaN to NULL at the source
    defs = {"idx": ("a", "b", "c")}
    fit = CI.fit_indices(df, defs, "income", min_non_null=100)
    got = CI.apply_indices(df, fit, defs).toPandas()["idx"]
    full = pdf[["a", "b", "income"]].dropna()
    w = {f: full[f].corr(full["income"]) for f in "ab"}
    x = pdf[["a", "b"]].dropna()
    z = (x - x.mean()) / x.std(ddof=0)
    raw = sum(w[f] * z[f] for f in "ab")
    want = ((raw - raw.mean()) / raw.std()).reindex(pdf.index)
    assert got.isna().equals(want.isna())
    assert np.allclose(got.dropna(), want.dropna(), atol=1e-9)
    weights = {r.feature: r.weight for r in CI.weights_long(fit, defs).collect()}
    assert weights["a"] == pytest.approx(w["a"]) and weights["b"] == pytest.approx(w["b"])


# --- resampling ----------------------------------------------------------------------------


def test_permute_units_is_a_permutation(spark):
    units = spark.createDataFrame([(y, q, float(10 * y + q)) for y in range(4) for q in (1, 2)], "year int, quarter int, v double")
    got = S.permute_units(units, ["year", "quarter"], "v", 20, within=["quarter"]).toPandas()
    want = sorted(10 * y + q for y in range(4) for q in (1, 2))
    assert got.groupby("perm")["v"].apply(lambda s: sorted(s) == want).all()
    assert ((got["v"] % 10) == got["quarter"]).all()
    assert (got[got["perm"] == 0]["v"] == 10 * got[got["perm"] == 0]["year"] + got[got["perm"] == 0]["quarter"]).all()
    assert got.sort_values(["quarter", "year"]).groupby("perm")["v"].apply(tuple).nunique() > 3


def test_sequential_test_against_lstsq(spark):
    rng = np.random.default_rng(2)
    years, quarters = (2016, 2017, 2018), (1, 2, 3, 4)
    per = pd.DataFrame([(y, q, rng.normal(), rng.normal()) for y in years for q in quarters], columns=["year", "quarter", "cloud", "land"])
    m = {(r.year, r.quarter): r for r in per.itertuples()}
    rows = []
    for a in m:
        for b in m:
            if a != b:
                rows.append((*a, *b, rng.normal(), f"Q{a[1]}->Q{b[1]}", m[b].cloud - m[a].cloud, abs(m[b].cloud - m[a].cloud)))
    pdf = pd.DataFrame(rows, columns=[*A.CELL_KEY, "r2", "season_pair", "dc", "ac"])
    n_perms = 5
    out = S.sequential_test(materialize(spark.createDataFrame(pdf), "g"), spark.createDataFrame(per), "r2", ["dc", "ac"], "season_pair", "land", n_perms).first()
    perms = S.permute_units(spark.createDataFrame(per[["year", "quarter", "land"]]), ["year", "quarter"], "land", n_perms, within=["quarter"]).toPandas()

    def r2(cols):
        x = np.column_stack([pd.get_dummies(pdf["season_pair"]).to_numpy(float), *cols])
        res = pdf["r2"] - x @ np.linalg.lstsq(x, pdf["r2"], rcond=None)[0]
        return 1 - (res ** 2).sum() / ((pdf["r2"] - pdf["r2"].mean()) ** 2).sum()

    base = r2([pdf["dc"], pdf["ac"]])
    added = {}
    for i, part in perms.groupby("perm"):
        v = {(r.year, r.quarter): r.land for r in part.itertuples()}
        d = np.array([v[(r.eval_year, r.eval_quarter)] - v[(r.model_year, r.model_quarter)] for r in pdf.itertuples()])
        added[i] = r2([pdf["dc"], pdf["ac"], d, abs(d)]) - base
    assert out.observed_r2_added == pytest.approx(added[0], abs=1e-8)
    null = [added[i] for i in range(1, n_perms + 1)]
    assert out.null_mean == pytest.approx(np.mean(null), abs=1e-8)
    assert out.p_value == pytest.approx((1 + sum(v >= added[0] for v in null)) / (n_perms + 1))


def test_insufficient_groups(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.6), (2, 3, 0.7)], ["a_m", "b_m", "s"])
    units = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], ["m", "g"])
    out = S.label_gap_test(pairs, units, ["m"], "g", "s", 9).first()
    assert out.insufficient_data and out.observed_gap is None and out.p_value is None


def test_label_gaps_of_groups_are_those_of_each_group(spark):
    rng = np.random.default_rng(21)
    units = [(y, q) for y in (1, 2) for q in (1, 2, 3)]
    rows = [(g, *a, *b, float(rng.normal() + (g == "x") * (a[1] == b[1]))) for g in ("x", "y") for k, a in enumerate(units) for b in units[k + 1 :]]
    pairs = spark.createDataFrame(rows, "g string, a_year int, a_quarter int, b_year int, b_quarter int, s double")
    known = spark.createDataFrame(units, "year int, quarter int")
    got = {r.g: r for r in S.label_gap_tests(pairs, known, ["year", "quarter"], "quarter", "s", ["g"], 99).collect()}
    for g in ("x", "y"):
        one = S.label_gap_test(pairs.filter(F.col("g") == g).drop("g"), known, ["year", "quarter"], "quarter", "s", 99).first()
        assert (got[g].observed_gap, got[g].p_value, got[g].n_perms) == (pytest.approx(one.observed_gap), one.p_value, 99)


def test_incomplete_states_are_reported(spark):
    df = spark.createDataFrame([("a", "l1"), ("a", "l2"), ("b", "l1")], "state string, layer_group string")
    whole, lacking = RC.complete_states(df, ("l1", "l2"))
    assert {r.state for r in whole.collect()} == {"a"} and [(r.state, r.missing) for r in lacking.collect()] == [("b", ["l2"])]


def test_bootstrap_of_exact_predictions(spark):
    df = spark.createDataFrame([("c", i, float(i), float(i)) for i in range(40)], ["cell", "k", "y", "f"])
    for fn in (B.bootstrap_r2, B.bootstrap_r2_poisson):
        out = fn(df, ["cell"], ["k"], "y", "f", 12).first()
        assert (out.n_boot, out.r2_boot_mean, out.r2_boot_std) == (12, 1.0, 0.0)
    flat = df.withColumn("y", F.lit(1.0))
    assert B.bootstrap_r2(flat, ["cell"], ["k"], "y", "f", 5).count() == 0
    assert B.bootstrap_r2(df.limit(0), ["cell"], ["k"], "y", "f", 5).count() == 0


def _boot_frame(rng, sizes):
    rows = [(c, i, float(y), float(y + e)) for c, n in sizes.items() for i, (y, e) in enumerate(zip(rng.normal(5, 2, n), rng.normal(0, 1, n), strict=True))]
    return rows, "cell string, k int, y double, f double"


def _boot_r2(w, y, f):
    sst = w @ ((y - y.mean()) ** 2) - (w @ (y - y.mean())) ** 2 / w.sum(axis=-1)
    return 1 - w @ ((y - f) ** 2) / sst


def test_exact_draws_add_up_and_are_even():
    sizes = np.array([40, 7, 0, 300, 55, 1, 90, 12])  # rows of the eight leaves
    counts = []
    for piece in range(8):
        path = [(int(sizes[(piece >> 3 - k) << 3 - k :][: 8 >> k].sum()), int(sizes[(piece >> 3 - k) << 3 - k :][: 4 >> k].sum())) for k in range(3)]
        if sizes[piece]:
            counts.append(B.piece_counts(path, piece, 4000, 7, 99))
            w = B.draw(counts[-1], int(sizes[piece]), np.random.default_rng(piece))
            assert (w.sum(axis=0) == counts[-1]).all() and abs(w.mean() - 1) < 0.1
            assert counts[-1].var() == pytest.approx(sizes[piece] * (1 - sizes[piece] / 505), rel=0.15)
    assert (np.sum(counts, axis=0) == 505).all()


def test_exact_bootstrap_against_brute_force(spark, monkeypatch):
    """The same replicates from plain weights, whatever the partitions; some cells of many pieces, one of a single row."""
    monkeypatch.setattr(B, "PIECE", 16)
    rows, schema = _boot_frame(np.random.default_rng(5), {"a": 300, "b": 20, "c": 1, "d": 2})
    df = spark.createDataFrame(rows, schema)
    got = {r.cell: r for r in B.bootstrap_r2(df, ["cell"], ["k"], "y", "f", 200, seed=3).collect()}
    again = {r.cell: r for r in B.bootstrap_r2(df.repartition(7, "f"), ["cell"], ["k"], "y", "f", 200, seed=3).collect()}
    assert set(got) == set(again) == {"a", "b", "d"}
    keyed = df.select("*", F.xxhash64("k").alias("h"), F.xxhash64(F.col("cell").cast("string")).alias("c")).collect()
    for cell in got:
        assert got[cell].r2_boot_mean == pytest.approx(again[cell].r2_boot_mean, rel=1e-9)
        mine = [r for r in keyed if r.cell == cell]
        bits = max(0, math.ceil(math.log2(len(mine) / 16)))
        pieces = {}
        for r in sorted(mine, key=lambda r: (r.h, r.y)):
            pieces.setdefault((r.h & (1 << 64) - 1) >> 64 - bits if bits else 0, []).append(r)
        w, y, f = [], [], []
        for piece, own in pieces.items():
            size = lambda level, prefix: sum(len(v) for p, v in pieces.items() if p >> bits - level == prefix)  # noqa: E731, B023
            path = [(size(k, piece >> bits - k), size(k + 1, (piece >> bits - k) * 2)) for k in range(bits)]
            counts = B.piece_counts(path, piece, 200, 3, own[0].c) if bits else np.full(200, len(own))
            w.append(B.draw(counts, len(own), B._generator(3, own[0].c, bits, piece, True)))
            y += [r.y for r in own]
            f += [r.f for r in own]
        w = np.concatenate(w).T
        assert (w.sum(axis=1) == len(mine)).all()
        with np.errstate(all="ignore"):
            r2 = _boot_r2(w, np.array(y), np.array(f))
        r2 = r2[[len(set(np.array(y)[row > 0])) > 1 for row in w]]
        assert got[cell].n_boot == len(r2)
        assert (got[cell].r2_boot_mean, got[cell].r2_boot_std) == pytest.approx((r2.mean(), r2.std(ddof=1)), rel=1e-8)
        assert (got[cell].ci_lower, got[cell].ci_upper) == pytest.approx(tuple(np.quantile(r2, [0.025, 0.975])), rel=1e-8)


def test_poisson_bootstrap_against_brute_force(spark, monkeypatch):
    rows, schema = _boot_frame(np.random.default_rng(6), {"a": 700, "b": 30})
    got = {r.cell: r for r in B.bootstrap_r2_poisson(spark.createDataFrame(rows, schema).repartition(3), ["cell"], ["k"], "y", "f", 300, seed=4).collect()}
    for cell in "ab":
        mine = [r for r in rows if r[0] == cell]
        words = [hashlib.md5(f"4:{r[1]}".encode()).hexdigest() for r in mine]
        w = B.poisson_weights(np.array([int(x[:8], 16) for x in words]), np.array([int(x[8:16], 16) for x in words]), 300).T
        r2 = _boot_r2(w, np.array([r[2] for r in mine]), np.array([r[3] for r in mine]))
        assert (got[cell].r2_boot_mean, got[cell].r2_boot_std, got[cell].ci_lower) == pytest.approx((r2.mean(), r2.std(ddof=1), np.quantile(r2, 0.025)), rel=1e-8)
    w = B.poisson_weights(np.arange(4000) * 7919, np.arange(4000) * 104729, 500)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    share = [(w == k).mean() for k in range(4)]
    assert share == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.003)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15


# --- regression ------------------------------------------------------------------------------


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(80, 4)), columns=list("abcy"))
    pdf["y"] += 2 * pdf["a"] - pdf["b"] + 5
    got = {r.term: r for r in G.ols(spark.createDataFrame(pdf), "y", ["a", "b", "c"]).collect()}
    x = np.column_stack([np.ones(80), pdf[["a", "b", "c"]]])
    b = np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
    res = pdf["y"] - x @ b
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (res ** 2).sum() / 76)
    for i, t in enumerate(("const", "a", "b", "c")):
        assert got[t].coef == pytest.approx(b[i]) and got[t].std_err == pytest.approx(se[i])
    llf = -40 * (np.log(2 * np.pi * (res ** 2).mean()) + 1)
    assert got["a"].aic == pytest.approx(8 - 2 * llf) and got["a"].bic == pytest.approx(4 * np.log(80) - 2 * llf)


def test_ols_refuses_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)] * 4, ["y", "a", "b"])
    assert G.ols(df, "y", ["a", "b"]).count() == 0


def test_cluster_ols_against_sandwich(spark):
    rng = np.random.default_rng(4)
    n = 240
    pdf = pd.DataFrame({"g": rng.integers(0, 40, n), "year": rng.integers(2017, 2020, n), "a": rng.normal(size=n), "b": rng.normal(size=n), "flat": 1.0})
    pdf["y"] = pdf["a"] + 0.3 * pdf["year"] + rng.normal(size=n) + pdf["g"] * 0.05
    got = {r.term: r for r in G.cluster_ols(spark.createDataFrame(pdf), "y", ["a", "b", "flat"], "year", "g").collect()}
    assert set(got) == {"a", "b"}
    x = np.column_stack([pdf["a"], pdf["b"], pd.get_dummies(pdf["year"]).to_numpy(float)])
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ pdf["y"]
    u = pdf["y"] - x @ beta
    scores = pd.DataFrame(x * u.to_numpy()[:, None]).groupby(pdf["g"]).sum().to_numpy()
    g = len(scores)
    v = bread @ (scores.T @ scores) @ bread * g / (g - 1) * (n - 1) / (n - x.shape[1])
    for i, t in enumerate("ab"):
        assert got[t].coef == pytest.approx(beta[i]) and got[t].se == pytest.approx(np.sqrt(v[i, i]))
    assert got["a"].n_params == x.shape[1] and got["a"].n_clusters == g and not got["a"].low_cluster_count
    assert got["a"].standardized == pytest.approx(beta[0] * pdf["a"].std() / pdf["y"].std())


def test_grouped_cluster_fit_equals_single_fits(spark):
    rng = np.random.default_rng(8)
    n = 300
    pdf = pd.DataFrame({"m": np.where(np.arange(n) < 220, "big", "small"), "g": rng.integers(0, 25, n), "year": rng.integers(0, 3, n),
                        "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["y"] = pdf["a"] * np.where(pdf["m"] == "big", 1.0, -2.0) + rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    both = {(r.m, r.term): (r.coef, r.se, r.r2) for r in G.cluster_ols(df, "y", ["a", "b"], "year", "g", ["m"]).collect()}
    for m in ("big", "small"):
        for r in G.cluster_ols(df.filter(F.col("m") == m), "y", ["a", "b"], "year", "g").collect():
            assert both[(m, r.term)] == pytest.approx((r.coef, r.se, r.r2))


def test_penalty_suite_skips_a_small_urban_part(spark):
    rng = np.random.default_rng(9)
    err = [(k, y, a, b, float(rng.normal() + (a != b))) for k in range(60) for y in (2017, 2018) for a, b in readers.REQUIRED_CELLS]
    errors = materialize(spark.createDataFrame(err, ["key", "year", "train_quarter", "eval_quarter", "error"]), "errors")
    shares = rng.dirichlet([1, 1, 1], 60)
    feats = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(shares)], ["key", "tree_cover", "built_up", "cropland"])
    out = G.penalty_suite(errors, feats, "tree_cover", ["tree_cover", "built_up", "cropland"], "cropland", "built_up", min_urban=60,
                          amplitude=spark.createDataFrame([(k, float(k)) for k in range(50)], ["key", "amplitude"])).toPandas()
    assert set(out["regression"]) == {"Q1->Q2", "Q1->Q3", "Q1->Q4", "Q3->Q1 reverse", "Q1->Q3 amplitude"}
    assert (out[out["regression"] == "Q1->Q3 amplitude"]["n_clusters"] == 50).all()


def test_nested_r2_adds_up(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(60, 3)), columns=["y", "q", "l"])
    pdf["pair"] = rng.integers(0, 4, 60).astype(str)
    out = G.nested_r2(spark.createDataFrame(pdf), "y", [("q", ["q"]), ("q+p", []), ("q+p+l", ["l"])], "pair", 1).orderBy("block_no").toPandas()
    assert list(out["block"]) == ["q", "q+p", "q+p+l"]
    assert out["r_squared"].is_monotonic_increasing
    assert out["r_squared_added"].sum() == pytest.approx(out["r_squared"].iloc[-1])


# --- vectors -------------------------------------------------------------------------------------


def test_cosine_pairs_and_zero_norm(spark):
    rows = [(m, i, v) for m, vec in {"a": (1.0, 0.0, 2.0), "b": (2.0, 1.0, 0.0), "z": (0.0, 0.0, 0.0)}.items() for i, v in enumerate(vec)]
    got = {(r.a_m, r.b_m): r.similarity for r in V.cosine_pairs(spark.createDataFrame(rows, ["m", "i", "v"]), ["m"], ["i"], "v").collect()}
    assert got == {("a", "b"): pytest.approx(0.4), ("a", "z"): 0.0, ("b", "z"): 0.0}


def test_cka_is_rotation_invariant(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(50, 4))
    q = np.linalg.qr(rng.normal(size=(4, 4)))[0]

    def cka(a, b):
        df = spark.createDataFrame([(u.tolist(), w.tolist()) for u, w in zip(a, b)], ["x", "y"])
        return V.linear_cka(df, "x", "y").first()["cka"]

    assert cka(x, x @ np.linalg.qr(rng.normal(size=(3, 3)))[0] * 5 + 2) == pytest.approx(1.0)
    assert cka(x, y) == pytest.approx(cka(x, y @ q))
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.norm(xc.T @ yc) ** 2 / (np.linalg.norm(xc.T @ xc) * np.linalg.norm(yc.T @ yc))
    assert cka(x, y) == pytest.approx(want)


def test_svd_share(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(4, 4))
    rows = [(2016, i + 1, 2016, j + 1, float(m[i, j])) for i in range(4) for j in range(4)]
    got = [r.singular_value for r in V.svd_share(spark.createDataFrame(rows, [*A.CELL_KEY, "r2"]), "r2").collect()]
    assert np.allclose(got, np.linalg.svd(m - m.mean())[1])


def test_overlay_and_delta_errors(spark):
    a = spark.createDataFrame([("l1", 0, 1.0), ("l2", 0, 2.0)], ["layer", "idx", "value"])
    b = spark.createDataFrame([("l1", 0, 9.0)], ["layer", "idx", "value"])
    out = {r.layer: r.value for r in V.param_overlay(a, b, ["layer", "idx"], F.col("layer") == "l1").collect()}
    assert out == {"l1": 9.0, "l2": 2.0}
    with pytest.raises(Exception, match="donor lacks"):
        V.param_overlay(a, b, ["layer", "idx"], F.col("layer") == "l2").collect()
    with pytest.raises(Exception, match="without base value"):
        V.vector_delta(a.withColumn("m", F.lit(1)), b, ["layer", "idx"], ["m"]).collect()
    missing = V.missing_params(b.withColumn("m", F.lit(1)), a, ["layer", "idx"], ["m"]).first()
    assert missing.n_missing == 1


# --- spatial and raster ------------------------------------------------------------------------------


def test_knn_against_brute_force_with_crowded_place(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(lo), float(la)) for i, (lo, la) in enumerate(zip(rng.uniform(-90, -80, 150), rng.uniform(35, 42, 150)))]
    pts += [(1000 + i, -85.0, 40.0) for i in range(100)]  # one place holds many points
    df = spark.createDataFrame(pts, ["id", "lon", "lat"]).repartition(6)
    got = SP.knn(df, df.filter("id % 25 = 0"), "id", 4).toPandas()

    def km(a, b):
        la, lb = np.radians(a[2]), np.radians(b[2])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * np.arcsin(min(1.0, np.sqrt(h)))

    by_id = {p[0]: p for p in pts}
    for i, part in got.groupby("id"):
        want = sorted((round(km(by_id[i], p), 9), p[0]) for p in pts if p[0] != i)[:4]
        assert [w[1] for w in want] == list(part.sort_values("rank")["neighbor"])
        assert np.allclose([w[0] for w in want], part.sort_values("rank")["km"], atol=1e-6)


def test_exclusive_quartiles(spark):
    import statistics

    xs = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6, 5.0]
    out = SP.exclusive_quartiles(spark.createDataFrame([(x,) for x in xs], ["v"]), "v").first()
    assert [out.p25, out.median, out.p75] == pytest.approx(statistics.quantiles(xs, n=4))


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 97, 1000):
        x = np.arange(n)
        seen = []
        for p in (1, 2, 30):
            to = SP.permuted(x.copy(), n, np.full(n, p), 7)
            assert sorted(to.tolist()) == list(range(n))
            assert (SP.permuted(to.copy(), n, np.full(n, p), 7, inverse=True) == x).all()
            seen.append(to)
        assert n < 10 or any((seen[0] != s).any() for s in seen[1:])
    place = np.array([SP.permuted(np.array([3]), 20, np.array([p]), 1)[0] for p in range(1, 8001)])
    assert np.bincount(place, minlength=20).std() < 4 * np.sqrt(8000 / 20)  # each place about as often


@pytest.mark.parametrize("leaf", [30, 4000])
def test_morans_i_against_numpy(spark, leaf):
    """Observed value and every permuted one from a dense weight matrix; a point without value counts nowhere."""
    rng = np.random.default_rng(9)
    lon, lat = rng.uniform(0, 10, 120), rng.uniform(40, 50, 120)
    v = lon + rng.normal(size=120)
    df = spark.createDataFrame([(i, float(a), float(b), None if i == 5 else float(c)) for i, (a, b, c) in enumerate(zip(lon, lat, v, strict=True))], "id int, lon double, lat double, v double")
    near = SP.knn_all(df, "id", 4).select("id", "neighbor")
    pairs = [(r.id, r.neighbor) for r in near.collect() if 5 not in (r.id, r.neighbor)]
    keep = np.array([i for i in range(120) if i != 5])
    w = np.zeros((120, 120))
    for i, j in pairs:
        w[i, j] = 1
    w = w[np.ix_(keep, keep)]
    w /= w.sum(axis=1, keepdims=True)
    z = v[keep] - v[keep].mean()
    out = SP.morans_i(df, near, "id", "v", 199, seed=3, leaf=leaf).first()
    assert out.morans_i == pytest.approx(z @ w @ z / (z @ z), rel=1e-10) and out.n_units == 119 and out.n_perms == 199
    assert out.morans_i > 0.5 and out.p_value == pytest.approx(1 / 200)
    null = [(q := rng.permutation(z)) @ w @ q / (z @ z) for _ in range(3000)]
    assert out.null_mean == pytest.approx(np.mean(null), abs=0.02) and out.null_95pct == pytest.approx(np.quantile(null, 0.95), abs=0.03)
    flat = SP.morans_i(df.withColumn("v", F.lit(1.0)), near, "id", "v", 9).first()
    assert flat.morans_i is None


def test_morans_i_streams_values_by_chunks(spark, monkeypatch):
    """Each permuted value by hand, with many small groups and chunks; no row is shuffled per permutation."""
    monkeypatch.setattr(SP, "CHUNK", 7)
    monkeypatch.setattr(SP, "LOOKUPS", 200)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(rng.uniform(0, 9)), float(rng.uniform(40, 50)), float(rng.normal())) for i in range(60)], "id int, lon double, lat double, v double")
    near = SP.knn_all(df, "id", 3).select("id", "neighbor").filter("id <> 7")
    frame = SP._lagged(60, 19, 5)
    z, pairs = rng.normal(size=60), [(i, (i * 7 + k) % 60) for i in range(60) for k in (1, 2) if i % 5]
    rows = [(i // 9, -1, i, j, None) for i, j in pairs] + [(g, c, None, None, z[c * 7 : c * 7 + 7].tolist()) for g in range(7) for c in range(9)]
    sent = spark.createDataFrame(rows, "group long, chunk long, idx long, to long, zs array<double>").repartition(3, "group").sortWithinPartitions("group", "chunk")
    got = sent.mapInArrow(frame, "n_linked long, s array<double>").collect()
    assert sum(r.n_linked for r in got) == 48 and len(got) == 7
    for p in range(20):
        a = z[SP.permuted(np.arange(60), 60, np.full(60, p), 5)] if p else z
        assert sum(r.s[p] for r in got) == pytest.approx(sum(a[i] * np.mean([a[j] for k, j in pairs if k == i]) for i in range(60) if i % 5))
    out = SP.morans_i(df, near, "id", "v", 19, seed=5)
    assert out.first().n_units == 60 and out.first().n_perms == 19
    plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "MapInArrow" in plan and "CoGroup" not in plan


def test_band_stats_floors(spark):
    """All-nodata input: mean 0 and std 0.0001, the floors of count and variance."""
    df = spark.createDataFrame([([0.0] * 12,), ([0.0] * 12,)], ["bands"])
    rows = RA.pooled_band_stats(df).collect()
    assert len(rows) == 12 and all((r.mean, r.std, r.n_valid) == (0.0, pytest.approx(1e-4), 0) for r in rows)


def test_band_stats_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([([float(v) for v in rng.integers(0, 3000, 12)],) for _ in range(200)], ["bands"])
    a, b = RA.pooled_band_stats(df.repartition(1)).toPandas(), RA.pooled_band_stats(df.repartition(7)).toPandas()
    assert np.allclose(a.sort_values("band")["std"], b.sort_values("band")["std"])


def test_class_fractions_sum_to_one(spark):
    df = spark.createDataFrame([("a", 10, 3), ("a", 40, 1), ("a", 99, 50), ("b", 99, 7)], ["geoid", "class", "n"])
    rows = RA.class_fractions(df, "geoid", [10, 40, 50]).collect()
    assert [tuple(r) for r in rows] == [("a", 0.75, 0.25, 0.0)]


def test_row_normalize(spark):
    pct = RA.normalize_rows(spark.createDataFrame([(60.0, 40.0), (0.5, 0.5)], ["a", "b"]), ["a", "b"])
    assert [tuple(r) for r in pct.collect()] == [(0.6, 0.4), (0.5, 0.5)]
    keep = RA.normalize_rows(spark.createDataFrame([(0.6, 0.3)], ["a", "b"]), ["a", "b"])
    assert [tuple(r) for r in keep.collect()] == [(0.6, 0.3)]


def test_tiles_cover_the_window(spark):
    out = RA.block_tiles(spark.createDataFrame([(5000, 2048)], "w int, h int"), "w", "h").toPandas()
    assert (out["tile_width"] * out["tile_height"]).sum() == 5000 * 2048 and len(out) == 3
    assert RA.block_tiles(spark.createDataFrame([(0, 5)], "w int, h int"), "w", "h").count() == 0


def _inside(x, y, rings):
    """Even-odd rule, one point at a time."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def _zones(rng):
    turn = np.sort(rng.uniform(0, 2 * np.pi, 40))
    reach = rng.uniform(0.5, 3.0, 40)
    return {
        "triangle": [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]],
        "hole": [[(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0), (0.0, 0.0)], [(1.25, 1.25), (4.5, 1.5), (4.0, 4.75)]],
        "parts": [[(0.1, 4.1), (1.9, 4.1), (1.9, 5.9)], [(4.0, 0.0), (6.0, 0.0), (6.0, 2.0), (4.0, 2.0)]],
        "star": [[(3 + float(r * np.cos(t)), 3 + float(r * np.sin(t))) for t, r in zip(turn, reach, strict=True)]],
        "none": [],
    }


@pytest.mark.parametrize(("cell", "crowd"), [(0.5, 10_000), (1.0, 7), (10.0, 50)])
def test_zonal_counts_of_holes_and_parts(spark, cell, crowd):
    rng = np.random.default_rng(0)
    zones = _zones(rng)
    pix = [(float(x), float(y), int(c)) for x, y, c in zip(rng.uniform(-1, 7, 700), rng.uniform(-1, 7, 700), rng.integers(0, 3, 700), strict=True)]
    pix += [(float(x), float(y), 5) for x in range(7) for y in range(7)] + pix[:50]  # corners of grid and polygons, repeats
    polygons = spark.createDataFrame(list(zones.items()), "geoid string, rings array<array<struct<x:double,y:double>>>")
    counts, over = RA.zonal_counts(spark.createDataFrame(pix, ["x", "y", "class"]), polygons, "geoid", cell, max_pixels=100, crowd=crowd)
    want = {}
    for name, rings in zones.items():
        for x, y, c in pix:
            if _inside(x, y, rings):
                want[name, c] = want.get((name, c), 0) + 1
    assert {(r.geoid, r["class"]): r.n for r in counts.collect()} == want
    assert {r.geoid for r in over.collect()} == {z for z in zones if sum(n for (g, _), n in want.items() if g == z) > 100}


def test_only_border_cells_are_tested(spark):
    """Inside cells are those whose four corners and centre lie inside, and no edge passes them."""
    zones = _zones(np.random.default_rng(1))
    polygons = spark.createDataFrame(list(zones.items()), "geoid string, rings array<array<struct<x:double,y:double>>>")
    inside, border = RA.classified_cells(polygons, "geoid", 0.25)
    on = {(r.geoid, r.cx, r.cy) for r in border.select("geoid", "cx", "cy").collect()}
    got = {(r.geoid, r.cx, r.cy) for r in inside.collect()}
    assert not got & on and len(got) > 300
    probe = [0.001, 0.125, 0.249]
    for name, rings in zones.items():
        for cx in range(-2, 26):
            for cy in range(-2, 26):
                if (name, cx, cy) not in on:
                    hits = {_inside(cx * 0.25 + u, cy * 0.25 + v, rings) for u in probe for v in probe}
                    assert hits == {(name, cx, cy) in got}


# --- importance and recovery ---------------------------------------------------------------------------


def test_importance_sanity(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"year": 2016, "quarter": 1, "k": np.arange(300), "a": rng.normal(size=300), "b": rng.normal(size=300)})
    pdf["y"] = 2 * pdf["a"] + 0.1 * rng.normal(size=300)
    sets = {"a": ("a",), "b": ("b",), "all": ("a", "b")}
    args = (spark.createDataFrame(pdf), ["year", "quarter"], ["k"], "y", ["a", "b"], sets, lambda c: 2 * c["a"] + 0 * c["b"])
    out = I.permutation_importance(*args, n_repeats=2).toPandas()
    assert out[out["feature"] == "b"]["delta_r2"].abs().max() < 1e-9  # an unused feature changes nothing
    assert (out[out["feature"] == "all"]["r2_pert"] <= 0.15).all()
    assert (out["n_test"] == 300).all() and out["r2_base"].min() > 0.99
    norm = I.importance_summary(I.permutation_importance(*args, n_repeats=2), ["year", "quarter"]).toPandas()
    assert norm[norm["unit"] == "band"]["normalized_importance"].sum() == pytest.approx(1.0)


@pytest.mark.parametrize("piece", [7, 65536])
def test_importance_against_sorted_rows(spark, monkeypatch, piece):
    """Each row gets the features of the row at its place of the fixed order, in cells of several pieces too; no row
    of a repeat is ranked and then joined by its rank."""
    import hashlib

    monkeypatch.setattr(I, "PIECE", piece)
    rng = np.random.default_rng(2)
    rows = [(2016 + k % 3 // 2, None if k % 50 == 0 else k % 2, k, float(rng.integers(9)), None if k % 11 == 0 else float(rng.normal()), 1.0, float(rng.normal())) for k in range(240)]
    df = spark.createDataFrame(rows, "year int, quarter int, k long, a double, b double, c double, y double")
    out = I.permutation_importance(df, ["year", "quarter"], ["k"], "y", ["a", "b", "c"], {"a": ("a",), "c": ("c",), "all": ("a", "b")}, lambda x: x["a"] + x["b"], 3)
    got = {(r.year, r.quarter, r.repeat, r.feature): (r.n_test, r.mae_base, r.mae_pert) for r in out.collect()}
    want = {}
    for cell in {(r[0], r[1]) for r in rows if r[1] is not None}:
        own = [r for r in rows if (r[0], r[1]) == cell]
        source = sorted(own, key=lambda r: hashlib.md5(f"src:{r[2]}".encode()).hexdigest())
        for repeat in range(3):
            pairs = list(zip(sorted(own, key=lambda r: hashlib.md5(f"0:{repeat}:{r[2]}".encode()).hexdigest()), source, strict=True))
            base = [abs(r[6] - r[3] - r[4]) for r in own if r[4] is not None]
            for name, f in {"a": lambda r, s: (s[3], r[4]), "c": lambda r, s: (r[3], r[4]), "all": lambda r, s: (s[3], s[4])}.items():
                new = [abs(r[6] - sum(f(r, s))) for r, s in pairs if None not in f(r, s)]
                want[(*cell, repeat, name)] = (len(own), pytest.approx(np.mean(base)), pytest.approx(np.mean(new)))
    assert got == want
    plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "row_number" not in plan and "FlatMapCoGroupsInArrow" in plan  # no rank is joined row by row


def test_same_season_control(spark):
    pairs = spark.createDataFrame([(2017, 1, 2016, 1), (2017, 1, 2016, 3), (2017, 2, 2016, 2)], RC.PAIR_KEY)
    have = spark.createDataFrame([(2016, 1), (2017, 1), (2018, 1), (2016, 2), (2017, 2)], ["year", "quarter"])
    got = {(r.recipient_quarter, r.donor_quarter): r.control_year for r in RC.same_season_control(pairs, have).collect()}
    assert got == {(1, 1): 2018, (1, 3): 2016, (2, 2): None}


def test_gradient_and_verdict(spark):
    df = spark.createDataFrame([("up", 1, 0.1), ("up", 2, 0.3), ("sign", 1, 0.1), ("sign", 2, -0.3)], ["g", "d", "c"])
    assert {r.g: r.gradient for r in RC.gradient_check(df, "d", "c", ["g"]).collect()} == {"up": True, "sign": False}
    p = spark.createDataFrame([("stage1", 0.01), ("stage3", 0.2)], ["layer", "p"])
    assert RC.layer_verdict(p, "layer", "p", ("patch_embed", "stage1"), ("stage3",)).first().verdict == "early"


# --- sources and sinks ------------------------------------------------------------------------------------


def test_prediction_files(spark):
    base = scratch_path(spark, "files")
    from pathlib import Path

    for rel, rows in {
        "oh/q1_2016/epoch195_valset_oh_2016_q1_s2_allbands_wealth_index_preds.csv": [("/c/39003010600.tif", 0.25, 0.04)],
        "az/q2_2018/epoch107_valset_az_2018_q3_s2_allbands_wealth_index_preds.csv": [("/c/4003010600.tif", 1.0, 2.0), ("/c/4003010700.tif", "bad", 1.0)],
    }.items():
        f = Path(base) / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(",name,pred,label,extra\n" + "".join(f"{i},{a},{b},{c},0\n" for i, (a, b, c) in enumerate(rows)))
    got = sorted(readers.read_predictions(spark, base).drop("path").collect())
    assert [(r.state, r.model_year, r.model_quarter, r.eval_quarter, r.geoid, r.pred) for r in got] == [
        ("az", 2018, 2, 3, "04003010600", 1.0), ("az", 2018, 2, 3, "04003010700", None), ("oh", 2016, 1, 1, "39003010600", 0.25)]


def test_only_chosen_files_are_read(spark):
    """Listing, not scanning, tells the highest epoch; cells that are wanted but not there and odd files are known before."""
    rows = [("ga", "income", 2018, q, 2019, 3, epoch, "x", 1.0, 2.0) for q in (1, 2) for epoch in (9, 10)] + [("oh", "a b+c%", 2018, 1, 2018, 1, 3, "x", 1.0, 2.0)]
    path = scratch_path(spark, "preds")
    sinks.write_prediction_files(spark.createDataFrame(rows, "state string, variable string, model_year int, model_quarter int, eval_year int, eval_quarter int, epoch int, name string, pred double, label double"), path)
    spark.createDataFrame([("x", 1.0)], ["name", "pred"]).coalesce(1).write.option("header", True).csv(f"{path}/notes.csv")
    index = readers.file_index(spark, path)
    assert index.filter("epoch is null").count() == 1 and index.filter("epoch is not null").count() == 5
    newest = readers.newest_files(index)
    out = readers.read_files(spark, newest)
    files = out.inputFiles()
    assert len(files) == 3 and sum("epoch10" in f for f in files) == 2 and not any("epoch9" in f or "notes" in f for f in files)
    assert sorted((r.state, r.model_quarter, r.epoch, r.pred) for r in out.collect()) == [("ga", 1, 10, 1.0), ("ga", 2, 10, 1.0), ("oh", 1, 3, 1.0)]
    some = readers.newest_files(index, spark.createDataFrame([("ga", 2), ("az", 1)], "state string, model_quarter int"))
    assert [r.model_quarter for r in readers.read_files(spark, some).collect()] == [2]
    assert readers.read_files(spark, index.limit(0)).count() == 0
    manifest = index.filter("epoch = 9 and model_quarter = 1").selectExpr("path as preds_csv").union(spark.createDataFrame([("/none.csv",)], ["preds_csv"]))
    held, missing = readers.manifest_files(manifest, index)
    assert [r.epoch for r in held.collect()] == [9] and [r.preds_csv for r in missing.collect()] == ["/none.csv"]


def test_quarantine_of_broken_rows(spark):
    """Every line of a CSV and a JSON file is either read or quarantined with its file."""
    from pathlib import Path

    base = Path(scratch_path(spark, "broken"))
    (base / "c").mkdir(parents=True)
    (base / "j").mkdir()
    (base / "c/one.csv").write_text("id,v\n1,0.5\n2,oops\n3,1.5,9\n4,\n")
    (base / "c/two.csv").write_text("id,v\nx,1\n5,2.5\n")
    good, broken = readers.read_quarantined(spark, str(base / "c"), "id INT, v DOUBLE", "csv")
    assert sorted((r.id, r.v) for r in good.collect()) == [(1, 0.5), (4, None), (5, 2.5)]
    assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in broken.collect()) == [("one.csv", "2,oops"), ("one.csv", "3,1.5,9"), ("two.csv", "x,1")]
    (base / "j/a.json").write_text('{"id":1,"v":0.5}\n{"id":2,"v":\n{"id":"z","v":1.0}\n\n{"id":3}\nnot json\n')
    good, broken = readers.read_quarantined(spark, str(base / "j"), "id INT, v DOUBLE", key=r'"id":(\d+)')
    assert sorted((r.id, r.v) for r in good.collect()) == [(1, 0.5), (3, None)]
    assert sorted((r.line, r.key) for r in broken.collect()) == [('not json', None), ('{"id":"z","v":1.0}', None), ('{"id":2,"v":', "2")]
    assert good.count() + broken.count() == 5


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        readers.require_columns(spark.createDataFrame([(1,)], ["a"]), ["a", "b", "c"])


def test_manifest(spark):
    need = readers.required_cells(spark, [2017])
    rows = readers.manifest_from_template(need, "/p/q%2$d_%1$d/q%3$d.csv").collect()
    assert len(rows) == 8 and rows[1].preds_csv == "/p/q1_2017/q2.csv"
    left = readers.missing_cells(need, need.filter("train_quarter = 1"), ["year", "train_quarter", "eval_quarter"])
    assert left.count() == 4


def test_append_missing_is_idempotent(spark):
    path = scratch_path(spark, "append")
    df = spark.createDataFrame([(1, "a"), (2, "b")], ["k", "v"])
    for _ in range(2):
        sinks.append_missing(spark, df, path, ["k"])
    sinks.append_missing(spark, spark.createDataFrame([(2, "x"), (3, "c")], ["k", "v"]), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_json_map(spark):
    from pathlib import Path

    path = scratch_path(spark, "json")
    Path(path).mkdir(parents=True)
    (Path(path) / "oh_ys.json").write_text('{"/c/1.tif": 0.5,\n "/c/2.tif": null}')
    rows = readers.read_json_map(spark, path, "double", "path", "label").collect()
    assert sorted(tuple(r) for r in rows) == [("/c/1.tif", 0.5), ("/c/2.tif", None)]


def test_streaming_union_of_batches_is_batch(spark):
    from crossgrid.streaming import jobs

    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "y": rng.normal(size=500) * 100 + 5000})
    pdf["f"] = pdf["y"] + rng.normal(size=500) * 30
    src = scratch_path(spark, "src")
    spark.createDataFrame(pdf).repartition(5).write.parquet(src)
    stream = jobs.read_stream(spark, src, max_files=1)
    got = jobs.stream_accuracy(stream, ["k"], "y", "f", scratch_path(spark, "work")).toPandas().sort_values("k")
    want = A.accuracy(spark.createDataFrame(pdf), ["k"], "y", "f").toPandas().sort_values("k")
    for c in ("n", "r2", "pearson_r", "bias", "mae"):
        assert np.allclose(got[c], want[c], rtol=1e-9)


def test_knn_all_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(lo), float(la)) for i, (lo, la) in enumerate(zip(rng.uniform(-180, 180, 120), rng.uniform(-90, 90, 120)))]
    pts += [(200 + i, float(lo), float(la)) for i, (lo, la) in enumerate(zip(rng.uniform(10, 10.01, 150), rng.uniform(50, 50.01, 150)))]
    pts += [(1000 + i, 179.99, -40.0) for i in range(60)] + [(2000, -179.99, -40.0), (2001, 0.0, 90.0), (2002, 90.0, 90.0)]
    df = spark.createDataFrame(pts, ["id", "lon", "lat"])
    lon, lat, ids = np.radians([p[1] for p in pts]), np.radians([p[2] for p in pts]), np.array([p[0] for p in pts])
    a = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.minimum(1.0, np.sqrt(a)))
    for leaf in (9, 40, 5000):
        got = SP.knn_all(df, "id", 4, leaf=leaf).toPandas()
        assert len(got) == 4 * len(pts)
        by_id = {i: part.sort_values("rank") for i, part in got.groupby("id")}
        for k, i in enumerate(ids):
            others = np.delete(np.arange(len(ids)), k)
            want = np.sort(km[k][others])[:4]
            assert np.allclose(by_id[i]["km"], want, atol=1e-6)
    few = SP.knn_all(df.limit(3), "id", 4).toPandas()
    assert len(few) == 6
    assert SP.knn_all(df.limit(0), "id", 4).count() == 0


def test_neighbours_of_a_town_and_scattered_points(spark):
    """One crowded town, lone points around the globe, equal distances on a lattice: the same neighbours as brute force."""
    rng = np.random.default_rng(8)
    pts = [(float(lo), float(la)) for lo, la in zip(rng.normal(2.35, 0.02, 900), rng.normal(48.85, 0.02, 900))]
    pts += [(float(lo), float(la)) for lo, la in zip(rng.uniform(-180, 180, 60), np.degrees(np.arcsin(rng.uniform(-1, 1, 60))))]
    pts += [(100.0 + i, float(j)) for i in range(6) for j in range(-3, 3)] + [(2.35, 48.85)] * 400
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, lon double, lat double")
    lon, lat = np.radians(np.array(pts)).T
    want = []
    for i in range(len(pts)):
        a = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat) * np.sin((lon - lon[i]) / 2) ** 2
        km = 2 * 6371.0 * np.arcsin(np.minimum(1.0, np.sqrt(a)))
        km[i] = np.inf
        order = np.lexsort((np.arange(len(pts)), km.round(9)))[:3]
        want.append(km[order])
    for leaf in (50, 300):
        got = SP.knn_all(df, "id", 3, leaf=leaf).toPandas().sort_values(["id", "rank"])
        assert np.allclose(got["km"].to_numpy().reshape(-1, 3), np.array(want), atol=1e-8)
        town = got[got["id"] >= len(pts) - 400].groupby("id")["neighbor"].apply(list)
        first = [len(pts) - 400 + j for j in range(4)]
        assert all(near == [j for j in first if j != i][:3] for i, near in town.items())


def test_quantiles_with_an_outlier_sort_small_bins(spark, monkeypatch):
    from crossgrid.operators import quantile as QN

    monkeypatch.setattr(QN, "SMALL_BIN", 50)
    xs = [*np.linspace(0, 1, 2001), 1e12, -1e9]
    df = spark.createDataFrame([(float(x),) for x in xs], ["v"])
    got = {r.prob: r.value for r in QN.exact_quantiles(df, "v", [0.1, 0.5, 0.9], bins=64).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(xs, p), abs=1e-12)


def _event_files(spark, name):
    """Three files that arrive out of order: 20, 21 and 2 January."""
    path = scratch_path(spark, name)
    rows = [[(1, "u", "2024-01-20 10:00:00", 1.0), (2, "u", "2024-01-20 10:10:00", 2.0)], [(3, "u", "2024-01-21 10:00:00", 4.0), (3, "u", "2024-01-21 10:00:00", 4.0)],
            [(4, "u", "2024-01-02 10:00:00", 8.0), (5, "v", "2024-01-20 10:20:00", 16.0), (6, "u", "2024-01-20 10:35:00", 32.0)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "id int, user string, t string, value double").selectExpr("id", "user", "cast(t as timestamp) ts", "value").coalesce(1).write.parquet(f"{path}/f={k}")
    return path, [r for part in rows for r in part]


def test_streams_lose_no_late_rows(spark):
    from crossgrid.streaming import event_time, jobs

    path, rows = _event_files(spark, "events")
    stream = lambda: jobs.read_stream(spark, f"{path}/*", max_files=1)
    table = scratch_path(spark, "sink")
    for _ in range(2):
        out = jobs.stream_append_once(stream(), ["id"], scratch_path(spark, "work"), table)
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5, 6]
    days = event_time.windows(stream(), "ts", ["user"], "value", scratch_path(spark, "work"), "1 day", delay="30 days").rows.collect()
    want = {}
    for _, u, t, v in rows:
        n, s = want.get((u, t[:10]), (0, 0.0))
        want[u, t[:10]] = (n + 1, s + v)
    assert {(r.user, str(r.window_start)[:10]): (r.n, r.total) for r in days} == want
    sessions = event_time.sessions(stream(), "ts", "user", "value", "30 minutes", scratch_path(spark, "work"), delay="30 days").rows.collect()
    got = sorted((r.user, str(r.session_start), r.n, r.total, r.is_open) for r in sessions)
    assert got == [("u", "2024-01-02 10:00:00", 1, 8.0, False), ("u", "2024-01-20 10:00:00", 3, 35.0, False),
                   ("u", "2024-01-21 10:00:00", 2, 8.0, True), ("v", "2024-01-20 10:20:00", 1, 16.0, False)]


def test_perfect_and_constant_fits_end_no_job(spark):
    rows = [("fit", float(x), 2.0 * x + 1) for x in range(10)] + [("flat", float(x), 3.0) for x in range(10)] + [("noisy", float(x), float(x * x % 7)) for x in range(10)]
    out = G.ols(spark.createDataFrame(rows, ["g", "x", "y"]), "y", ["x"], ["g"]).collect()
    by = {(r.g, r.term): r for r in out}
    assert by["fit", "x"].coef == pytest.approx(2) and by["fit", "x"].r_squared == pytest.approx(1) and by["fit", "x"].aic is None
    assert by["flat", "x"].coef == pytest.approx(0, abs=1e-9) and by["flat", "x"].r_squared is None
    assert by["noisy", "x"].aic is not None


def test_histogram_of_a_constant(spark):
    from crossgrid.operators import accuracy as A

    got = A.score_histogram(spark.createDataFrame([(2.0,)] * 5 + [(None,)], "v double"), "v", 10).collect()
    assert [(r.bin, r.left, r.n) for r in got] == [(0, 2.0, 5)]


def test_parameter_checks_look_both_ways(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, value double")
    fine = spark.createDataFrame([("m", "a", 1.5), ("m", "b", 2.5), ("n", "a", 3.0)], "model string, k string, value double")
    assert V.vector_delta(fine.filter("model = 'm'"), base, ["k"], ["model"]).agg(F.sum("delta")).first()[0] == pytest.approx(1.0)
    with pytest.raises(Exception, match="base parameters missing in model n"):
        V.vector_delta(fine, base, ["k"], ["model"]).collect()
    with pytest.raises(Exception, match="parameter without base value"):
        V.vector_delta(fine, base.filter("k = 'a'"), ["k"], ["model"]).collect()
    own, donor = base, base.withColumn("value", F.col("value") * 10)
    got = V.param_overlay(own, donor, ["k"], F.col("k") == "a").collect()
    assert {r.k: (r.value, r.swapped) for r in got} == {"a": (10.0, True), "b": (2.0, False)}
    for a, d, swap, text in ((own, donor.filter("k = 'b'"), "a", "donor lacks"), (own.filter("k = 'b'"), donor.filter("k = 'a'"), "a", "recipient lacks"), (own, donor, "z", "no parameter")):
        with pytest.raises(Exception, match=text):
            V.param_overlay(a, d, ["k"], F.col("k") == swap).collect()


def test_svd_of_an_incomplete_matrix(spark):
    rows = [(y, 1, e, 1, float(y * e % 5)) for y in range(3) for e in range(3)]
    cells = spark.createDataFrame(rows, "model_year int, model_quarter int, eval_year int, eval_quarter int, r2 double")
    got = V.svd_share(cells, "r2").toPandas().sort_values("component")
    m = np.array([r[4] for r in rows]).reshape(3, 3)
    assert np.allclose(got["singular_value"], np.linalg.svd(m - m.mean())[1], atol=1e-12)
    holed = cells.filter("model_year <> 1 or eval_year <> 2")
    centred = m - np.delete(m.ravel(), 5).mean()
    centred[1, 2] = 0
    assert np.allclose([r.singular_value for r in V.svd_share(holed, "r2").orderBy("component").collect()], np.linalg.svd(centred)[1], atol=1e-12)
    with pytest.raises(Exception, match="incomplete matrix"):
        V.svd_share(holed, "r2", holes="error").collect()


def test_singular_values_of_an_ill_conditioned_matrix(spark, monkeypatch):
    """Values over fourteen powers of ten keep their digits; a product of the matrix with itself would lose half of them."""
    rng = np.random.default_rng(12)
    u, v = np.linalg.qr(rng.normal(size=(300, 8)))[0], np.linalg.qr(rng.normal(size=(8, 8)))[0]
    want = 10.0 ** -np.arange(0, 16, 2)
    df = spark.createDataFrame([(row.tolist(),) for row in u * want @ v.T], "v array<double>")
    for fan in (2, 16):
        monkeypatch.setattr(V, "FAN", fan)
        got = V.singular_values(V.tall_triangle(df.repartition(11), "v", 8), 8).toPandas().sort_values("component")
        assert np.allclose(got["singular_value"], want, rtol=0, atol=2e-15)
    assert V.singular_values(V.tall_triangle(df.limit(3), "v", 8), 8).count() == 8


def test_pca_shares(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 1e6
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    got = V.pca_share(df, "v", 4).orderBy("component").collect()
    assert [r.component for r in got] == [1, 2, 3, 4] and np.allclose([r.variance_share for r in got], s[:4] / s.sum(), rtol=1e-8)
    assert V.pca_share(df.limit(3), "v", 10).count() == 2


def test_gram_in_tiles_is_the_whole_gram(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(30, 11))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    want = x.T @ x
    for tile in (4, 2000):
        monkeypatch.setattr(V, "TILE_UNITS", tile)
        got = V.gram(df, "v").collect()
        assert len(got) == 66 and all(r.v == pytest.approx(want[r.i, r.j]) for r in got)


def test_prediction_files_are_scored_at_the_highest_epoch(spark):
    from crossgrid.operators import accuracy as A
    from crossgrid.sources import readers, sinks

    rows = [("ga", "income", 2018, 1, 2019, 3, epoch, f"{i}", float(i) + bias, float(i)) for epoch, bias in ((9, 5.0), (10, 0.5)) for i in range(6)]
    preds = spark.createDataFrame(rows, "state string, variable string, model_year int, model_quarter int, eval_year int, eval_quarter int, epoch int, name string, pred double, label double")
    path = scratch_path(spark, "preds")
    sinks.write_prediction_files(preds, path)
    preds.limit(2).select("name", "pred").write.option("header", True).csv(f"{path}/notes.csv")
    got = A.score_cells(readers.read_predictions(spark, path), ["state", "variable"]).collect()
    assert len(got) == 1 and got[0].epoch == 10 and got[0].n == 6 and got[0].r2 == pytest.approx(1 - 0.25 / np.var(range(6)))
    assert [(r.n_rows, r.path.endswith("notes.csv")) for r in readers.unmatched_paths(spark, path).collect()] == [(2, True)]
