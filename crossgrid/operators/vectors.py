"""Vector and similarity operators built on one distributed Gram aggregate.

Pairs of vectors never meet as rows: every task adds up its part of the K x K matrix of
inner products (K units: models, hidden units), and only those partial matrices are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from crossgrid.session import attach_params, materialize, small_side


# Units in one side of a tile of a Gram matrix, and numbers a task holds for one batch of vectors.
TILE_UNITS = 2000
BATCH_NUMBERS = 4_000_000


def vector_delta(fine: DataFrame, base: DataFrame, key: list[str], model: list[str]) -> DataFrame:
    """Fine-tuned minus base value per key; a key that either side lacks, for any model, is an error."""
    known = base.select(*key, F.col("value").alias("_base"), F.lit(True).alias("_in_base"))
    total = known.agg(F.count(F.lit(1)).alias("_total"))
    joined = fine.select(*model, *key, "value").join(known, key, "left")
    held = joined.groupBy(*model).agg(F.count("_in_base").alias("_held"))  # one row a model
    joined = attach_params(joined.join(held, model), total)

    def named(what: str, columns: list[str]):
        return F.raise_error(F.concat(F.lit(what), F.concat_ws("/", *[F.col(c).cast("string") for c in columns]))).cast("double")

    checked = (
        F.when(F.col("_in_base").isNull(), named("parameter without base value: ", key))
        .when(F.col("_held") < F.col("_total"), named("base parameters missing in model ", model))
        .otherwise(F.col("value") - F.col("_base")))
    return joined.select(*model, *key, checked.alias("delta"))


def missing_params(fine: DataFrame, base: DataFrame, key: list[str], model: list[str]) -> DataFrame:
    """Base keys that a model lacks, as (model..., n_missing)."""
    n = base.agg(F.count(F.lit(1)).alias("_n"))
    have = fine.join(base.select(*key), key, "left_semi").groupBy(*model).agg(F.count(F.lit(1)).alias("_have"))
    return attach_params(have, n).select(*model, (F.col("_n") - F.col("_have")).alias("n_missing")).filter("n_missing > 0")


def param_overlay(recipient: DataFrame, donor: DataFrame, key: list[str], swap) -> DataFrame:
    """Donor values where ``swap`` (a condition on the key) holds, the recipient's elsewhere.

    A key of the swap set that either side lacks is an error, and so is an empty swap set."""
    d = donor.filter(swap).select(*key, F.col("value").alias("_donor"), F.lit(True).alias("_in_donor"))
    joined = recipient.select(*key, "value", F.lit(True).alias("_in_own")).join(d, key, "full").withColumn("_swap", swap)
    taken = (
        F.when(F.col("_in_donor").isNull(), F.raise_error(F.lit("donor lacks a parameter to swap")).cast("double"))
        .when(F.col("_in_own").isNull(), F.raise_error(F.lit("recipient lacks a parameter to swap")).cast("double")).otherwise(F.col("_donor")))
    n = joined.agg(F.count_if("_swap").alias("_n_swap"))
    value = F.when(F.col("_n_swap") == 0, F.raise_error(F.lit("no parameter to swap")).cast("double")).when(F.col("_swap"), taken).otherwise(F.col("value"))
    return attach_params(joined, n).select(*key, value.alias("value"), F.col("_swap").alias("swapped"))


def gram(df: DataFrame, vector: str, by: str | None = None, positions: str | None = None, size: str | None = None) -> DataFrame:
    """Upper triangle (i, j, v) of the sum of x x^T over all rows, per value of ``by``.

    ``positions`` and ``size`` are given for sparse rows (array of places, full length). A matrix of up to ``TILE_UNITS``
    units is summed in the task and emitted once; a larger one is computed in tiles, each emitted per batch of rows.
    """
    group = F.col(by).cast("string") if by else F.lit("")
    pos = F.col(positions) if positions else F.lit(None).cast("array<int>")
    length = F.col(size).cast("int") if size else F.size(vector)
    rows = df.select(group.alias("g"), F.col(vector).cast("array<double>").alias("x"), pos.alias("p"), length.alias("k"))

    def accumulate(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for g, whole in pdf.groupby("g"):
                k = int(whole["k"].max())
                rows = max(1, BATCH_NUMBERS // max(1, k))
                for at in range(0, len(whole), rows):
                    part = whole.iloc[at : at + rows]
                    if not (part["k"] == k).all():
                        raise ValueError("vectors of different lengths in one Gram matrix")
                    x = np.zeros((len(part), k))
                    places = [np.arange(len(v)) if p is None else np.asarray(p, dtype=int) for p, v in zip(part["p"], part["x"])]
                    x[np.repeat(np.arange(len(part)), [len(p) for p in places]), np.concatenate(places)] = np.concatenate(part["x"].to_numpy())
                    if k <= TILE_UNITS:
                        s = x.T @ x
                        total[g] = total[g] + s if g in total else s
                        continue
                    for a in range(0, k, TILE_UNITS):
                        for b in range(a, k, TILE_UNITS):
                            s = x[:, a : a + TILE_UNITS].T @ x[:, b : b + TILE_UNITS]
                            i, j = np.triu_indices(len(s)) if a == b else np.indices(s.shape).reshape(2, -1)
                            yield pd.DataFrame({"g": g, "i": (i + a).astype("int32"), "j": (j + b).astype("int32"), "v": s[i, j]})
        for g, s in total.items():
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({"g": g, "i": i.astype("int32"), "j": j.astype("int32"), "v": s[i, j]})

    summed = rows.mapInPandas(accumulate, "g STRING, i INT, j INT, v DOUBLE").groupBy("g", "i", "j").agg(F.sum("v").alias("v"))
    return summed.withColumnRenamed("g", by) if by else summed.drop("g")


def cosine_pairs(long: DataFrame, unit: list[str], key: list[str], value: str, by: str | None = None) -> DataFrame:
    """Cosine of every unordered pair of units over their keyed values; zero norm gives 0.

    Output: a_<unit>, b_<unit>, similarity (and ``by``). Units are numbered in a window over
    the distinct units, a table as long as there are models.
    """
    groups = [by] if by else []
    units = small_side(
        long.select(*unit).distinct().withColumn("_i", F.row_number().over(W.orderBy(*unit)) - 1), "units")
    n_units = units.agg((F.max("_i") + 1).alias("_k"))
    # one row per key with at most one entry per unit
    packed = (
        long.join(units, unit)
        .groupBy(*dict.fromkeys([*groups, *key])).agg(F.collect_list(F.struct(F.col("_i").alias("p"), F.col(value).alias("x"))).alias("_e"))
        .select(*groups, F.col("_e.p").alias("_p"), F.col("_e.x").alias("_x"))
    )
    # K x K rows, read for the norms of both sides and for the products
    g = materialize(gram(attach_params(packed, n_units), "_x", by, "_p", "_k"), "gram")
    norms = g.filter("i = j")
    pairs = g.filter("i < j")
    for side in ("i", "j"):
        own = norms.select(*groups, F.col("i").alias(side), F.sqrt("v").alias(f"_n{side}"))
        pairs = pairs.join(own, [*groups, side])
        named = units.select(F.col("_i").alias(side), *[F.col(u).alias(f"{'a' if side == 'i' else 'b'}_{u}") for u in unit])
        pairs = pairs.join(named, side)
    sim = F.coalesce(F.try_divide("v", F.col("_ni") * F.col("_nj")), F.lit(0.0))
    return pairs.select(*groups, *[f"a_{u}" for u in unit], *[f"b_{u}" for u in unit], sim.alias("similarity"))


def pair_flags(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({
        "same_season": (F.col("a_quarter") == F.col("b_quarter")).cast("int"),
        "same_year": (F.col("a_year") == F.col("b_year")).cast("int"),
    })


def pair_units(pairs: DataFrame, unit: list[str]) -> DataFrame:
    """The units that a pair table talks about."""
    sides = [F.struct(*[F.col(f"{s}_{u}").alias(u) for u in unit]) for s in "ab"]
    return pairs.select(F.explode(F.array(*sides)).alias("_u")).select("_u.*").distinct()


def linear_cka(df: DataFrame, x: str, y: str) -> DataFrame:
    """Linear CKA of two activation arrays over the same probes, from feature products.

    A leading 1 puts the column sums into the same Gram matrix, so centring needs no second
    pass. NULL where either side does not vary.
    """
    stacked = df.select(F.concat(F.array(F.lit(1.0)), F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("_v"))
    g = materialize(gram(stacked, "_v"), "gram")  # features x features rows, read four times
    p = df.agg(F.max(F.size(x)).alias("_p"))
    sums = g.filter("i = 0").select(F.col("j"), F.col("v").alias("s"))
    n = g.filter("i = 0 AND j = 0").select(F.col("v").alias("_n"))
    # one row per feature
    si = F.broadcast(sums.select(F.col("j").alias("i"), F.col("s").alias("_si")))
    sj = F.broadcast(sums.select("j", F.col("s").alias("_sj")))
    centred = attach_params(attach_params(g.filter("i > 0").join(si, "i").join(sj, "j"), n), p).withColumn(
        "_c", F.col("v") - F.col("_si") * F.col("_sj") / F.col("_n"))
    weight = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    sq = F.col("_c") * F.col("_c")
    in_x = F.col("j") <= F.col("_p")
    in_y = F.col("i") > F.col("_p")
    norms = centred.agg(
        F.sum(F.when(in_x, weight * sq)).alias("xx"), F.sum(F.when(in_y, weight * sq)).alias("yy"),
        F.sum(F.when(~in_x & ~in_y, sq)).alias("xy"))
    return norms.select(F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("cka"))


def head_forward(probes: DataFrame, heads: DataFrame, model: str, probe: str, x: str) -> DataFrame:
    """ReLU(x W0^T + b0), the hidden layer, and hidden w3 + b3, the output, of every head on every probe.

    ``heads`` has one row per model (w0 array<array>, b0, w3 array, b3): the heads are packed
    into one row, whose size depends on the models alone.
    """
    packed = heads.agg(F.collect_list(F.struct(model, "w0", "b0", "w3", "b3")).alias("_heads"))
    rows = attach_params(probes, packed).select(probe, F.col(x).alias("_x"), F.explode("_heads").alias("h"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    hidden = F.zip_with(F.col("h.w0"), F.col("h.b0"), lambda w, b: F.greatest(F.lit(0.0), dot(w, F.col("_x")) + b))
    active = rows.select(F.col(f"h.{model}").alias(model), probe, hidden.alias("hidden"), "h.w3", "h.b3")
    return active.select(model, probe, "hidden", (dot(F.col("hidden"), F.col("w3")) + F.col("b3")).alias("output"))


def cka_matrix(activations: DataFrame, model: str, probe: str, hidden: str) -> DataFrame:
    """Linear CKA of every pair of models, (a_<model>, b_<model>, similarity), from their hidden layers on the same probes.

    The layers of all models are laid side by side for each probe, so one Gram aggregate holds the feature products of all
    pairs and the probes are read once. Every model must have answered every probe, with as many units as the others."""
    models = activations.select(model).distinct().withColumn("_m", F.row_number().over(W.orderBy(model)) - 1)  # a row a model
    width = activations.agg(F.max(F.size(hidden)).alias("_h"))
    listed = activations.groupBy(probe).agg(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(hidden).cast("array<double>").alias("v")))).alias("_e"))
    whole = attach_params(attach_params(listed, models.agg(F.count(F.lit(1)).alias("_k"))), width)
    flat = F.flatten(F.transform("_e", lambda e: e["v"]))
    full = F.when(F.size(flat) == F.col("_k") * F.col("_h"), flat).otherwise(F.raise_error(F.lit("a model lacks hidden units for a probe")).cast("array<double>"))
    g = materialize(gram(whole.select(F.concat(F.array(F.lit(1.0)), full).alias("_v")), "_v"), "gram")
    sums = g.filter("i = 0").select(F.col("j").alias("u"), F.col("v").alias("s"))
    n = g.filter("i = 0 AND j = 0").select(F.col("v").alias("_n"))
    si, sj = sums.select(F.col("u").alias("i"), F.col("s").alias("_si")), sums.select(F.col("u").alias("j"), F.col("s").alias("_sj"))
    centred = attach_params(attach_params(g.filter("i > 0").join(si, "i").join(sj, "j"), n), width)
    c = F.col("v") - F.col("_si") * F.col("_sj") / F.col("_n")
    place = lambda x: F.floor((F.col(x) - 1) / F.col("_h")).cast("int")
    blocks = centred.select(place("i").alias("a"), place("j").alias("b"), (c * c * F.when((place("i") == place("j")) & (F.col("i") < F.col("j")), 2.0).otherwise(1.0)).alias("q"))
    blocks = blocks.groupBy("a", "b").agg(F.sum("q").alias("q"))
    norms = blocks.filter("a = b")
    pairs = blocks.filter("a < b").join(norms.select("a", F.sqrt("q").alias("_na")), "a").join(norms.select("b", F.sqrt("q").alias("_nb")), "b")
    named = pairs.join(models.select(F.col("_m").alias("a"), F.col(model).alias(f"a_{model}")), "a").join(models.select(F.col("_m").alias("b"), F.col(model).alias(f"b_{model}")), "b")
    return named.select(f"a_{model}", f"b_{model}", F.try_divide("q", F.col("_na") * F.col("_nb")).alias("similarity"))


def length_filter(df: DataFrame, vector: str, order: str) -> DataFrame:
    """Keep the vectors as long as the first one in ``order``."""
    first = df.agg(F.min_by(F.size(vector), F.col(order)).alias("_len"))
    return attach_params(df, first).filter(F.size(vector) == F.col("_len")).drop("_len")


def concat_parts(parts: DataFrame, model: str, position: str, part: str) -> DataFrame:
    """Named parts of a model as one vector, in the order of their position."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("_p"), F.col(part).alias("_v"))))
    return parts.groupBy(model).agg(F.flatten(F.transform(ordered, lambda e: e["_v"])).alias("vector"))


#: Triangles that one task of the reduction takes together.
FAN = 16


def tall_triangle(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """The triangular factor of a tall matrix whose rows are the vectors, as one row (part, r: its entries).

    Each task reduces its rows to a triangle of ``width`` x ``width``, then triangles are reduced together, FAN at a time.
    No product of the matrix with itself is taken, so small singular values keep their digits."""
    def reduced(blocks) -> list[float]:
        r = np.zeros((0, width))
        for block in blocks:
            r = np.linalg.qr(np.concatenate([r, block]), mode="r")
        full = np.zeros((width, width))
        full[: len(r)] = r
        return full.ravel().tolist()

    def of_task(frames):
        def blocks():
            for f in frames:
                for at in range(0, len(f), 4096):
                    yield np.array([np.asarray(v, dtype=float) for v in f["v"].iloc[at : at + 4096]]).reshape(-1, width)

        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [reduced(blocks())]})

    def of_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "r": [reduced(np.array(r).reshape(width, width) for r in frame.sort_values("part")["r"])]})

    out = materialize(rows.select(F.col(vector).alias("v")).mapInPandas(of_task, "part long, r array<double>"), "triangles")
    most = out.agg(F.max("part")).first()[0]
    while most:
        most //= FAN
        out = out.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(of_group, "part long, r array<double>")
    return out


def singular_values(triangle: DataFrame, width: int) -> DataFrame:
    """(component, singular_value, share of the squared norm) from a triangular factor."""
    def solve(frames):
        for f in frames:
            for r in f["r"]:
                s = np.linalg.svd(np.array(r).reshape(width, width), compute_uv=False)
                square = (s**2).sum()
                yield pd.DataFrame({"component": np.arange(1, width + 1), "singular_value": s, "share": s**2 / square if square else np.full(width, np.nan)})

    return triangle.mapInPandas(solve, "component INT, singular_value DOUBLE, share DOUBLE")


def pca_share(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Variance share of the leading components; at most min(k, n - 1, d) of them.

    Vectors are centred at their mean and reduced to a triangle whose singular values are those of the centred matrix."""
    rows = df.select(F.col(vector).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull())
    means = rows.select(F.posexplode("_v").alias("_j", "_x")).groupBy("_j").agg(F.avg("_x").alias("_x"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    d = shape["d"] or 0
    k = max(1, min(k, shape["n"] - 1, d)) if d else 0
    centre = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_x"))), lambda e: e["_x"]).alias("_mean"))  # as long as a vector
    centred = attach_params(rows, centre).select(F.zip_with("_v", "_mean", lambda x, m: x - m).alias("_v"))
    out = singular_values(tall_triangle(centred, "_v", d), d)
    return out.filter(F.col("component") <= k).select("component", F.col("share").alias("variance_share"))


def svd_share(cells: DataFrame, value: str, holes: str = "mean") -> DataFrame:
    """Singular values of the centred cell matrix and their shares of the squared norm.

    A hole counts as the mean, or with ``holes="error"`` ends the job."""
    if holes not in ("mean", "error"):
        raise ValueError(holes)
    known = cells.filter(F.col(value).isNotNull())
    column = known.select("eval_year", "eval_quarter").distinct()
    number = materialize(column.withColumn("_j", F.row_number().over(W.orderBy("eval_year", "eval_quarter")) - 1), "columns")  # periods of a calendar
    width = number.count()
    centred = attach_params(known, known.agg(F.avg(value).alias("_mean"))).withColumn("_v", F.col(value) - F.col("_mean"))
    entry = F.map_from_entries(F.collect_list(F.struct("_j", "_v"))).alias("_m")  # one a period
    listed = centred.join(number, ["eval_year", "eval_quarter"]).groupBy("model_year", "model_quarter").agg(entry, F.count(F.lit(1)).alias("_n"))
    row = F.transform(F.sequence(F.lit(0), F.lit(max(0, width - 1))), lambda j: F.coalesce(F.try_element_at("_m", j), F.lit(0.0)))
    if holes == "error":
        row = F.when(F.col("_n") == width, row).otherwise(
            F.raise_error(F.concat(F.lit("incomplete matrix: model period "), F.concat_ws("/", "model_year", "model_quarter"), F.lit(" lacks cells"))).cast("array<double>"))
    rows = listed.select(row.alias("_r"))
    n = rows.count()
    out = singular_values(tall_triangle(rows, "_r", width), width)
    return out.filter(F.col("component") <= min(n, width))
