"""Vector, similarity and parameter-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrid.functions import hashing as H
from crossgrid.operators import accuracy as A, resample as S, vectors as V
from crossgrid.plans import fixtures as X
from crossgrid.plans.inference import N_PERMS, null_sql, perm_sql, power_sql
from crossgrid.plans.registry import query, r
from crossgrid.session import attach_params, materialize, rounded


@query("pairs_theta", f"""
    WITH u AS (SELECT DISTINCT model FROM ({X.PARAMS_SQL}))
    SELECT a.model AS model_a, b.model AS model_b FROM u a JOIN u b ON a.model < b.model""")
def pairs_theta(t):
    """Unordered pairs of models."""
    grid = A.unit_grid(X.params(t).select("model").distinct(), "a", "b")
    return grid.filter(F.col("a.model") < F.col("b.model")).select(
        F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"))


_COS = "coalesce(sum(a.value * b.value) / nullif(sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value)), 0), 0)"


@query("cosine_models", f"""
    WITH p AS MATERIALIZED ({X.PARAMS_SQL})
    SELECT a.model AS a_model, b.model AS b_model, {r(_COS)} AS similarity
    FROM p a JOIN p b ON a.idx = b.idx AND a.model < b.model GROUP BY ALL""")
def cosine_models(t):
    """Cosine of every pair of label vectors."""
    out = V.cosine_pairs(X.params(t), ["model"], ["idx"], "value")
    return out.withColumn("similarity", rounded("similarity"))


_SLICE = "CASE WHEN idx <= 8 THEN 'patch_embed' WHEN idx <= 24 THEN 'stage1' WHEN idx <= 40 THEN 'stage2' WHEN idx <= 60 THEN 'stage3' ELSE 'head' END"


def _slices(df):
    i = F.col("idx")
    return df.withColumn("layer", F.when(i <= 8, "patch_embed").when(i <= 24, "stage1").when(i <= 40, "stage2")
                         .when(i <= 60, "stage3").otherwise("head"))


@query("cosine_by_slice", f"""
    WITH p AS MATERIALIZED (SELECT *, {_SLICE} AS layer FROM ({X.PARAMS_SQL}))
    SELECT a.layer, a.model AS a_model, b.model AS b_model, {r(_COS)} AS similarity
    FROM p a JOIN p b ON a.idx = b.idx AND a.model < b.model GROUP BY ALL""")
def cosine_by_slice(t):
    """The same per layer group, all groups in one pass."""
    out = V.cosine_pairs(_slices(X.params(t)), ["model"], ["idx"], "value", by="layer")
    return out.withColumn("similarity", rounded("similarity"))


@query("param_overlay", f"""
    WITH p AS MATERIALIZED (SELECT *, {_SLICE} AS layer FROM ({X.PARAMS_SQL}))
    SELECT a.model, a.idx, a.layer, {r("CASE WHEN a.layer IN ('patch_embed', 'stage1') THEN b.value ELSE a.value END", 8)} AS value,
           a.layer IN ('patch_embed', 'stage1') AS swapped
    FROM p a JOIN p b ON b.idx = a.idx AND b.model = (a.model + 1) % 10""")
def param_overlay(t):
    """Early layers of the next model over each model: donor values for the chosen groups."""
    p = _slices(X.params(t))
    swap = F.col("layer").isin("patch_embed", "stage1")
    donor = p.withColumn("model", F.pmod(F.col("model") - 1, F.lit(10)).cast(p.schema["model"].dataType))
    out = V.param_overlay(p, donor, ["model", "idx", "layer"], swap)
    return out.select("model", "idx", "layer", rounded("value", 8).alias("value"), "swapped")


@query("vector_delta_array", f"""
    WITH m AS (SELECT idx, avg(value) AS base FROM ({X.PARAMS_SQL}) GROUP BY idx)
    SELECT vec_id, {r("sqrt(sum((embedding[m.idx]::DOUBLE - base) * (embedding[m.idx]::DOUBLE - base)))")} AS norm
    FROM embeddings, m GROUP BY vec_id""")
def vector_delta_array(t):
    """Array form of the delta: norm of each vector minus the mean vector."""
    base = X.params(t).groupBy("idx").agg(F.avg("value").alias("v")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda e: e["v"]).alias("base"))
    sq = F.zip_with("embedding", "base", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return attach_params(t.embeddings, base).select(
        "vec_id", rounded(F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))).alias("norm"))


@query("linear_cka", f"""
    WITH e AS (SELECT vec_id, d, embedding[d]::DOUBLE AS v FROM embeddings, range(1, 65) t(d)),
    z AS MATERIALIZED (SELECT vec_id, d, d > 32 AS y, v - avg(v) OVER (PARTITION BY d) AS v FROM e),
    c AS (SELECT a.y AS ya, b.y AS yb, sum(a.v * b.v) AS s FROM z a JOIN z b USING (vec_id) GROUP BY a.y, b.y, a.d, b.d),
    n AS (SELECT sum(s * s) FILTER (WHERE NOT ya AND yb) AS xy, sum(s * s) FILTER (WHERE NOT ya AND NOT yb) AS xx, sum(s * s) FILTER (WHERE ya AND yb) AS yy FROM c)
    SELECT {r("xy / (sqrt(xx) * sqrt(yy))")} AS cka FROM n""")
def linear_cka(t):
    """Linear CKA of the two halves of all vectors, read as hidden units on the same probes."""
    e = t.embeddings.select(F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    return V.linear_cka(e, "x", "y").select(rounded("cka").alias("cka"))


_HIDDEN_SQL = f"""
    WITH p AS MATERIALIZED ({X.PARAMS_SQL}),
    nz AS MATERIALIZED (SELECT vec_id, d::INTEGER AS d,
              sqrt(-2 * ln((('0x' || substr(md5('u:' || vec_id || ':' || d), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0::DOUBLE))
              * cos(2 * pi() * (('0x' || substr(md5('v:' || vec_id || ':' || d), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)) AS z
          FROM embeddings, range(0, 16) t(d)),
    h AS (SELECT p.model, nz.vec_id, (p.idx - 1) // 16 AS unit, greatest(0, sum(p.value * 10 * nz.z) + 0.1 * ((p.idx - 1) // 16)) AS act
          FROM p JOIN nz ON nz.d = (p.idx - 1) % 16 GROUP BY p.model, nz.vec_id, (p.idx - 1) // 16)"""


@query("head_forward", _HIDDEN_SQL + f"""
    SELECT model, vec_id, {r("sum(act * p3.value * 10) + 0.5")} AS output
    FROM h JOIN (SELECT model AS m3, idx - 1 AS unit3, value FROM p WHERE idx <= 4) p3 ON m3 = model AND unit3 = unit GROUP BY model, vec_id""")
def head_forward(t):
    """Two-layer head of every label on a shared set of hash-normal probes (one per vector)."""
    return _activations(t).select("model", "vec_id", rounded("output").alias("output"))


def _activations(t):
    vec = X.params(t).groupBy("model").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda e: e["value"] * 10).alias("w"))
    heads = vec.select(
        "model", F.array(*[F.slice("w", 16 * i + 1, 16) for i in range(4)]).alias("w0"),
        F.array(*[F.lit(0.1 * i) for i in range(4)]).alias("b0"), F.slice("w", 1, 4).alias("w3"), F.lit(0.5).alias("b3"))
    probes = t.embeddings.select("vec_id", F.array(*[H.hash_normal("vec_id", F.lit(d)) for d in range(16)]).alias("x"))
    return V.head_forward(probes, heads, "model", "vec_id", "x")


_CKA_SQL = _HIDDEN_SQL + """,
    c AS MATERIALIZED (SELECT model, unit, vec_id, act - avg(act) OVER (PARTITION BY model, unit) AS z FROM h),
    x AS (SELECT a.model AS ma, b.model AS mb, a.unit AS ua, b.unit AS ub, sum(a.z * b.z) AS s FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.model <= b.model GROUP BY ALL),
    n AS (SELECT ma, mb, sum(s * s) AS q FROM x GROUP BY ALL),
    k AS MATERIALIZED (SELECT n.ma AS a_model, n.mb AS b_model, n.q / nullif(sqrt(a.q) * sqrt(b.q), 0) AS sim
          FROM n JOIN n a ON a.ma = n.ma AND a.mb = n.ma JOIN n b ON b.ma = n.mb AND b.mb = n.mb WHERE n.ma < n.mb)"""


@query("cka_matrix", _CKA_SQL + f" SELECT a_model, b_model, {r('sim')} AS similarity FROM k")
def cka_matrix(t):
    """Linear CKA of the hidden layers of every pair of models, from one Gram aggregate over all probes."""
    out = V.cka_matrix(_activations(t), "model", "vec_id", "hidden")
    return out.withColumn("similarity", rounded("similarity"))


@query("cka_group_test", _CKA_SQL + f""",
    {perm_sql("SELECT DISTINCT model, model % 2 AS val FROM h", key="model", order="model", cols="model")},
    j AS (SELECT a.i, sim, a.val = b.val AS same FROM k JOIN m a ON a.model = a_model JOIN m b ON b.i = a.i AND b.model = b_model),
    g AS (SELECT i, avg(sim) FILTER (WHERE same) - avg(sim) FILTER (WHERE NOT same) AS v FROM j GROUP BY i),
    {null_sql()}
    SELECT {r("obs")} AS observed_gap, {r("null_mean")} AS null_mean, {r("null_95pct")} AS null_95pct, {r("p_value")} AS p_value, n_perms FROM z""")
def cka_group_test(t):
    """Are the functions of models of one group more alike? Labels are permuted over the models."""
    pairs = materialize(V.cka_matrix(_activations(t), "model", "vec_id", "hidden"), "pairs")
    units = V.pair_units(pairs, ["model"]).withColumn("group", F.col("model") % 2)
    out = S.label_gap_test(pairs, units, ["model"], "group", "similarity", N_PERMS)
    return out.select(*[rounded(c).alias(c) for c in ("observed_gap", "null_mean", "null_95pct", "p_value")], "n_perms")


@query("length_filter", """
    WITH v AS (SELECT vec_id, CASE WHEN label = 9 THEN embedding[1:32] ELSE embedding END AS e FROM embeddings)
    SELECT vec_id, len(e)::INTEGER AS length FROM v WHERE len(e) = (SELECT arg_min(len(e), vec_id) FROM v)""")
def length_filter(t):
    """Vectors whose length differs from the first one's are dropped."""
    v = t.embeddings.select("vec_id", F.when(F.col("label") == 9, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("e"))
    return V.length_filter(v, "e", "vec_id").select("vec_id", F.size("e").alias("length"))


@query("concat_parts", f"""
    WITH p AS MATERIALIZED (SELECT *, {_SLICE} AS layer FROM ({X.PARAMS_SQL}))
    SELECT model, count(*)::INTEGER AS length, {r("sum(value * k)", 5)} AS checksum FROM (
        SELECT model, value, row_number() OVER (PARTITION BY model ORDER BY layer, idx) AS k FROM p) GROUP BY model""")
def concat_parts(t):
    """Layer parts of each model joined in the order of their names (length and weighted sum shown)."""
    parts = _slices(X.params(t)).groupBy("model", "layer").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda e: e["value"]).alias("part"))
    joined = V.concat_parts(parts, "model", "layer", "part")
    total = F.aggregate(F.transform("vector", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return joined.select("model", F.size("vector").alias("length"), rounded(total, 5).alias("checksum"))


@query("pca_share")
def pca_share(t):
    """Variance share of the first ten principal components of the vectors."""
    return V.pca_share(t.embeddings, "embedding", 10)


@query("pca_first_share", f"""
    WITH RECURSIVE m AS (SELECT i, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY i),
    {power_sql("SELECT i AS k, list(embedding[i]::DOUBLE - mean ORDER BY vec_id) AS x FROM embeddings, m GROUP BY i", 4000)}
    SELECT {r("share", 5)} AS variance_share FROM z""")
def pca_first_share(t):
    """Variance share of the first principal component."""
    return V.pca_share(t.embeddings, "embedding", 1).select(rounded("variance_share", 5).alias("variance_share"))
