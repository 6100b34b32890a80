"""Scalar expressions on hand-made rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from crossgrid.functions import geo, hashing as H, ids, metrics as M
from crossgrid.operators import features as FE


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    (" 4003010600.0 ", "04003010600"), ("39003010600", "39003010600"), ("abc", None), ("", None),
    ("1234567890123", "1234567890123"), ("04-003", "00000004003"),
])
def test_normalize_id(spark, raw, want):
    assert one(spark, ids.normalize_id("v"), v=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("/a/chips/39003010600.tif", "39003010600"), ("x.tar.gz", "x.tar"), ("/a/b", "b"),
])
def test_item_key(spark, raw, want):
    assert one(spark, ids.item_key("v"), v=raw) == want


def test_snake_case(spark):
    assert one(spark, ids.snake_case("v"), v="Bare/sparse vegetation ") == "bare_sparse_vegetation"


@pytest.mark.parametrize("raw, want", [("-666666666", None), ("-1", None), ("12.5", 12.5), ("n/a", None), ("NaN", None)])
def test_sentinels(spark, raw, want):
    assert one(spark, ids.sentinel_to_null("v"), v=raw) == want


def test_path_round_trip(spark):
    path = ids.pred_path(F.lit("oh"), F.lit(2016), F.lit(1), F.lit(195), F.lit(2017), F.lit(3), F.lit("wealth_index"))
    parts = ids.parse_pred_path("p")
    row = spark.range(1).select(path.alias("p")).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert row.asDict() == {"state": "oh", "model_quarter": 1, "model_year": 2016, "epoch": 195, "eval_year": 2017,
                            "eval_quarter": 3, "variable": "wealth_index"}
    other = spark.createDataFrame([("/tmp/readme.txt",)], ["p"]).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert set(other) == {None}


@pytest.mark.parametrize("key, want", [
    ("features.0.0.weight", "patch_embed"), ("features.1.x", "stage1"), ("features.2.x", "stage2"), ("features.3.x", "stage2"),
    ("features.4.x", "stage3"), ("features.5.x", "stage3"), ("features.6.x", "stage4"), ("features.7.x", "stage4"),
    ("norm.weight", "final_norm"), ("head.weight", "other"),
])
def test_layer_group(spark, key, want):
    assert one(spark, ids.layer_group("v"), v=key) == want


@pytest.mark.parametrize("raw, vintage, reason", [
    ("2015-2019", 2019, None), ("2015-2018", None, "span"), ("2001-2005", None, "too_early"), ("2015", None, "format"),
])
def test_period(spark, raw, vintage, reason):
    p = ids.parse_period("v")
    row = spark.createDataFrame([(raw,)], ["v"]).select(p["vintage"].alias("a"), p["reason"].alias("b")).first()
    assert (row.a, row.b) == (vintage, reason)


def test_quarter_bounds(spark):
    a, b = ids.quarter_bounds(F.lit(2016), F.lit(1))
    row = spark.range(1).select(a.cast("string").alias("a"), b.cast("string").alias("b")).first()
    assert (row.a, row.b) == ("2016-01-01", "2016-03-31")


def test_stable_split_equals_python(spark):
    keys = [f"k{i}" for i in range(200)]
    rows = spark.createDataFrame([(k,) for k in keys], ["k"]).select("k", H.stable_unit_interval("k").alias("u"), H.split_bucket("k").alias("s")).collect()
    for row in rows:
        u = int(hashlib.sha256(f"1337:{row.k}".encode()).hexdigest()[:16], 16) / 2 ** 64
        assert row.u == u
        assert row.s == ("train" if u < 0.8 else "val" if u < 0.9 else "test")


def test_split_does_not_change_when_rows_go(spark):
    df = spark.range(300).withColumn("s", H.split_bucket("id"))
    some = spark.range(0, 300, 3).withColumn("t", H.split_bucket("id"))
    assert df.join(some, "id").filter("s <> t").count() == 0


def test_hash_normal_looks_normal(spark):
    row = spark.range(20000).select(H.hash_normal("id").alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(row.m) < 0.03 and abs(row.s - 1) < 0.03


def test_recovery(spark):
    assert one(spark, M.recovery("b", "i", "d"), b=0.2, i=0.5, d=0.8) == pytest.approx(0.5)
    assert one(spark, M.recovery("b", "i", "d"), b=0.8, i=0.5, d=0.8) is None


def test_r2_of_mean_predictor_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], ["y", "f"])
    assert df.agg(M.r2("y", "f")).first()[0] == pytest.approx(0.0)
    assert df.agg(M.pearson("y", "f")).first()[0] is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], ["y", "f"])
    assert flat.agg(M.r2("y", "f")).first()[0] is None


def test_t_p_values():
    # two-sided 5% points of the t distribution
    for dof, t in ((1, 12.7062047362), (5, 2.5705818356), (30, 2.0422724563), (1000, 1.9623390808)):
        assert M.student_t_two_sided(t, dof) == pytest.approx(0.05, abs=1e-9)
    assert M.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


@pytest.mark.parametrize("p, d, want", [
    (0.01, 0.9, "large"), (0.01, -0.6, "medium"), (0.01, 0.3, "small"), (0.01, 0.1, "negligible"), (0.5, 2.0, "not_significant"),
])
def test_effect_label(spark, p, d, want):
    assert one(spark, M.effect_label("p", "d"), p=p, d=d) == want


@pytest.mark.parametrize("c, p, want", [(1.0, 0.01, "consistent"), (-1.0, 0.01, "opposite"), (1.0, 0.2, "no support")])
def test_direction_note(spark, c, p, want):
    assert one(spark, M.direction_note("c", "p"), c=c, p=p) == want


def test_block_id_floors_negative(spark):
    assert one(spark, geo.block_id("lon", "lat", 0.5), lon=-83.01, lat=39.99) == "-167_79"


def test_point_in_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0))])
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.9, 3.0), (5.0, 1.0), (0.5, 3.0)], ["x", "y"])
    got = [r[0] for r in df.select(geo.point_in_ring("x", "y", ring)).collect()]
    assert got == [True, False, True, False, True]


def test_haversine(spark):
    assert one(spark, geo.haversine_km("a", "b", "c", "d"), a=0.0, b=0.0, c=0.0, d=180.0) == pytest.approx(math.pi * 6371.0)


def test_derived_features(spark):
    df = spark.createDataFrame([(None, 3.0, 0.0), (-5.0, 1.0, 4.0)], "median_home_value double, owner_occupied_units double, total_housing_units double")
    rows = FE.derive_features(df).collect()
    assert rows[0].log_home_value is None and rows[0].owner_pct is None and rows[0].broadband_pct is None
    assert rows[1].log_home_value == 0.0 and rows[1].owner_pct == 25.0
