"""Spatial and raster-as-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrid.functions import geo
from crossgrid.functions.hashing import hash_order
from crossgrid.operators import raster as RA, spatial as SP
from crossgrid.operators.ranking import sample_per_group
from crossgrid.plans import fixtures as X
from crossgrid.plans.registry import query, r
from crossgrid.session import materialize, rounded, scratch_path
from crossgrid.sources import readers

_U64 = "18446744073709551616.0::DOUBLE"


@query("block_id", f"""
    SELECT id, floor(lon / 0.5)::BIGINT || '_' || floor(lat / 0.5)::BIGINT AS block FROM ({X.COORDS_SQL})""")
def block_id(t):
    return X.coords(t).select("id", geo.block_id("lon", "lat", 0.5).alias("block"))


_KM = """2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(power(sin(radians(p.lat - s.lat) / 2), 2)
         + cos(radians(s.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lon - s.lon) / 2), 2))))"""

_KNN = f"""
    WITH c AS MATERIALIZED ({X.COORDS_SQL}), s AS (SELECT * FROM c),
    d AS (SELECT s.id, p.id AS neighbor, {_KM} AS km FROM s JOIN c p ON p.id <> s.id),
    k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, neighbor)::INTEGER AS rank FROM d QUALIFY rank <= {SP.NEIGHBOURS})"""


def _knn(t, k=SP.NEIGHBOURS):
    return SP.knn_all(X.coords(t), "id", k)


@query("knn_haversine", _KNN + f" SELECT id, neighbor, rank, {r('km')} AS km FROM k")
def knn_haversine(t):
    """Five nearest other points of every point."""
    return _knn(t).select("id", "neighbor", "rank", rounded("km").alias("km"))


def _excl(p: float) -> str:
    j = f"least(greatest(floor({p} * (n + 1))::INTEGER, 1), n - 1)"
    d = f"({p}::DOUBLE * (n + 1) - {j})"
    return f"x[{j}] * (1 - {d}) + x[{j} + 1] * {d}"


@query("nn_distance", _KNN + f""", x AS (SELECT list_sort(list(km)) AS x, count(*)::INTEGER AS n FROM k WHERE rank = 1)
    SELECT n, {r("list_min(x)")} AS min, {r(_excl(0.25))} AS p25, {r(_excl(0.5))} AS median, {r(_excl(0.75))} AS p75, {r("list_max(x)")} AS max FROM x""")
def nn_distance(t):
    """Distribution of the distance to the nearest other point."""
    out = SP.exclusive_quartiles(_knn(t, 1), "km")
    return out.select("n", *[rounded(c).alias(c) for c in ("min", "p25", "median", "p75", "max")])


def _bucket(x: str) -> str:
    u = f"('0x' || substr(sha256('1337:' || {x}), 1, 16))::UBIGINT::DOUBLE / {_U64}"
    return f"CASE WHEN {u} < 0.8 THEN 'train' WHEN {u} < 0.9 THEN 'val' ELSE 'test' END"


def _block(lon: str, lat: str) -> str:
    return f"floor({lon} / block_deg)::BIGINT || '_' || floor({lat} / block_deg)::BIGINT"


@query("block_sweep", _KNN + f""",
    o AS (SELECT unnest([{", ".join(f"{d}::DOUBLE" for d in SP.BLOCK_DEGREES)}]) AS block_deg),
    b AS MATERIALIZED (SELECT *, {_bucket("block")} AS bucket FROM (SELECT block_deg, {_block("lon", "lat")} AS block, count(*) AS n FROM c, o GROUP BY 1, 2)),
    z AS (SELECT block_deg, count(*) AS n_blocks, min(n) AS min_items, median(n)::DOUBLE AS median_items, max(n) AS max_items,
                 {", ".join(f"coalesce(100.0::DOUBLE * sum(n) FILTER (WHERE bucket = '{s}') / sum(n), 0) AS {s}_pct" for s in ("train", "val", "test"))}
          FROM b GROUP BY 1),
    x AS (SELECT block_deg, avg(f) AS f FROM (SELECT block_deg, k.id, avg(({_bucket(_block("a.lon", "a.lat"))} <> {_bucket(_block("p.lon", "p.lat"))})::INTEGER) AS f
          FROM k JOIN c a ON a.id = k.id JOIN c p ON p.id = k.neighbor, o GROUP BY 1, 2) GROUP BY 1)
    SELECT block_deg, {r("block_deg * (111 + 111 * cos(radians((SELECT avg(lat) FROM c)))) / 2", 4)} AS cell_km, n_blocks, min_items, median_items, max_items,
           {r("train_pct", 4)} AS train_pct, {r("val_pct", 4)} AS val_pct, {r("test_pct", 4)} AS test_pct, {r("f")} AS cross_split_fraction,
           {r("0.8 * 0.8 + 0.1 * 0.1 + 0.1 * 0.1")} AS chance_agreement FROM z JOIN x USING (block_deg)""")
def block_sweep(t):
    """Candidate block sizes: size, realised split and leakage to neighbours."""
    pts = X.coords(t)
    near = materialize(_knn(t).select("id", "neighbor"), "neighbours")
    out = SP.block_sweep(pts, near, "id")
    return out.select("block_deg", rounded("cell_km", 4).alias("cell_km"), "n_blocks", "min_items", "median_items", "max_items",
                      *[rounded(f"{b}_pct", 4).alias(f"{b}_pct") for b in ("train", "val", "test")],
                      rounded("cross_split_fraction").alias("cross_split_fraction"), rounded("chance_agreement").alias("chance_agreement"))


_MORAN_PERMS = 999


@query("morans_i")
def morans_i(t):
    """Spatial autocorrelation of all points with their five neighbours, with a permutation test; tested against numpy."""
    pts = X.coords(t)
    near = materialize(_knn(t).select("id", "neighbor"), "neighbours")
    out = SP.morans_i(pts, near, "id", "value", _MORAN_PERMS)
    return out.select(*[rounded(c).alias(c) for c in ("morans_i", "null_mean", "null_95pct", "p_value")], "n_perms", "n_units")


@query("morans_i_observed", _KNN + f""",
    z AS (SELECT id, value - (SELECT avg(value) FROM c) AS z FROM c),
    l AS (SELECT k.id, avg(b.z) AS lag FROM k JOIN z b ON b.id = k.neighbor GROUP BY k.id)
    SELECT {r("sum(z * lag) / sum(z * z)")} AS morans_i, count(*) AS n_units FROM z JOIN l USING (id)""")
def morans_i_observed(t):
    """Moran's I itself, without permutations."""
    pts = X.coords(t)
    near = materialize(_knn(t).select("id", "neighbor"), "neighbours")
    return SP.morans_i(pts, near, "id", "value", 0).select(rounded("morans_i").alias("morans_i"), "n_units")


# --- raster ----------------------------------------------------------------------------

_PX = f"WITH px AS ({X.PIXELS_SQL})"


@query("pooled_band_stats", _PX + f""", l AS (SELECT quarter, (i - 1)::INTEGER AS band, bands[i] AS v FROM px, range(1, 13) t(i)),
    s AS (SELECT quarter, band, coalesce(sum(v) FILTER (WHERE v > 0), 0) AS s, coalesce(sum(v * v) FILTER (WHERE v > 0), 0) AS q,
                 count(*) FILTER (WHERE v > 0) AS n_valid FROM l GROUP BY 1, 2)
    SELECT quarter, band, n_valid, {r("s / greatest(n_valid, 1)", 4)} AS mean,
           {r("sqrt(greatest(q / greatest(n_valid, 1) - power(s / greatest(n_valid, 1), 2), 0.00000001))", 4)} AS std FROM s""")
def pooled_band_stats(t):
    """Mean and std of every band over valid pixels."""
    return RA.pooled_band_stats(X.pixels(t), by=["quarter"]).select(
        "quarter", "band", "n_valid", rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"))


@query("pooled_band_stats_sampled", _PX + f""",
    ch AS (SELECT chip_id FROM (SELECT DISTINCT chip_id, quarter FROM px) QUALIFY row_number() OVER (PARTITION BY quarter ORDER BY md5('1337:' || chip_id)) <= 200),
    l AS (SELECT (i - 1)::INTEGER AS band, bands[i] AS v FROM px SEMI JOIN ch USING (chip_id), range(1, 13) t(i))
    SELECT band, count(*) FILTER (WHERE v > 0) AS n_valid, {r("avg(v) FILTER (WHERE v > 0)", 4)} AS mean,
           {r("stddev_pop(v) FILTER (WHERE v > 0)", 4)} AS std FROM l GROUP BY 1""")
def pooled_band_stats_sampled(t):
    """The same from an equal sample of chips per quarter."""
    px = X.pixels(t)
    chips = px.select("chip_id", "quarter").distinct().withColumn("_h", hash_order(F.lit(1337), "chip_id"))
    chosen = sample_per_group(chips, ["quarter"], "_h", 200).select("chip_id")
    return RA.pooled_band_stats(px.join(chosen, "chip_id", "left_semi")).select(
        "band", "n_valid", rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"))


def _types(t):
    return t.part.groupBy(F.col("p_size").alias("geoid"), F.col("p_type").alias("class")).agg(F.count(F.lit(1)).alias("n"))


_CLASS_LIST = ["ECONOMY", "STANDARD", "PROMO"]


@query("class_fractions", f"""
    WITH c AS (SELECT p_size AS geoid, p_type AS k, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT geoid, {", ".join(f'''{r(f"coalesce(sum(n) FILTER (WHERE k = '{c}'), 0) / sum(n)")} AS "{c}"''' for c in _CLASS_LIST)}
    FROM c WHERE k IN ({", ".join(f"'{c}'" for c in _CLASS_LIST)}) GROUP BY geoid""")
def class_fractions(t):
    """Share of every recognised class per key; other classes leave the denominator."""
    out = RA.class_fractions(_types(t), "geoid", _CLASS_LIST)
    return out.select("geoid", *[rounded(c).alias(c) for c in _CLASS_LIST])


_LC_SQL = """
    SELECT l_suppkey AS geoid, 100.0::DOUBLE * avg((l_tax < 0.03)::INTEGER) AS tree_cover, 100.0::DOUBLE * avg((l_tax >= 0.03 AND l_tax < 0.05)::INTEGER) AS cropland,
           100.0::DOUBLE * avg((l_tax >= 0.05)::INTEGER) AS built_up FROM lineitem GROUP BY 1"""
_LC = ["tree_cover", "cropland", "built_up"]


def _cover(t):
    def pct(c):
        return 100.0 * F.avg(c.cast("int"))

    x = F.col("l_tax")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("geoid")).agg(
        pct(x < 0.03).alias("tree_cover"), pct((x >= 0.03) & (x < 0.05)).alias("cropland"), pct(x >= 0.05).alias("built_up"))


@query("row_normalize", f"""
    WITH f AS ({_LC_SQL}), m AS (SELECT max(tree_cover + cropland + built_up) > 2 AS pct FROM f)
    SELECT geoid, {", ".join(f"{r(f'CASE WHEN pct THEN {c} / nullif(tree_cover + cropland + built_up, 0) ELSE {c} END')} AS {c}" for c in _LC)} FROM f, m""")
def row_normalize(t):
    """Percent rows brought to fractions."""
    return RA.normalize_rows(_cover(t), _LC).select("geoid", *[rounded(c).alias(c) for c in _LC])


@query("reference_class", f"""
    WITH f AS ({_LC_SQL}), m AS (UNPIVOT (SELECT avg(cropland) AS cropland, avg(built_up) AS built_up FROM f) ON cropland, built_up INTO NAME k VALUE v)
    SELECT arg_max(k, v) AS reference_class, {r("max(v)", 4)} AS mean FROM m""")
def reference_class(t):
    """The leftover class with the largest mean."""
    return RA.reference_class(_cover(t), _LC, exclude=["tree_cover"]).select("reference_class", rounded("mean", 4).alias("mean"))


_BROKEN = "chip_id % 7 = 0 AND px = 2 OR chip_id % 97 = 5"


def _chip_files(t):
    """Pixels as JSON lines by quarter, some of them cut off: (readable pixels, quarantined lines)."""
    text = F.to_json(F.struct("chip_id", "px", "bands"))
    line = F.when(F.expr(_BROKEN), F.expr("left(value, length(value) - 9)")).otherwise(F.col("value"))
    path = scratch_path(t.spark, "chips")
    X.pixels(t).withColumn("value", text).select("quarter", line.alias("value")).write.partitionBy("quarter").text(path)
    return readers.read_quarantined(t.spark, path, "chip_id BIGINT, px INT, bands ARRAY<DOUBLE>", key=r'"chip_id":(\d+)')


@query("null_chip_audit", _PX + f""",
    a AS (SELECT chip_id, CASE WHEN {_BROKEN} THEN NULL ELSE bands END AS bands FROM px),
    c AS (SELECT chip_id, sum(len(list_filter(bands, lambda b: b <> 0)))::DOUBLE / sum(len(bands)) AS f, count(*) FILTER (WHERE bands IS NULL) AS bad FROM a GROUP BY 1)
    SELECT chip_id, {r("f")} AS nonzero_fraction, CASE WHEN bad > 0 OR f IS NULL THEN 'unreadable' WHEN f <= 0.4 THEN 'null' ELSE 'ok' END AS status FROM c""")
def null_chip_audit(t):
    """ok / null / unreadable per chip of files with broken lines."""
    good, broken = _chip_files(t)
    lost = broken.select(F.col("key").cast("long").alias("chip_id"), F.lit(None).cast("array<double>").alias("bands"))
    return RA.chip_audit(good.select("chip_id", "bands").union(lost), ["chip_id"], threshold=0.4).select(
        "chip_id", rounded("nonzero_fraction").alias("nonzero_fraction"), "status")


@query("quarantine_counts", _PX + f"""
    SELECT quarter, count(*) FILTER (WHERE NOT ({_BROKEN}) AND len(list_filter(bands, lambda b: b <> 0)) > 0) AS n_good,
           count(*) FILTER (WHERE NOT ({_BROKEN}) AND len(list_filter(bands, lambda b: b <> 0)) = 0) AS n_null,
           count(*) FILTER (WHERE {_BROKEN}) AS n_quarantined, count(*) AS n_lines FROM px GROUP BY quarter""")
def quarantine_counts(t):
    """Lines per folder: good, without a value, quarantined; they add up to what was written."""
    good, broken = _chip_files(t)
    kinds = good.select("file", F.when(F.exists("bands", lambda b: b != 0), "good").otherwise("null").alias("kind")).union(broken.select("file", F.lit("quarantined")))
    folder = F.regexp_extract("file", r"quarter=(\d+)", 1).cast("int").alias("quarter")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("good", "null", "quarantined")]
    return kinds.groupBy(folder).agg(*counts, F.count(F.lit(1)).alias("n_lines"))


@query("null_chip_summary", _PX + f""",
    c AS (SELECT chip_id, quarter, sum(len(list_filter(bands, lambda b: b <> 0)))::DOUBLE / sum(len(bands)) AS f FROM px GROUP BY 1, 2)
    SELECT quarter, count(*) AS n_chips, count(*) FILTER (WHERE f > 0.4) AS n_ok, count(*) FILTER (WHERE f <= 0.4) AS n_null,
           0::BIGINT AS n_unreadable, {r("100.0 * avg((f <= 0.4)::INTEGER)", 4)} AS pct_null FROM c GROUP BY quarter""")
def null_chip_summary(t):
    """Audit counts per quarter."""
    audit = RA.chip_audit(X.pixels(t), ["chip_id", "quarter"], threshold=0.4)
    return RA.audit_summary(audit, ["quarter"]).withColumn("pct_null", rounded("pct_null", 4))


# bands brightened so that many pixels are valid in every band
_BRIGHT = f"""WITH px AS (SELECT chip_id, quarter, list_transform(bands, lambda v: CASE WHEN v > 12000 THEN 0 ELSE 3 * v + 50 END) AS b FROM ({X.PIXELS_SQL}))"""


def _bright(t):
    return X.pixels(t).withColumn("bands", F.transform(
        "bands", lambda v: F.when(v > 12000, F.lit(0.0)).otherwise(3 * v + 50)))


def _ratio(a: int, b: int) -> str:
    return f"coalesce((b[{a}] - b[{b}]) / nullif(b[{a}] + b[{b}], 0), 0)"


@query("spectral_summary", _BRIGHT + f"""
    SELECT chip_id, {r(f"avg({_ratio(8, 4)})")} AS ndvi, {r(f"avg({_ratio(3, 8)})")} AS ndwi, {r(f"avg({_ratio(8, 11)})")} AS ndmi,
           {r("avg(b[1]) / 10000")} AS b01_mean, {r("avg(b[2]) / 10000")} AS b02_mean, {r("avg(b[10]) / 10000")} AS b09_mean
    FROM px WHERE len(list_filter(b, lambda v: v = 0)) = 0 GROUP BY chip_id""")
def spectral_summary(t):
    """Spectral indices and reflectances per chip over fully valid pixels."""
    cols = ["ndvi", "ndwi", "ndmi", "b01_mean", "b02_mean", "b09_mean"]
    return RA.spectral_summary(_bright(t), ["chip_id"]).select("chip_id", *[rounded(c).alias(c) for c in cols])


@query("quality_fracs", _BRIGHT + f""",
    f AS (SELECT chip_id, len(list_filter(b, lambda v: v = 0)) = 0 AS ok, {_ratio(3, 11)} > 0.4 AS snow, (b[2] + b[3] + b[4]) / 3 / 10000 > 0.3 AS bright FROM px)
    SELECT chip_id, {r("avg(ok::INTEGER)")} AS valid_obs_frac,
           {r("count(*) FILTER (WHERE ok AND NOT snow AND bright) / nullif(count(*) FILTER (WHERE ok), 0)")} AS cloud_frac,
           {r("count(*) FILTER (WHERE ok AND snow) / nullif(count(*) FILTER (WHERE ok), 0)")} AS snow_frac FROM f GROUP BY chip_id""")
def quality_fracs(t):
    """Valid, cloud and snow shares per chip; snow is tested before cloud."""
    cols = ["valid_obs_frac", "cloud_frac", "snow_frac"]
    return RA.quality_fractions(_bright(t), ["chip_id"]).select("chip_id", *[rounded(c).alias(c) for c in cols])


_DIV = _PX + """,
    l AS (SELECT chip_id, quarter, i AS band, bands[i] AS v FROM px, range(1, 13) t(i) WHERE bands[i] > 0),
    s AS (SELECT chip_id, quarter, avg(s) AS mean_std FROM (SELECT chip_id, quarter, band, stddev_samp(v) AS s FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2),
    h AS (SELECT chip_id, quarter, least(floor(v / 625), 15) AS bin, count(*) AS c FROM l GROUP BY 1, 2, 3),
    e AS (SELECT chip_id, quarter, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM h GROUP BY 1, 2),
    d AS (SELECT chip_id, quarter, mean_std, entropy FROM s JOIN e USING (chip_id, quarter))"""


@query("pixel_diversity", _DIV + f" SELECT chip_id, quarter, {r('mean_std', 4)} AS mean_std, {r('entropy')} AS entropy FROM d")
def pixel_diversity(t):
    """Mean band spread and histogram entropy of each chip."""
    return RA.pixel_diversity(X.pixels(t), ["chip_id", "quarter"]).select(
        "chip_id", "quarter", rounded("mean_std", 4).alias("mean_std"), rounded("entropy").alias("entropy"))


@query("diversity_corr", _DIV + f""", j AS (SELECT d.*, abs(embedding[64]::DOUBLE) AS err FROM d JOIN embeddings ON vec_id = chip_id)
    SELECT quarter, {r("covar_pop(entropy, err) / nullif(sqrt(var_pop(entropy) * var_pop(err)), 0)")} AS pearson_r, count(*) AS n FROM j GROUP BY quarter
    UNION ALL SELECT NULL, {r("covar_pop(entropy, err) / nullif(sqrt(var_pop(entropy) * var_pop(err)), 0)")}, count(*) FROM j""")
def diversity_corr(t):
    """Diversity against error, within each quarter and overall (quarter NULL)."""
    div = RA.pixel_diversity(X.pixels(t), ["chip_id", "quarter"])
    err = t.embeddings.select(F.col("vec_id").alias("chip_id"), F.abs(F.col("embedding")[63].cast("double")).alias("err"))
    joined = div.join(err, "chip_id")
    within = RA.diversity_correlation(joined, "entropy", "err", ["quarter"])
    overall = RA.diversity_correlation(joined, "entropy", "err", []).select(F.lit(None).cast("int").alias("quarter"), "pearson_r", "n")
    return within.unionByName(overall).withColumn("pearson_r", rounded("pearson_r"))


_ZONES = """
    zn AS (SELECT n_nationkey AS geoid, -125.0::DOUBLE + 11 * (n_nationkey % 5) AS x0, 25.0::DOUBLE + 4.8 * (n_nationkey // 5) AS y0 FROM nation)"""


@query("zonal_counts", f"""
    WITH p AS (SELECT lon, lat, c_mktsegment AS class FROM ({X.COORDS_SQL}) JOIN customer ON c_custkey = id), {_ZONES}
    SELECT geoid, class, count(*) AS n FROM p JOIN zn ON lon >= x0 AND lon < x0 + 10.5 AND lat >= y0 AND lat < y0 + 4.5 GROUP BY ALL""")
def zonal_counts(t):
    """Class counts of the pixel centres inside each polygon."""
    px = X.coords(t).join(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("class")), "id").select(
        F.col("lon").alias("x"), F.col("lat").alias("y"), "class")
    k = F.col("n_nationkey")
    x0 = -125.0 + 11 * (k % 5)
    y0 = 25.0 + 4.8 * F.floor(k / 5)

    def corner(dx, dy):
        return F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))

    zones = t.nation.select(k.alias("geoid"), F.array(corner(0.0, 0.0), corner(10.5, 0.0), corner(10.5, 4.5), corner(0.0, 4.5)).alias("ring"))
    counts, _ = RA.zonal_counts(px, zones, "geoid", 2.0)
    return counts


@query("zonal_rejects", f"""
    WITH p AS (SELECT lon, lat FROM ({X.COORDS_SQL})), {_ZONES}
    SELECT geoid, count(*) AS n_pixels FROM p JOIN zn ON lon >= x0 AND lon < x0 + 10.5 AND lat >= y0 AND lat < y0 + 4.5 GROUP BY geoid HAVING count(*) > 60""")
def zonal_rejects(t):
    """Polygons whose pixel count is over the limit: reported, and counted like the others."""
    px = X.coords(t).select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit("all").alias("class"))
    k = F.col("n_nationkey")
    x0 = -125.0 + 11 * (k % 5)
    y0 = 25.0 + 4.8 * F.floor(k / 5)
    ring = F.array(*[F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in ((0.0, 0.0), (10.5, 0.0), (10.5, 4.5), (0.0, 4.5))])
    _, rejects = RA.zonal_counts(px, t.nation.select(k.alias("geoid"), ring.alias("ring")), "geoid", 2.0, max_pixels=60)
    return rejects


@query("block_tiles", """
    WITH w AS (SELECT p_partkey, (p_size * 137 + 1)::INTEGER AS w, (p_partkey % 5000 + 1)::INTEGER AS h FROM part)
    SELECT p_partkey, c::INTEGER AS col_off, o::INTEGER AS row_off, least(2048, w - c)::INTEGER AS tile_width, least(2048, h - o)::INTEGER AS tile_height
    FROM (SELECT *, unnest(range(0, w, 2048)) AS c FROM w), LATERAL (SELECT unnest(range(0, h, 2048)) AS o)""")
def block_tiles(t):
    """Blocks that cover a raster window, the last ones clipped."""
    w = t.part.select("p_partkey", (F.col("p_size") * 137 + 1).cast("int").alias("w"), (F.col("p_partkey") % 5000 + 1).cast("int").alias("h"))
    return RA.block_tiles(w, "w", "h").drop("w", "h")
