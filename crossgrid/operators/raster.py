"""Raster work on pixel and class-count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crossgrid.functions import bands as B, metrics as M
from crossgrid.session import attach_params, materialize, small_side

MIN_VARIANCE = 1e-8

# Thresholds of the snow index and of visible reflectance (own definition).
SNOW_NDSI = 0.4
CLOUD_VISIBLE = 0.3


def pooled_band_stats(pixels: DataFrame, bands: str = "bands", by: list[str] | None = None) -> DataFrame:
    """Mean and std of each band over its valid (> 0) pixels, from sums that merge in any order.

    With no valid pixel the count is floored at 1 and the variance at 1e-8.
    """
    long = pixels.select(*(by or []), F.posexplode(bands).alias("band", "v"))
    v = F.when(F.col("v") > 0, F.col("v"))
    sums = long.groupBy(*(by or []), "band").agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("_q"),
        F.count(v).alias("n_valid"))
    n = F.greatest("n_valid", F.lit(1))
    mean = F.col("_s") / n
    return sums.select(
        *(by or []), "band", "n_valid", mean.alias("mean"),
        F.sqrt(F.greatest(F.col("_q") / n - mean * mean, F.lit(MIN_VARIANCE))).alias("std"))


def class_fractions(counts: DataFrame, key: str, classes: list, class_col: str = "class", n: str = "n") -> DataFrame:
    """Share of each recognised class per key; absent is 0, keys without recognised pixels go."""
    known = counts.filter(F.col(class_col).isin(classes))
    wide = known.groupBy(key).agg(
        *[F.coalesce(F.sum(F.when(F.col(class_col) == c, F.col(n))), F.lit(0)).alias(f"_{i}") for i, c in enumerate(classes)],
        F.sum(n).alias("_total")).filter("_total > 0")
    return wide.select(key, *[(F.col(f"_{i}") / F.col("_total")).alias(str(c)) for i, c in enumerate(classes)])


def normalize_rows(df: DataFrame, columns: list[str], limit: float = 2.0) -> DataFrame:
    """Divide rows by their sum if any row sums to more than ``limit`` (percent input)."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
    largest = df.agg(F.max(total).alias("_largest"))
    scale = F.when(F.col("_largest") > limit, total).otherwise(F.lit(1.0))
    return attach_params(df, largest).withColumn("_scale", scale).withColumns(
        {c: F.try_divide(F.col(c), F.col("_scale")) for c in columns}).drop("_largest", "_scale")


def reference_class(df: DataFrame, columns: list[str], exclude: list[str] | None = None) -> DataFrame:
    """The leftover class with the largest mean (the first in column order on a tie)."""
    rest = [c for c in columns if c not in (exclude or [])]
    means = df.agg(*[F.avg(c).alias(c) for c in rest])
    entries = F.array(*[F.struct(F.col(c).alias("m"), F.lit(-i).alias("o"), F.lit(c).alias("name")) for i, c in enumerate(rest)])
    best = F.array_max(entries)
    return means.select(best["name"].alias("reference_class"), best["m"].alias("mean"))


def chip_audit(pixels: DataFrame, chip: list[str], bands: str = "bands", threshold: float = 0.0) -> DataFrame:
    """ok / null / unreadable per chip from the share of nonzero values."""
    n = F.size(bands)
    nonzero = F.size(F.filter(bands, lambda b: b != 0))
    readable = F.col(bands).isNotNull()
    per = pixels.groupBy(*chip).agg(
        F.sum(F.when(readable, n)).alias("_n"), F.sum(F.when(readable, nonzero)).alias("_nz"),
        F.count_if(~readable).alias("_bad"))
    share = F.try_divide(F.col("_nz").cast("double"), F.col("_n").cast("double"))
    status = F.when((F.col("_bad") > 0) | share.isNull(), "unreadable").when(share <= threshold, "null").otherwise("ok")
    return per.select(*chip, share.alias("nonzero_fraction"), status.alias("status"))


def audit_summary(audit: DataFrame, by: list[str] | None = None) -> DataFrame:
    counts = {s: F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "null", "unreadable")}
    return audit.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_chips"), *counts.values(),
        (100.0 * F.avg((F.col("status") == "null").cast("int"))).alias("pct_null"))


def spectral_summary(pixels: DataFrame, chip: list[str], bands: str = "bands") -> DataFrame:
    """Mean NDVI, NDWI, NDMI and three band reflectances over pixels valid in every band."""
    valid = pixels.filter(F.forall(bands, lambda b: b != 0))
    return valid.groupBy(*chip).agg(
        F.avg(B.ndvi(bands)).alias("ndvi"), F.avg(B.ndwi(bands)).alias("ndwi"), F.avg(B.ndmi(bands)).alias("ndmi"),
        *[(F.avg(B.band(n, bands)) / B.REFLECTANCE_SCALE).alias(f"{n.lower()}_mean") for n in ("B01", "B02", "B09")])


def quality_fractions(pixels: DataFrame, chip: list[str], bands: str = "bands", ndsi: float = SNOW_NDSI,
                      visible: float = CLOUD_VISIBLE) -> DataFrame:
    """valid_obs_frac of all pixels; snow before cloud among the valid ones."""
    ok = F.forall(bands, lambda b: b != 0)
    snow = ok & (B.ratio(B.band("B03", bands), B.band("B11", bands)) > ndsi)
    bright = (B.band("B02", bands) + B.band("B03", bands) + B.band("B04", bands)) / 3 / B.REFLECTANCE_SCALE
    cloud = ok & ~snow & (bright > visible)
    n_ok = F.count_if(ok)
    return pixels.groupBy(*chip).agg(
        F.avg(ok.cast("int")).alias("valid_obs_frac"),
        F.try_divide(F.count_if(cloud), n_ok).alias("cloud_frac"), F.try_divide(F.count_if(snow), n_ok).alias("snow_frac"))


def pixel_diversity(pixels: DataFrame, chip: list[str], bands: str = "bands", bins: int = 16, top: float = 10000.0) -> DataFrame:
    """Spread of each chip: mean per-band sample std and entropy of a fixed-width histogram.

    The histogram has ``bins`` cells per chip, so the second grouping is bounded.
    """
    long = pixels.select(*chip, F.posexplode(bands).alias("band", "v")).filter("v > 0")
    spread = long.groupBy(*chip, "band").agg(F.stddev_samp("v").alias("s")).groupBy(*chip).agg(F.avg("s").alias("mean_std"))
    width = F.least(F.floor(F.col("v") / (top / bins)), F.lit(bins - 1))
    hist = long.groupBy(*chip, width.alias("_bin")).agg(F.count(F.lit(1)).alias("c"))
    # entropy = ln N - sum(c ln c) / N
    entropy = hist.groupBy(*chip).agg(
        (F.log(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log(F.col("c").cast("double"))) / F.sum("c")).alias("entropy"))
    return spread.join(entropy, chip)


#: Distinct pixel centres of one grid cell that one task takes at most, on average.
CROWD = 20_000


def _edges(polygons: DataFrame, key: str) -> DataFrame:
    """(key, ax, ay, bx, by) of every ring, closed or open; ``rings`` may hold holes and separate parts."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    ring = polygons.select(key, F.explode(rings).alias("_r")).filter(F.size("_r") > 1)
    ends = F.transform("_r", lambda p, i: F.struct(p.alias("a"), F.get("_r", (i + 1) % F.size("_r")).alias("b")))
    return ring.select(key, F.explode(ends).alias("e")).select(key, *[F.col(f"e.{p}.{c}").cast("double").alias(f"{p}{c}") for p in "ab" for c in "xy"]).filter(
        "ax <> bx or ay <> by")


def classified_cells(polygons: DataFrame, key: str, cell: float) -> tuple[DataFrame, DataFrame]:
    """Grid cells of each polygon: (key, cx, cy) wholly inside, and (key, cx, cy, edges) that an edge runs through.

    An edge marks the cells it passes in each row of the grid, a little widened against rounding. Between them a cell is
    inside where the line through the row's middle has crossed an odd number of edges. ``edges`` are those of the row: no
    others decide about its points."""
    def at(v):
        return F.floor(v / cell)

    rows = _edges(polygons, key).withColumn("cy", F.explode(F.sequence(at(F.least("ay", "by")), at(F.greatest("ay", "by")))))

    def x_at(y):
        """Where the edge meets a height, held within the edge."""
        x = F.col("ax") + F.try_divide((F.col("bx") - F.col("ax")) * (y - F.col("ay")), F.col("by") - F.col("ay"))
        return F.greatest(F.least("ax", "bx"), F.least(F.greatest("ax", "bx"), x))

    low, high = x_at(F.col("cy") * cell), x_at((F.col("cy") + 1) * cell)
    first, second = (F.when(F.col("ay") == F.col("by"), F.col(f"{p}x")).when(
        F.col(f"{p}y") < F.col("cy") * cell, low).when(F.col(f"{p}y") > (F.col("cy") + 1) * cell, high).otherwise(F.col(f"{p}x")) for p in "ab")
    pad = 1e-9 * (1.0 + F.abs("ax") + F.abs("bx"))
    passed = F.sequence(at(F.least(first, second) - pad), at(F.greatest(first, second) + pad))
    middle = (F.col("cy") + 0.5) * cell
    crossing = F.when((F.col("ay") > middle) != (F.col("by") > middle), x_at(middle))
    # a polygon's own edges and cells, by row
    per_row = rows.groupBy(key, "cy").agg(
        F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"), F.array_distinct(F.flatten(F.collect_list(passed))).alias("on"),
        F.array_sort(F.collect_list(crossing)).alias("cuts"))
    border = per_row.select(key, "cy", "edges", F.explode("on").alias("cx"))
    spans = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2, F.lit(2)), lambda i: F.struct(
        F.ceil(F.get("cuts", i) / cell - 0.5).alias("lo"), F.floor(F.get("cuts", i + 1) / cell - 0.5).alias("hi")))
    inner = F.flatten(F.transform(F.filter(spans, lambda s: s["lo"] <= s["hi"]), lambda s: F.sequence(s["lo"], s["hi"])))
    inside = per_row.filter(F.size("cuts") >= 2).select(key, "cy", F.explode(F.array_except(inner, "on")).alias("cx"))
    return inside, border


def _odd_crossings(x, y, edges):
    """Even-odd rule of a ray to the right over edges."""
    def crossed(e):
        straddles = (e["ay"] > y) != (e["by"] > y)
        return F.when(straddles, x < F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]).otherwise(False)

    return F.size(F.filter(edges, crossed)) % 2 == 1


def zonal_counts(pixels: DataFrame, polygons: DataFrame, key: str, cell: float, max_pixels: int | None = None, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Class counts of the pixel centres inside each polygon, all polygons included, and a report of those with more than
    ``max_pixels`` (they are counted like the others).

    ``polygons`` holds a ``ring`` or several ``rings`` (even-odd rule: holes, parts). Cells wholly inside a polygon give their
    class counts without a test of points; only pixels of cells on its border are tested. Equal pixels are counted first, and
    a border cell with more than ``crowd`` distinct centres is split over as many tasks as it needs."""
    inside, border = (materialize(x, "zone-cells") for x in classified_cells(polygons, key, cell))
    centres = materialize(
        pixels.groupBy("x", "y", "class").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)), "centres")
    whole = centres.groupBy("cx", "cy", "class").agg(F.sum("c").alias("c")).join(inside, ["cx", "cy"]).select(key, "class", "c")
    crowded = centres.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > crowd).select("cx", "cy", F.ceil(F.col("_k") / crowd).cast("int").alias("_parts"))
    crowded = small_side(crowded, "crowded-cells")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = centres.join(crowded, ["cx", "cy"], "left").withColumn("part", F.pmod(F.xxhash64("x", "y"), parts).cast("int")).drop("_parts")
    zones = border.join(crowded, ["cx", "cy"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    tested = dealt.join(zones, ["cx", "cy", "part"]).filter(_odd_crossings(F.col("x"), F.col("y"), F.col("edges"))).select(key, "class", "c")
    counts = whole.union(tested).groupBy(key, "class").agg(F.sum("c").alias("n"))
    if max_pixels is None:
        return counts, counts.limit(0)
    return counts, counts.groupBy(key).agg(F.sum("n").alias("n_pixels")).filter(F.col("n_pixels") > max_pixels)


def block_tiles(windows: DataFrame, width: str, height: str, size: int = 2048) -> DataFrame:
    """Blocks of at most size x size that cover a window; the last row and column are clipped."""
    def starts(extent):
        # an empty window has no blocks
        return F.when(F.col(extent) > 0, F.sequence(F.lit(0), F.col(extent) - 1, F.lit(size)))

    return (
        windows.withColumn("col_off", F.explode(starts(width))).withColumn("row_off", F.explode(starts(height)))
        .withColumn("tile_width", F.least(F.lit(size), F.col(width) - F.col("col_off")))
        .withColumn("tile_height", F.least(F.lit(size), F.col(height) - F.col("row_off")))
    )


def diversity_correlation(joined: DataFrame, measure: str, error: str, by: list[str]) -> DataFrame:
    """r of a diversity measure and an error, overall and within each quarter."""
    return joined.groupBy(*by).agg(M.pearson(measure, error).alias("pearson_r"), F.count(F.lit(1)).alias("n"))
