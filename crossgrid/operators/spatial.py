"""Spatial operators: nearest neighbours of all points or of a sample, block sweeps, spatial autocorrelation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crossgrid.functions import geo, hashing as H
from crossgrid.operators.quantile import quantile_columns
from crossgrid.operators.resample import summarize_null
from crossgrid.session import attach_params, materialize

# Candidate block sizes in degrees, and the default sample.
BLOCK_DEGREES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)
SAMPLE_SIZE = 300
NEIGHBOURS = 5


def sample_points(points: DataFrame, key: str, n: int = SAMPLE_SIZE, seed: int = 1337) -> DataFrame:
    """At most ``n`` points in hash order (a distributed top-n)."""
    return points.orderBy(H.hash_order(F.lit(seed), key)).limit(n)


def knn(points: DataFrame, sample: DataFrame, key: str, k: int = NEIGHBOURS) -> DataFrame:
    """k nearest other points of each sampled point by great-circle distance.

    The sample is as long as its size parameter, so it travels with the task. Every task keeps
    its own k best per sampled point, over whole batches of points; one more ranking over
    (tasks x k) rows per sampled point finishes. All points are looked at once, crowded places
    cost nothing extra.
    """
    picked = [(row[key], row["lat"], row["lon"]) for row in sample.select(key, "lat", "lon").collect()]
    ids = np.array([p[0] for p in picked])
    lat0 = np.radians([p[1] for p in picked])
    lon0 = np.array([p[2] for p in picked], dtype=float)
    lat0_deg = np.array([p[1] for p in picked], dtype=float)

    def nearest(batches):
        best = [(np.empty(0), np.empty(0, dtype=ids.dtype))] * len(ids)
        for pdf in batches:
            other = pdf["id"].to_numpy()
            lat, lon = pdf["lat"].to_numpy(dtype=float), pdf["lon"].to_numpy(dtype=float)
            for s in range(len(ids)):
                half_lat, half_lon = np.radians(lat - lat0_deg[s]) / 2, np.radians(lon - lon0[s]) / 2
                a = np.sin(half_lat) ** 2 + np.cos(lat0[s]) * np.cos(np.radians(lat)) * np.sin(half_lon) ** 2
                d = 2 * geo.EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))
                d[other == ids[s]] = np.inf
                if len(d) > k:  # keep the k smallest and everything tied with the last of them
                    near = d <= np.partition(d, k - 1)[k - 1]
                else:
                    near = np.ones(len(d), dtype=bool)
                near &= np.isfinite(d)
                dist = np.concatenate([best[s][0], d[near]])
                names = np.concatenate([best[s][1], other[near]])
                order = np.lexsort((names, dist))[:k]
                best[s] = (dist[order], names[order])
        rows = [(i, n, v) for i, (dist, names) in zip(ids, best) for v, n in zip(dist, names)]
        yield pd.DataFrame(rows, columns=["id", "neighbor", "km"])

    kind = dict(points.dtypes)[key]
    partial = points.select(F.col(key).alias("id"), "lat", "lon").mapInPandas(
        nearest, f"id {kind}, neighbor {kind}, km DOUBLE")
    w = W.partitionBy("id").orderBy("km", "neighbor")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Places of a leaf of the space partition; lower bounds are lowered by so much for rounding.
LEAF, ROUNDING = 2048, 4e-15
_SOLVED = "leaf int, lat double, lon double, id long, first boolean, x double, y double, z double, reach double, near array<struct<neighbor: long, km: double>>"
_FOUND = "lat double, lon double, near array<struct<neighbor: long, km: double>>"


def _on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the unit sphere: straight distances there grow with great-circle ones and have no seams or poles."""
    p, m = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(m), np.cos(p) * np.sin(m), np.sin(p)], axis=1)


def _order_code(at: np.ndarray, bits: int = 20) -> np.ndarray:
    """Z-order of points in the cube around the sphere."""
    cell = np.minimum(((at + 1.0) / 2.0 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    code = np.zeros(len(at), dtype=np.int64)
    for k in range(bits):
        for axis in range(3):
            code |= (cell[:, axis] >> k & 1) << (3 * k + axis)
    return code


def _nearest(lat: np.ndarray, lon: np.ndarray, at: np.ndarray, refs: pd.DataFrame, k: int, within: np.ndarray | None = None):
    """For each place the ``k`` nearest of ``refs`` (no farther than the chord ``within``) by (km, id): lists of (id, km)."""
    ref_at, ids = refs[["x", "y", "z"]].to_numpy(), refs["id"].to_numpy()
    ref_lat, ref_lon = refs["lat"].to_numpy(), refs["lon"].to_numpy()
    out, step = [], max(1, (1 << 20) // max(1, len(ids)))
    for lo in range(0, len(lat), step):
        part = slice(lo, lo + step)
        square = sum((at[part, axis, None] - ref_at[None, :, axis]) ** 2 for axis in range(3))
        bound = np.full(len(square), np.inf) if within is None else within[part].copy()
        if len(ids) > k:
            bound = np.minimum(bound, np.sqrt(np.partition(square, k - 1, axis=1)[:, k - 1]))
        row, ref = np.nonzero(square <= ((bound * (1 + 1e-12) + ROUNDING) ** 2)[:, None])
        half_lat, half_lon = np.radians(ref_lat[ref] - lat[part][row]) / 2, np.radians(ref_lon[ref] - lon[part][row]) / 2
        a = np.sin(half_lat) ** 2 + np.cos(np.radians(lat[part][row])) * np.cos(np.radians(ref_lat[ref])) * np.sin(half_lon) ** 2
        km = 2 * geo.EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))
        order = np.lexsort((ids[ref], km, row))
        row, ref, km = row[order], ref[order], km[order]
        begin = np.searchsorted(row, np.arange(len(square) + 1))
        out += [list(zip(ids[ref[u:v]].tolist(), km[u:v].tolist(), strict=True)) for u, v in ((u, min(v, u + k)) for u, v in zip(begin[:-1], begin[1:], strict=True))]
    return out


def _as_near(lists: list) -> list:
    return [[{"neighbor": i, "km": v} for i, v in pairs] for pairs in lists]


def _solve_leaf(k: int):
    """Each task holds one leaf: its places' nearest references within the leaf, and how far a nearer one may be."""

    def solve(frames):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        leaf = pd.concat(frames, ignore_index=True)
        at = _on_sphere(leaf["lat"].to_numpy(), leaf["lon"].to_numpy())
        leaf["x"], leaf["y"], leaf["z"] = at.T
        places = np.flatnonzero(leaf["first"].to_numpy())
        near = _nearest(leaf["lat"].to_numpy()[places], leaf["lon"].to_numpy()[places], at[places], leaf, k)
        reach, lists = np.full(len(leaf), -1.0), [None] * len(leaf)
        for p, pairs, kept in zip(places.tolist(), near, _as_near(near), strict=True):
            reach[p] = 2 * np.sin(min(pairs[-1][1] / (2 * geo.EARTH_RADIUS_KM), np.pi / 2)) if len(pairs) == k else 3.0
            lists[p] = kept
        leaf["leaf"], leaf["reach"], leaf["near"] = TaskContext.get().partitionId(), reach, lists
        yield leaf[["leaf", "lat", "lon", "id", "first", "x", "y", "z", "reach", "near"]]

    return solve


def _visit(k: int):
    """References of a leaf meet the places of other leaves whose reach touches it."""

    def visit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asked = frame[frame["asks"]]
        if not len(asked):
            return pd.DataFrame({"lat": [], "lon": [], "near": []})
        at = asked[["x", "y", "z"]].to_numpy()
        near = _nearest(asked["lat"].to_numpy(), asked["lon"].to_numpy(), at, frame[~frame["asks"]], k, asked["reach"].to_numpy())
        some = [p for p, pairs in enumerate(near) if pairs]
        return pd.DataFrame({"lat": asked["lat"].to_numpy()[some], "lon": asked["lon"].to_numpy()[some], "near": _as_near([near[p] for p in some])})

    return visit


def _gap(low, high, at: Column) -> Column:
    """How far a coordinate lies outside an interval."""
    return F.greatest(F.lit(0.0), low - at, at - high)


def _boxes(points: DataFrame, by: str) -> DataFrame:
    sides = [f(c).alias(f"{name}{c}") for c in "xyz" for f, name in ((F.min, "l"), (F.max, "h"))]
    return points.groupBy(by).agg(*sides, F.max("reach").alias("reach"))


def _box_gap(a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    out = F.lit(0.0)
    for c in "xyz":
        gap = F.greatest(F.lit(0.0), F.col(f"{a}.l{c}") - F.col(f"{b}.h{c}"), F.col(f"{b}.l{c}") - F.col(f"{a}.h{c}"))
        out = out + gap * gap
    return out


def knn_all(points: DataFrame, key: str, k: int = NEIGHBOURS, leaf: int = LEAF) -> DataFrame:
    """k nearest other points of every point by great-circle distance, exactly: (id, neighbor, km, rank).

    Points at one place share their search, and only the k + 1 lowest keys of a place can be anyone's neighbours. These
    references are cut along a Z-order curve on the sphere into leaves of about ``leaf`` each, small where points are
    crowded and wide where they are not. Round one finds the nearest within each leaf; that bounds how far a nearer one may
    be. In round two a place visits only those other leaves whose box lies within that reach; pairs of leaves are found over
    boxes of boxes. Points without coordinates are left out; ids are integers."""
    spark = points.sparkSession
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    own = points.select(F.col(key).cast("long").alias("id"), (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon")).filter(there)
    lowest = F.row_number().over(W.partitionBy("lat", "lon").orderBy("id"))
    refs = materialize(own.withColumn("_r", lowest).filter(F.col("_r") <= k + 1).select("id", "lat", "lon", (F.col("_r") == 1).alias("first")), "references")
    leaves = max(1, -(-refs.count() // leaf))
    kind = points.schema[key].dataType.simpleString()

    def coded(frames):
        for f in frames:
            f["code"] = _order_code(_on_sphere(f["lat"].to_numpy(), f["lon"].to_numpy()))
            yield f

    # places at one code still fall apart by their coordinates
    curve = refs.mapInPandas(coded, "id long, lat double, lon double, first boolean, code long").repartitionByRange(leaves, "code", "lat", "lon")
    solved = materialize(curve.mapInPandas(_solve_leaf(k + 1), _SOLVED), "leaves")
    places = solved.filter("first")
    done = places.select("lat", "lon", "near")
    if leaves > 1:
        group = max(1, int(leaves**0.5))
        boxes = materialize(_boxes(solved, "leaf"), "leaf-boxes")
        wide = boxes.withColumn("super", F.floor(F.col("leaf") / group)).groupBy("super").agg(
            *[f(f"{n}{c}").alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))])
        reach = F.col("a.reach") + ROUNDING
        # the wide boxes are as many as the root of the number of leaves
        hit = boxes.alias("a").join(F.broadcast(wide.alias("s")), _box_gap("a", "s") <= reach * reach).select("a.*", "s.super")
        pairs = hit.alias("a").join(boxes.withColumn("super", F.floor(F.col("leaf") / group)).alias("b"), "super").filter(
            (F.col("a.leaf") != F.col("b.leaf")) & (_box_gap("a", "b") <= reach * reach))
        pairs = pairs.select(F.col("a.leaf").alias("leaf"), F.col("b.leaf").alias("to"), *[F.col(f"b.{n}{c}").alias(f"{n}{c}") for c in "xyz" for n in "lh"])
        square = sum((_gap(F.col(f"l{c}"), F.col(f"h{c}"), F.col(c)) ** 2 for c in "xyz"), F.lit(0.0))
        asked = places.drop("near").join(materialize(pairs, "leaf-pairs"), "leaf").filter(square <= (F.col("reach") + ROUNDING) ** 2)
        cols = ["lat", "lon", "id", "x", "y", "z", "reach"]
        met = asked.select(F.col("to").alias("leaf"), *cols, F.lit(True).alias("asks")).union(solved.select("leaf", *cols, F.lit(False).alias("asks")))
        found = met.groupBy("leaf").applyInPandas(_visit(k + 1), _FOUND)
        both = done.union(found).groupBy("lat", "lon").agg(F.flatten(F.collect_list("near")).alias("near"))
        best = F.slice(F.array_sort(F.transform("near", lambda n: F.struct(n["km"].alias("km"), n["neighbor"].alias("neighbor")))), 1, k + 1)
        done = both.select("lat", "lon", best.alias("near"))
    others = F.slice(F.filter("near", lambda n: n["neighbor"] != F.col("id")), 1, k)
    each = own.join(done, ["lat", "lon"]).select("id", F.posexplode(others).alias("_p", "n"))
    return each.select(F.col("id").cast(kind).alias("id"), F.col("n.neighbor").cast(kind).alias("neighbor"), "n.km", (F.col("_p") + 1).alias("rank"))


def exclusive_quartiles(df: DataFrame, value: str) -> DataFrame:
    """min, p25, median, p75, max with the exclusive rule (positions p * (n + 1)), for any number of values."""
    quartiles = quantile_columns(df, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}, exclusive=True)
    ends = df.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    return attach_params(quartiles, ends).select(F.col("n").cast("int").alias("n"), "min", "p25", "median", "p75", "max")


def block_sweep(points: DataFrame, neighbours: DataFrame, key: str, degrees=BLOCK_DEGREES,
                split=(0.8, 0.1, 0.1), seed: int = 1337) -> DataFrame:
    """Per candidate block size: blocks, items per block, realised split, cross-split neighbours.

    Points are counted per (size, block) first; the rest works on blocks. ``neighbours`` is
    the (id, neighbor) table of :func:`knn`, found once for all sizes.
    """
    options = F.array(*[F.lit(float(d)) for d in degrees])
    blocks = materialize(
        points.select("lon", "lat", F.explode(options).alias("block_deg"))
        .groupBy("block_deg", geo.block_id("lon", "lat", F.col("block_deg")).alias("block"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", H.split_bucket("block", split, seed)), "blocks")
    share = {b: (100 * F.try_divide(F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)), F.sum("n"))).alias(f"{b}_pct")
             for b in ("train", "val", "test")}
    sizes = blocks.groupBy("block_deg").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.min("n").alias("min_items"), F.max("n").alias("max_items"), *share.values())
    median = quantile_columns(blocks, "n", {"median_items": 0.5}, ["block_deg"])
    # the buckets of a point for all sizes travel as one short array
    buckets = F.array(*[H.split_bucket(geo.block_id("lon", "lat", F.lit(float(d))), split, seed) for d in degrees])
    placed = materialize(points.select(F.col(key).alias("id"), buckets.alias("_x")), "point-buckets")
    ends = neighbours.select("id", "neighbor").join(placed, "id").join(placed.select(F.col("id").alias("neighbor"), F.col("_x").alias("_y")), "neighbor")
    apart = [F.avg((F.col("_x")[j] != F.col("_y")[j]).cast("int")).alias(f"_{j}") for j in range(len(degrees))]
    shares = ends.groupBy("id").agg(*apart).agg(*[F.avg(f"_{j}").alias(f"_{j}") for j in range(len(degrees))])
    cross = shares.select(F.inline(F.array(*[F.struct(F.lit(float(d)).alias("block_deg"), F.col(f"_{j}").alias("cross_split_fraction")) for j, d in enumerate(degrees)])))
    mean_lat = points.agg(F.avg("lat").alias("_lat"))
    chance = sum(s * s for s in split)
    return attach_params(sizes.join(median, "block_deg").join(cross, "block_deg"), mean_lat).select(
        "block_deg", geo.cell_km("block_deg", "_lat").alias("cell_km"), "n_blocks", "min_items", "median_items", "max_items",
        "train_pct", "val_pct", "test_pct", "cross_split_fraction", F.lit(chance).alias("chance_agreement"))


#: Constants of a 64-bit mixer, fixed values.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_ROUNDS = 6


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: int, perm: np.ndarray, seed: int, inverse: bool = False) -> np.ndarray:
    """Where permutation ``perm`` of 0..n-1 takes each ``x`` (arrays of one shape): a Feistel network on pairs of digits to
    the base of the root of n, walked on while it leaves the range. Nothing but the numbers themselves is needed."""
    base = max(2, math.isqrt(max(0, n - 1)) + 1)
    key = _scrambled(perm.astype(np.uint64) * np.uint64(MIX[0]) + np.uint64(seed))

    def once(x, key):
        left, right = x // base, x % base
        for r in range(_ROUNDS - 1, -1, -1) if inverse else range(_ROUNDS):
            half = left if inverse else right
            add = (_scrambled(half.astype(np.uint64) + key * np.uint64(2 * r + 1)) % np.uint64(base)).astype(np.int64)
            left, right = ((right - add) % base, left) if inverse else (right, (left + add) % base)
        return left * base + right

    with np.errstate(over="ignore"):
        out = once(x, key)
        while (far := out >= n).any():
            out[far] = once(out[far], key[far])
    return out


#: Values of one chunk; values that a group looks up at most (points times permutations); groups that small inputs get, too.
CHUNK, LOOKUPS, GROUPS = 1024, 1 << 24, 64


def morans_i(points: DataFrame, neighbours: DataFrame, key: str, value: str, n_perms: int = 999, seed: int = 0, leaf: int = LEAF) -> DataFrame:
    """Moran's I of points with row-standardised neighbour weights, and its permutation p-value.

    ``neighbours`` holds (id, neighbor), such as of ``knn_all``; a point's known neighbours share a weight of one. Values are
    permuted over the points. Which point's value stands where in a permutation is computed, not sent: points near each other
    are one group, which holds what it looks up for all permutations while the chunks of values pass by. So the plain values
    move once a group, never once a permutation; a group's size depends on the permutations alone. Points without value or
    place take no part."""
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon") & F.col(value).isNotNull()
    known = materialize(points.filter(there).select(F.col(key).cast("long").alias("id"), "lat", "lon", F.col(value).cast("double").alias("v")), "moran-points")
    total = known.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")).first()
    n, groups = total.n, max(1, -(-total.n // leaf))

    def coded(frames):
        for f in frames:
            f["code"] = _order_code(_on_sphere(f["lat"].to_numpy(), f["lon"].to_numpy()))
            yield f

    def placed(frames):
        frames = [f for f in frames if len(f)]
        if frames:
            whole = pd.concat(frames, ignore_index=True).sort_values(["code", "lat", "lon", "id"])
            yield pd.DataFrame({"id": whole["id"], "v": whole["v"], "part": TaskContext.get().partitionId(), "pos": np.arange(len(whole))})

    curve = known.mapInPandas(coded, "id long, lat double, lon double, v double, code long").repartitionByRange(groups, "code", "lat", "lon", "id")
    parts = materialize(curve.mapInPandas(placed, "id long, v double, part int, pos long"), "moran-parts")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("k"))  # one row a group
    before = sizes.select("part", (F.sum("k").over(W.orderBy("part")) - F.col("k")).alias("_before"))
    items = materialize(parts.join(before, "part").select("id", "part", (F.col("_before") + F.col("pos")).alias("idx"), (F.col("v") - (total.m or 0.0)).alias("z")), "moran-items")
    size = max(1, min(LOOKUPS // (n_perms + 1), max(256, -(-n // GROUPS))))
    n_groups = max(1, -(-n // size))
    ends = neighbours.select(F.col("id").cast("long").alias("id"), F.col("neighbor").cast("long").alias("_n")).filter("id <> _n").distinct()
    edges = ends.join(items.select("id", "idx"), "id").join(items.select(F.col("id").alias("_n"), F.col("idx").alias("to")), "_n").select(
        F.floor(F.col("idx") / size).alias("group"), F.lit(-1).cast("long").alias("chunk"), "idx", "to", F.lit(None).cast("array<double>").alias("zs"))
    chunks = items.groupBy(F.floor(F.col("idx") / CHUNK).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "z"))), lambda x: x["z"]).alias("zs"))
    sent = chunks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("group"), "chunk",
                         F.lit(None).cast("long").alias("idx"), F.lit(None).cast("long").alias("to"), "zs")
    met = edges.union(sent).repartition(n_groups, "group").sortWithinPartitions("group", "chunk")
    sums = met.mapInArrow(_lagged(n, n_perms, seed), "n_linked long, s array<double>")
    stat = sums.select("n_linked", F.posexplode("s").alias("perm", "s")).groupBy("perm").agg(F.sum("s").alias("s"), F.sum("n_linked").alias("k"))
    spread = items.agg(F.sum(F.col("z") * F.col("z")).alias("_zz"))
    scored = attach_params(stat, spread).withColumn("i", F.try_divide(F.lit(n) * F.col("s"), F.col("k") * F.col("_zz")))
    return summarize_null(scored, "i").withColumn("n_units", F.lit(n).cast("long")).withColumnRenamed("observed", "morans_i")


class _Group:
    """The edges of a group of points, and the values that these look up in all permutations."""

    def __init__(self, n: int, n_perms: int, seed: int, at: np.ndarray, to: np.ndarray):
        order = np.lexsort((to, at))
        nodes, (at, to) = np.unique(np.concatenate([at, to])), (at[order], to[order])
        self.own, self.first, self.counts = np.unique(np.searchsorted(nodes, at), return_index=True, return_counts=True)
        self.to = np.searchsorted(nodes, to)
        source = np.empty((len(nodes), n_perms + 1), dtype=np.int32 if n < 1 << 31 else np.int64)
        source[:, 0] = nodes
        for lo in range(0, len(nodes), 512):
            part = nodes[lo : lo + 512]
            x, p = np.repeat(part, n_perms), np.tile(np.arange(1, n_perms + 1), len(part))
            source[lo : lo + 512, 1:] = permuted(x, n, p, seed).reshape(len(part), n_perms)
        flat = source.reshape(-1)
        self.order = np.argsort(flat)
        self.source = flat[self.order]
        self.values = np.zeros(source.shape)

    def take(self, chunk: int, zs: np.ndarray) -> None:
        """Values from the place where ``chunk`` begins."""
        low = chunk * CHUNK
        u, v = np.searchsorted(self.source, np.array([low, low + len(zs)], dtype=self.source.dtype))
        self.values.reshape(-1)[self.order[u:v]] = zs[self.source[u:v] - low]

    def sums(self) -> np.ndarray:
        """Per permutation the sum over the points of value times the mean of the neighbours' values."""
        total = np.zeros(self.values.shape[1])
        for lo in range(0, len(self.own), 256):
            hi = min(len(self.own), lo + 256)
            end = self.first[hi] if hi < len(self.own) else len(self.to)
            lags = np.add.reduceat(self.values[self.to[self.first[lo] : end]], self.first[lo:hi] - self.first[lo], axis=0) / self.counts[lo:hi, None]
            total += (self.values[self.own[lo:hi]] * lags).sum(axis=0)
        return total


def _lagged(n: int, n_perms: int, seed: int):
    """Streams of (group, chunk): a group's edges come first, under chunk -1, then the chunks of all values in order."""
    def lag(batches):
        key, at, to, group = None, [], [], None

        def done():
            if group is not None:
                yield pa.RecordBatch.from_pydict({"n_linked": pa.array([len(group.own)], pa.int64()), "s": pa.array([group.sums()], pa.list_(pa.float64()))})

        for batch in batches:
            keys, chunk = batch.column("group").to_numpy(), batch.column("chunk").to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[lo] != key:
                    yield from done()
                    key, at, to, group = keys[lo], [], [], None
                split = lo + int(np.searchsorted(chunk[lo:hi], 0))
                at.append(batch.column("idx").slice(lo, split - lo).to_numpy(zero_copy_only=False))
                to.append(batch.column("to").slice(lo, split - lo).to_numpy(zero_copy_only=False))
                if split == hi:
                    continue
                if group is None:
                    if not sum(map(len, at)):
                        continue  # nobody here has a neighbour
                    group = _Group(n, n_perms, seed, np.concatenate(at).astype(np.int64), np.concatenate(to).astype(np.int64))
                # chunks are full but for the last, so those of a batch follow each other
                group.take(int(chunk[split]), batch.column("zs").slice(split, hi - split).flatten().to_numpy())
        yield from done()

    return lag
