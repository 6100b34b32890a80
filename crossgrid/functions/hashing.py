"""Deterministic hash draws: splits, permutations, bootstrap indices, normal values.

All come from md5 or sha256 of a text key, so that any engine gives the same values and a
lost task is recomputed to the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _s(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def hash_order(*parts) -> Column:
    """Hex text whose order is a pseudo-random order of the keyed rows."""
    return F.md5(F.concat_ws(":", *[_s(p) for p in parts]))


def hash_int(*parts) -> Column:
    """Non-negative 60-bit integer."""
    return F.conv(F.substring(hash_order(*parts), 1, 15), 16, 10).cast("long")


def hash_unit(*parts) -> Column:
    """Uniform value in [0, 1) with 32 bits."""
    return F.conv(F.substring(hash_order(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_normal(*parts) -> Column:
    """Standard normal value by the Box-Muller transform of two uniform draws."""
    u = (hash_unit(F.lit("u"), *parts) * 4294967296.0 + 1) / 4294967297.0
    v = hash_unit(F.lit("v"), *parts)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def stable_unit_interval(key, seed: int = 1337) -> Column:
    """First 64 bits of sha256("seed:key") as a share of 2^64."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), _s(key)), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def split_bucket(key, split=(0.8, 0.1, 0.1), seed: int = 1337) -> Column:
    """train / val / test by the stable hash of the key; other rows never change it."""
    u = stable_unit_interval(key, seed)
    return (
        F.when(u < split[0], "train").when(u < split[0] + split[1], "val").otherwise("test")
    )
