"""Exact linear-interpolated quantiles without gathering a group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here equal
values are counted first (so a hot value is one row) and written, a histogram over [min, max]
finds the bin that holds each wanted rank, and only the values of those bins are sorted. Bins
are refined until the ones that are sorted are small, so values may crowd into any part of
their range. Every step uses exact counts and exact minima and maxima, so the result does not
depend on task order. The data are read once, when this is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from crossgrid.session import materialize

_WINDOW = ["_lo", "_hi", "_below"]
#: Distinct values that one task may have to sort.
SMALL_BIN = 200_000


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
    bins: int = 65536, levels: int = 1, exclusive: bool = False,
) -> DataFrame:
    """Rows (by..., prob, value): ``percentile(value, prob)`` per group, NULLs ignored.

    Bins are refined ``levels`` times at least, and until they are small.
    ``exclusive`` takes positions p * (n + 1) instead, within the first and the last value."""
    keys = list(by or [])
    group = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    counts = materialize(
        base.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*group, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c")), "value-counts"
    )
    limits = counts.groupBy(*group).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n")
    )
    pos = F.col("_p") * (F.col("_n") - 1)
    if exclusive:
        pos = F.least(F.greatest(F.col("_p") * (F.col("_n") + 1) - 1, F.lit(0.0)), F.col("_n") - 1.0)
    targets = (
        limits.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_frac", pos - F.floor(pos))
        .withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))))
        .withColumn("_below", F.lit(0).cast("long"))
        .select(*group, "_p", "_frac", "_k", *_WINDOW,
                (F.col("_k") == F.floor(pos)).alias("_is_low"))
    )

    def small(side: DataFrame) -> DataFrame:
        # without groups there are at most 2 * len(probs) targets
        return side if keys else F.broadcast(side)

    def spans(t: DataFrame) -> DataFrame:
        open_spans = t.filter(F.col("_lo") < F.col("_hi")).select(*group, *_WINDOW).distinct()
        return counts.join(small(open_spans), group).filter(
            (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        )

    level = 0
    while True:
        level += 1
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        hist = (
            spans(targets).withColumn("_bin", F.floor(share * bins))
            .groupBy(*group, *_WINDOW, "_bin")
            .agg(F.sum("_c").alias("_m"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"), F.count(F.lit(1)).alias("_rows"))
        )
        before = W.partitionBy(*group, *_WINDOW).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
        hist = hist.withColumn(
            "_start", F.col("_below") + F.coalesce(F.sum("_m").over(before), F.lit(0))
        ).select(*group, *_WINDOW, "_start", "_m", "_blo", "_bhi", "_rows")
        narrowed = targets.join(hist, [*group, *_WINDOW], "left").filter(
            F.col("_start").isNull()
            | ((F.col("_k") >= F.col("_start")) & (F.col("_k") < F.col("_start") + F.col("_m")))
        )
        targets = narrowed.select(
            *group, "_p", "_frac", "_k", "_is_low",
            F.coalesce("_blo", "_lo").alias("_lo"), F.coalesce("_bhi", "_hi").alias("_hi"),
            F.coalesce("_start", "_below").alias("_below"), "_rows",
        )
        targets = materialize(targets, "quantile-bins")  # groups x probabilities
        if level >= levels and (targets.filter("_lo < _hi").agg(F.max("_rows")).first()[0] or 0) <= SMALL_BIN:
            targets = targets.drop("_rows")
            break
        targets = targets.drop("_rows")

    run = W.partitionBy(*group, *_WINDOW).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        spans(targets)
        .withColumn("_start", F.col("_below") + F.coalesce(F.sum("_c").over(run), F.lit(0)))
        .select(*group, *_WINDOW, "_v", "_start", "_c")
    )
    found = targets.join(ranked, [*group, *_WINDOW], "left").filter(
        F.col("_v").isNull()
        | ((F.col("_k") >= F.col("_start")) & (F.col("_k") < F.col("_start") + F.col("_c")))
    ).withColumn("_x", F.coalesce("_v", "_lo"))
    low = F.max(F.when(F.col("_is_low"), F.col("_x")))
    high = F.max(F.when(~F.col("_is_low"), F.col("_x")))
    return found.groupBy(*keys, F.col("_p").alias("prob")).agg(
        (low + F.coalesce(high - low, F.lit(0.0)) * F.max("_frac")).alias("value")
    )


def quantile_columns(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None, **kw
) -> DataFrame:
    """One row per group with a named column per quantile."""
    keys = list(by or [])
    long = exact_quantiles(df, value, list(probs.values()), keys, **kw)
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(name)
        for name, p in probs.items()
    ])


QUINTILE_LABELS = ("Poorest", "Poor", "Middle", "Rich", "Richest")


def quintile_label(score, p20, p40, p60, p80, labels=QUINTILE_LABELS):
    """Right-closed bins between the quintile edges; NULL scores stay NULL."""
    c = F.col(score) if isinstance(score, str) else score
    return (
        F.when(c.isNull(), F.lit(None))
        .when(c <= F.col(p20), labels[0]).when(c <= F.col(p40), labels[1])
        .when(c <= F.col(p60), labels[2]).when(c <= F.col(p80), labels[3])
        .otherwise(labels[4])
    )
