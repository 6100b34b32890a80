"""Event-time windows and sessions with a watermark: bounded state, and late rows that are kept and counted.

A job runs over what has arrived, in two steps. The router reads the rows. It knows the latest event time of all earlier
batches; less the allowed delay, that is the watermark. What belongs to something closed by then goes to the table of late
rows, all else is summed per batch. The second step holds open windows or sessions in Spark's state store and adds the sums
of new batches; its own watermark, on the sums, closes them and never runs ahead of the router's, so that it drops nothing.
Both steps keep their progress in ``work_dir`` and write per batch with overwrite: a job that is run again, after more input
or after a failure, goes on where it stopped, and the second step only starts from batches that the router has finished.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossgrid.session import attach_params
from crossgrid.streaming.jobs import run_batches


@dataclass
class EventTimeResult:
    """``rows``: windows or sessions, open ones too. ``late``: what came after its window or session was closed, and rows
    without an event time or key.

    ``state_rows``: groups in the state store after the run (None, if there was nothing to do); of sessions, buckets of keys. ``last``: one row with the
    latest event time."""

    rows: DataFrame
    late: DataFrame
    state_rows: int | None
    last: DataFrame


@contextmanager
def _partitions(spark: SparkSession, n: int | None):
    """The number of state partitions is that of shuffles when a job first starts."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        if n:
            spark.conf.set("spark.sql.shuffle.partitions", n)
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def route(stream: DataFrame, time: str, delay: str, work_dir: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> None:
    """Run ``split(batch)`` over new batches and write what it returns, (sums, late rows).

    The batch has a further column ``_watermark``: the latest event time of earlier batches less ``delay``, null at first."""

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = batch.agg(F.max(time).alias("last"))
        if batch_id:  # the mark of the batch before covers all earlier ones
            marks = spark.read.parquet(f"{work_dir}/marks/batch={batch_id - 1}")
            seen = seen.union(marks.select("last")).agg(F.max("last").alias("last"))
            batch = attach_params(batch, marks.select((F.col("last") - F.expr(f"INTERVAL {delay}")).alias("_watermark")))
        else:
            batch = batch.withColumn("_watermark", F.lit(None).cast("timestamp"))
        sums, late = split(batch)
        sums.write.mode("overwrite").parquet(f"{work_dir}/sums/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{work_dir}/late/batch={batch_id}")
        seen.write.mode("overwrite").parquet(f"{work_dir}/marks/batch={batch_id}")

    run_batches(stream, f"{work_dir}/router", one)


def _fold(sums: DataFrame, state: Callable[[DataFrame], DataFrame], work_dir: str, partitions: int | None) -> int | None:
    """Add new sums to the state, write what it returns per batch, and count the groups it holds."""

    def add(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{work_dir}/changes/batch={batch_id}")

    with _partitions(sums.sparkSession, partitions):
        writer = state(sums).writeStream.outputMode("update").foreachBatch(add)
        query = writer.option("checkpointLocation", f"{work_dir}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    counts = [op for progress in query.recentProgress for op in progress.stateOperators]
    if dropped := sum(op.numRowsDroppedByWatermark for op in counts):
        raise RuntimeError(f"{dropped} sums came after their group was closed")
    return counts[-1].numRowsTotal if counts else None


def _written(spark: SparkSession, work_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{work_dir}/{name}")


def _sums_stream(spark: SparkSession, work_dir: str) -> DataFrame:
    written = _written(spark, work_dir, "sums")
    return spark.readStream.schema(written.schema).parquet(f"{work_dir}/sums")


def windows(
    stream: DataFrame, time: str, group: list[str], value: str, work_dir: str, width: str, slide: str | None = None, *, delay: str = "7 days",
    partitions: int | None = None,
) -> EventTimeResult:
    """Count and sum per event-time window and group, with rows (window_start, window_end, *group, n, total).

    A row that lies in several windows is late only for those that ended at or before the watermark. A window leaves the
    state once the latest event is ``delay`` and ``width`` later than its end."""
    spark = stream.sparkSession
    window = F.window(time, width, slide) if slide else F.window(time, width)

    def split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        placed = batch.filter(F.col(time).isNotNull()).withColumn("_window", window)
        ended = F.coalesce(F.col("_window.end") <= F.col("_watermark"), F.lit(False))
        place = [F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end")]
        sums = placed.filter(~ended).groupBy(*place, *group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        late = placed.filter(ended).select(*place, *group, F.col(time), F.col(value), F.col("_watermark").alias("watermark"))
        return sums, late.unionByName(batch.filter(F.col(time).isNull()).select(*group, time, value), allowMissingColumns=True)

    route(stream, time, delay, work_dir, split)
    keys = ["window_start", "window_end", *group]

    def state(sums: DataFrame) -> DataFrame:
        # ends are at most ``width`` after the latest event
        marked = sums.withWatermark("window_end", _total(spark, delay, width))
        return marked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    held = _fold(_sums_stream(spark, work_dir), state, work_dir, partitions)
    newest = _written(spark, work_dir, "changes").groupBy(*keys).agg(F.max_by(F.struct("n", "total"), "batch").alias("_x"))
    return EventTimeResult(newest.select(*keys, "_x.n", "_x.total"), _late(spark, work_dir), held, _last(spark, work_dir))


def _total(spark: SparkSession, *spans: str) -> str:
    """The sum of fixed-length intervals, as one."""
    seconds = " + ".join(f"(unix_micros(TIMESTAMP '2000-01-01' + INTERVAL {s}) - unix_micros(TIMESTAMP '2000-01-01'))" for s in spans)
    return f"{spark.sql(f'SELECT {seconds}').first()[0]} microseconds"


def _late(spark: SparkSession, work_dir: str) -> DataFrame:
    return _written(spark, work_dir, "late").drop("batch")


def _last(spark: SparkSession, work_dir: str) -> DataFrame:
    return _written(spark, work_dir, "marks").agg(F.max("last").alias("last"))


def _merged(key: np.ndarray, parts: pd.DataFrame) -> pd.DataFrame:
    """Sessions of each key, those that touch as one."""
    code = pd.factorize(key, use_na_sentinel=False)[0]
    order = np.lexsort((parts["b"].to_numpy(), parts["a"].to_numpy(), code))
    code, (a, b, n, total) = code[order], (parts[c].to_numpy()[order] for c in ("a", "b", "n", "total"))
    reach = pd.Series(b).groupby(code).cummax().to_numpy()
    fresh = np.ones(len(code), dtype=bool)
    fresh[1:] = (code[1:] != code[:-1]) | ~(a[1:] < reach[:-1])
    first, known = np.flatnonzero(fresh), ~np.isnan(total)
    sums = np.where(np.add.reduceat(known.astype(np.int64), first) > 0, np.add.reduceat(np.where(known, total, 0.0), first), np.nan)
    return pd.DataFrame({"key": key[order][first], "a": a[first], "b": np.maximum.reduceat(b, first), "n": np.add.reduceat(n, first), "total": sums})


#: Keys are dealt to so many groups of the state, fixed for its lifetime: a group is folded at once, whatever the number of keys.
BUCKETS = 1024
_OPEN = "a array<long>, b array<long>, n array<long>, total array<double>"


def sessions(
    stream: DataFrame, time: str, key: str, value: str, gap: str, work_dir: str, *, delay: str = "1 day", partitions: int | None = None,
) -> EventTimeResult:
    """Sessions per key, with rows (key, session_start, session_end, n, total, is_open).

    A row before the watermark is late. A session whose end the watermark has reached is closed: no later row that is in
    time touches it, so it leaves the state, by a timer where its bucket of keys has no more rows. ``is_open``: no event of any key is
    later than the session's end."""
    spark = stream.sparkSession

    def split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        lost = F.col(time).isNull() | F.col(key).isNull()
        early = lost | F.coalesce(F.col(time) < F.col("_watermark"), F.lit(False))
        span = batch.filter(~early).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        sums = span.select(key, F.unix_micros("s.start").alias("a"), F.unix_micros("s.end").alias("b"), "n", F.col("total").cast("double").alias("total"), F.col("s.end").alias("ended"))
        return sums, batch.filter(early).select(key, F.col(time), F.col(value), F.col("_watermark").alias("watermark"))

    route(stream, time, delay, work_dir, split)
    kind = dict(stream.dtypes)[key]
    cols = ["key", "a", "b", "n", "total"]

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parts = [f[cols] for f in frames] if not state.hasTimedOut else []
        if state.exists:
            parts.append(pd.DataFrame(dict(zip(cols, state.get, strict=True))))
        whole = pd.concat(parts, ignore_index=True)
        merged = _merged(whole["key"].to_numpy(), whole.astype({"total": "float64"}))
        mark = state.getCurrentWatermarkMs()
        open_ = merged["b"].to_numpy() > mark * 1000
        if open_.any():
            kept = merged[open_]
            state.update(tuple(kept[c].tolist() for c in cols))
            state.setTimeoutTimestamp(max(int(kept["b"].min()) // 1000 + 1, mark + 1))
        else:
            state.remove()
        yield merged.assign(bucket=group[0], held=open_)[["bucket", *cols, "held"]]

    def state(sums: DataFrame) -> DataFrame:
        marked = sums.withColumnRenamed(key, "key").withWatermark("ended", _total(spark, delay, gap))  # ends are ``gap`` after the latest event
        return marked.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).groupBy("bucket").applyInPandasWithState(
            fold, f"bucket int, key {kind}, a long, b long, n long, total double, held boolean", f"key array<{kind}>, {_OPEN}", "update", "EventTimeTimeout")

    held = _fold(_sums_stream(spark, work_dir), state, work_dir, partitions)
    changes = _written(spark, work_dir, "changes")
    newest = changes.groupBy("bucket").agg(F.max("batch").alias("_newest"))
    # a closed session is told once; of open ones, what a bucket told last
    now = changes.join(F.broadcast(newest), "bucket").filter(~F.col("held") | (F.col("batch") == F.col("_newest")))
    ended: Column = F.timestamp_micros("b")
    last = _last(spark, work_dir)
    out = attach_params(now, last).select(
        F.col("key").alias(key), F.timestamp_micros("a").alias("session_start"), ended.alias("session_end"), "n", "total", (ended > F.col("last")).alias("is_open"))
    return EventTimeResult(out, _late(spark, work_dir), held, last)
