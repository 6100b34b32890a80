"""Structured Streaming variants for results that are still arriving.

Every job runs to the end of what is there (``availableNow``), keeps its progress in the
shared folder, and writes per-batch output under the batch id with ``overwrite``, so a batch
that is replayed after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crossgrid.sources.keyed_table import KeyedTable


#: Key buckets of a table that is appended to.
BUCKETS = 64


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files of one table as a stream, with the table's own schema.

    ``path`` is a folder or a glob. Event times must be instants, so zoneless timestamps are
    read as such in the session's time zone.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(path)
    zoneless = [c for c, kind in stream.dtypes if kind == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def run_batches(stream: DataFrame, work_dir: str, per_batch, mode: str = "append") -> None:
    """Run ``per_batch(df, batch_id)`` over all available input."""
    (
        stream.writeStream.outputMode(mode).foreachBatch(per_batch)
        .option("checkpointLocation", f"{work_dir}/progress")
        .trigger(availableNow=True).start().awaitTermination()
    )


def partial_moments(df: DataFrame, keys: list[str], label: str, pred: str) -> DataFrame:
    """Centred moments of one batch: they merge exactly with those of other batches."""
    err = F.col(label) - F.col(pred)
    both = df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull())
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("my"), F.avg(pred).alias("mp"),
        (F.count(F.lit(1)) * F.var_pop(label)).alias("syy"), (F.count(F.lit(1)) * F.var_pop(pred)).alias("spp"),
        (F.count(F.lit(1)) * F.covar_pop(label, pred)).alias("syp"),
        F.sum(err * err).alias("sse"), F.sum(F.abs(err)).alias("sae"))


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy from the partial moments of all batches (batches x cells rows)."""
    totals = parts.groupBy(*keys).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("_my"),
        (F.sum(F.col("n") * F.col("mp")) / F.sum("n")).alias("_mp"))
    dy, dp = F.col("my") - F.col("_my"), F.col("mp") - F.col("_mp")
    merged = parts.join(totals, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("syy") + F.col("n") * dy * dy).alias("syy"),
        F.sum(F.col("spp") + F.col("n") * dp * dp).alias("spp"), F.sum(F.col("syp") + F.col("n") * dy * dp).alias("syp"),
        F.sum("sse").alias("sse"), F.sum("sae").alias("sae"),
        (F.max("_mp") - F.max("_my")).alias("bias"))
    return merged.select(
        *keys, "n", (1 - F.try_divide("sse", "syy")).alias("r2"),
        F.try_divide(F.col("syp"), F.sqrt("syy") * F.sqrt("spp")).alias("pearson_r"), "bias",
        (F.col("sae") / F.col("n")).alias("mae"))


def stream_accuracy(stream: DataFrame, keys: list[str], label: str, pred: str, work_dir: str) -> DataFrame:
    """Continuously updated accuracy: each batch adds one small table of moments."""
    out = f"{work_dir}/moments"

    def add(batch: DataFrame, batch_id: int) -> None:
        partial_moments(batch, keys, label, pred).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(stream, work_dir, add)
    return merge_moments(stream.sparkSession.read.parquet(out), keys)


def stream_append_once(stream: DataFrame, key: list[str], work_dir: str, table: str) -> DataFrame:
    """Append rows whose key is new, however late they come: repeats in a batch, in the table and in replays change nothing."""
    def add(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, table, key, BUCKETS).append(batch)

    run_batches(stream, work_dir, add)
    rows = KeyedTable(stream.sparkSession, table, key, BUCKETS).read()
    return stream.sparkSession.createDataFrame([], stream.schema) if rows is None else rows
