"""Sinks: per-target tables, organised layouts, wide matrices, resumable appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from crossgrid.functions.ids import safe_double

# The label targets.
LABEL_TARGETS = (
    "wealth_index", "wealth_index_sat", "wealth_index_housing_core", "wealth_index_transport",
    "wealth_index_financial", "wealth_index_utilities", "gas_heat_pct", "log_home_value",
    "single_family_pct", "rent_burdened_30plus_pct", "owner_burdened_30plus_pct", "solar_heat_pct",
)


def label_rows(df: DataFrame, key: str, targets: list[str]) -> DataFrame:
    """Long (key, target, value) of the numeric values; anything else is left out."""
    as_text = df.select(key, *[F.col(c).cast("string").alias(c) for c in targets])
    long = as_text.unpivot([key], targets, "target", "raw")
    return long.select(key, "target", safe_double("raw").alias("value"))


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("target").agg(
        F.count("value").alias("n_written"),
        F.count_if(F.col("value").isNull()).alias("n_dropped"),
    )


def write_label_targets(labels: DataFrame, path: str) -> None:
    labels.filter("value is not null").write.partitionBy("target").parquet(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """Collect prediction files of any origin into one partitioned layout."""
    preds.write.partitionBy("state", "model_year", "model_quarter").parquet(path)


def write_prediction_files(preds: DataFrame, path: str) -> None:
    """One folder of CSV for each model, evaluation cell, epoch and variable, named as ``read_predictions`` expects."""
    file = F.format_string("epoch%d_valset_%s_%d_q%d_s2_allbands_%s_preds.csv", "epoch", "state", "eval_year", "eval_quarter", "variable")
    rows = preds.select(
        F.lit(None).cast("string").alias("row_index"), "name", "pred", "label", F.lit(None).cast("string").alias("extra"),
        F.col("state").alias("state_"), F.format_string("q%d_%d", "model_quarter", "model_year").alias("model_"), file.alias("file_"))
    rows.repartition("state_", "model_", "file_").write.partitionBy("state_", "model_", "file_").option("header", True).csv(path)


def write_matrix(wide: DataFrame, path: str) -> None:
    """A wide matrix has one row per model period, so one CSV file is enough."""
    wide.coalesce(1).write.option("header", True).csv(path)


def write_class_maps(counts: DataFrame, key: str, path: str) -> None:
    class_maps(counts, key).write.json(path)


def class_maps(counts: DataFrame, key: str) -> DataFrame:
    """Per key a map class -> count; the classes per key are a fixed code list."""
    entries = F.array_sort(F.collect_list(F.struct("class", "n")))
    return counts.groupBy(key).agg(F.map_from_entries(entries).alias("counts"))


def todo_keys(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Keys that a resumed run still has to compute."""
    return wanted.join(done.select(*key), key, "left_anti")


def append_missing(spark: SparkSession, fresh: DataFrame, path: str, key: list[str]) -> None:
    """Append only the rows whose key the table does not hold yet, one row for each key.

    All keys of the table are read; ``keyed_table`` has an index for many batches."""
    rows = fresh.dropDuplicates(key)
    try:
        done = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as e:  # first run: the table does not exist
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows.write.parquet(path)
        return
    rows.join(done.select(*key), key, "left_anti").write.mode("append").parquet(path)


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Per-state parts as one table; a column missing from a part is NULL there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
