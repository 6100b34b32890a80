"""Readers: schema-first CSV, prediction files with path fields, manifests, JSON maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from crossgrid.functions.ids import item_key, normalize_id, parse_pred_path, safe_double
from crossgrid.operators.ranking import first_per_key
from crossgrid.session import materialize

PRED_SCHEMA = "row_index STRING, name STRING, pred STRING, label STRING, extra STRING"

# The (train, eval) quarter cells a transfer-penalty manifest must hold.
REQUIRED_CELLS = ((1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (3, 3), (4, 4), (3, 1))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The DataFrame itself, or an error that names every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str, required: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).csv(path)
    return require_columns(df, required or [])


def plain_path(path: Column) -> Column:
    """A file's path without ``name=`` before partition values and without Spark's part file below a ``.csv`` folder."""
    return F.regexp_replace(F.regexp_replace(path, r"(?<=/)[a-z_]+=", ""), r"(\.csv)/part-[^/]*$", "$1")


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder or glob by their names alone: (file, path, n_bytes and the fields of a prediction path).

    Nothing is opened. Fields of a path that doesn't tell its cell are NULL."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))
    named = listed.select("file", plain_path(F.col("file")).alias("path"), "n_bytes")
    return named.select("*", *[c.alias(n) for n, c in parse_pred_path("path").items()])


#: What a prediction path tells besides its epoch.
PRED_CELL = ["state", "variable", "model_year", "model_quarter", "eval_year", "eval_quarter"]


def newest_files(index: DataFrame, wanted: DataFrame | None = None, cell: list[str] | None = None) -> DataFrame:
    """The files of the highest epoch of each cell, of those in ``wanted`` (rows that hold some of the cell's columns) if given.

    Two paths with one cell and epoch are both kept; ``single_match`` tells them."""
    cell = cell or PRED_CELL
    known = index.filter(F.col("epoch").isNotNull())
    if wanted is not None:
        known = known.join(wanted, [c for c in wanted.columns if c in cell], "left_semi")
    latest = known.groupBy(*cell).agg(F.max("epoch").alias("epoch"))
    # a field may be unknown, such as a file without a variable
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*cell, "epoch"]]
    return known.alias("k").join(latest.alias("n"), same, "left_semi")


def manifest_files(manifest: DataFrame, index: DataFrame, path: str = "preds_csv") -> tuple[DataFrame, DataFrame]:
    """The index rows of the files that a manifest names, and the manifest rows of which the index has no file."""
    held = index.select(F.col("path").alias(path)).distinct()
    return index.join(manifest.select(F.col(path).alias("path")).distinct(), "path", "left_semi"), manifest.join(held, path, "left_anti")


def unmatched_paths(spark: SparkSession, path: str) -> DataFrame:
    """Files below a glob whose path does not tell their cell: (path, n_rows). ``read_predictions`` leaves them out."""
    odd = file_index(spark, path).filter("epoch is null")
    return _prediction_files(spark, odd).groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))


def _prediction_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The rows of the files of an index; only these are scanned. Their names pass the driver, as in any listing."""
    names = [r.file for r in files.select("file").collect()]
    if not names:
        return spark.createDataFrame([], f"{PRED_SCHEMA}, path STRING")
    raw = spark.read.schema(PRED_SCHEMA).option("header", True).option("enforceSchema", True).csv(names)
    return raw.withColumn("path", plain_path(F.col("_metadata.file_path")))


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Prediction rows of the files of an index; periods come from each file's path."""
    return _prediction_files(spark, files.filter(F.col("epoch").isNotNull())).select(
        "path", *[c.alias(n) for n, c in parse_pred_path("path").items()],
        normalize_id(item_key("name")).alias("geoid"),
        safe_double("pred").alias("pred"), safe_double("label").alias("label"),
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All prediction files below a folder or glob. ``newest_files`` picks from the index before anything is read."""
    return read_files(spark, file_index(spark, path))


def read_quarantined(spark: SparkSession, path: str, schema: str, kind: str = "json", key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that can be read, quarantined rows (file, line, and the text that ``key``, a pattern with one group, finds in it)).

    ``kind``: json (a row a line) or csv (with a header). A row that doesn't parse to the schema is quarantined whole."""
    reader = spark.read.schema(f"{schema}, _broken STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    parsed = (reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)).withColumn("file", F.col("_metadata.file_path"))
    raw = materialize(parsed, "parsed")  # parsed once for both
    found = F.nullif(F.regexp_extract("_broken", key, 1), F.lit("")) if key else F.lit(None).cast("string")
    return raw.filter("_broken is null").drop("_broken"), raw.filter("_broken is not null").select("file", F.col("_broken").alias("line"), found.alias("key"))


def single_match(files: DataFrame, key: list[str], variable: str) -> tuple[DataFrame, DataFrame]:
    """Keys with exactly one file, and the ambiguous keys with the variables found."""
    found = files.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.array_sort(F.collect_set(variable)).alias("variables"),
    )
    unique = found.filter("n_files = 1").select(*key, F.col("variables")[0].alias(variable))
    return unique, found.filter("n_files > 1")


def required_cells(spark: SparkSession, years: list[int]) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.array(*[F.lit(y) for y in years])).alias("year"),
        F.array(*[
            F.struct(F.lit(a).alias("train_quarter"), F.lit(b).alias("eval_quarter"))
            for a, b in REQUIRED_CELLS
        ]).alias("_c"),
    ).select("year", F.explode("_c").alias("_c")).select("year", "_c.*")


def manifest_from_template(cells: DataFrame, template: str) -> DataFrame:
    """Manifest rows (year, train_quarter, eval_quarter, preds_csv).

    ``template`` is a printf pattern over year, train quarter and eval quarter, such as
    ``/preds/oh/q%2$d_%1$d/eval_q%3$d.csv``.
    """
    path = F.format_string(template, "year", "train_quarter", "eval_quarter")
    return cells.select("year", "train_quarter", "eval_quarter", path.alias("preds_csv"))


def missing_cells(required: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    return required.join(have.select(*key).distinct(), key, "left_anti")


def json_map_entries(df: DataFrame, column: str, value_type: str, key: str, value: str) -> DataFrame:
    """Rows of a JSON map column: ``map<string, value_type>`` exploded."""
    parsed = F.from_json(F.col(column), f"map<string,{value_type}>")
    return df.select(F.explode(parsed).alias(key, value))


def read_json_map(spark: SparkSession, path: str, value_type: str, key: str, value: str) -> DataFrame:
    """A file that holds one JSON map, as (key, value) rows."""
    return json_map_entries(spark.read.text(path, wholetext=True), "value", value_type, key, value)


def keyed_values(df: DataFrame, id_col: str, value_col: str, order: list[Column]) -> DataFrame:
    """Normalised id and numeric value; rows without either go, the first row per id stays."""
    clean = df.select(
        normalize_id(id_col).alias("id"), safe_double(value_col).alias("value"),
        F.struct(*order).alias("_order"),
    ).filter(F.col("id").isNotNull() & F.col("value").isNotNull())
    return first_per_key(clean, ["id"], [F.col("_order")]).drop("_order")


def missing_settings(settings: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Entities with required fields that are NULL, and the list of those fields."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return settings.select(key, missing.alias("missing")).filter(F.size("missing") > 0)
