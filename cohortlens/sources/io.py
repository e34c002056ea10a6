"""Sources and sinks: raw CSV scan, row-count audit, feature table files,
published predictions (text-encoded store and its safe read-back), key
splitting and a data inventory.

All writes are distributed ``DataFrameWriter`` calls (each task writes its
own partition files); nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.expressions import float_text
from cohortlens.operators.scoring import row_key
from cohortlens.sources import snapshots
from cohortlens.sources.schemas import ENROLLMENT_KEYS, RAW_FILE_NAMES, SCHEMAS

DEFAULT_RUN_ID = "00000000_000000"

# Evaluation rows: the two JSON documents and the number columns.
IMPORTANCE_TYPE = T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("score", T.DoubleType())]))
COMBO_TYPE = T.StructType(
    [
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("cv_auc", T.DoubleType()),
        T.StructField("is_best", T.BooleanType()),
    ]
)
TUNING_TYPE = T.StructType(
    [
        T.StructField("combos", T.ArrayType(COMBO_TYPE)),
        T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("best_auc", T.DoubleType()),
        T.StructField("num_folds", T.IntegerType()),
    ]
)
MODEL_NUMBERS = ["auc", "accuracy", "precision", "recall", "f1", "recall_dropout", "cv_auc", "composite_score", "training_time"]


# ── input parallelism ──────────────────────────────────────────────────────


def spread_input(df: DataFrame, *keys: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-spread a scan that yields fewer partitions than the cluster runs.

    A large table stored as one unsplittable unit (a single Parquet row
    group, a gzip file) is read by one task, and everything fused with the
    scan (joins, partial aggregation) runs there too.  Such an input is
    hash-partitioned on ``keys`` (its join key) over the default
    parallelism.  A table read from many splits, as at cluster scale, is
    returned untouched: no extra shuffle.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


# ── raw CSV (A1) and audit (A2) ────────────────────────────────────────────


def read_raw_csv(spark: SparkSession, base_path: str, names: Mapping[str, str] = RAW_FILE_NAMES) -> dict[str, DataFrame]:
    """Read the seven raw CSV files with declared schemas (no inference pass)."""
    base = base_path.rstrip("/")
    return {
        table: spark.read.schema(SCHEMAS[table]).option("header", True).csv(f"{base}/{file_name}")
        for table, file_name in names.items()
    }


def write_raw_csv(tables: Mapping[str, DataFrame], base_path: str, names: Mapping[str, str] = RAW_FILE_NAMES) -> None:
    """Write raw tables as header CSV folders, columns in schema order."""
    base = base_path.rstrip("/")
    for table, df in tables.items():
        cols = [f.name for f in SCHEMAS[table].fields if f.name in df.columns]
        df.select(*cols).write.mode("overwrite").option("header", True).csv(f"{base}/{names[table]}")


def source_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, rows)`` for every source, computed in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ── feature table files (A3, A4) ───────────────────────────────────────────


def write_table(
    df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", partition_by: list[str] | None = None
) -> None:
    """Distributed write; optionally partitioned (e.g. by module) for pruning."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


# ── published predictions (A5, A7, A8) ─────────────────────────────────────

# Columns of the prediction store, grouped as in the source's
# two column families, and read-back defaults for unparsable numbers.
INFO_TEXT = ["code_module", "code_presentation", "gender", "region", "highest_education", "imd_band", "age_band",
             "disability", "final_result"]
INFO_FLOAT = ["clicks", "engagement_ratio", "forum_clicks", "quiz_clicks", "resource_clicks", "score",
              "weighted_score", "submission_rate", "avg_days_early", "exam_score", "tma_score", "cma_score",
              "days_before_start"]
INFO_INT = ["active_days", "active_weeks", "withdrew_early", "num_prev_attempts", "imd_band_encoded",
            "disability_encoded", "studied_credits"]
INT_DEFAULTS = {"imd_band_encoded": -1, "disability_encoded": -1}


def prediction_rows(scored: DataFrame) -> DataFrame:
    """Rows of the prediction store: key ``id|module|presentation``, every
    value as text (as the key-value store keeps them) and the tier."""
    return scored.select(
        row_key(*ENROLLMENT_KEYS).alias("row_key"),
        *[F.col(c).cast("string").alias(f"info_{c}") for c in INFO_TEXT],
        *[float_text(F.col(c)).alias(f"info_{c}") for c in INFO_FLOAT],
        *[F.col(c).cast("string").alias(f"info_{c}") for c in INFO_INT],
        F.col("risk").cast("string").alias("prediction_risk_tier"),
    )


def publish_predictions(scored: DataFrame, path: str) -> None:
    """Full reload of the store: one distributed write of a new version, then the switch (no driver batches).

    Readers see the version before until the new one is whole.
    """
    snapshots.publish(prediction_rows(scored), path)


def published_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the store's current version; a reload does not change a frame that is being read."""
    return snapshots.read(spark, path)


def safe_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def safe_int(text: Column, default: int = 0) -> Column:
    """Parse as a number, then truncate toward zero; default if unparsable, NaN or beyond an int."""
    value = text.try_cast("double")
    number = F.when(~F.isnan(value), value).try_cast("long").try_cast("int")
    return F.coalesce(number, F.lit(int(default)))


def infinite(text: Column) -> Column:
    """The text is an infinite number, which has no whole-number form: its row is skipped."""
    return F.coalesce(F.abs(text.try_cast("double")) == float("inf"), F.lit(False))


def predictions_readback(store: DataFrame) -> DataFrame:
    """Typed frame from store rows: unparsable numbers take their defaults,
    missing text becomes ``""`` and the student id is the key's first part.
    Rows with an infinite whole-number field are skipped."""
    whole = [F.col(f"info_{c}") for c in INFO_INT] + [F.col("prediction_risk_tier")]
    store = store.filter(~reduce(lambda a, b: a | b, map(infinite, whole)))
    tier = safe_int(F.col("prediction_risk_tier"))
    labels = F.when(tier == 0, "Safe").when(tier == 1, "Watch").when(tier == 2, "High Risk").when(tier == 3, "Critical")
    return store.select(
        F.split_part(F.col("row_key"), F.lit("|"), F.lit(1)).alias("id"),
        *[F.coalesce(F.col(f"info_{c}"), F.lit("")).alias(c) for c in INFO_TEXT],
        *[safe_double(F.col(f"info_{c}")).alias(c) for c in INFO_FLOAT],
        *[safe_int(F.col(f"info_{c}"), INT_DEFAULTS.get(c, 0)).alias(c) for c in INFO_INT],
        tier.alias("risk"),
        labels.otherwise(F.lit("Unknown")).alias("risk_label"),
    )


def split_row_key(keys: DataFrame, key_col: str = "row_key") -> DataFrame:
    """Student id (first part) and the other parts of ``id|module|presentation``."""
    k = F.col(key_col)
    return keys.select(
        k.alias(key_col),
        F.split_part(k, F.lit("|"), F.lit(1)).alias("id"),
        F.split_part(k, F.lit("|"), F.lit(2)).alias("module_part"),
        F.split_part(k, F.lit("|"), F.lit(-1)).alias("last_part"),
    )


def split_model_key(keys: DataFrame, key_col: str = "model_key", keep_others: bool = False) -> DataFrame:
    """``name|run`` -> display name (underscores to spaces) and run id.

    The run id is the text after the last ``|``; a key without ``|`` gets the
    default run id.
    """
    k = F.col(key_col)
    has_run = F.instr(k, "|") > 0
    name = F.when(has_run, F.regexp_extract(k, r"^(.*)\|[^|]*$", 1)).otherwise(k)
    run = F.when(has_run, F.substring_index(k, "|", -1)).otherwise(F.lit(DEFAULT_RUN_ID))
    others = [c for c in keys.columns if c != key_col] if keep_others else []
    return keys.select(k.alias(key_col), F.regexp_replace(name, "_", " ").alias("name"), run.alias("run_id"), *others)


def model_rows_readback(stored: DataFrame) -> DataFrame:
    """Typed evaluation rows from stored text rows (``evaluation_text_rows``).

    The key gives name and run; unparsable numbers are 0, the flag is true for
    the text ``true`` only, and missing or malformed documents are empty.
    """
    keys = split_model_key(stored.select(F.col("row_key").alias("model_key"), *[c for c in stored.columns if c != "row_key"]), keep_others=True)
    importance = F.from_json("importance_json", IMPORTANCE_TYPE)
    tuning = F.from_json("tuning_json", TUNING_TYPE)
    return keys.select(
        "name",
        "run_id",
        *[safe_double(F.col(c)).alias(c) for c in MODEL_NUMBERS],
        F.coalesce(F.lower("is_best") == "true", F.lit(False)).alias("is_best"),
        F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        F.coalesce(importance, F.array().cast(IMPORTANCE_TYPE)).alias("importance"),
        tuning.alias("tuning"),
    )


# ── data inventory (A12) ───────────────────────────────────────────────────


def data_inventory(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """``(dataset, files, rows)``: distinct input files and rows per dataset."""
    parts = [
        spark.read.format(fmt)
        .load(path)
        .select(F.col("_metadata.file_path").alias("file"))
        .agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("rows"))
        .select(F.lit(name).alias("dataset"), "files", "rows")
        for name, path in paths.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
