"""Table readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from twinloom.functions.names import ref
from twinloom.operators.prep import Cohort, duplicate_keys, melt_features, normalise_key

_UNNAMED = re.compile(r"^_c\d+$")


def read_table(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None
) -> DataFrame:
    """Read a CSV (with header) or any Spark file format; header-less CSV columns are dropped."""
    if fmt != "csv":
        reader = spark.read.format(fmt)
        return (reader.schema(schema) if schema else reader).load(path)
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*[ref(c) for c in df.columns if c and not _UNNAMED.match(c)])


def load_cohort(
    spark: SparkSession,
    clinical_path: str,
    features_path: str,
    key: str,
    feature_key_scale: int | None = 1000,
    fmt: str = "csv",
    on_duplicate: str = "error",
    clinical_schema: T.StructType | None = None,
    features_schema: T.StructType | None = None,
) -> Cohort:
    """Load both tables, cast the clinical key and rescale the feature key.

    With schemas, CSV files are not scanned to infer types.
    """
    clinical = normalise_key(read_table(spark, clinical_path, fmt, clinical_schema), key)
    wide = normalise_key(read_table(spark, features_path, fmt, features_schema), key, feature_key_scale)
    if on_duplicate == "error" and not duplicate_keys(wide).isEmpty():
        raise ValueError("several feature rows share one key after rescaling")
    return Cohort(clinical, melt_features(wide), len(wide.columns) - 1)


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> None:
    """Write with overwrite; CSV gets a header."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_cohorts(
    clinical: dict[str, DataFrame], features: dict[str, DataFrame], path: str, fmt: str = "csv"
) -> None:
    """One folder per cohort and table; cohorts may differ in their clinical columns."""
    for name, df in clinical.items():
        write_table(df, f"{path}/{name}_clinical", fmt)
    for name, df in features.items():
        write_table(df, f"{path}/{name}_features", fmt)
