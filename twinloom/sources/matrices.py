"""Measurement matrices: one delimited file each, features in rows and patients in columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.staging import attach, stage


def read_matrices(
    spark: SparkSession, root: str, files: Sequence[str], separator: str = ",", skip: int = 1
) -> DataFrame:
    """Cells ``(file, id, feature, value)`` of the listed files under ``root``; absent files are skipped.

    In each file ``skip`` lines come first, then a header with the patient keys, then one
    line per feature starting with its name. Files are read as splittable text. The row
    counter is used only to find the header line of each file: within one scan partition
    it grows by one per line.
    """
    lines = (
        spark.read.text(root)
        .select(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_path").alias("path"),  # names may recur in folders
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
        .filter(F.col("file").isin(list(files)))
        .withColumn("line", F.monotonically_increasing_id())
    )
    opening = stage(lines.filter("block = 0").groupBy("path").agg((F.min("line") + skip).alias("header_line")))
    heads = attach(lines.filter("block = 0"), opening, ["path"])
    headers = stage(
        heads.filter("line = header_line").select(
            "path", "header_line", F.split("value", separator).alias("header")
        )
    )
    width = headers.agg(F.max(F.size("header"))).first()[0] or 1
    body = attach(lines, headers, ["path"], row_bytes=24 * width)
    body = body.filter((F.col("block") > 0) | (F.col("line") > F.col("header_line"))).filter(F.col("value") != "")
    parts = body.select("file", "header", F.split("value", separator).alias("parts"))
    # keys and values are paired first, so no array goes along with the cells
    paired = F.arrays_zip(F.slice("header", 2, width).alias("key"), F.slice("parts", 2, width).alias("text"))
    cells = parts.select("file", F.element_at("parts", 1).alias("feature"), F.inline(paired))
    return cells.select(
        "file",
        F.trim("key").cast("bigint").alias("id"),
        "feature",
        F.nullif(F.trim("text"), F.lit("")).cast("double").alias("value"),
    )


def melt_arrays(df: DataFrame, key: str, values: str, prefix: str = "f") -> DataFrame:
    """Rows holding a fixed-width array to long cells named ``<prefix><position>``."""
    return df.select(F.col(key).alias("id"), F.posexplode(values).alias("pos", "value")).select(
        "id",
        F.concat(F.lit(prefix), F.col("pos").cast("string")).alias("feature"),
        F.col("value").cast("double").alias("value"),
    )


def unite(cells: Sequence[DataFrame]) -> DataFrame:
    """Union of long cells. Features missing from one source stay absent, i.e. null."""
    out = cells[0]
    for other in cells[1:]:
        out = out.unionByName(other)
    return out
