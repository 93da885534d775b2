"""Synthetic against original data, feature by feature: KS distance and KL divergence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.functions.kolmogorov import EXACT_LIMIT, with_p_value
from twinloom.functions.names import div
from twinloom.operators.kernels import kernel_arrays
from twinloom.operators.ordered import running_totals
from twinloom.staging import attach, stage

GRID_POINTS = 1000


def dense_features(original: DataFrame, zero_share: float) -> DataFrame:
    """Features whose zero count is strictly below ``zero_share`` of their cells."""
    zeros = F.count_if(F.col("value") == 0)
    counted = original.groupBy("feature").agg(zeros.alias("zeros"), F.count("*").alias("n"))
    return counted.filter(F.col("zeros") < F.lit(zero_share) * F.col("n"))


def pooled_counts(sample: DataFrame, original: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, value, in_sample, in_original): how often each value occurs on each side."""

    def side(df: DataFrame, in_sample: int) -> DataFrame:
        return df.filter(F.col("value").isNotNull()).select(
            *keys, "value", F.lit(in_sample).alias("s"), F.lit(1 - in_sample).alias("o")
        )

    return (
        side(sample, 1)
        .unionByName(side(original, 0))
        .groupBy(*keys, "value")
        .agg(F.sum("s").alias("in_sample"), F.sum("o").alias("in_original"))
    )


def ks_statistic(sample: DataFrame, original: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Largest gap between the two empirical distributions, with both sizes."""
    keys = list(keys)
    run = running_totals(pooled_counts(sample, original, keys), keys, "value", ["in_sample", "in_original"])
    gap = F.abs(
        div(F.col("run_in_sample"), F.col("all_in_sample"))
        - div(F.col("run_in_original"), F.col("all_in_original"))
    )
    return (
        run.filter((F.col("all_in_sample") > 0) & (F.col("all_in_original") > 0))
        .groupBy(*keys)
        .agg(F.max("all_in_sample").alias("n1"), F.max("all_in_original").alias("n2"), F.max(gap).alias("ks"))
    )


def ks_test(
    sample: DataFrame,
    original: DataFrame,
    keys: Sequence[str] = ("feature",),
    method: str = "auto",
    exact_limit: int = EXACT_LIMIT,
) -> DataFrame:
    return with_p_value(ks_statistic(sample, original, keys), method=method, exact_limit=exact_limit)


def weighted_values(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal values collapsed to one row with their count as ``weight``; cells that have one are collapsed already."""
    if "weight" in cells.columns:
        return cells.filter(F.col("value").isNotNull()).select(*keys, "value", "weight")
    return cells.filter(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("weight"))


def _side_stats(cells: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    if "weight" in cells.columns:
        known = cells.filter(F.col("value").isNotNull())
        sums = known.groupBy(*keys).agg(
            F.sum("weight").alias(f"n_{side}"), F.min("value").alias(f"mn_{side}"), F.max("value").alias(f"mx_{side}"), F.sum(F.col("value") * F.col("weight")).alias("__sum")
        )
        means = stage(sums.withColumn("__mean", div(F.col("__sum"), F.col(f"n_{side}"))).drop("__sum"))
        gap = F.col("value") - F.col("__mean")
        spread = attach(known, means.select(*keys, "__mean"), list(keys), row_bytes=64).groupBy(*keys).agg(F.sum(gap * gap * F.col("weight")).alias("__squares"))
        n = F.col(f"n_{side}").cast("double")
        h = F.when(n > 1, F.sqrt(F.col("__squares") / (n - 1.0)) * F.pow(n, F.lit(-0.2)))
        return means.join(spread, list(keys)).withColumn(f"h_{side}", h).drop("__mean", "__squares")
    return (
        cells.filter(F.col("value").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias(f"n_{side}"),
            F.min("value").alias(f"mn_{side}"),
            F.max("value").alias(f"mx_{side}"),
            (F.stddev_samp("value") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias(f"h_{side}"),
        )
    )


def _divergences(rows: DataFrame, keys: Sequence[str], nan_policy: str) -> DataFrame:
    """(keys, p, q, n_o, n_s) with kernel sums ``p`` and ``q`` as arrays -> (keys, kl_divergence)."""
    lost = float("nan") if nan_policy == "propagate" else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                p = np.frombuffer(b"".join(batch["p"])).reshape(len(batch), -1) / batch["n_o"].to_numpy()[:, None]
                q = np.frombuffer(b"".join(batch["q"])).reshape(len(batch), -1) / batch["n_s"].to_numpy()[:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    term = np.where(q > 0, np.where(p > 0, p * np.log(p / q), lost), 0.0)
                yield batch[list(keys)].assign(kl_divergence=term.sum(1))

    fields = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.select(*keys, "p", "q", "n_o", "n_s").mapInPandas(run, ", ".join([*fields, "kl_divergence double"]))


def kl_divergence(
    sample: DataFrame,
    original: DataFrame,
    draws: Sequence[str] = (),
    points: int = GRID_POINTS,
    nan_policy: str = "propagate",
) -> DataFrame:
    """Sum over an even grid of p * ln(p / q): p original, q sample, both Scott-bandwidth KDEs.

    The grid spans the joint range and the sum has no width factor. ``draws`` names extra
    keys of ``sample`` (replicates); the density of the original is computed once per
    distinct grid, not once per replicate. A ``weight`` column of ``sample`` counts equal values. Where one side has no spread the result is null.
    ``nan_policy`` decides 0 * ln 0: "propagate" makes the sum NaN, "zero" counts it as 0.
    """
    keys = [*draws, "feature"]
    by_sample = _side_stats(sample, keys, "s")
    by_original = stage(_side_stats(original, ["feature"], "o"))
    both = attach(by_sample, by_original, ["feature"], row_bytes=128).select(
        "*",
        # adding 0.0 turns -0.0 into 0.0, so that equal grids hash alike
        (F.least("mn_s", "mn_o") + 0.0).alias("first"),
        (F.greatest("mx_s", "mx_o") + 0.0).alias("last"),
    )
    grids = stage(both)
    usable = grids.filter((F.col("h_s") > 0) & (F.col("h_o") > 0))
    sample_grids = usable.withColumnRenamed("h_s", "bandwidth")
    q = kernel_arrays(weighted_values(sample, keys), sample_grids, keys, points).withColumnRenamed("sums", "q")
    original_grids = usable.select("feature", "first", "last", F.col("h_o").alias("bandwidth")).distinct()
    numbered = stage(
        original_grids.withColumn("grid", F.xxhash64("first", "last"))
    )
    p = kernel_arrays(
        weighted_values(original, ["feature"]), numbered, ["feature", "grid"], points, on=["feature"]
    ).withColumnRenamed("sums", "p")
    sizes = grids.withColumn("grid", F.xxhash64("first", "last")).select(*keys, "grid", "n_s", "n_o")
    # one row per replicate and feature, its grid points as an array
    joined = attach(q, sizes, keys, row_bytes=64).join(p, ["feature", "grid"])
    return grids.select(*keys).join(_divergences(joined, keys, nan_policy), keys, "left")
