"""Two-sample Kolmogorov-Smirnov p-values.

The limit distribution is a Column expression. For samples up to a limit (an argument) the
exact probability is computed for distinct (n1, n2, distance) triples only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions.names import div
from twinloom.staging import tasks

EXACT_LIMIT = 10_000


def limit_sf(t: Column) -> Column:
    """P(K > t) of the Kolmogorov limit; two series, each where it converges fast."""
    upper = F.lit(0.0)
    for k in range(1, 9):
        upper = upper + F.exp(t * t * F.lit(-2.0 * k * k)) * F.lit(2.0 if k % 2 else -2.0)
    lower = F.lit(0.0)
    for k in range(1, 9, 2):
        lower = lower + F.exp(div(-((k * math.pi) ** 2) / 8.0, t * t))
    small = F.lit(1.0) - div(math.sqrt(2.0 * math.pi), t) * lower
    return F.when(t <= F.lit(1e-8), F.lit(1.0)).when(t < F.lit(1.0), small).otherwise(upper)


def scaled_distance(d: Column, n1: Column, n2: Column) -> Column:
    """Distance scaled by the effective size, with the usual finite-size correction."""
    root = F.sqrt(n1.cast("double") * n2.cast("double") / (n1 + n2).cast("double"))
    return (root + F.lit(0.12) + F.lit(0.11) / root) * d


def np_limit_sf(t: float) -> float:
    if t <= 1e-8:
        return 1.0
    if t < 1.0:
        return 1.0 - math.sqrt(2 * math.pi) / t * sum(
            math.exp(-((k * math.pi) ** 2) / 8.0 / (t * t)) for k in range(1, 9, 2)
        )
    return sum((2.0 if k % 2 else -2.0) * math.exp(-2.0 * k * k * t * t) for k in range(1, 9))


def exact_sf(n1: int, n2: int, steps: int) -> float:
    """P(D >= steps / lcm(n1, n2)) when both samples come from one continuous law.

    All orders of the pooled sample are equally likely. The pool is walked draw by draw;
    probability that reaches the given distance is moved to ``hit``.
    """
    if n1 > n2:
        n1, n2 = n2, n1
    lcm = n1 // math.gcd(n1, n2) * n2
    if steps <= 0:
        return 1.0
    i = np.arange(n1 + 1)
    left = n1 - i
    mass = np.zeros(n1 + 1)
    mass[0] = 1.0
    hit = 0.0
    total = n1 + n2
    for drawn in range(total):
        first = mass * left / (total - drawn)
        mass = mass - first
        mass[1:] += first[:-1]
        gap = np.abs(i * (lcm // n1) - (drawn + 1 - i) * (lcm // n2))
        out = gap >= steps
        hit += mass[out].sum()
        mass[out] = 0.0
    return float(min(1.0, max(0.0, hit)))


def two_sample_p(n1: int, n2: int, d: float, method: str = "auto", exact_limit: int = EXACT_LIMIT) -> float:
    if method == "exact" or (method == "auto" and max(n1, n2) <= exact_limit):
        lcm = n1 // math.gcd(n1, n2) * n2
        return exact_sf(n1, n2, round(d * lcm))
    root = math.sqrt(n1 * n2 / (n1 + n2))
    return min(1.0, max(0.0, np_limit_sf((root + 0.12 + 0.11 / root) * d)))


def critical_distance(n1: int, n2: int, alpha: float, method: str = "auto", exact_limit: int = EXACT_LIMIT) -> float:
    """The smallest attainable distance whose p-value is below ``alpha`` (2.0 if none is)."""
    lcm = n1 // math.gcd(n1, n2) * n2
    lo, hi = 0, lcm + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if two_sample_p(n1, n2, mid / lcm, method, exact_limit) < alpha:
            hi = mid
        else:
            lo = mid
    return hi / lcm if hi <= lcm else 2.0


def with_p_value(df: DataFrame, d: str = "ks", method: str = "auto", out: str = "ks_p", exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """Add the p-value of columns ``n1``, ``n2`` and distance ``d``.

    ``method``: "exact", "asymptotic", or "auto", which is exact for samples up to ``exact_limit``.
    """
    limit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), limit_sf(F.col("__t"))))
    df = df.withColumn("__t", scaled_distance(F.col(d), F.col("n1"), F.col("n2")))
    if method == "asymptotic":
        return df.withColumn(out, limit).drop("__t")
    triples = df.select("n1", "n2", F.col(d).alias("__d"))
    if method == "auto":
        triples = triples.filter(F.greatest("n1", "n2") <= F.lit(exact_limit))
    triples = triples.distinct().repartition(tasks(df.sparkSession))  # each one is costly

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(
                __exact=[two_sample_p(int(x), int(y), float(z), "exact") for x, y, z in zip(b["n1"], b["n2"], b["__d"])]
            )

    fields = [f"{c} {triples.schema[c].dataType.simpleString()}" for c in triples.columns]
    solved = triples.mapInPandas(run, ", ".join([*fields, "__exact double"])).withColumnRenamed("__d", d)
    joined = df.join(solved, ["n1", "n2", d], "left")
    return joined.withColumn(out, F.coalesce("__exact", limit)).drop("__t", "__exact")
