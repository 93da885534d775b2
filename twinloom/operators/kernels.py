"""Gaussian kernel sums on per-feature grids.

Values arrive range-partitioned and sorted by key and value, so one large key spreads over
many tasks while small keys stay together. A task adds its values, chunk by chunk, into one
array per key and emits it when the key changes; it never holds a group in memory. Arrays
of one key from several tasks are added element by element.

A chunk of sorted values only touches the grid points it can reach: beyond ``REACH``
bandwidths the kernel is 0 in double arithmetic (its distribution function 0, and 1 above
``FULL`` bandwidths), so the cut changes no sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.functions.normal import np_norm_cdf
from twinloom.staging import attach, tasks

_CHUNK = 2048
_NORM = 1.0 / np.sqrt(2.0 * np.pi)
# exp(-z * z / 2) is below the least double beyond REACH; 1 - Phi(z) is below half a unit in the last place of 1 beyond FULL
REACH = 38.7
FULL = 8.5


def _add(acc: np.ndarray, grid: np.ndarray, values: np.ndarray, weights: np.ndarray, h: float, kind: str) -> None:
    """Add sorted ``values`` to the sums at the points of ``grid`` (ascending)."""
    for start in range(0, len(values), _CHUNK):
        own, load = values[start : start + _CHUNK], weights[start : start + _CHUNK]
        first = int(np.searchsorted(grid, own[0] - REACH * h))
        last = int(np.searchsorted(grid, own[-1] + (FULL if kind == "cdf" else REACH) * h, side="right"))
        d = (grid[None, first:last] - own[:, None]) / h
        if kind == "cdf":
            k = np_norm_cdf(d)
            acc[last:] += load.sum()
        else:
            np.multiply(d, d, out=d)
            d *= -0.5
            k = np.exp(d, out=d) * (_NORM / h)
        acc[first:last] += load @ k


def kernel_arrays(
    values: DataFrame,
    grids: DataFrame,
    keys: Sequence[str],
    points: int,
    kind: str = "pdf",
    on: Sequence[str] | None = None,
) -> DataFrame:
    """Rows ``(keys, sums)``: the weighted kernel sums at all grid points as 64-bit floats.

    ``values`` holds ``(on, value, weight)``; ``grids`` (staged, one row per key) holds
    ``first``, ``last`` and ``bandwidth`` of ``points`` evenly spaced grid points. ``on``
    (default: all keys) are the keys that ``values`` carries; every grid of a value's
    ``on`` keys receives it.
    """
    keys = list(keys)
    on = keys if on is None else list(on)
    named = attach(values, grids.select(*keys, "first", "last", "bandwidth"), on, row_bytes=128)
    named = named.filter(F.col("bandwidth") > 0)
    order = [*[ref(k) for k in keys], F.col("value")]
    ordered = named.repartitionByRange(tasks(values.sparkSession), *order).sortWithinPartitions(*order)
    steps = np.arange(points) / max(points - 1, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, acc, grid = None, None, None
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False):
                lo, hi, h = (float(part[c].iloc[0]) for c in ("first", "last", "bandwidth"))
                if current != key:
                    if current is not None:
                        yield _row(keys, current, acc)
                    current, acc, grid = key, np.zeros(points), lo + steps * (hi - lo)
                _add(acc, grid, part["value"].to_numpy(), part["weight"].to_numpy(dtype=np.float64), h, kind)
        if current is not None:
            yield _row(keys, current, acc)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, acc = None, None
        for batch in batches:
            for key, part in zip(batch[keys].itertuples(index=False, name=None), batch["sums"]):
                if current != key:
                    if current is not None:
                        yield _row(keys, current, acc)
                    current, acc = key, np.zeros(points)
                acc += np.frombuffer(part)
        if current is not None:
            yield _row(keys, current, acc)

    shape = ", ".join([*[f"`{k}` {grids.schema[k].dataType.simpleString()}" for k in keys], "sums binary"])
    names = [ref(k) for k in keys]
    partial = ordered.mapInPandas(run, shape).repartition(tasks(values.sparkSession), *names)
    return partial.sortWithinPartitions(*names).mapInPandas(total, shape)


def _row(keys: list[str], key: tuple, acc: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([{**dict(zip(keys, key, strict=True)), "sums": acc.tobytes()}])


def kernel_sums(
    values: DataFrame,
    grids: DataFrame,
    keys: Sequence[str],
    points: int,
    kind: str = "pdf",
    on: Sequence[str] | None = None,
) -> DataFrame:
    """``kernel_arrays`` as rows ``(keys, point, x, total)``."""
    keys = list(keys)
    arrays = kernel_arrays(values, grids, keys, points, kind, on)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = batch.loc[batch.index.repeat(points), keys].reset_index(drop=True)
                yield out.assign(point=np.tile(np.arange(points), len(batch)), total=np.frombuffer(b"".join(batch["sums"])))

    fields = [f"`{k}` {grids.schema[k].dataType.simpleString()}" for k in keys]
    totals = arrays.mapInPandas(spread, ", ".join([*fields, "point int, total double"]))
    width = (F.col("last") - F.col("first")) / F.lit(float(max(points - 1, 1)))
    return attach(totals, grids.select(*keys, "first", "last"), keys, row_bytes=128).select(
        *keys, "point", (F.col("first") + F.col("point") * width).alias("x"), "total"
    )
