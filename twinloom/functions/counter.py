"""Counter-based randomness.

Every draw is a pure function of (seed, key, ...), so a result never depends on
partitioning, task retries or row order. The same integer recipe exists three times:
as staged Spark columns, as numpy code for block kernels, and (for the SQL checks) as
text in ``contract.sqltext``.

Two 32-bit lanes are hashed independently; their bits form one 52-bit uniform in (0, 1).
All products stay below 2**63, so signed 64-bit arithmetic never overflows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions.names import quoted, ref

MASK = 0xFFFFFFFF
HIGH = 0x7FFFFFFF
MULTIPLIER = 0x45D9F3B
# (start value, multiplier for the upper key half) of each lane
LANES = ((0x9E3779B9, 0x85EBCA6B), (0xC2B2AE35, 0x27D4EB2F))
SCALE = float(2**52)


def lane_start(seed: int, lane: int) -> int:
    """Hash of the seed: the state each lane starts from."""
    x = (int(seed) + LANES[lane][0]) & MASK
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MULTIPLIER) & MASK
    return x ^ (x >> 16)


def _fold_high(x: str) -> str:
    return f"({x} ^ shiftright({x}, 16))"


def _key_word(key: str, lane: int) -> str:
    return f"(({key} ^ ((shiftright({key}, 32) & {HIGH}L) * {LANES[lane][1]}L)) & {MASK}L)"


def with_uniform(df: DataFrame, out: str, seed: int, *keys: str) -> DataFrame:
    """Add column ``out``: a uniform in (0, 1) determined by ``seed`` and the BIGINT ``keys``.

    The hash is built in small select stages because each step uses its input twice;
    written as one nested expression it would double in size at every step.
    """
    base = [ref(c) for c in df.columns if c != out]
    state = [f"{lane_start(seed, lane)}L" for lane in range(2)]

    def stage_of(lanes: list[str]) -> DataFrame:
        return df.select(*base, *[F.expr(text).alias(f"__lane{i}") for i, text in enumerate(lanes)])

    for key in keys:
        k = f"bigint({quoted(key)})"
        df = stage_of([f"({state[i]} + {_key_word(k, i)}) & {MASK}L" for i in range(2)])
        for _ in range(2):
            df = stage_of([f"({_fold_high(f'__lane{i}')} * {MULTIPLIER}L) & {MASK}L" for i in range(2)])
        state = [_fold_high(f"__lane{i}") for i in range(2)]
    bits = f"shiftleft({state[0]}, 20) + shiftright({state[1]}, 12)"
    return sealed(df, base, F.expr(f"(double({bits}) + 0.5D) / {SCALE!r}D"), out)


def sealed(df: DataFrame, base: list[Column], value: Column, out: str) -> DataFrame:
    """Select ``base`` plus ``value`` so that later filters on ``out`` stay above this step.

    Filters are otherwise pushed below the stages by substitution, which doubles the
    expression once per stage. A one-element generator is a boundary they do not cross.
    """
    return df.select(*base, F.explode(F.array(value)).alias(out))


def name_key(name: Column) -> Column:
    """52-bit integer key of a string, for use as a counter key."""
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("bigint")


def _np_round(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MULTIPLIER) & MASK
    return x ^ (x >> 16)


def uniform_grid(seed: int, outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Uniforms for every (outer, inner) key pair, shape (len(outer), len(inner)).

    Equal to ``with_uniform(df, out, seed, outer, inner)`` row by row.
    """
    outer = np.asarray(outer, dtype=np.int64)
    inner = np.asarray(inner, dtype=np.int64)
    state = []
    for lane in range(2):
        fold = LANES[lane][1]
        word = lambda k: (k ^ (((k >> 32) & HIGH) * fold)) & MASK
        first = _np_round((lane_start(seed, lane) + word(outer)) & MASK)
        state.append(_np_round((first[:, None] + word(inner)[None, :]) & MASK))
    bits = (state[0] << 20) + (state[1] >> 12)
    return (bits.astype(np.float64) + 0.5) / SCALE


def uniform_pairs(seed: int, outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Uniforms of key pairs, element by element: row by row equal to ``with_uniform``."""
    state = []
    for lane in range(2):
        fold = LANES[lane][1]
        x = lane_start(seed, lane)
        for key in (outer, inner):
            key = np.asarray(key, dtype=np.int64)
            x = _np_round((x + ((key ^ (((key >> 32) & HIGH) * fold)) & MASK)) & MASK)
        state.append(x)
    bits = (state[0] << 20) + (state[1] >> 12)
    return (bits.astype(np.float64) + 0.5) / SCALE
