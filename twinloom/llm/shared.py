"""Helpers of the document operators: staged tables, small inline tables, byte and word arrays."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.staging import checkpoint_root, tasks

__all__ = ["stage", "tasks", "inline", "leading", "held_out", "pieces", "byte_view", "Words", "words_of", "mix"]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table whose rows are a literal of the plan (no Python on the executors)."""
    array = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(array))


def leading(array, size: int, before: Callable[[Column], Column]) -> Column:
    """How many of the first elements of a sorted array are ``before``: a binary search."""
    steps = [1 << s for s in reversed(range(max(1, size.bit_length())))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when((low + step <= size) & before(F.get(array, low + step - 1)), low + step).otherwise(low),
    )


def held_out(id_col: str):
    """Rows kept from every fit: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(ref(id_col).cast("string")) % 5 == 0, F.lit(False))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose ``text`` holds about ``limit`` bytes.

    A row is never cut: a longer text makes a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


_SEEDS = np.random.default_rng(20).integers(1, 2**63, 256).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of ``seed[byte] * base**position``; any span's hash follows from two of them."""
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SEEDS[data] * up[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# bytes with A-Z lowered, and which lowered bytes belong to words
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _classes() -> tuple[np.ndarray, np.ndarray]:
    return _LOWER, _WORD


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs of ``member``, cut at row offsets."""
    edge = np.zeros(len(member) + 1, bool)
    edge[offsets] = True
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1] | edge[1:-1]
    last[:-1] &= ~member[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """Words of the rows of one slice: byte spans, row numbers and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower, word = _classes()
        data = lower[data]
        self.rows = len(offsets) - 1
        self.starts, self.ends = runs(word[data], offsets)
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.hashes = span_hash(prefix_hash(data), self.starts, self.ends)
        # word numbers at which the rows begin
        self.offsets = np.searchsorted(self.row, np.arange(self.rows + 1))

    def __len__(self) -> int:
        return len(self.starts)


def words_of(column: pa.Array) -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of each row after lowering A-Z.

    Works on UTF-8 bytes: every byte of a character beyond ASCII belongs to a word.
    """
    return Words(*byte_view(column))
