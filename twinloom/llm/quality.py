"""Quality scores from random-indexing word vectors and a small two-layer network.

Random indexing: every word has a fixed sparse index vector, a few +1 and -1 at places
given by its hash. A word's vector is the sum of the index vectors of its neighbours over
the whole corpus. Words are runs of letters, of digits or of other visible bytes, kept in
their case, and live in a table of ``BUCKETS`` rows by hash, so the table has a fixed size. Tasks
add up their part of it; blocks of rows are summed across tasks.

A document is the mean of its words' normalised vectors and of their absolute values, with
the likeness of neighbouring words' vectors and the log of its length. A network of two layers is trained on a bounded sample of labelled
rows that are not held out (at most about ``FIT_ROWS``, chosen by the hash of the
identifier); a tenth of the sample sets the temperature that calibrates its probabilities.

What is collected: the vector table (``BUCKETS`` x ``DIM`` numbers) and the features of
the sample, both bounded.

Defined results: null and empty texts are all-zero features with their own score; null
labels are ignored; with no labels, or only one kind, every score is the share of label 1
(0.5 if there is none); null identifiers are not held out; an id with several labels
counts each in training; repeated rows get equal scores; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table
from twinloom.llm.shared import byte_view, held_out, pieces, prefix_hash, span_hash, stage, tasks

BUCKETS = 1 << 14
DIM = 48
NONZERO = 4
REACH = 2
BLOCKS = 64
FIT_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
RATE = 0.01
DECAY = 1e-4
SEED = 11
CUT = 0.3

_KIND = np.full(256, 3, np.uint8)
_KIND[:33] = _KIND[127] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and row number of every word, in order."""
    data, offsets = byte_view(column)
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    visible = kind[starts] > 0
    starts, ends = starts[visible], ends[visible]
    bucket = (span_hash(prefix_hash(data), starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.searchsorted(offsets, starts, side="right") - 1, len(offsets) - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector."""
    random = np.random.default_rng(SEED)
    places = np.argsort(random.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return places, np.where(random.random((BUCKETS, NONZERO)) < 0.5, -1.0, 1.0)


def _pair_counts(bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, neighbour, times) within ``REACH`` words of each other in one row."""
    keys = []
    for step in range(1, REACH + 1):
        same = row[step:] == row[:-step]
        a, b = bucket[:-step][same], bucket[step:][same]
        keys += [a * BUCKETS + b, b * BUCKETS + a]
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first] // BUCKETS, keys[first] % BUCKETS, np.diff(np.r_[first, len(keys)])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors, from the whole texts of all rows; rows have length 1 or 0."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        vectors, seen = np.zeros(BUCKETS * DIM), False
        for batch in pieces(batches, "text", 8 << 20):
            word, near, times = _pair_counts(*words(batch.column("text"))[:2])
            for k in range(NONZERO):
                vectors += np.bincount(word * DIM + places[near, k], times * signs[near, k], len(vectors))
            seen = True
        if seen:
            parts = vectors.astype(np.float32).reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_pydict({"block": np.arange(BLOCKS), "vector": pa.array([p.tobytes() for p in parts], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, vector in zip(batch.column("block").to_pylist(), batch.column("vector")):
                part = np.frombuffer(vector.as_buffer(), np.float32)
                sums[block] = sums.get(block, 0) + part.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": list(sums), "vector": pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())})

    shape = "block long, vector binary"
    parts = docs.select(ref(text_col).alias("text")).mapInArrow(add, shape)
    table_ = np.zeros((BLOCKS, BUCKETS * DIM // BLOCKS), np.float32)
    for r in parts.repartition(tasks(docs.sparkSession), "block").mapInArrow(total, shape).collect():  # the table, once
        table_[r["block"]] = np.frombuffer(r["vector"], np.float32)
    table_ = table_.reshape(BUCKETS, DIM)
    return table_ / np.maximum(np.linalg.norm(table_, axis=1, keepdims=True), 1e-12)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each row: mean vector, mean absolute vector, likeness of neighbouring words,
    log length, length of the mean."""
    bucket, row, rows = words(column)
    out = np.zeros((rows, 2 * DIM + 3), np.float32)
    count = np.bincount(row, minlength=rows)
    begin = np.searchsorted(row, np.arange(rows))
    full = count > 0
    if full.any():
        own = vectors[bucket]
        out[full, :DIM] = np.add.reduceat(own, begin[full], axis=0) / count[full, None]
        out[full, DIM : 2 * DIM] = np.add.reduceat(np.abs(own), begin[full], axis=0) / count[full, None]
        like = np.einsum("ij,ij->i", own[1:], own[:-1]) * (row[1:] == row[:-1])
        out[:, -3] = np.bincount(row[1:], like, rows) / np.maximum(count - 1, 1)
    out[:, -2] = np.log1p(count)
    out[:, -1] = np.linalg.norm(out[:, :DIM], axis=1)
    return out


def features(docs: DataFrame, vectors: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id, held_out, at (a number of its own), x (float32 bytes) of every row."""
    spread = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM numbers

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = pooled(batch.column("text"), spread.value)
            yield pa.RecordBatch.from_pydict(
                {**{c: batch.column(c) for c in ("id", "held_out", "at")}, "x": pa.array([r.tobytes() for r in x], pa.binary())}
            )

    rows = docs.select(ref(id_col).alias("id"), held_out(id_col).alias("held_out"), F.monotonically_increasing_id().alias("at"), ref(text_col).alias("text"))
    return rows.mapInArrow(pool, f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, at long, x binary")


class Network:
    """Standardised inputs, one hidden layer of tanh units, one logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        random = np.random.default_rng(SEED)
        self.base = float(y.mean()) if len(y) else 0.5
        self.weights = None
        if len(np.unique(y)) < 2:
            return
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        order = random.permutation(len(y))
        held = order[: len(y) // 10]
        train = order[len(y) // 10 :] if len(np.unique(y[order[len(y) // 10 :]])) > 1 else order
        z = (x - self.mean) / self.spread
        w = [
            random.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            np.zeros(1),
        ]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(EPOCHS):
            for part in np.array_split(random.permutation(train), max(1, len(train) // 256)):
                step += 1
                hidden = np.tanh(z[part] @ w[0] + w[1])
                error = (1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - y[part]) / len(part)
                back = np.outer(error, w[2]) * (1 - hidden**2)
                for k, g in enumerate((z[part].T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    rate = RATE * (1 - epoch / EPOCHS)
                    w[k] = w[k] * (1 - rate * DECAY) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.heat = w, 1.0
        if len(held) and len(np.unique(y[held])) > 1:
            logit = self.logit(x[held])
            heats = np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, np.where(y[held] == 1, -logit, logit) / t).mean() for t in heats]
            self.heat = float(heats[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(((x - self.mean) / self.spread) @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.heat, -500, 500)))


def fit(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, limit: int = FIT_ROWS) -> Network:
    """``rows``: staged features. Trains on a bounded sample of the labelled rows not held out."""
    own = labels.select(ref(id_col).alias("id"), ref(label_col).cast("double").alias("y"))
    own = own.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id"))
    # rows and not ids are drawn, so an id that is repeated often does not widen the sample
    joined = rows.filter(~F.col("held_out")).join(own, "id")
    share = min(1.0, limit / max(1, joined.count()))
    draw = F.pmod(F.xxhash64(F.lit("quality"), "at", "y"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = joined.filter(draw < share).select("id", "x", "y").toPandas()
    sample = sample.sort_values(["id", "x", "y"])
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(len(sample), 2 * DIM + 3).astype(np.float64)
    return Network(x, sample["y"].to_numpy(np.float64))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    rows = stage(features(docs, word_vectors(docs, text_col), id_col, text_col))
    network = fit(rows, labels, id_col, label_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1)
            score = network.score(x.astype(np.float64))
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= CUT).astype(np.int32)}
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(judge, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
