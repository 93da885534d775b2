"""Bootstrap sub-samples of a synthetic table, scored against the original.

Replicates are keyed by draw number. Each has a seed (several draws may share one), and
the sample of a seed depends on the seed and the row keys only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.functions.counter import with_uniform
from twinloom.functions.kolmogorov import EXACT_LIMIT, critical_distance
from twinloom.functions.permutation import Backwards
from twinloom.operators.evaluate import kl_divergence, ks_test
from twinloom.operators.ordered import running_totals
from twinloom.staging import at_most, attach, stage, tasks

ALPHA = 0.05
SEED_RANGE = 10_000
SAMPLE_STREAM = 7_001
# Replicates compared pairwise in one round of the final selection.
ROUND = 1000
FEATURE_BLOCK = 512
# Draws of one feature that meet in one task, numbers a task unpacks and holds at a time.
DRAW_BLOCK = 256
SWEEP_CELLS = 1 << 22
HELD_COUNTS = 1 << 22
# Ids of one unit of a sample, and about how many rows a task makes of it.
SAMPLE_IDS = 1 << 17
SAMPLE_ROWS = 1 << 25
# Pairs of an id and a seed that make a unit of counting, cells and bytes of counts a task holds at a time, and distinct values
# that may be counted by.
COUNT_PAIRS = 1 << 22
UNIT_CELLS = 1 << 22
COUNT_BYTES = 1 << 26
COUNT_VALUES = 1 << 18
# Seeds whose counts are the bytes of one word.
LANES = 8


def seed_of_draw(df: DataFrame, root_seed: int) -> DataFrame:
    """Add ``seed``: uniform on 0..9999, a function of the draw number."""
    return with_uniform(df, "__v", root_seed, "draw").withColumn(
        "seed", F.floor(F.col("__v") * F.lit(SEED_RANGE)).cast("bigint")
    ).drop("__v")


def numbered(ids: DataFrame) -> DataFrame:
    """The distinct ids, staged, with their place 0, 1, ... in id order as ``at``."""
    single = ids.select("id").distinct().withColumn("__one", F.lit(1).cast("bigint")).withColumn("__all", F.lit(0))
    return stage(running_totals(single, ["__all"], "id", ["__one"]).select("id", (F.col("run___one") - 1).alias("at")))


def _seeds(spark, draws: int, root_seed: int) -> list[int]:
    """The seed of each draw: a number per draw."""
    rows = seed_of_draw(spark.range(draws).withColumnRenamed("id", "draw"), root_seed).collect()
    return [r["seed"] for r in sorted(rows, key=lambda r: r["draw"])]


def _units(rows: DataFrame, n: int, chunks: int, blocks: int, *columns: str) -> DataFrame:
    """``rows`` (at, columns) dealt to units of neighbouring places and a block of draws, each sorted by its place."""
    per = max(1, -(-n // chunks))
    placed = rows.select(
        F.floor(F.col("at") / per).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "at", *columns
    )
    return placed.repartition(max(tasks(rows.sparkSession), chunks * blocks), "chunk", "block").sortWithinPartitions("chunk", "block", "at")


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(chunk, block, its rows): a task holds one unit."""
    key, held = None, []
    for batch in batches:
        chunk, block = (batch.column(c).to_numpy() for c in ("chunk", "block"))
        edges = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (block[1:] != block[:-1]), True]) if len(chunk) else []
        for low, high in zip(edges[:-1], edges[1:]):
            own = (int(chunk[low]), int(block[low]))
            if own != key:
                if held:
                    yield (*key, pa.Table.from_batches(held))
                key, held = own, []
            held.append(batch.slice(low, high - low))
    if held:
        yield (*key, pa.Table.from_batches(held))


def _shared(seeds: list[int], block: int, blocks: int) -> dict[int, list[int]]:
    """The seeds of one block with the draws that share each."""
    draws: dict[int, list[int]] = {}
    for draw, seed in enumerate(seeds):
        if seed % blocks == block:
            draws.setdefault(seed, []).append(draw)
    return draws


def draw_samples(ids: DataFrame, size: int, draws: int, root_seed: int) -> DataFrame:
    """Rows (draw, seed, id): ``size`` ids without replacement for each of ``draws`` replicates.

    A draw takes the ids at the first ``size`` places of a permutation keyed by its seed;
    ``size`` beyond the number of ids takes all. Each task reads the permutations backwards for its own
    ids, so the rows are made where they are used: no row of a sample is shuffled or joined.
    """
    index = numbered(ids)
    n = at_most(index)
    seeds, size = _seeds(ids.sparkSession, draws, root_seed), min(size, n)
    chunks = max(1, -(-n // SAMPLE_IDS))
    blocks = max(1, min(draws, -(-max(2 * tasks(ids.sparkSession), draws * size // SAMPLE_ROWS) // chunks)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, unit in _by_unit(batches):
            own = unit.column("id").combine_chunks()
            back = Backwards(SAMPLE_STREAM, unit.column("at").to_numpy(), n)
            for seed, held in _shared(seeds, block, blocks).items():
                drawn = own.take(pa.array(np.flatnonzero(back.places(seed) < size)))
                for draw in held:
                    columns = {"draw": pa.array(np.full(len(drawn), draw)), "seed": pa.array(np.full(len(drawn), seed)), "id": drawn}
                    yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=1 << 16)

    kind = index.schema["id"].dataType.simpleString()
    return _units(index, n, chunks, blocks, "id").mapInArrow(pick, f"draw bigint, seed bigint, id {kind}")


def sample_by_seed(ids: DataFrame, size: int, seed: int) -> DataFrame:
    """The ids that ``draw_samples`` picks for one seed."""
    index = numbered(ids)
    n = at_most(index)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = Backwards(SAMPLE_STREAM, batch.column("at").to_numpy(), n).places(seed)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").filter(pa.array(places < size))})

    return index.mapInArrow(pick, f"id {index.schema['id'].dataType.simpleString()}")


def _drawn_bits(index: DataFrame, n: int, size: int, seeds: list[int]) -> DataFrame:
    """``memberships`` of the draws of these seeds, made where the ids are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(64, SWEEP_CELLS // max(len(seeds), 1))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                back = Backwards(SAMPLE_STREAM, part.column("at").to_numpy(), n)
                bits = np.zeros((part.num_rows, len(seeds)), bool)
                for seed, held in _shared(seeds, 0, 1).items():
                    bits[:, held] = (back.places(seed) < size)[:, None]
                packed = [row.tobytes() for row in np.packbits(bits, axis=1)]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "draws": pa.array(packed, pa.binary())})

    spread = index.repartition(tasks(index.sparkSession), "id")
    return spread.mapInArrow(pack, f"id {index.schema['id'].dataType.simpleString()}, draws binary")


def memberships(samples: DataFrame, draws: int) -> DataFrame:
    """One row per sampled id, with a bit per draw that holds it as ``draws``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held")
            bits = np.zeros((batch.num_rows, draws), bool)
            bits[np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy())), held.flatten().to_numpy()] = True
            packed = [row.tobytes() for row in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "draws": pa.array(packed, pa.binary())})

    lists = samples.groupBy("id").agg(F.collect_list(F.col("draw").cast("int")).alias("held"))
    return lists.mapInArrow(pack, f"id {samples.schema['id'].dataType.simpleString()}, draws binary")


def _member_counts(cells: DataFrame, draws: int) -> DataFrame:
    """(feature, draws) -> per feature the number of its cells in each draw, as 64-bit numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for feature, _, bits in _by_feature(batch, draws):
                sums[feature] = sums.get(feature, 0) + bits.sum(0, dtype=np.int64)
            if len(sums) * draws > HELD_COUNTS:
                yield _vectors(sums)
                sums = {}
        if sums:
            yield _vectors(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            for feature, part in zip(batch.column("feature").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(part, np.int64)
                if feature == current:
                    held = held + part
                    continue
                if current is not None:
                    yield _vectors({current: held})
                current, held = feature, part
        if current is not None:
            yield _vectors({current: held})

    shape = "feature string, counts binary"
    parts = cells.select("feature", "draws").mapInArrow(add, shape)
    return parts.repartition(tasks(cells.sparkSession), "feature").sortWithinPartitions("feature").mapInArrow(total, shape)


def _vectors(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"feature": list(sums), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})


def _bits(column: pa.Array, draws: int) -> np.ndarray:
    """One row of draws per entry; null entries belong to none."""
    width = -(-draws // 8)
    flat = np.frombuffer(b"".join(b or bytes(width) for b in column.to_pylist()), np.uint8)
    return np.unpackbits(flat.reshape(-1, width), axis=1, count=draws)


def _by_feature(batch: pa.RecordBatch, draws: int, step: int | None = None) -> Iterator[tuple[str, slice, np.ndarray]]:
    """Stretches of rows of one feature, with the draws that hold each row; ``step`` rows at most."""
    names = batch.column("feature").to_numpy(zero_copy_only=False)
    step = step or max(64, SWEEP_CELLS // max(draws, 1))
    edges = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True]) if len(names) else []
    for low, high in zip(edges[:-1], edges[1:]):
        for start in range(low, high, step):
            rows = slice(start, min(start + step, high))
            yield names[start], rows, _bits(batch.column("draws")[rows.start : rows.stop], draws)


_SWEPT = "feature string, block int, task int, first double, last double, counts binary, others bigint, low binary, high binary, end binary"


class _Sweep:
    """Running gaps of one feature within one range of values, one column per draw."""

    def __init__(self, feature: str, sizes: np.ndarray, others: int, first: float):
        self.feature, self.sizes, self.others = feature, np.maximum(sizes, 1), max(others, 1)
        self.counts = np.zeros(len(sizes), np.int64)
        self.seen = 0
        self.low, self.high = np.full(len(sizes), np.inf), np.full(len(sizes), -np.inf)
        self.first = self.last = first

    def gap(self, counts: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return counts / self.sizes - (seen / self.others)

    def add(self, values: np.ndarray, bits: np.ndarray, weights: np.ndarray) -> None:
        """Rows in order of value. The last value stays open: it may go on, even in the next range."""
        if values[0] != self.last:
            self.note(self.gap(self.counts, np.int64(self.seen))[None])
        counts = self.counts + np.cumsum(bits, axis=0, dtype=np.int64)
        seen = self.seen + np.cumsum(weights)
        ends = np.flatnonzero(values[1:] != values[:-1])
        if len(ends):
            self.note(self.gap(counts[ends], seen[ends, None]))
        self.counts, self.seen, self.last = counts[-1], int(seen[-1]), values[-1]

    def note(self, gaps: np.ndarray) -> None:
        self.low = np.minimum(self.low, gaps.min(0))
        self.high = np.maximum(self.high, gaps.max(0))

    def rows(self, task: int) -> list[dict]:
        end = self.gap(self.counts, np.int64(self.seen))
        return [
            {
                "feature": self.feature, "block": k, "task": task, "first": self.first, "last": self.last, "others": self.seen,
                "counts": self.counts[at].tobytes(), "low": self.low[at].tobytes(), "high": self.high[at].tobytes(), "end": end[at].tobytes(),
            }
            for k, at in enumerate(np.split(np.arange(len(self.counts)), range(DRAW_BLOCK, len(self.counts), DRAW_BLOCK)))
        ]


def _joined_ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    """The largest gap of each draw of one feature and block, from its ranges in order."""
    pdf = pdf.sort_values("task")
    counts = np.stack([np.frombuffer(x, np.int64) for x in pdf["counts"]])
    sizes = counts.sum(0)
    others = int(pdf["others"].sum())
    low, high, end = (np.stack([np.frombuffer(x, np.float64) for x in pdf[c]]) for c in ("low", "high", "end"))
    before = (np.cumsum(counts, axis=0) - counts) / np.maximum(sizes, 1)
    before -= ((pdf["others"].cumsum() - pdf["others"]).to_numpy() / max(others, 1))[:, None]
    # a range's last value is complete unless the next range begins with it
    open_ = np.r_[pdf["first"].to_numpy()[1:] == pdf["last"].to_numpy()[:-1], False]
    gaps = np.maximum(np.abs(before + high), np.abs(before + low))
    gaps[np.isinf(high)] = 0.0
    gaps = np.maximum(gaps, np.where(open_[:, None], 0.0, np.abs(before + end)))
    draw = np.arange(len(sizes)) + int(pdf["block"].iloc[0]) * DRAW_BLOCK
    out = pd.DataFrame({"draw": draw, "feature": pdf["feature"].iloc[0], "n1": sizes, "n2": others, "ks": gaps.max(0)})
    return out[(out["n1"] > 0) & (others > 0)]


def replicate_distances(samples: DataFrame, synthetic: DataFrame, original: DataFrame) -> DataFrame:
    """KS distance for every (draw, feature): draw, feature, n1, n2, ks.

    Every synthetic cell carries one bit per draw. Cells and the counted original values are
    shuffled once, into sampled ranges of (feature, value, id), so equal values may be cut
    anywhere. A range is read in order with one running count per draw; it hands on its
    counts and the least and largest gap of each draw between its own running shares. The
    counts before a range shift those gaps evenly, so the few rows per (feature, range) hold all that
    the largest gap needs.

    Draws are numbered from 0. A feature whose cells are absent or null for some sampled ids
    takes its sample sizes along as one vector per cell.
    """
    drawn = {int(r["draw"]): r["count"] for r in samples.groupBy("draw").count().collect()}  # one number per draw
    if not drawn:
        return samples.sparkSession.createDataFrame([], "draw bigint, feature string, n1 bigint, n2 bigint, ks double")
    draws = max(drawn) + 1
    whole = np.array([drawn.get(k, 0) for k in range(draws)], np.int64)
    return _swept(stage(memberships(samples, draws)), whole, synthetic, original)


def _swept(members: DataFrame, whole: np.ndarray, synthetic: DataFrame, original: DataFrame) -> DataFrame:
    """Distances by one sweep over ranges of cells; ``members`` as of ``memberships``, ``whole`` the size of each draw."""
    draws = len(whole)
    known = synthetic.filter(F.col("value").isNotNull()).select("id", "feature", "value")
    # an id has one row of bits and a cell a feature: no key is hot, and copies of the bits would outweigh the cells
    held = known.join(members, "id")
    usual = whole.tobytes()
    counts = _member_counts(held, draws).withColumn("counts", F.when(F.col("counts") != F.lit(usual), F.col("counts")))
    others = original.filter(F.col("value").isNotNull()).groupBy("feature").agg(F.count("*").alias("others"))
    sizes = stage(counts.join(others, "feature"))
    at = F.col("id").cast("bigint")
    cells = held.select("feature", "value", at.alias("at"), "draws", F.lit(0).cast("bigint").alias("weight")).unionByName(
        original.filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("weight"))
        .select("feature", "value", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("binary").alias("draws"), "weight")
    )
    cells = attach(cells, sizes, ["feature"], row_bytes=64 + 8 * draws)
    order = [F.col("feature"), F.col("value"), F.col("at")]
    spread = cells.repartitionByRange(tasks(members.sparkSession), *order).sortWithinPartitions(*order)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        now: _Sweep | None = None
        done: list[dict] = []
        for batch in batches:
            values = batch.column("value").to_numpy(zero_copy_only=False)
            weights = batch.column("weight").to_numpy(zero_copy_only=False)
            for feature, rows, bits in _by_feature(batch, draws):
                if now is None or now.feature != feature:
                    done += now.rows(task) if now else []
                    own = batch.column("counts")[rows.start].as_py()
                    total = batch.column("others")[rows.start].as_py()
                    now = _Sweep(feature, whole if own is None else np.frombuffer(own, np.int64), total, values[rows.start])
                now.add(values[rows], bits, weights[rows])
            if len(done) * draws > HELD_COUNTS:
                yield pa.RecordBatch.from_pylist(done, shape)
                done = []
        done += now.rows(task) if now else []
        if done:
            yield pa.RecordBatch.from_pylist(done, shape)

    shape = pa.schema(
        [("feature", pa.string()), ("block", pa.int32()), ("task", pa.int32()), ("first", pa.float64()), ("last", pa.float64())]
        + [("counts", pa.binary()), ("others", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("end", pa.binary())]
    )
    ranges = spread.mapInArrow(sweep, _SWEPT).repartition(tasks(members.sparkSession), "feature", "block")
    return ranges.groupBy("feature", "block").applyInPandas(_joined_ranges, "draw bigint, feature string, n1 bigint, n2 bigint, ks double")


@dataclass(frozen=True)
class Counted:
    """Draws counted by value: per seed one vector over the distinct (feature, value) pairs in order."""

    vectors: DataFrame  # staged (seed, counts)
    features: list[str]
    starts: np.ndarray  # where each feature begins, and the end
    values: np.ndarray
    others: np.ndarray  # the original's count of each pair

    def distances(self) -> DataFrame:
        """(seed, feature, n1, n2, ks) from running totals along each feature's values."""
        features, starts, others = self.features, self.starts, self.others

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for seed, counts in zip(batch.column("seed").to_pylist(), batch.column("counts").to_pylist()):
                    counts = np.frombuffer(counts, np.int64)
                    for k, name in enumerate(features):
                        at = slice(starts[k], starts[k + 1])
                        one, two = np.cumsum(counts[at]), np.cumsum(others[at])
                        if one[-1] and two[-1]:
                            rows.append({"seed": seed, "feature": name, "n1": int(one[-1]), "n2": int(two[-1]), "ks": float(np.abs(one / one[-1] - two / two[-1]).max())})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

        return self.vectors.mapInArrow(run, "seed bigint, feature string, n1 bigint, n2 bigint, ks double")

    def weighted(self, draws: DataFrame) -> DataFrame:
        """(draw, feature, value, weight) of the named draws (draw, seed): their samples with equal values collapsed."""
        features, starts, values = self.features, self.starts, self.values

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owner = np.repeat(np.arange(len(features)), np.diff(starts))
            names = pa.array(features, pa.string())
            for batch in batches:
                for draw, counts in zip(batch.column("draw").to_pylist(), batch.column("counts").to_pylist()):
                    counts = np.frombuffer(counts, np.int64)
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_pydict(
                        {"draw": pa.array(np.full(len(at), draw)), "feature": names.take(pa.array(owner[at])), "value": pa.array(values[at]), "weight": pa.array(counts[at])}
                    )

        named = draws.select("draw", "seed").join(self.vectors, "seed").select("draw", "counts")
        return named.repartition(tasks(draws.sparkSession), "draw").mapInArrow(run, "draw bigint, feature string, value double, weight bigint")


def _dealt(pairs: int, line_bytes: int, vector_bytes: int, seeds: int, cores: int) -> tuple[int, int]:
    """Chunks of ids and blocks of seeds: lines travel once a block, vectors once a chunk; a task holds its block's vectors."""
    units = max(1, min(4 * cores, pairs // COUNT_PAIRS))
    blocks = max(round((units * vector_bytes / max(line_bytes, 1)) ** 0.5), -(-vector_bytes // COUNT_BYTES))
    blocks = max(1, min(blocks, max(units, -(-vector_bytes // COUNT_BYTES)), seeds))
    return -(-units // blocks), blocks


class _Tally:
    """Counts by value of one block of seeds; ids come in slices."""

    def __init__(self, block: int, seeds: list[int], n: int, size: int, width: int):
        self.block, self.seeds, self.n, self.size = block, seeds, n, size
        self.counts = np.zeros((len(seeds), width), np.int32)

    def add(self, slices: list[pa.RecordBatch]) -> None:
        """Sorted by code, the ids of a code are a stretch; a word of them adds up ``LANES`` seeds, a byte each, 255 ids at a time."""
        at = np.concatenate([s.column("at").to_numpy() for s in slices])
        held = np.concatenate([np.diff(s.column("codes").offsets.to_numpy()) for s in slices])
        codes = np.concatenate([s.column("codes").flatten().to_numpy() for s in slices])
        if not len(codes):
            return
        order = np.argsort(codes.astype(np.uint16) if self.counts.shape[1] <= 1 << 16 else codes, kind="stable")
        owner, codes = np.repeat(np.arange(len(at)), held)[order], codes[order]
        edges = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        cuts = -(-np.diff(np.r_[edges, len(codes)]) // 255)
        first = np.cumsum(cuts) - cuts
        starts = np.repeat(edges - 255 * first, cuts) + 255 * np.arange(cuts.sum())
        back = Backwards(SAMPLE_STREAM, at, self.n)
        for low in range(0, len(self.seeds), LANES):
            group = self.seeds[low : low + LANES]
            inside = np.zeros((len(at), LANES), np.uint8)
            for lane, places in enumerate(back.places_of(group)):
                inside[:, lane] = places < self.size
            sums = np.add.reduceat(inside.view(np.uint64).reshape(-1)[owner], starts).view(np.uint8).reshape(-1, LANES)
            sums = np.add.reduceat(sums[:, : len(group)], first, axis=0, dtype=np.int32)
            self.counts[low : low + len(group), codes[edges]] += sums.T

    def rows(self, slices: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if slices:
            self.add(slices)
        for seed, counts in zip(self.seeds, self.counts):
            yield pa.RecordBatch.from_pydict({"seed": pa.array([seed], pa.int64()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _counted(index: DataFrame, n: int, size: int, seeds: list[int], synthetic: DataFrame, original: DataFrame) -> Counted | None:
    """Counts of every draw by value, or None where distinct values are too many for that to be the shorter way.

    Units are neighbouring ids and a block of seeds. A task reads each seed's permutation backwards for its ids, counts their
    cells by (feature, value) and hands on one vector a seed. As many units are made as the cluster can use, cut
    between ids and seeds so that copies of the ids' cells and vectors together are few: what is shuffled
    grows with the cells and with the draws, not with their product.
    """
    spark = index.sparkSession
    side = lambda df, one: df.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n")).select(
        "feature", "value", (F.col("n") * one).alias("own"), (F.col("n") * (1 - one)).alias("other")
    )
    pairs = side(synthetic, 1).unionByName(side(original, 0)).groupBy("feature", "value").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    pairs = stage(pairs)
    width = at_most(pairs)
    cells = int(pairs.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0])
    if width > COUNT_VALUES or width * 32 > cells:
        return None
    own = sorted(set(seeds))
    chunks, blocks = _dealt(n * len(own), 4 * cells + 16 * n, 4 * width * len(own), len(own), spark.sparkContext.defaultParallelism)
    found = pairs.orderBy("feature", "value").toPandas()  # at most COUNT_VALUES rows
    codes = stage(spark.createDataFrame(found[["feature", "value"]].assign(code=np.arange(width, dtype=np.int32))))
    names, starts = np.unique(found["feature"].to_numpy().astype(str), return_index=True)
    coded = attach(synthetic.filter(F.col("value").isNotNull()), codes, ["feature", "value"], row_bytes=96)
    lines = coded.groupBy("id").agg(F.collect_list("code").alias("codes")).join(index, "id")
    per = max(1, -(-n // chunks))
    units = lines.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "at", "codes")
    units = units.repartitionById(chunks * blocks, (F.floor(F.col("at") / per) * blocks + F.col("block")).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, waiting = None, []
        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
            for low, high in zip(edges[:-1], edges[1:]):
                if tally is None or tally.block != block[low]:
                    if tally is not None:
                        yield from tally.rows(waiting)
                    tally, waiting = _Tally(int(block[low]), own[int(block[low]) :: blocks], n, size, width), []
                waiting.append(batch.slice(low, high - low))
                if sum(len(w.column("codes").flatten()) for w in waiting) >= UNIT_CELLS:
                    tally.add(waiting)
                    waiting = []
        if tally is not None:
            yield from tally.rows(waiting)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        row = lambda: pa.RecordBatch.from_pydict({"seed": pa.array([now], pa.int64()), "counts": pa.array([held.tobytes()], pa.binary())})
        for batch in batches:
            for seed, part in zip(batch.column("seed").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(part, np.int32)
                if seed == now:
                    held += part
                    continue
                if now is not None:
                    yield row()
                now, held = seed, part.astype(np.int64)
        if now is not None:
            yield row()

    shape = "seed bigint, counts binary"
    parts = units.mapInArrow(count, shape)
    vectors = stage(parts.repartition(tasks(spark), "seed").sortWithinPartitions("seed").mapInArrow(total, shape))
    return Counted(vectors, [str(x) for x in names], np.r_[starts, width], found["value"].to_numpy(), found["other"].to_numpy(np.int64))


@dataclass(frozen=True)
class Drawn:
    """All replicates of one root seed: their distances, and the weighted cells of some of them."""

    distances: DataFrame  # staged (draw, feature, n1, n2, ks)
    cells: Callable[[DataFrame], DataFrame]  # (draw, seed) -> (draw, feature, value, weight)


def drawn_distances(ids: DataFrame, size: int, draws: int, root_seed: int, synthetic: DataFrame, original: DataFrame) -> Drawn:
    """What ``replicate_distances`` gives for ``draw_samples``, without making the samples' rows.

    With few distinct values draws are counted by value (``_counted``); else cells are swept
    with one bit per draw. Both are exact.
    """
    spark = ids.sparkSession
    index = numbered(ids)
    n = at_most(index)
    seeds, size = _seeds(spark, draws, root_seed), min(size, n)
    inside = synthetic.select("id", "feature", "value")
    counted = _counted(index, n, size, seeds, inside, original) if seeds and size else None
    if counted is not None:
        by_draw = seed_of_draw(spark.range(draws).withColumnRenamed("id", "draw"), root_seed)
        distances = counted.distances().join(by_draw, "seed").select("draw", "feature", "n1", "n2", "ks")
        return Drawn(stage(distances), counted.weighted)
    whole = np.full(len(seeds) if size else 0, size, np.int64)
    if not len(whole):
        distances = spark.createDataFrame([], "draw bigint, feature string, n1 bigint, n2 bigint, ks double")
    else:
        distances = _swept(stage(_drawn_bits(index, n, size, seeds)), whole, inside, original)

    def cells(some: DataFrame) -> DataFrame:
        wanted = {r["draw"]: r["seed"] for r in some.select("draw", "seed").collect()}  # one number per draw

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                back = Backwards(SAMPLE_STREAM, batch.column("at").to_numpy(), n)
                for draw, seed in wanted.items():
                    own = batch.filter(pa.array(back.places(seed) < size))
                    yield pa.RecordBatch.from_pydict({"draw": pa.array(np.full(own.num_rows, draw)), "feature": own.column("feature"), "value": own.column("value")})

        placed = inside.filter(F.col("value").isNotNull()).join(index, "id").select("at", "feature", "value")
        picked = placed.mapInArrow(pick, "draw bigint, feature string, value double")
        return picked.groupBy("draw", "feature", "value").agg(F.count("*").alias("weight"))

    return Drawn(stage(distances), cells)


def replicate_scores(distances: DataFrame, n_features: int, root_seed: int, method: str = "auto", exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """Rows (draw, seed, ks): share of features with p < 0.05, truncated to three decimals.

    The p-value is compared through its critical distance, solved once per size pair.
    """
    if n_features == 0:
        raise ValueError("no feature passes the zero-share filter")
    sizes = distances.select("n1", "n2").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(
                critical=[critical_distance(int(x), int(y), ALPHA, method, exact_limit) for x, y in zip(b["n1"], b["n2"])]
            )

    fields = [f"{c} {sizes.schema[c].dataType.simpleString()}" for c in ("n1", "n2")]
    limits = stage(sizes.mapInPandas(run, ", ".join([*fields, "critical double"])))
    named = attach(distances, limits, ["n1", "n2"], row_bytes=64)
    # half of the finest step between attainable distances absorbs rounding
    slack = F.lit(0.5) / (F.col("n1").cast("double") * F.col("n2").cast("double"))
    failed = named.groupBy("draw").agg(F.count_if(F.col("ks") >= F.col("critical") - slack).alias("failed"))
    share = F.floor(F.col("failed") / F.lit(n_features) * F.lit(1000)) / F.lit(1000.0)
    return seed_of_draw(failed, root_seed).select("draw", "seed", "failed", share.alias("ks"))


def tied_best(scores: DataFrame) -> DataFrame:
    """Draws that share the lowest ``ks``; only these can win."""
    lowest = scores.agg(F.min("ks")).first()[0]
    return scores.filter(F.col("ks") == F.lit(lowest))


def _wins(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """For one feature block: how often each later replicate beats each earlier one."""
    table = pdf.pivot(index="place", columns="feature", values="kl_divergence").reindex(range(size))
    kl = table.to_numpy(dtype=np.float64)
    rows = [(int(b), (kl[b] < kl[: b + 1]).sum(axis=1).astype(np.int64).tolist()) for b in range(size)]
    return pd.DataFrame(rows, columns=["place", "wins"])


def select_best(tied: DataFrame, kl: DataFrame, n_features: int) -> int:
    """The winning draw: in draw order, a replicate replaces the best so far when its KL is
    lower on more than half of the features.

    The rule is not transitive, so order matters. Per feature block every pair is compared
    inside numpy and only counts leave the task; the walk over the counts is small. More
    than ``ROUND`` tied replicates are handled in rounds that carry the best one over.
    """
    order = [r[0] for r in tied.select("draw").orderBy("draw").collect()]
    blocks = max(1, -(-n_features // FEATURE_BLOCK))
    best = order[0]
    for start in range(1, len(order), ROUND):
        batch = [best, *order[start : start + ROUND]]
        places = kl.sparkSession.createDataFrame(list(enumerate(batch)), "place int, draw bigint")
        block = F.pmod(F.xxhash64("feature"), F.lit(blocks)).alias("block")
        named = kl.join(F.broadcast(places), "draw").select("place", "feature", "kl_divergence", block)
        size = len(batch)

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            return _wins(pdf, size)

        by_block = named.repartition(tasks(kl.sparkSession), "block").groupBy("block")
        partial_wins = by_block.applyInPandas(kernel, "place int, wins array<bigint>")
        counts = (
            partial_wins.select("place", F.posexplode("wins").alias("rival", "wins"))
            .groupBy("place", "rival")
            .agg(F.sum("wins").alias("wins"))
            .filter(F.col("wins") > F.lit(n_features / 2.0))
        )
        beats = {(r["place"], r["rival"]) for r in counts.collect()}
        current = 0
        for place in range(1, size):
            if (place, current) in beats:
                current = place
        best = batch[current]
    return best


def statistics(
    sample: DataFrame, original: DataFrame, method: str = "auto", nan_policy: str = "propagate", exact_limit: int = EXACT_LIMIT
) -> DataFrame:
    """Per-feature report of one sample: (feature, kl_divergence, ks_p)."""
    ks = ks_test(sample, original, method=method, exact_limit=exact_limit).select("feature", "ks_p")
    kl = kl_divergence(sample, original, nan_policy=nan_policy)
    return kl.join(ks, "feature").select("feature", "kl_divergence", "ks_p")
