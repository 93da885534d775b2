"""Removal of long repeated byte strings by merging shards' sparse Burrows-Wheeler transforms.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts anywhere else.

Each shard (a task's texts) samples its suffixes: of every ``SPAN`` consecutive positions
from which a whole string can start, the one whose ``GRAM``-byte hash is least becomes an anchor
(the last of equal ones). Which anchor a string of ``LENGTH`` bytes gets depends on its bytes alone, so two equal
strings start equally far (``d`` bytes, less than ``SPAN``) before anchors with equal
context, and share ``d`` bytes to the left and ``LENGTH - d`` to the right. Instead of all
suffixes, a shard's transform therefore lists its anchors with the bytes after them (which
order them) and the bytes before them (the transform's own symbols).

Anchors whose next ``LENGTH - SPAN + 1`` bytes occur once cannot repeat and are dropped;
anchors with equal contexts on both sides are repeats as they are and go on as one. What
is left is merged by interleave refinement: all shards' anchors start as one block per key,
and every step looks eight symbols further, only at blocks still tied, and splits them. The
step of a split gives the common prefix of the neighbours it parts. The symbols before the
anchors are refined in the same way. For each ``d`` the repeated strings are then the
blocks of common right prefix ``LENGTH - d`` crossed with those of common left part ``d``.

Keys with more than ``PART`` distinct contexts are merged in parts; the strings that found
no partner in their part, and one of each kind that did, are counted by a 128-bit digest
over all parts.

Contexts, not suffixes, travel; texts are shuffled twice by their hash and never held
beyond a slice of a few MB (or one document).

Defined results: null counts as empty; texts shorter than ``LENGTH`` lose nothing; equal texts of at
least that length lose everything, repeated rows alike; null or repeated ids are treated like
any row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table
from twinloom.llm.shared import byte_view, mix, pieces, prefix_hash, span_hash, stage

LENGTH = 400
SPAN = 300
GRAM = 32
PART = 8192
SLICE = 1 << 20  # bytes; the sampling takes some hundred bytes for each
_SHOWN = LENGTH - SPAN + 1  # bytes after an anchor that all its strings share


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors, their rows, the keys of what follows them, and of their whole contexts."""
    none = np.zeros(0, np.int64)
    size = len(data) - GRAM + 1
    starts = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(offsets, offsets[1:]) if b - a >= LENGTH] or [none])
    if not len(starts):
        return none, none, none, none
    sums = prefix_hash(data)
    at = np.arange(size)
    grams = span_hash(sums, at, at + GRAM) >> np.uint64(32) << np.uint64(32)
    grams |= np.uint64(0xFFFFFFFF) - at.astype(np.uint64)  # of equal hashes the last
    blocks = -(-size // SPAN)
    padded = np.full((blocks + 1, SPAN), np.iinfo(np.uint64).max, np.uint64)
    padded.reshape(-1)[:size] = grams
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[starts], ahead[starts + SPAN - 1])
    found = np.unique(np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    row = np.searchsorted(offsets, found, side="right") - 1
    left = np.minimum(SPAN - 1, found - offsets[row])
    right = np.minimum(LENGTH, offsets[row + 1] - found)
    key = span_hash(sums, found, found + _SHOWN)
    whole = mix(span_hash(sums, found - left, found + right) + (left * (LENGTH + 1) + right).astype(np.uint64))
    return found, row, key.view(np.int64), whole.view(np.int64)


def refine(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement of equally long strings (rows of bytes) within groups.

    Returns the order and, for each place in it, the common prefix with the string before
    (-1 where a group begins).
    """
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    symbols = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    common = np.full(n, width, np.int64)
    common[np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])] = -1
    block = np.maximum.accumulate(np.where(common < 0, np.arange(n), 0))  # first place of each place's block
    for step in range(symbols.shape[1]):
        tied = np.flatnonzero((common == width) | np.r_[common[1:] == width, False])
        if not len(tied):
            break
        inner = np.lexsort((symbols[order[tied], step], block[tied]))
        order[tied] = order[tied][inner]
        value = symbols[order[tied], step]
        parted = np.flatnonzero((block[tied][1:] == block[tied][:-1]) & (value[1:] != value[:-1])) + 1
        differ = value[parted] ^ value[parted - 1]
        bits = np.floor(np.log2(differ.astype(np.float64))).astype(np.int64)
        bits -= (differ < (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64))).astype(np.int64)
        common[tied[parted]] = np.minimum(8 * step + (63 - np.minimum(bits, 63)) // 8, width)
        fresh = common[tied] < width
        block[tied] = np.maximum.accumulate(np.where(fresh | (block[tied] == tied), tied, 0))
    return order, common


class Merged:
    """Contexts of several keys: which strings around each anchor repeat."""

    def __init__(self, group: np.ndarray, left: list[bytes], right: list[bytes]):
        n = len(group)
        self.left, self.right = left, right
        self.lengths = np.array([[len(a), len(b)] for a, b in zip(left, right)], np.int64).reshape(n, 2)
        before, after = np.zeros((n, SPAN - 1), np.uint8), np.zeros((n, LENGTH), np.uint8)
        for k in range(n):
            before[k, : len(left[k])] = np.frombuffer(left[k], np.uint8)[::-1]
            after[k, : len(right[k])] = np.frombuffer(right[k], np.uint8)
        self.after = refine(group, after)
        self.before = refine(group, before)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """For each context and distance d: does its string repeat; is it the first of its kind."""
        n = len(self.left)
        repeated, first = np.zeros((n, SPAN), bool), np.zeros((n, SPAN), bool)
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        for d in range(SPAN):
            right[self.after[0]] = np.cumsum(self.after[1] < LENGTH - d)
            left[self.before[0]] = np.cumsum(self.before[1] < d)
            whole = np.flatnonzero((self.lengths[:, 0] >= d) & (self.lengths[:, 1] >= LENGTH - d))
            if len(whole) < 1:
                continue
            kind = right[whole] * (n + 1) + left[whole]
            order = np.argsort(kind, kind="stable")
            edge = np.r_[True, kind[order][1:] != kind[order][:-1], True]
            first[whole[order[edge[:-1]]], d] = True
            repeated[whole[order], d] = ~(edge[:-1] & edge[1:])
        return repeated, first


def _intervals(repeated: np.ndarray) -> list[dict]:
    """Covered bytes relative to the anchor, from the distances whose strings repeat."""
    edge = np.diff(np.r_[False, repeated, False].astype(np.int8))
    out: list[dict] = []
    for a, b in zip(np.flatnonzero(edge == 1)[::-1].tolist(), np.flatnonzero(edge == -1)[::-1].tolist()):
        low, high = -(b - 1), LENGTH - a
        if out and low <= out[-1]["hi"]:
            out[-1]["hi"] = max(out[-1]["hi"], high)
        else:
            out.append({"lo": low, "hi": high})
    return out


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_OPEN = pa.list_(pa.struct([("d", pa.int64()), ("digest", pa.binary())]))


def _merge(contexts: DataFrame) -> DataFrame:
    """(key, part, parts, whole, before, after) -> key, whole, spans, open (strings to count over parts)."""

    def close(rows: list[dict]) -> pa.RecordBatch:
        _, group = np.unique(np.array([(r["key"], r["part"]) for r in rows], np.int64), axis=0, return_inverse=True)
        merged = Merged(group.reshape(-1), [r["before"] for r in rows], [r["after"] for r in rows])
        repeated, first = merged.repeats()
        opened = []
        for k, r in enumerate(rows):
            # strings without a partner in this part, and one of each kind with one
            wanted = np.flatnonzero(first[k]).tolist() if r["parts"] > 1 else []
            text, at = r["before"] + r["after"], len(r["before"])
            opened.append([{"d": d, "digest": hashlib.blake2b(text[at - d : at - d + LENGTH], digest_size=16).digest()} for d in wanted])
        return pa.RecordBatch.from_pydict(
            {
                "key": pa.array([r["key"] for r in rows], pa.int64()),
                "whole": pa.array([r["whole"] for r in rows], pa.int64()),
                "spans": pa.array([_intervals(x) for x in repeated], _SPANS),
                "open": pa.array(opened, _OPEN),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                # a batch of whole keys at a time
                if len(rows) >= 2048 and (row["key"], row["part"]) != (rows[-1]["key"], rows[-1]["part"]):
                    yield close(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield close(rows)

    spread = contexts.repartition("key", "part").sortWithinPartitions("key", "part")
    return spread.select("key", "part", "parts", "whole", "before", "after").mapInArrow(
        run, "key long, whole long, spans array<struct<lo: long, hi: long>>, open array<struct<d: long, digest: binary>>"
    )


def _sample(docs: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            data, offsets = byte_view(batch.column("text"))
            at, row, key, whole = anchors(data, offsets)
            texts = batch.column("thash").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"thash": texts[row], "at": at - offsets[row], "key": key, "whole": whole})

    return docs.mapInArrow(find, "thash long, at long, key long, whole long")


def _contexts(texts: DataFrame) -> DataFrame:
    """(text, wanted: array of at, key, whole, part, parts) -> the bytes around each anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = []
            for text, wanted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist()):
                for w in wanted:
                    at = w.pop("at")
                    rows.append(w | {"before": text[max(0, at - SPAN + 1) : at], "after": text[at : at + LENGTH]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("key", pa.int64()), ("whole", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("before", pa.binary()), ("after", pa.binary())]
    )
    return texts.mapInArrow(cut, "key long, whole long, part int, parts int, before binary, after binary")


def _repeats(docs: DataFrame) -> DataFrame:
    """(thash, spans): per distinct text the repeated byte spans, unsorted, overlapping."""
    found = stage(_sample(docs.select("thash", "text")))
    # contexts with their number of occurrences; those of keys that occur once are dropped
    kinds = found.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("thash", "at")).alias("one"))
    kinds = stage(kinds)
    keys = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).filter("total > 1")
    known = stage(kinds.join(keys, "key").select("key", "whole", "n", "one", "kinds"))
    several = known.filter("kinds > 1").withColumn("parts", F.ceil(F.col("kinds") / PART).cast("int"))
    several = several.withColumn("part", F.pmod(F.xxhash64("whole"), F.col("parts")).cast("int"))
    wanted = several.groupBy(F.col("one.thash").alias("wthash")).agg(
        F.collect_list(F.struct(F.col("one.at").alias("at"), "key", "whole", "part", "parts")).alias("wanted")
    )
    owner = docs.groupBy(F.col("thash").alias("othash")).agg(F.min("id").alias("oid"))
    wanted = wanted.join(owner, F.col("wthash") == F.col("othash"))
    texts = docs.join(wanted, (F.col("thash") == F.col("wthash")) & F.col("id").eqNullSafe(F.col("oid")))
    merged = stage(_merge(_contexts(texts.select("text", "wanted"))))
    opened = merged.select("key", "whole", F.inline("open"))
    same = ["key", "d", "digest"]
    shared = opened.groupBy(same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(same)
    late = opened.join(shared, same).select(
        "key", "whole", F.array(F.struct((-F.col("d")).alias("lo"), (LENGTH - F.col("d")).alias("hi"))).alias("spans")
    )
    spans = merged.select("key", "whole", "spans").unionByName(late)
    spans = spans.groupBy("key", "whole").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # a context that occurs more than once repeats as far as it reaches
    everywhere = F.array(F.struct(F.lit(1 - SPAN).cast("long").alias("lo"), F.lit(LENGTH).cast("long").alias("hi")))
    kinds = known.select("key", "whole", "n").join(spans, ["key", "whole"], "left")
    spans = kinds.select("key", "whole", F.when(F.col("n") > 1, everywhere).otherwise(F.col("spans")).alias("spans"))
    # written, so that both sides of the join are plain shuffles and a hot context can be split
    spans = stage(spans.filter(F.size("spans") > 0))
    placed = found.join(spans, ["key", "whole"]).select("thash", "at", F.inline("spans"))
    placed = placed.groupBy("thash", "at").agg(F.collect_set(F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))).alias("spans"))
    return placed.groupBy("thash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Sorted, disjoint, non-touching spans within a text of ``size`` bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted((max(0, s["lo"]), min(size, s["hi"])) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (bytes), kept_text.

    Removal may cut a character; ``kept_text`` shows the replacement character there.
    """
    text = F.coalesce(ref(text_col), F.lit(""))
    rows = docs.select(ref(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("thash"))
    found = _repeats(rows).withColumnRenamed("thash", "fthash")
    joined = rows.join(found, F.col("thash") == F.col("fthash"), "left").select("id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "kept_text")}
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                gone = covered(spans or [], len(text))
                ends = [0, *[x for span in gone for x in span], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"lo": a, "hi": b} for a, b in gone])
                out["kept"].append(kept)
                out["kept_text"].append(kept.decode(errors="replace"))
            columns = {"id": batch.column("id"), **{n: pa.array(v, pa.int64()) for n, v in list(out.items())[:3]}}
            columns |= {"kept_sha256": pa.array(out["kept_sha256"]), "spans": pa.array(out["spans"], _SPANS), "kept": pa.array(out["kept"], pa.binary()), "kept_text": pa.array(out["kept_text"], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo: long, hi: long>>, kept binary, kept_text string"
    return joined.mapInArrow(remove, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")
