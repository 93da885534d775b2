"""Best-fit packing of tokenised documents into sequences of a fixed length.

Hierarchical residual packing. Each task tokenises its documents, cuts those longer than a
sequence into pieces and packs its pieces best-fit, longest first. Nearly full bins are
emitted. The others are residual bins: they become items of the next round, in which the
residual bins of ``FAN_IN`` tasks (then of as many groups, and so on up to the root) are
packed best-fit again.

From the first merge on only the fill of a bin matters, so a round works on a histogram:
for each group and fill the number of residual bins, at most one row per fill. Best fit on
counts yields intervals ``(fill, rank from, rank to) -> bins from``; the bins themselves
are ranked within group and fill from per-task counts. A round never holds the bins of a
group, however many there are.

Token ids come from a tokenizers file; the path is a parameter. Words are looked up in a
bounded per-worker cache, see ``WordEncoder``.

Defined results: null text counts as empty; an empty document is one piece, the separator
alone; rows with null or repeated ids are packed each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator
from functools import reduce
from types import ModuleType

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table
from twinloom.llm.shared import stage

LENGTH = 2048
SEPARATOR = 0
FAN_IN = 64
#: Bins with at most this many free places are emitted without another round.
NEARLY = 2
CACHE = 400_000
TOKENIZER = "word_bpe_49k.json"


# The pattern in the tokenizer file, and the settings with which words can be encoded one by one.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


class WordEncoder:
    """Token ids of whole texts, by words that are encoded once and cached.

    That needs a tokenizer with the settings of ``_SETTINGS``; any other one encodes whole texts.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its white-space separated chunks in order. A chunk of characters up to U+017F is split by
    the tokenizer's own pattern (these characters are in normal form already) and its words
    go straight to the BPE model; any other chunk goes through the whole tokenizer, and so
    does a text with a special token's string or a control character that only Python counts
    as white space.
    """

    _whole = re.compile("[\x1c-\x1f]")
    _beyond = re.compile("[^\x00-ſ]")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        # whole texts go through the tokenizer unless it cuts them as this class does
        self.plain = any(settings[name] != wanted for name, wanted in _SETTINGS.items()) or settings["model"]["type"] != "BPE"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(_PATTERN).findall
        # printable bytes stand for themselves, the others are numbered from U+0100
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            shown = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
            ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
            known = np.array(ids, "<u4").tobytes()
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = known
        return known

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self._beyond.search(chunk) or not chunk.isprintable():
            ids = self._full(chunk)
        else:
            low = chunk.lower() if "İ" not in chunk else "".join(c.lower() for c in chunk)
            ids = b"".join([self._word(w) for w in self.split(low)])
        if len(self.chunks) >= CACHE:
            self.chunks.clear()
        self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.plain or self._whole.search(text) or any(s in text for s in self.special):
            return self._full(text)
        known, encode = self.chunks.get, self._chunk
        return b"".join([ids if (ids := known(c)) is not None else encode(c) for c in text.split()])


def encoder(path: str) -> WordEncoder:
    """One per Python worker and tokenizer file; its caches outlive a task.

    Task functions travel by value, so what a worker keeps lives in a module of its own.
    """
    held = sys.modules.setdefault("_twinloom_worker", ModuleType("_twinloom_worker")).__dict__
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of every item, longest first, each into the fullest bin that holds it; fills of bins."""
    order = np.argsort(-sizes, kind="stable")
    bin_of, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(length + 1)]
    open_mask, fills = 0, []
    for k in order.tolist():
        size = int(sizes[k])
        room = open_mask >> size
        if room:
            left = size + ((room & -room).bit_length() - 1)
            at = free[left].pop()
            if not free[left]:
                open_mask &= ~(1 << left)
        else:
            at, left = len(fills), length
            fills.append(0)
        bin_of[k], offset[k] = at, fills[at]
        fills[at] += size
        left -= size
        if left:
            free[left].append(at)
            open_mask |= 1 << left
    return bin_of, offset, np.array(fills, np.int64)


def best_fit_counts(counts: dict[int, int], length: int) -> list[dict[str, int]]:
    """Best fit, largest first, of ``counts[fill]`` equal items per fill.

    Returns intervals: item ``r`` of ``fill`` with ``lo <= r < hi`` goes to bin
    ``first + r - lo`` at ``place``; that bin ends with ``total`` tokens and is number
    ``rank + r - lo`` of its group's bins of that total.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # runs (first bin, number) of equal free room
    open_mask, bins, taken = 0, 0, []
    for size in sorted(counts, reverse=True):
        rank, rest = 0, counts[size]
        while rest:
            room = open_mask >> size
            if room:
                left = size + ((room & -room).bit_length() - 1)
                first, n = free[left].pop()
                take = min(n, rest)
                if take < n:
                    free[left].append((first + take, n - take))
                elif not free[left]:
                    open_mask &= ~(1 << left)
            else:
                # as many new bins as the rest needs of this size alone
                left, take, first = length, -(-rest // (length // size)), bins
                bins += take
            taken.append((size, rank, rank + take, first, length - left))
            rank, rest, left = rank + take, rest - take, left - size
            if left:
                free.setdefault(left, []).append((first, take))
                open_mask |= 1 << left
    # split the intervals where the runs of bins were split, so that each has one total
    marks = np.array(sorted({b for _, lo, hi, b0, _ in taken for b in (b0, b0 + hi - lo)}), np.int64)
    spans = [(*np.searchsorted(marks, [first, first + hi - lo]), size, lo, first, place) for size, lo, hi, first, place in taken]
    total = np.zeros(len(marks), np.int64)
    for a, b, size, *_ in spans:
        total[a:b] += size
    ranks, seen = np.zeros(len(marks), np.int64), dict.fromkeys(total.tolist(), 0)
    for k in range(len(marks) - 1):
        ranks[k] = seen[int(total[k])]
        seen[int(total[k])] += int(marks[k + 1] - marks[k])
    return [
        {
            "fill": size,
            "lo": lo + int(marks[k]) - first,
            "hi": lo + int(marks[k + 1]) - first,
            "first": int(marks[k]),
            "place": place,
            "total": int(total[k]),
            "rank": int(ranks[k]),
        }
        for a, b, size, lo, first, place in spans
        for k in range(a, b)
    ]


def _pieces(docs: DataFrame, path: str, length: int) -> DataFrame:
    """Pieces with task, bin, place in the bin, the bin's fill and its rank among the task's bins of that fill."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        ids, numbers, starts, lengths, crcs = [], [], [], [], []
        for batch in batches:
            for text in batch.column("text"):
                tokens = encode(text.as_py() or "") + SEPARATOR.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(tokens), 4 * length)):
                    piece = tokens[at : at + 4 * length]
                    numbers.append(k)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
            ids.append(batch.column("id"))
        if not numbers:
            return
        starts, lengths = np.array(starts), np.array(lengths)
        at, offset, fills = best_fit(lengths, length)
        order = np.argsort(fills, kind="stable")
        rank = np.empty(len(fills), np.int64)
        rank[order] = np.arange(len(fills)) - np.searchsorted(fills[order], fills[order])
        row = np.cumsum(starts == 0) - 1
        columns = {
            "id": pa.chunked_array(ids).combine_chunks().take(pa.array(row)),
            "piece": np.array(numbers, np.int32),
            "start": starts.astype(np.int64),
            "length": lengths.astype(np.int64),
            "crc": np.array(crcs, np.int64),
            "task": np.full(len(row), TaskContext.get().partitionId(), np.int64),
            "bin": at,
            "offset": offset,
            "fill": fills[at],
            "rank": rank[at],
        }
        yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=50_000)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        cut,
        f"id {kind}, piece int, start long, length long, crc long, task long, bin long, offset long, fill long, rank long",
    )


_PLAN = "group long, fill long, lo long, hi long, first long, place long, total long, rank long"


def _merge(sizes: DataFrame, fan_in: int, length: int) -> tuple[DataFrame, DataFrame]:
    """One round over residual bins, given as (task, fill, n).

    Returns the ranks before each task's bins in its group, and the staged plan.
    """
    grouped = sizes.withColumn("group", F.floor(F.col("task") / fan_in))
    before = Window.partitionBy("group", "fill").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.select("task", "fill", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        plan = best_fit_counts(dict(zip(frame["fill"].tolist(), frame["n"].tolist())), length)
        return pd.DataFrame(plan).assign(group=frame["group"].iloc[0])[[c.split()[0] for c in _PLAN.split(", ")]]

    counts = grouped.groupBy("group", "fill").agg(F.sum("n").alias("n"))
    return starts, stage(counts.groupBy("group").applyInPandas(pack, _PLAN))


def _sequence(level, group, number):
    """Sequence id from the round, the group (below 2**24) and the bin (below 2**36)."""
    return F.lit(level).cast("long") * F.lit(1 << 60) + group * F.lit(1 << 36) + number


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    fan_in: int = FAN_IN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stage(_pieces(docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")), tokenizer, length))
    # each bin has one piece at offset 0; it stands for the bin
    residual = pieces.filter((F.col("offset") == 0) & (F.col("fill") < length - NEARLY)).select(
        F.col("task").alias("task0"), F.col("bin").alias("bin0"), "task", "fill", "rank", F.lit(0).cast("long").alias("shift")
    )
    sizes = residual.groupBy("task", "fill").agg(F.count(F.lit(1)).alias("n"))
    groups, level, finished = (pieces.agg(F.max("task")).first()[0] or 0) + 1, 0, []
    while groups > 1 or not level:
        groups, level = -(-groups // fan_in), level + 1
        starts, plan = _merge(sizes, fan_in, length)
        ranked = residual.join(starts, ["task", "fill"]).withColumn("at", F.col("before") + F.col("rank")).drop("rank")
        inside = (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
        ahead = F.col("at") - F.col("lo")
        placed = ranked.join(plan, ["group", "fill"]).filter(inside)
        placed = stage(
            placed.select(
                "task0",
                "bin0",
                F.col("group").alias("task"),
                (F.col("first") + ahead).alias("bin"),
                F.col("total").alias("fill"),
                (F.col("rank") + ahead).alias("rank"),
                (F.col("shift") + F.col("place")).alias("shift"),
            )
        )
        done = F.lit(True) if groups == 1 else F.col("fill") >= length - NEARLY
        finished.append(placed.filter(done).select("task0", "bin0", "shift", _sequence(level, F.col("task"), F.col("bin")).alias("into")))
        residual = placed.filter(~done).drop("bin")
        heads = plan.filter((F.col("place") == 0) & (F.col("total") < length - NEARLY))
        sizes = heads.groupBy(F.col("group").alias("task"), F.col("total").alias("fill")).agg(
            F.sum(F.col("hi") - F.col("lo")).alias("n")
        )
    moved = reduce(DataFrame.unionByName, finished)
    out = pieces.join(moved, (F.col("task") == F.col("task0")) & (F.col("bin") == F.col("bin0")), "left")
    return out.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        F.coalesce("into", _sequence(0, F.col("task"), F.col("bin"))).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
