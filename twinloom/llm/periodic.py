"""Runs of repeated words: maximal stretches with a short period, found through suffix trees.

Per document the words are numbered. A suffix tree of the words and one of their reversal
are built by Ukkonen's method; an Euler tour of each tree, with range minima over its
depths, gives the lowest common ancestor of two leaves in constant time and so the longest
common extension of two places to the right and to the left. By the theorem of runs, every
run holds a Lyndon root that is the longest Lyndon word at its start under one of the two
orders of words (usual and inverted). So each place gives two candidate periods, and
extending a candidate in both directions yields its run.

Only stretches that can hold a run are handed to the trees: in a run of at least
``exponent`` periods each run of three words occurs at least ``exponent - 1`` times, which
is counted first over whole texts. No run is lost by that, and it is repeated inside the
stretches until nothing more goes away.

Range minima take memory in proportion to the tree (blocks with a sparse table over block
minima), so a document needs less than a KB per word of its candidate stretches. Texts are read
in slices of a few MB.

Defined results: null and empty texts and texts of white space have no words and no runs;
repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table
from twinloom.llm.shared import pieces

LEAST = 6
EXPONENT = 4
SLICE = 2 << 20
RANGE = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """Suffix tree of the numbers 1, 2, ... with an end mark of 0; node 0 is the root.

    ``span`` is the length of the edge into a node; ``edges`` has the child by
    ``node * width + first symbol``.
    """

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        n = len(text)
        width = max(text) + 1
        start, end, link = [0], [0], [0]
        edges: dict[int, int] = {}
        find = edges.get
        node, first, length, rest = 0, 0, 0, 0
        for at, symbol in enumerate(text):
            rest += 1
            pending = 0
            while rest:
                if not length:
                    first = at
                key = node * width + text[first]
                child = find(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(at)
                    end.append(n)
                    link.append(0)
                    if pending:
                        link[pending] = node
                        pending = 0
                else:
                    low = start[child]
                    size = (end[child] if end[child] <= at else at + 1) - low
                    if length >= size:
                        node, first, length = child, first + size, length - size
                        continue
                    if text[low + length] == symbol:
                        length += 1
                        if pending:
                            link[pending] = node
                        break
                    split = len(start)
                    start += (low, at)
                    end += (low + length, n)
                    link += (0, 0)
                    edges[key] = split
                    edges[split * width + symbol] = split + 1
                    start[child] = low + length
                    edges[split * width + text[low + length]] = child
                    if pending:
                        link[pending] = split
                    pending = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    first = at - rest + 1
        self.size, self.width, self.edges = n, width, edges
        self.span = [e - s for s, e in zip(start, end)]

    def tour(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """The Euler tour: the depth (in symbols) it turns at between neighbouring leaves, each
        suffix's place among the leaves, and the suffixes with the end mark before all symbols
        and behind them.
        """
        size, width, span = self.size, self.width, self.span
        # children as linked lists, the one of largest symbol first; leaves of a bare end mark apart
        head, after, marked = [0] * len(span), [0] * len(span), [False] * len(span)
        for key in sorted(self.edges):
            parent, symbol = divmod(key, width)
            if symbol:
                child = self.edges[key]
                after[child] = head[parent]
                head[parent] = child
            else:
                marked[parent] = True
        turns: list[int] = []
        first: list[int] = []
        last: list[int] = []
        depth = [0] * len(span)
        stack, back = [0], False
        while stack:
            node = stack.pop()
            if node < 0:
                last.append(~node)
                continue
            reach = depth[node]
            if back:  # the first step down after a leaf starts where the tour turned
                turns.append(reach - span[node])
                back = False
            child = head[node]
            if marked[node]:
                first.append(size - reach - 1)
                stack.append(~first[-1])
                if child:
                    turns.append(reach)
                else:
                    back = True
            elif not child:
                first.append(size - reach)
                last.append(first[-1])
                back = True
                continue
            while child:
                depth[child] = reach + span[child]
                stack.append(child)
                child = after[child]
        place = [0] * size
        for k, suffix in enumerate(first):
            place[suffix] = k
        return turns, place, first, last


class RangeMinima:
    """Minimum of any range in constant time: running minima inside blocks, a sparse table over them."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // RANGE)
        padded = np.full(blocks * RANGE, np.iinfo(np.int32).max, np.int32)
        padded[: len(values)] = values
        grid = padded.reshape(blocks, RANGE)
        self.values = padded
        self.ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [grid.min(1)]
        while 2 << (len(self.levels) - 1) <= blocks:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of values[low..high], both ends included."""
        a, b = low // RANGE, high // RANGE
        out = np.minimum(self.behind[low], self.ahead[high])
        within = np.flatnonzero(a == b)
        if len(within):
            places = low[within, None] + np.arange(RANGE)
            inside = places <= high[within, None]
            found = self.values[np.minimum(places, len(self.values) - 1)]
            out[within] = np.where(inside, found, np.iinfo(np.int32).max).min(1)
        count = b - a - 1
        level = np.frexp(np.maximum(count, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[count > 0]):
            at = np.flatnonzero((count > 0) & (level == k))
            left, right = self.levels[k][a[at] + 1], self.levels[k][b[at] - (1 << int(k))]
            out[at] = np.minimum(out[at], np.minimum(left, right))
        return out


class Extensions:
    """Longest common extensions of two places in one of several texts, kept one after another."""

    def __init__(self, texts: list[list[int]], orders: bool = False):
        turns: list[int] = []
        place: list[int] = []
        self.first: list[list[int]] = []
        self.last: list[list[int]] = []
        for symbols in texts:
            own, leaf, first, last = SuffixTree(symbols).tour()
            base = len(turns)
            place += [base + k for k in leaf]
            turns += own
            turns.append(0)
            if orders:
                self.first.append(first)
                self.last.append(last)
        self.place = np.array(place, np.int64)
        self.minima = RangeMinima(np.array(turns, np.int32))

    def __call__(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """``one`` and ``other``: two different places of one text, in the numbering of all texts."""
        a, b = self.place[one], self.place[other]
        return self.minima(np.minimum(a, b), np.maximum(a, b) - 1)


def lyndon_lengths(order: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, from the sorted suffixes (end mark included).

    It reaches up to the next place whose suffix is smaller.
    """
    n = len(order) - 1
    rank = [0] * (n + 1)
    for k, suffix in enumerate(order):
        rank[suffix] = k
    rank[n] = -1  # the bare end mark is smaller than all
    reach, stack = [0] * n, [n]
    for at in range(n - 1, -1, -1):
        own = rank[at]
        while rank[stack[-1]] > own:
            stack.pop()
        reach[at] = stack[-1] - at
        stack.append(at)
    return reach


def find_runs(texts: list[list[int]], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """For each text of numbers from 1 on: rows (start, length, period) of its runs.

    Runs have at least ``least`` symbols and ``exponent`` periods (2 or more); they are sorted
    by start, then period.
    """
    if not texts:
        return []
    right, left = Extensions(texts, orders=True), Extensions([t[::-1] for t in texts])
    sizes = np.array([len(t) for t in texts], np.int64)
    # each text takes one place more than it has symbols, for its end mark
    base = np.cumsum(sizes + 1) - sizes - 1
    of = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = []
    for orders in (right.first, [last[::-1] for last in right.last]):
        period = np.array([q for order in orders for q in lyndon_lengths(order)], np.int64)
        room = exponent * period <= sizes[of]
        text, start, q = of[room], at[room], period[room]
        low = base[text] + start
        ahead = right(low, low + q)
        low = base[text] + sizes[text] - start
        behind = left(low, low - q)
        length = behind + q + ahead
        long = length >= np.maximum(least, exponent * q)
        found.append(np.stack([text, start - behind, length, q], axis=1)[long])
    out = np.concatenate(found)
    out = out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]
    out = out[np.r_[True, (out[1:] != out[:-1]).any(1)][: len(out)]]
    cut = np.searchsorted(out[:, 0], np.arange(len(texts) + 1))
    return [out[a:b, 1:] for a, b in zip(cut[:-1], cut[1:])]


def stretches(words: np.ndarray, group: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that can hold runs; ``group`` parts the documents.

    Every three words in a row inside a run occur often enough in its stretch. ``words`` are
    numbers below 2**21. Counts are first taken over buckets, which can only be too high.
    """
    often = min(exponent - 1, least - 2)
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, np.int64)
    starts, ends = edge[:-1], edge[1:]
    if often < 2 or len(words) < 3:
        return starts, ends
    triples = words[:-2] << 42 | words[1:-1] << 21 | words[2:]
    size, rough = -1, True
    while True:
        long = ends - starts >= max(least, 3)
        starts, ends = starts[long], ends[long]
        held = int((ends - starts).sum())
        if held == size and not rough or not held:
            return starts, ends
        counts = ends - starts - 2
        at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        of = np.repeat(np.arange(len(starts)), counts)
        if rough:
            with np.errstate(over="ignore"):
                mixed = (triples[at].astype(np.uint64) + of.astype(np.uint64) * _ODD) * _ODD
            bucket = (mixed >> np.uint64(42)).astype(np.int64)
            good = np.bincount(bucket, minlength=1 << 22)[bucket] >= often
        else:
            order = np.lexsort((triples[at], of))
            a, b = triples[at][order], of[order]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True])
            good = np.empty(len(at), bool)
            good[order] = np.repeat(np.diff(new) >= often, np.diff(new))
        size, rough = held, False
        first = good & np.r_[True, ~good[:-1] | (of[1:] != of[:-1])]
        last = good & np.r_[~good[1:] | (of[1:] != of[:-1]), True]
        starts, ends = at[first], at[last] + 3


def runs_of(texts: list[str | None], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, np.ndarray, str]]:
    """For each text: its number of words, its runs, and its words without repeats, parted by spaces."""
    words = [(t or "").encode().split() for t in texts]
    numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(words)), sizes)
    if len(numbers) < 1 << 21:
        low, high = stretches(ids, row, least, exponent)
    else:
        low, high = first, first + sizes  # one text of millions of words
    found: dict[int, list[np.ndarray]] = {}
    held = [np.unique(ids[a:b], return_inverse=True)[1] + 1 for a, b in zip(low, high)]
    for a, own in zip(low, find_runs([h.tolist() for h in held], least, exponent)):
        own[:, 0] += a - first[row[a]]
        found.setdefault(int(row[a]), []).append(own)
    out = []
    for k, own_words in enumerate(words):
        own = np.concatenate(found[k]) if k in found else np.zeros((0, 3), np.int64)
        n = len(own_words)
        if len(own):
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 0] + own[:, 1], -1)
            own_words = [own_words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        out.append((n, own, b" ".join(own_words).decode()))
    return out


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (start, length, period by start, then period),
    collapsed (the words that no run repeats, parted by spaces)."""
    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))
    pair = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            found = runs_of(batch.column("text").to_pylist(), least, exponent)
            ends = np.cumsum([0, *[len(own) for _, own, _ in found]]).astype(np.int32)
            own = np.concatenate([own for _, own, _ in found])
            spans = pa.StructArray.from_arrays([pa.array(own[:, k]) for k in range(3)], fields=list(pair))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "n_words": np.array([n for n, _, _ in found], np.int64),
                    "runs": pa.ListArray.from_arrays(pa.array(ends), spans),
                    "collapsed": pa.array([text for _, _, text in found], pa.string()),
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(find, shape).withColumnRenamed("id", id_col)


def planted_words(words: list[bytes], id_: object) -> list[bytes] | None:
    """The words of a document into which the query plants repeats; None where it plants none."""
    h = zlib.crc32(str(id_).encode())
    n, g = len(words), h // 10
    if id_ is None or h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text of ``docs``, with repeats planted into the documents whose id's CRC-32 divides by 10."""
    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            for k, id_ in enumerate(batch.column("id").to_pylist()):
                if id_ is not None and texts[k] and zlib.crc32(str(id_).encode()) % 10 == 0:
                    words = planted_words(texts[k].encode().split(), id_)
                    texts[k] = texts[k] if words is None else b" ".join(words).decode()
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(texts, pa.string())})

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(rewrite, f"id {kind}, text string").toDF(id_col, text_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result of ``repeated_runs`` with its longest run and digests of runs and words."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    # the longest run; of equally long ones the first, then the one of least period
    key = F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(key)
    return found.select(
        ref(id_col),
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        (-best["a"]).alias("length"),
        best["period"].alias("period"),
        F.floor(-best["a"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repeated_runs(plant(table(spark, sf_dir, "documents"))))
