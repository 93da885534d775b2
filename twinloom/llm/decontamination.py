"""Benchmark decontamination by suffix arrays of the training documents.

A shard is a slice of a task's documents. The suffixes of its words are sorted: by three
words first, then by doubling among those still tied, never beyond a document's end. Every
suffix of every benchmark item is searched in the sorted array by halving. The suffixes that share a
window of ``WINDOW`` words with it (or the whole item, if that is shorter) form a range of the
array: all places where the window occurs. The neighbours of the insertion point hold the
longest match of any length (``longest_matches``), and neighbouring windows on one diagonal
make up one match of a document with its places on both sides.

The benchmark is made distinct and read in blocks of about ``BLOCK_BYTES``; each block is one pass
over the documents, whose results are united per document. A longer item is a block of its own.

Defined results: null texts have no words; an item of fewer than 13 words, but not none, is
one window; equal windows of several items count for each; items with a null id count as
an item without a name in ``n_items`` and are left out of the list; rows with repeated ids
are judged each; with an empty benchmark nothing is hit; an empty table gives no rows;
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
from twinloom.llm.shared import Words, pieces, stage, words_of
from twinloom.operators.ordered import running_totals

WINDOW = 13
#: A document is contaminated if hit words are at least one in so many of its words.
SHARE = 20
BLOCK_BYTES = 16 << 20
#: Bytes of text whose suffixes are sorted together.
SHARD = 2 << 20


def sorted_suffixes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of ``codes`` (numbers from 1 on) in the order of the suffixes that begin there.

    ``ends``: where the document of each place ends. Suffixes of two documents that are equal
    up to both ends stay in order of place.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    place = np.arange(n)

    def ahead(values: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """The value ``step`` places on, 0 beyond the document."""
        to = at + step
        return np.where(to < ends[at], values[np.minimum(to, n - 1)], 0)

    if codes.max() < 1 << 21:
        key, known = codes << 42 | ahead(codes, place, 1) << 21 | ahead(codes, place, 2), 3
    else:
        key, known = codes << 31 | ahead(codes, place, 1), 2
    order = np.argsort(key, kind="stable")
    key = key[order]
    # the rank of a place is one more than the first index of its group of ties
    fresh = np.r_[True, key[1:] != key[:-1]]
    first = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n])) + 1
    tied = ~(fresh & np.r_[fresh[1:], True])
    while tied.any():
        index = np.flatnonzero(tied)
        at = order[index]
        old, after = rank[at], ahead(rank, at, known)
        if not after.any():
            break
        pair = old << 32 | after
        by = np.argsort(pair, kind="stable")
        at, old, pair = at[by], old[by], pair[by]
        order[index] = at
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        first = np.flatnonzero(fresh)
        own = np.repeat(first, np.diff(np.r_[first, len(pair)]))
        group = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        begin = np.repeat(group, np.diff(np.r_[group, len(old)]))
        rank[at] = old + own - begin
        still = ~(fresh & np.r_[fresh[1:], True])
        if len(first) == len(group):  # nothing was told apart, nor will it be
            break
        tied = np.zeros(n, bool)
        tied[index[still]] = True
        known *= 2
    return order


class Shard:
    """Suffix array of one slice of documents, searched for suffixes of benchmark items."""

    def __init__(self, words: Words):
        self.vocabulary, codes = np.unique(words.hashes, return_inverse=True)
        self.ends = words.offsets[1:][words.row] if len(words) else np.zeros(0, np.int64)
        self.codes = codes.astype(np.int64) + 1
        self.order = sorted_suffixes(self.codes, self.ends)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Words in the order of the shard's codes: twice the code, or an odd number in between."""
        at = np.searchsorted(self.vocabulary, hashes)
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int64)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes
        return np.where(known, 2 * at + 2, 2 * at + 1)

    def compare(self, places: np.ndarray, wanted: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common words of the suffixes at ``places`` and ``wanted[start:stop]``, and whether the
        suffix comes before: it does not if all wanted words are there."""
        common, before = np.zeros(len(places), np.int64), np.zeros(len(places), bool)
        live = np.flatnonzero(stop > start)
        while len(live):
            mine, theirs = places[live] + common[live], start[live] + common[live]
            word = np.where(mine < self.ends[places[live]], 2 * self.codes[np.minimum(mine, len(self.codes) - 1)], 0)
            other = wanted[theirs]
            same = word == other
            before[live[~same]] = word[~same] < other[~same]
            live = live[same]
            common[live] += 1
            live = live[start[live] + common[live] < stop[live]]
        return common, before

    def bound(self, wanted: np.ndarray, start: np.ndarray, stop: np.ndarray, past: bool) -> np.ndarray:
        """How many suffixes come before ``wanted[start:stop]``; with ``past``, those that begin with it too."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order))
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) // 2
            common, before = self.compare(self.order[middle], wanted, start[live], stop[live])
            left = before | (past & (common == stop[live] - start[live]))
            low[live] = np.where(left, middle + 1, low[live])
            high[live] = np.where(left, high[live], middle)
            live = live[low[live] < high[live]]
        return low

    def longest(self, wanted: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and place of the longest match of each ``wanted[start:stop]``: one of its two neighbours."""
        if not len(self.order):
            return np.zeros(len(start), np.int64), np.full(len(start), -1)
        at = self.bound(wanted, start, stop, False)
        found = []
        for near in (np.minimum(at, len(self.order) - 1), np.maximum(at - 1, 0)):
            found.append((self.compare(self.order[near], wanted, start, stop)[0], self.order[near]))
        better = found[1][0] > found[0][0]
        return np.where(better, found[1][0], found[0][0]), np.where(better, found[1][1], found[0][1])


class Block:
    """A bounded block of benchmark items: their words, and a window at every place that has one."""

    def __init__(self, items: list[str | None], texts: list[str | None], window: int = WINDOW):
        self.words = words_of(pa.array(texts, pa.string()))
        self.items, self.offsets = items, self.words.offsets
        lengths = np.diff(self.offsets)
        # (item, first word, length) of each window; short items are one window each
        size = np.minimum(lengths, window)
        count = np.where(lengths > 0, lengths - size + 1, 0)
        self.item = np.repeat(np.arange(len(items)), count)
        self.start = np.repeat(self.offsets[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.length = size[self.item]

    def search(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(window, document word where it occurs) pairs over one shard."""
        wanted = shard.numbers(self.words.hashes)
        # a window with a word that the shard lacks occurs nowhere in it
        lacking = np.r_[0, np.cumsum(wanted % 2)]
        chosen = np.flatnonzero(lacking[self.start + self.length] == lacking[self.start])
        start, stop = self.start[chosen], self.start[chosen] + self.length[chosen]
        low = shard.bound(wanted, start, stop, False)
        here = np.flatnonzero(low < len(shard.order))
        here = here[shard.compare(shard.order[low[here]], wanted, start[here], stop[here])[0] == (stop - start)[here]]
        high = shard.bound(wanted, start[here], stop[here], True)
        n = high - low[here]
        at = np.repeat(low[here], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(chosen[here], n), shard.order[at]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The different (item, text) pairs in blocks of about ``BLOCK_BYTES``."""
    rows = benchmark.select(ref(item_col).cast("string").alias("item"), ref(text_col).alias("text")).filter("text is not null")
    rows = stage(rows.distinct().withColumn("size", F.octet_length("text").cast("long")).withColumn("all", F.lit(0)))
    run = stage(running_totals(rows.withColumn("hash", F.xxhash64("item", "text")), ["all"], ["hash", "item", "text"], ["size"]))
    run = run.withColumn("block", F.floor((F.col("run_size") - F.col("size")) / BLOCK_BYTES))
    for r in run.select("block").distinct().orderBy("block").collect():
        yield [(x["item"], x["text"]) for x in run.filter(F.col("block") == r["block"]).collect()]  # one bounded block


MATCH = "struct<item: string, item_word: long, doc_word: long, n_words: long>"
FOUND = [("n_words", "long"), ("n_hit", "long"), ("matches", f"array<{MATCH}>")]
_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])


def longest(block: Block, words: Words) -> list[list[dict]]:
    """Longest verbatim matches of each row: overlapping windows on one diagonal are one match."""
    window, at = block.search(Shard(words))
    out: list[list[dict]] = [[] for _ in range(words.rows)]
    if not len(at):
        return out
    order = np.lexsort((at, at - block.start[window], words.row[at], block.item[window]))
    window, at = window[order], at[order]
    item, diagonal, row = block.item[window], at - block.start[window], words.row[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (row[1:] != row[:-1]) | (np.diff(at) != 1)
    begin = np.flatnonzero(fresh)
    stop = np.r_[begin[1:], len(at)] - 1
    for a, b in zip(begin.tolist(), stop.tolist()):
        out[row[a]].append(
            {
                "item": block.items[item[a]],
                "item_word": int(block.start[window[a]] - block.offsets[item[a]]),
                "doc_word": int(at[a] - words.offsets[row[a]]),
                "n_words": int(at[b] - at[a] + block.length[window[b]]),
            }
        )
    return out


def _covered(matches: list[dict]) -> int:
    """Words inside at least one match."""
    total, end = 0, 0
    for m in sorted(matches, key=lambda m: m["doc_word"]):
        stop = m["doc_word"] + m["n_words"]
        total += max(0, stop - max(end, m["doc_word"]))
        end = max(end, stop)
    return total


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` (columns of any names, none of ``FOUND``) with n_words, n_hit and matches."""
    names = [n for n, _ in FOUND]
    out = docs.withColumns(
        {"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "matches": F.array().cast(FOUND[2][1])}
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    blocks = list(_blocks(benchmark, item_col, item_text)) or [[]]
    for k, items in enumerate(blocks):

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            block = Block([i for i, _ in items], [t for _, t in items], window)
            for batch in pieces(batches, text_col, SHARD):
                words = words_of(batch.column(text_col))
                old = batch.column("matches").to_pylist()
                found = [a + b for a, b in zip(old, longest(block, words))]
                columns = {n: batch.column(n) for n in batch.schema.names if n not in names}
                columns["n_words"] = np.diff(words.offsets)
                columns["n_hit"] = pa.array([_covered(m) for m in found], pa.int64())
                columns["matches"] = pa.array(found, pa.list_(_MATCH))
                yield pa.RecordBatch.from_pydict(columns)

        out = out.mapInArrow(search, schema)
        if k + 1 < len(blocks):
            out = stage(out)
    return out


def _contaminated():
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, matches."""
    rows = find_matches(docs.select(ref(id_col).alias("__id"), ref(text_col).alias("__text")), benchmark, "__text")
    items = F.array_distinct(F.transform("matches", lambda m: m["item"]))
    return rows.select(
        F.col("__id").alias(id_col),
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
        "matches",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    held = docs.select([ref(c).alias(f"__{k}") for k, c in enumerate(docs.columns)])
    found = find_matches(held, benchmark, f"__{docs.columns.index(text_col)}")
    return found.filter(~_contaminated()).select([F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)])


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The longest verbatim match of every benchmark item: item, n_words, item_word, doc_id, doc_word.

    Of equally long ones the first in the item, then the least document id. Items without a
    word in common with any document have no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))
    out = None
    for items in _blocks(benchmark, item_col, item_text):

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            block = Block([i for i, _ in items], [t for _, t in items])
            item = block.words.row
            start, stop = np.arange(len(item)), block.offsets[1:][item]
            for batch in pieces(batches, "text", SHARD):
                words = words_of(batch.column("text"))
                shard = Shard(words)
                common, at = shard.longest(shard.numbers(block.words.hashes), start, stop)
                # the best of each item in this shard
                by = np.lexsort((start, -common, item))
                best = by[np.r_[True, item[by][1:] != item[by][:-1]]] if len(by) else by
                best = best[common[best] > 0]
                row = words.row[at[best]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "item": pa.array([block.items[k] for k in item[best]], pa.string()),
                        "n_words": common[best],
                        "item_word": best - block.offsets[item[best]],
                        "id": batch.column("id").take(pa.array(row)),
                        "doc_word": at[best] - words.offsets[row],
                    }
                )

        found = rows.mapInArrow(search, f"item string, n_words long, item_word long, id {kind}, doc_word long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.limit(0).selectExpr("cast(null as string) item", "0L n_words", "0L item_word", "id", "0L doc_word").withColumnRenamed("id", id_col)
    first = F.min(F.struct((-F.col("n_words")).alias("a"), "item_word", "id", "doc_word"))
    best = out.groupBy("item").agg(first.alias("m"))
    return best.select("item", (-F.col("m.a")).alias("n_words"), "m.item_word", F.col("m.id").alias(id_col), "m.doc_word")


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    "op7_decontamination",
    f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
windows as (
  select item_id, w[i : i + least(len(w), {WINDOW}) - 1] as g, least(len(w), {WINDOW}) as n
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i from b where len(w) > 0)),
grams as (
  select doc_id, i, n, w[i : i + n - 1] as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows))),
found as (select doc_id, i, grams.n, item_id from grams join windows on grams.g = windows.g),
hits as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by 1),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
  from (select distinct doc_id, item_id::varchar as item from found) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(list, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")
