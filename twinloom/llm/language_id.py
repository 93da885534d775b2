"""Language identification by rank-order profiles of byte n-grams.

A text's profile is the list of its most frequent n-grams (1 to 3 bytes of its lowered
letters, with every other run of bytes as one gap), most frequent first. A language's
profile is that list over training texts of the language. The out-of-place distance of a
text to a language adds up, over the text's profile, how many places each n-gram is away
from its place in the language's profile, or the profile's length where it is missing. The
language with the least distance is predicted.

Whole texts are read in slices of a few MB per task. The only thing that is collected is
one profile of ``PROFILE`` n-grams per language.

Training reads a bounded sample: rows that are not held out, at most about ``FIT_ROWS`` of
them, an equal share for each language, chosen by the hash of the identifier.

Defined results: null texts and texts without a letter get ``und`` with score 0, as does
every text when there is nothing to learn from; of equally near languages the first by
name wins; null identifiers are not held out; repeated rows get equal results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table
from twinloom.llm.shared import byte_view, held_out, pieces

PROFILE = 400
ORDERS = (1, 2, 3)
FIT_ROWS = 20_000
UNKNOWN = "und"
GAP = ord("_")
SLICE = 1 << 20

_LETTER = np.full(256, GAP, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, code and count of every distinct n-gram of each row, sorted by both."""
    data, offsets = byte_view(column)
    rows = len(offsets) - 1
    # a gap before and after each row, then runs of gaps within a row shrink to one
    joined = np.full(len(data) + 2 * rows, GAP, np.uint8)
    joined[np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, np.diff(offsets))] = _LETTER[data]
    row = np.repeat(np.arange(rows, dtype=np.uint32), np.diff(offsets) + 2)
    keep = np.ones(len(joined), bool)
    keep[1:] = (joined[1:] != GAP) | (joined[:-1] != GAP) | (row[1:] != row[:-1])
    joined, row = joined[keep].astype(np.uint64), row[keep]
    keys = []
    for n in ORDERS:
        size = len(joined) - n + 1
        if size <= 0:
            continue
        code = joined[:size].copy()
        for k in range(1, n):
            code = code << np.uint64(8) | joined[k : size + k]
        inside = row[n - 1 :] == row[:size] if n > 1 else joined != GAP
        keys.append((row[:size].astype(np.uint64) << np.uint64(32) | code)[inside])
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(keys)])
    return (keys[first] >> np.uint64(32)).astype(np.int64), keys[first].astype(np.uint32), counts


def profiles(row: np.ndarray, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``PROFILE`` n-grams of each row by count, then code: row, code, rank."""
    order = np.lexsort((code, -count, row)) if len(row) else np.zeros(0, np.int64)
    row, code = row[order], code[order]
    begin = np.searchsorted(row, row)
    rank = np.arange(len(row)) - begin
    top = rank < PROFILE
    return row[top], code[top], rank[top]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> list[tuple[str, list[int]]]:
    """(language, n-gram codes by rank) for each language of the rows that are not held out."""
    spark = docs.sparkSession
    train = docs.filter(~held_out(id_col) & ref(lang_col).isNotNull() & ref(text_col).isNotNull())
    sizes = {r["lang"]: r["count"] for r in train.groupBy(ref(lang_col).alias("lang")).count().collect()}
    if not sizes:
        return []
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, rows / len(sizes) / n)))])
    draw = F.pmod(F.xxhash64(F.lit("fit"), ref(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = train.filter(draw < F.element_at(share, ref(lang_col)))
    sample = sample.select(ref(text_col).alias("text"), ref(lang_col).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            row, code, n = ngrams(batch.column("text"))
            names, of = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            key, at = np.unique(of[row].astype(np.uint64) << np.uint64(32) | code, return_inverse=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array(names[(key >> np.uint64(32)).astype(int)], pa.string()),
                    "code": (key & np.uint64(0xFFFFFFFF)).astype(np.int64),
                    "n": np.bincount(at, n, len(key)).astype(np.int64),
                }
            )

    grams = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    top = grams.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= PROFILE)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.collect():  # PROFILE rows per language
        found.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return [(lang, [code for _, code in sorted(found[lang])]) for lang in sorted(found)]


def scorer(model: list[tuple[str, list[int]]]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to the best language's number (-1: none) and its score.

    The score is the margin to the second language as a share of that one's distance; with
    a single language, the share of the largest distance that is left.
    """
    codes = np.unique(np.array([c for _, own in model for c in own], np.uint32))
    places = np.full((len(codes) + 1, len(model)), -1, np.int64)
    for k, (_, own) in enumerate(model):
        places[np.searchsorted(codes, np.array(own, np.uint32)), k] = np.arange(len(own))

    def score(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        best, margin = np.full(len(column), -1), np.zeros(len(column))
        row, code, rank = profiles(*ngrams(column))
        if not len(row) or not model:
            return best, margin
        at = np.searchsorted(codes, code)
        at[(at == len(codes)) | (codes[np.minimum(at, len(codes) - 1)] != code)] = len(codes)
        known = places[at]
        off = np.where(known < 0, PROFILE, np.abs(known - rank[:, None]))
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        far = np.add.reduceat(off, begin, axis=0)
        which = row[begin]
        best[which] = far.argmin(1)
        near = np.sort(far, axis=1)
        if len(model) > 1:
            margin[which] = 1 - near[:, 0] / np.maximum(near[:, 1], 1)
        else:
            margin[which] = 1 - near[:, 0] / (PROFILE * np.diff(np.r_[begin, len(row)]))
        return best, margin

    return score


def _judged(docs: DataFrame, model: list[tuple[str, list[int]]], text_col: str) -> DataFrame:
    """``docs`` with a boolean column letter -> the same columns but letter, and lang_pred and score."""
    names = [lang for lang, _ in model]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in pieces(batches, text_col, SLICE):
            best, margin = score(batch.column(text_col))
            best[~batch.column("letter").to_numpy(zero_copy_only=False)] = -1
            columns = {n: batch.column(n) for n in kept}
            columns["lang_pred"] = pa.array([names[k] if k >= 0 else UNKNOWN for k in best], pa.string())
            columns["score"] = np.where(best >= 0, margin, 0.0)
            yield pa.RecordBatch.from_pydict(columns)

    kept = [c for c in docs.columns if c != "letter"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(judge, f"{schema}, lang_pred string, score double")


def _letter(text):
    return F.coalesce(F.regexp_like(text, F.lit("\\p{L}")), F.lit(False)).alias("letter")


def predict(docs: DataFrame, model: list[tuple[str, list[int]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score."""
    text = ref(text_col)
    rows = docs.select(ref(id_col).alias("id"), held_out(id_col).alias("held_out"), text.alias("text"), _letter(text))
    return _judged(rows, model, "text").select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: list[tuple[str, list[int]]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a predicted language, with all their columns.

    Where no language could be learned, those with a letter.
    """
    if not model:
        return docs.filter(_letter(ref(text_col)))
    held = docs.select(*[ref(c).alias(f"c{k}") for k, c in enumerate(docs.columns)], _letter(ref(text_col)))
    found = _judged(held, model, f"c{docs.columns.index(text_col)}").filter(F.col("lang_pred") != UNKNOWN)
    return found.select([F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
