"""Importance resampling towards a target distribution of hashed word n-grams.

A text is turned into lower-case words parted by single spaces: A-Z is lowered, every run of
other separators becomes one space. An overlapped regular expression whose lookarounds
hold the word boundaries then emits the span of every run of ``low`` to ``high`` words, and
the CRC-32 of each span picks one of ``buckets``. The raw corpus and the target corpus are
counted per bucket over all their texts; a document's weight is the mean log-odds of its
features, and a Gumbel number made from its identifier turns weights into a draw without
replacement: the highest scores are drawn.

Texts are read once, in slices of a few MB; their bucket counts are staged, so scoring does
not read them again. Bucket totals are added up per task, then per block of buckets across
tasks. What is collected: the two tables of totals (``buckets`` numbers each) and the number
of documents per score (scores are whole numbers of a few tens of thousands). Drawn
documents are numbered by sampled ranges of (score, id), not in one task.

Defined results: null and empty texts have no features and weight 0; a null identifier is
hashed as the empty text; equal scores go by identifier (null first), then in any order among
rows that are alike; repeated rows each get a rank of their own; without a target text every
target count is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table
from twinloom.llm.shared import pieces, stage, tasks
from twinloom.llm.sqltext import CRC_TABLE, crc32
from twinloom.operators.ordered import running_totals

BUCKETS = 10_000
LOW, HIGH = 1, 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
BLOCKS = 16

_SEPARATOR = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spans(low: int, high: int) -> list[regex.Pattern]:
    """One pattern per length: so many words that begin and end at word boundaries."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(low, high + 1)]


def collapsed(text: bytes) -> bytes:
    """A-Z lowered, every run of separators as one space, none at the ends."""
    return _SEPARATOR.sub(b" ", text.lower()).strip(b" ")


def features(text: bytes, patterns: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words of a text, the buckets of its features, and how often each occurs."""
    flat = collapsed(text)
    counts: Counter[bytes] = Counter()
    for pattern in patterns:
        counts.update(map(itemgetter(0), pattern.finditer(flat, overlapped=True)))
    words = flat.count(b" ") + 1 if flat else 0
    if not counts:
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket, at = np.unique([zlib.crc32(span) % buckets for span in counts], return_inverse=True)
    return words, bucket, np.bincount(at, list(counts.values())).astype(np.int64)


def bucket_counts(rows: DataFrame, text: str, low: int, high: int, buckets: int) -> DataFrame:
    """The columns of ``rows`` with ``text`` replaced by words, features, bucket and times (arrays)."""
    kept = [c for c in rows.columns if c != text]
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept], "words long, n_features long, bucket array<int>, times array<long>"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = spans(low, high)
        for batch in pieces(batches, text, 1 << 20):
            found = [features((t or "").encode(), patterns, buckets) for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *[len(b) for _, b, _ in found]]).astype(np.int32)
            bucket = np.concatenate([b for _, b, _ in found]).astype(np.int32)
            times = np.concatenate([t for _, _, t in found])
            columns = {c: batch.column(c) for c in kept}
            columns["words"] = np.array([w for w, _, _ in found], np.int64)
            columns["n_features"] = np.array([t.sum() for _, _, t in found], np.int64)
            columns["bucket"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket))
            columns["times"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(times))
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(count, schema)


def totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs over all rows of ``bucket_counts``."""
    size = -(-buckets // BLOCKS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size * BLOCKS, np.int64)
        for batch in batches:
            bucket, times = (batch.column(c).flatten().to_numpy() for c in ("bucket", "times"))
            np.add.at(sums, bucket, times)
        if sums.any():
            parts = [p.tobytes() for p in sums.reshape(BLOCKS, size)]
            yield pa.RecordBatch.from_pydict({"block": np.arange(BLOCKS), "sums": pa.array(parts, pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(part, np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": list(sums), "sums": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    shape = "block long, sums binary"
    parts = counted.select("bucket", "times").mapInArrow(add, shape)
    out = np.zeros((BLOCKS, size), np.int64)
    for r in parts.repartition(tasks(counted.sparkSession), "block").mapInArrow(total, shape).collect():  # ``buckets`` numbers
        out[r["block"]] = np.frombuffer(r["sums"], np.int64)
    return out.reshape(-1)[:buckets]


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket in thousandths, rounded down; counts are raised by one."""
    s, t, n = raw.astype(np.float64), target.astype(np.float64), float(len(raw))
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """``counted`` with the mean gain of each row's features, rounded down, as ``weight``."""
    kept = [c for c in counted.columns if c not in ("bucket", "times")]
    schema = ", ".join([*[f"`{c}` {counted.schema[c].dataType.simpleString()}" for c in kept], "weight long"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bucket")
            bucket, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row, gain[bucket] * times)
            n = batch.column("n_features").to_numpy()
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in kept}, "weight": sums // np.maximum(n, 1)})

    return counted.mapInArrow(weigh, schema)


def gumbel(seed: int, id_: Column) -> Column:
    """A Gumbel number in thousandths, rounded down, from the hash of seed and identifier."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    low: int = LOW,
    high: int = HIGH,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank (null where not drawn)."""
    # the row's own number keeps alike rows apart when ranks are cut into ranges
    named = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"), F.monotonically_increasing_id().alias("at"))
    counted = stage(bucket_counts(named, "text", low, high, buckets))
    goal = bucket_counts(target.select(ref(target_col).alias("text")), "text", low, high, buckets)
    gain = gains(totals(counted, buckets), totals(goal, buckets))
    scored = weighted(counted, gain).withColumn("score", F.col("weight") + gumbel(seed, F.col("id")))
    scored = stage(scored.withColumn("eligible", F.col("words") >= least_words))
    levels = sorted(((r["score"], r["n"]) for r in scored.filter("eligible").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in levels) // 100
    # the score of the last drawn document; only rows from there on are ranked
    reach, last = 0, None
    for last, n in levels:
        reach += n
        if reach >= drawn:
            break
    near = F.col("eligible") & (F.col("score") >= F.lit(last)) if drawn else F.lit(False)
    columns = ["id", "n_features", "weight", "score"]
    front = scored.filter(near).select(*columns, "at", (-F.col("score")).alias("order"), F.lit(1).cast("long").alias("one"), F.lit(0).alias("all"))
    ranked = running_totals(front, ["all"], ["order", "id", "n_features", "weight", "at"], ["one"])
    rank = F.when(F.col("run_one") <= F.lit(drawn), F.col("run_one"))
    rest = scored.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.alias("rank")).unionByName(rest).withColumnRenamed("id", id_col)


def _words(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op11_importance_resampling",
    f"""
with recursive {CRC_TABLE},
words as (select doc_id, unnest({_words('text')}) as w from documents),
goal as (select unnest({_words('text')}) as w from benchmark),
hashed as (select w, {crc32('w')} % {BUCKETS} as b from (select w from words union select w from goal), crc_table),
raw as (select b, count(*) as s from words join hashed using (w) group by 1),
target as (select b, count(*) as t from goal join hashed using (w) group by 1),
gain as (
  select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from words) + {BUCKETS})::double
    / ((s + 1)::double * ((select count(*) from goal) + {BUCKETS})::double)))::bigint as g
  from raw left join target using (b)),
means as (select doc_id, floor(sum(g)::double / count(*)::double)::bigint as weight, count(*) as n from words join hashed using (w) join gain using (b) group by 1),
scored as (
  select d.doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from documents d left join means m on m.doc_id = d.doc_id),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r from scored where n_features >= {LEAST_WORDS})
select doc_id, n_features, weight, score,
  case when r <= (select {PERCENT} * count(*) // 100 from ranked) then r end::bigint as rank
from scored left join ranked using (doc_id)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
