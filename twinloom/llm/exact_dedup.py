"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, an external sort places equal
texts next to each other, and each row is compared in full with its neighbour. The row
with the smallest identifier of a run of equal texts stays.

The sort key begins with the first characters of the normalised text, its SHA-256 and a
salt of the identifier. Splitters therefore stay short, and copies of one text lie side by
side without having to share a task: a run that is spread over salts is joined by its
digest afterwards, from one row per salt.

Defined results: null text counts as empty; a null identifier sorts last; of repeated rows
with the same identifier and text one row stays; an empty table gives no rows; other
columns are ignored (``exact_dedup``) or carried along unchanged (``keep_first``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table
from twinloom.llm.shared import stage

SALTS = 64
LEAD_CHARS = 32
#: Runs of space and the controls tab to carriage return become one space.
SPACES = "[ \\x09-\\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """Adds __head (first row of a run of equal texts within its salt) and __run.

    ``rows`` has __id and __text. One exchange: the window's keys are those of the range
    partitioning.
    """
    norm = normalised(F.col("__text"))
    keyed = rows.withColumns(
        {
            "__lead": F.substring(norm, 1, LEAD_CHARS),
            "__sha": F.unhex(F.sha2(norm, 256)),
            "__salt": F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"),
        }
    )
    spread = keyed.repartitionByRange("__lead", "__sha", "__salt").withColumn("__norm", norm)
    near = Window.partitionBy("__lead", "__sha", "__salt").orderBy("__norm", F.col("__id").asc_nulls_last())
    headed = spread.withColumn("__head", ~F.col("__norm").eqNullSafe(F.lag("__norm").over(near)))
    return headed.withColumn("__run", F.sum(F.col("__head").cast("int")).over(near)).drop("__norm", "__lead")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(ref(id_col).alias("__id"), ref(text_col).alias("__text"))
    marked = stage(_sorted_runs(rows).select("__id", "__sha", "__salt", "__run", "__head"))
    parts = marked.groupBy("__sha", "__run", "__salt").agg(
        F.min("__id").alias("__least"), F.count(F.lit(1)).alias("__rows")
    )
    group = Window.partitionBy("__sha", "__run")
    groups = parts.select(
        "__sha",
        "__run",
        "__salt",
        F.min("__least").over(group).alias("keep_id"),
        F.sum("__rows").over(group).alias("group_size"),
    )
    joined = marked.join(groups, ["__sha", "__run", "__salt"])
    return joined.select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("__head") & F.col("__id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only the first row of a run can stay, so at most one row per text and salt meets in
    the second step.
    """
    packed = docs.select(ref(id_col).alias("__id"), F.struct("*").alias("__row"))
    heads = _sorted_runs(packed.withColumn("__text", F.col("__row").getField(text_col)))
    heads = heads.filter("__head").select("__id", "__sha", "__run", "__row")
    order = Window.partitionBy("__sha", "__run").orderBy(F.col("__id").asc_nulls_last())
    first = heads.withColumn("__place", F.row_number().over(order)).filter("__place = 1")
    return first.select([F.col("__row").getField(c).alias(c) for c in docs.columns])


@query(
    "op6_exact_dedup",
    r"""
with norm as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
       row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from norm window g as (partition by t)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
