"""From synthetic cells to output tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions.counter import name_key, with_uniform
from twinloom.functions.names import ref
from twinloom.operators.ordered import choose_smallest
from twinloom.operators.prep import null_to_zero
from twinloom.staging import tasks

FILL_STREAM = 13
KEY_RANGE = 10_001
KEY_STREAM = 14
_CHUNK = 4096


def synth_index(df: DataFrame, n_synth: int | Column) -> DataFrame:
    """Every row of ``df`` with ``synth`` 0 .. n_synth - 1 (at least 1), in bounded chunks."""
    n_synth = (n_synth if isinstance(n_synth, Column) else F.lit(n_synth)).cast("bigint")
    chunks = F.ceil(n_synth / F.lit(_CHUNK))
    outer = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    outer = outer.repartition(tasks(df.sparkSession), *[ref(c) for c in df.columns], "__chunk")
    start = F.col("__chunk").cast("bigint") * F.lit(_CHUNK)
    stop = F.least(start + F.lit(_CHUNK), n_synth) - F.lit(1)
    return outer.withColumn("synth", F.explode(F.sequence(start, stop))).drop("__chunk")


def low_count_fill(stats: DataFrame, n_synth: int | Column, seed: int) -> DataFrame:
    """Cells (synth, feature, value) of the features that are not modelled.

    ``stats`` (staged) holds feature, mean and n_zero. Exactly ``n_zero`` synthetic rows
    per feature get 0.0, at random places; the others get the mean.
    """
    n_synth = n_synth if isinstance(n_synth, Column) else F.lit(n_synth)
    named = stats.select("feature", "mean", name_key(F.col("feature")).alias("__name"), n_synth.alias("__size"))
    rows = synth_index(named, F.col("__size")).drop("__size")
    rolled = with_uniform(rows, "__u", seed + FILL_STREAM, "synth", "__name")
    picked = choose_smallest(
        rolled, ["feature"], "__u", "synth", stats.select("feature", F.col("n_zero").alias("k"))
    )
    return picked.select(
        "synth", "feature", F.when(F.col("chosen"), F.lit(0.0)).otherwise(F.col("mean")).alias("value")
    )


def fill_from(stats: DataFrame, names: Sequence[str], all_features: DataFrame) -> DataFrame:
    """``stats`` of the named features; an unknown name is an error."""
    known = all_features.filter(F.col("feature").isin(list(names))).select("feature").distinct().count()
    if known != len(set(names)):
        raise ValueError("a low-count feature was not found in the original data")
    return stats.filter(F.col("feature").isin(list(names)))


def clinical_table(
    numbers: DataFrame, levels: DataFrame | None, columns: Sequence[str], types: dict[str, str], categories: Sequence[str]
) -> DataFrame:
    """Wide clinical rows (synth, columns in order) from numeric cells and category levels."""
    numeric = [c for c in columns if c not in categories]
    cells = numbers.select("synth", "feature", F.col("value").cast("string").alias("text"))
    if levels is not None:
        cells = cells.unionByName(levels.select("synth", "feature", F.col("level").alias("text")))
    wide = cells.groupBy("synth").pivot("feature", [*numeric, *categories]).agg(F.max("text"))

    def typed(name: str) -> Column:
        value = ref(name)
        if name in numeric and types[name] in ("tinyint", "smallint", "int", "bigint"):
            value = F.round(value.cast("double"))
        return value.cast(types[name]).alias(name)

    return wide.select("synth", *[typed(c) for c in columns])


def merge_groups(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of per-group tables of one schema, with ``part`` = position in the list."""
    tagged = [t.withColumn("part", F.lit(i)) for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def merge_pairs(
    clinical: Sequence[DataFrame], features: Sequence[DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Both table lists merged; nulls in features become 0, clinical nulls stay."""
    if len(clinical) != len(features):
        raise ValueError(f"{len(clinical)} clinical tables do not pair with {len(features)} feature tables")
    return merge_groups(clinical), null_to_zero(merge_groups(features))


def key_offset(spark, seed: int) -> int:
    """Offset of the surrogate keys: uniform on 0..10000, a function of the seed."""
    one = with_uniform(spark.range(1), "u", seed + KEY_STREAM, "id")
    return int(one.first()["u"] * KEY_RANGE)


def surrogate_key(df: DataFrame, sizes: Sequence[int], offset: int, key: str = "id") -> DataFrame:
    """Replace (part, synth) by one key: offset + 1 .. offset + total, parts in order.

    ``synth`` is dense within a part and the part sizes are known, so no ranking is needed
    and both tables get the same key for the same row.
    """
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    base = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("part") + 1)
    rest = [ref(c) for c in df.columns if c not in ("part", "synth")]
    return df.select((F.lit(offset + 1) + base + F.col("synth")).alias(key), *rest)
