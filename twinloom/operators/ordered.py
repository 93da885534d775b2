"""Order statistics without putting a whole group into one task.

Rows are range-partitioned by group and order, with splitters that Spark samples, and
written once with the number of their range, so that a group of any size and spread is
cut where its rows are. Totals per group and range are few and are accumulated first;
the rows of one range are then ranked or summed on their own and shifted by the total of
the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.staging import attach, stage, tasks

UNIT_BUCKETS = 1024


def ranged(rows: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows``, staged, with the number of their range as ``__range``.

    Ranges follow (groups, order); equal keys share one. The numbers are part of the
    written table, so later tasks agree on them.
    """
    keys = [ref(c) for c in (*groups, *order)]
    spread = rows.repartitionByRange(tasks(rows.sparkSession), *keys)
    return stage(spread.withColumn("__range", F.spark_partition_id()))


def running_totals(counts: DataFrame, groups: Sequence[str], order: str | Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Inclusive running totals of the columns ``sums`` over ``order`` within ``groups``.

    ``counts`` holds one row per (groups, order). Adds ``run_<column>`` and the total of
    the whole group as ``all_<column>``.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = [*groups, "__range"]
    rows = ranged(counts, groups, order)
    totals = rows.groupBy(*keys).agg(*[F.sum(ref(s)).alias(f"__sum_{s}") for s in sums])
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"__sum_{s}").over(before), F.lit(0)).alias(f"__before_{s}") for s in sums],
        *[F.sum(f"__sum_{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    local = Window.partitionBy(*keys).orderBy(*[ref(c) for c in order])
    local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select(
        *[ref(c) for c in rows.columns], *[F.sum(ref(s)).over(local).alias(f"__local_{s}") for s in sums]
    )
    joined = summed.join(offsets, keys)
    return joined.select(
        *[ref(c) for c in counts.columns],
        *[(F.col(f"__local_{s}") + F.col(f"__before_{s}")).alias(f"run_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
    )


def quantiles(counts: DataFrame, groups: Sequence[str], value: str, weight: str, shares: Sequence[float]) -> DataFrame:
    """Rows (groups, share, value): the least value that at least ``share`` of its group does not exceed.

    ``counts`` holds one row per (groups, value) with its number of occurrences. Totals per
    range tell which range holds a rank; only its rows are ranked. Exact, whatever the
    partitioning.
    """
    keys = [*groups]
    rows = ranged(counts, groups, [value])
    totals = rows.groupBy(*keys, "__range").agg(F.sum(ref(weight)).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.select(
        *keys,
        "__range",
        "__sum",
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"),
        F.sum("__sum").over(Window.partitionBy(*keys)).alias("__all"),
    ).withColumn("share", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    rank = F.greatest(F.ceil(F.col("share") * F.col("__all")), F.lit(1))
    held = placed.withColumn("__need", rank - F.col("__before")).filter((F.col("__need") > 0) & (F.col("__need") <= F.col("__sum")))
    named = attach(rows, stage(held.select(*keys, "__range", "share", "__need")), [*keys, "__range"], row_bytes=128)
    local = Window.partitionBy(*keys, "share").orderBy(ref(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = named.withColumn("__run", F.sum(ref(weight)).over(local))
    return run.filter((F.col("__run") >= F.col("__need")) & (F.col("__run") - ref(weight) < F.col("__need"))).select(*keys, "share", ref(value))


def choose_smallest(
    rows: DataFrame,
    groups: Sequence[str],
    u: str,
    tie: str,
    k: int | DataFrame,
    buckets: int = UNIT_BUCKETS,
) -> DataFrame:
    """Add boolean ``chosen``: is the row among the ``k`` smallest ``(u, tie)`` of its group.

    ``u`` is a counter-based uniform in (0, 1), so equal-width buckets are balanced. ``k``
    is a number or a table ``(groups, k)``; without groups it is a number. Counting rows per bucket finds the bucket that
    holds the k-th row; all other rows are decided where they are, and only the rows of
    that bucket (one in ``buckets``) are shuffled, cut into ranges and ranked.
    """
    keys = [*groups]
    placed = rows.withColumn("__bucket", F.floor(ref(u) * F.lit(buckets)).cast("int"))
    totals = placed.groupBy(*keys, "__bucket").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = totals.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    if isinstance(k, DataFrame):
        filled = filled.join(k.select(*keys, F.col("k").alias("__k")), keys)
    else:
        filled = filled.withColumn("__k", F.lit(k))
    holds = (F.col("__before") < F.col("__k")) & (F.col("__before") + F.col("__rows") >= F.col("__k"))
    edges = stage(
        filled.groupBy(*keys).agg(
            # no bucket holds the k-th row: nothing is chosen (k = 0) or everything is
            F.coalesce(F.max(F.when(holds, F.col("__bucket"))), F.max(F.when(F.col("__k") <= 0, -1)), F.lit(buckets)).alias("__edge"),
            F.coalesce(F.max(F.when(holds, F.col("__k") - F.col("__before"))), F.lit(0)).alias("__need"),
        )
    )
    if keys:
        named = attach(placed, edges, keys, row_bytes=128)
    else:
        edge = edges.first()
        named = placed.withColumn("__edge", F.lit(edge["__edge"])).withColumn("__need", F.lit(edge["__need"]))
    columns = [ref(c) for c in rows.columns]
    decided = named.filter(F.col("__bucket") != F.col("__edge")).select(
        *columns, (F.col("__bucket") < F.col("__edge")).alias("chosen")
    )
    inside = named.filter(F.col("__bucket") == F.col("__edge")).select(
        *columns, "__need", F.lit(1).cast("bigint").alias("__one"), F.lit(0).alias("__all")
    )
    ranked = running_totals(inside, keys or ["__all"], [u, tie], ["__one"]).select(
        *columns, (F.col("run___one") <= F.col("__need")).alias("chosen")
    )
    return decided.unionByName(ranked)


def smallest_k(ids: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` smallest distinct keys."""
    counts = ids.select(key).distinct().withColumn("__one", F.lit(1).cast("bigint")).withColumn("__all", F.lit(0))
    ranked = running_totals(counts, ["__all"], key, ["__one"])
    return ranked.filter(F.col("run___one") <= F.lit(k)).select(key)
